"""The store: documents, chunks, lexical index and vectors, in immutable segments.

A change writes new segments and then creates the next numbered pointer, so readers see the old
state or the new one and never a mix, and of two writers at once none loses its work unseen.
An import writes its own papers' segments only; what it replaces is named in a tombstone file.
``compact`` merges segments of about one size.  Publication of an index with its chunk table is
one such change.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import chunking, dense, lexical, store
from sheaf.schemas import SCHEMA_VERSION
from sheaf.segments import Segments, State, fresh_name, runs
from sheaf.storage import CatalogError, Files, shared_folder, spark_array, written

__all__ = ["Catalog", "CatalogError", "Files", "mapping_fingerprint", "migrate", "replaced", "shared_folder", "spark_array", "written"]


class Catalog:
    """Documents, chunks and their lexical index, replaced paper by paper, with guarded vectors."""

    #: Tables that are divided by section type.
    DIVIDED = ("postings", "lengths", "terms")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root.rstrip("/"))
        self.segments = Segments(spark, self.root, SCHEMA_VERSION)
        if self.files.exists("current.json"):
            raise CatalogError("the store is of an older version; import its documents anew")
        version = self.pointer().get("schema_version")
        if version != SCHEMA_VERSION:
            raise CatalogError(f"schema version {version} is not {SCHEMA_VERSION}; migrate first")

    def pointer(self) -> State:
        return self.segments.state()

    def current(self) -> str | None:
        """The name of the store's state; another one after every change."""
        version = self.pointer()["version"]
        return f"{version:012d}" if version else None

    def table(self, name: str, state: State | None = None) -> DataFrame | None:
        """The live rows of a table."""
        state = state or self.pointer()
        rows = self.segments.live(state, name)
        return lexical.summed(rows) if rows is not None and name == "terms" and len(state["tables"][name]) > 1 else rows

    def index(self) -> lexical.Index:
        """The stored lexical index of all chunks."""
        state = self.pointer()
        tables = [self.table(t, state) for t in self.DIVIDED]
        if any(t is None for t in tables):
            raise CatalogError("the store has no lexical index")
        return lexical.Index(*tables, totals={kind: (n, total) for kind, (n, total) in state["totals"].items()})

    def _added(self, state: State, tables: dict[str, DataFrame], name: str) -> dict[str, dict[str, Any]]:
        """Write a segment of each table; the entries, and the tables' schemas into ``state``."""
        entries = {}
        for key, rows in tables.items():
            entries[key] = self.segments.write(key, name, rows, key in self.DIVIDED)
            state["schemas"].setdefault(key, rows.schema.json())
        return entries

    def publish(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), entries: dict[str, dict[str, Any]] | None = None, **facts: Any) -> str:
        """Replace whole tables, each by one segment; refused if the store changes meanwhile.

        ``entries``: of tables whose segment is written already.
        """
        base, name = self.pointer(), fresh_name()
        return self._replace(base, {**self._added(base, tables, name), **(entries or {})}, base["schemas"], drop, **facts)

    def _replace(self, base: State, entries: dict[str, dict[str, Any]], schemas: dict[str, str], drop: tuple[str, ...] = (), **facts: Any) -> str:
        def change(state: State) -> State:
            kept = {k: v for k, v in state["tables"].items() if k not in drop}
            tables = kept | {key: [{**entry, "seq": state["seq"]}] for key, entry in entries.items()}
            if "vectors" in drop:
                state.pop("index", None)
            return {**state, "tables": tables, "schemas": {**state["schemas"], **schemas}, "change": {"kind": "replace"}, **facts}

        return f"{self.segments.commit(base, change)['version']:012d}"

    def import_papers(self, documents: DataFrame, chunks: DataFrame, now: datetime | None = None, source: tuple[str, int] | None = None, chunkless: bool = False) -> str:
        """Replace the given papers as a whole, index their text; refused for papers that have vectors.

        Documents get the time of their first import and of this one.  The new chunks are
        written first and checked where they lie, so a broken import leaves the old state.
        Another import meanwhile is no obstacle unless it has one of these papers.  ``source``
        names a stream and the number of its batch: a batch that the store has taken already, or
        one before it, changes nothing.  A document without chunks is refused, unless ``chunkless``
        says that there may be blank ones.
        """
        base, name, schemas = self.pointer(), fresh_name(), {}
        if self._taken(base, source):
            return f"{base['version']:012d}"
        chunks, documents = (self.segments.shaped(base, t, rows) for t, rows in (("chunks", chunks), ("documents", documents.drop("ingested_at", "updated_at"))))
        entries = {"chunks": self.segments.write("chunks", name, chunks, False)}
        schemas["chunks"] = base["schemas"].get("chunks", chunks.schema.json())
        fresh = self.spark.read.schema(chunks.schema).parquet(self.segments.place("chunks", name))
        broken = chunking.violations(fresh).collect()
        if broken:
            raise CatalogError("chunks break rules: " + ", ".join(sorted(r["rule"] for r in broken)))
        if not chunkless and documents.select("paper_id").join(fresh.select("paper_id").distinct(), "paper_id", "left_anti").limit(1).count():
            raise CatalogError("a document has no chunks")
        papers = documents.select("paper_id").distinct()
        time = F.lit(now or datetime.now(timezone.utc)).cast("timestamp")
        documents = documents.withColumns({"ingested_at": time, "updated_at": time})
        stored = self.table("documents", base)
        before = None if stored is None else written(stored.join(papers, "paper_id", "left_semi"))
        if before is not None and not before.limit(1).count():
            before = None
        if before is not None:
            self._without_vectors(base, before)
            first = before.select("paper_id", F.col("ingested_at").alias("__first"))
            documents = documents.join(first, "paper_id", "left").withColumn("ingested_at", F.coalesce("__first", "ingested_at")).select(*documents.columns)
        # the document's title is indexed where a chunk has none
        titled = lambda rows, docs: store.indexed_rows(rows, docs) if "paper_title" in docs.columns else rows
        # the terms are stored once, and the rest of the index is made of what is stored
        entries |= self._added({"schemas": schemas}, {"lengths": lexical.lengths(lexical.analysed(titled(fresh, documents)))}, name)
        analysed = self.segments.read({"schemas": schemas}, "lengths", [entries["lengths"]])
        counts, totals = lexical.term_counts(analysed), lexical.totals(analysed)
        tombstone = None
        if before is not None:
            # what the replaced papers added to the counts is taken back
            old = self.table("lengths", base).join(before.select("paper_id"), "paper_id", "left_semi")
            counts = lexical.summed(counts.unionByName(lexical.term_counts(old).withColumn("df", -F.col("df"))))
            for kind, (n, length) in lexical.totals(old).items():
                had = totals.get(kind, (0, 0))
                totals[kind] = (had[0] - n, had[1] - length)
            tombstone = f"tombstones/{name}"
            before.select("paper_id").write.parquet(f"{self.root}/{tombstone}")
        rest = {"documents": documents, "postings": lexical.postings(analysed), "terms": counts}
        entries |= self._added({"schemas": schemas}, rest, name)

        def change(state: State) -> State:
            seq = state["seq"] + 1
            for key, entry in entries.items():
                state["tables"].setdefault(key, []).append({**entry, "seq": seq})
                state["schemas"].setdefault(key, schemas[key])
            for kind, (n, length) in totals.items():
                had = state["totals"].get(kind, (0, 0))
                state["totals"][kind] = [had[0] + n, had[1] + length]
            if tombstone:
                state["tombstones"].append({"place": tombstone, "seq": seq})
            if source:
                state["sources"] = {**state.get("sources", {}), source[0]: source[1]}
            return {**state, "seq": seq, "change": {"kind": "import", "documents": name}}

        def settle(other: State) -> None:
            if self._taken(other, source):
                raise CatalogError("another writer took the same batch")
            if other["change"]["kind"] == "import":
                theirs = self.segments.read(other, "documents", [e for e in other["tables"]["documents"] if e["segment"] == other["change"]["documents"]])
                if theirs.join(papers, "paper_id", "left_semi").limit(1).count():
                    raise CatalogError("another writer imported one of these papers meanwhile")
            elif other["change"]["kind"] == "replace" and before is not None:
                self._without_vectors(other, before)

        return f"{self.segments.commit(base, change, settle)['version']:012d}"

    @staticmethod
    def _taken(state: State, source: tuple[str, int] | None) -> bool:
        return source is not None and state.get("sources", {}).get(source[0], -1) >= source[1]

    def _without_vectors(self, state: State, papers: DataFrame) -> None:
        if self.table("chunks", state).where("vector_id is not null").join(papers.select("paper_id"), "paper_id", "left_semi").limit(1).count():
            raise CatalogError("a paper to replace has vectors; reset them first")

    def compact(self, whole: bool = False) -> dict[str, int]:
        """Merge neighbouring segments of about one size, or all of each table; how many went into a merged one, by table.

        Dead rows are not copied.  What is read afterwards is what was read before, and an
        import meanwhile is no obstacle: what it replaces has smaller numbers in any case.
        """
        base, name, merged = self.pointer(), fresh_name(), {}
        for table, entries in base["tables"].items():
            found = [(0, len(entries))] if whole and (len(entries) > 1 or base["tombstones"]) else runs([e["bytes"] for e in entries])
            for k, (start, end) in enumerate(found if table != "vectors" else []):
                part = entries[start:end]
                rows = self.segments.live(base, table, part)
                rows = lexical.ordered(rows) if table == "postings" else lexical.summed(rows) if table == "terms" else rows
                entry = self.segments.write(table, f"{name}{k}", rows.select(*self.segments.read(base, table, part).drop("segment").columns), table in self.DIVIDED)
                merged.setdefault(table, []).append((part, entry))

        def change(state: State) -> State:
            for table, parts in merged.items():
                for part, entry in parts:
                    names = [e["segment"] for e in part]
                    held = [e["segment"] for e in state["tables"][table]]
                    if not set(names) <= set(held):
                        raise CatalogError("another writer replaced the segments meanwhile")
                    at = held.index(names[0])
                    state["tables"][table][at : at + len(part)] = [{**entry, "seq": max(e["seq"] for e in part)}]
            state["tombstones"] = self.segments.needed(state)
            return {**state, "change": {"kind": "compact"}}

        if merged:
            self.segments.commit(base, change, lambda other: None)
        return {table: sum(len(part) for part, _ in parts) for table, parts in merged.items()}

    def assign_vectors(self, assignments: DataFrame, vectors: dict[str, Any] | None = None, schema: str | None = None, **facts: Any) -> str:
        """Set vector ids (chunk_id, vector_id, text_sha256) after checking that they fit exactly.

        ``vectors``: the entry of a written segment of vectors, with its schema.
        """
        base = self.pointer()
        chunks = self.table("chunks", base)
        if chunks is None:
            raise CatalogError("the store is empty")
        if chunks.where("vector_id is not null").limit(1).count():
            raise CatalogError("vectors are assigned already")
        if assignments.groupBy("vector_id").count().where("count > 1 or vector_id < 1").limit(1).count():
            raise CatalogError("vector ids must be unique and at least 1")
        if dense.staleness(chunks, assignments).limit(1).count():
            raise CatalogError("the artifact does not fit the stored chunks")
        ids = assignments.select("chunk_id", "vector_id")
        assigned = chunks.drop("vector_id").join(ids, "chunk_id", "left").select(*chunks.columns)
        entries = {"chunks": self.segments.write("chunks", fresh_name(), assigned, False)}
        return self._replace(base, {**entries, **({"vectors": vectors} if vectors else {})}, {"vectors": schema} if schema else {}, **facts)

    def reset_vectors(self) -> int:
        """Clear all vector ids and drop the vectors; returns how many ids there were."""
        base = self.pointer()
        chunks = self.table("chunks", base)
        if chunks is None:
            return 0
        n = chunks.where("vector_id is not null").count()
        cleared = chunks.withColumn("vector_id", F.lit(None).cast(chunks.schema["vector_id"].dataType))
        self._replace(base, {"chunks": self.segments.write("chunks", fresh_name(), cleared, False)}, {}, drop=("vectors",))
        return n

    def publish_index(self, embedded: DataFrame, dimension: int, journal: str = "pending.json", stop: str | None = None) -> str:
        """Publish vectors (chunk_id, paper_id, chunk_index, embedding_text, embedding) of all content chunks.

        The numbered vectors are written and checked first; then the journal names them and
        their mapping's fingerprint; then one new pointer brings vectors and vector ids
        together; then the journal goes.  ``recover`` finishes what was cut short between.
        ``stop`` ends after the journal or the swap, for tests of recovery.
        """
        rows = embedded.select("paper_id", "chunk_index", "chunk_id", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("text_sha256"), "embedding")
        numbered = dense.number_rows(rows, "paper_id", "chunk_index").select("vector_id", "chunk_id", "text_sha256", "embedding")
        name = fresh_name()
        entry, place = self.segments.write("vectors", name, numbered, False), self.segments.place("vectors", name)
        stored = self.spark.read.schema(numbered.schema).parquet(place)
        if bad := dense.invalid(stored, dimension).limit(1).collect():
            raise CatalogError(f"vector {bad[0]['vector_id']} is not valid: {bad[0]['problem']}")
        facts = {"fingerprint": mapping_fingerprint(stored), "dimension": dimension, "count": stored.count()}
        self.files.write_json(journal, {"mapping": place, "fingerprint": facts["fingerprint"]})
        if stop == "journal":
            return place
        version = self.assign_vectors(stored.select("chunk_id", "vector_id", "text_sha256"), entry, numbered.schema.json(), index=facts)
        if stop != "swap":
            self.files.delete(journal)
        return version

    def rebuild_index(self, embedded: DataFrame, dimension: int) -> str:
        """Reset and publish anew; the embedded rows must not depend on the stored vector ids."""
        embedded = written(embedded)
        self.reset_vectors()
        return self.publish_index(embedded, dimension)

    def vacuum(self, least_seconds: float = 7 * 86_400, journal: str = "pending.json") -> list[str]:
        """Delete what the store no longer uses and nobody may still be reading; returns its names.

        What the journal of an unfinished publication names stays.
        """
        pending = (self.files.read_json(journal) or {}).get("mapping", "")
        return self.segments.clear(self.pointer(), least_seconds, (pending.rsplit("segment=", 1)[-1],))

    def verify_index(self) -> DataFrame:
        """problem, n: where chunks, vectors and the recorded fingerprint differ; no rows when all fit."""
        state = self.pointer()
        chunks, vectors, facts = self.table("chunks", state), self.table("vectors", state), state.get("index")
        if chunks is None or vectors is None or facts is None:
            raise CatalogError("no index is published")
        have = chunks.where("vector_id is not null").select("vector_id", "chunk_id")
        parts = [
            dense.mapping_differences(have, vectors.select("vector_id", "chunk_id")).select(F.lit("mapping").alias("problem")),
            dense.staleness(chunks, vectors).select("problem"),
            dense.invalid(vectors, facts["dimension"]).select(F.concat(F.lit("vector: "), "problem").alias("problem")),
        ]
        if mapping_fingerprint(have) != facts["fingerprint"]:
            parts.append(self.spark.range(1).select(F.lit("fingerprint").alias("problem")))
        if vectors.count() != facts["count"]:
            parts.append(self.spark.range(1).select(F.lit("count").alias("problem")))
        return reduce(DataFrame.union, parts).groupBy("problem").agg(F.count("*").alias("n"))

    def recover(self, actual: DataFrame | None = None, journal: str = "pending.json") -> str:
        """Finish or discard a publication that was cut short: none, discarded or published.

        The journal names the mapping's folder and its fingerprint.  No vector ids in the
        store: the publication never took place.  The same mapping: it did.  Anything else
        is an error, and so is a table whose fingerprint differs from the journal's.
        """
        pending = self.files.read_json(journal)
        if pending is None:
            return "none"
        if missing := {"mapping", "fingerprint"} - set(pending):
            raise CatalogError(f"the journal lacks {', '.join(sorted(missing))}")
        actual = self.table("chunks") if actual is None else actual
        have = actual.where("vector_id is not null").select("vector_id", "chunk_id")
        if not have.limit(1).count():
            self.files.delete(journal)
            return "discarded"
        expected = self.spark.read.parquet(pending["mapping"])
        if mapping_fingerprint(expected) != pending["fingerprint"]:
            raise CatalogError("the pending mapping was changed")
        if dense.mapping_differences(have, expected).limit(1).count():
            raise CatalogError("the stored mapping is not the pending one")
        self.files.delete(journal)
        return "published"


def mapping_fingerprint(mapping: DataFrame) -> str:
    """The digest of a mapping (vector_id, chunk_id) in order of its ids."""
    line = F.concat_ws("|", F.col("vector_id").cast("string"), "chunk_id")
    return dense.fingerprint(mapping, line, "vector_id", "chunk_id").first()["fingerprint"]


def replaced(old: DataFrame, new: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """All rows of old whose paper is not in new (or in ``papers``), and all of new."""
    gone = new.select("paper_id").distinct() if papers is None else papers
    return old.join(gone, "paper_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def migrate(chunks: DataFrame, version: int, blocks: DataFrame | None = None) -> DataFrame:
    """Chunks of an older schema version brought to the current one.

    1: types are filled in from front-matter blocks; 2: nothing but indexes, which are derived
    here; 3: bibliography sections are told from content.
    """
    from sheaf.functions import text as X
    from sheaf.operators import layout

    if version not in (1, 2, 3):
        raise CatalogError(f"no way from schema version {version}")
    if version == 1:
        if blocks is None:
            raise CatalogError("version 1 needs its front-matter blocks")
        kinds = layout.front_matter_types(chunks, blocks)
        chunks = chunks.drop("front_matter_type", "content_kind").join(kinds, "chunk_id", "left").withColumn("content_kind", F.when(F.col("front_matter_type").isNotNull(), "front_matter").otherwise("body"))
    return chunks.withColumn("section_type", F.when((F.col("content_kind") == "body") & X.is_bibliography(F.col("section")), "bibliography").otherwise("content"))
