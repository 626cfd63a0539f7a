"""Structure-aware chunking of layout items, chunk identity and checks.

A paper's items stay together in one row; splitting and packing are folds over that row's
array, so chunking needs no shuffle beyond the one that gathers a paper's items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.config import Chunking
from sheaf.functions import text as X
from sheaf.operators import dense, layout
from sheaf.storage import written

if TYPE_CHECKING:
    from sheaf.adaptors import Tokenizer

CHUNK = "struct<section:string,text:string,tokens:int,first:int,last:int>"


def paper_id(text: Column) -> Column:
    """Identity by content."""
    return F.concat(F.lit("paper_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def chunk_id(paper: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", paper, index)


def split_oversize(items: Column, budget: int, headers: bool = False) -> Column:
    """Items with more words than the budget are cut into windows of so many words.

    With ``headers`` items have a field ``header``, a table's heading row or null: it stands
    again at the start of each further window, which has room for fewer words then.
    """

    def cut(item: Column, words: Column) -> Column:
        head = F.coalesce(item["header"], F.lit("")) if headers else F.lit("")
        again = F.when(X.squeeze(head) == "", 0).otherwise(F.size(F.split(X.squeeze(head), " ")))
        # a heading that fills the budget is not repeated
        again = F.when(again * 2 <= budget, again).otherwise(0)
        step = F.lit(budget) - again
        windows = F.sequence(F.lit(0), F.greatest(F.ceil((item["tokens"] - budget) / step), F.lit(0)).cast("int"))
        part = lambda k: F.when(k == 0, F.slice(words, F.lit(1), F.lit(budget))).otherwise(F.slice(words, F.lit(budget + 1) + (k - 1) * step, step))

        def piece(k: Column) -> Column:
            repeats = (k > 0) & (again > 0)
            text = F.when(repeats, F.concat(head, F.lit("\n"), F.array_join(part(k), " "))).otherwise(F.array_join(part(k), " "))
            return F.struct(item["section"].alias("section"), text.alias("text"), (F.size(part(k)) + F.when(repeats, again).otherwise(0)).alias("tokens"), item["page"].alias("page"))

        whole = F.struct(*(item[c].alias(c) for c in ("section", "text", "tokens", "page")))
        return F.when(item["tokens"] > budget, F.transform(windows, piece)).otherwise(F.array(whole))

    # the words of a long item are cut once and not again for each of its windows
    words = lambda x: F.when(x["tokens"] > budget, F.split(X.squeeze(x["text"]), " "))
    return F.flatten(F.transform(items, lambda x: F.flatten(F.transform(F.array(words(x)), lambda w: cut(x, w)))))


def pack(items: Column, budget: int) -> Column:
    """Greedy packing: an item joins the last chunk if it has its section and fits the budget."""
    empty = F.expr(f"cast(array() as array<{CHUNK}>)")

    def step(chunks: Column, item: Column) -> Column:
        last = F.element_at(chunks, -1)
        joins = (F.size(chunks) > 0) & F.try_element_at(chunks, F.lit(-1))["section"].eqNullSafe(item["section"]) & (F.try_element_at(chunks, F.lit(-1))["tokens"] + item["tokens"] <= budget)
        grown = F.struct(last["section"].alias("section"), F.concat(last["text"], F.lit("\n"), item["text"]).alias("text"), (last["tokens"] + item["tokens"]).alias("tokens"), F.least(last["first"], item["page"]).alias("first"), F.greatest(last["last"], item["page"]).alias("last"))
        fresh = F.struct(item["section"].alias("section"), item["text"].alias("text"), item["tokens"].alias("tokens"), item["page"].alias("first"), item["page"].alias("last"))
        return F.when(joins, F.concat(F.slice(chunks, F.lit(1), F.size(chunks) - 1), F.array(grown))).otherwise(F.concat(chunks, F.array(fresh)))

    return F.aggregate(items, empty, step)


def build(papers: DataFrame, max_tokens: int, reserve: int = 64, blocks: DataFrame | None = None) -> DataFrame:
    """Chunks of papers (paper_id, paper_title, source, items), with identity, links and types.

    ``reserve`` tokens of a chunk's most are left for what is embedded with its text.  Chunks
    without text are dropped before numbering, and so are bare article labels without a
    section.  With front-matter ``blocks`` (as of layout.front_matter_blocks) the chunks of
    their sections and pages are front matter of their type; the others are body.
    """
    budget = max_tokens - reserve
    headers = "header" in papers.schema["items"].dataType.elementType.fieldNames()
    packed = papers.select("paper_id", "paper_title", "source", pack(split_oversize(F.col("items"), budget, headers), budget).alias("chunks"))
    return finished(packed, blocks)


def build_numbered(papers: DataFrame, max_tokens: int, reserve: int, blocks: DataFrame) -> DataFrame:
    """As build, with vector ids 1, 2, ... of the content chunks in order of paper and place.

    Chunks are packed once and written; their sections and pages tell the types, and with them
    how many ids each paper takes.  So texts meet their paper's types and first id in one join,
    and a table of chunks need not be written again for its ids.
    """
    budget = max_tokens - reserve
    headers = "header" in papers.schema["items"].dataType.elementType.fieldNames()
    packed = written(papers.select("paper_id", "paper_title", "source", _kept(pack(split_oversize(F.col("items"), budget, headers), budget)).alias("kept")))
    # these fields are read without the texts
    light = packed.select("paper_id", *(F.col(f"kept.{c}").alias(c) for c in ("section", "first", "last"))).join(layout.blocks_of_papers(blocks), "paper_id", "left")
    types = F.transform("section", lambda s, i: layout.front_matter_type_of(F.col("blocks"), s, F.get("first", i), F.get("last", i)))
    typed = light.select("paper_id", "section", types.alias("types"))
    places = F.transform("section", lambda s, i: ~(F.get("types", i).isNull() & F.coalesce(X.is_bibliography(s), F.lit(False))))
    sized = typed.select("paper_id", "types", places.alias("content")).withColumn("size", F.size(F.filter("content", lambda x: x)))
    numbered = dense.number_rows(sized, "paper_id", name="start", size="size").drop("size")
    joined = packed.join(numbered, "paper_id")
    fields = lambda c, i: F.struct(*(c[f].alias(f) for f in ("section", "text", "tokens", "first", "last")), F.get("types", i).alias("type"), F.when(F.get("content", i), F.col("start") + F.size(F.filter(F.slice("content", 1, i), lambda x: x))).cast("long").alias("number"))
    rows = joined.select("paper_id", "paper_title", "source", F.transform("kept", fields).alias("kept"))
    return _rows(rows, F.col("c.type"), X.word_count, F.col("c.number"))


def _kept(chunks: Column) -> Column:
    """The chunks that stay: those with text that are no bare label."""
    return F.filter(chunks, lambda c: (F.length(F.trim(c["text"])) > 0) & ~is_layout_noise(c["section"], c["tokens"], c["text"]))


def finished(packed: DataFrame, blocks: DataFrame | None = None, count: Callable[[Column], Column] = X.word_count) -> DataFrame:
    """Chunks (paper_id, paper_title, source, chunks) with identity, links and types; ``count`` tells the tokens of what is embedded."""
    typed = F.lit(None).cast("string")
    if blocks is not None:
        # a paper has a handful of blocks, which meet its chunks in its own row: no chunk's text is moved again
        known = layout.blocks_of_papers(blocks)
        packed, typed = packed.join(known, "paper_id", "left"), layout.front_matter_type_of(F.col("blocks"), F.col("c.section"), F.col("c.first"), F.col("c.last"))
    carried = ("paper_id", "paper_title", "source", *(("blocks",) if blocks is not None else ()))
    return _rows(packed.select(*carried, _kept(F.col("chunks")).alias("kept")), typed, count)


def _rows(packed: DataFrame, typed: Column, count: Callable[[Column], Column], number: Column | None = None) -> DataFrame:
    """The chunks (``kept``) of each paper as rows; ``typed`` and ``number`` are of a chunk ``c``."""
    carried = [c for c in packed.columns if c != "kept"]
    # the count is taken before the chunks become rows, not again for each of them
    counted = packed.select(*carried, "kept", F.size("kept").alias("n"))
    rows = counted.select(*carried, "n", F.posexplode("kept").alias("chunk_index", "c"))
    index = F.col("chunk_index")
    embedded = X.embedding_text(F.col("paper_title"), F.col("c.section"), F.col("c.text"))
    chunks = rows.select(
        chunk_id(F.col("paper_id"), index).alias("chunk_id"),
        "paper_id",
        "paper_title",
        "source",
        index.cast("long").alias("chunk_index"),
        F.col("c.text").alias("raw_text"),
        embedded.alias("embedding_text"),
        F.col("c.section").alias("section"),
        F.col("c.first").alias("page_start"),
        F.col("c.last").alias("page_end"),
        F.col("c.tokens").cast("long").alias("raw_token_count"),
        count(embedded).cast("long").alias("embedding_token_count"),
        F.when(index > 0, chunk_id(F.col("paper_id"), index - 1)).alias("prev_chunk_id"),
        F.when(index < F.col("n") - 1, chunk_id(F.col("paper_id"), index + 1)).alias("next_chunk_id"),
        typed.alias("front_matter_type"),
        *((number.alias("vector_id"),) if number is not None else ()),
    )
    body = F.col("front_matter_type").isNull()
    return chunks.select(
        *(c for c in chunks.columns if c not in ("front_matter_type", "vector_id")),
        F.when(body, "body").otherwise("front_matter").alias("content_kind"),
        "front_matter_type",
        F.when(body & X.is_bibliography(F.col("section")), "bibliography").otherwise("content").alias("section_type"),
        *(("vector_id",) if number is not None else ()),
    )


class Chunker(Protocol):
    """What turns papers (paper_id, paper_title, source, items) into chunks; ``chunker_id`` goes into the documents."""

    chunker_id: str

    def chunk(self, papers: DataFrame, blocks: DataFrame | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class StructureChunker:
    """Chunks by section and budget of words: folds over arrays, without a tokenizer."""

    settings: Chunking = Chunking()
    chunker_id: str = "structure_v1"

    def chunk(self, papers: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        return build(papers, self.settings.max_tokens, self.settings.metadata_reserve, blocks)


@dataclass(frozen=True)
class TokenChunker:
    """Chunks by section and a tokenizer's budget, which no chunk's text exceeds.

    Items of more tokens are cut at places of tokens, at white space where there is some;
    neighbours under one heading path are put together while their joined text fits; each
    further piece of a table begins with its heading row again if that leaves it half the
    budget.  Papers stay where they are: one Arrow stage, a paper at a time.
    """

    settings: Chunking = Chunking()
    chunker_id: str = "tokens_v1"

    def chunk(self, papers: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        from sheaf.adaptors import tokenizer

        made, s = tokenizer(self.settings.tokenizer), self.settings
        names = papers.schema["items"].dataType.elementType.fieldNames()
        wanted = ("section", "text", "page", "header")
        items = F.transform("items", lambda x: F.struct(*(x[c].cast("int" if c == "page" else "string").alias(c) if c in names else F.lit(None).cast("int" if c == "page" else "string").alias(c) for c in wanted)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                packed = [pack_tokens(list(rows), made, s.budget, s.merge_peers, s.repeat_table_header) for rows in batch["items"]]
                yield batch[["paper_id", "paper_title", "source"]].assign(chunks=packed)

        packed = papers.select("paper_id", "paper_title", "source", items.alias("items")).mapInPandas(run, f"paper_id string, paper_title string, source string, chunks array<{CHUNK}>")

        def lengths(texts: pd.Series) -> pd.Series:
            return pd.Series(token_counts(texts.tolist(), made))

        lengths.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return finished(packed, blocks, F.pandas_udf(lengths, "long"))


def token_counts(texts: list[str], made: Tokenizer) -> list[int]:
    """How many tokens each text has; a tokenizer may have a quicker way to count than by places."""
    return made.counts(texts) if hasattr(made, "counts") else [len(o) for o in made.offsets(texts)]


def token_windows(text: str, made: Tokenizer, budget: int, size: int | None = None) -> list[tuple[str, int]]:
    """The text (``size`` tokens, where they are counted) in pieces of at most ``budget`` tokens, with their counts; nothing but white space at the cuts is lost.

    A piece may have more tokens by itself than within the text, so it is counted again and cut
    shorter until it fits.
    """
    out, at = [], 0
    size = token_counts([text], made)[0] if size is None else size
    if size <= budget:
        return [(text, size)]
    offsets = made.offsets([text])[0]
    k = 0
    while k < len(offsets):
        size = budget
        while True:
            end = len(text) if k + size >= len(offsets) else offsets[k + size][0]
            space = max(text.rfind(c, at + 1, end) for c in " \n\t")
            # white space in the later half of the piece is a better place
            if end < len(text) and not text[end].isspace() and not text[end - 1].isspace() and space > at + (end - at) // 2:
                end = space
            piece = text[at:end].strip()
            count = token_counts([piece], made)[0]
            if count <= budget or size == 1:
                break
            size = max(1, size - max(1, count - budget))
        if end <= at:
            # tokens inside one character
            end = at + 1
            piece, count = text[at:end], token_counts([text[at:end]], made)[0]
        if piece:
            out.append((piece, count))
        at = end
        while k < len(offsets) and offsets[k][0] < at:
            k += 1
        if k == len(offsets) and text[at:].strip():
            offsets = [*offsets, (at, len(text))]
    return out


def pack_tokens(items: list[dict], made: Tokenizer, budget: int, merge: bool = True, repeat: bool = True) -> list[dict]:
    """Items (section, text, page, header) of one paper as chunks (section, text, tokens, first, last)."""
    pieces, sizes = [], token_counts([item["text"] or "" for item in items], made)
    for item, size in zip(items, sizes, strict=True):
        head = (item["header"] or "").strip() if repeat and item["header"] else ""
        spent = token_counts([head + "\n"], made)[0] if head else 0
        parts = token_windows(item["text"] or "", made, budget, size)
        if head and spent * 2 <= budget and len(parts) > 1:
            first = parts[0]
            rest = item["text"][item["text"].find(first[0]) + len(first[0]) :]
            again = [f"{head}\n{text}" for text, _ in token_windows(rest.strip(), made, budget - spent - 1)]
            parts = [first, *((text, token_counts([text], made)[0]) for text in again)]
        pieces += [(item["section"], text, count, item["page"]) for text, count in parts]
    out: list[dict] = []
    # whether the last chunk and what joins it are even, so that their tokens can be added up
    even, tail = getattr(made, "even", lambda text: False), False
    for section, text, count, page in pieces:
        last, own = out[-1] if out else None, even(text)
        if merge and last and last["section"] == section and last["tokens"] + count <= budget + 2:
            joined = f"{last['text']}\n{text}"
            total = last["tokens"] + made.feed + count if tail and own else token_counts([joined], made)[0]
            if total <= budget:
                pages = [p for p in (last["first"], last["last"], page) if p is not None]
                out[-1] = {"section": section, "text": joined, "tokens": total, "first": min(pages, default=None), "last": max(pages, default=None)}
                tail = tail and own
                continue
        tail = own
        out.append({"section": section, "text": text, "tokens": count, "first": page, "last": page})
    return out


def chunker(settings: Chunking) -> Chunker:
    """The chunker of the settings: by tokens where they name a tokenizer or other than the plain ways."""
    plain = not settings.tokenizer and settings.merge_peers and settings.repeat_table_header
    return StructureChunker(settings) if plain else TokenChunker(settings)


def is_layout_noise(section: Column, tokens: Column, text: Column) -> Column:
    """A bare article label without a section."""
    label = F.lower(X.squeeze(text)).isin("article", "research article", "review article")
    return F.coalesce(X.blank_to_null(section).isNull() & (tokens <= 4) & label, F.lit(False))


def links(chunks: DataFrame) -> DataFrame:
    """prev and next chunk of the same paper, derived rather than stored."""
    order = Window.partitionBy("paper_id").orderBy("chunk_index")
    return chunks.select("chunk_id", F.lag("chunk_id").over(order).alias("prev_chunk_id"), F.lead("chunk_id").over(order).alias("next_chunk_id"))


def diagnostics(chunks: DataFrame, budget: int) -> DataFrame:
    """Per paper: chunks, most tokens, chunks over the budget, cross-page chunks."""
    return chunks.groupBy("paper_id").agg(
        F.count("*").alias("n_chunks"),
        F.max("raw_token_count").alias("max_tokens"),
        F.count_if(F.col("raw_token_count") > budget).alias("over_limit"),
        F.count_if(F.col("page_end") > F.col("page_start")).alias("cross_page"),
    )


def violations(chunks: DataFrame) -> DataFrame:
    """Per broken rule how many rows break it; an intact table gives no rows."""
    rules = {
        "blank text": F.length(F.trim("raw_text")) == 0,
        "token counts": F.col("embedding_token_count") < F.col("raw_token_count"),
        "page range": (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")),
        "section type": ~F.col("section_type").isin("content", "bibliography"),
        "front matter type": (F.col("content_kind") == "front_matter") != F.col("front_matter_type").isNotNull(),
    }
    named = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    per_row = chunks.select(F.explode(named).alias("rule"))
    shape = chunks.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))
    gaps = shape.where((F.col("n") != F.col("d")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1)).select(F.lit("indexes").alias("rule"))
    # an id is counted as a chunk's own and as a neighbour's in one grouping
    told = F.array(F.struct(F.col("chunk_id").alias("id"), F.lit(1).alias("own")), *(F.struct(F.col(c).alias("id"), F.lit(0).alias("own")) for c in ("prev_chunk_id", "next_chunk_id")))
    seen = chunks.select(F.explode(told).alias("x")).groupBy("x.id").agg(F.sum("x.own").alias("own"), F.sum(1 - F.col("x.own")).alias("named"))
    ids = seen.select(F.when(F.col("own") > 1, F.struct(F.lit("chunk id").alias("rule"), F.lit(1).cast("long").alias("n"))).when((F.col("own") == 0) & F.col("id").isNotNull(), F.struct(F.lit("neighbour").alias("rule"), F.col("named").cast("long").alias("n"))).alias("r")).where("r is not null").select("r.rule", "r.n")
    return per_row.union(gaps).withColumn("n", F.lit(1).cast("long")).union(ids).groupBy("rule").agg(F.sum("n").alias("n"))
