"""Command line: ``python -m sheaf.cli VERB ...``.

Exit codes: 0 done, 1 failed, 2 not configured or nothing to work on.
"""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sheaf")
    top.add_argument("--config", help="settings file (JSON or YAML)")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, *names: str) -> argparse.ArgumentParser:
        made = verbs.add_parser(name, help=text)
        for x in names:
            made.add_argument(x)
        return made

    verb("import", "chunk a table of documents (doc_id, text, source) into the store", "documents", "store")
    verb("import-pages", "clean and chunk a table of pages (page_id, url, html) into the store", "pages", "store")
    verb("compact", "merge the store's small segments", "store").add_argument("--whole", action="store_true")
    embed = verb("embed", "embed the store's content into an artifact", "store", "folder")
    embed.add_argument("--dimension", type=int, help="instead of the settings' one")
    index = verb("index", "embed and publish the store's content", "store")
    mode = index.add_mutually_exclusive_group()
    mode.add_argument("--verify", action="store_true")
    mode.add_argument("--reset", action="store_true")
    mode.add_argument("--rebuild", action="store_true")
    mode.add_argument("--recover", action="store_true")
    for name, text in (("search", "word search of the store"), ("retrieve", "hybrid retrieval: ranked records as JSON"), ("answer", "retrieval, evidence and answer as JSON")):
        find = verb(name, text, "store", "question")
        find.add_argument("-k", type=int, default=10 if name == "search" else None)
        if name != "search":
            find.add_argument("--context", action="append", default=[], help="an earlier turn")
    stage = verb("stage", "make a workspace of one paper of the store; prints its id", "store", "paper", "folder")
    stage.add_argument("--sha256", default="")
    verb("unstage", "delete a workspace", "folder", "workspace")
    verb("overview", "the passages that an overview of a workspace's paper would be drafted from", "folder", "workspace")
    stats = verb("inspect", "chunk counts by section and chunk sizes by paper", "store")
    stats.add_argument("--budget", type=int, default=512)
    pages = verb("inspect-items", "label counts of cleaned pages (page_id, html) and what the passes did", "pages")
    pages.add_argument("--label", help="only items of this label")
    pages.add_argument("--markdown", help="folder for the pages as Markdown")
    verb("query", "run a registered query and show its first rows", "name", "tables")
    verb("health", "call the chat model once")
    return top


def health() -> int:
    """One call of the configured model: prints its name and ``reachable``, or what went wrong, never a reply."""
    from sheaf import adaptors, config

    try:
        runtime = config.load_runtime()
        adaptors.HttpChatClient(runtime).complete("", "Hello")
    except config.ConfigurationError as error:
        print(f"not configured: {error}")
        return 2
    except Exception as error:
        # the kind alone: messages may hold parts of the request
        print(f"{runtime.model}: {type(error).__name__}")
        return 1
    print(f"{runtime.model}: reachable")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "health":
        return health()
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sheaf import adaptors, catalog, config, importing, registry, workspace
    from sheaf.operators import chunking, dense, layout, lexical, store
    from sheaf.service import Service
    from sheaf.sources import html, readers

    settings = config.load(args.config) if args.config else config.Settings()
    spark = SparkSession.builder.appName("sheaf").getOrCreate()
    if args.verb == "query":
        registry.QUERIES[args.name](spark, args.tables).show(truncate=False)
        return 0
    if args.verb == "inspect-items":
        tree = html.nodes(spark.read.parquet(args.pages))
        done = layout.clean(html.items(tree), html.tables(tree), most_pages=settings.parsing.front_matter_max_pages, least_list_chars=settings.parsing.list_heading_min_chars, trace=True)
        layout.label_histogram(done.items).groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").show(truncate=False)
        done.diagnostics.groupBy("name").agg(F.sum("n").alias("n")).orderBy("name").show(truncate=False)
        if args.label:
            done.items.where(F.col("label") == args.label).orderBy("paper_id", "pos").show(truncate=False)
        if args.markdown:
            readers.write_markdown(done.items, args.markdown)
        return 0
    if args.verb in ("unstage", "overview"):
        try:
            if args.verb == "unstage":
                workspace.delete(spark, args.folder, args.workspace)
            else:
                workspace.overview_context(workspace.open_chunks(spark, args.folder, args.workspace), settings.overview).orderBy("ord").show(truncate=False)
        except catalog.CatalogError as error:
            print(error, file=sys.stderr)
            return 2
        return 0
    try:
        held = catalog.Catalog(spark, args.store)
        if args.verb in ("import", "import-pages"):
            found = importing.from_documents(spark.read.parquet(args.documents)) if args.verb == "import" else importing.from_pages(spark.read.parquet(args.pages), settings)
            importing.into(held, found, settings)
            return 0
    except catalog.CatalogError as error:
        print(error, file=sys.stderr)
        return 1
    chunks = held.table("chunks")
    if chunks is None:
        print("the store is empty", file=sys.stderr)
        return 2

    dimension = getattr(args, "dimension", None) or settings.embedding.dimension

    def embedder():
        return adaptors.HashEmbedder(dimension)

    def embedded(rows):
        texts = rows.where("section_type = 'content'").select("chunk_id", "paper_id", "chunk_index", "embedding_text")
        return adaptors.embed(texts, embedder)

    try:
        if args.verb == "inspect":
            store.histogram(chunks, "section").show(truncate=False)
            chunking.diagnostics(chunks, args.budget).show(truncate=False)
        elif args.verb == "embed":
            print(readers.write_artifact(embedded(chunks), args.folder, dimension))
        elif args.verb == "search":
            questions = spark.createDataFrame([(0, [args.question])], "qid long, texts array<string>")
            lexical.search(held.index().of("content"), questions, args.k, settings.bm25).show(truncate=False)
        elif args.verb in ("retrieve", "answer"):
            questions = spark.createDataFrame([(0, args.question, args.context)], "qid long, query string, turns array<string>")
            service = Service(held, settings, embedder, settings.embedding.instruction)
            if args.verb == "answer":
                print(service.answer(questions, args.k).first()["json"])
            else:
                for row in service.records(service.retrieve(questions, args.k)).orderBy("rank").toLocalIterator():
                    print(row["json"])
        elif args.verb == "stage":
            print(workspace.create(chunks.where(F.col("paper_id") == args.paper), args.folder, embedder, args.sha256))
        elif args.verb == "compact":
            for name, n in sorted(held.compact(args.whole).items()):
                print(f"{name}: {n} segments merged")
        elif args.reset:
            print(held.reset_vectors())
        elif args.verify:
            dense.state(chunks).show()
            problems = held.verify_index().collect()
            for row in problems:
                print(f"{row['problem']}: {row['n']}")
            return 1 if problems else 0
        elif args.recover:
            print(held.recover())
        elif args.rebuild:
            held.rebuild_index(embedded(chunks), dimension)
        else:
            held.publish_index(embedded(chunks), dimension)
    except catalog.CatalogError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
