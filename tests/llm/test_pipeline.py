import numpy as np

import corpus_pipeline
from sheaf.llm import langid
from tests.llm import test_decontam_archive as hits
from tests.llm.fixtures import table
from tests.llm.test_neardup import brute
from tests.llm.test_scans import base_secrets


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
            now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert set(now) == {i for i, t in kept.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            roots = {i: root for (i, _), root in brute(list(kept.items()), 5).items()}
            assert set(now) == {i for i in kept if roots[i] == i}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
            assert set(now) == {i for i, x in hits.brute(kept, items).items() if not x[4]}
        elif name == "secrets":
            assert set(now) == set(kept)
            for i, text in kept.items():
                spans = base_secrets(text or "")
                assert now[i] == text if not spans else all(text[a:b] not in now[i] for a, _, b in spans)
        elif name == "packing":
            tokens = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
            sums = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
            assert set(tokens) == set(kept) and sums == tokens
            break
        kept = now
    assert seen == ["language_id", "near_duplicates", "decontamination", "secrets", "packing"]


def test_language_stage_drops_what_has_no_letters(spark):
    frame = spark.createDataFrame([(i, t, "en", "the of and") for i, t in enumerate(["the of and that", "123 !!", None, ""] + ["of the and with"] * 20)], "doc_id long, text string, lang string, row string")
    got = corpus_pipeline.language(spark, frame, "")
    assert got.columns == frame.columns and {r["doc_id"] for r in got.collect()} == {0, *range(4, 24)}
    assert np.isclose(corpus_pipeline.LEAST_COVERED, 0.3) and langid.UNKNOWN == "und"
    # nothing learned: what has a letter stays
    free = frame.withColumn("lang", frame["lang"].substr(9, 1)).withColumn("lang", corpus_pipeline.F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, free, "").collect()} == {0, *range(4, 24)}


def test_texts_of_several_known_languages_stay(spark):
    words = {"en": "the dog and the cat are in the house", "de": "der hund und die katze sind nicht im haus", "fr": "le chien et le chat ne sont pas dans la maison", "es": "el perro y el gato no están en la casa"}
    rows = [(i, words[x], x) for i, x in enumerate(sorted(words) * 12)]
    rows += [(100, " ".join(words.values()), None), (101, "это новый дом и большой город", None)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert {r["doc_id"] for r in got.collect()} == {*range(48), 100}


def test_the_whole_run_on_awkward_rows(spark, tmp_path):
    long = "the of and that with " * 250_000
    rows = [(1, "the of and that", "en"), (1, "the of and that", "en"), (2, None, "en"), (3, "", None), (4, "123 ½", "en"), (None, "the of and", "en"), (None, "the of and", "en"), (5, long, "en"), (6, "THE OF and that", "en"), (7, "secret words of the test stand here", "en"), (8, "the token=abcdef12 is here", "en")]
    schema = "doc_id long, text string, lang string"
    frame = spark.createDataFrame(rows, schema).withColumns({c: corpus_pipeline.F.lit(1) for c in ("own", "row", "ids", "kept", "runs", "__base", "start", "n_chars", "component_id")})
    bench = spark.createDataFrame([(1, "secret words of the test"), (None, None)], "item_id long, text string")
    for name, docs in (("some", frame), ("none", frame.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        got = [(r["doc_id"], r["n"]) for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
        if name == "none":
            assert got == []
        else:
            # equal ids and copies are one, letters are needed, the contaminated text goes, null ids stay
            assert {x for x, _ in got} == {1, None, 5, 8} and dict(got)[5] > 1_000_000
    stage = corpus_pipeline.secret_scan(spark, frame, "")
    assert stage.columns == frame.columns and stage.where("doc_id = 8").first()["text"] == "the [secret] is here"
