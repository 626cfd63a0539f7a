import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheaf.llm import archive, decontam
from sheaf.llm.common import alnum_words, shared_dir
from tests.llm.fixtures import AWKWARD, documents, empty, table, texts


def brute(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = alnum_words(text or "")
        m = min(13, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows[tuple(w[i : i + m])].add(str(name))
    sizes, out = {len(k) for k in windows}, {}
    for doc_id, text in docs.items():
        w, hit, found = alnum_words(text or ""), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[k]
        out[doc_id] = len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)
    return out


def test_hits_on_the_table(spark, sf):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.op9(spark, sf).collect()}
    assert got == brute(texts(spark, sf), items)
    assert any(x[4] for x in got.values())


ITEMS = [(1, "Alpha beta Gamma"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (3, ""), (4, None), (5, "of of"), (6, "ten eleven twelve thirteen " * 9), (7, "one two three four five six seven eight nine ten eleven twelve thirteen fifteen"), (1, "alpha beta gamma")]
TEXTS = [*AWKWARD, "x alpha BETA, gamma y", "a two three four five six seven eight nine ten eleven twelve thirteen fourteen b", "of of of zz", "ten eleven twelve thirteen " * 30, "one two three four five six seven eight nine ten eleven twelve thirteen" + " pad" * 300]


@pytest.mark.parametrize("block_words", [1, 20, 500_000])
def test_awkward_rows_in_blocks(spark, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, TEXTS, runs="clash", items=3, n_words="clash")
    rows = decontam.contaminated(decontam.find(docs, items, block_words=block_words)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in rows}
    assert got == brute(dict(enumerate(TEXTS, 1)), ITEMS)


def test_removal_keeps_clean_rows_and_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, TEXTS, runs="clash", own="x")
    kept = decontam.remove(docs, items)
    bad = [i for i, x in brute(dict(enumerate(TEXTS, 1)), ITEMS).items() if x[4]]
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where(~F.col("doc_id").isin(bad)).collect()))
    assert decontam.remove(empty(spark), items).count() == 0
    assert decontam.remove(docs, items.limit(0)).count() == len(TEXTS)


def test_items_without_an_id_are_hit(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "delta epsilon"), (2, "one two"), (1, "three four")], "item_id long, text string")
    docs = documents(spark, ["x alpha beta gamma", "alpha beta gamma delta epsilon one two", "three four one two", "clean text"])
    for block_words in (1, 500_000):
        hits = decontam.contaminated(decontam.find(docs, items, block_words=block_words))
        got = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in hits.collect()}
        assert got == {1: (3, [None], True), 2: (7, ["2", None], True), 3: (4, ["1", "2"], True), 4: (0, [], False)}
    assert [r["doc_id"] for r in decontam.remove(docs, items).collect()] == [4]


def test_long_items_and_common_beginnings(spark):
    prompt = " ".join(f"prompt{i}" for i in range(20))
    items = [(i, f"{prompt} own{i} " + " ".join(f"q{i}x{j}" for j in range(15))) for i in range(200)]
    items += [(1000, " ".join(f"long{j}" for j in range(3000)))]
    docs = {1: prompt, 2: prompt + " own7 q7x0", 3: "prompt0 prompt1 prompt2 prompt3 prompt4 prompt5 else", 4: " ".join(f"long{j}" for j in range(90, 120)), 5: "pad " * 300_000 + items[-1][1] + " pad" * 300_000, 6: " ".join(f"q9x{j}" for j in range(13))}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (900, 500_000):
        rows = decontam.contaminated(decontam.find(frame, bench, block_words=block_words)).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in rows}
        assert got == brute(docs, items)
    cut = decontam.pieces(bench, 13, piece_words=100).groupBy("name").count().where("name = 1000").first()["count"]
    assert cut == 30


def test_repeated_documents_and_null_ids(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "alpha beta gamma"), (None, "alpha beta gamma"), (3, None), (3, "clean"), (3, "clean")], "doc_id long, text string")
    for block_words in (1, 500_000):
        got = sorted(((r["doc_id"], r["n_words"], r["items"]) for r in decontam.find(docs, items, block_words=block_words).collect()), key=str)
        assert got == sorted([(None, 3, ["1"]), (None, 3, ["1"]), (3, 0, []), (3, 1, []), (3, 1, [])], key=str)


def test_archive_reads_back(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, sf, "pages").collect()}
    rows = archive.op8(spark, sf).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in rows} == {i: (len(p), hashlib.sha256(p).hexdigest()) for i, p in pages.items()}


def parse_warc(record):
    """A record read by hand: type, header fields, block."""
    head, _, rest = bytes(record).partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    assert first == "WARC/1.1" and rest[n:] == b"\r\n\r\n"
    return fields, rest[:n]


AWKWARD_PAGES = [(1, "u", "x" * 200), (2, "v\r\nq", "x" * 200), (2, "v", "x" * 200), (None, "v", "x" * 200), (4, None, None), (5, "zé好", "é" * 50), (6, "z", "é" * 50), (7, "", "sm"), (8, "", "sm"), (9, "h", "\r\n\r\nWARC-Type: revisit\r\n" * 20), (None, "w", None), (None, "w2", "only\x00here" * 30), (10, "long", "ü<p>" * 1_500_000)]


def test_archive_of_awkward_rows(spark):
    pages = spark.createDataFrame(AWKWARD_PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("salt", F.lit(1)).repartition(3)
    folder = shared_dir(spark)
    archive.write(pages, folder)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive.read(spark, folder).collect()), key=str)
    want = []
    for page_id, _, html in AWKWARD_PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in AWKWARD_PAGES if h == html and p is not None]
        again = len(data) >= 100 and bool(same) and page_id != min(same)
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in AWKWARD_PAGES})


def test_records_are_rebuilt_byte_for_byte(spark):
    pages = spark.createDataFrame(AWKWARD_PAGES, "page_id long, url string, html string").repartition(3)
    folder = shared_dir(spark)
    archive.write(pages, folder)
    rows = archive.reconstruct(spark, folder).collect()
    assert len(rows) == len(AWKWARD_PAGES) and all(r["checked"] for r in rows)
    names, bodies = [], {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in AWKWARD_PAGES}
    for r in rows:
        fields, block = parse_warc(r["record"])
        names.append(fields["WARC-Record-ID"])
        body = bodies[fields["WARC-Payload-Digest"].removeprefix("sha256:")]
        if fields["WARC-Type"] == "response":
            assert block == body
        else:
            assert block == b"" and int(fields["X-Payload-Length"]) == len(body) and fields["WARC-Refers-To"].startswith("<urn:uuid:") and fields["WARC-Profile"] == archive.PROFILE
    # only the two rows of page 2 share a name
    assert len(set(names)) == len(names) - 1


def test_a_damaged_archive_is_noticed(spark):
    folder = shared_dir(spark)
    archive.write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), folder)
    stored = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit("other").cast("binary")).collect()
    spark.createDataFrame(stored, "digest string, payload binary").write.format("parquet").mode("overwrite").option("path", f"{folder}/payloads").bucketBy(4, "digest").saveAsTable("damaged")
    spark.sql("DROP TABLE damaged")
    with pytest.raises(Exception, match="broken"):
        archive.read(spark, folder).collect()
    none = shared_dir(spark)
    archive.write(spark.createDataFrame([], "page_id long, url string, html string"), none)
    assert archive.read(spark, none).count() == 0
