import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import langid, quality
from tests.llm.fixtures import AWKWARD, documents, empty, table, texts



def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op6(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def viterbi_by_the_book(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        step = best[:, None] - penalty * (1 - np.eye(len(best)))
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int(best.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_of_many_documents_at_once():
    rng = np.random.default_rng(4)
    lengths = np.array([0, 1, 7, 30, 0, 12])
    scores = rng.normal(0, 3, (lengths.sum(), 3)).astype(np.float32)
    got, at = langid.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        if n:
            assert got[at : at + n].tolist() == viterbi_by_the_book(scores[at : at + n].astype(float), 2.0)
        at += n


def test_spans_scripts_and_awkward_rows(spark):
    sf = "/root/testdata/sf0.01"
    model = langid.train(table(spark, sf, "documents"))
    mixed = "the of and that with ing " * 5 + "und der die nicht für auf " * 5
    docs = documents(spark, [*AWKWARD, mixed, "привет мир", "123 !!"], lang="xx", score=9)
    rows = {r["doc_id"]: r for r in langid.predict(docs, model, spans=True).collect()}
    for i, text in enumerate(AWKWARD, 1):
        assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    n = len(AWKWARD)
    assert [(s["start"], s["end"], s["lang"]) for s in rows[n + 1]["spans"]] == [(0, 124, "en"), (125, 254, "de")]
    assert rows[n + 2]["score"] == 0 and rows[n + 2]["lang_pred"] in model.langs and rows[n + 3]["lang_pred"] == "und"
    assert langid.predict(empty(spark), model).count() == 0


def test_nothing_to_learn(spark):
    docs = documents(spark, ["some text"]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.predict(docs, langid.train(docs)).first()["lang_pred"] == "und"
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert 0 <= quality.predict(docs, quality.train(docs, labels)).first()["score"] <= 1


def test_held_out_rows_are_never_learned_from(spark):
    held = [i for i in range(1, 200) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "bonjour monde", "fr" if i in held else "en") for i in range(1, 200)], "doc_id long, text string, lang string")
    assert langid.train(docs).langs == ["en"]


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op10(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD, quality=1, predicted=5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 15)] + [(3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.predict(docs, quality.train(docs, labels)).collect()}
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[1]["score"] == rows[2]["score"] == rows[3]["score"] and rows[13]["score"] == rows[14]["score"]
    assert quality.predict(empty(spark), quality.train(docs, labels)).count() == 0


OWN = {
    "de": "der hund und die katze sind nicht im haus aber auf dem feld",
    "en": "the dog and the cat are not in the house but on the field",
    "es": "el perro y el gato no están en la casa pero en el campo",
    "fr": "le chien et le chat ne sont pas dans la maison mais sur le champ",
    "ja": "私は学生です。今日は天気が良いので公園に行きました。東京大学で日本語を勉強します。",
    "ru": "это новый дом и большой город где мы жили всегда вместе с семьёй и друзьями",
    "uk": "це новий будинок і велике місто де ми жили завжди разом з родиною та друзями",
    "zh": "我是学生。今天天气很好所以我们去了公园。他们在北京大学学习中文和历史。",
}


def test_languages_of_one_script_among_many(spark):
    held = {i for i in range(1, 600) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    free = [i for i in range(1, 600) if i not in held][: 8 * 20]
    docs = spark.createDataFrame([(d, OWN[sorted(OWN)[i % 8]], sorted(OWN)[i % 8]) for i, d in enumerate(free)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == sorted(OWN)
    words = [(w, x) for x, text in OWN.items() for w in text.split() if sum(w in t.split() for t in OWN.values()) == 1]
    scores = model.score([w for w, _ in words])[:, : len(OWN)]
    top = np.sort(scores, axis=1)
    assert (top[:, -1] > top[:, -2]).all()
    assert [model.langs[j] for j in scores.argmax(axis=1)] == [x for _, x in words]
    texts = ["ми жили разом де велике місто", "где мы жили вместе большой город", "今天我们去了北京大学学习历史", "日本語を勉強しますので東京に行きました"]
    rows = {r["doc_id"]: r for r in langid.predict(documents(spark, texts), model).collect()}
    assert [rows[i]["lang_pred"] for i in range(1, 5)] == ["uk", "ru", "zh", "ja"]
    assert all(r["score"] > 0.9 for r in rows.values())


MASK = (1 << 64) - 1


def grams_by_the_book(token, bits, sizes):
    """Buckets of a token and of its byte n-grams between marks, one at a time."""
    data = token.encode("utf-8", "surrogatepass")
    out = [xxhash.xxh3_64_intdigest(data) >> (64 - bits)]
    data = b"\x01" + data + b"\x02"
    for n in sizes:
        for i in range(len(data) - n + 1):
            code = n
            for byte in data[i : i + n]:
                code = (code * 1099511628211 + byte) & MASK
            code ^= code >> 31
            out.append(((code * 0x9E3779B97F4A7C15) & MASK) >> (64 - bits))
    return out


def quality_by_the_book(model, text):
    tokens = text.split()
    if not tokens:
        return model.empty
    first = [float(model.weights[b]) for t in tokens for b in grams_by_the_book(t, quality.BITS, quality.SIZES)]
    mean = sum(first) / len(first)
    if len(tokens) > 1:
        pairs = []
        for a, b in zip(tokens, tokens[1:]):
            ha, hb = (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in (a, b))
            code = 0 if a == b else (ha * 0x9E3779B97F4A7C15 + hb * 0xC2B2AE3D27D4EB4F) & MASK
            code ^= code >> 31
            pairs.append(float(model.weights[((code * 0xD6E8FEB86659FD93) & MASK) >> (64 - quality.BITS)]))
        mean = (mean + sum(pairs) / len(pairs)) / 2
    return 1 / (1 + math.exp(-mean - model.bias))


def test_quality_scores_by_the_book(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels, rows_per_class=40)
    want = texts(spark, sf)
    got = {r["doc_id"]: r["score"] for r in quality.predict(docs, model).collect()}
    assert set(got) == set(want)
    for i, text in want.items():
        assert abs(got[i] - quality_by_the_book(model, text)) < 1e-4
    odd = documents(spark, AWKWARD).union(documents(spark, AWKWARD)).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    rows = quality.predict(odd, model).collect()
    assert len(rows) == 2 * len(AWKWARD)
    for r in rows:
        assert abs(r["score"] - quality_by_the_book(model, AWKWARD[(r["doc_id"] or 7) - 1] or "")) < 1e-4


def test_numerals_are_no_letters_and_scripts_change_inside_tokens(spark):
    assert [langid.prepared(x) for x in ("½", "²", "Ⅷ", "٣", "a½b", "x́y")] == ["", "", "", "", "a b", "x́y"]
    assert langid.pieces("Hello世界 ok") == ["Hello", "世界", "ok"]
    assert langid.pieces("привет,мир") == ["привет", "мир"] and langid.pieces("für auf") == ["für", "auf"]
    assert langid.pieces("我们今天去了公园x") == ["我们今天", "去了公园", "x"]
    held = {i for i in range(1, 600) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    free = [i for i in range(1, 600) if i not in held][: 8 * 20]
    docs = spark.createDataFrame([(d, OWN[sorted(OWN)[i % 8]], sorted(OWN)[i % 8]) for i, d in enumerate(free)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    mixed = "the dog and the cat are in the house今天天气很好所以我们去了公园"
    cases = ["½ ²", "Ⅷ", mixed, mixed, "123", None]
    frame = documents(spark, cases).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    rows = {r["doc_id"]: r for r in langid.predict(frame, model, spans=True).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 5, 6)] == ["und"] * 4
    assert [(s["lang"], mixed[s["start"] : s["end"]]) for s in rows[3]["spans"]] == [("en", mixed[:36]), ("zh", mixed[36:])]
    assert rows[None]["spans"] == rows[3]["spans"]


def language_by_the_book(model, text):
    """lang_pred and score of one text, word by word."""
    words, every, by, path = langid.pieces(text), 0, {x: 0 for x in model.langs}, []
    scores, letters, fits = [], [], []
    for word in words:
        low = langid.prepared(word)
        letters.append(len(low.replace(" ", "")))
        uses = model.uses[langid.script_of(low)] if low else np.zeros(len(model.langs), bool)
        fits.append(bool(uses.any()))
        if not fits[-1]:
            scores.append(np.zeros(len(model.langs)))
            continue
        logs = sum(model.table[b].astype(float) for b in grams_by_the_book(low, langid.BITS, langid.SIZES)) / 4
        best = logs[uses].max()
        scores.append(np.where(uses, np.maximum(logs - best, -langid.WORD_BOUND), -100))
    if words:
        path = viterbi_by_the_book(np.array(scores), langid.SWITCH_PENALTY)
    for label, n, fit in zip(path, letters, fits, strict=True):
        every += n
        by[model.langs[label]] += n * fit
    if not every:
        return "und", 0.0
    top = max(by.values())
    return next(x for x in model.langs if by[x] == top) if top else model.langs[model.default], top / every


def test_language_by_the_book(spark, sf):
    model = langid.train(table(spark, sf, "documents"), 20)
    want = {i: t for i, t in texts(spark, sf).items() if len(t) < 3000}
    got = {r["doc_id"]: r for r in langid.predict(table(spark, sf, "documents"), model).collect()}
    for i, text in want.items():
        lang, score = language_by_the_book(model, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6


LONG = "Grüße an alle, the of and " * 200_000


def test_texts_of_megabytes(spark):
    docs = documents(spark, [LONG, "the of and"]).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality.predict(docs, model).collect()}
    assert abs(rows[1] - quality_by_the_book(model, LONG)) < 1e-3
    free = docs.withColumn("doc_id", F.col("doc_id") * 7)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(free)).collect()}
    assert got[1]["lang_pred"] == "en" and got[1]["score"] == 1
