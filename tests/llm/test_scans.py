import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from sheaf.llm import licenses as L
from sheaf.llm import secrets as S
from tests.llm.fixtures import AWKWARD, documents, empty, texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_licenses(text):
    words = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in L.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


LICENSED = AWKWARD + [
    "Under the MIT\nlicense. under the mit license CC-BY-NC cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (x)",
    "cc by nc " * 200,
    "license " * 2000,
    "Licensed under the GNU General Public License, version 3 and so on. This work is licensed under the GNU General Public License, version 3.",
    "CC\nBY.NC",
    "under the terms of the gnu general public license as published by the free software foundation, either version 9 of the license",
    "Kelvin lIcense",
]


def test_licenses_on_the_table(spark, sf):
    docs = texts(spark, sf)
    for r in L.op2(spark, sf).collect():
        n, count, first, last, labels = base_licenses(docs[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, count, first, last, ",".join(labels))
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert ("gpl-3" in r["labels"]) == ("GNU General Public License, version 3" in docs[r["doc_id"]])


def test_licenses_on_awkward_rows(spark):
    docs = documents(spark, LICENSED, score=3, labels="clash")
    rows = {r["doc_id"]: r for r in L.scan(docs.union(docs)).distinct().collect()}
    assert len(rows) == len(LICENSED)
    for i, text in enumerate(LICENSED, 1):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_licenses(text)
    at = len(AWKWARD)
    assert [rows[at + k]["labels"] for k in (1, 2, 5, 6, 7)] == [["cc-by-nc", "mit"], ["mit"], ["gpl-3"], ["cc-by-nc"], []]
    assert L.scan(empty(spark)).count() == 0


def test_every_notice_of_a_file_with_many_is_found(spark):
    notices = {label: notice for label, notice, _ in L.TEMPLATES}
    several = [notices[x] for x in ("bsd", "gpl-3", "isc")]
    rare = " ".join(sorted({w for w in L.vocabulary() if w not in " ".join(several).split()}))
    texts = ["\n\n".join(several), notices["isc"] + ". " + notices["gpl-3"], rare + ". " + notices["unlicense"], ". ".join(notices.values())]
    rows = {r["doc_id"]: r["labels"] for r in L.scan(documents(spark, texts)).collect()}
    assert rows == {1: ["bsd", "gpl-3", "isc"], 2: ["gpl-3", "isc"], 3: ["unlicense"], 4: sorted(notices)}


def license_labels(text):
    """Labels and score by trying every template at every place."""
    words = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    at = lambda i: words[i] if 0 <= i < len(words) else None
    labels, score = set(base_licenses(text)[4]), 0.0
    for label, notice, phrases in L.TEMPLATES:
        own = notice.split()
        for start in range(-len(own), len(words)):
            same = [at(start + q) == w for q, w in enumerate(own)]
            if sum(same) / len(own) >= L.LEAST_SHARE and all(all(same[q : q + n]) for q, n in L._key_places(notice, phrases)):
                labels.add(label)
                score = max(score, sum(same) / len(own))
    return sorted(labels), 1.0 if base_licenses(text)[1] else score


def test_labels_of_all_pairs_of_notices(spark):
    rng, notices = random.Random(2), [(label, notice) for label, notice, _ in L.TEMPLATES]
    pairs = [(a, b) for i, a in enumerate(notices) for b in notices[:i]]
    every = [f"{a[1]}. Some words between. {b[1]}" for a, b in pairs]
    damaged = [" ".join(w for w in f"{a[1]} {b[1]}".split() if rng.random() > 0.06) for a, b in pairs[::3]]
    changed = [" ".join("other" if rng.random() < 0.1 else w for w in f"{a[1]} {b[1]}".split()) for a, b in pairs[::3]]
    whole = [" / ".join(n for _, n in notices) + " pad" * 5000]
    docs = documents(spark, [*every, *damaged, *changed, *whole, *LICENSED]).repartition(4)
    rows = {r["doc_id"]: r for r in L.scan(docs).collect()}
    for i, text in enumerate([*every, *damaged, *changed, *whole, *LICENSED], 1):
        labels, score = license_labels(text)
        assert rows[i]["labels"] == labels and abs(rows[i]["score"] - score) < 1e-9, text
    for i, (a, b) in enumerate(pairs, 1):
        assert {a[0], b[0]} <= set(rows[i]["labels"])
    assert set(rows[len(every) + len(damaged) + len(changed) + 1]["labels"]) == {x for x, _ in notices}


def test_every_key_phrase_stands_in_its_notice():
    assert all(L._key_places(notice, phrases) for _, notice, phrases in L.TEMPLATES)


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def shown(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


SECRET = AWKWARD + [
    "secret: token : abcdefgh",
    "Password='abc12' token==abcdefg; éé api_key : ABCDEF AKIA" + "A" * 16 + " x AKIAAKIA" + "B" * 14 + " " + "a" * 23 + " " + "b" * 24,
    "é" * 10 + "\nuser = bob\nhost=db.example.com\nAbCdEfGh1234567890XyZ12\n\n\nuser=eve",
    "plain https://example.com/abc only and user: bob",
    "a" * 30 + "token=ab api_key=cdefgh",
    "AbCdEfGh1234567890XyZ12 alone",
    "user=ann\n\nAbCdEfGh1234567890XyZ12",
    "token=abcdef " * 300,
]


def test_secrets_on_the_table(spark, sf):
    docs = texts(spark, sf)
    for r in S.op4(spark, sf).collect():
        want = base_secrets(docs[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(shown(want).encode()).hexdigest()
        assert set(filter(None, shown(want).split(","))) <= set(r["spans"].split(","))


def test_secrets_on_awkward_rows(spark):
    docs = documents(spark, SECRET, base="clash", spans=1)
    rows = {r["doc_id"]: r for r in S.find(docs).withColumn("shown", S.render(F.col("spans"))).collect()}
    for i, text in enumerate(SECRET, 1):
        assert [(s["start"], s["order"], s["stop"]) for s in rows[i]["base"]] == base_secrets(text or "")
    at = len(AWKWARD)
    assert rows[at + 3]["shown"] == "identifier:11:21,endpoint:22:41,secret:42:65"
    # no part alone, and none across a blank line
    assert [rows[at + k]["shown"] for k in (4, 6, 7)] == ["", "", ""]
    assert S.find(empty(spark)).count() == 0


def test_redaction_leaves_clean_rows_alone(spark):
    docs = documents(spark, SECRET, spans="clash").withColumn("n_chars", F.char_length("text"))
    got = S.redact(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, text in enumerate(SECRET, 1):
        if not base_secrets(text or "") and "AbC" not in (text or ""):
            assert rows[i]["text"] == text
        elif base_secrets(text):
            assert all(text[a:b] not in rows[i]["text"] for a, _, b in base_secrets(text))
            assert rows[i]["n_chars"] == len(rows[i]["text"])


def test_overlapping_parts_do_not_bear_each_other_out(spark):
    secret, url = "AbCdEfGh1234567890XyZ12", "https://example.com/Wiki/2024/LongPathTitle1"
    cases = [
        (f"see {url} for more", ""),
        ("account: Ab3dEf6hIj9kLm2nOp5qR", ""),
        (f"user=bob {url}", ""),
        (f"user=bob {url} {secret}", "identifier:0:8,endpoint:9:53,secret:54:77"),
        (f"{secret} {url}", "secret:0:23,endpoint:24:68"),
        (f"{url}?LongOtherTitle2OfThePath {secret}", "endpoint:0:69,secret:70:93"),
        (f"user=bob account: {secret}", "identifier:0:8,secret:18:41"),
        (f"{secret} " + "x" * 300 + f" {url}", ""),
    ]
    docs = documents(spark, [t for t, _ in cases])
    rows = {r["doc_id"]: r["shown"] for r in S.find(docs).withColumn("shown", S.render(F.col("spans"))).collect()}
    assert [rows[i] for i in range(1, len(cases) + 1)] == [want for _, want in cases]
    assert S.redact(docs).where("doc_id = 1").first()["text"] == cases[0][0]


def part_spans(text):
    """Base and linked spans of a text by looking at all pairs of parts."""
    find = lambda pattern, k: [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.A)]
    meets = lambda p, q: p[0] < q[2] and q[0] < p[2]
    base, endpoints, limits = base_secrets(text), find(S.ENDPOINT, 5), find(r"\n[\x20\t\r]*\n", 9)
    secret = [p for p in find(S.SECRET, 4) if not any(meets(p, q) for q in endpoints)]
    weak = [p for p in [*find(S.IDENTIFIER, 3), *secret, *endpoints] if not any(meets(p, q) for q in base)]
    wanted = {3: (0, 2, 4), 5: (0, 2, 4), 4: (1, 3, 5)}
    out = list(base)
    for p in weak:
        for q in [*base, *weak]:
            first, second = sorted((p, q))
            gap = second[0] - first[2]
            if q[1] in wanted[p[1]] and 0 <= gap <= S.REACH and not any(first[2] <= x[0] and x[2] <= second[0] for x in limits):
                out.append(p)
                break
    return sorted(out)


def random_texts(seed, count):
    rng = random.Random(seed)
    secret = lambda: "".join(rng.choice("abcXYZ019_/-") for _ in range(24)) + "aZ9"
    makers = [
        secret, lambda: "user=bob", lambda: "account: " + secret(), lambda: "https://example.com/a/" + rng.choice(["b", secret()]), lambda: "token=abcdef" + rng.choice("gh"), lambda: "AKIA" + "Q" * 16,
        lambda: "0123456789abcdef" * 2, lambda: "\n\n", lambda: "\n \t\n", lambda: "word " * rng.choice((1, 20, 59, 61)), lambda: "é好", lambda: "host=db.example.com", lambda: "https://x.y/?token=abcdefg&sig=" + secret(), lambda: "secret: " + secret(), lambda: "password=a",
    ]
    return ["".join(rng.choice(makers)() + rng.choice([" ", " ", "\n", ",", ""]) for _ in range(rng.randint(1, 14))) for _ in range(count)]


def test_linking_against_all_pairs(spark):
    every = [*SECRET, *random_texts(1, 600)]
    frame = documents(spark, every).repartition(4)
    rows = {r["doc_id"]: r["shown"] for r in S.find(frame).withColumn("shown", S.render(F.col("spans"))).collect()}
    for i, text in enumerate(every, 1):
        assert rows[i] == shown(part_spans(text or "")), text
    got = {r["doc_id"]: r["text"] for r in S.redact(frame).collect()}
    for i, text in enumerate(every, 1):
        out, at = "", 0
        for a, k, b in part_spans(text or ""):
            if k in S.REDACTED and b > at:
                out, at = out + text[at : max(a, at)] + "[secret]", b
        assert got[i] == (None if text is None else out + text[at:])


def test_plain_addresses_are_left_alone(spark):
    clean = ["see https://docs.google.com/document/d/1AbCdEfGhIjKlMnOpQrStUvWxYz012345/edit for notes", "user: bob wrote https://github.com/Some/Repo/blob/0Ab1Cd2Ef3Gh4Ij5Kl6/src/Main.java", "https://a.example/B1c2D3e4F5g6H7i8J9k0 https://b.example/Z1y2X3w4V5u6T7s8R9q0"]
    docs = documents(spark, clean)
    assert [r["spans"] for r in S.find(docs).collect()] == [[]] * 3
    assert [r["text"] for r in S.redact(docs).orderBy("doc_id").collect()] == clean


def test_many_matches_in_a_long_text(spark):
    text = "token=abcdef é user=bob\n" * 40_000 + "x" * 4_000_000
    began = time.time()
    row = S.find(documents(spark, [text])).select(F.size("base").alias("n"), F.element_at("spans", -1).alias("last"), F.size("spans").alias("all")).first()
    assert (row["n"], row["all"]) == (40_000, 80_000) and row["last"]["stop"] == 24 * 40_000 - 1
    assert S.redact(documents(spark, [text])).first()["text"] == "[secret] é user=bob\n" * 40_000 + "x" * 4_000_000
    assert time.time() - began < 60


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["token=abcdef"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [S.render(F.lit(1)) is not None and r["spans"][0]["stop"] for r in S.find(docs.union(docs)).collect()] == [12, 12]
    assert [r["labels"] for r in L.scan(documents(spark, ["under the mit license"] * 2).withColumn("doc_id", F.lit(None).cast("long"))).collect()] == [["mit"]] * 2


ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."


def labelled(spark, texts, **more):
    return {r["doc_id"]: r["labels"] for r in L.scan(documents(spark, texts), **more).collect()}


def test_licenses_of_callers_templates(spark):
    made = (("own", "may be painted blue by anyone who likes the sea", ("painted blue by anyone",)), ("tiny", "we do as we do", ("do as we do",)), ("é", "à çà et là du vin", ("çà et là",)))
    texts = ["This house may be painted blue by anyone who likes the sea.", "so We do, as we do!", "à çà et LÀ du vin", "à ÇÀ et là du vin", "à çà et là du vin", ZLIB]
    assert labelled(spark, texts, templates=made, base=()) == {1: ["own"], 2: ["tiny"], 3: [], 4: [], 5: ["é"], 6: []}
    assert labelled(spark, texts, templates=(), base=(("blue by", "b"),)) == {1: ["b"], **{i: [] for i in range(2, 7)}}


def test_licenses_that_are_near_to_others(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this font and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use",
        "// SPDX-License-Identifier: GPL-3.0-only\nint x;",
        ZLIB,
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This software may not be altered by the authors.",
    ]
    assert labelled(spark, texts) == {1: [], 2: ["ofl-1.1"], 3: ["gpl-3"], 4: ["zlib"], 5: ["boost-1"], 6: ["cc-by-nc"], 7: []}


def test_every_template_passes_its_own_filter():
    weights = {w: 1.0 + len(w) % 3 for w in L.vocabulary()}
    chosen = L.triggers(weights, L.TEMPLATES, L.BASE)
    assert len(chosen) < 20
    for phrases in [*((p,) for p, _ in L.BASE), *(p for _, _, p in L.TEMPLATES)]:
        assert any(t in " ".join(phrases) for t in chosen)


def test_licenses_in_texts_of_megabytes(spark):
    filler = "words of no licence at all " * 120_000
    got = L.scan(documents(spark, [filler + "under the MIT license " + filler + ZLIB])).first()
    assert got["labels"] == ["mit", "zlib"] and got["n_base"] == 1 and got["first_word"] == 720_000
