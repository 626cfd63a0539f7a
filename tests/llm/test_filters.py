"""Operator 12 against every order applied document by document, and awkward rows."""

import re
from itertools import permutations

import pytest

from sheaf.llm import filters
from tests.llm.fixtures import AWKWARD

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def by_the_book(docs, labels):
    """(part, order, step) -> numbers; docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    ids = {}
    for i, text, _ in docs:
        ids.setdefault(text or "", set()).add(i)
    judged = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(other is not None and (i is None or other < i) for other in ids[text])
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": smaller,
        }
        mine = [row for row in labels if i is not None and row[0] == i]
        judged.append((source or "", fails, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    out = {}
    for part in {p for p, *_ in judged}:
        rows = [j[1:] for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                lost = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                failing = [r for r in rows if r[0][f]]
                alone = [r for r in failing if sum(r[0].values()) == 1]
                shapley[f] += len(lost)
                out[part, "".join(order), k + 1] = [len(left), len(lost), len(failing) - len(lost), len(alone), sum(r[1] for r in lost), sum(r[2] for r in lost), f]
        for key, value in out.items():
            if key[0] == part:
                value[6] = shapley[value[6]]
    return out


def run(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): [*(r[c] for c in COLUMNS), r["shapley"]] for r in filters.audit(docs.repartition(3), labels).collect()}


MANY = " ".join(f"w{i}" for i in range(250))
TEXTS = [*AWKWARD, MANY, MANY + " # ", MANY.upper(), "w " * 300, MANY, " ".join(f"W{i % 90}" for i in range(200)), "é" * 49 + "A", "x" * 99 + "A", "x" * 98 + "AB", "word\x0bword\x1fa\xa0b c " * 70]


@pytest.mark.parametrize("ids", ["own", "null", "same"])
def test_awkward_rows_equal_every_order_by_the_book(spark, ids):
    number = {"own": lambda i: i, "null": lambda i: None if i % 3 else i, "same": lambda i: 7}[ids]
    docs = [(number(i), t, (None, "", "a", "b")[i % 4]) for i, t in enumerate(TEXTS)] * 2
    labels = [(number(i), i % 2, (i // 2) % 2) for i in range(0, len(TEXTS), 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (999, 1, 1)]
    got, want = run(spark, docs, labels), by_the_book(docs, labels)
    assert set(got) == set(want) and len(got) == 3 * 600
    assert all(got[k] == want[k] for k in want)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    assert run(spark, [(1, None, None)], [])["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_clashing_columns_make_no_difference(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, MANY, "s"), (2, "x", "s")], "doc_id long, text string, source string").withColumns({"part": F.lit(1), "digest": F.lit(2), "words": F.lit(3), "A": F.lit(4), "copies": F.lit(5)})
    labels = spark.createDataFrame([(2, 0, 1)], "doc_id long, quality int, toxic int").withColumns({"good": F.lit(9), "text": F.lit("t"), "part": F.lit("p")})
    rows = {(r["filter_order"], r["step"]): r for r in filters.audit(docs, labels).collect()}
    first = rows["ABCDE", 1]
    assert len(rows) == 600 and (first["kept"], first["removed"], first["toxic_lost"]) == (1, 1, 1)


def test_texts_of_megabytes_count_whole(spark):
    long = " ".join(str(i % 300_000) for i in range(600_000))
    got = run(spark, [(1, long, "s"), (2, long + " &", "s")], [])
    assert got["s", "BADCE", 1][:3] == [2, 0, 0] and got["s", "DABCE", 1][:3] == [1, 1, 0]
