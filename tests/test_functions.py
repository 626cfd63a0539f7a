"""Text, vector and JSON functions against literal expectations."""


import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf import config
from sheaf.functions import json as J
from sheaf.functions import text as X
from sheaf.functions import vector as V


def values(spark, rows, make, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hyphens(spark):
    cases = {
        "humid-\nity": "humidity", "low-pres-\nsure": "low-pressure", "model-\nbased": "model-based", "fore-\ncasting": "forecasting", "state-of-the-\nart": "state-of-the-art",
        "graph-\nwave": "graph-wave", "soft­ ware": "software", "n-1 stays": "n-1 stays", "a-\nB": "a-\nB", "two humid-\nity and forecast-\ning": "two humidity and forecasting",
    }
    assert values(spark, list(cases), X.repair_hyphens) == list(cases.values())


def test_headings(spark):
    assert values(spark, ["A R T I C L E  I N F O", "A Title", "A B S T R A C T"], X.merge_spaced_capitals) == ["ARTICLE INFO", "A Title", "ABSTRACT"]
    assert values(spark, ["2. One 2.1. Two", "2. One", "x 2.1. Two", "1. A 2. B 3. C"], X.split_numbered_heading) == [["2. One", "2.1. Two"], ["2. One"], ["x 2.1. Two"], ["1. A 2. B 3. C"]]
    assert values(spark, ["References", "7. References:", "IV. Bibliography", "a > Works  Cited", "R E F E R E N C E S", "Reference model", None], X.is_bibliography) == [True, True, True, True, True, False, False]


def test_counters_and_formulas(spark):
    assert values(spark, ["3 of 11", "Page 3", "3 / 11", "7", "3 of them"], X.is_page_counter) == [True, True, True, True, False]
    assert values(spark, ["Page 3 of 11 Text", "3 of 11"], X.strip_page_counter) == ["Text", "3 of 11"]
    assert values(spark, ["cell 8 of", "8 of 9"], X.strip_dangling_counter) == ["cell", "8 of 9"]
    assert values(spark, ["a = b \\quad (1 2) prose", "a = b</formula>", "a = b"], X.clean_formula) == ["a = b \\quad (1 2)", "a = b", "a = b"]


def test_captions(spark):
    once = "Figure 3. " + "the pattern of speeds over a day " * 3
    first, second = (values(spark, [once + " " + once.replace("pattern", "pa ttern"), once, "Table 1. see Figure 3."], lambda c, k=k: X.caption_repeat(c)[k]) for k in (0, 1))
    assert first[0] == once.strip() and second[0].startswith("Figure 3.") and first[1:] == ["", ""]


def test_lists(spark):
    kind = "array<string>"
    assert values(spark, [[" E1 ", "E1", "", "e1"]], X.first_seen, kind) == [["E1", "e1"]]
    assert values(spark, [[" A ", "a", "", "B", "b"]], X.first_seen_folded, kind) == [["A", "B"]]
    assert values(spark, [[" a ", "", "b  c"], []], X.section_path, kind) == ["a > b c", None]
    assert values(spark, ["As [E1] and [R2], [E1]; [X3]"], X.citation_labels) == [["E1", "R2"]]


def test_small_ones(spark):
    assert values(spark, ["Contributions here", ""], lambda c: X.signal_count(F.lower(c), ("contribution", "contributions"))) == [2, 0]
    assert values(spark, ["5 of 10% by 2.5", ""], X.numeric_density) == [3 / 5, 0.0]
    assert values(spark, ["Café Ünï_x-1.5 漢字"], X.tokens) == [["cafe", "uni", "x", "1", "5", "漢字"]]
    assert [values(spark, [v], lambda c: X.page_label(c, F.lit(b).cast("int")), "int")[0] for v, b in ((None, None), (None, 3), (2, None), (2, 2), (2, 4))] == ["unknown", "unknown", "2", "2", "2-4"]


def test_vectors(spark):
    kind = "array<float>"
    assert values(spark, [[3.0, 4.0]], V.normalize, kind)[0] == pytest.approx([0.6, 0.8])
    assert values(spark, [[1.0, 0.0], [1.0], [2.0, 0.0], [float("nan"), 0.0], None], lambda c: V.problem(c, 2), kind) == [None, "dimension", "not unit", "not finite", "missing"]
    assert values(spark, [0.0, 100.0], V.sigmoid, "double") == pytest.approx([0.5, 1.0])
    with pytest.raises(Exception, match="no direction"):
        values(spark, [[0.0, 0.0]], V.normalize, kind)


def test_strict_json(spark):
    rows = ['{"a":1,"b":"x"}', '{"a":1}', '{"a":1,"b":"x","c":2}', "no", "[1]", None]
    assert values(spark, rows, lambda c: J.has_exactly(c, ("a", "b"))) == [True, False, False, False, False, False]
    assert values(spark, ['{"a":"x"}', '{"a":1}', '{"a":null}'], lambda c: J.has_types(c, {"a": ("STRING", "VOID")})) == [True, False, True]


def test_settings():
    assert config.Settings().retrieval.bm25_rewrite_weight == 1.2 and config.Settings().chunking.budget == 448
    assert config.build(config.Settings, {"retrieval": {"rrf_k": 10, "rewrite": {"max_keywords": 5}}}).retrieval.rewrite.max_keywords == 5
    for bad in ({"retrieval": {"rrf_k": 0}}, {"retrieval": {"dense_original_weight": 0}}, {"unknown": 1}, {"context": {"neighbor_window": True}}, {"reranking": {"final_top_k": 2.5}}):
        with pytest.raises(config.ConfigurationError):
            config.build(config.Settings, bad)
    env = {"SHEAF_LLM_BASE_URL": "http://x", "SHEAF_LLM_MODEL": "m", "SHEAF_LLM_TIMEOUT_SECONDS": "5"}
    assert config.load_runtime(env).timeout_seconds == 5
    for bad in ({}, env | {"SHEAF_LLM_TIMEOUT_SECONDS": "x"}, env | {"SHEAF_LLM_TIMEOUT_SECONDS": "0"}):
        with pytest.raises(config.ConfigurationError):
            config.load_runtime(bad)
    assert config.resolve_path("/a", "b") == "/a/b" and config.resolve_path("/a", "/b") == "/b"


@given(st.integers(-5, 5000))
def test_ranges_hold(k):
    if 1 <= k <= 1000:
        assert config.Retrieval(rrf_k=k).rrf_k == k
    else:
        with pytest.raises(config.ConfigurationError):
            config.Retrieval(rrf_k=k)




def test_keywords_of_letters_whose_capital_is_two(spark):
    row = spark.createDataFrame([(["Er\u00dfie", "ERSSIE", "er\u00dfIE", "other", "OTHER"],)], "w array<string>")
    assert row.select(X.first_seen_folded(F.col("w")).alias("w")).first()["w"] == ["Er\u00dfie", "other"]
