"""Token budgets and imports: sections and titles are those that the data has."""

import pytest
from pyspark.sql import functions as F

from sheaf import adaptors, catalog, importing
from sheaf.config import Chunking, Settings
from sheaf.operators import chunking

public = pytest.importorskip("public_tokenizers")
BPE = public.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i}" for i in range(700))
AWKWARD = ["", " ", "x", "supercalifragilistic" * 90, "😀" * 300, "a\n\nb", "<|endoftext|> " * 30, LONG, "日本語のテキスト" * 80]


@pytest.mark.parametrize("made", [adaptors.WordTokenizer(), adaptors.FileTokenizer(BPE)], ids=["words", "bpe"])
@pytest.mark.parametrize("budget", [1, 7, 100])
def test_windows_fit_and_lose_nothing(made, budget):
    for text in AWKWARD:
        parts = chunking.token_windows(text, made, budget)
        squeezed = lambda t: "".join(t.split())
        assert "".join(squeezed(p) for p, _ in parts) == squeezed(text)
        for piece, count in parts:
            assert count == len(made.offsets([piece])[0]) and (count <= budget or len(piece) == 1)
        if budget == 100 and text == LONG:
            assert all(p[:4] == "word" for p, _ in parts)


def item(section, text, page=None, header=None):
    return {"section": section, "text": text, "page": page, "header": header}


def test_peers_are_put_together_and_heads_repeated():
    made = adaptors.FileTokenizer(BPE)
    count = lambda t: len(made.offsets([t])[0])
    items = [item("A", "one two", 1), item("A", "three", 3), item("B", "four"), item("B", LONG), item("B", "end")]
    got = chunking.pack_tokens(items, made, 50)
    assert (got[0]["text"], got[0]["first"], got[0]["last"]) == ("one two\nthree", 1, 3) and all(c["tokens"] == count(c["text"]) <= 50 for c in got)
    assert [c["section"] for c in got] == ["A"] + ["B"] * (len(got) - 1) and len(chunking.pack_tokens(items, made, 50, merge=False)) > len(got)
    rows = "Name | Value\n" + "\n".join(f"row{i} | {i}" for i in range(100))
    table = chunking.pack_tokens([item(None, rows, None, "Name | Value")], made, 60)
    assert len(table) > 5 and all(c["text"].startswith("Name | Value\n") and c["tokens"] <= 60 for c in table)
    assert sorted(line for c in table for line in c["text"].split("\n")[1:]) == sorted(rows.split("\n")[1:])
    assert not chunking.pack_tokens([item(None, rows, None, "Name | Value")], made, 60, repeat=False)[1]["text"].startswith("Name")


def test_documents_have_no_sections_and_settings_are_in_force(spark, tmp_path):
    docs = spark.createDataFrame([(1, "First line.\n\nSecond line.\nThird", "s1"), (2, LONG, "s2"), (3, LONG, "s3"), (4, " \n", "s"), (5, None, "s"), (2, "First line.\n\nSecond line.\nThird", None)], "doc_id long, text string, source string")
    for settings in (Settings(), Settings(chunking=Chunking(max_tokens=128, metadata_reserve=28, tokenizer=BPE))):
        held = catalog.Catalog(spark, str(tmp_path / str(settings.chunking.max_tokens)))
        importing.into(held, importing.from_documents(docs), settings)
        chunks, papers = held.table("chunks"), held.table("documents").collect()
        assert chunks.where("section is not null or page_start is not null or paper_title is not null or section_type != 'content' or content_kind != 'body'").count() == 0
        assert {(p["source"], p["title_source"]) for p in papers} == {("s1", "unresolved"), ("s2", "unresolved")}
        assert chunks.where("raw_text = 'First line.\\nSecond line.\\nThird'").count() == 1
        assert chunks.agg(F.max("raw_token_count")).first()[0] <= settings.chunking.budget
        words = " ".join(r["raw_text"] for r in chunks.where("raw_text like '%word%'").orderBy("chunk_index").collect()).split()
        assert words == LONG.split()
    assert {p["chunker_id"] for p in papers} == {"tokens_v1"} and chunks.agg(F.max("embedding_token_count")).first()[0] <= 128


def test_pages_have_their_own_sections(spark, tmp_path):
    page = f"<title>Own title</title><nav>menu entry</nav><h1>Flows</h1><div>Loose text.</div><h2>Data</h2><p>{LONG}</p><table><tr><th>A<th>B<tr><td>1<td>2</table><h2>References</h2><ol><li>[1] Ref one</ol><footer>foot</footer>"
    pages = spark.createDataFrame([(1, "u1", page), (2, "u2", page), (3, "u3", "<div>Flows</div>"), (4, "u4", None), (5, "u5", "<nav>x</nav>")], "page_id long, url string, html string")
    held = catalog.Catalog(spark, str(tmp_path / "s"))
    importing.into(held, importing.from_pages(pages, Settings()), Settings(chunking=Chunking(tokenizer=BPE)))
    got = held.table("chunks").collect()
    first = [c for c in got if c["source"] == "u1"]
    assert {c["source"] for c in got} == {"u1", "u3"} and {c["section"] for c in first} == {"Flows", "Flows > Data", "Flows > References"}
    assert {c["section_type"] for c in first if c["section"].endswith("References")} == {"bibliography"}
    text = " ".join(c["raw_text"] for c in sorted(first, key=lambda c: c["chunk_index"]))
    assert "menu entry" not in text and "foot" not in text and "Loose text." in text and "A | B\n1 | 2" in text and text.count("word699") == 1
    assert all(c["raw_token_count"] <= 448 for c in got)


def test_token_chunks_of_all_documents_equal_plain_python(spark, sf):
    from sheaf import registry
    from sheaf.plans import fixtures as fx

    made = adaptors.FileTokenizer(BPE)
    want = {}
    for r in fx.papers(spark, sf).select("paper_id", fx.items_of(F.col("text")).alias("items")).collect():
        # pieces of at most 448 tokens, put together while the joined text fits
        out = []
        for i in r["items"]:
            for text, _ in chunking.token_windows(i["text"], made, 448):
                joined = f"{out[-1][1]}\n{text}" if out else text
                if out and out[-1][0] == i["section"] and len(made.offsets([joined])[0]) <= 448:
                    out[-1] = (i["section"], joined)
                else:
                    out.append((i["section"], text))
        for k, (section, text) in enumerate(out):
            want[f"{r['paper_id']}_chunk_{k:04d}"] = (section, len(made.offsets([text])[0]))
    got = {r["chunk_id"]: (r["section"], r["raw_token_count"]) for r in registry.QUERIES["chunk_tokens_bpe"](spark, sf).collect()}
    assert got == want and max(n for _, n in got.values()) <= 448


def test_words_are_counted_once_and_as_in_their_text():
    made, seen = adaptors.FileTokenizer(BPE), []
    texts = [*AWKWARD, "it's 'quoted', isn't it?\nA2b 3rd 12 100,000.5 end.", "a\tb c", " lead", "trail\n", "a \nb", "x\n y", "naïve ñ ciónque s", "a\x1cb c", "\n", "tail <|endoftext|>\nmore<|endoftext|>", "... ' s 've\n'll -- _a_", "a​b ᠎c \u0085d"]
    assert made.counts(texts) == [len(o) for o in made.offsets(texts)]
    assert made.by_words and made.counts(texts) == [made.counts([t])[0] for t in texts]
    plain = "some plain words that are all known\nby now"
    made.counts([plain])
    library, made.made = made.made, type("Spy", (), {"encode_batch": lambda self, new, **more: seen.append(new) or library.encode_batch(new, **more)})()
    assert made.counts([plain, "plain words that some"]) == [len(library.encode(t).ids) for t in (plain, "plain words that some")]
    # a word that begins the text and one after a space are two
    assert [sorted(new) for new in seen] == [[" some", "plain"]]


def test_joined_texts_are_not_counted_again():
    made = adaptors.FileTokenizer(BPE)
    items = [item("A", text) for text in ("one two,", "it's three", " lead", "four", "five  six", "seven", "x", "日本語")]
    got = chunking.pack_tokens(items, made, 100)
    assert [(c["text"], c["tokens"]) for c in got] == [("\n".join(i["text"] for i in items), len(made.offsets([got[0]["text"]])[0]))]
    seen, real = [], made.counts
    made.counts = lambda texts: seen.extend(texts) or real(texts)
    chunking.pack_tokens([item("A", "one two,"), item("A", "it's three"), item("A", "four")], made, 100)
    assert seen == ["one two,", "it's three", "four"]
