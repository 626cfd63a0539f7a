"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

A word scores for each learned language the log-probability of its hashed character n-grams.
The script of its letters leaves only languages that use this script; scores are taken against
the best of these, so a bound on what one word may weigh never makes the best ones equal.  A
token of several scripts is cut where the script changes, and scripts written without spaces
are cut into short pieces, so that a span may begin inside a token.  Viterbi with a penalty for
switching turns the word scores into spans of one language each, so mixed texts are labelled
piece by piece; the document's language is the one with most letters.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import hash_limits, held_out, text_of, trimmed
from sheaf.llm.features import TokenTable, ngrams
from sheaf.llm.tokens import slices

#: About how many labelled rows are drawn per language to fit the model, those with the smallest hashes of doc_id.
TRAIN_ROWS = 1500
BITS, SIZES = 16, (1, 2, 3, 4)
SWITCH_PENALTY = 4.0
#: How far a word's score may fall behind its best language.
WORD_BOUND = 24
#: Share of a language's letters from which it counts as using a script.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
SLICE_CHARS = 3_000_000

# Unicode ranges of scripts.  Letters outside all of them share one more script.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
)
N_SCRIPTS = len(SCRIPTS) + 1

#: Scripts written without spaces, and the letters that one of their pieces has at most.
UNSPACED, PIECE = ("thai", "kana", "han"), 4

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MARKS = "\u0300-\u036f"


def _class(ranges) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _run(name: str, ranges) -> str:
    first, more = f"[{_class(ranges)}]", f"[{_class(ranges)}{_MARKS}]"
    return first + more + (f"{{0,{PIECE - 1}}}" if name in UNSPACED else "*")


_KNOWN = "".join(_class(r) for _, r in SCRIPTS)
#: A character after which a text may hold other scripts than Latin.
_FOREIGN = re.compile(r"[\u0250-\u1dff\u1f00-\u1fff\u2c00-\U0010ffff]")
_RUNS = re.compile("|".join([*(_run(n, r) for n, r in SCRIPTS), rf"(?:(?![{_KNOWN}])[^\W\d_])+"]))


def pieces(text: str) -> list[str]:
    """The units that are judged: tokens, cut where their script changes and, without spaces, every few letters."""
    if text.isascii() or not _FOREIGN.search(text):
        return text.split()
    out = []
    for token in text.split():
        if _FOREIGN.search(token):
            out += _RUNS.findall(token)
        else:
            out.append(token)
    return out


def offsets(text: str, parts: list[str]) -> list[tuple[int, int]]:
    """Start and end, in code points, of the pieces of the text."""
    out, at = [], 0
    for part in parts:
        at = text.index(part, at)
        out.append((at, at + len(part)))
        at += len(part)
    return out


def script_of(word: str) -> int:
    """The script of the word's first letter; pieces do not mix scripts."""
    code = ord(word[0])
    for i, (_, ranges) in enumerate(SCRIPTS):
        if any(a <= code <= b for a, b in ranges):
            return i
    return len(SCRIPTS)


def prepared(token: str) -> str:
    """The letters of a token with their marks, lower-cased; runs of other characters, numerals too, become one space."""
    return " ".join(_LETTERS.findall(token)).lower()


class Model:
    """Per-language n-gram log-probabilities and the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, rows: np.ndarray):
        self.langs = langs
        # tells models apart in a worker, where the address of a broadcast may be used again
        self.token = uuid.uuid4().hex
        share = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1)
        self.table = np.log(share + 1e-6).astype(np.float32)
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.default = int(rows.argmax()) if len(rows) else -1

    def score(self, tokens: list[str]) -> np.ndarray:
        """Per token: scores of the languages, then its letters, then whether any language fits its script."""
        words = [prepared(t) for t in tokens]
        buckets, owners = ngrams([w.encode("utf-8", "surrogatepass") for w in words], SIZES, BITS)
        n, width = len(tokens), len(self.langs)
        out = np.zeros((n, width + 2), np.float32)
        out[:, width] = [len(w) - w.count(" ") for w in words]
        if not width:
            return out
        logs = np.stack([np.bincount(owners, self.table[buckets, j], n) / 4 for j in range(width)], 1)
        fits = np.stack([self.uses[script_of(w)] if w else np.zeros(width, bool) for w in words])
        known = fits.any(axis=1)
        best = np.where(fits, logs, -np.inf).max(axis=1)
        out[known, :width] = np.where(fits, np.maximum(logs - best[:, None], -WORD_BOUND), -100)[known]
        out[:, width + 1] = known
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of all words; the rows of ``scores`` are the words of the documents in turn.

    All documents advance together, one word a step, the longest first.
    """
    total, width = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    best = np.zeros((len(order), width), np.float32)
    kind = np.min_scalar_type(max(width - 1, 0))
    back = np.empty((total, width), kind)
    own = np.arange(width, dtype=kind)
    for t, n in enumerate(active.tolist()):
        rows = starts[:n] + t
        here = best[:n]
        top = here.argmax(axis=1)
        other = here[np.arange(n), top][:, None] - penalty
        switch = other > here
        back[rows] = np.where(switch, top[:, None].astype(kind), own)
        best[:n] = np.where(switch, other, here) + scores[rows]
    labels = np.empty(total, kind)
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        rows = starts[:n] + t
        labels[rows] = now[:n]
        now[:n] = back[rows, now[:n]]
    return labels


def train(docs: DataFrame, rows_per_language: int = TRAIN_ROWS) -> Model:
    """Learn from documents with a language that are not held out.

    Of each language about ``rows_per_language`` rows, those with the smallest hashes of
    doc_id, are counted on the executors; the driver gets one count table per language and task.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    limits = hash_limits(labelled, "lang", rows_per_language)
    if not limits:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((N_SCRIPTS, 0)), np.zeros(0))
    below = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("lang"))
    # a row tells by itself whether it is drawn, so no text is shuffled to be left out
    sample = labelled.where(F.xxhash64("doc_id") <= below).select("lang", "text").repartition(6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = [w for w in map(prepared, pieces(text.as_py())) if w]
                grams, scripts, n = seen.get(lang) or (np.zeros(1 << BITS), np.zeros(N_SCRIPTS), 0)
                if words:
                    grams += np.bincount(ngrams([w.encode("utf-8", "surrogatepass") for w in words], SIZES, BITS)[0], minlength=1 << BITS)
                    for w in words:
                        scripts[script_of(w)] += len(w)
                seen[lang] = grams, scripts, n + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[i].astype(np.float32).tobytes() for v in seen.values()], pa.binary()) for i in (0, 1)), pa.array([v[2] for v in seen.values()], pa.int64())], names=["lang", "grams", "scripts", "n"])

    found: dict[str, list] = {}
    for lang, grams, scripts, n in sample.mapInArrow(trimmed(count), "lang string, grams binary, scripts binary, n long").collect():
        have = found.setdefault(lang, [np.zeros(1 << BITS), np.zeros(N_SCRIPTS), 0])
        have[0] += np.frombuffer(grams, np.float32)
        have[1] += np.frombuffer(scripts, np.float32)
        have[2] += n
    langs = sorted(found)
    return Model(langs, np.stack([found[x][0] for x in langs], 1), np.stack([found[x][1] for x in langs], 1), np.array([found[x][2] for x in langs]))


_TABLES: dict[str, tuple[Model, TokenTable]] = {}


def _table(shared) -> tuple[Model, TokenTable]:
    """The worker's model and token table; of the last model only."""
    model = shared.value
    if model.token not in _TABLES:
        _TABLES.clear()
        _TABLES[model.token] = model, TokenTable(model.score, len(model.langs) + 2)
    return _TABLES[model.token]


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, lang_pred, score, covered and, if asked for, spans (start, end, lang; in code points, from
    the first of a span's pieces to the last).

    ``score`` is the share of the text's letters that lie in spans of the predicted language,
    ``covered`` the share in spans of any learned one.
    Texts that are null or have no letter are ``und`` with score 0.  A text whose letters are
    all of scripts that no learned language uses gets the most common language and score 0;
    with nothing learned all texts are ``und``.  Only ``text`` is an input: repeated rows and
    null ids are judged as the rows they are, other columns make no difference, and an empty
    table gives no rows.  Texts of any length are judged whole.  The columns named
    by ``keep`` are passed on (a null text as an empty one).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _table(shared)
        width = len(model.langs)
        for batch in batches:
            preds, scores, shares, marks = [], [], [], []
            for _, texts in slices(iter([batch]), SLICE_CHARS):
                parts = [pieces(t) for t in texts]
                lengths = np.fromiter(map(len, parts), np.int64, len(parts))
                rows, _ = table.lookup([w for p in parts for w in p])
                labels = viterbi(rows[:, :width], lengths, penalty) if width else np.zeros(len(rows), np.uint8)
                letters, fits = rows[:, width], rows[:, width + 1]
                owner = np.repeat(np.arange(len(parts)), lengths)
                every = np.bincount(owner, letters, len(parts))
                by = np.stack([np.bincount(owner, letters * fits * (labels == j), len(parts)) for j in range(width)], 1) if width else np.zeros((len(parts), 1))
                best = by.argmax(axis=1)
                top = by[np.arange(len(parts)), best]
                shares += np.minimum(1.0, by.sum(axis=1) / np.maximum(every, 1)).tolist()
                for i in range(len(parts)):
                    if not every[i] or not width:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        preds.append(model.langs[best[i] if top[i] else model.default])
                        scores.append(min(1.0, float(top[i] / every[i])))
                if spans:
                    at = 0
                    for text, own_parts in zip(texts, parts, strict=True):
                        n, places = len(own_parts), offsets(text, own_parts)
                        own = np.where(fits[at : at + n] > 0, labels[at : at + n].astype(np.int64), -1)
                        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), n] if n else []
                        marks.append([{"start": places[a][0], "end": places[b - 1][1], "lang": model.langs[own[a]] if own[a] >= 0 else UNKNOWN} for a, b in zip(edges, edges[1:])])
                        at += n
            columns = [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())]
            names = ["doc_id", *keep, "lang_pred", "score", "covered"]
            if spans:
                columns.append(pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = text_of(docs, *(c for c in keep if c != "text"))
    kept = [source.schema[c] for c in keep]
    schema = T.StructType([source.schema["doc_id"], *kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("covered", T.DoubleType())])
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])))
    return source.mapInArrow(trimmed(run), schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query: languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
