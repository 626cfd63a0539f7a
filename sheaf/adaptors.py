"""Where models plug in: embedders, rerankers, parsers, rewriters and chat clients.

Model calls run over Arrow batches, with the model made once per worker from a factory that
is shipped instead of the model.  The defaults are deterministic and need no model: hashed
terms for embeddings, term overlap for reranking.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as X


class Embedder(Protocol):
    dimension: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_queries(self, texts: list[str], instruction: str) -> np.ndarray: ...


class Reranker(Protocol):
    def rerank(self, query: str, passages: list[str]) -> list[float]: ...


class ChatClient(Protocol):
    def complete(self, system: str, user: str) -> str: ...

    def complete_json(self, system: str, user: str, schema: dict) -> str: ...


class Parser(Protocol):
    """Turns a file's bytes into layout items (dictionaries)."""

    def __call__(self, content: bytes) -> list[dict]: ...


class Tokenizer(Protocol):
    """What counts tokens: for each text the places (start, end) of its tokens in characters."""

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]: ...


class WordTokenizer:
    """Words between white space."""

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [[m.span() for m in re.finditer(r"\S+", text)] for text in texts]


#: Words whose numbers of tokens are kept by a worker, and the longest of them.
WORDS, WORD_CHARS = 500_000, 64
#: White space at which a text is not cut into words: other than spaces and line feeds, several in a row, or at an end.
UNCUT = re.compile(r"[^\S \n]|[ \n]{2}|^[ \n]|[ \n]\Z")


class FileTokenizer:
    """A tokenizer from a JSON file, which the driver reads once; the workers get its content.

    The pattern of byte-level tokenizers never joins what stands before a single space, or on the
    two sides of a single line feed, with what stands there otherwise; so a text has as many tokens
    as its words have, and a word that was counted before is looked up.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            self.content = source.read()
        self.made, self.known = None, {}

    def __getstate__(self) -> dict:
        return {"content": self.content, "made": None, "known": {}}

    def _load(self) -> None:
        from tokenizers import Tokenizer as Library

        self.made = Library.from_str(self.content)
        self.made.no_truncation()
        # strings of special tokens are text like any other
        self.made.encode_special_tokens = True
        told = json.loads(self.content)
        pre = told.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told["model"].get("type") == "BPE"
        self.by_words = plain and not told.get("normalizer") and not told.get("padding") and all(t["special"] for t in told.get("added_tokens") or ())
        self.feed = len(self.made.encode("\n", add_special_tokens=False).ids)

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        if self.made is None:
            self._load()
        return [e.offsets for e in self.made.encode_batch(texts, add_special_tokens=False)]

    def even(self, text: str) -> bool:
        """Whether a text is cut into words; two such with a line feed between have their tokens and ``feed`` more."""
        if self.made is None:
            self._load()
        return self.by_words and text != "" and not UNCUT.search(text)

    def counts(self, texts: list[str]) -> list[int]:
        """How many tokens each text has."""
        if self.made is None:
            self._load()
        if len(self.known) > WORDS:
            self.known = {}
        known = self.known
        cut = [re.findall(r" ?[^ \n]+", t) if self.by_words and not UNCUT.search(t) else [t] for t in texts]
        new = list({w for words in cut for w in words if w not in known})
        fresh = {w: len(e.ids) for w, e in zip(new, self.made.encode_batch(new, add_special_tokens=False) if new else (), strict=True)}
        known.update((w, n) for w, n in fresh.items() if len(w) <= WORD_CHARS)
        # a text that was not cut has its line feeds counted
        feeds = [self.feed * t.count("\n") if words != [t] else 0 for t, words in zip(texts, cut, strict=True)]
        return [more + sum(known[w] if w in known else fresh[w] for w in words) for more, words in zip(feeds, cut, strict=True)]


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a settings path; without one words are counted."""
    return FileTokenizer(path) if path else WordTokenizer()


class HashEmbedder:
    """Signed term hashing to unit vectors; a text without terms points along the first axis."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for term in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
            if not out[i].any():
                out[i, 0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def embed_queries(self, texts: list[str], instruction: str = "") -> np.ndarray:
        return self.embed_documents(texts)


def embed(rows: DataFrame, factory: Callable[[], Embedder], column: str = "embedding_text") -> DataFrame:
    """Adds ``embedding``; blank texts and vectors that are not finite and of unit length end the query."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            if (texts.isna() | (texts.str.strip() == "")).any():
                raise ValueError("a text to embed is blank")
            vectors = np.asarray(model.embed_documents(texts.tolist()), np.float32)
            norms = np.linalg.norm(vectors, axis=1)
            if vectors.shape != (len(texts), model.dimension) or not np.isfinite(vectors).all() or (np.abs(norms - 1) > 1e-4).any():
                raise ValueError("the embedder gave vectors that are not valid")
            yield pd.Series(list(vectors))

    # the hints tell an iterator UDF from a plain one
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(column))


def rerank(pairs: DataFrame, factory: Callable[[], Reranker]) -> DataFrame:
    """Scores of (qid, chunk_id, query, passage): qid, chunk_id, rerank_score.

    A query whose reranking fails gets no scores at all, so its fused order stays: the model
    raises, gives another number of scores than passages, or one that is no number, or a
    passage is blank.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk_id")
        try:
            if (group["passage"].isna() | (group["passage"].str.strip() == "")).any():
                raise ValueError("a passage to rerank is blank")
            scores = [float(s) for s in factory().rerank(group["query"].iloc[0], group["passage"].tolist())]
            if len(scores) != len(group) or not np.isfinite(scores).all():
                raise ValueError("the scores are not one finite number for each passage")
        except Exception:
            # whatever the model raised: this query falls back
            return group.iloc[:0].assign(rerank_score=0.0)[["qid", "chunk_id", "rerank_score"]]
        return group.assign(rerank_score=scores)[["qid", "chunk_id", "rerank_score"]]

    # the candidates of one query are at most candidate_top_k rows
    return pairs.groupBy("qid").applyInPandas(one, "qid long, chunk_id string, rerank_score double")


def embed_queries(rows: DataFrame, factory: Callable[[], Embedder], instruction: str = "") -> DataFrame:
    """qid, embedding of questions (qid, text)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(list(np.asarray(model.embed_queries(texts.tolist(), instruction), np.float32)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.select("qid", F.pandas_udf(run, "array<float>")("text").alias("embedding"))


def ask(prompts: DataFrame, factory: Callable[[], ChatClient], system: str, schema: dict) -> DataFrame:
    """qid, query, payload: the model's JSON for each user text (qid, query), null where the call failed.

    Calls run on the executors, one after another in a partition, with the client made there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            replies = []
            for text in batch["query"]:
                try:
                    replies.append(client.complete_json(system, text, schema))
                except Exception:
                    # the step is optional: what has no reply falls back
                    replies.append(None)
            yield batch.assign(payload=replies)

    return prompts.select("qid", "query").mapInPandas(run, "qid long, query string, payload string")


def rewrite(queries: DataFrame, factory: Callable[[], ChatClient], system: str, schema: dict, most: int = 3) -> DataFrame:
    """qid, query, payload: a model's plan for each question (qid, query, and turns if there are any)."""
    from sheaf import prompts

    turns = F.col("turns") if "turns" in queries.columns else F.lit(None).cast("array<string>")
    asked = queries.select("qid", prompts.rewrite(F.col("query"), turns, most).alias("query"))
    return queries.select("qid", "query").join(ask(asked, factory, system, schema).select("qid", "payload"), "qid")


def rewrite_offline(queries: DataFrame, most: int = 3) -> DataFrame:
    """Adds ``payload`` by rule: the question as it is, and its longest words as keywords."""
    words = F.array_distinct(F.filter(X.tokens(F.col("query")), lambda w: F.length(w) >= 4))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    plan = F.struct(F.col("query").alias("semantic_query"), F.transform(F.slice(ranked, 1, most), lambda x: x["w"]).alias("lexical_keywords_en"), F.lit(False).alias("search_bibliography"))
    return queries.select("qid", "query", F.to_json(plan).alias("payload"))


class HttpChatClient:
    """A chat endpoint that speaks the common completions protocol; one blocking call each."""

    def __init__(self, runtime):
        self.runtime = runtime

    def complete(self, system: str, user: str) -> str:
        """The text of one reply."""
        return extract_content(self._post([{"role": "system", "content": system}, {"role": "user", "content": user}] if system else [{"role": "user", "content": user}], {}))

    def complete_json(self, system: str, user: str, schema: dict) -> str:
        """As complete, with a reply that the endpoint holds to the schema."""
        shape = {"response_format": {"type": "json_schema", "json_schema": {"name": "result", "schema": schema, "strict": True}}}
        return extract_content(self._post([{"role": "system", "content": system}, {"role": "user", "content": user}], shape))

    def limited(self, max_output_tokens: int) -> HttpChatClient:
        """A client with another bound on replies; this one keeps its own."""
        return HttpChatClient(dataclasses.replace(self.runtime, max_output_tokens=max_output_tokens))

    def _post(self, messages: list[dict], more: dict) -> dict:
        import os
        import urllib.request

        body = {"model": self.runtime.model, "stream": False, "temperature": self.runtime.temperature, "max_tokens": self.runtime.max_output_tokens, "messages": messages, **more}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get('SHEAF_LLM_KEY', '')}"}
        request = urllib.request.Request(f"{self.runtime.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.runtime.timeout_seconds) as reply:
            return json.loads(reply.read())


def extract_content(reply: dict) -> str:
    """The text of the first choice; an empty or odd reply is an error."""
    try:
        content = reply["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError) as error:
        raise ValueError("the reply has no content") from error
    if not isinstance(content, str) or not content.strip():
        raise ValueError("the reply is empty")
    return content.strip()
