"""Hashed character n-grams of many tokens at once, and a cache of what tokens score."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from sheaf.llm.common import CACHE_ENTRIES, claim


def ngrams(tokens: list[bytes], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, numbers of their tokens): byte n-grams of each token between marks, and the token itself."""
    joined = np.frombuffer(b"".join(b"\x01" + t + b"\x02" for t in tokens), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(tokens)), np.fromiter((len(t) + 2 for t in tokens), np.int64, len(tokens)))
    shift = np.uint64(64 - bits)
    odd = np.uint64(0x9E3779B97F4A7C15)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    buckets, owners = [whole >> shift], [np.arange(len(tokens))]
    for n in sizes:
        m = len(joined) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(1099511628211) + joined[k : k + m]
        code ^= code >> np.uint64(31)
        inside = owner[:m] == owner[n - 1 :]
        buckets.append(((code * odd) >> shift)[inside])
        owners.append(owner[:m][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), 1) for t in tokens), np.uint64, len(tokens))


def bigrams(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of word bigrams, given the hashes of their first and second words; a repeated word is a back-reference."""
    left = np.where(left == right, np.uint64(0), left)
    right = np.where(left == 0, np.uint64(0), right)
    code = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    code ^= code >> np.uint64(31)
    return ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


class TokenTable(dict):
    """token -> row of a growing matrix; rows of new tokens are computed together by ``score``.

    ``score`` takes a list of tokens and returns a float32 matrix with ``width`` columns.
    ``hashes`` holds the tokens' hashes by the same numbers.
    """

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int):
        self.score, self.width = score, width
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows, self.count = np.zeros((1 << 14, self.width), np.float32), 0
        self.hashes = np.zeros(1 << 14, np.uint64)
        self.pending: list[str] = []
        self.long: list[str] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = self.count + len(self.pending)
        self.pending.append(token)
        if len(token) > 48:
            self.long.append(token)
        return number

    def lookup(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the tokens, and numbers that are equal for equal tokens.

        The cache is emptied first if it has grown past its bound.
        """
        claim(self)
        if self.count > CACHE_ENTRIES:
            self.reset()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        for i in range(0, len(self.pending), 50_000):
            part = self.pending[i : i + 50_000]
            need = self.count + len(part)
            while need > len(self.rows):
                self.rows, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.hashes))
            self.rows[self.count : need] = self.score(part)
            self.hashes[self.count : need] = token_hashes(part)
            self.count = need
        self.pending = []
        for token in self.long:
            self.pop(token, None)
        self.long = []
        return self.rows[at], at
