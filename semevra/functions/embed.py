"""The default embedder: signed feature hashing of words and word pairs, normalised to unit length."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semevra.functions.hashing import fnv1a64
from semevra.model import EngineError
from semevra.session import bounded_batches

MAX_INPUT = 32 << 10
SIGN_SEED = 0x9E3779B9
#: What str.isalnum calls letters and digits.
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return [w.lower() for w in _TOKEN.findall(text)]


class _Codes(dict):
    """Twice the coordinate of each feature, and one more where its sign is negative; a bounded memory of those seen."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, feature: str) -> int:
        raw = feature.encode()
        code = 2 * (fnv1a64(raw) % self.dim) + (fnv1a64(raw, SIGN_SEED) & 1)
        if len(self) < 200_000:
            self[feature] = code
        return code


class _Numbers(dict):
    """Words by number, in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


_PRIME = np.uint64(0x100000001B3)
#: Characters of the texts, about, that are embedded at once.
GROUP_CHARS = 1 << 20


def _continued(states: np.ndarray, words: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a states (2 x n) after the bytes of the numbered word of each column, position by position over all columns."""
    n = lengths[words]
    order = np.argsort(-n, kind="stable")
    h, at, left = states[:, order], starts[words[order]], np.sort(n)
    for p in range(int(n.max(initial=0))):
        m = len(n) - int(np.searchsorted(left, p, "right"))  # words longer than p, which stand first
        h[:, :m] = (h[:, :m] ^ data[at[:m] + p]) * _PRIME
    out = np.empty_like(h)
    out[:, order] = h
    return out


class HashEmbedder:
    """``embed`` raises EngineError for a text without tokens, or of zero norm. Subclasses may embed by other means.

    As the model is defined, it reads the first 32 KiB of a text (MAX_INPUT): what lies behind has no part in the vector.
    """

    model_id = "hash-embedder"

    def __init__(self, dim: int = 64, version: str = "1") -> None:
        self.dim, self.version = dim, version
        self._codes = _Codes(dim)

    @property
    def space(self) -> str:
        return f"{self.model_id}:{self.version}"

    @staticmethod
    def _read(text: str) -> str:
        if 4 * len(text) <= MAX_INPUT:
            return text
        raw = text.encode()
        return raw[:MAX_INPUT].decode(errors="ignore") if len(raw) > MAX_INPUT else text

    def embed_many(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """``embed`` of each text, None where it refuses: the same vectors, as sums of halves are exact in any order."""
        if type(self).embed is not HashEmbedder.embed:
            return [self._one(t) for t in texts]
        out: list[np.ndarray | None] = []
        group, size = [], 0
        for t in texts:
            group.append("" if t is None else self._read(t))
            size += len(group[-1])
            if size >= GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _one(self, text: str | None) -> np.ndarray | None:
        try:
            return None if text is None else self.embed(text)
        except EngineError:
            return None

    def _group(self, texts: list[str]) -> list[np.ndarray | None]:
        numbers = _Numbers()
        found = [list(map(numbers.__getitem__, _TOKEN.findall(t))) for t in texts]
        words = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        if not len(words):
            return [None] * len(texts)
        raw = [w.lower().encode() for w in numbers]
        lengths = np.array([len(r) for r in raw], np.int64)
        starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        basis = np.array([[0xCBF29CE484222325], [0xCBF29CE484222325 ^ SIGN_SEED]], np.uint64)
        single = _continued(np.repeat(basis, len(raw), 1), np.arange(len(raw)), data, starts, lengths)
        text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        first = np.flatnonzero(text[:-1] == text[1:])  # a pair lies in one text
        pairs = _continued((single[:, words[first]] ^ np.uint64(ord("_"))) * _PRIME, words[first + 1], data, starts, lengths)
        v = np.zeros(len(texts) * self.dim)
        for states, at, unit in ((single[:, words], text, 1.0), (pairs, text[first], 0.5)):
            weight = np.where(states[1] & np.uint64(1), -unit, unit)
            v += np.bincount(at * self.dim + (states[0] % np.uint64(self.dim)).astype(np.int64), weight, len(v))
        v = v.reshape(len(texts), self.dim)
        norm = np.sqrt((v**2).sum(1))
        return [(x / n).astype(np.float32) if n >= 1e-12 else None for x, n in zip(v, norm)]

    def embed(self, text: str) -> np.ndarray:
        words = tokens(self._read(text))
        if not words:
            raise EngineError("text has no tokens; its embedding would have no direction")
        n = len(words)
        words += map("_".join, zip(words[:-1], words[1:]))
        code = np.fromiter(map(self._codes.__getitem__, words), np.int64, len(words))
        weight = np.where(code & 1, -1.0, 1.0)
        weight[n:] *= 0.5
        v = np.bincount(code >> 1, weight, self.dim)
        norm = float(np.sqrt(np.sum(v**2)))
        if not np.isfinite(norm) or norm < 1e-12:
            raise EngineError("embedding has no norm")
        return (v / norm).astype(np.float32)


def embed_column(embedder: HashEmbedder, text: Column) -> Column:
    """array<float> of each text by Arrow batches; null where the embedder refuses."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(embedder.embed_many(texts.to_pylist()), pa.list_(pa.float32()))

    return run(text)


def with_vectors(df: DataFrame, embedder: HashEmbedder, text_col: str = "body", vector_col: str = "vector") -> DataFrame:
    bounded_batches(df)
    return df.withColumn(vector_col, embed_column(embedder, F.col(text_col)))


def lookup_vectors(df: DataFrame, vectors: DataFrame, text_col: str = "body", vector_col: str = "vector") -> DataFrame:
    """``df`` with the frozen vector of each body, from a table (body, vector); null where there is none. Bodies join by
    their SHA-256, so long texts are not shuffled twice; the first of several vectors of a body counts."""
    v = vectors.select(F.sha2(text_col, 256).alias("_k"), F.col(vector_col).alias("_v")).groupBy("_k").agg(F.min("_v").alias(vector_col))
    return df.withColumn("_k", F.sha2(text_col, 256)).join(v, "_k", "left").drop("_k")
