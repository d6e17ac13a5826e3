"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Texts of a bounded, hash-ordered sample of labelled rows (``max_labelled``) become sets of hashed features where they lie; one
executor task streams the sets, of at most 2^bits features each, through the learner. The L1 penalty leaves a short list of
weights, which alone reach the driver and are broadcast: its size is bounded by 2^bits and does not follow the data. The bias
is shifted to where a held-out fifth of the sample is parted best, so 0.5 is the cut point, not a calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.session import bounded_batches

BITS = 20
MAX_LABELLED = 24_000
EPOCHS = 5


def features(w: T.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-grams, 2-grams and 1-skip 2-grams: their indices, and the text of each."""
    shift = T.U64(64 - bits)
    doc = w.doc
    idx, own = [(w.hash >> shift).astype(np.int32)], [doc]
    at, d = T.valid_grams(w, 2)
    if len(at):
        idx.append((T.grams(w.hash, 2, 1)[at] >> shift).astype(np.int32))
        own.append(d)
    at, d = T.valid_grams(w, 3)
    if len(at):
        with np.errstate(over="ignore"):
            skip = T.mix(w.hash[at] * T.U64(0xD6E8FEB86659FD93) + w.hash[at + 2] * T.U64(3))
        idx.append((skip >> shift).astype(np.int32))
        own.append(d)
    return np.concatenate(idx), np.concatenate(own)


def ftrl(
    rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, epochs: int = EPOCHS
) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes; every coordinate has its own rate, alpha / (beta + sqrt(sum of g^2))."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    for _ in range(epochs):
        for x, t in zip(rows, y):
            zi, ni = z[x], n[x]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - t
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[x] = zi + g - s * w
            n[x] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -zb / ((beta + nb**0.5) / alpha + l2)


def cut_point(rows: list[np.ndarray], y: np.ndarray, bits: int) -> float:
    """Log-odds at which a fit on four fifths of the rows parts the last fifth with the best F1; 0 without both classes there."""
    held = np.arange(len(y)) % 5 == 4
    if y[held].sum() == 0 or y[~held].sum() == 0:
        return 0.0
    w, b = ftrl([r for r, h in zip(rows, held) if not h], y[~held], bits)
    s = np.array([w[r].sum() + b for r, h in zip(rows, held) if h])
    order = np.argsort(-s, kind="stable")
    s, t = s[order], y[held][order]
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    best = int(np.flatnonzero(f1 == f1.max())[-1])
    return float(np.clip((s[best] + (s[best + 1] if best + 1 < len(s) else s[best])) / 2, -4, 4))


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic"
) -> tuple[np.ndarray, float]:
    """Dense weights and bias. Rows without id, text or label are not used; an id labelled twice counts as toxic if any
    of its labels says so, and with several texts each is an example. With no usable row all weights are 0 and the bias
    says clean."""
    bounded_batches(docs)
    lab = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    lab = lab.orderBy(F.xxhash64("k"), "k").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).dropna().join(F.broadcast(lab), "k").select(F.xxhash64("k", "t").alias("o"), "y", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                idx, own = features(T.words(s.column("t")), bits)
                key = np.unique((own.astype(np.int64) << bits) | idx)
                cut = np.searchsorted(key >> bits, np.arange(s.num_rows + 1))
                low = (key & ((1 << bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.column("o"), s.column("y"), pa.array([low[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary())], ["o", "y", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs: list[np.ndarray] = []
        ys: list[int] = []
        for b in batches:
            xs += [np.frombuffer(x, np.int32) for x in b.column("x").to_pylist()]
            ys += b.column("y").to_pylist()
        if xs:
            y = np.array(ys, float)
            b0 = -cut_point(xs, y, bits)
            w, b = ftrl(xs, y, bits)
            b0 += b
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[b0, w[at]])], ["i", "w"])

    rows = rows.mapInArrow(sets, "o long, y int, x binary")
    got = rows.repartition(1).sortWithinPartitions("o", "y", "x").mapInArrow(train, "i int, w double").toArrow()
    weights, bias = np.zeros(1 << bits, np.float32), -5.0
    i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    weights[i[i >= 0]] = w[i >= 0]
    if (i < 0).any():
        bias = float(w[i < 0][0])
    return weights, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity, toxic) for every row that has an id.

    toxicity is the model's value, from 0 to 1, over the distinct features of the whole text, very long ones included; toxic is
    ``toxicity >= 0.5``. Null and empty texts score by the bias alone. Repeated rows give repeated, equal results; rows without an id give none; other
    columns are not looked at. An empty table gives an empty result.
    """
    bounded_batches(docs)
    bits = int(len(weights)).bit_length() - 1
    at = np.flatnonzero(weights).astype(np.int32)
    held = docs.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.float32)
        table[held.value[0]] = held.value[1]
        for b in batches:
            for s in T.slices(b, "t"):
                idx, own = features(T.words(s.column("t")), bits)
                live = np.flatnonzero(table[idx])
                key = np.unique((own[live].astype(np.int64) << bits) | idx[live])
                total = np.bincount(key >> bits, table[key & ((1 << bits) - 1)], s.num_rows) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([s.column("k"), pa.array(np.round(p, 6)), pa.array(p >= 0.5)], ["k", "toxicity", "toxic"])

    d = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).filter("k is not null")
    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, toxicity double, toxic boolean").withColumnRenamed("k", id_col)
