"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of 3-word shingles. Equal sets collapse first, each onto the least id that has it, with which its texts are
compared. 160 minimum hashes make 40 bands of 4; documents with an equal band are candidates, which a pair at the threshold of
0.5 is with a probability of 0.92, and one at 0.6 of 0.996. A pair's signatures are compared 32 places at a time: after each batch it is dropped if
the posterior probability of a similarity at the threshold or above, under a uniform prior, is below ``miss`` (so ``miss`` bounds
what pruning loses, beside what the bands do not propose). Survivors
are verified exactly on their texts, and the verified pairs' connected components are the groups. Where all pairs of a bucket are
formed, its rows meet in one task with their signatures and, up to SMALL shingles, their sets: texts that share a common line and
little else meet pair by pair there, but no pair of them leaves it that is not near by these.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.llm.grouping import blocks, group, only, shared, tiles, whole_parts
from semevra.session import bounded_batches, broadcast_if_small, discard, materialise

SHINGLE = 3
BANDS, ROWS = 40, 4
THRESHOLD = 0.5
MISS = 0.005
BATCH = 32
#: Shingles of a text up to which its set goes with its signature where all pairs of a bucket are formed; larger ones are verified on texts.
SMALL = 256

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(T.U64) * T.U64(2) + T.U64(1)
_C = _RNG.integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(T.U64)


def shingles(w: T.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their texts; a text of fewer than n words has one shingle of all its words."""
    at, doc = T.valid_grams(w, n)
    s = T.grams(w.hash, n)[at] if len(at) else np.zeros(0, T.U64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        extra = T.range_hash(w.hash, w.first[short], w.first[short + 1], 5)
        s, doc = np.concatenate([s, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    return s, doc


def signatures(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have words, their minimum hashes (uint32, one row each), and a hash of each shingle set."""
    s, doc = shingles(w)
    has = np.flatnonzero(w.counts > 0)
    sig = np.empty((len(has), len(_A)), np.uint32)
    mark = np.empty(len(has), T.U64)
    if not len(has):
        return has, sig, mark
    cut = np.searchsorted(doc, has)
    with np.errstate(over="ignore"):
        for at in range(0, len(has), 64):  # stays in cache
            lo, hi = cut[at], cut[at + 64] if at + 64 < len(cut) else len(s)
            x, c = s[lo:hi], cut[at : at + 64] - lo
            for j in range(len(_A)):
                sig[at : at + 64, j] = np.minimum.reduceat(((x * _A[j] + _C[j]) >> T.U64(32)).astype(np.uint32), c)
        order = np.lexsort((s, doc))
        x, d = s[order], doc[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
        x = np.where(new, T.mix(x ^ T.U64(0x5851F42D4C957F2D)), T.U64(0))
        mark[:] = np.add.reduceat(x, np.searchsorted(d, has))
    return has, sig, mark


def least_matches(threshold: float, miss: float, total: int = BANDS * ROWS, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest equal places of n at which P(similarity >= threshold | matches) is at least ``miss``.

    Signatures keep 8 bits a place, so unequal places agree with probability 1/256; a place then matches with
    probability (1 + 255 s) / 256 at similarity s.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    p = (1 + 255 * grid) / 256
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            ll = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
            d = np.exp(ll - ll.max())
            if d[grid >= threshold].sum() >= miss * d.sum():
                out.append(m)
                break
    return out


def jaccard(a: T.Words, b: T.Words) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of each pair of texts; 0 if neither has words."""
    n = len(a.first) - 1
    out = np.zeros(n)
    (sa, da), (sb, db) = shingles(a), shingles(b)
    ca, cb = np.searchsorted(da, np.arange(n + 1)), np.searchsorted(db, np.arange(n + 1))
    at = 0
    while at < n:  # sorts stay in cache
        to = at + 1
        while to < n and ca[to + 1] - ca[at] + cb[to + 1] - cb[at] < 1 << 14:
            to += 1
        x, y = slice(ca[at], ca[to]), slice(cb[at], cb[to])
        s, pair = np.concatenate([sa[x], sb[y]]), np.concatenate([da[x], db[y]])
        side = np.repeat(np.array([1, 2], np.int8), [ca[to] - ca[at], cb[to] - cb[at]])
        order = np.lexsort((s, pair))
        s, pair, side = s[order], pair[order], side[order]
        new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (pair[1:] != pair[:-1])]) if len(s) else np.zeros(0, np.int64)
        both = np.bitwise_or.reduceat(side, new) == 3 if len(new) else np.zeros(0, bool)
        union = np.bincount(pair[new] - at, minlength=to - at)
        out[at:to] = np.bincount(pair[new][both] - at, minlength=to - at) / np.maximum(union, 1)
        at = to
    return out


def small_sets(w: T.Words) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts that have words, the size of their shingle sets, and the sets of up to SMALL shingles as bytes, empty for larger ones."""
    s, doc = shingles(w)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    size = np.bincount(doc, minlength=len(w.counts))
    has = np.flatnonzero(size)
    at = np.r_[0, np.cumsum(np.where(size[has] <= SMALL, 8 * size[has], 0))].astype(np.int32)
    kept = np.ascontiguousarray(s[size[doc] <= SMALL])
    return has, size[has], pa.BinaryArray.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept.tobytes())])


def intersections(sets: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, pair by pair."""
    size = np.array([len(x) // 8 for x in sets], np.int64)
    first = np.r_[0, np.cumsum(size)]
    values, rank = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    out, cost = np.zeros(len(i), np.int64), np.r_[0, np.cumsum(size[i] + size[j])]
    at = 0
    while at < len(i):  # sorts stay in cache
        to = max(at + 1, int(np.searchsorted(cost, cost[at] + (1 << 16), "right")) - 1)
        row, pair = np.r_[i[at:to], j[at:to]], np.tile(np.arange(to - at), 2)
        n = size[row]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[row], n)
        key = np.sort(np.repeat(pair, n) * len(values) + rank[place])
        out[at:to] = np.bincount(key[1:][key[1:] == key[:-1]] // max(len(values), 1), minlength=to - at)
        at = to
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", mark_bits: int = 64) -> DataFrame:
    """(doc_id, kept_doc_id) for every document of a group but the one that stays, its least id.

    Rows of one id are one document: it is in the group of any of its texts. Texts without words (null and empty ones
    included) and rows without an id are in no group. Similarity exactly at the threshold counts. Very long texts are taken
    whole. Repeated rows count once. ``mark_bits`` is the width of the hash by which equal sets meet; no result depends on it. Columns other than the two are not looked at. An empty table gives an empty result.
    """
    bounded_batches(docs)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                has, sig, mark = signatures(T.words(s.column("t")))
                ids = s.column("id").take(pa.array(has))
                flat = np.ascontiguousarray(sig)
                band = np.empty((len(has), BANDS), T.U64)
                with np.errstate(over="ignore"):
                    for j in range(BANDS):
                        h = np.full(len(has), j + 1, T.U64)
                        for r in range(ROWS):
                            h = T.mix(h * T.U64(0x9E3779B97F4A7C15) + flat[:, j * ROWS + r])
                        band[:, j] = h
                low = np.ascontiguousarray(flat.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, T.int64(mark >> T.U64(64 - mark_bits)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(low.shape[1]), len(has), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary()),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * BANDS), len(has), [None, pa.py_buffer(band.tobytes())]).cast(pa.binary())
                    ],
                    ["id", "mark", "sig", "bands"],
                )

    signed = d.mapInArrow(sign, "id long, mark long, sig binary, bands binary")
    # One row for each distinct set: the least id and its signature; the rest follow it.
    signed = materialise(signed)
    sets = materialise(signed.groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    same = signed.select("id", "mark").join(
        sets.filter("n > 1").select("mark", F.col("id").alias("b")), "mark"
    ).select(F.col("id").alias("a"), "b", "mark").filter("a <> b").distinct()
    same = materialise(same)

    def texts_of(pairs: DataFrame) -> DataFrame:
        texts = only(d, pairs)
        return pairs.join(
            texts.select(F.col("id").alias("a"), F.col("t").alias("x")), "a"
        ).join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")), "b").select("a", "b", "x", "y")

    def at_least(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in T.slices(b, "x"):
                    ok = pa.array(jaccard(T.words(s.column("x")), T.words(s.column("y"))) >= least - 1e-12)
                    yield pa.RecordBatch.from_arrays([s.column("a").filter(ok), s.column("b").filter(ok)], ["a", "b"])

        return exact

    # A mark is only a hash: sets that merely share it go their own way.
    equal = materialise(texts_of(same.select("a", "b").distinct()).mapInArrow(at_least(1.0), "a long, b long").distinct())
    reps = signed.join(sets.select("mark", "id"), ["mark", "id"], "left_semi").dropDuplicates(["mark"])
    alone = same.join(equal, ["a", "b"], "left_anti")
    if not alone.isEmpty():
        reps = reps.unionByName(signed.join(alone.select(F.col("a").alias("id"), "mark"), ["mark", "id"], "left_semi").dropDuplicates(["mark", "id"]))
    reps = materialise(reps.select("id", "sig", "bands"))
    discard(signed)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(np.repeat(b.column("id").to_numpy(), BANDS))], ["bucket", "id"])

    buckets = materialise(shared(reps.select("id", "bands").mapInArrow(explode, "bucket long, id long")))
    least = least_matches(threshold, miss)
    sigs = reps.select("id", "sig")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column("y").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            live, m = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, need in enumerate(least):
                m[live] += (x[live, k * BATCH : (k + 1) * BATCH] == y[live, k * BATCH : (k + 1) * BATCH]).sum(1)
                live = live[m[live] >= need]
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(live)), b.column("b").take(pa.array(live)), pa.array(m[live].astype(np.int32))], ["a", "b", "est"])

    def sieve(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
        return p.select("a", "b", "x", "y").mapInArrow(prune, "a long, b long, est int").groupBy("a", "b").agg(F.max("est").alias("est"))

    def verify(pairs: DataFrame) -> DataFrame:
        return texts_of(materialise(pairs)).mapInArrow(at_least(threshold), "a long, b long").distinct()

    def refine(rows: DataFrame, depth: int) -> DataFrame:
        """Buckets (bucket, id) split by 24 pairs of other places of the signature; a pair at a similarity of 0.5 shares one but for 0.1 %."""
        places = np.random.Generator(np.random.PCG64(depth)).permutation(BANDS * ROWS)[:48].reshape(24, 2)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(T.U64)
                    with np.errstate(over="ignore"):
                        key = (x[:, places[:, 0]] << T.U64(8)) | x[:, places[:, 1]] | (np.arange(24, dtype=T.U64) << T.U64(16))
                        key = T.mix(key + b.column("bucket").to_numpy().view(T.U64)[:, None] * T.U64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([T.int64(key.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), 24))], ["bucket", "id"])

        return rows.join(sigs, "id").select("bucket", "id", "sig").mapInArrow(again, "bucket long, id long")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                has, size, raw = small_sets(T.words(s.column("t")))
                yield pa.RecordBatch.from_arrays([s.column("id").take(pa.array(has)), pa.array(size.astype(np.int64)), raw], ["id", "size", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part, both in whole_parts(batches):
            ids, label, size = (rows.column(c).to_numpy() for c in ("id", "label", "size"))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            sig = [np.ascontiguousarray(sig[:, k : k + BATCH]) for k in range(0, sig.shape[1], BATCH)]
            sets = rows.column("shingles").to_pylist()
            known = np.array([len(x) > 0 for x in sets], bool)
            for i, j in tiles(part, both, rows.column("side").to_numpy()):
                live = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= (threshold - 1e-12) * np.maximum(size[i], size[j]))
                i, j = i[live], j[live]
                m = np.zeros(len(i), np.int64)
                for x, need in zip(sig, least):
                    m += np.bitwise_count((x[i] == x[j]).view(np.uint64)).sum(1, dtype=np.int64)
                    live = m >= need
                    i, j, m = i[live], j[live], m[live]
                exact = np.flatnonzero(known[i] & known[j])
                if len(exact):
                    used, at = np.unique(np.r_[i[exact], j[exact]], return_inverse=True)
                    n = intersections([sets[k] for k in used], at[: len(exact)], at[len(exact) :])
                    live = np.ones(len(i), bool)
                    live[exact] = n / (size[i[exact]] + size[j[exact]] - n) >= threshold - 1e-12
                    i, j, m = i[live], j[live], m[live]
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m.astype(np.int32))], ["a", "b", "est"])

    def inside(rows: DataFrame) -> DataFrame:
        ids = broadcast_if_small(materialise(rows.select("id").distinct()))
        facts = sigs.join(ids, "id", "left_semi").join(d.join(ids, "id", "left_semi").mapInArrow(sized, "id long, size long, shingles binary"), "id")
        r = blocks(rows.join(materialise(facts), "id").select("bucket", "id", "label", "sig", "size", "shingles"))
        p = r.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "side").mapInArrow(compare, "a long, b long, est int")
        return p.groupBy("a", "b").agg(F.max("est").alias("est"))

    labels = group(buckets, sieve, verify, equal, refine, inside)
    return labels.filter("id <> label").select(F.col("id").alias("doc_id"), F.col("label").alias("kept_doc_id"))


def expected_recall(s: float) -> float:
    """Chance that a pair of similarity s shares a band."""
    return 1 - math.pow(1 - math.pow(s, ROWS), BANDS)
