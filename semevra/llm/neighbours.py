"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

The signs of ``bits`` random projections make a vector's bucket in each table. ``bits`` is SPARE more than the logarithm of the
number of vectors, so that few unrelated vectors meet (2^-SPARE of their number in each table), and the number of tables follows ``bits``, so that a pair at
the threshold is missed with a probability of at most ``miss`` at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.llm.grouping import group, only, shared
from semevra.session import bounded_batches, discard, materialise

THRESHOLD = 0.95
MISS = 0.02
SPARE = 4


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = int(min(48, max(8, math.ceil(math.log2(max(n, 2))) + SPARE)))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-min(agree, 1 - 1e-12))))


def packed(rows: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of ``size`` numbers each out of one run of single floats."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size * 4, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows, np.float32))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all values in one run, first number and size of each value) of ``packed`` vectors."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4) // 4
    return np.frombuffer(data, np.float32, int(offsets[-1])) if data is not None else np.zeros(0, np.float32), offsets[:-1], np.diff(offsets)


def units(ids: pa.Array, vectors: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Ids and unit vectors, packed, of the rows that have a direction: no null element, finite, and not zero."""
    size = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null elements become NaN
    norm = np.full(len(size), np.nan)
    full = np.flatnonzero(size)
    if len(full):
        with np.errstate(over="ignore", invalid="ignore"):
            norm[full] = np.sqrt(np.add.reduceat(x * x, (np.cumsum(size) - size)[full]))
    ok = np.isfinite(norm) & (norm >= 1e-12)
    each = np.repeat(ok, size)
    return ids.filter(pa.array(ok)), packed(x[each] / np.repeat(norm[ok], size[ok]), size[ok])


def signs(ids: np.ndarray, column: pa.Array, bits: int, tables: int, planes: dict[int, np.ndarray], salt: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of vectors, one bucket hash for each of them and table), block by block; vectors of different sizes never share one."""
    x, first, size = unpacked(column)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        if dim not in planes:
            planes[dim] = np.random.Generator(np.random.PCG64([int(dim), salt] if salt else int(dim))).standard_normal((dim, bits * tables), dtype=np.float32)
        for k in range(0, len(at), 1024):
            part = at[k : k + 1024]
            on = (x[first[part][:, None] + np.arange(dim)] @ planes[dim] > 0).reshape(len(part), tables, bits)
            raw = np.zeros((len(part), tables, 8), np.uint8)
            raw[:, :, : -(-bits // 8)] = np.packbits(on, axis=2, bitorder="little")
            key = raw.view(T.U64)[:, :, 0]
            with np.errstate(over="ignore"):
                yield part, T.mix(key * T.U64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=T.U64) * T.U64(0xC2B2AE3D27D4EB4F) + T.U64(int(dim)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, kept_vec_id) for every vector of a group but the one that stays, its least id.

    Vectors are compared by cosine; a cosine equal to the threshold counts. Null, empty, zero or non-finite vectors (or with
    a null element) and rows without an id are in no group; vectors of different lengths are never alike; very long ones are
    taken whole. Rows of one id are one item: it is in the group of any of its vectors. Columns other than the two are not
    looked at. An empty table gives an empty result.
    """
    bounded_batches(vectors)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id is not null and size(v) > 0")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*units(b.column("id"), b.column("v"))], ["id", "v"])

    every = materialise(v.mapInArrow(unit, "id long, v binary").withColumn("mark", F.xxhash64("v")))
    sets = materialise(every.groupBy("mark", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    same = every.join(sets.filter("n > 1").select("mark", "v", F.col("id").alias("b")), ["mark", "v"]).select(F.col("id").alias("a"), "b").filter("a <> b").distinct()
    same = materialise(same)
    discard(every)
    reps = sets.select("id", "v")
    bits, tables = plan(reps.count(), threshold, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column("id").to_numpy()
            for part, key in signs(ids, b.column("v"), bits, tables, planes):
                yield pa.RecordBatch.from_arrays([T.int64(key.ravel()), pa.array(np.repeat(ids[part], tables))], ["bucket", "id"])

    buckets = materialise(shared(reps.mapInArrow(sign, "bucket long, id long")))

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, fx, nx), (y, fy, ny) = unpacked(b.column("x")), unpacked(b.column("y"))
            out = np.full(b.num_rows, -2.0)
            for dim in np.unique(nx[nx == ny]):
                at = np.flatnonzero((nx == dim) & (ny == dim))
                for k in range(0, len(at), 1024):
                    part, place = at[k : k + 1024], np.arange(dim)
                    out[part] = (x[fx[part][:, None] + place].astype(np.float64) * y[fy[part][:, None] + place]).sum(1)
            good = out >= threshold - 1e-7
            ok = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array((out[good] * 1e6).astype(np.int32))], ["a", "b", "est"])

    def sieve(pairs: DataFrame) -> DataFrame:
        """Here the estimate is the exact cosine already."""
        pairs = materialise(pairs)
        some = only(reps, pairs)
        p = pairs.join(some.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(some.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
        return p.select("a", "b", "x", "y").mapInArrow(cosine, "a long, b long, est int").groupBy("a", "b").agg(F.max("est").alias("est"))

    def refine(rows: DataFrame, depth: int) -> DataFrame:
        """Buckets (bucket, id) split by tables of further hyperplanes; a pair at the threshold shares one but for ``miss``."""
        more, several = plan(1 << 16, threshold, miss)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[int, np.ndarray] = {}
            for b in batches:
                ids, old = b.column("id").to_numpy(), b.column("bucket").to_numpy().view(T.U64)
                for part, key in signs(ids, b.column("v"), more, several, planes, depth):
                    with np.errstate(over="ignore"):
                        key = T.mix(key + old[part][:, None] * T.U64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([T.int64(key.ravel()), pa.array(np.repeat(ids[part], several))], ["bucket", "id"])

        return rows.join(reps, "id").select("bucket", "id", "v").mapInArrow(again, "bucket long, id long")

    labels = group(buckets, sieve, None, same, refine)
    return labels.filter("id <> label").select(F.col("id").alias("vec_id"), F.col("label").alias("kept_vec_id"))
