"""Semantic analytics: clusters with exemplars, novelty against a baseline, semantic diff, drift, and agreement measures."""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semevra.functions.codebook import distances, kmeans, plus_plus
from semevra.functions.hashing import Random, content_id
from semevra.functions.vectors import nearest, novelty
from semevra.model import BASELINE_CLUSTERS, BASELINE_QUANTILE, CLUSTER_EPOCHS, CLUSTER_RESTARTS, FIRE_BASE, FIRE_MULTIPLE, LOW_CONFIDENCE, MAX_SEMANTIC_K, STATE_BUDGET, EngineError

STRIDE = 0x9E3779B9


@dataclass
class Clusters:
    """summary: (cluster_id, count, avg_cost, error_rate, exemplar). assigned: (event_id, cluster_id, dist)."""

    summary: DataFrame
    assigned: DataFrame
    centroids: np.ndarray
    quality: float
    confidence: str


def content_seed(ids: list[str], k: int, space: str) -> int:
    """The seed depends on the rows, k and the space, and on nothing else."""
    data = b"".join(i.encode() + b"\0" for i in ids) + struct.pack("<Q", k) + space.encode()
    return struct.unpack("<Q", content_id(data).encode()[:8])[0]


def assign(df: DataFrame, centroids: np.ndarray, id_col: str = "event_id", vector_col: str = "vector", keep: list[str] | None = None) -> DataFrame:
    """(event_id, cluster, dist, *keep) by the nearest centroid, the lowest number on ties; Arrow batches, centroids broadcast (at most 256)."""
    held = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float32))
    keep = keep or []

    def run(batches):
        c = held.value
        for b in batches:
            x = np.array(b.column(vector_col).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, c.shape[1])
            for at in range(0, max(len(x), 1), 4096):
                part = x[at : at + 4096]
                d = ((part[:, None] - c[None].astype(np.float64)) ** 2).sum(2) if len(c) <= 32 else distances(part, c)
                near = d.argmin(1)
                rows = b.slice(at, 4096)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(n) for n in (id_col, *keep)], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(part)), near])],
                    [id_col, *keep, "cluster", "dist"]
                )

    types = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (id_col, *keep))
    return df.select(id_col, *keep, vector_col).mapInArrow(run, f"{types}, cluster int, dist double")


def summarise(assigned: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(cluster_id, count, avg_cost, error_rate, exemplar, cluster) from (id, cluster, dist, cost, error).

    The exemplar is the real row nearest to the centroid, the least id on ties. Clusters are numbered by size, then exemplar.
    """
    g = assigned.groupBy("cluster").agg(
        F.count("*").alias("count"),
        (F.sum(F.col("cost").cast("decimal(28,9)")) / F.count("*")).cast("double").alias("avg_cost"),
        F.avg(F.col("error").cast("double")).alias("error_rate"),
        F.min_by(id_col, F.struct("dist", id_col)).alias("exemplar"),
    )
    return g.withColumn("cluster_id", (F.row_number().over(Window.orderBy(F.desc("count"), "exemplar")) - 1).cast("int"))


#: Rows of the sample from which the driver's k-means starts.
DRIVER_ROWS = 200_000
_FIXED = 1 << 24


def lloyd(df: DataFrame, centroids: np.ndarray, epochs: int, vector_col: str = "vector") -> tuple[np.ndarray, float, int]:
    """(centroids, inertia, rows) after full passes over all rows.

    Tasks add coordinates as integers of 2^-24, so sums do not depend on partitioning; a second level adds the k rows of each task
    by cluster, and k rows reach the driver.
    """
    k, dim = centroids.shape
    inertia, rows = 0.0, 0
    for _ in range(epochs):
        held = df.sparkSession.sparkContext.broadcast(centroids)

        def run(batches, held=held):
            c = held.value
            sums, counts, cost = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
            for b in batches:
                x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    d = distances(part, c)
                    near = d.argmin(1)
                    np.add.at(sums, near, np.rint(part * _FIXED).astype(np.int64))
                    np.add.at(cost, near, np.rint(d[np.arange(len(part)), near] * _FIXED).astype(np.int64))
                    counts += np.bincount(near, minlength=k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, dtype=np.int32)), pa.array([s.tobytes() for s in sums], pa.binary()), pa.array(counts), pa.array(cost)],
                ["c", "s", "n", "d"]
            )

        def add(batches):
            total: dict[int, list] = {}
            for b in batches:
                for c, s, n, d in zip(*(b.column(i).to_pylist() for i in range(4))):
                    t = total.setdefault(c, [np.zeros(dim, np.int64), 0, 0])
                    t[0] += np.frombuffer(s, np.int64)
                    t[1] += n
                    t[2] += d
            if total:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(total), pa.int32()), pa.array([t[0].tobytes() for t in total.values()], pa.binary()),
                        pa.array([t[1] for t in total.values()]), pa.array([t[2] for t in total.values()])
                    ],
                    ["c", "s", "n", "d"]
                )

        schema = "c int, s binary, n long, d long"
        got = df.select(vector_col).mapInArrow(run, schema).repartition("c").mapInArrow(add, schema).collect()
        sums, counts, total = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for r in got:
            sums[r.c] += np.frombuffer(r.s, np.int64)
            counts[r.c] += r.n
            total += r.d
        inertia, rows = total / _FIXED, int(counts.sum())
        new = centroids.copy()
        ok = counts > 0
        new[ok] = (sums[ok] / _FIXED / counts[ok, None]).astype(np.float32)
        if (new == centroids).all():
            break
        centroids = new
    return centroids, inertia, rows


def semantic_cluster(df: DataFrame, k: int, space: str = "", driver_rows: int = DRIVER_ROWS, state_budget: int = STATE_BUDGET) -> Clusters:
    """Semantic GROUP BY of (event_id, vector, cost, error).

    One procedure at every size: restarts of k-means, seeded by content, on a sample (the ``driver_rows`` of least SHA-256
    ticket, or as many as the state budget holds, in event_id order), then passes over all rows from the best of them until
    nothing moves. Nothing depends on partitioning. Assignment and summaries cover all rows and run on the cluster.
    """
    if not 1 <= k <= MAX_SEMANTIC_K:
        raise EngineError(f"k must lie between 1 and {MAX_SEMANTIC_K}")
    n = df.count()
    if not n:
        none = df.select("event_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("dist"), "cost", "error").limit(0)
        s = summarise(none)
        return Clusters(
            s.select("cluster_id", "count", "avg_cost", "error_rate", "exemplar"), none.select("event_id", F.lit(0).alias("cluster_id"), "dist"),
            np.zeros((0, 0)), 0.0, "low"
        )
    dim = df.select(F.size("vector")).first()[0]
    held = min(driver_rows, max(0, state_budget - 4 * k * dim) // (4 * dim))
    if held < min(n, 10 * k):
        raise EngineError("clustering state is over its budget; narrow the filter")
    got = df.select("event_id", "vector").orderBy(F.sha2("event_id", 256), "event_id").limit(held).toArrow()
    order = np.argsort(np.array(got.column("event_id").to_pylist(), object), kind="stable")
    x = np.array(got.column("vector").combine_chunks().flatten(), np.float32).reshape(len(order), -1)[order]
    ids = [got.column("event_id")[int(i)].as_py() for i in order]
    k = min(k, len(x))
    seed = content_seed(ids, k, space)
    best: tuple[np.ndarray, float] | None = None
    for r in range(CLUSTER_RESTARTS):
        c = plus_plus(x, k, Random(seed + r * STRIDE))
        for _ in range(CLUSTER_EPOCHS):
            d = distances(x, c)
            near = d.argmin(1)
            counts = np.bincount(near, minlength=k)
            sums = np.zeros((k, x.shape[1]))
            np.add.at(sums, near, x.astype(np.float64))
            new = c.copy()
            served = d[np.arange(len(x)), near].copy()
            for j in range(k):
                if counts[j]:
                    new[j] = sums[j] / counts[j]
                else:
                    w = int(served.argmax())
                    new[j], served[w] = x[w], 0
            if (new == c).all():
                break
            c = new
        inertia = float(distances(x, c).min(1).sum())
        if best is None or inertia < best[1]:
            best = (c, inertia)
    centroids, inertia, _ = lloyd(df, best[0], CLUSTER_EPOCHS)
    mean, total, rows = lloyd(df, np.zeros((1, dim), np.float32), 1)
    one = total - rows * float((mean.astype(np.float64) ** 2).sum())
    quality = float(np.clip(1 - inertia / one, 0, 1)) if one > 0 else 0.0
    assigned = assign(df, centroids, keep=["cost", "error"])
    numbered = summarise(assigned)
    summary = numbered.select("cluster_id", "count", "avg_cost", "error_rate", "exemplar")
    members = assigned.join(F.broadcast(numbered.select("cluster", "cluster_id")), "cluster").select("event_id", "cluster_id", "dist")
    return Clusters(summary, members, centroids, quality, "low" if quality < LOW_CONFIDENCE else "ok")


@dataclass
class Baseline:
    """Centroids of what is known, and the novelty that only one in a hundred of the rows exceeded. A degraded one has neither, but
    the reason why."""

    tenant: str
    generation: str
    centroids: list[list[float]]
    threshold: float
    rows: int
    state: str = "ok"
    reason: str = ""

    @property
    def id(self) -> str:
        return content_id(repr(sorted(asdict(self).items())).encode())


def with_novelty(df: DataFrame, centroids: list, vector_col: str = "vector", digits: int | None = None) -> DataFrame:
    """``df`` with novelty: 1 less the largest dot product with a centroid (at most 16), by Arrow batches."""
    v = novelty(F.col(vector_col), centroids)
    return df.withColumn("novelty", v if digits is None else F.round(v, digits))


def order_statistic(df: DataFrame, column: str, rank: int) -> float:
    """The value of that rank (0: the least) of a column of doubles without nulls, at any size: counts by halves of the range of
    the values' bits close in on it, 2^12 ranges a pass, so no task or driver ever holds the rows."""
    # Bits of a double in an order that is that of the values.
    @F.arrow_udf("long")
    def ordered(x: pa.Array) -> pa.Array:
        raw = x.to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
        return pa.array(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw))

    keys = df.select(ordered(F.col(column)).alias("b"))
    prefix, shift = None, 64
    while shift:
        below = max(0, shift - 12)
        found = keys if prefix is None else keys.filter(F.shiftright("b", shift) == prefix)
        for p, n in sorted(tuple(r) for r in found.groupBy(F.shiftright("b", below).alias("p")).count().collect()):  # 2^12 rows at most
            if rank < n:
                prefix = p
                break
            rank -= n
        shift = below
    bits = np.int64(prefix)
    raw = bits ^ np.int64(0x7FFFFFFFFFFFFFFF) if bits < 0 else bits
    return float(np.array([raw], np.int64).view(np.float64)[0])


#: Passes of the baseline's k-means, over the sample and over all rows.
BASELINE_EPOCHS = 25


def build_baseline(df: DataFrame, tenant: str, generation: str, seed: int = 42, sample: int = 50_000) -> Baseline:
    """k-means of up to 16 clusters over all rows; the threshold is an exact order statistic over all rows.

    A bounded sample (``sample`` rows of least SHA-256 ticket) seeds the centroids; full passes over all rows refine them, at
    every size.
    """
    got = df.select("event_id", "vector").orderBy(F.sha2("event_id", 256), "event_id").limit(sample).toArrow()
    if not got.num_rows:
        raise EngineError("a baseline needs rows")
    order = np.argsort(np.array(got.column("event_id").to_pylist(), object), kind="stable")
    x = np.array(got.column("vector").combine_chunks().flatten(), np.float32).reshape(len(order), -1)[order]
    c, _ = kmeans(x, BASELINE_CLUSTERS, BASELINE_EPOCHS, seed, 8)
    c, _, _ = lloyd(df, c, BASELINE_EPOCHS)
    scores = with_novelty(df, c.tolist()).select("novelty")
    n = scores.count()
    rank = int(round((n - 1) * BASELINE_QUANTILE))
    threshold = order_statistic(scores, "novelty", rank)
    return Baseline(tenant, generation, c.tolist(), float(threshold), n)


def novelty_against(df: DataFrame, baseline: Baseline) -> DataFrame:
    """(event_id, novelty, is_novel); strictly above the threshold is novel."""
    out = with_novelty(df, baseline.centroids)
    return out.select("event_id", "novelty", (F.col("novelty") > baseline.threshold).alias("is_novel"))


def drift(df: DataFrame, baselines: dict[str, Baseline]) -> DataFrame:
    """(generation, status, rows, novel, fraction, mean_novelty, max_novelty, fires) of (generation, vector) rows.

    Generations whose baseline is degraded, or that have none, are reported as such with the rows that nobody watches.
    """
    sound = {g: b for g, b in baselines.items() if b.state == "ok"}
    out: DataFrame | None = None
    for g, b in sorted(sound.items()):
        part = with_novelty(df.filter(F.col("generation") == g), b.centroids).select(
            "generation", "novelty", F.lit("ok").alias("status"), (F.col("novelty") > b.threshold).cast("int").alias("n")
        )
        out = part if out is None else out.unionByName(part)
    rest = df.filter(~F.col("generation").isin(list(sound))) if sound else df
    degraded = [g for g, b in baselines.items() if b.state != "ok"]
    status = F.when(F.col("generation").isin(degraded), "degraded").otherwise("no baseline") if degraded else F.lit("no baseline")
    rest = rest.select("generation", F.lit(None).cast("double").alias("novelty"), status.alias("status"), F.lit(None).cast("int").alias("n"))
    out = rest if out is None else out.unionByName(rest)
    g = out.groupBy("generation", "status").agg(
        F.count("*").alias("rows"), F.sum("n").alias("novel"), F.avg("novelty").alias("mean_novelty"), F.max("novelty").alias("max_novelty")
    )
    g = g.withColumn("fraction", F.col("novel") / F.col("rows"))
    return g.withColumn("fires", F.col("fraction") > FIRE_MULTIPLE * FIRE_BASE)


def untaken(a: DataFrame, b: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Summary of the clusters of ``b``, by the nearest of the centroids, to which no row of ``a`` is nearest; cluster is the centroid's number."""
    numbered = summarise(assign(b, centroids, keep=["cost", "error"]))
    taken = assign(a, centroids).select("cluster").distinct()
    return numbered.join(F.broadcast(taken), "cluster", "left_anti").select("cluster_id", "count", "avg_cost", "error_rate", "exemplar", "cluster")


def semantic_diff(a: DataFrame, b: DataFrame, k: int, space: str = "") -> DataFrame:
    """Summary of the clusters of window b to which no row of window a is nearest."""
    found = semantic_cluster(b, k, space)
    return untaken(a, b, found.centroids).drop("cluster") if len(found.centroids) else found.summary


def nearest_given(df: DataFrame, centroids: list[tuple[int, list[float]]], vector_col: str = "vector") -> DataFrame:
    """``df`` with cluster and dist by given centroids, by Arrow batches."""
    return df.withColumn("_n", nearest(F.col(vector_col), centroids)).select("*", F.col("_n.cluster").alias("cluster"), F.col("_n.dist").alias("dist")).drop("_n")


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> float:
    """Agreement of two labellings, from their contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = t.agg(pairs("n")).first()[0] or 0.0
    ra = t.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n")).first()[0] or 0.0
    rb = t.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n")).first()[0] or 0.0
    n = t.agg(F.sum("n")).first()[0] or 0
    expected = ra * rb / (n * (n - 1) / 2) if n > 1 else 0.0
    top = (ra + rb) / 2 - expected
    return float((both - expected) / top) if top else 1.0
