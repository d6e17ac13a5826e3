"""Semantic search over a DataFrame of events with vectors: exact, threshold and IVF-PQ, keyset pages, rank fusion."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semevra.functions.codebook import Codebook, distances, kmeans, probes
from semevra.functions.vectors import dot
from semevra.model import RRF_CONSTANT, EngineError
from semevra.operators.analytics import order_statistic
from semevra.session import materialise


def total_order() -> list[Column]:
    """score descending, then event_id ascending."""
    return [F.desc("score"), F.asc("event_id")]


def scored(df: DataFrame, q: Sequence[float], vector_col: str = "vector", digits: int | None = None) -> DataFrame:
    """``df`` with the exact cosine ``score`` of its unit vectors; generated code, no Python."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(vector_col), q)))
    return df.withColumn("score", s if digits is None else F.round(s, digits))


#: Rows that a heap of a task, or the driver, holds at most; beyond it a cut is found by counting and rows stay where they are.
HELD_ROWS = 10_000


def _nth_id(ids: DataFrame, n: int) -> str:
    """The n-th (from 1) of the column event_id, at any size: ranges of ids are counted, and only the one that holds it is sorted."""
    ranges = materialise(ids.repartitionByRange("event_id").withColumn("_p", F.spark_partition_id()))
    for p, rows in sorted(tuple(r) for r in ranges.groupBy("_p").count().collect()):
        if n <= rows:
            return ranges.filter(F.col("_p") == p).orderBy("event_id").limit(n).agg(F.max("event_id")).first()[0]
        n -= rows
    raise ValueError("there are fewer ids")


def best(df: DataFrame, n: int, column: str = "score", descending: bool = True, at_most: int | None = None) -> DataFrame:
    """The ``n`` rows of largest (else least) ``column``, ties by event_id, in that order; ``at_most`` bounds the rows, if known.

    Up to HELD_ROWS come by a heap a task. A larger ``n`` is met by a cut, an order statistic, so that no task and no driver
    holds ``n`` rows; rows that share both the score and the id of the last are all kept then.
    """
    order = [F.desc(column) if descending else F.asc(column), F.asc("event_id")]
    if n <= HELD_ROWS:
        return df.orderBy(*order).limit(n)
    if (at_most is not None and at_most <= n) or df.count() <= n:
        return df.orderBy(*order)
    key = F.col(column).cast("double")
    key = -key if descending else key
    keys = df.select(key.alias("_v"), "event_id")
    edge = order_statistic(keys, "_v", n - 1)
    last = _nth_id(keys.filter(F.col("_v") == edge).select("event_id"), n - keys.filter(F.col("_v") < edge).count())
    return df.filter((key < edge) | ((key == edge) & (F.col("event_id") <= last))).orderBy(*order)


def exact_topk(
    df: DataFrame, q: Sequence[float], k: int, threshold: float | None = None, vector_col: str = "vector", digits: int | None = None, at_most: int | None = None
) -> DataFrame:
    """Brute force: one scan, one bounded heap a task (TakeOrderedAndProject), no shuffle of rows."""
    out = scored(df, q, vector_col, digits)
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    return best(out, k, at_most=at_most)


def adc(code: Column, table: np.ndarray) -> Column:
    """Sum over subspaces of the query's distance to each row's codeword, in single precision, subspace by subspace."""
    table = table.astype(np.float32)

    @F.arrow_udf("float")
    def run(codes: pa.Array) -> pa.Array:
        c = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
        d = np.zeros(len(c), np.float32)
        for j in range(len(table)):
            d += table[j][c[:, j]]
        return pa.array(d)

    return run(code)


KEY = ["event_id", "tenant_id", "generation", "event_time"]
#: Ids that a scan is given as literals; more of them come by a broadcast join alone.
LITERALS = 1000


def coded(df: DataFrame, q: np.ndarray, book: Codebook, lists: Sequence[int]) -> DataFrame:
    """``df``, of the probed lists alone, with ``dist``, the distance by code."""
    return df.filter(F.col("centroid").isin([int(x) for x in lists])).withColumn("dist", adc(F.col("code"), book.table(q)))


def by_code(df: DataFrame, q: np.ndarray, book: Codebook, lists: Sequence[int], n: int) -> list:
    """The ``n`` rows (KEY, centroid, dist) of the probed lists to fetch, by code distance: the scan reads keys and codes only."""
    return best(coded(df, q, book, lists).select(*KEY, "centroid", "dist"), n, "dist", False).collect()


def fetched(df: DataFrame, rows: list) -> DataFrame:
    """The whole rows of ``df`` that ``rows`` (of ``by_code``) name. Their lists, times and, if few, ids are filters of the scan,
    so row groups and pages without any are not read."""
    spark = df.sparkSession
    df = df.filter(F.col("centroid").isin(sorted({r.centroid for r in rows})))
    if rows:
        times = [r.event_time for r in rows]
        df = df.filter(F.col("event_time").between(min(times), max(times)))
    if len(rows) <= LITERALS:
        df = df.filter(F.col("event_id").isin(sorted({r.event_id for r in rows})))
    keys = spark.createDataFrame(sorted({tuple(r[k] for k in KEY) for r in rows}), "event_id string, tenant_id string, generation string, event_time long")
    return df.join(F.broadcast(keys), KEY, "left_semi")  # at most HELD_ROWS keys


def approximate_topk(df: DataFrame, q: np.ndarray, book: Codebook, lists: Sequence[int], k: int, n: int, source: Callable[[list], DataFrame] | None = None) -> DataFrame:
    """IVF-PQ: rows of the probed lists by code distance, the best ``n`` exactly reranked. ``source`` gives the rows that hold the
    candidates it is called with; by default that is ``df``. Beyond HELD_ROWS the candidates stay in the cluster."""
    v = [float(x) for x in q]
    if n > HELD_ROWS:
        return exact_topk(best(coded(df, q, book, lists), n, "dist", False).drop("dist"), v, k)
    rows = by_code(df, q, book, lists, n)
    return exact_topk(fetched(df if source is None else source(rows), rows), v, k)


#: Share of the true neighbours that must lie in the probed lists, and that must be found, over CALIBRATION_QUERIES rows as
#: queries, before all queries run; above the 0.9 that is promised, as the share over all queries may be lower.
CEILING, FOUND, CALIBRATION_QUERIES = 0.97, 0.95, 200
#: Rows and queries of one block of a list, about.
LIST_ROWS, LIST_QUERIES = 4096, 8192
#: Lists at least, and rows of one list, about, when all rows are queries.
LEAST_LISTS, ROWS_OF_LIST = 32, 2048
RANKED = "query_id string, event_id string, score double"


def lists_for(rows: int) -> int:
    """Lists in which so many rows lie with about ROWS_OF_LIST each, so that n queries look at some n rows, not n^2."""
    return max(LEAST_LISTS, -(-rows // ROWS_OF_LIST))


def _pair_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of q (n x dim) with x (n x c x dim), summed element by element in order, as ``scored`` does."""
    out = np.zeros(x.shape[:2])
    for j in range(q.shape[1]):
        out += q[:, j, None].astype(np.float64) * x[:, :, j].astype(np.float64)
    return np.clip(out, -1.0, 1.0)


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*total_order())
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), -1)


def exact_topk_of(df: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], k: int) -> DataFrame:
    """(query_id, event_id, score, centroid) by brute force for a bounded number of queries: one scan, k rows a query and batch."""
    held = df.sparkSession.sparkContext.broadcast(([n for n, _ in queries], np.array([v for _, v in queries], np.float32)))

    def run(batches):
        names, q = held.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, cent, x = np.array(part.column("event_id").to_pylist(), object), part.column("centroid").to_numpy(), _matrix(part.column("vector"))
                for i, v in enumerate(q):
                    s = _pair_scores(v[None], x[None])[0]
                    t = np.lexsort((ids, -s))[:k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i]] * len(t)), pa.array(ids[t].tolist(), pa.string()), pa.array(s[t]), pa.array(cent[t])],
                        ["query_id", "event_id", "score", "centroid"]
                    )

    return _best(df.select("event_id", "vector", "centroid").mapInArrow(run, RANKED + ", centroid int"), k)


def approximate_topk_all(df: DataFrame, queries: DataFrame, book: Codebook, k: int, nprobe: int, cap: int, margin: float, candidates: int) -> DataFrame:
    """(query_id, event_id, score): IVF-PQ for every row (query_id, vector) of ``queries`` over ``df`` (event_id, vector, centroid, code).

    A query goes to the lists that it probes. In each list the ``candidates`` nearest by code distance are exactly scored and
    the k best go on, so a query reranks at least its ``candidates`` best codes. Lists are cut into blocks of bounded size.
    """
    nlist = len(book.coarse)
    row_blocks = max(1, -(-df.count() // (nlist * LIST_ROWS)))
    query_blocks = max(1, -(-queries.count() * nprobe // (nlist * LIST_QUERIES)))
    held = df.sparkSession.sparkContext.broadcast(book)

    def visit(batches):
        for b in batches:
            x = _matrix(b.column("vector"))
            if not len(x):
                continue
            d = distances(x, held.value.coarse)
            order = np.argsort(d, axis=1, kind="stable")
            near = np.take_along_axis(d, order, 1)
            n = [probes(r, nprobe, True, margin, cap) for r in near]
            at = pa.array(np.repeat(np.arange(len(x)), n))
            lists = np.concatenate([o[:m] for o, m in zip(order, n)]).astype(np.int32)
            for i in range(0, len(lists), 8192):
                t = at.slice(i, 8192)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(t), b.column("vector").take(t), pa.array(lists[i : i + 8192])], ["query_id", "vector", "centroid"])

    def block(c: str, n: int):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    visits = queries.select("query_id", "vector").mapInArrow(visit, "query_id string, vector array<float>, centroid int")
    visits = visits.withColumn("qb", block("query_id", query_blocks)).withColumn("rb", every(row_blocks))
    rows = df.select("event_id", "vector", "centroid", "code").withColumn("rb", block("event_id", row_blocks)).withColumn("qb", every(query_blocks))

    def search_list(left: pa.Table, right: pa.Table) -> pa.Table:
        names, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            book = held.value
            right = right.sort_by("event_id")
            q, x = _matrix(left.column("vector")), _matrix(right.column("vector"))
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            w, c = book.dim // book.m, min(candidates, len(x))
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                d = np.zeros((len(part), len(x)), np.float32)
                for j in range(book.m):
                    d += distances(part[:, j * w : (j + 1) * w], book.pq[j]).astype(np.float32)[:, code[:, j]]
                near = np.argpartition(d, c - 1, axis=1)[:, :c] if c < len(x) else np.broadcast_to(np.arange(len(x)), d.shape)
                near = np.sort(near, axis=1)
                s = _pair_scores(part, x[near])
                t = np.argsort(-s, axis=1, kind="stable")[:, :k]  # rows lie in the order of ids, so ties go by id
                names.append(np.repeat(np.arange(at, at + len(part)), t.shape[1]))
                found.append(np.take_along_axis(near, t, 1).ravel())
                scores.append(np.take_along_axis(s, t, 1).ravel())
        if not names:
            return pa.table({"query_id": pa.array([], pa.string()), "event_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        return pa.table(
            {
                "query_id": left.column("query_id").take(pa.array(np.concatenate(names))).combine_chunks(),
                "event_id": right.column("event_id").take(pa.array(np.concatenate(found))).combine_chunks(), "score": np.concatenate(scores)
            }
        )

    key = ["centroid", "rb", "qb"]
    return _best(visits.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(search_list, RANKED), k)


def calibrate(df: DataFrame, book: Codebook, k: int, nprobe: int, cap: int, margin: float, candidates: int) -> tuple[int, int, int]:
    """(nprobe, cap, candidates), grown until CALIBRATION_QUERIES rows of ``df`` as queries find FOUND of their exact neighbours."""
    sample = df.select(F.col("event_id").alias("query_id"), "vector").orderBy(F.sha2("query_id", 256), "query_id").limit(CALIBRATION_QUERIES)
    queries = [(r.query_id, r.vector) for r in sample.collect()]
    truth = exact_topk_of(df, queries, k).collect()
    if not truth:
        return nprobe, cap, candidates
    ranks = {n: book.rank(np.array(v, np.float32)) for n, v in queries}
    nlist = len(book.coarse)

    def reached() -> float:
        lists = {n: set(o[: probes(d, nprobe, True, margin, cap)].tolist()) for n, (o, d) in ranks.items()}
        return sum(r.centroid in lists[r.query_id] for r in truth) / len(truth)

    while reached() < CEILING and nprobe < nlist:
        nprobe, cap = min(nlist, nprobe + 1), min(nlist, cap + 1)
    want = {(r.query_id, r.event_id) for r in truth}
    asked = df.sparkSession.createDataFrame([(n, [float(x) for x in v]) for n, v in queries], "query_id string, vector array<float>")
    total = df.count()
    while candidates < total:
        got = {(r.query_id, r.event_id) for r in approximate_topk_all(df, asked, book, k, nprobe, cap, margin, candidates).collect()}
        if len(want & got) >= FOUND * len(want):
            break
        candidates *= 2
    return nprobe, cap, candidates


def group_survivors(rows: DataFrame, group_k: int, seed: int, survivors: int) -> list[dict]:
    """k-means of the reranked rows (bounded by ``survivors``) with a real row as each group's exemplar."""
    got = rows.limit(survivors).collect()
    if not got:
        return []
    x = np.array([r.vector for r in got], np.float32)
    centroids, _ = kmeans(x, min(group_k, len(got)), 25, seed, 8)
    d = ((x[:, None].astype(float) - centroids[None].astype(float)) ** 2).sum(2)
    near = d.argmin(1)
    out = []
    for c in np.unique(near):
        at = np.flatnonzero(near == c)
        out.append(
            {
                "cluster_id": int(c), "count": len(at), "avg_cost": float(np.mean([got[i].cost for i in at])),
                "error_rate": float(np.mean([bool(got[i].error) for i in at])), "exemplar": got[at[d[at, c].argmin()]].event_id,
                "member_ids": sorted(got[i].event_id for i in at)
            }
        )
    return sorted(out, key=lambda g: (-g["count"], g["cluster_id"]))


def reciprocal_rank_fusion(ranked: list[DataFrame], k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """(event_id, score): sum of 1 / (constant + rank) over the lists; each list is short and already limited."""
    out: DataFrame | None = None
    w = Window.orderBy(*total_order())
    for df in ranked:
        r = df.select("event_id", "score").withColumn("r", F.row_number().over(w)).select("event_id", (F.lit(1.0) / (F.lit(float(constant)) + F.col("r"))).alias("s"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("event_id").agg(F.sum("s").alias("score")).orderBy(*total_order()).limit(k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true ids that were found."""
    hits = found.select("event_id").distinct().withColumn("_hit", F.lit(1))
    n, hit = truth.select("event_id").join(hits, "event_id", "left").agg(F.count("*"), F.count("_hit")).first()
    return hit / n if n else 1.0


# Cursors ---------------------------------------------------------------------------------------------------------------


def make_cursor(snapshot: int, fingerprint: str, score: float, event_id: str) -> str:
    body = json.dumps({"snapshot": snapshot, "plan": fingerprint, "score": score, "id": event_id}).encode()
    return f"{zlib.crc32(body):08x}{body.hex()}"


def read_cursor(token: str, fingerprint: str) -> dict:
    """The cursor, or an EngineError that names what is wrong with it."""
    try:
        body = bytes.fromhex(token[8:])
        check = int(token[:8], 16)
    except ValueError:
        raise EngineError("cursor is malformed") from None
    if zlib.crc32(body) != check:
        raise EngineError("cursor fails its checksum")
    try:
        c = json.loads(body)
        c["snapshot"], c["plan"], c["score"], c["id"]
    except (ValueError, KeyError, TypeError):
        raise EngineError("cursor is malformed") from None
    if c["plan"] != fingerprint:
        raise EngineError("cursor belongs to another plan")
    return c


def after(df: DataFrame, score: float, event_id: str) -> DataFrame:
    """Rows behind the key in the total order."""
    return df.filter((F.col("score") < score) | ((F.col("score") == score) & (F.col("event_id") > event_id)))
