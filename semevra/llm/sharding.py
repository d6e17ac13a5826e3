"""Sharding by Karmarkar-Karp differencing: indivisible groups of documents into shards of nearly equal bytes.

A partial partition is k sums with the groups in each. The method repeatedly takes the two with the largest spread
(largest less smallest sum) and adds them in opposite order, large onto small. Partial partitions stay closed under that
step, so it runs as a tree: hash blocks of groups are differenced in parallel, each to one partial partition, and those
k sums a block are differenced again, until one is left. What a task holds is bounded by the block size.

Adding two partial partitions in opposite order never makes a spread larger than the larger of the two, so with blocks as
without, the fullest shard exceeds the emptiest by no more than the bytes of the largest group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.session import broadcast_if_small, materialise

SHARDS = 16
BLOCK = 20_000


def difference(parts: list[tuple[list[int], list[list[int]]]]) -> tuple[list[int], list[list[int]]]:
    """One partial partition (sums, members by place) from several. Ties go to the one with the least member."""
    heap = []
    for sums, members in parts:
        order = sorted(range(len(sums)), key=lambda i: (-sums[i], members[i][0] if members[i] else -1))
        s = [sums[i] for i in order]
        heap.append((-(s[0] - s[-1]), min((m for g in members for m in g), default=-1), s, [members[i] for i in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a0, sa, ma = heapq.heappop(heap)
        _, b0, sb, mb = heapq.heappop(heap)
        k = len(sa)
        sums = [sa[i] + sb[k - 1 - i] for i in range(k)]
        members = []
        for i in range(k):
            x, y = ma[i], mb[k - 1 - i]
            if len(x) < len(y):
                x, y = y, x
            x += y
            members.append(x)
        order = sorted(range(k), key=lambda i: -sums[i])
        sums, members = [sums[i] for i in order], [members[i] for i in order]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), min(a0, b0), sums, members))
    return heap[0][2], heap[0][3]


def assign_groups(sizes: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(g, shard, bytes) from (g string, bytes long), one row a group; shard 0 is the fullest."""
    n = sizes.count()
    block = max(block, 4 * shards)
    level = max(1, -(-n // block))
    # place: a unit is a group at first, and then one of the k piles of a block's partial partition
    current = materialise(sizes.select(F.col("g").alias("unit"), F.lit(None).cast("string").alias("part"), "bytes").withColumn("b", F.pmod(F.xxhash64("unit"), F.lit(level))))
    links: list[DataFrame] = []
    depth = 0
    while True:

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["bytes", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
            parts = []
            if pdf["part"].isna().all():
                for i, size in enumerate(pdf["bytes"]):
                    parts.append(([int(size)] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]))
            else:
                for _, rows in pdf.groupby("part", sort=True):
                    s = [int(x) for x in rows["bytes"]] + [0] * (shards - len(rows))
                    parts.append((s, [[int(i)] for i in rows.index] + [[] for _ in range(shards - len(rows))]))
            _, piles = difference(parts)
            where = np.zeros(len(pdf), np.int32)
            for p, pile in enumerate(piles):
                where[pile] = p
            return pd.DataFrame({"unit": pdf["unit"], "b": pdf["b"], "pile": where, "bytes": pdf["bytes"]})

        done = materialise(current.groupBy("b").applyInPandas(solve, "unit string, b long, pile int, bytes long"))
        if level == 1:
            last = done.select("unit", F.col("pile").alias("shard"))
            break
        name = F.concat_ws(":", F.lit(str(depth)), F.col("b"), F.col("pile"))
        links.append(done.select("unit", name.alias("up")))
        piles = done.groupBy("b", "pile").agg(F.sum("bytes").alias("bytes"))
        level = max(1, -(-level * shards // block))
        nxt = F.pmod(F.xxhash64("b"), F.lit(level))
        current = materialise(piles.select(name.alias("unit"), F.col("b").cast("string").alias("part"), "bytes", nxt.alias("b")))
        depth += 1
    for link in reversed(links):
        last = link.join(last.withColumnRenamed("unit", "up"), "up").select("unit", "shard")
    return sizes.join(last.withColumnRenamed("unit", "g"), "g").select("g", "shard", "bytes")


def shard(docs: DataFrame, shards: int = SHARDS, keys: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, group_bytes) for every row; rows equal in all ``keys`` go to one shard.

    Bytes are those of the whole UTF-8 text, however long; null and empty texts have none. A null key is a value of its own. Rows
    without an id keep a null one; repeated rows count each. Groups of equal size are taken in the order of their keys, so
    ties have one result. With fewer groups than shards some shards stay empty. An empty table gives an empty result.
    """
    g = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]), {"ignoreNullFields": "false"})
    d = docs.select(F.col(id_col).alias("doc_id"), g.alias("g"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"))
    sizes = materialise(d.groupBy("g").agg(F.sum("bytes").alias("bytes")))
    if sizes.isEmpty():
        return d.select("doc_id", F.lit(0).cast("int").alias("shard"), F.col("bytes").alias("group_bytes"))
    where = materialise(assign_groups(sizes, shards))
    return d.drop("bytes").join(broadcast_if_small(where), "g").select("doc_id", "shard", F.col("bytes").alias("group_bytes"))
