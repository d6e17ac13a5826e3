"""Best-fit packing by a grouping genetic algorithm (Falkenauer), as islands with elite migration.

Documents, as lengths in words, fill bins of ``capacity``. Hash blocks of documents are packed apart; each block is
evolved on several islands. A crossover injects the best-filled bins of one parent into the other and removes the bins that
then hold a document twice; displaced documents first replace lesser ones in bins that they fill better, and the rest goes by
best fit. After each epoch every island gets the elite of its left neighbour. The block's best packing counts; its last, badly
filled bins go back and are packed with those of other blocks. Evolution ends when no packing can have fewer bins, by Martello
and Toth's lower bound.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.session import bounded_batches, materialise

CAPACITY = 4096
BLOCK = 2048
ISLANDS = 4
EPOCHS = 3
GENERATIONS = 8
POPULATION = 8
GOOD_FILL = 0.98


def lower_bound(size: list[int], capacity: int) -> int:
    """Bins that any packing needs: Martello and Toth's L2, which is at least the sum over the capacity."""
    s = np.sort(np.array(size, np.int64))[::-1]
    if not len(s):
        return 0
    total = np.r_[0, np.cumsum(s)]
    upto = lambda x: np.searchsorted(-s, -x, "left")  # noqa: E731  items greater than x
    a = np.unique(np.r_[0, s[s <= capacity // 2]])
    big, half, small = upto(capacity - a), int(upto(np.array([capacity // 2]))[0]), np.searchsorted(-s, -a, "right")
    small = np.maximum(small, half)
    free = (half - big) * capacity - (total[half] - total[big])
    rest = np.maximum(0, -((free - (total[small] - total[half])) // capacity))
    return int((half + rest).max())


def best_fit(items: list[int], size: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put ``items``, largest first, each into the bin with the least room that holds it, or into a new one."""
    open_ = sorted((r, i) for i, r in enumerate(room) if r > 0)
    for x in sorted(items, key=lambda i: (-size[i], i)):
        s = size[x]
        at = bisect_left(open_, (s, -1))
        if at < len(open_):
            r, b = open_.pop(at)
            bins[b].append(x)
            r -= s
        else:
            b, r = len(bins), capacity - s
            bins.append([x])
            room.append(0)
        room[b] = r
        if r > 0:
            insort(open_, (r, b))


def fitness(room: list[int], capacity: int) -> float:
    """Mean squared fill of the bins: Falkenauer's cost, which favours full bins beside empty ones."""
    fill = 1 - np.array(room) / capacity
    return float((fill * fill).mean()) if len(room) else 1.0


def improve(bins: list[list[int]], room: list[int], loose: list[int], size: list[int]) -> list[int]:
    """Let items of ``loose`` take the places of lesser ones, one for one or two for one, where a bin is fuller then; what is loose afterwards."""
    pool = sorted((size[x], x) for x in loose)
    for b, g in enumerate(bins):
        if not pool:
            break
        k = 0
        while room[b] and k < len(g):
            x = g[k]
            low, high = size[x], size[x] + room[b]
            at = bisect_left(pool, (high + 1, -1)) - 1
            best, pair = (pool[at][0], (at,)) if at >= 0 and pool[at][0] > low else (low, ())
            i, j = 0, at  # two of the loose, as full as can be
            while best < high and i < j:
                both = pool[i][0] + pool[j][0]
                if both > high:
                    j -= 1
                    continue
                if both > best:
                    best, pair = both, (i, j)
                i += 1
            if pair:
                new = [pool[p][1] for p in pair]
                for p in reversed(pair):
                    del pool[p]
                insort(pool, (low, x))
                g[k : k + 1] = new
                room[b] = high - best
            k += 1
    return [x for _, x in pool]


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """A child: ``b`` with whole well-filled bins of ``a`` injected; also drops a few of the worst bins (mutation)."""
    fill = np.array([sum(size[x] for x in g) for g in a]) / capacity
    take = np.flatnonzero(rng.random(len(a)) < np.where(fill >= np.quantile(fill, 0.5), 0.3, 0.0))
    bins = [list(a[i]) for i in take]
    used = {x for g in bins for x in g}
    left = np.array([capacity - sum(size[x] for x in g) for g in b])
    drop = (rng.random(len(b)) < 0.02) | ((left > 0) & (rng.random(len(b)) < 0.3 * left / max(1, left.max())))
    loose: list[int] = []
    for g, gone in zip(b, drop):
        clash = not used.isdisjoint(g)
        if clash or gone:
            loose += [x for x in g if x not in used]
        else:
            bins.append(list(g))
    room = [capacity - sum(size[x] for x in g) for g in bins]
    best_fit(improve(bins, room, loose, size), size, bins, room, capacity)
    return bins, room


def evolve(
    size: list[int], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION, guests: list[list[list[int]]] | None = None
) -> tuple[list[list[int]], list[int]]:
    """The best packing (bins, room) after some generations; ``guests`` are packings that join the first population."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rank = lambda p: (len(p[0]), -fitness(p[1], capacity))
    least = lower_bound(size, capacity)
    pool = []
    for g in guests or []:
        pool.append((g, [capacity - sum(size[x] for x in b) for b in g]))
    while len(pool) < population:
        bins: list[list[int]] = []
        room: list[int] = []
        if not pool:
            best_fit(list(range(len(size))), size, bins, room, capacity)
        else:
            # random first fit of a part, best fit of the rest
            head = [int(x) for x in rng.permutation(len(size))[: len(size) // 3]]
            for x in head:
                if bins and room[-1] >= size[x]:
                    bins[-1].append(x)
                    room[-1] -= size[x]
                else:
                    bins.append([x])
                    room.append(capacity - size[x])
            held = set(head)
            best_fit([x for x in range(len(size)) if x not in held], size, bins, room, capacity)
        pool.append((bins, room))
        if len(pool[-1][0]) <= least:
            return pool[-1]
    pool.sort(key=rank)
    for _ in range(generations):
        if len(pool[0][0]) <= least:
            break
        kids = []
        for i in range(population // 2):
            j = int(rng.integers(0, len(pool)))
            a, b = pool[i], pool[j if j != i else (i + 1) % len(pool)]
            kids.append(crossover(a[0], b[0], size, capacity, rng))
            kids.append(crossover(b[0], a[0], size, capacity, rng))
        pool = sorted(pool + kids, key=rank)[:population]
    return pool[0]


def _pack_blocks(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(block, item, n, bin, fill): each block's best packing. items: (block, item, n), item unique in its block."""

    def epoch(first: bool, number: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["item"], kind="stable").reset_index(drop=True)
            block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
            size = [int(x) for x in pdf["n"]]
            guests = []
            if not first:
                for c in ("own", "guest"):
                    g: dict[int, list[int]] = {}
                    for i, b in enumerate(pdf[c]):
                        g.setdefault(int(b), []).append(i)
                    guests.append(list(g.values()))
            bins, room = evolve(size, capacity, block * 1009 + island * 31 + number, guests=guests)
            where = np.empty(len(size), np.int32)
            fill = np.empty(len(size), np.int32)
            for i, (g, r) in enumerate(zip(bins, room)):
                where[g], fill[g] = i, capacity - r
            return pd.DataFrame(
                {
                    "block": pdf["block"], "island": pdf["island"], "item": pdf["item"], "n": pdf["n"], "own": where, "fill": fill, "bins": len(bins),
                    "fit": fitness(room, capacity)
                }
            )

        return run

    schema = "block long, island int, item long, n int, own int, fill int, bins int, fit double"
    rows = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = materialise(rows.groupBy("block", "island").applyInPandas(epoch(True, 0), schema))
    for number in range(1, epochs):
        guest = state.select("block", "item", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("own").alias("guest"))
        rows = state.select("block", "island", "item", "n", "own").join(guest, ["block", "island", "item"])
        state = materialise(rows.groupBy("block", "island").applyInPandas(epoch(False, number), schema))
    best = state.groupBy("block").agg(F.min(F.struct("bins", -F.col("fit"), "island")).alias("m")).select("block", F.col("m.island").alias("island"))
    return state.join(best, ["block", "island"]).select("block", "item", "n", F.col("own").alias("bin"), "fill")


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): words of each row's whole text; rows without an id are left out."""
    bounded_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                yield pa.RecordBatch.from_arrays([s.column("id"), pa.array(T.words(s.column("t"), hashes=False).counts.astype(np.int64))], ["id", "n"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null")
    return d.mapInArrow(count, "id long, n long")


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, n_words, bin, bin_words): every document, whole, in bins of ``capacity`` words.

    A document longer than a bin is cut into pieces 0, 1, ...; all but the last fill a bin of their own each. Rows of one
    id are one document of their summed words. Null and empty texts have 0 words; they are placed, in bin 'empty'. Rows
    without an id are left out; other columns are not looked at. Equal lengths go in the order of ids. An empty table gives
    an empty result. Bin names are unique.
    """
    n = materialise(lengths(docs, id_col, text_col).groupBy("id").agg(F.sum("n").alias("n")))
    total = n.count()
    cap = F.lit(capacity)
    full = n.filter(F.col("n") >= cap).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {capacity}") - 1)).alias("piece"))
    full = full.select(
        F.col("id").alias("doc_id"), F.col("piece").cast("int").alias("piece"), cap.cast("int").alias("n_words"),
        F.concat_ws("-", F.lit("full"), "id", "piece").alias("bin"), cap.cast("int").alias("bin_words")
    )
    empty = n.filter("n = 0").select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("n_words"), F.lit("empty").alias("bin"), F.lit(0).alias("bin_words"))
    rest = n.filter(F.pmod("n", cap) > 0).select("id", F.expr(f"cast(n div {capacity} as int)").alias("piece"), F.pmod("n", cap).cast("int").alias("n"))
    blocks = max(1, -(-total // block))
    items = rest.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.col("id").alias("item"), "n")
    first = materialise(_pack_blocks(items, capacity, islands, epochs))
    loose = first.filter(F.col("fill") < int(capacity * GOOD_FILL))
    kept = first.filter(F.col("fill") >= int(capacity * GOOD_FILL)).select(F.col("item").alias("id"), "n", F.concat_ws("-", F.lit("a"), "block", "bin").alias("bin"), "fill")
    again = max(1, -(-loose.count() // block))
    second = _pack_blocks(loose.select(F.pmod(F.xxhash64("block"), F.lit(again)).alias("block"), "item", "n"), capacity, islands, epochs)
    packed = kept.unionByName(second.select(F.col("item").alias("id"), "n", F.concat_ws("-", F.lit("b"), "block", "bin").alias("bin"), "fill"))
    last = packed.join(rest.select("id", "piece"), "id").select(F.col("id").alias("doc_id"), "piece", F.col("n").alias("n_words"), "bin", F.col("fill").alias("bin_words"))
    return full.unionByName(empty).unionByName(last)
