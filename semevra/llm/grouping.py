"""Groups of similar rows from hash buckets: connected components of verified pairs, with no cap on bucket sizes.

All pairs of a bucket are candidates, but few need a look. First each member is compared with one centre of its bucket
(another one in each bucket, chosen by hash), and the verified pairs are contracted. Then only pairs of a bucket whose
members are still in different components are formed. Where a bucket still holds more than HOT components, unlike rows have met
by chance or by a common passage: it is split by further hashes first, again and again, so that no bucket is ever squared that
could be made smaller. A bucket of n copies of one text costs n comparisons, not n^2. Where what decides on a pair is small, the
pairs of a bucket are formed and judged in the task that holds its rows, and only those that pass leave it (``inside``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.session import broadcast_if_small, discard, materialise


#: Components of one bucket that are compared pair by pair; splits of larger ones, one within another, at most.
HOT, SPLITS = 256, 3
#: The same where pairs are judged inside of buckets; rows of a block of a bucket; pairs that a task forms at once.
WIDE, BLOCK, TILE = 1 << 14, 1 << 12, 1 << 16
#: Pairs that are verified at once without a look at what joins first; pairs of a bucket's components that are formed at once, for each
#: row and in all. They decide on time, not on results.
AT_ONCE, FEW, AHEAD = 1 << 14, 16, 1 << 22
#: Rows from which a bucket is spread over tasks; rows that a task counts at once, and those of a bucket among them that it reports.
SPREAD, COUNTED, SEEN = 1 << 20, 1 << 20, 64


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) of the ids that are not the least, for one piece of an edge list."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        p, q = label[x], label[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:  # every label is a root again
            up = label[label]
            if (up == label).all():
                break
            label = up
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0
    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += batch.num_rows
        if held > 1 << 22:  # what a task holds is bounded
            x, y = contract(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
            if len(x) > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    x, y = contract(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for the ends of ``edges`` (a, b), label being the least id of the component.

    Each task contracts its own piece of the edges. Then alternating large-star and small-star steps (Kiveris et al. 2014)
    join the pieces, with each step's edges written to the shared folder. Self-loops keep their node as a component of its own.
    An empty input gives an empty result. Edges that do not settle in ``rounds`` rounds (their number grows with the logarithm
    of the longest path) raise an error.
    """

    def count(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    every = materialise(edges.dropna().select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    loops = every.filter("a = b").select(F.col("a").alias("id"))
    e = materialise(every.filter("a <> b").mapInArrow(_contract, "a long, b long"))
    last = count(e)
    for _ in range(rounds if last[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        ).select("x.a", "x.b")
        before, e = e, materialise(small.filter("a <> b").distinct())
        discard(before)
        now = count(e)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
    labels = e.select(F.col("a").alias("id"), F.col("b").alias("label"))
    roots = e.select(F.col("b").alias("id")).unionByName(loops)
    return labels.unionByName(roots.distinct().join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("label")))


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the buckets that have SEEN rows at least among some COUNTED of a task."""

    def report(parts: list[np.ndarray]) -> pa.RecordBatch:
        bucket, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
        often = n >= SEEN
        return pa.RecordBatch.from_arrays([pa.array(bucket[often]), pa.array(n[often])], ["bucket", "n"])

    parts, held = [], 0
    for batch in batches:
        parts.append(batch.column("bucket").to_numpy())
        held += batch.num_rows
        if held >= COUNTED:
            yield report(parts)
            parts, held = [], 0
    yield report(parts)


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows (bucket long, id long) whose bucket has two ids at least: one shuffle, one sort, no growing state.

    A bucket of SPREAD rows or more, which tasks see by counting what they make, never meets in one task: nobody need ask
    whether it is shared, so its rows are only made distinct, by bucket and id.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, linked = None, False
        for batch in batches:
            b, i = batch.column("bucket").to_numpy(), batch.column("id").to_numpy()
            if held is not None:
                b, i = np.r_[held[0], b], np.r_[held[1], i]
            if not len(b):
                continue
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1])
            b, i = b[new], i[new]
            before = np.zeros(len(b), bool)
            before[1:] = b[1:] == b[:-1]
            before[0] = linked and held is not None
            ok = before.copy()
            ok[:-1] |= before[1:]
            held, linked = (b[-1], i[-1]), bool(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(b[:-1][ok[:-1]]), pa.array(i[:-1][ok[:-1]])], ["bucket", "id"])
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["bucket", "id"])

    rows = rows.select("bucket", "id")
    hot = rows.select("bucket").mapInArrow(_heavy, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot = materialise(hot.filter(F.col("n") >= SPREAD).select("bucket"))
    spread: DataFrame | None = None
    if not hot.isEmpty():
        known = broadcast_if_small(hot)
        spread = rows.join(known, "bucket", "left_semi").dropDuplicates(["bucket", "id"])
        rows = rows.join(known, "bucket", "left_anti")
    cold = rows.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(keep, "bucket long, id long")
    return cold if spread is None else cold.unionByName(spread)


def only(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``df`` (id, ...) whose id is in a pair (a, b); the ids are broadcast while their counted size allows."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return df.join(broadcast_if_small(ids), "id", "left_semi")


def star_pairs(buckets: DataFrame, salt: int = 0) -> DataFrame:
    """Distinct (a, b), a < b: each member of a bucket (bucket, id) with the bucket's centre, another one for each ``salt``. Where
    the rows have labels (bucket, id, label), the members of the centre's own label are left out."""
    labelled = "label" in buckets.columns
    order = F.xxhash64("bucket", "id", F.lit(salt)) if salt else F.xxhash64("bucket", "id")
    centre = F.min(F.struct(order.alias("o"), "id", *["label"] * labelled)).alias("c")
    c = buckets.groupBy("bucket").agg(centre, F.count("*").alias("n")).filter("n > 1").select("bucket", F.col("c.id").alias("c"), *[F.col("c.label").alias("l")] * labelled)
    p = buckets.join(c, "bucket").filter("label <> l" if labelled else "id <> c")
    return p.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, label) of the buckets whose members have different labels; ids without a label are their own."""
    b = buckets.select("bucket", "id").join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    open_ = b.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket")
    return materialise(b.join(open_, "bucket"))


def pairs_ahead(rows: DataFrame) -> tuple[int, int]:
    """Rows (bucket, id, label), and the pairs of different labels in one bucket, which cross_pairs would form."""
    n = rows.groupBy("bucket", "label").agg(F.count("*").cast("double").alias("n")).groupBy("bucket")
    got = n.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")).agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()
    return int(got[0] or 0), int(got[1] or 0)


def settle(pairs: DataFrame, labels: DataFrame, verify: Callable[[DataFrame], DataFrame], spent: int) -> tuple[DataFrame, int]:
    """``labels`` (id, label) after all true ones of ``pairs`` (a, b, est) have joined components, and ``spent`` with the pairs verified.

    The best pair of each component is verified, the true ones are contracted, and so on (Boruvka): a pair whose ends have met
    in the meantime needs no look. All that is left is verified at once when a round takes away less than a quarter, or
    when it is no more than was verified before.
    """
    last: int | None = None
    spare: list[DataFrame] = []
    while True:
        p = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left")
        p = p.join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
        p = p.select("a", "b", "est", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
        p = materialise(p.filter("la <> lb"))
        for x in spare:
            discard(x)
        n = p.count()
        whole = n <= max(spent, AT_ONCE) or last is not None and 4 * n > 3 * last
        if not n:
            return labels, spent
        if whole:
            chosen = p.select("a", "b")
        else:
            ends = p.select(F.col("la").alias("id"), "est", "a", "b").unionByName(p.select(F.col("lb").alias("id"), "est", "a", "b"))
            chosen = materialise(ends.groupBy("id").agg(F.max(F.struct("est", "a", "b")).alias("m")).select("m.a", "m.b").distinct())
        good = materialise(verify(chosen))
        if not good.isEmpty():
            labels = materialise(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(good)))
        discard(good)
        if whole:
            return labels, spent + n
        spent += chosen.count()
        pairs, last, spare = p.select("a", "b", "est").join(chosen, ["a", "b"], "left_anti"), n, [p, chosen]


def blocks(rows: DataFrame) -> DataFrame:
    """(bucket, low, high, side) before the other columns of ``rows`` (bucket, id, ...): each bucket in blocks of some BLOCK rows, and
    a part (bucket, low, high) for every two of them and for each with itself. Rows of block ``high`` are on side 1 if it is another."""
    n = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    r = rows.join(n, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    return r.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side, *[c for c in rows.columns if c != "bucket"])


def tiles(part: np.ndarray, both: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of rows of one part, some TILE at once; where ``both``, of rows on different sides only. ``part`` numbers the
    parts in the order of rows, which within one part are in the order of sides."""
    n = len(part)
    end = np.searchsorted(part, part, "right")
    start = np.where(both, np.searchsorted(part * 2 + side, part * 2 + 1), np.arange(n) + 1)
    count = np.where(both & (side == 1), 0, end - start)
    total = np.r_[0, np.cumsum(count)]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + TILE, "right")) - 1)
        i = np.repeat(np.arange(at, to), count[at:to])
        yield i, start[i] + np.arange(total[at], total[to]) - total[i]
        at = to


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of ``blocks`` in order, as (rows, part, both) for ``tiles``, with no part torn."""

    def numbered(t: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in ("bucket", "low", "high"):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    def ready(t: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        return t, numbered(t), t.column("low").to_numpy() != t.column("high").to_numpy()

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch if held is None else pa.concat_batches([held, batch])
        part = numbered(t)
        cut = int(np.searchsorted(part, part[-1]))
        if cut:
            yield ready(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield ready(held)


def cross_pairs(
    buckets: DataFrame, labels: DataFrame, refine: Callable[[DataFrame, int], DataFrame], depth: int = 1, inside: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Distinct (a, b), a < b, that share a bucket and have different labels; ids without a label are their own.

    Buckets of more than HOT labels give the pairs that share a bucket of theirs after ``refine``. With ``inside``, which maps rows
    (bucket, id, label) to those of their pairs that are worth verifying (a, b, est), the result is these, and WIDE is in HOT's place.
    """
    b = still_open(buckets, labels)
    most = HOT if inside is None else WIDE
    parts = b.select("bucket", "label").distinct()
    crowded = materialise(parts.groupBy("bucket").count().filter(F.col("count") > most).select("bucket")) if depth <= SPLITS else None
    finer: DataFrame | None = None
    if crowded is not None and not crowded.isEmpty():
        split = materialise(shared(refine(b.join(crowded, "bucket").select("bucket", "id"), depth)))
        finer = cross_pairs(split, labels, refine, depth + 1, inside)
        b = materialise(b.join(crowded, "bucket", "left_anti"))
        parts = b.select("bucket", "label").distinct()
    if inside is not None:
        p = inside(b)
        return p if finer is None else p.unionByName(finer).groupBy("a", "b").agg(F.max("est").alias("est"))
    split = parts.alias("x").join(parts.alias("y"), "bucket").filter("x.label < y.label").select("bucket", F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
    p = split.join(b.select("bucket", F.col("label").alias("la"), F.col("id").alias("a")), ["bucket", "la"])
    p = p.join(b.select("bucket", F.col("label").alias("lb"), F.col("id").alias("b")), ["bucket", "lb"])
    p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (p if finer is None else p.unionByName(finer)).distinct()


def group(
    buckets: DataFrame, sieve: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame] | None, same: DataFrame,
    refine: Callable[[DataFrame, int], DataFrame], inside: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(id, label) of the ids in verified pairs, or in pairs (a, b) of ``same``, which are verified already.

    ``sieve`` maps pairs (a, b) to those worth verifying with an estimate (a, b, est); ``verify`` maps pairs to the true
    ones, and is None where the sieve's are. What the sieve lets through is verified the best of each component first, and the
    rest only where its ends are still in different components. Before all pairs of different components are formed, further
    centres join what belongs together, as long as they halve the pairs that are ahead: n near copies cost some n comparisons then,
    not n^2. ``refine`` (rows, depth) splits crowded buckets. ``inside`` sieves all pairs of rows (bucket, id, label) where they lie.
    """
    first = materialise(sieve(star_pairs(buckets)))
    if verify is None:
        one = first.select("a", "b")
        labels = materialise(components(one))
        two = materialise(sieve(cross_pairs(buckets, labels, refine)).select("a", "b"))
        return components(one.unionByName(two).unionByName(same))
    labels, spent = settle(first, materialise(components(same)), verify, 0)
    rows = still_open(buckets, labels)
    held, ahead = pairs_ahead(rows)
    salt = 0
    while ahead > max(FEW * held, AHEAD):
        salt += 1
        labels, spent = settle(materialise(sieve(star_pairs(rows, salt))), labels, verify, spent)
        before, rows = rows, still_open(rows, labels)
        discard(before)
        last, (held, ahead) = ahead, pairs_ahead(rows)
        if 2 * ahead > last:
            break
    # What the sieve refused once it refuses again; only unseen pairs are worth its time.
    last_pairs = sieve(cross_pairs(rows, labels, refine)) if inside is None else cross_pairs(rows, labels, refine, 1, inside)
    return settle(materialise(last_pairs), labels, verify, spent)[0]
