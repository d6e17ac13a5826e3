"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of 32 words; two neighbouring blocks are a passage. Words are hashed into 2^14 features, weighted
by their inverse block frequency over the whole corpus; features in over a tenth of the blocks carry none, and a segment that
mostly consists of such is held against every passage without regard to its vector. One pass
multiplies the block-feature matrix A and its transpose with a random test matrix, from which the driver has the leading
right singular vectors (randomised SVD by the Nystrom formula, which needs no second pass). Every passage is then projected
and compared by cosine with every benchmark segment; pairs above a threshold that follows the segment's length go to the
checks: the longest common subsequence of the segment and the passage with one block on either side, by a bit-parallel
recurrence over all pairs at once, and the share of it in the item's last quarter, where the answer stands. Of an item longer
than a segment, the segments that hold the answer are looked for.

Beside that every item, of any length, is looked for as a run of words, exactly and without any threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.session import bounded_batches

BLOCK = 32
BITS = 14
RANK = 64
MAX_DF = 0.1
#: Items of fewer words are looked for as exact runs only; a part of so few words says nothing.
MIN_WORDS = 8
SEGMENT = 64
COSINE = 0.2
#: Segments of fewer words go to the checks whatever their cosine.
UNGATED = 12
LCS = 0.7
ANSWER = 0.5
#: Bytes of benchmark texts that one pass over the documents looks for, about; a larger benchmark takes several passes, and only
#: one pass's part of it is on the driver at a time.
PASS_BYTES = 1 << 20
#: Tasks whose sums are added up before all are.
FAN_IN = 32
_GRID = 1 << 12


def blocks(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature and block of each word, first block of each text), blocks counted over the slice."""
    n = -(-w.counts // BLOCK)
    first = np.r_[0, np.cumsum(n)]
    doc = w.doc
    place = np.arange(len(w.hash)) - w.first[doc]
    return (w.hash >> T.U64(64 - BITS)).astype(np.int32), first[doc] + place // BLOCK, first


def with_zero(table: np.ndarray) -> np.ndarray:
    """``table`` and a last row of zeros."""
    return np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])


def sum_rows(table: np.ndarray, rows: np.ndarray, group: np.ndarray, groups: int, width: int = BLOCK) -> np.ndarray:
    """Sums of table[rows] by the sorted ``group``; the last row of the table is zero and fills up chunks of ``width``."""
    counts = np.bincount(group, minlength=groups)
    chunks = -(-counts // width)
    first = np.cumsum(chunks) - chunks
    start = np.cumsum(counts) - counts
    grid = np.full(int(chunks.sum()) * width, len(table) - 1, np.int32)
    grid[np.arange(len(rows)) + np.repeat(first * width - start, counts)] = rows
    grid = grid.reshape(-1, width)
    sums = np.empty((len(grid), table.shape[1]), np.float32)
    one = np.ones((1, width), np.float32)
    for at in range(0, len(grid), 256):
        sums[at : at + 256] = (one @ table[grid[at : at + 256]])[:, 0]
    out = np.zeros((groups, table.shape[1]), np.float32)
    full = np.flatnonzero(chunks)
    if len(full):
        out[full] = sums[first[full]] if len(sums) == len(full) else np.add.reduceat(sums, first[full], axis=0)
    return out


def block_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Blocks that hold each feature, and all blocks, over the whole table (t)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for s in T.slices(b, "t"):
                f, block, first = blocks(T.words(s.column("t")))
                key = (block << BITS) | f
                key = np.sort(key.astype(np.int32) if first[-1] < 1 << 31 - BITS else key)
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                df += np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS)
                total += int(first[-1])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[total, df[at]].astype(np.int64))], ["f", "n"])

    got = texts.mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = got.column("f").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(1 << BITS, np.int64)
    df[f[f >= 0]] = n[f >= 0]
    return df, int(n[f < 0].sum())


def weights(df: np.ndarray, total: int) -> np.ndarray:
    """Inverse block frequencies; 0 for features in over MAX_DF of the blocks."""
    return np.where(df > max(MAX_DF * total, 1), 0.0, np.log((1 + total) / (1 + df))).astype(np.float32)


def sketch(texts: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(test matrix, A^T A test matrix) over all blocks, rows of A scaled to unit weight.

    Tasks round their sums to a grid, so that the total does not depend on the order in which they end.
    """
    omega = np.random.Generator(np.random.PCG64(11)).standard_normal((1 << BITS, rank)).astype(np.float32)
    held = texts.sparkSession.sparkContext.broadcast((idf, with_zero(omega * idf[:, None])))
    rows = 256

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, table = held.value
        y = np.zeros((1 << BITS, rank))
        any_ = False
        for b in batches:
            for s in T.slices(b, "t", 4 << 20):
                f, block, first = blocks(T.words(s.column("t")))
                ok = weight[f] > 0
                f, block = f[ok], block[ok]
                if not len(f):
                    continue
                any_ = True
                z = sum_rows(table, f, block, int(first[-1]))
                z /= np.maximum(np.bincount(block, weight[f].astype(float) ** 2, len(z)), 1e-9)[:, None].astype(np.float32)
                order = np.argsort(f.astype(np.uint16), kind="stable")
                y += sum_rows(with_zero(z), block[order], f[order], 1 << BITS, 16)
                del z, order
        if any_:
            whole = np.rint(y * weight[:, None] * _GRID).astype(np.int64).astype(np.int32)
            n = (1 << BITS) // rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([x.tobytes() for x in whole.reshape(n, -1)], pa.binary())], ["r", "y"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, raw in zip(b.column("r").to_pylist(), b.column("y").to_pylist()):
                x = np.frombuffer(raw, np.int32 if len(raw) == 4 * rows * rank else np.int64)
                if r in sums:
                    sums[r] += x
                else:
                    sums[r] = x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["r", "y"])

    parts = texts.mapInArrow(multiply, "r int, y binary").withColumn("p", F.floor(F.spark_partition_id() / FAN_IN))
    parts = parts.repartition("r", "p").mapInArrow(add, "r int, y binary")
    got = parts.repartition("r").mapInArrow(add, "r int, y binary").toArrow()
    y = np.zeros((1 << BITS, rank))
    for r, raw in zip(got.column("r").to_pylist(), got.column("y").to_pylist()):
        y[r * rows : (r + 1) * rows] = np.frombuffer(raw, np.int64).reshape(rows, rank) / _GRID
    return omega, y


def singular_vectors(omega: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of A from y = A^T A omega."""
    if not y.any():
        return np.zeros_like(y), np.ones(y.shape[1])
    q, r = np.linalg.qr(omega.astype(float))
    y = y @ np.linalg.inv(r)
    shift = 1e-9 * np.linalg.norm(y)
    y = y + shift * q
    e, v = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    ok = e > e.max() * 1e-9
    u, s, _ = np.linalg.svd(y @ (v[:, ok] / np.sqrt(e[ok])), full_matrices=False)
    return u, np.sqrt(np.maximum(s**2 - shift, 1e-12))


SLOTS = 2048
#: Segments that are looked at together.
GROUP = 128


def slot(h: np.ndarray) -> np.ndarray:
    return ((h >> T.U64(20)) & T.U64(SLOTS - 1)).astype(np.int16)


class Target:
    """Benchmark segments of at most 64 words: item, words, words of the answer at the end, and bit masks by vocabulary word."""

    def __init__(self, items: np.ndarray, w: T.Words) -> None:
        self.item, self.hash, tail = [], [], []
        for i, (a, z) in enumerate(zip(w.first, w.first[1:])):
            h = w.hash[a:z]
            if len(h) < MIN_WORDS:
                continue
            starts = [0] if len(h) <= SEGMENT else [*range(0, len(h) - SEGMENT, SEGMENT // 2), len(h) - SEGMENT]
            answer = int(answer_words(np.array(len(h))))
            for s in starts:
                own = min(s + SEGMENT, len(h)) - max(s, len(h) - answer)
                if 2 * own >= min(answer, SEGMENT):
                    self.item.append(int(items[i]))
                    self.hash.append(h[s : s + SEGMENT])
                    tail.append(own)
        self.size = np.array([len(h) for h in self.hash], np.int64)
        self.tail = np.array(tail, np.int64)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        v = np.array([table[(h >> T.U64(64 - BITS)).astype(np.int64)].sum(0) for h in self.hash]).reshape(len(self.hash), -1)
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def least(self, idf: np.ndarray, cosine: float) -> np.ndarray:
        """Least cosine of the passages to look at; none for segments of which over half the words carry no weight."""
        weighty = np.array([(idf[(h >> T.U64(64 - BITS)).astype(np.int64)] > 0).mean() for h in self.hash])
        return np.where(weighty < 0.5, -np.inf, threshold(self.size, cosine))

    def rare(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, list["Rare"]]:
        """Slots of each segment's rarest words, how many of those an LCS of the needed length must hold (it can miss so many words
        in all), and the words by group."""
        miss = self.size - np.ceil(LCS * self.size - 1e-9).astype(np.int64)
        width = int(min(SEGMENT, (miss + 4).max())) if len(miss) else 1
        slots, need = np.full((len(self.hash), width), -1, np.int16), np.zeros(len(self.hash), np.int64)
        rarest = []
        for i, h in enumerate(self.hash):
            n = int(min(len(h), miss[i] + 4))
            order = np.argsort(-idf[(h >> T.U64(64 - BITS)).astype(np.int64)], kind="stable")[:n]
            slots[i, :n] = slot(h[order])
            need[i] = n - miss[i]
            rarest.append(h[order])
        return slots, need, [Rare(rarest[a : a + GROUP]) for a in range(0, len(rarest), GROUP)]

    def groups(self, size: int = GROUP) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first segment, last, vocabulary, masks) of each group."""
        out = []
        for a in range(0, len(self.hash), size):
            z = min(a + size, len(self.hash))
            vocabulary = np.unique(np.concatenate(self.hash[a:z]))
            out.append((a, z, vocabulary, self.masks(a, z, vocabulary)))
        return out

    def masks(self, a: int, z: int, vocabulary: np.ndarray) -> np.ndarray:
        """Bits of the places of each vocabulary word in each segment; the last column, for other words, is 0."""
        m = np.zeros((z - a, len(vocabulary) + 1), T.U64)
        for i in range(a, z):
            at = np.searchsorted(vocabulary, self.hash[i])
            np.bitwise_or.at(m[i - a], at, T.U64(1) << np.arange(len(at), dtype=T.U64))
        return m


class Rare:
    """The rarest words of a group of segments, each with the segments that have it, once for each place."""

    def __init__(self, words: list[np.ndarray]) -> None:
        self.width = len(words)
        h, seg = np.concatenate(words), np.repeat(np.arange(len(words)), [len(x) for x in words])
        order = np.argsort(h, kind="stable")
        self.word, n = np.unique(h, return_counts=True)
        self.seg, self.first = seg[order], np.r_[0, np.cumsum(n)]
        self.marked = np.zeros(1 << 16, bool)
        self.marked[self.word >> T.U64(48)] = True

    def count(self, h: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
        """For each block and segment, places of rare words that the block's words have; a word that comes again counts again, so
        these are upper bounds."""
        at = np.flatnonzero(self.marked[h >> T.U64(48)])
        k = np.minimum(np.searchsorted(self.word, h[at]), len(self.word) - 1)
        ok = self.word[k] == h[at]
        at, k = at[ok], k[ok]
        n = self.first[k + 1] - self.first[k]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        return np.bincount(np.repeat(block[at], n) * self.width + self.seg[place], minlength=blocks * self.width).reshape(blocks, self.width)


def subsequences(mask: np.ndarray, segment: np.ndarray, tokens: np.ndarray, size: np.ndarray, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(LCS, LCS without the last ``tail`` words of the segment) of each pair; tokens are columns of ``mask``, one row a pair."""
    tail = answer_words(size) if tail is None else tail
    v = np.full(len(segment), np.iinfo(np.uint64).max, T.U64)
    with np.errstate(over="ignore"):
        for j in range(tokens.shape[1]):
            u = v & mask[segment, tokens[:, j]]
            v = (v + u) | (v - u)
    low = lambda n: np.where(n >= 64, ~T.U64(0), (T.U64(1) << np.minimum(n, 63).astype(T.U64)) - T.U64(1))
    return np.bitwise_count(~v & low(size)).astype(np.int64), np.bitwise_count(~v & low(size - tail)).astype(np.int64)


def answer_words(size: np.ndarray) -> np.ndarray:
    return np.maximum(size // 4, 2)


def threshold(size: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Least cosine of a passage that holds a segment of ``size`` words among others; none below UNGATED words."""
    return np.where(size < UNGATED, -np.inf, cosine * np.sqrt(np.minimum(size, 2 * BLOCK) / (2 * BLOCK)))


class Runs:
    """Whole items as runs of words, found by one anchor each: of its runs of at most MIN_WORDS words, the one that the fewest items have."""

    def __init__(self, items: np.ndarray, words: list[np.ndarray]) -> None:
        kept = [(int(i), h) for i, h in zip(items, words) if len(h)]
        self.item, self.hash = np.array([i for i, _ in kept], np.int64), [h for _, h in kept]
        grams = [T.grams(h, min(len(h), MIN_WORDS)) for h in self.hash]
        seen, inverse, n = np.unique(np.concatenate([*grams, np.zeros(0, T.U64)]), return_inverse=True, return_counts=True)
        by: dict[int, list[tuple[int, int, int]]] = {}
        at = 0
        for i, g in enumerate(grams):
            offset = int(n[inverse[at : at + len(g)]].argmin())
            by.setdefault(min(len(self.hash[i]), MIN_WORDS), []).append((int(g[offset]), offset, i))
            at += len(g)
        self.anchors = []
        for width, rows in sorted(by.items()):
            rows.sort()
            key = np.array([k for k, _, _ in rows], T.U64)
            marked = np.zeros(1 << 16, bool)
            marked[key >> T.U64(48)] = True
            self.anchors.append((width, key, [(o, i) for _, o, i in rows], marked))

    def find(self, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of every item that stands in a text, word for word."""
        doc = w.doc
        texts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, key, rows, marked in self.anchors:
            g = T.grams(w.hash, width)
            at = np.flatnonzero(marked[g >> T.U64(48)])
            low, high = np.searchsorted(key, g[at], "left"), np.searchsorted(key, g[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            order = np.argsort(low, kind="stable")
            at, low, high = at[order], low[order], high[order]
            cut = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else low
            for a, z in zip(cut, np.r_[cut[1:], len(at)]):
                for offset, i in rows[low[a] : high[a]]:
                    h = self.hash[i]
                    start = at[a:z] - offset
                    start = start[(start >= 0) & (start + len(h) <= len(doc))]
                    start = start[doc[start] == doc[start + len(h) - 1]]
                    for j in range(len(h)):
                        start = start[w.hash[start + j] == h[j]]
                    found = np.unique(doc[start])
                    texts.append(found)
                    items.append(np.full(len(found), self.item[i]))
        return np.concatenate(texts), np.concatenate(items)


def search(
    w: T.Words, table: np.ndarray, target: Target, vectors: np.ndarray, groups: list, least: np.ndarray, rare: tuple[np.ndarray, np.ndarray, list[Rare]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, segment, share of the segment in the LCS) of the pairs that pass all checks. table ends with a row of zeros."""
    f, block, first = blocks(w)
    total = int(first[-1])
    none = np.zeros(0, np.int64)
    if not total or not len(target.size):
        return none, none, none.astype(float)
    z = sum_rows(table, f, block, total)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.flatnonzero(np.r_[owner[1:] == owner[:-1], False])
    alone = first[np.flatnonzero(np.diff(first) == 1)]
    at = np.concatenate([pair, alone])
    order = np.argsort(at, kind="stable")
    at, v = at[order], np.concatenate([z[pair] + z[pair + 1], z[alone]])[order]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    text, seg, share = [], [], []
    slots, need, rarest = rare
    for r in range(0, len(v), 1024):
        # Rare words of the passage and of one block on either side, by block and then by slot: two bounds that end most pairs.
        part = at[r : r + 1024]
        low, high = int(part[0]) - 1, int(part[-1]) + 3
        lo, hi = np.searchsorted(block, [low, high])
        row = part - low
        words = None
        for (a, b, vocabulary, mask), own in zip(groups, rarest):
            c = own.count(w.hash[lo:hi], block[lo:hi] - low, high - low)
            c = c[row - 1] + c[row] + c[row + 1] + c[row + 2]
            p, s = np.nonzero((c >= need[a:b]) & (v[r : r + 1024] @ vectors[a:b].T >= least[a:b]))
            if not len(p):
                continue
            if words is None:
                held = np.zeros((len(part), SLOTS + 1), bool)
                start = w.first[owner[part]] + (part - 1 - first[owner[part]]) * BLOCK
                grid = start[:, None] + np.arange(4 * BLOCK)
                out = (grid < w.first[owner[part]][:, None]) | (grid >= w.first[owner[part] + 1][:, None])
                words = w.hash[np.where(out, 0, grid)]
                held[np.arange(len(part))[:, None], np.where(out, SLOTS, slot(words))] = True
                held[:, -1] = False
            live = held[p[:, None], slots[a + s]].sum(1) >= need[a + s]
            p, s = p[live], s[live]
            if not len(p):
                continue
            col = np.searchsorted(vocabulary, words[p])
            col[col == len(vocabulary)] = 0
            col = np.where((vocabulary[col] == words[p]) & ~out[p], col, len(vocabulary))
            n = target.size[a + s]
            tail = target.tail[a + s]
            lcs, head = subsequences(mask, s, col, n, tail)
            good = (lcs >= LCS * n - 1e-9) & (lcs - head >= ANSWER * tail - 1e-9)
            text.append(owner[part[p]][good])
            seg.append(a + s[good])
            share.append((lcs / n)[good])
    if not text:
        return none, none, none.astype(float)
    return np.concatenate(text), np.concatenate(seg), np.concatenate(share)


def leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, share): documents that hold a benchmark item or a paraphrase, with the largest share found.

    An item that stands in the text word for word, whatever its length, has a share of 1. Otherwise share is the part of the
    item's words (of its best 64-word segment that holds the answer) that the passage has in their order; at least LCS of them and
    ANSWER of those of the item's last quarter. Items of fewer than MIN_WORDS words are found word for word only; those without
    words, null ones among them, match nothing. Rows of one doc_id (or item_id) are one document (item). Null and empty texts and
    rows without an id match nothing; very long texts are searched whole; other columns are not looked at. Empty tables give an
    empty result.
    """
    bounded_batches(docs)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null and t is not null")
    bench = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).dropna().distinct()
    passes = -(-int(bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PASS_BYTES)
    idf = table = None
    sc = docs.sparkSession.sparkContext
    out = d.limit(0).select(F.col("id").alias("doc_id"), F.col("id").alias("item_id"), F.lit(0.0).alias("share"))
    for number in range(passes):
        items = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == number).orderBy("i", "t").toArrow()
        words = T.words(items.column("t").combine_chunks() if items.num_rows else pa.array([], pa.string()))
        if not len(words.hash):
            continue
        numbers = items.column("i").to_numpy()
        target = Target(numbers, words)
        runs = Runs(numbers, [words.hash[a:z] for a, z in zip(words.first, words.first[1:])])
        if target.hash and table is None:
            idf = weights(*block_frequency(d))
            u, s = singular_vectors(*sketch(d, idf, rank))
            table = with_zero((u / np.maximum(s, s.max() * 1e-3) * idf[:, None]).astype(np.float32))
        held = sc.broadcast((table, target, idf, runs))  # the table's size is fixed, that of the rest follows PASS_BYTES

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table, target, weight, runs = held.value
            if target.hash:
                vectors, groups, least, rare = target.vectors(table), target.groups(), target.least(weight, cosine), target.rare(weight)
            item = np.array(target.item, np.int64)
            for b in batches:
                for s in T.slices(b, "t"):
                    w = T.words(s.column("t"))
                    text, exact = runs.find(w)
                    yield pa.RecordBatch.from_arrays([s.column("id").take(pa.array(text)), pa.array(exact), pa.array(np.ones(len(text)))], ["doc_id", "item_id", "share"])
                    if not target.hash:
                        continue
                    text, seg, share = search(w, table, target, vectors, groups, least, rare)
                    yield pa.RecordBatch.from_arrays([s.column("id").take(pa.array(text)), pa.array(item[seg]), pa.array(np.round(share, 6))], ["doc_id", "item_id", "share"])

        out = out.unionByName(d.mapInArrow(run, "doc_id long, item_id long, share double"))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
