"""Substring duplicates: De Bruijn compaction over word k-mers.

Edges are k-mers of words, nodes the (k-1)-mers between them. Two k-mers that follow each other in a text are on one
nonbranching path if the first is never followed by anything else, in any document, and the second never preceded by
anything else; the end of a text counts as something else. A *unitig* is a longest such path, so wherever one of its k-mers
occurs the whole of it occurs, and all its k-mers are in the same documents.

Consecutive k-mers of a text with one minimiser (the least hash of the m-grams in the k-mer) form a path that is compacted
on the spot, so only about 2/(k-m+2) rows a word are shuffled, keyed by minimiser. A k-mer can only repeat where its minimiser
does. Where all paths of a minimiser are alike, the path is nonbranching as it stands; where they differ, each distinct path is
spelled out once, from its least source coordinates, however many copies it has, and split at every branch. The pieces then
compact along each document by Spark joins with what follows and precedes each piece. In the end every occurrence's source
words are compared with those of the unitig's first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.session import bounded_batches, broadcast_if_small, discard, fresh, materialise

K, M = 50, 24
#: k-mers of one path; longer ones, of periodic texts, are cut, which compares them k-mer by k-mer.
LONGEST = 1 << 12
_COUNT, _LOOP, _START = (1 << 23) - 1, 1 << 23, 24


def paths(w: T.Words, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, k-mers, text, minimiser, loop) of the paths of a slice; first words count over the slice. ``loop`` marks
    the paths that may hold one k-mer twice."""
    n = len(w.hash)
    if n < k:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, T.U64), np.zeros(0, bool)
    g, width, total = T.grams(w.hash, m), k - m + 1, n - k + 1
    # A k-mer that comes again d places on brings its m-grams along.
    again = np.zeros(len(g) + 1, np.int32)
    for d in range(1, width):
        again[1 : len(g) - d + 1] |= g[:-d] == g[d:]
    np.cumsum(again, out=again)
    least, size = g, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:total], least[width - size : width - size + total])
    doc = w.doc
    ok = doc[:total] == doc[k - 1 :]
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (doc[1:total] != doc[: total - 1])
    at = np.flatnonzero(begin)
    # A path ends where the next one begins or k-mers run out.
    live = np.cumsum(ok)
    stop = np.r_[at[1:], total]
    count = live[stop - 1] - live[at] + 1 if len(at) else at
    if len(at) and count.max() > LONGEST:
        times = -(-count // LONGEST)
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times) + part * LONGEST
        count = np.minimum(np.repeat(count, times) - part * LONGEST, LONGEST)
    loop = (count > width) | (again[at + count + width - 1] > again[at])
    return at, count, doc[at], least[at], loop


def row_key(text: Column) -> Column:
    """60 bits of the text's MD5: tells apart the texts of one id."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _of_documents(d: DataFrame, lists: DataFrame) -> DataFrame:
    """(t, x) of the texts of ``d`` (doc, t) that ``lists`` (doc, row, x) asks for. Where the ids are few enough for a broadcast
    the other texts drop out before the shuffle."""
    ids = lists.select("doc").distinct()
    some = d.join(broadcast_if_small(ids), "doc", "left_semi").withColumn("row", row_key(F.col("t")))
    # Of repeated rows one is enough.
    return some.join(lists, ["doc", "row"])


def _ranges(lists: pa.Array, w_first: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """Text of each element of a list column, and its elements."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def repeated(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, start, words, first, first_row, first_start): the occurrences of unitigs that two documents have at least.

    row is the ``row_key`` of the text; the last three are the coordinates of the unitig's least occurrence.
    """
    bounded_batches(docs)
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).filter("doc is not null and t is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                w = T.words(s.column("t"))
                at, count, text, least, loop = paths(w, k, m)
                text_ = pa.array(text)
                place = ((at - w.first[text]) << _START) | count | np.where(loop, _LOOP, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        T.int64(least), T.int64(T.range_hash(w.hash, at, at + count + k - 1)), s.column("doc").take(text_), s.column("row").take(text_),
                        pa.array(place)
                    ],
                    ["least", "path", "doc", "row", "place"]
                )

    every = materialise(d.withColumn("row", row_key(F.col("t"))).mapInArrow(cut, "least long, path long, doc long, row long, place long"))
    # What repeats, and where a minimiser has more than one path.
    loop = F.col("place").bitwiseAND(_LOOP)
    hubs = every.groupBy("least").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("path").alias("p0"), F.max("path").alias("p1"), F.max(loop).alias("loop"))
    hubs = hubs.filter("lo < hi").select("least", (F.expr("p0 < p1") | (F.col("loop") > 0)).alias("mixed"))
    start, count = F.shiftright("place", _START).alias("start"), F.col("place").bitwiseAND(_COUNT).cast("int").alias("count")
    rows = materialise(every.join(hubs, "least").select("least", "path", "doc", "row", start, count, "mixed"))
    discard(every)

    # Distinct paths with their least source coordinates; the pieces of those that branch.
    distinct = rows.groupBy("least", "path", "count", "mixed").agg(F.min(F.struct("doc", "row", "start")).alias("at"), F.max("doc").alias("hi"))
    distinct = materialise(distinct.select("least", "path", "count", "mixed", "at.*", "hi"))
    whole = distinct.filter("not mixed").select(
        "least", "path", F.lit(0).alias("offset"), "count", F.col("doc").alias("a_doc"), F.col("row").alias("a_row"), F.col("start").alias("a_start")
    )
    lists = materialise(distinct.filter("mixed").groupBy("doc", "row").agg(F.collect_list(F.struct("least", "path", "start", "count", "hi")).alias("x")))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                w = T.words(s.column("t"))
                g = T.grams(w.hash, k)
                owner, x = _ranges(s.column("x"), w.first)
                begin, count = x.field("start").to_numpy(), x.field("count").to_numpy().astype(np.int64)
                each = np.repeat(np.arange(len(owner)), count)
                offset = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                at = w.first[owner[each]] + begin[each] + offset
                own, each_ = pa.array(owner[each]), pa.array(each)
                after = pa.array(g[np.minimum(at + 1, len(g) - 1)].view(np.int64), mask=offset == count[each] - 1)
                before = pa.array(g[np.maximum(at - 1, 0)].view(np.int64), mask=offset == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        x.field("least").take(each_), x.field("path").take(each_), pa.array(offset.astype(np.int32)), T.int64(g[at]), after, before,
                        s.column("doc").take(own), s.column("row").take(own), pa.array(begin[each] + offset), x.field("hi").take(each_)
                    ],
                    ["least", "path", "offset", "g", "after", "before", "doc", "row", "start", "hi"],
                )

    spelled = _of_documents(d, lists).dropDuplicates(["doc", "row"]).select("doc", "row", "t", "x")
    mers = materialise(spelled.mapInArrow(spell, "least long, path long, offset int, g long, after long, before long, doc long, row long, start long, hi long"))
    only = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    seen = mers.groupBy("least", "g").agg(F.min(F.struct("doc", "row", "start")).alias("a"), F.max("hi").alias("hi"), only("after").alias("out"), only("before").alias("in"))
    seen = seen.filter("a.doc < hi").select("least", "g", "out", "in", F.col("a.doc").alias("a_doc"), F.col("a.row").alias("a_row"), F.col("a.start").alias("a_start"))
    mers = mers.select("least", "path", "offset", "g").join(seen, ["least", "g"])
    along = Window.partitionBy("least", "path").orderBy("offset")
    same = (F.lag("offset").over(along) == F.col("offset") - 1) & F.lag("out").over(along) & F.col("in")
    mers = mers.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("piece", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = mers.groupBy("least", "path", "piece").agg(F.min(F.struct("offset", "a_doc", "a_row", "a_start")).alias("f"), F.count("*").cast("int").alias("count"))
    pieces = materialise(whole.unionByName(pieces.select("least", "path", "f.offset", "count", "f.a_doc", "f.a_row", "f.a_start")))

    # Pieces along each document; rows that repeat an id and a text count once.
    here = rows.select("least", "path", "doc", "row", "start").join(pieces, ["least", "path"])
    here = here.groupBy("doc", "row", (F.col("start") + F.col("offset")).alias("start")).agg(
        F.min("count").alias("count"), F.min("a_doc").alias("a_doc"), F.min("a_row").alias("a_row"), F.min("a_start").alias("a_start")
    )
    text = Window.partitionBy("doc", "row").orderBy("start")
    name = F.xxhash64("a_doc", "a_row", "a_start")
    here = here.withColumns(
        {
            "touch": F.lag(F.col("start") + F.col("count")).over(text) == F.col("start"), "before": F.lag(name).over(text),
            "follow": F.lead("start").over(text) == F.col("start") + F.col("count"), "after": F.lead(name).over(text)
        }
    )
    here = here.withColumns({"before": F.when(F.col("touch"), F.col("before")), "after": F.when(F.col("follow"), F.col("after"))}).drop("touch", "follow")
    here = materialise(here)
    discard(rows), discard(distinct), discard(lists)
    ends = here.groupBy("a_doc", "a_row", "a_start").agg(only("after").alias("out"), only("before").alias("in"))
    here = here.select("doc", "row", "start", "count", F.col("before").isNotNull().alias("touch"), "a_doc", "a_row", "a_start").join(ends, ["a_doc", "a_row", "a_start"])
    same = F.col("touch") & F.col("in") & F.lag("out").over(text)
    here = here.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("unit", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    units = here.groupBy("doc", "row", "unit").agg(F.min(F.struct("start", "a_doc", "a_row", "a_start")).alias("f"), (F.sum("count") + k - 1).cast("int").alias("words"))
    units = materialise(
        units.select(
            "doc", "row", "f.start", "words", F.col("f.a_doc").alias("first"), F.col("f.a_row").alias("first_row"), F.col("f.a_start").alias("first_start")
        )
    )
    wrong = _unequal(d, units)
    return units if wrong.isEmpty() else units.join(wrong, ["doc", "row", "start"], "left_anti")


def _unequal(d: DataFrame, units: DataFrame) -> DataFrame:
    """(doc, row, start) of the occurrences whose source words are not those of the unitig's first occurrence."""
    heads = units.filter("doc = first and row = first_row and start = first_start")
    heads = heads.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "words")).alias("x"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                raw, begin, end, first = T.plain(s.column("t"))
                owner, x = _ranges(s.column("x"), first)
                at = first[owner] + x.field("start").to_numpy()
                spelled = [raw[a:z].tobytes() for a, z in zip(begin[at], end[at + x.field("words").to_numpy() - 1])]
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc").take(own), s.column("row").take(own), x.field("start"), pa.array(spelled, pa.binary())],
                    ["first", "first_row", "first_start", "spelled"]
                )

    spelled = _of_documents(d, materialise(heads)).dropDuplicates(["doc", "row"]).select("doc", "row", "t", "x").mapInArrow(
        read, "first long, first_row long, first_start long, spelled binary"
    )
    rest = units.filter("not (doc = first and row = first_row and start = first_start)")
    rest = rest.join(spelled, ["first", "first_row", "first_start"], "left")
    rest = rest.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "words", F.coalesce("spelled", F.lit(b"")).alias("spelled"))).alias("x"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "t"):
                raw, begin, end, first = T.plain(s.column("t"))
                owner, x = _ranges(s.column("x"), first)
                at = first[owner] + x.field("start").to_numpy()
                bad = [raw[a:z].tobytes() != want for a, z, want in zip(begin[at], end[at + x.field("words").to_numpy() - 1], x.field("spelled").to_pylist())]
                own = pa.array(owner[np.array(bad, bool)])
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc").take(own), s.column("row").take(own), x.field("start").filter(pa.array(bad, pa.bool_()))], ["doc", "row", "start"]
                )

    rest = materialise(rest)
    wrong = materialise(_of_documents(d, rest).select("doc", "row", "t", "x").mapInArrow(compare, "doc long, row long, start long").distinct())
    discard(rest)
    return wrong


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, start_word, n_words, path_id, first_doc_id): every run of ``k`` words or more that another document
    has too, as the unitigs it consists of.

    Words are those of ``text``. A run ends where in any document anything else goes on or comes before, or a text ends, so a
    unitig is whole wherever it occurs, and runs of one text overlap by k-1 words at a branch. first_doc_id is the least
    document that has the run, path_id the coordinates of its least occurrence. Repetition within one document only does not
    count. Rows of one id are one document; text_key tells their texts apart, each with its own coordinates, and rows that
    repeat an id and a text count once. Null, empty and shorter texts and rows without an id have no runs; very long texts
    are taken whole, in slices of windows of words; other columns are not looked at. An empty table gives an empty result.
    """
    u = repeated(docs, k, m, id_col, text_col)
    return u.select(
        F.col("doc").alias("doc_id"), F.col("row").alias("text_key"), F.col("start").alias("start_word"), F.col("words").alias("n_words"),
        F.concat_ws("-", "first", "first_row", "first_start").alias("path_id"), F.col("first").alias("first_doc_id")
    )


#: The same result in DuckDB: k-mers as lists of words, links between them by window functions.
ORACLE_SQL = rf"""WITH w AS (SELECT doc_id, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS text_key, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS l
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
p AS (SELECT doc_id, text_key, l, unnest(range(len(l) - {K - 1})) AS i FROM w WHERE len(l) >= {K}),
m AS (SELECT doc_id, text_key, i, md5(array_to_string(l[i + 1 : i + {K}], ' ')) AS g FROM p),
f AS (SELECT *, lead(g) OVER t AS b, lag(g) OVER t AS a FROM m WINDOW t AS (PARTITION BY doc_id, text_key ORDER BY i)),
s AS (SELECT g, min(b) = max(b) AND count(b) = count(*) AS o, min(a) = max(a) AND count(a) = count(*) AS n, min({{'d': doc_id, 'k': text_key, 'i': i}}) AS c FROM f GROUP BY g HAVING min(doc_id) < max(doc_id)),
j AS (SELECT doc_id, text_key, i, s.* FROM f JOIN s USING (g)),
u AS (SELECT *, CASE WHEN lag(i) OVER t = i - 1 AND lag(o) OVER t AND n THEN 0 ELSE 1 END AS fresh FROM j WINDOW t AS (PARTITION BY doc_id, text_key ORDER BY i)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, text_key ORDER BY i) AS unit FROM u)
SELECT doc_id, text_key, min(i) AS start_word, CAST(count(*) + {K - 1} AS INTEGER) AS n_words, min(c).d || '-' || arg_min(c, i).k || '-' || arg_min(c, i).i AS path_id, min(c.d) AS first_doc_id
FROM v GROUP BY doc_id, text_key, unit"""


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of repeated runs outside the first document (least id) that has them.

    A cut takes the separators up to the next word left. A document of which no word is left goes; one without words from
    the start stays. Columns stay as they are, but that n_chars, if there is one, is the new length where a text was cut.
    Cuts are those of a row's own text: rows of one id and text are cut alike, another text under the same id by its own runs.
    Rows without an id, and null texts, stay as they are; very long texts are taken whole.
    """
    bounded_batches(docs)
    doc, key, cuts, new = (fresh(docs, c) for c in ("doc", "key", "cuts", "new"))
    found = repeated(docs, k, m, id_col, text_col).filter("first <> doc").groupBy(F.col("doc").alias(doc), F.col("row").alias(key)).agg(
        F.collect_list(F.struct("start", "words")).alias(cuts)
    )
    found = materialise(found)
    mine = (F.col(id_col).cast("long") == F.col(doc)) & (row_key(F.col(text_col).cast("string")) == F.col(key))
    joined = docs.join(broadcast_if_small(found), mine, "left").drop(doc, key)

    @F.arrow_udf("string")
    def strike(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts, cuts], ["t", "c"])
        out: list[str | None] = []
        for s in T.slices(batch, "t"):
            w = T.words(s.column("t"), hashes=False)
            for i, (text, cut) in enumerate(zip(s.column("t").to_pylist(), s.column("c").to_pylist())):
                lo, hi = w.first[i], w.first[i + 1]
                edge = np.zeros(hi - lo + 1, np.int64)
                for c in cut:
                    edge[c["start"]] += 1
                    edge[c["start"] + c["words"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                if gone.all():
                    out.append(None)
                    continue
                raw = text.encode()
                change = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
                parts, at = [], 0
                for c in change:
                    byte = int(w.start[lo + c])
                    if gone[c]:
                        parts.append(raw[at:byte])
                    at = byte
                if not gone[-1]:
                    parts.append(raw[at:])
                out.append(b"".join(parts).decode())
        return pa.array(out, pa.string())

    cut = joined.filter(F.col(cuts).isNotNull()).withColumn(new, strike(F.col(text_col).cast("string"), F.col(cuts))).filter(F.col(new).isNotNull())
    cut = cut.withColumn(text_col, F.col(new))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(new).cast(docs.schema["n_chars"].dataType))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return joined.filter(F.col(cuts).isNull()).select(*columns).unionByName(cut.select(*columns))
