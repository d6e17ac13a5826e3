"""Quality: hierarchical empirical Bayes over a document classifier.

A logistic model over text statistics gives each document a log-odds of being good. Grouped sums turn those into
posteriors of hosts, shrunk toward the corpus, and of paths, shrunk toward their host; the strength of either shrinkage
is the method-of-moments ratio of the variance within groups to that between them. A document is kept if its own
evidence, with its path's posterior as the prior odds, makes it at least as likely good as bad. That posterior leaves the
document itself out, so on a sparse site its evidence does not count twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.session import bounded_batches, broadcast_if_small, materialise

MAX_LABELLED = 8_000
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"!", b"*#$%&@^~=<>{}[]\\/|_+", b".,;:?'\"()-"]
_CLASS = np.full(256, len(_CLASSES), np.int32)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
N_FEATURES = len(_CLASSES) + 8


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text; those of an empty or null text are 0."""
    raw, off = T.buffers(texts)
    w = T.words(texts)
    n, size = len(texts), np.maximum(np.diff(off), 1)
    out = np.zeros((n, N_FEATURES))
    k = len(_CLASSES)
    kinds = np.zeros(n * (k + 1))
    for a in range(0, len(raw), T.WINDOW_BYTES):
        z = min(a + T.WINDOW_BYTES, len(raw))
        lo, hi = int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, z, "left"))
        owner = np.repeat(np.arange(lo, hi, dtype=np.int32) * (k + 1), np.diff(np.clip(off[lo : hi + 1], a, z)))
        kinds += np.bincount(owner + _CLASS[raw[a:z]], minlength=len(kinds))
    kinds = kinds.reshape(n, k + 1)
    out[:, :k] = kinds[:, :k] / size[:, None]
    words = np.maximum(w.counts, 1)
    doc = w.doc
    # 44 bits of the hash beside the text: words of one text that agree in them count as one.
    h = np.sort((doc.astype(T.U64) << T.U64(44)) | (w.hash >> T.U64(20)))
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[at, len(h)])
    owner = (h[at] >> T.U64(44)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    if len(at):
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        top[owner[cut]] = np.maximum.reduceat(runs, cut)
    length = (w.end - w.start).astype(float)
    out[:, k] = np.log1p(w.counts)
    out[:, k + 1] = np.bincount(doc, length, n) / words
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / words - out[:, k + 1] ** 2, 0))
    out[:, k + 3] = distinct / words
    out[:, k + 4] = distinct / words * np.log1p(w.counts)
    out[:, k + 5] = top / words
    p, pd_ = T.valid_grams(w, 2)
    same = w.hash[p] == w.hash[p + 1] if len(p) else np.zeros(0, bool)
    out[:, k + 6] = np.bincount(pd_[same], minlength=n) / words
    out[:, k + 7] = np.minimum(np.log1p(size), 20)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients (the last is the intercept) of a ridge logistic fit by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    b = np.zeros(a.shape[1])
    r = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((a * s[:, None]).T @ a + r, a.T @ (y - p) - r @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple:
    """(mean, scale, coefficients, prior log-odds) from a hash-ordered sample of at most ``max_labelled`` labelled ids.

    Rows without id, text or label are not used; an id labelled twice counts by its largest label. Where one class is
    missing the model says nothing: every document's evidence is 0.
    """
    bounded_batches(docs)
    lab = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    lab = lab.orderBy(F.xxhash64("k"), "k").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).dropna().join(F.broadcast(lab), "k")

    def stats(batches):
        for b in batches:
            for s in T.slices(b, "t"):
                x = statistics(s.column("t"))
                yield pa.RecordBatch.from_arrays([s.column("k"), s.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["k", "y", "x"])

    got = rows.mapInArrow(stats, f"k {rows.schema['k'].dataType.simpleString()}, y int, x array<double>").toArrow().to_pandas()
    if not len(got) or got.y.nunique() < 2:
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.0
    got["o"] = [tuple(v) for v in got.x]
    got = got.sort_values(["k", "o"])
    y = (got.y.to_numpy() > 0).astype(float)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    return *logistic(np.array(got.x.to_list()), y), float(np.log(prior / (1 - prior)))


def evidence(model: tuple, text: Column) -> Column:
    """Log-odds of good that the text gives by the classifier, prior included."""
    mean, scale, b, _ = model

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        parts = [np.zeros(0)]
        for s in T.slices(batch, "t"):
            x = np.clip((statistics(s.column("t")) - mean) / scale, -8, 8)
            parts.append(np.clip(x @ b[:-1] + b[-1], -12, 12))
        return pa.array(np.concatenate(parts))

    return logit(text)


def _kappa(within: float, between: float) -> float:
    """Pseudo-count of a shrinkage; without variance between groups it is so large that only the parent counts."""
    return min(within / between, 1e9) if between > 1e-12 and within > 0 else (1e9 if between <= 1e-12 else 1e-6)


def posteriors(paths: DataFrame) -> DataFrame:
    """(host, path, host_quality, path_quality, and what they are made of) from sums (host, path, n, s, ss) of the documents' probabilities.

    An empty input gives an empty result. One host, or one path a host, has no variance between groups: the parent's
    value holds.
    """
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") * F.col("n")).alias("pn2"), F.count("*").alias("np"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("pms")
    )
    t = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hms"), F.sum("pms").alias("pms"),
        F.sum(F.col("hn") * F.col("hn")).alias("hn2"), F.sum(F.col("pn2") / F.col("hn")).alias("pn2h"), F.count("*").alias("nh"), F.sum("np").alias("np")
    ).first()
    ss = paths.agg(F.sum("ss")).first()[0] or 0.0
    n = float(t["n"] or 0)
    if not n:
        mu, kh, kp = 0.5, 1e9, 1e9
    else:
        mu = t["s"] / n
        within = max(ss - t["pms"], 0.0) / max(n - t["np"], 1.0)
        host_var = (t["hms"] - t["s"] ** 2 / n - (t["nh"] - 1) * within) / max(n - t["hn2"] / n, 1e-9) if t["nh"] > 1 else 0.0
        path_var = (t["pms"] - t["hms"] - (t["np"] - t["nh"]) * within) / max(n - t["pn2h"], 1e-9) if t["np"] > t["nh"] else 0.0
        kh, kp = _kappa(within, host_var), _kappa(within, path_var)
    hosts = hosts.select("host", "hn", "hs")
    p = paths.select("host", "path", "n", "s").join(hosts, "host").withColumns({"mu": F.lit(mu), "kh": F.lit(kh), "kp": F.lit(kp)})
    h, q = shrunk(F.lit(0.0), F.lit(0))
    return p.withColumns({"host_quality": h, "path_quality": q})


def shrunk(own: Column, left_out: Column) -> tuple[Column, Column]:
    """Posteriors of host and path from the columns of ``posteriors``, without ``left_out`` (0 or 1) documents of value ``own``."""
    h = (F.col("hs") - own + F.col("kh") * F.col("mu")) / (F.col("hn") - left_out + F.col("kh"))
    return h, (F.col("s") - own + F.col("kp") * h) / (F.col("n") - left_out + F.col("kp"))


def judge(docs: DataFrame, model: tuple, text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc, host, path, host_quality, path_quality, quality, keep): doc is the row of ``docs`` as a struct.

    quality is the posterior probability of good; keep is ``quality >= 0.5``. By default the host is the column source and
    the path the column lang below it. A null host or path counts as the empty one. Null and empty texts are judged by their
    (zero) statistics, very long ones by those of the whole text. The only document of a site has the corpus's mean as its prior.
    Repeated rows are judged alike, and each counts in its path. Columns of the input may have any names.
    An empty table gives an empty result. A hot host is no problem: the sums are combined map-side and the site table is
    joined by broadcast while its counted size allows.
    """
    bounded_batches(docs)
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))
    prior = model[3]
    scored = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), host.alias("host"), path.alias("path"),
        evidence(model, F.col(text_col).cast("string")).alias("l")
    )
    p = 1 / (1 + F.exp(-F.col("l")))
    # Sums of integers do not depend on the order in which tasks end.
    unit = 1 << 30
    sums = scored.select("host", "path", F.round(p * unit).cast("long").alias("u")).groupBy("host", "path")
    sums = sums.agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum(F.round(F.col("u").cast("double") * F.col("u") / unit).cast("long")).alias("uu"))
    paths = materialise(sums.select("host", "path", F.col("n").cast("double").alias("n"), (F.col("u") / unit).alias("s"), (F.col("uu") / unit).alias("ss")))
    _, q = shrunk(F.round(p * unit).cast("long") / unit, F.lit(1))
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), q))
    quality = 1 / (1 + F.exp(-(F.col("l") - F.lit(prior) + F.log(q / (1 - q)))))
    out = scored.join(broadcast_if_small(materialise(posteriors(paths))), ["host", "path"]).withColumn("quality", quality)
    return out.select("doc", "host", "path", "host_quality", "path_quality", "quality", (F.col("quality") >= 0.5).alias("keep"))
