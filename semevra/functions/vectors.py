"""Vector expressions. Sums run in double precision, element by element in order, so a row's score does not depend on layout."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    """Dot product. A literal vector is unrolled into one generated expression; two columns use higher-order functions."""
    if isinstance(b, Column):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    out = F.lit(0.0)
    for i, x in enumerate(b):
        out = out + a.getItem(i).cast("double") * F.lit(float(x))
    return out


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine_from_l2(d: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d / 2))


def _sums(vectors: pa.Array, centroids: np.ndarray, squared: bool) -> np.ndarray:
    """Dot products or squared distances (rows x centroids), summed element by element in order, as the expressions above do."""
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)
    out = np.zeros((len(x), len(centroids)))
    for j in range(centroids.shape[1]):
        if squared:
            e = x[:, j, None] - centroids[None, :, j]
            out += e * e
        else:
            out += x[:, j, None] * centroids[None, :, j]
    return out


def nearest(vector: Column, centroids: Sequence[tuple[int, Sequence[float]]], digits: int | None = None) -> Column:
    """struct(dist, cluster) of the nearest centroid by squared distance, the lowest number on ties. Vectors are not null."""
    order = sorted(centroids)
    numbers, c = np.array([n for n, _ in order], np.int32), np.array([v for _, v in order], np.float64)

    @F.arrow_udf("struct<dist:double,cluster:int>")
    def run(vectors: pa.Array) -> pa.Array:
        d = _sums(vectors, c, True)
        if digits is not None:
            d = np.round(d, digits)
        at = d.argmin(1)
        return pa.StructArray.from_arrays([pa.array(d[np.arange(len(d)), at]), pa.array(numbers[at])], ["dist", "cluster"])

    return run(vector)


def novelty(vector: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """1 - the largest dot product with a baseline centroid. Vectors are not null."""
    c = np.array(centroids, np.float64)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        return pa.array(1.0 - _sums(vectors, c, False).max(1))

    return run(vector)
