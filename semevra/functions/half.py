"""Half-precision floats: what a vector is worth once it is stored in 16 bits a number, and the two codecs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as P


def half(x: Column) -> Column:
    """``x`` (double) rounded to the nearest half float, ties to even, as a double; generated code, no Python.

    Beyond the largest half float it is infinite; infinities and NaN stay, as do nulls.
    """
    a = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(a)), F.lit(-14)) - 10)
    rounded = F.when(a == 0, x).otherwise(F.bround(x / step) * step)
    out = F.when(a >= 65520.0, F.signum(x) * float("inf")).otherwise(rounded)
    return F.when(F.isnan(x), x).otherwise(out)


def halves(vector: Column) -> Column:
    """A vector as half floats would hold it."""
    return F.transform(vector, lambda x: half(x.cast("double")))


@F.arrow_udf(P.BinaryType())
def packed(vectors: pa.Array) -> pa.Array:
    """Vectors of floats as little-endian half floats, two bytes a number; null vectors stay null."""
    valid = vectors.is_valid()
    with np.errstate(over="ignore"):
        x = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype("<f2")
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    offsets = np.r_[0, np.cumsum(2 * size.astype(np.int64))].astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])
    return pc.if_else(valid, out, pa.scalar(None, pa.binary()))


@F.arrow_udf(P.ArrayType(P.FloatType()))
def unpacked(packed: pa.Array) -> pa.Array:
    """The vectors of ``packed``; no number changes."""
    return pa.array([None if b is None else np.frombuffer(b, "<f2").astype(np.float32) for b in packed.to_pylist()], pa.list_(pa.float32()))
