"""Session-level helpers shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

#: Largest size, in bytes, of a side that an operator broadcasts; beyond it the join shuffles.
BROADCAST_LIMIT = 32 << 20
#: Bytes that a row takes in a hashed relation beside its values.
ROW_OVERHEAD = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file:///tmp/semevra-checkpoint"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_TABLES: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the driver's Python ends, if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/semevra-{uuid.uuid4().hex}"
    _TABLES[path] = spark
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._semevra_table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the table of a materialised ``df`` of which nothing unread depends any more; other DataFrames stay as they are."""
    path = getattr(df, "_semevra_table", None)
    if path and _TABLES.pop(path, None) is not None:
        _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in _TABLES.items():
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, path)


def _width(t: P.DataType) -> int | None:
    """Bytes of a value of fixed size, None for one of variable size."""
    if isinstance(t, P.StructType):
        each = [_width(f.dataType) for f in t.fields]
        return None if None in each else sum(each)
    return None if isinstance(t, (P.StringType, P.BinaryType, P.ArrayType, P.MapType)) else 16 if isinstance(t, P.DecimalType) else 8


def _bytes(c: Column, t: P.DataType) -> Column:
    w = _width(t)
    if w is not None:
        return F.lit(w).cast("long")
    if isinstance(t, P.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in t.fields), F.lit(0).cast("long"))
    if isinstance(t, P.MapType):
        return _bytes(F.map_entries(c), P.ArrayType(P.StructType([P.StructField("key", t.keyType), P.StructField("value", t.valueType)])))
    if isinstance(t, P.ArrayType):
        w = _width(t.elementType)
        n = F.size(c).cast("long") * w if w is not None else F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + _bytes(x, t.elementType))
        return F.coalesce(n, F.lit(0)) + 16
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its measured size, of all its values, fits ``limit``; else ``df`` as it is."""
    w = _width(df.schema)
    if w is not None:
        cap = limit // (w + ROW_OVERHEAD)
        return F.broadcast(df) if df.limit(cap + 1).count() <= cap else df
    size = df.select(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_OVERHEAD).cast("long")).alias("n")).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


#: Bytes of an Arrow batch on its way to a Python worker.
ARROW_BATCH = "8m"


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch size to ARROW_BATCH if it still has Spark's default, which is meant for narrow rows:
    batches of whole texts otherwise take tens of MB twice, in the JVM and in the worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "67108864", "64m"):
        conf.set(name, ARROW_BATCH)
