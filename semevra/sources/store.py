"""Snapshot-versioned store: immutable Parquet parts under JSON manifests.

A manifest lists each part's path, partition (tenant bucket, day window, generation), rows, time range and per-tenant
statistics, so that a reader prunes parts before it opens any, and a pinned snapshot never changes. A commit creates the next
manifest, which only one writer can, and that alone makes it current: CURRENT says from which number on to look. All files go through Hadoop's file system, so the root may be any shared folder.
"""

from __future__ import annotations

import functools
import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from semevra.functions.codebook import Codebook
from semevra.functions.hashing import content_id, day_window, tenant_bucket
from semevra.model import BUCKETS, DAY_MS, EVENT, EngineError
from semevra.session import broadcast_if_small

#: Rows of one file of a part, about; a task sorts as many.
PART_FILE_ROWS = 250_000
ROW = P.StructType([*EVENT.fields, P.StructField("vector", P.ArrayType(P.FloatType())), P.StructField("centroid", P.IntegerType()), P.StructField("code", P.BinaryType())])


class Files:
    """A few operations of Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _local(self, path: Any) -> str | None:
        """The path on this machine, if the file system is its own; Hadoop's calls are not atomic there."""
        uri = self.fs.makeQualified(path).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def _temporary(self, name: str, text: str) -> Any:
        temp = self.path(f"{name}.{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        return temp

    def write(self, name: str, text: str) -> None:
        """The file appears, or replaces another, whole or not at all; at no time is there none."""
        temp, final = self._temporary(name, text), self.path(name)
        local = self._local(temp)
        if local:
            os.replace(local, self._local(final))
            self.fs.delete(temp, False)  # its checksum
            return
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        one = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        one[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(temp, final, one)

    def create(self, name: str, text: str) -> bool:
        """The file appears whole; False, and nothing changes, if there is one of that name. One of several writers succeeds."""
        temp, final = self._temporary(name, text), self.path(name)
        local = self._local(temp)
        try:
            if local is None:
                return self.fs.rename(temp, final)
            try:
                os.link(local, self._local(final))
                return True
            except FileExistsError:
                return False
        finally:
            self.fs.delete(temp, False)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str) -> list[tuple[str, int]]:
        """(name, modification time in ms)."""
        if not self.exists(name):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.path(name))]

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Snapshot:
    id: int
    data: dict

    @property
    def parts(self) -> list[dict]:
        return self.data["parts"]

    @property
    def tombstones(self) -> list[str]:
        return self.data["tombstones"]

    @property
    def active(self) -> str | None:
        return self.data["active"]

    def space(self, generation: str) -> str:
        g = self.data["generations"][generation]
        return f"{g['model_id']}:{g['model_version']}"


class Store:
    """``init`` makes one; ``Store(spark, root)`` opens it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        if not self.files.exists("config.json"):
            raise EngineError(f"no store at {root}")
        self.config = json.loads(self.files.read("config.json"))

    @classmethod
    def init(cls, spark: SparkSession, root: str, **config: Any) -> Store:
        files = Files(spark, root)
        if files.exists("config.json"):
            raise EngineError(f"{root} holds a store already")
        config = {"dim": 64, "nlist": 32, "pq_m": 8, "seed": 42, "restarts": 8, "buckets": BUCKETS, "window_ms": DAY_MS, "promoted": {}} | config
        if config["dim"] % config["pq_m"]:
            raise EngineError("pq_m must divide dim")
        files.write("config.json", json.dumps(config))
        store = cls(spark, root)
        store._put({"parts": [], "active": None, "generations": {}, "bridges": [], "baselines": {}, "tombstones": [], "batch": -1, "parent": None}, 0)
        return store

    def _put(self, data: dict, number: int) -> Snapshot:
        if not self.files.create(f"snapshots/{number:010d}.json", json.dumps(data | {"id": number, "at": int(time.time() * 1000)})):
            raise EngineError("the snapshot has moved on; one writer at a time")
        self.files.write("CURRENT", str(number))
        return Snapshot(number, data)

    def snapshot(self, number: int | None = None) -> Snapshot:
        if number is None:
            number = int(self.files.read("CURRENT"))
            while self.files.exists(f"snapshots/{number + 1:010d}.json"):  # a writer died before it could say so
                number += 1
        name = f"snapshots/{number:010d}.json"
        if not self.files.exists(name):
            raise EngineError(f"snapshot {number} has been reclaimed")
        return Snapshot(number, json.loads(self.files.read(name)))

    def commit(self, base: Snapshot, **change: Any) -> Snapshot:
        """The next snapshot; refuses if another writer came first."""
        if self.snapshot().id != base.id:
            raise EngineError("the snapshot has moved on; one writer at a time")
        return self._put(base.data | change | {"parent": base.id}, base.id + 1)

    # Parts -------------------------------------------------------------------------------------------------------------

    def partitioned(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"bucket": tenant_bucket(F.col("tenant_id"), self.config["buckets"]), "window": day_window(F.col("event_time"), self.config["window_ms"])})

    def _salts(self, n: int) -> list[int]:
        """For each of ``n`` partitions a number that a hash partitioning of so many puts there, so that none is hit twice."""
        count = 32 * n
        while True:
            i = F.col("id").cast("int")
            got = self.spark.range(count).groupBy(F.pmod(F.hash(i), F.lit(n)).alias("p")).agg(F.min(i).alias("salt")).collect()
            if len(got) == n:
                return [r.salt for r in sorted(got, key=lambda r: r.p)]
            count *= 2

    def _placed(self, df: DataFrame) -> DataFrame:
        """``df`` shuffled once, with ``_place``: a task holds one file of a large part, or several small parts. All rows of an id lie
        in one place of their part."""
        sizes = sorted((r.bucket, r.window, r["count"]) for r in df.groupBy("bucket", "window").count().collect())  # one row a part
        places: list[tuple[int, int, list[int]]] = []
        used, room = 0, 0
        for bucket, window, rows in sizes:
            files = -(-rows // PART_FILE_ROWS)
            if files > 1 or rows > room:
                used, room = used + files, PART_FILE_ROWS if files == 1 else 0
            room -= rows if files == 1 else 0
            places.append((bucket, window, list(range(used - files, used))))
        salts = self._salts(max(1, used))
        table = self.spark.createDataFrame([(b, w, [salts[i] for i in x]) for b, w, x in places], "bucket int, window long, _salts array<int>")
        at = F.pmod(F.xxhash64("event_id"), F.size("_salts")).cast("int") + 1
        return df.join(F.broadcast(table), ["bucket", "window"]).withColumn("_place", F.element_at("_salts", at)).drop("_salts").repartition(max(1, used), "_place")

    def write_parts(
        self, df: DataFrame, generation: str, redacted: bool = False, shuffle: bool = True, columns: Sequence[str] = (),
        reduce: Callable[[DataFrame], DataFrame] | None = None
    ) -> list[dict]:
        """One part for each partition of ``df``, rows in (centroid, event_time, event_id) order; their manifest entries.

        A part has a file for each PART_FILE_ROWS rows, so a hot tenant's day is written by many tasks. Rows are shuffled once, or
        not at all without ``shuffle``, for rows that lie by part already. ``reduce`` drops rows, by further ``columns``, where they
        lie after the shuffle. Statistics come from one more pass over a few columns of what was written.
        """
        name = f"parts/{uuid.uuid4().hex}"
        out = self.promote(self.partitioned(df.select(*ROW.fieldNames(), *columns)))
        if shuffle:
            out = self._placed(out)
            out = (reduce(out) if reduce else out).drop("_place", *columns)
        out = out.sortWithinPartitions("bucket", "window", "centroid", "event_time", "event_id")
        out.write.option("maxRecordsPerFile", 2 * PART_FILE_ROWS).partitionBy("bucket", "window").parquet(f"{self.root}/{name}")
        written = self.spark.read.parquet(f"{self.root}/{name}").select("bucket", "window", "tenant_id", "event_time", "cost", "error", "centroid")
        stats = written.groupBy("bucket", "window", "tenant_id").agg(
            F.count("*").alias("rows"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"), F.min("cost").alias("cost_lo"),
            F.max("cost").alias("cost_hi"), F.max("error").alias("has_error"), F.max(~F.col("error")).alias("has_success"),
            F.collect_set("centroid").alias("lists")
        )
        parts: dict[tuple, dict] = {}
        for r in stats.collect():  # one row a part and tenant
            p = parts.setdefault(
                (r.bucket, r.window),
                {
                    "path": f"{name}/bucket={r.bucket}/window={r.window}", "bucket": r.bucket, "window": r.window, "generation": generation,
                    "redacted": redacted, "rows": 0, "tenants": {}
                }
            )
            p["rows"] += r.rows
            p["tenants"][r.tenant_id] = {
                "rows": r.rows, "lo": r.lo, "hi": r.hi, "cost": [r.cost_lo, r.cost_hi], "has_error": r.has_error, "has_success": r.has_success, "lists": f"{sum(1 << x for x in r.lists):x}"
            }
        return [parts[k] for k in sorted(parts)]

    def promote(self, df: DataFrame) -> DataFrame:
        """Configured attribute keys as typed columns attr.<key>, taken out of the map; a second type under a key is refused."""
        forms = {"str": ("s", (1,)), "num": ("d", (2, 3)), "bool": ("b", (4,))}
        for key, family in self.config["promoted"].items():
            slot, tags = forms[family]
            a = F.col("attributes")[key]
            value = F.when(a["tag"] == 2, a["i"].cast("double")).otherwise(a["d"]) if family == "num" else a[slot]
            wrong = a["tag"].isNotNull() & ~a["tag"].isin(*tags)
            df = df.withColumn(
                f"attr.{key}",
                F.when(
                    wrong, F.raise_error(F.lit(f"two types under promoted key {key!r}")).cast({"str": "string", "num": "double", "bool": "boolean"}[family])
                ).otherwise(value)
            )
        if self.config["promoted"]:
            df = df.withColumn("attributes", F.map_filter("attributes", lambda k, _: ~k.isin(*self.config["promoted"])))
        return df

    def prune(
        self, snap: Snapshot, tenant: str | None = None, lo: int | None = None, hi: int | None = None, space: str | None = None,
        generations: list[str] | None = None, lists: list[int] | None = None
    ) -> list[dict]:
        """Parts that may hold rows of the tenant in the inclusive time range, and of the coarse lists."""
        keep = []
        wanted = None if lists is None else sum(1 << int(x) for x in set(lists))
        for p in snap.parts:
            if space and snap.space(p["generation"]) != space or generations and p["generation"] not in generations:
                continue
            stats = p["tenants"].values() if tenant is None else [p["tenants"][tenant]] if tenant in p["tenants"] else []
            if any((lo is None or s["hi"] >= lo) and (hi is None or s["lo"] <= hi) and (wanted is None or wanted & int(s.get("lists", "") or "-1", 16)) for s in stats):
                keep.append(p)
        return keep

    def read(self, parts: list[dict], snap: Snapshot | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of the parts, by their paths alone, less the snapshot's tombstones. Each row carries its generation."""
        schema = P.StructType(
            [
                *ROW.fields,
                *[
                    P.StructField(
                        f"attr.{k}", {"str": P.StringType(), "num": P.DoubleType(), "bool": P.BooleanType()}[f]
                    ) for k, f in self.config["promoted"].items()
                ]
            ]
        )
        if not parts:
            return self.spark.createDataFrame([], P.StructType([*schema.fields, P.StructField("generation", P.StringType())]))
        out: DataFrame | None = None
        for g in sorted({p["generation"] for p in parts}):
            paths = [f"{self.root}/{p['path']}" for p in parts if p["generation"] == g]
            df = self.spark.read.schema(schema).parquet(*paths).withColumn("generation", F.lit(g))
            out = df if out is None else out.unionByName(df)
        return self.alive(out, snap) if snap is not None else out

    def alive(self, df: DataFrame, snap: Snapshot) -> DataFrame:
        """``df`` less the deleted ids, those in the manifest and those in tables."""
        if snap.tombstones:
            dead = self.spark.createDataFrame([(x,) for x in snap.tombstones], "event_id string")
            df = df.join(broadcast_if_small(dead), "event_id", "left_anti")
        for t in snap.data.get("tombstone_tables", []):
            df = df.join(self.spark.read.schema("event_id string").parquet(f"{self.root}/{t}"), "event_id", "left_anti")
        return df

    def dead(self, df: DataFrame, snap: Snapshot) -> DataFrame | None:
        """The rows of ``df`` that ``alive`` would take out; None if the snapshot has no deletes."""
        ids = [self.spark.createDataFrame([(x,) for x in snap.tombstones], "event_id string")] if snap.tombstones else []
        ids += [self.spark.read.schema("event_id string").parquet(f"{self.root}/{t}") for t in snap.data.get("tombstone_tables", [])]
        return df.join(functools.reduce(DataFrame.unionByName, ids), "event_id", "left_semi") if ids else None

    def restore(self, df: DataFrame) -> DataFrame:
        """Event rows with promoted attributes back in the map."""
        for key, family in self.config["promoted"].items():
            c = F.col(f"`attr.{key}`")
            tag = {"str": 1, "num": 3, "bool": 4}[family]
            value = F.struct(
                F.lit(tag).cast("byte").alias("tag"), (c if family == "str" else F.lit(None).cast("string")).alias("s"), F.lit(None).cast("long").alias("i"),
                (c if family == "num" else F.lit(None).cast("double")).alias("d"), (c if family == "bool" else F.lit(None).cast("boolean")).alias("b")
            )
            df = df.withColumn(
                "attributes",
                F.when(
                    c.isNotNull(),
                    F.map_concat(
                        F.coalesce("attributes", F.create_map().cast("map<string,struct<tag:tinyint,s:string,i:bigint,d:double,b:boolean>>")),
                        F.create_map(F.lit(key), value)
                    )
                ).otherwise(F.col("attributes"))
            ).drop(f"attr.{key}")
        return df

    # Generations -------------------------------------------------------------------------------------------------------

    def put_generation(self, model_id: str, version: str, book: Codebook) -> tuple[str, dict]:
        entry = {"model_id": model_id, "model_version": version, "dim": book.dim, "coarse": book.coarse.tolist(), "pq": book.pq.tolist()}
        number = content_id(json.dumps(entry, sort_keys=True).encode())
        self.files.write(f"generations/{number}.json", json.dumps(entry))
        return number, {"model_id": model_id, "model_version": version, "dim": book.dim, "state": "candidate"}

    def codebook(self, generation: str) -> Codebook:
        g = json.loads(self.files.read(f"generations/{generation}.json"))
        return Codebook(np.array(g["coarse"], np.float32), np.array(g["pq"], np.float32))


def encode(df: DataFrame, book: Codebook) -> DataFrame:
    """``df`` (with vector) with the centroid and PQ code of each row, by Arrow batches; columns of those names are replaced."""
    held = df.sparkSession.sparkContext.broadcast(book)

    @F.arrow_udf("struct<centroid:int,code:binary>")
    def run(vectors: pa.Array) -> pa.Array:
        x = np.array(vectors.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, held.value.dim)
        return pa.StructArray.from_arrays([pa.array(held.value.assign(x)), pa.array([c.tobytes() for c in held.value.encode(x)], pa.binary())], ["centroid", "code"])

    e = df.drop("centroid", "code").withColumn("_e", run("vector"))
    return e.select("*", F.col("_e.centroid").alias("centroid"), F.col("_e.code").alias("code")).drop("_e")
