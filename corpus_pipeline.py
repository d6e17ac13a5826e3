"""A training-corpus pipeline of five stages: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. SQL cannot express them; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semevra.llm import decontamination, minhash, packing, quality, substrings
from semevra.llm.substrings import row_key
from semevra.session import broadcast_if_small, fresh, materialise

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``docs`` but the rows whose ``column`` is in the one column of ``ids``; rows that have none stay."""
    gone = fresh(docs, "gone")
    ids = materialise(ids.toDF(gone).distinct())
    return docs.join(broadcast_if_small(ids), F.col(column) == F.col(gone), "left_anti")


def _by_text(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column whose value tells documents apart: doc_id where each id has one text, else a further column that
    numbers the texts of all ids in the order of ids. Rows without an id have none."""
    key, number, other = (fresh(docs, c) for c in ("text_key", "number", "other"))
    texts = docs.filter("doc_id is not null").select("doc_id", F.coalesce(row_key(F.col("text").cast("string")), F.lit(-1).cast("long")).alias(key))
    if texts.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a < b").isEmpty():
        return docs, "doc_id"
    numbers = materialise(texts.distinct().sort("doc_id", key).withColumn(number, F.monotonically_increasing_id()).withColumnRenamed("doc_id", other))
    same = (F.col("doc_id") == F.col(other)) & (F.coalesce(row_key(F.col("text").cast("string")), F.lit(-1).cast("long")) == F.col(key))
    return docs.join(numbers, same, "left").drop(other, key), number


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the hierarchical quality model keeps. It is fitted to the labelled rows of the table documents.

    Each row is judged by its own whole text, null, empty and very long ones like any other, and equal rows alike; an empty table
    stays empty.
    """
    model = quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).filter("keep").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near or exact copies. Texts that share an id are documents of their
    own; of rows that repeat an id and its text one stays; rows without an id stay. Null and empty texts are no copies of each
    other. Very long texts are taken whole. An empty table stays empty."""
    named, number = _by_text(docs)
    rest = _without(named, minhash.near_duplicates(named, id_col=number).select("doc_id"), number)
    again, place = fresh(named, "again"), fresh(named, "place")
    ids = materialise(rest.groupBy(number).agg(F.count("*").alias("n")).filter(f"n > 1 and `{number}` is not null").select(F.col(number).alias(again)))
    ids = broadcast_if_small(ids)
    once = rest.join(ids, F.col(number) == F.col(again), "left_anti")
    twice = rest.join(ids, F.col(number) == F.col(again), "left_semi")
    order = Window.partitionBy(number).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")], "text")
    one = twice.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return once.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of 50 words or more that a document of lesser id has. Texts that share an id are one
    document with coordinates of their own. Null and empty texts and rows without an id stay; very long texts are taken whole;
    equal rows are cut alike. An empty table stays empty."""
    return substrings.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; of an id with several texts those texts that hold none. Null and empty texts
    and rows without an id stay; very long texts are searched whole; equal rows go or stay together. An empty table stays empty."""
    named, number = _by_text(docs)
    found = decontamination.leaks(named, _table(spark, sf_dir, "benchmark"), id_col=number)
    return _without(named, found.select("doc_id"), number).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every document, or of each of its pieces. Texts that share an id are one document of their summed words; null
    and empty texts are placed with 0 words; a very long text is cut into pieces. An empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table documents."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
