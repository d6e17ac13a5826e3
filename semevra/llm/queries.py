"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents: every document is scored, those at 0.5 or more are returned."""
    from semevra.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels"))).filter("toxic")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_doc_id) for every near or exact copy."""
    from semevra.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, with the posteriors of host, path and document."""
    from semevra.llm import quality

    docs = table(spark, sf_dir, "documents")
    out = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).filter("keep")
    return out.select(
        "doc.doc_id", "host", "path", F.round("host_quality", 6).alias("host_quality"), F.round("path_quality", 6).alias("path_quality"),
        F.round("quality", 6).alias("quality"), "keep"
    )


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from semevra.llm import html

    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in the ChatML template, with the ranges of what the assistant says."""
    from semevra.llm import chat

    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document; documents of one source and language stay together."""
    from semevra.llm import sharding

    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, share) of the documents that hold benchmark items."""
    from semevra.llm import decontamination

    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of 50 words or more that several documents have, with its coordinates in each."""
    from semevra.llm import substrings

    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every document."""
    from semevra.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, kept_vec_id) for every near copy among the embeddings."""
    from semevra.llm import neighbours

    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def _oracle_chat() -> str:
    from semevra.llm import chat

    return chat.CHATML_SQL


def _oracle_substrings() -> str:
    from semevra.llm import substrings

    return substrings.ORACLE_SQL


QUERIES = {
    f.__name__: f for f in (
        op1_html_extraction, op2_toxicity, op3_chat_format, op4_minhash_dedup, op5_sharding, op6_quality, op7_decontamination, op8_substring_dedup, op9_packing,
        op10_embedding_dedup
    )
}
ORACLE: dict[str, str] = {"op3_chat_format": _oracle_chat(), "op8_substring_dedup": _oracle_substrings()}
