"""A corpus pipeline of five stages: classify, dedup lines and documents, mix, and encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import digests, encode
from tidemark.llm.common import stored, table
from tidemark.llm.lines import site_line_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near import drop_near_duplicates
from tidemark.llm.quality import keep_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; n_chars follows the text."""
    return site_line_dedup(docs).select(
        "doc_id", "text", "lang", "source", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("bigint").alias("n_chars")
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources make up equal shares, in a global shuffle."""
    return mix_sources(docs).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and digests of them and of the bytes that they decode to."""
    return digests(encode(docs))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("bpe", bpe)]

#: SQL can't express the classifier, so tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
