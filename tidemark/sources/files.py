"""Files: partitioned tables, replay logs as JSON lines, and trade reports with many spellings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a replay log; ``data`` is the event's own JSON.
REPLAY = "kind string, ts timestamp, symbol string, data string"
#: Other names of a trade report's columns.
ALIASES = {"pnl": ("pnl", "profit", "realized_pnl"), "qty": ("qty", "quantity", "size"), "ts": ("ts", "timestamp", "time"), "symbol": ("symbol", "pair")}


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], rows_a_file: int = 5_000_000) -> None:
    """A Parquet table in folders of ``by``; a folder's rows are dealt over tasks, so a large one is no hot task."""
    df.write.option("maxRecordsPerFile", rows_a_file).partitionBy(*by).parquet(path)


def collect_files(spark: SparkSession, paths: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """Several Parquet tables of the same columns as one table, one row a key: that of the least ``order``."""
    df = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths])
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("_row")).select(*keys, "_row.*")


def write_replay(events: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """Events (``session`` and the columns of ``REPLAY``) as gzipped JSON lines, a folder a session."""
    events.write.option("compression", "gzip").option("maxRecordsPerFile", rows_a_file).partitionBy("session").json(path)


def read_replay(spark: SparkSession, path: str, kinds: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The log's events of some kinds (none given: all) from ``start`` up to ``end``; lines that are no JSON are left out."""
    df = spark.read.schema(f"{REPLAY}, session string").option("mode", "DROPMALFORMED").json(path)
    df = df.where(F.col("kind").isin(*kinds)) if kinds else df
    df = df.where(F.col("ts") >= F.lit(start)) if start else df
    return df.where(F.col("ts") <= F.lit(end)) if end else df


def replay_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a log, newest first, from the names of their folders."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "session=([^/]+)/", 1).alias("session"))
    return names.where("session <> ''").groupBy("session").agg(F.count("*").alias("files")).orderBy(F.desc("session"))


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Renames columns to the names that reports use; of several spellings the first that is not null counts, of none null."""
    known = {s for spellings in aliases.values() for s in spellings}
    found = {name: [F.col(s) for s in spellings if s in df.columns] for name, spellings in aliases.items()}
    named = [(F.coalesce(*columns) if columns else F.lit(None).cast("string")).alias(name) for name, columns in found.items()]
    return df.select(*[c for c in df.columns if c not in known], *named)
