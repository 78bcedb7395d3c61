"""Domain views of the driver's tables: ticks, bars, book updates, trades and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: symbol, price, quantity and side (1: the taker buys)."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("qty"),
        (F.col("user_id") % 2).cast("int").alias("side"),
    )


def with_imbalance(ticks: DataFrame) -> DataFrame:
    """Adds ``imbalance``, from -1 to 1, as the quantity's place between 0 and 99."""
    return ticks.withColumn("imbalance", ratio(2 * F.col("qty") - 99, F.lit(99.0)))


def quotes(ticks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ticks as quotes around the price, sizes from the quantity and the side; with the ticks' columns ``keep``."""
    half = 0.0005 * F.col("price") * (1 + F.col("side"))
    return ticks.select(
        "event_id", "symbol", "ts", (F.col("price") - half).alias("bid"), (F.col("price") + half).alias("ask"), (F.col("qty") + 1).cast("double").alias("bid_size"),
        (100 - F.col("qty") + 1).cast("double").alias("ask_size"), *keep,
    )


def resample(trades: DataFrame, every: str = "hour") -> DataFrame:
    """Bars of a fixed length with open, high, low, close and volumes, one aggregation by symbol and time.

    Partial aggregation leaves a row for each bar and task, so a busy symbol is no hot task.
    """
    at = F.struct("ts", "event_id")
    q = F.col("qty").cast("double")
    return trades.groupBy("symbol", F.date_trunc(every, "ts").cast("timestamp_ntz").alias("open_time")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum(q).alias("volume"),
        F.sum(F.col("price") * q).alias("quote_volume"),
        F.count("*").alias("trades"),
        F.sum(F.when(F.col("side") == 1, q).otherwise(0.0)).alias("taker_buy_base"),
        F.sum(F.when(F.col("side") == 1, F.col("price") * q).otherwise(0.0)).alias("taker_buy_quote"),
    )


def bars(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    """Hourly bars of the ticks."""
    return resample(ticks(spark, sf_dir), every)


def book_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as level updates: the rounded price, its quantity (0 deletes) and book side."""
    return ticks(spark, sf_dir).select(
        "symbol", F.col("event_id").alias("update_id"), "ts",
        F.when(F.col("side") == 1, "bid").otherwise("ask").alias("book_side"),
        F.when(F.col("side") == 1, 100 - F.floor(F.col("price") / 10)).otherwise(101 + F.floor(F.col("price") / 10)).cast("double").alias("price"),
        F.col("qty").cast("double").alias("qty"),
    )


def trades_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed trades: the profit is the price beyond the mean of its priority."""
    o = table(spark, sf_dir, "orders")
    mean = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return o.join(mean, "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"),
        F.round(F.col("o_totalprice") - F.col("mean"), 2).alias("pnl"), F.col("o_totalprice").alias("notional"), F.col("o_custkey").alias("version"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills; side 1 buys, -1 sells."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"),
    )
