"""Streaming twins: bars by event time, the order book as keyed state, and deduplication."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
BOOK = "symbol string, last_update_id bigint, best_bid double, best_ask double, bid_levels int, ask_levels int, stale int"


def read_events(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of event files as trades; times become timestamps, which watermarks need."""
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return e.select(
        "event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("qty"), (F.col("user_id") % 2).cast("int").alias("side"),
    )


def stream_bars(trades: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars; trades later than the watermark are dropped, and a bar is final once it passes."""
    at = F.struct("ts", "event_id")
    q = F.col("qty").cast("double")
    return trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", every)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(q).alias("volume"), F.count("*").alias("trades"),
    ).select("symbol", F.col("window.start").alias("open_time"), "open", "high", "low", "close", "volume", "trades")


def stream_sessions(trades: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of each symbol, ended by a gap."""
    return trades.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def deduplicated(trades: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _book(depth: int):
    def update(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        levels, last, stale = state.get if state.exists else ([], -1, 0)
        book = {(side, price): qty for side, price, qty in levels}
        rows, current, old = pd.concat(list(batches)).sort_values("update_id", kind="stable"), None, False
        for side, price, qty, number in zip(rows["book_side"], rows["price"], rows["qty"], rows["update_id"], strict=True):
            if number != current:
                current, old = int(number), number <= last
                stale += int(old)
                last = max(last, current)
            if old:
                continue
            if qty > 0:
                book[side, float(price)] = float(qty)
            else:
                book.pop((side, float(price)), None)
            for own, sign in (("bid", -1), ("ask", 1)):
                held = sorted((p for s, p in book if s == own), key=lambda p: sign * p)
                for p in held[depth:]:
                    del book[own, p]
        bids, asks = ([p for s, p in book if s == own] for own in ("bid", "ask"))
        state.update(([(s, p, q) for (s, p), q in book.items()], last, stale))
        yield pd.DataFrame(
            {"symbol": [key[0]], "last_update_id": [last], "best_bid": [max(bids, default=None)], "best_ask": [min(asks, default=None)], "bid_levels": [len(bids)], "ask_levels": [len(asks)], "stale": [stale]}
        )

    return update


def stream_book(updates: DataFrame, depth: int = 20) -> DataFrame:
    """Each symbol's book, updated in order of update number; stale updates are counted and skipped whole.

    All levels of an update have its number, and come in one micro-batch.

    ``updates`` has symbol, update_id, book_side, price and qty.  The state of a symbol is bounded:
    at most ``depth`` levels a side.
    """
    state = "levels array<struct<side:string,price:double,qty:double>>, last bigint, stale int"
    return updates.groupBy("symbol").applyInPandasWithState(_book(depth), BOOK, state, "update", "NoTimeout")
