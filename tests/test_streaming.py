import shutil

from conftest import DATA
from pyspark.sql import functions as F

from tidemark.sources import adapters as A
from tidemark.streaming import events as S


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_streamed_bars_and_book_equal_batch(spark, tmp_path):
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "a.parquet")
    trades = S.read_events(spark, str(tmp_path))
    run(S.stream_bars(trades), "bars", "complete")
    batch = A.bars(spark, DATA).select("symbol", F.col("open_time").cast("timestamp"), "open", "high", "low", "close", "volume", "trades")
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, batch.collect()))
    side = F.when(F.col("side") == 1, "bid").otherwise("ask")
    updates = trades.select("symbol", F.col("event_id").alias("update_id"), side.alias("book_side"), F.round("price").alias("price"), F.col("qty").cast("double").alias("qty"))
    run(S.stream_book(updates, depth=1000), "book", "update")
    got = {r.symbol: (r.best_bid, r.best_ask) for r in spark.table("book").collect()}
    u = A.ticks(spark, DATA).select("symbol", F.col("event_id").alias("update_id"), side.alias("book_side"), F.round("price").alias("price"), F.col("qty").cast("double").alias("qty"))
    from tidemark.operators.flow import book_levels

    best = book_levels(u, 1000).groupBy("symbol").agg(F.max(F.when(F.col("book_side") == "bid", F.col("price"))), F.min(F.when(F.col("book_side") == "ask", F.col("price"))))
    assert got == {r[0]: (r[1], r[2]) for r in best.collect()}
