"""Books as keyed state against a plain loop: snapshots, stale and late rows, deletions, depth, days, restarts."""

import datetime as dt

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.plans.state_queries import replayed_updates
from tidemark.sources import adapters as A
from tidemark.streaming import books

SCHEMA = "symbol string, kind string, update_id long, ts timestamp, book_side string, price double, qty double"
NOON = dt.datetime(2024, 1, 1, 12)


def at(hours):
    return NOON + dt.timedelta(hours=hours)


def loop(rows, depth):
    """Each symbol's book, by dictionaries."""
    out = {}
    for symbol in {r[0] for r in rows}:
        book, last, ready, applied, stale, ignored, today, day = {"bid": {}, "ask": {}}, -1, False, 0, 0, 0, 0, None
        own = sorted((r for r in rows if r[0] == symbol and r[2] is not None), key=lambda r: (r[2], r[1]))
        for number, kind in sorted({(r[2], r[1]) for r in own}):
            part = [r for r in own if (r[2], r[1]) == (number, kind)]
            d = max(r[3] for r in part).date()
            if day is None or d > day:
                today, day = 0, d
            if kind == "snapshot":
                book, last, ready = {"bid": {}, "ask": {}}, number, True
            elif not ready:
                ignored += 1
                continue
            elif number <= last:
                stale += 1
                continue
            else:
                last, applied, today = number, applied + 1, today + 1
            for _, _, _, _, side, price, qty in part:
                book[side].pop(price, None)
                if qty > 0:
                    book[side][price] = qty
            for side, best in (("bid", True), ("ask", False)):
                book[side] = {p: book[side][p] for p in sorted(book[side], reverse=best)[:depth]}
        out[symbol] = (symbol, last, max(book["bid"], default=None), min(book["ask"], default=None), len(book["bid"]), len(book["ask"]), applied, stale, ignored, today)
    return out


def rows_of(df):
    return {r.symbol: tuple(r) for r in df.collect()}


def test_replay_equals_a_loop(spark):
    rows = [("a", "update", 1, at(0), "bid", 9.0, 1.0), ("a", "snapshot", 5, at(0), "ask", 20.0, 1.0)]
    rows += [("a", "snapshot", 5, at(0), "bid", 10.0 + i, 1.0 + i) for i in range(6)] + [("a", "snapshot", 5, at(0), "bid", 3.0, 0.0)]
    rows += [("a", "update", 6, at(1), "bid", 15.0, 0.0), ("a", "update", 6, at(1), "bid", 14.0, 2.0), ("a", "update", 7, at(13), "bid", 18.0, 1.0), ("a", "update", 8, at(13), "ask", 19.0, 1.0)]
    rows += [("b", "update", 3, at(0), "bid", 1.0, 1.0), ("c", "snapshot", 9, at(0), "ask", 1.0, 1.0), ("c", "update", 9, at(1), "ask", 2.0, 1.0), (None, "snapshot", 1, at(0), "bid", 1.0, 1.0)]
    df = spark.createDataFrame(rows + [("a", "update", None, at(0), "bid", 99.0, 1.0)], SCHEMA)
    assert rows_of(books.replay_books(df, 3)) == loop(rows, 3)
    assert books.replay_books(df.limit(0)).count() == 0


def test_replay_of_events_equals_a_loop(spark):
    u = replayed_updates(A.book_updates(spark, DATA)).select("symbol", "kind", "update_id", F.col("ts").cast("timestamp"), "book_side", "price", "qty")
    assert rows_of(books.replay_books(u, 5)) == loop([tuple(r) for r in u.collect()], 5)


@pytest.fixture
def store(spark):
    key, value = books.STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_stream_equals_replay_over_restarts(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    seen = []

    def run(initial=None, depth=3, place=checkpoint):
        updates = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = []
        q = (
            books.stream_books(updates, depth, "1 hour", initial).writeStream.outputMode("update").option("checkpointLocation", place)
            .foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        )
        q.awaitTermination(180)
        return {r[0]: r for r in out}, out

    def feed(*rows, late=()):
        spark.createDataFrame([*rows, *late], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        seen.extend(rows)

    feed(*[("a", "snapshot", 5, at(0), "bid", 10.0 + i, 1.0) for i in range(5)], ("a", "snapshot", 5, at(0), "ask", 30.0, 1.0), ("b", "update", 2, at(0), "bid", 1.0, 1.0))
    feed(("a", "update", 6, at(2), "bid", 14.0, 0.0), ("a", "update", 6, at(2), "ask", 29.0, 4.0))
    got, _ = run()
    assert got == loop(seen, 3)
    # Another run goes on from the checkpoint: a row behind the watermark is dropped, a stale one counted.
    feed(("a", "update", 7, at(3), "bid", 16.0, 1.0), ("b", "snapshot", 3, at(3), "ask", 2.0, 1.0), late=[("a", "update", 99, at(-5), "bid", 28.0, 1.0)])
    got, _ = run()
    assert got == loop(seen, 3)
    feed(("a", "update", 4, at(3), "bid", 17.0, 1.0))
    got, _ = run()
    assert got["a"][7] == 1 and got["a"][1:4] == (7, 16.0, 29.0)
    # The next day's rows of one symbol let the other's count start again by its timer.
    feed(("b", "update", 8, at(30), "bid", 1.5, 1.0))
    feed(("b", "update", 9, at(30), "bid", 1.6, 1.0))
    got, every = run()
    assert got["a"][9] == 0 and got["a"][6] == 2 and got["b"][9] == 2
    # Levels read from the state begin another stream, which knows where they ended.
    levels = books.recovered_levels(spark, checkpoint)
    assert {(r.symbol, r.update_id) for r in levels.collect()} == {("a", 7), ("b", 9)}
    held = spark.createDataFrame(levels.collect(), levels.schema)
    source = str(tmp_path / "next")
    feed(("a", "update", 7, at(31), "bid", 50.0, 1.0), ("a", "update", 8, at(31), "ask", 20.0, 1.0))
    got, _ = run(held, 2, str(tmp_path / "other"))
    assert got["a"][1:8] == (8, 16.0, 20.0, 2, 2, 1, 1)
