"""Windows over stretches of time give what they give over whole keys, and spread a hot key."""

import datetime as dt
import random

from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_stretches, running_total, stretched
from tidemark.operators import flow
from tidemark.sources import adapters as A

START = dt.datetime(2024, 1, 1)


def sample(spark):
    random.seed(1)
    rows = []
    for key, n in (("hot", 900), ("thin", 40), ("one", 1), (None, 30)):
        at = 0
        for _ in range(n):
            # Ties, gaps, and bursts that leave some stretches with a single row.
            at += random.choice([0, 0, 1, 2, 3, 500 if key == "hot" else 5])
            rows.append((key, START + dt.timedelta(seconds=at), len(rows), random.random(), len(rows) % 7))
    rows.append(("hot", None, len(rows), 0.5, 1))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, event_id long, x double, qty long")


def test_stretches_change_nothing(spark):
    df = sample(spark)

    def rolling(reach):
        w = Window.partitionBy("symbol").orderBy("ts", "event_id")
        return lambda d: d.select("symbol", "ts", "event_id", F.sum("x").over(w.rowsBetween(-reach, 0)).alias("s"), F.lag("x", reach).over(w).alias("b"), F.count("*").over(w.rowsBetween(-reach, 0)).alias("n"))

    for reach in (1, 5, 60):
        want = sorted(((r.event_id, r.symbol, r.ts, round(r.s, 9), r.b, r.n) for r in rolling(reach)(df).collect()))
        for rows in (7, 50, 10**6):
            got = by_stretches(df, rolling(reach), reach, rows=rows)
            assert sorted(((r.event_id, r.symbol, r.ts, round(r.s, 9), r.b, r.n) for r in got.collect())) == want
    assert by_stretches(df.limit(0), rolling(3), 3).count() == 0


def test_running_total(spark):
    df = sample(spark)
    w = Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted((r.event_id, r.t) for r in df.withColumn("t", F.sum(F.col("qty").cast("double")).over(w)).collect())
    for rows in (7, 10**6):
        assert sorted((r.event_id, r.t) for r in running_total(df, F.col("qty").cast("double"), "t", rows=rows).collect()) == want


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"))
    parts = stretched(df, rows=1000).where("symbol = 'hot'").groupBy("_stretch").count().collect()
    assert len(parts) == 18 and max(r["count"] for r in parts) <= 1001


def test_tick_queries_over_stretches(spark):
    t = A.with_imbalance(A.ticks(spark, DATA))
    for frame, operator, reach in ((A.quotes(t), flow.quote_flow, 100), (t, flow.tick_features, 120)):
        rounded = lambda d: sorted(tuple(round(x, 7) if isinstance(x, float) else str(x) for x in r) for r in d.select("event_id", *[c for c in d.columns if c != "event_id"]).collect())
        assert rounded(by_stretches(frame, operator, reach, rows=37)) == rounded(operator(frame))
    bars = [sorted(map(str, flow.volume_bars(t, rows=r).collect())) for r in (37, 10**6)]
    assert bars[0] == bars[1]
