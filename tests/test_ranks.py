"""Means that are compared with one another are added in the order that the SQL adds them in."""

import os
import random

import duckdb
import pandas as pd
from compare import TABLES, database
from pyspark.sql import functions as F

from tidemark.functions.windows import blocked_mean, ordered
from tidemark.plans import catalog

BIG = "/root/testdata/sf0.1"


def test_blocked_means_have_the_bits_of_sql(spark):
    random.seed(3)
    rows = pd.DataFrame([(k, i, random.randrange(1001) / 1000) for k, n in (("a", 700), ("b", 49), ("c", 51), ("d", 1)) for i in range(n)], columns=["symbol", "bar", "x"])
    df = spark.createDataFrame(rows)
    for n in (1, 7, 16, 20, 50, 64):
        got = sorted((r.symbol, r.bar, r.m) for r in df.withColumn("m", blocked_mean(F.col("x"), n, ordered("symbol", "bar"))).collect() if r.m is not None)
        f = f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        want = duckdb.sql(f"SELECT * FROM (SELECT symbol, bar, CASE WHEN count(*) OVER {f} = {n} THEN avg(x) OVER {f} END AS m FROM rows) WHERE m IS NOT NULL ORDER BY ALL").fetchall()
        assert got == want


def test_ranks_of_vpin_equal_sql(spark):
    got = sorted(tuple(r) for r in catalog.QUERIES["vpin"](spark, BIG).select("symbol", "bar", "vpin", "vpin_cdf", "regime").collect())
    want = database(BIG).execute(f"SELECT symbol, bar, vpin, vpin_cdf, regime FROM ({catalog.ORACLE_SQL['vpin']}) ORDER BY symbol, bar").fetchall()
    assert got == want


def test_toxicity_equals_sql(spark):
    columns = "event_id, symbol, ts, toxicity, toxicity_z, regime"
    got = sorted(tuple(r) for r in catalog.QUERIES["toxicity"](spark, BIG).selectExpr(*columns.split(", ")).collect())
    assert got == database(BIG).execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL['toxicity']}) ORDER BY event_id").fetchall()


def test_toxicity_of_repeated_and_missing_ids_equals_sql(spark, tmp_path):
    """Impact stands beside its tick; ids that several ticks share, or that are null, neither multiply nor drop rows."""
    events = f"SELECT * FROM '{BIG.removesuffix('0.1')}0.01/events.parquet'"
    for table in TABLES:
        if table != "events":
            os.symlink(f"{BIG}/{table}.parquet", tmp_path / f"{table}.parquet")
    shifted = "e.* REPLACE (CASE WHEN event_id % 1000 <> 7 THEN event_id END AS event_id, ts + to_days(CAST(40 * k AS INTEGER)) AS ts)"
    duckdb.sql(f"COPY (SELECT {shifted} FROM ({events}) e, range(3) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    columns = "ts, symbol, event_id, adverse, pin, informed, toxicity, toxicity_z, regime"
    got = [tuple(r) for r in catalog.QUERIES["toxicity"](spark, str(tmp_path)).selectExpr(*columns.split(", ")).orderBy("ts").collect()]
    assert got == database(tmp_path).execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL['toxicity']}) ORDER BY ts").fetchall()
