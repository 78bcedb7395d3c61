import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import fisher, normal_cdf
from tidemark.functions.windows import as_of, fold, run_length
from tidemark.operators import flow, portfolio, spectral
from tidemark.operators.validation import deflated_sharpe, purged_folds
from tidemark.sources.adapters import with_imbalance


def numbered(spark, values, name="x"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"symbol string, open_time int, {name} double")


def test_fold_runs_in_order_across_blocks(spark):
    values = [float(i % 7) for i in range(700)]
    got = [r.state for r in fold(numbered(spark, values), ["x"], F.lit(0.0), lambda s, r: 0.5 * s + r["x"]).orderBy("open_time").collect()]
    s, want = 0.0, []
    for v in values:
        s = 0.5 * s + v
        want.append(s)
    assert np.allclose(got, want)


def test_run_length(spark):
    got = [r.n for r in run_length(numbered(spark, [1.0, 1.0, 2.0, 1.0, 1.0, 1.0]), F.col("x"), "n").orderBy("open_time").collect()]
    assert got == [1, 2, 1, 1, 2, 3]


def test_as_of_takes_the_latest_row(spark):
    left = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("b", 5, "r")], "symbol string, ts int, id string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 20), ("a", 6, 30)], "symbol string, ts int, v int")
    loose = {r.id: r.right_v for r in as_of(left, right, ["v"]).collect()}
    strict = {r.id: r.right_v for r in as_of(left, right, ["v"], strict=True).collect()}
    assert loose == {"p": 10, "q": 20, "r": None}
    assert strict == {"p": None, "q": 20, "r": None}


def test_scalars(spark):
    r = spark.range(1).select(normal_cdf(F.lit(1.0)).alias("p"), normal_cdf(F.lit(-2.0)).alias("m"), fisher(F.lit(0.5)).alias("f")).first()
    assert math.isclose(r.p, 0.8413447, abs_tol=1e-6) and math.isclose(r.m, 0.0227501, abs_tol=1e-6) and math.isclose(r.f, math.atanh(0.5))


def test_book_deletes_and_orders_levels(spark):
    rows = [("s", 1, "bid", 50000.0, 1.0), ("s", 2, "bid", 49999.0, 2.0), ("s", 3, "ask", 50001.0, 1.5), ("s", 4, "ask", 50002.0, 2.5), ("s", 5, "bid", 49998.0, 1.0), ("s", 6, "bid", 49998.0, 0.0)]
    u = spark.createDataFrame(rows, "symbol string, update_id long, book_side string, price double, qty double")
    r = flow.book_state(u, levels=10).first()
    assert (r.best_bid, r.best_ask, r.mid) == (50000.0, 50001.0, 50000.5)
    assert math.isclose(r.imbalance, (3 - 4) / (3 + 4)) and r.bid_levels == 2


def test_position_modes(spark):
    fills = spark.createDataFrame([("s", 1, 10.0, 2.0, 1.0), ("s", 2, 12.0, 1.0, -1.0), ("s", 3, 11.0, 3.0, -1.0)], "symbol string, open_time int, price double, qty double, side double")
    good = [r.state for r in portfolio.positions(fills).orderBy("open_time").collect()]
    assert [(s.qty, s.entry, s.realised) for s in good] == [(2.0, 10.0, 0.0), (1.0, 10.0, 2.0), (-2.0, 11.0, 3.0)]
    other = [r.state for r in portfolio.positions(fills, "reference").orderBy("open_time").collect()]
    assert other[1].realised == 0.0 and math.isclose(other[1].entry, 32 / 3)
    with pytest.raises(ValueError):
        portfolio.positions(fills, "else")


def test_volume_bars_keep_the_volume(spark):
    t = spark.createDataFrame([("s", i, i, 1.0 + i, q, i % 2) for i, q in enumerate([300, 900, 2500, 50])], "symbol string, event_id long, ts long, price double, qty long, side int")
    got = flow.volume_bars(t, 1000.0).orderBy("bar").collect()
    assert [r.volume for r in got] == [1000.0, 1000.0, 1000.0, 750.0]


def test_folds_do_not_overlap(spark):
    f = purged_folds(numbered(spark, [float(i) for i in range(1000)], "close"))
    assert f.select("fold").distinct().count() == 10
    assert f.groupBy("fold").count().where("count <> 1000").count() == 0
    assert f.where("fold = 1 and part = 'test'").count() == 400


def test_deflated_sharpe_needs_trials():
    assert deflated_sharpe(1.0, 1, 1.0, 100) == (None, None)
    z, p = deflated_sharpe(0.1, 1000, 0.01, 100)
    assert z < 0 and p > 0.5


def test_estimators():
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.normal(size=2000))
    assert 0.4 < spectral.rescaled_range(np.diff(walk)) < 0.7
    assert 1.3 < spectral.higuchi_dimension(walk) < 1.7


def series(spark, values):
    return spark.createDataFrame([("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), float(v)) for i, v in enumerate(values)], "symbol string, open_time timestamp_ntz, close double")


def test_series_estimators_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    x = 100 * np.exp(np.cumsum(rng.normal(scale=0.01, size=140)))
    df = series(spark, x)
    r = np.diff(np.log(x))
    got = [row.hurst for row in spectral.rolling_hurst(df).orderBy("open_time").collect()]
    assert got[99] is None
    for i in (100, 120, 139):
        w = r[i - 100 : i]
        tau = [np.std(w[k:] - w[:-k]) for k in range(2, 20)]
        assert math.isclose(got[i], 2 * np.polyfit(np.log(range(2, 20)), np.log(tau), 1)[0], rel_tol=1e-9)

    rows = spectral.instant_phase(df).orderBy("open_time").collect()
    n = len(x)
    analytic = [sum(2 * np.exp(2j * np.pi * k * t / n) * (x * np.exp(-2j * np.pi * k * np.arange(n) / n)).sum() for k in range(1, n // 2)) for t in (0, 7, 139)]
    for t, z in zip((0, 7, 139), analytic, strict=True):
        z = (z + x.sum() + (x * (-1.0) ** np.arange(n)).sum() * (-1) ** t) / n
        assert math.isclose(rows[t].amplitude, abs(z), rel_tol=1e-9) and math.isclose(rows[t].phase, np.angle(z), rel_tol=1e-7, abs_tol=1e-9)
    turns = np.unwrap([row.phase for row in rows])
    assert math.isclose(rows[5].frequency, (turns[6] - turns[4]) / 4 / math.pi, rel_tol=1e-9)

    rows = spectral.kalman_level(df).orderBy("open_time").collect()
    m, v, means, spreads, before = 0.0, 1.0, [], [], []  # the second state has no weight, so the filter is of one state
    for z, row in zip(np.log(x), rows, strict=True):
        v += 1e-4
        before.append((m, v))
        k = v / (v + 1e-2)
        m, v = m + k * (z - m), (1 - k) * v
        means.append(m)
        spreads.append(v)
        assert math.isclose(row.level, m, rel_tol=1e-9)
    smooth = means[-1]
    for t in range(len(means) - 2, -1, -1):
        smooth = means[t] + spreads[t] / before[t + 1][1] * (smooth - before[t + 1][0])
        assert math.isclose(rows[t].smoothed, smooth, rel_tol=1e-9)


def test_signal_gates(spark):
    def ticks(qty, weighted=0.5):
        return with_imbalance(spark.createDataFrame([("s", i, i, 50000.0 + 10 * i, q, i % 2, weighted) for i, q in enumerate(qty)], "symbol string, event_id long, ts long, price double, qty long, side int, weighted_imbalance double"))

    def signals(qty, **how):
        return [r.signal for r in flow.imbalance_signals(ticks(qty), persistence=2, confidence=0.3, **how).orderBy("ts").collect()]

    assert signals([54, 54]) == [None, None]  # below the threshold
    assert signals([74, 74]) == [None, "buy"] and signals([19, 19]) == [None, "sell"]
    assert signals([74, 19, 19]) == [None, None, "sell"]
    assert flow.imbalance_signals(ticks([99, 99]), persistence=2, confidence=0.99).where("signal is not null").count() == 0
    row = flow.imbalance_signals(ticks([74, 74]), persistence=2, confidence=0.3).where("signal is not null").first()
    assert math.isclose(row.confidence, 0.4 * 49 / 99 + 0.1 + 0.04) and math.isclose(row.size, round(1000 / 50010, 6)) and row.reason.endswith("Persistent for 2 ticks")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "symbol string, open_time int, close double, signal double")
    assert portfolio.backtest(none).count() == 0
    assert fold(none, ["close"], F.lit(0.0), lambda s, r: s + r["close"]).count() == 0
