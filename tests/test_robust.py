"""Robustness operators against plain Python and theory."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.exprs import normal_ppf
from tidemark.operators import robust

START = dt.datetime(2024, 1, 1)


def test_inverse_normal(spark):
    p = [1e-300, 1e-12, 1e-5, 0.02, 0.02425, 0.03, 0.2, 0.5, 0.7, 0.97, 0.98, 0.99999]
    df = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, -0.1, 1.1, None]], "p double")
    got = {r.p: r.z for r in df.select("p", normal_ppf(F.col("p")).alias("z")).collect()}
    for x in p:
        assert math.isclose(got[x], NormalDist().inv_cdf(x), rel_tol=2e-9, abs_tol=1e-9)
    assert got[0.0] == -math.inf and got[1.0] == math.inf and got[-0.1] is None and got[1.1] is None and got[None] is None


def test_snooping_cases(spark):
    tried = spark.createDataFrame([("low", 5, 1000, None), ("high", 1000, 100, None), ("one", 1, 500, 2.0), ("none", 3, 0, -9.0)], "name string, strategies long, observations long, best_sharpe double")
    got = {r.name: r for r in robust.data_snooping(tried).collect()}
    assert got["low"].passed == 1 and got["high"].passed == 0 and "high_spurious_probability" in got["high"].issues
    assert got["one"].expected_best is None and got["one"].passed == 1 and got["none"].score is None and got["none"].issues == "below_expected"
    n, e = NormalDist(), robust.EULER
    assert math.isclose(got["high"].expected_best, (1 - e) * n.inv_cdf(1 - 1 / 1000) + e * n.inv_cdf(1 - 1 / (1000 * math.e)), rel_tol=1e-8)
    assert math.isclose(got["low"].least_sharpe, n.inv_cdf(1 - 0.01) / math.sqrt(1000), rel_tol=1e-8)


def test_signature_case(spark):
    rng = np.random.default_rng(0)
    rows = [("over", i, "train", float(x)) for i, x in enumerate(rng.normal(size=100) + 2)] + [("over", 100 + i, "test", float(x)) for i, x in enumerate(rng.normal(size=100) + 0.5)]
    rows += [("fine", i, "train", 1.0) for i in range(4)] + [("fine", 9 + i, "test", 1.0) for i in range(4)] + [("fading", i, ("train", "test")[i > 3], float(10 - i)) for i in range(9)] + [("lone", 0, "train", 1.0)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, part string, strategy double")
    got = {r.symbol: (r.gap, r.degrades, r.passed) for r in robust.overfit_signature(df).collect()}
    assert got["over"][0] == 1 and got["fine"] == (0, 0, 1) and got["fading"][1] == 1 and got["lone"] == (0, 0, 1)


def test_bootstrap_equals_plain_draws(spark):
    import hashlib

    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=75) / 50, "b": rng.normal(size=9)}
    rows = [(k, START + dt.timedelta(hours=i), float(v)) for k, y in x.items() for i, v in enumerate(y)] + [("a", START + dt.timedelta(hours=500), None)]
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, ret double")
    for width in (11 * 3600, 10**9):
        got = robust.block_bootstrap(df, simulations=40, block=10, width=width).collect()
        assert [r.symbol for r in got] == ["a"]
        sims = []
        for s in range(40):
            blocks = [int(hashlib.md5(f"42:a:{s}:{p}".encode()).hexdigest()[:8], 16) % 7 for p in range(7)]
            y = np.concatenate([x["a"][b * 10 : b * 10 + 10] for b in blocks])
            c = np.cumsum(y)
            sims.append((y.sum(), y.mean() / y.std() * math.sqrt(252), (np.maximum.accumulate(c) - c).max()))
        sims, c = np.array(sims), np.cumsum(x["a"])
        r = got[0]
        want = [sims.mean(0), sims.std(0), np.percentile(sims, 2.5, 0), np.percentile(sims, 97.5, 0)]
        assert np.allclose([[r[f"{n}_{e}"] for n in ("return", "sharpe", "drawdown")] for e in ("mean", "std", "low", "high")], want)
        assert np.isclose(r.own_return, c[-1]) and np.isclose(r.own_drawdown, (np.maximum.accumulate(c) - c).max()) and np.isclose(r.own_sharpe, x["a"].mean() / x["a"].std() * math.sqrt(252))


def test_permutations_of_few_folds(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(3)] + [("b", i, float(i)) for i in range(6)] + [("c", i, 2.0) for i in range(5)], "symbol string, fold int, total double")
    got = {r.symbol: r.pbo for r in robust.permuted_overfitting(df, permutations=300).collect()}
    assert got["a"] == 0.0 and got["c"] == 0.0 and 0.2 < got["b"] < 0.8


def test_prioritised_sample_follows_its_weights(spark):
    weights = {0: 1.0, 1: 2.0, 2: 4.0, 3: 8.0}
    rows = [(g, i, w) for g in range(3000) for i, w in weights.items()] + [(-1, 0, 0.0), (-1, 1, None), (-1, 2, 3.0)]
    df = spark.createDataFrame(rows, "symbol long, id long, p double")
    got = robust.prioritised_sample(df, "p", 1, alpha=1.0).collect()
    first = [r.id for r in got if r.symbol >= 0]
    for i, w in weights.items():
        assert abs(first.count(i) / 3000 - w / 15) < 0.03
    assert [(r.id, r.weight, r.probability) for r in got if r.symbol == -1] == [(2, 1.0, 1.0)]
    two = robust.prioritised_sample(df, "p", 2, alpha=1.0).where("symbol >= 0").groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("id").alias("k"), F.max("weight").alias("m")).collect()
    assert {(r.n, r.k, r.m) for r in two} == {(2, 2, 1.0)}
    # The chance that 3 is in a draw of two without replacement.
    inside = 8 / 15 + sum(w / 15 * 8 / (15 - w) for w in (1, 2, 4))
    seen = robust.prioritised_sample(df, "p", 2, alpha=1.0).where("symbol >= 0 and id = 3").count()
    assert abs(seen / 3000 - inside) < 0.03
