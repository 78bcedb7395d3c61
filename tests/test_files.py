import datetime

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import ensemble
from tidemark.sources import files


def test_replay_log(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("s1", "trade", at(1), "a", '{"p": 1}'), ("s1", "depth", at(2), "a", "{}"), ("s2", "trade", at(3), "b", None)]
    path = str(tmp_path / "log")
    files.write_replay(spark.createDataFrame(rows, f"session string, {files.REPLAY}"), path)
    (tmp_path / "log" / "session=s1" / "broken.json").write_text("{not json\n")
    read = lambda **k: sorted((r.session, r.kind, r.ts.hour) for r in files.read_replay(spark, path, **k).collect())
    assert read() == [("s1", "depth", 2), ("s1", "trade", 1), ("s2", "trade", 3)]
    assert read(kinds=["trade"]) == [("s1", "trade", 1), ("s2", "trade", 3)]
    assert read(start=at(2), end=at(2)) == [("s1", "depth", 2)]
    assert [r.session for r in files.replay_sessions(spark, path).collect()] == ["s2", "s1"]


def test_collected_files_keep_the_first_row_of_a_key(spark, tmp_path):
    paths = []
    for i, rows in enumerate([[(1, 5, "b"), (2, 1, "c")], [(1, 4, "a"), (1, 4, "a"), (3, None, None)]]):
        paths.append(str(tmp_path / str(i)))
        files.write_partitioned(spark.createDataFrame(rows, "id int, ts int, v string"), paths[-1], ["id"])
    got = files.collect_files(spark, paths, ["id"], "ts").collect()
    assert sorted((r.id, r.ts, r.v) for r in got if r.id < 3) == [(1, 4, "a"), (2, 1, "c")]
    assert [r.v for r in got if r.id == 3] == [None]


def test_aliases(spark):
    df = spark.createDataFrame([(1, None, 2.0, "x"), (2, 3.0, 4.0, "y")], "id int, profit double, realized_pnl double, pair string")
    got = files.with_aliases(df).orderBy("id").collect()
    assert [(r.id, r.pnl, r.symbol, r.qty) for r in got] == [(1, 2.0, "x", None), (2, 3.0, "y", None)]


def test_ensemble_weights_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    y, p = rng.normal(size=97), rng.normal(size=(97, 2))
    rows = [("a", i + 1, float(y[i]), float(p[i, 0]), float(p[i, 1])) for i in range(97)]
    got = ensemble.ensemble(spark.createDataFrame(rows, "symbol string, step int, actual double, m double, n double"), ["m", "n"], every=15, rows=20).orderBy("step").collect()
    w, want = np.array([0.5, 0.5]), []
    for i in range(97):
        want.append(w @ p[i])
        if (i + 1) % 15 == 0 and i + 1 >= 20:
            scores = np.maximum([(np.sign(p[i - 19 : i + 1, k]) == np.sign(y[i - 19 : i + 1])).mean() for k in range(2)], 0.01)
            w = np.maximum(0.95 * w + 0.05 * scores / scores.sum(), 0.05)
            w /= w.sum()
    assert np.allclose([r.prediction for r in got], want)


def test_overfitting_signs(spark):
    train, val = [1.0, 0.9, 0.8, 0.7, 0.6], [1.0, 0.99995, 1.2, 1.5, 2.1]
    df = spark.createDataFrame([("m", i, a, b) for i, (a, b) in enumerate(zip(train, val, strict=True))], "model string, epoch int, train_loss double, val_loss double")
    got = ensemble.overfitting_signs(df, patience=4).orderBy("epoch").collect()
    assert [r.severity for r in got] == ["none", "none", "mild", "moderate", "severe"]
    # An improvement of less than 1e-4 does not count.
    assert [r.waited for r in got] == [0, 1, 2, 3, 4] and [r.stop for r in got] == ["", "", "", "", "patience"]
    late = spark.createDataFrame([("m", i, 1.0 - i / 100, 1.0 + i / 100) for i in range(3)], df.schema)
    assert [r.severity for r in ensemble.overfitting_signs(late).orderBy("epoch").collect()] == ["none", "none", "moderate"]


def test_generalisation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, None), (0.4, 1.0, 1.0, 3.0), (0.4, 1.0, 2.0, 3.0)], "mse_train double, mse_val double, mse_test double, sharpe_train double").withColumn("sharpe_val", F.lit(1.0))
    got = ensemble.generalisation(df, lower=("mse",)).collect()
    assert [(r.passed, r.issues, r.verdict) for r in got] == [
        (1, "", "GOOD GENERALIZATION"), (0, "mse: overfitting, sharpe: overfitting", "POTENTIAL OVERFITTING"),
        (0, "mse: overfitting, mse: shift, sharpe: overfitting", "POTENTIAL OVERFITTING"),
    ]
