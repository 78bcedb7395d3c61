"""Moving weights, regime weights and the signal gate against plain loops."""

import datetime as dt
import math

import numpy as np

from tidemark.operators import ensemble

START = dt.datetime(2024, 1, 1)


def test_hit_weights_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 3))
    x[3, 1] = 0.0
    rows = [("s", START + dt.timedelta(hours=i), *map(float, v)) for i, v in enumerate(x)] + [("s", START + dt.timedelta(hours=999), 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, actual double, a double, b double")
    got = sorted(ensemble.hit_weights(df, ["a", "b"], rows=40).collect(), key=lambda r: r.open_time)
    w, history, want = np.array([0.5, 0.5]), [], []
    for v in x:
        history = [*history, v][-40:]
        h = np.array(history)
        score = [0.5, 0.5] if len(h) < 10 else [0.7 * ((h[:, k] >= 0) == (h[:, 0] >= 0)).mean() + 0.3 / (1 + ((h[:, k] - h[:, 0]) ** 2).mean()) for k in (1, 2)]
        w = 0.9 * w + 0.1 * np.array(score) / sum(score)
        w = w / w.sum()
        want.append(w)
    assert np.allclose([(r.weight_a, r.weight_b) for r in got], want)


def test_regime_weights_and_gate(spark):
    families = {"x": "tree", "y": "deep", "z": "agent"}
    rng = np.random.default_rng(6)
    rows = [("s", START + dt.timedelta(hours=i), float(p), 0.5, 0.3, 0.2, float(r), float(q)) for i, (p, r, q) in enumerate(zip(rng.normal(size=130), rng.random(130), rng.random(130), strict=True))]
    rows.append(("t", START, 5.0, 1.0, 0.0, 0.0, 1.0, None))
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, prediction double, weight_x double, weight_y double, weight_z double, regime_weight double, score double")
    out = sorted(ensemble.signal_gate(ensemble.regime_weights(df, families), list(families)).where("symbol = 's'").collect(), key=lambda r: r.open_time)
    for i, r in enumerate(out):
        base = 1 - 0.3 * (1 - r.regime_weight)
        raw = np.array([0.5 * (base * 0.9 + 0.1), 0.3 * base, 0.2 * (base * 0.8 + 0.2 * r.regime_weight)])
        assert np.allclose([r.adjusted_x, r.adjusted_y, r.adjusted_z], raw / raw.sum())
        strength = min(abs(r.prediction), 1)
        model = 0.5 * strength + 0.5 * (1 + sum(w * math.log(w) for w in (0.5, 0.3, 0.2)) / math.log(3))
        assert math.isclose(r.model_confidence, model) and math.isclose(r.confidence, 0.6 * model + 0.4 * r.regime_weight if i >= 99 else 0.0)
        signal = 0.6 * strength + 0.4 * (1 - r.score)
        assert math.isclose(r.signal_confidence, signal) and r.signal == (math.copysign(1, r.prediction) if i >= 99 and signal >= 0.6 else None)
    alone = ensemble.signal_gate(df.where("symbol = 't'"), list(families), warm_up=1).first()
    assert alone.model_confidence == 1.0 and alone.signal == 1.0 and alone.signal_confidence == 0.8
