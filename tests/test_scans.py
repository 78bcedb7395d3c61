"""Recursions by blocks against plain loops."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import manifold

START = dt.datetime(2024, 1, 1)


def series(spark, by_key):
    rows = [(k, START + dt.timedelta(hours=int(i)), *map(float, v)) for k, x in by_key.items() for i, v in enumerate(x)]
    d = len(next(iter(by_key.values()))[0])
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, " + ", ".join(f"f{i} double" for i in range(d))), [f"f{i}" for i in range(d)]


def plain_nsmi(x, half_life=100.0, tracked=3, threshold=0.3, warm_up=50, sensitivity=2.0):
    alpha = 1 - 0.5 ** (1 / half_life)
    d = x.shape[1]
    mean, cov, values = np.zeros(d), np.zeros((d, d)), np.zeros(tracked)
    ema = sq = last_gap = 0.0
    regime, out = 0, []
    for n, v in enumerate(x, 1):
        old = np.diag(cov).copy()
        mean = (1 - alpha) * mean + alpha * v
        cov = (1 - alpha) * cov + alpha * np.outer(v - mean, v - mean)
        if n >= warm_up:
            rest, found = cov.copy(), []
            for k in range(min(tracked, d)):
                u = np.array([np.sin(i + k + 1) for i in range(d)])
                u /= np.linalg.norm(u)
                kept = 0.0
                for _ in range(20):
                    w = rest @ u
                    e = float(u @ w)
                    u = w / np.linalg.norm(w) if np.linalg.norm(w) > 1e-10 else w
                    if abs(e - kept) < 1e-6:
                        break
                    kept = e
                found.append(max(kept, 0.0))
                rest = rest - kept * np.outer(u, u)
            values = np.array(sorted(found + [0.0] * (tracked - len(found)), reverse=True))
        gap = (values[0] - values[1]) / values[0] if values[0] > 1e-10 else 0.0
        drift = float(np.linalg.norm(np.diag(cov) - old))
        ema, sq = (1 - alpha) * ema + alpha * drift, (1 - alpha) * sq + alpha * drift * drift
        s2 = float((values**2).sum())
        dim = values.sum() ** 2 / s2 if s2 > 1e-10 else 1.0
        z = (drift - ema) / max(sq - ema * ema, 1e-10) ** 0.5
        combined = 0.6 * abs(gap - last_gap) / threshold + 0.4 * abs(z) / sensitivity
        warm = n >= warm_up
        detected = warm and combined > 1.5 and abs(z) > sensitivity
        regime += detected
        stable = min(n / regime, 1000) / 1000 if regime else 1.0
        out.append((gap, drift, dim, 1 / (1 + np.exp(-sensitivity * z)), 1 / (1 + np.exp(-2 * (combined - 1))) if warm else 0.0, int(detected), regime, ema / (ema + 1), dim / d, stable, 0.3 * stable + 0.35))
        last_gap = gap
    return np.array(out)


COLUMNS = ["spectral_gap", "drift", "effective_dimension", "score", "probability", "detected", "regime", "drift_norm", "dim_ratio", "stability", "regime_weight"]


@pytest.mark.parametrize("width", [7 * 3600, 40 * 3600, 10**9])
def test_nonstationarity_equals_a_loop(spark, width):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(260, 4)) @ rng.normal(size=(4, 4))
    a[150:] *= 6
    b = rng.normal(size=(30, 4))
    df, columns = series(spark, {"a": a, "b": b})
    got = manifold.nonstationarity(df, columns, half_life=20.0, width=width).collect()
    for key, x in (("a", a), ("b", b)):
        rows = sorted((r for r in got if r.symbol == key), key=lambda r: r.open_time)
        assert np.allclose([[r[c] for c in COLUMNS] for r in rows], plain_nsmi(x, 20.0), rtol=1e-6, atol=1e-6)


def test_nonstationarity_shift_decay_and_reset(spark):
    assert abs((1 - manifold.decay(100.0)) ** 100 - 0.5) < 0.01
    i = np.arange(100)
    calm = np.sin(i * 0.1)[:, None] * [1, 0.5, 0.2]
    wild = (np.cos(i * 0.5) * 100 + 500)[:, None] * [1, 10, 5]
    df, columns = series(spark, {"x": np.concatenate([calm, wild]), "late": np.concatenate([calm, wild])[100:]})
    settings = {"half_life": 20.0, "warm_up": 30, "threshold": 0.1, "sensitivity": 1.0, "width": 24 * 3600}
    got = manifold.nonstationarity(df, columns, **settings).collect()
    x = sorted((r for r in got if r.symbol == "x"), key=lambda r: r.open_time)
    assert max(r.probability for r in x[100:]) > 0.1 and not any(r.detected for r in x[:29]) and x[28].spectral_gap == 0 and x[-1].regime >= 1
    # A session as a key starts anew: rows after the change equal a series of their own.
    from pyspark.sql import functions as F

    cut = START + dt.timedelta(hours=100)
    sessions = df.where("symbol = 'x'").withColumn("session", (F.col("open_time") >= F.lit(cut)).cast("int"))
    again = manifold.nonstationarity(sessions, columns, keys=("symbol", "session"), **settings).where("session = 1").collect()
    own = [r for r in got if r.symbol == "late"]
    a, b = ([[r[c] for c in COLUMNS] for r in sorted(rows, key=lambda r: r.open_time)] for rows in (again, own))
    assert np.allclose(a, b)


def test_nonstationarity_of_odd_rows(spark):
    df, columns = series(spark, {"one": [[1.0, 2.0]], "flat": [[0.0, 0.0]] * 60, "gaps": [[1.0, float("nan")], [float("inf"), 1.0], [1.0, 1.0]]})
    got = manifold.nonstationarity(df, columns).collect()
    assert sorted((r.symbol, r.regime) for r in got).count(("flat", 0)) == 60 and sum(r.symbol == "gaps" for r in got) == 1
    assert manifold.nonstationarity(df.limit(0), columns).count() == 0


def plain_model(x, k, iterations, tolerance):
    """Expectation and maximisation along the whole series."""
    n, d = x.shape
    sizes = np.argsort((x**2).sum(1), kind="stable")
    means, covs = [], []
    for s in range(k):
        own = x[sizes[s * (n // k) : (s + 1) * (n // k) if s < k - 1 else n]]
        means.append(own.mean(0))
        covs.append(np.atleast_2d(np.cov(own.T)) + np.eye(d) * 1e-4)
    means, covs, start = np.array(means), np.array(covs), np.full(k, 1 / k)
    a = np.eye(k) * 0.9 + 0.1 / k
    a /= a.sum(1, keepdims=True)
    last_like = -np.inf
    for _ in range(iterations):
        e, alpha, scale = densities(x, means, covs), np.zeros((n, k)), np.zeros(n)
        for t in range(n):
            v = start * e[0] if t == 0 else (alpha[t - 1] @ a) * e[t]
            scale[t] = v.sum()
            alpha[t] = v / scale[t]
        beta = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            beta[t] = a @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        xi = alpha[:-1, :, None] * a[None] * (e[1:] * beta[1:])[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        start = gamma[0]
        a = xi.sum(0) / gamma[:-1].sum(0)[:, None]
        a /= a.sum(1, keepdims=True)
        w = gamma.sum(0)
        means = gamma.T @ x / w[:, None]
        covs = np.array([((x - means[s]) * gamma[:, s : s + 1]).T @ (x - means[s]) / w[s] + np.eye(d) * 1e-4 for s in range(k)])
        like = np.log(scale).sum()
        if abs(like - last_like) < tolerance:
            break
        last_like = like
    return start, a, means, covs, gamma[-1], like


def densities(x, means, covs):
    d = x.shape[1]
    out = [np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt((2 * np.pi) ** d * np.linalg.det(c)) for m, c in zip(means, covs, strict=True)]
    return np.maximum(np.stack(out, 1), 1e-100)


def plain_decode(x, start, a, means, covs, first=True):
    e, n, k = densities(x, means, covs), len(x), len(start)
    alpha, delta, back = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k), int)
    for t in range(n):
        v = start * e[0] if t == 0 and first else ((start if t == 0 else alpha[t - 1]) @ a) * e[t]
        alpha[t] = v / v.sum()
        if t == 0 and first:
            delta[0] = np.log(start + 1e-100) + np.log(e[0])
        else:
            s = (np.log(start + 1e-100) if t == 0 else delta[t - 1])[:, None] + np.log(a + 1e-100)
            back[t], delta[t] = s.argmax(0), s.max(0) + np.log(e[t])
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    gamma = alpha * beta
    path = [int(delta[-1].argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return alpha, gamma / gamma.sum(1, keepdims=True), path[::-1]


def switching(rng, n, d):
    state, out = 0, []
    for _ in range(n):
        state = state if rng.random() < 0.95 else int(rng.integers(3))
        out.append(rng.normal(size=d) * (0.3, 1.0, 0.5)[state] + (0.0, 1.0, -2.0)[state])
    return np.array(out)


@pytest.mark.parametrize(("width", "d"), [(30 * 3600, 2), (10**9, 1)])
def test_hidden_regimes_equal_whole_series(spark, width, d):
    from tidemark.operators import regimes

    rng = np.random.default_rng(2)
    data = {"a": switching(rng, 200, d), "b": switching(rng, 90, d), "short": switching(rng, 5, d)}
    df, columns = series(spark, data)
    models = regimes.fit(df, columns, iterations=8, tolerance=0.5, width=width)
    got = {r.symbol: regimes.Model(np.array(r.model), 3, d) for r in models.collect()}
    assert set(got) == {"a", "b"}
    rows = regimes.decode(df, models, columns, width=width).collect()
    later = {k: switching(rng, 70, d) for k in got}
    online = regimes.decode(series(spark, later)[0], models, columns, online=True, width=width).collect()
    for key, m in got.items():
        start, a, means, covs, last, like = plain_model(data[key], 3, 8, 0.5)
        for mine, theirs in ((m.start, start), (m.transition, a), (m.means, means), (m.covs, covs), (m.last, last), (m.likelihood, like)):
            assert np.allclose(mine, theirs, rtol=1e-6, atol=1e-8)
        own = sorted((r for r in rows if r.symbol == key), key=lambda r: r.open_time)
        alpha, gamma, path = plain_decode(data[key], start, a, means, covs)
        assert np.allclose([r.filtered for r in own], alpha, atol=1e-8) and np.allclose([r.smoothed for r in own], gamma, atol=1e-8)
        assert [r.path for r in own] == path and [r.state for r in own] == alpha.argmax(1).tolist()
        assert own[0].change_probability is None and np.isclose(own[5].change_probability, 1 - alpha[5][alpha[4].argmax()])
        assert np.isclose(own[7].entropy, -(np.clip(alpha[7], 1e-10, 1) * np.log(np.clip(alpha[7], 1e-10, 1))).sum())
        own = sorted((r for r in online if r.symbol == key), key=lambda r: r.open_time)
        alpha, gamma, path = plain_decode(later[key], last, a, means, covs, first=False)
        assert np.allclose([r.filtered for r in own], alpha, atol=1e-8) and [r.path for r in own] == path
        assert np.isclose(own[0].change_probability, 1 - alpha[0][last.argmax()])


def test_linear_recursions_equal_a_loop(spark):
    from tidemark.functions.scans import fading, linear

    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=(300, 1)), "b": rng.normal(size=(1, 1)), "c": rng.normal(size=(40, 1))}
    data["c"][7] = np.nan
    df, _ = series(spark, data)
    turn = np.array([[0.9, -0.3], [0.3, 0.9]])
    for width in (5 * 3600, 10**9):
        got = linear(df, "symbol", "open_time", ["f0"], fading([0.99, 0.5], [1.0, 2.0]), lambda x: np.array([x[0], -x[0]]), ["p", "q"], width).collect()
        mixed = linear(df, "symbol", "open_time", ["f0"], lambda x: (np.repeat(turn[None], len(x), 0), x * [1.0, 0.0]), lambda _: np.array([5.0, 1.0]), ["p", "q"], width).collect()
        for key, x in data.items():
            values = x[~np.isnan(x[:, 0]), 0]
            s, m, want, want_mixed = np.array([values[0], -values[0]]), np.array([5.0, 1.0]), [], []
            for i, v in enumerate(values):
                if i:
                    s = np.array([0.99, 0.5]) * s + np.array([1.0, 2.0]) * v
                    m = turn @ m + [v, 0.0]
                want.append(s)
                want_mixed.append(m)
            for rows, w in ((got, want), (mixed, want_mixed)):
                own = sorted((r for r in rows if r.symbol == key), key=lambda r: r.open_time)
                assert np.allclose([(r.p, r.q) for r in own], w) and [r.f0 for r in own] == values.tolist()
