"""Whole-series estimators against plain loops."""

import datetime
import math

import numpy as np
import pytest

from tidemark.operators import spectral

AT = datetime.datetime(2024, 1, 1)


def bars(spark, series):
    rows = [(k, AT + datetime.timedelta(hours=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double")


def slope(points):
    mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
    return sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)


def plain_hurst(closes):
    r = [math.log(b / a) for a, b in zip(closes, closes[1:], strict=False)]
    n = len(r)
    if n < 20:
        return 0.5
    top = max(n // 4, 10)
    points = []
    # Sizes are cut to integers from these floats as they are, so that 99.999... is 99.
    for size in sorted({int(s) for s in np.logspace(1, np.log10(top), 20)}):
        ratios = []
        for at in range(0, n - size + 1, size):
            block = r[at : at + size]
            mean = sum(block) / size
            total, sums = 0.0, []
            for x in block:
                total += x - mean
                sums.append(total)
            sd = math.sqrt(sum((x - mean) ** 2 for x in block) / (size - 1))
            if sd > 0:
                ratios.append((max(sums) - min(sums)) / sd)
        if ratios:
            points.append((math.log(size), math.log(sum(ratios) / len(ratios))))
    return min(max(slope(points), 0), 1) if len(points) > 1 else 0.5


def plain_dimension(x, most=10):
    n = len(x)
    points = []
    for k in range(1, (most if n >= 40 else max(2, n // 4)) + 1):
        lengths = []
        for m in range(k):
            steps = [abs(x[m + i * k] - x[m + (i - 1) * k]) for i in range(1, (n - 1 - m) // k + 1)]
            if steps:
                lengths.append(sum(steps) * (n - 1) / (len(steps) * k) / k)
        if lengths and sum(lengths) > 0:
            points.append((math.log(k), math.log(sum(lengths) / len(lengths))))
    return min(max(-slope(points), 1), 2) if len(points) > 1 else 1.5


def test_fractal_measures(spark):
    rng = np.random.default_rng(8)
    series = {
        "walk": np.exp(rng.normal(size=300).cumsum() / 50), "noise": np.exp(rng.normal(size=257)), "trend": np.exp(np.arange(120) / 40 + rng.normal(size=120) / 900),
        "short": [1.0, 2.0, 1.5, 1.7], "flat": [3.0] * 50, "one": [1.0],
    }
    got = {r.symbol: r for r in spectral.fractal_measures(bars(spark, series)).collect()}
    for k, x in series.items():
        x = [float(v) for v in x]
        assert got[k].n == len(x)
        assert got[k].hurst == pytest.approx(plain_hurst(x), abs=1e-9) and got[k].dimension == pytest.approx(plain_dimension(x), abs=1e-9)
    assert got["noise"].dimension > 1.9 and got["walk"].dimension < 1.7 and got["flat"].hurst == 0.5


@pytest.mark.parametrize("levels", [1, 3])
def test_haar(spark, levels):
    rng = np.random.default_rng(9)
    series = {"a": rng.normal(size=37).cumsum() + 50, "b": [4.0], "c": rng.normal(size=16)}
    got = spectral.haar_denoised(bars(spark, series), levels=levels).orderBy("open_time").collect()
    for k, x in series.items():
        x = [float(v) for v in x]
        n = len(x)
        while len(x) % 2**levels:
            x.append(x[-1])
        kept = []
        for _ in range(levels):
            pairs = [(x[i], x[i + 1]) for i in range(0, len(x), 2)]
            x, d = [(p + q) / 2**0.5 for p, q in pairs], [(p - q) / 2**0.5 for p, q in pairs]
            cut = 0.3 * max(abs(v) for v in d)
            kept.append([math.copysign(max(abs(v) - cut, 0), v) for v in d])
        for d in reversed(kept):
            x = [v for p, q in zip(x, d, strict=True) for v in ((p + q) / 2**0.5, (p - q) / 2**0.5)]
        assert np.allclose([r.denoised for r in got if r.symbol == k], x[:n])


def test_filtered_correlation(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 12))
    x[:, :6] += rng.normal(size=(400, 1))  # one common factor of half of the components
    x[:, 11] = 5.0  # does not vary
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)]
    got = spectral.filtered_correlation(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    c = np.eye(12)
    for i in range(11):
        for j in range(11):
            a, b = x[:, i] - x[:, i].mean(), x[:, j] - x[:, j].mean()
            c[i, j] = (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())
    values, vectors = np.linalg.eigh(c)
    edge = (1 + math.sqrt(12 / 400)) ** 2
    noise = [v for v in values if v <= edge]
    assert len(noise) == 11  # the factor alone stands out
    clean = sum((v if v > edge else sum(noise) / len(noise)) * np.outer(e, e) for v, e in zip(values, vectors.T, strict=True))
    clean = np.array([[clean[i, j] / math.sqrt(clean[i, i] * clean[j, j]) for j in range(12)] for i in range(12)])
    assert len(got) == 144 and all(abs(r.correlation - clean[r.i, r.j]) < 1e-8 for r in got)
