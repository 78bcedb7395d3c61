import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import wavelets

AT = datetime.datetime(2024, 1, 1)


def down(x, low, high):
    """One level by convolution over a mirrored series."""
    taps, n = len(low), len(x)
    p = np.arange(2 - taps, n + taps - 1) % (2 * n)
    mirrored = x[np.where(p < n, p, 2 * n - 1 - p)]
    return [np.convolve(mirrored, f, "valid")[::2] for f in (low, high)]


def up(a, d, low, high):
    """One level back by convolution with the filters turned round."""
    out = 0
    for c, f in ((a, low), (d, high)):
        spread = np.zeros(2 * len(d) - 1)
        spread[::2] = c[: len(d)]
        out = out + np.convolve(spread, f[::-1])[len(low) - 2 : 2 * len(d)]
    return out


@pytest.mark.parametrize("name", sorted(wavelets.MOMENTS))
def test_filters(name):
    low, high = map(np.array, wavelets.filters(name))
    moments = wavelets.MOMENTS[name]
    assert len(low) == 2 * moments and np.isclose(low.sum(), 2**0.5)
    for shift in range(0, len(low), 2):
        one = float(shift == 0)
        assert np.isclose(low[shift:] @ low[: len(low) - shift], one) and np.isclose(high[shift:] @ high[: len(low) - shift], one)
    for k in range(moments):  # the detail of a polynomial of lower degree vanishes
        assert abs(high @ np.arange(len(low)) ** k) < 1e-6
    if name == "db2":  # known in closed form
        assert np.allclose(low[::-1] * 4 * 2**0.5, [1 + 3**0.5, 3 + 3**0.5, 3 - 3**0.5, 1 - 3**0.5])


@pytest.mark.parametrize(("name", "levels"), [("db4", 4), ("haar", 3)])
def test_transform_equals_convolutions(spark, name, levels):
    rng = np.random.default_rng(4)
    series = {"a": rng.normal(size=203).cumsum(), "b": rng.normal(size=64), "short": rng.normal(size=3), "one": np.array([2.0]), None: rng.normal(size=9)}
    rows = [(k, AT + datetime.timedelta(hours=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    odd = [("b", AT + datetime.timedelta(hours=900), None), ("b", AT + datetime.timedelta(hours=901), float("nan")), ("b", None, None)]
    df = spark.createDataFrame(rows + odd, "symbol string, open_time timestamp, close double")
    low, high = map(np.array, wavelets.filters(name))
    found = wavelets.decompose(df, wavelet=name, levels=levels, block=16).toPandas()
    back = wavelets.reconstruct(wavelets.decompose(df, wavelet=name, levels=levels, block=16), name, levels, block=16).toPandas()
    smooth = wavelets.denoised(df, wavelet=name, levels=levels, block=16).toPandas()
    assert len(smooth) == len(rows) + len(odd) and smooth["denoised"].notna().sum() == len(rows)
    for k, x in series.items():
        of = lambda d: d[d["symbol"].isna() if k is None else d["symbol"] == k]  # noqa: B023, E731
        a, details = x, []
        for level in range(1, levels + 1):
            a, d = down(a, low, high)
            details.append(d)
            got = of(found[found["level"] == level]).sort_values("i")
            assert np.allclose(got["a"], a) and np.allclose(got["d"], d) and list(got["i"]) == list(range(len(a)))
        assert np.allclose(of(back).sort_values("i")["a"][: len(x)], x)
        for d in reversed(details):
            a = up(a, np.sign(d) * np.maximum(np.abs(d) - 0.3 * np.abs(d).max(), 0), low, high)
        got = of(smooth).dropna(subset=["denoised"]).sort_values("open_time")["denoised"]
        assert np.allclose(got, a[: len(x)])


def test_a_busy_symbol_is_many_groups(spark):
    df = spark.range(4096).select(F.lit("a").alias("symbol"), F.timestamp_seconds("id").alias("open_time"), F.sin(F.col("id") / 9).alias("close"))
    a, b = (wavelets.denoised(df, block=size).orderBy("open_time").toPandas()["denoised"] for size in (64, 1 << 20))
    assert np.array_equal(a, b)
