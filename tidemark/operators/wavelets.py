"""Discrete wavelet transforms of whole series: a filter bank whose levels run by blocks of coefficients."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import written
from tidemark.functions.windows import running_total

#: Vanishing moments of the wavelets by name; their filters have twice as many values.
MOMENTS = {"haar": 1, "db2": 2, "db3": 3, "db4": 4, "db5": 5, "db6": 6}
#: Coefficients that one group of a level makes, so a long series is many tasks.
BLOCK = 65_536


def daubechies(moments: int) -> list[float]:
    """The low-pass reconstruction filter of the Daubechies wavelet with so many vanishing moments.

    It is the factor of least phase of the half-band polynomial: of each pair of reciprocal roots
    the one inside the unit circle, with ``moments`` roots at -1.
    """
    half_band = [comb(moments - 1 + k, k) for k in range(moments)]
    roots = []
    for y in np.roots(half_band[::-1]):
        pair = np.roots([1, 4 * y - 2, 1])
        roots.append(pair[np.abs(pair).argmin()])
    taps = np.real(np.poly(roots + [-1.0] * moments))
    return (taps * np.sqrt(2) / taps.sum()).tolist()


def filters(wavelet: str) -> tuple[list[float], list[float]]:
    """The low-pass and high-pass decomposition filters; those of reconstruction are these reversed."""
    low = daubechies(MOMENTS[wavelet])
    return low[::-1], [x if j % 2 else -x for j, x in enumerate(low)]


def _weighted(terms: list[tuple[float, Column]]) -> Column:
    """The sum of values times numbers, in the order given."""
    total = F.lit(terms[0][0]) * terms[0][1]
    for number, value in terms[1:]:
        total = total + F.lit(number) * value
    return total


def series(df: DataFrame, value: str, key: str = "symbol", order: str = "open_time") -> DataFrame:
    """Rows (key, order, i, n, a): each key's finite values, numbered from 0 in order, with their number.

    Values that are null, NaN or infinite are left out.  Numbers come from counts of stretches of
    time, so a busy key is no hot task.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    rows = df.select(key, order, F.col(value).cast("double").alias("a")).where(finite)
    rows = running_total(rows, F.lit(1.0), "i", key, order, order)
    sizes = rows.groupBy(F.col(key).alias("_s")).agg(F.count("*").alias("n"))
    return rows.join(sizes, F.col(key).eqNullSafe(F.col("_s"))).select(key, order, (F.col("i") - 1).cast("bigint").alias("i"), "n", "a")


def _analysed(level: DataFrame, low: list[float], high: list[float], key: str, block: int) -> DataFrame:
    """One level down: from (key, n, i, a) to (key, n, i, a, d), about half as many rows.

    The series is continued over its ends by its mirror image, ends included, and goes on as its
    own image where it is shorter than the filter.  Coefficient i weighs the values at 2i + 1, 2i, ...
    Blocks get the values just before them as well.
    """
    taps = len(low)
    n, i = F.col("n"), F.col("i")
    around = F.ceil(F.lit(taps) / (2 * n))
    images = F.flatten(F.transform(F.sequence(-around, around), lambda m: F.array(i + 2 * n * m, 2 * n * m - 1 - i)))
    images = F.filter(images, lambda p: (p >= 2 - taps) & (p <= n + taps - 2))
    inner = (i >= taps) & (i < n - taps)
    placed = level.select(key, "n", "a", F.explode(F.when(inner, F.array(i)).otherwise(images)).alias("p"))
    width = 2 * block
    own = F.floor(F.col("p") / width)
    also = F.when(F.pmod("p", F.lit(width)) >= width - taps + 1, F.array(own, own + 1)).otherwise(F.array(own))
    placed = placed.select("*", F.explode(also).alias("block"))
    w = Window.partitionBy(key, "block").orderBy("p")
    back = [F.col("a")] + [F.lag("a", j).over(w) for j in range(1, taps)]
    made = placed.select(
        key, "block", "p", F.floor((n + taps - 1) / 2).alias("n"),
        _weighted(list(zip(low, back, strict=True))).alias("low"), _weighted(list(zip(high, back, strict=True))).alias("high"),
    )
    here = (F.floor(F.col("p") / width) == F.col("block")) & (F.col("p") > 0) & (F.pmod("p", F.lit(2)) == 1)
    return made.where(here).select(key, "n", ((F.col("p") - 1) / 2).cast("bigint").alias("i"), F.col("low").alias("a"), F.col("high").alias("d"))


def _synthesised(level: DataFrame, low: list[float], high: list[float], key: str, block: int) -> DataFrame:
    """One level up: from (key, i, a, d) to (key, i, a), undoing ``_analysed`` but for values past the end."""
    taps = len(low)
    reach = taps // 2 - 1
    low, high = low[::-1], high[::-1]
    own = F.floor(F.col("i") / block)
    also = F.when(F.pmod("i", F.lit(block)) >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    placed = level.select(key, "i", "a", "d", F.explode(also).alias("block"))
    w = Window.partitionBy(key, "block").orderBy("i")
    a = [F.col("a")] + [F.lag("a", q).over(w) for q in range(1, reach + 1)]
    d = [F.col("d")] + [F.lag("d", q).over(w) for q in range(1, reach + 1)]

    def value(side: int) -> Column:
        return _weighted([(low[2 * q + side], a[q]) for q in range(reach + 1)] + [(high[2 * q + side], d[q]) for q in range(reach + 1)])

    first = 2 * F.col("i") - taps + 2
    made = placed.select(key, "i", "block", F.array(F.struct(first.alias("i"), value(0).alias("a")), F.struct((first + 1).alias("i"), value(1).alias("a"))).alias("two"))
    here = (F.floor(F.col("i") / block) == F.col("block")) & (F.col("i") >= reach)
    return made.where(here).select(key, F.inline("two"))


def decompose(df: DataFrame, value: str = "close", wavelet: str = "db4", levels: int = 4, key: str = "symbol", order: str = "open_time", block: int = BLOCK) -> DataFrame:
    """Rows (key, level, i, n, a, d): approximation and detail of each level, from 1 (finest) to ``levels``.

    A level has floor((n + filter length - 1) / 2) coefficients of the n values below it, as many
    levels as asked for also for short series.  The transform needs ``a`` of the last level and ``d``
    of all.  Each level is written, since the next level, its details and their largest read it.
    Rows without a finite value are left out; a null key is a key of its own.
    """
    low, high = filters(wavelet)
    at = series(df, value, key, order).select(key, "n", "i", "a")
    out = None
    for level in range(1, levels + 1):
        at = written(_analysed(at, low, high, key, block), "wavelet")
        rows = at.select(key, F.lit(level).alias("level"), "i", "n", "a", "d")
        out = rows if out is None else out.unionByName(rows)
    return out


def reconstruct(coefficients: DataFrame, wavelet: str = "db4", levels: int = 4, key: str = "symbol", block: int = BLOCK) -> DataFrame:
    """Rows (key, i, a): the series whose coefficients ``decompose`` gave, with one value more at its end where its length was odd."""
    low, high = filters(wavelet)
    at = coefficients.where(F.col("level") == levels).select(key, "i", "a")
    for level in range(levels, 0, -1):
        own = coefficients.where(F.col("level") == level).select(F.col(key).alias("_s"), F.col("i").alias("_i"), "d")
        # The inner join leaves out the value past the end.
        both = at.join(own, F.col(key).eqNullSafe(F.col("_s")) & (F.col("i") == F.col("_i"))).select(key, "i", "a", "d")
        at = _synthesised(both, low, high, key, block)
    return at


def denoised(
    df: DataFrame, value: str = "close", wavelet: str = "db4", levels: int = 4, share: float = 0.3, key: str = "symbol", order: str = "open_time", block: int = BLOCK
) -> DataFrame:
    """Rows (key, order, value, denoised): the series with its small details shrunk away.

    Each level's details move towards 0 by ``share`` of the largest of them, and no further than 0.
    Rows without a finite value take no part and come out with null.
    """
    found = decompose(df, value, wavelet, levels, key, order, block)
    most = found.groupBy(F.col(key).alias("_s"), F.col("level").alias("_l")).agg((F.lit(share) * F.max(F.abs("d"))).alias("cut"))
    cut = found.join(most, F.col(key).eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l")))
    cut = cut.withColumn("d", F.signum("d") * F.greatest(F.abs("d") - F.col("cut"), F.lit(0.0))).select(*found.columns)
    made = reconstruct(cut, wavelet, levels, key, block).select(F.col(key).alias("_s"), F.col("i").alias("_i"), F.col("a").alias("denoised"))
    own = series(df, value, key, order).select(F.col(key).alias("_k"), F.col(order).alias("_o"), "i")
    made = own.join(made, F.col("_k").eqNullSafe(F.col("_s")) & (F.col("i") == F.col("_i"))).select("_k", "_o", "denoised")
    return df.join(made, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_o")), "left").select(key, order, value, "denoised")
