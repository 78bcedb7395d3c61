"""Features of bars: each function adds to a bar table columns that look back over its symbol's rows.

All windows are by symbol in order of time, so Spark sorts once for a chain of them.  Rolling
values are null until their window is full of values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ANNUAL, corrected_kurtosis, corrected_skew, log, ratio
from tidemark.functions.scans import fading, linear
from tidemark.functions.windows import back, backward_fill, forward_fill, frame, full, ordered, run_length

C = F.col


#: Columns of the bars that a table of features keeps.
KEEP = ("symbol", "open_time")


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds ``ret`` and ``log_ret`` against the bar before."""
    return bars.withColumn("ret", ratio(C("close"), back("close")) - 1).withColumn("log_ret", log(ratio(C("close"), back("close"))))


def returns_volatility(bars: DataFrame, windows: Sequence[int] = (5, 10, 20, 50, 100, 200), keep: Sequence[str] = KEEP) -> DataFrame:
    """Returns over several bars, and the annualised deviation of log returns."""
    df = with_returns(bars)
    return df.select(
        *keep, "ret", "log_ret",
        *[(ratio(C("close"), back("close", w)) - 1).alias(f"ret_{w}") for w in windows],
        *[(full(F.stddev_samp, C("log_ret"), w) * ANNUAL).alias(f"vol_{w}") for w in windows],
    )


def range_volatility(bars: DataFrame, windows: Sequence[int] = (10, 20, 50, 100), keep: Sequence[str] = KEEP) -> DataFrame:
    """Parkinson and Garman-Klass volatility."""
    hl = F.pow(log(ratio(C("high"), C("low"))), 2)
    gk = 0.5 * hl - (2 * math.log(2) - 1) * F.pow(log(ratio(C("close"), C("open"))), 2)
    df = bars.withColumn("hl", hl).withColumn("gk", gk)
    return df.select(
        *keep,
        *[(F.sqrt(full(F.avg, C("hl"), w) / (4 * math.log(2))) * ANNUAL).alias(f"parkinson_{w}") for w in windows],
        # A mean below 0, which open far from close can give, counts as no volatility.
        *[(F.when(full(F.avg, C("gk"), w).isNotNull(), F.sqrt(F.greatest(full(F.avg, C("gk"), w), F.lit(0.0)))) * ANNUAL).alias(f"garman_klass_{w}") for w in windows],
    )


def momentum_averages(bars: DataFrame, windows: Sequence[int] = (5, 10, 20, 50, 100), distances: Sequence[int] = (5, 10, 20, 50, 100, 200), keep: Sequence[str] = KEEP) -> DataFrame:
    """Momentum, rate of change, moving averages and the distance of the close from them."""
    return bars.select(
        *keep,
        *[(C("close") - back("close", w)).alias(f"momentum_{w}") for w in windows],
        *[(100 * (ratio(C("close"), back("close", w)) - 1)).alias(f"roc_{w}") for w in windows],
        *[full(F.avg, C("close"), w).alias(f"ma_{w}") for w in windows],
        *[(ratio(C("close"), full(F.avg, C("close"), w)) - 1).alias(f"ma_distance_{w}") for w in distances],
    )


def _gains(bars: DataFrame) -> DataFrame:
    change = C("close") - back("close")
    return bars.withColumn("gain", F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0))).withColumn(
        "loss", F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0))
    )


def _rsi(rows: int):
    up, down = full(F.avg, C("gain"), rows), full(F.avg, C("loss"), rows)
    return F.when((down == 0) & (up > 0), 100.0).otherwise(100 - ratio(F.lit(100.0), 1 + ratio(up, down)))


def rsi(bars: DataFrame, windows: Sequence[int] = (14, 21), keep: Sequence[str] = KEEP) -> DataFrame:
    """Relative strength by simple means: 100 where nothing was lost, null where nothing moved."""
    return _gains(bars).select(*keep, *[_rsi(w).alias(f"rsi_{w}") for w in windows])


def order_flow(bars: DataFrame, windows: Sequence[int] = (10, 20, 50), proxies: Sequence[int] = (50, 100), keep: Sequence[str] = KEEP) -> DataFrame:
    """The takers' buying share, volumes and trades with means, deviations and z-scores, and the share's mean distance from one half."""
    df = bars.withColumn("ofi", ratio(C("taker_buy_base"), C("volume")))
    df = df.withColumn("off", F.abs(C("ofi") - 0.5))
    out = []
    for w in windows:
        for name, x in (("ofi", C("ofi")), ("volume", C("volume"))):
            mean, std = full(F.avg, x, w), full(F.stddev_samp, x, w)
            out += [mean.alias(f"{name}_ma_{w}"), std.alias(f"{name}_std_{w}"), ratio(x - mean, std).alias(f"{name}_z_{w}")]
        out.append(full(F.avg, C("trades"), w).alias(f"trades_ma_{w}"))
    return df.select(*keep, "ofi", *out, *[full(F.avg, C("off"), w).alias(f"vpin_proxy_{w}") for w in proxies])


def illiquidity(bars: DataFrame, rows: int = 20, keep: Sequence[str] = KEEP) -> DataFrame:
    """Amihud illiquidity and its mean, and the deviation of returns over the mean volume."""
    df = with_returns(bars).withColumn("amihud", ratio(F.abs("ret"), C("quote_volume")))
    kyle = ratio(full(F.stddev_samp, C("ret"), rows), full(F.avg, C("volume"), rows))
    return df.select(*keep, (C("amihud") * 1e6).alias("amihud"), (full(F.avg, C("amihud"), rows) * 1e6).alias("amihud_ma"), kyle.alias("kyle_proxy"))


def forward_targets(bars: DataFrame, horizons: Sequence[int] = (1, 5, 15, 30), keep: Sequence[str] = KEEP) -> DataFrame:
    """Returns, directions and volatility over the next bars; a direction without a return is 0."""
    df = with_returns(bars)
    out = []
    for h in horizons:
        ahead = ratio(F.lead("close", h).over(ordered()), C("close")) - 1
        df = df.withColumn(f"target_return_{h}", ahead)
        out += [f"target_return_{h}", F.coalesce((C(f"target_return_{h}") > 0).cast("int"), F.lit(0)).alias(f"target_direction_{h}")]
        if h > 1:
            df = df.withColumn(f"_vol_{h}", full(F.stddev_samp, C("ret"), h))
            out.append(F.lead(f"_vol_{h}", h).over(ordered()).alias(f"target_volatility_{h}"))
    return df.select(*keep, *out)


def time_features(bars: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """Hour, weekday and month on the circle, the weekend, and trading sessions in UTC."""
    hour, day, month = F.hour("open_time"), F.weekday("open_time"), F.month("open_time")
    turn = lambda x, n: x * (2 * math.pi / n)
    return bars.select(
        *keep,
        F.sin(turn(hour, 24)).alias("hour_sin"), F.cos(turn(hour, 24)).alias("hour_cos"),
        F.sin(turn(day, 7)).alias("day_sin"), F.cos(turn(day, 7)).alias("day_cos"),
        F.sin(turn(month, 12)).alias("month_sin"), F.cos(turn(month, 12)).alias("month_cos"),
        (day >= 5).cast("int").alias("is_weekend"),
        ((hour >= 0) & (hour < 8)).cast("int").alias("asia"), ((hour >= 7) & (hour < 16)).cast("int").alias("europe"),
        ((hour >= 13) & (hour < 22)).cast("int").alias("us"),
    )


def feature_frame(bars: DataFrame, targets: bool = True) -> DataFrame:
    """One table of the bars with their returns, volatility, momentum, RSI, flow, illiquidity, times and targets.

    Each operator hands on the columns before it, so all windows share one exchange and one sort.
    """
    df = bars
    for add in (returns_volatility, range_volatility, momentum_averages, rsi, order_flow, illiquidity, time_features, *((forward_targets,) if targets else ())):
        df = add(df, keep=[c for c in df.columns if c not in ("ret", "log_ret")] if add is returns_volatility else df.columns)
    return df


def true_range(bars: DataFrame) -> DataFrame:
    """Adds ``tr``: the largest of the range and the distances to the close before."""
    prev = back("close")
    return bars.withColumn("tr", F.greatest(C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev)))


def atr(bars: DataFrame, windows: Sequence[int] = (14, 20, 50)) -> DataFrame:
    """Mean true range, and that as a share of the close."""
    df = true_range(bars)
    means = {w: full(F.avg, C("tr"), w) for w in windows}
    return df.select("symbol", "open_time", "tr", *[m.alias(f"atr_{w}") for w, m in means.items()], *[ratio(m, C("close")).alias(f"atr_pct_{w}") for w, m in means.items()])


def volatility_regime(bars: DataFrame) -> DataFrame:
    """Short over long volatility, its z-score and the volatility of volatility."""
    df = with_returns(bars)
    df = df.withColumn("v10", full(F.stddev_samp, C("log_ret"), 10)).withColumn("v50", full(F.stddev_samp, C("log_ret"), 50))
    z = ratio(C("v10") - full(F.avg, C("v10"), 50), full(F.stddev_samp, C("v10"), 50))
    return df.select("symbol", "open_time", ratio(C("v10"), C("v50")).alias("vol_regime"), z.alias("vol_z"), full(F.stddev_samp, C("v10"), 20).alias("vol_of_vol"))


def sharpe_and_gap(bars: DataFrame, windows: Sequence[int] = (20, 50), gap: int = 8) -> DataFrame:
    """The return of some bars over its deviation, and the open against the close ``gap`` bars before."""
    df = with_returns(bars)
    sharpe = [((ratio(C("close"), back("close", w)) - 1) / (full(F.stddev_samp, C("ret"), w) * math.sqrt(w) + 1e-10)).alias(f"rolling_sharpe_{w}") for w in windows]
    return df.select("symbol", "open_time", *sharpe, (ratio(C("open"), back("close", gap)) - 1).alias("gap"))


def volume_profile(bars: DataFrame, rows: int = 20, windows: Sequence[int] = (20, 50), deltas: Sequence[int] = (10, 20, 50), long: int = 50) -> DataFrame:
    """Relative volume, its z-score, dollar volume, trades, trade size, VWAP, cumulative delta and buy pressure.

    ``windows`` are those of volumes, ``deltas`` those of the cumulative delta, ``long`` that of trades and
    their size, ``rows`` that of the others.
    """
    typical = (C("high") + C("low") + C("close")) / 3
    df = bars.withColumn("tpv", typical * C("volume")).withColumn("delta", 2 * C("taker_buy_base") - C("volume")).withColumn("size", ratio(C("volume"), C("trades")))
    volume = full(F.sum, C("volume"), rows)
    vwap = ratio(full(F.sum, C("tpv"), rows), volume)
    trades = full(F.avg, C("trades"), long)
    return df.select(
        "symbol", "open_time",
        *[ratio(C("volume"), full(F.avg, C("volume"), w)).alias(f"relative_volume_{w}") for w in windows],
        *[ratio(C("volume") - full(F.avg, C("volume"), w), full(F.stddev_samp, C("volume"), w)).alias(f"volume_z_{w}") for w in windows],
        ratio(C("quote_volume"), full(F.avg, C("quote_volume"), rows)).alias("dollar_volume_ratio"),
        trades.alias("trades_ma"), ratio(C("trades") - trades, full(F.stddev_samp, C("trades"), long)).alias("trades_z"), C("size").alias("trade_size"),
        ratio(C("size"), full(F.avg, C("size"), long)).alias("trade_size_ratio"), vwap.alias("vwap"), (ratio(C("close"), vwap) - 1).alias("vwap_distance"),
        *[full(F.sum, C("delta"), w).alias(f"cvd_{w}") for w in deltas], *[ratio(full(F.sum, C("delta"), w), full(F.sum, C("volume"), w)).alias(f"cvd_share_{w}") for w in deltas],
        ratio(full(F.sum, C("taker_buy_base"), rows), volume).alias("buy_pressure"),
    )


def spread_efficiency(bars: DataFrame, rows: int = 20, windows: Sequence[int] = (20, 50)) -> DataFrame:
    """The range in basis points with means and z-scores, and the absolute return against log volume."""
    df = with_returns(bars).withColumn("spread", 1e4 * ratio(C("high") - C("low"), C("close")))
    df = df.withColumn("efficiency", ratio(F.abs("ret"), F.log1p("volume")) * 1000)
    out = []
    for w in windows:
        mean, std = full(F.avg, C("spread"), w), full(F.stddev_samp, C("spread"), w)
        out += [mean.alias(f"spread_ma_{w}"), ratio(C("spread") - mean, std).alias(f"spread_z_{w}")]
    return df.select("symbol", "open_time", "spread", *out, "efficiency", full(F.avg, C("efficiency"), rows).alias("efficiency_ma"))


def ema(bars: DataFrame, spans: Sequence[int] = (12, 26, 50)) -> DataFrame:
    """Exponential means of the close, from its first value on, and the close's distance from them; computed by blocks of time."""
    rates = [2 / (s + 1) for s in spans]
    df = linear(bars, "symbol", "open_time", ["close"], fading([1 - a for a in rates], rates), lambda x: np.repeat(x[0], len(spans)), [f"ema_{s}" for s in spans])
    return df.select("*", *[(ratio(C("close"), C(f"ema_{s}")) - 1).alias(f"ema_distance_{s}") for s in spans])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD, its signal line, histogram and the histogram's change: exponential means of exponential means, computed by blocks of time."""
    f, s, g = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    # The signal takes the two means after their own step, so its row holds theirs.
    a = np.array([[1 - f, 0, 0], [0, 1 - s, 0], [g * (1 - f), -g * (1 - s), 1 - g]])
    b = np.array([f, s, g * (f - s)])
    df = linear(bars, "symbol", "open_time", ["close"], lambda x: (np.repeat(a[None], len(x), 0), x * b), lambda x: np.array([x[0], x[0], 0.0]), ["f", "s", "g"])
    df = df.select("symbol", "open_time", (C("f") - C("s")).alias("macd"), C("g").alias("macd_signal"), (C("f") - C("s") - C("g")).alias("macd_hist"))
    return df.withColumn("macd_hist_change", C("macd_hist") - back("macd_hist"))


def oscillators(bars: DataFrame) -> DataFrame:
    """Stochastic RSI with its means, Williams %R and the commodity channel index."""
    df = _gains(bars).withColumn("rsi", _rsi(14)).withColumn("tp", (C("high") + C("low") + C("close")) / 3)
    low, high = full(F.min, C("rsi"), 14), full(F.max, C("rsi"), 14)
    df = df.withColumn("stoch", ratio(C("rsi") - low, high - low))
    df = df.withColumn("stoch_k", full(F.avg, C("stoch"), 3))
    williams = []
    for w in (14, 21):
        hh, ll = full(F.max, C("high"), w), full(F.min, C("low"), w)
        williams.append((-100 * ratio(hh - C("close"), hh - ll)).alias(f"williams_{w}"))
    cci = ratio(C("tp") - full(F.avg, C("tp"), 20), 0.015 * full(F.stddev_samp, C("tp"), 20))
    return df.select("symbol", "open_time", "stoch", "stoch_k", full(F.avg, C("stoch_k"), 3).alias("stoch_d"), *williams, cci.alias("cci"))


def bands(bars: DataFrame, windows: Sequence[int] = (20, 50), scores: Sequence[int] = (20, 50, 100)) -> DataFrame:
    """Bollinger width and position, and the z-score of the close."""
    out = []
    for w in windows:
        mean, std = full(F.avg, C("close"), w), full(F.stddev_samp, C("close"), w)
        out += [ratio(4 * std, mean).alias(f"bollinger_width_{w}"), ratio(C("close") - (mean - 2 * std), 4 * std).alias(f"bollinger_position_{w}")]
    out += [ratio(C("close") - full(F.avg, C("close"), w), full(F.stddev_samp, C("close"), w)).alias(f"price_z_{w}") for w in scores]
    return bars.select("symbol", "open_time", *out)


def adx(bars: DataFrame, rows: int = 14) -> DataFrame:
    """Directional movement by simple means: +DI, -DI and ADX."""
    up, down = C("high") - back("high"), back("low") - C("low")
    df = true_range(bars).withColumn("plus", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("minus", F.when((down > up) & (down > 0), down).otherwise(0.0))
    atr_ = full(F.avg, C("tr"), rows)
    df = df.withColumn("plus_di", 100 * ratio(full(F.avg, C("plus"), rows), atr_)).withColumn("minus_di", 100 * ratio(full(F.avg, C("minus"), rows), atr_))
    df = df.withColumn("dx", 100 * ratio(F.abs(C("plus_di") - C("minus_di")), C("plus_di") + C("minus_di")))
    return df.select("symbol", "open_time", "plus_di", "minus_di", full(F.avg, C("dx"), rows).alias("adx"))


def keltner(bars: DataFrame, span: int = 20) -> DataFrame:
    """The close's place in a channel of two mean true ranges around the exponential mean."""
    mean = ema(bars, [span]).select(C("symbol").alias("s"), C("open_time").alias("t"), f"ema_{span}")
    df = true_range(bars).withColumn("atr", full(F.avg, C("tr"), span))
    df = df.join(mean, (C("symbol") == C("s")) & (C("open_time") == C("t")))
    return df.select("symbol", "open_time", ratio(C("close") - (C(f"ema_{span}") - 2 * C("atr")), 4 * C("atr")).alias("keltner_position"))


def moments(bars: DataFrame, windows: Sequence[int] = (20, 50)) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis of log returns."""
    df = with_returns(bars)
    out = []
    for w in windows:
        n = F.lit(w)
        out += [corrected_skew(full(F.skewness, C("log_ret"), w), n).alias(f"skew_{w}"), corrected_kurtosis(full(F.kurtosis, C("log_ret"), w), n).alias(f"kurt_{w}")]
    return df.select("symbol", "open_time", *out)


def autocorrelation(bars: DataFrame, rows: int = 50, lags: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """The correlation of returns with earlier ones within a window."""
    df = with_returns(bars)
    out = []
    for k in lags:
        df = df.withColumn(f"_lag_{k}", back("ret", k))
        both = F.corr("ret", f"_lag_{k}").over(frame(rows - k))
        out.append(F.when(F.count("ret").over(frame(rows)) == rows, both).alias(f"autocorr_{k}"))
    return df.select("symbol", "open_time", *out)


def extremes(bars: DataFrame, windows: Sequence[int] = (20, 50, 100)) -> DataFrame:
    """New highs and lows against the window before, distances from them, and the place in the range."""
    df = bars
    for w in windows:
        df = df.withColumn(f"hh_{w}", full(F.max, C("high"), w)).withColumn(f"ll_{w}", full(F.min, C("low"), w))
    out = []
    for w in windows:
        hh, ll = C(f"hh_{w}"), C(f"ll_{w}")
        out += [
            F.coalesce((C("high") > back(f"hh_{w}")).cast("int"), F.lit(0)).alias(f"higher_high_{w}"), F.coalesce((C("low") < back(f"ll_{w}")).cast("int"), F.lit(0)).alias(f"lower_low_{w}"),
            (ratio(C("close"), hh) - 1).alias(f"from_high_{w}"), (ratio(C("close"), ll) - 1).alias(f"from_low_{w}"), ratio(C("close") - ll, hh - ll).alias(f"range_position_{w}"),
        ]
    return df.select("symbol", "open_time", *out)


def streaks(bars: DataFrame) -> DataFrame:
    """How many bars in a row have closed above, or not above, the one before."""
    df = bars.withColumn("up", F.coalesce((C("close") > back("close")).cast("int"), F.lit(0)))
    df = run_length(df, C("up"), "run")
    return df.select("symbol", "open_time", F.when(C("up") == 1, C("run")).otherwise(0).alias("up_streak"), F.when(C("up") == 0, C("run")).otherwise(0).alias("down_streak"))


def filled(bars: DataFrame, column: str, how: str = "ffill_bfill") -> DataFrame:
    """Fills nulls of a column forward, and backward too unless ``how`` is ``ffill``.

    The backward fill looks ahead; it is what batch pipelines do before training.
    """
    if how not in ("ffill", "ffill_bfill"):
        raise ValueError(f"unknown fill: {how}")
    x = forward_fill(C(column))
    return bars.withColumn(column, x if how == "ffill" else F.coalesce(x, backward_fill(C(column))))


def feature_report(df: DataFrame, columns: Sequence[str], most: float = 1e10) -> DataFrame:
    """One row per feature: nulls, infinities, distinct values and huge ones, in one pass."""
    aggs = []
    for c in columns:
        x = C(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"), F.sum(x.isNull().cast("bigint")).alias("nulls"), F.sum((F.abs(x) == float("inf")).cast("bigint")).alias("infinite"),
                F.min(x).eqNullSafe(F.max(x)).alias("constant"), F.sum((F.abs(x) > most).cast("bigint")).alias("huge"),
            )
        )
    one = df.agg(F.array(*aggs).alias("r"))
    return one.select(F.inline("r")).select("feature", "nulls", F.coalesce("infinite", F.lit(0)).alias("infinite"), "constant", F.coalesce("huge", F.lit(0)).alias("huge"))


def split(bars: DataFrame, train: float = 0.7, validate: float = 0.15, embargo: int = 0) -> DataFrame:
    """Each symbol's bars in order as train, validate and test, with ``embargo`` bars left out on both sides of a cut."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    i = F.row_number().over(ordered()) - 1
    df = bars.withColumn("_i", i).withColumn("_n", n).withColumn("_a", F.floor(C("_n") * train)).withColumn("_b", F.floor(C("_n") * (train + validate)))
    part = F.when(C("_i") < C("_a") - embargo, "train").when((C("_i") >= C("_a") + embargo) & (C("_i") < C("_b") - embargo), "validate").when(C("_i") >= C("_b") + embargo, "test")
    return df.withColumn("part", part).drop("_i", "_n", "_a", "_b")


def sequences(df: DataFrame, features: Sequence[str], label: str, rows: int = 60) -> DataFrame:
    """The last ``rows`` rows before each one as arrays, with its own label; only where all are there."""
    w = ordered().rowsBetween(-rows, -1)
    out = df.withColumn("_seq", F.collect_list(F.array(*[C(c).cast("double") for c in features])).over(w))
    return out.where((F.size("_seq") == rows) & C(label).isNotNull()).select("symbol", "open_time", C("_seq").alias("sequence"), label)


def robust_scaled(df: DataFrame, column: str, train: str = "part = 'train'") -> DataFrame:
    """A column less its symbol's median over the interquartile range, both of the training rows alone."""
    q = df.where(train).groupBy(C("symbol").alias("_s")).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return df.join(q, C("symbol") == C("_s"), "left").withColumn(f"{column}_scaled", ratio(C(column) - C("_q")[1], C("_q")[2] - C("_q")[0])).drop("_s", "_q")


def fisher_range(bars: DataFrame, rows: int = 20) -> DataFrame:
    """The close scaled to its range of the window and passed through the Fisher transform."""
    f = frame(rows + 1)
    low, high = F.min("close").over(f), F.max("close").over(f)
    x = F.greatest(F.least(2 * ratio(C("close") - low, high - low) - 1, F.lit(0.999)), F.lit(-0.999))
    ok = (F.row_number().over(ordered()) > rows) & (high - low > 1e-10)
    return bars.select("symbol", "open_time", F.when(ok, 0.5 * F.ln((1 + x) / (1 - x))).alias("fisher"))
