"""Queries over hourly bars of the events, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import ANNUAL, r6
from tidemark.operators import bars as B
from tidemark.sources import adapters as A

TICKS = """ticks AS (
  SELECT event_id, event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty,
    CAST(user_id % 2 AS INTEGER) AS side FROM events)"""
BARS = f"""{TICKS}, bars AS (
  SELECT symbol, date_trunc('hour', ts) AS open_time, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, ts) AS close, sum(CAST(qty AS DOUBLE)) AS volume, sum(price * qty) AS quote_volume, count(*) AS trades,
    sum(CASE WHEN side = 1 THEN CAST(qty AS DOUBLE) ELSE 0 END) AS taker_buy_base,
    sum(CASE WHEN side = 1 THEN price * qty ELSE 0 END) AS taker_buy_quote FROM ticks GROUP BY ALL)"""
W = "PARTITION BY symbol ORDER BY open_time"
RETS = f"""{BARS}, rets AS (
  SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, CASE WHEN close / nullif(lag(close) OVER w, 0) > 0 THEN ln(close / nullif(lag(close) OVER w, 0)) END AS log_ret FROM bars WINDOW w AS ({W}))"""


def full(agg: str, x: str, rows: int) -> str:
    """A rolling aggregate in SQL, null until the window is full of values."""
    f = f"OVER ({W} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {rows} THEN {agg}({x}) {f} END"


def back(x: str, rows: int = 1) -> str:
    return f"lag({x}, {rows}) OVER ({W})"


def rounded(columns: dict[str, str], source: str, with_: str = BARS, plain: tuple[str, ...] = (), digits: int = 6) -> str:
    """SELECT symbol, open_time and the rounded columns."""
    cols = ", ".join([f"round({e}, {digits}) AS {n}" for n, e in columns.items()] + [p for p in plain])
    return f"WITH {with_} SELECT symbol, open_time, {cols} FROM {source}"


def query(operator: Callable[[DataFrame], DataFrame], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies an operator to the bars and rounds its doubles."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(A.bars(spark, sf_dir))
        return out.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    run.__doc__ = operator.__doc__
    return run


def ohlcv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars."""
    return query(lambda b: b)(spark, sf_dir)


def fill_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The takers' share where a bar has volume beyond 50, filled forward, and backward too."""
    bars = A.bars(spark, sf_dir).select("symbol", "open_time", F.when(F.col("volume") > 50, F.col("taker_buy_base")).alias("x"))
    both = B.filled(B.filled(bars.withColumn("f", F.col("x")).withColumn("fb", F.col("x")), "f", "ffill"), "fb")
    return both.select("symbol", "open_time", r6(F.col("f")).alias("forward"), r6(F.col("fb")).alias("both_ways"))


def feature_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, infinities, constants and huge values of some features."""
    return B.feature_report(B.returns_volatility(A.bars(spark, sf_dir)).withColumn("one", F.lit(1.0)), ["ret", "vol_20", "ret_10", "one"])


def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and time bounds of each symbol's parts, with an embargo of two bars."""
    return B.split(A.bars(spark, sf_dir), embargo=2).groupBy("symbol", "part").agg(
        F.count("*").alias("n"), F.min("open_time").alias("first"), F.max("open_time").alias("last")
    )


def training_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the sequences of sixty bars before each bar."""
    s = B.sequences(A.bars(spark, sf_dir), ["close", "volume"], "trades")
    total = lambda k: F.aggregate(F.transform("sequence", lambda x: x[k]), F.lit(0.0), lambda a, x: a + x)
    return s.select("symbol", "open_time", F.size("sequence").alias("length"), F.round(total(0), 4).alias("closes"), F.round(total(1), 4).alias("volumes"), "trades")


def train_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes scaled by the training rows' median and interquartile range."""
    s = B.robust_scaled(B.split(A.bars(spark, sf_dir)), "volume")
    return s.select("symbol", "open_time", r6(F.col("volume_scaled")).alias("volume_scaled"))


def rolling_hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hurst exponent of the last hundred closes."""
    from tidemark.operators.spectral import rolling_hurst as hurst

    return hurst(A.bars(spark, sf_dir)).withColumn("hurst", F.round("hurst", 5))


QUERIES = {
    "ohlcv_bars": ohlcv_bars,
    "fill_policies": fill_policies,
    "feature_validation": feature_validation,
    "chronological_split": chronological_split,
    "training_sequences": training_sequences,
    "train_scaling": train_scaling,
    "rolling_hurst": rolling_hurst,
} | {
    name: query(operator, 7 if name == "atr" else 6)
    for name, operator in {
        "returns_volatility": B.returns_volatility, "range_volatility": B.range_volatility, "momentum_averages": B.momentum_averages, "rsi": B.rsi,
        "order_flow": B.order_flow, "illiquidity": B.illiquidity, "forward_targets": B.forward_targets, "time_features": B.time_features, "atr": B.atr,
        "volatility_regime": B.volatility_regime, "sharpe_and_gap": B.sharpe_and_gap, "volume_profile": B.volume_profile, "spread_efficiency": B.spread_efficiency,
        "ema": B.ema, "macd": B.macd, "oscillators": B.oscillators, "bands": B.bands, "adx": B.adx, "keltner": B.keltner, "moments": B.moments,
        "autocorrelation": B.autocorrelation, "extremes": B.extremes, "streaks": B.streaks, "fisher_range": B.fisher_range,
    }.items()
}

#: Windows of returns and averages.
_LONG = (5, 10, 20, 50, 100, 200)
_LN = lambda a, b: f"CASE WHEN {a} / nullif({b}, 0) > 0 THEN ln({a} / nullif({b}, 0)) END"
_HL, _GK = f"pow({_LN('high', 'low')}, 2)", f"0.5 * pow({_LN('high', 'low')}, 2) - {2 * math.log(2) - 1!r} * pow({_LN('close', 'open')}, 2)"
_GAINS = f"""{BARS}, gains AS (SELECT *, coalesce(greatest(close - {back('close')}, 0), 0) AS gain, coalesce(greatest({back('close')} - close, 0), 0) AS loss FROM bars)"""


def _rsi(w: int) -> str:
    up, down = full("avg", "gain", w), full("avg", "loss", w)
    return f"CASE WHEN ({down}) = 0 AND ({up}) > 0 THEN 100 ELSE 100 - 100 / nullif(1 + ({up}) / nullif(({down}), 0), 0) END"


_FLOW = f"{BARS}, flow AS (SELECT *, taker_buy_base / nullif(volume, 0) AS ofi FROM bars), off AS (SELECT *, abs(ofi - 0.5) AS d FROM flow)"
_TR = f"{BARS}, trs AS (SELECT *, greatest(high - low, abs(high - {back('close')}), abs(low - {back('close')})) AS tr FROM bars)"
_T = lambda x, n: f"{x} * {2 * math.pi / n!r}"
_EMA = lambda a, x, prev: f"{a!r} * {x} + {1 - a!r} * {prev}"
_NUMBERED = f"{BARS}, numbered AS (SELECT *, row_number() OVER ({W}) AS i FROM bars)"


def _recursive(step: dict[str, str], first: dict[str, str]) -> str:
    """Folds bars in order in a recursive common table expression."""
    names = ", ".join(step)
    return f"""WITH RECURSIVE {_NUMBERED}, folded AS (
      SELECT symbol, open_time, close, i, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in first.items())} FROM numbered WHERE i = 1
      UNION ALL
      SELECT n.symbol, n.open_time, n.close, n.i, {", ".join(step.values())} FROM folded f JOIN numbered n ON n.symbol = f.symbol AND n.i = f.i + 1),
    done AS (SELECT symbol, open_time, close, {names} FROM folded)"""


_A = {s: 2 / (s + 1) for s in (9, 12, 20, 26, 50)}
_F, _S = _EMA(_A[12], "n.close", "f.f"), _EMA(_A[26], "n.close", "f.s")

ORACLE_SQL = {
    "ohlcv_bars": rounded({c: c for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote")}, "bars", plain=("trades",)),
    "returns_volatility": rounded(
        {"ret": "ret", "log_ret": "log_ret"}
        | {f"ret_{w}": f"close / nullif({back('close', w)}, 0) - 1" for w in _LONG}
        | {f"vol_{w}": f"({full('stddev_samp', 'log_ret', w)}) * {ANNUAL!r}" for w in _LONG}, "rets", RETS),
    "range_volatility": rounded(
        {f"parkinson_{w}": f"sqrt(({full('avg', 'hl', w)}) / {4 * math.log(2)!r}) * {ANNUAL!r}" for w in _LONG[1:5]}
        | {f"garman_klass_{w}": f"sqrt(greatest({full('avg', 'gk', w)}, CASE WHEN ({full('avg', 'gk', w)}) IS NOT NULL THEN 0 END)) * {ANNUAL!r}" for w in _LONG[1:5]},
        "r", f"{BARS}, r0 AS (SELECT *, {_HL} AS hl, {_GK} AS gk FROM bars), r AS (SELECT * FROM r0)"),
    "momentum_averages": rounded(
        {f"momentum_{w}": f"close - {back('close', w)}" for w in _LONG[:5]} | {f"roc_{w}": f"100 * (close / nullif({back('close', w)}, 0) - 1)" for w in _LONG[:5]}
        | {f"ma_{w}": full("avg", "close", w) for w in _LONG[:5]} | {f"ma_distance_{w}": f"close / nullif({full('avg', 'close', w)}, 0) - 1" for w in _LONG}, "bars"),
    "rsi": rounded({f"rsi_{w}": _rsi(w) for w in (14, 21)}, "gains", _GAINS),
    "order_flow": rounded(
        {"ofi": "ofi"} | {f"{x}_ma_{w}": full("avg", x, w) for w in (10, 20, 50) for x in ("ofi", "volume", "trades")} | {f"{x}_std_{w}": full("stddev_samp", x, w) for w in (10, 20, 50) for x in ("ofi", "volume")}
        | {f"{x}_z_{w}": f"({x} - ({full('avg', x, w)})) / nullif({full('stddev_samp', x, w)}, 0)" for w in (10, 20, 50) for x in ("ofi", "volume")}
        | {f"vpin_proxy_{w}": full("avg", "d", w) for w in (50, 100)}, "off", _FLOW),
    "illiquidity": rounded(
        {"amihud": "amihud * 1e6", "amihud_ma": f"({full('avg', 'amihud', 20)}) * 1e6", "kyle_proxy": f"({full('stddev_samp', 'ret', 20)}) / nullif({full('avg', 'volume', 20)}, 0)"},
        "a", f"{RETS}, a AS (SELECT *, abs(ret) / nullif(quote_volume, 0) AS amihud FROM rets)"),
    "forward_targets": rounded(
        {f"target_return_{h}": f"lead(close, {h}) OVER ({W}) / nullif(close, 0) - 1" for h in (1, 5, 15, 30)} | {f"target_volatility_{h}": f"lead(v{h}, {h}) OVER ({W})" for h in (5, 15, 30)},
        "v", f"{RETS}, v AS (SELECT *, {full('stddev_samp', 'ret', 5)} AS v5, {full('stddev_samp', 'ret', 15)} AS v15, {full('stddev_samp', 'ret', 30)} AS v30 FROM rets)",
        tuple(f"CAST(coalesce(lead(close, {h}) OVER ({W}) / nullif(close, 0) - 1 > 0, false) AS INTEGER) AS target_direction_{h}" for h in (1, 5, 15, 30))),
    "time_features": rounded(
        {f"{n}_{f}": f"{f}({_T(x, k)})" for n, x, k in (("hour", "hour(open_time)", 24), ("day", "(isodow(open_time) - 1)", 7), ("month", "month(open_time)", 12)) for f in ("sin", "cos")},
        "bars", plain=("CAST(isodow(open_time) >= 6 AS INTEGER) AS is_weekend", "CAST(hour(open_time) < 8 AS INTEGER) AS asia",
                       "CAST(hour(open_time) BETWEEN 7 AND 15 AS INTEGER) AS europe", "CAST(hour(open_time) BETWEEN 13 AND 21 AS INTEGER) AS us")),
    "atr": rounded({"tr": "tr"} | {f"atr_{w}": full("avg", "tr", w) for w in (14, 20, 50)} | {f"atr_pct_{w}": f"({full('avg', 'tr', w)}) / nullif(close, 0)" for w in (14, 20, 50)}, "trs", _TR, digits=7),
    "volatility_regime": rounded(
        {"vol_regime": "v10 / nullif(v50, 0)", "vol_z": f"(v10 - ({full('avg', 'v10', 50)})) / nullif({full('stddev_samp', 'v10', 50)}, 0)", "vol_of_vol": full("stddev_samp", "v10", 20)},
        "v", f"{RETS}, v AS (SELECT *, {full('stddev_samp', 'log_ret', 10)} AS v10, {full('stddev_samp', 'log_ret', 50)} AS v50 FROM rets)"),
    "sharpe_and_gap": rounded(
        {f"rolling_sharpe_{w}": f"(close / nullif({back('close', w)}, 0) - 1) / (({full('stddev_samp', 'ret', w)}) * {math.sqrt(w)!r} + 1e-10)" for w in (20, 50)} | {"gap": f"open / nullif({back('close', 8)}, 0) - 1"}, "rets", RETS),
    "volume_profile": rounded(
        {f"relative_volume_{w}": f"volume / nullif({full('avg', 'volume', w)}, 0)" for w in (20, 50)} | {f"volume_z_{w}": f"(volume - ({full('avg', 'volume', w)})) / nullif({full('stddev_samp', 'volume', w)}, 0)" for w in (20, 50)}
        | {"dollar_volume_ratio": f"quote_volume / nullif({full('avg', 'quote_volume', 20)}, 0)", "trades_ma": full("avg", "trades", 50), "trades_z": f"(trades - ({full('avg', 'trades', 50)})) / nullif({full('stddev_samp', 'trades', 50)}, 0)",
         "trade_size": "size", "trade_size_ratio": f"size / nullif({full('avg', 'size', 50)}, 0)",
         "vwap": f"({full('sum', 'tpv', 20)}) / nullif({full('sum', 'volume', 20)}, 0)", "vwap_distance": f"close / nullif(({full('sum', 'tpv', 20)}) / nullif({full('sum', 'volume', 20)}, 0), 0) - 1",
         "buy_pressure": f"({full('sum', 'taker_buy_base', 20)}) / nullif({full('sum', 'volume', 20)}, 0)"}
        | {f"cvd_{w}": full("sum", "delta", w) for w in (10, 20, 50)} | {f"cvd_share_{w}": f"({full('sum', 'delta', w)}) / nullif({full('sum', 'volume', w)}, 0)" for w in (10, 20, 50)},
        "p", f"{BARS}, p AS (SELECT *, (high + low + close) / 3 * volume AS tpv, 2 * taker_buy_base - volume AS delta, volume / trades AS size FROM bars)"),
    "spread_efficiency": rounded(
        {"spread": "spread", "efficiency": "efficiency", "efficiency_ma": full("avg", "efficiency", 20)}
        | {f"spread_ma_{w}": full("avg", "spread", w) for w in (20, 50)} | {f"spread_z_{w}": f"(spread - ({full('avg', 'spread', w)})) / nullif({full('stddev_samp', 'spread', w)}, 0)" for w in (20, 50)},
        "s", f"{RETS}, s AS (SELECT *, 1e4 * ((high - low) / nullif(close, 0)) AS spread, abs(ret) / nullif(ln(1 + volume), 0) * 1000 AS efficiency FROM rets)"),
    "ema": _recursive({f"ema_{s}": _EMA(_A[s], "n.close", f"f.ema_{s}") for s in (12, 26, 50)}, {f"ema_{s}": "close" for s in (12, 26, 50)})
        + " SELECT symbol, open_time, round(close, 6) AS close, round(ema_12, 6) AS ema_12, round(ema_26, 6) AS ema_26, round(ema_50, 6) AS ema_50, " + ", ".join(f"round(close / nullif(ema_{s}, 0) - 1, 6) AS ema_distance_{s}" for s in (12, 26, 50)) + " FROM done",
    "macd": _recursive({"f": _F, "s": _S, "g": _EMA(_A[9], f"(({_F}) - ({_S}))", "f.g")}, {"f": "close", "s": "close", "g": "0"})
        + " SELECT symbol, open_time, round(f - s, 6) AS macd, round(g, 6) AS macd_signal, round(f - s - g, 6) AS macd_hist, round(f - s - g - lag(f - s - g) OVER (" + W + "), 6) AS macd_hist_change FROM done",
    "oscillators": rounded(
        {"stoch": "stoch", "stoch_k": "k", "stoch_d": full("avg", "k", 3), } | {f"williams_{w}": f"-100 * ((({full('max', 'high', w)}) - close) / nullif(({full('max', 'high', w)}) - ({full('min', 'low', w)}), 0))" for w in (14, 21)} | {
         "cci": f"(tp - ({full('avg', 'tp', 20)})) / nullif(0.015 * ({full('stddev_samp', 'tp', 20)}), 0)"},
        "o3", f"""{_GAINS}, o1 AS (SELECT *, {_rsi(14)} AS rsi, (high + low + close) / 3 AS tp FROM gains),
        o2 AS (SELECT *, (rsi - ({full('min', 'rsi', 14)})) / nullif(({full('max', 'rsi', 14)}) - ({full('min', 'rsi', 14)}), 0) AS stoch FROM o1), o3 AS (SELECT *, {full('avg', 'stoch', 3)} AS k FROM o2)"""),
    "bands": rounded(
        {f"bollinger_width_{w}": f"4 * ({full('stddev_samp', 'close', w)}) / nullif({full('avg', 'close', w)}, 0)" for w in (20, 50)}
        | {f"bollinger_position_{w}": f"(close - (({full('avg', 'close', w)}) - 2 * ({full('stddev_samp', 'close', w)}))) / nullif(4 * ({full('stddev_samp', 'close', w)}), 0)" for w in (20, 50)}
        | {f"price_z_{w}": f"(close - ({full('avg', 'close', w)})) / nullif({full('stddev_samp', 'close', w)}, 0)" for w in (20, 50, 100)}, "bars"),
    "adx": rounded(
        {"plus_di": "p", "minus_di": "m", "adx": full("avg", "dx", 14)},
        "d3", f"""{_TR}, d1 AS (SELECT *, high - {back('high')} AS up, {back('low')} - low AS down FROM trs),
        d2 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pl, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mi FROM d1),
        d25 AS (SELECT *, 100 * (({full('avg', 'pl', 14)}) / nullif({full('avg', 'tr', 14)}, 0)) AS p, 100 * (({full('avg', 'mi', 14)}) / nullif({full('avg', 'tr', 14)}, 0)) AS m FROM d2),
        d3 AS (SELECT *, 100 * (abs(p - m) / nullif(p + m, 0)) AS dx FROM d25)"""),
    "keltner": _recursive({"e": _EMA(_A[20], "n.close", "f.e")}, {"e": "close"})
        + f""", trs AS (SELECT *, greatest(high - low, abs(high - {back('close')}), abs(low - {back('close')})) AS tr FROM bars), k AS (SELECT *, {full('avg', 'tr', 20)} AS a FROM trs)
        SELECT k.symbol, k.open_time, round((k.close - (d.e - 2 * k.a)) / nullif(4 * k.a, 0), 6) AS keltner_position FROM k JOIN done d USING (symbol, open_time)""",
    "moments": rounded({f"{n}_{w}": full(a, "log_ret", w) for w in (20, 50) for n, a in (("skew", "skewness"), ("kurt", "kurtosis"))}, "rets", RETS),
    "autocorrelation": rounded(
        {f"autocorr_{k}": f"CASE WHEN count(ret) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 50 THEN corr(ret, l{k}) OVER ({W} ROWS BETWEEN {49 - k} PRECEDING AND CURRENT ROW) END" for k in (1, 5, 10)},
        "l", f"{RETS}, l AS (SELECT *, {back('ret', 1)} AS l1, {back('ret', 5)} AS l5, {back('ret', 10)} AS l10 FROM rets)"),
    "extremes": rounded(
        {f"from_high_{w}": f"close / nullif(hh{w}, 0) - 1" for w in (20, 50, 100)} | {f"from_low_{w}": f"close / nullif(ll{w}, 0) - 1" for w in (20, 50, 100)} | {f"range_position_{w}": f"(close - ll{w}) / nullif(hh{w} - ll{w}, 0)" for w in (20, 50, 100)},
        "x", f"{BARS}, x AS (SELECT *, {', '.join(f'{full(a, c, w)} AS {n}{w}' for w in (20, 50, 100) for a, c, n in (('max', 'high', 'hh'), ('min', 'low', 'll')))} FROM bars)",
        tuple(f"CAST(coalesce({c} {s} {back(f'{n}{w}')}, false) AS INTEGER) AS {name}_{w}" for w in (20, 50, 100) for c, s, n, name in (("high", ">", "hh", "higher_high"), ("low", "<", "ll", "lower_low")))),
    "streaks": f"""WITH {BARS}, u AS (SELECT *, CAST(coalesce(close > {back('close')}, false) AS INTEGER) AS up FROM bars),
      c AS (SELECT *, CASE WHEN up = {back('up')} THEN 0 ELSE 1 END AS ch FROM u), i AS (SELECT *, sum(ch) OVER ({W}) AS isl FROM c),
      n AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY open_time) AS run FROM i)
      SELECT symbol, open_time, CAST(CASE WHEN up = 1 THEN run ELSE 0 END AS INTEGER) AS up_streak, CAST(CASE WHEN up = 0 THEN run ELSE 0 END AS INTEGER) AS down_streak FROM n""",
    "fisher_range": f"""WITH {BARS}, g AS (SELECT *, min(close) OVER f AS lo, max(close) OVER f AS hi, row_number() OVER ({W}) AS i FROM bars
        WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), x AS (SELECT *, greatest(least(2 * (close - lo) / nullif(hi - lo, 0) - 1, 0.999), -0.999) AS v FROM g)
      SELECT symbol, open_time, CASE WHEN i > 20 AND hi - lo > 1e-10 THEN round(0.5 * ln((1 + v) / (1 - v)), 6) END AS fisher FROM x""",
    "fill_policies": f"""WITH {BARS}, x AS (SELECT symbol, open_time, CASE WHEN volume > 50 THEN taker_buy_base END AS x FROM bars),
      f AS (SELECT *, last_value(x IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS a, first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x)
      SELECT symbol, open_time, round(a, 6) AS forward, round(coalesce(a, b), 6) AS both_ways FROM f""",
    "feature_validation": f"""WITH {RETS}, f AS (SELECT ret, ({full('stddev_samp', 'log_ret', 20)}) * {ANNUAL!r} AS vol_20, close / nullif({back('close', 10)}, 0) - 1 AS ret_10, CAST(1 AS DOUBLE) AS one FROM rets)
      """ + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum(CASE WHEN isinf({c}) THEN 1 ELSE 0 END) AS BIGINT) AS infinite, min({c}) IS NOT DISTINCT FROM max({c}) AS constant, CAST(sum(CASE WHEN abs({c}) > 1e10 THEN 1 ELSE 0 END) AS BIGINT) AS huge FROM f" for c in ("ret", "vol_20", "ret_10", "one")),
    "chronological_split": f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
      c AS (SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) AS b FROM n),
      p AS (SELECT *, CASE WHEN i < a - 2 THEN 'train' WHEN i >= a + 2 AND i < b - 2 THEN 'validate' WHEN i >= b + 2 THEN 'test' END AS part FROM c)
      SELECT symbol, part, count(*) AS n, min(open_time) AS first, max(open_time) AS last FROM p GROUP BY ALL""",
    "training_sequences": f"""WITH {BARS}, s AS (SELECT symbol, open_time, trades, count(*) OVER f AS c, sum(close) OVER f AS a, sum(volume) OVER f AS b FROM bars
        WINDOW f AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
      SELECT symbol, open_time, CAST(c AS INTEGER) AS length, round(a, 4) AS closes, round(b, 4) AS volumes, trades FROM s WHERE c = 60""",
    "train_scaling": f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
      q AS (SELECT symbol, quantile_cont(volume, 0.25) AS a, quantile_cont(volume, 0.5) AS b, quantile_cont(volume, 0.75) AS c FROM n WHERE i < floor(n * CAST(0.7 AS DOUBLE)) GROUP BY symbol)
      SELECT n.symbol, open_time, round((volume - b) / nullif(c - a, 0), 6) AS volume_scaled FROM n LEFT JOIN q ON n.symbol = q.symbol""",
}
