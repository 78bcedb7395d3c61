"""Order books and order flow: latest levels, imbalance, quotes, volume bars, signals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import log, normal_cdf, ratio
from tidemark.functions.scans import fading, linear
from tidemark.functions.windows import as_of, back, blocked_mean, frame, full, ordered, run_length, running_total

C = F.col


def by_ts():
    """Ticks of a symbol in order."""
    return ordered("symbol", ["ts", "event_id"])


def book_levels(updates: DataFrame, depth: int = 20) -> DataFrame:
    """Each symbol's book after all updates: the latest quantity of each price, best levels first.

    The latest update of a price is a max by update number, which combines on the map side, so
    long histories shrink before the exchange.  Quantity 0 deletes a level.
    """
    last = updates.groupBy("symbol", "book_side", "price").agg(F.max_by("qty", "update_id").alias("qty"))
    best = F.when(C("book_side") == "bid", -C("price")).otherwise(C("price"))
    w = Window.partitionBy("symbol", "book_side").orderBy(best)
    return last.where("qty > 0").withColumn("level", F.row_number().over(w)).where(C("level") <= depth)


def book_state(updates: DataFrame, levels: int = 5, weighted: int = 10, decay: float = 0.9) -> DataFrame:
    """Best prices, mid, spread, imbalances, depth, microprice and pressure of each book."""
    b = book_levels(updates)

    def total(side: str, x: Column, most: int | None = None) -> Column:
        ok = C("book_side") == side
        return F.sum(F.when(ok & (C("level") <= most) if most else ok, x).otherwise(0.0))

    def share(x: Column, y: Column) -> Column:
        return ratio(x - y, x + y)

    top = lambda side, c: F.max(F.when((C("book_side") == side) & (C("level") == 1), C(c)))
    worth = C("qty") * F.pow(F.lit(decay), (C("level") - 1).cast("double"))
    press = C("qty") / C("level")
    out = b.groupBy("symbol").agg(
        top("bid", "price").alias("best_bid"), top("ask", "price").alias("best_ask"), top("bid", "qty").alias("bid_size"), top("ask", "qty").alias("ask_size"),
        share(total("bid", C("qty"), levels), total("ask", C("qty"), levels)).alias("imbalance"), share(total("bid", worth, weighted), total("ask", worth, weighted)).alias("weighted_imbalance"),
        total("bid", C("qty")).alias("bid_depth"), total("ask", C("qty")).alias("ask_depth"), F.count_if(C("book_side") == "bid").alias("bid_levels"), F.count_if(C("book_side") == "ask").alias("ask_levels"),
        share(total("bid", press, levels), total("ask", press, levels)).alias("pressure"),
    )
    mid = (C("best_bid") + C("best_ask")) / 2
    return out.withColumn("mid", mid).withColumn("spread_bps", 1e4 * ratio(C("best_ask") - C("best_bid"), mid)).withColumn(
        "microprice", ratio(C("best_bid") * C("ask_size") + C("best_ask") * C("bid_size"), C("bid_size") + C("ask_size"))
    )


def book_vwap(updates: DataFrame, size: float = 100.0) -> DataFrame:
    """The mean price of taking ``size`` from each side, level by level, null where it is too thin, and its slippage."""
    w = Window.partitionBy("symbol", "book_side").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    b = book_levels(updates).withColumn("before", F.coalesce(F.sum("qty").over(w), F.lit(0.0)))
    b = b.withColumn("take", F.greatest(F.least(C("qty"), size - C("before")), F.lit(0.0)))
    out = b.groupBy("symbol", "book_side").agg(F.sum("take").alias("taken"), F.sum(C("take") * C("price")).alias("cost"))
    mids = book_state(updates).select(C("symbol").alias("s"), "mid")
    vwap = F.when(C("taken") >= size, ratio(C("cost"), C("taken")))
    sign = F.when(C("book_side") == "ask", 1.0).otherwise(-1.0)
    return out.join(mids, C("symbol") == C("s")).select("symbol", "book_side", vwap.alias("vwap"), (1e4 * sign * ratio(vwap - C("mid"), C("mid"))).alias("slippage_bps"))


def quote_flow(q: DataFrame) -> DataFrame:
    """Order-flow imbalance of successive quotes: the six cases of moved and kept best prices."""
    p = lambda c: back(c, 1, by_ts())
    bid = F.when(C("bid") > p("bid"), C("bid_size")).when(C("bid") < p("bid"), -p("bid_size")).otherwise(C("bid_size") - p("bid_size"))
    ask = F.when(C("ask") < p("ask"), -C("ask_size")).when(C("ask") > p("ask"), p("ask_size")).otherwise(-(C("ask_size") - p("ask_size")))
    df = q.withColumn("ofi", F.coalesce(bid + ask, F.lit(0.0)))
    mean, std = F.avg("ofi").over(frame(100, by_ts())), F.stddev_pop("ofi").over(frame(100, by_ts()))
    enough = F.count("ofi").over(frame(100, by_ts())) >= 20
    return df.select("event_id", "symbol", "ts", "ofi", F.when(enough, ratio(C("ofi") - mean, std)).alias("ofi_z"))


def spread_impact(q: DataFrame, horizon: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """Effective spread, price impact over some quotes and realised spread, in basis points; with the columns ``keep``."""
    df = q.withColumn("mid", (C("bid") + C("ask")) / 2)
    effective = ratio(C("ask") - C("bid"), C("mid"))
    impact = ratio(F.abs(C("mid") - back("mid", horizon, by_ts())), back("mid", horizon, by_ts()))
    realised = F.when(impact.isNotNull(), F.greatest(effective - 2 * impact, F.lit(0.0)))
    return df.select("event_id", "symbol", "ts", (1e4 * effective).alias("effective_bps"), (1e4 * impact).alias("impact_bps"), (1e4 * realised).alias("realised_bps"), *keep)


def kyle_lambda(ticks: DataFrame, rows: int = 50, least: int = 20, left: int = 10) -> DataFrame:
    """Price impact of signed volume: covariance over variance of the last pairs, outliers left out."""
    volume = F.when(C("side") == 1, C("qty")).otherwise(-C("qty")).cast("double")
    df = ticks.withColumn("v", volume).withColumn("r", ratio(C("price"), back("price", 1, by_ts())) - 1)
    df = df.where(C("r").isNotNull()).withColumn("pairs", F.collect_list(F.struct("v", "r")).over(frame(rows, by_ts()))).withColumn("sd", F.stddev_pop("v").over(frame(rows, by_ts())))
    names = ("n", "sv", "sr", "svr", "svv")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def add(a: Column, x: Column) -> Column:
        more = (F.lit(1.0), x["v"], x["r"], x["v"] * x["r"], x["v"] * x["v"])
        return F.when(F.abs(x["v"]) < 3 * C("sd"), F.struct(*[(a[k] + y).alias(k) for k, y in zip(names, more, strict=True)])).otherwise(a)

    df = df.withColumn("sums", F.aggregate("pairs", zero, add))
    n, sv, sr, svr, svv = (C(f"sums.{k}") for k in names)
    value = ratio((svr - sv * sr / n) / (n - 1), svv / n - (sv / n) * (sv / n))
    return df.select("event_id", "symbol", "ts", F.when((F.size("pairs") >= least) & (n >= left), value).alias("kyle_lambda"))


def tick_features(ticks: DataFrame, vol: int = 20, mom: int = 10, stats: int = 100) -> DataFrame:
    """Annualised volatility, momentum, and the slope and z-score of the ``imbalance`` over recent ticks."""
    has = [c for c in ("weighted_imbalance", "position") if c in ticks.columns]
    df = ticks.withColumn("lr", log(ratio(C("price"), back("price", 1, by_ts())))).withColumn("i", F.row_number().over(by_ts()).cast("double"))
    volatility = full(F.stddev_pop, C("lr"), vol - 1, by_ts()) * math.sqrt(252 * 24 * 60)
    momentum = ratio(C("price"), back("price", mom - 1, by_ts())) - 1
    slope = F.when(F.count("imbalance").over(frame(mom, by_ts())) == mom, F.regr_slope("imbalance", "i").over(frame(mom, by_ts())))
    mean, std = F.avg("imbalance").over(frame(stats, by_ts())), F.stddev_pop("imbalance").over(frame(stats, by_ts()))
    z = F.when(F.count("imbalance").over(frame(stats, by_ts())) >= 20, (C("imbalance") - mean) / F.greatest(std, F.lit(0.001))).otherwise(C("imbalance"))
    df = df.withColumn("volatility", volatility)
    mean, std = F.avg("volatility").over(frame(stats, by_ts())), F.stddev_pop("volatility").over(frame(stats, by_ts()))
    v = F.when(F.count("volatility").over(frame(stats, by_ts())) >= 20, (C("volatility") - mean) / F.greatest(std, F.lit(0.001)))
    return df.select(
        "event_id", "symbol", "ts", "price", "imbalance", *has, "volatility", momentum.alias("momentum"), slope.alias("imbalance_slope"), z.alias("imbalance_z"), v.alias("volatility_z")
    )


def imbalance_signals(
    ticks: DataFrame, threshold: float = 0.3, persistence: int = 3, confidence: float = 0.5, calm: float = -1.0, wild: float = 1.0,
    balance: float = 10_000.0, share: float = 0.1, calm_factor: float = 1.5, wild_factor: float = 0.5,
) -> DataFrame:
    """Signals where the imbalance is strong, has kept its sign and does not fade, with size and reason.

    The run of a sign counts every tick, and an imbalance of 0 counts as negative.  Confidence is
    0.4 of the imbalance, 0.2 of ``weighted_imbalance`` where the ticks have one, 0.2 of the run up to
    10, 0.1 more in calm and less in wild markets, and 0.1 where the imbalance grows, within 0 and 1.
    The size is a share of the balance, more in calm and less in wild markets, half where it adds
    to a ``position`` that the ticks may have.
    """
    df = tick_features(ticks)
    for c in ("weighted_imbalance", "position"):
        df = df.withColumn(c, C(c).cast("double") if c in df.columns else F.lit(None).cast("double"))
    df = df.withColumn("sign", F.when(C("imbalance") > 0, 1).otherwise(-1)).withColumn("_o", F.struct("ts", "event_id"))
    df = run_length(df, C("sign"), "streak", ordered("symbol", "_o"), "symbol", "_o")
    one, z, grows = F.lit(1.0), C("volatility_z"), C("sign") * F.round("imbalance_slope", 9)  # below that is rounding alone
    score = (
        0.4 * F.least(F.abs("imbalance"), one) + 0.2 * F.coalesce(F.least(F.abs("weighted_imbalance"), one), F.lit(0.0)) + 0.2 * F.least(C("streak") / 10, one)
        + F.when(z < calm, 0.1).when(z > wild, -0.1).otherwise(0.0) + F.when(grows > 0, 0.1).otherwise(0.0)
    )
    df = df.withColumn("confidence", F.greatest(F.least(score, one), F.lit(0.0)))
    adds = F.coalesce((C("position") != 0) & (F.when(C("position") > 0, 1).otherwise(-1) == C("sign")), F.lit(False))
    base = balance * share * F.when(z < calm, calm_factor).when(z > wild, wild_factor).otherwise(1.0)
    size = F.round(F.when(C("price") > 0, base / C("price")) * F.when(adds, 0.5).otherwise(1.0), 6)
    ok = (F.abs("imbalance") >= threshold) & (C("streak") >= persistence) & (C("confidence") >= confidence) & ~F.coalesce(grows < 0, F.lit(False)) & (size > 0)
    ok = F.coalesce(ok, F.lit(False))
    reason = F.concat_ws(
        "; ", F.format_string("Order book %s imbalance: %.3f", F.when(C("sign") > 0, "bid").otherwise("ask"), C("imbalance")),
        F.when(C("streak") >= persistence, F.format_string("Persistent for %d ticks", C("streak"))),
        F.when(z < calm, "Low volatility environment").when(z > wild, "High volatility (reduced size)"),
    )
    return df.select(
        "event_id", "symbol", "ts", "imbalance", "streak", "confidence", F.when(ok, F.when(C("sign") > 0, "buy").otherwise("sell")).alias("signal"),
        F.when(ok, size).alias("size"), F.when(ok, reason).alias("reason"),
    )


def volume_bars(ticks: DataFrame, size: float = 1000.0, rows: int = 1_000_000) -> DataFrame:
    """Bars of equal volume: a trade that overflows a bar is split among as many as it fills.

    The bar number comes from the running volume; no state is carried between bars.
    """
    q = C("qty").cast("double")
    df = running_total(ticks.where("qty > 0"), q, "end", rows=rows).withColumn("start", C("end") - q)
    bars = F.sequence(F.floor(C("start") / size).cast("bigint"), (F.ceil(C("end") / size) - 1).cast("bigint"))
    df = df.withColumn("bar", F.explode(bars)).withColumn("part", F.least(C("end"), (C("bar") + 1) * size) - F.greatest(C("start"), C("bar") * size))
    return df.groupBy("symbol", "bar").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("part").alias("volume"), F.sum(F.when(C("side") == 1, C("part")).otherwise(0.0)).alias("buy"),
        ratio(F.sum(C("part") * C("price")), F.sum("part")).alias("vwap"), F.count("*").alias("trades"),
    )


def vpin(ticks: DataFrame, size: float = 1000.0, bars: int = 50) -> DataFrame:
    """Mean imbalance of the last complete volume bars, and its share of history at or below it."""
    b = volume_bars(ticks, size).where(C("volume") >= size - 1e-9).withColumn("imbalance", F.abs(2 * C("buy") - C("volume")) / C("volume"))
    w = ordered("symbol", "bar")
    b = b.withColumn("vpin", blocked_mean(C("imbalance"), bars, w))
    history = F.collect_list("vpin").over(frame(1000, w))
    share = ratio(F.size(F.filter(history, lambda v: v <= C("vpin"))), F.size(history))
    return b.select("symbol", "bar", "last", "imbalance", "vpin", F.when((F.size(history) >= 50) & C("vpin").isNotNull(), share).alias("vpin_cdf"))


def bulk_classified(bars: DataFrame, rows: int = 100, least: int = 10) -> DataFrame:
    """Buying volume by the normal distribution of the return over its recent deviation; half until there is history."""
    df = bars.withColumn("lr", log(ratio(C("close"), back("close"))))
    f = frame(rows)
    z = ratio(ratio(C("close"), back("close")) - 1, F.greatest(F.stddev_pop("lr").over(f), F.lit(1e-8)))
    share = F.when(F.count("lr").over(f) < least, 0.5).otherwise(normal_cdf(z))
    return df.select("symbol", "open_time", (C("volume") * share).alias("buy_volume"), (C("volume") * (1 - share)).alias("sell_volume"))


def decayed_flow(bars: DataFrame, decay: float = 0.99) -> DataFrame:
    """A running sum of the takers' net volume that fades with each bar."""
    df = bars.withColumn("x", 2 * C("taker_buy_base") - C("volume"))
    out = linear(df, "symbol", "open_time", ["x"], fading([decay], [1.0]), lambda x: x[:1], ["decayed_ofi"])
    return out.withColumnRenamed("x", "ofi")


def hawkes_intensity(ticks: DataFrame, base: float = 0.1, jump: float = 0.5, fade: float = 1.0, unit: float = 3600.0) -> DataFrame:
    """The intensity of a self-exciting process just before each hourly burst of ``ticks``.

    Between events it fades by exp(-fade * elapsed units); each event adds ``jump``.
    """
    events = ticks.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time")).agg(F.count("*").alias("n"))
    events = events.withColumn("kept", F.exp(-fade * (F.unix_timestamp(C("open_time").cast("timestamp")) - F.unix_timestamp(back(C("open_time")).cast("timestamp"))) / unit))
    rows = events.select("symbol", "open_time", C("n").cast("double").alias("n"), F.coalesce("kept", F.lit(0.0)).alias("kept"))
    out = linear(rows, "symbol", "open_time", ["n", "kept"], lambda x: (x[:, 1].reshape(-1, 1, 1), jump * x[:, 1:]), lambda _: np.zeros(1), ["before"])
    return out.select("symbol", "open_time", C("n").cast("bigint").alias("n"), (base + C("before")).alias("intensity"))


def trade_through(ticks: DataFrame, q: DataFrame, rows: int = 100) -> DataFrame:
    """Each trade with the quote before it, whether it went through it, and how often that happened lately."""
    j = as_of(ticks.select("symbol", "ts", "event_id", "price", "side"), q.select("symbol", "ts", "bid", "ask"), ["bid", "ask"], strict=True)
    through = F.when(C("side") == 1, C("price") > C("right_ask")).otherwise(C("price") < C("right_bid"))
    j = j.withColumn("through", through.cast("int"))
    rate = F.when(F.count("through").over(frame(rows, by_ts())) >= 10, F.avg("through").over(frame(rows, by_ts())))
    return j.select("event_id", "symbol", "ts", "price", C("right_bid").alias("bid"), C("right_ask").alias("ask"), "through", rate.alias("through_rate"))


def toxicity_regime(v: DataFrame, cuts: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """A label for the level of flow toxicity; unknown where there is none."""
    x = C("vpin")
    label = F.when(x.isNull(), "UNKNOWN").when(x < cuts[0], "LOW").when(x < cuts[1], "MEDIUM").when(x < cuts[2], "HIGH").otherwise("EXTREME")
    return v.withColumn("regime", label)
