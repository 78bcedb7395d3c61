"""Scores of models, their robustness, checks of splits, cleaning of feature tables, and toxicity of flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import back, ordered

C = F.col

#: Fixed weights of the composite score.
WEIGHTS = {"sharpe": 0.25, "sortino": 0.15, "win_rate": 0.15, "profit_factor": 0.15, "direction_accuracy": 0.15, "max_drawdown": -0.15}


def composite_score(df: DataFrame) -> DataFrame:
    """Adds ``score``, the weighted sum of a row's metrics; the drawdown's weight counts what is left of it up to 1."""
    parts = [F.lit(w) * (1 - F.least(C(m), F.lit(1.0)) if m == "max_drawdown" else C(m)) for m, w in WEIGHTS.items()]
    return df.withColumn("score", sum(parts[1:], parts[0]))


def best_models(scores: DataFrame, n: int = 3, last: int = 5, least: float | None = None) -> DataFrame:
    """The ``n`` models of best mean score over their ``last`` folds, in order; models below ``least`` only fill up.

    ``scores`` has ``model``, ``fold`` and ``score``.
    """
    recent = scores.withColumn("_age", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("fold")))).where(C("_age") <= last)
    mean = recent.groupBy("model").agg(F.avg("score").alias("score"), F.count("*").alias("folds"))
    passed = F.lit(1) if least is None else (C("score") >= least).cast("int")
    top = mean.withColumn("passed", passed).orderBy(F.desc("passed"), F.desc("score"), "model").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("passed"), F.desc("score"), "model")))


def fold_average(scores: DataFrame, metrics: Sequence[str], by: str = "model") -> DataFrame:
    """The mean of each metric over a model's folds."""
    return scores.groupBy(by).agg(F.count("*").alias("folds"), *[F.avg(m).alias(m) for m in metrics])


def robustness(runs: DataFrame, by: str = "model") -> DataFrame:
    """Mean, deviation, least and greatest return and Sharpe ratio over runs, and how consistent returns are."""
    aggs = [f(c).alias(f"{n}_{c}") for c in ("total", "sharpe") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return runs.groupBy(by).agg(*aggs).withColumn("return_consistency", 1 - C("std_total") / (F.abs("mean_total") + 1e-8))


def reward_hacking(returns: DataFrame, threshold: float = 0.5, by: str = "model") -> DataFrame:
    """Signs that training was gamed: a gap to validation, training too even, sudden drops in validation.

    ``returns`` has ``part`` (train, validate), ``step`` and ``ret``.
    """
    d = returns.withColumn("_change", C("ret") - F.lag("ret").over(Window.partitionBy(by, "part").orderBy("step")))
    val = F.when(C("part") == "validate", C("ret"))
    train = F.when(C("part") == "train", C("ret"))
    means = d.groupBy(C(by).alias("_by")).agg(F.avg(val).alias("_v"))
    d = d.join(means, C(by) == C("_by"))
    drop = (C("part") == "validate") & (C("_change") < -0.05 * F.abs("_v"))
    g = d.groupBy(by).agg(F.avg(train).alias("t"), F.avg(val).alias("v"), F.stddev_pop(train).alias("s"), F.count(val).alias("n"), F.count_if(drop).alias("drops")).where("t is not null and v is not null")
    gap = F.when(F.abs("t") > 1e-8, (C("t") - C("v")) / F.abs("t")).otherwise(0.0)
    even = (C("s") / (F.abs("t") + 1e-8) < 0.1) & (C("t") > 0.01)
    sudden = (C("n") > 10) & (C("drops") > 0.1 * C("n"))
    score = F.when(gap > threshold, 0.4).otherwise(0.0) + F.when(even, 0.3).otherwise(0.0) + F.when(sudden, 0.3).otherwise(0.0)
    return g.select(by, gap.alias("performance_gap"), even.cast("int").alias("too_even"), sudden.cast("int").alias("sudden_drops"), score.alias("confidence"), (score > 0.5).cast("int").alias("detected"))


def against_buy_and_hold(df: DataFrame, by: str = "symbol", order: str = "open_time") -> DataFrame:
    """A strategy's compound return and that of holding the asset; ``df`` has ``strategy`` and ``close``.

    A return that is null, as that from a price of zero, counts as none.
    """
    d = df.withColumn("_ret", ratio(C("close"), back("close", 1, ordered(by, order))) - 1)
    grown = lambda x: F.product(1 + F.coalesce(x, F.lit(0.0))) - 1
    g = d.groupBy(by).agg(grown(C("strategy")).alias("agent_return"), grown(C("_ret")).alias("baseline_return"))
    return g.withColumn("excess_return", C("agent_return") - C("baseline_return")).withColumn("outperformed", (C("excess_return") > 0).cast("int"))


def go_no_go(metrics: DataFrame) -> DataFrame:
    """How many of four criteria a row meets; three make it GO."""
    checks = (C("direction_accuracy") > 0.5, C("sharpe") > 0, C("win_rate") > 0.45, C("profit_factor") > 0.8)
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks[1:]), F.coalesce(checks[0], F.lit(False)).cast("int"))
    return metrics.withColumn("criteria", passed).withColumn("decision", F.when(passed >= 3, "GO").otherwise("NO-GO"))


def bounded_metrics(metrics: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds which metrics are below and above realistic bounds; any above, or a Sharpe ratio over 5, fails."""
    named = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(C(m), b), m) for m, b in bounds.items()])), ",")
    df = metrics.withColumn("below", named(lambda x, b: x < b[0])).withColumn("above", named(lambda x, b: x > b[1]))
    return df.withColumn("passed", ((C("above") == "") & ~F.coalesce(C("sharpe") > 5, F.lit(False))).cast("int"))


def return_profile(df: DataFrame, by: str = "symbol", order: str = "open_time") -> DataFrame:
    """Whether returns look like a market's: fat tails, clustered volatility, no serial correlation, usual volatility."""
    d = df.where(C("log_ret").isNotNull()).withColumn("_prev", F.lag("log_ret").over(ordered(by, order)))
    n = F.count("log_ret").cast("double")
    g = d.groupBy(by).agg(
        F.count("*").alias("n"), F.stddev_samp("log_ret").alias("sd"), F.skewness("log_ret").alias("g1"), F.kurtosis("log_ret").alias("g2"), n.alias("_n"),
        F.corr(F.when(C("_prev").isNotNull(), C("log_ret")), "_prev").alias("autocorrelation"), F.corr(F.when(C("_prev").isNotNull(), F.abs("log_ret")), F.abs("_prev")).alias("autocorrelation_abs"),
    )
    vol = C("sd") * (252 * 24 * 60) ** 0.5
    skew = ratio(C("g1") * F.sqrt(C("_n") * (C("_n") - 1)), C("_n") - 2)
    kurt = ratio((C("_n") - 1) * ((C("_n") + 1) * C("g2") + 6), (C("_n") - 2) * (C("_n") - 3))
    g = g.withColumn("annual_volatility", vol).withColumn("skewness", skew).withColumn("kurtosis", kurt)
    checks = (C("kurtosis") > 0, C("autocorrelation_abs") > 0.05, F.abs("autocorrelation") < 0.05, C("annual_volatility").between(0.3, 1.0))
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks[1:]), F.coalesce(checks[0], F.lit(False)).cast("int"))
    return g.select(by, "n", "annual_volatility", "skewness", "kurtosis", "autocorrelation", "autocorrelation_abs", passed.alias("checks_passed"))


def split_order(df: DataFrame, parts: Sequence[str] = ("train", "validate", "test"), gap_seconds: int = 0, by: str = "symbol", order: str = "open_time") -> DataFrame:
    """Whether each part of a split ends before the next begins, at least ``gap_seconds`` apart, and no time is in two parts."""
    at = F.unix_micros(C(order).cast("timestamp"))
    bounds = [f(F.when(C("part") == p, at)).alias(f"{n}_{p}") for p in parts for n, f in (("first", F.min), ("last", F.max))]
    times = df.where(C("part").isin(*parts)).groupBy(by, order).agg(F.count_distinct("part").alias("_k")).groupBy(C(by).alias("_by")).agg(F.count_if(C("_k") > 1).alias("shared"))
    g = df.groupBy(by).agg(*bounds).join(times, C(by).eqNullSafe(C("_by")), "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    gaps = [((C(f"first_{b}") - C(f"last_{a}")) / 1e6).alias(f"gap_{a}_{b}") for a, b in zip(parts, parts[1:], strict=False)]
    ok = C("shared") == 0
    for a, b in zip(parts, parts[1:], strict=False):
        ok = ok & (C(f"first_{b}") > C(f"last_{a}")) & (C(f"first_{b}") - C(f"last_{a}") >= gap_seconds * 1_000_000)
    return g.select(by, "shared", *gaps, F.coalesce(ok, F.lit(False)).cast("int").alias("ordered"))


def expanding_ranges(df: DataFrame, splits: int = 5, share: float = 0.8, gap: int = 2, by: str = "symbol") -> DataFrame:
    """Row ranges of walk-forward splits whose training rows grow: (split, train_end, test_start, test_end), ends excluded."""
    n = df.groupBy(by).agg(F.count("*").alias("n")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    size = F.floor(C("n") / splits)
    end = F.floor(size * (C("split") + 1) * share)
    out = n.select(by, "split", end.alias("train_end"), (end + gap).alias("test_start"), F.least(size * (C("split") + 2), C("n")).alias("test_end"))
    return out.where("test_start < test_end")


def numeric_features(df: DataFrame, without: Sequence[str] = ("target", "time"), most: int | None = None) -> list[str]:
    """Names of a table's number columns that contain none of some texts, the first ``most`` of them."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds and not any(x in c for x in without)][:most]


def cleaned(df: DataFrame, columns: Sequence[str], needed: Sequence[str] = (), zero: bool = False) -> DataFrame:
    """Infinite values and NaN become null, or 0 if ``zero``; rows without a ``needed`` value are left out."""
    fine = lambda c: C(c).isNotNull() & ~F.isnan(c) & (F.abs(C(c)) != float("inf"))
    out = df.select(*[F.when(fine(c), C(c)).otherwise(F.lit(0.0) if zero else None).alias(c) if c in columns else C(c) for c in df.columns])
    return out.na.drop(subset=list(needed)) if needed else out


def table_hash(df: DataFrame) -> DataFrame:
    """Rows and hashes of a table that do not depend on their order.

    A row's hash is the sha256 of its columns' texts, by name, doubles to six decimals and nulls as
    ``\\N``; of these are taken the exclusive or of their first 60 bits and the sum of their first 32.
    """
    text = lambda c, t: F.coalesce(F.format_string("%.6f", C(c)) if t in ("double", "float") else C(c).cast("string"), F.lit("\\N"))
    digest = F.sha2(F.concat_ws("\x1f", *[text(c, t) for c, t in sorted(df.dtypes)]), 256)
    part = lambda n: F.conv(F.substring(digest, 1, n), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.bit_xor(part(15)).alias("xor_hash"), F.sum(part(8)).alias("sum_hash"))


def bar_proxies(bars: DataFrame) -> DataFrame:
    """A quote, a trade's side and one book level of each side, made up from a bar's range and its takers' volume."""
    mid, takers = (C("high") + C("low")) / 2, C("taker_buy_base") > 0
    spread = F.when(C("close") > 0, (C("high") - C("low")) / C("close")).otherwise(0.0)
    half = F.when(C("high") > C("low"), (C("high") - C("low")) / 2).otherwise(mid * 0.001)
    side = F.when(takers, F.when(C("taker_buy_base") > C("volume") / 2, 1).otherwise(-1)).otherwise(F.when(C("close") > C("open"), 1).otherwise(-1))
    return bars.select(
        "symbol", "open_time", (mid - spread * mid / 2).alias("bid"), (mid + spread * mid / 2).alias("ask"), (C("volume") / 2).alias("size"), side.alias("side"),
        (mid - half).alias("book_bid"), (mid + half).alias("book_ask"), F.when(takers, C("volume") - C("taker_buy_base")).otherwise(C("volume") / 2).alias("book_bid_size"),
        F.when(takers, C("taker_buy_base")).otherwise(C("volume") / 2).alias("book_ask_size"),
    )


def hawkes_estimate(ticks: DataFrame, least: int = 50, by: str = "symbol") -> DataFrame:
    """Base rate, excitation and decay of a self-exciting process from the moments of times between events; null for too few."""
    at = F.unix_micros(C("ts").cast("timestamp")) / 1e6
    d = ticks.withColumn("_gap", at - F.lag(at).over(ordered(by, ["ts", "event_id"])))
    g = d.groupBy(by).agg(F.count("_gap").alias("n"), F.avg("_gap").alias("m"), F.var_pop("_gap").alias("v"))
    cv = C("v") / (C("m") * C("m"))
    branching = F.when(cv > 1, F.least(1 - 1 / cv, F.lit(0.99))).otherwise(0.0)
    ok = (C("n") >= least) & (C("m") > 0)
    return g.select(by, "n", F.when(ok, 1 / C("m")).alias("mu"), F.when(ok, branching / C("m")).alias("alpha"), F.when(ok, 1 / C("m")).alias("beta"))


def toxicity(trades: DataFrame, rows: int = 1000, least: int = 100, history: int = 100) -> DataFrame:
    """How informed recent flow is: adverse selection, the imbalance's PIN, a VPIN rank if given, and their weighted mean.

    ``trades`` has ``side`` (1 buys), ``impact`` (a price impact as a share, may be null) and ``vpin_cdf``
    (may be null).  Of the weights 0.4 (VPIN), 0.3 and 0.3 those of known parts count.
    """
    w = ordered("symbol", ["ts", "event_id"])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # Sums over the last rows are differences of running sums, which cost the same for any number of rows.
    sums = {"_n": C("side").isNotNull().cast("bigint"), "_buys": F.coalesce((C("side") == 1).cast("bigint"), F.lit(0)), "_known": C("impact").isNotNull().cast("bigint"), "_impact": F.coalesce("impact", F.lit(0.0))}
    d = trades.withColumns({k: F.sum(x).over(run) for k, x in sums.items()})
    n, buys, known, impact = (C(k) - F.coalesce(F.lag(k, rows).over(w), F.lit(0)) for k in sums)
    imbalance = F.abs(ratio(2 * buys - n, n))
    d = d.withColumn("pin", F.when(n >= least, 0.5 * (1 + F.tanh(2 * (imbalance - 0.3)))))
    d = d.withColumn("adverse", F.when(known >= 10, ratio(impact, known)))
    parts = ((C("vpin_cdf"), 0.4), (F.least(F.lit(1.0), C("adverse") * 10_000 / 50), 0.3), (C("pin"), 0.3))
    total = sum((F.when(x.isNotNull(), wt).otherwise(0.0) for x, wt in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    summed = sum((F.coalesce(x * wt, F.lit(0.0)) for x, wt in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    d = d.withColumn("toxicity", ratio(summed, total))
    informed = F.when(C("vpin").isNotNull() & C("pin").isNotNull(), 0.6 * C("vpin") + 0.4 * C("pin")).otherwise(F.coalesce("vpin", "pin"))
    h = w.rowsBetween(-(history - 1), 0)
    sd = F.stddev_pop("toxicity").over(h)
    z = F.when(F.count("toxicity").over(h) >= 20, F.when(sd == 0, 0.0).otherwise((C("toxicity") - F.avg("toxicity").over(h)) / sd))
    t = C("toxicity")
    regime = F.when(t.isNull(), "UNKNOWN").when(t < 0.3, "LOW").when(t < 0.5, "MEDIUM").when(t < 0.7, "HIGH").otherwise("EXTREME")
    return d.select("event_id", "symbol", "ts", "adverse", "pin", informed.alias("informed"), "toxicity", z.alias("toxicity_z"), regime.alias("regime"))
