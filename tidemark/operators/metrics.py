"""Metrics of returns, trades and predictions: plain aggregations over any number of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import ordered, run_length, so_far

C = F.col


def return_metrics(df: DataFrame, ret: str = "ret", by: str = "symbol", periods: float = 252.0) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, win rate and profit factor.

    Deviations are of the population; the risk-free rate is 0; ratios over 0 are null.
    """
    r = C(ret)
    up, down = F.when(r > 0, r), F.when(r < 0, r)
    year = math.sqrt(periods)
    return df.where(r.isNotNull()).groupBy(by).agg(
        F.count(r).alias("n"),
        F.sum(r).alias("total"),
        (F.avg(r) * periods).alias("annual_return"),
        (F.stddev_pop(r) * year).alias("annual_volatility"),
        (ratio(F.avg(r), F.stddev_pop(r)) * year).alias("sharpe"),
        (ratio(F.avg(r), F.stddev_pop(down)) * year).alias("sortino"),
        ratio(F.sum(up), -F.sum(down)).alias("profit_factor"),
        ratio(F.count(up), F.count(r)).alias("win_rate"),
        F.avg(up).alias("average_win"),
        F.avg(down).alias("average_loss"),
    )


def drawdowns(df: DataFrame, ret: str = "ret", by: str = "symbol", order: str = "open_time") -> DataFrame:
    """Largest drawdown of summed returns, its mean over rows below the peak, and the longest run of such rows."""
    w = ordered(by, order)
    d = df.where(C(ret).isNotNull()).withColumn("_sum", F.sum(ret).over(so_far(w)))
    d = d.withColumn("_dd", F.max("_sum").over(so_far(w)) - C("_sum")).withColumn("_below", (C("_dd") > 1e-12).cast("int"))
    d = run_length(d, C("_below"), "_run", w, by, order)
    return d.groupBy(by).agg(F.max("_dd").alias("max_drawdown"), F.coalesce(F.avg(F.when(C("_below") == 1, C("_dd"))), F.lit(0.0)).alias("average_drawdown"), F.max(F.when(C("_below") == 1, C("_run")).otherwise(0)).alias("longest"))


def value_at_risk(df: DataFrame, ret: str = "ret", by: str = "symbol") -> DataFrame:
    """Historical value at risk and the mean loss beyond it, at 95 and 99 %."""
    q = df.where(C(ret).isNotNull()).groupBy(C(by).alias("_by")).agg(F.percentile(ret, F.array(F.lit(0.05), F.lit(0.01))).alias("_q"))
    j = df.join(q, C(by) == C("_by"))
    tail = lambda k: -F.avg(F.when(C(ret) <= C("_q")[k], C(ret)))
    return j.groupBy(by).agg((-F.first(C("_q")[0])).alias("var_95"), tail(0).alias("cvar_95"), (-F.first(C("_q")[1])).alias("var_99"), tail(1).alias("cvar_99"))


def alpha_beta(df: DataFrame, ret: str = "ret", benchmark: str = "benchmark", by: str = "symbol", periods: float = 252.0) -> DataFrame:
    """Beta, annual alpha and information ratio against a benchmark's return in the same row."""
    d = df.where(C(ret).isNotNull() & C(benchmark).isNotNull())
    beta = ratio(F.covar_samp(ret, benchmark), F.var_samp(benchmark))
    active = C(ret) - C(benchmark)
    return d.groupBy(by).agg(
        beta.alias("beta"), ((F.avg(ret) - beta * F.avg(benchmark)) * periods).alias("alpha"), (ratio(F.avg(active), F.stddev_pop(active)) * math.sqrt(periods)).alias("information_ratio")
    )


def average_rank(value: Column | str, by: str | None = None) -> Column:
    """Rank of a value, ties averaged, as statistics packages count it.  Give ``by`` wherever there are many rows."""
    parts = [by] if by else []
    x = C(value) if isinstance(value, str) else value
    low = F.rank().over(Window.partitionBy(*parts).orderBy(x))
    return low + (F.count(F.lit(1)).over(Window.partitionBy(*parts, x)) - 1) / 2


def prediction_metrics(df: DataFrame, truth: str = "y", guess: str = "p", by: str = "symbol") -> DataFrame:
    """Errors, R2, direction measures and the AUC of the sign, for rows where both are known."""
    y, p = C(truth), C(guess)
    d = df.where(y.isNotNull() & p.isNotNull())
    d = d.withColumn("_rank", average_rank(guess, by)).withColumn("_mean", F.avg(truth).over(Window.partitionBy(by)))
    yes, said = y > 0, p > 0
    n = lambda c: F.sum(c.cast("double"))
    tp, fp, fn = n(yes & said), n(~yes & said), n(yes & ~said)
    return d.groupBy(by).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), (1 - ratio(F.sum((y - p) * (y - p)), F.sum((y - C("_mean")) * (y - C("_mean"))))).alias("r2"),
        F.avg(F.when(y != 0, F.abs((y - p) / F.nullif(y, F.lit(0.0))))).alias("mape"), F.avg((yes == said).cast("double")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(F.sum(F.when(yes, C("_rank"))) - n(yes) * (n(yes) + 1) / 2, n(yes) * n(~yes)).alias("auc"),
    )


def information_coefficient(df: DataFrame, truth: str = "y", guess: str = "p", by: str = "symbol") -> DataFrame:
    """The correlation of average ranks, by group."""
    d = df.where(C(truth).isNotNull() & C(guess).isNotNull())
    d = d.withColumn("_a", average_rank(truth, by)).withColumn("_b", average_rank(guess, by))
    return d.groupBy(by).agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n"))


def quantile_returns(df: DataFrame, truth: str = "y", guess: str = "p", parts: int = 5) -> DataFrame:
    """Mean outcome by equal-count parts of the prediction; the edges are exact percentiles of all rows."""
    d = df.where(C(truth).isNotNull() & C(guess).isNotNull())
    cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    edges = d.agg(F.percentile(guess, cuts).alias("_edges"))
    part = F.aggregate("_edges", F.lit(1), lambda a, e: a + (C(guess) > e).cast("int"))
    return d.join(F.broadcast(edges)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg(truth).alias("mean_return"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Counts, sums, profit factor, extremes, and trading days, in one pass."""
    p = C("pnl")
    up, down = F.when(p > 0, p), F.when(p < 0, p)
    days = F.count_distinct(F.to_date("ts"))
    return trades.agg(
        F.count("*").alias("trades"), F.count(up).alias("wins"), F.count(down).alias("losses"), F.sum(p).alias("total"), (100 * ratio(F.count(up), F.count("*"))).alias("win_rate"),
        ratio(F.sum(up), -F.sum(down)).alias("profit_factor"), F.avg(up).alias("average_win"), F.avg(down).alias("average_loss"), F.max(p).alias("best"), F.min(p).alias("worst"),
        days.alias("days"), ratio(F.count("*"), days).alias("trades_a_day"),
    )


def daily_pnl(trades: DataFrame) -> DataFrame:
    """Profit by day."""
    return trades.groupBy(F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("trades"))


def daily_sharpe(trades: DataFrame) -> DataFrame:
    """Mean over deviation of the daily profits, annualised; 0 for up to one day."""
    d = daily_pnl(trades)
    sharpe = F.when(F.count("*") <= 1, 0.0).otherwise(F.coalesce(ratio(F.avg("pnl"), F.stddev_samp("pnl")) * math.sqrt(252), F.lit(0.0)))
    return d.agg(F.count("*").alias("days"), sharpe.alias("sharpe"))


def equity_drawdown(trades: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Equity by day and its drawdown in money and as a share of the peak.

    Trades are summed by day first, so that the running sum is over days and not over trades.
    """
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = daily_pnl(trades).withColumn("equity", start + F.sum("pnl").over(w))
    peak = F.max("equity").over(w)
    return d.withColumn("drawdown", C("equity") - peak).withColumn("drawdown_share", ratio(C("equity") - peak, peak))


def pnl_heatmap(trades: DataFrame) -> DataFrame:
    """Profit by month and weekday, with a row for each pair, 0 where nothing was traded."""
    months = trades.sparkSession.range(1, 13).select(C("id").cast("int").alias("month"))
    days = trades.sparkSession.range(7).select(C("id").cast("int").alias("weekday"))
    sums = trades.groupBy(F.month("ts").alias("m"), F.weekday("ts").alias("d")).agg(F.sum("pnl").alias("pnl"))
    grid = months.join(F.broadcast(days))
    return grid.join(sums, (C("month") == C("m")) & (C("weekday") == C("d")), "left").select("month", "weekday", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


def hourly_heatmap(trades: DataFrame) -> DataFrame:
    """Profit by hour and weekday (Monday: 0), with a row for each of the 168 pairs, 0 where nothing was traded."""
    grid = trades.sparkSession.range(168).select((C("id") / 7).cast("int").alias("hour"), (C("id") % 7).cast("int").alias("weekday"))
    sums = trades.groupBy(F.hour("ts").alias("h"), F.weekday("ts").alias("d")).agg(F.sum("pnl").alias("pnl"), F.count("pnl").alias("trades"))
    joined = grid.join(sums, (C("hour") == C("h")) & (C("weekday") == C("d")), "left")
    return joined.select("hour", "weekday", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.coalesce("trades", F.lit(0)).cast("bigint").alias("trades"))


def pnl_pivot(trades: DataFrame) -> DataFrame:
    """Profit by month, a column for each weekday from Monday, 0."""
    return trades.withColumn("_d", F.weekday("ts")).groupBy(F.month("ts").alias("month")).pivot("_d", list(range(7))).agg(F.sum("pnl")).na.fill(0.0).select("month", *[C(str(i)).alias(f"day_{i}") for i in range(7)])


def pnl_histogram(trades: DataFrame, bins: int = 50) -> DataFrame:
    """Trades by equal-width bins between the least and the largest profit."""
    ends = trades.agg(F.min("pnl").alias("lo"), F.max("pnl").alias("hi"))
    b = F.least(F.floor(ratio((C("pnl") - C("lo")) * bins, C("hi") - C("lo"))), F.lit(bins - 1)).cast("int")
    return trades.join(F.broadcast(ends)).groupBy(F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str, absolute: float = 1e-5, relative: float = 1e-4) -> DataFrame:
    """How two tables' values differ: both tolerances must be exceeded to fail; NaN equals NaN."""
    j = a.select(C(key).alias("_k"), C(value).alias("x")).join(b.select(C(key).alias("_l"), C(value).alias("y")), C("_k") == C("_l"), "full_outer")
    same = C("x").eqNullSafe(C("y"))
    diff = F.when(~same, F.abs(C("x") - C("y")))
    wrong = ~same & (C("x").isNull() | C("y").isNull() | F.isnan(diff) | ((diff > absolute) & (diff > relative * F.abs("x"))))
    return j.agg(F.count("*").alias("rows"), F.sum(F.coalesce(wrong, F.lit(True)).cast("bigint")).alias("failed"), F.max(diff).alias("largest"))


def version_performance(trades: DataFrame, key: str = "version") -> DataFrame:
    """Trades, wins, sums and time range of each strategy version."""
    return trades.groupBy(key).agg(
        F.count("*").alias("trades"), F.sum((C("pnl") > 0).cast("bigint")).alias("wins"), F.sum("pnl").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
