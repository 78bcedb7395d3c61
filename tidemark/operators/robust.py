"""How much of a result is luck: block bootstrap, deflated Sharpe ratios, snooping, permutations, and weighted draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import normal_cdf, normal_ppf, ratio
from tidemark.functions.scans import WIDTH, in_blocks

C = F.col
#: Fixed value: the Euler-Mascheroni constant as used here.
EULER = 0.5772156649


def drawn(m: Column, *of: Column) -> Column:
    """A whole number from 0 to ``m`` - 1 that the hash of some values draws."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *[x.cast("string") for x in of])), 1, 8), 16, 10).cast("bigint"), m)


def _joined(a: Column, b: Column) -> Column:
    """The sum, highest and lowest running sum, and deepest fall from a high, of one stretch after another."""
    return F.struct(
        (a["s"] + b["s"]).alias("s"), (a["q"] + b["q"]).alias("q"), F.greatest(a["hi"], a["s"] + b["hi"]).alias("hi"), F.least(a["lo"], a["s"] + b["lo"]).alias("lo"),
        F.greatest(a["dd"], b["dd"], a["hi"] - (a["s"] + b["lo"])).alias("dd"),
    )


def _stretch(parts: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"), F.lit(0.0).alias("dd"))
    return F.aggregate(parts, zero, _joined)


def numbered(df: DataFrame, value: str, key: str, order: str, width: int = WIDTH) -> DataFrame:
    """(key, i, x): the values in order, numbered from 0, without one task for a key: counts of blocks of time tell where each begins."""
    blocks = in_blocks(df, [key], order, [value], width)
    w = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.withColumn("_from", F.coalesce(F.sum(F.size("x")).over(w), F.lit(0)))
    return begun.select(key, "_from", F.posexplode("x").alias("_at", "x")).select(key, (C("_from") + C("_at")).alias("i"), "x")


def block_bootstrap(
    df: DataFrame, value: str = "ret", key: str = "symbol", order: str = "open_time", simulations: int = 1000, block: int = 20, seed: int = 42, periods: float = 252.0, width: int = WIDTH
) -> DataFrame:
    """Intervals of return, Sharpe ratio and deepest drawdown under resampling of blocks of ``block`` values.

    Each simulation draws as many whole blocks as a series has, with replacement, by hash.  A block is
    reduced to five numbers, from which those of any sequence of blocks follow; so a simulation looks
    up one small row for each block and no value of the series is copied.  Its blocks are joined in
    runs of 1024, then its runs.  Values that are null or not finite are left out; a key of fewer than
    ``block`` values has no row.  Drawdowns are of running sums, and begin at the first value.
    """
    rows = numbered(df, value, key, order, width)
    one = F.struct(C("i"), C("x").alias("s"), (C("x") * C("x")).alias("q"), C("x").alias("hi"), C("x").alias("lo"), F.lit(0.0).alias("dd"))
    summed = rows.groupBy(key, F.floor(C("i") / block).alias("b")).agg(_stretch(F.array_sort(F.collect_list(one))).alias("v"), F.count("*").alias("n")).where(C("n") == block)
    count = rows.groupBy(key).agg(F.floor(F.count("*") / block).cast("bigint").alias("m")).where("m > 0")
    places = count.select(C(key).alias("_k"), "m", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim")).select("_k", "m", "sim", F.explode(F.sequence(F.lit(0).cast("bigint"), C("m") - 1)).alias("at"))
    places = places.withColumn("_b", drawn(C("m"), F.lit(seed), C("_k"), C("sim"), C("at")))
    picked = places.join(summed, (C("_k").eqNullSafe(C(key))) & (C("_b") == C("b"))).select(C("_k").alias(key), "m", "sim", "at", "v.*")
    run = picked.groupBy(key, "m", "sim", F.floor(C("at") / 1024).alias("at")).agg(_stretch(F.array_sort(F.collect_list(F.struct("at", "s", "q", "hi", "lo", "dd")))).alias("v"))
    whole = run.groupBy(key, "m", "sim").agg(_stretch(F.array_sort(F.collect_list(F.struct("at", "v.*")))).alias("v"))
    n = (C("m") * block).cast("double")

    def sharpe(v: str, n: Column) -> Column:
        mean = C(f"{v}.s") / n
        return ratio(mean, F.sqrt(F.greatest(C(f"{v}.q") / n - mean * mean, F.lit(0.0)))) * math.sqrt(periods)

    draws = whole.select(key, C("v.s").alias("return"), sharpe("v", n).alias("sharpe"), C("v.dd").alias("drawdown"))
    g = draws.groupBy(key).agg(
        F.count("*").alias("simulations"),
        *[f.alias(f"{c}_{n}") for c in ("return", "sharpe", "drawdown") for n, f in (("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("low", F.percentile(c, 0.025)), ("high", F.percentile(c, 0.975)))],
        F.percentile("sharpe", 0.05).alias("sharpe_p5"), F.percentile("drawdown", 0.95).alias("drawdown_p95"), F.avg((C("sharpe") > 0).cast("double")).alias("sharpe_positive"), F.avg((C("sharpe") > 1).cast("double")).alias("sharpe_above_1"),
    )
    # The series itself, by the same reduction: its blocks in order, the last one short.
    parts = rows.groupBy(key, F.floor(C("i") / 1024).alias("at")).agg(_stretch(F.array_sort(F.collect_list(one))).alias("v"), F.count("*").alias("n"))
    own = parts.groupBy(C(key).alias("_o")).agg(_stretch(F.array_sort(F.collect_list(F.struct("at", "v.*")))).alias("v"), F.sum("n").alias("n"))
    own = own.select("_o", C("v.s").alias("own_return"), sharpe("v", C("n").cast("double")).alias("own_sharpe"), C("v.dd").alias("own_drawdown"))
    return g.join(own, C(key).eqNullSafe(C("_o"))).drop("_o")


def expected_best(trials: Column) -> Column:
    """The highest Sharpe ratio to be expected of some trials without skill, in deviations; null for one trial."""
    t = trials.cast("double")
    return F.when(t > 1, (1 - EULER) * normal_ppf(1 - 1 / t) + EULER * normal_ppf(1 - 1 / (t * math.e)))


def deflated(sharpe: Column, trials: Column, n: Column, skew: Column, kurt: Column, deviation: Column) -> tuple[Column, Column]:
    """The Sharpe ratio in standard errors above ``expected_best`` of trials of some deviation, and its p-value.

    ``kurt`` is 3 for normal returns.  Null for one trial, fewer than two observations or no error.
    """
    error = F.sqrt((1 + 0.5 * sharpe * sharpe - skew * sharpe + (kurt - 3) / 4 * sharpe * sharpe) / F.nullif(n - 1, F.lit(0)))
    z = F.when(n >= 2, ratio(sharpe - deviation * expected_best(trials), error))
    return z, 1 - normal_cdf(z)


def fold_summary(folds: DataFrame, key: str = "symbol", periods: float = 252.0) -> DataFrame:
    """The deflated Sharpe ratio of test returns over folds: ``folds`` has key, fold and ``strategy``, the returns of test rows.

    The ratio is that of all test returns together, of as many trials as there are folds; the
    deviation of trials is that of the folds' ratios.  A row that several folds test counts in each.
    """
    sharpe = ratio(F.avg("strategy"), F.stddev_samp("strategy")) * math.sqrt(periods)
    each = folds.groupBy(key, "fold").agg(sharpe.alias("sharpe"))
    g = each.groupBy(key).agg(F.count("*").alias("trials"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("std"))
    shape = folds.groupBy(C(key).alias("_k")).agg(sharpe.alias("sharpe"), F.count("strategy").alias("n"), F.skewness("strategy").alias("skew"), (F.kurtosis("strategy") + 3).alias("kurt"))
    g = g.join(shape, C(key).eqNullSafe(C("_k"))).drop("_k")
    z, p = deflated(C("sharpe"), C("trials"), C("n"), C("skew"), C("kurt"), C("std"))
    return g.withColumn("deflated_sharpe", z).withColumn("p_value", p)


def data_snooping(tried: DataFrame, significance: float = 0.05) -> DataFrame:
    """The risk that the best of many strategies is luck.

    ``tried`` has strategies, observations and ``best_sharpe`` (may be null); other columns stay.  Adds
    the expected best without skill (null for one strategy), the Bonferroni level, the probability of
    a spurious find, the least significant ratio, a score, the issues found, and whether there are none.
    """
    k, n = C("strategies").cast("double"), C("observations").cast("double")
    df = tried.withColumn("expected_best", expected_best(k)).withColumn("bonferroni", ratio(F.lit(significance), k)).withColumn("spurious", 1 - F.pow(F.lit(1 - significance), k))
    df = df.withColumn("least_sharpe", ratio(normal_ppf(1 - C("bonferroni")), F.sqrt(n))).withColumn("score", ratio(F.when(k > 0, F.ln(k)), F.sqrt(n)))
    issues = F.array_compact(F.array(
        F.when(C("best_sharpe") < C("expected_best"), "below_expected"), F.when(C("bonferroni") < 1e-6, "severe_multiple_testing"), F.when(C("spurious") > 0.5, "high_spurious_probability"),
        F.when(C("score") > 0.5, "high_snooping_score"),
    ))
    return df.withColumn("issues", F.array_join(issues, ",")).withColumn("passed", (C("issues") == "").cast("int"))


def overfit_signature(df: DataFrame, key: str = "symbol", order: str = "open_time", most: float = 2.0) -> DataFrame:
    """Whether training performance is ``most`` times that of the test, or the test's first half 1.5 times its second.

    ``df`` has key, order, ``part`` (train or test) and ``strategy``.
    """
    test = F.when(C("part") == "test", C("strategy"))
    w = Window.partitionBy(key, "part")
    d = df.where("part in ('train', 'test')").withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_half", F.floor(F.count("*").over(w) / 2))
    g = d.groupBy(key).agg(
        F.avg(F.when(C("part") == "train", C("strategy"))).alias("train_mean"), F.avg(test).alias("test_mean"), F.count_if(C("part") == "test").alias("_n"),
        F.avg(F.when(C("_i") < C("_half"), test)).alias("first_half"), F.avg(F.when(C("_i") >= C("_half"), test)).alias("second_half"),
    )
    g = g.withColumn("gap", F.coalesce(ratio(C("train_mean"), C("test_mean")) > most, F.lit(False)).cast("int"))
    g = g.withColumn("degrades", F.coalesce((C("_n") >= 2) & (C("first_half") > C("second_half") * 1.5), F.lit(False)).cast("int")).drop("_n")
    return g.withColumn("passed", (C("gap") + C("degrades") == 0).cast("int"))


def permuted_overfitting(folds: DataFrame, key: str = "symbol", permutations: int = 1000, seed: int = 42) -> DataFrame:
    """How often the best fold's place in one half of a random order falls below the median of the other half.

    ``folds`` has key, fold and ``total``.  A permutation is the order of hashes of (seed, key, number,
    fold); the fold at the best one's place in the second half, or the first if there is none,
    is held against that half's median.  Fewer than four folds give 0.  A key's folds are
    few; they are exploded by the number of permutations.
    """
    known = folds.where(C("total").isNotNull())
    n = known.groupBy(C(key).alias("_k")).agg(F.count("*").alias("n"))
    every = known.join(n, C(key).eqNullSafe(C("_k"))).where("n >= 4").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    h = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), C(key).cast("string"), C("p").cast("string"), C("fold").cast("string")))
    d = every.withColumn("i", F.row_number().over(Window.partitionBy(key, "p").orderBy(h, "fold")) - 1).withColumn("half", F.floor(C("n") / 2))
    inside = C("i") < C("half")
    g = d.groupBy(key, "p", "half", "n").agg(
        F.min_by(F.when(inside, C("i")), F.when(inside, F.struct(-C("total"), C("i")))).alias("best"), F.median(F.when(~inside, C("total"))).alias("middle"),
        F.map_from_entries(F.collect_list(F.when(~inside, F.struct((C("i") - C("half")).alias("k"), C("total").alias("v"))))).alias("outside"),
    )
    at = F.when(C("best") < C("n") - C("half"), C("best")).otherwise(0)
    found = g.groupBy(key).agg(F.avg((F.element_at("outside", at) < C("middle")).cast("double")).alias("pbo"))
    none = n.where("n < 4").select(C("_k").alias(key), F.lit(0.0).alias("pbo"))
    return found.unionByName(none)


def prioritised_sample(df: DataFrame, priority: str, size: int, key: str = "symbol", item: str = "id", alpha: float = 0.6, beta: float = 0.4, seed: int = 42) -> DataFrame:
    """``size`` rows of each key without replacement, each draw with probability in proportion to priority to the power ``alpha``.

    Rows of the least exponential variates, by hash of (seed, key, item) and rate the weight, are such
    a draw.  Adds ``probability`` (of the first draw), ``weight`` for importance, (n probability) ^ -beta
    by the sample's largest, and ``place`` (1, 2, ...).  Rows without a priority above 0 are never drawn.
    Spark keeps the ``size`` best of each task before it exchanges rows.
    """
    d = df.where(C(priority) > 0).withColumn("_w", F.pow(C(priority).cast("double"), F.lit(alpha)))
    u = (drawn(F.lit(1 << 32), F.lit(seed), C(key), C(item)) + 0.5) / float(1 << 32)
    total = d.groupBy(C(key).alias("_k")).agg(F.sum("_w").alias("_all"), F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_e", item)
    best = d.withColumn("_e", -F.ln(u) / C("_w")).withColumn("place", F.row_number().over(w)).where(C("place") <= size)
    best = best.join(total, C(key).eqNullSafe(C("_k"))).withColumn("probability", C("_w") / C("_all"))
    raw = F.pow(C("_n") * C("probability"), F.lit(-beta))
    return best.withColumn("weight", raw / F.max(raw).over(Window.partitionBy(key))).drop("_w", "_e", "_k", "_all", "_n")
