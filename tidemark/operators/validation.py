"""Combinatorial purged cross-validation, overfitting probabilities and deflated Sharpe ratios."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import ordered

C = F.col


def purged_folds(df: DataFrame, groups: int = 5, held: int = 2, embargo: float = 0.01, purge: float = 0.01, window: int = 5) -> DataFrame:
    """Every row once for each choice of ``held`` of ``groups`` groups, as test, train, purged or embargoed.

    Rows before the first test group are purged and rows after the last one embargoed.  The folds
    are a constant array that each row explodes, so there is no join; ``fold`` spells its groups.
    """
    n = F.count("*").over(Window.partitionBy("symbol"))
    df = df.withColumn("_i", F.row_number().over(ordered()) - 1).withColumn("_n", n).withColumn("_k", F.floor(C("_n") / groups))
    df = df.withColumn("_g", F.least(F.floor(C("_i") / F.nullif(C("_k"), F.lit(0))), F.lit(groups - 1)).cast("int"))
    choices = list(itertools.combinations(range(groups), held))
    fold = lambda c: F.struct(F.lit(int("".join(map(str, c)))).alias("fold"), F.array(*[F.lit(x) for x in c]).alias("g"))
    df = df.withColumn("_f", F.explode(F.array(*[fold(c) for c in choices])))
    first, last = F.array_min("_f.g") * C("_k"), (F.array_max("_f.g") + 1) * C("_k")
    before = F.greatest(F.lit(window), F.floor(C("_n") * purge))
    after = F.greatest(F.lit(1), F.floor(C("_n") * embargo))
    part = (
        F.when(F.array_contains(C("_f.g"), C("_g")), "test").when((C("_i") >= first - before) & (C("_i") < first), "purged")
        .when((F.array_max("_f.g") < groups - 1) & (C("_i") >= last) & (C("_i") < last + after), "embargoed").otherwise("train")
    )
    return df.withColumn("fold", C("_f.fold")).withColumn("part", part).drop("_i", "_n", "_k", "_g", "_f")


def deflated_sharpe(sharpe: float, trials: int, variance: float, n: int, skew: float = 0.0, kurt: float = 3.0) -> tuple[float | None, float | None]:
    """The Sharpe ratio in deviations above the best expected of ``trials`` without skill, and its p-value; null for one trial."""
    if trials < 2 or n < 2:
        return None, None
    normal, gamma = NormalDist(), 0.5772156649
    best = math.sqrt(variance) * ((1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e)))
    error = math.sqrt(max((1 + 0.5 * sharpe**2 - skew * sharpe + (kurt - 3) / 4 * sharpe**2) / (n - 1), 1e-12))
    z = (sharpe - best) / error
    return z, 1 - normal.cdf(z)


def overfitting_probability(scores: DataFrame, parts: int = 6) -> DataFrame:
    """How often the best strategy of half the parts ranks below the middle in the other half.

    ``scores`` has strategy, part (0 to parts - 1) and score.  Every half of the parts is tried;
    strategies meet their own parts only, and ranks are within a half.
    """
    halves = list(itertools.combinations(range(parts), parts // 2))
    half = lambda i, c: F.struct(F.lit(i).alias("half"), F.array(*[F.lit(x) for x in c]).alias("inside"))
    df = scores.withColumn("_h", F.explode(F.array(*[half(i, c) for i, c in enumerate(halves)])))
    inside = F.array_contains(C("_h.inside"), C("part"))
    m = df.groupBy(C("_h.half").alias("half"), "strategy").agg(F.avg(F.when(inside, C("score"))).alias("a"), F.avg(F.when(~inside, C("score"))).alias("b"))
    w = Window.partitionBy("half")
    rank = F.rank().over(w.orderBy("b")) + (F.count("*").over(Window.partitionBy("half", "b")) - 1) / 2
    m = m.withColumn("rank", rank / F.count("*").over(w)).withColumn("best", F.row_number().over(w.orderBy(F.desc("a"), "strategy")))
    x = F.greatest(F.least(C("rank"), F.lit(1 - 1e-10)), F.lit(1e-10))
    return m.where("best = 1").agg(F.count("*").alias("halves"), F.avg((F.ln(x / (1 - x)) < 0).cast("double")).alias("pbo"))
