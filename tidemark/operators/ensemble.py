"""Ensembles of models with moving weights, signs of overfitting, version ids and rows for an API."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.scans import linear
from tidemark.functions.windows import as_of, fold, frame, ordered, so_far

C = F.col


def generalisation(metrics: DataFrame, lower: Sequence[str] = ("mse", "mae"), higher: Sequence[str] = ("sharpe",)) -> DataFrame:
    """What the metrics of three parts say about a model; ``metrics`` has ``<metric>_train``, ``_val`` and ``_test``.

    Of metrics that should be low, training below half of validation is overfitting, and validation
    below 0.7 of the test a shift of the data; of those that should be high, training over twice
    validation is overfitting.  A missing value gives no issue; any overfitting fails.
    """
    issues = []
    for m in lower:
        issues.append(F.when(C(f"{m}_train") < C(f"{m}_val") * 0.5, F.lit(f"{m}: overfitting")))
        issues.append(F.when(C(f"{m}_val") < C(f"{m}_test") * 0.7, F.lit(f"{m}: shift")))
    issues += [F.when(C(f"{m}_train") > C(f"{m}_val") * 2, F.lit(f"{m}: overfitting")) for m in higher]
    df = metrics.withColumn("_found", F.array_compact(F.array(*issues)))
    n = F.size("_found")
    verdict = F.when(n == 0, "GOOD GENERALIZATION").when(n == 1, "MINOR CONCERNS").otherwise("POTENTIAL OVERFITTING")
    df = df.withColumn("passed", (~F.exists("_found", lambda x: x.endswith("overfitting"))).cast("int"))
    return df.withColumn("issues", F.array_join("_found", ", ")).withColumn("verdict", verdict).drop("_found")


def overfitting_signs(
    epochs: DataFrame, gap: float = 0.3, share: float = 2.0, patience: int = 10, least: float = 1e-4, rows: int = 5, by: str = "model", order: str = "epoch"
) -> DataFrame:
    """Gap, severity and reason to stop at each epoch; ``epochs`` has ``train_loss`` and ``val_loss``.

    An epoch improves on the best validation loss if it is lower by more than ``least``.  The trend is
    that of the last ``rows`` epochs, where there are three: training falls while validation rises.
    A model's epochs are folded in one task; they are as many as a training has.
    """
    state = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"))

    def step(s, r):
        better = r.val_loss < s.best - least
        return F.struct(F.when(better, r.val_loss).otherwise(s.best).alias("best"), F.when(better, 0).otherwise(s.waited + 1).alias("waited"))

    df = fold(epochs, ["train_loss", "val_loss"], state, step, by, order)
    w = ordered(by, order)
    f = frame(rows, w)
    df = df.withColumn("gap", C("val_loss") - C("train_loss")).withColumn("gap_ratio", C("val_loss") / (C("train_loss") + 1e-8)).withColumn("waited", C("state.waited"))
    apart = (F.count("*").over(f) >= 3) & (C("train_loss") < F.first("train_loss").over(f)) & (C("val_loss") > F.first("val_loss").over(f))
    df = df.withColumn("_apart", apart)
    severity = (
        F.when(C("gap") > 3 * gap, "severe").when(C("gap") > 2 * gap, "moderate").when((C("gap") > gap) | (C("gap_ratio") > share), "mild")
        .when(C("_apart"), "moderate").otherwise("none")
    )
    n = F.row_number().over(w)
    stop = (
        F.when(C("waited") >= patience, "patience").when((n > 5) & (F.min("gap").over(frame(5, w)) > 2 * gap), "severe")
        .when((n > 1) & (C("val_loss") > 5 * F.first("val_loss").over(so_far(w))), "exploded").otherwise("")
    )
    return df.select(by, order, "gap", "gap_ratio", "waited", severity.alias("severity"), (severity != "none").cast("int").alias("overfitting"), stop.alias("stop"))


def rebalanced_weights(
    scores: DataFrame, models: Sequence[str], decay: float = 0.95, floor: float = 0.05, least: float = 0.01, by: str = "symbol", order: str = "step"
) -> DataFrame:
    """Weights of models after each rebalancing, from equal ones on; ``scores`` has a row for each with a column a model.

    A weight moves to the model's share of the scores (at least ``least`` each) by 1 - ``decay``, is
    raised to ``floor``, and all are divided by their sum.  Rows are the few rebalancings, not ticks.
    """
    k = len(models)
    df = scores.select(by, order, *[F.greatest(C(m), F.lit(least)).alias(m) for m in models])

    def step(s, r):
        total = sum((r[m] for m in models[1:]), r[models[0]])
        raised = [F.greatest(decay * s[m] + (1 - decay) * r[m] / total, F.lit(floor)) for m in models]
        whole = sum(raised[1:], raised[0])
        return F.struct(*[(x / whole).alias(m) for m, x in zip(models, raised, strict=True)])

    out = fold(df, list(models), F.struct(*[F.lit(1.0 / k).alias(m) for m in models]), step, by, order)
    return out.select(by, order, *[C(f"state.{m}").alias(f"weight_{m}") for m in models])


def hit_weights(predictions: DataFrame, models: Sequence[str], rows: int = 100, least: int = 10, rate: float = 0.1, by: str = "symbol", order: str = "open_time") -> DataFrame:
    """Weights of models after each outcome, from equal ones on.

    A model's score is 0.7 of how often its sign was right in the last ``rows`` outcomes (0 counts as
    above) and 0.3 of 1 / (1 + mean squared error), a half before ``least`` outcomes; weights move to the
    shares of scores by ``rate``.  The history of outcomes is a bounded window, and the weights, a
    linear recursion, run by blocks of time.  Rows without an outcome or a prediction are left out.
    """
    f = frame(rows, ordered(by, order))
    known = predictions.where(" and ".join(f"{c} is not null" for c in ["actual", *models]))
    score = {}
    for m in models:
        right = F.avg(((C(m) >= 0) == (C("actual") >= 0)).cast("double")).over(f)
        error = F.avg((C(m) - C("actual")) * (C(m) - C("actual"))).over(f)
        score[m] = F.when(F.count(m).over(f) >= least, 0.7 * right + 0.3 / (1 + error)).otherwise(0.5)
    scored = known.select(by, order, *[x.alias(m) for m, x in score.items()])
    total = sum((C(m) for m in models[1:]), C(models[0]))
    shares = scored.select(by, order, *[(C(m) / total).alias(m) for m in models])
    k = len(models)
    return linear(
        shares, by, order, models, lambda x: (np.repeat((1 - rate) * np.eye(k)[None], len(x), 0), rate * x), lambda x: (1 - rate) / k + rate * x, [f"weight_{m}" for m in models]
    ).select(by, order, *[f"weight_{m}" for m in models])


#: What of a weight stays when a regime is unstable, by family: (of the base factor, of 1, of the regime's weight).
FAMILIES = {"tree": (0.9, 0.1, 0.0), "deep": (1.0, 0.0, 0.0), "agent": (0.8, 0.0, 0.2)}


def regime_weights(df: DataFrame, families: dict[str, str], factor: float = 0.3) -> DataFrame:
    """Weights less the trust that an unstable regime takes from each family of models, divided by their sum.

    ``df`` has ``weight_`` and each model's name, and ``regime_weight`` (0 to 1); adds ``adjusted_`` and the name.
    """
    base = 1 - factor * (1 - C("regime_weight"))
    raw = {m: C(f"weight_{m}") * (base * FAMILIES[kind][0] + FAMILIES[kind][1] + C("regime_weight") * FAMILIES[kind][2]) for m, kind in families.items()}
    total = sum(list(raw.values())[1:], next(iter(raw.values())))
    return df.select("*", *[ratio(x, total).alias(f"adjusted_{m}") for m, x in raw.items()])


def signal_gate(df: DataFrame, models: Sequence[str], warm_up: int = 100, least: float = 0.6, by: str = "symbol", order: str = "open_time") -> DataFrame:
    """Confidence in each prediction, and the signals that pass.

    ``df`` has ``prediction``, the models' ``weight_`` columns, ``regime_weight`` and ``score``, how
    non-stationary the series is.  ``model_confidence`` is half the prediction's strength up to 1 and
    half the weights' concentration, 1 less their entropy by the largest; ``confidence`` is 0.6 of it
    and 0.4 of the regime's weight.  A signal has 0.6 of the strength and 0.4 of 1 less ``score``
    and passes from row ``warm_up`` on if that is ``least`` or more.
    """
    strength = F.least(F.abs("prediction"), F.lit(1.0))
    total = sum((C(f"weight_{m}") for m in models[1:]), C(f"weight_{models[0]}"))
    shares = [C(f"weight_{m}") / total for m in models]
    parts = [F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in shares]
    concentration = 1 + sum(parts[1:], parts[0]) / math.log(len(models)) if len(models) > 1 else F.lit(1.0)
    model = F.when(total > 0, 0.5 * strength + 0.5 * concentration).otherwise(0.0)
    signal = 0.6 * strength + 0.4 * (1 - F.coalesce("score", F.lit(0.5)))
    warm = F.row_number().over(ordered(by, order)) >= warm_up
    return df.select(
        "*", model.alias("model_confidence"), F.when(warm, 0.6 * model + 0.4 * C("regime_weight")).otherwise(0.0).alias("confidence"), signal.alias("signal_confidence"),
        F.when(warm & (signal >= least), F.signum("prediction")).alias("signal"),
    )


def ensemble(predictions: DataFrame, models: Sequence[str], every: int = 100, rows: int = 20, by: str = "symbol", order: str = "step") -> DataFrame:
    """The weighted mean of models' predictions, by the weights of the last rebalancing before a row.

    ``predictions`` has ``step`` (from 1), ``actual`` and a column a model.  Every ``every`` steps models
    are scored by how often the sign was right in the last ``rows`` steps, once there are so many.
    """
    f = frame(rows, ordered(by, order))
    right = [F.avg((F.signum(m) == F.signum("actual")).cast("double")).over(f).alias(m) for m in models]
    scores = predictions.select(by, order, *right).where((C(order) % every == 0) & (C(order) >= rows))
    weights = rebalanced_weights(scores, models, by=by, order=order)
    joined = as_of(predictions, weights, [f"weight_{m}" for m in models], by, order, strict=True)
    own = {m: F.coalesce(f"right_weight_{m}", F.lit(1.0 / len(models))) for m in models}
    parts = [own[m] * C(m) for m in models]
    return joined.select(by, order, *[own[m].alias(f"weight_{m}") for m in models], sum(parts[1:], parts[0]).alias("prediction"))


def funding_state(rates: DataFrame, rate: str = "rate") -> DataFrame:
    """A funding rate in percent, who pays, the sentiment beyond 0.05 % and whether it is extreme, beyond 0.1 %."""
    pct = C(rate) * 100
    mood = F.when(pct > 0.05, "bullish").when(pct < -0.05, "bearish").otherwise("neutral")
    return rates.withColumn("funding_pct", pct).withColumn("longs_pay", (C(rate) > 0).cast("int")).withColumn("sentiment", mood).withColumn("extreme", (F.abs(pct) > 0.1).cast("int"))


def version_ids(df: DataFrame, parameters: Sequence[str], created: str) -> DataFrame:
    """Adds ``version_id``: the day and eight digits of the hash of the parameters as JSON with sorted keys."""
    digest = F.substring(F.sha2(F.to_json(F.struct(*sorted(parameters))), 256), 1, 8)
    return df.withColumn("version_id", F.concat(F.lit("v"), F.date_format(created, "yyyyMMdd"), F.lit("_"), digest))


def api_rows(fills: DataFrame, digits: int = 2) -> DataFrame:
    """Each fill as a JSON object: the symbol in upper case, and decimals, exact, as strings."""
    money = lambda c: C(c).cast(f"decimal(18,{digits})")
    text = F.to_json(F.struct(
        F.upper("symbol").alias("symbol"), money("price").cast("string").alias("price"), money("qty").cast("string").alias("quantity"),
        (money("price") * money("qty")).cast(f"decimal(38,{2 * digits})").cast("string").alias("notional"),
    ))
    return fills.withColumn("json", text)


def guarded_metrics(df: DataFrame, annual: float, by: str = "symbol", order: str = "open_time") -> DataFrame:
    """Metrics of trading in the predicted direction, with quotients guarded by 1e-8.

    ``df`` has ``actual`` and ``predicted``.  The drawdown is that of summed returns, from their first
    value on; the Sortino ratio without a loss is 1.5 times the Sharpe ratio, and the Calmar ratio
    without a drawdown is the Sharpe ratio.
    """
    w = ordered(by, order)
    d = df.where("actual is not null and predicted is not null").withColumn("_s", C("actual") * F.signum("predicted")).withColumn("_sum", F.sum("_s").over(so_far(w)))
    d = d.withColumn("_down", F.max("_sum").over(so_far(w)) - C("_sum"))
    g = d.groupBy(by).agg(
        F.avg((F.signum("actual") == F.signum("predicted")).cast("double")).alias("direction_accuracy"), F.avg((C("_s") > 0).cast("double")).alias("win_rate"),
        F.avg("_s").alias("_m"), F.stddev_pop("_s").alias("_sd"), F.stddev_pop(F.when(C("_s") < 0, C("_s"))).alias("_dsd"),
        F.coalesce(F.sum(F.when(C("_s") > 0, C("_s"))), F.lit(0.0)).alias("_up"), F.coalesce(-F.sum(F.when(C("_s") < 0, C("_s"))), F.lit(0.0)).alias("_lost"),
        F.sum("_s").alias("total_return"), F.max("_down").alias("max_drawdown"),
    )
    sharpe = C("_m") / (C("_sd") + 1e-8) * annual
    sortino = F.when(C("_dsd").isNotNull(), C("_m") / (C("_dsd") + 1e-8) * annual).otherwise(1.5 * sharpe)
    calmar = F.when(C("max_drawdown") > 0, C("total_return") / C("max_drawdown") * annual / 252).otherwise(sharpe)
    return g.select(
        by, "direction_accuracy", "win_rate", sharpe.alias("sharpe"), sortino.alias("sortino"), calmar.alias("calmar"), (C("_up") / (C("_lost") + 1e-8)).alias("profit_factor"),
        "total_return", "max_drawdown",
    )
