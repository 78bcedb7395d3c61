"""Queries on ensembles, overfitting, funding, versions and API rows, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import back, ordered
from tidemark.operators import bars as B
from tidemark.operators import ensemble as N
from tidemark.plans import bar_queries
from tidemark.plans.bar_queries import BARS, RETS, W
from tidemark.plans.flow_queries import _r, tidy
from tidemark.sources import adapters as A

C = F.col
MODELS = ("follow", "fade", "older")
ANNUAL_HOURS = math.sqrt(252 * 24)


def generalisation(spark, sf_dir):
    """What each symbol's errors in three parts of its bars say."""
    b = B.split(A.bars(spark, sf_dir)).withColumn("_p", F.expr("CASE part WHEN 'train' THEN 'train' WHEN 'validate' THEN 'val' ELSE 'test' END"))
    one = lambda agg, p: agg(F.when(C("_p") == p, C("high") - C("close")))
    g = b.groupBy("symbol").agg(
        *[F.avg(F.when(C("_p") == p, (C("high") - C("close")) * (C("high") - C("close")))).alias(f"mse_{p}") for p in ("train", "val", "test")],
        *[one(F.avg, p).alias(f"mae_{p}") for p in ("train", "val", "test")],
        *[ratio(one(F.avg, p), one(F.stddev_pop, p)).alias(f"sharpe_{p}") for p in ("train", "val", "test")],
    )
    return N.generalisation(g).select("symbol", "passed", "issues", "verdict")


def overfitting_signs(spark, sf_dir):
    """Signs of overfitting with a bar's low and high as losses."""
    e = A.bars(spark, sf_dir).select(C("symbol").alias("model"), F.row_number().over(ordered()).alias("epoch"), (C("low") / 100).alias("train_loss"), (C("high") / 100).alias("val_loss"))
    return tidy(N.overfitting_signs(e, gap=1.0, share=50.0, patience=10))


def _predictions(spark, sf_dir):
    r = B.with_returns(A.bars(spark, sf_dir))
    d = r.select("symbol", "open_time", C("ret").alias("actual"), back("ret").alias("follow"), (-back("ret")).alias("fade"), back("ret", 2).alias("older")).where("older is not null")
    return d.select("symbol", F.row_number().over(ordered()).alias("step"), "actual", *MODELS)


def ensemble(spark, sf_dir):
    """Predictions of the next return by three models of moving weights."""
    return tidy(N.ensemble(_predictions(spark, sf_dir), MODELS, every=20))


def guarded_metrics(spark, sf_dir):
    """Metrics of trading against the last return."""
    r = B.with_returns(A.bars(spark, sf_dir))
    return tidy(N.guarded_metrics(r.select("symbol", "open_time", C("ret").alias("actual"), (-back("ret")).alias("predicted")), ANNUAL_HOURS), 4)


def funding_state(spark, sf_dir):
    """Customers' balances as funding rates."""
    r = A.table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), (C("c_acctbal") / 5_000_000).alias("rate"))
    return tidy(N.funding_state(r), 8)


def version_ids(spark, sf_dir):
    """Version ids of orders by their priority and customer."""
    o = A.table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), "o_orderpriority", "o_custkey", "o_orderdate")
    return N.version_ids(o, ["o_orderpriority", "o_custkey"], "o_orderdate").select("id", "version_id")


def api_rows(spark, sf_dir):
    """Line items as JSON with decimals as strings."""
    f = A.table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").alias("id"), C("l_linenumber").alias("line"), F.concat(F.lit("s"), C("l_suppkey").cast("string")).alias("symbol"),
        C("l_extendedprice").alias("price"), C("l_quantity").alias("qty"),
    )
    return N.api_rows(f).select("id", "line", "json")


def feature_frame(spark, sf_dir):
    """All features of the bars and their targets in one table."""
    return tidy(B.feature_frame(A.bars(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (feature_frame, generalisation, overfitting_signs, ensemble, guarded_metrics, funding_state, version_ids, api_rows)}

_PARTS = ("train", "val", "test")
_X = "(high - close)"
_SPLIT = f"""n AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS k FROM bars),
  pt AS (SELECT *, CASE WHEN i < floor(k * 0.7::DOUBLE) THEN 'train' WHEN i < floor(k * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS p FROM n)"""
_PRED = f"""{RETS}, d AS (SELECT symbol, open_time, ret AS actual, lag(ret) OVER ({W}) AS follow, -lag(ret) OVER ({W}) AS fade, lag(ret, 2) OVER ({W}) AS older FROM rets),
  p AS MATERIALIZED (SELECT symbol, row_number() OVER ({W}) AS step, actual, follow, fade, older FROM d WHERE older IS NOT NULL)"""
_RIGHT = ", ".join(f"greatest(avg(CAST(sign({m}) = sign(actual) AS DOUBLE)) OVER f, 0.01) AS {m}" for m in MODELS)
_NEXT = ", ".join(f"greatest(0.95::DOUBLE * w.{m} + 0.05::DOUBLE * s.{m} / (s.follow + s.fade + s.older), 0.05::DOUBLE) AS {m}" for m in MODELS)

_FEATURES = ("returns_volatility", "range_volatility", "momentum_averages", "rsi", "order_flow", "illiquidity", "time_features", "forward_targets")

ORACLE_SQL = {
    "feature_frame": f"SELECT * FROM ({bar_queries.ORACLE_SQL['ohlcv_bars']}) " + " ".join(f"JOIN ({bar_queries.ORACLE_SQL[n]}) USING (symbol, open_time)" for n in _FEATURES),
    "generalisation": f"""WITH {BARS}, {_SPLIT}, g AS (SELECT symbol, {', '.join(f"avg({_X} * {_X}) FILTER (p = '{p}') AS mse_{p}, avg({_X}) FILTER (p = '{p}') AS mae_{p}, avg({_X}) FILTER (p = '{p}') / nullif(stddev_pop({_X}) FILTER (p = '{p}'), 0) AS sharpe_{p}" for p in _PARTS)} FROM pt GROUP BY symbol),
      l AS (SELECT symbol, concat_ws(', ', {', '.join(f"CASE WHEN {m}_train < {m}_val * 0.5 THEN '{m}: overfitting' END, CASE WHEN {m}_val < {m}_test * 0.7 THEN '{m}: shift' END" for m in ('mse', 'mae'))}, CASE WHEN sharpe_train > sharpe_val * 2 THEN 'sharpe: overfitting' END) AS issues FROM g)
      SELECT symbol, CAST(issues NOT LIKE '%overfitting%' AS INTEGER) AS passed, issues,
        CASE WHEN issues = '' THEN 'GOOD GENERALIZATION' WHEN issues NOT LIKE '%,%' THEN 'MINOR CONCERNS' ELSE 'POTENTIAL OVERFITTING' END AS verdict FROM l""",
    "overfitting_signs": f"""WITH RECURSIVE {BARS}, e AS MATERIALIZED (SELECT symbol AS model, CAST(row_number() OVER ({W}) AS INTEGER) AS epoch, low / 100 AS t, high / 100 AS v FROM bars),
      s AS (SELECT model, epoch, v AS best, 0 AS waited FROM e WHERE epoch = 1 UNION ALL
        SELECT e.model, e.epoch, CASE WHEN e.v < s.best - 1e-4 THEN e.v ELSE s.best END, CASE WHEN e.v < s.best - 1e-4 THEN 0 ELSE s.waited + 1 END FROM s JOIN e ON e.model = s.model AND e.epoch = s.epoch + 1),
      x AS (SELECT e.*, waited, v - t AS gap, v / (t + 1e-8) AS gap_ratio, count(*) OVER f >= 3 AND t < first_value(t) OVER f AND v > first_value(v) OVER f AS apart, min(v - t) OVER f AS low5, first_value(v) OVER (PARTITION BY e.model ORDER BY e.epoch) AS v1
        FROM e JOIN s ON s.model = e.model AND s.epoch = e.epoch WINDOW f AS (PARTITION BY e.model ORDER BY e.epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
      y AS (SELECT *, CASE WHEN gap > 3 THEN 'severe' WHEN gap > 2 THEN 'moderate' WHEN gap > 1 OR gap_ratio > 50 THEN 'mild' WHEN apart THEN 'moderate' ELSE 'none' END AS severity FROM x)
      SELECT model, epoch, {_r({'gap': 'gap', 'gap_ratio': 'gap_ratio'})}, waited, severity, CAST(severity <> 'none' AS INTEGER) AS overfitting,
        CASE WHEN waited >= 10 THEN 'patience' WHEN epoch > 5 AND low5 > 2 THEN 'severe' WHEN epoch > 1 AND v > 5 * v1 THEN 'exploded' ELSE '' END AS stop FROM y""",
    "ensemble": f"""WITH RECURSIVE {_PRED}, a AS (SELECT symbol, step, {_RIGHT} FROM p WINDOW f AS (PARTITION BY symbol ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
      s AS MATERIALIZED (SELECT * FROM a WHERE step % 20 = 0),
      w AS (SELECT DISTINCT symbol, 0::BIGINT AS step, 1 / 3.0::DOUBLE AS follow, 1 / 3.0::DOUBLE AS fade, 1 / 3.0::DOUBLE AS older FROM p UNION ALL
        SELECT symbol, step, follow / (follow + fade + older), fade / (follow + fade + older), older / (follow + fade + older) FROM (SELECT s.symbol, s.step, {_NEXT} FROM w JOIN s ON s.symbol = w.symbol AND s.step = w.step + 20) u)
      SELECT p.symbol, CAST(p.step AS INTEGER) AS step, {_r({f'weight_{m}': f'w.{m}' for m in MODELS} | {'prediction': ' + '.join(f'w.{m} * p.{m}' for m in MODELS)})}
      FROM p JOIN w ON w.symbol = p.symbol AND w.step = (p.step - 1) // 20 * 20""",
    "guarded_metrics": f"""WITH {RETS}, d AS (SELECT symbol, open_time, ret AS a, -lag(ret) OVER ({W}) AS p FROM rets), e AS (SELECT *, a * sign(p) AS s FROM d WHERE a IS NOT NULL AND p IS NOT NULL),
      c AS (SELECT *, sum(s) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum FROM e), k AS (SELECT *, max(cum) OVER ({W} ROWS UNBOUNDED PRECEDING) - cum AS down FROM c),
      g AS (SELECT symbol, avg(CAST(sign(a) = sign(p) AS DOUBLE)) AS da, avg(CAST(s > 0 AS DOUBLE)) AS wr, avg(s) AS m, stddev_pop(s) AS sd, stddev_pop(s) FILTER (s < 0) AS dsd,
        coalesce(sum(s) FILTER (s > 0), 0) AS up, coalesce(-sum(s) FILTER (s < 0), 0) AS lost, sum(s) AS total, max(down) AS md FROM k GROUP BY symbol),
      h AS (SELECT *, m / (sd + 1e-8) * {ANNUAL_HOURS!r} AS sh FROM g)
      SELECT symbol, {_r({'direction_accuracy': 'da', 'win_rate': 'wr', 'sharpe': 'sh', 'sortino': f'CASE WHEN dsd IS NOT NULL THEN m / (dsd + 1e-8) * {ANNUAL_HOURS!r} ELSE 1.5 * sh END',
        'calmar': f'CASE WHEN md > 0 THEN total / md * {ANNUAL_HOURS!r} / 252 ELSE sh END', 'profit_factor': 'up / (lost + 1e-8)', 'total_return': 'total', 'max_drawdown': 'md'}, 4)} FROM h""",
    "funding_state": """WITH r AS (SELECT c_custkey AS id, c_acctbal / 5000000 AS rate FROM customer)
      SELECT id, round(rate, 8) AS rate, round(rate * 100, 8) AS funding_pct, CAST(rate > 0 AS INTEGER) AS longs_pay,
        CASE WHEN rate * 100 > 0.05 THEN 'bullish' WHEN rate * 100 < -0.05 THEN 'bearish' ELSE 'neutral' END AS sentiment, CAST(abs(rate * 100) > 0.1 AS INTEGER) AS extreme FROM r""",
    "version_ids": """SELECT o_orderkey AS id, 'v' || strftime(o_orderdate, '%Y%m%d') || '_' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}'), 1, 8) AS version_id FROM orders""",
    "api_rows": """SELECT l_orderkey AS id, l_linenumber AS line, '{"symbol":"S' || l_suppkey || '","price":"' || CAST(l_extendedprice AS DECIMAL(18, 2)) || '","quantity":"' || CAST(l_quantity AS DECIMAL(18, 2))
      || '","notional":"' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_quantity AS DECIMAL(18, 2)) AS DECIMAL(38, 4)) || '"}' AS json FROM lineitem""",
}
