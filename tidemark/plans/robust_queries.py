"""Queries on how much of a result is luck, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import PPF_CUT, PPF_MIDDLE, PPF_MIDDLE_BELOW, PPF_TAIL, PPF_TAIL_BELOW, normal_ppf
from tidemark.functions.windows import ordered
from tidemark.operators import bars as B
from tidemark.operators import portfolio as P
from tidemark.operators import robust as R
from tidemark.operators.validation import purged_folds
from tidemark.plans.bar_queries import BARS, RETS, TICKS, W
from tidemark.plans.flow_queries import BT, LOG, _r, tidy
from tidemark.plans.flow_queries import walk_forward as _walked
from tidemark.sources import adapters as A

C = F.col


def _tested(spark, sf_dir):
    return P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))


def block_bootstrap(spark, sf_dir):
    """Intervals of each symbol's return, Sharpe ratio and drawdown over 1000 resamplings of blocks of twenty bars."""
    return tidy(R.block_bootstrap(B.with_returns(A.bars(spark, sf_dir))), 4)


def deflated_sharpe(spark, sf_dir):
    """The strategy's Sharpe ratio over combinatorial folds, deflated by their number."""
    return tidy(R.fold_summary(purged_folds(_tested(spark, sf_dir)).where("part = 'test'")), 4)


def data_snooping(spark, sf_dir):
    """The risk that the best version of each symbol's strategy is luck, by how many were tried."""
    t = A.trades_log(spark, sf_dir)
    best = t.groupBy("symbol", "version").agg((F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0))).alias("sharpe"), F.count("*").alias("n")).where("n >= 5")
    tried = t.groupBy("symbol").agg(F.count_distinct("version").alias("strategies"), F.count("*").alias("observations"))
    best = best.groupBy(C("symbol").alias("s")).agg(F.max("sharpe").alias("best_sharpe"))
    return tidy(R.data_snooping(tried.join(best, C("symbol") == C("s"), "left").drop("s")))


def overfit_signature(spark, sf_dir):
    """Signs in training and test returns that a strategy was fitted too closely."""
    return tidy(R.overfit_signature(B.split(_tested(spark, sf_dir))), 5)


def permuted_overfitting(spark, sf_dir):
    """The probability of overfitting by 1000 permutations of each symbol's walk-forward folds."""
    return tidy(R.permuted_overfitting(_walked(spark, sf_dir).select("symbol", "fold", C("test_return").alias("total"))))


def prioritised_sample(spark, sf_dir):
    """A hundred ticks of each symbol, drawn without replacement by the size of their notional."""
    t = A.ticks(spark, sf_dir).select("event_id", "symbol", (C("price") * C("qty")).alias("priority"))
    return tidy(R.prioritised_sample(t, "priority", 100, item="event_id"), 8)


def normal_scores(spark, sf_dir):
    """Each bar's volume as a normal score of its rank."""
    b = A.bars(spark, sf_dir)
    rank = (F.row_number().over(ordered("symbol", ["volume", "open_time"])) - 0.5) / F.count("*").over(Window.partitionBy("symbol"))
    return tidy(b.select("symbol", "open_time", normal_ppf(rank).alias("score")))


QUERIES = {f.__name__: f for f in (block_bootstrap, deflated_sharpe, data_snooping, overfit_signature, permuted_overfitting, prioritised_sample, normal_scores)}


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out}) * {x} + ({c!r}))"
    return out


def ppf(p: str) -> str:
    """The inverse normal distribution function in SQL."""
    p = f"CAST({p} AS DOUBLE)"
    tail = lambda x: f"{_poly(PPF_TAIL, f'sqrt(-2 * ln({x}))')} / {_poly(PPF_TAIL_BELOW, f'sqrt(-2 * ln({x}))')}"
    q = f"({p} - 0.5)"
    return f"""CASE WHEN {p} = 0 THEN '-inf'::DOUBLE WHEN {p} = 1 THEN 'inf'::DOUBLE WHEN {p} > 0 AND {p} < {PPF_CUT} THEN {tail(p)} WHEN {p} < 1 AND {p} > {1 - PPF_CUT} THEN -({tail(f'(1 - {p})')})
      WHEN {p} > 0 AND {p} < 1 THEN {q} * {_poly(PPF_MIDDLE, f'({q} * {q})')} / {_poly(PPF_MIDDLE_BELOW, f'({q} * {q})')} END"""


def cdf(z: str) -> str:
    """The normal distribution function in SQL, by the same approximation as the operator's."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    tail = f"exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r} * ({t} * {_poly((1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), t)})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def _expected(k: str) -> str:
    return f"(CASE WHEN {k} > 1 THEN {1 - R.EULER!r} * ({ppf(f'1 - 1 / CAST({k} AS DOUBLE)')}) + {R.EULER!r} * ({ppf(f'1 - 1 / ({k} * {math.e!r})')}) END)"


def _draw(m: str, *of: str) -> str:
    return f"(CAST('0x' || substr(md5({' || chr(58) || '.join(f'CAST({x} AS VARCHAR)' for x in of)}), 1, 8) AS BIGINT) % {m})"


_YEAR = repr(math.sqrt(252.0))
_SHARPE = f"avg(x) / nullif(stddev_pop(x), 0) * {_YEAR}"
#: Test rows of the ten folds.
_TESTED = f"""{BT}, nb AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bt), gb AS (SELECT *, CAST(least(floor(i / nullif(floor(n / 5), 0)), 4) AS INTEGER) AS grp FROM nb),
  tf AS (SELECT gb.*, a.x * 10 + b.x AS fold FROM gb CROSS JOIN range(0, 5) a(x) CROSS JOIN range(0, 5) b(x) WHERE a.x < b.x AND (grp = a.x OR grp = b.x))"""
_PARTS = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bt),
  pt AS (SELECT *, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i >= floor(n * CAST(0.85 AS DOUBLE)) THEN 'test' END AS part FROM n)"""

ORACLE_SQL = {
    "block_bootstrap": f"""WITH {RETS}, k AS MATERIALIZED (SELECT symbol, ret AS x, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL),
      m AS (SELECT DISTINCT symbol, n // 20 AS m FROM k WHERE n >= 20), d AS (SELECT symbol, sim, pl, {_draw('m', '42', 'symbol', 'sim', 'pl')} AS b FROM (SELECT symbol, m, sim, unnest(range(0, m)) AS pl FROM m CROSS JOIN range(0, 1000) s(sim))),
      p AS (SELECT d.symbol, sim, pl * 20 + k.i % 20 AS j, x FROM d JOIN k ON k.symbol = d.symbol AND k.i // 20 = b),
      c AS (SELECT *, sum(x) OVER (PARTITION BY symbol, sim ORDER BY j) AS s FROM p), h AS (SELECT *, max(s) OVER (PARTITION BY symbol, sim ORDER BY j) - s AS dd FROM c),
      z AS (SELECT symbol, sim, sum(x) AS "return", {_SHARPE} AS sharpe, max(dd) AS drawdown FROM h GROUP BY symbol, sim),
      oc AS (SELECT *, sum(x) OVER (PARTITION BY symbol ORDER BY i) AS s FROM k), oh AS (SELECT *, max(s) OVER (PARTITION BY symbol ORDER BY i) - s AS dd FROM oc),
      o AS (SELECT symbol, sum(x) AS own_return, {_SHARPE} AS own_sharpe, max(dd) AS own_drawdown FROM oh GROUP BY symbol)
      SELECT z.symbol, count(*) AS simulations, {_r({f'{c}_{n}': f.format(f'"{c}"') for c in ('return', 'sharpe', 'drawdown') for n, f in (('mean', 'avg({})'), ('std', 'stddev_pop({})'), ('low', 'quantile_cont({}, 0.025)'), ('high', 'quantile_cont({}, 0.975)'))}
        | {'sharpe_p5': 'quantile_cont(sharpe, 0.05)', 'drawdown_p95': 'quantile_cont(drawdown, 0.95)', 'sharpe_positive': 'avg(CAST(sharpe > 0 AS DOUBLE))', 'sharpe_above_1': 'avg(CAST(sharpe > 1 AS DOUBLE))'}
        | {c: f'any_value({c})' for c in ('own_return', 'own_sharpe', 'own_drawdown')}, 4)} FROM z JOIN o ON o.symbol = z.symbol GROUP BY z.symbol""",
    "deflated_sharpe": f"""WITH {_TESTED}, e AS (SELECT symbol, fold, avg(strategy) / nullif(stddev_samp(strategy), 0) * {_YEAR} AS sharpe FROM tf GROUP BY ALL),
      g AS (SELECT symbol, count(*) AS trials, avg(sharpe) AS mean, stddev_pop(sharpe) AS std FROM e GROUP BY symbol),
      mo AS (SELECT symbol, avg(strategy) AS mu, stddev_pop(strategy) AS sp FROM tf GROUP BY symbol),
      s AS (SELECT tf.symbol, avg(strategy) / nullif(stddev_samp(strategy), 0) * {_YEAR} AS sharpe, count(strategy) AS n, avg(pow((strategy - mu) / nullif(sp, 0), 3)) AS skew, avg(pow((strategy - mu) / nullif(sp, 0), 4)) AS kurt FROM tf JOIN mo ON mo.symbol = tf.symbol GROUP BY tf.symbol),
      z AS (SELECT g.*, sharpe, n, skew, kurt, CASE WHEN n >= 2 THEN (sharpe - std * {_expected('trials')}) / nullif(sqrt((1 + 0.5 * sharpe * sharpe - skew * sharpe + (kurt - 3) / 4 * sharpe * sharpe) / (n - 1)), 0) END AS z FROM g JOIN s ON s.symbol = g.symbol)
      SELECT symbol, trials, n, {_r({'mean': 'mean', 'std': 'std', 'sharpe': 'sharpe', 'skew': 'skew', 'kurt': 'kurt', 'deflated_sharpe': 'z', 'p_value': f'1 - {cdf("z")}'}, 4)} FROM z""",
    "data_snooping": f"""WITH {LOG}, b AS (SELECT symbol, version, avg(pnl) / nullif(stddev_samp(pnl), 0) AS sharpe FROM trades GROUP BY ALL HAVING count(*) >= 5), bb AS (SELECT symbol, max(sharpe) AS best_sharpe FROM b GROUP BY symbol),
      t AS (SELECT symbol, count(DISTINCT version) AS strategies, count(*) AS observations FROM trades GROUP BY symbol),
      d AS (SELECT t.*, best_sharpe, {_expected('strategies')} AS expected_best, 0.05::DOUBLE / strategies AS bonferroni, 1 - pow(0.95::DOUBLE, strategies) AS spurious, ln(strategies) / sqrt(observations) AS score FROM t LEFT JOIN bb ON bb.symbol = t.symbol),
      i AS (SELECT *, concat_ws(',', CASE WHEN best_sharpe < expected_best THEN 'below_expected' END, CASE WHEN bonferroni < 1e-6 THEN 'severe_multiple_testing' END, CASE WHEN spurious > 0.5 THEN 'high_spurious_probability' END,
        CASE WHEN score > 0.5 THEN 'high_snooping_score' END) AS issues FROM d)
      SELECT symbol, strategies, observations, issues, CAST(issues = '' AS INTEGER) AS passed,
        {_r({c: c for c in ('best_sharpe', 'expected_best', 'bonferroni', 'spurious', 'score')} | {'least_sharpe': f'({ppf("1 - bonferroni")}) / sqrt(observations)'})} FROM i""",
    "overfit_signature": f"""WITH {BT}, {_PARTS}, h AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY open_time) - 1 AS k, count(*) OVER (PARTITION BY symbol, part) // 2 AS half FROM pt WHERE part IS NOT NULL),
      g AS (SELECT symbol, avg(strategy) FILTER (part = 'train') AS a, avg(strategy) FILTER (part = 'test') AS b, count(*) FILTER (part = 'test') AS n, avg(strategy) FILTER (part = 'test' AND k < half) AS f1, avg(strategy) FILTER (part = 'test' AND k >= half) AS f2 FROM h GROUP BY symbol),
      r AS (SELECT *, CAST(coalesce(a / nullif(b, 0) > 2, false) AS INTEGER) AS gap, CAST(coalesce(n >= 2 AND f1 > f2 * 1.5, false) AS INTEGER) AS degrades FROM g)
      SELECT symbol, {_r({'train_mean': 'a', 'test_mean': 'b', 'first_half': 'f1', 'second_half': 'f2'}, 5)}, gap, degrades, CAST(gap + degrades = 0 AS INTEGER) AS passed FROM r""",
    "permuted_overfitting": f"""WITH {BT}, nb AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM bt),
      f AS (SELECT symbol, CAST(g.fold AS INTEGER) AS fold, round(sum(CASE WHEN i - g.fold * 50 >= 100 THEN strategy END), 5) AS total FROM nb JOIN range(0, 100000) g(fold) ON g.fold * 50 <= i AND i < g.fold * 50 + 150 AND g.fold * 50 + 150 <= c GROUP BY ALL),
      n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE total IS NOT NULL),
      d AS (SELECT symbol, fold, total, n, p, n // 2 AS half, row_number() OVER (PARTITION BY symbol, p ORDER BY md5('42:' || symbol || ':' || p || ':' || fold), fold) - 1 AS i FROM n CROSS JOIN range(0, 1000) r(p) WHERE n >= 4),
      g AS (SELECT symbol, p, any_value(n) AS n, any_value(half) AS half, arg_min(i, (-total, i)) FILTER (i < half) AS best, median(total) FILTER (i >= half) AS middle FROM d GROUP BY symbol, p),
      x AS (SELECT g.symbol, d.total < g.middle AS under FROM g JOIN d ON d.symbol = g.symbol AND d.p = g.p AND d.i = g.half + CASE WHEN best < g.n - g.half THEN best ELSE 0 END)
      SELECT symbol, round(avg(CAST(under AS DOUBLE)), 6) AS pbo FROM x GROUP BY symbol UNION ALL SELECT DISTINCT symbol, CAST(0 AS DOUBLE) FROM n WHERE n < 4""",
    "prioritised_sample": f"""WITH {TICKS}, d AS (SELECT event_id, symbol, price * qty AS priority, pow(price * qty, 0.6) AS w, ({_draw('4294967296', '42', 'symbol', 'event_id')} + 0.5) / 4294967296 AS u FROM ticks WHERE price * qty > 0),
      e AS (SELECT *, w / sum(w) OVER (PARTITION BY symbol) AS p, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY -ln(u) / w, event_id) AS place FROM d),
      s AS (SELECT *, pow(n * p, -0.4) AS raw FROM e WHERE place <= 100)
      SELECT event_id, symbol, round(priority, 8) AS priority, CAST(place AS INTEGER) AS place, round(p, 8) AS probability, round(raw / max(raw) OVER (PARTITION BY symbol), 8) AS weight FROM s""",
    "normal_scores": f"""WITH {BARS}, r AS (SELECT symbol, open_time, (row_number() OVER (PARTITION BY symbol ORDER BY volume, open_time) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY symbol) AS p FROM bars)
      SELECT symbol, open_time, round({ppf('p')}, 6) AS score FROM r""",
    # Queries registered elsewhere, whose SQL needs the parts above.
    "bulk_classified": f"""WITH {BARS}, l AS (SELECT *, close / nullif(lag(close) OVER ({W}), 0) AS q FROM bars), k AS (SELECT *, CASE WHEN q > 0 THEN ln(q) END AS lr FROM l),
      z AS (SELECT *, count(lr) OVER f AS c, (q - 1) / greatest(stddev_pop(lr) OVER f, 1e-8) AS z FROM k WINDOW f AS ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
      s AS (SELECT *, CASE WHEN c < 10 THEN 0.5 WHEN z IS NOT NULL THEN {cdf("z")} END AS s FROM z) SELECT symbol, open_time, round(volume * s, 4) AS buy_volume, round(volume * (1 - s), 4) AS sell_volume FROM s""",
    "fold_sharpe": f"""WITH {_TESTED}, e AS (SELECT symbol, CAST(fold AS INTEGER) AS fold, avg(strategy) / nullif(stddev_samp(strategy), 0) * {_YEAR} AS sharpe FROM tf GROUP BY ALL)
      SELECT symbol, fold, round(sharpe, 4) AS sharpe, round(avg(sharpe) OVER (PARTITION BY symbol), 4) AS mean, round(stddev_pop(sharpe) OVER (PARTITION BY symbol), 4) AS std FROM e""",
    "overfitting": f"""WITH {BT}, s AS (SELECT symbol, dayofmonth(open_time) % 6 AS part, avg(strategy) AS score FROM bt GROUP BY ALL),
      h AS (SELECT a.x * 100 + b.x * 10 + c.x AS half, [a.x, b.x, c.x] AS inside FROM range(0, 6) a(x), range(0, 6) b(x), range(0, 6) c(x) WHERE a.x < b.x AND b.x < c.x),
      m AS (SELECT half, symbol, avg(score) FILTER (list_contains(inside, part)) AS a, avg(score) FILTER (NOT list_contains(inside, part)) AS b FROM s CROSS JOIN h GROUP BY ALL),
      r AS (SELECT *, (rank() OVER (PARTITION BY half ORDER BY b NULLS FIRST) + (count(*) OVER (PARTITION BY half, b) - 1) / 2) / count(*) OVER (PARTITION BY half) AS r, row_number() OVER (PARTITION BY half ORDER BY a DESC NULLS LAST, symbol) AS best FROM m),
      x AS (SELECT greatest(least(r, 1 - 1e-10), 1e-10) AS x FROM r WHERE best = 1) SELECT count(*) AS halves, round(avg(CAST(ln(x / (1 - x)) < 0 AS DOUBLE)), 6) AS pbo FROM x""",
    "tail_risk": f"""WITH {RETS}, l AS (SELECT symbol, CASE WHEN ret < 0 THEN -ret END AS loss FROM rets), g AS (SELECT symbol, count(loss) AS losses, quantile_cont(loss, 0.95) AS u FROM l GROUP BY symbol),
      o AS (SELECT l.symbol, loss - u AS e, row_number() OVER (PARTITION BY l.symbol ORDER BY loss) AS i, count(*) OVER (PARTITION BY l.symbol) AS n FROM l JOIN g ON g.symbol = l.symbol WHERE loss > u),
      b AS (SELECT symbol, any_value(n) AS n, avg(e) AS b0, sum(e * (n - i) / (n - 1)) / any_value(n) AS b1 FROM o WHERE n >= 10 GROUP BY symbol),
      p AS (SELECT *, 2 - b0 / nullif(b0 - 2 * b1, 0) AS shape, 2 * b0 * b1 / nullif(b0 - 2 * b1, 0) AS scale FROM b),
      v AS (SELECT g.symbol, losses, u, shape, scale, u + CASE WHEN abs(shape) > 1e-9 THEN scale / shape * (pow(0.01 / (n / losses), -shape) - 1) ELSE -scale * ln(0.01 / (n / losses)) END AS var FROM g LEFT JOIN p ON p.symbol = g.symbol)
      SELECT symbol, losses, round(var, 6) AS var, CASE WHEN shape < 1 THEN round(var / (1 - shape) + (scale - shape * u) / (1 - shape), 6) WHEN shape >= 1 THEN 'inf'::DOUBLE END AS shortfall FROM v""",
    "rolling_hurst": f"""WITH {BARS}, q AS (SELECT *, close / nullif(lag(close) OVER ({W}), 0) AS q FROM bars), r AS (SELECT *, CASE WHEN q > 0 THEN ln(q) END AS r FROM q),
      d AS (SELECT *, {', '.join(f'r - lag(r, {k}) OVER ({W}) AS d{k}' for k in range(2, 20))} FROM r),
      s AS (SELECT symbol, open_time, count(r) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS c, {', '.join(f'stddev_pop(d{k}) OVER ({W} ROWS BETWEEN {99 - k} PRECEDING AND CURRENT ROW) AS s{k}' for k in range(2, 20))} FROM d),
      u AS (SELECT symbol, open_time, c, least({', '.join(f's{k}' for k in range(2, 20))}) AS low, unnest([{', '.join(f'ln({k}::DOUBLE)' for k in range(2, 20))}]) AS x, unnest([{', '.join(f'CASE WHEN s{k} > 0 THEN ln(s{k}) END' for k in range(2, 20))}]) AS y FROM s)
      SELECT symbol, open_time, round(CASE WHEN any_value(c) = 100 THEN CASE WHEN any_value(low) <= 0 THEN 0.5 ELSE 2 * regr_slope(y, x) END END, 5) AS hurst FROM u GROUP BY symbol, open_time""",
    "table_hash": """WITH h AS (SELECT sha256(concat_ws(chr(31), {})) AS h FROM orders) SELECT count(*) AS n, bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS xor_hash, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS sum_hash FROM h""".format(
        ", ".join("coalesce(" + ("printf('%.6f', o_totalprice)" if c == "o_totalprice" else f"CAST({c} AS VARCHAR)") + ", '\\N')" for c in ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"))
    ),
}
