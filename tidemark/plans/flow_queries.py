"""Queries on books, flow, trades, portfolios and metrics, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import by_stretches, so_far
from tidemark.operators import bars as B
from tidemark.operators import flow as L
from tidemark.operators import metrics as M
from tidemark.operators import portfolio as P
from tidemark.plans.bar_queries import BARS, RETS, TICKS, W, back, full
from tidemark.sources import adapters as A

C = F.col


def tidy(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, for comparison across engines."""
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else C(c) for c, t in df.dtypes])


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_returns(A.bars(spark, sf_dir))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next returns and the last return turned round as their prediction."""
    r = B.with_returns(A.bars(spark, sf_dir))
    return r.select("symbol", "open_time", F.lead("ret").over(B.ordered()).alias("y"), F.round(-C("ret") / 10, 8).alias("p"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "orders").select(
        C("o_custkey").alias("symbol"), C("o_orderdate").alias("ts"), C("o_orderkey").alias("id"), (C("o_orderkey") % 50).cast("double").alias("qty"),
        F.when(C("o_orderkey") % 3 == 0, -1).otherwise(1).alias("side"), (C("o_totalprice") / 100).alias("price"),
    )


def book_state(spark, sf_dir):
    """Best prices, imbalances, depth and pressure of each book after all updates."""
    return tidy(L.book_state(A.book_updates(spark, sf_dir)))


def book_levels(spark, sf_dir):
    """The twenty best levels of each side."""
    return L.book_levels(A.book_updates(spark, sf_dir)).select("symbol", "book_side", "price", "qty", "level")


def book_vwap(spark, sf_dir):
    """The price of taking 100 from each side, and its slippage."""
    return tidy(L.book_vwap(A.book_updates(spark, sf_dir)))


def quote_flow(spark, sf_dir):
    """Order-flow imbalance of quotes with its z-score."""
    return tidy(by_stretches(A.quotes(A.ticks(spark, sf_dir)), L.quote_flow, 100))


def spread_impact(spark, sf_dir):
    """Effective and realised spread and price impact of quotes."""
    return tidy(by_stretches(A.quotes(A.ticks(spark, sf_dir)), L.spread_impact, 5), 4)


def kyle_lambda(spark, sf_dir):
    """Price impact of signed volume over the last fifty ticks."""
    return tidy(L.kyle_lambda(A.ticks(spark, sf_dir)), 5)


def tick_features(spark, sf_dir):
    """Volatility, momentum, imbalance slope and z-score of ticks."""
    return tidy(by_stretches(A.with_imbalance(A.ticks(spark, sf_dir)), L.tick_features, 120))


def imbalance_signals(spark, sf_dir):
    """Signals of strong, lasting imbalance."""
    t = A.with_imbalance(A.ticks(spark, sf_dir))
    return tidy(L.imbalance_signals(t.withColumn("weighted_imbalance", (C("qty") - 40) / 60.0).withColumn("position", (C("event_id") % 3 - 1).cast("double"))))


def volume_bars(spark, sf_dir):
    """Bars of 1000 units of volume."""
    return tidy(L.volume_bars(A.ticks(spark, sf_dir)))


def vpin(spark, sf_dir):
    """Flow toxicity over fifty volume bars, its place in history and its label."""
    return tidy(L.toxicity_regime(L.vpin(A.ticks(spark, sf_dir))))


def bulk_classified(spark, sf_dir):
    """Bulk-classified volume of bars."""
    return tidy(L.bulk_classified(A.bars(spark, sf_dir)), 4)


def decayed_flow(spark, sf_dir):
    """Net taker volume, fading."""
    return tidy(L.decayed_flow(A.bars(spark, sf_dir)))


def hawkes_intensity(spark, sf_dir):
    """Self-exciting intensity of hours with large trades."""
    return tidy(L.hawkes_intensity(A.ticks(spark, sf_dir).where("qty >= 90")))


def trade_through_asof(spark, sf_dir):
    """Trades against the quote before them."""
    t = A.ticks(spark, sf_dir)
    return tidy(L.trade_through(t, A.quotes(t)))


def return_metrics(spark, sf_dir):
    """Return, risk and win metrics of each symbol's bars."""
    return tidy(M.return_metrics(_returns(spark, sf_dir)), 5)


def drawdowns(spark, sf_dir):
    """Drawdown of summed returns and its longest duration."""
    return tidy(M.drawdowns(_returns(spark, sf_dir)))


def value_at_risk(spark, sf_dir):
    """Value at risk and expected shortfall."""
    return tidy(M.value_at_risk(_returns(spark, sf_dir)))


def alpha_beta(spark, sf_dir):
    """Each symbol against the mean return of all in the same hour."""
    r = _returns(spark, sf_dir).select("symbol", "open_time", "ret")
    m = r.groupBy(C("open_time").alias("t")).agg(F.avg("ret").alias("benchmark"))
    return tidy(M.alpha_beta(r.join(m, C("open_time") == C("t"))), 5)


def prediction_metrics(spark, sf_dir):
    """Errors and direction metrics of a reversal prediction."""
    return tidy(M.prediction_metrics(_predicted(spark, sf_dir)), 5)


def information_coefficient(spark, sf_dir):
    """Rank correlation of prediction and outcome."""
    return tidy(M.information_coefficient(_predicted(spark, sf_dir)))


def quantile_returns(spark, sf_dir):
    """Mean outcome by fifths of the prediction."""
    return tidy(M.quantile_returns(_predicted(spark, sf_dir)))


def trade_summary(spark, sf_dir):
    """Summary of the trade log."""
    return tidy(M.trade_summary(A.trades_log(spark, sf_dir)), 2)


def daily_sharpe(spark, sf_dir):
    """Sharpe ratio of daily profits."""
    return tidy(M.daily_sharpe(A.trades_log(spark, sf_dir)))


def equity_drawdown(spark, sf_dir):
    """Equity and drawdown by day."""
    return tidy(M.equity_drawdown(A.trades_log(spark, sf_dir), 1e9), 2)


def pnl_heatmap(spark, sf_dir):
    """Profit by month and weekday."""
    return tidy(M.pnl_heatmap(A.trades_log(spark, sf_dir)), 2)


def hourly_heatmap(spark, sf_dir):
    """What a crossing of moving averages earned by hour and weekday."""
    b = P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))
    return tidy(M.hourly_heatmap(b.select(C("open_time").alias("ts"), C("strategy").alias("pnl"))), 5)


def pnl_pivot(spark, sf_dir):
    """Profit by month, weekdays as columns."""
    return tidy(M.pnl_pivot(A.trades_log(spark, sf_dir)), 2)


def pnl_histogram(spark, sf_dir):
    """Trades by fifty bins of profit."""
    return tidy(M.pnl_histogram(A.trades_log(spark, sf_dir)), 2)


def version_performance(spark, sf_dir):
    """Performance by strategy version."""
    return tidy(M.version_performance(A.trades_log(spark, sf_dir)), 2)


def parity_compare(spark, sf_dir):
    """Prices in two precisions held against each other."""
    o = A.table(spark, sf_dir, "orders")
    return tidy(M.compare(o, o.withColumn("o_totalprice", F.round("o_totalprice", -1)), "o_orderkey", "o_totalprice"), 4)


def replay_summary(spark, sf_dir):
    """Events by type with their time range and length in seconds."""
    t = A.ticks(spark, sf_dir)
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    return t.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), seconds.alias("seconds"))


def backtest(spark, sf_dir):
    """A crossing of moving averages, traded with costs."""
    return tidy(P.backtest(P.moving_average_signal(A.bars(spark, sf_dir))), 5)


def round_trips(spark, sf_dir):
    """The trades of that strategy."""
    return tidy(P.round_trips(P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))), 5)


def walk_forward(spark, sf_dir):
    """Its returns over rolling train and test ranges."""
    return tidy(P.walk_forward(P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))), 5)


def _fills(spark, sf_dir):
    f = A.fills(spark, sf_dir)
    return f.select("symbol", F.struct("ts", "order_id", "line", "part", "price", "qty").alias("open_time"), "price", "qty", C("side").cast("double").alias("side"))


def position_fold(spark, sf_dir):
    """Final position and realised profit of each supplier's fills, closing at the entry price."""
    return P.last_positions(_fills(spark, sf_dir)).select("symbol", "fills", F.round("state.qty", 2).alias("qty"), F.round("state.entry", 3).alias("entry"), F.round("state.realised", -2).alias("realised"))


def position_fold_averaged(spark, sf_dir):
    """The same where a partial close averages into the entry price."""
    return P.last_positions(_fills(spark, sf_dir), "reference").select("symbol", "fills", F.round("state.qty", 2).alias("qty"), F.round("state.entry", 3).alias("entry"), F.round("state.realised", -2).alias("realised"))


def risk_checks(spark, sf_dir):
    """The first risk rule that each order breaks."""
    return tidy(P.risk_checks(_orders(spark, sf_dir)))


def price_jumps(spark, sf_dir):
    """Orders far from the price of the one before."""
    return tidy(P.price_jumps(_orders(spark, sf_dir)))


def rate_limit_rolling(spark, sf_dir):
    """Events in the last hour."""
    return P.rolling_rate(A.ticks(spark, sf_dir).drop("price"))


def rate_limit_session(spark, sf_dir):
    """Events numbered within sessions."""
    return P.session_rate(A.ticks(spark, sf_dir))


def loss_breaker(spark, sf_dir):
    """Losses in a row by symbol and customer."""
    t = A.trades_log(spark, sf_dir).withColumn("symbol", F.concat_ws(":", "symbol", "version"))
    return tidy(P.loss_breaker(t), 2)


def latest_position(spark, sf_dir):
    """The last fill of each part and supplier pair's part: an upsert by part."""
    return P.latest(A.fills(spark, sf_dir), "part", ["ts", "order_id", "line", "symbol", "price", "qty"])


def top_trades(spark, sf_dir):
    """The hundred latest trades."""
    return A.trades_log(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id", "symbol", "ts", "notional")


def dedup_first(spark, sf_dir):
    """The first fill of each order and line."""
    return P.first_of(A.fills(spark, sf_dir), ["order_id", "line"], ["ts", "symbol", "part", "price", "qty"])


def index_sets(spark, sf_dir):
    """Customers with orders in both, one and the other of two years: semi and anti joins."""
    o = A.table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    a, b = (o.where(C("y") == y).select("o_custkey").distinct() for y in (1996, 1997))
    both = a.join(b, "o_custkey", "left_semi").withColumn("kind", F.lit("both"))
    first = a.join(b, "o_custkey", "left_anti").withColumn("kind", F.lit("first"))
    second = b.join(a, "o_custkey", "left_anti").withColumn("kind", F.lit("second"))
    return both.unionByName(first).unionByName(second)


def open_interest_change(spark, sf_dir):
    """Change of the traded quantity against 24 and 60 bars before, by count and not by time."""
    b = A.bars(spark, sf_dir)
    return tidy(b.select("symbol", "open_time", *[(F.try_divide(C("volume"), F.nullif(B.back("volume", k), F.lit(0.0))) - 1).alias(f"change_{k}") for k in (24, 60)]))


def feature_leakage(spark, sf_dir):
    """Correlation of features with the next return now, ten bars earlier and ten later, in one pass."""
    r = _returns(spark, sf_dir).withColumn("y", F.lead("ret").over(B.ordered()))
    r = r.withColumn("early", F.lag("y", 10).over(B.ordered())).withColumn("late", F.lead("y", 10).over(B.ordered()))
    cols = ["ret", "volume", "close"]
    one = r.agg(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.corr(c, t).alias(f"corr_{t}") for t in ("y", "early", "late")]) for c in cols]).alias("r"))
    return tidy(one.select(F.inline("r")))


def ks_shift(spark, sf_dir):
    """Two-sample Kolmogorov-Smirnov distance of volumes in training and test rows, by symbol."""
    s = B.split(A.bars(spark, sf_dir)).where("part in ('train', 'test')")
    n = s.groupBy(C("symbol").alias("s")).agg(F.count_if(C("part") == "train").alias("a"), F.count_if(C("part") == "test").alias("b"))
    v = s.groupBy("symbol", "volume").agg(F.count_if(C("part") == "train").alias("x"), F.count_if(C("part") == "test").alias("y"))
    w = so_far(B.ordered("symbol", "volume"))
    v = v.withColumn("x", F.sum("x").over(w)).withColumn("y", F.sum("y").over(w)).join(n, C("symbol") == C("s"))
    return tidy(v.groupBy("symbol").agg(F.max(F.abs(ratio(C("x"), C("a")) - ratio(C("y"), C("b")))).alias("ks")))


def purged_folds(spark, sf_dir):
    """Rows of the ten combinatorial folds of five groups with two held out, purged and embargoed."""
    from tidemark.operators.validation import purged_folds as folds

    f = folds(A.bars(spark, sf_dir))
    return tidy(f.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.avg("close").alias("close")), 5)


QUERIES = {f.__name__: f for f in (
    book_state, book_levels, book_vwap, quote_flow, spread_impact, kyle_lambda, tick_features, imbalance_signals, volume_bars, vpin, bulk_classified, decayed_flow, hawkes_intensity,
    trade_through_asof, return_metrics, drawdowns, value_at_risk, alpha_beta, prediction_metrics, information_coefficient, quantile_returns, trade_summary, daily_sharpe, equity_drawdown,
    pnl_heatmap, hourly_heatmap, pnl_pivot, pnl_histogram, version_performance, parity_compare, replay_summary, backtest, round_trips, walk_forward, position_fold, position_fold_averaged, risk_checks, price_jumps,
    rate_limit_rolling, rate_limit_session, loss_breaker, latest_position, top_trades, dedup_first, index_sets, open_interest_change, feature_leakage, ks_shift, purged_folds,
)}

V = "PARTITION BY symbol ORDER BY ts, event_id"
TR = "PARTITION BY symbol ORDER BY ts, id"


def tick_full(agg: str, x: str, rows: int) -> str:
    f = f"OVER ({V} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {rows} THEN {agg}({x}) {f} END"


BOOK = f"""{TICKS}, updates AS (
  SELECT symbol, event_id AS update_id, CASE WHEN side = 1 THEN 'bid' ELSE 'ask' END AS book_side,
    CAST(CASE WHEN side = 1 THEN 100 - floor(price / 10) ELSE 101 + floor(price / 10) END AS DOUBLE) AS price, CAST(qty AS DOUBLE) AS qty FROM ticks),
last AS (SELECT symbol, book_side, price, arg_max(qty, update_id) AS qty FROM updates GROUP BY ALL),
levels AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, book_side ORDER BY CASE WHEN book_side = 'bid' THEN -price ELSE price END) AS level FROM last WHERE qty > 0) WHERE level <= 20)"""


def _side(x: str, side: str, most: int = 99) -> str:
    return f"sum(CASE WHEN book_side = '{side}' AND level <= {most} THEN {x} ELSE 0 END)"


def _share(x: str, most: int = 99) -> str:
    a, b = _side(x, "bid", most), _side(x, "ask", most)
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


def _top(side: str, c: str) -> str:
    return f"max(CASE WHEN book_side = '{side}' AND level = 1 THEN {c} END)"


STATE = f"""{BOOK}, st AS (SELECT symbol, {_top('bid', 'price')} AS best_bid, {_top('ask', 'price')} AS best_ask, {_top('bid', 'qty')} AS bid_size, {_top('ask', 'qty')} AS ask_size,
  {_share('qty', 5)} AS imbalance, {_share('qty * pow(0.9, level - 1)', 10)} AS weighted_imbalance, {_side('qty', 'bid')} AS bid_depth, {_side('qty', 'ask')} AS ask_depth,
  count(*) FILTER (book_side = 'bid') AS bid_levels, count(*) FILTER (book_side = 'ask') AS ask_levels, {_share('qty / level', 5)} AS pressure FROM levels GROUP BY symbol)"""
QUOTES = f"""{TICKS}, quotes AS (SELECT event_id, symbol, ts, price - 0.0005 * price * (1 + side) AS bid, price + 0.0005 * price * (1 + side) AS ask,
  CAST(qty + 1 AS DOUBLE) AS bid_size, CAST(100 - qty + 1 AS DOUBLE) AS ask_size FROM ticks)"""
LOG = """trades AS (SELECT o_orderkey AS id, o_orderpriority AS symbol, o_orderdate AS ts, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS pnl,
  o_totalprice AS notional, o_custkey AS version FROM orders)"""
FILLS = """fills AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, l_extendedprice / nullif(l_quantity, 0) AS price,
  l_quantity AS qty, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side FROM lineitem)"""
ORDERS = """o AS (SELECT o_custkey AS symbol, o_orderdate AS ts, o_orderkey AS id, CAST(o_orderkey % 50 AS DOUBLE) AS qty, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS side,
  o_totalprice / 100 AS price FROM orders)"""
PRED = f"{RETS}, pr AS (SELECT symbol, open_time, lead(ret) OVER ({W}) AS y, round(-ret / 10, 8) AS p FROM rets), known AS (SELECT * FROM pr WHERE y IS NOT NULL AND p IS NOT NULL)"
FEATURES = f"""{TICKS}, im AS (SELECT *, (2 * qty - 99) / 99.0 AS imbalance, CASE WHEN price / nullif(lag(price) OVER ({V}), 0) > 0 THEN ln(price / nullif(lag(price) OVER ({V}), 0)) END AS lr, CAST(row_number() OVER ({V}) AS DOUBLE) AS i FROM ticks),
fe AS (SELECT event_id, symbol, ts, price, imbalance, ({tick_full('stddev_pop', 'lr', 19)}) * {math.sqrt(252 * 24 * 60)!r} AS volatility, price / nullif(lag(price, 9) OVER ({V}), 0) - 1 AS momentum,
  CASE WHEN count(imbalance) OVER t = 10 THEN regr_slope(imbalance, i) OVER t END AS imbalance_slope,
  CASE WHEN count(imbalance) OVER h >= 20 THEN (imbalance - avg(imbalance) OVER h) / greatest(stddev_pop(imbalance) OVER h, 0.001) ELSE imbalance END AS imbalance_z, qty
  FROM im WINDOW t AS ({V} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), h AS ({V} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""
VOLZ = f"""{FEATURES}, vz AS (SELECT *, CASE WHEN count(volatility) OVER g >= 20 THEN (volatility - avg(volatility) OVER g) / greatest(stddev_pop(volatility) OVER g, 0.001) END AS volatility_z
  FROM fe WINDOW g AS ({V} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""
VBARS = f"""{TICKS}, cum AS (SELECT *, sum(CAST(qty AS DOUBLE)) OVER ({V}) AS e FROM ticks WHERE qty > 0), st AS (SELECT *, e - qty AS s FROM cum),
ex AS (SELECT *, unnest(range(CAST(floor(s / 1000) AS BIGINT), CAST(ceil(e / 1000) AS BIGINT))) AS bar FROM st), pt AS (SELECT *, least(e, (bar + 1) * 1000) - greatest(s, bar * 1000) AS part FROM ex),
vb AS (SELECT symbol, bar, min(ts) AS first, max(ts) AS last, sum(part) AS volume, sum(CASE WHEN side = 1 THEN part ELSE 0 END) AS buy, sum(part * price) / sum(part) AS vwap, count(*) AS trades FROM pt GROUP BY ALL)"""
VPIN = f"""{VBARS}, ok AS (SELECT *, abs(2 * buy - volume) / volume AS imbalance FROM vb WHERE volume >= 1000 - 1e-9),
      v AS (SELECT *, CASE WHEN count(*) OVER f = 50 THEN avg(imbalance) OVER f END AS vpin FROM ok WINDOW f AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
      h AS (SELECT *, list_filter(list(vpin) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS hist FROM v)"""
BT = f"""{BARS}, sg AS (SELECT *, CAST(coalesce(sign(({full('avg', 'close', 5)}) - ({full('avg', 'close', 20)})), 0) AS DOUBLE) AS position, coalesce(close / nullif({back('close')}, 0) - 1, 0) AS ret FROM bars),
bt AS (SELECT *, coalesce(lag(position) OVER ({W}), 0) * ret - abs(position - coalesce(lag(position) OVER ({W}), 0)) * 0.0015 AS strategy FROM sg)"""


def _r(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in columns.items())


def _up(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} END"


def _down(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN {x} END"


_YEAR = repr(math.sqrt(252.0))
_RANK = lambda x: f"rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0"
_STEP = """WITH RECURSIVE {fills}, nf AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, order_id, line, part, price, qty) AS i FROM fills WHERE qty > 0),
st AS (SELECT symbol, i, CAST(side * qty AS DOUBLE) AS q, CAST(price AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS r FROM nf WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, s.q + n.side * n.qty,
    CASE WHEN s.q = 0 OR sign(s.q) = n.side {avg} THEN (abs(s.q) * s.e + n.qty * n.price) / (abs(s.q) + n.qty) WHEN s.q + n.side * n.qty <> 0 AND sign(s.q + n.side * n.qty) = n.side THEN n.price ELSE s.e END,
    s.r + CASE WHEN s.q = 0 OR sign(s.q) = n.side {avg} THEN 0 ELSE least(abs(s.q), n.qty) * sign(s.q) * (n.price - s.e) END
  FROM st s JOIN nf n ON n.symbol = s.symbol AND n.i = s.i + 1)
SELECT symbol, max(i) AS fills, round(arg_max(q, i), 2) AS qty, round(arg_max(e, i), 3) AS entry, round(arg_max(r, i), -2) AS realised FROM st GROUP BY symbol"""

ORACLE_SQL = {
    "book_state": f"""WITH {STATE} SELECT symbol, bid_levels, ask_levels, {_r({c: c for c in ('best_bid', 'best_ask', 'bid_size', 'ask_size', 'imbalance', 'weighted_imbalance', 'bid_depth', 'ask_depth', 'pressure')}
        | {'mid': '(best_bid + best_ask) / 2', 'spread_bps': '1e4 * ((best_ask - best_bid) / nullif((best_bid + best_ask) / 2, 0))', 'microprice': '(best_bid * ask_size + best_ask * bid_size) / nullif(bid_size + ask_size, 0)'})} FROM st""",
    "book_levels": f"WITH {BOOK} SELECT symbol, book_side, price, qty, CAST(level AS INTEGER) AS level FROM levels",
    "book_vwap": f"""WITH {STATE}, b AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY symbol, book_side ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM levels),
      t AS (SELECT symbol, book_side, sum(greatest(least(qty, 100 - bef), 0)) AS taken, sum(greatest(least(qty, 100 - bef), 0) * price) AS cost FROM b GROUP BY ALL),
      v AS (SELECT t.symbol, book_side, CASE WHEN taken >= 100 THEN cost / taken END AS vwap, (best_bid + best_ask) / 2 AS mid FROM t JOIN st ON t.symbol = st.symbol)
      SELECT symbol, book_side, {_r({'vwap': 'vwap', 'slippage_bps': "1e4 * (CASE WHEN book_side = 'ask' THEN 1 ELSE -1 END) * ((vwap - mid) / nullif(mid, 0))"})} FROM v""",
    "quote_flow": f"""WITH {QUOTES}, p AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_size) OVER w AS ps, lag(ask_size) OVER w AS pz FROM quotes WINDOW w AS ({V})),
      f AS (SELECT *, coalesce((CASE WHEN bid > pb THEN bid_size WHEN bid < pb THEN -ps ELSE bid_size - ps END) + (CASE WHEN ask < pa THEN -ask_size WHEN ask > pa THEN pz ELSE -(ask_size - pz) END), 0) AS ofi FROM p)
      SELECT event_id, symbol, ts, round(ofi, 6) AS ofi, CASE WHEN count(ofi) OVER h >= 20 THEN round((ofi - avg(ofi) OVER h) / nullif(stddev_pop(ofi) OVER h, 0), 6) END AS ofi_z
      FROM f WINDOW h AS ({V} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    "spread_impact": f"""WITH {QUOTES}, m AS (SELECT *, (bid + ask) / 2 AS mid FROM quotes), i AS (SELECT *, (ask - bid) / nullif(mid, 0) AS eff, abs(mid - lag(mid, 5) OVER ({V})) / nullif(lag(mid, 5) OVER ({V}), 0) AS imp FROM m)
      SELECT event_id, symbol, ts, {_r({'effective_bps': '1e4 * eff', 'impact_bps': '1e4 * imp', 'realised_bps': '1e4 * (CASE WHEN imp IS NOT NULL THEN greatest(eff - 2 * imp, 0) END)'}, 4)} FROM i""",
    "kyle_lambda": f"""WITH {TICKS}, p AS (SELECT *, CAST(CASE WHEN side = 1 THEN qty ELSE -qty END AS DOUBLE) AS v, price / nullif(lag(price) OVER ({V}), 0) - 1 AS r FROM ticks),
      w AS (SELECT event_id, symbol, ts, list({{'v': v, 'r': r}}) OVER f AS pairs, stddev_pop(v) OVER f AS sd FROM p WHERE r IS NOT NULL WINDOW f AS ({V} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
      k AS (SELECT *, list_filter(pairs, lambda x: abs(x.v) < 3 * sd) AS kept FROM w),
      l AS (SELECT *, len(kept) AS n, list_transform(kept, lambda x: x.v) AS vs, list_transform(kept, lambda x: x.r) AS rs, list_transform(kept, lambda x: x.v * x.r) AS vr, list_transform(kept, lambda x: x.v * x.v) AS vv FROM k)
      SELECT event_id, symbol, ts, CASE WHEN len(pairs) >= 20 AND n >= 10 THEN round(((list_sum(vr) - list_sum(vs) * list_sum(rs) / n) / (n - 1)) / nullif(list_sum(vv) / n - (list_sum(vs) / n) * (list_sum(vs) / n), 0), 5) END AS kyle_lambda FROM l""",
    "tick_features": f"WITH {VOLZ} SELECT event_id, symbol, ts, {_r({c: c for c in ('price', 'imbalance', 'volatility', 'momentum', 'imbalance_slope', 'imbalance_z', 'volatility_z')})} FROM vz",
    "imbalance_signals": f"""WITH {VOLZ}, s1 AS (SELECT *, CASE WHEN imbalance > 0 THEN 1 ELSE -1 END AS sg, (qty - 40) / 60.0 AS wi, CAST(event_id % 3 - 1 AS DOUBLE) AS pos FROM vz),
      s2 AS (SELECT *, CASE WHEN sg = lag(sg) OVER ({V}) THEN 0 ELSE 1 END AS ch FROM s1),
      s3 AS (SELECT *, sum(ch) OVER ({V}) AS isl FROM s2), s4 AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY ts, event_id) AS streak FROM s3),
      s5 AS (SELECT *, greatest(least(0.4 * least(abs(imbalance), 1) + 0.2 * least(abs(wi), 1) + 0.2 * least(streak / 10.0, 1) + CASE WHEN volatility_z < -1 THEN 0.1 WHEN volatility_z > 1 THEN -0.1 ELSE 0 END
        + CASE WHEN sg * round(imbalance_slope, 9) > 0 THEN 0.1 ELSE 0 END, 1), 0) AS conf,
        round(1000.0 * CASE WHEN volatility_z < -1 THEN 1.5 WHEN volatility_z > 1 THEN 0.5 ELSE 1 END / nullif(price, 0) * CASE WHEN pos = sg THEN 0.5 ELSE 1 END, 6) AS size FROM s4),
      s6 AS (SELECT *, abs(imbalance) >= 0.3 AND streak >= 3 AND conf >= 0.5 AND NOT coalesce(sg * round(imbalance_slope, 9) < 0, false) AND price > 0 AND size > 0 AS ok FROM s5)
      SELECT event_id, symbol, ts, round(imbalance, 6) AS imbalance, CAST(streak AS INTEGER) AS streak, round(conf, 6) AS confidence, CASE WHEN ok THEN CASE WHEN sg > 0 THEN 'buy' ELSE 'sell' END END AS signal,
        CASE WHEN ok THEN size END AS size, CASE WHEN ok THEN concat_ws('; ', format('Order book {{}} imbalance: {{:.3f}}', CASE WHEN sg > 0 THEN 'bid' ELSE 'ask' END, imbalance), CASE WHEN streak >= 3 THEN format('Persistent for {{}} ticks', streak) END,
        CASE WHEN volatility_z < -1 THEN 'Low volatility environment' WHEN volatility_z > 1 THEN 'High volatility (reduced size)' END) END AS reason FROM s6""",
    "volume_bars": f"WITH {VBARS} SELECT symbol, bar, first, last, round(volume, 6) AS volume, round(buy, 6) AS buy, round(vwap, 6) AS vwap, trades FROM vb",
    "vpin": f"""WITH {VPIN}
      SELECT symbol, bar, last, round(imbalance, 6) AS imbalance, round(vpin, 6) AS vpin, CASE WHEN len(hist) >= 50 AND vpin IS NOT NULL THEN round(len(list_filter(hist, lambda x: x <= vpin)) / len(hist), 6) END AS vpin_cdf,
        CASE WHEN vpin IS NULL THEN 'UNKNOWN' WHEN vpin < 0.3 THEN 'LOW' WHEN vpin < 0.5 THEN 'MEDIUM' WHEN vpin < 0.7 THEN 'HIGH' ELSE 'EXTREME' END AS regime FROM h""",
    "decayed_flow": f"""WITH RECURSIVE {BARS}, n AS (SELECT *, 2 * taker_buy_base - volume AS x, row_number() OVER ({W}) AS i FROM bars),
      f AS (SELECT symbol, open_time, x, i, x AS d FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.open_time, n.x, n.i, 0.99 * f.d + n.x FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)
      SELECT symbol, open_time, round(x, 6) AS ofi, round(d, 6) AS decayed_ofi FROM f""",
    "hawkes_intensity": f"""WITH RECURSIVE {TICKS}, e AS (SELECT symbol, date_trunc('hour', ts) AS open_time, count(*) AS n, epoch(date_trunc('hour', ts)) / 3600 AS t FROM ticks WHERE qty >= 90 GROUP BY ALL),
      k AS (SELECT *, row_number() OVER ({W}) AS i FROM e), f AS (SELECT symbol, open_time, n, t, i, CAST(0 AS DOUBLE) AS b FROM k WHERE i = 1
        UNION ALL SELECT k.symbol, k.open_time, k.n, k.t, k.i, (f.b + 0.5) * exp(-(k.t - f.t)) FROM f JOIN k ON k.symbol = f.symbol AND k.i = f.i + 1)
      SELECT symbol, open_time, n, round(0.1 + b, 6) AS intensity FROM f""",
    "trade_through_asof": f"""WITH {QUOTES}, j AS (SELECT t.event_id, t.symbol, t.ts, t.price, q.bid, q.ask, CAST(CASE WHEN t.side = 1 THEN t.price > q.ask ELSE t.price < q.bid END AS INTEGER) AS through
        FROM ticks t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts > q.ts)
      SELECT event_id, symbol, ts, round(price, 6) AS price, round(bid, 6) AS bid, round(ask, 6) AS ask, through, CASE WHEN count(through) OVER h >= 10 THEN round(avg(through) OVER h, 6) END AS through_rate
      FROM j WINDOW h AS ({V} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    "return_metrics": f"""WITH {RETS} SELECT symbol, count(ret) AS n, {_r({
        'total': 'sum(ret)', 'annual_return': 'avg(ret) * 252', 'annual_volatility': f'stddev_pop(ret) * {_YEAR}', 'sharpe': f'avg(ret) / nullif(stddev_pop(ret), 0) * {_YEAR}',
        'sortino': f'avg(ret) / nullif(stddev_pop({_down("ret")}), 0) * {_YEAR}', 'profit_factor': f'sum({_up("ret")}) / nullif(-sum({_down("ret")}), 0)', 'win_rate': f'count({_up("ret")}) / count(ret)',
        'average_win': f'avg({_up("ret")})', 'average_loss': f'avg({_down("ret")})'}, 5)} FROM rets WHERE ret IS NOT NULL GROUP BY symbol""",
    "drawdowns": f"""WITH {RETS}, c AS (SELECT *, sum(ret) OVER ({W}) AS s FROM rets WHERE ret IS NOT NULL), d AS (SELECT *, max(s) OVER ({W} ROWS UNBOUNDED PRECEDING) - s AS dd FROM c),
      b AS (SELECT *, CAST(dd > 1e-12 AS INTEGER) AS below FROM d), g AS (SELECT *, CASE WHEN below = lag(below) OVER ({W}) THEN 0 ELSE 1 END AS ch FROM b), i AS (SELECT *, sum(ch) OVER ({W}) AS isl FROM g),
      r AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY open_time) AS run FROM i)
      SELECT symbol, round(max(dd), 6) AS max_drawdown, round(coalesce(avg(CASE WHEN below = 1 THEN dd END), 0), 6) AS average_drawdown, CAST(max(CASE WHEN below = 1 THEN run ELSE 0 END) AS INTEGER) AS longest FROM r GROUP BY symbol""",
    "value_at_risk": f"""WITH {RETS}, k AS (SELECT symbol, ret FROM rets WHERE ret IS NOT NULL), q AS (SELECT symbol, quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.01) AS b FROM k GROUP BY symbol)
      SELECT k.symbol, round(-max(a), 6) AS var_95, round(-avg(CASE WHEN ret <= a THEN ret END), 6) AS cvar_95, round(-max(b), 6) AS var_99, round(-avg(CASE WHEN ret <= b THEN ret END), 6) AS cvar_99
      FROM k JOIN q ON k.symbol = q.symbol GROUP BY k.symbol""",
    "alpha_beta": f"""WITH {RETS}, m AS (SELECT *, avg(ret) OVER (PARTITION BY open_time) AS bm FROM rets), k AS (SELECT * FROM m WHERE ret IS NOT NULL AND bm IS NOT NULL),
      b AS (SELECT symbol, covar_samp(ret, bm) / nullif(var_samp(bm), 0) AS beta, avg(ret) AS r, avg(bm) AS m, avg(ret - bm) AS act, stddev_pop(ret - bm) AS te FROM k GROUP BY symbol)
      SELECT symbol, {_r({'beta': 'beta', 'alpha': '(r - beta * m) * 252', 'information_ratio': f'act / nullif(te, 0) * {_YEAR}'}, 5)} FROM b""",
    "prediction_metrics": f"""WITH {PRED}, r AS (SELECT *, {_RANK('p')} AS rk, avg(y) OVER (PARTITION BY symbol) AS my FROM known),
      c AS (SELECT symbol, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / nullif(sum((y - my) * (y - my)), 0) AS r2, avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) AS mape,
        avg(CAST((y > 0) = (p > 0) AS INTEGER)) AS accuracy, count(*) FILTER (y > 0 AND p > 0) AS tp, count(*) FILTER (y <= 0 AND p > 0) AS fp, count(*) FILTER (y > 0 AND p <= 0) AS fn,
        sum(CASE WHEN y > 0 THEN rk END) AS rs, count(*) FILTER (y > 0) AS np, count(*) FILTER (y <= 0) AS nn FROM r GROUP BY symbol)
      SELECT symbol, {_r({'mse': 'mse', 'mae': 'mae', 'r2': 'r2', 'mape': 'mape', 'accuracy': 'accuracy', 'precision': 'tp / nullif(tp + fp, 0)', 'recall': 'tp / nullif(tp + fn, 0)',
        'f1': '2 * tp / nullif(2 * tp + fp + fn, 0)', 'auc': '(rs - np * (np + 1) / 2) / nullif(np * nn, 0)'}, 5)} FROM c""",
    "information_coefficient": f"WITH {PRED}, r AS (SELECT symbol, {_RANK('y')} AS a, {_RANK('p')} AS b FROM known) SELECT symbol, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY symbol",
    "quantile_returns": f"""WITH {PRED}, e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM known)
      SELECT 1 + CAST(p > q[1] AS INTEGER) + CAST(p > q[2] AS INTEGER) + CAST(p > q[3] AS INTEGER) + CAST(p > q[4] AS INTEGER) AS part, count(*) AS n, round(avg(y), 6) AS mean_return FROM known, e GROUP BY ALL""",
    "trade_summary": f"""WITH {LOG} SELECT count(*) AS trades, count({_up('pnl')}) AS wins, count({_down('pnl')}) AS losses, count(DISTINCT CAST(ts AS DATE)) AS days, {_r({
        'total': 'sum(pnl)', 'win_rate': f"100 * count({_up('pnl')}) / count(*)", 'profit_factor': f"sum({_up('pnl')}) / nullif(-sum({_down('pnl')}), 0)", 'average_win': f"avg({_up('pnl')})",
        'average_loss': f"avg({_down('pnl')})", 'best': 'max(pnl)', 'worst': 'min(pnl)', 'trades_a_day': 'count(*) / count(DISTINCT CAST(ts AS DATE))'}, 2)} FROM trades""",
    "daily_sharpe": f"WITH {LOG}, d AS (SELECT CAST(ts AS DATE) AS day, sum(pnl) AS pnl FROM trades GROUP BY ALL) SELECT count(*) AS days, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * {_YEAR}, 0), 6) AS sharpe FROM d",
    "equity_drawdown": f"""WITH {LOG}, d AS (SELECT CAST(ts AS DATE) AS day, sum(pnl) AS pnl, count(*) AS trades FROM trades GROUP BY ALL), e AS (SELECT *, 1e9 + sum(pnl) OVER (ORDER BY day) AS equity FROM d),
      p AS (SELECT *, max(equity) OVER (ORDER BY day) AS peak FROM e) SELECT day, trades, {_r({'pnl': 'pnl', 'equity': 'equity', 'drawdown': 'equity - peak', 'drawdown_share': '(equity - peak) / peak'}, 2)} FROM p""",
    "pnl_heatmap": f"""WITH {LOG}, s AS (SELECT month(ts) AS m, isodow(ts) - 1 AS d, sum(pnl) AS pnl FROM trades GROUP BY ALL)
      SELECT CAST(a.month AS INTEGER) AS month, CAST(b.weekday AS INTEGER) AS weekday, round(coalesce(pnl, 0), 2) AS pnl FROM range(1, 13) a(month) CROSS JOIN range(0, 7) b(weekday) LEFT JOIN s ON s.m = a.month AND s.d = b.weekday""",
    "hourly_heatmap": f"""WITH {BT}, s AS (SELECT hour(open_time) AS h, isodow(open_time) - 1 AS d, sum(strategy) AS pnl, count(strategy) AS trades FROM bt GROUP BY ALL)
      SELECT CAST(a.hour AS INTEGER) AS hour, CAST(b.weekday AS INTEGER) AS weekday, round(coalesce(pnl, 0), 5) AS pnl, coalesce(trades, 0) AS trades
      FROM range(0, 24) a(hour) CROSS JOIN range(0, 7) b(weekday) LEFT JOIN s ON s.h = a.hour AND s.d = b.weekday""",
    "pnl_pivot": f"WITH {LOG} SELECT CAST(month(ts) AS INTEGER) AS month, {', '.join(f'round(coalesce(sum(pnl) FILTER (isodow(ts) = {i + 1}), 0), 2) AS day_{i}' for i in range(7))} FROM trades GROUP BY ALL",
    "pnl_histogram": f"""WITH {LOG}, e AS (SELECT min(pnl) AS lo, max(pnl) AS hi FROM trades)
      SELECT coalesce(CAST(least(floor((pnl - lo) * 50 / nullif(hi - lo, 0)), 49) AS INTEGER), 0) AS bin, count(*) AS n, round(sum(pnl), 2) AS pnl FROM trades, e GROUP BY ALL""",
    "version_performance": f"WITH {LOG} SELECT version, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 2) AS total, min(ts) AS first, max(ts) AS last FROM trades GROUP BY version",
    "parity_compare": """WITH j AS (SELECT o_totalprice AS x, round(o_totalprice, -1) AS y FROM orders)
      SELECT count(*) AS rows, count(*) FILTER (x <> y AND abs(x - y) > 1e-5 AND abs(x - y) > 1e-4 * abs(x)) AS failed, round(max(CASE WHEN x <> y THEN abs(x - y) END), 4) AS largest FROM j""",
    "replay_summary": f"WITH {TICKS} SELECT symbol, count(*) AS n, min(ts) AS first, max(ts) AS last, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM ticks GROUP BY symbol",
    "backtest": f"WITH {BT} SELECT symbol, open_time, {_r({'close': 'close', 'position': 'position', 'ret': 'ret', 'strategy': 'strategy', 'equity': f'CASE WHEN min(1 + strategy) OVER ({W}) > 0 THEN 10000 * exp(sum(ln(greatest(1 + strategy, 1e-300))) OVER ({W})) ELSE 0 END'}, 5)} FROM bt",
    "round_trips": f"""WITH {BT}, p AS (SELECT *, lag(position) OVER ({W}) AS bef FROM bt), c AS (SELECT * FROM p WHERE bef IS NOT NULL AND position <> bef),
      t AS (SELECT *, lead(open_time) OVER ({W}) AS xt, lead(close) OVER ({W}) AS x FROM c)
      SELECT symbol, open_time AS entry_time, xt AS exit_time, {_r({'position': 'position', 'entry': 'close', 'exit': 'x', 'trade_return': 'position * (x / nullif(close, 0) - 1)'}, 5)} FROM t WHERE position <> 0 AND x IS NOT NULL""",
    "walk_forward": f"""WITH {BT}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bt),
      f AS (SELECT n.*, g.fold, i - g.fold * 50 AS a FROM n JOIN range(0, 100000) g(fold) ON g.fold * 50 <= i AND i < g.fold * 50 + 150 AND g.fold * 50 + 150 <= n)
      SELECT symbol, CAST(fold AS INTEGER) AS fold, round(sum(CASE WHEN a < 100 THEN strategy END), 5) AS train_return, round(sum(CASE WHEN a >= 100 THEN strategy END), 5) AS test_return, min(open_time) AS start, max(open_time) AS stop FROM f GROUP BY ALL""",
    "position_fold": _STEP.format(fills=FILLS, avg=""),
    "position_fold_averaged": _STEP.format(fills=FILLS, avg="OR (s.q + n.side * n.qty <> 0 AND sign(s.q + n.side * n.qty) = sign(s.q))"),
    "risk_checks": f"""WITH {ORDERS}, p AS (SELECT *, coalesce(sum(side * qty) OVER ({TR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM o),
      v AS (SELECT *, CASE WHEN qty <= 0 THEN 'rejected: quantity' WHEN qty * price > 80000 THEN 'rejected: notional' WHEN abs(pos + side * qty) > 60 AND 60 - abs(pos) <= 0 THEN 'rejected: position' WHEN abs(pos + side * qty) > 60 THEN 'adjust' ELSE 'approved' END AS verdict FROM p)
      SELECT symbol, ts, id, round(pos, 6) AS position, verdict, CASE WHEN verdict = 'adjust' THEN round(least(60 - abs(pos), qty), 6) END AS allowed FROM v""",
    "price_jumps": f"WITH {ORDERS}, m AS (SELECT *, abs(price / nullif(lag(price) OVER ({TR}), 0) - 1) AS mv FROM o) SELECT symbol, ts, id, round(price, 6) AS price, round(mv, 6) AS move, CAST(coalesce(mv > 0.5, false) AS INTEGER) AS jump FROM m",
    "rate_limit_rolling": f"""WITH {TICKS}, r AS (SELECT event_id, symbol, ts, count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM ticks)
      SELECT *, CAST(recent > 5 AS INTEGER) AS limited FROM r""",
    "rate_limit_session": f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({V}) <= 3600000000 THEN 0 ELSE 1 END AS nw FROM ticks), s AS (SELECT *, CAST(sum(nw) OVER ({V}) AS BIGINT) AS session FROM g)
      SELECT event_id, symbol, ts, session, CAST(row_number() OVER (PARTITION BY symbol, session ORDER BY ts, event_id) AS INTEGER) AS number FROM s""",
    "loss_breaker": f"""WITH {LOG}, k AS (SELECT symbol || ':' || version AS symbol, ts, id, pnl FROM trades), i AS (SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER ({TR}) AS isl FROM k),
      l AS (SELECT *, CAST(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER v AS BIGINT) AS losses, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) OVER v AS lost FROM i WINDOW v AS (PARTITION BY symbol, isl ORDER BY ts, id))
      SELECT symbol, ts, id, losses, round(lost, 2) AS lost, CAST(losses >= 4 OR lost >= 500000 AS INTEGER) AS tripped FROM l""",
    "latest_position": f"WITH {FILLS} SELECT part, ts, order_id, line, symbol, price, qty, side FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ts DESC, order_id DESC, line DESC, symbol DESC, price DESC, qty DESC, side DESC) AS k FROM fills) WHERE k = 1",
    "top_trades": f"WITH {LOG} SELECT id, symbol, ts, notional FROM trades ORDER BY ts DESC, id DESC LIMIT 100",
    "dedup_first": f"WITH {FILLS} SELECT order_id, line, ts, symbol, part, price, qty, side FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line ORDER BY ts, symbol, part, price, qty, side) AS k FROM fills) WHERE k = 1",
    "index_sets": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
      SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'first' WHEN a.o_custkey IS NULL THEN 'second' ELSE 'both' END AS kind FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
    "open_interest_change": f"WITH {BARS} SELECT symbol, open_time, {_r({f'change_{k}': f'volume / nullif(lag(volume, {k}) OVER ({W}), 0) - 1' for k in (24, 60)})} FROM bars",
    "feature_leakage": f"""WITH {RETS}, t AS (SELECT *, lead(ret) OVER ({W}) AS y FROM rets), u AS (SELECT *, lag(y, 10) OVER ({W}) AS early, lead(y, 10) OVER ({W}) AS late FROM t)
      """ + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, y), 6) AS corr_y, round(corr({c}, early), 6) AS corr_early, round(corr({c}, late), 6) AS corr_late FROM u" for c in ("ret", "volume", "close")),
    "ks_shift": f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
      p AS (SELECT symbol, volume, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 1 ELSE 0 END AS a, CASE WHEN i >= floor(n * CAST(0.85 AS DOUBLE)) THEN 1 ELSE 0 END AS b FROM n), q AS (SELECT * FROM p WHERE a + b > 0),
      c AS (SELECT symbol, sum(a) OVER (PARTITION BY symbol ORDER BY volume) / sum(a) OVER (PARTITION BY symbol) AS fa, sum(b) OVER (PARTITION BY symbol ORDER BY volume) / sum(b) OVER (PARTITION BY symbol) AS fb FROM q)
      SELECT symbol, round(max(abs(fa - fb)), 6) AS ks FROM c GROUP BY symbol""",
    "purged_folds": f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
      g AS (SELECT *, CAST(least(floor(i / floor(n / 5)), 4) AS INTEGER) AS grp, greatest(1, CAST(floor(n * 0.01) AS INTEGER)) AS emb, greatest(5, CAST(floor(n * 0.01) AS INTEGER)) AS pur, CAST(floor(n / 5) AS INTEGER) AS k FROM n),
      f AS (SELECT g.*, a.x AS ga, b.x AS gb, a.x * 10 + b.x AS fold FROM g CROSS JOIN range(0, 5) a(x) CROSS JOIN range(0, 5) b(x) WHERE a.x < b.x),
      p AS (SELECT *, CASE WHEN grp = ga OR grp = gb THEN 'test' WHEN i >= ga * k - pur AND i < ga * k THEN 'purged' WHEN gb < 4 AND i >= (gb + 1) * k AND i < (gb + 1) * k + emb THEN 'embargoed' ELSE 'train' END AS part FROM f)
      SELECT symbol, CAST(fold AS INTEGER) AS fold, part, count(*) AS n, round(avg(close), 5) AS close FROM p GROUP BY ALL""",
}
