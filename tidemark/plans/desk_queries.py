"""Queries on risk, trades, messages, scores, splits and toxicity, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import fisher, inverse_fisher, ratio
from tidemark.functions.windows import as_of, by_stretches
from tidemark.operators import bars as B
from tidemark.operators import desk as D
from tidemark.operators import evaluation as E
from tidemark.operators import flow as L
from tidemark.operators import metrics as M
from tidemark.operators import portfolio as P
from tidemark.operators.validation import purged_folds
from tidemark.plans.bar_queries import BARS, RETS, TICKS, W
from tidemark.plans.flow_queries import BT, FILLS, LOG, STATE, VPIN, V, _r, tidy
from tidemark.sources import adapters as A

C = F.col
#: Bounds of the checks of realistic metrics.
BOUNDS = {"win_rate": (0.3, 0.7), "profit_factor": (0.5, 2.0), "sharpe": (-3.0, 3.0)}


def _accounts(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(
        C("o_custkey").alias("account"), C("o_orderpriority").alias("symbol"), C("o_orderdate").alias("ts"), C("o_orderkey").alias("id"), (C("o_orderkey") % 50).cast("double").alias("qty"),
        F.when(C("o_orderkey") % 3 == 0, -1).otherwise(1).alias("side"), (C("o_totalprice") / 100).alias("price"), (C("o_orderkey") % 97 == 0).alias("breaker"),
    )


def _chain(spark, sf_dir):
    return D.risk_chain(_accounts(spark, sf_dir), gap_seconds=2_592_000, initial=1_000_000.0, min_balance=850_000.0)


def risk_chain(spark, sf_dir):
    """The whole chain of risk rules over each account's orders."""
    return tidy(_chain(spark, sf_dir), 4)


def violation_switch(spark, sf_dir):
    """Rejected orders of an account so far, and whether trading stops."""
    return D.violation_switch(_chain(spark, sf_dir), most=5)


def sized_orders(spark, sf_dir):
    """Size, stop, target and exposure rule of a signal at each bar."""
    b = B.with_returns(A.bars(spark, sf_dir))
    s = b.select("symbol", "open_time", C("close").alias("price"), F.greatest(F.least(100 * F.coalesce("ret", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)).alias("strength"), (C("trades") * 500.0).alias("exposure"))
    return tidy(D.sized_orders(s), 5)


def execution_costs(spark, sf_dir):
    """Notional, fee and slipped price of fills."""
    f = A.fills(spark, sf_dir).select("order_id", "line", "symbol", "part", "price", "qty", "side")
    return tidy(D.execution_costs(f).drop("price"), 8)


def _closed(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts", "order_id", "line", "part", "price", "qty")
    f = A.fills(spark, sf_dir)
    return f.select("symbol", "order_id", "line", "part", "qty", "side", C("price").alias("entry"), F.lead("price").over(w).alias("exit"), C("ts").alias("opened"), F.lead("ts").over(w).alias("closed")).where("exit is not null")


def trade_pnl(spark, sf_dir):
    """Profit, fees and holding time of each fill closed by the next of its symbol."""
    t = D.trade_pnl(_closed(spark, sf_dir))
    return tidy(t.select("symbol", "order_id", "line", "part", "qty", "gross", "fees", "net", "held_seconds"), 8)


def pnl_summary(spark, sf_dir):
    """Metrics of those trades by symbol."""
    return tidy(D.pnl_summary(D.trade_pnl(_closed(spark, sf_dir))))


def _held(spark, sf_dir):
    f = A.fills(spark, sf_dir)
    at = F.struct("ts", "order_id", "line", "part", "price", "qty")
    g = f.groupBy((C("symbol") % 7).alias("account"), "symbol").agg(
        F.sum(C("side") * C("qty")).alias("qty"), ratio(F.sum(C("price") * C("qty")), F.sum("qty")).alias("entry"), F.lit(0.0).alias("realised"), F.max_by("price", at).alias("price")
    )
    return g


def account_value(spark, sf_dir):
    """Exposure, unrealised profit and equity of accounts."""
    h = _held(spark, sf_dir)
    return tidy(D.account_value(h.drop("price"), h.select("symbol", "price")), 2)


def account_snapshot(spark, sf_dir):
    """Each account's positions as one JSON text, in order of symbols."""
    h = _held(spark, sf_dir).select("account", F.struct("symbol", C("qty").cast("bigint").alias("qty")).alias("p"))
    return h.groupBy("account").agg(F.count("*").alias("positions"), F.to_json(F.array_sort(F.collect_list("p"))).alias("json"))


def _forced(spark, sf_dir):
    return A.ticks(spark, sf_dir).withColumn("forced", C("qty") >= 80)


def recent_liquidations(spark, sf_dir):
    """Forced orders in each symbol's last two days."""
    return tidy(D.recent_liquidations(_forced(spark, sf_dir), 172_800), 3)


def market_regime(spark, sf_dir):
    """The regime of each symbol from funding, open interest and liquidations."""
    t = A.ticks(spark, sf_dir)
    g = t.groupBy(C("symbol").alias("s")).agg(
        ((F.avg(C("side")) - 0.5) / 10).alias("funding_rate"), ratio(F.sum(F.when(C("side") == 1, C("qty"))) - F.sum(F.when(C("side") == 0, C("qty"))), F.sum("qty")).alias("oi_change")
    )
    l_ = D.recent_liquidations(_forced(spark, sf_dir), 172_800)
    return D.market_regime(g.join(l_, C("s") == C("symbol"), "left").withColumn("symbol", C("s")), high=5e4, medium=1e4)


def warm_up(spark, sf_dir):
    """How far each tick's symbol is warmed up."""
    return tidy(D.warm_up(A.ticks(spark, sf_dir), seconds=86_400))


def mid_atr(spark, sf_dir):
    """Mean absolute change of the last fourteen ticks."""
    return tidy(by_stretches(A.ticks(spark, sf_dir), D.mid_atr, 15))


def book_health(spark, sf_dir):
    """Whether each book is usable, and its ratio of depths."""
    return tidy(D.book_health(L.book_state(A.book_updates(spark, sf_dir))))


def parsed_messages(spark, sf_dir):
    """Events as exchange messages, routed and decoded."""
    t = A.ticks(spark, sf_dir)
    level = lambda d: F.array(F.array((F.round("price") + d).cast("decimal(10,2)").cast("string"), C("qty").cast("string")))
    trade = F.struct(F.lit("trade").alias("e"), C("event_id").alias("E"), C("symbol").alias("s"), F.format_string("%.2f", "price").alias("p"), F.when(C("event_id") % 50 != 0, C("qty").cast("string")).otherwise("x").alias("q"), (C("side") == 0).alias("m"))
    depth = F.struct(F.lit("depthUpdate").alias("e"), C("event_id").alias("E"), C("symbol").alias("s"), level(-1).alias("b"), level(1).alias("a"))
    wrapped = F.to_json(F.struct(F.concat("symbol", F.lit("@trade")).alias("stream"), trade.alias("data")))
    kind = C("event_id") % 4
    raw = t.select("event_id", F.when(kind == 0, F.to_json(trade)).when(kind == 1, F.to_json(depth)).when(kind == 2, wrapped).otherwise('{"e":"ping"}').alias("message"))
    p = D.parsed_messages(raw)
    return p.select("event_id", "kind", "symbol", "event_time", C("price").cast("double").alias("price"), C("qty").cast("double").alias("qty"), F.size("bids").alias("bids"), C("asks")[0]["price"].cast("double").alias("best_ask"), "bad")


def selected_trades(spark, sf_dir):
    """The newest fifty trades of a symbol in a range of days."""
    return D.select_trades(A.trades_log(spark, sf_dir).select("id", "symbol", "ts", "pnl"), "1-URGENT", "1993-01-01", "1997-12-31", 50)


def trades_by_day(spark, sf_dir):
    """Trades of each day by symbol, all symbols in order."""
    return A.trades_log(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy("symbol", "day")


def last_trades(spark, sf_dir):
    """Winners, losers and profit of the newest thousand trades."""
    t = A.trades_log(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(1000)
    g = t.agg(F.count("*").alias("n"), F.count_if(C("pnl") > 0).alias("winners"), F.sum("pnl").alias("total"), F.avg("pnl").alias("average"))
    return tidy(g.withColumn("losers", C("n") - C("winners")), 3)


def _model_folds(spark, sf_dir):
    """Metrics of each symbol's strategy by two-day folds."""
    b = P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))
    b = b.withColumn("fold", (F.dayofmonth("open_time") / 2).cast("int")).withColumn("model", F.concat_ws("#", "symbol", "fold"))
    r = M.return_metrics(b, "strategy", "model").select("model", "total", "sharpe", "sortino", "win_rate", "profit_factor")
    right = b.groupBy(C("model").alias("_m")).agg(F.avg((C("strategy") > 0).cast("double")).alias("direction_accuracy"))
    dd = M.drawdowns(b, "strategy", "model").select(C("model").alias("_d"), "max_drawdown")
    return r.join(right, C("model") == C("_m")).join(dd, C("model") == C("_d")).select("total", *E.WEIGHTS, F.split("model", "#")[0].alias("model"), F.split("model", "#")[1].cast("int").alias("fold"))


def composite_score(spark, sf_dir):
    """The composite score of each model and fold."""
    return tidy(E.composite_score(_model_folds(spark, sf_dir)).select("model", "fold", "score"), 4)


def best_models(spark, sf_dir):
    """The three models of best recent score."""
    s = E.composite_score(_model_folds(spark, sf_dir)).na.fill(0.0, ["score"])
    return tidy(E.best_models(s, least=0.5), 4)


def fold_average(spark, sf_dir):
    """Metrics of each model, averaged over folds."""
    return tidy(E.fold_average(_model_folds(spark, sf_dir), ["total", "win_rate", "max_drawdown"]), 5)


def robustness(spark, sf_dir):
    """How steady returns and Sharpe ratios are over folds."""
    return tidy(E.robustness(_model_folds(spark, sf_dir)), 3)


def reward_hacking(spark, sf_dir):
    """Signs of training returns that validation does not repeat."""
    s = B.split(P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))).where("part in ('train', 'validate')")
    return tidy(E.reward_hacking(s.select(C("symbol").alias("model"), "part", C("open_time").alias("step"), C("strategy").alias("ret"))), 3)


def against_buy_and_hold(spark, sf_dir):
    """The strategy's compound return against holding."""
    return tidy(E.against_buy_and_hold(P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))), 3)


def go_no_go(spark, sf_dir):
    """The decision for each model and fold, and which metrics are out of bounds."""
    f = E.go_no_go(_model_folds(spark, sf_dir))
    return E.bounded_metrics(f, BOUNDS).select("model", "fold", "criteria", "decision", "below", "above", "passed")


def return_profile(spark, sf_dir):
    """Checks of the returns' distribution by symbol."""
    return tidy(E.return_profile(B.with_returns(A.bars(spark, sf_dir))), 4)


def split_order(spark, sf_dir):
    """Whether the parts of each symbol's split follow one another."""
    return E.split_order(B.split(A.bars(spark, sf_dir), embargo=2), gap_seconds=7200)


def expanding_ranges(spark, sf_dir):
    """Walk-forward ranges of each symbol's bars."""
    return E.expanding_ranges(A.bars(spark, sf_dir))


def fold_sharpe(spark, sf_dir):
    """Sharpe ratios of the strategy on the test rows of each combinatorial fold, and their mean and deviation."""
    f = purged_folds(P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))).where("part = 'test'")
    s = f.groupBy("symbol", "fold").agg((ratio(F.avg("strategy"), F.stddev_samp("strategy")) * math.sqrt(252.0)).alias("sharpe"))
    w = Window.partitionBy("symbol")
    return tidy(s.select("symbol", C("fold").cast("int").alias("fold"), "sharpe", F.avg("sharpe").over(w).alias("mean"), F.stddev_pop("sharpe").over(w).alias("std")), 4)


def cleaned_features(spark, sf_dir):
    """Number columns of a feature table without its targets, cleaned."""
    r = B.with_returns(A.bars(spark, sf_dir)).withColumn("inverse", F.try_divide(F.lit(1.0), C("ret"))).withColumn("target_x", F.lit(1.0))
    names = E.numeric_features(r, without=("target", "volume", "taker"))
    return tidy(E.cleaned(r.select("symbol", "open_time", *names), ["ret", "log_ret", "inverse"], needed=["ret"]).select("symbol", "open_time", "trades", "ret", "inverse"), 4)


def table_hash(spark, sf_dir):
    """A hash of all orders that does not depend on their order."""
    return E.table_hash(A.table(spark, sf_dir, "orders"))


def bar_proxies(spark, sf_dir):
    """Quotes, sides and book levels made up from bars."""
    return tidy(E.bar_proxies(A.bars(spark, sf_dir)))


def hawkes_estimate(spark, sf_dir):
    """Parameters of a self-exciting process by symbol."""
    return tidy(E.hawkes_estimate(A.ticks(spark, sf_dir)), 7)


def toxicity(spark, sf_dir):
    """Toxicity of the flow at each tick, from its price impact, its imbalance, and the last volume bar's VPIN and rank."""
    own = ["price", "qty", "side"]
    t = by_stretches(A.quotes(A.ticks(spark, sf_dir), own), lambda q: L.spread_impact(q, keep=own), 5)
    t = t.select("event_id", "symbol", "ts", *own, (C("impact_bps") / 1e4).alias("impact"))
    v = L.vpin(t).select("symbol", C("last").alias("ts"), "vpin", "vpin_cdf")
    known = as_of(t, v, ["vpin", "vpin_cdf"]).withColumnsRenamed({"right_vpin": "vpin", "right_vpin_cdf": "vpin_cdf"})
    return tidy(by_stretches(known, E.toxicity, 1105), 5)


def fisher_pair(spark, sf_dir):
    """The Fisher transform of a bar's place in its range, and back."""
    b = A.bars(spark, sf_dir).withColumn("x", 2 * ratio(C("close") - C("low"), C("high") - C("low")) - 1)
    return tidy(b.select("symbol", "open_time", fisher(C("x")).alias("fisher"), inverse_fisher(C("x")).alias("inverse")), 5)


QUERIES = {f.__name__: f for f in (
    risk_chain, violation_switch, sized_orders, execution_costs, trade_pnl, pnl_summary, account_value, account_snapshot, recent_liquidations, market_regime, warm_up, mid_atr, book_health,
    parsed_messages, selected_trades, trades_by_day, last_trades, composite_score, best_models, fold_average, robustness, reward_hacking, against_buy_and_hold, go_no_go, return_profile,
    split_order, expanding_ranges, fold_sharpe, cleaned_features, table_hash, bar_proxies, hawkes_estimate, toxicity, fisher_pair,
)}

AC, OWN = "PARTITION BY account ORDER BY ts, id", "PARTITION BY account, symbol ORDER BY ts, id"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
CHAIN = f"""o AS (SELECT o_custkey AS account, o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS id, CAST(o_orderkey % 50 AS DOUBLE) AS qty, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS side,
  o_totalprice / 100 AS price, o_orderkey % 97 = 0 AS breaker FROM orders),
c1 AS (SELECT *, coalesce(sum(side * qty) OVER ({OWN} {BEFORE}), 0) AS position, lag(price) OVER ({OWN}) AS pp FROM o),
c2 AS (SELECT *, 1000000 - coalesce(sum(side * qty * price) OVER ({AC} {BEFORE}), 0) AS balance, coalesce(sum(abs(position + side * qty) - abs(position)) OVER ({AC} {BEFORE}), 0) AS exposure,
  coalesce(sum(price * (position + side * qty) - coalesce(pp * position, 0)) OVER ({AC} {BEFORE}), 0) AS marked, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({AC}) <= 2592000000000 THEN 0 ELSE 1 END AS nw FROM c1),
c3 AS (SELECT *, balance + marked AS equity, sum(nw) OVER ({AC}) AS run FROM c2), c4 AS (SELECT *, row_number() OVER (PARTITION BY account, run ORDER BY ts, id) - 1 AS recent FROM c3),
chain AS (SELECT *, CASE WHEN breaker THEN 'rejected: breaker' WHEN recent >= 3 THEN 'rejected: rate' WHEN balance < 850000 THEN 'rejected: balance' WHEN (1000000 - equity) / 1000000 > 0.2 THEN 'rejected: drawdown'
  WHEN exposure + qty > 150 THEN 'rejected: exposure' WHEN abs(position + side * qty) > 60 AND abs(position) >= 60 THEN 'rejected: position' WHEN abs(position + side * qty) > 60 THEN 'adjust' ELSE 'approved' END AS verdict FROM c4)"""
CLOSED = f"""{FILLS}, cl AS (SELECT symbol, order_id, line, part, qty, side, price AS entry, lead(price) OVER f AS exit, ts AS opened, lead(ts) OVER f AS closed FROM fills WINDOW f AS (PARTITION BY symbol ORDER BY ts, order_id, line, part, price, qty)),
tp AS (SELECT *, side * (exit - entry) * qty AS gross, (entry + exit) * qty * 0.001 AS fees, (epoch_us(closed) - epoch_us(opened)) / 1e6 AS held FROM cl WHERE exit IS NOT NULL), tn AS (SELECT *, gross - fees AS net FROM tp)"""
HELD = f"""{FILLS}, hd AS (SELECT symbol % 7 AS account, symbol, sum(side * qty) AS qty, sum(price * qty) / sum(qty) AS entry, arg_max(price, (ts, order_id, line, part, price, qty)) AS price FROM fills GROUP BY ALL)"""
LIQ = f"""{TICKS}, ag AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY symbol) - epoch_us(ts) AS age FROM ticks),
lq AS (SELECT symbol, count(*) AS liquidations, sum(price * qty) AS notional, sum(CASE WHEN side = 0 THEN price * qty ELSE 0 END) AS long_notional FROM ag WHERE qty >= 80 AND age < 172800000000 GROUP BY symbol)"""
FOLDS = f"""{BT}, mf AS (SELECT *, symbol AS model, CAST(floor(day(open_time) / 2) AS INTEGER) AS fold FROM bt),
md AS (SELECT *, sum(strategy) OVER (PARTITION BY model, fold ORDER BY open_time) AS s FROM mf), me AS (SELECT *, max(s) OVER (PARTITION BY model, fold ORDER BY open_time) - s AS dd FROM md),
folds AS (SELECT model, fold, sum(strategy) AS total, avg(strategy) / nullif(stddev_pop(strategy), 0) * {math.sqrt(252.0)!r} AS sharpe,
  avg(strategy) / nullif(stddev_pop(CASE WHEN strategy < 0 THEN strategy END), 0) * {math.sqrt(252.0)!r} AS sortino, count(CASE WHEN strategy > 0 THEN 1 END) / count(*) AS win_rate,
  sum(CASE WHEN strategy > 0 THEN strategy END) / nullif(-sum(CASE WHEN strategy < 0 THEN strategy END), 0) AS profit_factor, avg(CAST(strategy > 0 AS DOUBLE)) AS direction_accuracy, max(dd) AS max_drawdown FROM me GROUP BY ALL),
scored AS (SELECT *, 0.25 * sharpe + 0.15 * sortino + 0.15 * win_rate + 0.15 * profit_factor + 0.15 * direction_accuracy - 0.15 * (1 - least(max_drawdown, 1)) AS score FROM folds)"""
_CUT = f"""sp AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {{0}}), pt AS (SELECT *, CASE WHEN i < floor(n * 0.7e0) - {{1}} THEN 'train'
  WHEN i >= floor(n * 0.7e0) + {{1}} AND i < floor(n * 0.85e0) - {{1}} THEN 'validate' WHEN i >= floor(n * 0.85e0) + {{1}} THEN 'test' END AS part FROM sp)"""
_PASS = lambda *tests: " + ".join(f"CAST(coalesce({t}, false) AS INTEGER)" for t in tests)
_OUT = lambda sign, k: "concat_ws(',', " + ", ".join(f"CASE WHEN {m} {sign} {b[k]} THEN '{m}' END" for m, b in BOUNDS.items()) + ")"
_H = "ROWS BETWEEN 99 PRECEDING AND CURRENT ROW"

ORACLE_SQL = {
    "risk_chain": f"""WITH {CHAIN} SELECT account, symbol, ts, id, CAST(recent AS INTEGER) AS recent, verdict, {_r({c: c for c in ('position', 'balance', 'equity', 'exposure')}
        | {'allowed': "CASE verdict WHEN 'adjust' THEN 60 - abs(position) WHEN 'approved' THEN qty END", 'safe_size': 'greatest(least(60 - side * position, 0.95 * balance), 0)'}, 4)} FROM chain""",
    "violation_switch": f"""WITH {CHAIN}, n AS (SELECT account, ts, id, CAST(sum(CAST(starts_with(verdict, 'rejected') AS INTEGER)) OVER ({AC}) AS BIGINT) AS violations FROM chain)
      SELECT *, CAST(violations >= 5 AS INTEGER) AS stopped FROM n""",
    "sized_orders": f"""WITH {RETS}, s AS (SELECT symbol, open_time, close AS price, greatest(least(100 * coalesce(ret, 0), 1), -1) AS strength, CAST(trades * 500 AS DOUBLE) AS exposure FROM rets),
      q AS (SELECT *, greatest(round(1000 * abs(strength) / nullif(price, 0), 8), 0.001) AS qty, CASE WHEN strength >= 0 THEN 1 ELSE -1 END AS sd FROM s)
      SELECT symbol, open_time, {_r({c: c for c in ('price', 'strength', 'exposure', 'qty')} | {'stop_loss': 'price * (1 - sd * 0.02)', 'take_profit': 'price * (1 + sd * 0.04)'}, 5)},
        CASE WHEN qty * price > 1000 * (1 + 1e-9) THEN 'position' WHEN exposure + qty * price > 5000 THEN 'total exposure' ELSE 'ok' END AS rule FROM q""",
    "execution_costs": f"WITH {FILLS} SELECT order_id, line, symbol, part, qty, side, {_r({'notional': 'price * qty', 'fee': 'price * qty * 0.001', 'slipped': 'price * (1 + side * 5.0 / 1e4)'}, 8)} FROM fills",
    "trade_pnl": f"WITH {CLOSED} SELECT symbol, order_id, line, part, qty, {_r({'gross': 'gross', 'fees': 'fees', 'net': 'net', 'held_seconds': 'held'}, 8)} FROM tn",
    "pnl_summary": f"""WITH {CLOSED} SELECT symbol, count(*) AS trades, count(*) FILTER (net > 0) AS winners, count(*) FILTER (net < 0) AS losers, {_r({
        'win_rate': 'count(*) FILTER (net > 0) / count(*)', 'net': 'sum(net)', 'fees': 'sum(fees)', 'profit_factor': 'coalesce(sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0), 0)',
        'average_win': 'coalesce(avg(net) FILTER (net > 0), 0)', 'average_loss': 'coalesce(avg(-net) FILTER (net < 0), 0)', 'largest_win': 'coalesce(max(net) FILTER (net > 0), 0)',
        'largest_loss': 'coalesce(max(-net) FILTER (net < 0), 0)', 'held_seconds': 'avg(held)'})} FROM tn GROUP BY symbol""",
    "account_value": f"""WITH {HELD} SELECT account, count(*) FILTER (qty <> 0) AS positions, {_r({'exposure': 'sum(abs(qty))', 'unrealised': 'sum((price - entry) * qty)', 'total_pnl': 'sum((price - entry) * qty)',
        'equity': '1000000 + sum((price - entry) * qty)'}, 2)} FROM hd GROUP BY account""",
    "account_snapshot": f"""WITH {HELD} SELECT account, count(*) AS positions, '[' || string_agg('{{"symbol":' || symbol || ',"qty":' || CAST(qty AS BIGINT) || '}}', ',' ORDER BY symbol) || ']' AS json FROM hd GROUP BY account""",
    "recent_liquidations": f"WITH {LIQ} SELECT symbol, liquidations, round(notional, 3) AS notional, round(long_notional, 3) AS long_notional FROM lq",
    "market_regime": f"""WITH {LIQ}, g AS (SELECT symbol, 100 * (avg(side) - 0.5) / 10 AS pct, (sum(CASE WHEN side = 1 THEN qty END) - sum(CASE WHEN side = 0 THEN qty END)) / CAST(sum(qty) AS DOUBLE) AS oi FROM ticks GROUP BY symbol),
      lb AS (SELECT g.symbol, CASE WHEN pct > 0.05 THEN 'bullish' WHEN pct < -0.05 THEN 'bearish' ELSE 'neutral' END AS funding_sentiment, CAST(coalesce(abs(pct) > 0.1, false) AS INTEGER) AS funding_extreme,
        CASE WHEN oi > 0.02 THEN 'increasing' WHEN oi < -0.02 THEN 'decreasing' ELSE 'stable' END AS oi_trend, CASE WHEN notional > 5e4 THEN 'high' WHEN notional > 1e4 THEN 'medium' ELSE 'low' END AS cascade_risk,
        CASE WHEN long_notional > 0.7 * notional THEN 'long_heavy' WHEN long_notional < 0.3 * notional THEN 'short_heavy' ELSE 'balanced' END AS bias FROM g LEFT JOIN lq ON g.symbol = lq.symbol)
      SELECT *, CASE WHEN cascade_risk = 'high' OR funding_extreme = 1 THEN 'high_risk' WHEN oi_trend = 'increasing' AND funding_sentiment <> 'neutral' THEN 'trending' ELSE 'normal' END AS regime FROM lb""",
    "warm_up": f"""WITH {TICKS}, p AS (SELECT *, least(row_number() OVER ({V}) / 100.0, (epoch_us(ts) - first_value(epoch_us(ts)) OVER ({V})) / 1e6 / 86400, 1.0) AS x FROM ticks)
      SELECT event_id, symbol, ts, round(CAST(x AS DOUBLE), 6) AS progress, CAST(x >= 1 AS INTEGER) AS ready FROM p""",
    "mid_atr": f"""WITH {TICKS}, d AS (SELECT *, abs(price - lag(price) OVER ({V})) AS d FROM ticks)
      SELECT event_id, symbol, ts, CASE WHEN count(d) OVER f = 14 THEN round(avg(d) OVER f, 6) END AS atr FROM d WINDOW f AS ({V} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "book_health": f"WITH {STATE} SELECT symbol, CAST(best_bid IS NOT NULL AND best_ask IS NOT NULL AND bid_levels > 0 AND ask_levels > 0 AS INTEGER) AS healthy, round(bid_depth / nullif(ask_depth, 0), 6) AS volume_ratio FROM st",
    "parsed_messages": f"""WITH {TICKS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'trade' WHEN 1 THEN 'depth' WHEN 2 THEN 'trade' ELSE 'unknown' END AS kind, CASE WHEN event_id % 4 < 3 THEN upper(symbol) END AS symbol,
        CASE WHEN event_id % 4 < 3 THEN event_id END AS event_time, CASE WHEN event_id % 4 IN (0, 2) THEN round(price, 2) END AS price, CASE WHEN event_id % 4 IN (0, 2) AND event_id % 50 <> 0 THEN CAST(qty AS DOUBLE) END AS qty,
        CASE WHEN event_id % 4 = 1 THEN 1 END AS bids, CASE WHEN event_id % 4 = 1 THEN round(price) + 1 END AS best_ask, CAST(event_id % 4 IN (0, 2) AND event_id % 50 = 0 AS INTEGER) AS bad FROM ticks""",
    "selected_trades": f"WITH {LOG} SELECT id, symbol, ts, pnl FROM trades WHERE symbol = '1-URGENT' AND ts >= TIMESTAMP '1993-01-01' AND ts <= TIMESTAMP '1997-12-31' ORDER BY ts DESC, id DESC LIMIT 50",
    "trades_by_day": f"WITH {LOG} SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n FROM trades GROUP BY ALL",
    "last_trades": f"""WITH {LOG}, l AS (SELECT * FROM trades ORDER BY ts DESC, id DESC LIMIT 1000)
      SELECT count(*) AS n, count(*) FILTER (pnl > 0) AS winners, round(sum(pnl), 3) AS total, round(avg(pnl), 3) AS average, count(*) - count(*) FILTER (pnl > 0) AS losers FROM l""",
    "composite_score": f"WITH {FOLDS} SELECT model, fold, round(score, 4) AS score FROM scored",
    "best_models": f"""WITH {FOLDS}, a AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY fold DESC) AS age FROM scored), m AS (SELECT model, avg(coalesce(score, 0)) AS score, count(*) AS folds FROM a WHERE age <= 5 GROUP BY model),
      p AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS passed FROM m) SELECT model, round(score, 4) AS score, folds, passed, CAST(row_number() OVER o AS INTEGER) AS rank FROM p WINDOW o AS (ORDER BY passed DESC, score DESC, model) QUALIFY row_number() OVER o <= 3""",
    "fold_average": f"WITH {FOLDS} SELECT model, count(*) AS folds, {_r({m: f'avg({m})' for m in ('total', 'win_rate', 'max_drawdown')}, 5)} FROM folds GROUP BY model",
    "robustness": f"""WITH {FOLDS} SELECT model, {_r({f'{n}_{c}': f'{f}({c})' for c in ('total', 'sharpe') for n, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max'))}
        | {'return_consistency': '1 - stddev_pop(total) / (abs(avg(total)) + 1e-8)'}, 3)} FROM folds GROUP BY model""",
    "reward_hacking": f"""WITH {BT}, {_CUT.format('bt', 0)}, k AS (SELECT *, strategy - lag(strategy) OVER (PARTITION BY symbol, part ORDER BY open_time) AS ch FROM pt WHERE part IN ('train', 'validate')),
      mv AS (SELECT symbol AS ms, avg(strategy) AS v FROM k WHERE part = 'validate' GROUP BY symbol),
      g AS (SELECT symbol, avg(strategy) FILTER (part = 'train') AS t, any_value(v) AS v, stddev_pop(strategy) FILTER (part = 'train') AS s, count(*) FILTER (part = 'validate') AS n, count(*) FILTER (part = 'validate' AND ch < -0.05 * abs(v)) AS drops FROM k JOIN mv ON ms = symbol GROUP BY symbol),
      h AS (SELECT symbol AS model, CASE WHEN abs(t) > 1e-8 THEN (t - v) / abs(t) ELSE 0 END AS gap, s / (abs(t) + 1e-8) < 0.1 AND t > 0.01 AS even, n > 10 AND drops > 0.1 * n AS sudden FROM g WHERE t IS NOT NULL),
      c AS (SELECT *, CASE WHEN gap > 0.5 THEN 0.4 ELSE 0 END + CASE WHEN even THEN 0.3 ELSE 0 END + CASE WHEN sudden THEN 0.3 ELSE 0 END AS x FROM h)
      SELECT model, round(gap, 3) AS performance_gap, CAST(even AS INTEGER) AS too_even, CAST(sudden AS INTEGER) AS sudden_drops, round(CAST(x AS DOUBLE), 3) AS confidence, CAST(x > 0.5 AS INTEGER) AS detected FROM c""",
    "against_buy_and_hold": f"""WITH {BT}, g AS (SELECT symbol, product(1 + strategy) - 1 AS a, product(1 + coalesce(close / nullif(lag_close, 0) - 1, 0)) - 1 AS b FROM (SELECT *, lag(close) OVER ({W}) AS lag_close FROM bt) GROUP BY symbol)
      SELECT symbol, round(a, 3) AS agent_return, round(b, 3) AS baseline_return, round(a - b, 3) AS excess_return, CAST(a - b > 0 AS INTEGER) AS outperformed FROM g""",
    "go_no_go": f"""WITH {FOLDS}, c AS (SELECT *, {_PASS('direction_accuracy > 0.5', 'sharpe > 0', 'win_rate > 0.45', 'profit_factor > 0.8')} AS criteria FROM folds)
      SELECT model, fold, criteria, CASE WHEN criteria >= 3 THEN 'GO' ELSE 'NO-GO' END AS decision, {_OUT('<', 0)} AS below, {_OUT('>', 1)} AS above, CAST({_OUT('>', 1)} = '' AND NOT coalesce(sharpe > 5, false) AS INTEGER) AS passed FROM c""",
    "return_profile": f"""WITH {RETS}, d AS (SELECT *, lag(log_ret) OVER ({W}) AS prev FROM rets WHERE log_ret IS NOT NULL), g AS (SELECT symbol, count(*) AS n, stddev_samp(log_ret) * {math.sqrt(252 * 24 * 60)!r} AS vol, skewness(log_ret) AS sk, kurtosis(log_ret) AS ku,
        corr(log_ret, prev) FILTER (prev IS NOT NULL) AS ac, corr(abs(log_ret), abs(prev)) FILTER (prev IS NOT NULL) AS aa FROM d GROUP BY symbol)
      SELECT symbol, n, {_r({'annual_volatility': 'vol', 'skewness': 'sk', 'kurtosis': 'ku', 'autocorrelation': 'ac', 'autocorrelation_abs': 'aa'}, 4)}, {_PASS('ku > 0', 'aa > 0.05', 'abs(ac) < 0.05', 'vol BETWEEN 0.3 AND 1.0')} AS checks_passed FROM g""",
    "split_order": f"""WITH {BARS}, {_CUT.format('bars', 2)}, b AS (SELECT symbol, {', '.join(f"{f}(CASE WHEN part = '{p}' THEN epoch_us(open_time) END) AS {n}_{p}" for p in ('train', 'validate', 'test') for n, f in (('a', 'min'), ('z', 'max')))} FROM pt GROUP BY symbol)
      SELECT symbol, CAST(0 AS BIGINT) AS shared, (a_validate - z_train) / 1e6 AS gap_train_validate, (a_test - z_validate) / 1e6 AS gap_validate_test,
        CAST(coalesce(a_validate - z_train >= 7200000000 AND a_test - z_validate >= 7200000000, false) AS INTEGER) AS ordered FROM b""",
    "expanding_ranges": f"""WITH {BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), s AS (SELECT symbol, n, CAST(g.split AS INTEGER) AS split, CAST(floor(n / 5) AS BIGINT) AS size FROM n, range(0, 5) g(split)),
      e AS (SELECT symbol, split, CAST(floor(size * (split + 1) * 0.8) AS BIGINT) AS train_end, least(size * (split + 2), n) AS test_end FROM s)
      SELECT symbol, split, train_end, train_end + 2 AS test_start, test_end FROM e WHERE train_end + 2 < test_end""",
    "cleaned_features": f"WITH {RETS} SELECT symbol, open_time, trades, round(ret, 4) AS ret, round(CASE WHEN ret <> 0 THEN 1 / ret END, 4) AS inverse FROM rets WHERE ret IS NOT NULL",
    "bar_proxies": f"""WITH {BARS}, m AS (SELECT *, (high + low) / 2 AS mid, CASE WHEN close > 0 THEN (high - low) / close ELSE 0 END AS spread, CASE WHEN high > low THEN (high - low) / 2 ELSE (high + low) / 2 * 0.001 END AS half FROM bars)
      SELECT symbol, open_time, {_r({'bid': 'mid - spread * mid / 2', 'ask': 'mid + spread * mid / 2', 'size': 'volume / 2', 'book_bid': 'mid - half', 'book_ask': 'mid + half',
        'book_bid_size': 'CASE WHEN taker_buy_base > 0 THEN volume - taker_buy_base ELSE volume / 2 END', 'book_ask_size': 'CASE WHEN taker_buy_base > 0 THEN taker_buy_base ELSE volume / 2 END'})},
        CASE WHEN taker_buy_base > 0 THEN CASE WHEN taker_buy_base > volume / 2 THEN 1 ELSE -1 END WHEN close > open THEN 1 ELSE -1 END AS side FROM m""",
    "hawkes_estimate": f"""WITH {TICKS}, d AS (SELECT symbol, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({V})) / 1e6 AS gap FROM ticks), g AS (SELECT symbol, count(gap) AS n, avg(gap) AS m, var_pop(gap) AS v FROM d GROUP BY symbol)
      SELECT symbol, n, {_r({'mu': 'CASE WHEN n >= 50 AND m > 0 THEN 1 / m END', 'alpha': 'CASE WHEN n >= 50 AND m > 0 THEN CASE WHEN v / (m * m) > 1 THEN least(1 - 1 / (v / (m * m)), 0.99) ELSE 0 END / m END', 'beta': 'CASE WHEN n >= 50 AND m > 0 THEN 1 / m END'}, 7)} FROM g""",
    "toxicity": f"""WITH {VPIN}, vp AS (SELECT symbol, last AS at, vpin, CASE WHEN len(hist) >= 50 AND vpin IS NOT NULL THEN len(list_filter(hist, lambda x: x <= vpin)) / len(hist) END AS vpin_cdf FROM h),
      qm AS (SELECT event_id, symbol, ts, price, side, price - 0.0005 * price * (1 + side) AS bid, price + 0.0005 * price * (1 + side) AS ask FROM ticks), qi AS (SELECT *, (bid + ask) / 2 AS mid FROM qm),
      i0 AS (SELECT event_id, symbol, ts, side, abs(mid - lag(mid, 5) OVER ({V})) / nullif(lag(mid, 5) OVER ({V}), 0) AS impact FROM qi),
      i AS (SELECT i0.*, vp.vpin AS vp, vp.vpin_cdf AS vc FROM i0 ASOF LEFT JOIN vp ON i0.symbol = vp.symbol AND i0.ts >= vp.at),
      a AS (SELECT *, count(*) OVER f AS n, abs(2 * sum(CAST(side = 1 AS INTEGER)) OVER f - count(*) OVER f) / CAST(count(*) OVER f AS DOUBLE) AS im, CASE WHEN count(impact) OVER f >= 10 THEN avg(impact) OVER f END AS adverse FROM i WINDOW f AS ({V} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
      p AS (SELECT *, CASE WHEN n >= 100 THEN 0.5 * (1 + tanh(2 * (im - 0.3))) END AS pin, least(1, adverse * 200) AS ad FROM a),
      t AS (SELECT *, (coalesce(vc * 0.4, 0) + coalesce(ad * 0.3, 0) + coalesce(pin * 0.3, 0)) / nullif(CASE WHEN vc IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN ad IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN pin IS NOT NULL THEN 0.3 ELSE 0 END, 0) AS tox FROM p)
      SELECT event_id, symbol, ts, {_r({'adverse': 'adverse', 'pin': 'pin', 'informed': 'CASE WHEN vp IS NOT NULL AND pin IS NOT NULL THEN 0.6 * vp + 0.4 * pin ELSE coalesce(vp, pin) END', 'toxicity': 'tox',
        'toxicity_z': 'CASE WHEN count(tox) OVER h >= 20 THEN CASE WHEN stddev_pop(tox) OVER h = 0 THEN 0 ELSE (tox - avg(tox) OVER h) / stddev_pop(tox) OVER h END END'}, 5)},
        CASE WHEN tox IS NULL THEN 'UNKNOWN' WHEN tox < 0.3 THEN 'LOW' WHEN tox < 0.5 THEN 'MEDIUM' WHEN tox < 0.7 THEN 'HIGH' ELSE 'EXTREME' END AS regime FROM t WINDOW h AS ({V} {_H})""",
    "fisher_pair": f"""WITH {BARS}, x AS (SELECT *, 2 * ((close - low) / nullif(high - low, 0)) - 1 AS x FROM bars), c AS (SELECT *, CASE WHEN x IS NOT NULL THEN greatest(least(x, 1 - 1e-8), -1 + 1e-8) END AS c FROM x)
      SELECT symbol, open_time, round(0.5 * ln((1 + c) / (1 - c)), 5) AS fisher, round(tanh(x), 5) AS inverse FROM c""",
}
