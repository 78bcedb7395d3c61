"""Risk chain, order sizes, fees, trade profit, equity and the market regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import back, ordered, so_far

C = F.col


def risk_chain(
    orders: DataFrame, max_position: float = 60.0, max_exposure: float = 150.0, max_drawdown: float = 0.2, min_balance: float = 1000.0, most_orders: int = 3,
    gap_seconds: int = 60, initial: float = 100_000.0,
) -> DataFrame:
    """Each order's verdict: breaker, rate, balance, drawdown, total exposure, position, the first that fails.

    Orders have ``account``, ``symbol``, ``ts``, ``id``, ``qty``, ``side`` (1, -1), ``price`` and ``breaker``
    (boolean).  The state before an order is that of all earlier ones of its account, filled at
    their price: the cash left, the equity with positions at their last price, the summed sizes of
    positions, and the orders since the last pause of more than ``gap_seconds``.  An order beyond the
    position limit is cut to the room that is left, if any.  ``safe_size`` is the room by position
    and 95 % of the balance, never below 0.
    """
    own, account = Window.partitionBy("account", "symbol").orderBy("ts", "id"), Window.partitionBy("account").orderBy("ts", "id")
    signed = C("side") * C("qty")
    position = F.coalesce(F.sum(signed).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = orders.withColumn("position", position).withColumn("_value", C("price") * (C("position") + signed) - F.coalesce(F.lag("price").over(own) * C("position"), F.lit(0.0)))
    earlier = account.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("balance", initial - F.coalesce(F.sum(signed * C("price")).over(earlier), F.lit(0.0)))
    # Changes of one symbol's size and value telescope, so that running sums over all symbols are the account's.
    df = df.withColumn("exposure", F.coalesce(F.sum(F.abs(C("position") + signed) - F.abs("position")).over(earlier), F.lit(0.0)))
    df = df.withColumn("equity", C("balance") + F.coalesce(F.sum("_value").over(earlier), F.lit(0.0)))
    at = F.unix_micros(C("ts").cast("timestamp"))
    df = df.withColumn("_run", F.sum(F.when(at - F.lag(at).over(account) <= gap_seconds * 1_000_000, 0).otherwise(1)).over(so_far(account)))
    df = df.withColumn("recent", F.row_number().over(Window.partitionBy("account", "_run").orderBy("ts", "id")) - 1)
    room = max_position - F.abs("position")
    beyond = F.abs(C("position") + signed) > max_position
    verdict = (
        F.when(C("breaker"), "rejected: breaker").when(C("recent") >= most_orders, "rejected: rate").when(C("balance") < min_balance, "rejected: balance")
        .when((initial - C("equity")) / initial > max_drawdown, "rejected: drawdown").when(C("exposure") + C("qty") > max_exposure, "rejected: exposure")
        .when(beyond & (room <= 0), "rejected: position").when(beyond, "adjust").otherwise("approved")
    )
    safe = F.greatest(F.least(max_position - C("side") * C("position"), 0.95 * C("balance")), F.lit(0.0))
    return df.select(
        "account", "symbol", "ts", "id", "position", "recent", "balance", "equity", "exposure", verdict.alias("verdict"),
        F.when(verdict == "adjust", room).when(verdict == "approved", C("qty")).alias("allowed"), safe.alias("safe_size"),
    )


def violation_switch(checks: DataFrame, most: int = 100, by: str = "account") -> DataFrame:
    """Rejected orders so far, and whether they are so many that trading stops."""
    n = F.sum(F.col("verdict").startswith("rejected").cast("bigint")).over(so_far(ordered(by, ["ts", "id"])))
    return checks.select(by, "ts", "id", n.alias("violations"), (n >= most).cast("int").alias("stopped"))


def sized_orders(
    df: DataFrame, capital: float = 10_000.0, share: float = 0.1, total_share: float = 0.5, least: float = 0.001, stop: float = 0.02, take: float = 0.04
) -> DataFrame:
    """Size of a signal by a share of the capital, its stop and target prices, and the exposure rules.

    ``df`` has ``price``, ``strength`` (its sign is the side) and ``exposure``, what is held already.
    """
    qty = F.greatest(F.round(ratio(capital * share * F.abs("strength"), C("price")), 8), F.lit(least))
    side = F.when(C("strength") >= 0, 1).otherwise(-1)
    value = qty * C("price")
    rule = F.when(value > capital * share * (1 + 1e-9), "position").when(C("exposure") + value > capital * total_share, "total exposure").otherwise("ok")
    return df.withColumn("qty", qty).withColumn("stop_loss", C("price") * (1 - side * stop)).withColumn("take_profit", C("price") * (1 + side * take)).withColumn("rule", rule)


def execution_costs(fills: DataFrame, fee: float = 0.001, slip_bps: float = 5.0) -> DataFrame:
    """Notional, fee and the price after slippage against the side of each fill."""
    notional = C("price") * C("qty")
    return fills.withColumn("notional", notional).withColumn("fee", notional * fee).withColumn("slipped", C("price") * (1 + C("side") * slip_bps / 1e4))


def trade_pnl(trades: DataFrame, fee: float = 0.001) -> DataFrame:
    """Gross and net profit, both fees and seconds held of closed trades (``entry``, ``exit``, ``qty``, ``side``, ``opened``, ``closed``)."""
    gross = C("side") * (C("exit") - C("entry")) * C("qty")
    fees = (C("entry") + C("exit")) * C("qty") * fee
    held = (F.unix_micros(C("closed").cast("timestamp")) - F.unix_micros(C("opened").cast("timestamp"))) / 1e6
    return trades.withColumn("gross", gross).withColumn("fees", fees).withColumn("net", C("gross") - C("fees")).withColumn("held_seconds", held)


def pnl_summary(trades: DataFrame, by: str = "symbol") -> DataFrame:
    """Trade metrics of net profits; profit factor 0 without losses, mean and largest 0 without such trades."""
    win, loss = F.when(C("net") > 0, C("net")), F.when(C("net") < 0, -C("net"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return trades.groupBy(by).agg(
        F.count("*").alias("trades"), F.count(win).alias("winners"), F.count(loss).alias("losers"), (F.count(win) / F.count("*")).alias("win_rate"),
        F.sum("net").alias("net"), F.sum("fees").alias("fees"), zero(ratio(F.sum(win), F.sum(loss))).alias("profit_factor"), zero(F.avg(win)).alias("average_win"),
        zero(F.avg(loss)).alias("average_loss"), zero(F.max(win)).alias("largest_win"), zero(F.max(loss)).alias("largest_loss"), F.avg("held_seconds").alias("held_seconds"),
    )


def account_value(positions: DataFrame, prices: DataFrame, balance: float = 1_000_000.0, by: str = "account") -> DataFrame:
    """Exposure, unrealised and total profit and equity of accounts from positions and last prices by symbol.

    A position without a price is taken at its entry.
    """
    p = positions.join(prices.select(C("symbol").alias("_s"), C("price").alias("_mark")), C("symbol") == C("_s"), "left")
    open_ = (F.coalesce("_mark", "entry") - C("entry")) * C("qty")
    return p.groupBy(by).agg(
        F.count_if(C("qty") != 0).alias("positions"), F.sum(F.abs("qty")).alias("exposure"), F.sum(open_).alias("unrealised"),
        F.sum(C("realised") + open_).alias("total_pnl"), (balance + F.sum(open_)).alias("equity"),
    )


def recent_liquidations(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Forced orders of each symbol's last ``seconds``: total and long notional; a forced sale ends a long position."""
    at = F.unix_micros(C("ts").cast("timestamp"))
    last = F.max(at).over(Window.partitionBy("symbol"))
    recent = events.withColumn("_age", last - at).where(C("forced") & (C("_age") < seconds * 1_000_000))
    notional = C("price") * C("qty")
    return recent.groupBy("symbol").agg(F.count("*").alias("liquidations"), F.sum(notional).alias("notional"), F.sum(F.when(C("side") == 0, notional).otherwise(0.0)).alias("long_notional"))


def market_regime(df: DataFrame, high: float = 1e7, medium: float = 1e6) -> DataFrame:
    """Labels of a symbol's funding rate, change of open interest and recent liquidations, and the regime that they make.

    ``df`` has ``funding_rate``, ``oi_change`` (1 is 100 %), ``notional`` and ``long_notional``, each null if unknown.
    """
    percent = 100 * C("funding_rate")
    extreme = F.coalesce(F.abs(percent) > 0.1, F.lit(False))
    sentiment = F.when(percent > 0.05, "bullish").when(percent < -0.05, "bearish").otherwise("neutral")
    interest = F.when(C("oi_change") > 0.02, "increasing").when(C("oi_change") < -0.02, "decreasing").otherwise("stable")
    cascade = F.when(C("notional") > high, "high").when(C("notional") > medium, "medium").otherwise("low")
    bias = F.when(C("long_notional") > 0.7 * C("notional"), "long_heavy").when(C("long_notional") < 0.3 * C("notional"), "short_heavy").otherwise("balanced")
    regime = F.when((cascade == "high") | extreme, "high_risk").when((interest == "increasing") & (sentiment != "neutral"), "trending").otherwise("normal")
    return df.select(
        "symbol", sentiment.alias("funding_sentiment"), extreme.cast("int").alias("funding_extreme"), interest.alias("oi_trend"), cascade.alias("cascade_risk"), bias.alias("bias"), regime.alias("regime")
    )


def warm_up(df: DataFrame, points: int = 100, seconds: int = 300) -> DataFrame:
    """Whether a symbol has had ``points`` rows and ``seconds`` since its first, and the share of both reached."""
    w = ordered("symbol", ["ts", "event_id"])
    at = F.unix_micros(C("ts").cast("timestamp"))
    age = (at - F.first(at).over(so_far(w))) / 1e6
    progress = F.least(F.row_number().over(w) / points, age / seconds, F.lit(1.0))
    return df.select("event_id", "symbol", "ts", progress.alias("progress"), (progress >= 1).cast("int").alias("ready"))


def mid_atr(df: DataFrame, rows: int = 14) -> DataFrame:
    """The mean absolute change of the price over the last ``rows`` changes; null before."""
    w = ordered("symbol", ["ts", "event_id"])
    d = df.withColumn("_d", F.abs(C("price") - back("price", 1, w)))
    f = w.rowsBetween(-(rows - 1), 0)
    return d.select("event_id", "symbol", "ts", F.when(F.count("_d").over(f) == rows, F.avg("_d").over(f)).alias("atr"))


def book_health(state: DataFrame) -> DataFrame:
    """Whether a book has a mid price, a spread and levels on both sides, and its ratio of depths."""
    ok = C("mid").isNotNull() & C("spread_bps").isNotNull() & (C("bid_levels") > 0) & (C("ask_levels") > 0)
    return state.select("symbol", F.coalesce(ok, F.lit(False)).cast("int").alias("healthy"), ratio(C("bid_depth"), C("ask_depth")).alias("volume_ratio"))


def parsed_messages(raw: DataFrame, text: str = "message") -> DataFrame:
    """Routes JSON messages by their stream's name, else by the event's name, and decodes them.

    Adds ``kind`` (depth, trade, unknown), ``symbol`` in upper case, ``price`` and ``qty`` of trades as
    decimal(18,8), and ``bids`` and ``asks`` of depth updates; a level that is not a pair of two
    decimals, or a price that is none, makes the message ``bad``.
    """
    data = F.coalesce(F.get_json_object(text, "$.data"), C(text))
    get = lambda k: F.get_json_object(data, f"$.{k}")
    stream, event = F.get_json_object(text, "$.stream"), get("e")
    kind = (
        F.when(stream.contains("depth"), "depth").when(stream.contains("trade"), "trade").when(event == "depthUpdate", "depth").when(event == "trade", "trade").otherwise("unknown")
    )
    decimal = lambda x: x.try_cast("decimal(18,8)")
    levels = lambda k: F.from_json(get(k), "array<array<string>>")
    pairs = lambda x: F.transform(x, lambda p: F.struct(decimal(F.get(p, 0)).alias("price"), decimal(F.get(p, 1)).alias("qty")))
    wrong = lambda x: F.exists(x, lambda p: (F.size(p) != 2) | decimal(F.get(p, 0)).isNull() | decimal(F.get(p, 1)).isNull())
    df = raw.withColumn("kind", kind).withColumn("symbol", F.upper(get("s"))).withColumn("event_time", get("E").try_cast("bigint"))
    trade, depth = C("kind") == "trade", C("kind") == "depth"
    df = df.withColumn("price", F.when(trade, decimal(get("p")))).withColumn("qty", F.when(trade, decimal(get("q")))).withColumn("buyer_maker", F.when(trade, get("m").try_cast("boolean")))
    bids, asks = F.when(depth, levels("b")), F.when(depth, levels("a"))
    bad = (trade & (C("price").isNull() | C("qty").isNull())) | (depth & (bids.isNull() | asks.isNull() | wrong(bids) | wrong(asks)))
    return df.withColumn("bids", pairs(bids)).withColumn("asks", pairs(asks)).withColumn("bad", F.coalesce(bad, F.lit(True)).cast("int"))


def select_trades(trades: DataFrame, symbol: str | None = None, start: object = None, stop: object = None, limit: int = 100) -> DataFrame:
    """The newest trades of a symbol from ``start`` up to ``stop``, each bound optional."""
    for wanted in (symbol is not None and (C("symbol") == symbol), start is not None and (C("ts") >= F.lit(start)), stop is not None and (C("ts") <= F.lit(stop))):
        trades = trades.where(wanted) if isinstance(wanted, Column) else trades
    return trades.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
