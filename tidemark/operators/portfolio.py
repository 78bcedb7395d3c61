"""Backtests, folds of positions, and chains of risk and safety checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import back, full, ordered, so_far

C = F.col


def moving_average_signal(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Adds ``signal``: 1, -1 or 0 by the sign of the fast less the slow mean; 0 until both are there."""
    d = full(F.avg, C("close"), fast) - full(F.avg, C("close"), slow)
    return bars.withColumn("signal", F.coalesce(F.signum(d), F.lit(0.0)))


def backtest(df: DataFrame, fee: float = 0.001, slippage: float = 0.0005, capital: float = 10_000.0, short: bool = True) -> DataFrame:
    """Holds each signal from the next bar on, pays for every change of position, and compounds equity."""
    s = F.greatest(F.least(C("signal"), F.lit(1.0)), F.lit(-1.0 if short else 0.0))
    df = df.withColumn("position", s).withColumn("ret", F.coalesce(ratio(C("close"), back("close")) - 1, F.lit(0.0)))
    cost = F.abs(C("position") - F.coalesce(back("position"), F.lit(0.0))) * (fee + slippage)
    df = df.withColumn("strategy", F.coalesce(back("position"), F.lit(0.0)) * C("ret") - cost)
    equity = F.when(F.min(1 + C("strategy")).over(so_far()) > 0, capital * F.exp(F.sum(F.ln(F.greatest(1 + C("strategy"), F.lit(1e-300)))).over(so_far()))).otherwise(0.0)
    return df.select("symbol", "open_time", "close", "position", "ret", "strategy", equity.alias("equity"))


def round_trips(df: DataFrame) -> DataFrame:
    """Entries and exits of a position column: a trade runs from one change of position to the next; the last stays open and is left out."""
    changed = df.withColumn("before", back("position")).where("before is not null and position <> before")
    w = ordered()
    t = changed.withColumn("exit_time", F.lead("open_time").over(w)).withColumn("exit", F.lead("close").over(w))
    return t.where("position <> 0 and exit is not null").select(
        "symbol", C("open_time").alias("entry_time"), "exit_time", "position", C("close").alias("entry"), "exit", (C("position") * (ratio(C("exit"), C("close")) - 1)).alias("trade_return")
    )


def walk_forward(df: DataFrame, train: int = 100, test: int = 50, step: int = 50) -> DataFrame:
    """Sums of returns over rolling train and test ranges of each symbol's rows.

    A row lies in a bounded number of folds, which an explode of the fold numbers gives; there is no
    join of rows with folds.
    """
    i = F.row_number().over(ordered()) - 1
    df = df.withColumn("i", i).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    first = F.greatest(F.ceil((C("i") - (train + test) + 1) / step), F.lit(0)).cast("int")
    last = F.floor(C("i") / step).cast("int")
    df = df.withColumn("fold", F.explode(F.sequence(F.least(first, last), last)))
    df = df.withColumn("at", C("i") - C("fold") * step).where((C("at") >= 0) & (C("at") < train + test) & (C("fold") * step + train + test <= C("n")))
    part = C("at") < train
    return df.groupBy("symbol", "fold").agg(
        F.sum(F.when(part, C("strategy"))).alias("train_return"), F.sum(F.when(~part, C("strategy"))).alias("test_return"), F.min("open_time").alias("start"), F.max("open_time").alias("stop")
    )


def _after_fill(q: float, entry: float, realised: float, price: float, qty: float, averaged: bool) -> tuple[float, float, float]:
    """Position, entry and realised profit after a fill of a signed quantity."""
    new = q + qty
    flips = q * new < 0
    if q == 0 or q * qty > 0 or (averaged and not flips and new != 0):
        return new, (abs(q) * entry + abs(qty) * price) / (abs(q) + abs(qty)), realised
    closed = min(abs(q), abs(qty)) * (1.0 if q > 0 else -1.0) * (price - entry)
    return new, price if flips else entry, realised + closed


def _folded(averaged: bool, last: bool) -> Callable[[Iterator], Iterator]:
    """The state after each fill, or after each symbol's last, of batches in order; a task holds one state at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(out: list[tuple], kept: dict) -> pa.RecordBatch:
            symbols, fills, *state = zip(*out, strict=True) if out else ((),) * 5
            state = pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in state], names=["qty", "entry", "realised"])
            columns = kept or {"symbol": pa.array(symbols, kind), "fills": pa.array(fills, pa.int64())}
            return pa.RecordBatch.from_arrays([*columns.values(), state], names=[*columns, "state"])

        now = None
        for batch in batches:
            out, kind = [], batch.schema.field("symbol").type
            for symbol, price, qty, side in zip(*(batch.column(c).to_pylist() for c in ("symbol", "price", "qty", "side")), strict=True):
                if now is not None and now[0] == symbol:
                    now = (symbol, now[1] + 1, *_after_fill(now[2], now[3], now[4], price, side * qty, averaged))
                else:
                    if last and now is not None:
                        out.append(now)
                    now = (symbol, 1, side * qty, price, 0.0)
                if not last:
                    out.append(now)
            yield made(out, {} if last else dict(zip(batch.schema.names, batch.columns, strict=True)))
        if last and now is not None:
            yield made([now], {})

    return run


def _in_order(fills: DataFrame, mode: str) -> DataFrame:
    """Fills dealt by symbol and sorted in each task."""
    if mode not in ("correct", "reference"):
        raise ValueError(f"unknown mode: {mode}")
    fills = fills.where("qty > 0 and price is not null and side <> 0")
    rows = fills.select("symbol", "open_time", *[C(c).cast("double").alias(c) for c in ("price", "qty", "side")])
    return rows.repartition("symbol").sortWithinPartitions("symbol", "open_time")


_STATE = "state struct<qty: double, entry: double, realised: double>"


def positions(fills: DataFrame, mode: str = "correct") -> DataFrame:
    """Position, average entry and realised profit after each fill, folded by symbol in order.

    ``correct``: a fill against the position closes up to its size at the entry price, and any rest
    opens the other side.  ``reference``: a partial close averages into the entry instead and books
    nothing.  Fills need ``symbol``, ``open_time`` (a struct that orders them), ``price``, ``qty``
    and ``side`` (1 or -1).  Rows without a quantity above 0, a price and a side are no fills and left out.
    Fills stream through the task of their symbol in order, so that no symbol's history is gathered.
    """
    rows = _in_order(fills, mode)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_folded(mode == "reference", False), f"{types}, {_STATE}")


def last_positions(fills: DataFrame, mode: str = "correct") -> DataFrame:
    """The number of each symbol's fills and the state after its last one: what ``positions`` ends with, and no row for each fill."""
    rows = _in_order(fills, mode).select("symbol", "price", "qty", "side")
    return rows.mapInArrow(_folded(mode == "reference", True), f"symbol {rows.schema['symbol'].dataType.simpleString()}, fills bigint, {_STATE}")


def risk_checks(orders: DataFrame, max_position: float = 60.0, max_notional: float = 80_000.0) -> DataFrame:
    """The first rule that an order breaks, in a fixed order, with the room left where it can be cut down.

    Orders need ``symbol``, ``ts``, ``id``, ``qty``, ``side`` and ``price``.  The position before an
    order sums the earlier ones of its symbol, as if all had been filled.  Breaker, rate, balance,
    drawdown and total exposure are not tested.
    """
    w = ordered("symbol", ["ts", "id"])
    before = F.coalesce(F.sum(C("side") * C("qty")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = orders.withColumn("position", before).withColumn("notional", C("qty") * C("price"))
    room = max_position - F.abs("position")
    after = F.abs(C("position") + C("side") * C("qty"))
    verdict = (
        F.when(C("qty") <= 0, "rejected: quantity").when(C("notional") > max_notional, "rejected: notional").when((after > max_position) & (room <= 0), "rejected: position")
        .when(after > max_position, "adjust").otherwise("approved")
    )
    return df.select("symbol", "ts", "id", "position", verdict.alias("verdict"), F.when(verdict == "adjust", F.least(room, C("qty"))).alias("allowed"))


def price_jumps(orders: DataFrame, most: float = 0.5) -> DataFrame:
    """Orders whose price is far from that of the symbol's order before."""
    w = ordered("symbol", ["ts", "id"])
    move = F.abs(ratio(C("price"), back("price", 1, w)) - 1)
    return orders.select("symbol", "ts", "id", "price", move.alias("move"), F.coalesce((move > most).cast("int"), F.lit(0)).alias("jump"))


def rolling_rate(events: DataFrame, seconds: int = 3600, most: int = 5) -> DataFrame:
    """Each event with the number in the last ``seconds``, itself included, and whether that is too many."""
    at = F.unix_micros(C("ts").cast("timestamp"))
    w = Window.partitionBy("symbol").orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    n = F.count("*").over(w)
    return events.select("event_id", "symbol", "ts", n.alias("recent"), (n > most).cast("int").alias("limited"))


def session_rate(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Each event's number within its session; a session ends with a gap longer than ``gap_seconds``."""
    w = ordered("symbol", ["ts", "event_id"])
    at = F.unix_micros(C("ts").cast("timestamp"))
    df = events.withColumn("_new", F.when(at - F.lag(at).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("_new").over(so_far(w)))
    return df.select("event_id", "symbol", "ts", "session", F.row_number().over(Window.partitionBy("symbol", "session").orderBy("ts", "event_id")).alias("number"))


def loss_breaker(trades: DataFrame, in_a_row: int = 4, most_lost: float = 500_000.0) -> DataFrame:
    """Losses in a row and their sum since the last win, and whether either stops trading."""
    w = ordered("symbol", ["ts", "id"])
    df = trades.withColumn("_win", (C("pnl") >= 0).cast("int")).withColumn("_island", F.sum("_win").over(so_far(w)))
    v = Window.partitionBy("symbol", "_island").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    losses = F.sum((C("pnl") < 0).cast("bigint")).over(v)
    lost = F.sum(F.when(C("pnl") < 0, -C("pnl")).otherwise(0.0)).over(v)
    return df.select("symbol", "ts", "id", losses.alias("losses"), lost.alias("lost"), ((losses >= in_a_row) | (lost >= most_lost)).cast("int").alias("tripped"))


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The last row of each key, a max over its columns that combines on the map side: an upsert's result."""
    rest = [c for c in df.columns if c != key and c not in by]
    best = df.groupBy(key).agg(F.max(F.struct(*by, *rest)).alias("_r"))
    return best.select(key, "_r.*")


def first_of(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The first row of each key in a given order, unlike a dedup that keeps any."""
    rest = [c for c in df.columns if c not in keys and c not in by]
    best = df.groupBy(*keys).agg(F.min(F.struct(*by, *rest)).alias("_r"))
    return best.select(*keys, "_r.*")


