"""The safety rules that an order passes before it is sent, by what was accepted before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import fold

STATE = "struct<verdict:string,times:array<bigint>,last:map<string,double>,held:map<string,double>,violations:int>"


@dataclass(frozen=True)
class Limits:
    """Limits of an account; ``rates`` are (most orders, seconds), ``symbols`` the tradable ones (empty: all)."""

    rates: tuple[tuple[int, int], ...] = ((5, 1), (60, 60), (500, 3600))
    symbols: tuple[str, ...] = ()
    min_price: float = 0.01
    max_price: float = 1_000_000.0
    max_change: float = 0.1
    min_qty: float = 0.00001
    max_qty: float = 100.0
    max_notional: float = 100_000.0
    max_position: float = 50_000.0
    max_violations: int = 100


def safety_verdicts(orders: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``verdict``: the first rule that an order breaks, or ``ok``, and ``violations`` so far.

    Expects (account, symbol, ts, id, price, qty) and, where trading pauses, a boolean ``halted``.  In
    order: kill_switch (after ``max_violations``), circuit_breaker, rate_limit, invalid_symbol,
    invalid_price, anomaly_detected (against the symbol's last accepted price), invalid_quantity,
    position_limit (notional of the symbol's accepted orders).  Only accepted orders count for rates,
    last prices and positions; the first three are no violations.  A rate's window holds both its
    ends.  A null symbol, price or quantity is invalid; orders without an account or a time are left out.

    An order's verdict depends on all before it, so an account's orders are folded in one task.
    """
    c = F.col
    halted = F.coalesce(c("halted"), F.lit(False)) if "halted" in orders.columns else F.lit(False)
    d = orders.where(c("account").isNotNull() & c("ts").isNotNull()).select(
        "account", F.struct("ts", "id").alias("at"), F.unix_micros(c("ts").cast("timestamp")).alias("micros"), "symbol", c("price").cast("double").alias("price"),
        c("qty").cast("double").alias("qty"), halted.alias("halted"),
    )
    longest = max(seconds for _, seconds in limits.rates)

    def step(s: Column, r: Column) -> Column:
        recent = F.filter(s["times"], lambda t: r["micros"] - t <= longest * 1_000_000)
        crowded = F.lit(False)
        for most, seconds in limits.rates:
            crowded = crowded | (F.size(F.filter(recent, lambda t: r["micros"] - t <= seconds * 1_000_000)) >= most)  # noqa: B023
        symbol = F.coalesce(r["symbol"], F.lit(""))
        known = r["symbol"].isNotNull() & (r["symbol"].isin(*limits.symbols) if limits.symbols else F.lit(True))
        last = F.try_element_at(s["last"], symbol)
        jump = F.when(last > 0, F.abs((r["price"] - last) / F.when(last > 0, last)) > limits.max_change)
        notional = r["price"] * r["qty"]
        position = F.coalesce(F.try_element_at(s["held"], symbol), F.lit(0.0)) + notional
        fine = lambda x: F.coalesce(x, F.lit(False))
        verdict = (
            F.when(s["violations"] >= limits.max_violations, "kill_switch").when(r["halted"], "circuit_breaker").when(crowded, "rate_limit").when(~known, "invalid_symbol")
            .when(~fine(r["price"].between(limits.min_price, limits.max_price)), "invalid_price").when(fine(jump), "anomaly_detected")
            .when(~fine(r["qty"].between(limits.min_qty, limits.max_qty)) | (notional > limits.max_notional), "invalid_quantity")
            .when(position > limits.max_position, "position_limit").otherwise("ok")
        )
        ok = verdict == "ok"
        put = lambda m, v: F.map_concat(F.map_filter(m, lambda k, _: k != symbol), F.create_map(symbol, v))
        violated = ~verdict.isin("ok", "kill_switch", "circuit_breaker", "rate_limit")
        return F.struct(
            verdict.alias("verdict"), F.when(ok, F.concat(recent, F.array(r["micros"]))).otherwise(recent).alias("times"),
            F.when(ok, put(s["last"], r["price"])).otherwise(s["last"]).alias("last"), F.when(ok, put(s["held"], position)).otherwise(s["held"]).alias("held"),
            (s["violations"] + violated.cast("int")).alias("violations"),
        ).cast(STATE)

    start = F.from_json(F.lit('{"times": [], "last": {}, "held": {}, "violations": 0}'), STATE)
    out = fold(d, ["micros", "symbol", "price", "qty", "halted"], start, step, "account", "at")
    return out.select("account", "symbol", c("at.ts").alias("ts"), c("at.id").alias("id"), "price", "qty", c("state.verdict").alias("verdict"), c("state.violations").alias("violations"))
