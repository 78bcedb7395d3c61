"""Queries on states: non-stationarity, hidden regimes, books, moving weights, weekly pauses, wavelets and replay logs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import log, ratio
from tidemark.functions.solar import sunset_seconds
from tidemark.functions.tables import shared_folder
from tidemark.operators import bars as B
from tidemark.operators import calendar as K
from tidemark.operators import ensemble as N
from tidemark.operators import manifold, regimes, wavelets
from tidemark.operators.safety import safety_verdicts
from tidemark.plans.bar_queries import BARS, RETS, TICKS, W
from tidemark.plans.flow_queries import tidy
from tidemark.sources import adapters as A
from tidemark.sources import replay
from tidemark.streaming.books import replay_books

C = F.col


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_returns(A.bars(spark, sf_dir))
    return b.select(
        "symbol", "open_time", "ret", ratio(C("high") - C("low"), C("close")).alias("spread"), ratio(C("taker_buy_base"), C("volume")).alias("flow"), log(C("volume")).alias("size"),
    )


def nonstationarity(spark, sf_dir):
    """How stationary each symbol's returns, ranges, flow and volumes are, and where their regime changes."""
    return tidy(manifold.nonstationarity(_features(spark, sf_dir), ["ret", "spread", "flow", "size"]))


def replayed_updates(updates: DataFrame) -> DataFrame:
    """Each symbol's first update as a snapshot, the others as updates after it."""
    first = updates.groupBy(C("symbol").alias("s")).agg(F.min("update_id").alias("begin"))
    joined = updates.join(first, C("symbol").eqNullSafe(C("s")))
    return joined.select(*updates.columns, F.when(C("update_id") == C("begin"), "snapshot").otherwise("update").alias("kind"))


def book_replay(spark, sf_dir):
    """Each symbol's book of twenty levels a side after a snapshot and all updates, and what became of the updates."""
    return tidy(replay_books(replayed_updates(A.book_updates(spark, sf_dir))))


def hidden_regimes(spark, sf_dir):
    """Three regimes of each symbol's returns and ranges, fitted on its first 70 % of bars, and the regime of each later bar."""
    b = B.split(_features(spark, sf_dir))
    models = regimes.fit(b.where("part = 'train'"), ["ret", "spread"], iterations=10)
    d = regimes.decode(b.where("part <> 'train'"), models, ["ret", "spread"], online=True)
    return tidy(d.select("symbol", "open_time", *[F.element_at("filtered", i + 1).alias(f"regime_{i}") for i in range(3)], "state", "path", "entropy", "change_probability"), 5)


#: Three simple models, one of each family.
FAMILIES = {"follow": "tree", "fade": "deep", "older": "agent"}


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.with_returns(A.bars(spark, sf_dir))
    return r.select("symbol", "open_time", C("ret").alias("actual"), B.back("ret").alias("follow"), (-B.back("ret")).alias("fade"), B.back("ret", 2).alias("older")).where("older is not null and follow is not null and actual is not null")


def hit_weights(spark, sf_dir):
    """Weights of three models by their last hundred outcomes."""
    return tidy(N.hit_weights(_guesses(spark, sf_dir), list(FAMILIES)))


def trading_gate(spark, sf_dir):
    """Predictions by weights that the regime adjusts, confidence in them, and the signals that pass the gate."""
    g = _guesses(spark, sf_dir)
    w = N.hit_weights(g, list(FAMILIES))
    # A prediction has the weights after the outcome before it.
    w = w.select("symbol", "open_time", *[F.coalesce(F.lag(f"weight_{m}").over(B.ordered()), F.lit(1 / len(FAMILIES))).alias(f"weight_{m}") for m in FAMILIES])
    n = manifold.nonstationarity(_features(spark, sf_dir), ["ret", "spread", "flow", "size"]).select("symbol", "open_time", "score", "regime_weight")
    d = N.regime_weights(g.join(w, ["symbol", "open_time"]).join(n, ["symbol", "open_time"]), FAMILIES)
    d = d.withColumn("prediction", sum((C(f"adjusted_{m}") * C(m) for m in list(FAMILIES)[1:]), C("adjusted_follow") * C("follow")))
    out = N.signal_gate(d, list(FAMILIES))
    return tidy(out.select("symbol", "open_time", "prediction", *[f"adjusted_{m}" for m in FAMILIES], "model_confidence", "confidence", "signal_confidence", "signal"))


def sabbath(spark, sf_dir):
    """Whether each tick falls in the weekly pause from Friday's to Saturday's sunset, and when that changes next."""
    return tidy(K.sabbath(A.ticks(spark, sf_dir).select("event_id", "symbol", "ts")), 0)


def wavelet_coefficients(spark, sf_dir):
    """Four levels of wavelet coefficients of each symbol's closes."""
    d = wavelets.decompose(A.bars(spark, sf_dir))
    return tidy(d.select("symbol", "level", C("i").alias("place"), C("a").alias("approximation"), C("d").alias("detail")))


def wavelet_denoised(spark, sf_dir):
    """Closes without small wavelet details."""
    return tidy(wavelets.denoised(A.bars(spark, sf_dir)))


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks in a replay log, a session a symbol, as read back; every 50th is lost on the way and every 40th written twice."""
    t = replay.numbered(A.ticks(spark, sf_dir).withColumn("session", C("symbol")))
    data = F.struct(C("price").cast("decimal(18,6)").alias("price"), F.struct(C("ts").alias("at"), F.array(C("qty").cast("decimal(38,0)")).alias("sizes")).alias("order"))
    t = t.select("event_id", "session", "seq", "ts", F.when(C("side") == 1, "buy").otherwise("sell").alias("type"), data.alias("data"))
    path = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    replay.write_log(t.where("event_id % 50 <> 0"), path)
    replay.write_log(t.where("event_id % 40 = 0 and event_id % 50 <> 0"), path)
    return replay.read_log(spark, path, t.schema["data"].dataType)


def replayed_ticks(spark, sf_dir):
    """Ticks written to a replay log and read back, each once, with exact decimals and times."""
    d = replay.once(_logged(spark, sf_dir))
    return d.select("session", "seq", "type", C("data.price").alias("price"), C("data.order.at").alias("at"), F.element_at("data.order.sizes", 1).cast("bigint").alias("qty"))


def sequence_gaps(spark, sf_dir):
    """Where the sequence numbers of a replay log jump."""
    return replay.gaps(_logged(spark, sf_dir))


def safety_chain(spark, sf_dir):
    """The first safety rule that each user's ticks, taken as orders, break."""
    users = A.table(spark, sf_dir, "events").select(C("event_id").alias("id"), C("user_id").alias("account"))
    return tidy(safety_verdicts(A.ticks(spark, sf_dir).withColumnRenamed("event_id", "id").join(users, "id")))


QUERIES = {f.__name__: f for f in (safety_chain, replayed_ticks, sequence_gaps, nonstationarity, book_replay, hidden_regimes, hit_weights, trading_gate, sabbath, wavelet_coefficients, wavelet_denoised)}

_SCORES = ", ".join(
    f"CASE WHEN count(*) OVER f >= 10 THEN 0.7 * avg(CAST(({m} >= 0) = (actual >= 0) AS DOUBLE)) OVER f + 0.3 / (1 + avg(({m} - actual) * ({m} - actual)) OVER f) ELSE 0.5::DOUBLE END AS {m}" for m in FAMILIES
)
_LOW, _HIGH = wavelets.filters("db4")
_TAPS = ", ".join(f"({j}, {a!r}, {b!r})" for j, (a, b) in enumerate(zip(_LOW, _HIGH, strict=True)))
_LEVELS = f"""{BARS}, taps(j, low, high) AS (VALUES {_TAPS}),
      l0 AS MATERIALIZED (SELECT symbol, open_time, close, CAST(row_number() OVER ({W}) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY symbol) AS n, close AS a FROM bars WHERE isfinite(close))""" + "".join(
    f""", p{k} AS (SELECT symbol, n, i, j, low, high, (((2 * i + 1 - j) % (2 * n)) + 2 * n) % (2 * n) AS p FROM (SELECT symbol, n, unnest(range((n + 7) // 2)) AS i FROM (SELECT DISTINCT symbol, n FROM l{k - 1})) CROSS JOIN taps),
      l{k} AS MATERIALIZED (SELECT p.symbol, (p.n + 7) // 2 AS n, p.i, sum(low * a) AS a, sum(high * a) AS d FROM p{k} p JOIN l{k - 1} x ON x.symbol = p.symbol AND x.i = CASE WHEN p.p < p.n THEN p.p ELSE 2 * p.n - 1 - p.p END GROUP BY ALL)"""
    for k in range(1, 5)
)
_RAISED = ", r4 AS (SELECT symbol, i, a FROM l4)" + "".join(
    f""", c{k} AS (SELECT l.symbol, l.i, r.a, sign(d) * greatest(abs(d) - 0.3 * max(abs(d)) OVER (PARTITION BY l.symbol), 0) AS d FROM l{k} l JOIN r{k} r ON r.symbol = l.symbol AND r.i = l.i),
      r{k - 1} AS MATERIALIZED (SELECT symbol, 2 * c.i + 1 - j AS i, sum(low * a + high * d) AS a FROM c{k} c CROSS JOIN taps GROUP BY ALL)"""
    for k in range(4, 0, -1)
)
_NUMBERED = f"{TICKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS seq FROM ticks), kept AS (SELECT * FROM numbered WHERE event_id % 50 <> 0)"
_SUNSET = lambda day: sunset_seconds(day, K.LATITUDE, K.LONGITUDE)
ORACLE_SQL = {
    "replayed_ticks": f"""WITH {_NUMBERED} SELECT symbol AS session, seq, CASE WHEN side = 1 THEN 'buy' ELSE 'sell' END AS type, CAST(price AS DECIMAL(18, 6)) AS price, ts AS at, qty FROM kept""",
    "sequence_gaps": f"""WITH {_NUMBERED}, g AS (SELECT symbol AS session, lag(seq) OVER (PARTITION BY symbol ORDER BY seq) AS after, seq AS before FROM kept)
      SELECT *, before - after - 1 AS missing FROM g WHERE before > after + 1""",
    "wavelet_coefficients": f"WITH {_LEVELS} "
    + " UNION ALL ".join(f"SELECT symbol, {k} AS level, i AS place, round(a, 6) AS approximation, round(d, 6) AS detail FROM l{k}" for k in range(1, 5)),
    "wavelet_denoised": f"""WITH {_LEVELS}{_RAISED} SELECT b.symbol, b.open_time, round(b.close, 6) AS close, round(r.a, 6) AS denoised
      FROM bars b LEFT JOIN l0 ON l0.symbol = b.symbol AND l0.open_time = b.open_time LEFT JOIN r0 r ON r.symbol = l0.symbol AND r.i = l0.i""",
    "hit_weights": f"""WITH RECURSIVE {RETS}, g AS (SELECT symbol, open_time, ret AS actual, lag(ret) OVER ({W}) AS follow, -lag(ret) OVER ({W}) AS fade, lag(ret, 2) OVER ({W}) AS older FROM rets),
      k AS (SELECT *, row_number() OVER ({W}) AS i FROM g WHERE older IS NOT NULL AND follow IS NOT NULL AND actual IS NOT NULL), s AS MATERIALIZED (SELECT symbol, open_time, i, {_SCORES} FROM k WINDOW f AS ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
      w AS (SELECT symbol, open_time, i, {', '.join(f'0.9::DOUBLE / 3 + 0.1::DOUBLE * {m} / (follow + fade + older) AS w_{m}' for m in FAMILIES)} FROM s WHERE i = 1
        UNION ALL SELECT s.symbol, s.open_time, s.i, {', '.join(f'0.9::DOUBLE * w_{m} + 0.1::DOUBLE * {m} / (follow + fade + older)' for m in FAMILIES)} FROM w JOIN s ON s.symbol = w.symbol AND s.i = w.i + 1)
      SELECT symbol, open_time, {', '.join(f'round(w_{m}, 6) AS weight_{m}' for m in FAMILIES)} FROM w""",
    "sabbath": f"""WITH {TICKS}, t AS (SELECT event_id, symbol, ts, epoch_us(ts) / 1e6 AS sec, CAST(floor((epoch_us(ts) / 1e6 + ({K.LONGITUDE * 240.0!r})) / 86400) AS INTEGER) AS d FROM ticks),
      f AS (SELECT *, d - (((d - 1) % 7) + 7) % 7 AS friday FROM t), p AS (SELECT friday, {_SUNSET('friday')} - {60 * K.BUFFER} AS pause, {_SUNSET('(friday + 1)')} AS resume, {_SUNSET('(friday + 7)')} - {60 * K.BUFFER} AS again FROM (SELECT DISTINCT friday FROM f))
      SELECT event_id, symbol, ts, CAST(sec >= pause AND sec <= resume AS INTEGER) AS paused, round(CASE WHEN sec >= pause AND sec <= resume THEN resume WHEN sec < pause THEN pause ELSE again END, 0) AS next_event FROM f JOIN p ON p.friday = f.friday""",
}
