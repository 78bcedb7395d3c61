"""Order books as keyed state: snapshots, updates in order, bounded depth, daily counts, recovery."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

DEPTH = 20
DAY = 24 * 3600 * 1000
LEVEL = "book_side string, price double"
COUNTS = "last_update_id bigint, ready boolean, applied bigint, stale bigint, ignored bigint, today bigint, day bigint"
BOOK = "symbol string, last_update_id bigint, best_bid double, best_ask double, bid_levels int, ask_levels int, applied bigint, stale bigint, ignored bigint, applied_today bigint"
_TYPES = {"string": StringType(), "bigint": LongType(), "double": DoubleType(), "int": IntegerType()}
ROW = StructType([StructField(f.split()[0], _TYPES[f.split()[1]]) for f in BOOK.split(", ")])
NAMES = ROW.names
ORDER = ["update_id", "kind", "book_side", "price", "qty"]
VALUES = ["book_side", "price", "qty", "at"]
#: Where streams with this state keep it: the map and value state need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Side:
    """One side of a book: prices in order, best first, cut to a depth."""

    def __init__(self, bid: bool, levels: dict[float, float]):
        self.sign, self.qty = -1 if bid else 1, dict(levels)
        self.order = sorted(self.sign * p for p in levels)

    def put(self, price: float, qty: float) -> None:
        """Sets a level; a quantity that is not above 0 takes it away."""
        if qty > 0:
            if price not in self.qty:
                insort(self.order, self.sign * price)
            self.qty[price] = qty
        elif self.qty.pop(price, None) is not None:
            self.order.remove(self.sign * price)

    def cut(self, depth: int) -> None:
        """Leaves out the levels beyond the depth; they do not come back by themselves."""
        for p in self.order[depth:]:
            del self.qty[self.sign * p]
        del self.order[depth:]

    def best(self) -> float | None:
        return self.sign * self.order[0] if self.order else None


class Book:
    """A symbol's two sides and its counts; a snapshot replaces it, an update counts after one if its number is above the last."""

    def __init__(self, depth: int, levels: list = (), counts: tuple = (-1, False, 0, 0, 0, 0, -1)):
        self.depth = depth
        self.last, self.ready, self.applied, self.stale, self.ignored, self.today, self.day = counts
        self._fill(levels)

    def _fill(self, levels: list) -> None:
        self.sides = {s: Side(s == "bid", {p: q for side, p, q in levels if side == s and q > 0}) for s in ("bid", "ask")}
        for side in self.sides.values():
            side.cut(self.depth)

    def take(self, number: int, kind: str, rows: list) -> None:
        """All rows (side, price, quantity, milliseconds) of one number."""
        known = lambda x: x is not None and x == x
        levels = [(s, float(p), float(q)) for s, p, q, _ in rows if s in self.sides and known(p) and known(q)]
        day = max((int(t // DAY) for *_, t in rows if known(t)), default=self.day)
        if day > self.day:
            self.today, self.day = 0, day
        if kind == "snapshot":
            self._fill(levels)
            self.last, self.ready = number, True
        elif not self.ready:
            self.ignored += 1
        elif number <= self.last:
            self.stale += 1
        else:
            for side, price, qty in levels:
                self.sides[side].put(price, qty)
            for side in self.sides.values():
                side.cut(self.depth)
            self.last, self.applied, self.today = number, self.applied + 1, self.today + 1

    def levels(self) -> dict[tuple[str, float], float]:
        return {(s, p): q for s, side in self.sides.items() for p, q in side.qty.items()}

    def counts(self) -> tuple:
        return self.last, self.ready, self.applied, self.stale, self.ignored, self.today, self.day

    def row(self, symbol: str) -> tuple:
        bid, ask = self.sides["bid"], self.sides["ask"]
        return symbol, self.last, bid.best(), ask.best(), len(bid.order), len(ask.order), self.applied, self.stale, self.ignored, self.today


class BookProcessor(StatefulProcessor):
    """Keeps each symbol's ``Book`` in state: a map of levels and one value of counts.

    The levels of one update have its number and come in one micro-batch.  Levels are held sorted
    while a batch runs, and only those that changed go back to the state.  ``applied_today`` starts
    again at midnight (UTC): by the rows' own times, and by a timer where no rows come.
    """

    def __init__(self, depth: int = DEPTH):
        self.depth = depth

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.levels = handle.getMapState("levels", LEVEL, "qty double")
        self.counts = handle.getValueState("counts", COUNTS)

    def _load(self) -> Book:
        held = [(side, price, qty) for (side, price), (qty,) in self.levels.iterator()]
        self.before = {(s, p): q for s, p, q in held}
        return Book(self.depth, held, *([tuple(self.counts.get())] if self.counts.exists() else []))

    def _keep(self, book: Book) -> None:
        now = book.levels()
        for k in self.before.keys() - now.keys():
            self.levels.removeKey(k)
        for k, q in now.items():
            if self.before.get(k) != q:
                self.levels.updateValue(k, (q,))
        self.counts.update(book.counts())

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        import pandas as pd

        book = self._load()
        pdf = pd.concat(list(rows)).sort_values(ORDER, kind="stable")
        pdf = pdf[pdf["update_id"].notna()]
        for (number, kind), own in _runs([pdf[c].tolist() for c in ["update_id", "kind", *VALUES]], 2):
            book.take(int(number), kind, own)
        self._keep(book)
        if book.day >= 0:
            due = (book.day + 1) * DAY
            if due not in set(self.handle.listTimers()):
                self.handle.registerTimer(due)
        yield _frame(book.row(key[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: ANN001, N802, N803
        book = self._load()
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY
        if book.day < day:
            book.today, book.day = 0, day
            self.counts.update(book.counts())
        yield _frame(book.row(key[0]))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        book = self._load()
        rows = zip(*[initialState[c] for c in VALUES[:3]], strict=True)
        book.take(int(initialState["update_id"].max()), "snapshot", [(*r, float("nan")) for r in rows])
        self._keep(book)

    def close(self) -> None:
        pass


def _frame(row: tuple):  # noqa: ANN202
    import pandas as pd

    return pd.DataFrame([row], columns=NAMES).astype({"symbol": object})


def _runs(columns: list[list], keys: int) -> Iterator:
    """Successive rows of equal first ``keys`` values: the key and the other values."""
    for key, rows in groupby(zip(*columns, strict=True), key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in rows]


def _input(updates: DataFrame) -> DataFrame:
    kind = F.coalesce("kind", F.lit("update")) if "kind" in updates.columns else F.lit("update")
    return updates.select("symbol", kind.alias("kind"), "update_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "book_side", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"))


def stream_books(updates: DataFrame, depth: int = DEPTH, late: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Each symbol's book after each micro-batch.

    ``updates`` is a stream of symbol, update_id, ts (timestamp), book_side (bid or ask), price, qty
    and, where it holds snapshots, kind (``snapshot`` or ``update``).  Rows that are later than the
    watermark are dropped.  ``initial`` has symbol, update_id, book_side, price and qty, at most ``depth``
    levels a side: a book to begin with, such as ``recovered_levels`` gives.  Rows without an update
    number, side, price or quantity change nothing.  The session must use the store named in ``STORE``.
    """
    keyed = _input(updates).withWatermark("ts", late).groupBy("symbol")
    start = None if initial is None else initial.select("symbol", "update_id", "book_side", "price", "qty").groupBy("symbol")
    return keyed.transformWithStateInPandas(BookProcessor(depth), BOOK, "update", "eventTime", start)


def replay_books(updates: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The same over a table: each symbol's book after all its updates, in order of their numbers.

    Cutting a side to its depth makes the book depend on the order of all updates, so a symbol's
    updates pass through one task, as sorted batches; what is held is the book.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        def done(book: Book, symbol: str):  # noqa: ANN202
            return pa.RecordBatch.from_pylist([dict(zip(NAMES, book.row(symbol), strict=True))], schema=to_arrow_schema(schema))

        # A symbol's update may go on in the next batch: its rows wait until another begins.
        symbol, book, at, waiting = None, None, None, []
        for batch in batches:
            for (name, number, kind), own in _runs([batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ["symbol", "update_id", "kind", *VALUES]], 3):
                if book is not None and (name, number, kind) != (symbol, *at):
                    book.take(at[0], at[1], waiting)
                    waiting = []
                    if name != symbol:
                        yield done(book, symbol)
                        book = None
                symbol, book, at = name, book or Book(depth), (number, kind)
                waiting += own
        if book is not None:
            book.take(at[0], at[1], waiting)
            yield done(book, symbol)

    schema = ROW
    ordered = _input(updates).where("update_id is not null").repartition("symbol").sortWithinPartitions("symbol", *ORDER)
    return ordered.drop("ts").mapInArrow(run, BOOK)


def recovered_levels(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The levels of all books in a stopped stream's last checkpoint: symbol, update_id, book_side, price, qty.

    It reads the state itself, so a new stream, of another depth for instance, can start from it.
    """
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    levels = state("levels").select(F.col("key.symbol").alias("symbol"), "user_map_key.*", F.col("user_map_value.qty").alias("qty"))
    last = state("counts").select(F.col("key.symbol").alias("symbol"), F.col("value.last_update_id").alias("update_id"))
    return levels.join(last, "symbol").select("symbol", "update_id", "book_side", "price", "qty")
