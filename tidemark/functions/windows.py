"""Windows over one symbol's rows in order: rolling frames, fills, islands, folds, as-of joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "symbol", "open_time"


def ordered(key: str | Sequence[str] = KEY, order: str | Sequence[str] = ORDER) -> WindowSpec:
    """Rows of a key in order."""
    keys = [key] if isinstance(key, str) else list(key)
    by = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*by)


def frame(rows: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last ``rows`` rows, the current one included."""
    return (w or ordered()).rowsBetween(-(rows - 1), 0)


def so_far(w: WindowSpec | None = None) -> WindowSpec:
    """All rows up to the current one."""
    return (w or ordered()).rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Callable[[Column], Column], x: Column, rows: int, w: WindowSpec | None = None) -> Column:
    """A rolling aggregate that is null until ``rows`` values are not null."""
    f = frame(rows, w)
    return F.when(F.count(x).over(f) == rows, agg(x).over(f))


def blocked_mean(x: Column, rows: int, w: WindowSpec | None = None, block: int = 16) -> Column:
    """The mean of the last ``rows`` values, null until so many are not null, added up by blocks of ``block`` rows counted from the key's first.

    The values before the first whole block are added one by one, then the sum of each whole block,
    then the values after the last.  Sums in another order may differ in their last bits, so that
    means which are compared with one another must all be added in one known order.
    """
    w = w or ordered()
    values = F.collect_list(x).over(frame(rows, w))
    total = lambda start, part: F.aggregate(part, start, lambda a, v: a + v)
    ahead = F.least(F.pmod(rows - F.row_number().over(w), F.lit(block)), F.lit(rows))
    whole = F.floor((rows - ahead) / block).cast("int")
    sums = F.transform(F.slice(F.sequence(F.lit(0), F.lit(rows // block)), F.lit(1), whole), lambda i: total(F.lit(0.0), F.slice(values, ahead + i * block + 1, F.lit(block))))
    added = total(total(total(F.lit(0.0), F.slice(values, F.lit(1), ahead)), sums), F.slice(values, ahead + whole * block + 1, F.lit(rows)))
    return F.when(F.size(values) == rows, added / rows)


def back(x: Column | str, rows: int = 1, w: WindowSpec | None = None) -> Column:
    """The value some rows earlier."""
    return F.lag(x, rows).over(w or ordered())


def forward_fill(x: Column, w: WindowSpec | None = None) -> Column:
    """The last value that is not null, up to the current row."""
    return F.last(x, ignorenulls=True).over(so_far(w))


def backward_fill(x: Column, w: WindowSpec | None = None) -> Column:
    """The next value that is not null, from the current row on."""
    return F.first(x, ignorenulls=True).over((w or ordered()).rowsBetween(0, Window.unboundedFollowing))


def run_length(df: DataFrame, value: Column, out: str, w: WindowSpec | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Adds the number of rows in a row, the current one included, that have the same value."""
    w = w or ordered(key, order)
    df = df.withColumn("_value", value)
    change = F.when(F.col("_value").eqNullSafe(F.lag("_value").over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    df = df.withColumn("_change", change).withColumn("_island", F.sum("_change").over(so_far(w)))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key, "_island").orderBy(order))).drop("_value", "_change", "_island")


def fold(
    df: DataFrame,
    fields: Sequence[str],
    state: Column,
    step: Callable[[Column, Column], Column],
    key: str = KEY,
    order: str = ORDER,
) -> DataFrame:
    """Runs an order-dependent recursion over each key's rows; one row with all states per input row.

    ``step`` maps (state, row) to the next state.  Returns key, order, the fields and ``state``.  A
    key's rows are gathered in one array of the named fields alone, so a key's history must fit in
    a task: bars, not ticks, are meant for this.  Rows are folded in blocks, so that appending
    states copies blocks of them and not all.
    """
    block = 256
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *fields)))
    gathered = df.groupBy(key).agg(rows.alias("rows"))
    none = F.transform(F.slice("rows", 1, 0), lambda r: step(state, r))
    last = F.floor((F.size("rows") - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("rows", i * block + 1, F.lit(block)))

    def through(done: Column, part: Column) -> Column:
        before = F.coalesce(F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(-1)), state)
        return F.aggregate(part, none, lambda acc, r: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), before), r))))

    states = F.flatten(F.aggregate(blocks, F.slice(F.array(none), 1, 0), lambda done, part: F.concat(done, F.array(through(done, part)))))
    out = gathered.select(key, F.explode(F.arrays_zip(F.col("rows").alias("row"), states.alias("state"))).alias("x"))
    return out.select(key, F.col("x.row.o").alias(order), *[F.col(f"x.row.{f}").alias(f) for f in fields], F.col("x.state").alias("state"))


def as_of(left: DataFrame, right: DataFrame, values: Sequence[str], key: str = KEY, order: str = "ts", strict: bool = False) -> DataFrame:
    """Joins each left row with the right row of its key that is latest at its time.

    A union and one window: a single exchange by key, and no pairs of rows.  ``strict`` takes
    earlier rows alone.  Of right rows at the same time the one of greatest values counts.
    """
    picked = F.struct(*[F.col(v) for v in values])
    side = 0 if strict else 1
    l_cols = [c for c in left.columns if c not in (key, order)]
    a = left.select(key, order, F.struct(*l_cols).alias("_row"), F.lit(None).alias("_right"), F.lit(side).alias("_side"))
    b = right.select(key, order, F.lit(None).alias("_row"), picked.alias("_right"), F.lit(1 - side).alias("_side"))
    w = Window.partitionBy(key).orderBy(order, "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_row is not null")
    return joined.select(key, order, "_row.*", *[F.col(f"_right.{v}").alias(f"right_{v}") for v in values])


def stretched(df: DataFrame, key: str = KEY, order: str = "ts", rows: int = 1_000_000) -> DataFrame:
    """Adds ``_stretch`` (int) and ``_begin`` (microseconds): each key's time cut into equal parts, as many as it has times ``rows`` rows.

    Keys, counts and time bounds are one small table, one row a key.  Rows without a time are in the first.
    """
    at = F.unix_micros(F.col(order).cast("timestamp"))
    bounds = df.groupBy(F.col(key).alias("_k")).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count("*").alias("_n"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / rows))).cast("bigint")
    bounds = bounds.select("_k", "_lo", width.alias("_width"))
    joined = df.join(bounds, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_stretch", F.coalesce(F.floor((at - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("int"))
    return joined.withColumn("_begin", F.col("_lo") + F.col("_stretch") * F.col("_width")).drop("_k")


def by_stretches(
    df: DataFrame, operator: Callable[[DataFrame], DataFrame], reach: int, key: str = KEY, order: str = "ts", tie: str = "event_id", rows: int = 1_000_000
) -> DataFrame:
    """Applies ``operator``, whose windows by ``key`` look back at most ``reach`` rows, to stretches of each key's time.

    A key of many rows is so many tasks instead of one.  Each stretch gets, besides its own rows, the
    ``reach`` rows before it, from as many earlier stretches as hold them; what the operator makes
    of those is left out again.  While it runs, the key is a struct of the key and the stretch's
    begin.  Rows without a time come first.  The operator must keep ``key`` and ``order``, and be one row for one row.
    """
    d = stretched(df, key, order, rows)
    counts = d.groupBy(key, "_stretch").agg(F.count("*").alias("_c"), F.first("_begin").alias("_b"))
    w = Window.partitionBy(key).orderBy("_stretch")
    counts = counts.withColumn("_end", F.sum("_c").over(so_far(w)))
    ahead = F.collect_list(F.struct(F.col("_b").alias("b"), (F.col("_end") - F.col("_c")).alias("start"))).over(w.rowsBetween(1, max(reach, 1)))
    counts = counts.withColumn("_later", F.filter(ahead, lambda x: x["start"] - F.col("_end") < reach))
    counts = counts.select(F.col(key).alias("_k"), F.col("_stretch").alias("_s"), "_end", "_later")
    d = d.join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_s")))
    left = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(F.desc_nulls_last(order), F.desc_nulls_last(tie)))
    d = d.withColumn("_left", left)
    wanted = F.transform(F.filter("_later", lambda x: x["start"] - F.col("_end") + F.col("_left") <= reach), lambda x: x["b"])
    d = d.withColumn("_to", F.explode(F.concat(F.array("_begin"), wanted))).withColumn(key, F.struct(F.col(key).alias("key"), F.col("_to").alias("begin"), F.col("_to").eqNullSafe(F.col("_lo")).alias("first")))
    out = operator(d.select(*df.columns))
    at = F.unix_micros(F.col(order).cast("timestamp"))
    own = F.when(at.isNull(), F.col(key)["first"]).otherwise(at >= F.col(key)["begin"])
    return out.where(own).withColumn(key, F.col(key)["key"])


def running_total(df: DataFrame, value: Column, name: str, key: str = KEY, order: str = "ts", tie: str = "event_id", rows: int = 1_000_000) -> DataFrame:
    """Adds the sum of ``value`` over a key's rows up to each: sums of stretches, their running sum, and the sum within the stretch."""
    d = stretched(df.withColumn("_value", value), key, order, rows)
    sums = d.groupBy(key, "_stretch").agg(F.sum("_value").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select(F.col(key).alias("_k"), F.col("_stretch").alias("_s"), before.alias("_before"))
    d = d.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_s")))
    within = F.sum("_value").over(so_far(Window.partitionBy(key, "_stretch").orderBy(order, tie)))
    return d.withColumn(name, F.col("_before") + within).select(*df.columns, name)
