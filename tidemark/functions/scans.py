"""Recursions along a key's rows, computed by blocks of time so that a long key is many tasks.

A recursion whose steps compose, such as s = a s + b or a product of matrices, need not run along
all rows in one task: each block of rows reduces to one composed step (``part``), a scan over these
few gives the state at which each block begins (``carry``), and all blocks then run at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A day of hourly bars times 28: the rows of a block are what one task holds at a time.
WIDTH = 28 * 24 * 3600


def in_blocks(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], width: int = WIDTH) -> DataFrame:
    """One row per key and block of ``width`` seconds: keys, block, first, last, at (microseconds), x (the columns' values, row after row).

    Rows that lack a value, or whose value is not a finite number, are left out.  Rows of one time
    are ordered by their values.  ``first`` and ``last`` tell a key's first and last block.  A block
    is gathered in one task, a key is not.
    """
    at = F.unix_micros(F.col(order).cast("timestamp"))
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    rows = df.where(F.coalesce(fine, F.lit(False)) & F.col(order).isNotNull())
    one = F.struct(at.alias("o"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    held = rows.groupBy(*keys, F.floor(at / (width * 1_000_000)).alias("block")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    w = Window.partitionBy(*keys)
    return held.select(
        *keys, "block", (F.col("block") == F.min("block").over(w)).alias("first"), (F.col("block") == F.max("block").over(w)).alias("last"),
        F.col("r.o").alias("at"), F.flatten("r.x").alias("x"),
    )


def over_blocks(df: DataFrame, run: Callable[[dict], Sequence[dict]], schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Applies ``run`` to each row as a dict, lists as numpy arrays, and returns the dicts that it gives.

    Each batch holds few rows, as each is a block.
    """
    names = df.columns

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = {}
                for n, column in zip(names, batch.columns, strict=True):
                    x = column[i]
                    row[n] = x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) and x.is_valid else x.as_py()
                for out in run(row):
                    yield pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in (out | {k: row[k] for k in keep}).items()}], schema=_arrow(schema_))

    schema_ = _struct(df, schema, keep)
    return df.mapInArrow(blocks, schema_)


def _struct(df: DataFrame, schema: str, keep: Sequence[str]):  # noqa: ANN202
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    return StructType([df.schema[k] for k in keep] + made.fields)


def _arrow(schema):  # noqa: ANN001, ANN202
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def carried(parts: DataFrame, keys: Sequence[str], step: Callable[[np.ndarray, np.ndarray], np.ndarray], start: Callable[[np.ndarray], np.ndarray], backward: bool = False) -> DataFrame:
    """The state before each block: keys, block, carry.

    ``parts`` has keys, block and part (array<double>).  Along a key's blocks, in order or ``backward``,
    the state begins as ``start(part)`` and goes on as ``step(state, part)``.  There is one row per block, of
    bounded size; a task holds one state at a time.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        here, state = None, None
        for batch in batches:
            carries = []
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in range(len(keys)))
                part = batch.column(len(keys) + 1)[i].values.to_numpy(zero_copy_only=False)
                if key != here or state is None:
                    here, state = key, start(part)
                carries.append(state.tolist())
                state = step(state, part)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(carries, pa.list_(pa.float64()))], names=[*keys, "block", "carry"])

    order = F.desc("block") if backward else F.asc("block")
    rows = parts.select(*keys, "block", "part").repartition(*keys).sortWithinPartitions(*keys, order)
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in [*keys, "block"]) + ", carry array<double>")


def with_carry(blocks: DataFrame, carries: DataFrame, keys: Sequence[str], name: str = "carry") -> DataFrame:
    """Blocks with the state at which each begins."""
    on = F.lit(True)
    c = carries.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "block"]], F.col("carry").alias(name))
    for k in [*keys, "block"]:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return blocks.join(c, on).drop(*[f"_{k}" for k in [*keys, "block"]])


def linear(
    df: DataFrame, key: str, order: str, columns: Sequence[str], step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], begin: Callable[[np.ndarray], np.ndarray], names: Sequence[str], width: int = WIDTH
) -> DataFrame:
    """Runs s = A s + b along each key's rows, by blocks: key, order, columns, and the state after each row as ``names``.

    ``step`` maps rows' values (n, columns) to A (n, m, m) and b (n, m); ``begin`` gives the state
    after a key's first row from its values.  Rows without finite values are left out.
    """
    m, d = len(names), len(columns)

    def local(row: dict) -> tuple[np.ndarray, np.ndarray]:
        x = row["x"].reshape(-1, d)
        a, b = step(x)
        if row["first"]:
            a, b = a.copy(), b.copy()
            a[0], b[0] = 0.0, begin(x[0])
        return a, b

    def part(row: dict) -> list[dict]:
        a, b = local(row)
        whole, rest = np.eye(m), np.zeros(m)
        for x, y in zip(a, b, strict=True):
            whole, rest = x @ whole, x @ rest + y
        return [{"block": row["block"], "part": np.concatenate([whole.ravel(), rest])}]

    def rows(row: dict) -> list[dict]:
        a, b = local(row)
        s, out = row["carry"], np.empty_like(b)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            s = x @ s + y
            out[i] = s
        values = row["x"].reshape(-1, d)
        return [{"at": row["at"], **{f"x{i}": values[:, i] for i in range(d)}, **{f"s{i}": out[:, i] for i in range(m)}}]

    blocks = in_blocks(df, [key], order, columns, width)
    carries = carried(over_blocks(blocks, part, "block bigint, part array<double>", [key]), [key], lambda s, p: p[: m * m].reshape(m, m) @ s + p[m * m :], lambda _: np.zeros(m))
    fields = [*[f"x{i}" for i in range(d)], *[f"s{i}" for i in range(m)]]
    done = over_blocks(with_carry(blocks, carries, [key]), rows, "at array<bigint>, " + ", ".join(f"{f} array<double>" for f in fields), [key])
    out = done.select(key, F.explode(F.arrays_zip("at", *fields)).alias("r"))
    return out.select(key, F.timestamp_micros("r.at").cast(df.schema[order].dataType).alias(order), *[F.col(f"r.{f}").alias(n) for f, n in zip(fields, [*columns, *names], strict=True)])


def fading(alphas: Sequence[float], gains: Sequence[float]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Steps of independent recursions s = alpha s + gain x of one column."""
    a, g = np.diag(np.asarray(alphas, float)), np.asarray(gains, float)
    return lambda x: (np.repeat(a[None], len(x), 0), x[:, :1] * g)
