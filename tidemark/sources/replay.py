"""Replay logs with exact values: tagged decimals and times, sequence numbers, batch and stream reads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.windows import running_total

#: Sequence numbers that one group looks at together, so a long session is many tasks.
BLOCK = 1_000_000
_TIMES = (T.TimestampType, T.TimestampNTZType)


def tagged(value: Column, kind: T.DataType) -> Column:
    """``value`` with each decimal as {"__decimal__": digits} and each time as {"__datetime__": ISO 8601}, at any depth.

    JSON numbers would lose digits and JSON has no times.  Nulls stay null, other values stay as they are.
    Times with a zone are written in UTC.
    """
    if isinstance(kind, T.DecimalType):
        return F.when(value.isNotNull(), F.struct(value.cast("string").alias("__decimal__")))
    if isinstance(kind, _TIMES):
        utc, end = (value, "") if isinstance(kind, T.TimestampNTZType) else (F.to_utc_timestamp(value, F.current_timezone()), "'Z'")
        return F.when(value.isNotNull(), F.struct(F.date_format(utc, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{end}").alias("__datetime__")))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[tagged(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: tagged(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: tagged(x, kind.valueType))
    return value


def tagged_type(kind: T.DataType) -> T.DataType:
    """The type to read tagged values of a type as: where a tag may stand, a VARIANT."""
    if isinstance(kind, (T.DecimalType, *_TIMES)):
        return T.VariantType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, tagged_type(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(tagged_type(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, tagged_type(kind.valueType))
    return kind


def untagged(value: Column, kind: T.DataType) -> Column:
    """Undoes ``tagged``, for values read as ``tagged_type``; numbers and times without a tag are taken too, what is neither is null."""
    if isinstance(kind, (T.DecimalType, *_TIMES)):
        tag = "__decimal__" if isinstance(kind, T.DecimalType) else "__datetime__"
        return F.coalesce(F.try_variant_get(value, f"$.{tag}", "string"), F.try_variant_get(value, "$", "string")).try_cast(kind)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[untagged(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: untagged(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: untagged(x, kind.valueType))
    return value


def numbered(events: DataFrame, session: str = "session", order: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds ``seq``: each session's events numbered from 1 in order, by counts of stretches of time."""
    return running_total(events, F.lit(1.0), "seq", session, order, tie).withColumn("seq", F.col("seq").cast("bigint"))


def write_log(events: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """Appends events (session, seq, ts, type, data) to a log of gzipped JSON lines, a folder a session.

    ``ts`` is written in microseconds since 1970 and ``data``, a struct, with tags.
    """
    data = tagged(F.col("data"), events.schema["data"].dataType)
    rows = events.select("session", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "type", data.alias("data"))
    rows.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", rows_a_file).partitionBy("session").json(path)


def _decoded(raw: DataFrame, data: T.StructType, sessions: Sequence[str], kinds: Sequence[str], start: datetime | None, end: datetime | None) -> DataFrame:
    rows = raw.where(F.col("session").isin(*sessions)) if sessions else raw
    rows = rows.where(F.col("type").isin(*kinds)) if kinds else rows
    for bound, keeps in ((start, F.col("ts").__ge__), (end, F.col("ts").__le__)):
        rows = rows.where(keeps(F.unix_micros(F.lit(bound).cast("timestamp")))) if bound else rows
    return rows.select("session", "seq", F.timestamp_micros("ts").alias("ts"), "type", untagged(F.col("data"), data).alias("data"))


def _schema(data: T.StructType) -> T.StructType:
    return T.StructType().add("seq", "long").add("ts", "long").add("type", "string").add("data", tagged_type(data)).add("session", "string")


def read_log(
    spark: SparkSession, path: str, data: T.StructType, sessions: Sequence[str] = (), kinds: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """The events of a log, of some sessions and kinds (none given: all), from ``start`` up to ``end``.

    ``data`` is the type the events had.  Sessions are folders, so others are not read; kinds and
    times are tested as lines are parsed.  Lines that are no JSON are left out.
    """
    raw = spark.read.schema(_schema(data)).option("mode", "DROPMALFORMED").json(path)
    return _decoded(raw, data, sessions, kinds, start, end)


def stream_log(
    spark: SparkSession, path: str, data: T.StructType, sessions: Sequence[str] = (), kinds: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None,
    files_a_batch: int = 1000, late: str = "1 hour",
) -> DataFrame:
    """``read_log`` as a stream: files once each, by the checkpoint of the query that reads it, and an event once.

    An event written again (the same session and seq) is left out while it comes within ``late`` of the first.
    """
    raw = spark.readStream.schema(_schema(data)).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).json(path)
    return _decoded(raw, data, sessions, kinds, start, end).withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "seq"])


def once(events: DataFrame) -> DataFrame:
    """Events written more than once (the same session and seq) once: that of the least time, then of the least data as JSON."""
    others = [c for c in events.columns if c not in ("session", "seq")]
    first = F.min_by(F.struct(*others), F.struct(F.col("ts"), F.col("type"), F.to_json("data")))
    return events.groupBy("session", "seq").agg(first.alias("_row")).select("session", "seq", "_row.*")


def gaps(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (session, after, before, missing): where a session's sequence numbers jump, and by how many.

    Numbers are compared within blocks of ``block``, and a block's first with the last of the block
    before it that has any.  Repeated numbers count once, null ones not at all; what is missing
    before the first or after the last number cannot be known.
    """
    seen = events.where("seq is not null").select("session", "seq").distinct().withColumn("_block", F.floor(F.col("seq") / block))
    bounds = seen.groupBy(F.col("session").alias("_s"), F.col("_block").alias("_b")).agg(F.max("seq").alias("_last"))
    bounds = bounds.withColumn("_before", F.lag("_last").over(Window.partitionBy("_s").orderBy("_b"))).drop("_last")
    d = seen.join(bounds, F.col("session").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    after = F.coalesce(F.lag("seq").over(Window.partitionBy("session", "_block").orderBy("seq")), F.col("_before"))
    d = d.select("session", after.alias("after"), F.col("seq").alias("before"))
    return d.where("before > after + 1").withColumn("missing", F.col("before") - F.col("after") - 1)
