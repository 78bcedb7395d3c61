import datetime
from decimal import Decimal

from pyspark.sql import types as T

from tidemark.sources import replay

AT = datetime.datetime(2024, 3, 1, 12, 0, 0, 123457)
DATA = (
    T.StructType().add("price", T.DecimalType(38, 18)).add("at", T.TimestampType()).add("local", T.TimestampNTZType()).add("note", "string")
    .add("levels", T.ArrayType(T.StructType().add("p", T.DecimalType(20, 8)).add("n", "integer"))).add("by", T.MapType(T.StringType(), T.DecimalType(38, 0)))
)
SCHEMA = T.StructType().add("session", "string").add("seq", "long").add("ts", "timestamp").add("type", "string").add("data", DATA)


def rows():
    big = (Decimal("12345678901234567890.123456789012345678"), AT, AT, 'say "x"\n', [(Decimal("0.00000001"), 1), (None, None)], {"k": Decimal(10) ** 37 + 1, "none": None})
    small = (Decimal("-0.1").quantize(Decimal(1).scaleb(-18)), None, None, None, [], {})
    return [("s1", 1, AT, "trade", big), ("s1", 2, AT + datetime.timedelta(hours=1), "depth", small), ("s1", 5, AT + datetime.timedelta(hours=2), "trade", None), ("s2", 1, AT, "trade", small)]


def plain(df):
    return sorted(((r.session, r.seq, r.ts, r.type, r.data and r.data.asDict(recursive=True)) for r in df.collect()), key=lambda r: r[:2])


def test_values_come_back_exactly(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame(rows(), SCHEMA)
    replay.write_log(events, path)
    replay.write_log(events.where("seq = 2"), path)
    (tmp_path / "log" / "session=s2" / "odd.json").write_text('{not json\n{"seq": 2, "ts": 7, "type": "trade", "data": {"price": 1.25, "at": "soon", "by": {"a": {"__decimal__": "x"}}}}\n')
    log = replay.read_log(spark, path, DATA)
    odd = next(r.data for r in log.collect() if r.session == "s2" and r.seq == 2)
    # Untagged numbers are taken; what is no time and no number is null.
    assert odd.price == Decimal("1.25") and odd.at is None and odd.by == {"a": None}
    log = log.where("not (session = 's2' and seq = 2)")
    assert log.count() == 5 and plain(replay.once(log)) == plain(events)
    got = lambda **k: [r[:2] for r in plain(replay.once(replay.read_log(spark, path, DATA, **k)))]
    assert got(sessions=["s1"], kinds=["trade"]) == [("s1", 1), ("s1", 5)]
    assert got(sessions=["s1"], start=AT + datetime.timedelta(hours=1), end=AT + datetime.timedelta(hours=1)) == [("s1", 2)]
    plan = replay.read_log(spark, path, DATA, sessions=["s1"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(session" in plan

    stream = replay.stream_log(spark, path, DATA, sessions=["s1"], files_a_batch=1)
    query = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert plain(spark.table("replayed")) == plain(events.where("session = 's1'"))


def test_gaps(spark):
    seqs = {"a": [1, 2, 2, 3, 7, 8, 20, None], "b": [5], None: [1, 3], "c": [10, 11, 12]}
    df = spark.createDataFrame([(s, n) for s, ns in seqs.items() for n in ns], "session string, seq bigint")
    for block in (4, 1_000_000):
        got = sorted((tuple(r) for r in replay.gaps(df, block).collect()), key=str)
        assert got == [("a", 3, 7, 3), ("a", 8, 20, 11), (None, 1, 3, 1)]
