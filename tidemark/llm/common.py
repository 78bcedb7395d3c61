"""Helpers shared by the corpus operators: tables, written intermediates, components."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session names one.  Where it is unset, a local session,
    as in tests, makes a temporary folder once and stores it in its configuration; a cluster's
    executors would not share that folder, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.scratch.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("tidemark.scratch.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only the tasks that ran on it, since the files
    are in the folder that all executors share.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a, b) of long ids.

    Returns (node, component), component being the smallest id of the component, for every
    node that has an edge to another node.  Alternates large-star and small-star steps until
    the edges no longer change: each step is a min aggregation, which combines on the map side,
    and an equi-join, which Spark may split where one node holds most edges.  Edges are written
    to the shared folder after each round; only a pair of checksums comes to the driver.
    Null ids and self-links are left out; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each larger neighbour of a node is linked to the node's least neighbour.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours are linked to the least of them.
        down = e.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        e = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        e = stored(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    node = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return node.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def sorted_groups(batches: Iterator, keys: int) -> Iterator:
    """The groups of two rows or more of sorted Arrow batches, as tables.

    Rows are sorted by their first ``keys`` columns, numbers without nulls; a group may go on in
    the next batch.
    """
    import numpy as np
    import pyarrow as pa

    held: list = []
    held_key = None

    def whole() -> Iterator:
        if sum(b.num_rows for b in held) > 1:
            yield pa.Table.from_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], 1)
        cuts = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
        for a, b in itertools.pairwise([0, *cuts, len(key)]):
            if held_key is not None and (key[a] != held_key).any():
                yield from whole()
                held = []
            held_key = key[a]
            held.append(batch.slice(a, b - a))
    yield from whole()


def whole_groups(batches: Iterator, keys: int) -> Iterator:
    """Tables of sorted Arrow batches that hold whole groups, many at a time, with the rows at which groups start.

    Rows are sorted by their first ``keys`` columns, numbers without nulls.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        key = np.stack([table.column(k).to_numpy() for k in range(keys)], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if len(cuts):
            yield table.slice(0, cuts[-1]), np.concatenate(([0], cuts[:-1]))
            held = table.slice(cuts[-1])
        else:
            held = table
    if held is not None:
        yield held, np.array([0])


def tiled(rows: DataFrame, bucket: str, node: str, tile: int, target: Column | None = None) -> DataFrame:
    """Deals rows into tiles of their buckets, so that no group has many more than ``tile`` rows a side.

    Adds ``i``, ``j`` (int), ``query`` and ``target`` (boolean).  Each query of a bucket meets each
    target in one tile; a bucket of up to ``tile`` rows is one tile, where all rows are queries.
    ``target`` tells which rows are targets (all, if None).
    """
    target = F.lit(True) if target is None else target
    hot = rows.groupBy(bucket).agg(F.count("*").alias("n")).where(F.col("n") > tile)
    hot = stored(hot.select(F.col(bucket).alias("hot"), F.ceil(F.col("n") / tile).cast("int").alias("k")), "hot")
    dealt = rows.join(hot, F.col(bucket) == F.col("hot"), "left").withColumn("is_target", target)
    own = F.pmod(F.xxhash64(node), F.col("k")).cast("int")
    yes, no, zero, last = F.lit(True), F.lit(False), F.lit(0), F.col("k") - 1

    def place(i: Column, j: Column, query: Column, targets: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), query.alias("query"), targets.alias("target"))

    across = F.transform(F.sequence(zero, last), lambda j: place(own, j, yes, (j == own) & F.col("is_target")))
    down = F.transform(F.filter(F.sequence(zero, last), lambda i: (i != own) & F.col("is_target")), lambda i: place(i, own, no, yes))
    places = F.when(F.col("k").isNull(), F.array(place(zero, zero, yes, F.col("is_target")))).otherwise(F.concat(across, down))
    out = dealt.withColumn("place", F.explode(places))
    return out.select(*rows.columns, "place.i", "place.j", "place.query", "place.target")
