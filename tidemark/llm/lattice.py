"""Near-duplicate embeddings by hashing to points of the E8 lattice."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, sorted_groups, stored, table, tiled

MIN_COSINE = 0.9
#: Tables, neighbouring cells probed in each, and the lattice's scale against unit vectors.  Pairs
#: of cosine 0.9 meet in some table in 99 of 100 cases, pairs of 0.97 practically always.
TABLES, PROBES, SCALE = 6, 4, 1.5
#: Vectors of a bucket that one group holds on each side; larger buckets are dealt into tiles.
TILE = 1024
SEED = 29


def lattice_roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to a cell's nearest neighbours."""
    roots = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            roots.append(v)
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(roots + [np.array(s) for s in halves])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where the sum is odd, the coordinate furthest
    from its integer goes to the next one."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(1) % 2 != 0
    at = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    near[rows, at[rows]] += np.where(off[rows, at[rows]] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of D8 or of D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((np.square(x - a).sum(1) <= np.square(x - b).sum(1))[:, None], a, b)


def lattice_codes(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Hashes of each unit vector's cell and of the neighbouring cells nearest to it, as an array
    (vector, table, 1 + probes) of int64."""
    roots = lattice_roots()
    n, d = unit.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    mixer = np.random.default_rng(seed).integers(-(2**62), 2**62, size=8) | 1
    for t in range(tables):
        turn = np.random.default_rng([seed, t, d]).normal(size=(d, 8)) / scale
        x = unit @ turn
        home = nearest_e8(x)
        nearest = np.argsort(-((x - home) @ roots.T), axis=1, kind="stable")[:, :probes]
        cells = np.concatenate([home[:, None], home[:, None] + roots[nearest]], axis=1)
        with np.errstate(over="ignore"):
            h = ((2 * cells).astype(np.int64) * mixer).sum(-1) + np.int64(t * 1_000_003 + d)
            h = (h ^ (h >> 31)) * np.int64(-7046029254386353131)
            out[:, t] = h ^ (h >> 29)
    return out


def _coded(tables: int, probes: int, scale: float, seed: int):
    """A row for each vector, table and cell: its own cell (home) or a probed one."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column(2)
                lengths = np.asarray(lists.value_lengths())
                for d in np.unique(lengths):
                    own = np.flatnonzero(lengths == d)
                    x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    codes = lattice_codes(x / np.linalg.norm(x, axis=1)[:, None], tables, probes, scale, seed)
                    per = tables * (1 + probes)
                    rows = np.repeat(np.arange(len(own)), per)
                    ids = batch.column(0).take(pa.array(own[rows]))
                    weights = batch.column(1).take(pa.array(own[rows]))
                    raw = pa.array([v.astype("<f8").tobytes() for v in x], pa.binary()).take(pa.array(rows))
                    all_codes = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(rows))
                    t = np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(own))
                    home = np.tile(np.arange(per) % (1 + probes) == 0, len(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes.reshape(-1)), pa.array(t), pa.array(home), ids, weights, raw, all_codes],
                        names=["cell", "t", "home", "id", "weight", "vector", "codes"],
                    )

    return run


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links a - b among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(min_cosine: float, tables: int, probes: int):
    """For each tile the number of links it finds first, by vector, and links that span them."""

    def tile(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        ids, t = rows["id"], int(rows["t"][0])
        query, target = np.flatnonzero(rows["query"]), np.flatnonzero(rows["target"])
        if not len(query) or not len(target) or len(ids) < 2:
            return None
        x = np.stack([np.frombuffer(v, "<f8") for v in rows["vector"]])
        norm = np.linalg.norm(x, axis=1)
        codes = np.stack([np.frombuffer(c, np.int64) for c in rows["codes"]]).reshape(len(x), tables, 1 + probes)
        cosine = (x[query] @ x[target].T) / np.outer(norm[query], norm[target])
        q, s = np.nonzero(cosine >= min_cosine)
        q, s = query[q], target[s]
        apart = ids[q] != ids[s]
        q, s = q[apart], s[apart]
        good = np.ones(len(q), bool)
        for at in range(0, len(q), 100_000):
            a, b = q[at : at + 100_000], s[at : at + 100_000]
            # Seen from both sides in this table: it counts where the query has the smaller id.
            back = (codes[b, t, :] == codes[a, t, :1]).any(1)
            first = (ids[a] < ids[b]) | ~back
            for u in range(t):
                first &= ~((codes[a, u, :] == codes[b, u, :1]).any(1) | (codes[b, u, :] == codes[a, u, :1]).any(1))
            good[at : at + 100_000] = first
        a, b = q[good], s[good]
        if not len(a):
            return None
        count = np.bincount(a, rows["weight"][b], len(ids)) + np.bincount(b, rows["weight"][a], len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order[_spanning(len(ids), rank[a], rank[b])]][rank]
        linked = np.flatnonzero(count > 0)
        return ids[linked], count[linked].astype(np.int64), root[linked]

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["id", "t", "weight", "query", "target"]
        for group in sorted_groups(batches, 3):
            rows = {c: group.column(c).to_numpy() for c in names}
            rows |= {c: group.column(c).to_pylist() for c in ("vector", "codes")}
            if (found := tile(rows)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "n", "root"])

    return run


def valid_vector(vector: Column) -> Column:
    """Whether a vector is not null, not empty or zero, and of finite components alone."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_links(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    tile: int = TILE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Links vectors of cosine ``min_cosine`` or more, and finds the components of the links.

    In each table a random projection to eight dimensions is decoded to its nearest point of the
    E8 lattice.  Two vectors are compared where one's cell is the other's or among the
    neighbouring cells that the other probes, and linked by their cosine in double precision.  A
    link counts in the first table that finds it.

    Equal vectors are one vector with a weight.  A bucket of more than ``tile`` vectors is dealt
    into tiles of queries by targets, so no task holds a whole hot bucket; tiles return counts
    and spanning links, never all pairs.

    Returns (id_col, n_links bigint, component_id bigint, kept boolean), a row for each input
    row.  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are their own component, as are vectors without an id, whose component is null
    (kept, since nothing else stands for them).  Vectors of different length are never linked.
    Rows of the same vector are linked, also where they share their id.
    """
    h = [F.xxhash64(F.lit(k), F.col("vector")).alias(f"h{k}") for k in (1, 2)]
    cells = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), cells.alias("vector"))
    rows = rows.withColumn("vector", F.when(valid_vector(F.col("vector")) & F.col("id").isNotNull(), F.col("vector")))
    keyed = rows.select("id", "vector", *h)
    distinct = keyed.where("vector is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")
    )
    distinct = stored(distinct, "vectors")
    coded = distinct.select("id", "weight", "vector").mapInArrow(
        _coded(tables, probes, scale, seed), "cell bigint, t int, home boolean, id bigint, weight bigint, vector binary, codes binary"
    )
    tiles = tiled(coded, "cell", "id", tile, F.col("home"))
    tiles = tiles.select("cell", "i", "j", "t", "id", "weight", "query", "target", "vector", "codes")
    tiles = tiles.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = stored(tiles.mapInArrow(_links(min_cosine, tables, probes), "id bigint, n bigint, root bigint"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "linked")
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    reps = distinct.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("id").alias("rep"), "weight")
    reps = reps.join(counts, F.col("rep") == F.col("linked"), "left").join(components, F.col("rep") == F.col("node"), "left")
    reps = reps.select("r1", "r2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    reps = stored(reps, "classes")
    out = keyed.join(reps, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & F.col("vector").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op2_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's links of cosine 0.9 or more, and its component."""
    return embedding_links(table(spark, sf_dir, "embeddings"))
