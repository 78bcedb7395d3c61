"""Lloyd's clustering with exact whole-number centroids, spared distances by ns-bounds.

A vector keeps, for each centroid, the distance at the round in which it was last computed.  The
centroid has moved since by the norm of its *total* displacement, of which the history of all
rounds' centroids tells the length; so the stored distance, loosened by that norm, bounds today's.
Summing each round's drift would loosen it more: a centroid that goes out and comes back has drifted
twice and is displaced by nothing.  Where the bounds can't tell the nearest centroid, the distances
that fail the test are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

CLUSTERS, ROUNDS, SEED, SCALE, DIMENSIONS = 16, 3, 1, 64, 64
#: Components beyond this could give squared distances that no long holds.
LARGEST = 1 << 27
#: What rounding can add to a norm of doubles, as a share of it, with room to spare.
SLACK = 1e-9
STATE = "vec_id bigint, v array<bigint>, cluster int, upper double, upper_at int, lower array<double>, lower_at array<int>, evaluated int"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to whole-number centroids, as int64."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if most * most * 4 * x.shape[1] < 2**53:  # every sum is exact in doubles, which multiply faster
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (np.square(a).sum(1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(1)).astype(np.int64)
    return np.stack([np.square(x - row).sum(1) for row in c], 1)


class Bounds:
    """Stored distances of a block of vectors: ``near`` to the own centroid, ``far`` to each, with their rounds."""

    def __init__(self, cluster: np.ndarray, near: np.ndarray, near_at: np.ndarray, far: np.ndarray, far_at: np.ndarray):
        self.cluster, self.near, self.near_at, self.far, self.far_at = cluster, near, near_at, far, far_at


def first_assignment(x: np.ndarray, centroids: np.ndarray) -> Bounds:
    """The nearest centroid of each vector, all distances computed."""
    d = squared(x, centroids)
    far, own = np.sqrt(d.astype(np.float64)), d.argmin(1)
    rows = np.arange(len(x))
    return Bounds(own, far[rows, own], np.zeros(len(x), np.int64), far, np.zeros(far.shape, np.int64))


def next_assignment(x: np.ndarray, history: np.ndarray, b: Bounds) -> tuple[Bounds, np.ndarray]:
    """The nearest of the last centroids of ``history`` (rounds, centroids, components), and how many distances each vector took.

    Ties go to the smaller number, as a full scan gives them: a centroid is passed over only if it is
    farther than the own one beyond all rounding.
    """
    now = history[-1]
    t = len(history) - 1
    rows = np.arange(len(x))
    # moved[r, j]: how far centroid j is from where it was in round r.
    moved = np.sqrt(np.square((history - now).astype(np.float64)).sum(2))
    columns = np.arange(len(now))
    lower = b.far * (1 - SLACK) - moved[b.far_at, columns] * (1 + SLACK)
    upper = b.near * (1 + SLACK) + moved[b.near_at, b.cluster] * (1 + SLACK)
    own = columns == b.cluster[:, None]
    doubt = (lower <= upper[:, None]) & ~own
    cluster, near, near_at, far, far_at = (a.copy() for a in (b.cluster, b.near, b.near_at, b.far, b.far_at))
    taken = np.zeros(len(x), np.int64)
    fails = np.flatnonzero(doubt.any(1))
    if len(fails):
        # The own distance first: it may settle what the loosened bound could not.
        mine = np.square(x[fails] - now[cluster[fails]]).sum(1)
        near[fails], near_at[fails] = np.sqrt(mine.astype(np.float64)), t
        far[fails, cluster[fails]], far_at[fails, cluster[fails]] = near[fails], t
        taken[fails] = 1
        still = (lower[fails] <= (near[fails] * (1 + SLACK))[:, None]) & ~own[fails]
        best, best_at = mine.copy(), cluster[fails].copy()
        for j in columns:
            at = np.flatnonzero(still[:, j])
            if not len(at):
                continue
            d = np.square(x[fails[at]] - now[j]).sum(1)
            far[fails[at], j], far_at[fails[at], j] = np.sqrt(d.astype(np.float64)), t
            taken[fails[at]] += 1
            better = (d < best[at]) | ((d == best[at]) & (j < best_at[at]))
            best[at], best_at[at] = np.where(better, d, best[at]), np.where(better, j, best_at[at])
        cluster[fails] = best_at
        near[fails], near_at[fails] = np.sqrt(best.astype(np.float64)), t
    return Bounds(cluster, near, near_at, far, far_at), taken


def whole_vectors(df: DataFrame, scale: int, dimensions: int | None) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors without null or non-finite components, of the length asked for."""
    rows = df.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if dimensions is not None:
        fine = fine & (F.size("x") == dimensions)
    whole = rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))
    large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    refused = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling: squared distances would not fit in a long"))
    return whole.select("vec_id", F.when(large, refused.cast("array<bigint>")).otherwise(F.col("v")).alias("v"))


def _read(batch) -> np.ndarray:  # noqa: ANN001
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _written(batch, b: Bounds, taken: np.ndarray):  # noqa: ANN001, ANN202
    import pyarrow as pa

    k = b.far.shape[1]
    offsets = pa.array(np.arange(len(b.cluster) + 1, dtype=np.int32) * k)
    return pa.RecordBatch.from_arrays([
        batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("v")), pa.array(b.cluster.astype(np.int32)), pa.array(b.near), pa.array(b.near_at.astype(np.int32)),
        pa.ListArray.from_arrays(offsets, pa.array(b.far.ravel())), pa.ListArray.from_arrays(offsets, pa.array(b.far_at.astype(np.int32).ravel())), pa.array(taken.astype(np.int32)),
    ], names=[f.split()[0] for f in STATE.split(", ")])


def _assigning(history: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _read(batch)
            if len(history) == 1:
                b = first_assignment(x, history[0])
                taken = np.full(len(x), len(history[0]))
            else:
                column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
                lists = [column(n).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for n in ("lower", "lower_at")]
                flat = [column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "upper_at")]
                b, taken = next_assignment(x, history, Bounds(flat[0].astype(np.int64), flat[1], flat[2].astype(np.int64), lists[0], lists[1].astype(np.int64)))
            yield _written(batch, b, taken)

    return run


def _summing(k: int):  # noqa: ANN202
    """Each task's sums and counts by cluster: at most clusters times components rows, whatever the table's size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, counts = None, np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, c = _read(batch), batch.column(batch.schema.get_field_index("cluster")).to_numpy()
            sums = np.zeros((k, x.shape[1]), np.int64) if sums is None else sums
            np.add.at(sums, c, x)
            counts += np.bincount(c, minlength=k)
        for j in np.flatnonzero(counts):
            d = sums.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, j, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(sums[j]), pa.array(np.full(d, counts[j]))], names=["cluster", "at", "s", "n"])

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by floor(sum / count) of its vectors, exactly; those without vectors stay.

    Only sums by cluster and component come to the driver.
    """
    parts = state.select("cluster", "v").mapInArrow(_summing(len(centroids)), "cluster int, at int, s bigint, n bigint")
    total = parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in total.collect():
        out[r.cluster, r["at"]] = int(r.s) // r.n
    return out


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dimensions: int | None = DIMENSIONS) -> DataFrame:
    """Clusters ``df`` (vec_id, embedding) by ``rounds`` of Lloyd's method and a last assignment.

    Returns, per vector of ``dimensions`` finite components: vec_id, cluster, distance (squared),
    cluster_inertia, inertia, centroid_sha256, and ``evaluated``, how many of the last round's
    distances to other centroids and its own had to be computed.  ``dimensions`` None takes all
    vectors, which must then have one length.

    The first centroids are the vectors of smallest sha256 of "seed:vec_id"; of equal ids that with
    the smaller vector comes first, ids that are null come last; with fewer vectors than clusters
    there are fewer centroids.  Equal centroids tie to the smaller number.  Repeated rows count each.
    Vectors that are null, empty or of another length, or hold null or non-finite components, are
    left out; components that are too large for exact distances raise an error.  An empty table
    gives no rows.  Other columns of ``df`` are not read.

    Each round reads the vectors with their bounds once, in order, and writes them; nothing is
    exchanged but sums by cluster, so no cluster, however large, is gathered in a task.  The history
    is ``rounds`` times ``clusters`` centroids, which goes to tasks with the function.
    """
    rows = whole_vectors(df, scale, dimensions)
    first = rows.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    seeds = [r.v for r in first.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]
    if not seeds:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"), ("evaluated", "int"))]).limit(0)
    history = [np.array(seeds, np.int64)]
    state = stored(rows.mapInArrow(_assigning(np.stack(history)), STATE), "assigned")
    for _ in range(rounds):
        history.append(moved_centroids(state, history[-1]))
        state = stored(state.mapInArrow(_assigning(np.stack(history)), STATE), "assigned")
    last = F.lit([[int(x) for x in c] for c in history[-1]])
    gaps = F.zip_with("v", F.element_at(last, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b))
    measured = state.select("vec_id", "cluster", F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("distance"), "evaluated")
    total = {r.cluster: r.s for r in measured.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = F.sha2(F.array_join(F.transform(F.element_at(last, F.col("cluster") + 1), lambda x: x.cast("string")), ","), 256)
    own = F.element_at(F.create_map(*[F.lit(x) for j, s in sorted(total.items()) for x in (j, s)]), F.col("cluster"))
    return measured.select("vec_id", "cluster", "distance", own.cast("bigint").alias("cluster_inertia"), F.lit(sum(total.values())).cast("bigint").alias("inertia"), digest.alias("centroid_sha256"), "evaluated")


def op13_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's cluster after three rounds from sixteen seeds, with distances and inertia."""
    return cluster(table(spark, sf_dir, "embeddings")).drop("evaluated")


def _sql() -> str:
    near = "SELECT vec_id, v, arg_min(j, d * 100 + j) AS j, min(d) AS d FROM (SELECT vec_id, v, j, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM w CROSS JOIN c{r}) GROUP BY vec_id, v"
    steps = []
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(r=r)})",
            f"s{r} AS (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) g(i) GROUP BY j, i)",
            f"m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY j)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.j = c{r}.j)",
        ]
    return f"""
WITH w AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS j, v AS c FROM w QUALIFY j < {CLUSTERS}),
{", ".join(steps)},
z AS MATERIALIZED ({near.format(r=ROUNDS)})
SELECT vec_id, CAST(z.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} ON c{ROUNDS}.j = z.j
"""


OP13_SQL = _sql()
