"""Exact top-k search by inner product with M-trees, searched best first."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored, table

K = 5
#: Vectors of a tree, entries of a page, queries of a block, and pivots that divide the space.
TREE, PAGE, BLOCK, PIVOTS = 4096, 64, 2048, 256
SEED = 41


class MTree:
    """A paged M-tree: each page holds routing vectors with covering radii and the distances to
    their page's parent, leaves hold objects with theirs.

    Inner products become distances by one more coordinate, which brings all objects to the same
    norm: |q|^2 + norm^2 - 2 q.x is the squared distance of q to x.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float, page: int = PAGE, seed: int = SEED):
        self.ids, self.vectors, self.norm2, self.page = ids, vectors, norm2, page
        real = vectors.astype(np.float64)
        self.points = np.concatenate([real, np.sqrt(np.maximum(norm2 - np.square(real).sum(1), 0))[:, None]], axis=1)
        self.random = np.random.default_rng(seed)
        # A page: whether it is a leaf, the members (rows, or pages), the routing points, radii, distances to the parent.
        self.pages: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rows = np.arange(len(ids))
        level = [self._leaf(center, own) for center, own in self._parts(self.points, rows)]
        while len(level) > 1:
            centers = np.array([c for _, c, _ in level])
            upper = [self._inner(center, [level[i] for i in own]) for center, own in self._parts(centers, np.arange(len(level)))]
            level = upper
        self.root, self.center, self.radius = level[0] if level else (None, None, 0.0)

    def _parts(self, points: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Divides points into pages of near ones: (routing point, rows)."""
        if len(rows) <= self.page:
            return [(points[rows].mean(0), rows)] if len(rows) else []
        chosen = self.random.choice(rows, size=min(self.page, math.ceil(len(rows) / self.page)), replace=False)
        if len(chosen) < 2:
            chosen = self.random.choice(rows, size=2, replace=False)
        p = points[chosen]
        near = (np.square(p).sum(1) - 2 * points[rows] @ p.T).argmin(1)
        out = []
        for i in range(len(chosen)):
            own = rows[near == i]
            if len(own) == len(rows):  # equal points: any division will do
                for part in np.array_split(own, math.ceil(len(own) / self.page)):
                    out.append((points[part].mean(0), part))
            else:
                out += self._parts(points, own)
        return out

    def _leaf(self, center: np.ndarray, rows: np.ndarray):
        d = np.linalg.norm(self.points[rows] - center, axis=1)
        self.pages.append((True, rows, self.points[rows], np.zeros(len(rows)), d))
        return len(self.pages) - 1, center, float(d.max())

    def _inner(self, center: np.ndarray, children: list):
        centers, radii = np.array([c for _, c, _ in children]), np.array([r for _, _, r in children])
        d = np.linalg.norm(centers - center, axis=1)
        self.pages.append((False, np.array([n for n, _, _ in children]), centers, radii, d))
        return len(self.pages) - 1, center, float((d + radii).max())

    def search(self, query: np.ndarray, own_id: int, k: int, least: float = -math.inf) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, of objects that score ``least`` or more.

        Pages come from a heap by the least distance that an object in them can have.  An entry
        whose stored distance to the parent rules it out is passed over without computing its own.
        """
        if self.root is None:
            return []
        q = np.append(query.astype(np.float64), 0.0)
        q2 = float(q @ q)
        slack = 1e-9 * (q2 + self.norm2 + 1)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first

        def reach() -> float:
            """The distance beyond which no object can be among the best."""
            score = max(least, best[0][0] if len(best) == k else -math.inf)
            return math.inf if score == -math.inf else math.sqrt(max(q2 + self.norm2 - 2 * score, 0) + slack) + 1e-9

        to_root = float(np.linalg.norm(q - self.center))
        heap = [(max(to_root - self.radius, 0.0), 0, self.root, to_root)]
        pushed = 0
        while heap:
            low, _, page, to_parent = heapq.heappop(heap)
            limit = reach()
            if low > limit:
                break
            leaf, members, points, radii, parent = self.pages[page]
            open_ = np.abs(to_parent - parent) - radii <= limit
            if not open_.any():
                continue
            members = members[open_]
            if leaf:
                for score, x in zip((self.vectors[members] @ query).tolist(), self.ids[members].tolist(), strict=True):
                    if x == own_id or score < least:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -x))
                    elif (score, -x) > best[0]:
                        heapq.heapreplace(best, (score, -x))
                continue
            d = np.linalg.norm(points[open_] - q, axis=1)
            lows = np.maximum(d - radii[open_], 0)
            for n, one, low in zip(members.tolist(), d.tolist(), lows.tolist(), strict=True):
                if low <= limit:
                    pushed += 1
                    heapq.heappush(heap, (low, pushed, n, one))
        return [(s, -x) for s, x in sorted(best, reverse=True)]


def _vectors(column, kind=np.int64) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _extended(x: np.ndarray, norm2: float) -> np.ndarray:
    real = x.astype(np.float64)
    return np.concatenate([real, np.sqrt(np.maximum(norm2 - np.square(real).sum(1), 0))[:, None]], axis=1)


def _assigned(pivots: np.ndarray, norm2: float):
    """Adds each vector's nearest pivot and its distance."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = _extended(_vectors(batch.column(1)), norm2)
                near = (np.square(pivots).sum(1) - 2 * x @ pivots.T).argmin(1)
                d = np.linalg.norm(x - pivots[near], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d)], names=["id", "v", "pivot", "d"])

    return run


def _routed(pivots: np.ndarray, radii: np.ndarray, norm2: float):
    """For each query the pivots whose vectors could beat its bound, its home aside."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                q = _vectors(batch.column(1)).astype(np.float64)
                q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
                home = batch.column(2).to_numpy()
                least = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)  # null: no bound
                q2 = np.square(q).sum(1)
                limit = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(q2 + norm2 - 2 * least, 0) * (1 + 1e-9) + 1e-6))
                d = np.sqrt(np.maximum(q2[:, None] + np.square(pivots).sum(1) - 2 * q @ pivots.T, 0))
                go = (d - radii <= limit[:, None] + 1e-6 * (1 + d)) & (radii >= 0)
                go[np.arange(len(q)), home] = False
                rows, to = np.nonzero(go)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(to.astype(np.int32)), batch.column(3).take(take)],
                    names=["query", "v", "pivot", "least"],
                )

    return run


def _searched(k: int, norm2: float):
    """Builds the tree of a group's vectors and searches it for the group's queries."""

    def run(vectors, queries):
        import pyarrow as pa

        out: list[tuple[int, int, int]] = []
        if vectors.num_rows and queries.num_rows:
            tree = MTree(vectors["id"].to_numpy(), _vectors(vectors["v"].combine_chunks()), norm2)
            q = _vectors(queries["v"].combine_chunks())
            for x, own, least in zip(q, queries["query"].to_pylist(), queries["least"].to_pylist(), strict=True):
                out += [(own, i, s) for s, i in tree.search(x, own, k, -math.inf if least is None else least)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _search(trees: DataFrame, queries: DataFrame, sizes: DataFrame, k: int, norm2: float, tree: int, block: int) -> DataFrame:
    """Meets trees and blocks of queries: a tree is a part of at most about ``tree`` vectors of a pivot.

    A pivot's trees are copied once for each ``block`` queries that are routed to it, so what is
    exchanged grows with the vectors and the routed pairs; trees without queries stay where they are.
    """
    parts = F.greatest(F.ceil(F.col("n") / tree), F.lit(1)).cast("int")
    routed = queries.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("blocks"))
    sized = sizes.select("pivot", parts.alias("parts")).join(routed, "pivot")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = trees.join(sized, "pivot").select("id", "v", "pivot", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), block.alias("block"))
    right = queries.join(sized, "pivot").select(
        "query", "v", "pivot", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("query"), "blocks").cast("int").alias("block"),
    )
    keys = ["pivot", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k, norm2), "query_id bigint, vec_id bigint, score bigint")


def top_k_inner(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    tree: int = TREE,
    pivots: int = PIVOTS,
    block: int = BLOCK,
    id_col: str = "id",
    vector_col: str = "v",
    query_col: str | None = None,
) -> DataFrame:
    """Each query's k vectors of highest inner product, exactly, ties to smaller ids.

    Both tables have an id and an array<bigint>.  A query meets vectors of its own length, each
    length being searched by itself.  Pivots, a
    bounded number of vectors taken by a hash of their ids, divide the vectors; each pivot's
    vectors are dealt into M-trees of about ``tree`` vectors, so a crowded pivot is many trees.
    A query first searches the trees of its nearest pivot.  The score of its k-th best there
    bounds the rest: pivots are passed over whose covering radius rules them out, and so are
    pages and entries within the trees.  Queries meet trees in blocks of about ``block``; the
    driver holds the pivots, their radii and counts, of which there are at most ``pivots``.

    Returns (query_id, rank int from 1, vec_id, score bigint).  Rows with a null id, or a
    vector that is null, empty or holds a null, take no part, vectors of the query's own id are never its results, a query with fewer candidates
    gets them all, and rows that share an id are results of their own, while of queries that share
    an id only the one with the least vector is searched.  Empty tables give an empty result.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    q = queries.select(F.col(query_col or id_col).cast("bigint").alias("query"), F.col(vector_col).alias("v")).where("query is not null and size(v) > 0 and not exists(v, x -> x is null)")
    v = stored(v, "vectors")
    q = stored(q.groupBy("query").agg(F.min("v").alias("v")), "queries")
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    lengths = sorted(r[0] for r in q.select(F.size("v")).distinct().collect())
    if len(lengths) > 1:
        parts = [top_k_inner(v.where(F.size("v") == n), q.where(F.size("v") == n), k, tree, pivots, block, "id", "v", "query") for n in lengths]
        return functools.reduce(DataFrame.unionByName, parts)
    v = v.where(F.size("v") == (lengths[0] if lengths else 0))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most, n_vectors = v.agg(F.max(norm), F.count("*")).first()
    n_queries = q.count()
    empty = v.sparkSession.createDataFrame([], schema)
    if not n_vectors or not n_queries:
        return empty
    norm2 = float(most)
    wanted = max(1, min(pivots, math.ceil(n_vectors / tree)))
    chosen = [r["v"] for r in v.orderBy(F.xxhash64(F.lit(SEED), "id"), "id", "v").limit(wanted).collect()]
    points = _extended(np.array(chosen, np.int64), norm2)
    assigned = stored(v.mapInArrow(_assigned(points, norm2), "id bigint, v array<bigint>, pivot int, d double"), "assigned")
    sizes = stored(assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.max("d").alias("radius")), "pivots")
    radii = np.full(len(points), -1.0)
    for row in sizes.collect():
        radii[row["pivot"]] = row["radius"]
    trees = assigned.select("id", "v", "pivot")
    # A query has no further coordinate, so its nearest pivot differs from that of its vector.
    homed = q.select(F.col("query").alias("id"), "v").mapInArrow(_nearest(points), "query bigint, v array<bigint>, pivot int")
    homed = stored(homed, "homes")
    first = stored(_search(trees, homed.withColumn("least", F.lit(None).cast("bigint")), sizes, k, norm2, tree, block), "first")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(by_score))
    bounds = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    bounded = homed.join(bounds, homed["query"] == bounds["query_id"], "left").select("query", "v", "pivot", "least")
    further = stored(bounded.mapInArrow(_routed(points, radii, norm2), "query bigint, v array<bigint>, pivot int, least bigint"), "routed")
    rest = _search(trees, further, sizes, k, norm2, tree, block)
    return (
        first.unionByName(rest)
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _nearest(pivots: np.ndarray):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            q = _vectors(batch.column(1)).astype(np.float64)
            q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
            near = (np.square(pivots).sum(1) - 2 * q @ pivots.T).argmin(1) if len(q) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=["query", "v", "pivot"])

    return run


def op7_mtree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products with the whole-number parts of 256 times the components, for
    every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    finite = F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = rows.where(finite).select(F.col("vec_id").alias("id"), F.transform("x", lambda x: F.floor(x * 256)).alias("v"))
    return top_k_inner(rows, rows.where("id % 50 = 0"))


OP7_SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
