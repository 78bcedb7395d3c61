"""Hidden regimes: a Gaussian hidden Markov model, fitted and decoded by blocks of time.

Forward, backward and best-path recursions are products of small matrices, in sums of products or in
maxima of sums.  Each block of a key's rows gives one matrix, a scan over blocks gives the vectors at
which they begin and end, and all blocks then run at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scans import WIDTH, carried, in_blocks, over_blocks, with_carry
from tidemark.functions.tables import written

#: States, what is added to variances and to probabilities, least density, persistence at first.
STATES, RIDGE, TINY, PERSISTENCE = 3, 1e-4, 1e-100, 0.9


class Model:
    """A model's numbers, as one array: start, transition, means, covariances, last state, log likelihood, whether it has settled."""

    def __init__(self, flat: np.ndarray, k: int, d: int):
        cuts = np.cumsum([k, k * k, k * d, k * d * d, k])
        self.start, transition, means, covs, self.last, rest = np.split(np.asarray(flat, float), cuts)
        self.transition, self.means, self.covs = transition.reshape(k, k), means.reshape(k, d), covs.reshape(k, d, d)
        self.likelihood, self.settled = rest

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start, self.transition.ravel(), self.means.ravel(), self.covs.ravel(), self.last, [self.likelihood, self.settled]])

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Each row's density in each state, at least ``TINY``."""
        d = x.shape[1]
        out = []
        for mean, cov in zip(self.means, self.covs, strict=True):
            c = x - mean
            det = np.linalg.det(cov)
            with np.errstate(under="ignore"):
                out.append(np.exp(-0.5 * np.einsum("ni,ni->n", c @ np.linalg.inv(cov), c)) / np.sqrt((2 * np.pi) ** d * (det if det > 0 else 1e-10)))
        return np.maximum(np.stack(out, 1), TINY)

    def steps(self, e: np.ndarray, first: bool) -> np.ndarray:
        """The matrix by which each row takes the state probabilities on; a key's first row only weighs them."""
        m = self.transition[None] * e[:, None, :]
        if first:
            m[0] = np.diag(e[0])
        return m

    def log_steps(self, e: np.ndarray, first: bool) -> np.ndarray:
        m = np.log(self.transition + TINY)[None] + np.log(e + TINY)[:, None, :]
        if first:
            m[0] = np.where(np.eye(len(self.start)) > 0, np.log(e[0] + TINY)[None], -np.inf)
        return m


def _product(m: np.ndarray) -> np.ndarray:
    """The product of matrices in order, scaled to a largest entry of 1, by halving."""
    while len(m) > 1:
        pairs = m[0 : len(m) - len(m) % 2 : 2] @ m[1::2]
        pairs = pairs / np.maximum(pairs.max((1, 2)), 1e-300)[:, None, None]
        m = np.concatenate([pairs, m[-1:]]) if len(m) % 2 else pairs
    return m[0] / max(m[0].max(), 1e-300)


def _max_product(m: np.ndarray) -> np.ndarray:
    """The same where sums are maxima and products sums."""
    while len(m) > 1:
        pairs = (m[0 : len(m) - len(m) % 2 : 2][:, :, :, None] + m[1::2][:, None]).max(2)
        m = np.concatenate([pairs, m[-1:]]) if len(m) % 2 else pairs
    return m[0]


def _forward(steps: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities after each row, and what each row scaled them by."""
    out, scales = np.empty(steps.shape[:2]), np.empty(len(steps))
    for i, m in enumerate(steps):
        alpha = alpha @ m
        scales[i] = alpha.sum()
        alpha = alpha / (scales[i] + TINY)
        out[i] = alpha
    return out, scales


def _backward(steps: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The backward vector of each row, ``beta`` being that of the last; each scaled to a sum of 1."""
    out = np.empty(steps.shape[:2])
    out[-1] = beta
    for i in range(len(steps) - 1, 0, -1):
        beta = steps[i] @ beta
        beta = beta / (beta.sum() + TINY)
        out[i - 1] = beta
    return out


def _best(log_steps: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back pointers of each row, and the last row's scores."""
    back = np.empty(log_steps.shape[:2], np.int64)
    for i, m in enumerate(log_steps):
        scores = delta[:, None] + m
        back[i] = scores.argmax(0)
        delta = scores.max(0)
        delta = delta - delta.max()
    return back, delta


def _first_models(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, k: int) -> DataFrame:
    """(keys, model): rows sorted by size in ``k`` equal parts give the first means and covariances."""
    d = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    fine = F.lit(True)
    for c in x:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    w = Window.partitionBy(*keys)
    rows = df.where(F.coalesce(fine, F.lit(False)) & F.col(order).isNotNull()).withColumn("_size", sum((c * c for c in x[1:]), x[0] * x[0]))
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy("_size", order)) - 1).withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= 2 * k)
    part = F.least(F.floor(F.col("_i") / F.floor(F.col("_n") / k)), F.lit(k - 1)).cast("int")
    numbers = F.array(*[F.avg(c) for c in x], *[F.covar_samp(a, b) for a in x for b in x])
    parts = rows.groupBy(*keys, part.alias("_part")).agg(numbers.alias("_m"))
    made = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "_m"))).alias("_p")).select(*keys, F.flatten("_p._m").alias("m"))

    def model(row: dict) -> list[dict]:
        m = row["m"].reshape(k, d + d * d)
        transition = np.eye(k) * PERSISTENCE + (1 - PERSISTENCE) / k
        transition /= transition.sum(1, keepdims=True)
        covs = m[:, d:].reshape(k, d, d) + np.eye(d) * RIDGE
        return [{"model": np.concatenate([np.full(k, 1 / k), transition.ravel(), m[:, :d].ravel(), covs.ravel(), np.full(k, 1 / k), [-np.inf, 0.0]])}]

    return over_blocks(made, model, "model array<double>", keys)


def _joined(blocks: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    m = models.select(*[F.col(c).alias(f"_{c}") for c in keys], "model")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return blocks.join(m, on).drop(*[f"_{c}" for c in keys])


def fit(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), order: str = "open_time", states: int = STATES, iterations: int = 100, tolerance: float = 1e-4, width: int = WIDTH) -> DataFrame:
    """A model of each key's rows by expectation and maximisation: keys, model (``Model``'s array).

    A key's model is final once its log likelihood changes by less than ``tolerance``, or after
    ``iterations``.  Rows without finite values are passed over, keys of fewer than two rows a state
    have no model.  Each iteration reads the blocks twice; sums by key make the next models, which are
    written.  One number comes to the driver: whether all have settled.
    """
    keys, k, d = list(keys), states, len(columns)
    blocks = written(in_blocks(df, keys, order, columns, width), "blocks")
    models = written(_first_models(df, columns, keys, order, k), "models")

    def parts(row: dict) -> list[dict]:
        m = Model(row["model"], k, d)
        e = m.densities(row["x"].reshape(-1, d))
        return [{"block": row["block"], "part": np.concatenate([_product(m.steps(e, row["first"])).ravel(), m.start])}]

    def expected(row: dict) -> list[dict]:
        m, x = Model(row["model"], k, d), row["x"].reshape(-1, d)
        steps = m.steps(m.densities(x), row["first"])
        alpha, scales = _forward(steps, row["before"])
        beta = _backward(steps, row["after"])
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        # Pairs of a row and the one before it, which may stand in the block before.
        earlier = np.concatenate([row["before"][None], alpha[:-1]])
        pairs = earlier[:, :, None] * steps * beta[:, None, :]
        pairs /= pairs.sum((1, 2), keepdims=True) + TINY
        if row["first"]:
            pairs = pairs[1:]
        none = np.zeros(k)
        sums = [
            [np.log(scales + TINY).sum()], gamma[0] if row["first"] else none, gamma[-1] if row["last"] else none, gamma.sum(0), pairs.sum(0).ravel(), (gamma.T @ x).ravel(),
            np.einsum("nk,ni,nj->kij", gamma, x, x).ravel(),
        ]
        return [{"sums": np.concatenate(sums)}]

    size = 1 + 3 * k + k * k + k * d + k * d * d

    def maximised(row: dict) -> list[dict]:
        m = Model(row["model"], k, d)
        if m.settled:
            return [{"model": row["model"]}]
        like, start, last, total, pairs, first, second = np.split(row["sums"], np.cumsum([1, k, k, k, k * k, k * d]))
        weight = total + TINY
        transition = pairs.reshape(k, k) / (total - last + TINY)[:, None]
        m.transition = transition / transition.sum(1, keepdims=True)
        m.means = first.reshape(k, d) / weight[:, None]
        m.covs = second.reshape(k, d, d) / weight[:, None, None] - np.einsum("ki,kj->kij", m.means, m.means) + np.eye(d) * RIDGE
        m.settled = float(abs(like[0] - m.likelihood) < tolerance)
        m.start, m.last, m.likelihood = start, last, like[0]
        return [{"model": m.flat()}]

    for _ in range(iterations):
        going = _joined(blocks, models.where(F.element_at("model", -1) == 0), keys)
        composed = written(over_blocks(going, parts, "block bigint, part array<double>", keys), "parts")
        scaled = lambda v: v / (v.sum() + TINY)
        before = carried(composed, keys, lambda s, p: scaled(s @ p[: k * k].reshape(k, k)), lambda p: p[k * k :])
        after = carried(composed, keys, lambda s, p: scaled(p[: k * k].reshape(k, k) @ s), lambda p: np.full(k, 1.0 / k), backward=True)
        seen = over_blocks(with_carry(with_carry(going, before, keys, "before"), after, keys, "after"), expected, "sums array<double>", keys)
        sums = seen.groupBy(*keys).agg(F.array(*[F.sum(F.element_at("sums", i + 1)) for i in range(size)]).alias("sums"))
        rest = models.where(F.element_at("model", -1) != 0)
        models = written(over_blocks(_joined(sums, models, keys), maximised, "model array<double>", keys).unionByName(rest), "models")
        if models.where(F.element_at("model", -1) == 0).isEmpty():
            break
    return models


def decode(df: DataFrame, models: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), order: str = "open_time", states: int = STATES, online: bool = False, width: int = WIDTH) -> DataFrame:
    """Each row's regime under its key's model.

    Returns keys, order, filtered (the probabilities given the rows so far), smoothed (given all),
    state (the likeliest by what is known so far), path (on the best path through all rows), entropy
    of the filtered probabilities, and change_probability, what is left for states other than that
    which was likeliest a row before; the first row's is null.  With ``online`` the rows follow those
    that the model was fitted on, and go on from the last of them, whose likeliest state the first
    row's change is from.  Rows of keys without a model are left out.
    """
    keys, k, d = list(keys), states, len(columns)
    blocks = written(_joined(in_blocks(df, keys, order, columns, width), models, keys), "blocks")

    def start(m: Model) -> np.ndarray:
        return m.last if online else m.start

    def parts(row: dict) -> list[dict]:
        m = Model(row["model"], k, d)
        e = m.densities(row["x"].reshape(-1, d))
        first = row["first"] and not online
        return [{"block": row["block"], "part": np.concatenate([_product(m.steps(e, first)).ravel(), _max_product(m.log_steps(e, first)).ravel(), start(m), np.log(start(m) + TINY)])}]

    def onward(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        a, delta = s[:k] @ p[: k * k].reshape(k, k), (s[k:, None] + p[k * k : 2 * k * k].reshape(k, k)).max(0)
        return np.concatenate([a / (a.sum() + TINY), delta - delta.max()])

    composed = written(over_blocks(blocks, parts, "block bigint, part array<double>", keys), "parts")
    before = written(carried(composed, keys, onward, lambda p: p[2 * k * k :]), "before")
    opened = with_carry(blocks, before, keys, "before")

    def ends(row: dict) -> list[dict]:
        m = Model(row["model"], k, d)
        e = m.densities(row["x"].reshape(-1, d))
        first = row["first"] and not online
        back, delta = _best(m.log_steps(e, first), row["before"][k:])
        came = np.arange(k)
        for pointers in back[::-1]:
            came = pointers[came]
        return [{"block": row["block"], "part": np.concatenate([_product(m.steps(e, first)).ravel(), came, [delta.argmax()]])}]

    def homeward(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        b = p[: k * k].reshape(k, k) @ s[:k]
        return np.concatenate([b / (b.sum() + TINY), [p[k * k + int(s[k])]]])

    after = carried(over_blocks(opened, ends, "block bigint, part array<double>", keys), keys, homeward, lambda p: np.concatenate([np.full(k, 1.0 / k), [p[-1]]]), backward=True)

    def rows(row: dict) -> list[dict]:
        m = Model(row["model"], k, d)
        e = m.densities(row["x"].reshape(-1, d))
        first = row["first"] and not online
        steps = m.steps(e, first)
        alpha, _ = _forward(steps, row["before"][:k])
        gamma = alpha * _backward(steps, row["after"][:k])
        gamma /= gamma.sum(1, keepdims=True)
        back, _ = _best(m.log_steps(e, first), row["before"][k:])
        path = np.empty(len(e), np.int32)
        at = int(row["after"][k])
        for i in range(len(e) - 1, -1, -1):
            path[i], at = at, back[i][at]
        clipped = np.clip(alpha, 1e-10, 1)
        earlier = np.concatenate([[row["before"][:k].argmax()], alpha[:-1].argmax(1)])
        change = list(1 - alpha[np.arange(len(e)), earlier])
        if first:
            change[0] = None
        return [{"at": row["at"], "filtered": [a.tolist() for a in alpha], "smoothed": [g.tolist() for g in gamma], "state": alpha.argmax(1).astype(np.int32), "path": path,
                 "entropy": -(clipped * np.log(clipped)).sum(1), "change_probability": change}]

    names = ["filtered", "smoothed", "state", "path", "entropy", "change_probability"]
    schema = "at array<bigint>, filtered array<array<double>>, smoothed array<array<double>>, state array<int>, path array<int>, entropy array<double>, change_probability array<double>"
    out = over_blocks(with_carry(opened, after, keys, "after"), rows, schema, keys).select(*keys, F.explode(F.arrays_zip("at", *names)).alias("r"))
    return out.select(*keys, F.timestamp_micros("r.at").cast(df.schema[order].dataType).alias(order), *[F.col(f"r.{n}").alias(n) for n in names])
