"""Non-stationarity of a vector series: a decaying covariance, its spectrum, its drift, and changes of regime."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scans import WIDTH, carried, in_blocks, over_blocks, with_carry

#: Half life, eigenvalues, threshold of the gap, warm-up, sensitivity to drift; iterations and tolerance.
HALF_LIFE, TRACKED, THRESHOLD, WARM_UP, SENSITIVITY = 100.0, 3, 0.3, 50, 2.0
ITERATIONS, TOLERANCE = 20, 1e-6


def decay(half_life: float) -> float:
    """The weight that a new observation gets so that one is worth half after ``half_life`` others."""
    return 1 - 0.5 ** (1 / half_life)


def top_eigenvalues(matrices: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues of each symmetric matrix, falling, by power iteration with deflation.

    All matrices iterate together, each until its estimate changes by less than the tolerance; as
    specified, what is kept is the estimate before the last.
    """
    n, d, _ = matrices.shape
    left = matrices.copy()
    out = np.zeros((n, count))
    for k in range(min(count, d)):
        v = np.sin(np.arange(d) + k + 1.0)
        v = np.repeat((v / np.linalg.norm(v))[None], n, 0)
        kept, going = np.zeros(n), np.arange(n)
        for _ in range(ITERATIONS):
            w = np.einsum("nij,nj->ni", left[going], v[going])
            estimate = (v[going] * w).sum(1)
            norm = np.linalg.norm(w, axis=1)
            v[going] = np.where(norm[:, None] > 1e-10, w / np.maximum(norm, 1e-300)[:, None], w)
            settled = np.abs(estimate - kept[going]) < TOLERANCE
            kept[going[~settled]] = estimate[~settled]
            going = going[~settled]
            if not len(going):
                break
        out[:, k] = np.maximum(kept, 0)
        left -= kept[:, None, None] * v[:, :, None] * v[:, None, :]
    return -np.sort(-out, axis=1)


def _decayed(x: np.ndarray, start: np.ndarray, alpha: float) -> np.ndarray:
    """s = (1 - alpha) s + alpha x along the first axis."""
    out = np.empty_like(x)
    s = start
    for i in range(len(x)):
        s = (1 - alpha) * s + alpha * x[i]
        out[i] = s
    return out


def nonstationarity(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), order: str = "open_time", half_life: float = HALF_LIFE, tracked: int = TRACKED,
    threshold: float = THRESHOLD, warm_up: int = WARM_UP, sensitivity: float = SENSITIVITY, width: int = WIDTH,
) -> DataFrame:
    """The spectrum, drift and regime of the ``columns`` at each row of each key, in order.

    Mean and covariance decay by ``half_life``; the mean moves first and the row is centred with the
    new one.  Returns keys, order, spectral_gap, drift (the norm of the change of variances),
    effective_dimension, score (0 to 1), probability and detected of a regime change, regime (how many
    changes so far), and the features drift_norm, dim_ratio, stability and regime_weight.  Eigenvalues
    and changes begin with row ``warm_up``; before it gap is 0 and dimension 1.

    Rows that lack a finite value are passed over.  To start anew, as at a session, make the session
    a key.  A key's rows are cut into blocks of ``width`` seconds: mean and covariance of a block's
    end are linear in those of its start (a quadratic term in the mean apart), so blocks compose, and
    a key of any length uses all tasks.
    """
    keys, d, alpha = list(keys), len(columns), decay(half_life)
    keep = 1 - alpha
    blocks = in_blocks(df, keys, order, columns, width)

    def parts(row: dict) -> list[dict]:
        x = row["x"].reshape(-1, d)
        n = len(x)
        local = _decayed(x, np.zeros(d), alpha)
        u = x - local
        weight = alpha * keep ** np.arange(n - 1, -1, -1.0)
        powers = keep ** np.arange(1, n + 1.0)
        # A row's centred value is u - keep^(i+1) m for the mean m at the block's start.
        second = np.einsum("n,ni,nj->ij", weight, u, u)
        return [{"block": row["block"], "part": np.concatenate([[n, keep**n], local[-1], second.ravel(), (weight * powers) @ u, [(weight * powers**2).sum()]])}]

    def step(state: np.ndarray, part: np.ndarray) -> np.ndarray:
        count, mean, cov = state[0], state[1 : 1 + d], state[1 + d :].reshape(d, d)
        n, fade = part[0], part[1]
        local, second, cross, own = part[2 : 2 + d], part[2 + d : 2 + d + d * d].reshape(d, d), part[2 + d + d * d : 2 + 2 * d + d * d], part[-1]
        grown = fade * cov + second - np.outer(cross, mean) - np.outer(mean, cross) + own * np.outer(mean, mean)
        return np.concatenate([[count + n], fade * mean + local, grown.ravel()])

    starts = carried(over_blocks(blocks, parts, "block bigint, part array<double>", keys), keys, step, lambda _: np.zeros(1 + d + d * d))

    def spectra(row: dict) -> list[dict]:
        x, s = row["x"].reshape(-1, d), row["carry"]
        mean = _decayed(x, s[1 : 1 + d], alpha)
        c = x - mean
        before = s[1 + d :].reshape(d, d)
        cov = _decayed(c[:, :, None] * c[:, None, :], before, alpha)
        variances = np.diagonal(cov, axis1=1, axis2=2)
        drift = np.linalg.norm(np.diff(variances, axis=0, prepend=np.diag(before)[None]), axis=1)
        number = s[0] + np.arange(1, len(x) + 1)
        values = np.zeros((len(x), tracked))
        warm = number >= warm_up
        if warm.any():
            values[warm] = top_eigenvalues(cov[warm], tracked)
        top, total, squares = values[:, 0], values.sum(1), np.square(values).sum(1)
        gap = np.where(top > 1e-10, (top - values[:, 1]) / np.where(top > 1e-10, top, 1), 0.0) if tracked > 1 else np.zeros(len(x))
        dimension = np.where(squares > 1e-10, total**2 / np.where(squares > 1e-10, squares, 1), 1.0)
        n = len(x)
        ends = [_decayed(drift**p, np.zeros(()), alpha)[-1] for p in (1, 2)]
        return [{"block": row["block"], "at": row["at"], "number": number, "gap": gap, "drift": drift, "dimension": dimension, "part": np.array([keep**n, *ends, gap[-1]])}]

    seen = over_blocks(with_carry(blocks, starts, keys), spectra, "block bigint, at array<bigint>, number array<double>, gap array<double>, drift array<double>, dimension array<double>, part array<double>", keys)
    drifts = carried(seen, keys, lambda s, p: np.array([p[0] * s[0] + p[1], p[0] * s[1] + p[2], p[3]]), lambda _: np.zeros(3))

    def scores(row: dict) -> list[dict]:
        gap, drift, number = row["gap"], row["drift"], row["number"]
        mean, square = (_decayed(drift**p, np.asarray(row["carry"][p - 1]), alpha) for p in (1, 2))
        z = (drift - mean) / np.sqrt(np.maximum(square - mean**2, 1e-10))
        change = np.abs(np.diff(gap, prepend=row["carry"][2]))
        combined = 0.6 * change / threshold + 0.4 * np.abs(z) / sensitivity
        warm = number >= warm_up
        with np.errstate(over="ignore"):
            probability = np.where(warm, 1 / (1 + np.exp(-2 * (combined - 1))), 0.0)
            score = 1 / (1 + np.exp(-sensitivity * z))
        detected = warm & (combined > 1.5) & (np.abs(z) > sensitivity)
        return [{"block": row["block"], "at": row["at"], "number": number, "gap": gap, "drift": drift, "dimension": row["dimension"], "score": score, "probability": probability,
                 "ema": mean, "detected": detected.astype(np.int32), "changes": np.cumsum(detected)}]

    fields = {"number": "double", "gap": "double", "drift": "double", "dimension": "double", "score": "double", "probability": "double", "ema": "double", "detected": "int", "changes": "bigint"}
    scored = over_blocks(with_carry(seen, drifts, keys), scores, "block bigint, at array<bigint>, " + ", ".join(f"{k} array<{t}>" for k, t in fields.items()), keys)
    w = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scored = scored.withColumn("_earlier", F.coalesce(F.sum(F.element_at("changes", -1)).over(w), F.lit(0)))
    rows = scored.select(*keys, "_earlier", F.explode(F.arrays_zip("at", *fields)).alias("r"))
    regime = F.col("_earlier") + F.col("r.changes")
    stability = F.when(regime > 0, F.least(F.col("r.number") / regime, F.lit(1000.0)) / 1000).otherwise(1.0)
    return rows.select(
        *keys, F.timestamp_micros("r.at").cast(df.schema[order].dataType).alias(order), F.col("r.gap").alias("spectral_gap"), F.col("r.drift").alias("drift"), F.col("r.dimension").alias("effective_dimension"),
        F.col("r.score").alias("score"), F.col("r.probability").alias("probability"), F.col("r.detected").alias("detected"), regime.alias("regime"),
        (F.col("r.ema") / (F.col("r.ema") + 1)).alias("drift_norm"), (F.col("r.dimension") / d).alias("dim_ratio"), stability.alias("stability"),
        # The score at the mean drift, whose z is 0, is a half.
        (0.3 * stability + 0.7 * 0.5).alias("regime_weight"),
    )
