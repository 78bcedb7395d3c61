"""Estimators over whole series: each runs as a grouped Arrow or pandas function over one symbol's rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import log, ratio
from tidemark.functions.windows import frame, ordered


def rolling_hurst(bars: DataFrame, rows: int = 100, lags: range = range(2, 20)) -> DataFrame:
    """Twice the slope of the log deviation of differences on the log of their lag, over the last ``rows`` log returns.

    Null until there are so many; a half where some lag's differences do not vary.  The deviation of
    a lag's differences within the window is one over ``rows`` less the lag of them.
    """
    df = bars.withColumn("_r", log(ratio(F.col("close"), F.lag("close").over(ordered()))))
    df = df.withColumns({f"_d{k}": F.col("_r") - F.lag("_r", k).over(ordered()) for k in lags})
    df = df.withColumns({f"_s{k}": F.stddev_pop(f"_d{k}").over(frame(rows - k)) for k in lags})
    logs = [np.log(k) for k in lags]
    mean = float(np.mean(logs))
    squares = float(sum((x - mean) ** 2 for x in logs))
    slope = sum((F.ln(f"_s{k}") * float((x - mean) / squares) for k, x in zip(lags[1:], logs[1:], strict=True)), F.ln(f"_s{lags[0]}") * float((logs[0] - mean) / squares))
    flat = F.least(*[F.col(f"_s{k}") for k in lags]) <= 0
    value = F.when(F.count("_r").over(frame(rows)) == rows, F.when(flat, 0.5).otherwise(2 * slope))
    return df.select("symbol", "open_time", value.alias("hurst"))


def kalman_level(bars: DataFrame, process: float = 1e-4, noise: float = 1e-2) -> DataFrame:
    """A two-state Kalman filter of the log close: filtered level, its innovation, and the level smoothed backward.

    A bar without a close above 0 observes nothing: its state is predicted and its innovation is null.
    """

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("open_time")
        x, p = np.zeros(2), np.eye(2)
        eye, h, q = np.eye(2), np.array([[1.0, 0.0]]), process * np.eye(2)
        level, gap, states, covariances, ahead = [], [], [], [], []
        closes = pdf["close"].to_numpy(float)
        for z in np.where(closes > 0, np.log(np.where(closes > 0, closes, 1.0)), np.nan):
            p = p + q
            ahead.append((x, p))
            if np.isnan(z):
                level.append(x[0])
                gap.append(None)
                states.append(x)
                covariances.append(p)
                continue
            y = z - x[0]
            s = p[0, 0] + noise
            k = (p @ h.T / s)[:, 0]
            x = x + k * y
            ikh = eye - np.outer(k, h[0])
            p = ikh @ p @ ikh.T + noise * np.outer(k, k)
            level.append(x[0])
            gap.append(y)
            states.append(x)
            covariances.append(p)
        smooth = [states[-1]]
        for t in range(len(states) - 2, -1, -1):  # the Rauch-Tung-Striebel pass; the transition is the identity
            gain = covariances[t] @ np.linalg.inv(ahead[t + 1][1])
            smooth.append(states[t] + gain @ (smooth[-1] - ahead[t + 1][0]))
        smoothed = [s[0] for s in reversed(smooth)]
        return pd.DataFrame({"symbol": pdf["symbol"], "open_time": pdf["open_time"], "level": level, "innovation": gap, "smoothed": smoothed})

    return bars.select("symbol", "open_time", "close").groupBy("symbol").applyInPandas(run, "symbol string, open_time timestamp_ntz, level double, innovation double, smoothed double")


def instant_phase(bars: DataFrame) -> DataFrame:
    """Amplitude and phase of the close by the Hilbert transform, and the frequency in cycles a bar.

    The phase is not unwrapped; the frequency is the slope of the unwrapped phase.
    """

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("open_time")
        x = pdf["close"].to_numpy(float)
        n = len(x)
        weight = np.zeros(n)
        weight[0] = 1
        weight[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            weight[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x) * weight)
        phase = np.angle(z)
        turns = np.gradient(np.unwrap(phase)) / (2 * np.pi) if n > 1 else np.full(n, np.nan)
        return pd.DataFrame({"symbol": pdf["symbol"], "open_time": pdf["open_time"], "amplitude": np.abs(z), "phase": phase, "frequency": turns})

    return bars.select("symbol", "open_time", "close").groupBy("symbol").applyInPandas(run, "symbol string, open_time timestamp_ntz, amplitude double, phase double, frequency double")


def haar_denoised(bars: DataFrame, levels: int = 3, share: float = 0.3) -> DataFrame:
    """The close with small Haar wavelet details shrunk away: a soft threshold at a share of the largest."""

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("open_time")
        x = pdf["close"].to_numpy(float)
        size = 1 << levels
        a = np.pad(x, (0, -len(x) % size), mode="edge")
        details = []
        for _ in range(levels):
            a, d = (a[::2] + a[1::2]) / np.sqrt(2), (a[::2] - a[1::2]) / np.sqrt(2)
            cut = share * np.abs(d).max(initial=0.0)
            details.append(np.sign(d) * np.maximum(np.abs(d) - cut, 0))
        for d in reversed(details):
            a = np.stack([(a + d) / np.sqrt(2), (a - d) / np.sqrt(2)], 1).ravel()
        return pd.DataFrame({"symbol": pdf["symbol"], "open_time": pdf["open_time"], "denoised": a[: len(x)]})

    return bars.select("symbol", "open_time", "close").groupBy("symbol").applyInPandas(run, "symbol string, open_time timestamp_ntz, denoised double")


def rescaled_range(x: np.ndarray) -> float:
    """The Hurst exponent by rescaled ranges over blocks of growing size, between 0 and 1."""
    n = len(x)
    if n < 20:
        return 0.5
    sizes = np.unique(np.logspace(1, np.log10(max(n // 4, 10)), 20).astype(int))
    points = []
    for s in sizes:
        blocks = x[: n // s * s].reshape(-1, s)
        dev = np.cumsum(blocks - blocks.mean(1, keepdims=True), axis=1)
        sd = blocks.std(1, ddof=1)
        ok = sd > 0
        if ok.any():
            points.append((np.log(s), np.log(((dev.max(1) - dev.min(1))[ok] / sd[ok]).mean())))
    if len(points) < 2:
        return 0.5
    return float(np.clip(np.polyfit(*np.array(points).T, 1)[0], 0, 1))


def higuchi_dimension(x: np.ndarray, most: int = 10) -> float:
    """The fractal dimension of a curve by its length at several steps, between 1 and 2."""
    n = len(x)
    points = []
    for k in range(1, (most if n >= 40 else max(2, n // 4)) + 1):
        lengths = []
        for m in range(k):
            d = np.abs(np.diff(x[m::k]))
            if len(d):
                lengths.append(d.sum() * (n - 1) / (len(d) * k) / k)
        if lengths and np.mean(lengths) > 0:
            points.append((np.log(k), np.log(np.mean(lengths))))
    if len(points) < 2:
        return 1.5
    return float(np.clip(-np.polyfit(*np.array(points).T, 1)[0], 1, 2))


def fractal_measures(bars: DataFrame) -> DataFrame:
    """Hurst exponent of the log returns and fractal dimension of the closes of each symbol."""

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        x = pdf.sort_values("open_time")["close"].to_numpy(float)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "n": [len(x)], "hurst": [rescaled_range(np.diff(np.log(x)))], "dimension": [higuchi_dimension(x)]})

    return bars.select("symbol", "open_time", "close").groupBy("symbol").applyInPandas(run, "symbol string, n bigint, hurst double, dimension double")


def tail_risk(returns: DataFrame, threshold: float = 0.95, level: float = 0.99) -> DataFrame:
    """Value at risk and expected shortfall of losses by a generalised Pareto tail.

    Shape and scale come from probability-weighted moments of the losses above the threshold; null
    for less than ten of them.  Expects (symbol, ret); the shortfall is infinite for a shape of 1 or more.
    Only losses above the threshold are sorted.
    """
    c = F.col
    loss = returns.select("symbol", F.when(-c("ret") > 0, -c("ret")).alias("loss"))
    g = loss.groupBy("symbol").agg(F.count("loss").alias("losses"), F.percentile("loss", threshold).alias("u"))
    over = loss.join(g.select(c("symbol").alias("_s"), c("u").alias("_u")), c("symbol") == c("_s")).where(c("loss") > c("_u")).select("symbol", (c("loss") - c("_u")).alias("e"))
    w = ordered("symbol", "e")
    over = over.withColumn("i", F.row_number().over(w)).groupBy(c("symbol").alias("_s")).agg(F.count("*").alias("n"), F.avg("e").alias("b0"), F.sum(c("e") * c("i")).alias("ranked"), F.sum("e").alias("total"))
    d = g.join(over, c("symbol") == c("_s"), "left")
    n = c("n").cast("double")
    b1 = (n * c("total") - c("ranked")) / F.nullif(n - 1, F.lit(0.0)) / n
    d = d.withColumn("b1", F.when(c("n") >= 10, b1)).withColumn("shape", 2 - ratio(c("b0"), c("b0") - 2 * c("b1"))).withColumn("scale", ratio(2 * c("b0") * c("b1"), c("b0") - 2 * c("b1")))
    p = (1 - level) / (n / c("losses"))
    var = c("u") + F.when(F.abs("shape") > 1e-9, ratio(c("scale"), c("shape")) * (F.pow(p, -c("shape")) - 1)).otherwise(-c("scale") * F.ln(p))
    shortfall = F.when(c("shape") < 1, ratio(c("var"), 1 - c("shape")) + ratio(c("scale") - c("shape") * c("u"), 1 - c("shape"))).when(c("shape") >= 1, float("inf"))
    return d.withColumn("var", var).select("symbol", "losses", "var", shortfall.alias("shortfall"))


def filtered_correlation(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The correlations of a vector table's components, cleaned of noise by random-matrix bounds.

    Spark sums the components and their products (a row for each pair of components); the matrix
    that comes to the driver grows with the number of components alone.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.transform(vector_col, lambda x: x.cast("double")).alias("v"))

    def sums(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        total = None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if b.num_rows:
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    found = rows.mapInArrow(sums, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not found:
        return vectors.sparkSession.createDataFrame([], "i int, j int, correlation double")
    d = 1 + max(r["i"] for r in found)
    m = np.zeros((d, d))
    for i, j, s in found:
        m[i, j] = s
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    c = np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 0)
    np.fill_diagonal(c, 1.0)
    values, basis = np.linalg.eigh(c)
    noise = values <= (1 + np.sqrt(len(c) / n)) ** 2
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    c = basis @ np.diag(np.maximum(values, 1e-6)) @ basis.T
    c /= np.sqrt(np.outer(np.diag(c), np.diag(c)))
    c = (c + c.T) / 2
    out = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))]
    return vectors.sparkSession.createDataFrame(out, "i int, j int, correlation double")
