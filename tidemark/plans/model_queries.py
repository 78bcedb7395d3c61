"""Queries of estimators that SQL can't express; tests hold them against other computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import portfolio as P
from tidemark.operators import spectral as S
from tidemark.operators.validation import overfitting_probability
from tidemark.plans.flow_queries import tidy
from tidemark.sources import adapters as A


def kalman_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered level of log closes."""
    return S.kalman_level(A.bars(spark, sf_dir))


def instant_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude and phase of closes."""
    return S.instant_phase(A.bars(spark, sf_dir))


def haar_denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes without small wavelet details."""
    return S.haar_denoised(A.bars(spark, sf_dir))


def fractal_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hurst exponent and fractal dimension by symbol."""
    return S.fractal_measures(A.bars(spark, sf_dir))


def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail risk of bar returns by symbol."""
    return tidy(S.tail_risk(B.with_returns(A.bars(spark, sf_dir))))


def filtered_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned correlations of embedding components."""
    return S.filtered_correlation(A.table(spark, sf_dir, "embeddings"))


def overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that the best of five symbols' strategies in half of six periods is below the middle in the other half."""
    b = P.backtest(P.moving_average_signal(A.bars(spark, sf_dir)))
    scores = b.groupBy(F.col("symbol").alias("strategy"), (F.dayofmonth("open_time") % 6).alias("part")).agg(F.avg("strategy").alias("score"))
    return tidy(overfitting_probability(scores))


QUERIES = {f.__name__: f for f in (kalman_level, instant_phase, haar_denoised, fractal_measures, tail_risk, filtered_correlation, overfitting)}
