"""Scalar expressions with guarded division, logarithms and corrected moments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Annualisation of one-minute returns: the square root of minutes in a trading year.
ANNUAL = math.sqrt(252 * 24 * 60)


def ratio(a: Column, b: Column | float) -> Column:
    """a / b in double precision, null where b is 0 or null."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def log(a: Column) -> Column:
    """Natural logarithm, null unless a is above 0."""
    return F.when(a > 0, F.ln(a))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 7e-8 (Abramowitz and Stegun 26.2.17).

    Fixed values of that approximation: p, then b1 to b5.
    """
    p = 0.2316419
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(z))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


#: Fixed values of the rational approximation below: numerator and denominator in the middle, then in the tails; where tails begin.
PPF_MIDDLE = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
PPF_MIDDLE_BELOW = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
PPF_TAIL = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_TAIL_BELOW = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661754240, 1.0)
PPF_CUT = 0.02425


def normal_ppf(p: Column) -> Column:
    """The inverse of the standard normal distribution function, to a relative error of 1.2e-9; null outside 0 to 1, infinite at both ends."""

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    p = p.cast("double")
    q = p - 0.5
    middle = q * poly(PPF_MIDDLE, q * q) / poly(PPF_MIDDLE_BELOW, q * q)
    tail = lambda x: poly(PPF_TAIL, F.sqrt(-2 * F.ln(x))) / poly(PPF_TAIL_BELOW, F.sqrt(-2 * F.ln(x)))
    ends = F.when(p == 0, float("-inf")).when(p == 1, float("inf"))
    return ends.when((p > 0) & (p < PPF_CUT), tail(p)).when((p < 1) & (p > 1 - PPF_CUT), -tail(1 - p)).when((p > 0) & (p < 1), middle)


def fisher(x: Column) -> Column:
    """Fisher transform of a value clipped to just inside -1 and 1."""
    c = F.greatest(F.least(x, F.lit(1 - 1e-8)), F.lit(-1 + 1e-8))
    return F.when(x.isNotNull(), 0.5 * F.ln((1 + c) / (1 - c)))


def inverse_fisher(x: Column) -> Column:
    """The inverse of the Fisher transform, the hyperbolic tangent."""
    return F.tanh(x)


def corrected_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one."""
    return ratio(g1 * F.sqrt((n * (n - 1)).cast("double")), n - 2)


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    return ratio((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))


def r6(x: Column) -> Column:
    """Rounded to six decimals, for comparison across engines."""
    return F.round(x, 6)
