"""Column builders for normal probabilities and interval constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five-term polynomial of the normal tail (Abramowitz and Stegun 26.2.17).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
SCALE, ROOT = 0.2316419, 0.3989422804014327


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + SCALE * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    upper = ROOT * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def interval_estimate(low: Column, mean: Column, high: Column, n: Column) -> Column:
    """From a stated minimum, mean and maximum: whether they agree, a deviation and the mean's clipped band."""
    sd = (high - low) / 3.92
    half = sd / F.sqrt(F.greatest(n, F.lit(1)))
    return F.struct(((low <= mean) & (mean <= high)).alias("consistent"), sd.alias("sd"), F.greatest(low, mean - half).alias("band_low"), F.least(high, mean + half).alias("band_high"))


# The rational approximation of the normal quantile (Acklam), middle and tails.
MIDDLE_TOP = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
MIDDLE_BOTTOM = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857, 1.0)
TAIL_TOP = (-0.00778489400243029, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
TAIL_BOTTOM = (0.00778469570904146, 0.32246712907004, 2.445134137143, 3.75440866190742, 1.0)
TAIL_FROM = 0.02425


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The z below which a share p of a normal distribution lies; null outside (0, 1)."""
    q = p - 0.5
    middle = q * polynomial(q * q, MIDDLE_TOP) / polynomial(q * q, MIDDLE_BOTTOM)
    far = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = polynomial(far, TAIL_TOP) / polynomial(far, TAIL_BOTTOM)
    return F.when((p > 0) & (p < 1), F.when(p < TAIL_FROM, tail).when(p > 1 - TAIL_FROM, -tail).otherwise(middle))
