"""Scores, priors and numeric comparisons as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results must share.
ABSOLUTE_TOLERANCE = 1e-8
RELATIVE_TOLERANCE = 1e-6
LOG_OFFSET = 1e-12
CLIP = 5.0
DEVIATION_FLOOR = 1e-6


def rank_hit(rank: Column, k: int) -> Column:
    """1.0 when the rank is within the first k; rank 0 (not covered) scores 0."""
    return F.when(rank.between(1, k), 1.0).otherwise(0.0)


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank > 0, F.lit(1.0) / rank).otherwise(0.0)


def rank_metric(rank: Column, metric: str) -> Column:
    """'top<k>' or 'mrr'."""
    return reciprocal_rank(rank) if metric == "mrr" else rank_hit(rank, int(metric[3:]))


def normalised_rank(rank: Column, size: Column) -> Column:
    """1 for the first rank down to 0 for the last; 1 for a list of one."""
    return F.lit(1.0) - (rank - 1) / F.greatest(size - 1, F.lit(1))


def normalised_midrank(midrank: Column, size: Column) -> Column:
    """Descending score in [0, 1] from an ascending average rank; a single item scores 1."""
    return F.when(size <= 1, F.lit(1.0)).otherwise((midrank - 1) / F.nullif(size - 1, F.lit(0)))


def log_prior(prior: Column) -> Column:
    """Natural logarithm with a small offset; a negative prior is an error."""
    return F.when(prior < 0, F.raise_error(F.lit("negative prior")).cast("double")).otherwise(
        F.log(prior + LOG_OFFSET))


def standardised(value: Column, mean: Column, deviation: Column, clip: float = CLIP) -> Column:
    return F.least(F.greatest((value - mean) / deviation, F.lit(-clip)), F.lit(clip))


def within_tolerance(reference: Column, other: Column) -> Column:
    """|other - reference| <= max(1e-8, 1e-6 |reference|); false unless both are finite."""
    allowed = F.greatest(F.lit(ABSOLUTE_TOLERANCE), F.lit(RELATIVE_TOLERANCE) * F.abs(reference))
    return finite(reference) & finite(other) & (F.abs(other - reference) <= allowed)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(math.inf))


def relative_difference(reference: Column, other: Column) -> Column:
    return F.abs(other - reference) / F.greatest(F.abs(reference), F.lit(ABSOLUTE_TOLERANCE))


@F.pandas_udf(T.LongType())
def float32_steps(left: pd.Series, right: pd.Series) -> pd.Series:
    """Representable single-precision steps between two numbers; null on overflow."""
    def position(values: pd.Series):
        with np.errstate(over="ignore"):
            single = values.to_numpy("float64", na_value=np.nan).astype("float32")
        bits = single.view("int32").astype("int64")
        return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits), np.isfinite(single)

    a, a_ok = position(left)
    b, b_ok = position(right)
    return pd.Series(np.abs(a - b)).where(pd.Series(a_ok & b_ok)).astype("Int64")


def linear_score(features: dict[str, float]) -> Column:
    """Weighted sum of columns, in the order given."""
    total: Column | None = None
    for name, weight in features.items():
        term = F.col(name) * F.lit(float(weight))
        total = term if total is None else total + term
    return total


def hidden_layer_score(
    columns: list[str], hidden: list[list[float]], bias: list[float],
    output: list[float], output_bias: float = 0.0,
) -> Column:
    """One hidden rectified layer and a linear output, as plain column arithmetic."""
    total = F.lit(float(output_bias))
    for weights, offset, scale in zip(hidden, bias, output):
        unit = F.lit(float(offset))
        for name, weight in zip(columns, weights):
            unit = unit + F.col(name) * F.lit(float(weight))
        total = total + F.greatest(unit, F.lit(0.0)) * F.lit(float(scale))
    return total


def pair_loss(positive: Column, negative: Column, margin: float = 0.0) -> Column:
    """log(1 + exp(negative - positive + margin)), without overflow."""
    x = negative - positive + F.lit(float(margin))
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def length_bin(count: Column) -> Column:
    """List-length bin; a count outside 1..10 is an error."""
    return (
        F.when(count == 1, "1").when(count.between(2, 3), "2-3").when(count.between(4, 6), "4-6")
        .when(count.between(7, 9), "7-9").when(count == 10, "10")
        .otherwise(F.raise_error(F.concat(F.lit("length out of range: "), count.cast("string"))))
    )


def rank_bin(rank: Column) -> Column:
    """Rank bin; a rank outside 1..10 is an error."""
    return (
        F.when(rank == 1, "1").when(rank == 2, "2").when(rank == 3, "3")
        .when(rank.between(4, 5), "4-5").when(rank.between(6, 10), "6-10")
        .otherwise(F.raise_error(F.concat(F.lit("rank out of range: "), rank.cast("string"))))
    )


def size_stratum(size: Column, bounds: list[tuple[str, int, int]]) -> Column:
    """Label of the closed range that holds ``size``; outside all is an error."""
    label: Column | None = None
    for name, low, high in bounds:
        hit = size.between(low, high)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(F.raise_error(F.lit("size outside every stratum")))


def larger_stratum(left: Column, right: Column) -> Column:
    """'0', '1-4' or '>=5' by the larger of two counts."""
    top = F.greatest(left, right)
    return F.when(top == 0, "0").when(top <= 4, "1-4").otherwise(">=5")


def verdict(low: Column, high: Column) -> Column:
    """Label of an interval relative to zero."""
    return (
        F.when(low.isNull() | high.isNull(), "missing").when(low > 0, "positive")
        .when(high < 0, "negative").otherwise("inconclusive")
    )


def interval_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(numerator, denominator)
