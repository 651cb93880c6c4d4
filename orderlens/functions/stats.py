"""Aggregates and ratios used by more than one operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, otherwise: float | None = None) -> Column:
    """``top / bottom``; ``otherwise`` where the divisor is zero or missing."""
    value = F.try_divide(top, bottom)
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def coefficient_of_variation(std: Column, mean: Column) -> Column:
    """Spread relative to a positive mean, else 0."""
    return F.when(mean > 0, F.try_divide(std, mean)).otherwise(F.lit(0.0))


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; NULL below three values or without spread."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, corrected)


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values or without spread."""
    n = F.count(value).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, factor * ((n + 1) * F.kurtosis(value) + 6))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def iqr_bounds(q25: Column, q75: Column, reach: float = 1.5) -> tuple[Column, Column]:
    spread = (q75 - q25) * reach
    return q25 - spread, q75 + spread


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


# --- forecast accuracy, as aggregates over actual and predicted rows -------------------


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mape(actual: Column, predicted: Column) -> Column:
    """Percentage error over non-zero actuals; NULL when every actual is zero."""
    return F.avg(F.when(actual != 0, F.abs((actual - predicted) / actual))) * 100


def mase(actual: Column, predicted: Column, step: Column) -> Column:
    """Error relative to the naive one; ``step`` is the change since the row before."""
    naive = F.avg(F.abs(step))
    return F.when(naive > 0, F.try_divide(mae(actual, predicted), naive))


def wape(actual: Column, predicted: Column) -> Column:
    return F.try_divide(F.sum(F.abs(actual - predicted)), F.sum(F.abs(actual)))


def weighted_quantile_loss(actual: Column, predicted: Column, q: float) -> Column:
    miss = actual - predicted
    pinball = F.greatest(F.lit(q) * miss, F.lit(q - 1.0) * miss)
    return F.try_divide(2 * F.sum(pinball), F.sum(F.abs(actual)))
