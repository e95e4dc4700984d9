"""Aggregates that have more than one reading: three percentiles, two deviations (AG4 to AG8), and step functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_median(name: str) -> Column:
    """AG7 of a column: of an even number, the lower of the two in the middle."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{name}`)")


def linear_percentile(x: Column, p: float) -> Column:
    """AG8: linear between neighbours."""
    return F.percentile(x, F.lit(p))


def finite(x: Column) -> Column:
    """a number, not NaN and not infinite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Factor of the learning rate at a step: linear to 1, then half a cosine to 0."""
    up = F.greatest(step, F.lit(1)) / F.lit(float(max(1, warmup)))
    down = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))))
    return F.when(step < warmup, up).otherwise(down)


def log_sum_exp(values: Column) -> Column:
    """Over an array, with the largest value taken out first."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
