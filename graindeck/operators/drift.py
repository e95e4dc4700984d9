"""Embedding drift and parity (AG5, AG15, AG27, M2, M3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.functions.stats import linear_percentile
from graindeck.functions.vector import cosine, l2_distance, unit


def distances(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine, cosine distance and L2 distance of the unit vectors of each row."""
    u = pairs.withColumn("ua", unit(F.col(a))).withColumn("ub", unit(F.col(b)))
    return u.withColumn("cosine", cosine(F.col("ua"), F.col("ub"))).withColumn("cosine_distance", 1 - F.col("cosine")).withColumn(
        "l2", l2_distance(F.col("ua"), F.col("ub"))
    ).drop("ua", "ub")


def distribution(value: str) -> list[Column]:
    """AG5: mean, population deviation, smallest, p05 and p95 (AG8), lower median (AG7), largest."""
    c = F.col(value)
    named = {
        "mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "p05": linear_percentile(c, 0.05),
        "median": F.expr(f"percentile_disc(0.5) within group (order by `{value}`)"), "p95": linear_percentile(c, 0.95), "max": F.max(c),
    }
    return [x.alias(f"{value}_{k}") for k, x in named.items()]


def fractions_above(value: str, thresholds: tuple[float, ...] = (1e-4, 1e-3, 1e-2)) -> list[Column]:
    """AG15: shares strictly above each threshold."""
    return [F.avg((F.col(value) > t).cast("double")).alias(f"above_{i}") for i, t in enumerate(thresholds)]


def drift_summary(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    return distances(pairs, a, b).groupBy(*by).agg(
        F.count("*").alias("n"), *distribution("cosine_distance"), *distribution("l2"), *fractions_above("cosine_distance")
    )


def parity(pairs: DataFrame, name: str, reference: str, observed: str, atol: float, rtol: float) -> DataFrame:
    """AG27 by name: largest absolute and relative error, and whether all are close (the observed side scales rtol)."""
    r, o = F.col(reference).cast("double"), F.col(observed).cast("double")
    err = F.abs(r - o)
    least = max(atol, 2.220446049250313e-16)
    return pairs.groupBy(name).agg(
        F.max(err).alias("max_abs"), F.max(err / F.greatest(F.abs(r), F.lit(least))).alias("max_rel"),
        F.bool_and(err <= atol + rtol * F.abs(o)).alias("close")
    )
