"""Comparisons and decisions: paired deltas, gates, Pareto frontier, rankings, diffs (AG21 to AG23, J16 to J18, D1 to D8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.operators.select import range_part
from graindeck.schema import ConstraintError

def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str, strict: bool = True) -> DataFrame:
    """Rows of equal keys side by side (left_value, right_value); strict: a key on one side only is an error."""
    left, right = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    out = left.join(right, keys, "full" if strict else "inner")
    if strict and (bad := out.where("left_value is null or right_value is null").limit(3).collect()):
        raise ConstraintError(f"keys without a partner: {[r.asDict() for r in bad]}")
    return out


def delta_points(pairs: DataFrame, *by: str) -> DataFrame:
    """AG23: differences in percentage points within a pair, then mean and sample deviation over pairs (AG4)."""
    d = pairs.withColumn("delta", 100 * (F.col("left_value") - F.col("right_value")))
    return d.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean_pp"), F.stddev_samp("delta").alias("std_pp"))


def leaf_statistics(leaves: DataFrame, path: str, value: str) -> DataFrame:
    """AG21 over trees flattened to (path, value): mean and sample deviation at each leaf."""
    return leaves.groupBy(path).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def leaf_difference(a: DataFrame, b: DataFrame, path: str, value: str) -> DataFrame:
    """AG22: left less right at each leaf."""
    return paired(a, b, [path], value).select(path, (F.col("left_value") - F.col("right_value")).alias("difference"))


def difference_of_differences(df: DataFrame, key: str, arm: str, phase: str, value: str, arms: tuple[str, str], phases: tuple[str, str]) -> DataFrame:
    """(arm 1 after - before) - (arm 0 after - before) for each key."""
    at = lambda a, p: F.avg(F.when((F.col(arm) == a) & (F.col(phase) == p), F.col(value)))
    return df.groupBy(key).agg(((at(arms[1], phases[1]) - at(arms[1], phases[0])) - (at(arms[0], phases[1]) - at(arms[0], phases[0]))).alias("dd"))


def gate(df: DataFrame, rules: dict[str, Column], *by: str) -> DataFrame:
    """Each rule over all rows of a run, and their conjunction. A null verdict fails."""
    out = df.groupBy(*by).agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    passed = F.lit(True)
    for n in rules:
        passed = passed & F.col(n)
    return out.withColumn("passed", passed)


def promoted(final: Column, base: Column, margin: float) -> Column:
    """D7."""
    return final >= F.greatest(F.lit(0.0), base - margin)


def pareto_frontier(df: DataFrame, loss: str, recall: str) -> DataFrame:
    """Rows that no row dominates (no worse in both, better in one).

    A row is dominated if one of smaller loss has at least its recall, or one of equal loss a larger one. So it is
    enough to know the best recall at each smaller loss: a running maximum over ranges of losses, and within them,
    not a join of all pairs.
    """
    best = range_part(df.groupBy(loss).agg(F.max(recall).alias("best_here")), loss)
    before = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    tops = best.groupBy("range").agg(F.max("best_here").alias("top")).withColumn("top_before", F.max("top").over(before(F.lit(0)).orderBy("range"))).drop("top")
    best = best.withColumn("best_before", F.max("best_here").over(before("range").orderBy(loss))).join(F.broadcast(tops), "range")
    best = best.withColumn("best_before", F.greatest("best_before", "top_before")).drop("range", "top_before")
    out = df.join(best, loss)
    return out.where(
        (F.col(recall) == F.col("best_here")) & (F.col("best_before").isNull() | (F.col("best_before") < F.col(recall)))
    ).drop("best_here", "best_before")


def ranking(df: DataFrame, eligible: str, order: list[Column], fall_back: bool = False) -> DataFrame:
    """Eligible rows by several keys with their place; with fall_back all rows if none is eligible."""
    none = ~F.coalesce(df.agg(F.bool_or(eligible)).scalar(), F.lit(False)) if fall_back else F.lit(False)
    rows = df.where(F.col(eligible) | none)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def config_difference(a: DataFrame, b: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Leaf paths of two flattened configurations that differ or are on one side only."""
    left, right = a.select(path, F.col(value).alias("left_value"), F.lit(True).alias("l")), b.select(
        path, F.col(value).alias("right_value"), F.lit(True).alias("r")
    )
    out = left.join(right, path, "full")
    kind = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only").otherwise("differs")
    return out.where(
        F.col("l").isNull() | F.col("r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))
    ).select(path, "left_value", "right_value", kind.alias("kind"))


def flattened(tree: dict, above: str = "") -> dict[str, str]:
    """Leaf paths of a nested dict, values as JSON."""
    import json

    out = {}
    for k, v in tree.items():
        at = f"{above}.{k}" if above else str(k)
        out |= flattened(v, at) if isinstance(v, dict) and v else {at: json.dumps(v, sort_keys=True)}
    return out


def approved_difference(a: dict, b: dict, approved: set[str]) -> None:
    """Two configurations have the same paths and differ in exactly the approved ones."""
    x, y = flattened(a), flattened(b)
    if x.keys() != y.keys():
        raise ConstraintError(f"paths on one side only: {sorted(x.keys() ^ y.keys())}")
    if (found := {k for k in x if x[k] != y[k]}) != approved:
        raise ConstraintError(f"paths that differ: {sorted(found)}; approved: {sorted(approved)}")
