"""Step logs (run, step, value): summaries, gaps, intervals, running best (AG18 to AG20, AG25, W11 to W13, ST4 to ST7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_summary(log: DataFrame, run: str, step: str, value: str, window: int = 10) -> DataFrame:
    """AG18: first, last, least and largest value, and means of the first and last ``window`` (or all, if fewer).

    The ends of a run are taken within 32 parts of it first, so no task ranks a run as a whole; then from the 32 times
    ``window`` rows that are left.
    """
    rows = log.select(run, F.col(step).alias("s"), F.col(value).alias("v"))
    parts = [run, F.pmod(F.xxhash64("s"), F.lit(32))]
    base = rows.groupBy(run).agg(
        F.count("*").alias("n"), F.min_by("v", "s").alias("first_value"), F.max_by("v", "s").alias("last_value"), F.min("v").alias("min_value"),
        F.max("v").alias("max_value")
    )

    def end(order: Column, name: str) -> DataFrame:
        near = rows.withColumn("i", F.row_number().over(Window.partitionBy(*parts).orderBy(order))).where(F.col("i") <= window)
        near = near.withColumn("i", F.row_number().over(Window.partitionBy(run).orderBy(order))).where(F.col("i") <= window)
        return near.groupBy(run).agg(F.avg("v").alias(name))

    return base.join(end(F.asc("s"), "first_mean"), run).join(end(F.desc("s"), "last_mean"), run)


def argmin_step(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """AG19: step of the least value, the smallest of equal ones."""
    return log.groupBy(run).agg(F.min_by(step, F.struct(value, step)).alias("best_step"), F.min(value).alias("best_value"))


def change_from_start(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """AG20: best less first value, absolute and relative to the first."""
    a = log.groupBy(run).agg(F.min_by(value, step).alias("start_value"), F.min(value).alias("best_value"))
    return a.withColumn("change", F.col("best_value") - F.col("start_value")).withColumn(
        "relative_change", F.try_divide(F.col("best_value") - F.col("start_value"), F.col("start_value"))
    )


def running_best(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """ST6: least value so far, and whether the step improves on all before it (strictly)."""
    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(value).over(before)
    return log.select(run, step, value, F.least(best, F.col(value)).alias("best"), (best.isNull() | (F.col(value) < best)).alias("improved"))


def log_intervals(log: DataFrame, run: str, step: str, value: str, every: int) -> DataFrame:
    """ST5: means over ``every`` steps, a partial last window kept with its number of steps. Steps count from 1."""
    window = F.ceil(F.col(step) / every).cast("long")
    return log.groupBy(run, window.alias("window")).agg(F.count("*").alias("steps"), F.max(step).alias("end_step"), F.avg(value).alias("mean_value"))


def expected_steps(log: DataFrame, run: str, step: str, last: int | None, every: int, terminal: bool = True) -> DataFrame:
    """Steps 0, every, ... and, if asked, the last one, of each run; without ``last``, up to the run's own last step."""
    own = log.groupBy(run).agg((F.max(step) if last is None else F.lit(last)).cast("long").alias("last"))
    grid = F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(every).cast("long"))
    return own.select(run, F.explode(F.array_union(grid, F.array("last")) if terminal else grid).alias(step))


def step_gaps(log: DataFrame, run: str, step: str, last: int | None, every: int, terminal: bool = True) -> DataFrame:
    """Expected steps that are missing, and steps not expected."""
    want = expected_steps(log, run, step, last, every, terminal)
    have = log.select(run, F.col(step).cast("long").alias(step)).distinct()
    return want.join(have, [run, step], "left_anti").withColumn("kind", F.lit("missing")).unionByName(
        have.join(want, [run, step], "left_anti").withColumn("kind", F.lit("unexpected"))
    )


def not_increasing(log: DataFrame, run: str, order: str, step: str) -> DataFrame:
    """Rows whose step is not above the one before, in the log's order."""
    w = Window.partitionBy(run).orderBy(order)
    return log.withColumn("previous", F.lag(step).over(w)).where(F.col("previous").isNotNull() & (F.col(step) <= F.col("previous")))


def monotone_decline(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Whether every step is lower than the one before."""
    down = F.col(value) < F.lag(value).over(Window.partitionBy(run).orderBy(step))
    return log.withColumn("down", down).groupBy(run).agg(F.coalesce(F.bool_and("down"), F.lit(True)).alias("declines"))


def coverage(seen: DataFrame, pool: DataFrame, row: str, group: str) -> DataFrame:
    """AG25: distinct rows and groups seen, and shares of the pool."""
    a = seen.agg(F.countDistinct(row).alias("rows_seen"), F.countDistinct(group).alias("groups_seen"))
    b = pool.agg(F.countDistinct(row).alias("rows_all"), F.countDistinct(group).alias("groups_all"))
    out = a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])
    return out.withColumn("row_share", F.col("rows_seen") / F.col("rows_all")).withColumn("group_share", F.col("groups_seen") / F.col("groups_all"))


def accumulation(micro: Column, width: int) -> Column:
    """ST7: optimizer step of a micro step; the last one may be shorter."""
    return F.floor(micro / width).cast("long")


def rolled_back(log: DataFrame, step: str, at: int) -> tuple[DataFrame, DataFrame]:
    """ST4: what stays on a resume at a step, and what is archived before the log is cut."""
    return log.where(F.col(step) <= at), log.where(F.col(step) > at)


def grad_norm(values: Column) -> Column:
    """M6 over grouped rows."""
    return F.sqrt(F.sum(values * values))
