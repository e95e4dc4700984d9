"""Whole-run verification and reports, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.functions.stats import finite
from graindeck.operators import drift, quality, runlog
from graindeck.operators.decide import gate
from graindeck.schema import ConstraintError


def recovery_inventory(expected: DataFrame, retained: DataFrame, history: DataFrame, run: str, step: str) -> DataFrame:
    """Each expected checkpoint step: present, recoverable (named in the history) or lost."""
    out = expected.join(
        retained.select(run, step).distinct().withColumn("kept", F.lit(True)), [run, step], "left"
    ).join(history.select(run, step).distinct().withColumn("noted", F.lit(True)), [run, step], "left")
    return out.select(run, step, F.when(F.col("kept"), "present").when(F.col("noted"), "recoverable").otherwise("lost").alias("status"))


def verify_run(log: DataFrame, run: str, step: str, value: str, last: int | None, every: int) -> DataFrame:
    """By run: finite values, increasing steps, no gaps, an improvement on the start, and whether all hold."""
    gaps = runlog.step_gaps(log, run, step, last, every).groupBy(run).agg(F.count("*").alias("n_gaps"))
    change = runlog.change_from_start(log, run, step, value).select(run, "change")
    unordered = runlog.not_increasing(log, run, step, step).groupBy(run).agg(F.count("*").alias("n_repeats"))
    base = log.groupBy(run).agg(F.count_if(~finite(F.col(value))).alias("n_bad"))
    out = base.join(change, run).join(gaps, run, "left").join(unordered, run, "left").na.fill(0, ["n_gaps", "n_repeats"])
    return gate(
        out,
        {
            "values_finite": F.col("n_bad") == 0, "steps_complete": F.col("n_gaps") == 0, "steps_increase": F.col("n_repeats") == 0,
            "improves": F.col("change") < 0
        },
        run
    )


def downstream_summary(reports: DataFrame, model: str, dataset: str, value: str, asset: str) -> DataFrame:
    """Mean value by model, with every dataset seen once and one asset digest over all."""
    return reports.groupBy(model).agg(
        F.count("*").alias("n_reports"), F.countDistinct(dataset).alias("n_datasets"), F.avg(value).alias("mean_value"),
        ((F.min(asset) == F.max(asset)) & (F.count(asset) == F.count("*"))).alias("same_assets")
    )


def asset_inventory(files: DataFrame) -> DataFrame:
    """D17, AG29: files and bytes by suffix."""
    return files.groupBy(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("suffix")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def reference_report(refs: DataFrame, files: DataFrame, ref: str, path: str) -> DataFrame:
    """References by status."""
    return quality.resolve_references(refs, files, ref, path).groupBy("status").agg(F.count("*").alias("n"))


def final_gate(stages: DataFrame, run: str, passed: str, *shared: str) -> DataFrame:
    """By run, whether every stage passed and each shared field has one value over them."""
    same = [((F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))).alias(f"same_{c}") for c in shared]
    out = stages.groupBy(run).agg(F.count("*").alias("n_stages"), F.bool_and(F.coalesce(passed, F.lit(False))).alias("stages_passed"), *same)
    ok = F.col("stages_passed")
    for c in shared:
        ok = ok & F.col(f"same_{c}")
    return out.withColumn("passed", ok)


def init_parity(reference: DataFrame, observed: DataFrame, name: str, index: str, value: str, atol: float, rtol: float) -> DataFrame:
    """Values of two models (name, index, value) against each other; other names or shapes are an error."""
    pairs = reference.select(name, index, F.col(value).alias("r")).join(observed.select(name, index, F.col(value).alias("o")), [name, index], "full")
    if bad := pairs.where("r is null or o is null").limit(1).collect():
        raise ConstraintError(f"a value on one side only: {bad[0][name]}[{bad[0][index]}]")
    return drift.parity(pairs, name, "r", "o", atol, rtol)
