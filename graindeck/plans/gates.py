"""Gates of experiments as tables: a row for each run with every check and the verdict.

An input that breaks a rule of its format makes a run invalid, and an invalid run never passes; a check that cannot be
worked out fails. So nothing is skipped silently, and one plan judges any number of runs.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.functions.stats import finite
from graindeck.schema import ConstraintError


def verdict(df: DataFrame, integrity: dict[str, Column], checks: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each rule, valid (all of integrity hold) and passed (valid, and all checks hold)."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    out = df.withColumns({n: sure(c) for n, c in (integrity | checks).items()})
    every = lambda names: F.forall(F.array(*[F.col(n) for n in names]), lambda x: x)
    return out.withColumn("valid", every(integrity)).withColumn("passed", F.col("valid") & every(checks))


def exact_steps(step: str, last: int, every: int) -> Column:
    """Aggregate: the steps are 0, every, ..., last, each once."""
    n = last // every + 1
    on = (F.col(step) >= 0) & (F.col(step) <= last) & (F.col(step) % every == 0)
    return (F.count("*") == n) & (F.count_if(on) == n) & (F.countDistinct(step) == n)


def stage_gate(
    reports: DataFrame, validation: DataFrame, evaluations: DataFrame, run: str, stage: int, every: int, last_stage: int, resumed_at: list[int],
    margin: float = 0.01, tolerance: float = 1e-12
) -> DataFrame:
    """A run at a stage of its training.

    reports (run, steps, completed, final_queue_size, best_step, resume_steps), validation (run, step, loss), evaluations
    (run, task "own" or "other", step, null for the official weights, mean_recall). Integrity: the report describes the
    stage, the validation steps up to it are complete and finite, the report's best step is theirs (the first of equal
    ones), and step 0 equals the official weights on the other task. Checks: the loss is below that of step 0 and step 0 is
    not the best; the recall on the own task is above that of step 0; that on the other task is at most ``margin`` below
    the official one.
    """
    upto = validation.where(F.col("step") <= stage)
    loss = lambda s: F.max(F.when(F.col("step") == s, F.col("loss")))
    v = upto.groupBy(run).agg(
        (exact_steps("step", stage, every) & F.bool_and(finite(F.col("loss")))).alias("steps_ok"), F.min_by("step", F.struct("loss", "step")).alias("best"),
        loss(0).alias("loss_0"), loss(stage).alias("loss_now"),
    )
    recall = lambda task, s: F.max(F.when((F.col("task") == task) & F.col("step").eqNullSafe(F.lit(s)), F.col("mean_recall")))
    e = evaluations.groupBy(run).agg(
        recall("own", 0).alias("own_0"), recall("own", stage).alias("own_now"), recall("other", None).alias("official"), recall("other", 0).alias("other_0"),
        recall("other", stage).alias("other_now"), F.bool_and(finite(F.col("mean_recall"))).alias("recalls_finite"),
    )
    out = reports.join(v, run, "left").join(e, run, "left")
    out = out.withColumn("own_change", F.col("own_now") - F.col("own_0")).withColumn("other_change", F.col("other_now") - F.col("official"))
    integrity = {
        "report_describes_stage": (F.col("steps") == stage) & (F.col("completed") == F.lit(stage == last_stage)) & (F.col("final_queue_size") == 0) & (
            F.col("resume_steps") == F.array(*map(F.lit, resumed_at)).cast("array<bigint>")
        ),
        "validation_complete": F.col("steps_ok"), "best_step_agrees": F.col("best") == F.col("best_step"),
        "start_is_official": F.col("recalls_finite") & (F.abs(F.col("other_0") - F.col("official")) <= tolerance),
    }
    checks = {
        "validation_improves": (F.col("loss_now") < F.col("loss_0")) & (F.col("best") != 0), "own_recall_rises": F.col("own_change") > 0,
        "other_recall_holds": F.col("other_change") >= -margin
    }
    return verdict(out, integrity, checks).select(run, "best", "own_change", "other_change", *integrity, *checks, "valid", "passed")


def final_gate(stages: DataFrame, run: str, expected: list[int]) -> DataFrame:
    """All stages (run, stage, passed, checks, a map by name, commit) of a run. Integrity: exactly the expected stages,
    each with checks whose conjunction is its verdict, and one commit; the verdict is that of all stages."""
    agrees = F.coalesce(F.forall(F.map_values("checks"), lambda x: x) == F.col("passed"), F.lit(False)) & (F.size("checks") > 0)
    out = stages.groupBy(run).agg(
        (
            F.sort_array(F.collect_list("stage")) == F.sort_array(F.array(*map(F.lit, expected)).cast(dict(stages.dtypes)["stage"].join(("array<", ">"))))
        ).alias("all_stages"),
        F.bool_and(agrees).alias("verdicts_agree"), (
            (F.countDistinct("commit") == 1) & (F.count("commit") == F.count("*"))
        ).alias("one_commit"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("stages_pass"),
    )
    integrity = {n: F.col(n) for n in ("all_stages", "verdicts_agree", "one_commit")}
    return verdict(out, integrity, {"stages_pass": F.col("stages_pass")}).select(run, *integrity, "stages_pass", "valid", "passed")


def seeds_gate(seeds: DataFrame, by: str, expected: list[int], *values: str) -> DataFrame:
    """D3: runs of several seeds (by, seed, passed, protocol, values): exactly the expected seeds, one protocol, every seed
    passes; mean and sample deviation of each value."""
    kind = dict(seeds.dtypes)["seed"]
    out = seeds.groupBy(by).agg(
        (F.sort_array(F.collect_list("seed")) == F.sort_array(F.array(*map(F.lit, expected)).cast(f"array<{kind}>"))).alias("all_seeds"),
        (
            (F.countDistinct("protocol") == 1) & (F.count("protocol") == F.count("*"))
        ).alias("one_protocol"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("seeds_pass"),
        *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
    )
    integrity = {n: F.col(n) for n in ("all_seeds", "one_protocol")}
    return verdict(out, integrity, {"seeds_pass": F.col("seeds_pass")})


def pilot_gate(reports: DataFrame, run: str, steps: int, target: int, allow_degraded: bool = False) -> DataFrame:
    """Pilots (run, steps, target_steps, completed, improvement, three agreements of the best checkpoint, evidence): cut
    off at ``steps`` of a schedule of ``target``, better than at the start, with whole evidence (or, if allowed, degraded)."""
    kinds = ["complete", "degraded"] if allow_degraded else ["complete"]
    integrity = {
        "cut_off": (F.col("steps") == steps) & (F.col("target_steps") == target) & ~F.col("completed"), "improvement_finite": finite(F.col("improvement")),
        "best_agrees": F.col("best_step_agrees") & F.col("best_loss_agrees") & F.col("best_file_agrees"), "evidence_known": F.col("evidence").isin(
            "complete", "degraded"
        ),
    }
    checks = {"improves": F.col("improvement") < 0, "evidence_suffices": F.col("evidence").isin(kinds)}
    out = verdict(reports, integrity, checks)
    return out.select(
        run, *integrity, *checks, "valid", "passed", F.when(F.col("passed") & (F.col("evidence") == "degraded"), "degraded evidence").alias("warning")
    )


def training_gate(
    metrics: DataFrame, summaries: DataFrame, validation: DataFrame, run: str, steps: int, target: int, validation_every: int, completed: bool
) -> DataFrame:
    """A run's own records against each other.

    metrics (run, ord, step, loss, gradient_norm, logit_scale, peak_bytes), summaries (run, steps, target_steps, completed,
    log_every, log_at_end, device, all_losses_finite, all_gradients_finite, all_applied_gradients_finite,
    skipped_optimizer_steps, final_loss, best_step, resume_steps), validation (run, step, loss). Metric steps rise in the
    file's order; they are the logged ones, and at a logged end the last and, if it was resumed, the resume steps may be
    there too. Unfinite gradients are allowed if their steps were skipped and counted.
    """
    last = F.max(F.struct("ord", "step")).alias("end")
    number = lambda c: F.bool_and(finite(F.col(c)))
    gaps = metrics.select(run, "ord", "step").join(metrics.select(run, (F.col("ord") + 1).alias("ord"), F.col("step").alias("previous")), [run, "ord"])
    order = gaps.groupBy(run).agg(F.bool_and(F.col("step") > F.col("previous")).alias("rising"))
    m = metrics.join(
        summaries.select(run, "log_every", "log_at_end", "device", "resume_steps"), run
    ).withColumn("logged", F.col("step") % F.col("log_every") == 0)
    extra = F.col("log_at_end") & ((F.col("step") == steps) | F.array_contains(F.coalesce("resume_steps", F.array().cast("array<bigint>")), F.col("step")))
    inside = (F.col("step") > 0) & (F.col("step") <= steps)
    peak = F.when(F.col("peak_bytes").isNull(), F.col("device") == "cpu").otherwise(F.col("peak_bytes") > 0)
    m = m.groupBy(run).agg(
        F.bool_and(inside & (F.col("logged") | extra)).alias("steps_allowed"), F.countDistinct(
            F.when(F.col("logged") & inside, F.col("step"))
        ).alias("n_logged"), F.bool_or(F.col("step") == steps).alias("has_last"),
        (number("loss") & number("gradient_norm") & number("logit_scale")).alias("metrics_finite"), F.bool_and(peak).alias("peaks_positive"), last,
    )
    v = validation.where(F.col("step") <= steps).groupBy(run).agg(
        (exact_steps("step", steps, validation_every) & number("loss")).alias("validation_complete"), F.min_by("step", F.struct("loss", "step")).alias("best")
    )
    out = summaries.join(m, run, "left").join(v, run, "left").join(order, run, "left")
    skipped = F.col("all_applied_gradients_finite") & (F.col("skipped_optimizer_steps") > 0)
    integrity = {
        "metric_steps": F.col("steps_allowed") & (
            F.col("n_logged") == F.floor(F.lit(steps) / F.col("log_every"))
        ) & (~F.col("log_at_end") | F.col("has_last")) & F.coalesce("rising", F.lit(True)),
        "metrics_finite": F.col("metrics_finite"), "peaks_positive": F.col("peaks_positive"),
        "summary_steps": (F.col("steps") == steps) & (F.col("target_steps") == target) & (F.col("completed") == F.lit(completed)),
        "summary_finite": F.col("all_losses_finite") & (F.col("all_gradients_finite") | F.coalesce(skipped, F.lit(False))) & finite(F.col("final_loss")),
        "validation_complete": F.col("validation_complete"), "best_step_agrees": F.col("best") == F.col("best_step"),
    }
    return verdict(out, integrity, {}).select(run, "best", *integrity, "valid", "passed")


def require_fields(report: dict[str, Any], expected: dict[str, Any]) -> None:
    """Fields of a report by dotted path have these values; a set names the values that are allowed. All that differ are
    named in the error."""
    bad = {}
    for path, want in expected.items():
        at: Any = report
        for part in path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at not in want if isinstance(want, set) else (at != want or type(at) is not type(want)):
            bad[path] = at
    if bad:
        raise ConstraintError(f"fields of the report that are not as expected: {bad}")
