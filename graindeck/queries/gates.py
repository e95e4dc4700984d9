"""Gate queries: runs are users, the steps of a run its events in order, the loss their value; recalls and reports are
made of the user's number, so that each rule holds for some runs and not for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graindeck.plans import gates
from graindeck.queries import query, rounded
from graindeck.schema import table

#: Validation every 25 steps up to 100.
_V = """with s as (select user_id as run, (row_number() over (partition by user_id order by event_id) - 1) * 25 as step, value as loss from events),
v as (select run, count(*) = 5 as steps_ok, arg_min(step, (loss, step)) as best, max(loss) filter (step = 0) as loss_0, max(loss) filter (step = 100)
  as loss_now from s where step <= 100 group by run),
"""
_E = """e as (select *, (run * 7919 % 1000)::double / 1000 as own_0, (run * 104729 % 1000)::double / 1000 as own_now, (run * 15485 % 1000)::double /
  1000 as official from v),
f as (select *, official + case when run % 11 = 0 then 0.001::double else 0::double end as other_0, official + (run * 31 % 41 - 20)::double / 1000 as
  other_now, case when run % 13 = 0 then 0 else best end as best_step, run % 17 <> 0 as completed from e),
g as (select run, best, own_now - own_0 as own_change, other_now - official as other_change, completed as report_describes_stage, steps_ok as
  validation_complete, best = best_step as best_step_agrees,
  abs(other_0 - official) <= 1e-12 as start_is_official, coalesce(loss_now < loss_0 and best <> 0, false) as validation_improves, own_now - own_0 > 0
  as own_recall_rises, other_now - official >= -0.01::double as other_recall_holds from f),
h as (select *, report_describes_stage and validation_complete and best_step_agrees and start_is_official as valid from g),
j as (select *, valid and validation_improves and own_recall_rises and other_recall_holds as passed from h)
"""


def _validation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    step = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) * 25
    return e.select(F.col("user_id").alias("run"), step.cast("long").alias("step"), F.col("value").alias("loss"))


def _part(factor: int) -> Column:
    return (F.col("run") * factor % 1000).cast("double") / 1000


def _stages(spark: SparkSession, d: str) -> DataFrame:
    v = _validation(spark, d)
    runs = v.where("step <= 100").groupBy("run").agg(F.min_by("step", F.struct("loss", "step")).alias("best"))
    other = _part(15485)
    moved = other + (F.col("run") * 31 % 41 - 20).cast("double") / 1000
    start = other + F.when(F.col("run") % 11 == 0, 0.001).otherwise(0.0)
    rows = [("own", 0, _part(7919)), ("own", 100, _part(104729)), ("other", None, other), ("other", 0, start), ("other", 100, moved)]
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(s).cast("long").alias("step"), c.alias("mean_recall")) for t, s, c in rows])).alias("x")
    reports = runs.select(
        "run", F.lit(100).alias("steps"), (F.col("run") % 17 != 0).alias("completed"), F.lit(0).alias("final_queue_size"),
        F.when(F.col("run") % 13 == 0, 0).otherwise(F.col("best")).alias("best_step"), F.array(F.lit(50)).cast("array<bigint>").alias("resume_steps")
    )
    return gates.stage_gate(reports, v, runs.select("run", rows).select("run", "x.*"), "run", 100, 25, 100, [50])


@query(_V + _E + "select * replace (round(own_change, 9) as own_change, round(other_change, 9) as other_change) from j")
def gate_stages(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of a stage, for every run."""
    return rounded(_stages(spark, d), "own_change", "other_change", places=9)


_PARTS = """, k as (select run // 3 as family, run % 3 as stage, passed, validation_improves, own_recall_rises, other_recall_holds, valid, run from j),
l as (select family, stage, case when run % 19 = 0 then not passed else passed end as passed, valid and validation_improves and own_recall_rises and
  other_recall_holds as truth, case when run % 23 = 0 then null else 'c' || (run % 29 = 0) end as c, run from k)
"""


@query(_V + _E + _PARTS + """, m as (select family, count(*) = 3 as all_stages, bool_and(truth = passed) as verdicts_agree, count(distinct c) = 1 and
  count(c) = count(*) as one_commit, bool_and(passed) as stages_pass from l group by family)
select *, all_stages and verdicts_agree and one_commit as valid, all_stages and verdicts_agree and one_commit and stages_pass as passed from m""")
def gate_final(spark: SparkSession, d: str) -> DataFrame:
    """Three stages of a family of runs together."""
    checks = F.create_map(*[x for c in ("valid", "validation_improves", "own_recall_rises", "other_recall_holds") for x in (F.lit(c), F.col(c))])
    wrong = F.when(F.col("run") % 19 == 0, ~F.col("passed")).otherwise(F.col("passed"))
    commit = F.when(F.col("run") % 23 != 0, F.concat(F.lit("c"), (F.col("run") % 29 == 0).cast("string")))
    rows = _stages(spark, d).select(
        F.floor(F.col("run") / 3).alias("family"), (F.col("run") % 3).alias("stage"), wrong.alias("passed"), checks.alias("checks"), commit.alias("commit")
    )
    return gates.final_gate(rows, "family", [0, 1, 2])


@query(_V + _E + """, k as (select run // 3 as family, run % 3 as seed, passed, 'p' || (run % 31 = 0) as protocol, own_change, other_change from j),
m as (select family, count(*) = 3 as all_seeds, count(distinct protocol) = 1 as one_protocol, bool_and(passed) as seeds_pass, round(avg(own_change),
  9) as own_change_mean, round(stddev_samp(own_change), 9) as own_change_std,
  round(avg(other_change), 9) as other_change_mean, round(stddev_samp(other_change), 9) as other_change_std from k group by family)
select *, all_seeds and one_protocol as valid, all_seeds and one_protocol and seeds_pass as passed from m""")
def gate_seeds(spark: SparkSession, d: str) -> DataFrame:
    """D3, AG4: three seeds of one protocol."""
    protocol = F.concat(F.lit("p"), (F.col("run") % 31 == 0).cast("string")).alias("protocol")
    rows = _stages(spark, d).select(
        F.floor(F.col("run") / 3).alias("family"), (F.col("run") % 3).alias("seed"), "passed", protocol, "own_change", "other_change"
    )
    return rounded(gates.seeds_gate(rows, "family", [0, 1, 2], "own_change", "other_change"), places=9)


@query("""with s as (select user_id as run, (row_number() over (partition by user_id order by event_id) - 1) as step, value from events),
r as (select run, count(*) as n, arg_min(value, step) as start, min(value) as best from s group by run),
p as (select run, (run % 7 <> 0) as cut_off, start <> 0 as improvement_finite, run % 5 <> 0 as best_agrees, run % 11 <> 0 as evidence_known,
  coalesce(start <> 0 and (best - start) / nullif(start, 0) < 0, false) as improves,
  run % 11 <> 0 as evidence_suffices, run % 3 = 0 as degraded from r),
q as (select *, cut_off and improvement_finite and best_agrees and evidence_known as valid from p),
t as (select *, valid and improves and evidence_suffices as passed from q)
select run, cut_off, improvement_finite, best_agrees, evidence_known, improves, evidence_suffices, valid, passed, case when passed and degraded then
  'degraded evidence' end as warning from t""")
def gate_pilot(spark: SparkSession, d: str) -> DataFrame:
    """Pilots by user, better than at their start."""
    s = _validation(spark, d).groupBy("run").agg(F.min_by("loss", "step").alias("start"), F.min("loss").alias("best"))
    evidence = F.when(F.col("run") % 11 == 0, "unknown").when(F.col("run") % 3 == 0, "degraded").otherwise("complete")
    reports = s.select(
        "run", F.lit(500).alias("steps"), F.lit(5000).alias("target_steps"), (F.col("run") % 7 == 0).alias("completed"), F.try_divide(
            F.col("best") - F.col("start"), F.col("start")
        ).alias("improvement"),
        (
            F.col("run") % 5 != 0
        ).alias("best_step_agrees"), F.lit(True).alias("best_loss_agrees"), F.lit(True).alias("best_file_agrees"), evidence.alias("evidence"),
    )
    return gates.pilot_gate(reports, "run", 500, 5000, allow_degraded=True)


@query("""with s as (select user_id as run, row_number() over (partition by user_id order by event_id) as ord, value as loss from events),
m as (select *, case when run % 7 = 0 and ord = 2 then 1 else ord end as step, case when run % 5 = 0 then -1 else 100 end as peak from s),
w as (select run, ord, step, lag(step) over (partition by run order by ord) as previous, peak from m),
a as (select run, bool_and(step between 1 and 6) as allowed, count(distinct step) filter (step between 1 and 6) as n_logged, bool_and(previous is null
  or step > previous) as rising, bool_and(peak > 0) as peaks_positive from w group by run),
v as (select run, count(*) = 3 as validation_complete, arg_min((ord - 1) * 3, (loss, ord)) as best from s where ord <= 3 group by run),
z as (select run, best, allowed and n_logged = 6 and rising as metric_steps, true as metrics_finite, peaks_positive, run % 11 <> 0 as summary_steps,
  run % 13 <> 0 or run % 2 = 0 as summary_finite, validation_complete, best = case when run % 17 = 0 then 3 else best end as best_step_agrees
  from a join v using (run))
select *, metric_steps and metrics_finite and peaks_positive and summary_steps and summary_finite and validation_complete and best_step_agrees as valid,
  metric_steps and metrics_finite and peaks_positive and summary_steps and summary_finite and validation_complete and best_step_agrees as passed from z""")
def gate_training(spark: SparkSession, d: str) -> DataFrame:
    """Logs, summaries and validation of every run against each other; six steps are due."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("ord"),
        F.col("value").alias("loss")
    )
    step = F.when((F.col("run") % 7 == 0) & (F.col("ord") == 2), 1).otherwise(F.col("ord")).cast("long")
    metrics = e.select(
        "run", "ord", step.alias("step"), "loss", F.col("loss").alias("gradient_norm"), F.lit(1.0).alias("logit_scale"),
        F.when(F.col("run") % 5 == 0, -1).otherwise(100).alias("peak_bytes")
    )
    validation = e.where("ord <= 3").select("run", ((F.col("ord") - 1) * 3).alias("step"), "loss")
    best = validation.groupBy("run").agg(F.min_by("step", F.struct("loss", "step")).alias("best"), F.max("loss").alias("final_loss"))
    bad = F.col("run") % 13 == 0
    summaries = best.select(
        "run", F.when(
            F.col("run") % 11 == 0, 5
        ).otherwise(6).alias("steps"), F.lit(6).alias("target_steps"), F.lit(True).alias("completed"), F.lit(1).alias("log_every"), F.lit(False).alias("log_at_end"), F.lit("gpu").alias("device"),
        F.lit(True).alias("all_losses_finite"), (~bad).alias("all_gradients_finite"), F.lit(True).alias(
            "all_applied_gradients_finite"
        ), F.when(F.col("run") % 2 == 0, 4).otherwise(0).alias("skipped_optimizer_steps"),
        "final_loss", F.when(F.col("run") % 17 == 0, 3).otherwise(F.col("best")).alias("best_step"), F.lit(None).cast("array<bigint>").alias("resume_steps"),
    )
    return gates.training_gate(metrics, summaries, validation, "run", 6, 6, 3, True)
