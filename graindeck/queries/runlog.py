"""Step-log queries: a run is an event type, its steps are its events in order, 1, 2, ..., its value the event's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graindeck.functions.stats import finite, warmup_cosine
from graindeck.operators import runlog
from graindeck.plans import verify
from graindeck.queries import query, rounded
from graindeck.schema import table

LOG = "with log as (select event_type as run, row_number() over (partition by event_type order by event_id) as step, value, event_id, user_id from events) "


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Steps by rank within the run: a run is one series, whose order is its meaning."""
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), "event_id", "user_id", "value")
    return e.withColumn("step", F.row_number().over(Window.partitionBy("run").orderBy("event_id")).cast("long"))


@query(
    LOG
    + ", r as (select *, row_number() over (partition by run order by step desc) as down from log) select run, count(*) as n, arg_min(value, step) as "
    "first_value, arg_max(value, step) as last_value, min(value) as min_value, max(value) as max_value, round(avg(value) filter (step <= 10), 6) as "
    "first_mean, round(avg(value) filter (down <= 10), 6) as last_mean from r group by run"
)
def series_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG18."""
    return rounded(runlog.series_summary(_log(spark, d), "run", "step", "value"), "first_mean", "last_mean")


@query(LOG + "select run, arg_min(step, (value, step)) as best_step, min(value) as best_value from log group by run")
def argmin_step(spark: SparkSession, d: str) -> DataFrame:
    """AG19."""
    return runlog.argmin_step(_log(spark, d), "run", "step", "value")


@query(
    LOG
    + ", c as (select run, arg_min(value, step) as start_value, min(value) as best_value from log group by run) select run, start_value, best_value, "
    "round(best_value - start_value, 6) as change, round((best_value - start_value) / nullif(start_value, 0), 6) as relative_change from c"
)
def change_from_start(spark: SparkSession, d: str) -> DataFrame:
    """AG20."""
    return rounded(runlog.change_from_start(_log(spark, d), "run", "step", "value"), "change", "relative_change")


@query(
    LOG
    + ", b as (select run, step, value, min(value) over (partition by run order by step rows between unbounded preceding and 1 preceding) as before from "
    "log) select run, step, value, least(before, value) as best, before is null or value < before as improved from b"
)
def running_best(spark: SparkSession, d: str) -> DataFrame:
    """ST6."""
    return runlog.running_best(_log(spark, d), "run", "step", "value")


@query(LOG + 'select run, (step + 49) // 50 as "window", count(*) as steps, max(step) as end_step, round(avg(value), 6) as mean_value from log group by 1, 2')
def log_intervals(spark: SparkSession, d: str) -> DataFrame:
    """ST5."""
    return rounded(runlog.log_intervals(_log(spark, d), "run", "step", "value", 50))


#: Checkpoints are due every 25 steps; those of some users stand for the ones that were lost.
_KEPT = (
    LOG
    + ", k as (select run, step - 1 as step from log where (step - 1) % 25 = 0 and user_id % 9 <> 0), e as (select run, "
    "unnest(list_distinct(list_append(range(0, n, 25), n - 1))) as step from (select run, max(step) as n from {} group by run)) "
)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("step", F.col("step") - 1)
    return log.where("step % 25 = 0 and user_id % 9 <> 0").select("run", "step")


@query(
    _KEPT.format("(select run, step + 1 as step from k)")
    + "select run, step, 'missing' as kind from (select run, step from e where run in (select run from k) except select run, step from k) union all select "
    "run, step, 'unexpected' from (select run, step from k except select run, step from e)"
)
def step_gaps(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    return runlog.step_gaps(_kept(spark, d), "run", "step", None, 25)


@query(
    LOG
    + ", p as (select run, event_id, user_id, lag(user_id) over (partition by run order by event_id) as previous from log) select run, event_id, user_id, "
    "previous from p where user_id <= previous"
)
def monotonic_check(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    return runlog.not_increasing(_log(spark, d).select("run", "event_id", "user_id"), "run", "event_id", "user_id")


@query(
    LOG
    + ", p as (select run, value < lag(value) over (partition by run order by step) as down from log) select run, coalesce(bool_and(down), true) as "
    "declines from p group by run"
)
def monotone_decline(spark: SparkSession, d: str) -> DataFrame:
    """W12."""
    return runlog.monotone_decline(_log(spark, d), "run", "step", "value")


@query(
    "with s as (select * from events where value > 150) select (select count(distinct user_id) from s) as rows_seen, (select count(distinct event_type) "
    "from s) as groups_seen, (select count(distinct user_id) from events) as rows_all, (select count(distinct event_type) from events) as groups_all, "
    "round((select count(distinct user_id) from s) / (select count(distinct user_id) from events), 6) as row_share, round((select count(distinct "
    "event_type) from s) / (select count(distinct event_type) from events), 6) as group_share"
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """AG25."""
    e = table(spark, d, "events")
    return rounded(runlog.coverage(e.where("value > 150"), e, "user_id", "event_type"))


@query(LOG + "select run, (step - 1) // 4 as optimizer_step, count(*) as micro_steps, round(avg(value), 6) as mean_value from log group by 1, 2")
def accumulation_groups(spark: SparkSession, d: str) -> DataFrame:
    """ST7."""
    return _log(spark, d).groupBy("run", runlog.accumulation(F.col("step") - 1, 4).alias("optimizer_step")).agg(
        F.count("*").alias("micro_steps"), F.round(F.avg("value"), 6).alias("mean_value")
    )


@query(
    LOG
    + "select run, step, round(case when step < 100 then greatest(step, 1) / 100.0 else 0.5 * (1 + cos(pi() * least(1, (step - 100) / 900.0))) end, 6) as "
    "factor from log"
)
def warmup_cosine_factors(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    return _log(spark, d).select("run", "step", F.round(warmup_cosine(F.col("step"), 100, 1000), 6).alias("factor"))


@query("select event_type, count(*) filter (not isnan(value) and abs(value) < 'infinity'::double) as n_finite, count(*) as n from events group by event_type")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    """F10."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(finite(F.col("value"))).alias("n_finite"), F.count("*").alias("n"))


@query(
    _KEPT.format("log")
    + ", h as (select run, step - 1 as step from log where (step - 1) % 25 = 0 and user_id % 2 = 0) select distinct e.run, e.step, case when k.step is not "
    "null then 'present' when h.step is not null then 'recoverable' else 'lost' end as status from e left join k using (run, step) left join h using "
    "(run, step)"
)
def recovery_inventory(spark: SparkSession, d: str) -> DataFrame:
    """D12."""
    log = _log(spark, d).withColumn("step", F.col("step") - 1)
    expected = runlog.expected_steps(log, "run", "step", None, 25)
    return verify.recovery_inventory(expected, _kept(spark, d), log.where("step % 25 = 0 and user_id % 2 = 0"), "run", "step")


_FAULTS = """with s as (select user_id as run, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, value from events),
log as (select run, event_id, i + case when run % 7 = 0 and i = 2 then 1 else 0 end as step, case when run % 5 = 0 and i = 1 then 'nan'::double else
  value end as value from s),
n as (select run, max(step) as last, count(distinct step) as steps, count(*) as rows, count(*) filter (isnan(value)) as bad, arg_min(value, (step,
  event_id)) as start, min(value) filter (not isnan(value)) as least from log group by run)
"""


@query(_FAULTS + """, c as (select run, bad = 0 as values_finite, steps = last + 1 as steps_complete, steps = rows as steps_increase, coalesce(least <
  start, false) as improves from n)
select *, values_finite and steps_complete and steps_increase and improves as passed from c""")
def verify_run(spark: SparkSession, d: str) -> DataFrame:
    """D13, F10, W11, W13, AG20: logs by user, some with a value that is no number, some with a step twice and one missing."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), "value", i.alias("step"))
    log = log.withColumn("value", F.when((F.col("run") % 5 == 0) & (F.col("step") == 1), F.lit(float("nan"))).otherwise(F.col("value")))
    log = log.withColumn("step", F.col("step") + F.when((F.col("run") % 7 == 0) & (F.col("step") == 2), 1).otherwise(0))
    return verify.verify_run(log, "run", "step", "value", None, 1)


@query(
    LOG
    + "select 'kept' as part, count(*) as n, max(step) as last_step from log where step <= 500 union all select 'archived', count(*), max(step) from log "
    "where step > 500"
)
def log_rollback(spark: SparkSession, d: str) -> DataFrame:
    """ST4."""
    kept, rest = runlog.rolled_back(_log(spark, d), "step", 500)
    total = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.max("step").alias("last_step"))
    return total(kept, "kept").union(total(rest, "archived"))
