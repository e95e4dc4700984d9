"""Comparison and decision queries: arms are return flag and line status, seeds are line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.operators import decide
from graindeck.plans import verify
from graindeck.queries import query, rounded
from graindeck.schema import table

_ARMS = (
    "with a as (select l_linestatus as arm, l_linenumber as seed, l_returnflag as dataset, avg(l_discount) as v, avg(l_tax) as w, avg(l_quantity) as q, "
    "count(*) as n from lineitem group by all) "
)


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("dataset")).agg(
        F.avg("l_discount").alias("v"), F.avg("l_tax").alias("w"), F.avg("l_quantity").alias("q"), F.count("*").alias("n")
    )


_PAIR = ", p as (select x.seed, x.dataset, 100 * (x.v - y.v) as delta from a x join a y using (seed, dataset) where x.arm = 'F' and y.arm = 'O') "


@query(_ARMS + _PAIR + "select dataset, count(*) as n_pairs, round(avg(delta), 6) as mean_pp, round(stddev_samp(delta), 6) as std_pp from p group by dataset")
def paired_delta_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """AG23, AG4, J16: differences within a seed, then mean and deviation."""
    a = _arms(spark, d)
    pairs = decide.paired(a.where("arm = 'F'"), a.where("arm = 'O'"), ["seed", "dataset"], "v", strict=False)
    return rounded(decide.delta_points(pairs, "dataset"))


_LEAF = (
    _ARMS
    + ", l as (select arm, seed, 'metrics.' || dataset || '.' || m as path, x from (select arm, seed, dataset, unnest(['discount', 'tax', 'quantity']) as "
    "m, unnest([v, w, q]) as x from a)) "
)


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    parts = F.explode(
        F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("x")) for m, c in (("discount", "v"), ("tax", "w"), ("quantity", "q"))])
    ).alias("l")
    return _arms(spark, d).select("arm", "seed", "dataset", parts).select(
        "arm", "seed", F.concat_ws(".", F.lit("metrics"), "dataset", "l.m").alias("path"), F.col("l.x").alias("x")
    )


@query(_LEAF + "select path, count(*) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std from l group by path")
def nested_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG21 in long form."""
    return rounded(decide.leaf_statistics(_leaves(spark, d), "path", "x"))


@query(
    _LEAF
    + "select f.path, round(f.x - o.x, 6) as difference from (select path, avg(x) as x from l where seed = 1 group by path) f join (select path, avg(x) as "
    "x from l where seed = 2 group by path) o using (path)"
)
def nested_delta(spark: SparkSession, d: str) -> DataFrame:
    """AG22."""
    l = _leaves(spark, d).groupBy("path", "seed").agg(F.avg("x").alias("x"))  # noqa: E741
    return rounded(decide.leaf_difference(l.where("seed = 1"), l.where("seed = 2"), "path", "x"))


@query(
    _ARMS
    + "select seed, round((avg(v) filter (arm = 'F' and dataset = 'R') - avg(v) filter (arm = 'F' and dataset = 'A')) - (avg(v) filter (arm = 'O' and "
    "dataset = 'R') - avg(v) filter (arm = 'O' and dataset = 'A')), 6) as dd from a group by seed"
)
def diff_of_diffs(spark: SparkSession, d: str) -> DataFrame:
    """D4."""
    return rounded(decide.difference_of_differences(_arms(spark, d), "seed", "arm", "dataset", "v", ("O", "F"), ("A", "R")))


@query(
    _ARMS
    + "select dataset, bool_and(v > 0.04) as discount_ok, bool_and(w <= 0.05) as tax_ok, bool_and(n > 10) as rows_ok, bool_and(v > 0.04) and bool_and(w <= "
    "0.05) and bool_and(n > 10) as passed from a group by dataset"
)
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    """D1, D2, D8."""
    return decide.gate(_arms(spark, d), {"discount_ok": F.col("v") > 0.04, "tax_ok": F.col("w") <= 0.05, "rows_ok": F.col("n") > 10}, "dataset")


@query(_ARMS + "select arm, seed, dataset, v >= greatest(0, w - 0.001) as promoted from a")
def threshold_promotion(spark: SparkSession, d: str) -> DataFrame:
    """D7."""
    return _arms(spark, d).select("arm", "seed", "dataset", decide.promoted(F.col("v"), F.col("w"), 0.001).alias("promoted"))


@query(
    "select p_partkey, p_retailprice, p_size from part p where not exists (select 1 from part q where q.p_retailprice <= p.p_retailprice and q.p_size >= "
    "p.p_size and (q.p_retailprice < p.p_retailprice or q.p_size > p.p_size))"
)
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Parts that none is at most as dear as and at least as large."""
    return decide.pareto_frontier(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")


@query(
    _ARMS
    + ", e as (select *, v > 0.049 as ok from a) select arm, seed, dataset, row_number() over (order by round(v, 9) desc, arm, seed, dataset) as place from "
    "e where ok"
)
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """D5, L5, L6."""
    a = _arms(spark, d).withColumn("ok", F.col("v") > 0.049)
    return decide.ranking(
        a, "ok", [F.round("v", 9).desc(), F.col("arm"), F.col("seed"), F.col("dataset")]
    ).select("arm", "seed", "dataset", F.col("place").cast("long").alias("place"))


@query(
    "with t as (select n_name as path, cast(n_regionkey as varchar) as v from nation), u as (select n_name as path, cast(case when n_nationkey % 5 = 0 "
    "then n_regionkey + 1 else n_regionkey end as varchar) as v from nation where n_nationkey <> 7) select coalesce(t.path, u.path) as path, t.v as "
    "left_value, u.v as right_value, case when u.path is null then 'left only' when t.path is null then 'right only' else 'differs' end as kind from t "
    "full join u on t.path = u.path where t.path is null or u.path is null or t.v is distinct from u.v"
)
def config_diff(spark: SparkSession, d: str) -> DataFrame:
    """J18, J17."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("path"), F.col("n_regionkey").cast("string").alias("value"))
    b = n.where("n_nationkey <> 7").select(
        F.col("n_name").alias("path"),
        F.when(F.col("n_nationkey") % 5 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).cast("string").alias("value")
    )
    return decide.config_difference(a, b)


@query(
    _ARMS
    + "select arm, count(*) as n_reports, count(distinct dataset) as n_datasets, round(avg(v), 6) as mean_value, min(asset) = max(asset) and count(asset) = "
    "count(*) as same_assets from (select *, case when arm = 'F' then 'x' when seed < 7 then 'y' else 'z' end as asset from a) group by arm"
)
def downstream_summary(spark: SparkSession, d: str) -> DataFrame:
    """D14."""
    asset = F.when(F.col("arm") == "F", "x").when(F.col("seed") < 7, "y").otherwise("z")
    return rounded(verify.downstream_summary(_arms(spark, d).withColumn("asset", asset), "arm", "dataset", "v", "asset"))


@query(
    _ARMS
    + ", g as (select seed, avg(v) filter (arm = 'F') as f, avg(v) filter (arm = 'O') as o, count(*) as k from a group by seed) select seed, f > o as "
    "gains, abs(f - o) < 0.01 as close, k >= 3 as complete, f > o and abs(f - o) < 0.01 and k >= 3 as passed from g"
)
def seed_gate(spark: SparkSession, d: str) -> DataFrame:
    """D3: a gate for each seed over paired arms."""
    g = _arms(spark, d).groupBy("seed").agg(
        F.avg(F.when(F.col("arm") == "F", F.col("v"))).alias("f"), F.avg(F.when(F.col("arm") == "O", F.col("v"))).alias("o"), F.count("*").alias("k")
    )
    return decide.gate(g, {"gains": F.col("f") > F.col("o"), "close": F.abs(F.col("f") - F.col("o")) < 0.01, "complete": F.col("k") >= 3}, "seed")
