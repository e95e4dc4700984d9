"""Joins, sets and aggregates over the star schema, as the audits compose them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.functions.text import stem
from graindeck.operators import quality
from graindeck.queries import query
from graindeck.schema import table


@query("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """J10."""
    return table(spark, d, "customer").join(
        table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"
    ).select("c_custkey")


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """J12."""
    return table(spark, d, "customer").join(
        table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"
    ).select("c_custkey")


@query(
    "with a as (select c_nationkey as k, count(*) as customers from customer group by 1), b as (select s_nationkey as k, count(*) as suppliers from "
    "supplier group by 1) select coalesce(a.k, b.k) as nationkey, coalesce(customers, 0) as customers, coalesce(suppliers, 0) as suppliers from a full "
    "join b on a.k = b.k"
)
def full_outer_join(spark: SparkSession, d: str) -> DataFrame:
    """J18 in its plain form."""
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full").na.fill(0, ["customers", "suppliers"])


@query(
    "select n_name, r_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on "
    "c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"
)
def chained_joins(spark: SparkSession, d: str) -> DataFrame:
    """Lookups along foreign keys. Nation and region have 25 and 5 rows at every scale."""
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    by_customer = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    rows = by_customer.join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("t"), 2).alias("total"))


@query("select distinct c_nationkey as nationkey from customer intersect select s_nationkey from supplier")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    """SO1."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("select c_custkey as k from customer except select o_custkey from orders")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """SO2."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query(
    "with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as k from lineitem where "
    "l_returnflag = 'A') select k, 'left' as side from (select k from a except select k from b) union all select k, 'right' from (select k from b except "
    "select k from a)"
)
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    """SO3, J11: no row means equal sets."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return quality.set_difference(l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), l.where("l_returnflag = 'A'").select("l_partkey"))


@query(
    "with a as (select cast(user_id as varchar) as x, event_type as y from events where value > 50 group by all), b as (select cast(user_id as varchar) "
    "as x, event_type as y from events where value <= 50 group by all) select x, y, 'left' as side from (select x, y from a except select x, y from b) "
    "union all select x, y, 'right' from (select x, y from b except select x, y from a)"
)
def reciprocity(spark: SparkSession, d: str) -> DataFrame:
    """Edges that the other direction lacks."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("x"), F.col("event_type").alias("y"), "value")
    turned = e.where("value <= 50").select(F.col("y").alias("x"), F.col("x").alias("y"))
    return quality.edges_not_reciprocal(e.where("value > 50"), turned)


@query(
    "select text_kind, count(*) as n from (select 'document' as text_kind, text from documents union all select 'benchmark', text from benchmark union "
    "all select 'turn', text from conversations) group by 1"
)
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """SO4."""
    parts = [
        table(spark, d, t).select(F.lit(k).alias("text_kind"), "text") for t,
        k in (("documents", "document"), ("benchmark", "benchmark"), ("conversations", "turn"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("text_kind").agg(F.count("*").alias("n"))


@query("select v, count(*) as n from (select unnest([l_partkey, l_suppkey]) as v from lineitem) group by v having count(*) > 1")
def stacked_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """SO5: values that occur more than once over two columns stacked."""
    return table(spark, d, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n > 1")


@query("select o_orderkey, o_orderstatus as first, len(list_distinct([o_orderstatus, substr(o_orderpriority, 1, 1), o_orderstatus])) as n from orders")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """SO6: distinct values in order of appearance."""
    p = F.substring("o_orderpriority", 1, 1)
    a = F.array_distinct(F.array("o_orderstatus", p, "o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.element_at(a, 1).alias("first"), F.size(a).cast("long").alias("n"))


@query(
    "select event_type, json_extract_string(props, '$.' || k) as v, k, count(*) as n from (select event_type, props, unnest(json_keys(props)) as k from "
    "events) group by all"
)
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    """SC9: fields of a JSON column, exploded."""
    e = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.groupBy("event_type", "v", "k").agg(F.count("*").alias("n"))


@query(
    "select regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') as stem, count(*) as "
    "n from pages group by all"
)
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    """SC12, S5: parts of a path as labels."""
    return table(spark, d, "pages").groupBy(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), stem(F.col("url")).alias("stem")
    ).agg(F.count("*").alias("n"))


@query(
    "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as "
    "sum_disc_price, round(avg(l_discount), 6) as avg_disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Grouped sums and means with a filter that reaches the scan."""
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )


@query(
    "select conv_id, count(*) as turns, arg_min(role, turn) as first_role, arg_max(role, turn) as last_role, md5(string_agg(text, '|' order by turn)) as "
    "talk from conversations group by conv_id"
)
def conversation_groups(spark: SparkSession, d: str) -> DataFrame:
    """SC2: the rows of a one-to-many table by their parent, in order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "|")
    rows = table(spark, d, "conversations").groupBy("conv_id")
    return rows.agg(
        F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"),
        F.md5(whole.cast("binary")).alias("talk")
    )
