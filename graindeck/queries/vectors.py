"""Vector and loss queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.functions import vector as V
from graindeck.operators import drift, loss, retrieval, select
from graindeck.queries import query, rounded
from graindeck.schema import table


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _queries(df: DataFrame, where: str = "true") -> DataFrame:
    return df.where(where).select(F.col("vec_id").alias("qid"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))


def _candidates(df: DataFrame, where: str = "true") -> DataFrame:
    return df.where(where).select(F.col("vec_id").alias("idx"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))


def ranks(spark: SparkSession, d: str) -> DataFrame:
    """Self-retrieval: every vector against all others, positives of the same label."""
    df = _emb(spark, d)
    return retrieval.best_positive_ranks(_queries(df), _candidates(df), exclude_self=True)


#: Ranks of queries against candidates in DuckDB: the number of the first positive in the order of score and index.
_RANKS = """with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
 s as (select q.vec_id as qid, q.label as grp, q.label = c.label as pos, row_number() over (partition by q.vec_id order by list_dot_product(q.e, c.e)
  desc, c.vec_id) as rn from v q join v c on {on}),
 ranks as (select qid, grp, min(rn) filter (pos) as rank from s group by qid, grp) """
_SELF = _RANKS.format(on="q.vec_id <> c.vec_id")
_SUMMARY = (
    "count(*) as n_queries, round(avg((rank <= 1)::int), 6) as r1, round(avg((rank <= 5)::int), 6) as r5, round(avg((rank <= 10)::int), 6) as r10, "
    "quantile_disc(rank, 0.5) as median_rank, round(avg(rank), 6) as mean_rank"
)


@query(_SELF + f"select {_SUMMARY} from ranks")
def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    """W1, J9, AG11: Recall@1, 5, 10 and ranks of self-retrieval."""
    return rounded(retrieval.recall_summary(ranks(spark, d)))


@query(_SELF + "select qid, grp, rank from ranks")
def retrieval_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The rank of every query."""
    return ranks(spark, d)


@query(
    _SELF
    + "select count(*) as n_groups, round(avg(r1), 6) as r1, round(avg(r5), 6) as r5, round(avg(r10), 6) as r10 from (select grp, avg((rank <= 1)::int) as "
    "r1, avg((rank <= 5)::int) as r5, avg((rank <= 10)::int) as r10 from ranks group by grp)"
)
def retrieval_group_balanced(spark: SparkSession, d: str) -> DataFrame:
    """AG13."""
    return rounded(retrieval.group_balanced(ranks(spark, d)))


_TWO = "with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), " + ", ".join(
    f"{n} as (select qid, min(rn) filter (pos) as rank from (select q.vec_id as qid, q.label = c.label as pos, row_number() over (partition by q.vec_id order by list_dot_product(q.e, c.e) desc, c.vec_id) as rn from v q join v c on q.vec_id % 2 = {a} and c.vec_id % 2 = {b}) group by qid)" for n, a, b in (
        ("i2t", 0, 1), ("t2i", 1, 0)
    )
)


def _both_ways(spark: SparkSession, d: str) -> DataFrame:
    df = _emb(spark, d)
    a = retrieval.recall_summary(retrieval.best_positive_ranks(_queries(df, "vec_id % 2 = 0"), _candidates(df, "vec_id % 2 = 1")))
    b = retrieval.recall_summary(retrieval.best_positive_ranks(_queries(df, "vec_id % 2 = 1"), _candidates(df, "vec_id % 2 = 0")))
    return a.withColumn("direction", F.lit("image_to_text")).unionByName(b.withColumn("direction", F.lit("text_to_image")))


@query(_TWO + f" select 'image_to_text' as direction, {_SUMMARY} from i2t union all select 'text_to_image', {_SUMMARY} from t2i")
def retrieval_two_directions(spark: SparkSession, d: str) -> DataFrame:
    """SC2, J7, J8, AG11: two modalities, even vectors as images and odd ones as texts, both ways."""
    return rounded(_both_ways(spark, d))


_MEANS = "select avg((rank <= 1)::int) as r1, avg((rank <= 5)::int) as r5, avg((rank <= 10)::int) as r10 from {}"


@query(f"{_TWO}, r as ({_MEANS.format('i2t')} union all {_MEANS.format('t2i')}) select round(avg((r1 + r5 + r10) / 3), 6) as mean_recall from r")
def retrieval_mean_recall(spark: SparkSession, d: str) -> DataFrame:
    """AG12."""
    return rounded(retrieval.mean_recall(_both_ways(spark, d)))


_PROTO = """with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), f as (select label,
  unnest(range(64)) as dim, unnest(e) as x from v),
 m as (select label, dim, avg(x) as x from f group by label, dim), n as (select label, list(x order by dim) as p from m group by label), u as (select
  label, list_transform(p, lambda x: x / greatest(sqrt(list_dot_product(p, p)), 1e-12)) as p from n),
 s as (select vec_id, v.label as truth, u.label as predicted, row_number() over (partition by vec_id order by list_dot_product(e, p) desc, u.label) as
  rn from v join u on true), r as (select truth, count(*) as n, avg((truth = predicted)::int) as acc from s where rn = 1 group by truth) """


def _classified(spark: SparkSession, d: str) -> DataFrame:
    df = _emb(spark, d)
    return retrieval.classify(df, retrieval.prototypes(df, "label", "embedding"), "vec_id", "label", "embedding")


@query(_PROTO + "select sum(n)::bigint as n, round(sum(acc * n) / sum(n), 6) as accuracy, round(avg(acc), 6) as mean_class_accuracy from r")
def prototype_classification(spark: SparkSession, d: str) -> DataFrame:
    """AG14, AG16, L7: prototypes of the labels classify all vectors."""
    return rounded(retrieval.accuracy(_classified(spark, d))[1])


@query(_PROTO + "select truth, n, round(acc, 6) as acc from r")
def prototype_per_class(spark: SparkSession, d: str) -> DataFrame:
    """AG14 by class."""
    return rounded(retrieval.accuracy(_classified(spark, d))[0])


def _perturbed(spark: SparkSession, d: str) -> DataFrame:
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.lit(0.02) * ((F.col("vec_id") * 31 + i * 17) % 11 - 5) / 5.0)
    return _emb(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"), moved.alias("b"))


_PERTURBED = """with p as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as a, list_transform(embedding, lambda x, i:
  cast(x as double) + 0.02::double * ((vec_id * 31 + (i - 1) * 17) % 11 - 5) / 5.0::double) as b from embeddings),
 u as (select vec_id, label, list_transform(a, lambda x: x / greatest(sqrt(list_dot_product(a, a)), 1e-12)) as a, list_transform(b, lambda x: x /
  greatest(sqrt(list_dot_product(b, b)), 1e-12)) as b from p),
 x as (select vec_id, label, 1 - greatest(-1, least(1, list_dot_product(a, b))) as cd, list_distance(a, b) as l2 from u) """


def _dist(c: str, n: str) -> str:
    named = {
        "mean": "avg({})", "std": "stddev_pop({})", "min": "min({})", "p05": "quantile_cont({}, 0.05)", "median": "quantile_disc({}, 0.5)",
        "p95": "quantile_cont({}, 0.95)", "max": "max({})"
    }
    return ", ".join(f"round({x.format(c)}, 9) as {n}_{k}" for k, x in named.items())


_ABOVE = ", ".join(f"round(avg((cd > {t})::int), 9) as above_{i}" for i, t in enumerate(("1e-4", "1e-3", "1e-2")))


@query(_PERTURBED + f"select label, count(*) as n, {_dist('cd', 'cosine_distance')}, {_dist('l2', 'l2')}, {_ABOVE} from x group by label")
def embedding_drift(spark: SparkSession, d: str) -> DataFrame:
    """AG5, AG7, AG8, AG15, M1 to M3: vectors against a shifted copy, by label."""
    return rounded(drift.drift_summary(_perturbed(spark, d), "a", "b", "label"), places=9)


@query("""with p as (select vec_id, label, unnest(list_transform(embedding, lambda x: cast(x as double))) as r, unnest(range(64)) as i from
  embeddings), o as (select label, r, r + 0.0001::double * (vec_id % 3) as o from p)
 select label, round(max(abs(r - o)), 6) as max_abs, bool_and(abs(r - o) <= 0.00015 + 1e-5 * abs(o)) as close from o group by label""")
def parity_check(spark: SparkSession, d: str) -> DataFrame:
    """AG27."""
    flat = _emb(spark, d).select(
        "vec_id", "label", F.explode(F.transform("embedding", lambda x: x.cast("double"))).alias("r")
    ).withColumn("o", F.col("r") + F.lit(0.0001) * (F.col("vec_id") % 3))
    return drift.parity(flat, "label", "r", "o", 0.00015, 1e-5).select("label", F.round("max_abs", 6).alias("max_abs"), "close")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return _perturbed(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 16).cast("long"))


def _loss_sql(kind: str) -> str:
    kept = "true" if kind == "multi_positive" else "(gi <> gj or i = j)"
    target = "gi = gj" if kind == "multi_positive" else "i = j"
    side = (
        lambda r: f"select batch, avg(loss) as loss, count(*) as size from (select batch, {r}, max(logit) + ln(sum(exp(logit - top))) - avg(logit) filter ({target}) as loss from (select *, max(logit) over (partition by batch, {r}) as top from l where {kept}) group by batch, {r}) group by batch"
    )
    return (
        _PERTURBED.split(" u as (")[0].rstrip().rstrip(",") + f""", b as (select *, vec_id // 16 as batch from p), l as (select x.batch, x.vec_id as
  i, y.vec_id as j, x.label as gi, y.label as gj, 0.05::double * list_dot_product(x.a, y.b) as logit from b x join b y using (batch)),
 im as ({side('i')}), tx as ({side('j')}) select sum(im.size)::bigint as n, round(sum((im.loss + tx.loss) / 2 * im.size) / sum(im.size), 6) as loss
  from im join tx using (batch)"""
    )


def _loss(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return rounded(loss.weighted_loss(loss.group_losses(_batches(spark, d), "batch", "vec_id", "a", "b", "label", 0.05, kind)))


@query(_loss_sql("multi_positive"))
def contrastive_loss_groups(spark: SparkSession, d: str) -> DataFrame:
    """M4, M5, AG17: uniform targets over the label, batches of 16."""
    return _loss(spark, d, "multi_positive")


@query(_loss_sql("mask_same_caption"))
def contrastive_loss_masked(spark: SparkSession, d: str) -> DataFrame:
    """M5: others of the label left out."""
    return _loss(spark, d, "mask_same_caption")


@query(
    "select vec_id // 16 as batch, sum(n)::bigint as n_rows, count(*) as n_groups, round(sum(n * n) / sum(n), 6) as positives_per_query, sum(n * (n - "
    "1))::bigint as off_diagonal, round(sum((n = 1)::int) / sum(n), 6) as singleton_share from (select vec_id // 16 * 16 as vec_id, label, count(*) as n "
    "from embeddings group by 1, 2) group by 1"
)
def batch_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AG24."""
    return rounded(loss.batch_diagnostics(_batches(spark, d), "batch", "label"))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("arrival"), F.floor(F.col("event_id") / 16).cast("long").alias("batch"))


@query("""with e as (select user_id, event_id as arrival, event_id // 16 as batch from events), p as (select user_id, batch, max(max_arrival) over
  (partition by user_id order by batch rows between unbounded preceding and 1 preceding) as previous from (select user_id, batch, max(arrival) as
  max_arrival from e group by user_id, batch))
 select e.user_id, arrival, e.batch, previous from e join p using (user_id, batch) where previous >= e.batch * 16 - 256""")
def queue_collisions(spark: SparkSession, d: str) -> DataFrame:
    """ST2: users seen among the last 256 arrivals before their batch."""
    return loss.queue_collisions(_arrivals(spark, d), "user_id", "batch", "arrival", 256, 16)


@query("""with e as (select event_id, user_id, row_number() over (order by event_id) - 1 as i from events)
select event_id, least(i, 256) as queue_size, case when i = 0 then null when i <= 256 then first_value(user_id) over w else lag(user_id, 256) over w
  end as oldest from e window w as (order by event_id)""")
def queue_window(spark: SparkSession, d: str) -> DataFrame:
    """ST1 in batch form: entries held on arrival, and the oldest of them."""
    rows = select.running_sum(table(spark, d, "events").select("event_id", "user_id", F.lit(1).alias("one")), "event_id", "one", "arrival")
    return loss.queue_window(rows, "arrival", "user_id", 256).select("event_id", "queue_size", "oldest")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as norm from embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """M1, M6."""
    return _emb(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))

