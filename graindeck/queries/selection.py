"""Selection queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.functions import text as T
from graindeck.functions.hashing import blake2b_hex, priority
from graindeck.operators import select
from graindeck.operators.quality import digest
from graindeck.queries import query
from graindeck.queries.quality import N
from graindeck.schema import table

#: The seeded priority (H1) in DuckDB.
P = "substr(sha256('{}' || chr(0) || {}), 1, 32)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"select doc_id, {P.format(23, 'doc_id')} as priority from documents order by priority, doc_id limit 100")
def hash_topk(spark: SparkSession, d: str) -> DataFrame:
    """W2, H1."""
    return select.hash_top(_docs(spark, d).select("doc_id"), "doc_id", 100, 23)


@query(
    f"with p as (select doc_id, lang as group_key, {P.format(7, 'doc_id')} as priority from documents), r as (select *, row_number() over (partition by "
    f"group_key order by priority, doc_id) as rn from p) select doc_id, group_key, priority from r where rn <= 50 order by priority, doc_id limit 120"
)
def cap_per_group_topk(spark: SparkSession, d: str) -> DataFrame:
    """At most 50 of a language, then 120 overall."""
    return select.capped_top(_docs(spark, d).select("doc_id", "lang"), F.col("lang"), "doc_id", 50, 120, 7).select("doc_id", "group_key", "priority")


@query(
    f"with g as (select key, {P.format(23, 'key')} as priority from (select distinct {N} as key from documents)), v as (select key from g order by "
    f"priority, key limit 50) select doc_id, case when {N} in (select key from v) then 'val' else 'train' end as split from documents"
)
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """H1 split of normalised texts: 50 groups to validation."""
    return select.split_by_group(_docs(spark, d), T.normalized(F.col("text")), 50, 23).select("doc_id", "split")


@query("select doc_id, lang, source from documents where doc_id < 100")
def first_n_prefix(spark: SparkSession, d: str) -> DataFrame:
    """L1."""
    return select.prefix(_docs(spark, d), "doc_id", 100).select("doc_id", "lang", "source")


@query("select source, min(doc_id) as doc_id, arg_min(lang, doc_id) as lang from documents group by source")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    """W5, SC4."""
    return select.least_per_group(_docs(spark, d).select("source", "doc_id", "lang"), "source", "doc_id")


@query(f"select source, arg_min(doc_id, {P.format(5, 'doc_id')}) as doc_id, min({P.format(5, 'doc_id')}) as priority from documents group by source")
def argmin_per_group(spark: SparkSession, d: str) -> DataFrame:
    """W4 with a SHA-256 order."""
    df = _docs(spark, d).select("source", "doc_id", priority(5, F.col("doc_id")).alias("priority"))
    return select.least_per_group(df, "source", "priority", "doc_id")


@query()
def argmin_per_group_blake2b(spark: SparkSession, d: str) -> DataFrame:
    """The order by BLAKE2b, which SQL has not; tested against hashlib."""
    df = _docs(spark, d).select("source", "doc_id", blake2b_hex(5)(F.col("doc_id").cast("string")).alias("priority"))
    return select.least_per_group(df, "source", "priority", "doc_id")


@query(
    f"with g as (select {N} as key, doc_id, source from documents), f as (select key, min(doc_id) as first from g group by key) select doc_id, first as "
    f"ref_ord, doc_id = first as representative, row_number() over (order by first, doc_id <> first, source, doc_id) as place from g join f using (key)"
)
def representative_first(spark: SparkSession, d: str) -> DataFrame:
    """By group of equal texts, the first row leading; place is the global rank of that order."""
    from pyspark.sql import Window

    df = _docs(spark, d).select("doc_id", "source", digest(T.normalized(F.col("text"))).alias("key"))
    ref = df.groupBy("key").agg(F.min("doc_id").alias("ref_ord"), F.count("*").alias("size"))
    rows = df.join(ref, "key").withColumn("representative", F.col("doc_id") == F.col("ref_ord"))
    inside = F.row_number().over(Window.partitionBy("ref_ord").orderBy(~F.col("representative"), "source", "doc_id"))
    offsets = select.running_sum(ref.select("ref_ord", "size"), "ref_ord", "size", "before")
    return rows.withColumn("inside", inside).join(offsets.select("ref_ord", "before"), "ref_ord").select(
        "doc_id", "ref_ord", "representative", (F.col("before") + F.col("inside")).cast("long").alias("place")
    )


@query(
    "with p as (select doc_id, substr(sha256('3:0' || chr(0) || doc_id), 1, 32) as h, lang from documents), r as (select *, row_number() over (partition "
    "by lang order by h, doc_id) - 1 as rn from p), c as (select *, rn // 4 as chunk from r), k as (select lang, chunk, count(*) as size, "
    "substr(sha256('3:0:chunk' || chr(0) || lang || chr(0) || chunk), 1, 32) as place from c group by lang, chunk), o as (select *, coalesce(sum(size) "
    "over (order by place rows between unbounded preceding and 1 preceding), 0) as before from k) select doc_id, cast(before + rn - c.chunk * 4 as "
    "bigint) as pos from c join o using (lang, chunk)"
)
def chunked_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Seeded order in chunks of 4 of a language."""
    return select.chunked_epoch(_docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", 4, 3).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("select doc_id, doc_id // 16 as batch_no, doc_id % 16 as slot from documents where (doc_id // 16 + 1) * 16 <= (select count(*) from documents)")
def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 16 in order, the short last one dropped."""
    return select.batches(_docs(spark, d).select("doc_id"), "doc_id", 16, True)


def quota_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the next one as detail; conversations as objects, a role of one as a group."""
    c = table(spark, d, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("detail"))
    split = F.when(F.col("conv_id") % 5 == 0, "val").otherwise("train").alias("split")
    path, group = F.concat_ws("/", "conv_id", "turn").alias("path"), F.concat_ws(":", "conv_id", "role").alias("group")
    rows = c.join(n, ["conv_id", "turn"]).select(split, path, F.col("conv_id").alias("object"), group, F.col("text").alias("short"), "detail")
    return rows.withColumn("priority", priority(11, F.col("path")))


@query()
def greedy_quota(spark: SparkSession, d: str) -> DataFrame:
    """A sequential selection, tested against a plain loop over the same table."""
    accepted, _ = select.greedy_quota(quota_candidates(spark, d), {"train": 8, "val": 2})
    return spark.createDataFrame(
        [(r["split"], r["path"], r["caption_kind"], i) for i, r in enumerate(accepted)], "split string, path string, caption_kind string, place int"
    )


def epoch_orders(n: int) -> list[np.ndarray]:
    """Two orders of n groups, each by a multiplicative hash."""
    return [np.array(sorted(range(n), key=lambda g: ((epoch * 7919 + g) * 2654435761 % 4294967296, g))) for epoch in range(2)]


@query()
def rotating_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of group batches with rotating cursors; tested against a plain loop over the same table.

    The driver works on one number a group; runs of rows are expanded and joined to the rows by the executors.
    """
    df = _docs(spark, d).select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    sizes = df.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()
    counts = np.array([r["n"] for r in sizes], dtype=np.int64)
    runs = np.concatenate(list(select.rotating_epochs(counts, epoch_orders(len(counts)), 16, 3, True)) or [np.zeros((0, 6), np.int64)])
    rows = [(*r[:3], sizes[r[3]]["source"], *r[4:], int(counts[r[3]])) for r in runs.tolist()]
    plan = spark.createDataFrame(rows, "epoch long, batch_no long, first_slot long, source string, first_row long, n long, size long")
    plan = plan.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("i", (F.col("first_row") + F.col("k")) % F.col("size"))
    numbered = select.rank_in_group(df.withColumn("at", priority(9, F.col("doc_id"))), "source", "at", "doc_id", "i")
    return plan.join(numbered, ["source", "i"]).select("epoch", "batch_no", (F.col("first_slot") + F.col("k")).alias("slot"), "doc_id")


@query("""with o as (select doc_id, row_number() over (order by substr(sha256('9:1' || chr(0) || doc_id), 1, 32)) - 1 as pos, count(*) over () as n
  from documents)
select doc_id, pos // 16 as batch_no, pos % 16 as slot from o where pos // 16 >= 3 and pos // 16 < n // 16""")
def resumed_epoch(spark: SparkSession, d: str) -> DataFrame:
    """ST3: what is left of the second epoch after three batches."""
    df = _docs(spark, d).select("doc_id")
    start = select.EpochPosition(df.count(), 16, 9)
    return select.epoch_batches(df, "doc_id", start.after(start.batches + 3))
