"""Manifest queries: rows made canonical, split, restored to reference groups, paired and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.functions import text as T
from graindeck.functions.hashing import state_fingerprint
from graindeck.operators import quality, runlog
from graindeck.plans import manifest, publish, verify
from graindeck.queries import query, rounded
from graindeck.queries.quality import COLLAPSE, NORM, N, added_words
from graindeck.queries.scans import _BASE, _rows
from graindeck.queries.selection import P
from graindeck.schema import table
from graindeck.session import new_folder

_PATH = "'i' || doc_id % 3 || '/a' || doc_id || '_' || upper(coalesce(nullif(lang, ''), 'xx')) || '_' || doc_id % 5 || '.jpg'"


def _source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a path that names a folder, an object, a language and a zoom."""
    lang = F.upper(F.coalesce(F.nullif("lang", F.lit("")), F.lit("xx")))
    number = lambda c: c.cast("string")
    path = F.concat(
        F.lit("./i"), number(F.col("doc_id") % 3), F.lit("\\a"), number(F.col("doc_id")), F.lit("_"), lang, F.lit("_"), number(F.col("doc_id") % 5),
        F.lit(".jpg")
    )
    rows = _rows(spark, d).select("doc_id", "caption")
    return rows.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("path", path)


@query(
    _BASE
    + f", r as (select {_PATH} as image, caption from c join documents using (doc_id)) select 'web:' || image as id, image, "
    f"md5({COLLAPSE.format('caption')}) as caption, 'train' as split, 'web' as source from r"
)
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Canonical rows of source rows."""
    out = manifest.canonical(_source_rows(spark, d), "path", "caption", "train", "web", "full")
    return out.withColumn("caption", F.md5(F.col("caption").cast("binary")))


@query(
    _BASE
    + f", r as (select {_PATH} as image, {NORM.format('caption')} as k from c join documents using (doc_id)) select count(*) as records, count(distinct k) "
    f"as unique_captions, count(*) - count(distinct k) as duplicates, round((count(*) - count(distinct k)) / count(*), 9) as duplicate_rate, "
    f"count(distinct regexp_extract(image, '_([A-Z]{{2}})_([0-9]+)[.]jpg$', 1)) as countries, 5 as zooms from r"
)
def manifest_audit(spark: SparkSession, d: str) -> DataFrame:
    """AG1 to AG3, AG6, S4, S6, L4: the audit of canonical rows."""
    a = manifest.audit(manifest.canonical(_source_rows(spark, d), "path", "caption", "train", "web", "full"))
    row = (a["records"], a["unique_captions"], a["duplicates"], round(a["duplicate_rate"], 9), len(a["countries"]), len(a["zooms"]))
    return spark.createDataFrame([row], "records long, unique_captions long, duplicates long, duplicate_rate double, countries long, zooms int")


@query("select count(*) filter (turn % 2 = 1) as n_train, count(*) filter (turn % 2 = 0) as n_val from conversations")
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """rows of a split, whatever its case and blanks."""
    rows = table(spark, d, "conversations").select(F.when(F.col("turn") % 2 == 1, " Train").otherwise("VAL ").alias("split"))
    return manifest.of_split(rows, "train").agg(F.count("*").alias("n_train")).join(manifest.of_split(rows, "val").agg(F.count("*").alias("n_val")))


@query(f"""with k as (select doc_id, source, {N} as g from documents), f as (select g, min(doc_id) as ref from k group by g having count(*) > 1),
r as (select k.doc_id, k.g, f.ref, k.doc_id = f.ref as reference_representative from k join f using (g))
select 'p' || doc_id % 2 || '/' || doc_id || '.jpg' as path, ref as reference_ord, reference_representative from r where doc_id % 2 = 0 or doc_id = ref""")
def restored_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one prefix restored to reference groups, which are the texts that occur more than once."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("caption"), T.normalized(F.col("text")).alias("g"))
    first = docs.groupBy("g").agg(F.min("doc_id").alias("ref"), F.count("*").alias("n"), F.min_by("caption", "doc_id").alias("ref_caption")).where("n > 1")
    at = lambda prefix, c: F.concat(prefix, F.lit("/"), F.col(c).cast("string"), F.lit(".jpg"))
    even = F.when((F.col("doc_id") % 2 == 0) | F.col("doc_id").eqNullSafe(F.col("ref")), F.lit("p0")).otherwise("p1")
    rows = docs.join(first.select("g", "ref"), "g", "left").select(at(even, "doc_id").alias("path"), "caption")
    refs = first.select(
        F.col("ref").alias("ord"), F.col("ref").cast("string").alias("id"), at(F.lit("p0"), "ref").alias("image"), F.col("ref_caption").alias("caption"),
        F.col("g").alias("group_id")
    )
    out, _ = manifest.restored(rows, refs, ["p0"])
    number = F.regexp_extract("path", "/([0-9]+)", 1).cast("bigint")
    return out.select(
        F.concat(F.lit("p"), (number % 2).cast("string"), F.lit("/"), number.cast("string"), F.lit(".jpg")).alias("path"), "reference_ord",
        "reference_representative"
    )


@query(
    "select c.conv_id || '/' || c.turn as path, md5(c.text) as short, md5(n.text) as detail from conversations c left join conversations n on n.conv_id = "
    "c.conv_id and n.turn = c.turn + 1"
)
def paired_captions(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the next as its detail, if there is one."""
    c = table(spark, d, "conversations")
    at = lambda turn: F.concat_ws("/", "conv_id", turn).alias("path")
    short = c.select(at(F.col("turn")), F.md5(F.col("text").cast("binary")).alias("short"))
    detail = c.select(at(F.col("turn") - 1), F.md5(F.col("text").cast("binary")).alias("detail"))
    return manifest.paired_captions(short, detail, "path")


_NW = lambda c: f"len(list_filter(string_split({COLLAPSE.format(c)}, ' '), lambda w: w <> ''))"
_MIXED = f"""with t as (select 'x/a' || c.conv_id || '_' || c.turn || '.jpg' as path, 'a' || c.conv_id as object, c.text as short, n.text as detail
  from conversations c left join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1),
g as (select *, {NORM.format('short')} as grp from t),
s as (select distinct grp, case when substr(md5(grp), 1, 1) < '4' then 'val' else 'train' end as split from g),
k as (select g.*, split from g join s using (grp)),
x as (select object from k group by object having count(distinct split) > 1),
j as (select *, case when coalesce(trim(detail), '') = '' then 'missing_detail' when {_NW('short')} > 20 then 'short_over_20_words' when not
  ({_NW('detail')} between 12 and 50) then 'detail_outside_12_50_words'
  when not ({NORM.format('short')} <> {NORM.format('detail')} and len({added_words(NORM.format('short'), NORM.format('detail'))}) >= 3) then
  'detail_not_meaningfully_different'
  when object in (select object from x) then 'object_in_both_original_splits' end as reason from k)
"""


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations")
    path = F.concat(F.lit("x/a"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".jpg"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("detail"))
    rows = c.select("conv_id", "turn", path.alias("path"), F.col("text").alias("short")).join(n, ["conv_id", "turn"], "left").select("path", "short", "detail")
    groups = rows.select(T.normalized(F.col("short")).alias("group")).distinct()
    split = F.when(F.substring(F.md5(F.col("group").cast("binary")), 1, 1) < "4", "val").otherwise("train")
    return manifest.mixed_candidates(rows, groups.withColumn("split", split), 3)


@query(_MIXED + "select reason, count(*) as n from j where reason is not null group by 1")
def mixed_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the first rule that rejects them."""
    return _mixed(spark, d)[1]


@query(
    _MIXED
    + f"select md5(grp) as \"group\", any_value(split) as split, arg_min(path, ({P.format(3, 'path')}, path)) as path from j where reason is null group by grp"
)
def mixed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One candidate a group, the one of smallest priority."""
    return _mixed(spark, d)[0].select(F.md5(F.col("group").cast("binary")).alias("group"), "split", "path")


@query(
    "select n_name as name, t as template_no, case t when 0 then 'a view of ' || n_name || '.' else n_name || ' from above' end as prompt from nation, "
    "(values (0), (1)) as v(t)"
)
def class_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Every class under every template."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return manifest.prompts(names, "name", ["a view of {}.", "{} from above"]).select("name", "template_no", "prompt")


@query("""with g as (select l.doc_id from documents l anti join labels using (doc_id))
select (select count(*) from g) as n, (select string_agg(doc_id, ',' order by doc_id) from (select doc_id from g order by doc_id limit 100)) as examples""")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    """documents without a label, their number and the first hundred."""
    docs, labels = (table(spark, d, t).select(F.col("doc_id").alias("path")) for t in ("documents", "labels"))
    n, first = quality.missing(docs, labels, "path", allow=True)
    return spark.createDataFrame([(n, ",".join(map(str, first)) or None)], "n long, examples string")


@query("""with f as (select vec_id, label, unnest(list_transform(embedding, lambda x: cast(x as double))) as r, unnest(range(64)) as i from embeddings)
select label, round(max(abs(r - (r + 1e-7::double * (vec_id % 5)))), 9) as max_abs, bool_and(abs(r - (r + 1e-7::double * (vec_id % 5))) <=
  3e-7::double + 1e-9::double * abs(r + 1e-7::double * (vec_id % 5))) as close from f group by label""")
def init_parity(spark: SparkSession, d: str) -> DataFrame:
    """The values of two models against each other, every value paired."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "v"))
    a = e.select(F.col("label").alias("name"), F.concat_ws(":", "vec_id", "i").alias("index"), "v")
    b = e.select(F.col("label").alias("name"), F.concat_ws(":", "vec_id", "i").alias("index"), (F.col("v") + F.lit(1e-7) * (F.col("vec_id") % 5)).alias("v"))
    out = verify.init_parity(a, b, "name", "index", "v", 3e-7, 1e-9)
    return rounded(out.select(F.col("name").alias("label"), "max_abs", "close"), "max_abs", places=9)


@query(
    "select r_name as part, sha256(string_agg(n_name || '=' || sha256(n_name), chr(10) order by n_name || '=' || sha256(n_name))) as fingerprint from "
    "nation join region on n_regionkey = r_regionkey group by 1"
)
def state_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """H6: a digest of named digests by group."""
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = rows.groupBy(F.col("r_name").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("n_name", F.sha2(F.col("n_name").cast("binary"), 256).alias("h")))).alias("s")
    )
    return pairs.select("part", state_fingerprint(F.transform("s", lambda x: x["n_name"]), F.transform("s", lambda x: x["h"])).alias("fingerprint"))


@query("select event_type as run, round(sqrt(sum(value * value)), 6) as norm from events group by 1")
def gradient_norms(spark: SparkSession, d: str) -> DataFrame:
    """M6: the norm of grouped values."""
    return rounded(table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(runlog.grad_norm(F.col("value")).alias("norm")))


@query(
    "select o_orderkey, coalesce(nullif(trim(case when o_orderkey % 2 = 0 then ' ' else o_orderstatus end), ''), o_orderpriority) as value, "
    "o_orderpriority as looked_up from orders"
)
def first_filled(spark: SparkSession, d: str) -> DataFrame:
    """The first value that is not blank, and a path looked up by name."""
    status = F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(F.col("o_orderstatus"))
    paths = T.name_paths(F.concat(F.lit("a=x,p="), F.col("o_orderpriority"), F.lit(",z=y")))
    return table(spark, d, "orders").select(
        "o_orderkey", T.first_filled(status, F.col("o_orderpriority")).alias("value"), F.element_at(paths, "p").alias("looked_up")
    )


@query("select count(*) as n, count(distinct l_orderkey) as orders, round(sum(l_quantity), 2) as quantity, 2 * count(*) as appended from lineitem")
def published_parts(spark: SparkSession, d: str) -> DataFrame:
    """SK1, SK5, SK6: two parts and an audit published at once, and a log appended to twice."""
    at, l = new_folder(spark), table(spark, d, "lineitem")  # noqa: E741
    publish.publish({"rows": l.select("l_orderkey", "l_quantity"), "orders": l.select("l_orderkey").distinct()}, f"{at}/published", {"kind": "test"})
    for _ in range(2):
        publish.append_log(l.select("l_orderkey"), f"{at}/log")
    rows, orders, log = spark.read.parquet(f"{at}/published/rows"), spark.read.parquet(f"{at}/published/orders"), spark.read.json(f"{at}/log")
    n = {"orders": orders, "appended": log}
    return rows.agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    ).select("*", *[t.agg(F.count("*")).scalar().alias(c) for c, t in n.items()])
