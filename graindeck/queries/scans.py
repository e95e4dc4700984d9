"""Scans: tables written in the foreign formats that the readers take, and read back (SC1 to SC18, F14, S13)."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.functions import text as T
from graindeck.functions.hashing import content_sha256
from graindeck.operators.select import running_sum
from graindeck.plans import verify
from graindeck.queries import query
from graindeck.queries.quality import N
from graindeck.schema import CANONICAL, GROUPED, table
from graindeck.session import new_folder
from graindeck.sources import files, manifests


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as canonical rows; a blank text gets a caption of its own."""
    caption = F.when(T.stripped(F.coalesce("text", F.lit(""))) == "", F.concat(F.lit("blank "), "doc_id")).otherwise(F.col("text"))
    key = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        "doc_id", key.alias("id"), F.concat(key, F.lit(".jpg")).alias("image"), caption.alias("caption"), F.lit("val").alias("split"),
        F.coalesce("source", F.lit("none")).alias("source")
    )


def _lines(df: DataFrame, order: str, at: str) -> str:
    """JSON lines in files whose names are in the rows' order: ranges of it, each sorted."""
    df.repartitionByRange(8, order).sortWithinPartitions(order).drop(order).write.option("ignoreNullFields", "false").json(at)
    return at


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file on any Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data))
    out.close()


_CAPTION = r"case when trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g')) = '' then 'blank ' || doc_id else text end"
_BASE = (
    f"with c as (select doc_id, cast(doc_id as varchar) as id, {_CAPTION} as caption, coalesce(source, 'none') as source, row_number() over (order by "
    f"doc_id) - 1 as ord from documents) "
)


@query(_BASE + "select ord, id, id || '.jpg' as image, md5(caption) as caption, source from c")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """SC1: a manifest of JSON lines over several files, numbered."""
    rows = manifests.read_jsonl(spark, _lines(_rows(spark, d), "doc_id", new_folder(spark)), CANONICAL)
    return rows.select("ord", "id", "image", F.md5(F.col("caption").cast("binary")).alias("caption"), "source")


@query(_BASE + "select count(*) as n, max(ord) as last from c")
def scan_jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    """SC7: blank lines are errors; there are none."""
    rows = manifests.read_jsonl(spark, _lines(_rows(spark, d), "doc_id", new_folder(spark)), CANONICAL, blank="error")
    return rows.agg(F.count("*").alias("n"), F.max("ord").alias("last"))


@query("select doc_id % 7 = 0 as broken, count(*) as n from documents group by 1")
def scan_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """SC16: lines that are no JSON are reported, not dropped."""
    line = F.to_json(F.struct("id", "image", F.md5(F.col("caption").cast("binary")).alias("caption"), "split", "source"))
    at = new_folder(spark)
    _rows(spark, d).select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(at)
    return manifests.read_jsonl_tolerant(spark, at, CANONICAL).groupBy(F.col("error").isNotNull().alias("broken")).agg(F.count("*").alias("n"))


@query("""with t as (select conv_id, conv_id || ':' || turn as id from conversations), i as (select conv_id, row_number() over (order by cast(conv_id
  as varchar)) - 1 as image_idx from conversations group by conv_id)
select id, row_number() over (order by id) - 1 as idx, image_idx from t join i using (conv_id)""")
def scan_multi_caption(spark: SparkSession, d: str) -> DataFrame:
    """SC2: conversations as images, turns as their captions; both numbered by id."""
    image = F.col("conv_id").cast("string")
    caption = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    rows = table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), image.alias("image_id"), F.concat(image, F.lit(".jpg")).alias("image"), caption.alias("caption"),
        F.lit("test").alias("split"), F.lit("talk").alias("source")
    )
    _, captions = manifests.multi_caption(rows, "test")
    return captions.select("id", "idx", "image_idx")


@query("select cast(vec_id as varchar) as id, row_number() over (order by vec_id) - 1 as ord from embeddings")
def scan_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """SC3: ids, images and captions that are all unique."""
    key = F.col("vec_id").cast("string")
    rows = table(spark, d, "embeddings").select(
        "vec_id", key.alias("id"), F.concat(key, F.lit(".png")).alias("image"), F.concat(F.lit("Vector "), key).alias("caption"), F.lit("Val").alias("split"),
        F.lit("vectors").alias("source")
    )
    read = manifests.read_jsonl(spark, _lines(rows, "vec_id", new_folder(spark)))
    return manifests.one_to_one(read, "val", "vectors").select("id", "ord")


@query(
    _BASE
    + f", g as (select {N.replace('text', 'caption')} as group_id, caption, ord from c) select md5(group_id) as group_id, md5(arg_min(caption, ord)) as "
    f"caption, min(ord) as first from g group by 1"
)
def scan_caption_groups(spark: SparkSession, d: str) -> DataFrame:
    """SC4, F13: groups of equal captions, their first one leading."""
    rows = _rows(spark, d).withColumn("group_id", T.normalized(F.col("caption")))
    _, texts = manifests.caption_groups(manifests.read_jsonl(spark, _lines(rows, "doc_id", new_folder(spark)), GROUPED))
    return texts.select(F.md5(F.col("group_id").cast("binary")).alias("group_id"), F.md5(F.col("caption").cast("binary")).alias("caption"), "first")


@query("select 'c' || label as label, count(*) as n from embeddings group by 1")
def scan_classification(spark: SparkSession, d: str) -> DataFrame:
    """SC5: labels of a fixed set, all of which occur."""
    key = F.col("vec_id").cast("string")
    e = table(spark, d, "embeddings")
    rows = e.select(
        key.alias("id"), F.concat(key, F.lit(".tif")).alias("image"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.lit("test").alias("split"), F.lit("v").alias("source")
    )
    classes = [f"c{r[0]}" for r in e.select("label").distinct().collect()]
    return manifests.classification(rows, classes).groupBy("label").agg(F.count("*").alias("n"))


@query(_BASE + "select id, md5(caption) as caption from c")
def scan_captions_only(spark: SparkSession, d: str) -> DataFrame:
    """SC6: of a manifest the ids and captions alone."""
    rows = manifests.read_jsonl(spark, _lines(_rows(spark, d), "doc_id", new_folder(spark)))
    return manifests.captions_only(rows).select("id", F.md5(F.col("caption").cast("binary")).alias("caption"))


@query("select doc_id, md5(text) as digest, coalesce(source, '') as source from documents")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    """SC8: CSV with quotes, commas and line ends in its cells, and a quoted header."""
    at = new_folder(spark)
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id, as text"), F.regexp_replace(F.regexp_replace("text", "\r", "\\\\r"), "\\\\r", "\r").alias("text"),
        F.coalesce("source", F.lit("")).alias("source")
    )
    rows.write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", lineSep="\n"
    ).csv(at)
    out = manifests.read_csv(spark, at, ["id, as text", "text", "source"], exact=True)
    return out.select(
        F.col("id, as text").cast("bigint").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
        F.coalesce("source", F.lit("")).alias("source")
    )


@query(
    "select cast(conv_id as varchar) as image, row_number() over (partition by conv_id order by turn) - 1 as number, md5(trim(regexp_replace(text, "
    "'[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+', ' ', 'g'))) as caption from conversations"
)
def scan_nested(spark: SparkSession, d: str) -> DataFrame:
    """SC9, SC10, S13: one JSON document of images with sentences, some with their text, some with tokens."""
    at, c = new_folder(spark), table(spark, d, "conversations")
    words = T.words(F.col("text"))
    odd = F.col("turn") % 2 == 1
    sentence = F.struct("turn", F.when(odd, F.col("text")).alias("caption"), F.when(~odd, words).alias("tokens"))
    images = c.groupBy(F.col("conv_id").cast("string").alias("filename")).agg(F.array_sort(F.collect_list(sentence)).alias("sentences"))
    images.select(F.concat(F.lit("["), F.to_json(F.struct("filename", "sentences")), F.lit("]")).alias("value")).write.text(at, lineSep="\n")
    # a file holds one list here, as an annotation file does: a list a line
    rows = spark.read.text(at).select(
        F.posexplode(
            F.from_json("value", "array<struct<filename: string, sentences: array<struct<caption: string, tokens: array<string>>>>>")
        ).alias("ord", "record")
    ).select("record.*")
    return manifests.annotation_captions(rows).select(
        F.col("filename").alias("image"), F.col("number").cast("bigint").alias("number"), F.md5(T.collapsed(F.col("caption")).cast("binary")).alias("caption")
    )


@query("select n_name as image, len(n_name) as n_chars, n_regionkey as region from nation")
def scan_nested_object(spark: SparkSession, d: str) -> DataFrame:
    """SC9: records below a key of one JSON object, in a file of its own. A nation is one record, at every scale."""
    at = new_folder(spark)
    records = [
        r.asDict() for r in table(spark, d, "nation").select(
            F.col("n_name").alias("image"), F.col("n_name").alias("text"), F.col("n_regionkey").cast("int").alias("region")
        ).collect()
    ]
    write_file(spark, f"{at}/annotations.json", json.dumps({"info": 1, "images": records}).encode())
    rows = manifests.nested_records(spark, f"{at}/annotations.json", "image string, text string, region int")
    return rows.select("image", F.char_length("text").cast("bigint").alias("n_chars"), "region")


def _tree(spark: SparkSession, d: str) -> tuple[str, list]:
    """Files by region: 25 nations, at every scale."""
    at = new_folder(spark)
    rows = table(spark, d, "nation").join(
        F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_name", "r_name", "n_nationkey").collect()
    for r in rows:
        write_file(spark, f"{at}/{r.r_name}/{r.n_name}{'.JPG' if r.n_nationkey % 2 else '.png'}", (r.n_name * 3).encode())
    return at, rows


@query("select r_name as label, count(*) as n_files, sum(strlen(n_name) * 3)::bigint as bytes from nation join region on n_regionkey = r_regionkey group by 1")
def scan_class_directories(spark: SparkSession, d: str) -> DataFrame:
    """SC11, SC12: a tree of files, labelled by their directories."""
    at, rows = _tree(spark, d)
    found = files.class_directories(files.list_files(spark, at), len(rows))
    return found.groupBy("label").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


@query(
    "select case when n_nationkey % 2 = 1 then '.jpg' else '.png' end as suffix, count(*) as n_files, sum(strlen(n_name) * 3)::bigint as bytes from "
    "nation group by 1"
)
def asset_inventory(spark: SparkSession, d: str) -> DataFrame:
    """D17, AG29: files and bytes by suffix."""
    return verify.asset_inventory(files.list_files(spark, _tree(spark, d)[0]))


@query("""select 'images' || n_regionkey || '/' || replace(n_name, ' ', '_') || '.jpg' as path, 'wrap/' || replace(n_name, ' ', '_') || '.jpg' as
  member, strlen(n_name) * 3 as size from nation where n_regionkey % 2 = 0
union all select 'pack/' || replace(n_name, ' ', '_') || '.jpg', replace(n_name, ' ', '_') || '.jpg', strlen(n_name) * 3 from nation where n_regionkey
  % 2 = 1""")
def scan_archive(spark: SparkSession, d: str) -> DataFrame:
    """SC13, SC14, SC15: members of a ZIP archive, matched to the paths that they are wanted by."""
    at, rows = new_folder(spark), table(spark, d, "nation").select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("n_name"), "n_regionkey").collect()
    data, wanted = io.BytesIO(), []
    with zipfile.ZipFile(data, "w") as z:
        for r in rows:
            even = r.n_regionkey % 2 == 0
            z.writestr(f"wrap/{r.n_name}.jpg" if even else f"{r.n_name}.jpg", r.n_name * 3)
            wanted.append((f"{'wrap' if even else 'pack'}/{r.n_name}.jpg", f"images{r.n_regionkey}/{r.n_name}.jpg" if even else f"pack/{r.n_name}.jpg"))
    write_file(spark, f"{at}/pack.zip", data.getvalue())
    members = files.archive_members(spark, f"{at}/pack.zip")
    files.bundle_matches(members, spark.createDataFrame([(n,) for n in zipfile.ZipFile(data).namelist()], "path string"), "path")
    paths = spark.createDataFrame(wanted, "path string, named string")
    found = files.match_members(members, paths, files.member_names(F.col("member"), "pack", ["pack", "images"]), "path", 1 << 20)
    return found.join(paths, "path").select(F.col("named").alias("path"), "member", "size")


@query("select r_name as name, cast(r_regionkey as varchar) as value from region")
def scan_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SC18: name=value lines. A region is one line, at every scale."""
    lines = [f"{r.r_name} = {r.r_regionkey}\n\n" for r in table(spark, d, "region").collect()]
    return spark.createDataFrame(list(files.read_pairs("".join(lines)).items()), "name string, value string")


@query("select 'r' || r_regionkey || '.name' as name, '/home/' || r_name || '/$HOMER/x' as value from region")
def scan_settings(spark: SparkSession, d: str) -> DataFrame:
    """SC17: typed settings of a TOML text, names expanded in them."""
    rows = table(spark, d, "region").collect()
    text = "".join(f'[r{r.r_regionkey}]\nname = "$HOME/{r.r_name}/$HOMER/x"\n' for r in rows)
    found = files.load_settings(text, [files.Setting(f"r{r.r_regionkey}.name", str) for r in rows], {"HOME": "/home", "R": "no"})
    return spark.createDataFrame(list(found.items()), "name string, value string")


@query("""select page_id, page_id || '.jpg' as reference from pages union all select page_id, 'deep/' || page_id || '.WEBP' from pages where page_id % 3 = 0""")
def scan_references(spark: SparkSession, d: str) -> DataFrame:
    """image paths anywhere in JSON texts, by the names of their fields."""
    key = F.col("page_id").cast("string")
    deep = F.when(F.col("page_id") % 3 == 0, F.struct(F.concat(F.lit("deep/"), key, F.lit(".WEBP")).alias("File_Name"), F.lit("no.jpg").alias("title")))
    tree = F.to_json(
        F.struct(
            F.struct(F.concat(key, F.lit(".jpg")).alias("image")).alias("a"), F.array(deep).alias("b"), F.col("url").alias("path"),
            F.array(F.lit("x.png")).alias("image")
        )
    )
    return files.image_references(table(spark, d, "pages").select("page_id", tree.alias("tree")), "tree", "page_id")


@query("select doc_id, sha256(coalesce(text, '')) as digest, row_number() over (order by doc_id) - 1 as place from documents")
def numbered_digests(spark: SparkSession, d: str) -> DataFrame:
    """H5, SC2: digests of contents, and ranks of a key over ranges."""
    rows = table(spark, d, "documents").select("doc_id", content_sha256(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.lit(1).alias("one"))
    return running_sum(rows, "doc_id", "one", "place").select("doc_id", "digest", "place")
