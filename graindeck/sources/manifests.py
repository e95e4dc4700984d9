"""Manifest readers and writers: JSON lines, CSV, nested JSON (SC1 to SC10, SC16, SK1, SK4)."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graindeck.functions.text import normalized, stripped
from graindeck.operators.select import running_sum
from graindeck.schema import CANONICAL, CLASSIFICATION, GROUPED, MULTI_CAPTION, ConstraintError, filled, require, require_functional, require_unique


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ord, the 0-based number of a line over all files of the path in the order of their names.

    Files are read in splits, each by a task. Lines are numbered within a split as they are read, and the splits' line
    counts, one row for each, give a split's first number.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(splits, ["file", "start"]).select((F.col("offset") + F.col("row") - F.col("first")).cast("long").alias("ord"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: StructType = CANONICAL, blank: str = "skip") -> DataFrame:
    """SC1 (blank lines skipped), SC7 (blank="error"): rows of the schema with ord; malformed lines, missing required
    fields and an empty table are errors."""
    lines = numbered_lines(spark, path)
    empty = F.trim("value") == ""
    if blank == "error":
        require(lines, {"blank line": ~empty})
    lines = lines.where(~empty).withColumn("row", F.from_json("value", schema, {"mode": "FAILFAST"}))
    out = lines.select("ord", "row.*")
    if out.isEmpty():
        raise ConstraintError(f"{path} has no rows")
    return require(out, {f"{f.name} is missing": F.col(f.name).isNotNull() for f in schema.fields if not f.nullable})


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SC16: rows with ord, and error where a line is no JSON object of the schema."""
    row = F.from_json(
        "value", StructType([*schema.fields]).add("_corrupt_record", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    return numbered_lines(spark, path).where(F.trim("value") != "").withColumn("row", row).select("ord", "row.*").withColumnRenamed("_corrupt_record", "error")


def multi_caption(rows: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """SC2: images numbered by image_id and captions by id, after the checks of the multi-caption manifest."""
    require(rows, filled(*MULTI_CAPTION.fieldNames()) | {"split": F.lower("split") == split})
    require_functional(require_unique(rows, "id"), "image_id", "image")
    images = _numbered(rows.select("image_id", "image").distinct(), "image_id")
    return images, _numbered(rows, "id").join(images.select("image_id", F.col("idx").alias("image_idx")), "image_id")


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """0-based rank of a unique key."""
    return running_sum(df.withColumn("one", F.lit(1)), key, "one", "idx").drop("one")


def one_to_one(rows: DataFrame, split: str, source: str) -> DataFrame:
    """SC3: unique id, image and normalized caption; candidates keep the file's order (ord)."""
    require(rows, filled(*CANONICAL.fieldNames()) | {"split": F.lower("split") == split, "source": F.col("source") == source})
    return require_unique(rows, "id", "image", normalized(F.col("caption")))


def caption_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC4, F13: rows, and one text a group: its first caption in file order, groups in order of appearance."""
    require(rows, filled(*GROUPED.fieldNames()) | {"group_id": F.col("group_id") == normalized(F.col("caption"))})
    texts = require_unique(rows, "id", "image").groupBy("group_id").agg(F.min_by("caption", "ord").alias("caption"), F.min("ord").alias("first"))
    return rows, texts


def classification(rows: DataFrame, classes: list[str]) -> DataFrame:
    """SC5: labels of a fixed set, each of which occurs."""
    require(rows, filled(*CLASSIFICATION.fieldNames()) | {"label": F.col("label").isin(classes)})
    if gone := set(classes) - {r[0] for r in rows.select("label").distinct().collect()}:
        raise ConstraintError(f"classes without rows: {sorted(gone)}")
    return rows


def captions_only(rows: DataFrame) -> DataFrame:
    """SC6: id and caption; the scan reads no other column."""
    return require_unique(require(rows.select("id", "caption"), filled("id", "caption")), "id")


def read_csv(spark: SparkSession, path: str, required: list[str], exact: bool = False) -> DataFrame:
    """SC8: all columns as text. A missing header column is an error, as is a row with too many cells; exact: the header
    is this list in this order. A byte-order mark is taken off; a quoted name may hold commas."""
    head = spark.read.text(path).first()
    if head is None:
        raise ConstraintError(f"{path} is empty")
    names = [c.strip() for c in next(csv.reader([head[0].lstrip("\ufeff").rstrip("\r")]))]
    if (names != required) if exact else not set(required) <= set(names):
        raise ConstraintError(f"columns of {path}: {names}; needed: {required}")
    schema = StructType()
    for c in [*names, "_corrupt_record"]:
        schema = schema.add(c, "string")
    rows = spark.read.csv(
        path, schema=schema, header=True, enforceSchema=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    )
    bad = rows.where("_corrupt_record is not null").limit(1).collect()
    if bad:
        raise ConstraintError(f"a row of {path} has not as many cells as the header: {bad[0]['_corrupt_record'][:80]}")
    return rows.drop("_corrupt_record")


ROOT_KEYS = ("annotations", "images", "data", "records")


def nested_records(spark: SparkSession, path: str, record: str, keys: tuple[str, ...] = ROOT_KEYS) -> DataFrame:
    """SC9, SC10: records (a DDL struct) of a JSON list, or of the first of these keys that an object has."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<struct<{record}>>")
    as_object = F.from_json("value", ", ".join(f"{k} array<struct<{record}>>" for k in keys))
    root = F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(*[as_object[k] for k in keys]))
    out = text.select(F.posexplode(root).alias("ord", "record")).select(F.col("ord").cast("long"), "record.*")
    if out.isEmpty():
        raise ConstraintError(f"{path} holds no records")
    return out


def annotation_captions(rows: DataFrame, sentences: str = "sentences") -> DataFrame:
    """One row a sentence with its first usable text: raw, caption, text (those of them that the structs have) or the
    joined tokens. A sentence without any is an error."""
    out = rows.select("*", F.posexplode(sentences).alias("number", "s"))
    fields = out.schema["s"].dataType.fieldNames()
    found = [F.col(f"s.{f}") for f in ("raw", "caption", "text") if f in fields]
    if "tokens" in fields:
        tokens = F.filter(F.transform("s.tokens", stripped), lambda t: t != "")
        found.append(F.when(F.forall("s.tokens", lambda t: t.isNotNull()), F.array_join(tokens, " ")))
    usable = F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in found])
    caption = F.when(usable.isNull(), F.raise_error(F.lit("a sentence has no usable text")).cast("string")).otherwise(usable)
    return out.withColumn("caption", caption).drop("s")
