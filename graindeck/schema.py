"""Schemas of the tables, and the constraints that their readers check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType(), False) for n in names]


# Field names of the manifest and log formats, and suffixes of image files (of manifests, of references).
IMAGE_SUFFIXES = (".jpeg", ".jpg", ".png", ".tif", ".tiff")
REFERENCE_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
CANONICAL = StructType(_strings("id", "image", "caption", "split", "source"))
GROUPED = StructType([*CANONICAL.fields, *_strings("group_id")])
RESTORED = StructType(
    [
        *GROUPED.fields, *_strings("csv_filepath"), StructField("reference_representative", BooleanType(), False),
        StructField("extras", MapType(StringType(), StringType()))
    ]
)
MULTI_CAPTION = StructType(_strings("id", "image_id", "image", "caption", "split", "source"))
CLASSIFICATION = StructType(_strings("id", "image", "label", "split", "source"))
MIXED_PILOT = StructType(
    [
        *CANONICAL.fields,
        *_strings("image_id", "original_caption", "csv_filepath", "caption_kind", "selected_caption_group", "short_caption", "detail_caption")
    ]
)
STEP_LOG = StructType(
    [
        StructField("run", StringType(), False), StructField("step", LongType(), False), StructField("loss", DoubleType()),
        StructField("learning_rates", MapType(StringType(), DoubleType()))
    ]
)


class ConstraintError(ValueError):
    """A table breaks a rule that its reader has to hold; nothing is dropped silently."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, if every rule holds on every row; a null verdict breaks a rule. One pass for all rules."""
    if rules:
        broken = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]).first().asDict()
        if bad := {n: x for n, x in broken.items() if x}:
            raise ConstraintError(f"rows that break a rule: {bad}")
    return df


def require_unique(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df``, if no value of any key occurs twice."""
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        again = df.groupBy(c.alias("key")).count().where("count > 1").limit(3).collect()
        if again:
            raise ConstraintError(f"values of {k} that occur more than once: {[r[0] for r in again]}")
    return df


def require_functional(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df``, if each key has one value."""
    bad = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("not (lo <=> hi)").limit(3).collect()
    if bad:
        raise ConstraintError(f"values of {key} with more than one {value}: {[r[0] for r in bad]}")
    return df


def filled(*names: str) -> dict[str, Column]:
    """Rules: each column is a text that is not blank."""
    return {f"{n} is blank": F.col(n).isNotNull() & (F.trim(F.col(n)) != "") for n in names}
