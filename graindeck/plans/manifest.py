"""Manifest preparation from source rows to published tables, as compositions of operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.functions import text as T
from graindeck.functions.hashing import priority
from graindeck.operators import quality, select
from graindeck.schema import ConstraintError, filled, require, require_unique


def canonical(rows: DataFrame, path: str, field: str, split: str, source: str, mode: str = "auto") -> DataFrame:
    """Canonical rows (id, image, caption, split, source) of source rows with a path and a text.

    Unsafe paths, captions that the mode finds nothing in and repeated ids are errors.
    """
    out = rows.select(T.plain_path(F.col(path)).alias("image"), T.caption_from(F.col(field), mode).alias("caption"))
    out = out.select(T.record_id(F.lit(source), F.col("image")).alias("id"), "image", "caption", F.lit(split).alias("split"), F.lit(source).alias("source"))
    return require_unique(require(out, filled("caption") | {"path is unsafe": T.safe_path(F.col("image"))}), "id")


def of_split(rows: DataFrame, split: str) -> DataFrame:
    """F2 in preparation: rows of the split, whatever its case; in evaluation use ``require`` instead."""
    return rows.where(F.lower(F.trim("split")) == split.lower())


def audit(rows: DataFrame, preview: int = 20) -> dict:
    """AG1, AG2, AG3, AG6, S4, S6, L4: what an audit of canonical rows reports, each figure from an aggregate."""
    key, stem = T.normalized(F.col("caption")), T.stem(F.col("image"))
    lengths = rows.select(T.word_count(F.col("caption")).alias("w"), F.char_length("caption").cast("long").alias("c"))
    dup = quality.duplicate_rate(rows, key).first()
    out = {"records": dup.n_rows, "unique_captions": dup.n_distinct, "duplicates": dup.n_duplicates, "duplicate_rate": dup.rate}
    for n in ("w", "c"):
        p = quality.rounded_percentiles(lengths, n, {"p50": 0.5, "p95": 0.95, "max": 1.0}).first()
        out[{"w": "words", "c": "characters"}[n]] = p.asDict() if p else {}
    for n, c in (("countries", T.country(stem)), ("zooms", T.zoom(stem))):
        out[n] = {r[0]: r[1] for r in quality.counts(rows, c).orderBy(F.desc("n"), "value").collect()}
    out["most_common"] = [(r.value, r.n) for r in quality.most_common(rows, key, "id", preview).collect()]
    return out


def text_audit(rows: DataFrame, context: int, preview: int = 20, length: Column | None = None) -> dict:
    """Token lengths against a context: records, distinct captions, overflow and its first examples (S9, AG2, L4)."""
    n = T.token_count(F.col("caption")) if length is None else length
    t = rows.select("id", "caption", T.normalized(F.col("caption")).alias("key"), n.alias("n"))
    a = t.agg(F.count("*"), F.countDistinct("key"), F.count_if(F.col("n") > context)).first()
    if not a[0]:
        raise ConstraintError("the manifest is empty")
    p = quality.rounded_percentiles(t, "n", {"p50": 0.5, "p95": 0.95, "max": 1.0}).first().asDict()
    worst = [r.asDict() for r in t.where(F.col("n") > context).orderBy("id").limit(preview).select("id", "n", "caption").collect()]
    return {
        "records": a[0], "unique": a[1], "duplicates": a[0] - a[1], "duplicate_rate": (a[0] - a[1]) / a[0], "overflow": a[2], "lengths": p, "examples": worst
    }


def fitted(rows: DataFrame, context: int, first_sentence: bool = False) -> DataFrame:
    """Captions cut to the context, with the original where it changed."""
    text = T.first_sentence(F.col("caption")) if first_sentence else F.col("caption")
    out = rows.withColumn("original_caption", F.col("caption")).withColumn("caption", T.fit_words(text, context))
    return require(out.withColumn("changed", F.col("caption") != F.col("original_caption")), filled("caption"))


def restored(rows: DataFrame, references: DataFrame, prefixes: Iterable[str]) -> tuple[DataFrame, dict]:
    """Source rows (path, caption) expanded to reference groups (ord, id, image, caption, group_id).

    Returns the rows in reference order and how many were eligible, of another prefix, or of no known group.
    """
    keyed = rows.withColumn("group_id", T.normalized(F.col("caption"))).withColumn("ok", select.in_prefixes(F.col("path"), prefixes))
    known = references.select("group_id").distinct().withColumn("known", F.lit(True))
    marked = keyed.join(known, "group_id", "left")
    n = marked.agg(
        F.count_if(F.expr("ok and known")).alias("eligible"), F.count_if(F.expr("not ok")).alias("excluded_prefix"),
        F.count_if(F.expr("ok and known is null")).alias("unknown_group")
    ).first().asDict()
    eligible = marked.where("ok and known").drop("ok", "known")
    out = quality.restore_groups(eligible, references, ["id"])
    if lost := references.join(out.where("reference_representative"), references["image"] == out["path"], "left_anti").limit(1).collect():
        raise ConstraintError(f"a reference image is not among the rows: {lost[0]['image']}")
    return select.restored_order(out.withColumn("reference_ord", F.col("ref.ord")), "reference_ord", "reference_representative", "path"), n


def paired_captions(short: DataFrame, detail: DataFrame, path: str) -> DataFrame:
    """Short captions with their detail, null where there is none; repeated paths are errors."""
    return require_unique(short, path).join(require_unique(detail, path), path, "left")


def mixed_candidates(rows: DataFrame, splits: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One candidate a group of rows (path, short, detail), ready for the greedy quota, and the
    numbers of rejected rows by their first reason."""
    keyed = rows.withColumn("group", T.normalized(F.col("short"))).withColumn("object", T.object_key(F.col("path")))
    require(keyed, {"no object in the path": F.col("object").isNotNull()})
    keyed = keyed.join(splits.select("group", "split"), "group", "left")
    crossing = keyed.where("split is not null").groupBy("object").agg((F.min("split") != F.max("split")).alias("crossing"))
    n_short, n_detail = T.word_count(F.col("short")), T.word_count(F.col("detail"))
    # fixed values: names of the reasons, in the order that they are tried
    reason = select.first_reason(
        (
            "missing_detail", F.coalesce(F.trim("detail"), F.lit("")) == ""
        ), ("short_over_20_words", n_short > 20), ("detail_outside_12_50_words", ~n_detail.between(12, 50)),
        (
            "detail_not_meaningfully_different", ~T.meaningfully_differs(F.col("short"), F.col("detail"))
        ), ("object_in_both_original_splits", F.coalesce("crossing", F.lit(False))),
    )
    judged = keyed.join(crossing, "object", "left").withColumn("reason", reason)
    kept = require(judged.where("reason is null"), {"group without a split": F.col("split").isNotNull()})
    ranked = kept.select("group", "split", "path", "object", "short", "detail", priority(seed, F.col("path")).alias("priority"))
    return select.least_per_group(ranked, "group", "priority", "path"), judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def prompts(classes: DataFrame, name: str, templates: list[str]) -> DataFrame:
    """Every class under every template, class by class; both sides are small, fixed lists."""
    t = F.posexplode(F.array(*[F.lit(x) for x in templates])).alias("template_no", "template")
    return classes.select("*", t).withColumn("prompt", T.prompt(F.col("template"), F.col(name)))
