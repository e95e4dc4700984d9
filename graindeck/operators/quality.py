"""Data-quality audits: duplicates, lengths, group sizes, overlaps, leaks, references (AG1 to AG10, J1 to J15, F5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.operators.select import running_sum
from graindeck.schema import ConstraintError


def counts(df: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """AG1."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def digest(key: Column) -> Column:
    return F.unhex(F.sha2(key.cast("string").cast("binary"), 256))


def duplicate_rate(df: DataFrame, key: Column, *by: str) -> DataFrame:
    """AG2: rows, distinct values, rows beyond the first of each value, and their share. Values are compared by a 256-bit
    digest, so that long ones are not shuffled."""
    grouped = df.withColumn("key", digest(key)).groupBy(*by, "key").agg(F.count("*").alias("n"))
    out = grouped.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"))
    return out.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct")).withColumn("rate", F.col("n_duplicates") / F.col("n_rows"))


def most_common(df: DataFrame, key: Column, order: str, k: int = 20) -> DataFrame:
    """AG3: the k most frequent values, ties by first appearance (``order`` is unique). Values are counted by digest; only
    the rows where the k first appear are read again for theirs."""
    keyed = df.select(F.col(order).alias("first"), key.alias("value"))
    top = keyed.groupBy(digest(F.col("value")).alias("d")).agg(F.count("*").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").limit(k)
    return keyed.join(F.broadcast(top.drop("d")), "first").select("value", "n", "first").orderBy(F.desc("n"), "first")


def rounded_percentiles(df: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """AG6: sorted[round((n - 1) f)], halves to even, for each fraction.

    Values are counted first, so what is ranked is the distinct values, and a rank is a running sum of counts.
    """
    c = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    if by:
        w = Window.partitionBy(*by).orderBy(value)
        c = c.withColumn(
            "_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    else:  # over ranges, as one group would be one task
        total = c.agg(F.sum("_n")).scalar()
        c = running_sum(
            c.where(F.col(value).isNotNull()), value, "_n", "_before"
        ).withColumn("_upto", F.col("_before") + F.col("_n")).withColumn("_total", total)
    place = {k: F.bround((F.col("_total") - 1) * F.lit(f), 0) for k, f in fractions.items()}
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > p, F.col(value))).alias(k) for k, p in place.items()])


def group_sizes(df: DataFrame, key: Column) -> DataFrame:
    """AG9: one row: groups, singletons, p50 and p95 (AG6), largest."""
    sizes = df.groupBy(digest(key).alias("key")).agg(F.count("*").alias("size"))
    p = rounded_percentiles(sizes, "size", {"p50": 0.5, "p95": 0.95})
    return sizes.agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("size") == 1).alias("n_singletons"), F.max("size").alias("largest")
    ).select("*", *[p.select(c).scalar().alias(c) for c in p.columns])


def size_histogram(df: DataFrame, key: Column) -> DataFrame:
    """AG10: number of groups by size."""
    return df.groupBy(digest(key).alias("key")).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """All pairs with an equal key."""
    return left.select(key, F.col(left_id).alias("left_id")).join(right.select(key, F.col(right_id).alias("right_id")), key)


def overlap_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """J1 as numbers of rows by key, from which the pairs are a product; nothing is expanded."""
    a, b = (t.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)) for t, n in ((left, "n_left"), (right, "n_right")))
    return a.join(b, key).withColumn("n_pairs", F.col("n_left") * F.col("n_right"))


def audit_overlap(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each key: pairs and the verdict clear or overlap."""
    out = None
    for k in keys:
        one = overlap_counts(left, right, k).agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs")).select(
            F.lit(k).alias("key"), "n_pairs", F.when(F.col("n_pairs") > 0, "overlap").otherwise("clear").alias("status")
        )
        out = one if out is None else out.union(one)
    return out


def without_digests(df: DataFrame, digests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose digest is not listed, and removals by digest; nothing left is an error."""
    kept = df.join(digests.select(key).distinct(), key, "left_anti")
    if kept.isEmpty():
        raise ConstraintError("no row is left")
    return kept, df.join(digests.select(key).distinct(), key, "left_semi").groupBy(key).count()


def leak(train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    """J10, SO1: values on both sides."""
    return train.select(key).intersect(val.select(key))


def require_no_leak(train: DataFrame, val: DataFrame, *keys: str) -> None:
    for k in keys:
        if found := leak(train, val, k).limit(3).collect():
            raise ConstraintError(f"values of {k} on both sides: {[r[0] for r in found]}")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """J11, SO2, SO3: rows of one side only, and which side: equal sets give none."""
    return left.subtract(right).withColumn("side", F.lit("left")).union(right.subtract(left).withColumn("side", F.lit("right")))


def missing(df: DataFrame, files: DataFrame, path: str, allow: bool = False, examples: int = 100) -> tuple[int, list[str]]:
    """number of rows without a file and the first of them by path; an error unless allowed."""
    gone = df.select(path).join(files.select(path).distinct(), path, "left_anti")
    n, first = gone.count(), [r[0] for r in gone.orderBy(path).limit(examples).collect()]
    if n and not allow:
        raise ConstraintError(f"{n} files are missing, such as {first[:5]}")
    return n, first


def resolve_references(refs: DataFrame, files: DataFrame, ref: str, path: str) -> DataFrame:
    """Each reference with its file and a status: resolved, ambiguous or missing.

    A reference that is a path wins; else files with its base name are counted.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    by_path = files.select(F.col(path).alias("direct")).distinct()
    by_name = files.select(path).distinct().groupBy(base(F.col(path)).alias("name")).agg(F.count("*").alias("n_files"), F.min(path).alias("any_file"))
    out = refs.join(by_path, refs[ref] == by_path["direct"], "left").withColumn("name", base(F.col(ref))).join(by_name, "name", "left")
    status = F.when(F.col("direct").isNotNull() | (F.col("n_files") == 1), "resolved").when(F.col("n_files") > 1, "ambiguous").otherwise("missing")
    return out.withColumn("status", status).withColumn(
        "file", F.when(F.col("status") == "resolved", F.coalesce("direct", "any_file"))
    ).drop("direct", "n_files", "any_file", "name")


def edges_not_reciprocal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges (x, y) of one set that the other, turned round, has not."""
    return set_difference(a.select("x", "y"), b.select(F.col("y").alias("x"), F.col("x").alias("y")))


def restore_groups(rows: DataFrame, references: DataFrame, extras: list[str]) -> DataFrame:
    """Rows (path, caption, group_id) joined to reference groups; the reference's own image is marked, and an
    image that the reference names with another group is an error."""
    groups = references.groupBy("group_id").agg(
        F.min_by(F.struct("ord", F.col("image").alias("ref_image"), F.col("caption").alias("ref_caption"), *extras), F.struct("ord")).alias("ref")
    )
    out = rows.join(groups, "group_id").withColumn("reference_representative", F.col("path") == F.col("ref.ref_image"))
    wrong = rows.join(
        references.select(F.col("image").alias("path"), F.col("group_id").alias("ref_group")), "path"
    ).where("group_id <> ref_group").limit(1).collect()
    if wrong:
        raise ConstraintError(f"an image has another caption than its reference: {wrong[0]['path']}")
    return out


def field_counts(df: DataFrame, fields: Column) -> DataFrame:
    """AG28: records by field name, from a map column."""
    return df.select(F.explode(F.map_keys(fields)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def consistent(df: DataFrame, value: str, *by: str) -> DataFrame:
    """AG26: whether all rows have one value and none is null."""
    return df.groupBy(*by).agg(((F.min(value) == F.max(value)) & (F.count(value) == F.count("*"))).alias("consistent"))
