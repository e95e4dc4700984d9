"""Exact similarity ranking and its metrics (J9, W1, AG11 to AG16, L7).

Ranks are found in two steps, so that no score matrix exists: the best positive of each query first, then the number
of candidates before it. Candidates of at most BLOCK_BYTES, a size that is checked, are broadcast and queries stay
where they are. Beyond that, queries and candidates are dealt to blocks of that size and meet in a grid of cells, one
task a cell; a query's best positives and its counts are then reduced over the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.functions.stats import finite, lower_median
from graindeck.functions.vector import dot
from graindeck.schema import ConstraintError

#: Classes that a row is scored against at most.
MAX_CLASSES = 10_000

#: Bytes of the vectors in a block.
BLOCK_BYTES = 64 << 20

#: Rows whose scores are worked out at once.
CHUNK = 256


def checked_size(rows: DataFrame, name: str) -> tuple[int, int]:
    """Bytes of the vectors as doubles, and their dimension. Empty tables, empty vectors, several dimensions and numbers
    that are not finite are errors."""
    bad = F.exists("vec", lambda x: ~finite(x))
    n, low, high, broken, total = rows.agg(
        F.count("*"), F.min(F.size("vec")), F.max(F.size("vec")), F.count_if(F.coalesce(bad, F.lit(True))), F.sum(F.size("vec"))
    ).first()
    if not n or broken or low != high or low < 1:
        raise ConstraintError(f"{name}: {n} vectors of {low} to {high} numbers, {broken} of them null or not finite")
    return 8 * total, low


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def _scores(queries: pd.DataFrame, candidates: tuple, exclude_self: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, their scores against all candidates, and which are positives; a query's own candidate is NaN if excluded."""
    idx, grp, vectors = candidates
    for a in range(0, len(queries), CHUNK):
        q = queries.iloc[a : a + CHUNK]
        s = _matrix(q["vec"]) @ vectors.T
        if exclude_self:
            s[q["qid"].to_numpy()[:, None] == idx[None, :]] = np.nan
        yield slice(a, a + len(q)), s, q["grp"].to_numpy()[:, None] == grp[None, :]


def _best(queries: pd.DataFrame, candidates: tuple, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Score and index of each query's best positive, of equal ones the smallest index; -inf and -1 without one."""
    top, at = np.full(len(queries), -np.inf), np.full(len(queries), -1, dtype=np.int64)
    for rows, s, positive in _scores(queries, candidates, exclude_self):
        s = np.where(positive & ~np.isnan(s), s, -np.inf)
        top[rows] = s.max(axis=1, initial=-np.inf)
        first = np.where(s == top[rows][:, None], candidates[0][None, :], np.iinfo(np.int64).max).min(axis=1)
        at[rows] = np.where(np.isfinite(top[rows]), first, -1)
    return top, at


def _ahead(queries: pd.DataFrame, top: np.ndarray, at: np.ndarray, candidates: tuple, exclude_self: bool) -> np.ndarray:
    """How many candidates come before each query's best positive."""
    out = np.zeros(len(queries), dtype=np.int64)
    for rows, s, _ in _scores(queries, candidates, exclude_self):
        best = top[rows][:, None]
        with np.errstate(invalid="ignore"):
            out[rows] = ((s > best) | ((s == best) & (candidates[0][None, :] < at[rows][:, None]))).sum(axis=1)
    return out


def _columns(pdf: pd.DataFrame) -> tuple:
    pdf = pdf.rename(columns=lambda c: c.removeprefix("c_")).sort_values("idx")
    return pdf["idx"].to_numpy(), pdf["grp"].to_numpy(), _matrix(pdf["vec"])


def best_positive_ranks(queries: DataFrame, candidates: DataFrame, exclude_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Qid, grp and rank of each query (qid, grp, vec) among candidates (idx, grp, vec).

    Positives are the candidates of the query's group. The best positive has the highest score, ties going to the
    smaller index; the rank is 1 and the number of candidates that score higher, or equal with a smaller index. A query
    without a positive has a null rank. exclude_self: the candidate whose index is the query's id does not count.
    """
    kinds = dict(queries.dtypes)
    base = f"qid {kinds['qid']}, grp {kinds['grp']}"
    queries, candidates = queries.select("qid", "grp", "vec"), candidates.select("idx", "grp", "vec")
    sizes = [checked_size(t, n) for t, n in ((queries, "queries"), (candidates, "candidates"))]
    if sizes[0][1] != sizes[1][1]:
        raise ConstraintError(f"queries have {sizes[0][1]} dimensions, candidates {sizes[1][1]}")
    if sizes[1][0] > block_bytes:
        return _in_grid(queries, candidates, exclude_self, base, *[-(-size // block_bytes) for size, _ in sizes])
    rows = candidates.collect()  # at most block_bytes
    block = queries.sparkSession.sparkContext.broadcast(_columns(pd.DataFrame([tuple(r) for r in rows], columns=["idx", "grp", "vec"])))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            top, at = _best(pdf, block.value, exclude_self)
            ranks = pd.Series(_ahead(pdf, top, at, block.value, exclude_self) + 1, index=pdf.index, dtype="Int64")
            yield pd.DataFrame({"qid": pdf["qid"], "grp": pdf["grp"], "rank": ranks.mask(at < 0)})

    return queries.repartition(max(1, queries.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, f"{base}, rank bigint")


def _in_grid(queries: DataFrame, candidates: DataFrame, exclude_self: bool, base: str, rows: int, columns: int) -> DataFrame:
    """Ranks by cells of a grid of query blocks and candidate blocks."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    # new names, as both sides may come from one table
    dealt = candidates.select(
        F.col("idx").alias("c_idx"), F.col("grp").alias("c_grp"), F.col("vec").alias("c_vec"), block("idx", columns).alias("c_j"), every(rows).alias("c_i")
    )

    def cells(asking: DataFrame):
        asking = asking.withColumn("i", block("qid", rows)).withColumn("j", every(columns))
        return asking.groupBy("i", "j").cogroup(dealt.groupBy("c_i", "c_j"))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values("qid")
        top, at = _best(q, _columns(c), exclude_self) if len(c) else (-np.inf, -1)
        return pd.DataFrame({"qid": q["qid"], "grp": q["grp"], "top": top, "at": at})

    def ahead(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values("qid")
        n = _ahead(q, q["top"].to_numpy(), q["at"].to_numpy(), _columns(c), exclude_self) if len(c) else 0
        return pd.DataFrame({"qid": q["qid"], "grp": q["grp"], "at": q["at"], "n": n})

    tops = cells(queries).applyInPandas(best, f"{base}, top double, at bigint").groupBy("qid").agg(
        F.max_by(F.struct("top", "at"), F.struct("top", (-F.col("at")).alias("first"))).alias("b")
    )
    found = cells(queries.join(tops.select("qid", "b.*"), "qid")).applyInPandas(ahead, f"{base}, at bigint, n bigint")
    return found.groupBy("qid", "grp", "at").agg(F.sum("n").alias("n")).select(
        "qid", "grp", F.when(F.col("at") >= 0, F.col("n") + 1).cast("bigint").alias("rank")
    )


def _hit(k: int) -> Column:
    """Whether a rank is within k; a query without a positive is an error, since leaving it out would raise the recall."""
    missing = F.raise_error(F.lit("a query has no positive candidate")).cast("double")
    return F.when(F.col("rank").isNull(), missing).otherwise((F.col("rank") <= k).cast("double"))


def recall_summary(ranks: DataFrame, *by: str) -> DataFrame:
    """AG11: queries, Recall@1, 5, 10 (a hit is any positive), lower median and mean rank."""
    at = [F.avg(_hit(k)).alias(f"r{k}") for k in (1, 5, 10)]
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n_queries"), *at, lower_median("rank").cast("long").alias("median_rank"), F.avg("rank").alias("mean_rank")
    )


def mean_recall(summary: DataFrame) -> DataFrame:
    """AG12: the mean of the recalls of all directions and cutoffs."""
    return summary.agg(F.avg((F.col("r1") + F.col("r5") + F.col("r10")) / 3).alias("mean_recall"))


def group_balanced(ranks: DataFrame) -> DataFrame:
    """AG13: recalls averaged within groups, then over groups."""
    per = ranks.groupBy("grp").agg(*[F.avg(_hit(k)).alias(f"r{k}") for k in (1, 5, 10)])
    return per.agg(F.count("*").alias("n_groups"), *[F.avg(f"r{k}").alias(f"r{k}") for k in (1, 5, 10)])


def prototypes(df: DataFrame, label: str, vec: str) -> DataFrame:
    """AG16: the unit vector of the mean of each label's unit vectors. Means are taken by coordinate, map-side."""
    flat = df.select(label, F.posexplode(vec).alias("dim", "x"))
    mean = flat.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    arrays = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("proto"))
    n = F.greatest(F.sqrt(F.aggregate("proto", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return arrays.withColumn("proto", F.transform("proto", lambda x: x / n))


def classify(df: DataFrame, protos: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    """The label whose prototype scores highest, ties to the smallest.

    Prototypes are one a class, a fixed small set (more than MAX_CLASSES is an error): they become one array that every
    row is scored against where it stands.
    """
    if protos.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ConstraintError(f"more than {MAX_CLASSES} classes")
    every = protos.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("cls"), "proto")))).scalar()
    scores = F.transform(F.col("classes"), lambda c: F.struct(dot(F.col("v"), c["proto"]).alias("s"), (-c["cls"]).alias("c")))
    return df.select(
        key, F.col(label).alias("truth"), F.col(vec).alias("v"), every.alias("classes")
    ).select(key, "truth", (-F.array_max(scores)["c"]).alias("predicted"))


def accuracy(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG14: by class, and overall with the mean over classes."""
    hit = (F.col("truth") == F.col("predicted")).cast("double")
    per = pred.groupBy("truth").agg(F.count("*").alias("n"), F.avg(hit).alias("acc"))
    total = per.agg(F.sum("n").alias("n"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("acc").alias("mean_class_accuracy"))
    return per, total
