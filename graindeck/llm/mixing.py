"""Mixing sources to target weights: hierarchical budgeting over domain, language and source.

A token budget flows down the tree by the nodes' weights. A node short of tokens takes what it has, and what it
leaves is dealt again among its siblings by weight until it is placed; only what a whole subtree cannot take goes to
the siblings of its ancestors. A leaf can give each of its tokens once an epoch, for ``epochs`` epochs; in each epoch
its documents come in an order of their own, set by the seed, and the leaf's share is a prefix of that sequence: all
documents that begin before the share is used up.

Everything is DataFrame functions. No leaf is sorted in one task: a leaf's order is cut into ranges of hashes, their
token sums give each range's offset, and rows are ordered within a range only.

Defined results: null domains, languages and sources are values of their own (""); null texts have 0 tokens and are
never taken; repeated rows are each counted and may each be taken; ties in the order are cut by doc_id, and rows
that tie even then are taken or left together; a text of any length is counted whole; an empty table gives an empty
result. Names missing from the weights have weight 1; negative weights count as 0. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.llm.common import SPACE_WORD, Run

LEVELS = ("domain", "lang", "source")

#: Rows of a leaf in one range of its order, on average.
RANGE_ROWS = 1_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _fill(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Deal each parent's ``budget`` among its nodes by weight w, no node above its capacity cap: column share.

    The share is min(cap, level * w), with one level for all siblings. Siblings sorted by cap / w fill up in that
    order, so the level follows from running sums.
    """
    fill = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*parent).orderBy("fill", "name")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    out = nodes.withColumn("fill", fill)
    out = out.withColumn(
        "full_cap", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    ).withColumn("open_w", F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("level", F.when(F.col("open_w") > 0, (F.col(budget) - F.col("full_cap")) / F.col("open_w")))
    # the first node whose own fill is not below the level of those still open sets the level
    out = out.withColumn("line", F.min(F.when((F.col("level") <= F.col("fill")) & (F.col("w") > 0), F.struct("fill", "name", "level"))).over(whole)["level"])
    return out.withColumn(
        "share",
        F.when(F.col("w") > 0, F.least(F.col("cap").cast("double"), F.coalesce(F.col("line"), F.lit(float("inf"))) * F.col("w"))).otherwise(F.lit(0.0))
    ).drop("fill", "full_cap", "open_w", "level", "line")


def weight_column(level: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, x in sorted(weights.items()):
        out = F.when(F.col(level) == name, F.lit(max(0.0, float(x)))).otherwise(out)
    return out


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: Column, epochs: int) -> DataFrame:
    """Leaves (LEVELS, n_tokens, n_rows) with their share of ``budget`` (a column over total_tokens), in tokens."""
    tree = leaves.withColumn("cap", F.col("n_tokens") * epochs)
    total = tree.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens")).select(F.round(budget).alias("budget"))
    shares = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("name", F.col(level)).withColumn(
            "w", weight_column(level, weights.get(level, {}))
        )
        if shares is None:
            nodes = nodes.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
            dealt = _fill(nodes, ["one"], "budget").drop("one")
        else:
            dealt = _fill(nodes.join(shares, path[:-1]), path[:-1], "budget")
        shares = dealt.select(*path, F.col("share").alias("budget"))
    return tree.join(shares.withColumnRenamed("budget", "share"), list(LEVELS))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], budget: Column, epochs: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (epochs in which it is taken) of the documents taken.

    budget: the tokens to take, as a column over ``total_tokens``, the number of tokens there are.
    """
    with Run(docs.sparkSession) as run:
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        rows = docs.select(
            "doc_id", text(domain).alias("domain"), text(F.col("lang")).alias("lang"), text(F.col("source")).alias("source"),
            token_count(F.col("text")).alias("n_tokens")
        )
        rows = run.stored(rows.where(F.col("n_tokens") > 0), "mix")
        leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
        shares = run.stored(budgets(leaves, weights, budget, epochs), "shares").select(*LEVELS, F.col("n_tokens").alias("leaf_tokens"), "n_rows", "share")
        every = rows.join(F.broadcast(shares) if _small(shares) else shares, list(LEVELS))
        # whole epochs are taken of every document; the last one is a prefix of its order
        every = every.withColumn("whole", F.floor(F.col("share") / F.col("leaf_tokens")))
        every = every.withColumn("rest", F.col("share") - F.col("whole") * F.col("leaf_tokens"))
        digest = F.sha2(F.encode(F.concat_ws("|", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("doc_id").cast("string")), "UTF-8"), 256)
        every = every.withColumn("place", F.substring(digest, 1, 16))
        ranges = F.greatest(F.lit(1.0), F.ceil(F.col("n_rows") / F.lit(float(RANGE_ROWS))))
        every = every.withColumn("part", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * ranges).cast("int"))
        sums = every.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("part_tokens"))
        ahead = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*LEVELS, "part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("offset"))
        here = Window.partitionBy(*LEVELS, "part").orderBy("place", "doc_id")
        # rows before this one and its ties: the running sum with ties (a range frame) less that of its own ties
        ties = Window.partitionBy(*LEVELS, "part", "place", "doc_id")
        first = F.sum("n_tokens").over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n_tokens").over(ties)
        every = every.join(offsets, [*LEVELS, "part"]).withColumn("begins", F.col("offset") + first)
        copies = (F.col("whole") + F.when(F.col("begins") < F.col("rest"), 1).otherwise(0)).cast("long")
        return run.result(every.withColumn("copies", copies).where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies"), "mix")


def _small(df: DataFrame, most: int = 20_000) -> bool:
    """Whether a written table has few enough rows to broadcast."""
    return df.limit(most + 1).count() <= most
