"""Contrastive losses over fixed batches, and the first-in-first-out queue as a window (M4, M5, AG17, AG24, ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graindeck.functions.vector import dot


def _logits(rows: DataFrame, batch: str, pos: str, a: str, b: str, group: str, scale: float) -> DataFrame:
    """Scaled scores of every pair of a batch; batches have a bounded size, and a batch is one join key."""
    left = rows.select(batch, F.col(pos).alias("i"), F.col(a).alias("va"), F.col(group).alias("gi"))
    right = rows.select(batch, F.col(pos).alias("j"), F.col(b).alias("vb"), F.col(group).alias("gj"))
    return left.join(right, batch).select(
        batch, "i", "j", (F.col("gi") == F.col("gj")).alias("positive"), (dot(F.col("va"), F.col("vb")) * scale).alias("logit")
    )


def _cross_entropy(pairs: DataFrame, batch: str, row: str, objective: str) -> DataFrame:
    """Mean loss of each batch over its rows; the largest logit is taken out of the exponentials."""
    kept = pairs if objective == "multi_positive" else pairs.where(~F.col("positive") | (F.col("i") == F.col("j")))
    target = F.when(F.col("positive") if objective == "multi_positive" else F.col("i") == F.col("j"), F.col("logit"))
    top = F.max("logit").over(Window.partitionBy(batch, row))
    per = kept.withColumn("top", top).groupBy(batch, row).agg((F.max("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top")))) - F.avg(target)).alias("loss"))
    return per.groupBy(batch).agg(F.avg("loss").alias("loss"), F.count("*").alias("size"))


def group_losses(rows: DataFrame, batch: str, pos: str, a: str, b: str, group: str, scale: float, objective: str = "multi_positive") -> DataFrame:
    """M4 (every group distinct), M5: image, text and mean loss of each batch.

    multi_positive: uniform targets over the rows of the same group; mask_same_caption: the row itself, others of its
    group left out.
    """
    if objective not in ("multi_positive", "mask_same_caption"):
        raise ValueError(f"unknown objective {objective}")
    pairs = _logits(rows, batch, pos, a, b, group, scale)
    image = _cross_entropy(pairs, batch, "i", objective).withColumnRenamed("loss", "image_loss")
    text = _cross_entropy(pairs, batch, "j", objective).select(batch, F.col("loss").alias("text_loss"))
    return image.join(text, batch).withColumn("loss", (F.col("image_loss") + F.col("text_loss")) / 2)


def weighted_loss(losses: DataFrame) -> DataFrame:
    """AG17: losses weighted by batch size, a short last batch included."""
    return losses.agg(F.sum("size").alias("n"), (F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("loss"))


def batch_diagnostics(rows: DataFrame, batch: str, group: str) -> DataFrame:
    """AG24: by batch: rows, groups, positives a query, off-diagonal positives, share of rows alone in their group."""
    c = rows.groupBy(batch, group).agg(F.count("*").alias("n"))
    return c.groupBy(batch).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("positives_per_query"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("off_diagonal"), (F.count_if(F.col("n") == 1) / F.sum("n")).alias("singleton_share"),
    )


def queue_window(rows: DataFrame, arrival: str, item: str, capacity: int) -> DataFrame:
    """ST1 over a table: the number of entries that the queue holds when a row arrives (0-based, without gaps), as rows are
    queued after their own use, and the oldest of them. A join with the row ``capacity`` arrivals before, not a window."""
    gone = rows.select((F.col(arrival) + capacity).alias(arrival), F.col(item).alias("oldest"))
    first = rows.where(F.col(arrival) == 0).agg(F.max(item)).scalar()
    out = rows.join(gone, arrival, "left").withColumn("queue_size", F.least(F.col(arrival), F.lit(capacity)).cast("long"))
    return out.withColumn("oldest", F.when((F.col(arrival) > 0) & (F.col(arrival) < capacity), first).otherwise(F.col("oldest")))


def queue_collisions(rows: DataFrame, key: str, batch: str, arrival: str, capacity: int, batch_size: int) -> DataFrame:
    """ST2: rows whose key is among the last ``capacity`` rows before their batch."""
    w = Window.partitionBy(key).orderBy(arrival)
    start = F.col(batch) * batch_size
    # the key's latest arrival before the batch; its rows within the batch do not count
    marked = rows.withColumn("batch_start", start).withColumn("last_in", F.max(F.struct(batch, arrival)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    before = F.when(F.col(f"last_in.{batch}") < F.col(batch), F.col(f"last_in.{arrival}"))
    first = F.min(before).over(Window.partitionBy(key, batch))
    return marked.withColumn("previous", F.coalesce(before, first)).where(F.col("previous") >= F.col("batch_start") - capacity).drop("last_in", "batch_start")
