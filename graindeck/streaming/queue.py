"""Streams: a bounded first-in-first-out queue, interval logs and running best as stateful operators (ST1, ST5, ST6)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def queue_stream(rows: DataFrame, key: str, order: str, item: str, capacity: int) -> DataFrame:
    """ST1 over a stream: each row with the size of its key's queue before it and the oldest item held; rows enter the
    queue after their own use, the oldest leave beyond ``capacity``. State is bounded by the capacity."""
    kinds = dict(rows.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else (), maxlen=capacity)
        # the rows of a micro-batch come unordered; table_stream bounds how many there are
        pdf, out = pd.concat(list(batches)).sort_values(order), []
        for o, i in zip(pdf[order], pdf[item], strict=True):
            out.append((k[0], o, i, len(held), held[0] if held else None))
            held.append(i)
        state.update((list(held),))
        yield pd.DataFrame(out, columns=[key, order, item, "queue_size", "oldest"])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {item} {kinds[item]}, queue_size bigint, oldest {kinds[item]}"
    return rows.groupBy(key).applyInPandasWithState(step, schema, f"held array<{kinds[item]}>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(rows: DataFrame, time: str, kind: str, value: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and means by tumbling event-time window and kind, with a watermark for late rows."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).select(
        F.col("w.start").alias("window_start"), kind, "n", "mean_value"
    )


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Process all input there is, then stop; a later call goes on from the checkpoint (ST3), exactly once."""
    q = stream.writeStream.format(kind).outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def table_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of a folder of parquet files with their own schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
