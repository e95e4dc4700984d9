"""Helpers shared by the corpus operators: folds, bounded samples, shared storage, Arrow streaming."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch sent to a Python worker; keeps a batch of long texts within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

#: The word class `[^\x20\x09-\x0D]+` as Java and Python regular expressions.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: ASCII whitespace of SPACE_WORD.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(col: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % F.lit(modulus)


def fold_of(value, modulus: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine, as in tests, a
    temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir()
    if found and not isinstance(found, str):
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(found)
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Paths of the result tables of this process, in the order they were made.
_RESULTS: list[str] = []


@contextmanager
def results_within(spark: SparkSession) -> Iterator[None]:
    """Result tables made within the block are deleted at its end; what is to stay has to be written before."""
    begin = len(_RESULTS)
    try:
        yield
    finally:
        for path in _RESULTS[begin:]:
            deleted(spark, path)
        del _RESULTS[begin:]


class Run:
    """The tables of one call of an operator, in a folder of their own below the shared one.

    A stored table cuts the lineage and outlives executors. When the ``with`` block ends, by an error too, the folder is
    deleted; what the call returns is written by ``result`` beside it and is all that stays (see ``results_within``).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.home = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *error) -> None:
        deleted(self.spark, self.home)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_path = path
        return out

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of this run."""
        return self._written(df, f"{self.home}/{name}-{uuid.uuid4().hex}")

    def discarded(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            deleted(self.spark, t.stored_path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as the table that stays when the run's own are deleted."""
        _RESULTS.append(f"{shared_dir(self.spark)}/results/{name}-{uuid.uuid4().hex}")
        return self._written(df, _RESULTS[-1])


def trimmed(cycles: bool = True) -> None:
    """Give memory that a worker no longer uses back to the system, where that is possible; workers outlive tasks.

    cycles: look for objects that refer to each other, too, which takes longer.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None:
        trim(0)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, before the next step writes its own.

    Spark drops them when the JVM collects a plan, which a driver with much memory may not do for hours. A plan is let
    go of in steps, first by Python, then by the JVM, so it takes more than one collection.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows and BATCH_BYTES bytes (or one row), whatever size they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small() -> Iterator[pa.RecordBatch]:
            for b in batches:
                step = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
                for i in range(0, b.num_rows, step):
                    yield b.slice(i, step)

        return iter(fn(small()))

    # Spark reads these when the plan runs, so they stay set in the session: a batch that crosses to Python is bounded
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def runs_of(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[bool, pa.Table]]:
    """Rows of sorted batches by equal values of the first column: (whether all the value's rows, the rows).

    A value with more than ``most`` rows comes in pieces as they arrive, so it is never held as a whole.
    """
    held: pa.Table | None = None
    beyond = None  # the value that is known to have too many rows
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        k = t.column(0).to_numpy()
        cut = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1] if len(k) else np.zeros(0, int)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield k[lo] != beyond, t.slice(lo, hi - lo)
        held = t.slice(int(cut[-1])) if len(cut) else None
        if held is not None and most is not None and (held.num_rows > most or k[-1] == beyond):
            beyond = k[-1]
            yield False, held
            held = None
    if held is not None and held.num_rows:
        yield held.column(0)[0].as_py() != beyond, held


def one_text_each(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The documents of the ids in ``picked``, one row for each id (of repeated ids the smallest text), so there are no
    more rows than ids. ``picked`` has a bounded number of rows and is broadcast."""
    more = [F.any_value(c).alias(c) for c in picked.columns if c != "doc_id"]
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *more)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled documents (doc_id, text, label) of the training fold.

    Labels come one per doc_id (repeated rows: the larger label; nulls are left out). The documents are those
    whose ids come first by hash, so the choice does not depend on partitions. Only the ids and labels, at most
    ``bound`` rows of 12 bytes, are broadcast.
    """
    one = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return one_text_each(docs, one.orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(bound))
