"""SparkSession factory."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, ANSI casts, adaptive plans, Arrow batches."""
    builder = SparkSession.builder.master(master).appName("graindeck")
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own that the driver and all executors can reach: below the session's ``spark.checkpoint.dir``, or,
    where all runs on one machine, below the warehouse. On a cluster without the former it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/queries/{uuid.uuid4().hex}"
