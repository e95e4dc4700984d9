"""Stream and publication queries: they run to the end of their input and return what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.plans import publish
from graindeck.queries import query
from graindeck.schema import table
from graindeck.session import new_folder
from graindeck.streaming import queue


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream: its folder, or the folder of its file with the file's name as a filter."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option(
        "pathGlobFilter", "*events*"
    ).parquet(d) if not _is_folder(spark, f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(
    "with t as (select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events "
    "group by 1, 2) select * from t where window_start + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)"
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows with a watermark: those that the watermark has passed are final."""
    at = new_folder(spark)
    out = queue.windowed_counts(_events(spark, d), "ts", "event_type", "value")
    queue.run_to_end(out, f"{at}/out", f"{at}/state")
    return spark.read.schema("window_start timestamp, event_type string, n bigint, mean_value double").parquet(f"{at}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value")
    )


@query(
    "with r as (select event_type, event_id, user_id, row_number() over (partition by event_type order by event_id) - 1 as i from events) select "
    "event_type, event_id, user_id, least(i, 32) as queue_size, case when i = 0 then null when i <= 32 then first_value(user_id) over w else lag(user_id, "
    "32) over w end as oldest from r window w as (partition by event_type order by event_id)"
)
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """ST1: a queue of 32 for each event type as stream state."""
    at = new_folder(spark)
    out = queue.queue_stream(_events(spark, d).select("event_type", "event_id", "user_id"), "event_type", "event_id", "user_id", 32)
    queue.run_to_end(out, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


@query("select count(*) as n, count(distinct user_id) as users, 'reused' as again from events")
def publish_once(spark: SparkSession, d: str) -> DataFrame:
    """SK3, SK5: publish a table, publish it again as a no-op, and read it."""
    at = f"{new_folder(spark)}/published"
    df = table(spark, d, "events").select("event_id", "user_id", "event_type")
    publish.publish_immutable(df, at)
    again = publish.publish_immutable(df, at)
    return spark.read.parquet(f"{at}/data").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.lit(again).alias("again"))
