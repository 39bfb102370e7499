"""The price stream: events as observations, deduplicated, windowed and folded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a stream; its times are cast, since watermarks need time zones."""
    raw = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("observed_at", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and mean value per event type and window, in batch or streaming."""
    at = F.window("observed_at", width, slide) if slide else F.window("observed_at", width)
    return events.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value")).select(F.col("w.start").alias("start"), "event_type", "n", "max_value")


def latest_per_offer(events: DataFrame) -> DataFrame:
    """Newest value per (user_id, event_type): an aggregation that a stream can keep as state; ties to the greater value."""
    newest = F.max_by(F.struct("observed_at", "value"), F.struct("observed_at", "value")).alias("m")
    return events.groupBy("user_id", "event_type").agg(newest).select("user_id", "event_type", "m.observed_at", "m.value")


def run_available(frame: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a streaming frame over what is there now and return the memory table."""
    writer = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def run_to_table(frame: DataFrame, path: str, checkpoint: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a streaming frame in append mode over what is there now, into Parquet at `path`, and read that; `settings` hold while it starts.

    With the same `checkpoint` a later call takes only what is new.
    """
    spark = frame.sparkSession
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def sessions(events: DataFrame, keys: Sequence[str] = ("user_id",), gap: str = "30 minutes", at: str = "observed_at") -> DataFrame:
    """(keys..., start, stop, n, max_value): stretches of events of a key that are less than `gap` apart, in batch or streaming.

    A session stops `gap` after its last event. On a stream with a watermark, late rows widen and
    merge the sessions that are still open, and rows later than the watermark are dropped.
    """
    session = F.session_window(at, gap).alias("w")
    return events.groupBy(*keys, session).agg(F.count("*").alias("n"), F.max("value").alias("max_value")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "max_value")
