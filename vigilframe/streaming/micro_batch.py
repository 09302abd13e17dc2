"""Event files as a stream, and per-batch work with what was fitted before.

An extension of the chunked readers: a file source read in micro-batches replaces the generator
of chunks. Watermarks need TIMESTAMP, so stored times without a zone are cast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilframe.operators.scaling import Scaler
from vigilframe.operators.sets import clean, standardize
from vigilframe.sources.cloud import FORMATS, json_schema, records_of
from vigilframe.sources.events import from_events

RAW = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_raw(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """The event files of a folder as they arrive."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def stream_logs(spark: SparkSession, source: str, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Canonical events of a folder of JSON logs as files arrive, for the sources in cloud.FORMATS."""
    record, parse = FORMATS[source.lower()]
    raw = spark.readStream.schema(json_schema(record)).option("maxFilesPerTrigger", files_per_batch).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    return clean(standardize(parse(records_of(raw))))


def windowed_counts(raw: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events, failures and users by window and type; windows close once the watermark passes them."""
    e = raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id").alias("users"))


def for_each_batch(raw: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], progress: Callable[[int], None] | None = None, adapt: Callable[[DataFrame], DataFrame] = from_events) -> StreamingQuery:
    """Runs work on every micro-batch of canonical events and ends when all files are read.

    adapt makes events of a batch; the logs of stream_logs are events already.
    """

    def run(batch: DataFrame, number: int) -> None:
        work(adapt(batch), number)
        if progress:
            progress(number)

    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_batches(raw: DataFrame, scaler: Scaler, out: str, checkpoint: str) -> StreamingQuery:
    """Scales each batch with parameters fitted once; a batch that is repeated overwrites its own folder."""

    def work(events: DataFrame, number: int) -> None:
        scaled = scaler.transform(events, "_scaled")
        scaled.select("row_id", *[f"{c}_scaled" for c in scaler.mean]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return for_each_batch(raw, checkpoint, work)
