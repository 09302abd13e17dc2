"""Queries that SQL can't twin: generators, samples, models and micro-batches. Tests hold their contracts."""

from __future__ import annotations

import uuid
from itertools import pairwise

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.models.ensemble import HybridDetector
from vigilframe.models.isolation import IsolationForest, threshold
from vigilframe.models.stages import HybridEstimator
from vigilframe.operators import sets
from vigilframe.operators.quantiles import percentiles
from vigilframe.operators.rules import rule_hits, session_metrics
from vigilframe.operators.scaling import Scaler
from vigilframe.plans.pipeline import Encoder, extract
from vigilframe.plans.reports import LIMITS, METRICS, SQL_RULES
from vigilframe.plans.twins import WU, over_events
from vigilframe.schema import FIXED_FEATURES
from vigilframe.session import materialize, shared_dir
from vigilframe.sources import read
from vigilframe.sources.events import from_events_unwindowed, read_events
from vigilframe.sources.synthetic import Generator
from vigilframe.streaming.keyed import user_features
from vigilframe.streaming.micro_batch import for_each_batch, score_batches, stream_logs, stream_raw

#: All defaults but the share of rows above a threshold.
DEFAULTS = {"inputCols": list(FIXED_FEATURES), "extraCol": "extra", "contamination": 0.1}
_fitted: dict[tuple[str, str], tuple[str, str]] = {}


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Encoder]:
    """The whole feature frame: fixed features, and extra ones for all values there are."""
    extracted = materialize(extract(read_events(spark, sf_dir), v6=False), "features")
    encoder = Encoder.fit(extracted)
    return materialize(encoder.transform(extracted), "encoded"), encoder


def m2_isolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = _features(spark, sf_dir)
    return IsolationForest.fit(f, FIXED_FEATURES, extra="extra").score(f, extra="extra").select("row_id", "anomaly_score")


def m3_batch_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = materialize(m2_isolation_scores(spark, sf_dir), "scores")
    return scores.select("row_id", (F.col("anomaly_score") > threshold(scores, "anomaly_score", 0.1)).alias("flagged"))


def _detector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Encoder, HybridDetector]:
    """The feature frame and a detector fitted on it as a stage of a Pipeline, saved and loaded.

    The queries of one session and table share the saved one.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        f, encoder = _features(spark, sf_dir)
        path = f"{shared_dir(spark)}/vigilframe/detector-{uuid.uuid4().hex}"
        Pipeline(stages=[HybridEstimator(**DEFAULTS)]).fit(f).write().overwrite().save(f"{path}/pipeline")
        encoder.save(f"{path}/encoder")
        _fitted[key] = path, f.written_to
    path, features = _fitted[key]
    model = PipelineModel.load(f"{path}/pipeline").stages[0]
    return spark.read.parquet(features), Encoder.load(spark, f"{path}/encoder"), model.detector


def m8_hybrid_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, detector = _detector(spark, sf_dir)
    return detector.predict(f).select("row_id", "anomaly_score", "is_anomaly_predicted")


def m9_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, encoder, detector = _detector(spark, sf_dir)
    found = detector.explain(encoder.names)
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(found.items(), 1)], "rank int, feature string, importance double")


def t6_first_anomalies_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three predicted anomalies, each with the five features of most importance and their values."""
    f, encoder, detector = _detector(spark, sf_dir)
    top = sorted(detector.importances().items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    names = encoder.names([n for n, _ in top])
    first = detector.predict(f).where("is_anomaly_predicted = 1").orderBy("row_id").limit(3)
    value = lambda n: F.col(f"`{FIXED_FEATURES[n]}`") if n < Encoder.FIRST else F.coalesce(F.get(F.filter("extra", lambda x: x["i"] == n), F.lit(0))["v"], F.lit(0.0))
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(names[n]).alias("feature"), F.lit(w).alias("importance"), value(n).alias("value")) for i, (n, w) in enumerate(top, 1)])
    return first.select("row_id", "user_id", F.inline(listed))


def f24_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(session_metrics(read_events(spark, sf_dir)), LIMITS).select("session_id", F.array_join("reasons", "; ").alias("reasons"))


def t9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sample_rows(read_events(spark, sf_dir), 100).select("row_id", "user_id")


def x3_scaled_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaler fitted on the table, applied to its files as a stream."""
    at = f"{shared_dir(spark)}/vigilframe-stream-{uuid.uuid4().hex}"
    scaler = Scaler.fit(read_events(spark, sf_dir), ["session_duration_seconds"])
    query = score_batches(stream_raw(spark, sf_dir), scaler, f"{at}/out", f"{at}/state")
    query.awaitTermination()
    return spark.read.schema("row_id bigint, session_duration_seconds_scaled double").parquet(f"{at}/out").select("row_id", F.round("session_duration_seconds_scaled", 6).alias("scaled"))


def _write_logs(events: DataFrame, folder: str, records: int = 1000) -> None:
    """Events as audit logs: JSON files of one object each, whose Records array has so many events."""
    failed = F.when(F.col("status") == "failure", F.lit("AccessDenied"))
    record = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"), F.col("action").alias("eventName"), F.col("region").alias("awsRegion"), F.col("ip_address").alias("sourceIPAddress"),
        F.col("user_agent").alias("userAgent"), F.col("session_id").alias("requestID"), failed.alias("errorCode"), F.struct(F.col("user_id").alias("userName")).alias("userIdentity"), F.array(F.struct(F.col("resource").alias("resourceName"))).alias("resources"),
    )
    files = events.groupBy(F.floor(F.col("row_id") / records).alias("file")).agg(F.collect_list(record).alias("Records"))
    files.write.partitionBy("file").json(folder)


def records_of_a_log(rows: int) -> int:
    """A large table makes larger logs up to 20,000 records, and more of them only beyond that: every batch and file costs the driver some time."""
    return min(20_000, max(1000, rows // 100))


def _log_columns(events: DataFrame) -> DataFrame:
    return events.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "user_id", "action", "resource", "ip_address", "region", "status", "session_id", "user_agent")


def x1_logs_in_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON log files, read back as a stream of some files at a time."""
    at, events = f"{shared_dir(spark)}/vigilframe-logs-{uuid.uuid4().hex}", read_events(spark, sf_dir)
    _write_logs(events, f"{at}/logs", records_of_a_log(events.count()))
    logs = stream_logs(spark, "aws", f"{at}/logs/file=*", files_per_batch=25)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
    for_each_batch(logs, f"{at}/state", keep, adapt=lambda batch: batch).awaitTermination()
    return _log_columns(spark.read.schema(logs.schema).parquet(f"{at}/out"))


def s2_large_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON log files of some megabytes, each read by several tasks."""
    at = f"{shared_dir(spark)}/vigilframe-large-logs-{uuid.uuid4().hex}"
    _write_logs(read_events(spark, sf_dir), f"{at}/logs", records=20_000)
    return _log_columns(read(spark, "aws", f"{at}/logs/file=*", block=1 << 20))


def write_slices(raw: DataFrame, folder: str, slices: int = 4) -> None:
    """The raw events in files of equal size, one after the other in the order of time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = percentiles(raw.select(micros.alias("t")), "t", [k / slices for k in range(1, slices)])
    for low, high in pairwise([None, *cuts, None]):
        part = raw if low is None else raw.where(micros > low)
        (part if high is None else part.where(micros <= high)).coalesce(1).write.mode("append").parquet(folder)


def x1_user_features_on_the_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, trailing minutes and counts of users, carried from file to file as keyed state."""
    at = f"{shared_dir(spark)}/vigilframe-keyed-{uuid.uuid4().hex}"
    write_slices(spark.read.parquet(f"{sf_dir}/events.parquet"), f"{at}/events")
    found = user_features(from_events_unwindowed(stream_raw(spark, f"{at}/events", "*.parquet")), minute=3600.0)
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out").withColumn("time_since_last_access", F.round("time_since_last_access", 6))


QUERIES = {
    "x1_user_features_on_the_stream": x1_user_features_on_the_stream,
    "x1_logs_in_micro_batches": x1_logs_in_micro_batches,
    "s2_large_log_files": s2_large_log_files,
    "s7_synthetic_reader": lambda spark, sf_dir: read(spark, "synthetic", n=1000),
    "s8_privileged_generator": lambda spark, sf_dir: Generator().privileged(spark, 1000),
    "s11_normal_log": lambda spark, sf_dir: Generator().normal_log(spark, 1000),
    "s12_injected_anomalies": lambda spark, sf_dir: Generator().inject_anomalies(Generator().normal_log(spark, 1000), 0.1),
    "s13_dataset": lambda spark, sf_dir: Generator().dataset(spark, 1000, 0.1),
    "s19_fixture": lambda spark, sf_dir: Generator().fixture(spark),
    "t9_sample": t9_sample,
    "f24_reasons": f24_reasons,
    "m2_isolation_scores": m2_isolation_scores,
    "m3_batch_threshold": m3_batch_threshold,
    "m8_hybrid_votes": m8_hybrid_votes,
    "m9_importances": m9_importances,
    "t6_first_anomalies_features": t6_first_anomalies_features,
    "x3_scaled_micro_batches": x3_scaled_micro_batches,
}
SQL_REASONS = {
    "hours": "'outside working hours: ' || strftime(start_time, '%H:%M')", "duration": "format('long session: {{:.1f}} minutes', duration)", "actions": "'many actions: ' || n_actions",
    "ips": "'many addresses: ' || n_unique_ips", "failures": "format('failure rate: {{:.1f}}%', failure_rate * 100)",
}
SQL_LOGS = "SELECT strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS at, user_id, action, resource, ip_address, region, status, session_id, user_agent FROM ev"
ORACLES = {
    "f24_reasons": over_events(
        "SELECT session_id, reasons FROM (SELECT session_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {c.format(t=LIMITS)} THEN {SQL_REASONS[code].replace('{{', '{').replace('}}', '}')} END" for code, c in SQL_RULES.items()) + ") AS reasons FROM m) WHERE reasons <> ''",
        METRICS,
    ),
    "x1_logs_in_micro_batches": over_events(SQL_LOGS),
    "s2_large_log_files": over_events(SQL_LOGS),
    "x1_user_features_on_the_stream": over_events(f"""SELECT row_id, user_id, round(coalesce(date_diff('microsecond', lag("timestamp") OVER ({WU}), "timestamp") / 1e6, 0), 6) AS time_since_last_access,
        count(*) OVER (PARTITION BY user_id ORDER BY "timestamp" RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY user_id, "timestamp") - row_number() OVER (PARTITION BY user_id, "timestamp" ORDER BY row_id)) AS actions_per_minute,
        count(*) FILTER (status = 'success') OVER r AS success_count, count(*) FILTER (status = 'failure') OVER r AS failure_count FROM ev WINDOW r AS ({WU} ROWS UNBOUNDED PRECEDING)"""),
    # The stream must equal the batch once it is through.
    "x3_scaled_micro_batches": "SELECT event_id AS row_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0 AS scaled FROM events",
}
