"""Cloud audit logs as canonical events.

A file is an object with a `Records` array or a bare array. Multi-line JSON is one task a file,
which suits many files of moderate size; given a block size, large files are read by several
tasks each (blocks.py). Null nested objects keep their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions.scalars import first_truthy, last_token
from vigilframe.operators.sets import clean, standardize
from vigilframe.schema import EVENT
from vigilframe.sources import blocks

TRAIL_RECORD = """struct<eventTime string, eventName string, eventSource string, awsRegion string, sourceIPAddress string, userAgent string,
 requestID string, errorCode string, errorMessage string,
 userIdentity struct<type string, userName string, principalId string, arn string, accountId string, sessionContext struct<sessionIssuer struct<userName string>>>,
 resources array<struct<resourceName string, ARN string, accountId string>>>"""
ACTIVITY_RECORD = """struct<time string, resourceId string, category string, operationName string, resultType string, resultSignature string,
 durationMs bigint, callerIpAddress string, correlationId string, identity struct<claims struct<oid string, name string>, principalId string>>"""


def _time(text: Column) -> Column:
    return text.try_cast("timestamp")


def parse_trail(records: DataFrame) -> DataFrame:
    """Rows of TRAIL_RECORD's fields as events."""
    who = F.col("userIdentity")
    failed = first_truthy(F.col("errorCode"), F.col("errorMessage")).isNotNull()
    return records.select(
        _time(F.col("eventTime")).alias("timestamp"),
        first_truthy(who["userName"], who["principalId"], who["sessionContext"]["sessionIssuer"]["userName"], who["arn"]).alias("user_id"),
        F.col("eventName").alias("action"), F.get("resources", F.lit(0))["resourceName"].alias("resource"),
        F.col("sourceIPAddress").alias("ip_address"), F.col("awsRegion").alias("region"), F.when(failed, "failure").otherwise("success").alias("status"),
        F.col("requestID").alias("session_id"), _time(F.col("eventTime")).alias("session_start"), _time(F.col("eventTime")).alias("session_end"), F.col("userAgent").alias("user_agent"),
    )


def parse_activity(records: DataFrame) -> DataFrame:
    """Rows of ACTIVITY_RECORD's fields as events; region and agent are not part of it."""
    claims = F.col("identity")["claims"]
    return records.select(
        _time(F.col("time")).alias("timestamp"), first_truthy(claims["oid"], claims["name"]).alias("user_id"),
        last_token(F.col("operationName")).alias("action"), last_token(F.col("resourceId")).alias("resource"), F.col("callerIpAddress").alias("ip_address"),
        F.lit(None).cast("string").alias("region"), F.when(F.lower("resultType") == "success", "success").otherwise("failure").alias("status"),
        F.col("correlationId").alias("session_id"), _time(F.col("time")).alias("session_start"), _time(F.col("time")).alias("session_end"), F.lit(None).cast("string").alias("user_agent"),
    )


def no_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in EVENT.items()))


def json_schema(record: str) -> str:
    """What a file of records reads as: wrapped in an object, or bare."""
    return f"Records array<{record}>, {record[record.index('<') + 1 : -1]}, _corrupt_record string"


def records_of(raw: DataFrame) -> DataFrame:
    """One row per record of files read by json_schema; text that doesn't parse gives none."""
    wrapped = raw.where("Records is not null").select(F.explode("Records").alias("r")).select("r.*")
    fields = wrapped.columns
    bare = raw.where("Records is null and _corrupt_record is null").select(*fields)
    return wrapped.unionByName(bare.where(~F.forall(F.array(*[F.col(c).isNull() for c in fields]), lambda absent: absent)))


def read_json(spark: SparkSession, path: str, record: str, parse: Callable[[DataFrame], DataFrame], block: int | None = None) -> DataFrame:
    """Cleaned events of a file or folder; no rows if it is missing. Records that don't parse are skipped.

    With a block size in bytes, large uncompressed files are cut at record borders and each record
    is judged alone: a file that breaks off keeps the records before.
    """
    try:
        if block:
            return clean(standardize(parse(blocks.parsed(blocks.record_texts(spark, path, block), record))))
        raw = spark.read.schema(json_schema(record)).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_events(spark)
    return clean(standardize(parse(records_of(raw))))


#: Record schema and parser by source, for whole reads and for micro-batches.
FORMATS = {"aws": (TRAIL_RECORD, parse_trail), "azure": (ACTIVITY_RECORD, parse_activity)}


def read_trail(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    return read_json(spark, path, *FORMATS["aws"], block)


def read_activity(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    return read_json(spark, path, *FORMATS["azure"], block)
