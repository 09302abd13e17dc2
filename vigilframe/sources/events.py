"""The `events` table as canonical privileged-access events, by fixed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESOURCES = ("bucket", "database", "console", "queue", "keystore")
REGIONS = ("eu-north", "eu-south", "us-east", "ap-east")
AGENTS = ("Mozilla/5.0 (Windows NT) Chrome/120", "Mozilla/5.0 (Macintosh) Safari/605", "Mozilla/5.0 (X11; Linux) Firefox/119")
ROLES = ("admin", "analyst", "developer", "operator", "auditor")
ACCOUNTS = 10
VAULTS = 7


def _pick(options: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), at.cast("int"))


def from_events_unwindowed(events: DataFrame) -> DataFrame:
    """row_id, the canonical columns but for the session's times, role and the privileged columns: what a stream can have too."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    e = events.select(F.col("event_id").alias("row_id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("uid"), F.col("event_type").alias("action"), "value", k.alias("k"))
    user = F.concat(F.lit("user_"), F.col("uid").cast("string"))
    return e.select(
        "row_id", "timestamp", user.alias("user_id"), "action",
        _pick(RESOURCES, F.col("k") % 5).alias("resource"),
        F.concat(F.when(F.col("k") % 4 == 0, "203.0.").otherwise("192.168."), (F.col("k") + 21).cast("string"), F.lit("."), (F.col("uid") % 254).cast("string")).alias("ip_address"),
        _pick(REGIONS, (F.col("uid") + F.col("k")) % 4).alias("region"),
        F.when(F.col("action") == "error", "failure").otherwise("success").alias("status"),
        F.concat(user, F.lit("_"), F.date_format("timestamp", "yyyyMMdd")).alias("session_id"),
        _pick(AGENTS, F.col("k") % 3).alias("user_agent"),
        _pick(ROLES, F.col("uid") % 5).alias("role"),
        (F.col("k") % 2 == 0).alias("is_privileged_session"),
        F.col("value").cast("double").alias("session_duration_seconds"),
        (F.col("k") % 10 == 0).alias("policy_violation"),
        F.concat(F.lit("acct_"), (F.col("k") % ACCOUNTS).cast("string")).alias("privileged_account_used"),
        F.concat(F.lit("vault_"), (F.col("k") % VAULTS).cast("string")).alias("vault_name"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("T"), F.col("row_id").cast("string"))).alias("ticket_id"),
        F.when(F.col("k") % 7 != 0, F.lit("maintenance")).alias("reason_for_access"),
    )


def from_events(events: DataFrame) -> DataFrame:
    """row_id, the canonical columns, role and the privileged columns."""
    e, session = from_events_unwindowed(events), Window.partitionBy("session_id")
    return e.withColumns({"session_start": F.min("timestamp").over(session), "session_end": F.max("timestamp").over(session)})


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
