"""Result sets behind reports: counts by hour and user, quality of predictions, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.scalars import ratio
from vigilframe.operators.windows import running_distinct


def hours(df: DataFrame, name: str = "n") -> DataFrame:
    return df.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias(name))


def hours_dense(df: DataFrame, name: str = "n") -> DataFrame:
    """All of 0 to 23, 0 where nothing happened."""
    every = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return every.join(hours(df, name), "hour", "left").select("hour", F.coalesce(name, F.lit(0)).alias(name))


def top_users(df: DataFrame, n: int) -> DataFrame:
    """Most rows first, ties by user."""
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(n)


def detection_quality(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: precision, recall, f1 and accuracy; 0 where a share has no base."""
    hit = lambda a, b: F.sum((a & b).cast("long"))
    counts = df.agg(hit(predicted, label).alias("tp"), hit(predicted, ~label).alias("fp"), hit(~predicted, label).alias("fn"), F.avg((predicted == label).cast("double")).alias("accuracy"))
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) over equal widths from the least to the greatest value; bins count from 1, empty ones are left out."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins) + 1
    rows = df.where(F.col(column).isNotNull()).join(F.broadcast(ends))
    return rows.groupBy(F.least(F.coalesce(at, F.lit(1)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, anomalous: Column, cost: float = 5000.0) -> DataFrame:
    n = F.sum(anomalous.cast("long"))
    return df.agg(F.count(F.lit(1)).alias("events"), n.alias("anomalies"), (n * F.lit(cost)).alias("estimated_cost"))


def in_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    return df.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def outside_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    return df.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def cumulative_ips(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, row_id, timestamp, cumulative_ips) of the given sessions."""
    return running_distinct(in_sessions(df, sessions), "cumulative_ips", "session_id", "ip_address").select("session_id", "row_id", "timestamp", "cumulative_ips")


def profile(df: DataFrame, anomalous: Column) -> DataFrame:
    """One row that sets anomalous sessions against the others: duration, actions and addresses per session."""
    sessions = df.groupBy("session_id").agg(
        F.max(anomalous.cast("int")).alias("odd"), F.count(F.lit(1)).alias("n"), F.countDistinct("ip_address").alias("ips"),
        (F.timestamp_diff("MICROSECOND", F.min("timestamp"), F.max("timestamp")) / 6e7).alias("minutes"),
    )
    when = lambda odd, x: F.avg(F.when(F.col("odd") == odd, F.col(x)))
    shares = sessions.agg(*[when(k, c).alias(f"{label}_{c}") for label, k in (("anomalous", 1), ("baseline", 0)) for c in ("minutes", "n", "ips")])
    base = df.where(~anomalous).agg((F.countDistinct("ip_address") / F.countDistinct("session_id")).alias("baseline_ips_per_session"))
    return shares.join(F.broadcast(base))
