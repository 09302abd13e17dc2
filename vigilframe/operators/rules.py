"""Session rules: thresholds over one aggregate per session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import scalars


@dataclass(frozen=True)
class Thresholds:
    """A session is flagged strictly above each; working hours include both ends."""

    start_s: int = 9 * 3600
    end_s: int = 17 * 3600
    duration_min: float = 180.0
    actions: int = 20
    ips: int = 5
    failure_rate: float = 0.2


def session_metrics(df: DataFrame) -> DataFrame:
    """One row per session from one aggregate."""
    order = F.struct("timestamp", "row_id")
    first = F.min_by(F.struct("user_id", "timestamp", "session_start", "session_end"), order)
    out = df.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        first.alias("first"), F.count(F.lit(1)).alias("n_actions"), F.countDistinct("ip_address").alias("n_unique_ips"),
        F.avg((F.col("status") == "failure").cast("double")).alias("failure_rate"),
    )
    duration = F.timestamp_diff("MICROSECOND", F.col("first.session_start"), F.col("first.session_end")) / 6e7
    return out.select("session_id", F.col("first.user_id").alias("user_id"), F.col("first.timestamp").alias("start_time"), duration.alias("duration"), "n_actions", "n_unique_ips", "failure_rate")


def rules(t: Thresholds) -> dict[str, tuple[Column, Column]]:
    """{code: (broken, reason)} in the order in which reasons are listed."""
    return {
        "hours": (~scalars.within_hours(F.col("start_time"), t.start_s, t.end_s), F.concat(F.lit("outside working hours: "), F.date_format("start_time", "HH:mm"))),
        "duration": (F.col("duration") > t.duration_min, F.format_string("long session: %.1f minutes", F.col("duration"))),
        "actions": (F.col("n_actions") > t.actions, F.format_string("many actions: %d", F.col("n_actions"))),
        "ips": (F.col("n_unique_ips") > t.ips, F.format_string("many addresses: %d", F.col("n_unique_ips"))),
        "failures": (F.col("failure_rate") > t.failure_rate, F.format_string("failure rate: %.1f%%", F.col("failure_rate") * 100)),
    }


def rule_hits(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Sessions that break a rule, with codes and reasons in rule order."""
    listed = {"codes": [F.when(c, code) for code, (c, _) in rules(t).items()], "reasons": [F.when(c, r) for c, r in rules(t).values()]}
    out = metrics.withColumns({n: F.filter(F.array(*cs), lambda x: x.isNotNull()) for n, cs in listed.items()})
    return out.where(F.size("codes") > 0)
