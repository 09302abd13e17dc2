"""Queries of the feature extractors and their SQL twins, over the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import network, scalars
from vigilframe.operators import features as X
from vigilframe.operators import windows
from vigilframe.functions.scalars import numeric
from vigilframe.plans.pipeline import CATEGORIES, PIVOTS, extract
from vigilframe.plans.twins import WS, WU, over_events
from vigilframe.schema import FIXED_FEATURES
from vigilframe.sources.events import read_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = 86400.0


def rounded(df: DataFrame, *columns: str, key: str = "row_id", digits: int = 6) -> DataFrame:
    """The key and the columns: doubles rounded, whole numbers as long."""
    kinds = dict(df.dtypes)
    cast = {"int": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(c, digits) + 0.0}  # no negative zero
    return df.select(key, *[cast.get(kinds[c], F.col)(c).alias(c) for c in columns])


def query(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(read_events(spark, sf_dir))
    ORACLES[name] = sql


query(
    "adapter_events",
    lambda e: e.select("row_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "user_id", "action", "resource", "ip_address", "region", "status", "session_id", "user_agent", "role", "privileged_account_used", "vault_name", "ticket_id", "reason_for_access"),
    over_events("SELECT row_id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS at, user_id, action, resource, ip_address, region, status, session_id, user_agent, role, privileged_account_used, vault_name, ticket_id, reason_for_access FROM ev"),
)
query(
    "f1_f4_time_parts",
    lambda e: rounded(X.time_features(e).withColumn("minute", F.minute("timestamp")), "hour", "minute", "day_of_week", "is_weekend", "is_working_hour"),
    over_events("""SELECT row_id, hour("timestamp") AS hour, minute("timestamp") AS minute, isodow("timestamp") - 1 AS day_of_week,
        (isodow("timestamp") >= 6)::BIGINT AS is_weekend, (hour("timestamp") BETWEEN 9 AND 17)::BIGINT AS is_working_hour FROM ev"""),
)
query(
    "f5_cyclic_hour",
    lambda e: rounded(X.time_features(e), "hour_sin", "hour_cos"),
    over_events('SELECT row_id, round(sin(2 * pi() * hour("timestamp") / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour("timestamp") / 24), 6) + 0 AS hour_cos FROM ev'),
)
query(
    "f6_session_duration",
    lambda e: rounded(X.time_features(e), "session_duration"),
    over_events("SELECT row_id, round(date_diff('microsecond', session_start, session_end) / 1e6, 6) AS session_duration FROM ev"),
)
query(
    "f7_day_parts",
    lambda e: rounded(X.temporal_features(e), "is_early_morning", "is_morning", "is_afternoon", "is_evening"),
    over_events("""SELECT row_id, (hour("timestamp") < 6)::BIGINT AS is_early_morning, (hour("timestamp") BETWEEN 6 AND 11)::BIGINT AS is_morning,
        (hour("timestamp") BETWEEN 12 AND 17)::BIGINT AS is_afternoon, (hour("timestamp") >= 18)::BIGINT AS is_evening FROM ev"""),
)
query(
    "f8_private_ip",
    lambda e: rounded(e.withColumn("is_private_ip", network.is_private_ip(F.col("ip_address"), v6=False)), "is_private_ip"),
    over_events("SELECT row_id, (ip_address LIKE '192.168.%' OR ip_address LIKE '203.0.113.%')::BIGINT AS is_private_ip FROM ev"),
)
NETS = ("fd00::{}", "2001:db8::{}", "2a00:1450:4001::{}", "fe80::1:{}", "::ffff:8.8.{}.1", "2001:4:112::{}", "not:an:address:{}")
query(
    "f8_private_ip_v6",
    lambda e: rounded(
        e.withColumn("ip", F.element_at(F.array(*[F.format_string(n.replace("{}", "%d"), F.pmod("row_id", F.lit(200))) for n in NETS]), (F.pmod("row_id", F.lit(len(NETS))) + 1).cast("int")))
        .withColumn("is_private_ip", network.is_private_ip(F.col("ip"))),
        "is_private_ip",
    ),
    over_events(f"SELECT row_id, (row_id % {len(NETS)} IN (0, 1, 3, 4))::BIGINT AS is_private_ip FROM ev"),
)
query(
    "f9_f10_agent_parts",
    lambda e: e.select("row_id", scalars.operating_system(F.col("user_agent")).alias("os"), scalars.browser(F.col("user_agent")).alias("browser")),
    over_events("""SELECT row_id, CASE WHEN contains(user_agent, 'Windows') THEN 'Windows' WHEN contains(user_agent, 'Macintosh') THEN 'Mac' WHEN contains(user_agent, 'Linux') THEN 'Linux' ELSE 'OtherOS' END AS os,
        CASE WHEN contains(user_agent, 'Chrome') THEN 'Chrome' WHEN contains(user_agent, 'Firefox') THEN 'Firefox' WHEN contains(user_agent, 'Safari') THEN 'Safari' ELSE 'OtherBrowser' END AS browser FROM ev"""),
)
query(
    "f11_pair_text",
    lambda e: e.select("row_id", F.concat_ws("_", "action", "resource").alias("pair")),
    over_events("SELECT row_id, action || '_' || resource AS pair FROM ev"),
)
query(
    "f12_f16_text_and_nested",
    lambda e: e.select("row_id", F.struct(F.concat(F.lit("/org/"), "region", F.lit("/"), "resource").alias("path"), F.array("ip_address", "region").alias("list"), F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("user_id")).alias("name"), F.col("role")).alias("d"))
    .select("row_id", scalars.last_token(F.col("d.path")).alias("last"), F.lower("d.role").alias("low"), scalars.first_truthy(F.col("d.name"), F.col("d.role")).alias("who"), F.get("d.list", F.lit(0)).alias("first"), F.get("d.list", F.lit(9)).alias("absent")),
    over_events("SELECT row_id, resource AS last, lower(role) AS low, CASE WHEN row_id % 3 = 0 THEN role ELSE user_id END AS who, ip_address AS first, NULL::VARCHAR AS absent FROM ev"),
)
query(
    "f17_lenient_times",
    lambda e: e.select("row_id", F.when(F.col("row_id") % 5 == 0, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("text")).select("row_id", F.date_format(F.col("text").try_cast("timestamp"), "yyyyMMddHHmmss").alias("parsed")),
    over_events("SELECT row_id, CASE WHEN row_id % 5 <> 0 THEN strftime(\"timestamp\", '%Y%m%d%H%M%S') END AS parsed FROM ev"),
)
query(
    "f18_f19_arithmetic",
    lambda e: rounded(
        e.withColumns({"abs_value": F.abs(F.col("session_duration_seconds") - 50), "log_value": F.log2(F.abs("session_duration_seconds") + 1), "squared": F.pow("session_duration_seconds", F.lit(2.0)), "inverse": F.coalesce(F.lit(1.0) / F.nullif(F.floor("session_duration_seconds").cast("double"), F.lit(0.0)), F.lit(1.0)), "finite": scalars.finite(F.when(F.col("row_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("session_duration_seconds")))}),
        "abs_value", "log_value", "squared", "inverse", "finite", digits=4,
    ),
    over_events("""SELECT row_id, round(abs(session_duration_seconds - 50), 4) AS abs_value, round(log2(abs(session_duration_seconds) + 1), 4) AS log_value, round(pow(session_duration_seconds, 2), 4) AS squared,
        round(coalesce(1.0::DOUBLE / nullif(floor(session_duration_seconds), 0), 1.0), 4) AS inverse, CASE WHEN row_id % 7 <> 0 THEN round(session_duration_seconds, 4) END AS finite FROM ev"""),
)
query(
    "f20_one_hot",
    lambda e: rounded(X.one_hot(e.select("row_id", "role"), "role", ["admin", "analyst", "auditor", "developer", "operator"]), "role_admin", "role_analyst", "role_auditor", "role_developer", "role_operator"),
    over_events("SELECT row_id, " + ", ".join(f"(role = '{r}')::DOUBLE AS role_{r}" for r in ("admin", "analyst", "auditor", "developer", "operator")) + " FROM ev"),
)
query(
    "f22_missing_flags",
    lambda e: rounded(X.privileged_features(e), "missing_reason", "missing_ticket"),
    over_events("SELECT row_id, (is_privileged_session AND reason_for_access IS NULL)::BIGINT AS missing_reason, (is_privileged_session AND ticket_id IS NULL)::BIGINT AS missing_ticket FROM ev"),
)
query(
    "f23_working_hours_exact",
    lambda e: e.select("row_id", scalars.within_hours(F.col("timestamp"), 9 * 3600, 17 * 3600).cast("long").alias("inside")),
    over_events("SELECT row_id, (\"timestamp\"::TIME BETWEEN TIME '09:00:00' AND TIME '17:00:00')::BIGINT AS inside FROM ev"),
)
query(
    "w1_time_since_last_access",
    lambda e: rounded(X.time_features(e), "time_since_last_access"),
    over_events(f"SELECT row_id, round(coalesce(date_diff('microsecond', lag(\"timestamp\") OVER ({WU}), \"timestamp\") / 1e6, 0), 6) AS time_since_last_access FROM ev"),
)
for label, seconds in (("1min", 60.0), ("1h", 3600.0), ("1d", DAY)):
    frame = f'PARTITION BY user_id ORDER BY "timestamp" RANGE BETWEEN INTERVAL \'{seconds - 0.000001:.6f} seconds\' PRECEDING AND CURRENT ROW'
    query(
        f"w2_actions_{label}",
        lambda e, s=seconds: windows.trailing_count(e, "actions", "user_id", s).select("row_id", "actions"),
        over_events(f"SELECT row_id, count(*) OVER ({frame}) - (count(*) OVER (PARTITION BY user_id, \"timestamp\") - row_number() OVER (PARTITION BY user_id, \"timestamp\" ORDER BY row_id)) AS actions FROM ev"),
    )
    query(
        f"w3_w4_distinct_{label}",
        lambda e, s=seconds: windows.trailing_distinct(e, {"unique_actions": "action", "unique_resources": "resource"}, "user_id", s).select("row_id", "unique_actions", "unique_resources"),
        over_events(
            f"""SELECT a.row_id, count(DISTINCT b.action) AS unique_actions, count(DISTINCT b.resource) AS unique_resources
            FROM ev a JOIN ev b ON a.user_id = b.user_id AND b."timestamp" > a."timestamp" - INTERVAL '{seconds:.0f} seconds'
             AND (b."timestamp" < a."timestamp" OR b."timestamp" = a."timestamp" AND b.row_id <= a.row_id) GROUP BY a.row_id"""
        ),
    )
GAPS = f"gaps AS (SELECT *, coalesce(date_diff('microsecond', lag(\"timestamp\") OVER ({WS}), \"timestamp\") / 1e6, 0)::DOUBLE AS gap FROM ev)"
query(
    "w5_w6_session_gaps",
    lambda e: rounded(X.session_features(e), "time_between_actions_in_session", "average_time_between_actions_in_session"),
    over_events(f"SELECT row_id, round(gap, 6) AS time_between_actions_in_session, round(avg(gap) OVER ({WS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS average_time_between_actions_in_session FROM gaps", GAPS),
)
VELOCITY = "vel AS (SELECT *, coalesce(1.0::DOUBLE / nullif(gap, 0), 1.0::DOUBLE) AS v FROM gaps)"
SPREAD = f"spread AS (SELECT *, avg(v) OVER ({WU} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, coalesce(stddev_samp(v) OVER ({WU} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS s FROM vel)"
query(
    "w7_w8_velocity",
    lambda e: rounded(X.velocity_features(X.session_features(e)), "action_velocity", "velocity_mean", "velocity_std"),
    over_events("SELECT row_id, round(v, 6) AS action_velocity, round(m, 6) AS velocity_mean, round(s, 6) AS velocity_std FROM spread", GAPS, VELOCITY, SPREAD),
)
for label, k in (("default", 2.0), ("1_5_sigma", 1.5)):
    query(
        f"w9_burst_{label}",
        lambda e, k=k: rounded(X.velocity_features(X.session_features(e), sigmas=k), "is_burst"),
        over_events(f"SELECT row_id, (v > m + {k} * s AND s > 0)::BIGINT AS is_burst FROM spread", GAPS, VELOCITY, SPREAD),
    )
query(
    "w10_session_hours",
    lambda e: rounded(X.temporal_features(e), "session_start_hour", "session_end_hour", "session_hour_span"),
    over_events(f"""SELECT row_id, first_value(hour("timestamp")) OVER w AS session_start_hour, last_value(hour("timestamp")) OVER w AS session_end_hour,
        last_value(hour("timestamp")) OVER w - first_value(hour("timestamp")) OVER w AS session_hour_span FROM ev
        WINDOW w AS ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
)
query(
    "w11_running_distinct_ips",
    lambda e: windows.running_distinct(e, "ips_so_far", "session_id", "ip_address").select("row_id", "ips_so_far"),
    over_events(f"SELECT row_id, count(DISTINCT ip_address) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ips_so_far FROM ev"),
)
query(
    "w12_group_broadcast",
    lambda e: rounded(X.session_features(X.status_features(e)), "success_count", "failure_count", "actions_per_session"),
    over_events("SELECT row_id, count(*) FILTER (status = 'success') OVER u AS success_count, count(*) FILTER (status = 'failure') OVER u AS failure_count, count(*) OVER (PARTITION BY session_id) AS actions_per_session FROM ev WINDOW u AS (PARTITION BY user_id)"),
)
query(
    "w13_sequences",
    lambda e: windows.sequences(X.time_features(e), ["hour", "day_of_week"], 4).where("sequence is not null").select("row_id", F.round(F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("sequence").cast("long").alias("steps")),
    over_events(f"""SELECT row_id, total::DOUBLE AS total, steps FROM (SELECT row_id, sum(hour("timestamp") + isodow("timestamp") - 1) OVER w AS total, count(*) OVER w AS steps FROM ev
        WINDOW w AS ({WU} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE steps = 4"""),
)
query(
    "w13_global_sequences",
    lambda e: windows.sequences(X.time_features(e), ["hour", "day_of_week", "time_since_last_access"], 10, key=None).where("sequence is not null").select("row_id", F.size("sequence").cast("long").alias("steps"), F.round(F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.get("sequence", F.lit(0))[0].alias("first_hour")),
    over_events("""SELECT row_id, n AS steps, round(total, 3) AS total, h::DOUBLE AS first_hour
        FROM (SELECT row_id, count(*) OVER w AS n, (sum(hour("timestamp") + isodow("timestamp") - 1 + gap) OVER w)::DOUBLE AS total, first_value(hour("timestamp")) OVER w AS h FROM since
        WINDOW w AS (ORDER BY "timestamp", row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10""",
        f"since AS (SELECT *, coalesce(date_diff('microsecond', lag(\"timestamp\") OVER ({WU}), \"timestamp\") / 1e6, 0) AS gap FROM ev)"),
)
query(
    "a1_value_frequency",
    lambda e: rounded(X.agent_features(X.region_features(X.ip_features(e, v6=False), e), e), "ip_frequency", "region_frequency", "user_agent_frequency"),
    over_events("SELECT row_id, count(*) OVER (PARTITION BY ip_address) AS ip_frequency, count(*) OVER (PARTITION BY region) AS region_frequency, count(*) OVER (PARTITION BY user_agent) AS user_agent_frequency FROM ev"),
)


def _pivot(name: str, column: str, values: list[str], pattern: str) -> None:
    query(
        name,
        lambda e: X.count_pivot(e, "user_id", column, values, pattern),
        over_events("SELECT user_id, " + ", ".join(f"count(*) FILTER ({column} = '{v}') AS \"{pattern.format(v)}\"" for v in values) + " FROM ev GROUP BY user_id"),
    )


_pivot("a2_action_pivot", "action", ["click", "error", "purchase", "signup", "view"], "action_{}_count")
_pivot("a3_resource_pivot", "resource", ["bucket", "console", "database", "keystore", "queue"], "resource_{}_count")
_pivot("a5_account_pivot", "privileged_account_used", [f"acct_{i}" for i in range(10)], "priv_acc_{}_count")
_pivot("a6_vault_pivot", "vault_name", [f"vault_{i}" for i in range(7)], "vault_{}_count")


def _pair_pivot(e: DataFrame) -> DataFrame:
    counts = X.pair_bucket(e, 20).groupBy("user_id", "pair").count()
    return counts.select("user_id", F.concat(F.lit("pair_"), "pair").alias("feature"), "count")


TOP = "top AS (SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {n})"
query(
    "a4_pair_counts",
    _pair_pivot,
    over_events(
        "SELECT user_id, 'pair_' || CASE WHEN pair IN (SELECT v FROM top) THEN pair ELSE 'other_pair' END AS feature, count(*) AS count FROM p GROUP BY ALL",
        "p AS (SELECT user_id, action || '_' || resource AS pair FROM ev)", TOP.format(c="pair", t="p", n=20),
    ),
)
query(
    "a7_status_ratio",
    lambda e: rounded(X.status_features(e), "success_count", "failure_count", "success_ratio"),
    over_events("SELECT row_id, s AS success_count, f AS failure_count, round(coalesce(s / nullif(s + f, 0)::DOUBLE, 1), 6) AS success_ratio FROM (SELECT row_id, count(*) FILTER (status = 'success') OVER u AS s, count(*) FILTER (status = 'failure') OVER u AS f FROM ev WINDOW u AS (PARTITION BY user_id))"),
)
query(
    "a8_a10_changes_in_session",
    lambda e: X.distinct_per(e, "session_id", {"ips": "ip_address", "regions": "region", "agents": "user_agent"}).select("row_id", "ips", "regions", "agents"),
    over_events("SELECT row_id, ips, regions, agents FROM ev JOIN (SELECT session_id, count(DISTINCT ip_address) AS ips, count(DISTINCT region) AS regions, count(DISTINCT user_agent) AS agents FROM ev GROUP BY 1) USING (session_id)"),
)
query(
    "a11_a12_session_actions",
    lambda e: rounded(X.session_features(e), "actions_per_session", "distinct_actions_per_session"),
    over_events("SELECT row_id, actions_per_session, distinct_actions_per_session FROM ev JOIN (SELECT session_id, count(*) AS actions_per_session, count(DISTINCT action) AS distinct_actions_per_session FROM ev GROUP BY 1) USING (session_id)"),
)
query(
    "a13_action_entropy",
    lambda e: rounded(X.action_entropy(e), "action_entropy", key="user_id"),
    over_events("SELECT user_id, round(-sum(p * log2(p)), 6) AS action_entropy FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM ev GROUP BY user_id, action) GROUP BY user_id"),
)
query(
    "a14_transitions",
    lambda e: rounded(X.transitions(e), "common_transition_prob", "unique_transitions", key="user_id"),
    over_events(
        "SELECT u.user_id, round(coalesce(t.p, 0), 6) AS common_transition_prob, coalesce(t.n, 0) AS unique_transitions FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN (SELECT user_id, max(c) / sum(c)::DOUBLE AS p, count(*) AS n FROM pairs GROUP BY user_id) t USING (user_id)",
        f"steps AS (SELECT user_id, action, lead(action) OVER ({WU}) AS following FROM ev)",
        "pairs AS (SELECT user_id, action, following, count(*) AS c FROM steps WHERE following IS NOT NULL GROUP BY ALL)",
    ),
)
query(
    "a15_resource_diversity",
    lambda e: rounded(X.resource_diversity(e), "resource_diversity", key="user_id"),
    over_events("SELECT user_id, round(count(DISTINCT resource) / count(*)::DOUBLE, 6) AS resource_diversity FROM ev GROUP BY user_id"),
)
query(
    "a16_hours_from_mean",
    lambda e: rounded(X.temporal_features(e), "hour_mean", "hour_std", "hours_from_mean"),
    over_events("SELECT row_id, round(avg(h) OVER u, 6) AS hour_mean, round(coalesce(stddev_samp(h) OVER u, 0), 6) AS hour_std, round(abs(h - avg(h) OVER u), 6) AS hours_from_mean FROM (SELECT *, hour(\"timestamp\") AS h FROM ev) WINDOW u AS (PARTITION BY user_id)"),
)
PRIV = "pr AS (SELECT *, CASE WHEN is_privileged_session THEN session_duration_seconds END AS d FROM ev)"
STAT = "st AS (SELECT *, coalesce(min(d) OVER u, 0) AS lo, coalesce(max(d) OVER u, 0) AS hi, coalesce(avg(d) OVER u, 0) AS mu, coalesce(stddev_samp(d) OVER u, 0) AS sd FROM pr WINDOW u AS (PARTITION BY user_id))"
query(
    "a17_privileged_durations",
    lambda e: rounded(X.privileged_features(e), "priv_duration_min", "priv_duration_max", "priv_duration_mean", "priv_duration_std"),
    over_events("SELECT row_id, round(lo, 6) AS priv_duration_min, round(hi, 6) AS priv_duration_max, round(mu, 6) AS priv_duration_mean, round(sd, 6) AS priv_duration_std FROM st", PRIV, STAT),
)
query(
    "a18_long_short",
    lambda e: rounded(X.privileged_features(e, sigmas=1.5), "is_long_session", "is_short_session"),
    over_events("SELECT row_id, (is_privileged_session AND session_duration_seconds > mu + 1.5 * sd)::BIGINT AS is_long_session, (is_privileged_session AND session_duration_seconds < mu - 1.5 * sd)::BIGINT AS is_short_session FROM st", PRIV, STAT),
)
query(
    "a19_policy_violations",
    lambda e: rounded(X.privileged_features(e), "policy_violation_count", "total_actions_count", "policy_violation_ratio"),
    over_events("SELECT row_id, count(*) FILTER (policy_violation) OVER u AS policy_violation_count, count(*) OVER u AS total_actions_count, round(count(*) FILTER (policy_violation) OVER u / (count(*) OVER u)::DOUBLE, 6) AS policy_violation_ratio FROM ev WINDOW u AS (PARTITION BY user_id)"),
)
for name, column, n, other in (("t3_top_ip", "ip_address", 20, "other_ip"), ("t3_top_region", "region", 3, "other_region"), ("t3_top_agent", "user_agent", 2, "other_user_agent"), ("t3_top_account", "privileged_account_used", 5, "other_priv_account"), ("t3_top_vault", "vault_name", 5, "other_vault")):
    query(
        name,
        lambda e, c=column, n=n, o=other: X.bucket_top(e, "top", c, n, o).select("row_id", "top"),
        over_events(f"SELECT row_id, CASE WHEN {column} IN (SELECT v FROM top) THEN {column} ELSE '{other}' END AS top FROM ev", TOP.format(c=column, t="ev", n=n)),
    )


#: Where each fixed feature's SQL is: a query above, and the names of its columns there.
FRAME = {
    "f1_f4_time_parts": "hour day_of_week is_weekend is_working_hour", "w1_time_since_last_access": "time_since_last_access", "f5_cyclic_hour": "hour_sin hour_cos", "f6_session_duration": "session_duration",
    "f8_private_ip": "is_private_ip", "a1_value_frequency": "ip_frequency region_frequency user_agent_frequency", "a8_a10_changes_in_session": "ips:ip_changes_in_session regions:region_changes_in_session agents:user_agent_changes_in_session",
    "a7_status_ratio": "success_count failure_count success_ratio", "w2_actions_1min": "actions:actions_per_minute", "w3_w4_distinct_1h": "unique_actions:unique_actions_per_hour unique_resources:unique_resources_per_hour",
    "a11_a12_session_actions": "actions_per_session distinct_actions_per_session", "w5_w6_session_gaps": "time_between_actions_in_session average_time_between_actions_in_session",
    "a13_action_entropy": "action_entropy", "a14_transitions": "common_transition_prob unique_transitions", "w7_w8_velocity": "action_velocity", "w9_burst_default": "is_burst", "a15_resource_diversity": "resource_diversity",
    "f7_day_parts": "is_early_morning is_morning is_afternoon is_evening", "a16_hours_from_mean": "hours_from_mean", "w10_session_hours": "session_hour_span",
    "a17_privileged_durations": "priv_duration_min priv_duration_max priv_duration_mean priv_duration_std", "a19_policy_violations": "policy_violation_count policy_violation_ratio", "f22_missing_flags": "missing_reason missing_ticket",
}


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 48 fixed features of every event, from the whole chain and the encoder."""
    x = extract(read_events(spark, sf_dir), v6=False)
    return x.select("row_id", *[(F.round(numeric(F.col(c)), 6) + 0.0).alias(c) for c in FIXED_FEATURES])


def _extracted_values(e: DataFrame) -> DataFrame:
    """The columns that the encoder counts, by the operators that make them."""
    return X.agent_features(X.region_features(X.ip_features(X.privileged_features(X.pair_bucket(e, base=e), base=e), False, e), e), e)


#: The same in SQL, from the events and the most frequent values.
def _top_sql(column: str, n: int, other: str) -> str:
    return f"CASE WHEN {column} IN (SELECT {column} FROM ev GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT {n}) THEN {column} ELSE '{other}' END"


VALUES = f"""vals AS (SELECT user_id, unnest([{', '.join(repr(c) for c in (*PIVOTS, *CATEGORIES))}]) AS "column",
    unnest([action, resource, {_top_sql("action || '_' || resource", 20, "other_pair")}, privileged_account_used, vault_name, role, {_top_sql("ip_address", 20, "other_ip")}, {_top_sql("region", 5, "other_region")},
     {_top_sql("user_agent", 5, "other_user_agent")}, CASE WHEN user_agent LIKE '%Windows%' THEN 'Windows' WHEN user_agent LIKE '%Macintosh%' THEN 'Mac' WHEN user_agent LIKE '%Linux%' THEN 'Linux' ELSE 'OtherOS' END,
     CASE WHEN user_agent LIKE '%Chrome%' THEN 'Chrome' WHEN user_agent LIKE '%Firefox%' THEN 'Firefox' WHEN user_agent LIKE '%Safari%' THEN 'Safari' ELSE 'OtherBrowser' END,
     {_top_sql("privileged_account_used", 10, "other_priv_account")}, {_top_sql("vault_name", 5, "other_vault")}]) AS value FROM ev)"""
query(
    "a2_a6_user_value_counts",
    lambda e: X.user_value_counts(_extracted_values(e), list(PIVOTS)),
    over_events(f"SELECT user_id, \"column\", value, count(*) AS n FROM vals WHERE \"column\" IN ({', '.join(repr(c) for c in PIVOTS)}) GROUP BY ALL", VALUES),
)
query(
    "f20_value_dictionary",
    lambda e: X.value_dictionary(_extracted_values(e), [*PIVOTS, *CATEGORIES]),
    over_events(
        f"SELECT \"column\", value, n, row_number() OVER (ORDER BY list_position([{', '.join(repr(c) for c in (*PIVOTS, *CATEGORIES))}], \"column\"), n DESC, value) - 1 AS number FROM (SELECT \"column\", value, count(*) AS n FROM vals GROUP BY ALL)", VALUES,
    ),
)


def _frame_sql() -> str:
    names = {n.split(":")[-1]: f"{source}.{n.split(':')[0]}" for source, listed in FRAME.items() for n in listed.split()}
    names |= {"is_long_session": "(p.d > p.mu + 3 * p.sd)", "is_short_session": "(p.d < p.mu - 3 * p.sd)", "is_privileged": "p.is_privileged_session"}
    by_user = ("a13_action_entropy", "a14_transitions", "a15_resource_diversity")
    joins = " ".join(f"JOIN ({ORACLES[source]}) AS {source} ON {source}.{key} = p.{key}" for source in FRAME for key in ["user_id" if source in by_user else "row_id"])
    return f"SELECT p.row_id, {', '.join(f'coalesce({names[c]}::DOUBLE, 0) AS {c}' for c in FIXED_FEATURES)} FROM ({over_events('SELECT * FROM st', PRIV, STAT)}) AS p {joins}"


QUERIES["feature_frame"], ORACLES["feature_frame"] = feature_frame, _frame_sql()
