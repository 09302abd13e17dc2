"""Queries of rules, joins, sorts, sets, aggregates and reports, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.functions import scalars
from vigilframe.models.experiments import ExperimentLog
from vigilframe.operators import features as X
from vigilframe.operators import reports as R
from vigilframe.operators import sets
from vigilframe.operators.quantiles import percentiles
from vigilframe.operators.rules import Thresholds, rule_hits, rules, session_metrics
from vigilframe.operators.scaling import Scaler
from vigilframe.plans.features import rounded
from vigilframe.plans.twins import over_events
from vigilframe.schema import EVENT, REQUIRED
from vigilframe.session import shared_dir
from vigilframe.sources.cloud import ACTIVITY_RECORD, TRAIL_RECORD, parse_activity, parse_trail
from vigilframe.sources.events import read_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Sessions of the events table are a user's day: a few rows over many hours.
LIMITS = Thresholds(duration_min=720.0, actions=4, ips=3, failure_rate=0.2)


def query(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(read_events(spark, sf_dir))
    ORACLES[name] = sql


# Rules

METRICS = """m AS (SELECT session_id, min_by(user_id, ("timestamp", row_id)) AS user_id, min("timestamp") AS start_time,
  date_diff('microsecond', min(session_start), max(session_end)) / 6e7 AS duration, count(*) AS n_actions, count(DISTINCT ip_address) AS n_unique_ips,
  avg((status = 'failure')::INT) AS failure_rate FROM ev GROUP BY session_id)"""
SQL_RULES = {
    "hours": "start_time::TIME NOT BETWEEN TIME '09:00:00' AND TIME '17:00:00'", "duration": "duration > {t.duration_min}", "actions": "n_actions > {t.actions}",
    "ips": "n_unique_ips > {t.ips}", "failures": "failure_rate > {t.failure_rate}",
}
query(
    "a20_session_metrics",
    lambda e: rounded(session_metrics(e).withColumn("start", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss")), "user_id", "start", "duration", "n_actions", "n_unique_ips", "failure_rate", key="session_id"),
    over_events("SELECT session_id, user_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start, round(duration, 6) AS duration, n_actions, n_unique_ips, round(failure_rate, 6) AS failure_rate FROM m", METRICS),
)
for i, (code, condition) in enumerate(SQL_RULES.items(), 1):
    query(
        f"r{i}_{code}",
        lambda e, c=code: session_metrics(e).where(rules(LIMITS)[c][0]).select("session_id", "user_id", "n_actions"),
        over_events(f"SELECT session_id, user_id, n_actions FROM m WHERE {condition.format(t=LIMITS)}", METRICS),
    )
for name, limits in (("r6_rule_hits", LIMITS), ("r6_rule_hits_defaults", Thresholds())):
    query(
        name,
        lambda e, t=limits: rounded(rule_hits(session_metrics(e), t).withColumn("broken", F.array_join("codes", ",")), "user_id", "duration", "n_actions", "n_unique_ips", "failure_rate", "broken", key="session_id"),
        over_events(
            "SELECT session_id, user_id, round(duration, 6) AS duration, n_actions, n_unique_ips, round(failure_rate, 6) AS failure_rate, broken FROM (SELECT *, concat_ws(',', "
            + ", ".join(f"CASE WHEN {c.format(t=limits)} THEN '{code}' END" for code, c in SQL_RULES.items()) + ") AS broken FROM m) WHERE broken <> ''",
            METRICS,
        ),
    )
HITS = "hits AS (SELECT session_id FROM m WHERE " + " OR ".join(SQL_RULES[c].format(t=LIMITS) for c in ("duration", "actions", "ips", "failures")) + ")"


def _flagged(e: DataFrame) -> DataFrame:
    """Sessions that break a rule other than the hours."""
    return rule_hits(session_metrics(e), LIMITS).where(F.size(F.array_remove("codes", "hours")) > 0)


def _odd() -> Column:
    return F.col("policy_violation")


# Projections

query("p1_standardize", lambda e: sets.standardize(e.drop("region").withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))).select("row_id", F.date_format("timestamp", "HH:mm").alias("at"), "user_id", "region", "status", F.lit(len(EVENT)).cast("long").alias("n_columns")),
      over_events("SELECT row_id, strftime(\"timestamp\", '%H:%M') AS at, user_id, NULL::VARCHAR AS region, status, 11::BIGINT AS n_columns FROM ev"))
def _validated(e: DataFrame) -> DataFrame:
    """Whether the events are valid, and without two of the columns, and events of which a column is null throughout."""
    tables = {"all": e, "no_status": e.drop("status", "action"), "null_action": e.withColumn("action", F.lit(None).cast("string")), "none": e.where("row_id < 0")}
    return e.sparkSession.createDataFrame([(name, sets.validate(t)) for name, t in tables.items()], "events string, valid boolean")


query("p2_validate", _validated,
      over_events("SELECT unnest(['all', 'no_status', 'null_action', 'none']) AS events, unnest([" + " AND ".join(f'count("{c}") > 0' for c in REQUIRED) + ", false, false, false]) AS valid FROM ev"))
query("f25_steady_id", lambda e: e.select("row_id", scalars.steady_id(F.col("row_id")).alias("made_id")), over_events("SELECT row_id, substring(sha256(row_id::VARCHAR), 1, 32) AS made_id FROM ev"))
query("p3_clean", lambda e: sets.clean(e.withColumns({"region": F.when(F.col("row_id") % 3 > 0, F.col("region")), "session_start": F.when(F.col("row_id") % 2 == 0, F.col("session_start"))})).select("row_id", "region", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start")),
      over_events("SELECT row_id, CASE WHEN row_id % 3 > 0 THEN region ELSE 'unknown' END AS region, strftime(CASE WHEN row_id % 2 = 0 THEN session_start ELSE \"timestamp\" END, '%Y-%m-%d %H:%M:%S') AS start FROM ev"))
query("p4_drop_null_keys", lambda e: sets.drop_null_keys(e, "ticket_id", "reason_for_access").select("row_id", "ticket_id"), over_events("SELECT row_id, ticket_id FROM ev WHERE ticket_id IS NOT NULL AND reason_for_access IS NOT NULL"))
query("p5_sentinels", lambda e: X.fill_sentinels(e.withColumns({"region": F.when(F.col("row_id") % 3 > 0, F.col("region")), "action": F.when(F.col("row_id") % 4 > 0, F.col("action"))})).select("row_id", "region", "action"),
      over_events("SELECT row_id, CASE WHEN row_id % 3 > 0 THEN region ELSE 'unknown_region' END AS region, CASE WHEN row_id % 4 > 0 THEN action ELSE 'unknown_action' END AS action FROM ev"))
query("p6_filters", lambda e: e.where(_odd() & (F.col("user_id") != "user_1")).select("row_id", "user_id"), over_events("SELECT row_id, user_id FROM ev WHERE policy_violation AND user_id <> 'user_1'"))
query("p9_numeric", lambda e: e.select("row_id", scalars.numeric(F.when(F.col("row_id") % 4 == 0, "x").otherwise((F.col("row_id") % 7).cast("string"))).alias("x")), over_events("SELECT row_id, (CASE WHEN row_id % 4 = 0 THEN 0 ELSE row_id % 7 END)::DOUBLE AS x FROM ev"))
query("p11_privileged_defaults", lambda e: X.privileged_defaults(e.drop("vault_name").withColumn("policy_violation", F.when(F.col("row_id") % 2 == 0, F.col("policy_violation")))).select("row_id", "vault_name", "policy_violation"),
      over_events("SELECT row_id, 'none' AS vault_name, coalesce(CASE WHEN row_id % 2 = 0 THEN policy_violation END, false) AS policy_violation FROM ev"))

# Sources: records in the vendors' shape, built from the events


def _trail(e: DataFrame) -> DataFrame:
    issuer = F.struct(F.struct(F.col("user_id").alias("userName")).alias("sessionIssuer"))
    record = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.col("action").alias("eventName"), F.col("region").alias("awsRegion"), F.col("ip_address").alias("sourceIPAddress"), F.col("row_id").cast("string").alias("requestID"),
        F.when(F.col("status") == "failure", "denied").alias("errorCode"), F.struct(F.when(F.col("row_id") % 2 == 0, F.col("role")).otherwise("").alias("userName"), issuer.alias("sessionContext")).alias("userIdentity"),
        F.when(F.col("row_id") % 5 > 0, F.array(F.struct(F.col("resource").alias("resourceName")))).alias("resources"),
    )
    parsed = e.select(F.from_json(F.to_json(record), TRAIL_RECORD).alias("r")).select("r.*")
    return parse_trail(parsed).select(F.col("session_id").cast("long").alias("row_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "user_id", "action", "resource", "ip_address", "region", "status")


query("s5_trail_records", _trail, over_events("SELECT row_id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN row_id % 2 = 0 THEN role ELSE user_id END AS user_id, action, CASE WHEN row_id % 5 > 0 THEN resource END AS resource, ip_address, region, status FROM ev"))


def _activity(e: DataFrame) -> DataFrame:
    record = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.concat(F.lit("/sub/x/"), "resource").alias("resourceId"), F.concat(F.lit("ns/kind/"), "action").alias("operationName"), F.when(F.col("status") == "success", "SUCCESS").otherwise("Failed").alias("resultType"),
        F.col("ip_address").alias("callerIpAddress"), F.col("row_id").cast("string").alias("correlationId"), F.struct(F.struct(F.when(F.col("row_id") % 2 == 0, F.col("role")).alias("oid"), F.col("user_id").alias("name")).alias("claims")).alias("identity"),
    )
    parsed = e.select(F.from_json(F.to_json(record), ACTIVITY_RECORD).alias("r")).select("r.*")
    return parse_activity(parsed).select(F.col("session_id").cast("long").alias("row_id"), "user_id", "action", "resource", "ip_address", "status")


query("s6_activity_records", _activity, over_events("SELECT row_id, CASE WHEN row_id % 2 = 0 THEN role ELSE user_id END AS user_id, action, resource, ip_address, status FROM ev"))

# Joins

query("j1_user_aggregate_join", lambda e: rounded(e.join(X.resource_diversity(e), "user_id", "left"), "resource_diversity"), over_events("SELECT row_id, round(d, 6) AS resource_diversity FROM ev LEFT JOIN (SELECT user_id, count(DISTINCT resource) / count(*)::DOUBLE AS d FROM ev GROUP BY 1) USING (user_id)"))
query("j2_j3_no_self_join", lambda e: e.select("row_id", F.count(F.lit(1)).over(Window.partitionBy("session_id", "timestamp")).alias("peers")), over_events("SELECT a.row_id, count(*) AS peers FROM ev a LEFT JOIN ev b ON a.session_id = b.session_id AND a.\"timestamp\" = b.\"timestamp\" GROUP BY 1"))
query("j4_value_counts_join", lambda e: X.value_frequency(e, "n", "resource").select("row_id", "n"), over_events("SELECT row_id, n FROM ev JOIN (SELECT resource, count(*) AS n FROM ev GROUP BY 1) USING (resource)"))
query("j5_in_flagged_sessions", lambda e: R.in_sessions(e, _flagged(e)).select("row_id", "session_id"), over_events("SELECT row_id, session_id FROM ev WHERE session_id IN (SELECT session_id FROM hits)", METRICS, HITS))
query("j6_outside_flagged_sessions", lambda e: R.outside_sessions(e, _flagged(e)).select("row_id", "session_id"), over_events("SELECT row_id, session_id FROM ev WHERE session_id NOT IN (SELECT session_id FROM hits)", METRICS, HITS))
query("j7_top_membership", lambda e: X.bucket_top(e, "top", "user_id", 10, "other").select("row_id", (F.col("top") != "other").alias("in_top")), over_events("SELECT row_id, user_id IN (SELECT user_id FROM ev GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 10) AS in_top FROM ev"))
query("j8_rows_of_flagged_sessions", lambda e: R.cumulative_ips(e, _flagged(e)).select("session_id", "row_id", "cumulative_ips"), over_events("SELECT session_id, row_id, count(DISTINCT ip_address) OVER (PARTITION BY session_id ORDER BY \"timestamp\", row_id) AS cumulative_ips FROM ev WHERE session_id IN (SELECT session_id FROM hits)", METRICS, HITS))

# Aggregates and reports

NORMAL = "normal AS (SELECT * FROM ev WHERE session_id NOT IN (SELECT session_id FROM hits))"
query("a21_normal_sessions", lambda e: rounded(session_metrics(R.outside_sessions(e, _flagged(e))), "duration", "n_actions", "n_unique_ips", "failure_rate", key="session_id"),
      over_events("SELECT session_id, round(duration, 6) AS duration, n_actions, n_unique_ips, round(failure_rate, 6) AS failure_rate FROM m WHERE session_id NOT IN (SELECT session_id FROM hits)", METRICS, HITS))
query("a22_hours", lambda e: rounded(R.hours(e), "n", key="hour"), over_events("SELECT hour(\"timestamp\") AS hour, count(*) AS n FROM ev GROUP BY 1"))
query("a22_hours_by_session", lambda e: R.in_sessions(e, _flagged(e)).groupBy("session_id", F.hour("timestamp").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n")), over_events("SELECT session_id, hour(\"timestamp\") AS hour, count(*) AS n FROM ev WHERE session_id IN (SELECT session_id FROM hits) GROUP BY ALL", METRICS, HITS))
query("a23_anomalous_hours", lambda e: rounded(R.hours(e.where(_odd() & (F.hour("timestamp") < 12))), "n", key="hour"), over_events("SELECT hour(\"timestamp\") AS hour, count(*) AS n FROM ev WHERE policy_violation AND hour(\"timestamp\") < 12 GROUP BY 1"))
query("a24_hours_dense", lambda e: rounded(R.hours_dense(e.where(_odd() & (F.hour("timestamp") < 12))), "n", key="hour"), over_events("SELECT h.hour::INT AS hour, count(row_id) AS n FROM range(24) h(hour) LEFT JOIN (SELECT row_id, hour(\"timestamp\") AS hr FROM ev WHERE policy_violation AND hour(\"timestamp\") < 12) ON hr = h.hour GROUP BY 1"))
TOP5 = "top5 AS (SELECT user_id, count(*) AS n FROM ev WHERE policy_violation GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5)"
query("a25_scores_of_top_users", lambda e: rounded(e.join(R.top_users(e.where(_odd()), 5).select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.avg("session_duration_seconds").alias("mean_score")), "mean_score", key="user_id"), over_events("SELECT user_id, round(avg(session_duration_seconds), 6) AS mean_score FROM ev WHERE user_id IN (SELECT user_id FROM top5) GROUP BY 1", TOP5))
PRED = "q AS (SELECT policy_violation AS y, is_privileged_session AND hour(\"timestamp\") < 12 AS p FROM ev), c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (y AND NOT p) AS fn, avg((y = p)::INT) AS acc FROM q)"
query("a26_a27_quality", lambda e: R.detection_quality(e, _odd(), F.col("is_privileged_session") & (F.hour("timestamp") < 12)).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")]),
      over_events("SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, round(acc, 6) AS accuracy FROM (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / (tp + fn)::DOUBLE AS re FROM c)", PRED))
query("a28_totals", lambda e: R.totals(e, _odd()), over_events("SELECT count(*) AS events, count(*) FILTER (policy_violation) AS anomalies, count(*) FILTER (policy_violation) * 5000.0::DOUBLE AS estimated_cost FROM ev"))
query("a29_profile", lambda e: (lambda p: p.select(*[F.round(c, 6).alias(c) for c in p.columns]))(R.profile(e, _odd())),
      over_events("SELECT " + ", ".join(f"round(avg({c}) FILTER (odd = {k}), 6) AS {label}_{c}" for label, k in (("anomalous", 1), ("baseline", 0)) for c in ("minutes", "n", "ips"))
                  + ", round((SELECT count(DISTINCT ip_address) / count(DISTINCT session_id)::DOUBLE FROM ev WHERE NOT policy_violation), 6) AS baseline_ips_per_session FROM s",
                  "s AS (SELECT session_id, max(policy_violation::INT) AS odd, count(*) AS n, count(DISTINCT ip_address) AS ips, date_diff('microsecond', min(\"timestamp\"), max(\"timestamp\")) / 6e7 AS minutes FROM ev GROUP BY 1)"))


def _percentiles(e: DataFrame, wanted: tuple[int, ...] = (50, 65, 90, 99)) -> DataFrame:
    found = percentiles(e, "session_duration_seconds", [p / 100 for p in wanted])
    return e.sparkSession.createDataFrame([tuple(found)], ", ".join(f"p{p} double" for p in wanted)).select(*[F.round(f"p{p}", 6).alias(f"p{p}") for p in wanted])


query("a30_percentile", _percentiles, over_events("SELECT " + ", ".join(f"round(quantile_cont(session_duration_seconds, {p / 100}), 6) AS p{p}" for p in (50, 65, 90, 99)) + " FROM ev"))
query("a31_histogram", lambda e: R.histogram(e, "session_duration_seconds", 50).select(F.col("bin").cast("long").alias("bin"), "n"), over_events("SELECT least(floor((v - lo) / (hi - lo) * 50) + 1, 50)::BIGINT AS bin, count(*) AS n FROM (SELECT session_duration_seconds AS v, min(session_duration_seconds) OVER () AS lo, max(session_duration_seconds) OVER () AS hi FROM ev) GROUP BY 1"))


def _scaled(e: DataFrame) -> DataFrame:
    x = e.select("row_id", "session_duration_seconds", F.hour("timestamp").alias("hour"), F.lit(3.0).alias("constant"))
    return rounded(Scaler.fit(x, ["session_duration_seconds", "hour", "constant"]).transform(x), "session_duration_seconds", "hour", "constant")


query("f21_a32_scaling", _scaled, over_events("SELECT row_id, round((d - avg(d) OVER ()) / stddev_pop(d) OVER (), 6) + 0 AS session_duration_seconds, round((h - avg(h) OVER ()) / stddev_pop(h) OVER (), 6) + 0 AS hour, 0.0::DOUBLE AS constant FROM (SELECT row_id, session_duration_seconds AS d, hour(\"timestamp\") AS h FROM ev)"))
query("a33_label_counts", lambda e: e.groupBy("role").agg(F.sum(_odd().cast("long")).alias("anomalies"), F.count(F.lit(1)).alias("n")), over_events("SELECT role, count(*) FILTER (policy_violation) AS anomalies, count(*) AS n FROM ev GROUP BY 1"))

# Sorts and sets

query("t2_global_sort", lambda e: sets.placed(e, ["timestamp", "row_id"], "place").select("place", "row_id", "user_id"), over_events("SELECT row_number() OVER (ORDER BY \"timestamp\", row_id) AS place, row_id, user_id FROM ev"))
for n in (10, 5):
    query(f"t{4 if n == 10 else 5}_top_{n}_users", lambda e, n=n: R.top_users(e.where(_odd()), n), over_events(f"SELECT user_id, count(*) AS n FROM ev WHERE policy_violation GROUP BY 1 ORDER BY n DESC, user_id LIMIT {n}"))
query("t6_first_anomalies", lambda e: e.where(_odd()).orderBy("row_id").limit(3).select("row_id", "user_id", "action"), over_events("SELECT row_id, user_id, action FROM ev WHERE policy_violation ORDER BY row_id LIMIT 3"))
query("t8_first_rows", lambda e: e.groupBy("session_id").agg(F.min_by("action", F.struct("timestamp", "row_id")).alias("first_action"), F.max_by("action", F.struct("timestamp", "row_id")).alias("last_action")), over_events("SELECT session_id, arg_min(action, (\"timestamp\", row_id)) AS first_action, arg_max(action, (\"timestamp\", row_id)) AS last_action FROM ev GROUP BY 1"))
query("t10_value_counts", lambda e: X.top_values(e, "action", 10).select("value", "count", F.row_number().over(Window.orderBy(F.desc("count"), "value")).cast("long").alias("rank")), over_events("SELECT action AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, action) AS rank FROM ev GROUP BY action"))
query("u1_union_by_name", lambda e: sets.union(e.where("status = 'failure'").select("row_id", "status"), e.where(_odd()).select("status", "row_id", "role")), over_events("SELECT row_id, status, NULL AS role FROM ev WHERE status = 'failure' UNION ALL SELECT row_id, status, role FROM ev WHERE policy_violation"))


def _unpermitted(e: DataFrame) -> DataFrame:
    permitted = e.where(F.col("row_id") % 2 == 0).select("role", "action").where("action <> 'signup'").distinct()
    return sets.unpermitted(e, permitted).select("row_id", "role", "action")


query("u3_unpermitted_actions", _unpermitted, over_events("SELECT row_id, role, action FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.row_id % 2 = 0 AND b.action <> 'signup' AND a.role = b.role AND a.action = b.action)"))
query("u4_distinct_values", lambda e: e.select("region", "action").distinct(), over_events("SELECT DISTINCT region, action FROM ev"))

# Reporting result sets

query("v1_scatter", lambda e: rounded(e.select("row_id", F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("second"), F.col("session_duration_seconds").alias("score"), _odd().cast("int").alias("predicted")), "second", "score", "predicted"), over_events("SELECT row_id, floor(epoch(\"timestamp\"))::BIGINT AS second, round(session_duration_seconds, 6) AS score, policy_violation::BIGINT AS predicted FROM ev"))
query("v2_duration_by_actions", lambda e: rounded(session_metrics(e).join(_flagged(e).select("session_id", F.lit(True).alias("hit")), "session_id", "left").withColumn("anomalous", F.coalesce("hit", F.lit(False))), "duration", "n_actions", "anomalous", key="session_id"),
      over_events("SELECT session_id, round(duration, 6) AS duration, n_actions, session_id IN (SELECT session_id FROM hits) AS anomalous FROM m", METRICS, HITS))
query("v4_distributions", lambda e: session_metrics(e).groupBy("n_unique_ips", F.floor(F.col("failure_rate") * 10).alias("failure_bin")).agg(F.count(F.lit(1)).alias("sessions")), over_events("SELECT n_unique_ips, floor(failure_rate * 10)::BIGINT AS failure_bin, count(*) AS sessions FROM m GROUP BY ALL", METRICS))
query("v4_duration_distribution", lambda e: R.histogram(session_metrics(e), "duration", 20).select(F.col("bin").cast("long").alias("bin"), "n"),
      over_events("SELECT coalesce(least(floor((v - lo) / nullif(hi - lo, 0) * 20) + 1, 20), 1)::BIGINT AS bin, count(*) AS n FROM (SELECT duration AS v, min(duration) OVER () AS lo, max(duration) OVER () AS hi FROM m) WHERE v IS NOT NULL GROUP BY 1", METRICS))
query("v5_hourly_activity", lambda e: rounded(R.hours_dense(e, "all_actions").join(R.hours_dense(e.where(_odd()), "anomalous"), "hour"), "all_actions", "anomalous", key="hour"), over_events("SELECT h.hour::INT AS hour, count(row_id) AS all_actions, count(row_id) FILTER (policy_violation) AS anomalous FROM range(24) h(hour) LEFT JOIN ev ON hour(\"timestamp\") = h.hour GROUP BY 1"))


def _summary(e: DataFrame) -> DataFrame:
    t = R.totals(e, _odd()).select(F.expr("stack(2, 'events', events, 'anomalies', anomalies) as (item, n)"))
    users = R.top_users(e.where(_odd()), 5).select(F.concat(F.lit("user:"), "user_id").alias("item"), "n")
    return t.union(users).union(R.hours_dense(e.where(_odd())).select(F.concat(F.lit("hour:"), F.col("hour").cast("string")), "n"))


query("v6_summary", _summary, over_events("SELECT 'events' AS item, count(*) AS n FROM ev UNION ALL SELECT 'anomalies', count(*) FILTER (policy_violation) FROM ev UNION ALL SELECT 'user:' || user_id, n FROM top5 UNION ALL SELECT 'hour:' || h.hour, count(row_id) FROM range(24) h(hour) LEFT JOIN (SELECT * FROM ev WHERE policy_violation) x ON hour(x.\"timestamp\") = h.hour GROUP BY h.hour", TOP5))
def _experiment(e: DataFrame, run: str, contamination: float, predicted: Column) -> DataFrame:
    return R.detection_quality(e, _odd(), predicted).select(F.lit(run).alias("run"), F.lit(contamination).alias("contamination"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def _experiment_log(e: DataFrame) -> DataFrame:
    """Two runs appended to a log, the first one twice."""
    log = ExperimentLog(e.sparkSession, f"{shared_dir(e.sparkSession)}/vigilframe/experiments-{uuid.uuid4().hex}", "run string, contamination double, precision double, recall double, f1 double")
    runs = {"privileged": (0.35, F.col("is_privileged_session")), "failures": (0.1, F.col("status") == "failure")}
    for run in ("privileged", "failures", "privileged"):
        log.append(run, _experiment(e, run, *runs[run]))
    return log.rows()


query("v7_experiment_log", _experiment_log, over_events(" UNION ALL ".join(
    f"SELECT '{run}' AS run, {c}::DOUBLE AS contamination, round(tp / p::DOUBLE, 6) AS precision, round(tp / y::DOUBLE, 6) AS recall, round(2.0 * tp / (p + y), 6)::DOUBLE AS f1 FROM (SELECT count(*) FILTER (policy_violation AND {flag}) AS tp, count(*) FILTER ({flag}) AS p, count(*) FILTER (policy_violation) AS y FROM ev)"
    for run, c, flag in (("privileged", 0.35, "is_privileged_session"), ("failures", 0.1, "status = 'failure'")))))
query("v7_experiment_row", lambda e: R.detection_quality(e, _odd(), F.col("is_privileged_session")).select(F.lit("default").alias("run"), F.lit(0.35).alias("contamination"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1")),
      over_events("SELECT 'default' AS run, 0.35::DOUBLE AS contamination, round(tp / p::DOUBLE, 6) AS precision, round(tp / y::DOUBLE, 6) AS recall, round(2.0 * tp / (p + y), 6)::DOUBLE AS f1 FROM (SELECT count(*) FILTER (policy_violation AND is_privileged_session) AS tp, count(*) FILTER (is_privileged_session) AS p, count(*) FILTER (policy_violation) AS y FROM ev)"))


# Star-schema tables as a second domain for the same operators


def _status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey"), "o_orderstatus")
    return X.count_pivot(orders, "o_custkey", "o_orderstatus", ["F", "O", "P"], "status_{}_count")


QUERIES["a2_order_status_pivot"] = _status_pivot
ORACLES["a2_order_status_pivot"] = "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"status_{s}_count\"" for s in "FOP") + " FROM orders GROUP BY 1"


def _top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity")
    out = X.bucket_top(lines.withColumn("part", F.col("l_partkey").cast("string")), "part_bucket", "part", 20, "other_part")
    return out.groupBy("part_bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


QUERIES["t3_top_parts"] = _top_parts
ORACLES["t3_top_parts"] = """WITH l AS (SELECT l_partkey::VARCHAR AS part, l_quantity FROM lineitem), t AS (SELECT part FROM l GROUP BY 1 ORDER BY count(*) DESC, part LIMIT 20)
SELECT CASE WHEN part IN (SELECT part FROM t) THEN part ELSE 'other_part' END AS part_bucket, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM l GROUP BY 1"""


def _enriched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    per = read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    return read("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


QUERIES["j1_customer_orders"] = _enriched_orders
ORACLES["j1_customer_orders"] = "SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS orders, round(coalesce(s, 0), 2) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey"
