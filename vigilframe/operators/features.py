"""The feature extractors: each takes canonical events and adds its columns.

Aggregates that come back to every row of their group are grouped and joined, never windows: a
busy user is combined before the shuffle. USER and SESSION list them, so that a chain of
extractors groups once by each and joins once; an extractor alone groups for what is missing.
`base` is the event table that such counts are taken from; a chain passes the narrow one, so
that no count repeats the chain's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions import network, scalars
from vigilframe.operators import windows
from vigilframe.operators.sets import placed
from vigilframe.operators.slices import Hot, hot_keys
from vigilframe.schema import SENTINELS

BURST_SIGMAS, ROWS = 2.0, 5


def filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(SENTINELS.get(column, "unknown")))


def fill_sentinels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: filled(c).cast("string") for c in columns or SENTINELS if c in df.columns})


def _privileged_duration() -> Column:
    return F.when(F.col("is_privileged_session"), F.col("session_duration_seconds"))


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def _in_order() -> Column:
    return F.struct("user_id", "timestamp", "row_id")


USER = {
    "success_count": lambda: _count(F.col("status") == "success"), "failure_count": lambda: _count(F.col("status") == "failure"),
    "hour_mean": lambda: F.avg(F.hour("timestamp")), "hour_std": lambda: F.coalesce(F.stddev_samp(F.hour("timestamp")), F.lit(0.0)),
    "priv_duration_min": lambda: F.coalesce(F.min(_privileged_duration()), F.lit(0.0)), "priv_duration_max": lambda: F.coalesce(F.max(_privileged_duration()), F.lit(0.0)),
    "priv_duration_mean": lambda: F.coalesce(F.avg(_privileged_duration()), F.lit(0.0)), "priv_duration_std": lambda: F.coalesce(F.stddev_samp(_privileged_duration()), F.lit(0.0)),
    "policy_violation_count": lambda: _count(F.col("policy_violation")), "total_actions_count": lambda: F.count(F.lit(1)),
    "resource_diversity": lambda: F.countDistinct("resource") / F.count(F.lit(1)),
}
SESSION = {
    "ip_changes_in_session": lambda: F.countDistinct("ip_address"), "region_changes_in_session": lambda: F.countDistinct("region"),
    "user_agent_changes_in_session": lambda: F.countDistinct("user_agent"), "distinct_actions_per_session": lambda: F.countDistinct("action"),
    "actions_per_session": lambda: F.count(F.lit(1)), "session_start_hour": lambda: F.min_by(F.hour("timestamp"), _in_order()), "session_end_hour": lambda: F.max_by(F.hour("timestamp"), _in_order()),
}
#: What rows without a session get: no counts, but the hours of all such rows.
NO_SESSION = tuple(c for c in SESSION if not c.endswith("_hour"))


def with_stats(df: DataFrame, key: str, names: Sequence[str], base: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """df with the USER or SESSION aggregates that it doesn't have yet: one group-by and one join.

    tasks: as many partitions as df is dealt to by the key, where it is.
    """
    known = USER if key == "user_id" else SESSION
    missing = [n for n in names if n not in df.columns]
    if not missing:
        return df
    stats = (df if base is None else base).groupBy(F.col(key).alias("__key")).agg(*[known[n]().alias(n) for n in missing])
    if tasks:
        stats = stats.repartition(tasks, "__key")
    # A plain equation takes rows as they are dealt by the key; one that nulls satisfy deals them anew.
    same = F.col(key).eqNullSafe(F.col("__key")) if df.schema[key].nullable else F.col(key) == F.col("__key")
    out = df.join(stats, same, "left").drop("__key")
    return out.withColumns({n: F.when(F.col(key).isNull(), 0).otherwise(F.col(n)) for n in missing if n in NO_SESSION})


def with_access_gap(df: DataFrame, hot: Hot | None = None) -> DataFrame:
    gap = "time_since_last_access"
    return df if gap in df.columns else windows.with_gap(df, gap, "user_id", hot=hot)


def time_features(df: DataFrame, hot: Hot | None = None) -> DataFrame:
    ts = F.col("timestamp")
    sin, cos = scalars.cyclic(F.hour(ts))
    return with_access_gap(df, hot).withColumns({
        "hour": F.hour(ts), "day_of_week": scalars.day_of_week(ts), "is_weekend": scalars.is_weekend(ts), "is_working_hour": scalars.is_working_hour(ts),
        "hour_sin": sin, "hour_cos": cos,
        "session_duration": F.coalesce(scalars.seconds_between(F.coalesce("session_start", ts), F.coalesce("session_end", ts)), F.lit(0.0)),
    })


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, from one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("column"), c.cast("string").alias("value")) for name, c in columns.items()]))
    return df.select(each.alias("x")).groupBy(F.col("x.column").alias("column"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _counts_of(df: DataFrame, column: str, counts: DataFrame | None) -> DataFrame:
    """(value, n) of one column, from counts where they are given."""
    counts = value_counts(df, {column: F.col(column)}) if counts is None else counts.where(F.col("column") == column)
    return counts.select("value", "n")


def value_frequency(df: DataFrame, out: str, column: str, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """How often the row's value occurs in the table: counted first, so a hot value costs no task of its own."""
    found = _counts_of(df if base is None else base, column, counts).withColumnsRenamed({"value": "__value", "n": out})
    return df.join(found, F.col(column).cast("string").eqNullSafe(F.col("__value")), "left").drop("__value")


def distinct_per(df: DataFrame, key: str, columns: dict[str, str], base: DataFrame | None = None) -> DataFrame:
    """Distinct values per key for each {new column: column}; 0 for a null key."""
    counts = (df if base is None else base).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(*[F.countDistinct(c).alias(n) for n, c in columns.items()])
    out = df.join(counts, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in columns})


def top_values(df: DataFrame, column: str, n: int, counts: DataFrame | None = None) -> DataFrame:
    """(value, count): the n most frequent values, ties by value."""
    return _counts_of(df, column, counts).where("value is not null").withColumnRenamed("n", "count").orderBy(F.desc("count"), "value").limit(n)


def bucket_top(df: DataFrame, out: str, column: str, n: int, other: str, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The value if it is among the n most frequent, else `other`."""
    top = top_values(df if base is None else base, column, n, counts).select(F.col("value").alias("__top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("__top"), "left").withColumn(out, F.coalesce("__top", F.lit(other))).drop("__top")


#: The columns that extractors count the values of.
COUNTED = {c: (lambda c=c: F.col(c)) for c in ("ip_address", "region", "user_agent", "privileged_account_used", "vault_name")} | {"__pair": lambda: pair_name()}


def ip_values(df: DataFrame, v6: bool = True, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    df = df.withColumn("is_private_ip", network.is_private_ip(F.col("ip_address"), v6))
    df = value_frequency(df, "ip_frequency", "ip_address", base, counts)
    return bucket_top(df, "top_ip", "ip_address", 20, "other_ip", base, counts)


def ip_features(df: DataFrame, v6: bool = True, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    return with_stats(ip_values(df, v6, base, counts), "session_id", ["ip_changes_in_session"], base)


def count_pivot(df: DataFrame, key: str, column: str, values: Sequence[str], name: str = "{}") -> DataFrame:
    """key and one count column per value, 0 where there is none. The values are given, so the schema is fixed."""
    wanted = df.where(F.col(column).isin(*values)) if values else df.limit(0)
    keys = df.select(key).distinct()
    counts = wanted.groupBy(key).pivot(column, list(values)).count()
    out = keys.join(counts.withColumnRenamed(key, "__key"), keys[key].eqNullSafe(F.col("__key")), "left").drop("__key") if values else keys
    return out.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(name.format(v)) for v in values])


def value_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, number): all values of the columns, numbered from 0, by column, the frequent ones first."""
    at = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    counts = value_counts(df, {c: F.col(f"`{c}`") for c in columns}).where("value is not null")
    numbered = placed(counts.withColumns({"__at": at, "__less": -F.col("n")}), ["__at", "__less", "value"], "number")
    return numbered.select("column", "value", "n", (F.col("number") - 1).alias("number"))


def user_value_counts(df: DataFrame, columns: Sequence[str], key: str = "user_id") -> DataFrame:
    """(key, column, value, n): how often each key has each value, for all values there are."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(key, each.alias("x")).select(key, "x.*").where("value is not null").groupBy(key, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def status_features(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    df = with_stats(df, "user_id", ["success_count", "failure_count"], base)
    return df.withColumn("success_ratio", scalars.ratio(F.col("success_count"), F.col("success_count") + F.col("failure_count"), 1.0))


def rate_features(df: DataFrame, minute: float = 60, hour: float = 3600, hot: Hot | None = None) -> DataFrame:
    df = windows.trailing_count(df, "actions_per_minute", "user_id", minute, hot=hot)
    return windows.trailing_distinct(df, {"unique_actions_per_hour": "action", "unique_resources_per_hour": "resource"}, "user_id", hour, hot=hot)


def session_features(df: DataFrame, base: DataFrame | None = None, hot: Hot | None = None) -> DataFrame:
    gap = "time_between_actions_in_session"
    valid = F.col("session_id").isNotNull()
    df = with_stats(df, "session_id", ["actions_per_session", "distinct_actions_per_session"], base)
    hot = hot or hot_keys(df, "session_id")
    df = windows.with_gap(df, gap, "session_id", hot=hot)
    df = df.withColumn(gap, F.when(valid, F.col(gap)).otherwise(0.0))
    return windows.with_recent(df, "session_id", ROWS, lambda w: {"average_" + gap: F.avg(gap).over(w)}, hot=hot)


def region_values(df: DataFrame, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    return bucket_top(value_frequency(df, "region_frequency", "region", base, counts), "top_region", "region", 5, "other_region", base, counts)


def region_features(df: DataFrame, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    return with_stats(region_values(df, base, counts), "session_id", ["region_changes_in_session"], base)


def agent_values(df: DataFrame, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    df = value_frequency(df, "user_agent_frequency", "user_agent", base, counts)
    df = bucket_top(df, "top_user_agent", "user_agent", 5, "other_user_agent", base, counts)
    return df.withColumns({"os": scalars.operating_system(F.col("user_agent")), "browser": scalars.browser(F.col("user_agent"))})


def agent_features(df: DataFrame, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    return with_stats(agent_values(df, base, counts), "session_id", ["user_agent_changes_in_session"], base)


def action_entropy(df: DataFrame) -> DataFrame:
    """(user_id, action_entropy) in bits."""
    counts = df.groupBy("user_id", "action").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy("user_id"))
    return counts.withColumn("p", p).groupBy("user_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("action_entropy"))


def transitions(df: DataFrame, hot: Hot | None = None) -> DataFrame:
    """(user_id, common_transition_prob, unique_transitions) over consecutive actions; 0 and 0 for one action."""
    ordered = windows.with_next(df.select("user_id", "timestamp", "row_id", "action"), "following", "user_id", "action", hot=hot)
    pairs = ordered.where("following is not null").groupBy("user_id", "action", "following").count()
    found = pairs.groupBy("user_id").agg((F.max("count") / F.sum("count")).alias("common_transition_prob"), F.count(F.lit(1)).alias("unique_transitions"))
    out = df.select("user_id").distinct().join(found, "user_id", "left")
    return out.select("user_id", F.coalesce("common_transition_prob", F.lit(0.0)).alias("common_transition_prob"), F.coalesce("unique_transitions", F.lit(0)).alias("unique_transitions"))


def sequence_features(df: DataFrame, base: DataFrame | None = None, hot: Hot | None = None, tasks: int | None = None) -> DataFrame:
    """tasks: as in with_stats."""
    base = df if base is None else base
    found = [action_entropy(base), transitions(base, hot)]
    for stats in [f.repartition(tasks, "user_id") for f in found] if tasks else found:
        df = df.join(stats, "user_id", "left")
    return df


def resource_diversity(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg((F.countDistinct("resource") / F.count(F.lit(1))).alias("resource_diversity"))


def velocity_features(df: DataFrame, sigmas: float = BURST_SIGMAS, rows: int = ROWS, hot: Hot | None = None) -> DataFrame:
    """action_velocity, its rolling mean and deviation, is_burst. With 5 rows no value exceeds 1.79 sigmas."""
    gap = F.col("time_between_actions_in_session")
    df = df.withColumn("action_velocity", F.coalesce(F.lit(1.0) / F.nullif(gap, F.lit(0.0)), F.lit(1.0)))
    spread = lambda w: {"velocity_mean": F.avg("action_velocity").over(w), "velocity_std": F.coalesce(F.stddev_samp("action_velocity").over(w), F.lit(0.0))}
    df = windows.with_recent(df, "user_id", rows, spread, hot=hot)
    high = F.col("action_velocity") > F.col("velocity_mean") + sigmas * F.col("velocity_std")
    return df.withColumn("is_burst", scalars.flag(high & (F.col("velocity_std") > 0)))


def advanced_features(df: DataFrame, base: DataFrame | None = None, hot: Hot | None = None) -> DataFrame:
    return with_stats(velocity_features(df, hot=hot), "user_id", ["resource_diversity"], base)


def temporal_features(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    ts, hour = F.col("timestamp"), F.hour("timestamp")
    df = with_stats(df, "user_id", ["hour_mean", "hour_std"], base)
    df = with_stats(df, "session_id", ["session_start_hour", "session_end_hour"], base)
    df = df.withColumns({n: scalars.day_part(ts, lo, lo + 6) for n, lo in (("is_early_morning", 0), ("is_morning", 6), ("is_afternoon", 12), ("is_evening", 18))})
    df = df.withColumn("minute", F.minute(ts))
    df = df.withColumn("hours_from_mean", F.coalesce(F.abs(hour - F.col("hour_mean")), F.lit(0.0)))
    span = F.coalesce(F.col("session_end_hour") - F.col("session_start_hour"), F.lit(0))
    return df.withColumn("session_hour_span", F.when(F.col("session_id").isNotNull(), span).otherwise(0))


def privileged_defaults(df: DataFrame) -> DataFrame:
    """Missing privileged columns become typed defaults; null flags are false, null durations 0."""
    for name, kind, default in (("is_privileged_session", "boolean", False), ("policy_violation", "boolean", False), ("session_duration_seconds", "double", 0.0)):
        df = df.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in df.columns else F.lit(default))
    for name, default in (("privileged_account_used", "none"), ("vault_name", "none")):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    for name in ("reason_for_access", "ticket_id"):
        df = df if name in df.columns else df.withColumn(name, F.lit(None).cast("string"))
    return df


def privileged_features(df: DataFrame, sigmas: float = 3.0, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    priv = F.col("is_privileged_session")
    df = with_stats(df, "user_id", ["priv_duration_min", "priv_duration_max", "priv_duration_mean", "priv_duration_std", "policy_violation_count", "total_actions_count"], base)
    mean, std, length = F.col("priv_duration_mean"), F.col("priv_duration_std"), F.col("session_duration_seconds")
    df = df.withColumns({
        "is_long_session": scalars.flag(priv & (length > mean + sigmas * std)), "is_short_session": scalars.flag(priv & (length < mean - sigmas * std)),
        "is_privileged": priv.cast("int"),
        "missing_reason": scalars.flag(priv & F.col("reason_for_access").isNull()), "missing_ticket": scalars.flag(priv & F.col("ticket_id").isNull()),
    })
    df = df.withColumn("policy_violation_ratio", scalars.ratio(F.col("policy_violation_count"), F.col("total_actions_count"), 0.0))
    return privileged_values(df, base, counts)


def privileged_values(df: DataFrame, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    if "top_vault" in df.columns:
        return df
    df = bucket_top(df, "top_priv_account", "privileged_account_used", 10, "other_priv_account", base, counts)
    return bucket_top(df, "top_vault", "vault_name", 5, "other_vault", base, counts)


def pair_name() -> Column:
    return F.concat_ws("_", filled("action"), filled("resource"))


def pair_bucket(df: DataFrame, n: int = 20, base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """`pair`: action and resource, the n most frequent by name and the others together."""
    base = (df if base is None else base).withColumn("__pair", pair_name())
    return bucket_top(df.withColumn("__pair", pair_name()), "pair", "__pair", n, "other_pair", base, counts).drop("__pair")


def one_hot(df: DataFrame, column: str, values: Sequence[str], drop: bool = True) -> DataFrame:
    """<column>_<value> as 0.0 or 1.0; nothing to encode where there is one value."""
    if len(values) > 1:
        df = df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})
    return df.drop(column) if drop else df
