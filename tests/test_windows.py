"""Time windows with ties, by hand and by brute force."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from vigilframe.operators import features, slices, windows

SCHEMA = "user_id string, row_id long, timestamp timestamp, action string"


def at(minutes: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minutes)


def test_hand_computed_windows(spark):
    rows = [("u", 1, at(0), "a"), ("u", 2, at(1), "b"), ("u", 3, at(1), "a"), ("u", 4, at(2), "c"), ("u", 5, at(60), "d"), ("u", 6, at(61), "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    df = windows.trailing_count(df, "n", "user_id", 60)
    df = windows.trailing_distinct(df, {"d": "action"}, "user_id", 3600)
    assert [(r.n, r.d) for r in df.orderBy("row_id").collect()] == [(1, 1), (1, 2), (2, 2), (1, 3), (1, 4), (1, 2)]


def test_ties_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(3)}", i, at(rng.randrange(30)), rng.choice("abc") if rng.random() < 0.9 else None) for i in range(120)]
    df = windows.trailing_distinct(windows.trailing_count(spark.createDataFrame(rows, SCHEMA), "n", "user_id", 300), {"d": "action"}, "user_id", 300)
    for r in df.repartition(3).collect():
        seen = [x for x in rows if x[0] == r.user_id and r.timestamp - dt.timedelta(minutes=5) < x[2] and (x[2] < r.timestamp or x[2] == r.timestamp and x[1] <= r.row_id)]
        assert r.n == len(seen)
        assert r.d == len({x[3] for x in seen} - {None})


def test_rows_without_time_count_nothing(spark):
    df = spark.createDataFrame([("u", 1, None, "a"), ("u", 2, at(0), "b")], SCHEMA)
    df = windows.trailing_distinct(windows.trailing_count(df, "n", "user_id", 60), {"d": "action"}, "user_id", 60)
    assert {r.row_id: (r.n, r.d) for r in df.collect()} == {1: (0, 0), 2: (1, 1)}


def test_running_distinct_ignores_nulls(spark):
    df = spark.createDataFrame([("u", i, at(i), a) for i, a in enumerate(["x", None, "x", "y"])], SCHEMA)
    out = windows.running_distinct(df, "n", "user_id", "action").orderBy("row_id").collect()
    assert [r.n for r in out] == [1, 1, 1, 2]


def test_sequences_by_user_and_global(spark):
    df = spark.createDataFrame([(f"u{i % 2}", i, at(i), "a") for i in range(6)], SCHEMA).withColumn("x", F.col("row_id").cast("double"))
    mine = {r.row_id: r.sequence for r in windows.sequences(df, ["x"], 2).collect()}
    assert mine[0] is None and mine[4] == [[2.0], [4.0]]
    every = {r.row_id: r.sequence for r in windows.sequences(df, ["x"], 2, key=None).collect()}
    assert every[4] == [[3.0], [4.0]]


def test_burst_never_exceeds_two_sigmas_in_five_rows(spark):
    rng = random.Random(1)
    rows = [("u", i, at(rng.randrange(10_000)), "a") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("time_between_actions_in_session", F.pmod(F.xxhash64("row_id"), F.lit(900)).cast("double"))
    assert features.velocity_features(df).agg(F.sum("is_burst")).first()[0] == 0
    assert features.velocity_features(df, sigmas=1.5).agg(F.sum("is_burst")).first()[0] > 0


def test_entropy_and_transitions(spark):
    df = spark.createDataFrame([("u", i, at(i), a) for i, a in enumerate("abab")] + [("v", 9, at(0), "a")], SCHEMA)
    entropy = {r.user_id: r.action_entropy for r in features.action_entropy(df).collect()}
    assert entropy["u"] == 1.0 and abs(entropy["v"]) == 0.0
    steps = {r.user_id: (round(r.common_transition_prob, 6), r.unique_transitions) for r in features.transitions(df).collect()}
    assert steps == {"u": (0.666667, 2), "v": (0.0, 0)}


def test_busy_user_takes_no_frames(spark):
    """A user with 300,000 rows in one window: no row gathers the others, and the count is right."""
    n = 300_000
    rows = spark.range(n).select(F.lit("u").alias("user_id"), F.col("id").alias("row_id"), F.timestamp_micros(F.col("id")).alias("timestamp"), F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(1000))).alias("action"))
    out = windows.trailing_distinct(rows, {"d": "action"}, "user_id", 3600)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan
    assert out.agg(F.max("d"), F.min("d"), F.count("d")).first() == (1000, 1, n)


def test_group_values_are_no_windows(spark):
    """Counts of a busy user are combined before the shuffle; rows without a key form a group without session counts."""
    rows = [("u", 1, "s", "success", 3.0), ("u", 2, "s", "failure", 5.0), (None, 3, None, "success", 1.0), (None, 4, None, "success", 2.0)]
    df = spark.createDataFrame(rows, "user_id string, row_id long, session_id string, status string, session_duration_seconds double")
    df = df.selectExpr("*", "timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, row_id) as timestamp", "true as is_privileged_session", "false as policy_violation", "'r' as resource", "status as action", "'i' as ip_address", "'g' as region", "'a' as user_agent")
    out = features.with_stats(features.with_stats(df, "user_id", list(features.USER)), "session_id", list(features.SESSION))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row_id: (r.success_count, r.priv_duration_mean, r.actions_per_session, r.distinct_actions_per_session, r.session_start_hour) for r in out.collect()}
    assert got == {1: (1, 4.0, 2, 2, 11), 2: (1, 4.0, 2, 2, 11), 3: (2, 1.5, 0, 0, 13), 4: (2, 1.5, 0, 0, 13)}


def _busy(spark, n, share=2):
    """Events of which one user has every second one, with ties in time and null values."""
    rng = random.Random(9)
    rows = [("hot" if i % share == 0 else f"u{rng.randrange(6)}", i, at(rng.randrange(n // 4)), rng.choice("abcd") if rng.random() < 0.9 else None) for i in range(n)]
    return spark.createDataFrame([*rows, ("hot", n, None, "a"), (None, n + 1, at(3), "b")], SCHEMA)


def _all_windows(df):
    df = windows.trailing_distinct(windows.trailing_count(df, "n", "user_id", 300), {"d": "action"}, "user_id", 300)
    df = windows.running_distinct(windows.with_gap(df, "gap", "user_id"), "so_far", "user_id", "action")
    df = windows.with_next(windows.with_recent(df, "user_id", 5, lambda w: {"mean_gap": F.round(F.avg("gap").over(w), 6)}), "following", "user_id", "action")
    return windows.sequences(df.withColumn("x", F.col("row_id").cast("double")), ["x", "gap"], 4)


def test_slices_equal_whole_keys(spark, monkeypatch):
    df = _busy(spark, 600).persist()
    whole = {r.row_id: r for r in _all_windows(df).collect()}
    monkeypatch.setattr(slices, "HOT_ROWS", 100)
    monkeypatch.setattr(slices, "SLICE_ROWS", 16)
    assert slices.hot_keys(df, "user_id").keys.collect() == [("hot",)]
    cut = {r.row_id: r for r in _all_windows(df).collect()}
    assert cut == whole and len(cut) == 602
    assert slices.hot_keys(df.where("user_id is null"), "user_id").keys is None


def test_hot_null_key_is_sliced(spark, monkeypatch):
    monkeypatch.setattr(slices, "HOT_ROWS", 20)
    monkeypatch.setattr(slices, "SLICE_ROWS", 8)
    df = spark.createDataFrame([(None, i, at(i), "a") for i in range(50)], SCHEMA)
    assert [r.n for r in windows.trailing_count(df, "n", "user_id", 180).orderBy("row_id").collect()] == [1, 2, *[3] * 48]


def test_no_task_holds_a_hot_user(spark, monkeypatch):
    """Half of the rows are one user's, yet the largest task has less than twice the mean."""
    monkeypatch.setattr(slices, "HOT_ROWS", 100_000)
    monkeypatch.setattr(slices, "SLICE_ROWS", 2_000)
    user = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("string")))
    df = spark.range(2_000_000).select(user.alias("user_id"), F.col("id").alias("row_id"), F.timestamp_seconds(F.col("id") * 7).alias("timestamp"), F.concat(F.lit("a"), (F.col("id") % 5).cast("string")).alias("action"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = windows.with_recent(windows.trailing_count(df, "n", "user_id", 60), "user_id", 5, lambda w: {"newest": F.max("row_id").over(w)})
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 2_000_000 and max(tasks) < 2 * sum(tasks) / len(tasks)
    # The hot user has a row every 14 seconds.
    assert out.where("user_id = 'hot' and row_id > 100").agg(F.min("n"), F.max("n"), F.sum((F.col("newest") != F.col("row_id")).cast("int"))).first()[:] == (5, 5, 0)


def test_global_sequences_need_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 16)
    df = spark.createDataFrame([(f"u{i % 7}", i, at(i % 50), "a") for i in range(300)], SCHEMA).withColumn("x", F.col("row_id").cast("double"))
    out = windows.sequences(df, ["x"], 10, key=None)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    order = sorted(range(300), key=lambda i: (i % 50, i))
    want = {i: [[float(x)] for x in order[k - 9 : k + 1]] if k >= 9 else None for k, i in enumerate(order)}
    assert {r.row_id: r.sequence for r in out.collect()} == want


def test_large_samples_are_the_small_ones(spark, monkeypatch):
    from vigilframe.operators import sets

    df = spark.range(3000).withColumnRenamed("id", "row_id").repartition(5)
    small = {r.row_id for r in sets.sample_rows(df, 700).collect()}
    monkeypatch.setattr(sets, "FEW", 10)
    large = sets.sample_rows(df, 700)
    assert {r.row_id for r in large.collect()} == small and len(small) == 700 and large.columns == ["row_id"]
