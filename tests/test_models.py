"""Contracts of the models, and streams against batches."""

from __future__ import annotations

import shutil
from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from vigilframe.models.ensemble import HybridDetector, Parameters
from vigilframe.models.recurrent import Training
from vigilframe.models.stages import HybridEstimator
from vigilframe.operators import features as X
from vigilframe.models import coding
from vigilframe.models import forest as forest_module
from vigilframe.models.experiments import ExperimentLog
from vigilframe.models.forest import RandomForest
from vigilframe.models.isolation import IsolationForest
from vigilframe.operators import quantiles, slices
from vigilframe.operators.scaling import Scaler
from vigilframe.plans.pipeline import Encoder, extract
from vigilframe.schema import FIXED_FEATURES
from vigilframe.operators import windows
from vigilframe.plans.models import records_of_a_log, write_slices
from vigilframe.session import materialize
from vigilframe.sources.events import from_events, from_events_unwindowed
from vigilframe.sources.synthetic import Generator
from vigilframe.streaming.keyed import carried, user_features
from vigilframe.streaming.micro_batch import RAW, for_each_batch, stream_raw, windowed_counts

SMALL = Parameters(contamination=0.2, n_trees=30, forest_trees=10, forest_depth=6, sequence_length=4, components=3, training=Training(units=8, epochs=3, batch=256))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"u{i % 5}", *map(float, rng.normal(size=3) + (8 if i % 50 == 0 else 0))) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, user_id string, a double, b double, c double").withColumn("timestamp", F.timestamp_seconds(F.col("row_id") * 60))
    return df.persist()


def test_isolation_forest(spark, points):
    forest = IsolationForest.fit(points, ["a", "b", "c"], n_trees=50)
    again = IsolationForest.fit(points.repartition(7), ["a", "b", "c"], n_trees=50)
    assert forest.trees == again.trees
    s = forest.score(points).select("row_id", "anomaly_score").toPandas()
    assert s["anomaly_score"].between(0, 1).all()
    assert set(s.nlargest(10, "anomaly_score")["row_id"]) == set(range(0, 500, 50))
    assert IsolationForest.from_json(forest.to_json()).trees == forest.trees


@pytest.mark.parametrize("kind", ["recurrent", "pca"])
def test_hybrid(spark, points, tmp_path, kind):
    settings = replace(SMALL, sequence_model=kind)
    with pytest.raises(ValueError):
        HybridDetector(settings).predict(points)
    with pytest.raises(ValueError):
        HybridDetector(replace(SMALL, sequence_model="other"))
    steps = []
    model = HybridDetector(settings, steps.append).fit(points, ["a", "b", "c"])
    assert [s for s in steps if "epoch" not in s] == ["scale", "isolation forest", "sequences", "random forest"]
    out = model.predict(points).orderBy("row_id").toPandas()
    assert len(out) == 500 and set(out["is_anomaly_predicted"]) <= {0, 1}
    assert abs(out["is_anomaly_predicted"].mean() - 0.2) < 0.1
    assert out.loc[out["row_id"] % 50 == 0, "is_anomaly_predicted"].mean() > 0.8
    assert out["a"].equals(points.orderBy("row_id").toPandas()["a"])
    weights = list(model.explain().values())
    assert weights == sorted(weights, reverse=True) and abs(sum(weights) - 1) < 1e-6
    model.save(spark, f"file://{tmp_path}/m")
    loaded = HybridDetector.load(spark, f"file://{tmp_path}/m").predict(points.repartition(3)).orderBy("row_id").toPandas()
    assert loaded["is_anomaly_predicted"].equals(out["is_anomaly_predicted"])


def test_windows_follow_the_global_order(spark, points):
    model = HybridDetector(SMALL)
    model.columns, model.extra, model.scaler = ["a", "b"], None, Scaler({"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0})
    got = {r.row_id: r["__flat"] for r in model._windows(points).collect()}
    rows = {r.row_id: (r.a, r.b) for r in points.collect()}
    assert got[2] is None and all(got[i] == [v for k in range(i - 3, i + 1) for v in rows[k]] for i in range(3, 500))


def test_detector_with_extra_features_in_a_pipeline(spark, points, tmp_path):
    more = F.when(F.col("row_id") % 50 == 0, F.array(F.struct(F.lit(77).alias("i"), F.lit(9.0).alias("v")))).otherwise(F.array(F.struct((3 + F.col("row_id") % 4).cast("int").alias("i"), F.lit(1.0).alias("v"))))
    df = points.withColumn("more", more)
    stage = HybridEstimator(inputCols=["a", "b", "c"], extraCol="more", contamination=0.1, n_trees=30, forest_trees=10, sequence_length=4, units=8, epochs=2)
    stage.write().overwrite().save(f"file://{tmp_path}/stage")
    assert HybridEstimator.load(f"file://{tmp_path}/stage").parameters() == stage.parameters()
    model = Pipeline(stages=[stage]).fit(df)
    out = model.transform(df).select("row_id", "anomaly_score", "is_anomaly_predicted").orderBy("row_id").toPandas()
    assert out.loc[out["row_id"] % 50 == 0, "is_anomaly_predicted"].mean() > 0.8
    model.write().overwrite().save(f"file://{tmp_path}/pipeline")
    loaded = PipelineModel.load(f"file://{tmp_path}/pipeline")
    assert loaded.stages[0].parameters() == stage.parameters() and loaded.stages[0].uid == model.stages[0].uid
    again = loaded.transform(df).select("row_id", "anomaly_score", "is_anomaly_predicted").orderBy("row_id").toPandas()
    assert again.equals(out)
    assert set(loaded.stages[0].detector.importances()) <= {*range(7), 77}


def test_pipeline_gives_all_features(spark):
    events = Generator(n_users=10).dataset(spark, 120).persist()
    odd = F.when(F.col("row_id") % 2 == 0, "a b").otherwise(F.when(F.col("row_id") % 3 == 0, "a.b").otherwise(F.col("role")))
    steps = []
    x = extract(events.withColumn("role", odd), steps.append, v6=False).persist()
    encoder = Encoder.fit(x)
    f = encoder.transform(x).toPandas()
    assert len(FIXED_FEATURES) == 48 and len(f) == 120 and "privileged" in steps
    assert not f[list(FIXED_FEATURES)].isna().any().any()
    names = encoder.names(sorted({e["i"] for row in f["extra"] for e in row}))
    assert {"role_a b", "role_a.b"} <= set(names.values())  # values that differ in a sign are two features
    rows, number = {r["row_id"]: r for r in x.collect()}, {n: i for i, n in names.items()}
    for row in f.itertuples():
        have, source = {e["i"]: e["v"] for e in row.extra}, rows[row.row_id]
        assert have[number[f"role_{source['role']}"]] == 1.0
        assert have[number[f"action_{source['action']}_count"]] == sum(r["user_id"] == source["user_id"] and r["action"] == source["action"] for r in rows.values())
    x.unpersist()


def test_counts_of_values_take_one_scan(spark, sf_dir):
    base = from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    plan = X.value_counts(base, {n: c() for n, c in X.COUNTED.items()})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_percentiles_by_radix_selection(spark):
    rng = np.random.default_rng(1)
    tiny, huge = 5e-324, 1.7e308
    tables = (rng.normal(size=3000), np.r_[np.zeros(2500), rng.random(3), 1e12], np.array([4.0]), np.repeat([1.0, 2.0], 400), np.array([-0.0, 0.0, -tiny, tiny, -huge, huge, 3.5]))
    shares = (0.0, 0.5, 0.65, 0.9, 0.999, 1.0)
    for x in tables:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        with np.errstate(over="ignore", invalid="ignore"):
            want = [np.quantile(x / 4, s) * 4 for s in shares]
        assert quantiles.percentiles(df, "x", shares) == pytest.approx(want, rel=1e-12, abs=1e-12)
        ranks = [0, len(x) // 2, len(x) - 1, len(x)]
        assert quantiles.order_statistics(df, "x", ranks) == [*np.sort(x)[ranks[:3]], None]
    assert quantiles.percentile(df.limit(0), "x", 0.5) is None


def test_percentiles_of_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(float(v),) for v in [*range(20), inf]] + [(-inf,)] * 2, "x double")
    assert quantiles.percentiles(df, "x", [0.0, 0.03, 0.5, 0.99, 1.0]) == [-inf, -inf, 9.0, inf, inf]
    assert quantiles.order_statistics(df, "x", [1, 2, 21, 22]) == [-inf, 0.0, 19.0, inf]


def test_any_number_of_places_takes_the_same_passes(spark):
    df = spark.range(5000).select((F.col("id") * 0.5).alias("x"))
    jobs = {}
    for ranks in ([17], range(0, 5000, 7)):
        spark.sparkContext.setJobGroup(f"places-{len(ranks)}", "")
        assert quantiles.order_statistics(df, "x", ranks) == [k * 0.5 for k in ranks]
        jobs[len(ranks)] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"places-{len(ranks)}"))
    spark.sparkContext.setJobGroup("others", "")
    assert jobs[715] <= jobs[1] + 1


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    s = Scaler.fit(df, ["a", "b"])
    assert [tuple(r) for r in Scaler.from_json(s.to_json()).transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    seen: list = []
    for_each_batch(stream_raw(spark, sf_dir), f"file://{tmp_path}/s", lambda df, n: seen.extend(r.row_id for r in df.select("row_id").collect())).awaitTermination()
    assert sorted(seen) == sorted(r.row_id for r in from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).select("row_id").collect())
    q = windowed_counts(stream_raw(spark, sf_dir)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/w").start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("events")).first()[0] == len(seen)


def _marked(spark, n=600):
    """Rows of which an extra feature, or a sum of two dense ones, makes the label."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(n, 3)), []
    rows = []
    for i in range(n):
        more = [(3 + int(k), float(rng.integers(1, 5))) for k in rng.choice(40, 3, replace=False)]
        y.append(int(any(f == 7 for f, _ in more) or x[i, 0] > 1.2))
        rows.append((i, *map(float, x[i]), more, y[-1]))
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, more array<struct<i:int,v:double>>, y int").persist()


def test_random_forest(spark):
    df = _marked(spark)
    forest = RandomForest.fit(df, ["a", "b", "c"], F.col("y"), extra="more", n_trees=30)
    again = RandomForest.fit(df.repartition(5), ["a", "b", "c"], F.col("y"), extra="more", n_trees=30)
    assert forest.trees == again.trees and forest.importances == again.importances
    got = forest.score(df, "p", extra="more").select("y", "p").toPandas()
    assert ((got["p"] > 0.5) == (got["y"] == 1)).mean() > 0.97
    top = sorted(forest.importances, key=forest.importances.get, reverse=True)[:2]
    assert set(top) == {0, 7} and abs(sum(forest.importances.values()) - 1) < 1e-9
    loaded = RandomForest.from_json(forest.to_json())
    assert loaded.trees == forest.trees and loaded.importances == forest.importances
    # No node of fewer rows than min_split is split, and depth is bounded.
    assert max(len(t) for t in RandomForest.fit(df, ["a"], F.col("y"), n_trees=3, depth=2).trees) <= 7
    assert all(len(t) == 1 for t in RandomForest.fit(df, ["a"], F.col("y"), n_trees=3, min_split=10_000).trees)
    with pytest.raises(ValueError):
        RandomForest.fit(df.where("y = 1"), ["a"], F.col("y"))


def test_grown_tree_separates_its_rows():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (300, 4)).astype(float), rng.integers(0, 2, 300)
    rows = forest_module.Rows.from_lists(x.tolist(), [[]] * 300)
    ones = np.ones(300)
    nodes, removed = forest_module.grow(rows, y, ones, ones, np.random.default_rng(0), 40, 2)
    share = forest_module.leaves(x, np.array(nodes, float), {f: f for f in range(4)})
    for v in {tuple(r) for r in x.tolist()}:
        same = (x == v).all(axis=1)
        assert share[same] == pytest.approx(y[same].mean())
    # What all cuts remove is the root's impurity less that of the leaves.
    start = 2 * y.sum() * (1 - y.mean())
    assert sum(removed.values()) == pytest.approx(start - (2 * share * (1 - share)).sum())


def test_isolation_forest_with_extra_features(spark):
    rows = [(i, float(i % 7), [(1, 1.0)] if i % 100 else [(1, 1.0), (9, 50.0)]) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, a double, more array<struct<i:int,v:double>>")
    model = IsolationForest.fit(df, ["a"], n_trees=60, extra="more")
    s = model.score(df, extra="more").select("row_id", "anomaly_score").toPandas()
    assert set(s.nlargest(5, "anomaly_score")["row_id"]) == set(range(0, 500, 100))
    assert IsolationForest.fit(df, ["a"], n_trees=5).score(df.limit(0)).count() == 0


def test_keyed_state_survives_a_restart(spark, sf_dir, tmp_path):
    """Half of the files, then the rest from the checkpoint, give what all files at once and the batch do."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 400")
    write_slices(raw, f"file://{tmp_path}/all")
    files = sorted((f for f in (tmp_path / "all").glob("*.parquet")), key=lambda f: f.stat().st_mtime)
    assert len(files) == 4
    (tmp_path / "some").mkdir()
    for some in (files[:2], files[2:]):
        for f in some:
            shutil.copy2(f, tmp_path / "some" / f.name)
        found = user_features(from_events_unwindowed(stream_raw(spark, f"file://{tmp_path}/some", "*.parquet")), 86400.0)
        found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r.row_id: r[2:] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = windows.trailing_count(windows.with_gap(from_events(raw), "gap", "user_id"), "n", "user_id", 86400.0)
    assert len(got) == 400
    for r in batch.collect():
        assert (got[r.row_id][0], got[r.row_id][1]) == (pytest.approx(r.gap), r.n)


def test_carried_windows_by_hand():
    gaps, counts, left = carried(np.array([10, 10, 70, 200]) * 1_000_000, 5_000_000, np.array([5]) * 1_000_000, 60_000_000)
    assert gaps.tolist() == [5, 0, 60, 130] and counts.tolist() == [2, 3, 1, 1] and left.tolist() == [200_000_000]


def test_experiments_count_once_and_whole(spark, tmp_path):
    log = ExperimentLog(spark, f"file://{tmp_path}/log", "run string, f1 double")
    row = lambda run, f1: spark.createDataFrame([(f1, run, "x")], "f1 double, run string, other string")
    assert log.rows().count() == 0
    assert log.append("a/b", row("a/b", 0.5)) and not log.append("a/b", row("a/b", 0.9))
    # A writer that died: files, but no mark that they are all.
    row("c", 0.1).write.parquet(log._folder("c"))
    (tmp_path / "log" / log._folder("c").rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert [tuple(r) for r in log.rows().collect()] == [("a/b", 0.5)]
    assert log.append("c", row("c", 0.7))
    assert sorted(tuple(r) for r in log.rows().collect()) == [("a/b", 0.5), ("c", 0.7)]


def test_more_rows_make_more_tasks(spark, sf_dir, monkeypatch):
    events = from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    one = extract(events, v6=False)
    monkeypatch.setattr(slices, "TASK_ROWS", 100)
    many = extract(events, v6=False)
    assert many.rdd.getNumPartitions() >= 10 > one.rdd.getNumPartitions()
    assert many.orderBy("row_id").select("row_id", *FIXED_FEATURES).toPandas().equals(one.orderBy("row_id").select("row_id", *FIXED_FEATURES).toPandas())
    extracted = materialize(many, "extracted")
    assert Encoder.fit(extracted).transform(extracted).rdd.getNumPartitions() >= 10


def test_trees_walked_together_reach_the_leaves_of_each():
    rng = np.random.default_rng(3)
    trees = [np.array([[-1, 0, -1, -1, 0.25]]), np.array([[1, 0.5, 1, 2, 0.0], [-1, 0, -1, -1, 1.0], [0, 0.3, 3, 4, 0.0], [-1, 0, -1, -1, 2.0], [-1, 0, -1, -1, 3.0]])]
    x = rng.random((50, 2))
    x[0], x[1] = (0.3, 0.5), (np.nan, np.nan)

    def walk(row, nodes):
        at = 0
        while nodes[at][0] >= 0:
            at = int(nodes[at][2] if row[int(nodes[at][0])] < nodes[at][1] else nodes[at][3])
        return nodes[at][4]

    found = forest_module.Leveled.of(trees, {0: 0, 1: 1}).leaves(x)
    assert found.tolist() == [[walk(row, t) for row in x] for t in trees]


def test_large_tables_make_larger_logs():
    assert [records_of_a_log(n) for n in (1000, 100_000, 600_000, 36_000_000)] == [1000, 1000, 6000, 20_000]


def test_rows_without_a_time_keep_their_place_in_the_keyed_state(spark, tmp_path):
    raw = spark.createDataFrame([(1, None, 1, "click", 1.0, '{"k": 1}'), (2, datetime(2024, 1, 1), 1, "error", 1.0, '{"k": 1}'), (3, datetime(2024, 1, 1, 0, 0, 5), 1, None, 1.0, '{"k": 1}')], RAW)
    raw.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    found = user_features(from_events_unwindowed(stream_raw(spark, f"file://{tmp_path}/in", "*.parquet")), 60.0)
    found.writeStream.format("memory").queryName("keyed_odd").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = {r["row_id"]: tuple(r)[2:] for r in spark.table("keyed_odd").collect()}
    assert rows == {1: (0.0, 0, 1, 0), 2: (0.0, 1, 1, 1), 3: (5.0, 2, 2, 1)}


def test_every_tree_draws_from_all_rows(spark):
    """Labels without a rule can only be known from the rows themselves: most trees must have drawn each."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(20_000, 4)), rng.integers(0, 2, 20_000)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(len(x))], "row_id long, a double, b double, c double, d double, y int")
    forest = RandomForest.fit(df, list("abcd"), F.col("y"), n_trees=20)
    got = forest.score(df, "p").select(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert got > 0.97


def test_nodes_split_by_counts_of_all_tasks_are_those_of_one_task(spark, monkeypatch):
    df = _marked(spark)
    fit = lambda: RandomForest.fit(df.repartition(3), ["a", "b", "c"], F.col("y"), extra="more", n_trees=5)
    score = lambda forest: forest.score(df, "p", extra="more").orderBy("row_id").toPandas()["p"].tolist()
    one = fit()
    monkeypatch.setattr(forest_module, "NODE_BYTES", 3000)
    monkeypatch.setattr(forest_module, "SENT_BYTES", 50_000)
    several = fit()
    assert several.importances == pytest.approx(one.importances) and [len(t) for t in several.trees] == [len(t) for t in one.trees]
    assert score(several) == pytest.approx(score(one))


def test_codes_come_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(coding, "CHUNK", 700)
    rng = np.random.default_rng(4)
    n = 4000
    dense = np.stack([rng.integers(-3, 4, n) / 3, np.exp(3 * rng.normal(size=n)), np.zeros(n), np.where(rng.random(n) < 0.9, 7.25, rng.random(n))], axis=1)
    # A value that one row has is told apart where a feature has few.
    dense[17, 0], dense[5, 2], dense[9, 0] = 1e9, -np.inf, np.nan
    extra = [[{"i": 9, "v": float(2 + i % 2)}] if i % 5 == 0 else [] for i in range(n)]
    rows = spark.createDataFrame(list(zip(dense.tolist(), extra, strict=True)), f"dense array<double>, extra {coding.EXTRA}")
    found = coding.coding_of(rows.repartition(3), n, 4)
    again = coding.coding_of(rows, n, 4)
    assert found.features.tolist() == [0, 1, 2, 3, 9] and all(np.array_equal(a, b) for a, b in zip(found.edges, again.edges, strict=True))
    edges = dict(zip(found.features.tolist(), found.edges, strict=True))
    assert [len(edges[f]) for f in (0, 2, 9)] == [8, 1, 2] and all(len(e) <= coding.EDGES for e in found.edges)
    codes = found.codes(coding.Rows.from_lists(dense.tolist(), extra))
    for k in (1, 3):
        sizes = np.bincount(codes[:, k])
        # No code but that of a single value holds many rows.
        assert all(s <= 3 * n / coding.EDGES or len(set(dense[codes[:, k] == c, k])) == 1 for c, s in enumerate(sizes))
