"""Readers, generators, files and set operations."""

from __future__ import annotations

import io
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import sets
from vigilframe.schema import EVENT
from vigilframe.sources import READERS, blocks, files, get_log_reader, read
from vigilframe.sources.synthetic import Generator
from vigilframe.streaming.micro_batch import for_each_batch, stream_logs


def test_registry():
    assert get_log_reader("AWS") is READERS["aws"]
    with pytest.raises(ValueError):
        get_log_reader("nowhere")


def test_trail_file(spark, tmp_path):
    who = {"userName": "", "principalId": None, "sessionContext": {"sessionIssuer": {"userName": "issuer"}}, "arn": "arn"}
    records = [
        {"eventTime": "2024-01-01T10:00:00Z", "eventName": "Get", "awsRegion": "r", "sourceIPAddress": "1.2.3.4", "userAgent": "ua", "requestID": "s1", "userIdentity": who, "resources": [{"resourceName": "b"}, {"resourceName": "c"}]},
        {"eventTime": "bad", "eventName": "Put", "errorMessage": "no", "userIdentity": {"arn": "arn"}, "resources": []},
        {"eventTime": "2024-01-01T10:00:00Z", "errorCode": "E", "userIdentity": None},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"Records": records}))
    (tmp_path / "b.json").write_text(json.dumps(records[:1]))
    rows = read(spark, "aws", str(tmp_path / "a.json")).collect()
    assert [c for c in rows[0].__fields__] == list(EVENT)
    assert [(r.user_id, r.resource, r.status) for r in rows] == [("issuer", "b", "success"), ("arn", "unknown", "failure"), ("unknown", "unknown", "failure")]
    assert rows[1].timestamp is None and len({r.session_id for r in rows}) == 3
    assert read(spark, "aws", str(tmp_path / "b.json")).count() == 1
    (tmp_path / "bad.json").write_text("{not json")
    assert read(spark, "aws", str(tmp_path / "bad.json")).count() == 0
    assert read(spark, "aws", str(tmp_path / "missing.json")).count() == 0


def test_activity_file(spark, tmp_path):
    records = [
        {"time": "2024-01-01T10:00:00Z", "resourceId": "/s/x/vm1", "operationName": "ns/vm/write", "resultType": "SUCCESS", "callerIpAddress": "1.1.1.1", "correlationId": "c", "identity": {"claims": {"name": "n"}}},
        {"time": "2024-01-01T10:00:00Z", "resourceId": None, "operationName": "start", "resultType": None, "identity": None},
    ]
    (tmp_path / "a.json").write_text(json.dumps(records))
    rows = read(spark, "azure", str(tmp_path / "a.json")).collect()
    assert [(r.user_id, r.action, r.resource, r.status, r.region) for r in rows] == [("n", "write", "vm1", "success", "unknown"), ("unknown", "start", "unknown", "failure", "unknown")]


def test_dataset_is_exact_and_steady(spark):
    g = Generator()
    one = g.dataset(spark, 1000, 0.2).toPandas()
    assert len(one) == 1000 and one["is_anomaly"].sum() == 200 and one["row_id"].is_unique
    assert one.equals(g.dataset(spark, 1000, 0.2).repartition(5).orderBy("timestamp", "row_id").toPandas())
    assert one.groupby("user_id")["role"].nunique().max() == 1
    assert not one.isna().any().any()
    assert (one["timestamp"] >= one["session_start"]).all() and (one["timestamp"] <= one["session_end"]).all()
    assert one.loc[~one["is_anomaly"], "ip_address"].str.startswith("192.168.").all()
    assert g.normal_log(spark, 123).count() == 123
    assert g.inject_anomalies(g.normal_log(spark, 100), 0.1).where("is_anomaly").count() == 10
    fixture = g.fixture(spark).groupBy("is_anomaly").count().collect()
    assert {r.is_anomaly: r["count"] for r in fixture}[False] == 99


def test_privileged(spark):
    rows = Generator().privileged(spark, 500, 0.2).toPandas()
    assert len(rows) == 500 and 0.1 < rows["is_anomaly"].mean() < 0.3
    assert rows["session_duration_seconds"].min() >= 10


def test_csv_round_trip(spark, tmp_path):
    df = Generator().dataset(spark, 50)
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out")).select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_validate_and_clean(spark):
    full = "timestamp string, user_id string, action string, ip_address string, status string"
    row = ("2024-01-01", "u", "a", "1.1.1.1", "success")
    assert sets.validate(spark.createDataFrame([row], full))
    assert not sets.validate(spark.createDataFrame([], full))
    assert not sets.validate(spark.createDataFrame([row], full).drop("user_id"))
    assert not sets.validate(spark.createDataFrame([row[:1] + (None,) + row[2:]], full))
    out = sets.clean(sets.standardize(spark.createDataFrame([(None, None, None, None, None)], full))).first()
    assert out.user_id == "unknown" and len(out.session_id) == 32
    assert sets.sample_rows(spark.range(100).withColumnRenamed("id", "row_id"), 7).count() == 7
    assert sets.union(spark.range(1).toDF("id"), spark.range(1).select("id", F.lit(1).alias("x"))).columns == ["id", "x"]


def test_logs_in_micro_batches(spark, tmp_path):
    """File by file, the stream gives the events of the whole read."""
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(4):
        some = [{"eventTime": f"2024-01-01T1{i}:00:00Z", "eventName": f"e{i}-{k}", "userIdentity": {"userName": f"u{k}"}, "sourceIPAddress": "1.2.3.4", "requestID": f"s{i}"} for k in range(3)]
        (logs / f"{i}.json").write_text(json.dumps({"Records": some} if i % 2 else some))
    (logs / "bad.json").write_text("{not json")
    seen: list = []
    numbers: list = []
    query = for_each_batch(stream_logs(spark, "AWS", str(logs)), f"file://{tmp_path}/state", lambda df, n: (numbers.append(n), seen.extend(tuple(r) for r in df.collect())), adapt=lambda df: df)
    query.awaitTermination()
    assert len(numbers) == 5
    assert sorted(seen) == sorted(tuple(r) for r in read(spark, "aws", str(logs)).collect()) and len(seen) == 12


def cut(text: bytes, block: int) -> list[bytes]:
    """The records of a text by blocks, without Spark."""
    f, rows = io.BytesIO(text), []
    for start in range(0, len(text), block):
        first, end = blocks.border(f, start, len(text)), blocks.border(f, start + block, len(text))
        head, data = text[max(0, first - blocks.BEHIND) : first], text[first:end]
        found = blocks.marks(data)
        rows.append(("f", len(text), start, *blocks.summary(head, data, found, False), *blocks.summary(head, data, found, True)))
    states = blocks.chain(pd.DataFrame(rows, columns=["path", "length", "start", "out_ends", "out_pops", "out_opens", "in_ends", "in_pops", "in_opens"]))
    return [r for s in states.itertuples() for r in blocks.records_in(f, len(text), s.start, block, s.inside, s.stack)]


def test_records_by_blocks():
    """Wherever the cuts fall, strings, escapes, nested arrays and other keys included, the records are those of a JSON parser."""
    rng = random.Random(3)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "Records", "é", "x", '\\"', "\\\\", "\n"]
    word = lambda: "".join(rng.choices(bits, k=rng.randrange(6)))
    for trial in range(9):
        records = [{"eventName": word(), "Records": [{"a": word()}], "n": {word(): [word(), {"b": [[], {}]}]}} for _ in range(rng.randrange(6))]
        roots = [records, {"Records": records}, {"first": [{"no": word()}], "Records": records, "last": {"Records": [{"no": 1}]}, word(): [{"no": 2}]}]
        for root in roots:
            if isinstance(root, dict) and root.get("Records") is not records:
                continue
            text = json.dumps(root, indent=trial % 3 or None, ensure_ascii=trial % 2 == 0).encode()
            for block in (1, 7, 64, 5000):
                assert [json.loads(r) for r in cut(text, block)] == records
    assert cut(b"", 4) == cut(b"[]", 1) == cut(b'{"Records": null}', 3) == cut(b"{not json", 2) == cut(b"null", 2) == []
    assert cut(b'[{"a": 1}, null, 3, "{}", {"a": 2}, {"a": ', 5) == [b'{"a": 1}', b'{"a": 2}']
    long = {"Records": [{"a": "x" * 300_000}, {"b": 1}]}
    assert [json.loads(r) for r in cut(json.dumps(long).encode(), 1000)] == long["Records"]


def test_large_logs(spark, tmp_path):
    """Equal to the whole reader on sound files; of broken ones the sound records stay; several tasks read one file."""
    who = {"userName": None, "sessionContext": {"sessionIssuer": {"userName": 'a "quoted\\ {name'}}}
    records = [{"eventTime": f"2024-01-01T10:{i % 60:02}:00Z", "eventName": f"e{i}", "userIdentity": who if i % 3 else None, "requestID": f"s{i}", "resources": [{"resourceName": "r]"}, {"resourceName": "}"}]} for i in range(500)]
    records.append({"eventTime": 5, "eventName": ["of another type"], "requestID": "odd"})
    sound = tmp_path / "sound"
    sound.mkdir()
    (sound / "a b.json").write_text(json.dumps({"version": [{"eventName": "no"}], "Records": records}))
    (sound / "b.json").write_text(json.dumps(records[:40], indent=2))
    (sound / "c.json").write_text("")
    whole, cut_up = read(spark, "aws", str(sound)), read(spark, "aws", str(sound), block=4096)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut_up.collect())) and cut_up.count() == 541
    texts = blocks.record_texts(spark, str(sound / "a b.json"), 4096)
    assert texts.groupBy(F.spark_partition_id()).count().count() > 4
    broken = tmp_path / "broken.json"
    broken.write_text('{"Records": [{"eventName": "one"}, {"eventName": oops}, {"eventName": "two"}, {"eventName": "cut o')
    assert [r.action for r in read(spark, "aws", str(broken), block=16).orderBy("action").collect()] == ["one", "two"]
    assert read(spark, "aws", str(tmp_path / "missing.json"), block=16).count() == 0
    assert read(spark, "azure", str(sound / "c.json"), block=16).count() == 0
