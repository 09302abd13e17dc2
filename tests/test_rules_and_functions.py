"""Rule boundaries and scalar expressions on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import network, scalars
from vigilframe.operators.rules import rule_hits, session_metrics

START = dt.datetime(2024, 1, 1, 12)
SCHEMA = "session_id string, row_id long, user_id string, timestamp timestamp, session_start timestamp, session_end timestamp, ip_address string, status string"


def session_rows(name, n=1, ips=1, failures=0, start=START, minutes=10.0):
    end = start + dt.timedelta(minutes=minutes)
    return [(name, i, "u", start, start, end, f"10.0.0.{i % ips}", "failure" if i < failures else "success") for i in range(n)]


CASES = {
    "hours_in_1": (dict(start=dt.datetime(2024, 1, 1, 9)), []), "hours_in_2": (dict(start=dt.datetime(2024, 1, 1, 17)), []),
    "hours_out_1": (dict(start=dt.datetime(2024, 1, 1, 8, 59, 59, 999999)), ["hours"]), "hours_out_2": (dict(start=dt.datetime(2024, 1, 1, 17, 0, 0, 1)), ["hours"]),
    "long_in": (dict(minutes=180), []), "long_out": (dict(minutes=180 + 1 / 60), ["duration"]),
    "many_in": (dict(n=20), []), "many_out": (dict(n=21), ["actions"]), "ips_in": (dict(n=6, ips=5), []), "ips_out": (dict(n=6, ips=6), ["ips"]),
    "fail_in": (dict(n=5, failures=1), []), "fail_out": (dict(n=5, failures=2), ["failures"]),
    "all": (dict(n=30, ips=9, failures=20, start=dt.datetime(2024, 1, 1, 3), minutes=400), ["hours", "duration", "actions", "ips", "failures"]),
}


def test_rule_boundaries(spark):
    rows = [r for name, (how, _) in CASES.items() for r in session_rows(name, **how)]
    found = {r.session_id: (r.codes, r.reasons) for r in rule_hits(session_metrics(spark.createDataFrame(rows, SCHEMA))).collect()}
    for name, (_, expected) in CASES.items():
        assert found.get(name, ([], []))[0] == expected, name
    assert len(found["all"][1]) == 5 and "66.7%" in found["all"][1][4]


PRIVATE = "10.0.0.1 172.16.0.1 172.31.255.255 192.168.1.1 127.0.0.1 169.254.0.1 203.0.113.7 198.18.0.1 0.0.0.0 255.255.255.255 fc00::1 ::1 fe80::1".split()
PUBLIC = ["8.8.8.8", "172.32.0.1", "203.0.112.7", "100.64.0.1", "192.0.0.9", "2606:4700::1111", "unknown", "", None, "1.2.3", "256.1.1.1", "01.2.3.4"]


def test_private_addresses(spark):
    df = spark.createDataFrame([(a,) for a in PRIVATE + PUBLIC], "ip string").select("ip", network.is_private_ip(F.col("ip")).alias("p"))
    got = {r.ip: r.p for r in df.collect()}
    assert all(got[a] == 1 for a in PRIVATE)
    assert all(not got[a] for a in PUBLIC)


def test_ipv6_against_the_registry(spark):
    """Network edges, mixed notations and malformed text."""
    import ipaddress

    edges = [ipaddress.ip_network(n) for n in (*network.PRIVATE_V6, *network.PUBLIC_V6)]
    texts = {str(n[i]) for n in edges for i in (0, -1)} | {n[0].exploded.upper() for n in edges}
    texts |= {str(ipaddress.IPv6Address(min(2**128 - 1, int(n[-1]) + 1))) for n in edges} | {str(ipaddress.IPv6Address(max(0, int(n[0]) - 1))) for n in edges}
    texts |= {"::ffff:10.0.0.1", "64:ff9b::8.8.8.8", "::8.8.8.8", "1:2:3:4:5:6:7:8", "1::8", "::", "fe80::1%eth0", "2606:4700:4700::1111"}
    wrong = {"1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "12345::", "g::1", ":1", "1:", "::1.2.3", "::1.2.3.256", "fe80::1/64", "a:b"}
    got = {r.ip: bool(r.p) for r in spark.createDataFrame([(a,) for a in texts | wrong], "ip string").select("ip", network.is_private_ip(F.col("ip")).alias("p")).collect()}
    within = lambda a: any(a in ipaddress.ip_network(n) for n in network.PRIVATE_V6) and not any(a in ipaddress.ip_network(n) for n in network.PUBLIC_V6)
    assert {a: got[a] for a in texts} == {a: within(ipaddress.IPv6Address(a.split("%")[0])) for a in texts}
    assert not any(got[a] for a in wrong)


@pytest.mark.parametrize(("agent", "os", "browser"), [
    ("Mozilla (Windows NT) Chrome/1 Safari/2", "Windows", "Chrome"), ("(Macintosh) Safari", "Mac", "Safari"), ("Linux Firefox", "Linux", "Firefox"), ("windows chrome", "OtherOS", "OtherBrowser"),
])
def test_agents(spark, agent, os, browser):
    r = spark.createDataFrame([(agent,)], "a string").select(scalars.operating_system(F.col("a")).alias("o"), scalars.browser(F.col("a")).alias("b")).first()
    assert (r.o, r.b) == (os, browser)


def test_small_expressions(spark):
    df = spark.createDataFrame([("a/b/c", "", "x", float("inf"), "7x")], "p string, e string, f string, d double, n string")
    r = df.select(scalars.last_token(F.col("p")), scalars.first_truthy(F.col("e"), F.col("f")), scalars.finite(F.col("d")), scalars.numeric(F.col("n")), scalars.ratio(F.lit(0), F.lit(0), 1.0)).first()
    assert list(r) == ["c", "x", None, 0.0, 1.0]


def test_an_address_is_taken_apart_once(spark):
    plan = spark.range(1).select(network.is_private_ip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    # An analysed plan names each expression twice, once for the type of its result.
    assert plan.count("regexp_extract(") <= 2 and plan.count("split(") <= 10
