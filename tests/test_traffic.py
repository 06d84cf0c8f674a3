"""Hosts, rules, eligibility, audit log and statistics."""

import json
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskwright.functions.hosts import classify_host, connect_target, normalize_host
from maskwright.functions.labels import masked_counts, masked_label, unique_types
from maskwright.operators import sketches, stats, traffic
from maskwright.operators.policy import evaluate_policy, intercept_scope
from maskwright.session import written
from maskwright.sources.audit import AUDIT_SCHEMA, read_audit, rfc3339, write_audit, write_report
from maskwright.sources.rules import load_rules


def column(spark, values, make, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.o for r in df.orderBy("i").select(make(F.col("v")).alias("o")).collect()]


def test_hosts(spark):
    hosts = ["api.openai.com:443", "[::1]:8443", "a:b:c", "[::1]", "plain", "", "x:"]
    assert column(spark, hosts, normalize_host) == ["api.openai.com", "::1", "a", "[", "plain", "", "x"]
    assert column(spark, [" h ", "h:1", "", "::1"], connect_target) == ["h:443", "h:1", "", "::1"]
    kinds = column(spark, ["API.OpenAI.com", "x.anthropic.com", "example.com"], classify_host)
    assert kinds == ["LLM_OPENAI", "LLM_ANTHROPIC", "UNKNOWN"]


RULES = [
    {"id": "a", "host": "good.com", "action": "allow"},
    {"id": "b", "host_contains": "Bad", "action": "BLOCK"},
    {"id": "", "host": "odd.com", "action": "Peek"},
    {"id": "c", "host_contains": "good", "action": "block"},
]


@pytest.mark.parametrize("extra", [0, 150])
def test_policy_first_rule_wins(spark, extra):
    """Few rules in one expression and many by joins decide alike."""
    hosts = spark.createDataFrame([(h,) for h in ("GOOD.com", "so.bad.net", "odd.com", "x.good.com", "other")], "host string")
    rules = RULES + [{"id": f"e{i}", "host": f"h{i}.net", "action": "mitm"} for i in range(extra)]
    rows = {r["host"]: tuple(r)[1:] for r in evaluate_policy(hosts, rules).collect()}
    assert rows == {
        "GOOD.com": ("allow", "matched rule", "a"),
        "so.bad.net": ("block", "matched rule", "b"),
        "odd.com": ("block", 'invalid action "Peek"', "unnamed"),
        "x.good.com": ("block", "matched rule", "c"),
        "other": ("allow", "default allow", "default"),
    }
    everything = [*rules, {"id": "all", "action": "mitm"}]
    last = evaluate_policy(hosts.filter("host = 'other'"), everything).first()
    assert (last["decision"], last["rule_id"]) == ("mitm", "all")


def test_a_hundred_thousand_rules_of_many_lengths(spark):
    draw = random.Random(6)
    names = ["".join(draw.choice("abcdefgh.-") for _ in range(draw.randrange(1, 240))) + ".example.com" for _ in range(150)]
    names += ["a", "", "www.example.com", names[0].upper()]
    rules = []
    for i in range(100_000):
        n = 1 + i % 200
        part = "".join(draw.choice("abcdefgh.-") for _ in range(n)) if n > 3 else "zq" + str(n)
        rules.append((i, f"r{i}", "", part, "block"))
    for i in range(100_000, 100_300):
        name = draw.choice([n for n in names if n])
        at = draw.randrange(len(name))
        rules.append((i, f"r{i}", name if i % 9 == 0 else "", name[at : at + draw.randrange(1, 200)].upper(), draw.choice(["allow", "MITM", "odd"])))
    rules += [(100_300, "common", None, ".example.com", "allow"), (100_301, "b", "", "b", "allow")]
    schema = "ord int, id string, host string, host_contains string, action string"
    table = spark.createDataFrame(rules, schema).repartition(4)
    hosts = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "host string").repartition(3)
    decided = evaluate_policy(hosts, table)
    assert not re.search(r"transform\(array\(1, 2, 3", decided._jdf.queryExecution().analyzed().toString())
    got = {r["host"]: r["rule_id"] for r in decided.collect()}
    lowered = [(i, (h or "").lower(), p.lower()) for _, i, h, p, _ in rules]
    for name in names:
        low = name.lower()
        first = next((i for i, h, p in lowered if (h and low == h) or (p and p in low)), "default")
        assert got[name] == first, name
    assert got[None] == "default" and decided.count() == 2 * len(names) + 1
    everything = table.unionByName(spark.createDataFrame([(100_299, "all", "", "", "mitm")], schema))
    last = {r["host"]: r["rule_id"] for r in evaluate_policy(hosts, everything).collect()}
    assert last[""] == last[None] == "all" and last["www.example.com"] == got["www.example.com"]


def test_rules_from_a_file_and_none(spark, tmp_path):
    file = tmp_path / "rules.json"
    file.write_text(json.dumps({"rules": [{"id": "x", "match": {"host_contains": "h"}, "action": "block"}, {"id": "y", "action": "allow"}]}))
    rows = load_rules(spark, str(file)).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(0, "x", "", "h", "block"), (1, "y", "", "", "allow")]
    assert [r["id"] for r in load_rules(spark, []).collect()] == ["allow_all"]


@pytest.mark.parametrize("many", [False, True])
def test_intercept_scope(spark, many):
    rows = [("openai.com", "mitm"), ("API.openai.com:443", "mitm"), ("notopenai.com", "mitm"), ("openai.com", "allow")]
    df = spark.createDataFrame(rows, "host string, decision string")
    domains = [" OpenAI.com "] + ([f"d{i}.net" for i in range(150)] if many else [])
    got = {(r["host"], r["decision"]): r["inspect"] for r in intercept_scope(df, domains).collect()}
    assert [got[r] for r in rows] == [True, True, False, False]
    everywhere = spark.createDataFrame([], "domain string") if many else []
    assert [r["inspect"] for r in intercept_scope(df, everywhere).collect()].count(True) == 3
    assert not any(r["inspect"] for r in intercept_scope(df, domains, enabled=False).collect())


def test_a_missing_host_meets_the_same_rule_in_both_forms(spark):
    df = spark.createDataFrame([(1, None), (2, "h7.net")], "id int, host string")
    few = [{"id": f"r{i}", "host": f"h{i}.net", "action": "allow"} for i in range(90)] + [{"id": "all", "action": "block"}]
    many = [{"id": f"r{i}", "host": f"h{i}.net", "action": "allow"} for i in range(150)] + [{"id": "all", "action": "block"}]
    for rules in (few, many):
        got = {r["id"]: (r["decision"], r["rule_id"]) for r in evaluate_policy(df, rules).collect()}
        assert got == {1: ("block", "all"), 2: ("allow", "r7")}


def test_response_reasons(spark):
    rows = [
        ("application/json", None, None, 10, "b", True, True, None),
        ("image/png", None, None, 10, "b", True, True, "content type"),
        ("image/png", ["Chunked"], None, -1, "b", True, True, None),
        ("text/html", None, "gzip", 10, "b", True, True, "compressed"),
        ("text/plain", None, "", -1, "b", True, True, "unknown length"),
        ("text/plain", None, "", 300_000, "b", True, True, "too large"),
        ("text/event-stream", None, "", -1, "b", False, True, "restore off"),
        ("text/plain", None, "", 3, "b", True, False, "no mapping"),
        ("text/plain", None, "", 3, None, True, True, "no body"),
    ]
    df = spark.createDataFrame(
        rows, "ct string, te array<string>, ce string, n long, body string, wanted boolean, known boolean, reason string"
    )
    got = df.select("reason", traffic.response_skip_reason(*[F.col(c) for c in df.columns[:-1]], limit=256 * 1024).alias("o")).collect()
    assert all(r.reason == r.o for r in got)


def test_preview(spark):
    df = spark.createDataFrame([("a\nb" * 300, "application/json; x"), ("x", "text/plain")], "b string, t string")
    first, second = [r.p for r in df.select(traffic.body_preview(F.col("b"), F.col("t")).alias("p")).collect()]
    assert first == ("a\nb" * 300)[:512].replace("\n", "") and second == ""


def test_labels(spark):
    types = [["email", " email ", "jwt", " "], [], ["phone"]]
    assert column(spark, types, unique_types, "array<string>") == [["email", "jwt"], [], ["phone"]]
    labels = column(spark, types, lambda c: masked_label(masked_counts(c)), "array<string>")
    assert labels == ["1 JWT, 2 EMAIL", "-", "1 PHONE"]


def entries(spark, n):
    rows = [
        (
            f"2024-01-01T00:{i // 150:02d}:{i % 60:02d}.5Z", "POST", f" h{i % 7}.com ", None, 200, "allow", "r",
            0.0, float(i % 3), 2.0, None, None, True, [("email", "[EMAIL_1]"), (" ", "")],
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, AUDIT_SCHEMA).withColumn("line", F.monotonically_increasing_id())


def test_snapshot(spark):
    now = F.lit("2024-01-01T00:07:59.5Z").cast("timestamp")
    row = stats.snapshot(entries(spark, 1200), now, ["line"]).first()
    assert row["requests"]["total"] == 1200 and row["masked_items"]["total"] == 1200
    assert row["masked_items"]["by_type"] == {"EMAIL": 1200}
    assert [d["domain"] for d in row["top_domains"]] == [f"h{i}.com" for i in (0, 1, 2, 3, 4)]
    assert row["requests"]["last_5_minute"] == [150] * 5 and row["requests"]["per_minute"] == 150.0
    assert row["latency"]["sanitize_ms"] == 0.0 and row["latency"]["upstream_ms"] == 1.5
    assert len(row["recent"]) == 20 and row["recent"][0]["masked_count"] == 2
    assert row["recent"][0]["timestamp"] >= row["recent"][19]["timestamp"]
    assert row["status"] == "stopped"


def test_snapshot_of_an_empty_log(spark):
    log = read_audit(spark, "/tmp/no such audit log")
    row = stats.snapshot(log.withColumn("line", F.lit(0)), F.current_timestamp(), ["line"]).first()
    assert row["requests"]["total"] == 0 and row["masked_items"]["by_type"] == {}
    assert row["top_domains"] == [] and row["recent"] == [] and row["requests"]["per_minute"] == 0.0
    assert json.loads(stats.stats_json(stats.snapshot(log.withColumn("line", F.lit(0)), F.current_timestamp(), ["line"])).first()[0])["port"] == 0


def test_audit_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    write_audit(entries(spark, 3).filter("line = line"), path, stamp=False)
    (tmp_path / "log" / "part-x.txt").write_text('{"timestamp": "torn\n\n[1]\nnull\n{"status_code":"x"}\n{"host":"k","extra":1}\n')
    rows = read_audit(spark, path).collect()
    assert sorted(r["host"] for r in rows) == [" h0.com ", " h1.com ", " h2.com ", "k"]
    text = next(Path(path).glob("part-0*")).read_text() + "".join(p.read_text() for p in Path(path).glob("*.json"))
    assert "sanitize_latency_ms" not in text and '"decision":"allow"' in text


def test_a_very_long_line_is_read(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"host":"' + "x" * (3 * 1024 * 1024) + '"}\n{"host":"y"}\n')
    assert read_audit(spark, str(tmp_path)).count() == 2


def test_times_are_written_without_trailing_zeros(spark):
    times = ["2024-01-01 10:00:00", "2024-01-01 10:20:30.500", "2024-01-01 10:20:30.123456"]
    got = column(spark, times, lambda c: rfc3339(c.cast("timestamp")))
    assert got == ["2024-01-01T10:00:00Z", "2024-01-01T10:20:30.5Z", "2024-01-01T10:20:30.123456Z"]


def test_report_has_a_header(spark, tmp_path):
    write_report(stats.recent_report(entries(spark, 30), ["line"], 3), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "timestamp,domain,method,status,masked_types,masked_count,latency_ms"
    assert lines[1].split(",")[1:] == ["h1.com", "POST", "200", "EMAIL", "2", "2.000"] and len(lines) == 4


def test_trace_durations(spark):
    df = spark.sql(
        "select timestamp'2024-01-01 00:00:01' start_ts, timestamp'2024-01-01 00:00:03' end_ts, "
        "timestamp'2024-01-01 00:00:02' sanitize_start, timestamp'2024-01-01 00:00:01' sanitize_end, "
        "cast(null as timestamp) upstream_start, timestamp'2024-01-01 00:00:01.5' first_byte, "
        "cast(null as timestamp) upstream_end, cast(null as timestamp) response_start, cast(null as timestamp) response_end"
    )
    row = traffic.trace_durations(df).first()
    assert (row["total_us"], row["sanitize_us"], row["ttfb_us"], row["first_byte_us"]) == (2_000_000, 0, 0, 500_000)


def test_sampled_traces_are_a_tenth_and_stay_the_same(spark):
    df = spark.range(20_000)
    first = traffic.sample_traces(df)
    assert 0.09 < first.count() / 20_000 < 0.11
    assert first.exceptAll(traffic.sample_traces(df.repartition(7))).count() == 0


def test_audit_rows_hold_no_originals(spark):
    df = spark.sql(
        "select 'POST' method, 'h' host, 'allow' decision, 'default allow' reason, 'default' rule_id, "
        "array(named_struct('type','email','original','a@x.com','placeholder','[EMAIL_1]')) items"
    )
    row = traffic.audit_record(df).first()
    assert row["reason"] == "default allow (default)" and row["sanitized"]
    assert "a@x.com" not in str(row)


def test_sketches_merge_as_if_they_had_seen_everything(spark):
    """Quantiles and frequent hosts of minutes merged in two steps, against sorting and counting, with skewed hosts."""
    draw = random.Random(12)
    rows, values, hosts = [], [], []
    for i in range(20_000):
        value = draw.choice([draw.expovariate(1 / 200), 5.0, 0.0, None])
        host = draw.choice(["big.example", " big.example", f"h{int(draw.expovariate(1 / 6))}", "", None])
        rows.append((f"2024-01-01T0{i // 60 % 3}:{i % 60:02}:10Z" if i % 100 else "no time", host, value))
        if i % 100:
            values.append(value)
            hosts.append((host or "").strip())
    log = spark.createDataFrame(rows, "timestamp string, host string, total_latency_ms double").repartition(5)
    log = log.withColumns({c: F.lit(0.0) for c in ("sanitize_latency_ms", "upstream_latency_ms")})
    minutes = written(sketches.minute_sketches(log), "test-sketches")
    assert minutes.count() == 180 and minutes.agg(F.sum("requests")).first()[0] == len(values)
    hours = sketches.merge_sketches(minutes.withColumn("hour", F.date_trunc("hour", "minute")), ["hour"])
    assert hours.count() == 3
    merged = sketches.merge_sketches(hours)
    known = sorted(v for v in values if v)
    found = sketches.quantiles(merged, [0.0, 0.5, 0.9, 0.99, 1.0]).collect()
    assert {r.what for r in found} == {"total_ms"} and len(found) == 5
    for r in found:
        below, upto = sum(v < r.value for v in known) / len(known), sum(v <= r.value for v in known) / len(known)
        assert r.n == len(known) and below <= r.p + sketches.rank_error() and upto >= r.p - sketches.rank_error()
    counts = sorted(Counter(h for h in hosts if h).items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in sketches.frequent_hosts(merged, 7).orderBy(F.desc("n"), "host").collect()] == counts[:7]
    # too few places for all hosts: the frequent ones stay, and no count is too high or far too low
    small = sketches.merge_sketches(sketches.minute_sketches(log, tracked=64), tracked=64)
    exact = dict(counts)
    for r in sketches.frequent_hosts(small, 3).collect():
        assert exact[r.host] - len(values) / 64 <= r.n <= exact[r.host]
    none = sketches.merge_sketches(sketches.minute_sketches(log.limit(0)))
    assert sketches.quantiles(none, [0.5]).count() == 0 and sketches.frequent_hosts(none, 3).count() == 0
