"""Streams against their batch twins."""

import random
import re
import time
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.fixed_values import PLACEHOLDER_PATTERN
from maskwright.session import scratch_scope, written
from maskwright.sources.audit import AUDIT_SCHEMA, audit_tail, follow_audit, read_audit, write_audit
from maskwright.streaming import restore as restoring
from maskwright.streaming.restore import restore_chunks, restore_stream, split_held
from maskwright.streaming.sanitize import sanitize_stream
from maskwright.streaming.stats import watch_counts, watch_stats


def test_split_held():
    assert split_held("Contact me at [EM", 9) == ("Contact me at ", "[EM")
    assert split_held("a [x", 9) == ("a [x", "")
    assert split_held("a [ABCDEFGHIJ", 9) == ("a [ABCDEFGHIJ", "")
    assert split_held("[EMAIL_1]", 9) == ("[EMAIL_1]", "")
    assert split_held("a [ABCDEFGHIJ") == ("a ", "[ABCDEFGHIJ")


def sessions(seed):
    """Texts full of placeholders, halves of them and brackets, cut into chunks of any size."""
    rng = random.Random(seed)
    mappings, chunks, whole = [], [], {}
    for s in map(str, range(4)):
        known = {f"[EMAIL_{i}]": f"u{i}-[EMAIL_1]@{s}.com" for i in range(1, 13)} if s != "3" else {}
        mappings += [(s, k, v) for k, v in known.items()]
        parts = [rng.choice([f"[EMAIL_{rng.randint(1, 14)}]", " é ", "[EMA", "[", "]", "x" * rng.randint(0, 30)]) for _ in range(90)]
        text = "".join(parts)
        whole[s] = re.sub(PLACEHOLDER_PATTERN, lambda m, known=known: known.get(m.group(), m.group()), text)
        at = seq = 0
        while at < len(text):
            n = rng.randint(0, 7) if rng.random() < 0.9 else rng.randint(0, 80)
            chunks.append((s, seq, text[at : at + n], at + n >= len(text)))
            at, seq = at + n, seq + 1
    rng.shuffle(chunks)
    return mappings, chunks, whole


CHUNKS = "session_id string, seq long, data string, eof boolean"


def joined(rows, order):
    out = defaultdict(str)
    for r in sorted(rows, key=lambda r: r[order]):
        out[r["session_id"]] += r["data"]
    return out


def test_stream_and_batch_restore_the_same(spark, tmp_path):
    mappings, chunks, whole = sessions(7)
    known = spark.createDataFrame(mappings, "session_id string, placeholder string, original string")
    table = spark.createDataFrame(chunks, CHUNKS)
    for size in (1, 64):
        assert joined(restore_chunks(table, known, size).collect(), "block") == whole
    table.repartition(4).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    restore_stream(stream, known, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert joined(spark.read.parquet(out).collect(), "seq") == whole


@pytest.mark.parametrize("bound", [100_000, 0])
def test_brackets_longer_than_a_placeholder_stay_across_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(restoring, "MAX_BROADCAST_CROSSINGS", bound)
    known = spark.createDataFrame([("s", "[A_1]", "x")], "session_id string, placeholder string, original string")
    text = "[A_1] " + "[A_" + "1" * 40 + "] [" + "B" * 25 + "_1] end [A_1]"
    for size in (3, 7, 13):
        rows = [("s", i, text[i * size : (i + 1) * size], False) for i in range(-(-len(text) // size))]
        found = restore_chunks(spark.createDataFrame(rows, CHUNKS), known, size=10)
        assert joined(found.collect(), "block")["s"] == text.replace("[A_1]", "x")


def test_chunks_are_moved_once_by_place_and_once_by_block(spark, monkeypatch):
    rows = spark.createDataFrame([("s", i, "ab", False) for i in range(9)], CHUNKS)
    plan = restoring._blocks_of_text(rows, 4)._jdf.queryExecution().executedPlan().toString()
    # rows with the text: once by place, for the window and the join, once by block
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 5


class _State:
    """An empty state that notes what it is asked."""

    def __init__(self):
        self.asked = []

    def __getattr__(self, name):
        return lambda *_: self.asked.append(name)


def test_a_new_session_asks_its_state_once_and_writes_its_place():
    processor = restoring.RestoredSessions(None, None)
    processor.place, processor.early, processor.missing, processor.known = (_State() for _ in range(4))
    processor.told = (None, {})
    processor.handleInitialState(("s",), pd.DataFrame({"placeholder": ["[A_1]"], "original": ["x"]}), None)
    rows = pd.DataFrame({"seq": [1, 0], "data": ["1] b", "a [A_"], "eof": [None, False]})
    out = pd.concat(processor.handleInputRows(("s",), iter([rows]), None))
    assert "".join(out["piece"]) == "a x b"
    states = (processor.place, processor.early, processor.missing, processor.known)
    assert [s.asked for s in states] == [["get", "update"], [], [], ["updateValue"]]


def test_a_silent_session_gives_up_what_it_holds(spark, tmp_path):
    known = spark.createDataFrame([("s", "[EMAIL_1]", "a@x.com")], "session_id string, placeholder string, original string")
    rows = [("s", 0, "to [EMAIL_1] and [EM", False), ("s", 2, " late", False)]
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = restore_stream(stream, known, out, str(tmp_path / "cp"), ttl_ms=1000)
    try:
        for _ in range(60):
            time.sleep(1)
            if len(list((tmp_path / "out").glob("batch_id=*/*.parquet"))) and "late" in joined(
                spark.read.parquet(out).collect(), "seq"
            ).get("s", ""):
                break
    finally:
        query.stop()
    assert joined(spark.read.parquet(out).collect(), "seq") == {"s": "to a@x.com and [EM late"}


def test_mappings_that_arrive_while_the_stream_runs(spark, tmp_path):
    known, source, out = str(tmp_path / "known"), str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, placeholder string, original string"
    spark.createDataFrame([], schema).write.parquet(known)
    spark.createDataFrame([], CHUNKS).write.json(source)
    stream = spark.readStream.schema(CHUNKS).json(source)
    query = restore_stream(stream, lambda: spark.read.schema(schema).parquet(known), out, str(tmp_path / "cp"))
    try:
        spark.createDataFrame([("s", "[EMAIL_1]", "a@x.com")], schema).write.mode("append").parquet(known)
        rows = [("s", 0, "to [EMA", False), ("s", 1, "IL_1] done", True)]
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").json(source)
        for _ in range(60):
            time.sleep(1)
            if len(list((tmp_path / "out").glob("batch_id=*/*.parquet"))) and "done" in joined(
                spark.read.parquet(out).collect(), "seq"
            ).get("s", ""):
                break
    finally:
        query.stop()
    assert joined(spark.read.parquet(out).collect(), "seq") == {"s": "to a@x.com done"}


def told(path):
    """The rows of every batch so far, by number and then by batch."""
    import pyarrow.parquet as pq

    rows = []
    for folder in Path(path).glob("batch_id=*"):
        for file in folder.glob("*.parquet"):
            table = pq.read_table(file, partitioning=None).to_pylist()
            rows += [(r["seq"], int(folder.name.split("=")[1]), r["data"]) for r in table if r["data"]]
    return [(seq, data) for seq, _, data in sorted(rows)]


def wait_for(path, n, seconds=90):
    for _ in range(seconds * 2):
        if len(told(path)) >= n:
            break
        time.sleep(0.5)
    return told(path)


def test_late_repeated_and_following_chunks_after_a_silence_and_an_end(spark, tmp_path):
    """Each chunk leaves once, restored, as soon as its turn has come or passed."""
    known = spark.createDataFrame([("s", "[EMAIL_1]", "a@x.com")], "session_id string, placeholder string, original string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], CHUNKS).write.json(source)

    def send(*rows):
        spark.createDataFrame([("s", *r) for r in rows], CHUNKS).coalesce(1).write.mode("append").json(source)

    stream = spark.readStream.schema(CHUNKS).json(source)
    query = restore_stream(stream, known, out, str(tmp_path / "cp"), ttl_ms=4000)
    try:
        send((0, "to [EMAIL_1] and [EM", False), (3, " three [EMAIL_", False), (4, "1] four [X", False))
        flushed = [(0, "to a@x.com and "), (1, "[EM"), (3, " three "), (4, "a@x.com four "), (5, "[X")]
        assert wait_for(out, 5) == flushed
        send((2, "two [EMAIL_1]", False), (0, "again", False), (3, "again", False))
        assert wait_for(out, 6) == [*flushed[:2], (2, "two a@x.com"), *flushed[2:]]
        # what goes on goes on at once, and an end isn't the end of the session's place
        start = time.perf_counter()
        send((5, "five [EMAIL_1]", True))
        assert wait_for(out, 7)[-1] == (5, "five a@x.com")
        send((5, "five again", True), (2, "two again", False), (1, "AIL_1] late", False))
        assert wait_for(out, 8)[2] == (1, "AIL_1] late")
        send((6, "after the end [EMAIL_1]", False), (5, "five again", True))
        assert wait_for(out, 9)[-1] == (6, "after the end a@x.com")
        assert time.perf_counter() - start < 60
        time.sleep(6)
        assert len(told(out)) == 9
    finally:
        query.stop()


def test_mappings_as_a_stream(spark, tmp_path):
    """Mappings go to the state of their session: they count for the chunks of their batch and of later ones."""
    schema = "session_id string, placeholder string, original string"
    mappings, chunks, whole = sessions(9)
    extra = [("new", "[EMAIL_1]", "n@x.com"), ("new", None, "x"), (None, "[EMAIL_1]", "none@x.com")]
    spark.createDataFrame(mappings + extra, schema).repartition(3).write.json(str(tmp_path / "known"))
    rows = [*chunks, ("new", 1, "IL_1] [EMAIL_2]", True), ("new", 0, "a [EMA", False)]
    spark.createDataFrame(rows, CHUNKS).repartition(2).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).json(str(tmp_path / "in"))
    known = spark.readStream.schema(schema).json(str(tmp_path / "known"))
    out = str(tmp_path / "out")
    restore_stream(stream, known, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    expected = {**whole, "new": "a n@x.com [EMAIL_2]"}
    assert joined(spark.read.parquet(out).collect(), "seq") == expected
    # the next run knows them from its state
    spark.createDataFrame([("new", 2, " and [EMAIL_1]", True)], CHUNKS).write.mode("append").json(str(tmp_path / "in"))
    restore_stream(stream, known, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    expected["new"] += " and n@x.com"
    assert joined(spark.read.parquet(out).collect(), "seq") == expected


def scratch_folder(spark):
    written(spark.range(1), "probe")
    return Path(spark.conf.get("spark.checkpoint.dir")) / "maskwright"


def test_a_scope_deletes_its_scratch_tables(spark):
    folder = scratch_folder(spark)
    with scratch_scope(spark):
        outer = written(spark.range(3), "outer-scope")
        with scratch_scope(spark):
            assert written(spark.range(2), "inner-scope").count() == 2
        assert not list(folder.glob("inner-scope-*"))
        assert outer.count() == 3
    assert not list(folder.glob("outer-scope-*"))
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        written(spark.range(2), "failed-scope")
        1 / 0
    assert not list(folder.glob("failed-scope-*"))
    assert list(folder.glob("probe-*"))


def test_the_end_of_a_log(spark, tmp_path):
    rows = [(f"2024-01-01T00:{m:02}:10Z", "POST", f"h{m}", "allow", "r") for m in range(30)]
    names = "timestamp string, method string, host string, decision string, reason string"
    write_audit(spark.createDataFrame(rows, names).repartition(3), str(tmp_path / "log"), stamp=False)
    log = read_audit(spark, str(tmp_path / "log"))
    assert [r["host"] for r in audit_tail(log, ["timestamp"]).collect()] == [f"h{m}" for m in range(10, 30)]
    assert [r["host"] for r in audit_tail(log, ["timestamp"], 2).collect()] == ["h28", "h29"]
    assert audit_tail(read_audit(spark, str(tmp_path / "none")), ["timestamp"]).count() == 0


def test_hosts_and_types_by_minute(spark):
    def row(minute, host, *types):
        items = [(t, "[X_1]") for t in types]
        return (f"2024-01-01T00:0{minute}:10Z", "POST", host, None, 200, "allow", "r", 0.0, 0.0, 1.0, None, None, None, items)

    rows = [row(1, " a ", "email", " Email", " "), row(1, "a"), row(2, "", "phone"), row(2, None), ("no time", *row(1, "b")[1:])]
    rows.append((*row(2, "c")[:-1], None))
    got = watch_counts(spark.createDataFrame(rows, AUDIT_SCHEMA), None).collect()
    assert {(str(r["minute"])[14:16], r["what"], r["name"], r["n"]) for r in got} == {
        ("01", "host", "a", 2),
        ("01", "type", "EMAIL", 2),
        ("02", "type", "PHONE", 1),
        ("02", "host", "c", 1),
    }


def test_requests_as_a_stream(spark, tmp_path):
    body = '{"messages":[{"role":"user","content":"mail a@x.com"}]}'
    rows = [(i, "POST", "api.openai.com:443", "/v1", "application/json", len(body), body) for i in range(3)]
    rows.append((3, "POST", "h", "/v1", "text/event-stream", 5, "b@x.com"))
    schema = (
        "request_id int, method string, host string, path string, content_type string, content_length long, body string"
    )
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    before = set(scratch_folder(spark).glob("requests-*"))
    sanitize_stream(stream, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    masked = {r["request_id"]: r["masked"] for r in spark.read.parquet(f"{out}/masked").collect()}
    assert masked == {**dict.fromkeys(range(3), body.replace("a@x.com", "[EMAIL_1]")), 3: "b@x.com"}
    known = spark.read.parquet(f"{out}/mappings")
    assert {tuple(r)[:3] for r in known.collect()} == {(i, "[EMAIL_1]", "a@x.com") for i in range(3)}
    audit = spark.read.parquet(f"{out}/audit")
    assert audit.filter("sanitized").count() == 3
    assert audit.filter(F.to_json(F.struct("*")).contains("@x.com")).count() == 0
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"masked", "mappings", "audit"}
    assert set(scratch_folder(spark).glob("requests-*")) == before


def test_followed_log_is_counted_by_minute(spark, tmp_path):
    rows = [
        (f"2024-01-01T00:0{m}:10Z", "POST", "h", None, 200, "allow", "r", 0.0, 0.0, float(m), None, None, None, [("email", "[EMAIL_1]")])
        for m in (1, 1, 2)
    ]
    write_audit(spark.createDataFrame(rows, AUDIT_SCHEMA), str(tmp_path / "log"), stamp=False)
    query = (
        watch_stats(follow_audit(spark, str(tmp_path / "log")))
        .writeStream.outputMode("update")
        .format("memory")
        .queryName("watched")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {str(r["minute"])[14:16]: (r["requests"], r["masked_items"], r["total_ms"]) for r in spark.table("watched").collect()}
    assert got == {"01": (2, 2, 1.0), "02": (1, 1, 2.0)}


def test_the_live_snapshot_is_the_snapshot_of_what_has_come(spark, tmp_path):
    """After every batch and restart, with late events, blank names, unreadable times and times that are equal."""
    from maskwright.operators import stats
    from maskwright.sources.audit import parse_audit
    from maskwright.streaming.snapshot import watch_snapshot

    draw = random.Random(14)
    log, out, state = (str(tmp_path / n) for n in ("log", "live", "state"))

    def rounded(row):
        def plain(x):
            if isinstance(x, float):
                return round(x, 6)
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items()}
            return [plain(v) for v in x] if isinstance(x, list) else x

        return plain(row.asDict(recursive=True))

    def run():
        events = parse_audit(spark.readStream.text(log))
        watch_snapshot(events, out, state, str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()

    for turn in range(4):
        rows = []
        for i in range(60 if turn != 2 else 0):
            second = draw.randrange(60)
            # the third minute of events comes late, in the last turn
            when = f"2024-01-01T00:{(turn * 3 + draw.randrange(3)) if turn < 3 else 2:02}:{second:02}.{draw.randrange(3)}Z"
            items = [(draw.choice(["email", " Email", "phone", " "]), "[X_1]") for _ in range(draw.randrange(3))]
            value = draw.choice([0.0, 1.5, draw.random() * 100])
            host = draw.choice(["a", " a", "b", "c", "d", "e", "f", "g", ""])
            rows.append((when if i % 20 else "no time", "POST", host, f"/{turn}/{i}", 200, "allow", "r", value, 2 * value, 3 * value, None, None, bool(items), items))
        spark.createDataFrame(rows, AUDIT_SCHEMA).coalesce(2).write.mode("append").json(log)
        run()
        if turn == 1:
            run()  # nothing new
        so_far = read_audit(spark, log).orderBy("timestamp")
        now = so_far.agg(F.max(stats.event_time(F.col("timestamp")))).scalar()
        (expected,) = stats.snapshot(so_far, now, ["timestamp"], "running").collect()
        made = spark.read.parquet(out)
        (got,) = made.filter(F.col("batch_id") == made.agg(F.max("batch_id")).scalar()).drop("batch_id").collect()
        got, expected = rounded(got), rounded(expected)
        # requests of one time may stand in any order, and which of them are the last twenty is open
        times = [[r["timestamp"] for r in x.pop("recent")] for x in (got, expected)]
        assert times[0] == times[1] and len(times[0]) == 20
        assert got == expected
    assert len(list((tmp_path / "state").iterdir())) <= 2
