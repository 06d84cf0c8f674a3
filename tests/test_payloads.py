"""Conversations, JSON bodies, hot keys."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from maskwright.functions import detectors as det
from maskwright.functions.jsontext import json_leaves
from maskwright.functions.spans import SPAN
from maskwright.operators.jsonmask import json_texts, sanitize_body, sanitize_json, should_sanitize
from maskwright.operators.masking import restore, sanitize, sanitize_conversations
from maskwright.operators.skew import broadcast_if_small, hot_split_join, rank_in_order
from maskwright.streaming.sanitize import mask_requests


def bodies(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, body string")


def one(spark, body, function=sanitize_json, **options):
    return function(bodies(spark, body), **options).first()


def test_nested_messages_keep_their_roles(spark):
    row = one(spark, '{"messages":[{"role":"user","content":"alice@example.com"}]}')
    assert row["masked"] == '{"messages":[{"role":"user","content":"[EMAIL_1]"}]}'
    assert row["items"][0]["original"] == "alice@example.com"


def test_skipped_and_custom_keys(spark):
    body = '{"content":"alice@example.com","access_token":"sk-Abcdefghij1234567890XYZ","model":"gpt-4"}'
    assert json.loads(one(spark, body)["masked"]) == {
        "content": "[EMAIL_1]",
        "access_token": "sk-Abcdefghij1234567890XYZ",
        "model": "gpt-4",
    }
    body = '{"custom_field":"a@x.com","content":"b@x.com"}'
    row = one(spark, body, sanitize_keys=["Custom_Field"], skip_keys=["content"])
    assert row["masked"] == '{"custom_field":"[EMAIL_1]","content":"b@x.com"}'


def test_layout_numbers_and_escapes_stay(spark):
    body = ' {"n": 1.500, "text" : "\\u00e9 \\"q\\" a@x.com\\n\\/b@x.com", "z":[1e5, true, null, "c@x.com"], "b":2} '
    row = one(spark, body)
    assert row["masked"] == (
        ' {"n": 1.500, "text" : "é \\"q\\" [EMAIL_1]\\n/[EMAIL_2]", "z":[1e5, true, null, "c@x.com"], "b":2} '
    )
    assert json.loads(row["masked"])["text"] == 'é "q" [EMAIL_1]\n/[EMAIL_2]'


def test_one_placeholder_space_and_limit_per_payload(spark):
    body = '{"input":["a@x.com b@x.com","b@x.com c@x.com"],"text":"c@x.com a@x.com"}'
    assert json.loads(one(spark, body)["masked"]) == {
        "input": ["[EMAIL_1] [EMAIL_2]", "[EMAIL_2] [EMAIL_3]"],
        "text": "[EMAIL_3] [EMAIL_1]",
    }
    assert json.loads(one(spark, body, max_replacements=3)["masked"]) == {
        "input": ["[EMAIL_1] [EMAIL_2]", "[EMAIL_2] c@x.com"],
        "text": "c@x.com a@x.com",
    }


def test_overlapping_findings_in_json(spark):
    row = one(spark, '{"text":"postgres://u:p@db.example.com/x"}')
    assert row["masked"] == '{"text":"[DB_URL_1]"}'


def test_not_json(spark):
    plain = "plain text with alice@example.com"
    row = one(spark, plain)
    assert (row["is_json"], row["masked"]) == (False, plain)
    assert one(spark, plain, sanitize_body)["masked"] == "plain text with [EMAIL_1]"
    assert one(spark, '{"a":1} x@y.com', sanitize_body)["masked"] == "{\"a\":1} [EMAIL_1]"
    assert one(spark, None, sanitize_body)["masked"] is None
    assert one(spark, "", sanitize_body)["masked"] == ""


_MARKS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]', re.DOTALL)


def refuse(constant):
    raise ValueError(constant)


def plain_leaves(body, wanted, skipped):
    """The same by a parser and a loop."""
    if body is None:
        return None, []
    try:
        json.loads(body, parse_constant=refuse, parse_int=str, parse_float=str)
    except ValueError:
        return False, []
    leaves, containers, key, at_key = [], [], "", False
    for mark in _MARKS.finditer(body):
        token = mark.group()
        if token in "{[":
            containers.append((token == "{", key))
            at_key = token == "{"
        elif token in "}]":
            _, key = containers.pop()
            at_key = False
        elif token == ",":
            at_key, outer = containers[-1]
            key = key if at_key else outer
        elif token == ":":
            at_key = False
        elif at_key:
            key = json.loads(token).lower()
        elif key in wanted and key not in skipped:
            value = json.loads(token).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
            leaves.append((mark.start(), mark.end(), value.replace("\ufffd", "?")))
    return True, leaves


ODD_BODIES = [
    None, "", "null", " null ", '"x"', "5", "01", "-", "1.", "[.5]", "[+1]", "[1e999]", "tru", "[tru]", "[1,]", "[,]", "{,}", "[}",
    "{]", "[]]", "[1 2]", '["a" "b"]', '{"a" 1}', '{"a":}', '{:1}', '{"a":1,}', '{"a":1} x', '{"a":1}{', '{"a":NaN}', "{'a':1}",
    '{"text":"b"} // c', '\ufeff{"text":"b"}', "[1]\x00", "\x0b[1]", '{"text":"\t"}', '{"text":"\\x"}', '{"text":"\\u12g4"}', '"\\', '"abc',
    'a\\"', "\\n", '{"text":"1","text":["2"],"TOKEN":"3"}', '{"text":"bad \\ud83d \\ud83d\\ude00"}', '{"\\u0074ext":"hit","te\\u0058t":"hit"}',
    '{"text":{"x":"1","text":["2",["3",{"text":"4"},"5"]]},"text":"6"}', "[" * 1000 + '{"text":"deep"}' + "]" * 1000, "[" * 1001 + "]" * 1000,
]


def test_leaves_of_odd_and_random_bodies(spark):
    draw = random.Random(4)

    def value(depth=0):
        kind = draw.randrange(8 if depth < 4 else 5)
        if kind == 0:
            return draw.choice([True, False, None, 1, -0.5, 1e30, 0])
        if kind < 5:
            return draw.choice(["a@x.com", 'é\n"q"\\', "x,y:[{}]", "", "\u2028😀/", "tab\t\x01"])
        if kind == 5:
            return [value(depth + 1) for _ in range(draw.randrange(4))]
        return {draw.choice(["text", "Content", 'to"ken', "role", "o"]): value(depth + 1) for _ in range(draw.randrange(4))}

    texts = list(ODD_BODIES)
    for _ in range(300):
        whole = json.dumps(value(), ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, None, 2]))
        at = draw.randrange(len(whole))
        texts += [whole, whole[:at] + draw.choice(["", ",", '"', "\\", "}", " ", "1"]) + whole[at + 1 :]]
    found = bodies(spark, *texts).select("id", F.expr(json_leaves("body", ["Text", "content", "o"], ["O"])).alias("j"))
    for row in found.collect():
        got = row.j.is_json, [tuple(leaf) for leaf in row.j.leaves]
        assert got == plain_leaves(texts[row.id], {"text", "content", "o"}, {"o"}), texts[row.id]


def test_json_costs_in_proportion_to_its_length(spark):
    def seconds(n):
        turns_of = ",".join('{"role":"user","content":"mail a@x.com, \\"q\\" n"}' for _ in range(n))
        texts = ['{"messages":[' + turns_of + "]}", '{"text":"' + "a\\n" * 10 * n + '"}']
        df = bodies(spark, *texts).select(F.expr(json_leaves("body", ["content", "text"], [])).alias("j"))
        start = time.perf_counter()
        sizes = [len(r.j.leaves) for r in df.collect()]
        assert sizes == [n, 1]
        return time.perf_counter() - start

    seconds(2000)
    assert min(seconds(16_000) for _ in range(2)) < 3 * min(seconds(8_000) for _ in range(2))


def test_masking_json_stays_in_the_jvm(spark):
    for function in (sanitize_json, sanitize_body):
        plan = function(bodies(spark, "{}"))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_should_sanitize(spark):
    keys = ["Content", "content", "token", "parts", "other", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(should_sanitize(F.col("k")).alias("m"))
    assert [r.m for r in df.collect()] == [True, True, False, True, False, False]


def turns(spark, n):
    """One conversation with most of the turns, its people coming back all the time."""
    rows = [(1, i, f"p{i % 5}@x.com and q{i}@x.com") for i in range(n)] + [(2, 0, "p4@x.com"), (2, 1, None), (3, 0, "no")]
    return spark.createDataFrame(rows, "conv_id long, turn long, text string")


def expected(rows, limit=0):
    numbers, out, done = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        seen = numbers.setdefault(r["conv_id"], {})
        words = []
        for word in (r["text"] or "").split(" "):
            if "@" in word and (not limit or done.get(r["conv_id"], 0) < limit):
                done[r["conv_id"]] = done.get(r["conv_id"], 0) + 1
                word = f"[EMAIL_{seen.setdefault(word, len(seen) + 1)}]"
            words.append(word)
        out[(r["conv_id"], r["turn"])] = None if r["text"] is None else " ".join(words)
    return out


def test_conversations_against_a_plain_loop(spark):
    df = turns(spark, 60)
    for block, limit in ((7, 0), (1024, 0), (7, 31)):
        done, mappings = sanitize_conversations(df, types=["email"], block=block, max_replacements=limit)
        got = {(r["conv_id"], r["turn"]): r["masked"] for r in done.collect()}
        assert got == expected(df.collect(), limit)
    back = restore(
        done.withColumn("key", F.concat_ws("/", "conv_id", "turn")), mappings, "key", "conv_id", "masked"
    )
    assert back.filter(~F.col("restored").eqNullSafe(F.col("text"))).count() == 0


def test_hot_key_is_split_and_nothing_is_lost(spark):
    left = spark.range(6000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    right = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        plain = left.join(right, "k", how)
        split = hot_split_join(left, right, ["k"], ["id"], how, parts=16)
        assert plain.exceptAll(split.select(plain.columns)).count() == 0
        assert split.count() == plain.count()


def test_rank_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") * 3).alias("o"))
    rows = rank_in_order(df, ["g"], ["o"], 64).collect()
    assert all(r["rank"] == (r["o"] // 3) // 2 + 1 for r in rows)


def test_broadcast_only_when_counted(spark):
    assert broadcast_if_small(spark.range(10), 10)[1] is True
    assert broadcast_if_small(spark.range(11), 10)[1] is False


def test_long_bodies_and_unknown_lengths_are_masked_without_a_limit(spark):
    body = '{"text":"a@x.com ' + "x" * 300_000 + '"}'
    rows = [(1, "POST", "h", "application/json", -1, body)]
    schema = "request_id int, method string, host string, content_type string, content_length long, body string"
    df = spark.createDataFrame(rows, schema).withColumn("path", F.lit("/"))
    (row,) = mask_requests(df).collect()
    assert row["skip_reason"] is None and "[EMAIL_1]" in row["masked"] and "a@x.com" not in row["masked"]


def test_half_a_surrogate_pair_does_not_end_the_job(spark):
    body = '{"text":"bad \\ud83d a@x.com"}'
    df = spark.createDataFrame([(1, body)], "id int, body string")
    from maskwright.operators.jsonmask import sanitize_body

    (row,) = sanitize_body(df, "body").collect()
    assert "[EMAIL_1]" in row["masked"] and "a@x.com" not in row["masked"]


def test_requests_that_are_not_masked(spark):
    mail = '{"text":"a@x.com"}'
    rows = [
        (1, "POST", "h:1", "application/json", len(mail), mail),
        (2, "GET", "h", "application/json", len(mail), mail),
        (3, "POST", "h", "text/event-stream", len(mail), mail),
        (4, "POST", "h", "application/json", 2_000_000, "x" * 1000 + " a@x.com"),
        (5, "POST", "bad", "application/json", len(mail), mail),
        (6, "POST", "h", "application/json", -1, mail),
        (7, "POST", "h", "application/json", 0, ""),
        (8, "POST", "h", "application/json", 5, None),
    ]
    schema = "request_id int, method string, host string, content_type string, content_length long, body string"
    df = spark.createDataFrame(rows, schema).withColumn("path", F.lit("/"))
    rules = [{"id": "b", "host": "bad", "action": "block"}]
    done = mask_requests(df, rules, limit=256 * 1024).orderBy("request_id").collect()
    assert [r["skip_reason"] for r in done] == [
        None, "method", "event stream", "too large", "blocked", "unknown length", "empty", "no body",
    ]
    assert done[0]["masked"] == done[0]["request_body_preview"] == '{"text":"[EMAIL_1]"}'
    assert {r["request_body_preview"] for r in done[1:]} == {""}
    assert all(r["masked"] == r["body"] and not r["items"] for r in done[1:])


ENTITIES = "type string, start int, end int, score double"


def test_model_spans_in_texts(spark):
    df = spark.createDataFrame([(1, "John Smith wrote john@x.com today"), (2, "no names in this one"), (3, None)], "id int, t string")
    found = [(1, "PERSON", 0, 10, 0.9), (1, "PERSON", 17, 21, 0.99), (1, "LOC", 28, 400, 0.9), (3, "LOC", 0, 2, 0.9)]
    table = spark.createDataFrame(found, f"id int, {ENTITIES}")
    rows = sanitize(df, "t", entities=table, key="id").orderBy("id").collect()
    assert [r["masked"] for r in rows] == ["[PERSON_1] wrote [EMAIL_1] today", "no names in this one", None]
    one_only = sanitize(df, "t", entities=table, key="id", max_replacements=1).orderBy("id").first()
    assert one_only["masked"] == "[PERSON_1] wrote john@x.com today"


def test_model_spans_in_json(spark):
    first = '{"messages":[{"content":"My \\"name\\" is John Smith"},{"role":"x","content":["ok","Jo@x.com in New York now"]}]}'
    df = bodies(spark, first, "plain text by Ann Lee of Rome", '{"n":1}')
    texts = [(r["id"], r["leaf"], r["text"]) for r in json_texts(df, "id").orderBy("id", "leaf").collect()]
    assert texts == [
        (0, 0, 'My "name" is John Smith'), (0, 1, "ok"), (0, 2, "Jo@x.com in New York now"),
        (1, 0, "plain text by Ann Lee of Rome"),
    ]
    found = [
        (0, 0, "PERSON", 13, 23, 0.9), (0, 2, "LOC", 12, 20, 0.9), (0, 2, "PERSON", 0, 2, 0.99), (0, 7, "LOC", 0, 2, 0.9),
        (0, 0, "MISC", 0, 2, 0.1), (1, 0, "PERSON", 14, 21, 0.8), (2, 0, "LOC", 0, 2, 0.9), (0, -1, "LOC", 0, 2, 0.9),
    ]
    table = spark.createDataFrame(found, f"id long, leaf int, {ENTITIES}")
    rows = sanitize_body(df, entities=table, key="id").orderBy("id").collect()
    assert rows[0]["masked"] == first.replace("John Smith", "[PERSON_1]").replace("Jo@x.com", "[EMAIL_1]").replace("New York", "[LOC_1]")
    assert [r["masked"] for r in rows[1:]] == ["plain text by [PERSON_1] of Rome", '{"n":1}']
    rows = sanitize_json(df, entities=table, key="id").orderBy("id").collect()
    assert [r["is_json"] for r in rows] == [True, False, True] and rows[1]["masked"] == "plain text by Ann Lee of Rome"


def test_model_spans_in_conversations(spark):
    rows = [("c", 0, "Ann Lee asks about x"), ("c", 1, "a@x.com is of Ann Lee now"), (None, 0, "mail a@x.com to me")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, text string")
    found = spark.createDataFrame([("c", 0, "PERSON", 0, 7, 0.9), ("c", 1, "PERSON", 14, 21, 0.9)], f"conv_id string, turn int, {ENTITIES}")
    masked, mappings = sanitize_conversations(df, entities=found)
    got = [r["masked"] for r in masked.orderBy(F.col("conv_id").desc_nulls_last(), "turn").collect()]
    assert got == ["[PERSON_1] asks about x", "[EMAIL_1] is of [PERSON_1] now", "mail [EMAIL_1] to me"]
    assert mappings.count() == 3


def test_custom_detectors_in_json(spark):
    def ssn(text):
        value = F.regexp_extract(text, r"\d{3}-\d{2}-\d{4}", 0)
        at = (F.locate("-", text) - 4).cast("int")
        span = F.struct(F.lit("us-ssn"), value, at, (at + 11).cast("int"), F.lit(0.9), F.lit("regex"))
        return F.filter(F.array(span).cast(f"array<{SPAN}>"), lambda s: s["value"] != "")

    det.register_detector("us-ssn", ssn)
    try:
        row = one(spark, '{"content":["is 123-45-6789.","a@x.com",""]}', types=["us-ssn", "email"])
        assert row["masked"] == '{"content":["is [US_SSN_1].","[EMAIL_1]",""]}'
        assert one(spark, "is 123-45-6789.", sanitize_body, types=["us-ssn"])["masked"] == "is [US_SSN_1]."
    finally:
        det.unregister_detector("us-ssn")
