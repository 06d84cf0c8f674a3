"""Queries over hosts, rules, requests and their JSON bodies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.hosts import classify_host, connect_target, normalize_host
from maskwright.operators import traffic
from maskwright.operators.jsonmask import sanitize_body, sanitize_json, should_sanitize
from maskwright.operators.policy import evaluate_policy, intercept_scope
from maskwright.plans import oracle, tables
from maskwright.session import scratch_dir, written
from maskwright.sources.rules import load_rules
from maskwright.streaming.sanitize import mask_requests, sanitize_stream

RULES = [
    {"id": "r1", "host": "API.openai.com", "action": "mitm"},
    {"id": "", "host_contains": "Casino", "action": "block"},
    {"id": "r3", "host_contains": "example.net", "action": "ALLOW"},
    {"id": "r4", "host_contains": "blog.", "host": "m.example.com", "action": "inspect"},
    {"id": "r5", "host_contains": ".example.org", "action": "mitm"},
]
DOMAINS = ["openai.com", " Example.org "]
REQUEST_RULES = [{"id": "no", "host": "api.blocked.example", "action": "block"}]


def normalize(spark: SparkSession, folder: str) -> DataFrame:
    return tables.hosts(spark, folder).select("page_id", normalize_host(F.col("host")).alias("name"))


def connect(spark: SparkSession, folder: str) -> DataFrame:
    return tables.hosts(spark, folder).select("page_id", connect_target(F.col("host")).alias("target"))


def classify(spark: SparkSession, folder: str) -> DataFrame:
    return tables.hosts(spark, folder).select("page_id", classify_host(F.col("host")).alias("category"))


def _clean_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.hosts(spark, folder).select("page_id", F.trim(normalize_host(F.col("host"))).alias("host"))


def policy(spark: SparkSession, folder: str) -> DataFrame:
    decided = evaluate_policy(_clean_hosts(spark, folder), RULES)
    return decided.select("page_id", "decision", "reason", "rule_id")


def policy_rules_file(spark: SparkSession, folder: str) -> DataFrame:
    """The rules written as a configuration file and loaded from there."""
    path = scratch_dir(spark, "rules-file")
    named = [{"id": r["id"], "match": {k: v for k, v in r.items() if k.startswith("host")}, "action": r["action"]} for r in RULES]
    spark.range(1).select(F.lit(json.dumps({"rules": named}, indent=1)).alias("value")).write.text(path)
    decided = evaluate_policy(_clean_hosts(spark, folder), load_rules(spark, path))
    return decided.select("page_id", "decision", "reason", "rule_id")


def policy_rules_table(spark: SparkSession, folder: str) -> DataFrame:
    """One rule per host, as a table; more than 100 hosts take the form of equi-joins."""
    listed = _clean_hosts(spark, folder).groupBy("host").agg(F.min("page_id").alias("ord"))
    part = F.substring_index("host", ".", 1)
    text = lambda c: F.coalesce(c, F.lit(""))
    rules = listed.select(
        "ord",
        text(F.concat(F.lit("p"), "ord")).alias("id"),
        text(F.when(F.col("ord") % 2 == 0, F.col("host"))).alias("host"),
        text(F.when(F.col("ord") % 2 == 1, F.concat(part, F.lit(".")))).alias("host_contains"),
        F.when(F.col("ord") % 4 == 0, F.lit("block")).otherwise("allow").alias("action"),
    )
    decided = evaluate_policy(_clean_hosts(spark, folder), written(rules, "rules"))
    return decided.select("page_id", "decision", "rule_id")


def scope(spark: SparkSession, folder: str) -> DataFrame:
    decided = evaluate_policy(_clean_hosts(spark, folder), RULES)
    return intercept_scope(decided, DOMAINS).select("page_id", "inspect")


def request_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    reason = traffic.request_skip_reason(
        F.col("method"), F.col("content_type"), F.col("content_length"), F.col("content")
    )
    return tables.request_parts(spark, folder).select(
        "request_id", F.coalesce(reason, F.lit("inspect")).alias("skip_reason")
    )


def response_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    encoding = F.when(F.col("request_id") % 7 == 0, F.lit("gzip"))
    transfer = F.when(F.col("request_id") % 2 == 0, F.array(F.lit("Chunked")))
    reason = traffic.response_skip_reason(
        F.col("content_type"),
        transfer,
        encoding,
        F.col("content_length"),
        F.col("content"),
        F.lit(True),
        F.col("request_id") % 3 != 0,
    )
    return tables.request_parts(spark, folder).select(
        "request_id", F.coalesce(reason, F.lit("restore")).alias("skip_reason")
    )


def preview(spark: SparkSession, folder: str) -> DataFrame:
    return tables.request_parts(spark, folder).select(
        "request_id", traffic.body_preview(F.col("content"), F.col("content_type")).alias("preview")
    )


def key_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Field names, the roles of turns among them, and whether their values are masked."""
    names = F.explode(
        F.array("role", F.upper("role"), F.lit("Content"), F.lit("token"), F.lit("X-API-Key"), F.lit("parts"))
    )
    keys = tables.table(spark, folder, "conversations").select(names.alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).withColumn("masked", should_sanitize(F.col("key")))


def _body_parts(df: DataFrame, *more: str) -> DataFrame:
    part = lambda path: F.get_json_object("masked", path)
    return df.select(
        "request_id",
        F.when(F.col("is_json"), part("$.message.content")).otherwise(F.col("masked")).alias("content"),
        part("$.input[0]").alias("input"),
        part("$.token").alias("token"),
        F.size("items").cast("bigint").alias("n_items"),
        *more,
    )


def json_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """All bodies; those that are not JSON stay as they are."""
    masked = sanitize_json(tables.requests(spark, folder), types=["email"])
    return _body_parts(masked, "is_json")


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    return _body_parts(sanitize_body(tables.requests(spark, folder), types=["email"]))


def _stream_requests(spark: SparkSession, folder: str) -> DataFrame:
    return tables.requests(spark, folder).select(
        "request_id", "method", "host", "path", "content_type", "content_length", "body"
    )


def audit_record(spark: SparkSession, folder: str) -> DataFrame:
    masked = mask_requests(_stream_requests(spark, folder), REQUEST_RULES, types=["email"])
    rows = traffic.audit_record(masked.withColumn("path", F.concat("path", F.lit("/"), F.col("request_id"))))
    return rows.select(
        F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint").alias("request_id"),
        "method",
        "host",
        "decision",
        "reason",
        "sanitized",
        F.concat_ws(",", F.col("sanitized_items")["placeholder"]).alias("placeholders"),
    )


def stream_of_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The requests as files that arrive, masked by the stream; what it wrote, with its mappings counted."""
    source, output = scratch_dir(spark, "requests"), scratch_dir(spark, "sanitized")
    arriving = _stream_requests(spark, folder)
    arriving.write.json(source)
    stream = spark.readStream.schema(arriving.schema).json(source)
    query = sanitize_stream(
        stream, output, scratch_dir(spark, "checkpoint"), REQUEST_RULES, types=["email"], available_now=True
    )
    query.awaitTermination()
    masked = spark.read.parquet(f"{output}/masked")
    counts = spark.read.parquet(f"{output}/mappings").groupBy("request_id").agg(F.count("*").alias("n"))
    is_json = F.col("masked").startswith("{")
    return masked.join(counts, "request_id", "left").select(
        "request_id",
        F.coalesce("skip_reason", F.lit("masked")).alias("skip_reason"),
        F.when(is_json, F.get_json_object("masked", "$.message.content")).otherwise(F.col("masked")).alias("content"),
        F.coalesce("n", F.lit(0)).alias("n_items"),
    )


QUERIES = {
    "normalize_host": normalize,
    "connect_target": connect,
    "classify_host": classify,
    "policy": policy,
    "policy_rules_file": policy_rules_file,
    "policy_rules_table": policy_rules_table,
    "intercept_scope": scope,
    "request_eligibility": request_eligibility,
    "response_eligibility": response_eligibility,
    "body_preview": preview,
    "key_filter": key_filter,
    "sanitize_json": json_bodies,
    "sanitize_body": bodies,
    "audit_record": audit_record,
    "sanitize_stream": stream_of_requests,
}

_NAME = (
    "CASE WHEN page_id % 6 = 1 THEN h WHEN page_id % 6 = 2 THEN '::1' WHEN page_id % 6 = 3 THEN h ELSE host END"
)
_CLEAN = f"SELECT page_id, trim({_NAME}) AS host FROM ({tables.HOSTS_SQL})"


def _first_rule(rules: list[tuple[str, str, str, str]], default: tuple[str, str, str]) -> str:
    """CASE expressions (decision, reason, rule_id) over (condition, decision, reason, rule_id)."""
    out = []
    for i, name in enumerate(("decision", "reason", "rule_id")):
        whens = " ".join(f"WHEN {r[0]} THEN {oracle.q(r[i + 1])}" for r in rules)
        out.append(f"CASE {whens} ELSE {oracle.q(default[i])} END AS {name}")
    return ", ".join(out)


_DECIDED = "SELECT page_id, host, " + _first_rule(
    [
        ("lower(host) = 'api.openai.com'", "mitm", "matched rule", "r1"),
        ("contains(lower(host), 'casino')", "block", "matched rule", "unnamed"),
        ("contains(lower(host), 'example.net')", "allow", "matched rule", "r3"),
        (
            "contains(lower(host), 'blog.') OR lower(host) = 'm.example.com'",
            "block",
            'invalid action "inspect"',
            "r4",
        ),
        ("contains(lower(host), '.example.org')", "mitm", "matched rule", "r5"),
    ],
    ("allow", "default allow", "default"),
) + f" FROM ({_CLEAN})"

_RULES_TABLE = f"""SELECT ord, 'p' || ord AS id, CASE WHEN ord % 2 = 0 THEN host ELSE '' END AS exact,
  CASE WHEN ord % 2 = 1 THEN string_split(host, '.')[1] || '.' ELSE '' END AS part,
  CASE WHEN ord % 4 = 0 THEN 'block' ELSE 'allow' END AS action
  FROM (SELECT host, min(page_id) AS ord FROM ({_CLEAN}) GROUP BY host)"""

_MENTIONS = "contains(lower(content_type), '{}')".format
_NEWLINE = "chr(10)"


def _masked_bodies(where: str = "true", where_masked: str = "true") -> str:
    """Both content fields of a body as one text, masked and cut again; plain bodies are their content."""
    source = (
        f"SELECT request_id, CASE WHEN request_id % 3 = 0 THEN content ELSE content || {_NEWLINE} || input END AS text "
        f"FROM ({tables.REQUESTS_SQL}) WHERE {where}"
    )
    return oracle.sanitize_sql(source, "request_id", ["email"])


_JSON_COLUMNS = r"""request_id,
  CASE WHEN request_id % 3 = 0 THEN masked ELSE regexp_replace(masked, '\n[^\n]*$', '') END AS content,
  CASE WHEN request_id % 3 = 0 THEN NULL ELSE regexp_extract(masked, '\n([^\n]*)$', 1) END AS input,
  CASE WHEN request_id % 3 = 0 THEN NULL ELSE 'bob@example.com' END AS token, n_items"""

_REASON = f"""CASE WHEN method <> 'POST' THEN 'method'
  WHEN {_MENTIONS('text/event-stream')} THEN 'event stream'
  WHEN NOT {_MENTIONS('application/json')} THEN 'content type' END"""
_SKIPPED = (
    f"SELECT request_id, method, content, CASE WHEN host = 'api.blocked.example' THEN 'blocked' ELSE {_REASON} END "
    f"AS skip_reason FROM ({tables.REQUESTS_SQL})"
)

ORACLES = {
    "normalize_host": f"SELECT page_id, {_NAME} AS name FROM ({tables.HOSTS_SQL})",
    "connect_target": "SELECT page_id, CASE WHEN contains(trim(host), ':') THEN trim(host) ELSE trim(host) || ':443' END "
    f"AS target FROM ({tables.HOSTS_SQL})",
    "classify_host": "SELECT page_id, CASE WHEN contains(lower(host), 'openai.com') THEN 'LLM_OPENAI' "
    "WHEN contains(lower(host), 'anthropic.com') THEN 'LLM_ANTHROPIC' ELSE 'UNKNOWN' END AS category "
    f"FROM ({tables.HOSTS_SQL})",
    "policy": f"SELECT page_id, decision, reason, rule_id FROM ({_DECIDED})",
    "policy_rules_file": f"SELECT page_id, decision, reason, rule_id FROM ({_DECIDED})",
    "policy_rules_table": "SELECT page_id, coalesce(action, 'allow') AS decision, coalesce(id, 'default') AS rule_id "
    f"FROM (SELECT h.page_id, arg_min(r.action, r.ord) AS action, arg_min(r.id, r.ord) AS id FROM ({_CLEAN}) h "
    f"LEFT JOIN ({_RULES_TABLE}) r ON (r.exact <> '' AND lower(h.host) = lower(r.exact)) "
    "OR (r.part <> '' AND contains(lower(h.host), lower(r.part))) GROUP BY h.page_id)",
    "intercept_scope": "SELECT page_id, decision = 'mitm' AND (lower(host) IN ('openai.com', 'example.org') "
    "OR ends_with(lower(host), '.openai.com') OR ends_with(lower(host), '.example.org')) AS inspect "
    f"FROM ({_DECIDED})",
    "request_eligibility": f"SELECT request_id, coalesce({_REASON}, CASE "
    f"WHEN strlen(content) = 0 THEN 'empty' END, 'inspect') AS skip_reason FROM ({tables.REQUESTS_SQL})",
    "response_eligibility": f"""SELECT request_id, CASE
  WHEN request_id % 7 = 0 THEN 'compressed'
  WHEN request_id % 3 = 0 THEN 'no mapping' ELSE 'restore' END AS skip_reason FROM ({tables.REQUESTS_SQL})""",
    "body_preview": f"SELECT request_id, CASE WHEN {_MENTIONS('application/json')} "
    f"THEN replace(left(content, 512), {_NEWLINE}, '') ELSE '' END AS preview FROM ({tables.REQUESTS_SQL})",
    "key_filter": "SELECT key, count(*) AS n, lower(key) IN ('content', 'parts') AS masked FROM (SELECT "
    "unnest([role, upper(role), 'Content', 'token', 'X-API-Key', 'parts']) AS key FROM conversations) GROUP BY key",
    "sanitize_json": f"{_masked_bodies()}, cut AS (SELECT {_JSON_COLUMNS} FROM masked) "
    "SELECT c.request_id, c.request_id % 3 <> 0 AS is_json, "
    "CASE WHEN c.request_id % 3 = 0 THEN s.text ELSE c.content END AS content, c.input, c.token, "
    "CASE WHEN c.request_id % 3 = 0 THEN 0 ELSE c.n_items END AS n_items "
    "FROM cut c JOIN src s ON s.request_id = c.request_id",
    "sanitize_body": f"{_masked_bodies()} SELECT {_JSON_COLUMNS} FROM masked",
    "audit_record": f"{_masked_bodies()} SELECT s.request_id, s.method, "
    "CASE WHEN s.skip_reason = 'blocked' OR (s.request_id // 100) % 5 = 0 THEN 'api.blocked.example' "
    "ELSE 'api.openai.com' END AS host, "
    "CASE WHEN s.skip_reason = 'blocked' THEN 'block' ELSE 'allow' END AS decision, "
    "CASE WHEN s.skip_reason = 'blocked' THEN 'matched rule (no)' ELSE 'default allow (default)' END AS reason, "
    "s.skip_reason IS NULL AND m.n_items > 0 AS sanitized, "
    "CASE WHEN s.skip_reason IS NULL THEN coalesce(p.l, '') ELSE '' END AS placeholders "
    f"FROM ({_SKIPPED}) s JOIN masked m ON m.request_id = s.request_id LEFT JOIN (SELECT request_id, "
    "string_agg(placeholder, ',' ORDER BY placeholder) AS l FROM (SELECT DISTINCT request_id, placeholder FROM placed) "
    "GROUP BY request_id) p ON p.request_id = s.request_id",
    "sanitize_stream": f"{_masked_bodies()}, cut AS (SELECT {_JSON_COLUMNS} FROM masked) "
    "SELECT s.request_id, coalesce(s.skip_reason, 'masked') AS skip_reason, "
    "CASE WHEN s.skip_reason IS NULL THEN c.content ELSE s.content END AS content, "
    "CASE WHEN s.skip_reason IS NULL THEN c.n_items ELSE 0 END AS n_items "
    f"FROM ({_SKIPPED}) s JOIN cut c ON c.request_id = s.request_id",
}
