"""The given tables and what is derived from them, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


# Documents with one secret of every kind written at their end.
_PLANTED = """CASE doc_id % 11
  WHEN 0 THEN 'AKIA' || substr(upper(md5(k)), 1, 16)
  WHEN 1 THEN 'aws_secret_access_key = ' || substr(md5(k) || md5(k), 1, 40)
  WHEN 2 THEN 'AWS_SESSION_TOKEN: "' || md5(k) || md5(k) || md5(k) || md5(k) || '"'
  WHEN 3 THEN 'AIza' || substr(md5(k) || md5(k), 1, 35)
  WHEN 4 THEN '{"type": "service_account"}'
  WHEN 5 THEN 'DefaultEndpointsProtocol=https;AccountName=acct;AccountKey=' || md5(k) || '=='
  WHEN 6 THEN 'https://x.blob.core.windows.net/c?sv=2022-11-02&ss=b&sig=' || md5(k)
  WHEN 7 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(k) || chr(10) || '-----END RSA PRIVATE KEY-----'
  WHEN 8 THEN 'postgres://user:' || md5(k) || '@db.example.com:5432/app'
  WHEN 9 THEN md5(k) || upper(md5(k))
  ELSE 'ghijklmnopqrstuvwxyzGHIJ' || md5(k) END"""
PLANTED_SQL = (
    f"SELECT doc_id, text || ' ' || {_PLANTED} AS text FROM "
    "(SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS k FROM documents)"
)


def planted(spark: SparkSession, folder: str) -> DataFrame:
    keyed = documents(spark, folder).withColumn("k", F.col("doc_id").cast("string"))
    return keyed.select("doc_id", F.expr(f"text || ' ' || {_PLANTED}").alias("text"))


# Turns of conversations that mention people by address, some of them again and again.
_ADDRESSED = (
    "text || ' u' || (conv_id % 7) || '@example.com wrote to t' || (turn % 3) || '@example.org, cc u' "
    "|| ((conv_id + turn) % 7) || '@example.com'"
)
TURNS_SQL = f"SELECT conv_id, turn, role, {_ADDRESSED} AS text FROM conversations"


def turns(spark: SparkSession, folder: str) -> DataFrame:
    read = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    return read.select("conv_id", "turn", "role", F.expr(_ADDRESSED).alias("text"))


# Requests made of the turns: two content fields, one of them a list, and a field that is never touched.
_REQUEST_COLUMNS = [
    "conv_id * 100 + turn AS request_id",
    "CASE WHEN turn % 5 = 4 THEN 'GET' ELSE 'POST' END AS method",
    "CASE WHEN conv_id % 5 = 0 THEN 'api.blocked.example' ELSE 'api.openai.com:443' END AS host",
    "'/v1/chat' AS path",
    "CASE (conv_id + turn) % 6 WHEN 4 THEN 'text/event-stream' WHEN 5 THEN 'text/plain' "
    "WHEN 3 THEN 'Application/JSON; charset=utf-8' ELSE 'application/json' END AS content_type",
    "CASE WHEN conv_id % 13 = 0 THEN -1 WHEN conv_id % 17 = 0 THEN 300000 ELSE 1000 END AS content_length",
    "text AS content",
    "'note for t' || (turn % 3) || '@example.org and v' || (conv_id % 7) || '@example.net' AS input",
]
REQUESTS_SQL = f"SELECT {', '.join(_REQUEST_COLUMNS)} FROM ({TURNS_SQL})"


def request_parts(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).selectExpr(*_REQUEST_COLUMNS)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with a JSON body; every third one has its content as plain text instead."""
    parts = request_parts(spark, folder)
    body = F.to_json(
        F.struct(
            F.lit("m-1").alias("model"),
            F.struct(F.col("content").alias("content"), F.lit(1.50).alias("weight")).alias("message"),
            F.array("input").alias("input"),
            F.lit("bob@example.com").alias("token"),
        )
    )
    return parts.withColumn("body", F.when(F.col("request_id") % 3 == 0, F.col("content")).otherwise(body))


# The audit log, as the requests behind the events would have left it.
_AUDIT_COLUMNS = [
    "event_id",
    "'POST' AS method",
    "'api-' || (user_id % 7) || '.example.com' AS host",
    "'/v1/chat' AS path",
    "CAST(CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS INT) AS status_code",
    "CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS decision",
    "'matched rule (r1)' AS reason",
    "CASE WHEN event_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE value / 100 END AS sanitize_latency_ms",
    "CASE WHEN event_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS upstream_latency_ms",
    "CASE WHEN event_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE value * CAST(1.01 AS DOUBLE) END AS total_latency_ms",
]
AUDIT_SQL = (
    f"SELECT ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS \"timestamp\", {', '.join(_AUDIT_COLUMNS)}, "
    "CASE event_type WHEN 'signup' THEN ['email'] WHEN 'purchase' THEN ['email', ' phone '] "
    "WHEN 'error' THEN [' '] ELSE [] END AS types FROM events"
)


def audit(spark: SparkSession, folder: str) -> DataFrame:
    item = "named_struct('type', '{0}', 'placeholder', '[{1}_1]')".format
    items = (
        f"CASE event_type WHEN 'signup' THEN array({item('email', 'EMAIL')}) "
        f"WHEN 'purchase' THEN array({item('email', 'EMAIL')}, {item(' phone ', 'PHONE')}) "
        f"WHEN 'error' THEN array({item(' ', '')}) "
        "ELSE cast(array() as array<struct<type:string,placeholder:string>>) END AS sanitized_items"
    )
    return table(spark, folder, "events").selectExpr(
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp",
        *_AUDIT_COLUMNS,
        "event_type <> 'view' AND event_type <> 'click' AS sanitized",
        items,
    )


# Hosts of the pages, some with ports or in forms that do not parse.
_HOST = """CASE page_id % 6
  WHEN 0 THEN h WHEN 1 THEN h || ':8443' WHEN 2 THEN '[::1]:' || (page_id % 100)
  WHEN 3 THEN h || ':80:90' WHEN 4 THEN upper(h) ELSE ' api.openai.com ' END"""
HOSTS_SQL = (
    f"SELECT page_id, url, h, {_HOST} AS host FROM "
    "(SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)"
)


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    read = table(spark, folder, "pages").select("page_id", "url")
    named = read.withColumn("h", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return named.select("page_id", "url", "h", F.expr(_HOST).alias("host"))


# Traces of requests: some steps missing, some out of order.
_STEPS = {
    "start_ts": "0",
    "sanitize_start": "1",
    "sanitize_end": "1 + event_id % 5",
    "upstream_start": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 10 END",
    "first_byte": "5 + event_id % 40",
    "upstream_end": "60",
    "response_start": "61",
    "response_end": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 70 END",
    "end_ts": "80 + event_id % 3",
}
TRACES_SQL = (
    "SELECT event_id AS id, "
    + ", ".join(f"ts + to_milliseconds({ms}) AS {name}" for name, ms in _STEPS.items())
    + " FROM events"
)


def traces(spark: SparkSession, folder: str) -> DataFrame:
    read = table(spark, folder, "events")
    return read.selectExpr(
        "event_id AS id", *[f"timestampadd(MILLISECOND, {ms}, ts) AS {name}" for name, ms in _STEPS.items()]
    )


# Model output: an embedding stands in for the logits of a token, fifty of them make a sequence.
LABELS_SQL = (
    "SELECT i AS id, CASE i % 9 WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-PER' WHEN 3 THEN 'B-ORG' "
    "WHEN 4 THEN 'I-ORG' WHEN 5 THEN 'I-GPE' WHEN 6 THEN 'B-PER' WHEN 7 THEN 'X-BAD' ELSE 'MISC' END AS label "
    "FROM range(60) t(i)"
)
LOGITS_SQL = "SELECT CAST(vec_id // 50 AS BIGINT) AS doc_id, vec_id % 50 AS tok, embedding AS logits FROM embeddings"


def labels(spark: SparkSession) -> DataFrame:
    kinds = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "I-GPE", "B-PER", "X-BAD", "MISC"]
    name = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 9 + 1).cast("int"))
    return spark.range(60).select("id", name.alias("label"))


def token_logits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id div 50 AS doc_id", "vec_id % 50 AS tok", "embedding AS logits"
    )


# A vocabulary of letters and beginnings of words; a few letters are unknown.
VOCAB_SQL = """SELECT piece, CASE piece WHEN '[UNK]' THEN 1 WHEN '[CLS]' THEN 2 WHEN '[SEP]' THEN 3
    ELSE CAST('0x' || substr(md5(piece), 1, 7) AS BIGINT) END AS id FROM (
  SELECT DISTINCT piece FROM (
    SELECT unnest([substr(w, 1, 1), substr(w, 1, 2), substr(w, 1, 3), '##' || substr(w, 2, 1), '##' || substr(w, 3, 1),
      '##' || substr(w, 2, 2), '##' || substr(w, 4, 3)]) AS piece
    FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS w FROM benchmark))
  WHERE piece NOT IN ('', '##') AND NOT contains(piece, 'k')
  UNION SELECT unnest(['[UNK]', '[CLS]', '[SEP]']))"""


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).alias("w")
    )
    cuts = [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (2, 2), (4, 3)]
    marks = ["", "", "", "##", "##", "##", "##"]
    parts = F.array(*[F.concat(F.lit(m), F.substring("w", p, n)) for m, (p, n) in zip(marks, cuts, strict=True)])
    cut = words.select(F.explode(parts).alias("piece")).filter("piece not in ('', '##') and not contains(piece, 'k')")
    special = spark.createDataFrame([("[UNK]",), ("[CLS]",), ("[SEP]",)], "piece string")
    number = F.expr(
        "case piece when '[UNK]' then 1 when '[CLS]' then 2 when '[SEP]' then 3 "
        "else cast(conv(substr(md5(piece), 1, 7), 16, 10) as int) end"
    )
    return cut.unionByName(special).distinct().select("piece", number.alias("id"))
