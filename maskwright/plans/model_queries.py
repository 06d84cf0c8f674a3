"""Queries over words, model output and word pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.numbers import softmax
from maskwright.operators import entities
from maskwright.operators.masking import findings, sanitize
from maskwright.operators.wordpiece import encode_corpus, special_ids, wordpiece
from maskwright.plans import oracle, tables
from maskwright.session import scratch_dir, written
from maskwright.sources.model_files import load_labels, load_vocab

NAMES = "[A-Z][a-z]+ [A-Z][a-z]+|[A-Z][a-z]{7,}"


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Words per document, checked by their number, places and longest word."""
    long = entities.words_with_offsets(tables.documents(spark, folder), ["doc_id"], count="of")
    # The last word of a text is a key of its own: sums of numbers are hashed, while a text among them would have every word sorted.
    last = F.when(F.col("word_index") == F.col("of") - 1, F.col("word")).alias("last_word")
    parts = long.groupBy("doc_id", last).agg(
        F.count("*").alias("n_words"),
        F.sum(F.col("start").cast("bigint") * (F.col("word_index") + 1)).alias("starts"),
        F.sum(F.col("end").cast("bigint") * (F.col("word_index") + 1)).alias("ends"),
        F.max(F.char_length("word")).cast("bigint").alias("longest"),
        F.max("word_index").alias("place"),
    )
    return parts.groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"),
        F.sum("starts").alias("starts"),
        F.sum("ends").alias("ends"),
        F.max("longest").alias("longest"),
        F.max_by("last_word", F.when(F.col("last_word").isNotNull(), F.col("place"))).alias("last_word"),
    )


def ner_gate(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder).select("doc_id", F.expr(entities.ner_gate("text")).alias("passes"))


def softmax_query(spark: SparkSession, folder: str) -> DataFrame:
    scored = tables.table(spark, folder, "embeddings").select("vec_id", F.expr(softmax("embedding")).alias("p"))
    return scored.select(
        "vec_id",
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max("p"), 6).alias("best"),
        F.array_position("p", F.array_max("p")).cast("bigint").alias("place"),
    )


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    return entities.decode_labels(tables.token_logits(spark, folder), tables.labels(spark))


def decode_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _decoded(spark, folder).select("doc_id", "tok", "label", F.round("score", 6).alias("score"))


def merge_bio(spark: SparkSession, folder: str) -> DataFrame:
    placed = _decoded(spark, folder).withColumns({"start": F.col("tok") * 10, "end": F.col("tok") * 10 + 8})
    merged = entities.merge_bio(placed)
    return merged.select("doc_id", "type", "start", "end", F.round("score", 6).alias("score"), "source")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """What a model might name: capitalised words, with scores of which some are too low."""
    found = tables.documents(spark, folder).withColumn(
        "spans", F.expr(entities.regex_spans("text", NAMES, "PERSON", 0.0, source=entities.ENTITY_SOURCE))
    )
    long = findings(found, ["doc_id"])
    return long.select("doc_id", "type", "start", "end", ((F.col("start") % 10 + 1) / 10.0).alias("score"))


def hybrid_detect(spark: SparkSession, folder: str) -> DataFrame:
    both = entities.hybrid_detect(
        tables.documents(spark, folder), _named(spark, folder), "doc_id", types=["email", "phone", "api_key", "jwt"]
    )
    return findings(both, ["doc_id"]).select(
        "doc_id",
        F.col("type").alias("span_type"),
        F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"),
        F.col("value").alias("span_value"),
        F.round("score", 6).alias("score"),
        "source",
    )


def sanitize_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Documents masked by the patterns and by what the model named."""
    masked = sanitize(
        tables.documents(spark, folder),
        types=["email", "phone", "api_key", "jwt"],
        entities=_named(spark, folder),
        key="doc_id",
    )
    return masked.select("doc_id", "masked", F.size("items").cast("bigint").alias("n_items"))


def model_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels written as the model's label file and loaded; each with how often a token got it."""
    path = scratch_dir(spark, "labels")
    entry = F.struct(F.col("id").cast("string").alias("id"), "label")
    # A label file has one entry per class of the model.
    one = tables.labels(spark).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    one.coalesce(1).write.text(path)
    loaded = load_labels(spark, path)
    decoded = entities.decode_labels(tables.token_logits(spark, folder), loaded)
    return decoded.groupBy("label").agg(F.count("*").alias("n"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces as a table, one a row; the special ones must be there."""
    vocab = written(tables.vocabulary(spark, folder), "vocab")
    special_ids(vocab)
    return vocab.select("piece", F.col("id").cast("bigint").alias("id"))


def wordpiece_file(spark: SparkSession, folder: str) -> DataFrame:
    """Words cut by a tokenizer file of the shortest pieces, of which an alphabet has few."""
    path, entry = scratch_dir(spark, "tokenizer"), F.struct("piece", "id")
    short = tables.vocabulary(spark, folder).filter(_SHORT)
    model = F.struct(F.map_from_entries(F.collect_list(entry)).alias("vocab"))
    config = F.struct(model.alias("model"), F.struct(F.lit(True).alias("lowercase")).alias("normalizer"))
    short.agg(F.to_json(config).alias("value")).coalesce(1).write.text(path)
    vocab, lowercase = load_vocab(spark, path)
    docs = tables.documents(spark, folder)
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).alias("word"))
    cut = wordpiece(found, vocab, lowercase=lowercase)
    return cut.select("word", F.array_join(F.col("pieces").cast("array<string>"), ",").alias("pieces"))


def word_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).alias("word"))
    cut = wordpiece(found, tables.vocabulary(spark, folder))
    return cut.select("word", F.array_join(F.col("pieces").cast("array<string>"), ",").alias("pieces"))


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    rows = encode_corpus(tables.documents(spark, folder), tables.vocabulary(spark, folder))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        text("input_ids").alias("input_ids"),
        text("word_index").alias("word_index"),
        F.size("attention_mask").cast("bigint").alias("length"),
    )


_SHORT = "length(replace(piece, '##', '')) = 1 OR piece IN ('[UNK]', '[CLS]', '[SEP]')"

QUERIES = {
    "words": words,
    "ner_gate": ner_gate,
    "softmax": softmax_query,
    "decode_labels": decode_labels,
    "merge_bio": merge_bio,
    "hybrid_detect": hybrid_detect,
    "sanitize_hybrid": sanitize_hybrid,
    "model_labels": model_labels,
    "vocabulary": vocabulary,
    "wordpiece": word_pieces,
    "wordpiece_file": wordpiece_file,
    "encode_corpus": encoded,
}

_P = r"'[\p{L}\p{Nd}]+'"
_WORDS = f"""SELECT doc_id, hit, i, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
  SELECT doc_id, unnest(g[1:len(m)]) AS gap, unnest(m) AS hit, unnest(range(len(m))) AS i FROM (
    SELECT doc_id, string_split_regex(text, {_P}) AS g, regexp_extract_all(text, {_P}) AS m FROM documents))"""
_SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_GATE = (
    r"strlen(text) >= 8 AND "
    r"length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / length(text) > 0.4 AND "
    f"length(regexp_replace(text, '[^{_SPACE}]+', '', 'g'))::DOUBLE / length(text) > 0.05"
)
_SOFTMAX = """SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p FROM (
  SELECT *, list_transform(l, lambda x: exp((x - list_max(l))::DOUBLE)) AS w FROM (SELECT *, {} AS l FROM ({})))""".format
_DECODED = f"""SELECT d.doc_id, d.tok, coalesce(l.label, 'O') AS label, d.score FROM (
  SELECT doc_id, tok, list_max(p) AS score, list_position(p, list_max(p)) - 1 AS id FROM ({_SOFTMAX('logits',
    f"SELECT * FROM (SELECT *, min(tok) OVER (PARTITION BY doc_id) AS lo, max(tok) OVER (PARTITION BY doc_id) AS hi FROM ({tables.LOGITS_SQL})) WHERE tok > lo AND tok < hi")})) d
  LEFT JOIN ({tables.LABELS_SQL}) l ON l.id = d.id"""
_BIO = f"""SELECT doc_id, max(kind) AS kind, min(tok) * 10 AS start, max(tok) * 10 + 8 AS "end", avg(score) AS score FROM (
  SELECT *, sum(CASE WHEN kind IS NOT NULL AND (label LIKE 'B-%' OR kind IS DISTINCT FROM prev) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY tok) AS entity FROM (
    SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY tok) AS prev FROM (
      SELECT *, CASE WHEN label <> 'O' THEN label[3:] END AS kind FROM ({_DECODED})
      WHERE label = 'O' OR label LIKE 'B-%' OR label LIKE 'I-%')))
  WHERE kind IS NOT NULL GROUP BY doc_id, entity"""

_BASIC = ["email", "phone", "api_key", "jwt"]
_HYBRID = (
    "WITH "
    + oracle.spans_sql("SELECT doc_id, text FROM documents", "doc_id", _BASIC)
    + f""", named AS (
  SELECT doc_id, hit AS value, e - length(hit) AS s, e FROM (
    SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(g[1:len(m)]) AS gap, unnest(m) AS hit, unnest(range(len(m))) AS i FROM (
        SELECT doc_id, string_split_regex(text, '{NAMES}') AS g, regexp_extract_all(text, '{NAMES}') AS m
        FROM documents WHERE {_GATE})))),
every AS (SELECT doc_id, type, value, s, e, score, src, ord FROM spans UNION ALL
  SELECT doc_id, 'PERSON', value, CAST(s AS BIGINT), CAST(e AS BIGINT), CAST((s % 10 + 1) / 10.0 AS DOUBLE), 'onnx-ner', 99
  FROM named WHERE (s % 10 + 1) / 10.0 >= 0.7),
"""
    + oracle.chosen_sql("doc_id", "prefer", spans="every")
)

_PIECES = f"""WITH RECURSIVE vocab AS ({tables.VOCAB_SQL}),
forms AS (SELECT DISTINCT lower(w) AS form FROM (SELECT unnest(regexp_extract_all(text, {_P})) AS w FROM documents)),
walk(form, pos, ids) AS (
  SELECT form, 0, CAST([] AS BIGINT[]) FROM forms
  UNION ALL
  SELECT form, pos + size, list_append(ids, id) FROM (
    SELECT w.form, w.pos, w.ids, v.id, n.size, row_number() OVER (PARTITION BY w.form ORDER BY n.size DESC) AS rank
    FROM walk w JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS size) n ON w.pos + n.size <= length(w.form)
    JOIN vocab v ON v.piece = CASE WHEN w.pos > 0 THEN '##' ELSE '' END || substr(w.form, w.pos + 1, n.size)) WHERE rank = 1),
cut AS (SELECT forms.form, coalesce(d.ids, [CAST(1 AS BIGINT)]) AS ids FROM forms
  LEFT JOIN (SELECT form, ids FROM walk WHERE pos = length(form)) d ON d.form = forms.form)"""

_CUT = (
    "SELECT word, array_to_string(ids, ',') AS pieces FROM (SELECT DISTINCT w AS word FROM "
    f"(SELECT unnest(regexp_extract_all(text, {_P})) AS w FROM documents)) JOIN cut ON form = lower(word)"
)

ORACLES = {
    "words": "SELECT doc_id, count(*) AS n_words, CAST(sum((e - length(hit)) * (i + 1)) AS BIGINT) AS starts, "
    "CAST(sum(e * (i + 1)) AS BIGINT) AS ends, max(length(hit)) AS longest, arg_max(hit, i) AS last_word "
    f"FROM ({_WORDS}) GROUP BY doc_id",
    "ner_gate": f"SELECT doc_id, {_GATE} AS passes FROM documents",
    "softmax": "SELECT vec_id, round(list_sum(p), 6) AS total, round(list_max(p), 6) AS best, "
    "CAST(list_position(p, list_max(p)) AS BIGINT) AS place FROM "
    f"({_SOFTMAX('embedding', 'SELECT * FROM embeddings')})",
    "decode_labels": f"SELECT doc_id, tok, label, round(score, 6) AS score FROM ({_DECODED})",
    "merge_bio": "SELECT doc_id, CASE kind WHEN 'PER' THEN 'PERSON' WHEN 'GPE' THEN 'LOC' ELSE kind END AS type, "
    f"start, \"end\", round(score, 6) AS score, 'onnx-ner' AS source FROM ({_BIO})",
    "hybrid_detect": f"{_HYBRID} SELECT doc_id, type AS span_type, s AS span_start, e AS span_end, value AS span_value, "
    "round(score, 6) AS score, src AS source FROM chosen",
    "sanitize_hybrid": f"{_HYBRID}, {oracle.masked_sql('doc_id')} SELECT doc_id, masked, n_items FROM masked",
    "model_labels": f"SELECT label, count(*) AS n FROM ({_DECODED}) GROUP BY label",
    "vocabulary": tables.VOCAB_SQL,
    "wordpiece": f"{_PIECES} {_CUT}",
    "wordpiece_file": _PIECES.replace(tables.VOCAB_SQL, f"SELECT * FROM ({tables.VOCAB_SQL}) WHERE {_SHORT}") + f" {_CUT}",
    "encode_corpus": f"""{_PIECES},
words AS (SELECT doc_id, unnest(m) AS word, unnest(range(len(m))) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, {_P}) AS m FROM documents)),
long AS (SELECT * FROM (
  SELECT doc_id, i, id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS place FROM (
    SELECT doc_id, i, unnest(ids) AS id, unnest(range(len(ids))) AS j FROM words JOIN cut ON form = lower(word))))
SELECT d.doc_id, CASE WHEN n IS NULL THEN '2,3' ELSE '2,' || ids || ',3' END AS input_ids,
  CASE WHEN n IS NULL THEN '-1,-1' ELSE '-1,' || idx || ',-1' END AS word_index, coalesce(n, 0) + 2 AS length
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids,
    string_agg(CAST(i AS VARCHAR), ',' ORDER BY place) AS idx
  FROM long
  GROUP BY doc_id) l ON l.doc_id = d.doc_id""",
}
