"""The registered queries of these operators, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import (
    byte_bpe,
    decontamination,
    near_duplicates,
    personal_data,
    quality,
    ranked_search,
    repeated_text,
    spelling_variants,
    token_counts,
    toxicity,
    url_rules,
    vector_links,
    warc,
)
from maskwright.llm.common import hashed_remainder, table
from maskwright.session import scratch_dir, written

TOKEN_LIMIT = 4096
REPEATED_BYTES = 400
LEAST_COSINE = 0.93
SITE_RULES = [
    url_rules.host_rule("allow", "com/"),
    url_rules.host_rule("block", "example.com/en/"),
    url_rules.host_rule("allow", "www.example.com/en/"),
    url_rules.host_rule("block", "net/es/"),
    url_rules.host_rule("block", "net/fr/"),
]
UNWANTED = [
    url_rules.pattern_rule("block", f".{name}.")
    for name in ("ads-track", "cheap-pills", "spam-farm", "free-casino", "click-bait", "adult-cams")
]


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op2_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ready = written(quality.add_features(docs), "quality-features")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    learn = ready.join(labels, "doc_id").filter(hashed_remainder("doc_id", 3) != 1)
    ranking = quality.fit_ranking(learn)
    return ready.select(
        "doc_id", (hashed_remainder("doc_id", 3) == 1).alias("held_out"), ranking.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.token_digests(docs, path, public_tokenizers.PATTERN)


def op4_repeated_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = repeated_text.remove_repeats(docs, ["doc_id"], length=REPEATED_BYTES)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_items(docs, table(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(decontamination.CONTAMINATED).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return personal_data.summarise(personal_data.find_spans(docs, ["doc_id"]), ["doc_id"])


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, SITE_RULES + UNWANTED, ["page_id"])


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op9_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links.link_vectors(table(spark, folder, "embeddings"), LEAST_COSINE)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    lexicon = toxicity.fit_lexicon(docs.join(labels, "doc_id").filter(hashed_remainder("doc_id", 5) != 0))
    scored = toxicity.score_texts(docs, lexicon)
    return scored.select("doc_id", (hashed_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_hits")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.count_words(table(spark, folder, "documents")))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ranked_search.rank_documents(docs, table(spark, folder, "benchmark"), k=10)


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_dir(spark, "warc-archive")
    warc.write_archive(table(spark, folder, "pages"), archive)
    return warc.read_archive(spark, archive).select(
        warc.record_key("id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        warc.record_key("refers").alias("refers_to"),
    )


_HOST = "coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '')"
_RULE = """CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END"""
_UNWANTED = " OR ".join(
    f"contains('.' || host || path, '.{n}.')"
    for n in ("ads-track", "cheap-pills", "spam-farm", "free-casino", "click-bait", "adult-cams")
)
OP7_SQL = f"""
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN {_UNWANTED} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, {_RULE} AS rule FROM (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages))
"""

OP1_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM split WHERE w IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * c >= 75 * (sa.n + sb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS start, a AS here FROM both_ways UNION SELECT r.start, e.b FROM reach r JOIN both_ways e ON e.a = r.here),
roots AS (SELECT start, min(here) AS root FROM reach GROUP BY start)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN roots ON roots.start = d.doc_id
"""

OP9_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
sized AS (SELECT * FROM (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM good) WHERE size > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sized x JOIN sized y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE len(x.e) = len(y.e) AND list_inner_product(x.e, y.e) / (x.size * y.size) >= 0.93),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT a AS start, a AS here FROM links UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.here),
roots AS (SELECT start, min(here) AS root FROM reach GROUP BY start)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(root, v.vec_id) AS component_id,
  coalesce(root, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN counts ON counts.a = v.vec_id LEFT JOIN roots ON roots.start = v.vec_id
"""

OP11_SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS r FROM documents),
counted AS (SELECT doc_id, r, count(*) AS n FROM said WHERE length(r) >= 6 GROUP BY 1, 2),
bits AS (
  SELECT doc_id, r, n, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, 2 * strlen(coalesce(doc_id::VARCHAR, '') || ':' || r), 2),
      lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), i, 2))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS c FROM counted),
hashed AS (SELECT r, n, xor(c, 4294967295::UBIGINT) AS h FROM bits),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, unnest(range(0, length(word))) AS i FROM words),
keys AS (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS k FROM cut),
shorter AS (SELECT DISTINCT keys.word, o.word AS other FROM keys JOIN words o ON o.word = k),
near AS (
  SELECT word, other FROM shorter UNION ALL SELECT other, word FROM shorter
  UNION ALL SELECT x.word, y.word FROM keys x JOIN keys y ON x.k = y.k AND x.i = y.i AND x.word <> y.word),
best AS (
  SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS other, max(o.n) AS top
  FROM near JOIN words o ON o.word = near.other GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form,
    CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS d FROM forms UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, d) AS root FROM chain GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
WITH said AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM said GROUP BY 1, 2),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, whole WHERE t IN (SELECT t FROM asked) GROUP BY t, docs),
parts AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS part
  FROM tfs JOIN weights USING (t) JOIN sizes USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (t) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = """
WITH said AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM said),
marked AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM firsts)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM marked
"""

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality_ranking": op2_quality_ranking,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_repeated_text": op4_repeated_text,
    "op5_decontamination": op5_decontamination,
    "op6_personal_data": op6_personal_data,
    "op7_url_rules": op7_url_rules,
    "op8_token_counts": op8_token_counts,
    "op9_vector_links": op9_vector_links,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_warc": op13_warc,
}
ORACLES = {"op1_near_duplicates": OP1_SQL, "op7_url_rules": OP7_SQL, "op9_vector_links": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_warc": OP13_SQL}
