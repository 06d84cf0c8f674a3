"""Entities named by a model: from logits over labels to spans, and their union with the regex spans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions.arrays import fresh, let, quoted
from maskwright.functions.detectors import detect
from maskwright.functions.labels import ner_type
from maskwright.functions.numbers import softmax
from maskwright.functions.patterns import UNICODE_SPACE, WORDS
from maskwright.functions.spans import NO_SPANS, make_span, regex_spans, resolve, valid_spans
from maskwright.operators.skew import null_safe_join
from maskwright.session import written

ENTITY_SOURCE = "onnx-ner"
BIO_BLOCK = 1 << 16


def words_with_offsets(df: DataFrame, keys: list[str], text: str = "text", count: str | None = None) -> DataFrame:
    """One row per run of letters and digits: keys, word_index, word, start, end; `count` names a column for how many the text has."""
    found = df.withColumn("__words", F.expr(regex_spans(text, WORDS, "word", 1.0)))
    many = [] if count is None else [count]
    if count is not None:
        found = found.withColumn(count, F.size("__words"))
    long = found.select(*keys, *many, F.posexplode_outer("__words").alias("word_index", "w")).filter("w is not null")
    place = [F.col("w.value").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end")]
    return long.select(*keys, "word_index", *place, *many)


def ner_gate(text: str, max_bytes: int = 0) -> str:
    """Whether a text looks like natural language and is not too long for the model; 0 is no limit."""

    def check(t: str) -> str:
        size = f"char_length({t})"
        letters = f"char_length(regexp_replace({t}, {quoted(r'[^\p{L}]+')}, ''))"
        spaces = f"char_length(regexp_replace({t}, {quoted(f'[^{UNICODE_SPACE}]+')}, ''))"
        short = f"octet_length({t}) <= {max_bytes}" if max_bytes > 0 else "true"
        return (
            f"coalesce(octet_length({t}) >= {fixed.NER_MIN_BYTES} and {short} "
            f"and cast({letters} as double) / {size} > {fixed.NER_LETTER_SHARE}d "
            f"and cast({spaces} as double) / {size} > {fixed.NER_SPACE_SHARE}d, false)"
        )

    return let(text, check)


def decode_labels(
    token_logits: DataFrame, labels: DataFrame, sequence: str = "doc_id", token: str = "tok", logits: str = "logits"
) -> DataFrame:
    """The likeliest label of every token and its probability; the first and last token of a sequence are markers.

    A sequence has at most as many tokens as the model takes, so its window is small.
    """
    order = Window.partitionBy(sequence).orderBy(token)
    inner = (
        token_logits.withColumn("__before", F.lag(token).over(order))
        .withColumn("__after", F.lead(token).over(order))
        .filter("__before is not null and __after is not null")
    )
    scored = (
        inner.withColumn("__p", F.expr(softmax(logits)))
        .withColumn("score", F.array_max("__p"))
        .withColumn("id", (F.array_position("__p", F.col("score")) - 1).cast("int"))
    )
    named = scored.join(labels.select(F.col("id").cast("int").alias("id"), "label"), "id", "left")
    label = F.when(F.coalesce("label", F.lit("")) == "", F.lit("O")).otherwise(F.col("label"))
    return named.select(sequence, token, label.alias("label"), "score")


def merge_bio(tokens: DataFrame, document: str = "doc_id", token: str = "tok", block: int = BIO_BLOCK) -> DataFrame:
    """Join labelled tokens to entities: B starts one, I goes on with its type, O closes it.

    A label of another form neither goes on nor closes and is left out first. Score is the mean over the tokens. A sequence
    is worked on in blocks of `block` numbers of `token`, an integer; what a block hands on is the kind that is open at its
    end and how many entities began in it, so a sequence of any length is spread over its blocks. Runs a job when called.
    """
    label = F.coalesce("label", F.lit(""))
    marked = tokens.withColumn("__label", F.when(label.isin("O", ""), F.lit("")).otherwise(label)).filter(
        (F.col("__label") == "") | F.col("__label").rlike("^[BI]-")
    )
    within = Window.partitionBy(document, "__block").orderBy(token)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("__label").startswith("B-")
    starts = F.col("__kind").isNotNull() & (begins | ~F.col("__kind").eqNullSafe(F.lag("__kind").over(within)))
    # numbered within its block, as if nothing were open before it
    rows = written(
        marked.withColumn("__kind", F.when(F.col("__label") != "", F.expr("substr(__label, 3)")))
        .withColumn("__block", F.floor(F.col(token) / block))
        .withColumn("__begins", begins)
        .withColumn("__first", starts.cast("int"))
        .withColumn("__n", F.sum("__first").over(running))
        .select(document, token, "__block", "__kind", "__begins", "__first", "__n", "start", "end", "score"),
        "bio-tokens",
    )
    edges = rows.groupBy(document, "__block").agg(
        F.min_by(F.struct("__kind", "__begins"), token).alias("__head"),
        F.max_by("__kind", token).alias("__last"),
        F.sum("__first").alias("__starts"),
    )
    blocks = Window.partitionBy(document).orderBy("__block")
    head = F.col("__head.__kind")
    goes_on = head.isNotNull() & ~F.col("__head.__begins") & head.eqNullSafe(F.lag("__last").over(blocks))
    linked = edges.withColumn("__on", F.coalesce(goes_on, F.lit(False)).cast("int"))
    earlier = F.sum(F.col("__starts") - F.col("__on")).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    carried = linked.select(document, "__block", (F.coalesce(earlier, F.lit(0)) - F.col("__on")).alias("__carry"))
    joined = null_safe_join(rows.filter(F.col("__kind").isNotNull()), carried, [document, "__block"], "inner")
    return joined.withColumn("__entity", F.col("__n") + F.col("__carry")).groupBy(document, "__entity").agg(
        ner_type(F.min("__kind")).alias("type"),
        F.min_by("start", token).alias("start"),
        F.max_by("end", token).alias("end"),
        F.avg("score").alias("score"),
        F.lit(ENTITY_SOURCE).alias("source"),
    ).drop("__entity")


def entities_by(entities: DataFrame, keys: list[str], min_score: float) -> DataFrame:
    """The entities that reach the score as one array, `__entities`, per key."""
    return (
        entities.filter(F.col("score") >= min_score)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "type", "score"))).alias("__entities"))
    )


def model_spans(text: str, found: str, max_bytes: int = 0) -> str:
    """The model's spans of a text from its array of entities; none if the text fails the gate or there is no array."""
    e = fresh("e")
    made = make_span(
        f"{e}.type",
        f"substr({text}, {e}.start + 1, {e}.end - {e}.start)",
        f"{e}.start",
        f"{e}.end",
        f"{e}.score",
        quoted(ENTITY_SOURCE),
    )
    inside = valid_spans(f"transform({found}, {e} -> {made})", text)
    return f"if({found} is not null and {ner_gate(text, max_bytes)}, {inside}, {NO_SPANS})"


def hybrid_detect(
    df: DataFrame,
    entities: DataFrame,
    key: str | list[str],
    text: str = "text",
    types: Iterable[str] | None = None,
    min_score: float = fixed.NER_MIN_SCORE,
    max_bytes: int = 0,
    into: str = "spans",
    min_confidence: float = 0.0,
    overlap: str = "prefer",
) -> DataFrame:
    """Regex spans and the model's spans of each text, overlaps resolved, by preference unless told otherwise.

    `entities` is a table (key, type, start, end, score) of whatever the model found; the key may be several columns.
    Texts that fail the gate, and texts without a row in it, have their regex spans only; entities that reach beyond
    their text are left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    regex = detect(df, text, types, min_confidence, into="__regex")
    found = regex.join(entities_by(entities, keys, max(min_score, min_confidence)), keys, "left")
    return (
        found.withColumn("__all", F.concat("__regex", F.expr(model_spans(text, "__entities", max_bytes))))
        .withColumn(into, F.expr(let("__all", lambda a: f"if(size({a}) > 0, {resolve(a, overlap)}, {a})")))
        .drop("__regex", "__entities", "__all")
    )

