"""Masking JSON payloads by key, with plain text as the fallback."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions.arrays import fresh, let, scan
from maskwright.functions.detectors import custom_column, detectors, find_spans, with_custom_spans_of_items
from maskwright.functions.jsontext import json_leaves
from maskwright.functions.masking import chosen_spans, masked_items, placed_spans
from maskwright.functions.spans import rebuild
from maskwright.operators.entities import entities_by, model_spans

ENTITIES = "array<struct<start:int,end:int,type:string,score:double>>"


def should_sanitize(
    key: Column, sanitize_keys: Iterable[str] | None = None, skip_keys: Iterable[str] | None = None
) -> Column:
    """Whether values under this key are user content; case-blind, the skip list wins."""
    wanted = [k.lower() for k in sanitize_keys or fixed.SANITIZE_KEYS]
    skipped = [k.lower() for k in skip_keys or fixed.SKIP_KEYS]
    name = F.lower(key)
    return F.coalesce(name.isin(wanted) & ~name.isin(skipped), F.lit(False))


def _with_leaves(
    df: DataFrame,
    body: str,
    sanitize_keys: Iterable[str] | None,
    skip_keys: Iterable[str] | None,
    text_fallback: bool,
) -> DataFrame:
    """Add `is_json`, `__leaves`, the texts to mask with their places, and `__quoted`, whether they are literals."""
    found = json_leaves(body, list(sanitize_keys or fixed.SANITIZE_KEYS), list(skip_keys or fixed.SKIP_KEYS))
    df = df.withColumn("__json", F.expr(found)).withColumn("is_json", F.col("__json.is_json"))
    leaves, quoted = "__json.leaves", "true"
    if text_fallback:
        whole = f"array(named_struct('start', 0, 'end', char_length({body}), 'value', {body}))"
        leaves, quoted = f"if(coalesce(is_json, true), __json.leaves, {whole})", "is_json"
    return df.withColumn("__leaves", F.expr(leaves)).withColumn("__quoted", F.expr(quoted)).drop("__json")


def json_texts(
    df: DataFrame,
    key: str,
    body: str = "body",
    sanitize_keys: Iterable[str] | None = None,
    skip_keys: Iterable[str] | None = None,
    text_fallback: bool = True,
) -> DataFrame:
    """The texts of each body that are masked, for a model to read: key, leaf (from 0, in document order), text."""
    long = _with_leaves(df, body, sanitize_keys, skip_keys, text_fallback).select(
        key, F.posexplode_outer("__leaves").alias("leaf", "at")
    )
    return long.select(key, "leaf", F.col("at.value").alias("text")).filter("leaf is not null")


def _entities_by_leaf() -> str:
    """The arrays of entities, sorted by leaf, laid out as one array (or NULL) per leaf, in one walk."""

    def step(state: str, place: str) -> tuple[str, str]:
        own = f"get(__by_key, {state}.n)"
        hit = f"coalesce({own}.leaf = {place}, false)"
        return f"named_struct('n', {state}.n + if({hit}, 1, 0))", f"array(if({hit}, {own}.found, null))"

    places = "if(size(__leaves) > 0, sequence(0, size(__leaves) - 1), cast(array() as array<int>))"
    walked = scan(places, "named_struct('n', 0)", "struct<n:int>", ENTITIES, step)
    return f"if(__by_key is null, null, {walked})"


def _with_entities(df: DataFrame, entities: DataFrame | None, key: str | None, min_score: float) -> DataFrame:
    """Add `__named`: per leaf the array of what the model found in it."""
    if entities is None:
        return df
    cast = entities.select(
        key,
        F.col("leaf").cast("int").alias("leaf"),
        F.col("type").cast("string").alias("type"),
        *[F.col(c).cast("int").alias(c) for c in ("start", "end")],
        F.col("score").cast("double").alias("score"),
    )
    by_leaf = entities_by(cast.filter("leaf >= 0"), [key, "leaf"], min_score)
    entry = F.struct("leaf", F.col("__entities").alias("found"))
    by_key = by_leaf.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("__by_key"))
    return df.join(by_key, key, "left").withColumn("__named", F.expr(_entities_by_leaf())).drop("__by_key")


def _spans_by_leaf(names: list[str], min_confidence: float, overlap: str, hybrid: bool) -> str:
    """Per leaf its disjoint spans, moved to the leaf's place in the body: in document order over the payload."""
    leaf, s, b, i = fresh("leaf"), fresh("s"), fresh("b"), fresh("i")
    moved = (
        f"named_struct('type', {s}.type, 'value', {s}.value, 'start', {s}.start + {leaf}.start, "
        f"'end', {s}.end + {leaf}.start, 'score', {s}.score, 'source', {s}.source)"
    )
    every = find_spans(f"{leaf}.value", names, min_confidence, lambda n: f"get({custom_column(n)}, {i})")
    if hybrid:
        every = f"concat({every}, {model_spans(f'{leaf}.value', f'get(__named, {i})')})"
    solid = f"filter({chosen_spans(every, overlap=overlap)}, {b} -> trim({b}.value) <> '')"
    return f"transform(__leaves, ({leaf}, {i}) -> transform({solid}, {s} -> {moved}))"


def _new_literals() -> str:
    """The leaves that change, with their new text, as spans of the body.

    The spans of a leaf are a run of the payload's spans, found by a running count.
    """
    leaf, i, m, b = fresh("leaf"), fresh("i"), fresh("m"), fresh("b")

    def count(state: str, spans: str) -> tuple[str, str]:
        run = f"array(named_struct('skip', {state}.n, 'n', size({spans})))"
        return f"named_struct('n', {state}.n + size({spans}))", run

    runs = scan("__by_leaf", "named_struct('n', 0)", "struct<n:int>", "struct<skip:int,n:int>", count)

    def new_text(run: str) -> str:
        own = (
            f"transform(slice(__placed, {run}.skip + 1, {run}.n), {m} -> named_struct("
            f"'start', {m}.start - {leaf}.start, 'end', {m}.end - {leaf}.start, 'placeholder', {m}.placeholder))"
        )
        new = rebuild(f"{leaf}.value", own)
        literal = let(
            f"to_json(named_struct('v', {new}))", lambda j: f"substr({j}, 6, char_length({j}) - 6)"
        )
        changed = f"{run}.n > 0 and {run}.skip < size(__placed)"
        return f"if({changed}, if(__quoted, {literal}, {new}), null)"

    with_text = let(
        runs,
        lambda rs: f"transform(__leaves, ({leaf}, {i}) -> named_struct('start', {leaf}.start, "
        f"'end', {leaf}.end, 'placeholder', {new_text(f'{rs}[{i}]')}))",
    )
    return f"filter({with_text}, {b} -> {b}.placeholder is not null)"


def _mask_payload(
    df: DataFrame,
    body: str,
    types: Iterable[str] | None,
    min_confidence: float,
    max_replacements: int,
    sanitize_keys: Iterable[str] | None,
    skip_keys: Iterable[str] | None,
    text_fallback: bool,
    overlap: str | None,
    entities: DataFrame | None,
    key: str | None,
    min_score: float,
) -> DataFrame:
    names, hybrid = detectors(types), entities is not None
    rule = overlap or ("prefer" if hybrid else "first_longest")
    df = _with_leaves(df, body, sanitize_keys, skip_keys, text_fallback)
    df, extra = with_custom_spans_of_items(df, "__leaves", names)
    df = _with_entities(df, entities, key, max(min_score, min_confidence))
    limit = f"slice(flatten(__by_leaf), 1, {max_replacements})" if max_replacements > 0 else "flatten(__by_leaf)"
    return (
        df.withColumn("__by_leaf", F.expr(_spans_by_leaf(names, min_confidence, rule, hybrid)))
        .withColumn("__placed", F.expr(placed_spans(limit)))
        .withColumn("__new", F.expr(f"if(size(__placed) > 0, {_new_literals()}, null)"))
        .withColumn("masked", F.expr(f"if(__new is null, {body}, {rebuild(body, '__new')})"))
        .withColumn("items", F.expr(masked_items("__placed")))
        .drop("__leaves", "__quoted", "__by_leaf", "__placed", "__new", "__named", *extra)
    )


def sanitize_json(
    df: DataFrame,
    body: str = "body",
    types: Iterable[str] | None = None,
    min_confidence: float = 0.0,
    max_replacements: int = 0,
    sanitize_keys: Iterable[str] | None = None,
    skip_keys: Iterable[str] | None = None,
    overlap: str | None = None,
    entities: DataFrame | None = None,
    key: str | None = None,
    min_score: float = fixed.NER_MIN_SCORE,
) -> DataFrame:
    """Mask the string values under content keys; one placeholder space per payload.

    Adds `masked`, `items` and `is_json`. A body that is not JSON is left alone. Everything but the masked
    literals, such as key order and the digits of numbers, stays as written. Custom detectors made of Spark's own
    functions count among `types`. `entities` is a table (key, leaf, type, start, end, score) of what a model found in
    the texts of `json_texts`; with it, overlaps are resolved by preference unless told otherwise.
    """
    return _mask_payload(
        df, body, types, min_confidence, max_replacements, sanitize_keys, skip_keys, False, overlap, entities, key,
        min_score,
    )


def sanitize_body(
    df: DataFrame,
    body: str = "body",
    types: Iterable[str] | None = None,
    min_confidence: float = 0.0,
    max_replacements: int = 0,
    sanitize_keys: Iterable[str] | None = None,
    skip_keys: Iterable[str] | None = None,
    overlap: str | None = None,
    entities: DataFrame | None = None,
    key: str | None = None,
    min_score: float = fixed.NER_MIN_SCORE,
) -> DataFrame:
    """As `sanitize_json`, but a body that is not JSON is masked as plain text: its one text is leaf 0."""
    return _mask_payload(
        df, body, types, min_confidence, max_replacements, sanitize_keys, skip_keys, True, overlap, entities, key,
        min_score,
    )
