"""Spans: typed pieces of a text with code-point offsets."""

from __future__ import annotations

from collections.abc import Callable

from maskwright.functions.arrays import block_numbers, empty, fresh, let, quoted, running_sums, scan

SPAN = "struct<type:string,value:string,start:int,end:int,score:double,source:string>"
PLACED = "struct<start:int,end:int,first:int,type:string,value:string,placeholder:string>"
ITEM = "struct<type:string,original:string,placeholder:string>"
NO_SPANS = empty(SPAN)
CUT = 256


def make_span(type_: str, value: str, start: str, end: str, score: str, source: str) -> str:
    return (
        f"named_struct('type', {type_}, 'value', {value}, 'start', cast({start} as int), 'end', cast({end} as int), "
        f"'score', cast({score} as double), 'source', {source})"
    )


def regex_spans(
    text: str,
    pattern: str,
    type_: str,
    score: float,
    *,
    accept: Callable[[str], str] | None = None,
    lead: str | None = None,
    source: str = "regex",
) -> str:
    """All matches of `pattern` as spans. Most texts have none and are scanned only once.

    The pieces between the matches give the offsets by a running length. `lead` names a prefix of the match that
    is not part of the span, `accept` a test on the span's value.
    """

    def secret(hit: str) -> str:
        return f"regexp_replace({hit}, {quoted(lead)}, '')" if lead else hit

    def locate(hits: str) -> str:
        gap, hit, i, span = fresh("gap"), fresh("hit"), fresh("i"), fresh("span")
        gaps = f"slice(split({text}, {quoted(pattern)}, -1), 1, size({hits}))"
        sizes = f"transform({gaps}, ({gap}, {i}) -> char_length({gap}) + char_length(get({hits}, {i})))"

        def at(ends: str) -> str:
            value, end = secret(hit), f"{ends}[{i}]"
            made = make_span(quoted(type_), value, f"{end} - char_length({value})", end, str(score), quoted(source))
            return f"transform({hits}, ({hit}, {i}) -> {made})"

        spans = let(running_sums(sizes), at)
        return f"filter({spans}, {span} -> {accept(f'{span}.value')})" if accept else spans

    def build(hits: str) -> str:
        hit = fresh("hit")
        useful = f"exists({hits}, {hit} -> {accept(secret(hit))})" if accept else f"size({hits}) > 0"
        return f"if({useful}, {locate(hits)}, {NO_SPANS})"

    return let(f"regexp_extract_all({text}, {quoted(pattern)}, 0)", build)


def valid_spans(spans: str, text: str, min_confidence: float = 0.0) -> str:
    """Spans inside the text that reach the wanted confidence."""
    s = fresh("s")
    # The length is counted once per text, not once per span.
    return let(
        f"char_length({text})",
        lambda size: f"filter({spans}, {s} -> {s}.score >= {float(min_confidence)!r}d and {s}.start >= 0 "
        f"and {s}.end <= {size} and {s}.start < {s}.end)",
    )


def _ordered(spans: str, by_score: bool) -> str:
    """Start first, longer first; then higher score if asked; then the order of the detectors."""
    s, i, k = fresh("s"), fresh("i"), fresh("k")
    score = f"-{s}.score" if by_score else "0d"
    keyed = (
        f"transform({spans}, ({s}, {i}) -> "
        f"named_struct('a', {s}.start, 'b', -{s}.end, 'c', {score}, 'd', {i}, 'span', {s}))"
    )
    return f"transform(sort_array({keyed}), {k} -> {k}.span)"


def resolve_first_longest(spans: str) -> str:
    """Keep a span when it starts at or after the end of the last kept one."""

    def step(state: str, s: str) -> tuple[str, str]:
        keep = f"{s}.start >= {state}.last"
        return f"named_struct('last', if({keep}, {s}.end, {state}.last))", f"if({keep}, array({s}), {NO_SPANS})"

    return scan(_ordered(spans, False), "named_struct('last', -1)", "struct<last:int>", SPAN, step)


def resolve_prefer(spans: str) -> str:
    """On overlap the newcomer takes the place of the last span if it is preferred.

    A regex span beats one from a model, else the higher score wins. The last span is held back until the next
    one no longer overlaps it.
    """

    def step(state: str, s: str) -> tuple[str, str]:
        last = f"{state}.last"
        preferred = (
            f"if(({s}.source = 'regex') <> ({last}.source = 'regex'), {s}.source = 'regex', {s}.score > {last}.score)"
        )
        overlaps = f"({last} is not null and {s}.start < {last}.end)"
        after = f"if({overlaps} and not {preferred}, {last}, {s})"
        done = f"if({last} is not null and not {overlaps}, array({last}), {NO_SPANS})"
        return f"named_struct('last', {after})", done

    return scan(
        _ordered(spans, True),
        f"named_struct('last', cast(null as {SPAN}))",
        f"struct<last:{SPAN}>",
        SPAN,
        step,
        finish=lambda state: f"if({state}.last is not null, array({state}.last), {NO_SPANS})",
    )


def resolve(spans: str, overlap: str = "first_longest") -> str:
    if overlap == "first_longest":
        return resolve_first_longest(spans)
    if overlap == "prefer":
        return resolve_prefer(spans)
    raise ValueError(f"unknown overlap rule {overlap!r}")


def kind_of(type_: str) -> str:
    """The name in a placeholder: in upper case, what the shape of a placeholder doesn't hold as an underline."""
    return f"regexp_replace(upper({type_}), '[^A-Z0-9_]', '_')"


def number_spans(spans: str) -> str:
    """Give disjoint spans of one text their placeholders, by first occurrence within each type.

    Sorting by value finds each value's first place, sorting by first place counts the values; no lookup per
    span, so long texts with many values stay cheap.
    """
    s = fresh("s")
    by_value = (
        f"sort_array(transform({spans}, {s} -> named_struct('kind', {kind_of(f'{s}.type')}, 'value', {s}.value, "
        f"'start', {s}.start, 'end', {s}.end, 'type', {s}.type)))"
    )

    def mark(state: str, x: str) -> tuple[str, str]:
        first = f"if({state}.kind = {x}.kind and {state}.value = {x}.value, {state}.first, {x}.start)"
        return (
            f"named_struct('kind', {x}.kind, 'value', {x}.value, 'first', {first})",
            f"array(named_struct('kind', {x}.kind, 'first', {first}, 'start', {x}.start, 'end', {x}.end, "
            f"'type', {x}.type, 'value', {x}.value))",
        )

    marked = scan(
        by_value,
        "named_struct('kind', '', 'value', '', 'first', -1)",
        "struct<kind:string,value:string,first:int>",
        "struct<kind:string,first:int,start:int,end:int,type:string,value:string>",
        mark,
    )

    def count(state: str, x: str) -> tuple[str, str]:
        n = (
            f"case when {state}.kind <> {x}.kind then 1 when {state}.first <> {x}.first then {state}.n + 1 "
            f"else {state}.n end"
        )
        placeholder = f"concat('[', {x}.kind, '_', {n}, ']')"
        return (
            f"named_struct('kind', {x}.kind, 'first', {x}.first, 'n', {n})",
            f"array(named_struct('start', {x}.start, 'end', {x}.end, 'first', {x}.first, 'type', {x}.type, "
            f"'value', {x}.value, 'placeholder', {placeholder}))",
        )

    counted = scan(
        f"sort_array({marked})",
        "named_struct('kind', '', 'first', -1, 'n', 0)",
        "struct<kind:string,first:int,n:int>",
        PLACED,
        count,
    )
    return f"sort_array({counted})"


def items_of(placed: str) -> str:
    """One item per distinct value, ordered by placeholder."""
    p, q, k = fresh("p"), fresh("q"), fresh("k")
    firsts = f"filter({placed}, {p} -> {p}.start = {p}.first)"
    keyed = f"transform({firsts}, {q} -> named_struct('k', {q}.placeholder, 't', {q}.type, 'v', {q}.value))"
    return (
        f"transform(sort_array({keyed}), "
        f"{k} -> named_struct('type', {k}.t, 'original', {k}.v, 'placeholder', {k}.k))"
    )


def rebuild(text: str, placed: str, block: int = CUT) -> str:
    """The text with every placed span replaced.

    Cutting by position walks the string, so a block of spans is cut from its own stretch of the text.
    """
    i, s, j = fresh("i"), fresh("s"), fresh("j")

    def whole(spans: str) -> str:
        def cut(begin: str, part: str, stretch: str) -> str:
            prev = f"if({j} = 0, {begin}, get({part}, {j} - 1).end)"
            return let(
                prev,
                lambda p: f"concat(substr({stretch}, {p} - {begin} + 1, {s}.start - {p}), {s}.placeholder)",
            )

        one_block = let(
            f"if({i} = 0, 0, get({spans}, {i} * {block} - 1).end)",
            lambda begin: let(
                f"slice({spans}, {i} * {block} + 1, {block})",
                lambda part: let(
                    f"substr({text}, {begin} + 1, element_at({part}, -1).end - {begin})",
                    lambda stretch: f"transform({part}, ({s}, {j}) -> {cut(begin, part, stretch)})",
                ),
            ),
        )
        masked = f"array_join(flatten(transform({block_numbers(spans, block)}, {i} -> {one_block})), '')"
        tail = f"substr({text}, element_at({spans}, -1).end + 1)"
        return f"if(size({spans}) = 0, {text}, concat({masked}, {tail}))"

    return let(placed, whole)
