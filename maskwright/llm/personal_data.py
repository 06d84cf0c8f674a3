"""Personal data by fixed forms and by bootstrapped contextual extraction, in DataFrame and SQL functions only.

The fixed forms (e-mail, IP, card and phone) give the base spans, which are also the seeds. The words before a seed are
a lexical pattern. Patterns and the tokens they stand before make a graph over the whole corpus: a pattern is as sure of
a kind as the share of its instances that are believed to be of the kind, an instance of fitting shape as sure as its
patterns together. This is repeated until nothing changes; the instances that reach the wanted certainty are added as spans
of their kind.

A text is searched in a copy of the same length in which separators that stand between two digits, or dots between two
labels, are one reserved character each. So every form is a run of one character class, and the cost stays in proportion
to the text, however long a run is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import empty, fresh, let, quoted, running_sums, scan
from maskwright.functions.spans import NO_SPANS, rebuild, regex_spans, resolve_first_longest
from maskwright.operators.skew import hot_split_join
from maskwright.session import written

KINDS = ("email", "ip", "card", "phone")
MAX_ROUNDS = 100
MIN_SEEDS = 3
MIN_CERTAINTY = 0.6
SPANS = "array<struct<k:int,start:int,end:int>>"

_GAP, _DOT = chr(0xE000), chr(0xE001)
_MARK = chr(0xE010)  # a found span of kind k is blanked with the character k places after this one
_MARKS = _MARK + "-" + chr(0xE013)
_LABEL = "A-Za-z0-9-"
_EMAIL = rf"(?:(?<![A-Za-z0-9._%+\-{_DOT}])|\G)[A-Za-z0-9._%+\-{_DOT}]++@[{_LABEL}]++{_DOT}[{_LABEL}{_DOT}]+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
_CARD = rf"[0-9][0-9{_GAP}]+"
_PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
_DIGITS = "regexp_replace({}, '[^0-9]', '')"
# Punctuation that may stand around a value; a bracket around an area code is part of it.
_OPEN = r"[\"'<\[{,;:=«»“”„‘’]*+"
_CLOSE = r".,;!?)\]}>\"'…«»”“’"
_LEAD = rf"^{_OPEN}(?:\((?![^()\s]{{1,8}}\) ?[0-9A-Za-z]){_OPEN}){{0,3}}"
_TRAIL = rf"(?<![{_CLOSE}:]):[{_CLOSE}]*+\z|(?<![{_CLOSE}])[{_CLOSE}]++\z"
# A number in groups with one space between them. None of its groups without a separator has a shape of its own.
_SPACED = (
    rf"[(\"'<\[{{]*+\(?[0-9]{{1,6}}\)?(?: (?:[\-/] )?\(?[0-9]{{2,6}}\)?(?:[\-./][0-9]{{2,6}})?){{1,10}}[{_CLOSE}:]*+(?!\S)"
)
# A token that holds a digit, a blanked span or an at sign.
_HAS = rf"[^\s0-9{_MARKS}@]*+[0-9{_MARKS}@]|\S*?[(\[]at[)\]]"
# The words before it that are none: as far as no character speaks for one all at once, then word by word past brackets. The
# digits are written out, as Java looks single characters up in a table and compares ranges one by one.
_PLAIN = rf"[^0123456789@{_MARKS}(\["
_WORDS = rf"(?:(?>{_PLAIN}]*\s)|{_PLAIN}\s]*+(?:[(\[](?!at[)\]]){_PLAIN}\s]*+)*+\s++)*+"
# Each begins where the last one ended, so that no part of the text is searched twice.
_TOKEN = rf"\G{_WORDS}(?:{_SPACED}|(?={_HAS})\S++)"
# Shapes that a token found by its context must have; one may have several.
_SHAPES = {
    "email": r"^[^\s@]{2,}(?:@|\(at\)|\[at\])[^\s@]{3,}\z",
    "ip": r"^[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}\z",
    "card": r"^[0-9](?:[ \-]?[0-9]){11,18}\z",
    "phone": r"^[0-9(][0-9().\-/ ]{5,17}[0-9]\z",
}


def _same_length(text: str, pattern: str, character: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(character)})"


def _without(text: str, characters: str) -> str:
    """SQL for the text with a tilde for each of the reserved characters; hardly any text has one, and looking costs less."""
    held = " or ".join(f"contains({text}, {quoted(c)})" for c in characters)
    return f"if({held}, translate({text}, {quoted(characters)}, {quoted('~' * len(characters))}), {text})"


def base_spans(text: str) -> str:
    """SQL for the fixed forms of a text, each kind leftmost and without overlap, as an array of SPAN."""
    clean = _without(text, _GAP + _DOT)
    dotted = _same_length(clean, rf"\.(?<=[{_LABEL}]\.)(?=[{_LABEL}])", _DOT)
    joined = _same_length(clean, r"[ \-](?<=[0-9][ \-])(?=[0-9])", _GAP)

    def when(test: str, searched: str, pattern: str, k: int, accept=None) -> str:
        found = let(searched, lambda s: regex_spans(s, pattern, KINDS[k], 1.0, accept=accept))
        return f"if({test}, {found}, {NO_SPANS})"

    def digits(low: int, high: int, also: str = ""):
        return lambda v: f"char_length({_DIGITS.format(v)}) between {low} and {high}" + also.replace("{}", _DIGITS.format(v))

    return (
        "concat("
        + when(f"contains({text}, '@')", dotted, _EMAIL, 0)
        + ", "
        + when(f"{text} rlike '[0-9][.][0-9]'", text, _IP, 1, lambda v: f"{v} rlike {quoted(f'^{_PART}(?:[.]{_PART}){{3}}$')}")
        + ", "
        + when(f"{text} rlike '[0-9][0-9 -]{{11}}'", joined, _CARD, 2, digits(13, 19, " and luhn_check({})"))
        + ", "
        + when(f"contains({text}, '+')", text, _PHONE, 3, digits(9, 15))
        + ")"
    )


def _numbered(spans: str) -> str:
    """Spans as sorted (kind number, start, end)."""
    s = fresh("s")
    kinds = ", ".join(quoted(k) for k in KINDS)
    return (
        f"array_sort(transform({spans}, {s} -> named_struct('k', cast(array_position(array({kinds}), {s}.type) - 1 as int), "
        f"'start', {s}.start, 'end', {s}.end)))"
    )


def _written_out(spans: str) -> str:
    s = fresh("s")
    kinds = ", ".join(quoted(k) for k in KINDS)
    return f"array_join(transform({spans}, {s} -> concat(get(array({kinds}), {s}.k), ':', {s}.start, ':', {s}.end)), ',')"


def _replaced(text: str, spans: str, put: str) -> str:
    """The text with disjoint spans replaced; `put` is SQL in terms of `x`, a SPAN."""
    placed = f"transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'placeholder', {put}))"
    return rebuild(text, placed)


def _bare(token: str) -> str:
    """SQL for the value in a token, `skip` characters from its beginning: the first blanked span, or all but punctuation."""
    first = f"regexp_extract({token}, {quoted(rf'([{_MARKS}])\1*+')}, 0)"
    before = f"char_length(regexp_extract({token}, {quoted(f'^[^{_MARKS}]*+')}, 0))"
    span = f"named_struct('value', {first}, 'skip', {before}, 'known', true)"
    known = quoted("|".join(_SHAPES.values()))

    def bare(led: str) -> str:
        made = let(
            f"regexp_replace({led}, {quoted(_TRAIL)}, '')",
            lambda v: f"named_struct('value', {v}, 'skip', char_length({token}) - char_length({led}), 'known', {v} rlike {known})",
        )
        return made

    return f"if({token} rlike '[{_MARKS}]', {span}, {let(f'regexp_replace({token}, {quoted(_LEAD)}, {quoted("")})', bare)})"


def _instances(blank: str) -> str:
    """Tokens with digits, of the e-mail shape, and blanked spans, each with the token before it: start, end, context, value.

    The value is without the punctuation around it. A token before it that is a blanked span counts by its kind. Tokens that
    follow each other and have a shape or are spans are a list: each but the first is given a second time, with the word
    before the list. A number in groups is one value if it has a shape; its groups are values of their own if they have one.
    """
    hit, i = fresh("hit"), fresh("i")
    token = f"regexp_replace({hit}, {quoted(f'^{_WORDS}')}, '')"
    squeezed = f"lower(regexp_replace({{}}, {quoted(rf'([{_MARKS}])\1++')}, '$1'))"

    def word(t: str) -> str:
        before = f"reverse(left({hit}, char_length({hit}) - char_length({t})))"
        return f"lower(reverse(regexp_extract({before}, {quoted(r'^\s*+(\S*+)')}, 1)))"

    def opener(state: str, part: str) -> tuple[str, str]:
        kept = f"if({part}.word <> '', {part}.word, if({state}.listed, {state}.word, ''))"
        after = f"named_struct('word', {kept}, 'listed', {part}.bare.known)"
        return after, f"array(if({part}.word <> '', '', {kept}))"

    def groups(part: str, start: str, context: str) -> str:
        """The groups of a number with spaces, at most 21; those that stand for themselves if the whole has a shape."""
        group, j, n, x, y = (fresh(v) for v in "gjnxy")

        def placed(all_: str) -> str:
            at = f"{start} + aggregate(slice({all_}, 1, {j}), 0, ({n}, {y}) -> {n} + char_length({y}) + 1)"
            before = f"if({j} = 0, {context}, lower(get({all_}, {j} - 1)))"
            made = let(
                _bare(group),
                lambda b: f"named_struct('start', {at} + {b}.skip, 'end', {at} + {b}.skip + char_length({b}.value), "
                f"'context', {before}, 'value', {b}.value, 'known', {b}.known)",
            )
            kept = f"{x}.known or (not {part}.bare.known and {x}.value rlike '[0-9]')"
            return f"filter(transform({all_}, ({group}, {j}) -> {made}), {x} -> {kept})"

        return let(f"split({part}.token, ' ')", placed)

    def build(hits: str) -> str:
        sizes = f"transform({hits}, {hit} -> char_length({hit}))"
        made = let(token, lambda t: f"named_struct('word', {word(t)}, 'token', {t}, 'bare', {_bare(t)})")
        parts = f"transform({hits}, {hit} -> {made})"

        def at(parts: str, ends: str, openers: str) -> str:
            part, context = fresh("part"), fresh("context")
            start = f"(get({ends}, {i}) - char_length({part}.token))"
            before = squeezed.format(f"substring_index(coalesce(get({parts}, {i} - 1).token, ''), ' ', -1)")
            first = f"if({part}.word <> '', {part}.word, {before})"
            whole = (
                f"named_struct('start', {start} + {part}.bare.skip, 'end', {start} + {part}.bare.skip + "
                f"char_length({part}.bare.value), 'context', {context}, 'value', {part}.bare.value, 'known', {part}.bare.known)"
            )
            n = fresh("n")
            contexts = f"filter(array({first}, get({openers}, {i})), ({context}, {n}) -> {n} = 0 or {context} <> '')"
            one = f"transform({contexts}, {context} -> {whole})"
            none = empty("struct<start:int,end:int,context:string,value:string,known:boolean>")
            kept = f"if({part}.bare.known or ({part}.token rlike '[0-9]' and not contains({part}.token, ' ')), {one}, {none})"
            split = f"if(contains({part}.token, ' '), {groups(part, start, first)}, {none})"
            return f"flatten(transform({parts}, ({part}, {i}) -> concat({kept}, {split})))"

        def listed(parts: str) -> str:
            words = scan(parts, "named_struct('word', '', 'listed', false)", "struct<word:string,listed:boolean>", "string", opener)
            return let(running_sums(sizes), lambda ends: let(words, lambda openers: at(parts, ends, openers)))

        none = empty("struct<start:int,end:int,context:string,value:string,known:boolean>")
        return f"if(size({hits}) > 0, {let(parts, listed)}, {none})"

    return let(f"regexp_extract_all({blank}, {quoted(_TOKEN)}, 0)", build)


def find_spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns with `base` and `spans`, arrays of (k, start, end) sorted by kind number, start and end.

    Offsets count code points, the end is exclusive. NULL and empty texts have none. Repeated rows get the same spans each;
    an empty table gives an empty one. `keep` must not hold the names of the results. Base spans always stay; a span found
    by context is left out where it would overlap one. The tables between the steps go to the shared folder.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*keep, whole.alias("__whole")).withColumn("__base", F.expr(base_spans("__whole")))
    found = found.withColumn("__apart", F.expr(resolve_first_longest("__base")))
    marks = (
        "repeat(get(array(" + ", ".join(quoted(chr(ord(_MARK) + i)) for i in range(4)) + "), cast(array_position(array("
        + ", ".join(quoted(k) for k in KINDS)
        + "), x.type) as int) - 1), x.end - x.start)"
    )
    marked = _without("__whole", "".join(chr(ord(_MARK) + i) for i in range(4)))
    blank = let(marked, lambda t: _replaced(t, "__apart", marks))
    found = found.withColumn("__seen", F.expr(let(blank, _instances)))
    # Seeds are told apart by their text: cut from the text for the few tokens that are one.
    rows = written(
        found.select(
            *keep,
            F.xxhash64("__whole").alias("__d1"),
            F.xxhash64(F.lit(1), "__whole").alias("__d2"),
            F.monotonically_increasing_id().alias("__at"),
            F.expr(_numbered("__base")).alias("base"),
            F.expr(
                f"transform(__seen, t -> struct(t.start, t.end, t.context, "
                f"if(t.value rlike '[{_MARKS}]', substr(__whole, t.start + 1, t.end - t.start), t.value) as value, "
                f"instr({quoted(''.join(chr(ord(_MARK) + i) for i in range(4)))}, regexp_extract(t.value, "
                f"'[{_MARKS}]', 0)) - if(t.value rlike '[{_MARKS}]', 1, 2) as seed))"
            ).alias("seen"),
        ),
        "personal-data",
    )
    accepted = _bootstrap(rows)
    # The text decides, so its digest names what was added; rows with the same text share it.
    key = ["__d1", "__d2"]
    held = rows.select(*key, "base", F.explode("seen").alias("t")).filter("t.seed < 0")
    added = (
        held.join(accepted, F.col("t.value") == F.col("value"))
        .filter(~F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"])))
        .groupBy(*key)
        .agg(F.collect_set(F.struct("k", "t.start", "t.end")).alias("__added"))
    )
    # A text may have any number of copies: those of a frequent one are dealt out by their place in the written table.
    joined = hot_split_join(rows, added, key, ["__at"])
    none = F.expr(f"cast(array() as {SPANS})")
    spans = F.array_sort(F.concat("base", F.coalesce("__added", none)))
    return joined.select(*keep, "base", spans.alias("spans"))


def _bootstrap(rows: DataFrame) -> DataFrame:
    """Values believed to be of a kind, `value` and `k`: rounds of scoring over the graph of patterns and instances."""
    seen = rows.select(F.explode("seen").alias("t")).filter("t.context <> ''").select("t.context", "t.value", "t.seed")
    fits = ", ".join(f"if(value rlike {quoted(p)}, {i}, null)" for i, p in enumerate(_SHAPES.values()))
    kinds = f"if(seed >= 0, array(cast(seed as int)), array_compact(array({fits})))"
    edges = seen.select("context", "value", "seed", F.expr(f"explode_outer({kinds})").alias("k"))
    # Tokens of no shape only speak against a pattern; how many distinct ones it has is all that counts.
    graph = written(
        edges.groupBy("context", "value", "k").agg(F.max((F.col("seed") >= 0).cast("int")).alias("seed")), "pattern-graph"
    )
    sizes = graph.select("context", "value").distinct().groupBy("context").agg(F.count("*").alias("n"))
    # Certainties are whole thousandths, rounded down, and only grow from round to round: the rounds come to an end.
    seeds = graph.filter("seed = 1").select("value", "k", F.lit(1000).cast("long").alias("certainty")).distinct()
    believed, before = seeds, None
    for _ in range(MAX_ROUNDS):
        support = (
            graph.filter("k is not null")
            .join(believed, ["value", "k"])
            .groupBy("context", "k")
            .agg((F.sum("certainty") / 1000).alias("sure"), F.count("*").alias("m"))
            .filter(F.col("m") >= MIN_SEEDS)
        )
        patterns = (
            support.join(sizes, "context")
            .withColumn("p", F.col("sure") / (F.col("n") + 1))
            .filter(F.col("p") >= MIN_CERTAINTY / 2)
            .select("context", "k", "p")
        )
        together = 1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))
        scored = (
            graph.filter("seed = 0 and k is not null")
            .join(patterns, ["context", "k"])
            .groupBy("value", "k")
            .agg(F.floor(F.round(together, 9) * 1000).alias("certainty"))
            .filter(F.col("certainty") >= int(MIN_CERTAINTY * 1000))
        )
        believed = written(seeds.unionByName(scored).groupBy("value", "k").agg(F.max("certainty").alias("certainty")), "believed")
        hashed = F.xxhash64("value", "k", "certainty").cast("decimal(38,0)")
        state = tuple(believed.agg(F.count("*"), F.sum(hashed)).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"the certainties have not settled in {MAX_ROUNDS} rounds")
    known = graph.filter("seed = 1").select("value", "k").distinct()
    return believed.select("value", "k").join(known, ["value", "k"], "left_anti")


def summarise(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of the base spans by kind, and both lists of spans written out."""
    # As SQL: a second parameter of a Python lambda, with a default or not, would be the place in the array.
    counts = [F.expr(f"cast(size(filter(base, s -> s.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        *keep,
        *counts,
        F.sha2(F.expr(_written_out("base")), 256).alias("base_sha256"),
        F.expr(_written_out("spans")).alias("spans"),
    )


def mask(text: str, spans: str) -> str:
    """SQL for the text with spans, as `find_spans` gives them, replaced by the name of their kind; overlapping ones once."""
    names = ", ".join(quoted(k) for k in KINDS)
    plain = fresh("s")
    typed = (
        f"transform({spans}, {plain} -> named_struct('type', get(array({names}), {plain}.k), 'value', '', 'start', "
        f"{plain}.start, 'end', {plain}.end, 'score', 1d, 'source', ''))"
    )
    return let(resolve_first_longest(typed), lambda kept: _replaced(text, kept, "concat('[', upper(x.type), ']')"))
