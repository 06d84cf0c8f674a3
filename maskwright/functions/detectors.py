"""Detectors: expressions from a text to an array of spans, chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions import patterns
from maskwright.functions.arrays import fresh, let, quoted
from maskwright.functions.numbers import has_alpha_num, looks_like_jwt, shannon_entropy
from maskwright.functions.secrets import SECRET_RULES, SecretRule
from maskwright.functions.spans import NO_SPANS, make_span, regex_spans, valid_spans

CustomDetector = Callable[[Column], Column]


@dataclass(frozen=True)
class Detector:
    """`find` gives the spans of a text.

    It is only asked for texts that pass the cheap test `hint`, if there is one, and given the text's long runs one
    by one if it looks `in_runs`.
    """

    find: Callable[[str], str]
    hint: Callable[[str], str] | None = None
    in_runs: bool = False


find_email = Detector(
    lambda text: regex_spans(text, patterns.EMAIL, "email", fixed.EMAIL_SCORE),
    lambda text: f"contains({text}, '@')",
)

find_phone = Detector(lambda text: regex_spans(text, patterns.PHONE, "phone", fixed.PHONE_SCORE))

find_api_key = Detector(
    lambda text: regex_spans(
        text,
        patterns.TOKEN,
        "api_key",
        fixed.API_KEY_SCORE,
        accept=lambda v: f"({has_alpha_num(v)} and {shannon_entropy(v)} >= {fixed.API_KEY_MIN_ENTROPY})",
    ),
    in_runs=True,
)


def jwt_detector(strict: bool = False) -> Detector:
    return Detector(
        lambda text: regex_spans(
            text, patterns.JWT, "jwt", fixed.JWT_SCORE, accept=lambda v: looks_like_jwt(v, strict)
        ),
        lambda text: f"{text} rlike {quoted(patterns.JWT_HINT)}",
    )


find_jwt = jwt_detector()


def _secret_detector(rule: SecretRule) -> Detector:
    def accept(value: str) -> str:
        tests = []
        if rule.exact_length is not None:
            tests.append(f"char_length({value}) = {rule.exact_length}")
        if rule.holds is not None:
            tests.append(f"{value} rlike {quoted(rule.holds)}")
        if rule.letter_and_digit:
            tests.append(has_alpha_num(value))
        if rule.min_entropy is not None:
            tests.append(f"{shannon_entropy(value)} >= {rule.min_entropy}")
        return f"({' and '.join(tests)})"

    tested = rule.letter_and_digit or any(x is not None for x in (rule.exact_length, rule.holds, rule.min_entropy))

    def hint(text: str) -> str:
        where = f"lower({text})" if rule.case_blind else text
        named = " or ".join(f"contains({where}, {quoted(word)})" for word in rule.any_of)
        # Lower-casing a text costs more than looking for one character of the name.
        return f"(contains({text}, '_') and ({named}))" if rule.case_blind else f"({named})"

    return Detector(
        lambda text: regex_spans(
            text, rule.pattern, rule.type, rule.score, accept=accept if tested else None, lead=rule.lead
        ),
        None if rule.in_run else hint,
        rule.in_run,
    )


SECRET_DETECTORS: dict[str, Detector] = {rule.type: _secret_detector(rule) for rule in SECRET_RULES}
BUILT_IN: dict[str, Detector] = {
    "email": find_email,
    "phone": find_phone,
    "api_key": find_api_key,
    "jwt": find_jwt,
    **SECRET_DETECTORS,
}
_custom: dict[str, CustomDetector] = {}


def register_detector(name: str, detector: CustomDetector) -> None:
    """Add a detector: a function from a text column to a column of `array<SPAN>`.

    A pandas UDF that returns an array of spans fits as well.
    """
    _custom[name.strip().lower()] = detector


def unregister_detector(name: str) -> None:
    _custom.pop(name.strip().lower(), None)


def detectors(names: Iterable[str] | None = None, specific_first: bool = False) -> list[str]:
    """The known detectors among `names`, or all built-in ones when no names are given.

    Names are trimmed and case-blind, unknown names are ignored, "secret" means every secret type. The order of
    the names decides between equal spans; `specific_first` puts the vendor formats ahead of the generic ones.
    """
    wanted = [n.strip().lower() for n in names] if names else list(fixed.DETECTOR_ORDER)
    chosen: list[str] = []
    for name in wanted:
        for single in fixed.SECRET_TYPES if name == "secret" else [name]:
            if (single in _custom or single in BUILT_IN) and single not in chosen:
                chosen.append(single)
    if specific_first:
        generic = {"high_entropy", "hex_secret"}
        chosen.sort(key=lambda n: 0 if n in SECRET_DETECTORS and n not in generic else 1)
    return chosen


def _within(runs: str, detector: Detector) -> str:
    """The spans a detector finds in each run, moved to the run's place in the text."""
    run, s = fresh("run"), fresh("s")
    moved = make_span(
        f"{s}.type", f"{s}.value", f"{s}.start + {run}.start", f"{s}.end + {run}.start", f"{s}.score", f"{s}.source"
    )
    return f"flatten(transform({runs}, {run} -> transform({detector.find(f'{run}.value')}, {s} -> {moved})))"


def find_spans(
    text: str, names: Iterable[str], min_confidence: float = 0.0, custom: Callable[[str], str] | None = None
) -> str:
    """Every span of the named detectors, in their order; a custom one is read from its own column, or from `custom`."""
    names = list(names)
    custom = custom or custom_column
    in_runs = any(n not in _custom and BUILT_IN[n].in_runs for n in names)

    def found(t: str, runs: str) -> str:
        parts = [NO_SPANS]
        for n in names:
            if n in _custom:
                parts.append(custom(n))
            elif BUILT_IN[n].in_runs:
                parts.append(_within(runs, BUILT_IN[n]))
            elif BUILT_IN[n].hint:
                parts.append(f"if({BUILT_IN[n].hint(t)}, {BUILT_IN[n].find(t)}, {NO_SPANS})")
            else:
                parts.append(BUILT_IN[n].find(t))
        return f"if({t} is null, {NO_SPANS}, {valid_spans(f'concat({chr(44).join(parts)})', t, min_confidence)})"

    def run(t: str) -> str:
        if not in_runs:
            return found(t, "")
        # The text is searched for long runs once for all detectors that look at nothing else.
        return let(regex_spans(t, patterns.LONG_RUN, "run", 0.0), lambda runs: found(t, runs))

    return let(text, run)


def custom_column(name: str) -> str:
    return f"`__spans_{name}`"


def with_custom_spans(df: DataFrame, text: str, names: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Run the custom detectors among `names`, each into a column of its own."""
    added = [n for n in names if n in _custom]
    for n in added:
        df = df.withColumn(custom_column(n).strip("`"), _custom[n](F.expr(text)))
    return df, [custom_column(n).strip("`") for n in added]


def with_custom_spans_of_items(df: DataFrame, items: str, names: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """As `with_custom_spans` for an array of structs with a `value`: one array of spans per item.

    Runs inside the array, so these detectors have to be made of Spark's own functions.
    """
    added = [n for n in names if n in _custom]

    def spans(n: str) -> Column:
        return F.transform(items, lambda item: _custom[n](item["value"]))

    for n in added:
        df = df.withColumn(custom_column(n).strip("`"), spans(n))
    return df, [custom_column(n).strip("`") for n in added]


def detect(
    df: DataFrame,
    text: str = "text",
    types: Iterable[str] | None = None,
    min_confidence: float = 0.0,
    specific_first: bool = False,
    into: str = "spans",
) -> DataFrame:
    """Add the array of every span the chosen detectors report, in detector order."""
    names = detectors(types, specific_first)
    df, extra = with_custom_spans(df, text, names)
    return df.withColumn(into, F.expr(find_spans(text, names, min_confidence))).drop(*extra)
