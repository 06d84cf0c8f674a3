"""Entropy, softmax and other numeric expressions."""

from __future__ import annotations

from maskwright.fixed_values import SHARE_STEPS
from maskwright.functions.arrays import fresh, let


def shannon_entropy(text: str) -> str:
    """Bits per character, with character counts taken over the byte length; empty text gives 0."""

    def bits(t: str) -> str:
        c, p, acc = fresh("c"), fresh("p"), fresh("acc")
        characters = f"array_sort(array_distinct(regexp_extract_all({t}, '(?s).', 0)))"
        share = f"cast(char_length({t}) - char_length(replace({t}, {c}, '')) as double) / octet_length({t})"
        return (
            f"aggregate(transform({characters}, {c} -> {share}), cast(0 as double), "
            f"({acc}, {p}) -> {acc} - {p} * log2({p}))"
        )

    return let(text, lambda t: f"if(octet_length({t}) = 0, cast(0 as double), {bits(t)})")


def has_alpha_num(text: str) -> str:
    return rf"({text} rlike '\\p{{Nd}}' and {text} rlike '\\p{{L}}')"


def looks_like_jwt(text: str, strict: bool = False) -> str:
    """Three non-empty dotted parts of which the first two decode as unpadded base64url.

    `strict` also asks for a header that decodes to a JSON object.
    """

    def check(parts: str) -> str:
        decodes = (
            lambda i: rf"get({parts}, {i}) rlike '^[A-Za-z0-9_\\-]+$' and char_length(get({parts}, {i})) % 4 <> 1"
        )
        tests = [f"size({parts}) = 3", decodes(0), decodes(1), f"char_length(get({parts}, 2)) > 0"]
        if strict:
            header = f"translate(get({parts}, 0), '-_', '+/')"
            padded = f"rpad({header}, cast(ceil(char_length({header}) / 4) * 4 as int), '=')"
            tests.append(f"json_object_keys(cast(try_to_binary({padded}, 'base64') as string)) is not null")
        return f"coalesce({' and '.join(tests)}, false)"

    return let(rf"split({text}, '\\.', -1)", check)


def softmax(logits: str) -> str:
    """Probabilities of an array of logits, shifted by the largest; an all-zero sum gives equal shares."""

    def normalise(values: str) -> str:
        v, w, acc, u = fresh(), fresh("w"), fresh("acc"), fresh("u")
        shifted = let(
            f"array_max({values})",
            lambda top: f"transform({values}, {v} -> exp(cast({v} - {top} as double)))",
        )
        return let(
            shifted,
            lambda ws: let(
                f"aggregate({ws}, cast(0 as double), ({acc}, {u}) -> {acc} + {u})",
                lambda total: f"transform({ws}, {w} -> if({total} = 0, 1d / size({ws}), {w} / {total}))",
            ),
        )

    return let(logits, normalise)


def share_steps(part: str, total: str) -> str:
    """Length of a share bar in steps, capped; 0 when there is no total."""
    steps = f"floor(cast({part} as double) / nullif({total}, 0) * {SHARE_STEPS})"
    return f"cast(least(coalesce({steps}, 0), {SHARE_STEPS}) as bigint)"
