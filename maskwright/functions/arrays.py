"""Array expressions that stay linear on long arrays.

The functions of this package take and return Spark SQL expressions as text: one `F.expr` hands a whole expression
to Spark, where building it node by node from Python would take seconds.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

BLOCK = 256
SMALL_BLOCK = 32  # for plain numbers, of which a text may have one per word
_numbers = itertools.count(1)


def fresh(prefix: str = "v") -> str:
    """A lambda variable name that is not used elsewhere."""
    return f"{prefix}__{next(_numbers)}"


def quoted(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate `value` once per row and use it many times in `body`."""
    v = fresh()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def empty(element_type: str) -> str:
    return f"cast(array() as array<{element_type}>)"


def block_numbers(items: str, block: int = BLOCK) -> str:
    return f"sequence(0, cast(greatest(size({items}) - 1, 0) div {block} as int))"


def running_sums(numbers: str, block: int = SMALL_BLOCK) -> str:
    """Sums of an array of integers up to each place."""
    return scan(numbers, "0", "int", "int", lambda total, n: (f"{total} + {n}", f"array({total} + {n})"), block=block)


def scan(
    items: str,
    zero: str,
    state_type: str,
    out_type: str,
    step: Callable[[str, str], tuple[str, str]],
    finish: Callable[[str], str] | None = None,
    block: int = BLOCK,
) -> str:
    """Walk an array in order with a running state and collect what `step` emits.

    `step(state, item)` gives the next state and an array of emitted values. Appending to one growing array
    would copy it for every item, so the walk goes block by block and the blocks are flattened at the end.
    """

    def one_block(state: str, part: str) -> str:
        acc, item = fresh("acc"), fresh("x")
        state_after, emitted = step(f"{acc}.state", item)
        return (
            f"aggregate({part}, named_struct('state', {state}, 'out', {empty(out_type)}), ({acc}, {item}) -> "
            f"named_struct('state', cast({state_after} as {state_type}), 'out', concat({acc}.out, {emitted})))"
        )

    def walk(whole: str) -> str:
        done, i = fresh("done"), fresh("i")
        seed = f"array(named_struct('state', cast({zero} as {state_type}), 'out', {empty(out_type)}))"
        part = f"slice({whole}, {i} * {block} + 1, {block})"
        return (
            f"aggregate({block_numbers(whole, block)}, {seed}, ({done}, {i}) -> "
            f"array_append({done}, {one_block(f'element_at({done}, -1).state', part)}))"
        )

    def collect(parts: str) -> str:
        p = fresh()
        out = f"flatten(transform({parts}, {p} -> {p}.out))"
        return f"concat({out}, {finish(f'element_at({parts}, -1).state')})" if finish else out

    return let(items, lambda whole: let(walk(whole), collect))
