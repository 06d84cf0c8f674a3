"""String values of JSON texts and where they stand, as one expression.

A body is cut into marks: the signs of the structure, and strings in pieces that begin at their quote or at an escape.
What stands between marks is white space, a number or a name, or an error. One walk over all of it keeps what may come
next, and the open containers as a string of one letter each, which also says whether the key of a container is wanted. So the
same walk checks the grammar and finds the wanted strings, at any depth, and a body is read a few times from end to end.
"""

from __future__ import annotations

from maskwright.functions.arrays import empty, fresh, let, quoted, scan

# possessive, without a group that repeats: no piece is looked at twice, and none is too long
_MARK = r'"[^"\\]*+"?|\\(?s:.)[^"\\]*+"?|[{}\[\],:]'
_SPACE = r"[ \t\n\r]*+"
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_BETWEEN = rf"\A{_SPACE}(?:true|false|null|{_NUMBER})?{_SPACE}\z"
_ESCAPE = r'\A\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
_CONTROL = r"[\x00-\x1F]"

# What may come next: V a value, v a value or the end of an array, K a key, k a key or the end of an object, C a colon,
# E the end of a container or a comma; ! is an error. Containers: A and B objects, C and D arrays; A and C stand under a
# wanted key.
_STATE = "struct<e:string,stack:string,want:boolean,open:int,at:int>"
_FOUND = "struct<first:int,last:int,start:int,end:int>"
_ITEM = "struct<c:string,i:int,gap:int,n:int>"


def _piece(mark: str) -> str:
    """The kind of a mark: itself, S a whole string, a the beginning of one, b more of it, c its last piece, ! an error."""
    closed = f"right({mark}, 1) = '\"'"
    return (
        f"case when left({mark}, 1) = '\"' then if({mark} rlike {quoted(_CONTROL)}, '!', "
        f"if(char_length({mark}) > 1 and {closed}, 'S', 'a')) "
        f"when left({mark}, 1) = '\\\\' then if({mark} rlike {quoted(_CONTROL)} or not {mark} rlike {quoted(_ESCAPE)}, '!', "
        f"if(char_length({mark}) > 2 and {closed}, 'c', 'b')) else {mark} end"
    )


def _items(marks: str, gaps: str) -> str:
    """Kind, number, length and the length before it of each mark but the middle pieces of strings; an item of kind l stands
    before a mark that a number or name precedes."""
    mark, i, m = fresh("mark"), fresh("i"), fresh("m")

    def item(kind: str, number: str, gap: str, size: str) -> str:
        return f"named_struct('c', {kind}, 'i', {number}, 'gap', {gap}, 'n', {size})"

    def before(gap: str, number: str) -> str:
        kind = f"if({gap} rlike {quoted(_BETWEEN)}, 'l', '!')"
        return item(kind, number, "0", f"char_length({gap})")

    def one(kinds: str) -> str:
        gap, kind = f"{gaps}[{i}]", f"{kinds}[{i}]"
        follows = f"{i} > 0 and {kinds}[{i} - 1] in ('a', 'b')"
        blank = f"{gap} = '' or {gap} rlike {quoted(rf'\A{_SPACE}\z')}"
        size = f"char_length({mark})"
        own = f"if({kind} in ('b', 'c') and not ({follows}), '!', {kind})"
        return (
            f"if({kind} = 'b' and {follows}, {empty(_ITEM)}, if({blank}, array({item(own, i, f'char_length({gap})', size)}), "
            f"array({before(gap, i)}, {item(own, i, '0', size)})))"
        )

    last = f"element_at({gaps}, -1)"
    behind = f"if({last} rlike {quoted(rf'\A{_SPACE}\z')}, {empty(_ITEM)}, array({before(last, '-1')}))"
    kinds = f"transform({marks}, {m} -> {_piece(m)})"
    return let(kinds, lambda ks: f"concat(flatten(transform({marks}, ({mark}, {i}) -> {one(ks)})), {behind})")


def _literal(marks: str, first: str, last: str) -> str:
    return f"if({first} = {last}, {marks}[{first}], array_join(slice({marks}, {first} + 1, {last} - {first} + 1), ''))"


def _text(literal: str) -> str:
    """The string that a literal stands for; halves of surrogate pairs become question marks."""
    read = "from_json(concat('[', {0}, ']'), 'array<string>', map('maxStringLen', '2147483647'))[0]".format
    return let(literal, lambda x: f"if(contains({x}, '\\\\'), {read(x)}, substr({x}, 2, char_length({x}) - 2))")


def _walk(marks: str, items: str, wanted: list[str]) -> str:
    """Marks and place of each wanted string, and behind them whether the body is JSON (first = 1)."""
    names = f"array({', '.join(map(quoted, wanted))})" if wanted else empty("string")

    def state(e: str, stack: str, want: str, at: str, opened: str = "-1") -> str:
        return f"named_struct('e', {e}, 'stack', {stack}, 'want', {want}, 'open', {opened}, 'at', {at})"

    def step(s: str, x: str) -> tuple[str, str]:
        top, rest = f"right({s}.stack, 1)", f"left({s}.stack, char_length({s}.stack) - 1)"
        value, key = f"{s}.e in ('V', 'v')", f"{s}.e in ('K', 'k')"
        # while a string is open, `at` is where it began
        begin = f"if({x}.c = 'S', {s}.at + {x}.gap, {s}.at)"
        first = f"if({x}.c = 'S', {x}.i, {s}.open)"
        literal = _literal(marks, first, f"{x}.i")
        end = f"if({x}.c = 'S', {s}.at + {x}.gap + {x}.n, {s}.at + char_length({literal}))"
        on = f"{s}.at + {x}.gap + {x}.n"
        bad = state("'!'", "''", "false", "0")

        def go(condition: str, e: str, stack: str | None = None, want: str | None = None, at: str = on) -> str:
            return f"if({condition}, {state(quoted(e), stack or f'{s}.stack', want or f'{s}.want', at)}, {bad})"

        def push(wanted_one: str, other: str) -> str:
            return f"concat({s}.stack, if({s}.want, '{wanted_one}', '{other}'))"

        known = f"coalesce(array_contains({names}, lower({_text(literal)})), false)"
        done = (
            f"if({value}, {state(quoted('E'), f'{s}.stack', f'{s}.want', end)}, {go(key, 'C', want=known, at=end)})"
        )
        following = f"if({top} in ('A', 'B'), {state(quoted('K'), f'{s}.stack', f'{s}.want', on)}, {state(quoted('V'), f'{s}.stack', f'{top} = {quoted("C")}', on)})"
        after = (
            f"case {x}.c when 'S' then {done} "
            f"when 'l' then {go(value, 'E')} "
            f"when ':' then {go(f'{s}.e = {quoted("C")}', 'V')} "
            f"when ',' then if({s}.e = 'E' and {s}.stack <> '', {following}, {bad}) "
            f"when '{{' then {go(value, 'k', push('A', 'B'))} "
            f"when '[' then {go(value, 'v', push('C', 'D'))} "
            f"when '}}' then {go(f'{s}.e in ({quoted("k")}, {quoted("E")}) and {top} in ({quoted("A")}, {quoted("B")})', 'E', rest, f'{top} = {quoted("A")}')} "
            f"when ']' then {go(f'{s}.e in ({quoted("v")}, {quoted("E")}) and {top} in ({quoted("C")}, {quoted("D")})', 'E', rest, f'{top} = {quoted("C")}')} "
            f"when 'a' then if({value} or {key}, {state(f'{s}.e', f'{s}.stack', f'{s}.want', f'{s}.at + {x}.gap', f'{x}.i')}, {bad}) "
            f"when 'c' then if({s}.open >= 0, {done}, {bad}) else {bad} end"
        )
        hit = f"{x}.c in ('S', 'c') and {value} and {s}.want"
        found = f"array(named_struct('first', {first}, 'last', {x}.i, 'start', {begin}, 'end', {end}))"
        return f"if({s}.e = '!', {s}, {after})", f"if({hit}, {found}, {empty(_FOUND)})"

    def finish(s: str) -> str:
        whole = f"{s}.e = 'E' and {s}.stack = '' and {s}.open < 0"
        return f"array(named_struct('first', if({whole}, 1, 0), 'last', -1, 'start', 0, 'end', 0))"

    return scan(items, state("'V'", "''", "false", "0"), _STATE, _FOUND, step, finish)


def json_leaves(body: str, wanted: list[str], skipped: list[str]) -> str:
    """SQL for `is_json` and `leaves`: the string values under wanted keys, in document order, with their places.

    Keys are compared in small letters; items of an array belong to the key of the array. Places are those of the quoted
    literal, in code points. NULL is neither JSON nor not, and has no leaves. A key may come twice.
    """
    keys = sorted({k.lower() for k in wanted} - {k.lower() for k in skipped})

    def leaves(marks: str, found: str) -> str:
        p = fresh("p")
        value = _text(_literal(marks, f"{p}.first", f"{p}.last"))
        placed = f"transform(slice({found}, 1, size({found}) - 1), {p} -> named_struct('start', {p}.start, 'end', {p}.end, 'value', {value}))"
        good = f"element_at({found}, -1).first = 1"
        none = empty("struct<start:int,end:int,value:string>")
        return f"named_struct('is_json', {good}, 'leaves', if({good} and size({found}) > 1, {placed}, {none}))"

    def read(marks: str) -> str:
        items = let(f"split({body}, {quoted(_MARK)}, -1)", lambda gaps: _items(marks, gaps))
        return let(_walk(marks, items, keys), lambda found: leaves(marks, found))

    none = f"named_struct('is_json', cast(null as boolean), 'leaves', {empty('struct<start:int,end:int,value:string>')})"
    return f"if({body} is null, {none}, {let(f'regexp_extract_all({body}, {quoted(_MARK)}, 0)', read)})"
