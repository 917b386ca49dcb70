"""PostgreSQL forms that Spark writes differently, rewritten token by token.

A text comes with its literals, quoted names and comments set aside (``\\0n\\0`` stands for the n-th). Only
brackets are matched and operands found beside an operator; the session's own parser reads the result.

* ``x op ANY (query)``, ``x op ALL (query)``: comparisons with the least or largest value, empty
  and null values included as the standard has them
* ``string_agg(x, s ORDER BY y)``, ``array_agg(x ORDER BY y)``
* ``array[1, 2]``, ``x[1]`` (counted from 1), ``x[1:2]``
* ``j -> 'k'``, ``j ->> 'k'``
* ``regexp_match(s, 'p')``, ``COLLATE "C"``, ``localtime``
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\x00\d+\x00|\w+|->>|->|<=|>=|<>|!=|::|\|\||\s+|.", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]"}, {")": "(", "]": "["}
#: Words and signs that end the left operand of a comparison.
_BOUNDS = {
    "and", "or", "not", "where", "on", "having", "when", "then", "else", "select", "case", "by", "distinct", "if", "qualify",
    "filter", "all", "any", ",", "=", "<", ">", "<=", ">=", "<>", "!=", ";",
}
_COMPARE = {"=", "<", ">", "<=", ">=", "<>", "!="}
#: Words that cannot be the end of an operand, so that a bracket behind them opens something else.
_KEYWORDS = _BOUNDS | {"in", "from", "join", "as", "like", "ilike", "between", "is", "limit", "union", "except", "intersect", "values"}
#: Collations whose order is that of the bytes, and their Spark name.
_BYTEWISE, _BYTE_ORDER = {"c", "posix", "ucs_basic", "c.utf-8", "c.utf8"}, "UTF8_BINARY"


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _blank(t: str) -> bool:
    return t.isspace()


def _after(ts: list[str], i: int) -> int:
    """The next token that is not white space, or the length."""
    while i < len(ts) and _blank(ts[i]):
        i += 1
    return i


def _before(ts: list[str], i: int) -> int:
    while i >= 0 and _blank(ts[i]):
        i -= 1
    return i


def _end(ts: list[str], i: int) -> int:
    """Place of the bracket that closes the one at ``i``; the last place where none does."""
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j] in _OPEN) - (ts[j] in _CLOSE)
        if not depth:
            return j
    return len(ts) - 1


def _begin(ts: list[str], i: int) -> int:
    """Place of the bracket that opens the one closed at ``i``."""
    depth = 0
    for j in range(i, -1, -1):
        depth += (ts[j] in _CLOSE) - (ts[j] in _OPEN)
        if not depth:
            return j
    return 0


def _parts(ts: list[str], sign: str = ",") -> list[list[str]]:
    """Tokens between signs outside brackets."""
    out, depth = [[]], 0
    for t in ts:
        depth += (t in _OPEN) - (t in _CLOSE)
        if t == sign and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _text(ts: list[str]) -> str:
    return "".join(ts).strip()


def _name(t: str) -> bool:
    return bool(re.fullmatch(r"[^\W\d]\w*", t)) and t.lower() not in _KEYWORDS


def _primary(ts: list[str], i: int) -> int | None:
    """Where the operand begins that ends at ``i``: a name, a literal, a call, a bracket, each with its casts."""
    i = _before(ts, i)
    if i < 0:
        return None
    if ts[i] in _CLOSE:
        at = _begin(ts, i)
        before = _before(ts, at - 1)
        if ts[i] == "]" or (before >= 0 and (_name(ts[before]) or ts[before][0] == "\0") and before == at - 1):
            at = _primary(ts, at - 1) if ts[i] == "]" else _dotted(ts, before)
    elif _name(ts[i]) or ts[i][0] == "\0" or ts[i].isdigit():
        at = _dotted(ts, i)
    else:
        return None
    if at is None:
        return None
    before = _before(ts, at - 1)
    return _primary(ts, before - 1) if before >= 0 and ts[before] == "::" else at


def _dotted(ts: list[str], i: int) -> int:
    while i >= 2 and ts[i - 1] == "." and (_name(ts[i - 2]) or ts[i - 2][0] == "\0"):
        i -= 2
    return i


def _operand(ts: list[str], i: int) -> int:
    """Where the left operand of the comparison at ``i`` begins: up to a word of lower rank or an open bracket."""
    j = i - 1
    while j >= 0:
        t = ts[j]
        if t in _CLOSE:
            j = _begin(ts, j) - 1
            continue
        if t in _OPEN or t.lower() in _BOUNDS:
            break
        j -= 1
    return _after(ts, j + 1)


def _quantified(ts: list[str]) -> list[str] | None:
    """The first comparison with ANY, SOME or ALL of a query, rewritten."""
    for i, t in enumerate(ts):
        if t not in _COMPARE:
            continue
        word = _after(ts, i + 1)
        at = _after(ts, word + 1)
        if word >= len(ts) or ts[word].lower() not in ("any", "some", "all") or at >= len(ts) or ts[at] != "(":
            continue
        end = _end(ts, at)
        first = _after(ts, at + 1)
        if first >= end or ts[first].lower() not in ("select", "with"):
            continue
        every, query = ts[word].lower() == "all", _text(ts[at + 1 : end])
        begin = _operand(ts, i)
        left, op = _text(ts[begin:i]), "<>" if t == "!=" else t
        if not left:
            continue
        if (op, every) in (("=", False), ("<>", True)):
            new = f"({left} {'NOT ' if every else ''}IN ({query}))"
        else:
            of = lambda x: f"(SELECT {x} FROM ({query}) AS _q(_v))"
            if op in ("=", "<>"):
                # All equal, or any different: both ends must be, or either.
                join = "AND" if op == "=" else "OR"
                holds = f"({left} {op} {of('min(_v)')} {join} {left} {op} {of('max(_v)')})"
            else:
                most = (op in (">", ">=")) == every
                holds = f"({left} {op} {of('max(_v)' if most else 'min(_v)')})"
            empty, gaps = f"{of('count(*)')} = 0", f"{of('count(*) - count(_v)')} > 0"
            decided = f"NOT {holds}" if every else holds
            new = (
                f"(CASE WHEN {empty} THEN {str(every).upper()} WHEN {decided} THEN {str(not every).upper()} "
                f"WHEN {gaps} THEN CAST(NULL AS BOOLEAN) ELSE {holds} END)"
            )
        return ts[:begin] + tokens(new) + ts[end + 1 :]
    return None


def _order(ts: list[str]) -> tuple[list[str], list[str]] | None:
    """Arguments and order of ``x ORDER BY y``; None without an order outside brackets."""
    depth = 0
    for i, t in enumerate(ts):
        depth += (t in _OPEN) - (t in _CLOSE)
        if not depth and t.lower() == "order":
            by = _after(ts, i + 1)
            if by < len(ts) and ts[by].lower() == "by":
                return ts[:i], ts[by + 1 :]
    return None


def _ordered_array(value: str, order: list[list[str]]) -> str:
    """``array_agg`` in an order: rows with their keys, sorted by a comparison of these."""
    distinct = re.match(r"(?i)distinct\s+", value)
    value = value[distinct.end() :] if distinct else value
    fields, steps = [], []
    for i, key in enumerate(order):
        m = re.fullmatch(r"(?is)(.*?)(\s+(?:asc|desc))?(\s+nulls\s+(?:first|last))?", _text(key))
        down = bool(m[2]) and m[2].strip().lower() == "desc"
        first = m[3].split()[1].lower() == "first" if m[3] else down
        fields += [f"({m[1]}) IS NULL AS n{i}", f"({m[1]}) AS k{i}"]
        here, there = (-1, 1) if first else (1, -1)
        steps.append(
            f"WHEN a.n{i} <> b.n{i} THEN IF(a.n{i}, {here}, {there}) "
            f"WHEN a.k{i} < b.k{i} THEN {1 if down else -1} WHEN a.k{i} > b.k{i} THEN {-1 if down else 1}"
        )
    rows = f"collect_list({'DISTINCT ' if distinct else ''}struct({', '.join(fields)}, {value} AS v))"
    return f"transform(array_sort({rows}, (a, b) -> CASE {' '.join(steps)} ELSE 0 END), e -> e.v)"


def _calls(ts: list[str], held: list[str]) -> list[str]:
    """Aggregates with an order, and ``regexp_match``."""
    i = 0
    while i < len(ts):
        name, at = ts[i].lower(), _after(ts, i + 1)
        if name in ("string_agg", "array_agg", "regexp_match") and at < len(ts) and ts[at] == "(":
            end = _end(ts, at)
            inner = ts[at + 1 : end]
            found = _order(inner)
            new = None
            if name == "regexp_match":
                args = [_text(a) for a in _parts(inner)]
                if len(args) > 1 and re.fullmatch(r"\x00\d+\x00", args[1]):
                    pattern = held[int(args[1][1:-1])]
                    # Groups that are kept: brackets that open no special group and are no plain sign.
                    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
                    groups = len(re.findall(r"\((?!\?)", plain))
                    picks = [f"regexp_extract({args[0]}, {args[1]}, {g})" for g in (range(1, groups + 1) if groups else [0])]
                    new = f"IF(regexp_like({args[0]}, {args[1]}), array({', '.join(picks)}), NULL)"
            elif found and name == "string_agg":
                new = f"string_agg({_text(found[0])}) WITHIN GROUP (ORDER BY {_text(found[1])})"
            elif found:
                new = _ordered_array(_text(found[0]), _parts(found[1]))
            if new is not None:
                ts = ts[:i] + tokens(new) + ts[end + 1 :]
        i += 1
    return ts


def _array(ts: list[str]) -> str:
    """The elements of ``array[...]``; a bracket inside opens a further one."""
    out = []
    for part in _parts(ts):
        first = _after(part, 0)
        nested = first < len(part) and part[first] == "["
        out.append(_array(part[first + 1 : _end(part, first)]) if nested else _text(part))
    return "array(" + ", ".join(out) + ")"


def _brackets(ts: list[str]) -> list[str]:
    """``array[...]`` and subscripts, which count from 1."""
    i = 0
    while i < len(ts):
        if ts[i] == "[":
            before, end = _before(ts, i - 1), _end(ts, i)
            if before >= 0 and ts[before].lower() == "array":
                ts = ts[:before] + tokens(_array(ts[i + 1 : end])) + ts[end + 1 :]
                i = before
            else:
                begin = _primary(ts, i - 1)
                if begin is not None:
                    whole, bounds = _text(ts[begin:i]), [_text(p) for p in _parts(ts[i + 1 : end], ":")]
                    if len(bounds) == 2:
                        lo, hi = bounds[0] or "1", bounds[1] or f"size({whole})"
                        new = f"slice({whole}, {lo}, greatest({hi} - {lo} + 1, 0))"
                    else:
                        new = f"try_element_at({whole}, {bounds[0]})"
                    ts = ts[:begin] + tokens(new) + ts[end + 1 :]
                    i = begin
        i += 1
    return ts


def _json(ts: list[str], held: list[str]) -> list[str]:
    """``->`` and ``->>`` with a literal key or place; a lambda's arrow has no literal behind it."""
    i = 0
    while i < len(ts):
        if ts[i] in ("->", "->>"):
            key = _after(ts, i + 1)
            begin = _primary(ts, i - 1)
            path = None
            if key < len(ts) and begin is not None:
                if ts[key].isdigit():
                    path = f"$[{ts[key]}]"
                elif ts[key][0] == "\0" and held[int(ts[key][1:-1])][0] == "'":
                    name = held[int(ts[key][1:-1])][1:-1].replace("''", "'")
                    path = f"$.{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"$['{name}']"
            if path is not None:
                held.append("'" + path.replace("'", "\\'") + "'")
                place, left = f"\0{len(held) - 1}\0", _text(ts[begin:i])
                new = (
                    f"get_json_object({left}, {place})" if ts[i] == "->>"
                    else f"to_json(try_variant_get(parse_json({left}), {place}, \0{len(held)}\0))"
                )
                if ts[i] == "->":
                    held.append("'variant'")
                ts = ts[:begin] + tokens(new) + ts[key + 1 :]
                i = begin
        i += 1
    return ts


def _words(ts: list[str], held: list[str]) -> list[str]:
    """``COLLATE "C"`` and ``localtime``."""
    for i, t in enumerate(ts):
        at = _after(ts, i + 1)
        if t.lower() == "collate" and at < len(ts) and ts[at][0] == "\0":
            if held[int(ts[at][1:-1])].strip('"').lower() in _BYTEWISE:
                ts[at] = _BYTE_ORDER
        elif t.lower() == "localtime" and (at >= len(ts) or ts[at] != "("):
            ts[i] = "current_time()"
    return ts


def rewritten(sql: str, held: list[str]) -> str:
    """The text in Spark's forms; literals that the rewriting needs are added to ``held``."""
    ts = _calls(_json(_brackets(tokens(sql)), held), held)
    ts = _words(ts, held)
    while (found := _quantified(ts)) is not None:
        ts = found
    return "".join(ts)
