"""Boolean trigram queries derived from regular expressions.

A regex is walked once. Runs whose strings are few enough to list are kept as
an exact set and give an OR over the strings of an AND over their trigrams;
anything longer or open-ended flushes the set and starts a new one. Text and
literals are lower-cased (ASCII), so a query never misses a match in either
case: it is necessary, not sufficient.

A query is ``True`` (no mandatory trigram) or ``("and" | "or", frozenset)`` over
queries and trigrams.
"""

from __future__ import annotations

from re import _constants as const
from re import _parser as parser

#: An exact set beyond this many strings is flushed.
MOST_STRINGS = 32
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _join(kind: str, parts) -> object:
    flat: set = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_string(s: str) -> object:
    return _join("and", {s[i : i + 3] for i in range(len(s) - 2)})


def _of_strings(strings: set[str]) -> object:
    grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    # a string whose trigrams include another's asks for nothing new
    least = [g for g in grams if not any(h < g for h in grams)]
    return _join("or", [_join("and", g) for g in least])


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is const.LITERAL:
            out.add(chr(arg).translate(_LOWER))
        elif op is const.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            out |= {chr(c).translate(_LOWER) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS else None


def _exact(node) -> set[str] | None:
    """The strings a node matches, where they are few."""
    op, arg = node
    if op is const.LITERAL:
        return {chr(arg).translate(_LOWER)}
    if op is const.IN:
        return _members(arg)
    if op is const.SUBPATTERN:
        return _product(arg[3])
    if op is const.BRANCH:
        out: set[str] = set()
        for branch in arg[1]:
            s = _product(branch)
            if s is None:
                return None
            out |= s
        return out
    if op in (const.MAX_REPEAT, const.MIN_REPEAT):
        low, high, body = arg
        if high is const.MAXREPEAT or high > 3:
            return None
        one = _product(body)
        if one is None:
            return None
        out, power = set(), {""}
        for n in range(high + 1):
            out |= power if n >= low else set()
            power = {a + b for a in power for b in one}
            if len(power) > MOST_STRINGS:
                return None
        return out
    return None


def _product(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        s = _exact(node)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _query(nodes) -> object:
    parts, run = [], {""}
    for node in nodes:
        s = _exact(node)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        parts.append(_of_strings(run))
        run = s if s is not None else {""}
        if s is None:
            op, arg = node
            if op is const.SUBPATTERN:
                parts.append(_query(arg[3]))
            elif op is const.BRANCH:
                parts.append(_join("or", [_query(b) for b in arg[1]]))
            elif op in (const.MAX_REPEAT, const.MIN_REPEAT) and arg[0] > 0:
                parts.append(_query(arg[2]))
    parts.append(_of_strings(run))
    return _join("and", parts)


def query(pattern: str) -> object:
    return _query(parser.parse(pattern))


def trigrams(q: object) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*(trigrams(p) for p in q[1]))


def holds(q: object, present) -> object:
    """Evaluate ``q``; ``present(trigram)`` and the connectives may be Columns or booleans."""
    if q is True or isinstance(q, str):
        return True if q is True else present(q)
    kind, parts = q
    out = None
    for p in sorted(parts, key=repr):
        x = holds(p, present)
        out = x if out is None else (out & x if kind == "and" else out | x)
    return out
