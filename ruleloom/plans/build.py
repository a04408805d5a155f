"""Builders: Python functions that return trees. The derived ones expand to the closed vocabulary."""

from __future__ import annotations

import math
from functools import reduce as _reduce


def _node(kind, **fields):
    return {"kind": kind} | {k: v for k, v in fields.items() if v is not None}


def ref(key, unit=None):
    return _node("reference", key=key, unit=unit)


def lit(value, unit=None):
    """A literal for a Python bool, number, str or complex."""
    if isinstance(value, bool):
        return _node("booleanLiteral", value=value)
    if isinstance(value, str):
        return _node("textLiteral", value=value)
    if isinstance(value, complex):
        return _node("complexLiteral", re=value.real, im=value.imag, unit=unit)
    return _node("numberLiteral", value=float(value), unit=unit)


def instant(value):
    return _node("instantLiteral", value=value)


def duration(value, unit):
    return _node("durationLiteral", value=float(value), unit=unit)


def compare(op, left, right):
    return _node("compare", op=op, left=left, right=right)


def text_compare(op, left, right):
    return _node("textCompare", op=op, left=left, right=right)


def member_of(op, operand, candidates):
    return _node("memberOf", op=op, operand=operand, candidates=list(candidates))


def exists(operand):
    return _node("exists", operand=operand)


def not_(a):
    return _node("not", operand=a)


def and_(a, b):
    return _node("and", left=a, right=b)


def or_(a, b):
    return _node("or", left=a, right=b)


def all_of(*operands):
    return _node("allOf", operands=list(operands))


def any_of(*operands):
    return _node("anyOf", operands=list(operands))


def xor(a, b):
    return or_(and_(a, not_(b)), and_(not_(a), b))


def nand(a, b):
    return not_(and_(a, b))


def nor(a, b):
    return not_(or_(a, b))


def implies(a, b):
    return or_(not_(a), b)


def iff(a, b):
    return not_(xor(a, b))


def some(collection, item, filter=None):
    return _node("some", collection=collection, item=item, filter=filter)


def every(collection, item, filter=None):
    return _node("every", collection=collection, item=item, filter=filter)


def none(collection, item, filter=None):
    return not_(some(collection, item, filter))


def arith(op, left, right):
    return _node("arithmetic", op=op, left=left, right=right)


def negate(operand):
    return _node("negate", operand=operand)


def call(fn, *args):
    return _node("call", fn=fn, args=list(args))


def lookup(table, *keys):
    return _node("lookup", table=table, keys=list(keys))


def conditional(cases, fallback, hit_policy=None):
    return _node("conditional", hitPolicy=hit_policy, cases=[{"when": w, "then": t} for w, t in cases], fallback=fallback)


def fold(collection, mode, item=None, filter=None, initial=None, combine=None):
    combiner = {"mode": mode} | ({"initial": initial, "combine": combine} if mode == "reduce" else {"item": item})
    return _node("fold", collection=collection, filter=filter, combiner=combiner)


def accumulator():
    return _node("accumulator")


def delegate(system, payload=None):
    return {"kind": "delegate", "system": system, "payload": payload}


def tree(key):
    return _node("treeReference", key=key)


def sum_(collection, item, filter=None):
    return fold(collection, "reduce", filter=filter, initial=lit(0), combine=arith("add", accumulator(), item))


def presence_of(probe):
    return conditional([(member_of("in", probe, [probe]), lit(1))], lit(0))


def count(collection, filter=None, probe=None):
    return sum_(collection, lit(1) if probe is None else presence_of(probe), filter)


def average(collection, item, filter=None):
    return arith("divide", sum_(collection, item, filter), count(collection, filter))


def coalesce(first, second, *rest):
    candidates = [first, second, *rest]
    return _reduce(lambda below, own: conditional([(exists(own), own)], below), reversed(candidates[:-1]), candidates[-1])


#: Characters that patterns escape (fixed values).
_SYNTAX = "^$\\.*+?()[]{}|/"
_ANY = "[\\s\\S]*"


def _quoted(text):
    return "".join("\\" + c if c in _SYNTAX else c for c in text)


def prefix_pattern(text, prefix):
    """The prefix alone, or followed by a space and anything."""
    return text_compare("matches", text, lit(f"^{_quoted(prefix)}(?: {_ANY})?$"))


def wildcard_pattern(text, pattern):
    """`*` is anything, `\\*` and `\\\\` are literal; a sole star after a last space makes both optional."""
    body, stars, rest = [], 0, pattern.strip()
    while rest:
        if rest[:2] in ("\\*", "\\\\"):
            body.append("\\" + rest[1])
            rest = rest[2:]
            continue
        stars += rest[0] == "*"
        body.append(_ANY if rest[0] == "*" else _quoted(rest[0]))
        rest = rest[1:]
    if stars == 1 and body[-2:] == [" ", _ANY]:
        body[-2:] = [f"(?: {_ANY})?"]
    return text_compare("matches", text, lit("^" + "".join(body) + "$"))


def glob_pattern(text, pattern):
    """`**` crosses `/`, `*` and `?` don't; nothing is escaped."""
    parts, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            parts.append(_ANY)
            i += 2
            continue
        parts.append({"*": "[^\\/]*", "?": "[^\\/]"}.get(pattern[i]) or _quoted(pattern[i]))
        i += 1
    return text_compare("matches", text, lit("^" + "".join(parts) + "$"))


def complex_from_polar(magnitude, phase, unit=None):
    return _node("complexLiteral", re=magnitude * math.cos(phase), im=magnitude * math.sin(phase), unit=unit)
