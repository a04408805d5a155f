"""Reading rule trees: JSON objects in, checked and normalised dictionaries out.

The vocabulary is closed. Keys that a node doesn't name are dropped; a complex literal that mixes its two forms is refused;
polar literals become rectangular. Issues carry a path such as `operands[2].left: ...`.
"""

from __future__ import annotations

import json
import math
import sys

from ruleloom.operators.values import number_text

MAX_DEPTH, MAX_ITEMS, MAX_VALUES, MAX_STRING, MAX_TEXT = 500, 65_536, 1_000_000, 1_048_576, 4_194_304

# trees may nest MAX_DEPTH deep, and reading takes some calls a level
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))

COMPARISONS = ("gt", "gte", "lt", "lte", "eq", "neq")
TEXT_COMPARISONS = ("equals", "notEquals", "matches", "notMatches", "portableMatches", "portableNotMatches")
MEMBERSHIPS = ("in", "notIn")
ARITHMETIC = ("add", "subtract", "multiply", "divide", "power", "modulo")
DURATION_UNITS = ("ms", "s", "min", "h", "d")
HIT_POLICIES = ("first", "unique")

#: kind -> field -> type; P and E are trees, a trailing ? is optional, [] a list, | an enumeration.
PREDICATES = {
    "not": {"operand": "P"},
    "and": {"left": "P", "right": "P"},
    "or": {"left": "P", "right": "P"},
    "allOf": {"operands": "P[]"},
    "anyOf": {"operands": "P[]"},
    "compare": {"op": COMPARISONS, "left": "E", "right": "E"},
    "textCompare": {"op": TEXT_COMPARISONS, "left": "E", "right": "E"},
    "memberOf": {"op": MEMBERSHIPS, "operand": "E", "candidates": "E[]"},
    "exists": {"operand": "E"},
    "some": {"collection": "json", "item": "P", "filter": "P?"},
    "every": {"collection": "json", "item": "P", "filter": "P?"},
    "treeReference": {"key": "json"},
}
EXPRESSIONS = {
    "numberLiteral": {"value": "number", "unit": "unit?"},
    "textLiteral": {"value": "string"},
    "booleanLiteral": {"value": "boolean"},
    "instantLiteral": {"value": "string"},
    "durationLiteral": {"value": "number", "unit": DURATION_UNITS},
    "complexLiteral": {},
    "reference": {"key": "json", "unit": "unit?"},
    "arithmetic": {"op": ARITHMETIC, "left": "E", "right": "E"},
    "negate": {"operand": "E"},
    "call": {"fn": "string", "args": "E[]"},
    "lookup": {"table": "json", "keys": "E[]"},
    "conditional": {"hitPolicy": "hit?", "cases": "case[]", "fallback": "E"},
    "fold": {"collection": "json", "filter": "P?", "combiner": "combiner"},
    "accumulator": {},
    "delegate": {"system": "string", "payload": "json"},
    "treeReference": {"key": "json"},
}
COMBINERS = {"max": {"item": "E"}, "min": {"item": "E"}, "reduce": {"initial": "E", "combine": "E"}}


class InvalidTree(ValueError):
    """A tree that doesn't read; `issues` lists (path, text)."""

    def __init__(self, issues: list[tuple[str, str]]):
        super().__init__("; ".join(f"{p}: {t}" if p else t for p, t in issues))
        self.issues = issues


class _Reader:
    def __init__(self):
        self.issues: list[tuple[str, str]] = []
        self.values = self.text = 0

    def fail(self, path: str, text: str):
        self.issues.append((path, text))

    def number(self, v, path):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return self.fail(path, "expected a number")
        if isinstance(v, int) and abs(v) > 2**1023:
            return self.fail(path, "expected a finite number")
        return float(v)

    def string(self, v, path):
        if not isinstance(v, str):
            return self.fail(path, "expected a string")
        size = len(v.encode("utf-16-le", "surrogatepass")) // 2
        self.text += size
        if size > MAX_STRING or self.text > MAX_TEXT:
            return self.fail(path, "the text is too long")
        return v

    def unit(self, v, path):
        if not isinstance(v, dict):
            return self.fail(path, "expected a unit: an object of exponents")
        out = {k: self.number(x, f"{path}.{k}") for k, x in v.items()}
        return {k: x for k, x in out.items() if x}

    def json(self, v, path, depth):
        self.values += 1
        if depth > MAX_DEPTH or self.values > MAX_VALUES:
            return self.fail(path, "the document is too deep or too large")
        if isinstance(v, str):
            return self.string(v, path)
        if isinstance(v, dict):
            return {k: self.json(x, f"{path}.{k}", depth + 1) for k, x in v.items() if k != "__proto__"}
        if isinstance(v, (list, tuple)):
            return [self.json(x, f"{path}[{i}]", depth + 1) for i, x in enumerate(v)]
        if v is None or isinstance(v, (bool, int)) or isinstance(v, float) and math.isfinite(v):
            return v
        return self.fail(path, "expected a JSON value")

    def field(self, kind, v, path, depth):
        if isinstance(kind, tuple):
            return v if v in kind else self.fail(path, f"expected one of {', '.join(kind)}")
        if kind.endswith("[]"):
            if not isinstance(v, (list, tuple)):
                return self.fail(path, "expected a list")
            if len(v) > MAX_ITEMS:
                return self.fail(path, "the list is too long")
            return [self.field(kind[:-2], x, f"{path}[{i}]", depth) for i, x in enumerate(v)]
        if kind in ("P", "E"):
            return self.node(v, PREDICATES if kind == "P" else EXPRESSIONS, path, depth + 1)
        if kind == "json":
            return self.json(v, path, depth)
        if kind == "hit":
            return self.field(HIT_POLICIES, v, path, depth)
        if kind == "boolean":
            return v if isinstance(v, bool) else self.fail(path, "expected a boolean")
        if kind == "case":
            if not isinstance(v, dict) or "when" not in v or "then" not in v:
                return self.fail(path, "expected a case with 'when' and 'then'")
            return {"when": self.field("P", v["when"], f"{path}.when", depth), "then": self.field("E", v["then"], f"{path}.then", depth)}
        if kind == "combiner":
            mode = v.get("mode") if isinstance(v, dict) else None
            if mode not in COMBINERS:
                return self.fail(path, f"expected a combiner with a mode of {', '.join(COMBINERS)}")
            return {"mode": mode} | self.fields(v, COMBINERS[mode], path, depth)
        return getattr(self, kind)(v, path)

    def fields(self, v, spec, path, depth):
        out = {}
        for name, kind in spec.items():
            optional = isinstance(kind, str) and kind.endswith("?")
            at = f"{path}.{name}" if path else name
            if name in v and not (optional and v[name] is None):
                out[name] = self.field(kind[:-1] if optional else kind, v[name], at, depth)
            elif not optional:
                self.fail(at, "is missing")
        return out

    def node(self, v, kinds, path, depth):
        self.values += 1
        if depth > MAX_DEPTH or self.values > MAX_VALUES:
            return self.fail(path, "the tree is too deep or too large")
        kind = v.get("kind") if isinstance(v, dict) else None
        if not isinstance(kind, str) or kind not in kinds:
            return self.fail(path, f"expected a node; its kind is one of {', '.join(kinds)}")
        if kind == "complexLiteral":
            return self.complex(v, path)
        return {"kind": kind} | self.fields(v, kinds[kind], path, depth)

    def complex(self, v, path):
        keys = set(v) - {"kind", "unit"}
        forms = ({"re", "im"}, {"magnitude", "phase"})
        if keys not in forms:
            return self.fail(path, "expected either 're' and 'im' or 'magnitude' and 'phase'")
        a, b = ("re", "im") if keys == forms[0] else ("magnitude", "phase")
        x, y = self.number(v[a], f"{path}.{a}"), self.number(v[b], f"{path}.{b}")
        if x is None or y is None:
            return None
        re, im = (x, y) if a == "re" else (x * math.cos(y), x * math.sin(y))
        unit = {"unit": self.unit(v["unit"], f"{path}.unit")} if v.get("unit") is not None else {}
        return {"kind": "complexLiteral", "re": re, "im": im} | unit


def _read(value, kinds):
    reader = _Reader()
    out = reader.node(value, kinds, "", 1)
    if reader.issues:
        raise InvalidTree(reader.issues)
    return out


def read_predicate(value) -> dict:
    return _read(value, PREDICATES)


def read_expression(value) -> dict:
    return _read(value, EXPRESSIONS)


def issues(value, of: str = "predicate") -> list[tuple[str, str]]:
    """What is wrong with a tree; empty if it reads."""
    try:
        (read_predicate if of == "predicate" else read_expression)(value)
    except InvalidTree as e:
        return e.issues
    return []


def tree_kinds(value) -> list[str]:
    """Which of predicate and expression a value reads as."""
    return [of for of in ("predicate", "expression") if not issues(value, of)]


def canonical(value) -> str:
    """RFC 8785 text: keys sorted by their UTF-16 units, no white space, numbers in their shortest form."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return f"[{','.join(map(canonical, value))}]"
    units = lambda k: k.encode("utf-16-be", "surrogatepass")
    return f"{{{','.join(f'{canonical(k)}:{canonical(value[k])}' for k in sorted(value, key=units))}}}"


def children(node: dict):
    """The trees directly below a node, in the order of evaluation."""
    for name in ("operand", "left", "right", "fallback", "item", "filter", "initial", "combine"):
        if isinstance(node.get(name), dict) and name != "fallback":
            yield node[name]
    for name in ("operands", "candidates", "args", "keys"):
        yield from node.get(name, ())
    for case in node.get("cases", ()):
        yield case["when"]
        yield case["then"]
    if isinstance(node.get("fallback"), dict):
        yield node["fallback"]
    if isinstance(node.get("combiner"), dict):
        yield from children(node["combiner"])


def size(node: dict) -> int:
    return 1 + sum(map(size, children(node)))


def _definition(kind):
    if isinstance(kind, tuple):
        return {"enum": list(kind)}
    if kind.endswith("?"):
        return _definition(kind[:-1])
    if kind.endswith("[]"):
        return {"type": "array", "items": _definition(kind[:-2]), "maxItems": MAX_ITEMS}
    named = {"P": "PredicateNode", "E": "ExpressionNode", "case": "ConditionalCase", "combiner": "FoldCombiner", "unit": "Unit"}
    if kind in named:
        return {"$ref": f"#/$defs/{named[kind]}"}
    return {"number": {"type": "number"}, "string": {"type": "string"}, "boolean": {"type": "boolean"}, "json": {}, "hit": {"enum": list(HIT_POLICIES)}}[kind]


def _object(tag: str, value: str, spec: dict) -> dict:
    required = [n for n, k in spec.items() if not (isinstance(k, str) and k.endswith("?"))]
    return {"type": "object", "properties": {tag: {"const": value}} | {n: _definition(k) for n, k in spec.items()}, "required": [tag, *required]}


def json_schema() -> dict:
    """The JSON Schema of both kinds of tree."""
    unit = {"unit": "unit?"}
    complex_forms = [_object("kind", "complexLiteral", {a: "number", b: "number"} | unit) | {"additionalProperties": False} for a, b in (("re", "im"), ("magnitude", "phase"))]
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "$defs": {
            "Unit": {"type": "object", "additionalProperties": {"type": "number"}},
            "ConditionalCase": {"type": "object", "properties": {"when": _definition("P"), "then": _definition("E")}, "required": ["when", "then"]},
            "FoldCombiner": {"anyOf": [_object("mode", m, s) for m, s in COMBINERS.items()]},
            "PredicateNode": {"anyOf": [_object("kind", k, s) for k, s in PREDICATES.items()]},
            "ExpressionNode": {"anyOf": [_object("kind", k, s) for k, s in EXPRESSIONS.items() if k != "complexLiteral"] + complex_forms},
        },
    }
