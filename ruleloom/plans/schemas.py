"""Named schemas: the trees by kind, and the values that trees and verdicts consist of.

read(name, value) gives the value as the schema reads it (keys that it doesn't name are dropped) or raises InvalidTree with
every issue and its path; validate() reports the same as a dictionary; json_schema(name) is the schema as JSON Schema.
"""

from __future__ import annotations

from ruleloom.plans import nodes
from ruleloom.plans.nodes import EXPRESSIONS, PREDICATES, InvalidTree, _definition, _object, _Reader

#: Reason codes of a verdict (fixed values).
CODES = ("not-found", "not-yet-known", "wrong-type", "domain-error")
#: Computed values by kind: field -> type, as nodes describes fields.
COMPUTED = {
    "number": {"value": "number", "unit": "unit?"},
    "text": {"value": "string"},
    "boolean": {"value": "boolean"},
    "instant": {"value": "string"},
    "duration": {"value": "number", "unit": nodes.DURATION_UNITS},
    "complex": {"re": "number", "im": "number", "unit": "unit?"},
}
#: Schemas that are an enumeration, or a field type of nodes.
FIELDS = {
    "ArithmeticOperator": nodes.ARITHMETIC, "ComparisonOperator": nodes.COMPARISONS, "DurationUnit": nodes.DURATION_UNITS, "HitPolicy": nodes.HIT_POLICIES,
    "MembershipOperator": nodes.MEMBERSHIPS, "TextComparisonOperator": nodes.TEXT_COMPARISONS, "ConditionalCase": "case", "FoldCombiner": "combiner",
    "JsonValue": "json", "Unit": "unit", "PredicateNode": "P", "ExpressionNode": "E",
}
FORMS = {"ComplexRectangularLiteralNode": {"re": "number", "im": "number"}, "ComplexPolarLiteralNode": {"magnitude": "number", "phase": "number"}}


def _node_name(kind: str) -> str:
    return f"{kind[0].upper()}{kind[1:]}Node"


#: Type name -> kind, for the schemas of one kind of node.
NODES = {_node_name(kind): kind for kind in [*PREDICATES, *EXPRESSIONS]}
NAMES = sorted(f"{x}Schema" for x in [*NODES, *FIELDS, *FORMS, "ComputedValue", "IndeterminateReason"])


def _tagged(reader: _Reader, value, kinds: dict, path: str):
    kind = value.get("kind") if isinstance(value, dict) else None
    if kind not in kinds:
        return reader.fail(path, f"expected a value; its kind is one of {', '.join(kinds)}")
    return {"kind": kind} | reader.fields(value, kinds[kind], path, 1)


def read(name: str, value):
    """The value as the schema called `name` reads it."""
    if name not in NAMES:
        raise KeyError(name)
    short, reader = name.removesuffix("Schema"), _Reader()
    if short in NODES:
        kind = NODES[short]
        out = reader.node(value, {k: v for group in (PREDICATES, EXPRESSIONS) for k, v in group.items() if k == kind}, "", 1)
    elif short in FORMS:
        if not isinstance(value, dict) or set(value) - {"kind", "unit"} != set(FORMS[short]):
            reader.fail("", f"expected {' and '.join(map(repr, FORMS[short]))}")
            out = None
        else:
            out = reader.node(value, {"complexLiteral": {}}, "", 1)
            if out and short == "ComplexPolarLiteralNode":  # as it was written: reading it alone makes no tree of it
                out = {k: value[k] for k in ("kind", "magnitude", "phase")} | {k: v for k, v in out.items() if k == "unit"}
    elif short == "ComputedValue":
        out = _tagged(reader, value, COMPUTED, "")
    elif short == "IndeterminateReason":
        out = reader.fields(value, {"code": CODES, "message": "string"}, "", 1) if isinstance(value, dict) else reader.fail("", "expected an object")
    else:
        out = reader.field(FIELDS[short], value, "", 1)
    if reader.issues:
        raise InvalidTree(reader.issues)
    return out


def validate(name: str, value) -> dict:
    """{"ok": True, "value": ...}, or {"ok": False, "issues": [(path, text), ...]}."""
    try:
        return {"ok": True, "value": read(name, value)}
    except InvalidTree as e:
        return {"ok": False, "issues": e.issues}


def json_schema(name: str) -> dict:
    """The JSON Schema of one named schema, with the definitions of both kinds of tree."""
    if name not in NAMES:
        raise KeyError(name)
    short, whole = name.removesuffix("Schema"), nodes.json_schema()
    unit = {"unit": "unit?"}
    if short in NODES and short != "ComplexLiteralNode":
        kind = NODES[short]
        own = _object("kind", kind, (PREDICATES | EXPRESSIONS)[kind])
    elif short in FORMS or short == "ComplexLiteralNode":
        forms = [_object("kind", "complexLiteral", f | unit) | {"additionalProperties": False} for k, f in FORMS.items() if short in (k, "ComplexLiteralNode")]
        own = forms[0] if len(forms) == 1 else {"anyOf": forms}
    elif short == "ComputedValue":
        own = {"anyOf": [_object("kind", k, f) for k, f in COMPUTED.items()]}
    elif short == "IndeterminateReason":
        own = {"type": "object", "properties": {"code": {"enum": list(CODES)}, "message": {"type": "string"}}, "required": ["code", "message"]}
    else:
        own = _definition(FIELDS[short])
    return {"$schema": whole["$schema"], "title": short, **own, "$defs": whole["$defs"]}
