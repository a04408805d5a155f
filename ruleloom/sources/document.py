"""One document: a tree and named inputs, evaluated as a one-row DataFrame.

Inputs are numbers, texts, booleans or computed values ({"kind": ...}); lists of objects are collections. Inside an item
only the item's fields are visible.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ruleloom.operators import values as val
from ruleloom.plans import nodes
from ruleloom.plans.lower import MAX_NODES
from ruleloom.plans.nodes import canonical
from ruleloom.sources.bindings import ArrayBinding, BindingError, ColumnBinding, Scope


class InvalidInputs(ValueError):
    def __init__(self, issues):
        super().__init__("; ".join(f"{p}: {t}" for p, t in issues))
        self.issues = issues


_COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
_TYPES = {"number": T.DoubleType(), "text": T.StringType(), "boolean": T.BooleanType(), "instant": T.StringType(), "duration": T.DoubleType(), "complex": _COMPLEX}


def _computed(v, path, issues):
    """(kind, value, unit) of an input."""
    if isinstance(v, bool):
        return "boolean", v, None
    if isinstance(v, (int, float)) and math.isfinite(v):
        return "number", float(v), None
    if isinstance(v, str):
        return "text", v, None
    if isinstance(v, dict) and v.get("kind") in _TYPES:
        kind, x = v["kind"], v.get("value")
        if kind == "complex" and all(isinstance(v.get(k), (int, float)) and math.isfinite(v[k]) for k in ("re", "im")):
            return kind, (float(v["re"]), float(v["im"])), v.get("unit")
        if kind in ("number", "duration") and isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and (kind == "number" or v.get("unit") in val.MILLIS):
            return kind, float(x), v.get("unit")
        if kind in ("text", "instant") and isinstance(x, str) or kind == "boolean" and isinstance(x, bool):
            return kind, x, None
    issues.append((path, "expected a finite number, a text, a boolean or a computed value"))
    return None


def parse_inputs(inputs) -> tuple[dict, dict]:
    """(values, lists) by name: computed values, and lists of items with computed values."""
    issues: list = []
    if not isinstance(inputs, dict):
        raise InvalidInputs([("inputs", "expected an object")])
    values, lists = {}, {}
    for name, v in inputs.items():
        if not isinstance(v, list):
            values[name] = _computed(v, f"inputs.{name}", issues)
            continue
        lists[name] = items = []
        for i, item in enumerate(v):
            if not isinstance(item, dict):
                issues.append((f"inputs.{name}[{i}]", "expected an object"))
                continue
            items.append({k: _computed(x, f"inputs.{name}[{i}].{k}", issues) for k, x in item.items()})
    if issues:
        raise InvalidInputs(issues)
    return values, lists


def _binding(name, kinds, where):
    if len(set((k, json.dumps(u)) for k, u in kinds)) > 1:
        raise BindingError(f"{where} has values of different kinds")
    kind, unit = kinds[0]
    return ColumnBinding(name, kind, unit), T.StructField(name, _TYPES[kind])


def input_frame(spark: SparkSession, inputs):
    """(one-row DataFrame, scope) of a document's inputs."""
    values, lists = parse_inputs(inputs)
    columns, fields, row, collections = {}, [], [], {}
    for i, (name, (kind, value, unit)) in enumerate(values.items()):
        columns[name], f = _binding(f"v{i}", [(kind, unit)], name)
        fields.append(f)
        row.append(value)
    for i, (name, items) in enumerate(lists.items()):
        keys = list(dict.fromkeys(k for item in items for k in item))
        bound = {k: _binding(f"f{j}", [x[k][::2] for x in items if k in x], f"{name}.{k}") for j, k in enumerate(keys)}
        element = T.StructType([f for _, f in bound.values()] or [T.StructField("none", T.BooleanType())])
        fields.append(T.StructField(f"c{i}", T.ArrayType(element)))
        row.append([tuple(x[k][1] if k in x else None for k in keys) or (None,) for x in items])
        collections[name] = ArrayBinding(f"c{i}", {k: b for k, (b, _) in bound.items()})
    if not fields:
        fields, row = [T.StructField("none", T.BooleanType())], [None]
    return spark.createDataFrame([tuple(row)], T.StructType(fields)), Scope(columns, collections)


def visits(node: dict, sizes: dict[str, int]) -> int:
    """The nodes that an evaluation visits, those of a collection's trees once for each of its items."""
    times = sizes.get(canonical(node["collection"]), 0) if "collection" in node else 1
    out = 1
    for name, one in _below(node):
        out += visits(one, sizes) * (times if name in ("item", "filter", "combine") else 1)
    return out


def _below(node: dict):
    """(field, tree) for the trees directly below a node; a fold's combiner counts as the fold."""
    held = {**node, **node.get("combiner", {})}
    for name in ("operand", "left", "right", "item", "filter", "initial", "combine", "fallback"):
        if isinstance(held.get(name), dict):
            yield name, held[name]
    for name in ("operands", "candidates", "args", "keys"):
        yield from ((name, x) for x in held.get(name, ()))
    for case in held.get("cases", ()):
        yield from case.items()


def evaluate_document(spark: SparkSession, tree, inputs, of: str | None = None, max_nodes: int = MAX_NODES) -> dict:
    """{"outcome": "evaluated", ...} with a value or a reason, or {"outcome": "rejected", "reason": ..., "issues": ...}.

    An evaluation that would visit more than max_nodes nodes is indeterminate."""
    from ruleloom.plans.rules import lower, with_verdict

    kinds = nodes.tree_kinds(tree)
    if of is None:
        if not kinds:
            return {"outcome": "rejected", "reason": "invalid", "issues": nodes.issues(tree, "predicate")}
        if len(kinds) > 1:
            return {"outcome": "rejected", "reason": "ambiguous-tree-kind", "issues": []}
        of = kinds[0]
    elif of not in kinds:
        return {"outcome": "rejected", "reason": "invalid", "issues": nodes.issues(tree, of)}
    try:
        df, scope = input_frame(spark, inputs)
    except InvalidInputs as e:
        return {"outcome": "rejected", "reason": "invalid", "issues": e.issues}
    read = (nodes.read_predicate if of == "predicate" else nodes.read_expression)(tree)
    if visits(read, {canonical(k): len(v) for k, v in inputs.items() if isinstance(v, list)}) > max_nodes:
        return {"outcome": "evaluated", "as": of, "status": "indeterminate", "reason": {"code": "domain-error", "message": f"evaluation exceeded the maximum of {max_nodes} nodes"}}
    _, e = lower(df, tree, of, scope)
    got = with_verdict(df, "verdict", tree, of, scope).first().verdict
    if got.code is not None:
        return {"outcome": "evaluated", "as": of, "status": "indeterminate", "reason": {"code": got.code, "message": got.message}}
    value = got.value
    if of == "expression":
        if isinstance(value, float) and not math.isfinite(value):
            return {"outcome": "unrepresentable"}
        unit = {"unit": e.unit} if e.unit else {}
        if e.kind == "complex":
            value = {"kind": "complex", "re": value.re, "im": value.im} | unit
        else:
            value = {"kind": e.kind, "value": val.format_instant(value) if e.kind == "instant" else value} | unit
    return {"outcome": "evaluated", "as": of, "status": "definite", "value": value}
