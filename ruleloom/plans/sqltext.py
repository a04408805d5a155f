"""Predicate trees as Spark SQL text with named parameters: a WHERE fragment for spark.sql(text, args={...}). A fragment that
stands in the text twice names its parameters twice.

What SQL text can't say exactly is refused with the node's kind, path and reason; `unpushable` tells beforehand. The
Column form (plans.rules) covers everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ruleloom.functions import regex as rx
from ruleloom.operators import values as val
from ruleloom.plans import nodes
from ruleloom.plans.nodes import canonical


class UnsupportedNode(ValueError):
    def __init__(self, kind: str, path: str, reason: str):
        super().__init__(f"'{kind}' at '{path or '.'}' has no SQL form: {reason}")
        self.kind, self.path, self.reason = kind, path, reason


class InvalidColumn(ValueError):
    """A column name that can't be written as one to three quoted segments."""


class InvalidTable(ValueError):
    """A collection's table name that can't be written as one or two quoted segments."""


class UnknownDialect(ValueError):
    """A dialect other than those that compile_sql writes."""


DIALECTS = ("spark",)


@dataclass
class SqlColumn:
    """A column of dotted segments, and its kind: text, number, boolean or timestamp."""

    column: str
    kind: str | None = None


@dataclass
class SqlCollection:
    """A child table, the SQL condition that ties its rows to the outer row, and its columns."""

    table: str
    join: str
    columns: dict = field(default_factory=dict)
    collections: dict = field(default_factory=dict)


OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "<>"}
TYPES = {"number": "DOUBLE", "text": "STRING", "boolean": "BOOLEAN", "instant": "BIGINT"}


def quoted(name: str, most: int, error=InvalidColumn) -> str:
    """Backquoted dotted segments."""
    parts = name.split(".") if isinstance(name, str) else []
    if not 1 <= len(parts) <= most or any(not p or "\0" in p or not carried(p) for p in parts):
        raise error(f"{name!r} is no name of 1 to {most} segments")
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def carried(text: str) -> bool:
    """Whether Spark strings, which are UTF-8, can carry a text: unpaired surrogates they can't."""
    return not any("\ud800" <= c <= "\udfff" for c in text)


class _Writer:
    def __init__(self, columns: dict, collections: dict, params: dict | None = None):
        self.columns, self.collections, self.params = columns, collections, {} if params is None else params
        self.seen: dict = {}

    def refuse(self, node, path, reason):
        raise UnsupportedNode(node["kind"], path, reason)

    # -- values: (text, kind) ----------------------------------------------------------------------------------------

    def literal(self, value, kind):
        name = f"p{len(self.params)}"
        self.params[name] = value
        return f"CAST(:{name} AS {TYPES[kind]})", kind

    def value(self, n, path):
        kind = n["kind"]
        if kind == "numberLiteral":
            if n.get("unit"):
                self.refuse(n, path, "units have no SQL form")
            if n["value"] != n["value"]:
                self.refuse(n, path, "NaN is no literal of a comparison")
            return self.literal(n["value"], "number")
        if kind == "textLiteral" and not carried(n["value"]):
            self.refuse(n, path, "a text with unpaired surrogates can't be carried")
        if kind in ("textLiteral", "booleanLiteral"):
            return self.literal(n["value"], "text" if kind == "textLiteral" else "boolean")
        if kind == "instantLiteral":
            ms = val.parse_instant(n["value"])
            return (f"CAST(NULL AS {TYPES['instant']})", "instant") if ms is None else self.literal(ms, "instant")
        if kind == "reference":
            if n.get("unit"):
                self.refuse(n, path, "units have no SQL form")
            if not isinstance(n["key"], str):
                self.refuse(n, path, "a column's key is a string")
            bound = self.column(n["key"])
            name = quoted(bound.column, 3)
            if bound.kind == "timestamp":
                return f"unix_millis({name})", "instant"
            return (f"CAST({name} AS DOUBLE)" if bound.kind == "number" else name), bound.kind
        if kind == "fold" and n["combiner"]["mode"] in ("max", "min"):
            return self.extreme(n, path)
        return self.refuse(n, path, "only references, literals and folds by max or min have a SQL form")

    def column(self, key: str) -> SqlColumn:
        """The binding of a key, looked up once; a callable in place of the mapping is asked once a key, too."""
        if key not in self.seen:
            bound = self.columns(key) if callable(self.columns) else self.columns.get(key)
            self.seen[key] = bound if isinstance(bound, SqlColumn) else SqlColumn(bound or key)
        return self.seen[key]

    # -- predicates --------------------------------------------------------------------------------------------------

    def truth(self, n, path):
        return getattr(self, "t_" + n["kind"])(n, path)

    def t_not(self, n, path):
        return f"(NOT {self.truth(n['operand'], _at(path, 'operand'))})"

    def t_and(self, n, path):
        return f"({self.truth(n['left'], _at(path, 'left'))} {n['kind'].upper()} {self.truth(n['right'], _at(path, 'right'))})"

    t_or = t_and

    def t_allOf(self, n, path):
        every = n["kind"] == "allOf"
        parts = [self.truth(x, f"{_at(path, 'operands')}[{i}]") for i, x in enumerate(n["operands"])]
        return f"({(' AND ' if every else ' OR ').join(parts)})" if parts else ("TRUE" if every else "FALSE")

    t_anyOf = t_allOf

    def t_compare(self, n, path):
        (a, ka), (b, kb) = self.value(n["left"], _at(path, "left")), self.value(n["right"], _at(path, "right"))
        if ka == "text" or kb == "text" or ka and kb and ka != kb or "boolean" in (ka, kb) and n["op"] not in ("eq", "neq"):
            return "CAST(NULL AS BOOLEAN)"
        if "number" in (ka, kb):
            unlike = f"(isnan({a}) AND {b} IS NOT NULL OR isnan({b}) AND {a} IS NOT NULL)"
            plain = f"{a} {OPS[n['op']]} {b}"
            return f"({plain} OR {unlike})" if n["op"] == "neq" else f"({plain} AND NOT {unlike})"
        return f"({a} {OPS[n['op']]} {b})"

    def t_textCompare(self, n, path):
        (a, ka), (b, kb) = self.value(n["left"], _at(path, "left")), self.value(n["right"], _at(path, "right"))
        if ka not in (None, "text") or kb not in (None, "text"):
            return "CAST(NULL AS BOOLEAN)"
        op = n["op"]
        if op in ("equals", "notEquals"):
            return f"({a} {'=' if op == 'equals' else '<>'} {b})"
        if n["right"]["kind"] != "textLiteral":
            self.refuse(n, path, "a pattern must be a literal")
        portable = op.startswith("portable")
        try:
            tree = (rx.parse if portable else rx.parse_ecma)(n["right"]["value"])
        except rx.PatternError as e:
            self.refuse(n, path, str(e))
        if rx.java.may_explode(tree) or rx.java.splits_astral(tree):
            self.refuse(n, path, "the pattern needs the bounded matcher")
        self.params[f"p{len(self.params) - 1}"] = rx.render(tree)
        return f"({'NOT ' if 'ot' in op else ''}({a} RLIKE {b}))"

    def t_memberOf(self, n, path):
        operand, kind = self.value(n["operand"], _at(path, "operand"))
        inside = n["op"] == "in"
        if not n["candidates"]:
            return f"({operand} IS NULL AND CAST(NULL AS BOOLEAN))" if inside else f"({operand} IS NOT NULL OR CAST(NULL AS BOOLEAN))"
        parts = []
        for i, x in enumerate(n["candidates"]):
            text, own = self.value(x, f"{_at(path, 'candidates')}[{i}]")
            if kind and own and kind != own:
                parts.append("CAST(NULL AS BOOLEAN)")
            elif "number" in (kind, own):  # NaN is in no list, itself included
                parts.append(f"({operand} = {text} AND NOT (isnan({operand}) AND {text} IS NOT NULL))")
            else:
                parts.append(f"({operand} = {text})")
        found = f"(({' OR '.join(parts)}) AND ({operand} IS NOT NULL OR CAST(NULL AS BOOLEAN)))"
        return found if inside else f"(NOT {found})"

    def t_exists(self, n, path):
        if n["operand"]["kind"] not in ("reference",) and not n["operand"]["kind"].endswith("Literal"):
            self.refuse(n, path, "only a reference's presence has a SQL form")
        return f"({self.value(n['operand'], _at(path, 'operand'))[0]} IS NOT NULL)"

    def t_some(self, n, path):
        every = n["kind"] == "every"
        inner, bound = self.inside(n, path)
        f = inner.truth(n["filter"], _at(path, "filter")) if n.get("filter") else "TRUE"
        p = inner.truth(n["item"], _at(path, "item"))
        vote = f"(CASE WHEN {f} THEN {p} WHEN NOT {f} THEN {str(every).upper()} END)"
        hit, settled = ("NOT ", "FALSE") if every else ("", "TRUE")
        other = str(every).upper()
        return (
            f"(SELECT CASE WHEN count_if({hit}{vote}) > 0 THEN {settled} WHEN count_if({vote} IS NULL) > 0 THEN CAST(NULL AS BOOLEAN) ELSE {other} END"
            f" FROM {quoted(bound.table, 2, InvalidTable)} WHERE {bound.join})"
        )

    t_every = t_some

    def t_treeReference(self, n, path):
        self.refuse(n, path, "references to trees are inlined in the column form only")

    def inside(self, n, path):
        bound = self.collections.get(n["collection"] if isinstance(n["collection"], str) else canonical(n["collection"]))
        if bound is None:
            self.refuse(n, path, f"no table is bound to collection {canonical(n['collection'])}")
        return _Writer(bound.columns, bound.collections, self.params), bound

    def extreme(self, n, path):
        inner, bound = self.inside(n, path)
        f = inner.truth(n["filter"], _at(path, "filter")) if n.get("filter") else "TRUE"
        v, kind = inner.value(n["combiner"]["item"], _at(path, "combiner.item"))
        if kind in ("text", "boolean"):
            self.refuse(n, path, f"{kind} values have no order")
        return (
            f"(SELECT CASE WHEN count_if({f} IS NULL) + count_if({f} AND {v} IS NULL) > 0 THEN NULL ELSE {n['combiner']['mode']}(CASE WHEN {f} THEN {v} END) END"
            f" FROM {quoted(bound.table, 2, InvalidTable)} WHERE {bound.join})"
        ), kind


def _at(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def compile_sql(predicate: dict, columns: dict | None = None, collections: dict | None = None, dialect: str = "spark") -> tuple[str, dict]:
    """(text, parameters by name) of a WHERE fragment; columns and collections map keys to SqlColumn and SqlCollection."""
    if dialect not in DIALECTS:
        raise UnknownDialect(f"'{dialect}' is none of the dialects {', '.join(DIALECTS)}")
    writer = _Writer(columns or {}, collections or {})
    text = writer.truth(nodes.read_predicate(predicate), "")
    used = set(re.findall(r":(p\d+)\b", text))
    return text, {k: v for k, v in writer.params.items() if k in used}


def unpushable(predicate: dict, columns: dict | None = None, collections: dict | None = None) -> tuple[str, str, str] | None:
    """(kind, path, reason) of the first node without a SQL form; None if all have one."""
    try:
        compile_sql(predicate, columns, collections)
    except UnsupportedNode as e:
        return e.kind, e.path, e.reason
    return None
