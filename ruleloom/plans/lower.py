"""Lowering trees to Catalyst columns.

Every node becomes one Column. In value mode it is the node's value, NULL for indeterminate: Kleene logic is what SQL's AND,
OR and NOT do, so a rule is a plain filter. In verdict mode it is struct<v, r: struct<code, message>>, r being NULL for a
definite value; children are bound once by a lambda over a one-element array, so plans grow with the tree and not with
the number of its paths. Kinds and units are inferred while lowering; what they settle is settled here.

Collections in other tables are read by one grouped pass a collection and joined back. In value mode `some`, `every`,
`max`, `min` and the shapes of sum, count and average become hash aggregates; other folds and verdicts gather the items
of a parent in order, in an array.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.functions import builtin
from ruleloom.functions import regex as rx
from ruleloom.operators import complexnum as cx
from ruleloom.operators import values as val
from ruleloom.plans import nodes
from ruleloom.plans.nodes import canonical
from ruleloom.sources.bindings import ArrayBinding, BindingError, ChildTable, ColumnBinding, Scope, kind_of

MAX_REFERENCES, MAX_NODES = 100, 10_000
#: From so many nodes on, an operand that a formula names twice is bound first.
BIND_FROM = 6
#: Up to so many nodes of its operands an operation names them directly, which keeps it in generated code.
INLINE_UP_TO = 12

REASON = "struct<code:string,message:string>"
TYPES = {"number": "double", "text": "string", "boolean": "boolean", "instant": "bigint", "duration": "double", "complex": "struct<re:double,im:double>", None: "boolean"}


class UnsupportedTree(ValueError):
    """A tree that has no column form: branches of different kinds."""


@dataclass
class Ev:
    """A lowered expression. kind None: indeterminate whatever the data. s: value or verdict column."""

    kind: str | None
    s: Column
    unit: Any = None
    finite: bool = True
    size: int = 1
    bare: tuple | None = None
    literal: Any = None


def reason(code: str, message) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def no_reason() -> Column:
    return F.lit(None).cast(REASON)


def null_of(kind) -> Column:
    return F.lit(None).cast(TYPES[kind])


def first_reason(rs: list[Column]) -> Column:
    return F.coalesce(*rs) if len(rs) > 1 else rs[0]


def urgent_reason(rs: list[Column]) -> Column:
    """The first reason, but one of a value that is not yet known comes before the others."""
    if len(rs) == 1:
        return rs[0]
    return F.coalesce(*[F.when(r["code"] == "not-yet-known", r) for r in rs], *rs)


def article(kind: str) -> str:
    return f"{'an' if kind[0] in 'aeiou' else 'a'} '{kind}'"


@dataclass
class Place:
    """Where keys resolve: a scope, the schema its columns come from, and how a column name becomes a Column."""

    scope: Scope
    schema: T.StructType
    get: Any
    item: bool = False


@dataclass
class Lowering:
    place: Place
    explain: bool = False
    limits: dict = field(default_factory=lambda: {"nodes": MAX_NODES})
    steps: list = field(default_factory=list)
    chain: tuple = ()
    accumulator: Ev | None = None
    tables: dict = field(default_factory=dict)
    names: list = field(default_factory=lambda: [0])
    visits: list = field(default_factory=lambda: [0])

    # -- composition -------------------------------------------------------------------------------------------------

    def fresh(self) -> str:
        self.names[0] += 1
        return f"__rl{self.names[0]}"

    def inlined(self, evs: list[Ev]) -> bool:
        return sum(e.size for e in evs) <= INLINE_UP_TO

    def grown(self, evs: list[Ev], times: int = 3) -> int:
        """The size of an operation that names its operands several times, unless they are bound."""
        return 1 + sum(e.size for e in evs) * (times if self.inlined(evs) else 1)

    def bound(self, evs: list[Ev], body) -> Column:
        """body(columns) with every child evaluated once, or named directly where they are small."""
        if self.inlined(evs):
            return body([e.s for e in evs])
        row = F.struct(*[e.s.alias(f"c{i}") for i, e in enumerate(evs)])
        return F.element_at(F.transform(F.array(row), lambda x: body([x[f"c{i}"] for i in range(len(evs))])), 1)

    def op(self, evs: list[Ev], kind, value, why=None, unit=None, finite=True, twice=False, reasons=first_reason) -> Ev:
        """An operation on children. value(columns): the value if they are definite, NULL-propagating.
        why(columns): the reason where all children are definite and the value is NULL. reasons: how children's combine."""
        size = 1 + sum(e.size for e in evs)
        if not self.explain:
            cols = [e.s for e in evs]
            s = self.bound(evs, value) if twice and any(e.size >= BIND_FROM for e in evs) else value(cols)
            return Ev(kind, s, unit, finite, size)

        def body(structs):
            vs = [x["v"] for x in structs]
            v = value(vs)
            own = [why(vs)] if why else []
            r = F.when(v.isNull(), F.coalesce(reasons([x["r"] for x in structs]), *own) if structs else own[0])
            return F.struct(v.alias("v"), r.alias("r"))

        return Ev(kind, self.bound(evs, body), unit, finite, self.grown(evs))

    def known(self, kind, v: Column, unit=None, literal=None, finite=True) -> Ev:
        s = F.struct(v.alias("v"), no_reason().alias("r")) if self.explain else v
        return Ev(kind, s, unit, finite, literal=literal)

    def wrong(self, evs: list[Ev], message: str, kind=None, code: str = "wrong-type") -> Ev:
        """Indeterminate whatever the values; an absent operand is reported before."""
        return self.op(evs, kind, lambda _: null_of(kind), lambda _: reason(code, message))

    def with_explain(self) -> Lowering:
        return replace(self, explain=True)

    # -- expressions -------------------------------------------------------------------------------------------------

    def expression(self, node: dict) -> Ev:
        self.visit()
        return getattr(self, "e_" + node["kind"])(node)

    def predicate(self, node: dict) -> Ev:
        self.visit()
        return getattr(self, "p_" + node["kind"])(node)

    def visit(self):
        """Count a node, those of referenced trees each time they are inlined."""
        self.visits[0] += 1
        if self.visits[0] > self.limits["nodes"]:
            raise nodes.InvalidTree([("", f"the tree has more than {self.limits['nodes']} nodes, with the trees that it refers to")])

    def e_numberLiteral(self, n):
        return self.known("number", F.lit(float(n["value"])), val.tidy(n.get("unit")), n["value"], finite=n["value"] == n["value"])

    def e_textLiteral(self, n):
        return self.known("text", F.lit(n["value"]), literal=n["value"])

    def e_booleanLiteral(self, n):
        return self.known("boolean", F.lit(n["value"]), literal=n["value"])

    def e_instantLiteral(self, n):
        ms = val.parse_instant(n["value"])
        if ms is None:
            return self.wrong([], f"'{n['value']}' is not a parseable ISO-8601 timestamp", "instant")
        return self.known("instant", F.lit(ms).cast("long"), literal=ms)

    def e_durationLiteral(self, n):
        return self.known("duration", F.lit(float(n["value"])), n["unit"], n["value"])

    def e_complexLiteral(self, n):
        return self.known("complex", cx.make(F.lit(float(n["re"])), F.lit(float(n["im"]))), val.tidy(n.get("unit")))

    def e_reference(self, n):
        key = n["key"]
        binding = self.place.scope.column(key)
        name = binding.column if binding else key
        if binding is None and (not isinstance(key, str) or key not in self.place.schema.names):
            return self.wrong([], f"no value found for reference key {canonical(key)}", code="not-found")
        binding = binding or ColumnBinding(key)
        get = self.place.get
        if isinstance(name, Column):
            v, kind, t = name, binding.kind, None
        else:
            v, t = get(name), self.place.schema[name].dataType
            kind = binding.kind or kind_of(t)
        if kind is None:
            raise BindingError(f"the column for key {canonical(key)} has no kind: {t}")
        finite = True
        unit = val.tidy(binding.unit) if kind in ("number", "complex") else binding.unit
        if kind == "number":
            finite = not isinstance(t, (T.DoubleType, T.FloatType, type(None)))
            v = v.cast("double")
        elif kind == "instant" and t is not None and not isinstance(t, T.LongType):
            v = val.instant_of_text(v) if isinstance(t, T.StringType) else val.instant_of_time(v, {T.TimestampType: "timestamp", T.DateType: "date"}.get(type(t), "ntz"))
        elif kind == "duration":
            unit = unit or ("ms" if isinstance(t, T.DayTimeIntervalType) else None)
            if isinstance(t, T.DayTimeIntervalType):
                v = F.timestamp_millis(F.lit(0)) + v
                v = F.unix_micros(v).cast("double") / 1000
            if unit not in val.MILLIS:
                raise BindingError(f"the duration for key {canonical(key)} needs a unit")
            v, finite = v.cast("double"), False
        pending = get(binding.pending) if isinstance(binding.pending, str) else binding.pending
        expected = n.get("unit")
        if self.explain:
            raw = get(name) if not isinstance(name, Column) else name
            absent = reason("not-found", f"no value found for reference key {canonical(key)}")
            if pending is not None:
                absent = F.when(pending, reason("not-yet-known", f"the value for reference key {canonical(key)} is not yet known")).otherwise(absent)
            if kind == "instant" and isinstance(t, T.StringType):
                absent = F.when(raw.isNotNull(), reason("wrong-type", F.concat(F.lit("'"), raw, F.lit("' is not a parseable ISO-8601 timestamp")))).otherwise(absent)
            out = Ev(kind, F.struct(v.alias("v"), F.when(v.isNull(), absent).alias("r")), unit, finite)
        else:
            plain = not (kind == "instant" and isinstance(t, T.StringType))
            out = Ev(kind, v, unit, finite, bare=(v, pending) if plain else None)
        if expected is not None:
            if kind not in ("number", "complex"):
                return self.wrong([out], "a unit was expected on a reference that resolved to a non-numeric value")
            if val.tidy(expected) != (unit or {}):
                return self.wrong([out], "the resolved value's unit does not match the reference's expected unit")
        return out

    def e_negate(self, n):
        a = self.expression(n["operand"])
        if a.kind is None:
            return self.wrong([a], "")
        if a.kind in ("number", "duration"):
            return self.op([a], a.kind, lambda c: -c[0], unit=a.unit, finite=a.finite)
        if a.kind == "complex":
            return self.op([a], "complex", lambda c: cx.make(-c[0]["re"], -c[0]["im"]), unit=a.unit, finite=a.finite, twice=True)
        return self.wrong([a], f"cannot negate {article(a.kind)} value")

    def checked(self, evs, kind, value, why=None, unit=None, inline=True) -> Ev:
        """An operation whose result must be finite."""
        inf = "result is not a finite number"
        ok = cx.is_finite if kind == "complex" else val.finite
        if not self.explain:
            raw = self.op(evs, kind, value, unit=unit, twice=True)
            if inline and self.inlined([raw]):
                return Ev(kind, F.when(ok(raw.s), raw.s), unit, True, 2 * raw.size)
            kept = F.filter(F.array(raw.s), lambda x: ok(x))
            return Ev(kind, F.get(kept, F.lit(0)), unit, True, raw.size + 1)

        def body(structs):
            vs = [x["v"] for x in structs]
            own = why(vs) if why else no_reason()
            r = F.coalesce(first_reason([x["r"] for x in structs]), own)
            if inline and self.inlined(evs):
                v = value(vs)
                sound = F.coalesce(ok(v), F.lit(False))
                return F.struct(F.when(r.isNull() & sound, v).alias("v"), F.when(r.isNotNull(), r).when(~sound, reason("domain-error", inf)).alias("r"))
            raw = F.struct(value(vs).alias("v"), r.alias("r"))
            return F.element_at(
                F.transform(
                    F.array(raw),
                    lambda x: F.struct(
                        F.when(x["r"].isNull() & ok(x["v"]), x["v"]).alias("v"),
                        F.when(x["r"].isNotNull(), x["r"]).when(~F.coalesce(ok(x["v"]), F.lit(False)), reason("domain-error", inf)).alias("r"),
                    ),
                ),
                1,
            )

        return Ev(kind, self.bound(evs, body), unit, True, self.grown(evs, 4))

    def e_arithmetic(self, n):
        op = n["op"]
        a, b = self.expression(n["left"]), self.expression(n["right"])
        ab = [a, b]
        if a.kind is None or b.kind is None:
            return self.wrong(ab, "")
        kinds = (a.kind, b.kind)
        mixed = f"arithmetic operator '{op}' is not defined between {article(a.kind).replace('an ', 'a ')} and {article(b.kind).replace('an ', 'a ')} value"
        if "instant" in kinds:
            if kinds == ("instant", "instant") and op == "subtract":
                return self.op(ab, "duration", lambda c: (c[0] - c[1]).cast("double"), unit="ms")
            if set(kinds) == {"instant", "duration"} and (op == "add"):
                i, d = (0, 1) if a.kind == "instant" else (1, 0)
                factor = float(val.MILLIS[ab[d].unit])

                def shifted(c):
                    raw = c[i].cast("double") + c[d] * factor
                    return F.when(F.abs(raw) <= float(val.INSTANT_LIMIT), raw.cast("long"))

                return self.op(ab, "instant", shifted, lambda _: reason("domain-error", "the resulting instant falls outside the representable timestamp range"), twice=True)
            return self.wrong(ab, mixed)
        if kinds == ("duration", "duration"):
            if op not in ("add", "subtract"):
                return self.wrong(ab, f"arithmetic operator '{op}' is not defined between two 'duration' values")
            fa, fb = float(val.MILLIS[a.unit]), float(val.MILLIS[b.unit])
            sign = 1.0 if op == "add" else -1.0
            return self.checked(ab, "duration", lambda c: c[0] * fa + c[1] * fb * sign, unit="ms")
        if "duration" in kinds and set(kinds) <= {"duration", "number", "complex"}:
            return self.wrong(ab, mixed)
        for e in ab:
            if e.kind not in ("number", "complex"):
                return self.wrong(ab, f"arithmetic requires numeric operands; got {article(e.kind).replace('an ', 'a ')} value")
        if "complex" in kinds:
            return self.complex_arithmetic(op, a, b, n)
        return self.real_arithmetic(op, a, b)

    def real_arithmetic(self, op, a, b):
        ab, ua, ub = [a, b], a.unit or {}, b.unit or {}
        if op in ("add", "subtract"):
            if ua != ub:
                return self.wrong(ab, f"cannot {op} numbers with incompatible units")
            return self.checked(ab, "number", (lambda c: c[0] + c[1]) if op == "add" else (lambda c: c[0] - c[1]), unit=ua)
        if op == "multiply":
            return self.checked(ab, "number", lambda c: c[0] * c[1], unit=val.times(ua, ub))
        if op == "divide":
            return self.checked(ab, "number", lambda c: F.try_divide(c[0], c[1]), lambda c: F.when(c[1] == 0, reason("domain-error", "division by zero")), val.times(ua, ub, -1))
        if ua or ub:
            return self.wrong(ab, f"'{op}' requires dimensionless operands")
        if op == "modulo":
            return self.checked(ab, "number", lambda c: F.try_mod(c[0], c[1]), lambda c: F.when(c[1] == 0, reason("domain-error", "modulo by zero")), {})
        root = lambda c: (c[0] < 0) & (c[1] != F.floor(c[1]))
        zero = lambda c: (c[0] == 0) & (c[1] < 0)
        return self.checked(
            ab, "number", lambda c: F.when(~root(c) & ~zero(c), F.pow(c[0], c[1])),
            lambda c: F.when(root(c), reason("domain-error", "a negative base raised to a non-integer power is not a real number")).when(
                zero(c), reason("domain-error", "zero raised to a negative power is a division by zero")
            ), {},
        )

    def complex_arithmetic(self, op, a, b, n):
        ab, ua, ub = [a, b], a.unit or {}, b.unit or {}
        if op == "modulo":
            return self.wrong(ab, "'modulo' is undefined for complex values", "complex", "domain-error")
        if op == "power":
            if b.kind != "number":
                return self.wrong(ab, "'power' with a complex operand requires a real integer exponent")
            if ua or ub:
                return self.wrong(ab, "'power' requires dimensionless operands")
            exponent = b.literal
            if exponent is None and n["right"]["kind"] == "negate" and n["right"]["operand"]["kind"] == "numberLiteral":
                exponent = -n["right"]["operand"]["value"]
            if exponent is None:
                return self.computed_power(a, b)
            if not math.isfinite(exponent) or exponent != int(exponent):
                return self.wrong(ab, "'power' with a complex operand requires a real integer exponent")
            k = abs(int(exponent))
            raised = self.chain_power(a, k)
            if exponent >= 0:
                return raised
            one = cx.make(F.lit(1.0), F.lit(0.0))
            return self.checked([raised], "complex", lambda c: F.when(~cx.is_zero(c[0]), cx.divide(one, c[0])), lambda c: F.when(cx.is_zero(c[0]), reason("domain-error", "division by zero")), {})
        up = [(lambda c, i=i: c[i]) if e.kind == "complex" else (lambda c, i=i: F.when(c[i].isNotNull(), cx.make(c[i], F.lit(0.0)))) for i, e in enumerate(ab)]
        both = lambda f: lambda c: F.when(c[0].isNotNull() & c[1].isNotNull(), f(up[0](c), up[1](c)))
        if op in ("add", "subtract"):
            if ua != ub:
                return self.wrong(ab, f"cannot {op} complex values with incompatible units")
            return self.checked(ab, "complex", both(cx.add if op == "add" else cx.subtract), unit=ua)
        if op == "multiply":
            return self.checked(ab, "complex", both(cx.multiply), unit=val.times(ua, ub))
        zero = (lambda c: cx.is_zero(c[1])) if b.kind == "complex" else (lambda c: c[1] == 0)
        return self.checked(
            ab, "complex", lambda c: F.when(~zero(c), both(cx.divide)(c)), lambda c: F.when(zero(c), reason("domain-error", "division by zero")), val.times(ua, ub, -1)
        )

    def computed_power(self, a: Ev, b: Ev) -> Ev:
        """a ** b by squaring, b being a column: one step of the aggregate for each bit of the exponent."""
        fits = lambda c: (c[1] == F.floor(c[1])) & val.finite(c[1])
        one = cx.make(F.lit(1.0), F.lit(0.0))
        zero = lambda c: (c[1] < 0) & cx.is_zero(c[0])

        def raised(c):
            bits = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.abs(c[1]), F.lit(1.0)))).cast("int"))
            start = F.struct(one.alias("out"), cx.make(c[0]["re"], c[0]["im"]).alias("square"), F.abs(c[1]).alias("left"))
            step = lambda s, _: F.struct(
                F.when(s["left"] % 2 == 1, cx.multiply(s["out"], s["square"])).otherwise(s["out"]).alias("out"),
                cx.multiply(s["square"], s["square"]).alias("square"), F.floor(s["left"] / 2).cast("double").alias("left"),
            )
            out = F.aggregate(bits, start, step, lambda s: F.when(c[1] >= 0, s["out"]).otherwise(cx.divide(one, s["out"])))
            return F.when(c[0].isNotNull() & fits(c) & ~zero(c), out)

        fraction = reason("wrong-type", "'power' with a complex operand requires a real integer exponent")
        return self.checked([a, b], "complex", raised, lambda c: F.when(~fits(c), fraction).when(zero(c), reason("domain-error", "division by zero")), {}, inline=False)

    def chain_power(self, a: Ev, k: int) -> Ev:
        """a ** k by squaring; every square is bound once."""
        square = lambda e: self.checked([e], "complex", lambda c: F.when(c[0].isNotNull(), cx.multiply(c[0], c[0])), unit={})
        product = lambda x, y: self.checked([x, y], "complex", lambda c: F.when(c[0].isNotNull() & c[1].isNotNull(), cx.multiply(c[0], c[1])), unit={})
        if k == 0:
            return self.op([a], "complex", lambda c: F.when(c[0].isNotNull(), cx.make(F.lit(1.0), F.lit(0.0))), unit={})
        out = a
        for bit in bin(k)[3:]:
            out = square(out)
            if bit == "1":
                out = product(out, a)
        return out

    def e_call(self, n):
        args = [self.expression(x) for x in n["args"]]
        name = n["fn"]
        user = self.place.scope.functions.get(name)
        if user is not None:
            if user.args is not None and tuple(e.kind for e in args) != tuple(user.args):
                return self.wrong(args, f"'{name}' takes {', '.join(user.args)}")
            return self.op(args, user.kind, lambda c: user.build(*c), lambda _: reason("domain-error", user.domain), unit={} if user.kind == "number" else None, finite=False)
        made = builtin.FUNCTIONS.get(name)
        if made is None:
            return self.wrong(args, f"no function registered under the name '{name}'")
        if any(e.kind is None for e in args):
            return self.wrong(args, "")
        return made(self, args)

    def e_lookup(self, n):
        keys = [self.expression(x) for x in n["keys"]]
        at = canonical(n["table"])
        table = self.place.scope.lookup(n["table"])
        absent = reason("not-found", f"no match found in lookup table {at}")
        if table is None:
            return self.wrong(keys, f"no match found in lookup table {at}", code="not-found")
        value = table.df.schema[table.value.column].dataType
        side = Lowering(Place(Scope({"v": table.value}), table.df.schema, F.col)).expression({"kind": "reference", "key": "v"})
        if any(e.kind is None for e in keys) or len(keys) != len(table.keys):
            return self.wrong(keys, f"no match found in lookup table {at}", side.kind, "not-found")
        dim = table.df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(table.keys)], side.s.alias("v")).dropDuplicates([f"k{i}" for i in range(len(keys))])
        if self.place.item:
            rows = dim.limit(table.most + 1).collect()
            if len(rows) > table.most:
                raise BindingError(f"lookup table {at} is too large to use inside items")
            cells = [c for r in rows for c in (F.struct(*[F.lit(r[f"k{i}"]).cast(dim.schema[f"k{i}"].dataType) for i in range(len(keys))]), F.lit(r.v).cast(dim.schema["v"].dataType))]
            held = F.create_map(*cells) if cells else F.lit(None)
            return self.op(
                keys, side.kind,
                lambda c: F.when(reduce(lambda x, y: x & y, [k.isNotNull() for k in c]), F.try_element_at(held, F.struct(*[k.cast(dim.schema[f"k{i}"].dataType) for i, k in enumerate(c)]))) if cells else null_of(side.kind),
                lambda _: absent, unit=side.unit, finite=side.finite,
            )
        names = [self.fresh() for _ in keys]
        out = self.fresh()

        def attach(df: DataFrame) -> DataFrame:
            df = df.withColumns({c: (e.s["v"] if self.explain else e.s) for c, e in zip(names, keys)})
            right = dim.select(*[F.col(f"k{i}").alias(f"{c}k") for i, c in enumerate(names)], F.col("v").alias(out))
            return df.join(right, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{c}k") for c in names]), "left").drop(*[f"{c}k" for c in names])

        self.steps.append(attach)
        found = Ev(side.kind, F.col(out), side.unit, side.finite)
        if not self.explain:
            return found
        return self.op(keys, side.kind, lambda _: F.col(out), lambda _: absent, unit=side.unit, finite=side.finite)

    def e_delegate(self, n):
        handler = self.place.scope.delegates.get(n["system"])
        if handler is None:
            return self.wrong([], f"no delegate handler registered for external system '{n['system']}'")
        v = handler.build(n["payload"])
        if not self.explain:
            return Ev(handler.kind, v, {} if handler.kind == "number" else None, False)
        why = reason("not-found", f"delegate handler for external system '{n['system']}' reported no value")
        return Ev(handler.kind, F.struct(v.alias("v"), F.when(v.isNull(), why).alias("r")), {} if handler.kind == "number" else None, False)

    def e_accumulator(self, n):
        return self.accumulator or self.wrong([], "accumulator used outside a reduce fold's combine expression")

    def same(self, evs: list[Ev], what: str) -> Ev:
        """The kind, unit and finiteness that branches share."""
        typed = [e for e in evs if e.kind is not None]
        if not typed:
            return Ev(None, F.lit(None))
        for e in typed[1:]:
            if (e.kind, e.unit or None) != (typed[0].kind, typed[0].unit or None):
                raise UnsupportedTree(f"{what} of different kinds or units: {typed[0].kind} and {e.kind}")
        return replace(typed[0], finite=all(e.finite for e in typed))

    def cast_null(self, e: Ev, kind) -> Ev:
        """A branch that is never definite, with the type of the others."""
        if e.kind is not None or kind is None:
            return e
        return replace(e, s=F.struct(null_of(kind).alias("v"), e.s["r"].alias("r")) if self.explain else null_of(kind))

    def e_conditional(self, n):
        guards = [self.predicate(c["when"]) for c in n["cases"]]
        results = [self.expression(c["then"]) for c in n["cases"]] + [self.expression(n["fallback"])]
        like = self.same(results, "a conditional with branches")
        results = [self.cast_null(e, like.kind) for e in results]
        m = len(guards)
        if n.get("hitPolicy") == "unique":
            return self.unique(guards, results, like)
        if not self.explain:
            out = results[-1].s
            for g, r in reversed(list(zip(guards, results))):
                out = F.when(g.s, r.s).when(~g.s, out)
            return Ev(like.kind, out, like.unit, like.finite, 1 + sum(2 * g.size for g in guards) + sum(r.size for r in results))

        def body(c):
            out = c[-1]
            for g, r in reversed(list(zip(c[:m], c[m:-1]))):
                out = F.when(g["v"], r).when(~g["v"], out).otherwise(F.struct(F.lit(None).cast(TYPES[like.kind]).alias("v"), g["r"].alias("r")))
            return out

        return Ev(like.kind, self.bound(guards + results, body), like.unit, like.finite, 1 + sum(e.size for e in guards + results))

    def unique(self, guards, results, like):
        m = len(guards)

        def chosen(gs, rs, wrap):
            hits = val.total([F.coalesce(g, F.lit(False)).cast("int") for g in gs]) if gs else F.lit(0)
            unknown = reduce(lambda x, y: x | y, [g.isNull() for g in gs]) if gs else F.lit(False)
            out = rs[-1]
            for g, r in reversed(list(zip(gs, rs))):
                out = F.when(F.coalesce(g, F.lit(False)), r).otherwise(out)
            return wrap(hits, unknown, out)

        if not self.explain:
            s = self.bound(guards + results, lambda c: chosen(c[:m], c[m:], lambda hits, unknown, out: F.when((hits <= 1) & ~unknown, out)))
            return Ev(like.kind, s, like.unit, like.finite, 1 + sum(e.size for e in guards + results))

        def body(c):
            gs = c[:m]
            nothing = lambda r: F.struct(F.lit(None).cast(TYPES[like.kind]).alias("v"), r.alias("r"))
            many = reason("domain-error", "more than one case matched under the 'unique' hit policy")
            return chosen(
                [g["v"] for g in gs], c[m:],
                lambda hits, unknown, out: F.when(hits > 1, nothing(many)).when(unknown, nothing(urgent_reason([g["r"] for g in gs]))).otherwise(out) if gs else out,
            )

        return Ev(like.kind, self.bound(guards + results, body), like.unit, like.finite, 1 + sum(e.size for e in guards + results))

    # -- references to trees -----------------------------------------------------------------------------------------

    def referenced(self, n, of: str):
        trees, key = self.place.scope.trees, canonical(n["key"])
        if trees is None:
            return self.wrong([], "no tree resolver registered for treeReference nodes", "boolean" if of == "predicate" else None)
        if key in self.chain:
            return self.wrong([], "circular treeReference detected", "boolean" if of == "predicate" else None, "domain-error")
        if len(self.chain) >= MAX_REFERENCES:
            raise UnsupportedTree(f"treeReference chain exceeds the maximum depth of {MAX_REFERENCES}")
        if key not in trees:
            return self.wrong([], f"no tree found for treeReference key {key}", "boolean" if of == "predicate" else None, "not-found")
        try:
            tree = (nodes.read_predicate if of == "predicate" else nodes.read_expression)(trees[key])
        except nodes.InvalidTree:
            return self.wrong([], f"the referenced tree is not a valid {'PredicateNode' if of == 'predicate' else 'ExpressionNode'}", "boolean" if of == "predicate" else None)
        inner = replace(self, chain=(*self.chain, key))
        return inner.predicate(tree) if of == "predicate" else inner.expression(tree)

    def e_treeReference(self, n):
        return self.referenced(n, "expression")

    def p_treeReference(self, n):
        return self.referenced(n, "predicate")

    # -- predicates --------------------------------------------------------------------------------------------------

    def p_not(self, n):
        inner = n["operand"]
        if inner["kind"] == "not":
            return self.predicate(inner["operand"])
        return self.op([self.predicate(inner)], "boolean", lambda c: ~c[0])

    def p_and(self, n):
        return self.junction([n["left"], n["right"]], True)

    def p_or(self, n):
        return self.junction([n["left"], n["right"]], False)

    def p_allOf(self, n):
        return self.junction(n["operands"], True)

    def p_anyOf(self, n):
        return self.junction(n["operands"], False)

    def junction(self, operands, every: bool):
        if not operands:
            return self.known("boolean", F.lit(every))
        join = (lambda a, b: a & b) if every else (lambda a, b: a | b)
        return self.op([self.predicate(x) for x in operands], "boolean", lambda c: val.balanced(join, list(c)), reasons=urgent_reason)

    def p_compare(self, n):
        op = n["op"]
        a, b = self.expression(n["left"]), self.expression(n["right"])
        ab = [a, b]
        wrong = lambda message: self.wrong(ab, message, "boolean")
        if a.kind is None or b.kind is None:
            return wrong("")
        if a.kind == "text":
            return wrong("text values are not comparable via 'compare'; use 'textCompare'")
        if a.kind == "complex" and op not in ("eq", "neq"):
            return wrong(f"ordering operator '{op}' is not defined for complex values; the complex plane has no total order")
        if a.kind != b.kind:
            return wrong(f"cannot compare {article(a.kind)} value with {article(b.kind).replace('an ', 'a ')} value")
        if a.kind in ("number", "complex") and (a.unit or {}) != (b.unit or {}):
            return wrong(f"cannot compare {'numbers' if a.kind == 'number' else 'complex values'} with incompatible units")
        if a.kind == "boolean" and op not in ("eq", "neq"):
            return wrong(f"booleans have no natural ordering; '{op}' is only defined for 'eq'/'neq'")
        test, twice = self.comparison(op, a, b)
        return self.op(ab, "boolean", test, twice=twice)

    @staticmethod
    def comparison(op, a: Ev, b: Ev):
        """(value function, whether it names operands twice) for two operands of one kind."""
        plain = {
            "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y, "eq": lambda x, y: x == y, "neq": lambda x, y: x != y,
        }[op]
        if a.kind == "complex":
            same = lambda c: F.when(c[0].isNotNull() & c[1].isNotNull(), cx.equal(c[0], c[1]))
            return (same if op == "eq" else lambda c: ~same(c)), True
        if a.kind == "duration" and a.unit != b.unit:
            return lambda c: F.when(F.isnan(c[0]) & c[1].isNotNull() | F.isnan(c[1]) & c[0].isNotNull(), F.lit(op == "neq")).otherwise(
                F.when(c[0].isNotNull() & c[1].isNotNull(), plain(val.duration_order(c[0], a.unit, c[1], b.unit), F.lit(0)))
            ), True
        loose = [i for i, e in enumerate((a, b)) if e.kind in ("number", "duration") and not e.finite]
        if not loose:
            return lambda c: plain(c[0], c[1]), False
        def nan(c):
            """Whether one operand is NaN and the other is there."""
            return reduce(lambda x, y: x | y, [F.isnan(c[i]) & c[1 - i].isNotNull() for i in loose])

        # NaN differs from everything, itself included; the plain comparison stays a conjunct of its own, for pushdown
        if op in ("gt", "gte", "lt", "lte", "eq"):
            literal = {i for i, e in enumerate((a, b)) if e.literal is not None and e.literal == e.literal}
            if op in ("lt", "lte", "eq") and 1 in literal or op in ("gt", "gte", "eq") and 0 in literal or op == "eq" and literal:
                return lambda c: plain(c[0], c[1]), False  # NaN ranks above every number, so it can't pass
            return lambda c: plain(c[0], c[1]) & ~nan(c), True
        return lambda c: plain(c[0], c[1]) | nan(c), True

    def p_textCompare(self, n):
        op = n["op"]
        a, b = self.expression(n["left"]), self.expression(n["right"])
        ab = [a, b]
        for e, side in ((a, "left"), (b, "right")):
            if e.kind != "text":
                return self.wrong(ab, f"'textCompare' requires 'text' operands; the {side} operand is '{e.kind}'" if e.kind else "", "boolean")
        if op == "equals":
            return self.op(ab, "boolean", lambda c: c[0] == c[1])
        if op == "notEquals":
            return self.op(ab, "boolean", lambda c: c[0] != c[1])
        portable = op.startswith("portable")
        negated = op in ("notMatches", "portableNotMatches")
        if b.literal is None:
            found = self.attached(_match_udf(portable, negated), ab)
            invalid = lambda c: reason("wrong-type", F.concat(F.lit("'"), c[1], F.lit("' is not a valid regular expression pattern")))
            beyond = lambda c: reason("domain-error", F.concat(F.lit("the text cannot be tested against '"), c[1], F.lit("'")))
            return self.op(ab, "boolean", lambda c: F.when(c[0].isNotNull() & c[1].isNotNull() & (found < 2), found == 1), lambda c: F.when(found == 2, beyond(c)).otherwise(invalid(c)))
        try:
            tree = rx.parse(b.literal) if portable else rx.parse_ecma(b.literal)
            machine = rx.Automaton(tree)
        except rx.PatternError as e:
            text = f"'{b.literal}' is not a valid portable pattern: {e}" if portable else f"'{b.literal}' is not a valid regular expression pattern"
            return self.wrong(ab, text, "boolean")
        most = min(rx.nfa.MAX_INPUT, rx.nfa.MAX_WORK // len(machine.code) - 1)
        return self.op([a], "boolean", self.pattern(a, tree, negated, most), lambda _: reason("domain-error", f"the text cannot be tested against '{b.literal}'"), twice=True)

    def attached(self, udf, evs: list[Ev]) -> Column:
        """A Python function's result as a column of its own: lambdas, which bind operands, can't call Python."""
        if self.place.item:
            raise BindingError("patterns from data can't be tested inside the items of a nested array")
        name, args = self.fresh(), [e.s["v"] if self.explain else e.s for e in evs]
        self.steps.append(lambda df: df.withColumn(name, udf(*args)))
        return F.col(name)

    def pattern(self, a: Ev, tree, negated: bool, most: int):
        """The test of a fixed pattern; NULL for texts beyond the matcher's limits. Java's matcher counts characters and
        backtracks; where that tells, the bounded matcher judges (but inside nested items, where Python can't run)."""
        fast, item = rx.fast_form(tree), self.place.item
        slow = not fast and not item and rx.java.may_explode(tree)
        astral = not fast and not item and not slow and rx.java.splits_astral(tree)
        beyond = "[\\x{10000}-\\x{10FFFF}]"
        exact = None
        if slow or astral:
            text = a if slow else replace(a, s=F.when(a.s["v"].rlike(beyond), a.s["v"]) if self.explain else F.when(a.s.rlike(beyond), a.s))
            exact = replace(self, explain=False).attached(_nfa_udf(tree), [replace(text, s=text.s["v"]) if slow and self.explain else text])

        def value(c):
            x = c[0]
            if fast:
                form, text = fast
                hit = x == text if form == "equals" else getattr(x, form)(F.lit(text))
            elif slow:
                hit = F.when(x.isNotNull(), exact)
            else:
                hit = x.rlike(rx.render(tree))
                if astral:  # units and characters differ only beyond the basic plane
                    hit = F.when(x.rlike(beyond), exact).otherwise(hit)
            hit = F.when(F.length(x) <= most, hit)
            return ~hit if negated else hit

        return value

    def p_memberOf(self, n):
        a = self.expression(n["operand"])
        candidates = [self.expression(x) for x in n["candidates"]]
        inside = n["op"] == "in"
        if not candidates:
            return self.op([a], "boolean", lambda c: F.when(c[0].isNotNull(), F.lit(not inside)))
        if a.kind is None:
            return self.wrong([a], "", "boolean")
        votes = []
        simple = [e.literal for e in candidates if e.literal is not None and e.kind == a.kind and (e.unit or None) == (a.unit or None) and a.kind != "duration"]
        if len(simple) == len(candidates) and not any(x != x for x in simple) and not self.explain:
            # NaN is in no list of numbers, as it should be
            out = self.op([a], "boolean", lambda c: c[0].isin(*simple))
            return out if inside else self.op([out], "boolean", lambda c: ~c[0])
        for e in candidates:
            if e.kind is None:
                votes.append(self.wrong([e], "", "boolean"))
            elif e.kind != a.kind:
                votes.append(self.wrong([e], f"cannot compare {article(a.kind)} value with {article(e.kind).replace('an ', 'a ')} value for membership", "boolean"))
            elif a.kind in ("number", "complex") and (a.unit or {}) != (e.unit or {}):
                votes.append(self.wrong([e], f"cannot compare {'numbers' if a.kind == 'number' else 'complex values'} with incompatible units for membership", "boolean"))
            else:
                test, _ = self.comparison("eq", a, e)
                if a.kind == "text":
                    test = lambda c: c[0] == c[1]
                votes.append(self.op([a, e], "boolean", test, twice=True))
        any_ = self.op(votes, "boolean", lambda c: val.balanced(lambda x, y: x | y, list(c)), reasons=urgent_reason)
        out = self.op([a, any_], "boolean", lambda c: F.when(c[0].isNotNull(), c[1]))
        return out if inside else self.op([out], "boolean", lambda c: ~c[0])

    def p_exists(self, n):
        if not self.explain:
            plain = self.expression(n["operand"]) if n["operand"]["kind"] == "reference" else None
            if plain is not None and plain.bare is not None:
                v, pending = plain.bare
                return Ev("boolean", v.isNotNull() if pending is None else F.when(v.isNotNull(), F.lit(True)).when(~F.coalesce(pending, F.lit(False)), F.lit(False)))
        a = self.with_explain().expression(n["operand"])

        def body(c):
            code = c[0]["r"]["code"]
            v = F.when(code.isNull(), F.lit(True)).when(code == "not-found", F.lit(False)).when(code == "not-yet-known", F.lit(None)).otherwise(F.lit(True))
            return F.struct(v.alias("v"), F.when(v.isNull(), c[0]["r"]).alias("r")) if self.explain else v

        return Ev("boolean", self.bound([a], body), size=a.size + 1)

    # -- collections -------------------------------------------------------------------------------------------------

    def p_some(self, n):
        return self.quantifier(n, False)

    def p_every(self, n):
        return self.quantifier(n, True)

    def items(self, key):
        """(array column, item schema, item scope, columns used) of a nested collection, gathering a child table into one.

        The columns that items use are noted in a set, as only these are gathered; a nested array notes none."""
        binding = self.place.scope.collection(key)
        schema = self.place.schema
        if binding is None and isinstance(key, str) and key in schema.names and isinstance(schema[key].dataType, T.ArrayType):
            binding = ArrayBinding(key)
        if binding is None:
            raise BindingError(f"no collection found for key {canonical(key)}")
        if isinstance(binding, ArrayBinding):
            t = schema[binding.column].dataType.elementType
            return self.place.get(binding.column), t, Scope(binding.fields, functions=self.place.scope.functions, trees=self.place.scope.trees, lookups={}, delegates=self.place.scope.delegates), set()
        if self.place.item:
            raise BindingError(f"collection {canonical(key)} in another table can't be reached from a nested array")
        name, used = self.gathered(key, binding)
        scope = binding.scope or Scope()
        return F.col(name), binding.df.schema, replace(scope, functions=scope.functions or self.place.scope.functions, trees=scope.trees or self.place.scope.trees), used

    def gathered(self, key, binding: ChildTable) -> tuple[str, set]:
        """The child rows of a parent as an ordered array of the columns that are used; one grouped pass for all uses of the
        collection."""
        held = self.tables.setdefault(canonical(key), {})
        if "array" not in held:
            name = self.fresh()
            used: set = set()
            held["array"] = name, used

            def attach(df: DataFrame) -> DataFrame:
                fields = [*binding.order, *(c for c in binding.df.columns if c in used and c not in binding.order)]
                rows = F.struct(*[F.col(c) for c in fields or binding.df.columns[:1]])
                ordered = F.sort_array(F.collect_list(rows)) if binding.order else F.collect_list(rows)
                grouped = binding.df.groupBy(*[F.col(c).alias(f"{name}_{i}") for i, c in enumerate(binding.child_key)]).agg(ordered.alias(name))
                empty = F.array().cast(T.ArrayType(grouped.schema[name].dataType.elementType))
                return _joiner(grouped, binding.parent_key, name, {name: None})(df).withColumn(name, F.coalesce(F.col(name), empty))

            self.steps.append(attach)
        return held["array"]

    def item_lowering(self, schema, scope, x, used: set, accumulator=None) -> Lowering:
        def get(column):
            used.add(column)
            return x[column]

        return replace(self, place=Place(scope, schema, get, item=True), accumulator=accumulator, tables={})

    def item_struct(self, low: Lowering, tree, filter_, of: str):
        """struct<f, x>: the filter's and the item's verdicts or values."""
        f = low.predicate(filter_).s if filter_ else low.known("boolean", F.lit(True)).s
        e = low.predicate(tree) if of == "predicate" else low.expression(tree)
        return e, F.struct(f.alias("f"), e.s.alias("x"))

    def aggregates(self, key):
        """The child table of a collection, if its values can come from hash aggregates."""
        binding = self.place.scope.collection(key)
        return binding if isinstance(binding, ChildTable) and not self.explain and not self.place.item else None

    def child(self, key, binding: ChildTable) -> Lowering:
        """What lowers trees over the child rows; one for all uses of a collection, so that they share its passes."""
        held = self.tables.setdefault(canonical(key), {})
        if "child" not in held:
            scope = binding.scope or Scope()
            scope = replace(scope, functions=scope.functions or self.place.scope.functions, trees=scope.trees or self.place.scope.trees)
            held["child"] = Lowering(Place(scope, binding.df.schema, F.col), limits=self.limits, names=self.names, visits=self.visits)
        return replace(held["child"], chain=self.chain)

    def aggregated(self, key, binding: ChildTable, low: Lowering, aggregate: Column, empty: Column | None) -> Column:
        """A column with an aggregate over the child rows of each parent; `empty` stands where there are none."""
        held = self.tables.setdefault(canonical(key), {})
        if "pass" not in held:
            held["pass"] = {"aggregates": []}

            def attach(df: DataFrame, held=held["pass"], steps=low.steps) -> DataFrame:
                rows = binding.df
                for step in steps:
                    rows = step(rows)
                name = held["aggregates"][0][0]
                grouped = rows.groupBy(*[F.col(c).alias(f"{name}_{i}") for i, c in enumerate(binding.child_key)]).agg(*[a.alias(c) for c, a, _ in held["aggregates"]])
                return _joiner(grouped, binding.parent_key, name, {c: e for c, _, e in held["aggregates"]})(df)

            self.steps.append(attach)
        name = self.fresh()
        held["pass"]["aggregates"].append((name, aggregate, empty))
        return F.col(name)

    def quantifier(self, n, every: bool):
        binding = self.aggregates(n["collection"])
        if binding is not None:
            low = self.child(n["collection"], binding)
            p = low.predicate(n["item"]).s
            f = low.predicate(n["filter"]).s if n.get("filter") else None
            vote = p if f is None else F.when(f, p).when(~f, F.lit(every))
            settled = (vote == F.lit(not every))
            out = F.when(F.max(F.coalesce(settled, F.lit(False))), F.lit(not every)).when(F.max(vote.isNull()), F.lit(None)).otherwise(F.lit(every))
            return Ev("boolean", self.aggregated(n["collection"], binding, low, out, F.lit(every)))
        binding = self.place.scope.collection(n["collection"])
        if self.explain and not self.place.item and isinstance(binding, ChildTable) and binding.order:
            return self.explained_quantifier(n, every, binding)
        array, schema, scope, used = self.items(n["collection"])
        if not self.explain:
            def vote(x):
                low = self.item_lowering(schema, scope, x, used)
                p = low.predicate(n["item"]).s
                f = low.predicate(n["filter"]).s if n.get("filter") else None
                return p if f is None else F.when(f, p).when(~f, F.lit(every))

            return Ev("boolean", F.forall(array, vote) if every else F.exists(array, vote), size=BIND_FROM)
        low = lambda x: self.item_struct(self.item_lowering(schema, scope, x, used), n["item"], n.get("filter"), "predicate")[1]
        votes = F.transform(array, lambda x: F.element_at(F.transform(F.array(low(x)), lambda s: F.when(s["f"]["v"].isNull(), s["f"]).when(s["f"]["v"], s["x"]).otherwise(
            F.struct(F.lit(every).alias("v"), no_reason().alias("r")))), 1))

        def body(c):
            v = F.when(F.exists(c[0], lambda x: F.coalesce(x["v"] == F.lit(not every), F.lit(False))), F.lit(not every)).when(F.exists(c[0], lambda x: x["v"].isNull()), F.lit(None)).otherwise(F.lit(every))
            unknown = F.filter(c[0], lambda x: x["v"].isNull())
            urgent = F.filter(unknown, lambda x: x["r"]["code"] == "not-yet-known")
            r = F.when(F.size(urgent) > 0, F.get(urgent, F.lit(0))["r"]).otherwise(F.get(unknown, F.lit(0))["r"])
            return F.struct(v.alias("v"), F.when(v.isNull(), r).alias("r"))

        return Ev("boolean", self.bound([Ev("boolean", votes)], body), size=BIND_FROM)

    def explained_quantifier(self, n, every: bool, binding: ChildTable) -> Ev:
        """A quantifier's verdict over a child table by hash aggregates: whether a vote settles it, whether one is unknown, and
        of the unknown ones the reason that comes first in the order, those of values not yet known before the others."""
        low = self.child(n["collection"], binding)
        judge = low.with_explain()
        p = judge.predicate(n["item"]).s
        f = judge.predicate(n["filter"]).s if n.get("filter") else None
        vote = p["v"] if f is None else F.when(f["v"], p["v"]).when(~f["v"], F.lit(every))
        why = p["r"] if f is None else F.when(f["v"].isNull(), f["r"]).when(f["v"], p["r"])
        held = self.fresh()
        low.steps.append(lambda df: df.withColumn(held, F.struct(vote.alias("v"), why.alias("r"))))
        v, r = F.col(held)["v"], F.col(held)["r"]
        order = F.struct(*binding.order)
        urgent = v.isNull() & (r["code"] == "not-yet-known")
        first = lambda which: F.min_by(F.when(which, r), F.when(which, order))
        truth = F.when(F.max(F.coalesce(v == F.lit(not every), F.lit(False))), F.lit(not every)).when(F.max(v.isNull()), F.lit(None)).otherwise(F.lit(every))
        found = self.aggregated(n["collection"], binding, low, truth, F.lit(every))
        cause = self.aggregated(n["collection"], binding, low, F.coalesce(first(urgent), first(v.isNull())), None)
        return Ev("boolean", F.struct(found.alias("v"), F.when(found.isNull(), cause).alias("r")))

    def e_fold(self, n):
        c = n["combiner"]
        if c["mode"] == "reduce":
            return self.summed(n) or self.reduced(n)
        return self.extreme(n)

    def extreme(self, n):
        mode, item = n["combiner"]["mode"], n["combiner"]["item"]
        op = "gt" if mode == "max" else "lt"
        empty = f"'{mode}' has no participating items to seed a running result from"
        binding = self.aggregates(n["collection"])
        if binding is not None:
            low = self.child(n["collection"], binding)
            e = low.expression(item)
            if e.kind in ("number", "instant") or e.kind == "duration":
                f = low.predicate(n["filter"]).s if n.get("filter") else F.lit(True)
                bad = F.max(F.when(f, e.s.isNull()).otherwise(f.isNull()))
                pick = F.max if mode == "max" else F.min
                if e.finite:
                    best = pick(F.when(f, e.s))
                else:  # NaN never replaces another value, and stays if it comes first; without an order it comes last
                    best = F.coalesce(pick(F.when(f & ~F.isnan(e.s), e.s)), pick(F.when(f, e.s)))
                    if binding.order:
                        first = F.min_by(F.when(f, e.s), F.when(f, F.struct(*binding.order)))
                        best = F.when(F.isnan(first), first).otherwise(best)
                return Ev(e.kind, self.aggregated(n["collection"], binding, low, F.when(~F.coalesce(bad, F.lit(False)), best), None), e.unit, e.finite)
        array, schema, scope, used = self.items(n["collection"])
        kind: dict = {}

        def each(x):
            low = self.item_lowering(schema, scope, x, used).with_explain()
            e, s = self.item_struct(low, item, n.get("filter"), "expression")
            kind.update(kind=e.kind, unit=e.unit, finite=e.finite)
            return s

        taken = F.transform(array, each)
        k = kind["kind"]

        def body(cols):
            members = F.filter(cols[0], lambda s: F.coalesce(s["f"]["v"], F.lit(True)))
            verdicts = F.transform(members, lambda s: F.when(s["f"]["v"].isNull(), F.struct(null_of(k).alias("v"), s["f"]["r"].alias("r"))).otherwise(s["x"]))
            like = Ev(k, F.lit(None), kind["unit"], kind["finite"])

            def merge(acc, x):
                if k in ("number", "instant", "duration"):
                    test, _ = self.comparison(op, like, like)
                    return F.when(acc["s"] & acc["e"]["v"].isNull(), acc).otherwise(
                        F.struct(F.lit(True).alias("s"), F.when(~acc["s"] | x["v"].isNull() | test([x["v"], acc["e"]["v"]]), x).otherwise(acc["e"]).alias("e"))
                    )
                refuse = {
                    "text": "text values are not comparable via 'compare'; use 'textCompare'",
                    "boolean": f"booleans have no natural ordering; '{op}' is only defined for 'eq'/'neq'",
                    "complex": f"ordering operator '{op}' is not defined for complex values; the complex plane has no total order",
                }.get(k, "")
                clash = F.when(x["v"].isNull(), x).otherwise(F.struct(null_of(k).alias("v"), reason("wrong-type", refuse).alias("r")))
                return F.when(acc["s"] & acc["e"]["v"].isNull(), acc).otherwise(F.struct(F.lit(True).alias("s"), F.when(~acc["s"], x).otherwise(clash).alias("e")))

            start = F.struct(F.lit(False).alias("s"), F.struct(null_of(k).alias("v"), reason("domain-error", empty).alias("r")).alias("e"))
            # an indeterminate filter anywhere counts before the items' values
            filters = F.filter(cols[0], lambda s: s["f"]["v"].isNull())
            found = F.aggregate(verdicts, start, merge)["e"]
            return F.when(F.size(filters) > 0, F.struct(null_of(k).alias("v"), F.get(filters, F.lit(0))["f"]["r"].alias("r"))).otherwise(found)

        s = self.bound([Ev(k, taken)], body)
        return Ev(k, s if self.explain else s["v"], kind["unit"], kind["finite"], BIND_FROM)

    def summed(self, n) -> Ev | None:
        """Sum and count over a child table as hash aggregates."""
        c = n["combiner"]
        binding = self.aggregates(n["collection"])
        shape = c["combine"]
        if binding is None or c["initial"] != {"kind": "numberLiteral", "value": c["initial"].get("value")} or shape["kind"] != "arithmetic" or shape["op"] != "add" or shape["left"] != {"kind": "accumulator"}:
            return None
        if _mentions(shape["right"], "accumulator"):
            return None
        low = self.child(n["collection"], binding)
        e = low.expression(shape["right"])
        if e.kind != "number" or e.unit:
            return None
        f = low.predicate(n["filter"]).s if n.get("filter") else F.lit(True)
        start = float(c["initial"]["value"])
        bad = F.max(F.when(f, e.s.isNull()).otherwise(f.isNull()))
        total = F.coalesce(F.sum(F.when(f, e.s)), F.lit(0.0)) + F.lit(start)
        out = F.when(~F.coalesce(bad, F.lit(False)) & val.finite(total), total)
        return Ev("number", self.aggregated(n["collection"], binding, low, out, F.lit(start)), {}, True)

    def reduced(self, n):
        c = n["combiner"]
        binding = self.place.scope.collection(n["collection"])
        if isinstance(binding, ChildTable) and not binding.order:
            raise BindingError("a reduce over a child table needs an order")
        array, schema, scope, used = self.items(n["collection"])
        start = self.with_explain().expression(c["initial"])
        k = start.kind
        if k is None:
            return start if self.explain else Ev(None, null_of(None))
        filter_ = n.get("filter")
        members = array

        def verdict_of(x):
            low = self.item_lowering(schema, scope, x, used).with_explain()
            return low.predicate(filter_).s

        result: dict = {}

        def merge(acc, x):
            low = self.item_lowering(schema, scope, x, used, Ev(k, acc, start.unit, start.finite, BIND_FROM)).with_explain()
            e = low.expression(c["combine"])
            result.update(kind=e.kind, unit=e.unit, finite=e.finite)
            if e.kind is None:
                e = low.cast_null(e, k)
            elif (e.kind, e.unit or None) != (k, start.unit or None):
                raise UnsupportedTree(f"a reduce that changes its kind or unit: {k} and {e.kind}")
            return F.when(acc["v"].isNull(), acc).otherwise(e.s)

        if filter_:
            members = F.filter(array, lambda x: F.coalesce(verdict_of(x)["v"], F.lit(True)))
            unknown = F.get(F.filter(F.transform(array, verdict_of), lambda s: s["v"].isNull()), F.lit(0))
        # the running verdict has the type of the first one, whose value may be a literal: say that it can become NULL
        first = F.struct(F.when(F.lit(False), null_of(k)).otherwise(start.s["v"]).alias("v"), start.s["r"].alias("r"))
        s = F.aggregate(members, first, merge)
        if filter_:
            s = F.when(unknown.isNotNull(), F.struct(null_of(k).alias("v"), unknown["r"].alias("r"))).otherwise(s)
        return Ev(k, s if self.explain else s["v"], start.unit, start.finite, BIND_FROM)


def _mentions(node: dict, kind: str) -> bool:
    return node["kind"] == kind or any(_mentions(c, kind) for c in nodes.children(node))


def _joiner(grouped: DataFrame, parent_key: list[str], name: str, columns: dict):
    """Join grouped child rows (key columns name_0, ...) back to their parents; parents without any get the given values."""

    def attach(df: DataFrame) -> DataFrame:
        on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{name}_{i}") for i, c in enumerate(parent_key)])
        df = df.join(grouped, on, "left")
        here = F.col(f"{name}_0").isNotNull()
        return df.withColumns({c: F.when(here, F.col(c)).otherwise(e) for c, e in columns.items() if e is not None}).drop(*[f"{name}_{i}" for i in range(len(parent_key))])

    return attach


def _nfa_udf(tree):
    @F.pandas_udf("boolean")
    def test(texts):
        import pandas as pd

        machine = rx.Automaton(tree)

        def one(t):
            try:
                return None if t is None else machine.test(t)
            except rx.InputTooLarge:
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return test


def _match_udf(portable: bool, negated: bool):
    """Patterns that come from data: 1 or 0, 2 for a text beyond the matcher's limits, NULL for no pattern."""

    @F.pandas_udf("int")
    def test(texts, patterns):
        import pandas as pd

        @functools.lru_cache(1000)
        def machine(p):
            try:
                return rx.Automaton(rx.parse(p) if portable else rx.parse_ecma(p))
            except rx.PatternError:
                return None

        def one(t, p):
            if t is None or p is None or machine(p) is None:
                return None
            try:
                return int(machine(p).test(t) != negated)
            except rx.InputTooLarge:
                return 2

        return pd.Series([one(t, p) for t, p in zip(texts, patterns)], dtype="Int32")

    return test
