"""Applying trees to DataFrames: the public entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.plans import nodes
from ruleloom.plans.lower import TYPES, Ev, Lowering, Place
from ruleloom.plans.schemas import CODES
from ruleloom.sources.bindings import Scope


def _start(df: DataFrame, scope: Scope | None, explain: bool) -> Lowering:
    return Lowering(Place(scope or Scope(), df.schema, F.col), explain)


def _apply(df: DataFrame, low: Lowering, names: list[str], columns: list[Column]) -> DataFrame:
    keep = [c for c in df.columns if c not in names]
    for step in low.steps:
        df = step(df)
    return df.select(*[F.col(c) for c in keep], *[c.alias(n) for n, c in zip(names, columns)])


def lower(df: DataFrame, tree: dict, of: str, scope: Scope | None = None, explain: bool = False) -> tuple[Lowering, Ev]:
    low = _start(df, scope, explain)
    if of == "predicate":
        tree = nodes.read_predicate(tree)
        _check_size(low, tree)
        return low, low.predicate(tree)
    tree = nodes.read_expression(tree)
    _check_size(low, tree)
    return low, low.expression(tree)


def _check_size(low: Lowering, tree: dict):
    if nodes.size(tree) > low.limits["nodes"]:
        raise nodes.InvalidTree([("", f"the tree has more than {low.limits['nodes']} nodes")])


def filter_rows(df: DataFrame, predicate: dict, scope: Scope | None = None) -> DataFrame:
    """The rows for which the predicate is definitely true."""
    low, e = lower(df, predicate, "predicate", scope)
    if not low.steps:
        return df.where(e.s)
    out = df
    for step in low.steps:
        out = step(out)
    return out.where(e.s).select(*df.columns)


def with_truth(df: DataFrame, name: str, predicate: dict, scope: Scope | None = None) -> DataFrame:
    """Append a boolean column, NULL where the predicate is indeterminate."""
    return with_values(df, {name: predicate}, scope, "predicate")


def with_value(df: DataFrame, name: str, expression: dict, scope: Scope | None = None) -> DataFrame:
    """Append the expression's value, NULL where it is indeterminate."""
    return with_values(df, {name: expression}, scope, "expression")


def with_values(df: DataFrame, trees: dict[str, dict], scope: Scope | None = None, of: str | dict[str, str] = "predicate") -> DataFrame:
    """Append several trees; they share the passes over child tables. of: predicate or expression, for all or by name."""
    low = _start(df, scope, False)
    columns = []
    for name, tree in trees.items():
        predicate = (of if isinstance(of, str) else of[name]) == "predicate"
        tree = (nodes.read_predicate if predicate else nodes.read_expression)(tree)
        _check_size(low, tree)
        low.visits[0] = 0  # each tree has the whole limit
        columns.append((low.predicate if predicate else low.expression)(tree).s)
    return _apply(df, low, list(trees), columns)


def with_verdict(df: DataFrame, name: str, tree: dict, of: str = "predicate", scope: Scope | None = None) -> DataFrame:
    """Append struct<value, code, message>; code and message are NULL for a definite value."""
    low, e = lower(df, tree, of, scope, explain=True)
    held = f"__{name}"
    out = _apply(df, low, [held], [e.s])
    x = F.col(held)
    return out.withColumn(name, F.struct(x["v"].alias("value"), x["r"]["code"].alias("code"), x["r"]["message"].alias("message"))).drop(held)


def definite(value: Column) -> Column:
    """The verdict of a known value, as with_verdict writes it."""
    nothing = F.lit(None).cast("string")
    return F.struct(value.alias("value"), nothing.alias("code"), nothing.alias("message"))


def indeterminate(code: str, message: str, kind: str = "boolean") -> Column:
    """The verdict of an unknown value of a kind, with its reason."""
    if code not in CODES:
        raise ValueError(f"'{code}' is none of the codes {', '.join(CODES)}")
    return F.struct(F.lit(None).cast(TYPES[kind]).alias("value"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def first_indeterminate(*verdicts: Column) -> Column:
    """The reason (struct<code, message>) of the first verdict that has one; NULL if all are definite."""
    return F.coalesce(*[F.when(v["code"].isNotNull(), F.struct(v["code"].alias("code"), v["message"].alias("message"))) for v in verdicts])


def rules_batch(df: DataFrame, key: list[str], rules: dict[str, dict], scope: Scope | None = None) -> DataFrame:
    """Long form: key columns, rule, verdict (NULL: indeterminate); all rules in one pass over the rows."""
    wide = with_values(df, {f"__{r}": t for r, t in rules.items()}, scope)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"__{r}").alias("verdict")) for r in rules])
    return wide.select(*key, F.explode(cells).alias("x")).select(*key, "x.rule", "x.verdict")


def instant_text(ms: Column) -> Column:
    """ISO text of epoch milliseconds between the years 0 and 9999, whatever the session's zone."""
    days, rest = F.floor(ms / 86_400_000).cast("int"), F.pmod(ms, F.lit(86_400_000))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(
        date, F.lit("T"), two(rest / 3_600_000), F.lit(":"), two(rest / 60_000 % 60), F.lit(":"), two(rest / 1000 % 60), F.lit("."),
        F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"),
    )


__all__ = ["definite", "filter_rows", "first_indeterminate", "indeterminate", "instant_text", "lower", "rules_batch", "with_truth", "with_value", "with_values", "with_verdict"]
