"""Where the keys of a tree find their values.

A Scope maps keys to columns, collections, lookup tables, delegates, trees and functions. Keys are any JSON; they are
compared by canonical text. Columns of a DataFrame bind by name with kinds from its schema; explicit bindings override.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ruleloom.plans.nodes import canonical


class BindingError(ValueError):
    pass


def kind_of(t: T.DataType) -> str | None:
    """The kind of a Spark type; None if it has none."""
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "instant"
    if isinstance(t, T.DayTimeIntervalType):
        return "duration"
    if isinstance(t, T.StructType) and set(t.names) == {"re", "im"}:
        return "complex"
    return None


@dataclass
class ColumnBinding:
    """A column. kind overrides the schema's (a string column may hold instants); unit is a unit of a number or complex,
    or ms, s, min, h or d for a duration; pending names a boolean column: where it is true a NULL is not yet known."""

    column: str | Column
    kind: str | None = None
    unit: Any = None
    pending: str | Column | None = None


@dataclass
class ArrayBinding:
    """A nested collection: an array of structs. fields overrides the bindings of the items' fields."""

    column: str
    fields: dict = field(default_factory=dict)


@dataclass
class ChildTable:
    """A collection in another table: the child rows whose key columns equal the parent's. order fixes the items' order
    (needed by reduce and for reasons); scope binds the child's columns and its own collections."""

    df: DataFrame
    parent_key: list[str]
    child_key: list[str]
    order: list[str] = field(default_factory=list)
    scope: Scope | None = None


@dataclass
class LookupTable:
    """A table of unique keys; value is the column that a lookup gives."""

    df: DataFrame
    keys: list[str]
    value: ColumnBinding
    #: Inside items a lookup becomes a literal map, for tables of at most so many rows.
    most: int = 1000


@dataclass
class Function:
    """A scalar function over Columns. build(*columns) gives a Column, NULL outside the function's domain."""

    build: Any
    kind: str = "number"
    args: tuple[str, ...] | None = None
    domain: str = "the function is not defined for its arguments"


@dataclass
class Delegate:
    """An external system: build(payload) gives a Column, NULL for no value."""

    build: Any
    kind: str = "number"


def _key(k) -> str:
    """A plain name stands for itself as a JSON string; text that starts like a string, object or list is canonical JSON already."""
    return k if k[:1] in ("{", "[", '"') else canonical(k)


@dataclass
class Scope:
    columns: dict = field(default_factory=dict)
    collections: dict = field(default_factory=dict)
    lookups: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)
    delegates: dict = field(default_factory=dict)
    trees: dict | None = None

    def __post_init__(self):
        for name in ("columns", "collections", "lookups", "trees"):
            own = getattr(self, name)
            if own is not None:
                setattr(self, name, {_key(k): v for k, v in own.items()})

    def column(self, key):
        return self.columns.get(canonical(key))

    def collection(self, key):
        return self.collections.get(canonical(key))

    def lookup(self, key):
        return self.lookups.get(canonical(key))
