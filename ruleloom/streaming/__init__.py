"""Rules on streams. A lowered tree is a stateless Column, so it runs on a streaming DataFrame as on a static one; child
tables and lookup tables must be static there, and their joins are stream-static."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ruleloom.plans.rules import filter_rows, with_truth
from ruleloom.sources.bindings import Scope


def filter_stream(stream: DataFrame, predicate: dict, scope: Scope | None = None) -> DataFrame:
    """The rows of a stream for which the predicate is definitely true."""
    return filter_rows(stream, predicate, scope)


def judged_stream(stream: DataFrame, name: str, predicate: dict, scope: Scope | None = None) -> DataFrame:
    return with_truth(stream, name, predicate, scope)
