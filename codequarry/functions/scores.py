"""Scalar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_score(complexity: Column, coverage: Column) -> Column:
    """complexity squared times the uncovered share cubed, plus complexity; null where coverage is unknown."""
    c, bare = complexity.cast("double"), 1.0 - coverage
    return c * c * (bare * bare * bare) + c


def coverage_of(executed: Column, recorded: Column) -> Column:
    """The executed share of recorded lines; null where none is recorded."""
    return F.try_divide(executed.cast("double"), recorded.cast("double"))


def span_coverage(executed: Column, missing: Column, start: Column, end: Column) -> Column:
    """coverage_of the lines from start to end, from arrays of executed and missing lines; null arrays: unknown."""
    inside = lambda lines: F.filter(F.array_distinct(lines), lambda x: (x >= start) & (x <= end))
    return coverage_of(F.size(inside(executed)), F.size(inside(F.array_union(executed, missing))))


def point_weight(point: Column) -> Column:
    """What a decision point adds to a function's complexity."""
    return F.when(point["kind"] == "bool", point["arity"] - 1).when(point["kind"] == "comprehension", point["arity"]).otherwise(F.lit(1))


def complexity(points: Column) -> Column:
    return F.aggregate(points, F.lit(1), lambda n, p: n + point_weight(p))


def data_weight(fields: Column, methods: Column) -> Column:
    """Public fields' share of public members; 0 where there are none."""
    return F.coalesce(F.try_divide(fields.cast("double"), (fields + methods).cast("double")), F.lit(0.0))


def mean_micros(total: Column, calls: Column) -> Column:
    return F.coalesce(F.try_divide(total, calls.cast("double")), F.lit(0.0))


def frame_millis(mean: Column) -> Column:
    """Milliseconds a second at sixty calls a second."""
    return mean * 60.0 / 1000.0


def is_private(name: Column) -> Column:
    return name.startswith("_") & ~(name.startswith("__") & name.endswith("__"))


def is_assertion(signal: Column) -> Column:
    """Assert statements, and calls of self.assert*, self.fail, x.raises, raises or fail."""
    attr = signal["attr"]
    of_self = (signal["kind"] == "attribute") & (signal["root"] == "self")
    of_other = (signal["kind"] == "attribute") & (signal["root"] != "self")
    bare = (signal["kind"] == "name") & attr.isin("raises", "fail")
    return (signal["kind"] == "assert") | (of_self & (attr.startswith("assert") | (attr == "fail"))) | (of_other & (attr == "raises")) | bare
