"""Reports of other tools: line coverage and timings, both JSON."""

from __future__ import annotations

import json
import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

COVERAGE_JSON = "files map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>"
COVERAGE = "rel string, executed array<int>, missing array<int>"
TIMINGS = "key string, calls long, total double, least double, most double, ord long"


def parse_coverage(reports: DataFrame, json_column: str = "json", root: str | None = None) -> DataFrame:
    """(rel, executed, missing) of coverage reports. Absent files or lines are empty; paths under root become relative
    to it, and others are kept, to match nothing. Of paths that become the same the last one counts."""
    listed = F.map_entries(F.from_json(F.col(json_column), COVERAGE_JSON)["files"])
    rows = reports.select(F.posexplode(listed).alias("ord", "file"))
    key: Column = F.col("file.key")
    none = F.expr("cast(array() as array<int>)")
    rows = rows.select((P.relative_to(key, root) if root else key).alias("rel"), "ord", F.coalesce("file.value.executed_lines", none).alias("executed"), F.coalesce("file.value.missing_lines", none).alias("missing"))
    last = rows.groupBy("rel").agg(F.max_by(F.struct("executed", "missing"), "ord").alias("lines"))
    return last.select("rel", "lines.executed", "lines.missing")


def load_coverage(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """parse_coverage of one file; an empty table, with a warning, where there is none."""
    if not os.path.exists(path):
        warnings.warn(f"no coverage at {path}: coverage is unknown. Run the tests under coverage and write its JSON report first.", stacklevel=2)
        return spark.createDataFrame([], COVERAGE)
    return parse_coverage(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"), root=os.path.realpath(root) if root else None)


def coverage_lines(coverage: DataFrame) -> DataFrame:
    """(rel, line, executed, missing): one row for each recorded line."""
    both = F.array_union("executed", "missing")
    rows = coverage.select("rel", "executed", "missing", F.explode(both).alias("line"))
    return rows.select("rel", "line", F.array_contains("executed", F.col("line")).alias("executed"), F.array_contains("missing", F.col("line")).alias("missing"))


def load_timings(spark: SparkSession, path: str) -> DataFrame:
    """Aggregated timings of one file, in its order; empty, with a warning, where it can't be read or is no object."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        warnings.warn("no profiling data was produced", stacklevel=2)
        data = {}
    number = lambda v: None if v is None else float(v)
    rows = [
        (k, int(v.get("calls") or 0), float(v.get("totalMicros") or 0.0), number(v.get("minMicros")), float(v.get("maxMicros") or 0.0), i)
        for i, (k, v) in enumerate(data.items() if isinstance(data, dict) else ())
    ]
    return spark.createDataFrame(rows, TIMINGS)
