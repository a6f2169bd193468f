"""Change-risk scores: complexity of functions joined with coverage of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S

THRESHOLD = 8.0
#: Coverage tables up to this many rows are small enough to send to every task.
SMALL = 20_000


def methods(facts: DataFrame) -> DataFrame:
    """(file, ord, method_name, start_line, end_line, complexity) of every function of a fact table."""
    rows = facts.where("parse_error is null").select(F.col("rel").alias("file"), F.explode("functions").alias("f"))
    return rows.select("file", "f.ord", F.col("f.name").alias("method_name"), "f.start_line", "f.end_line", S.complexity(F.col("f.points")).alias("complexity"))


def score(found: DataFrame, coverage: DataFrame) -> DataFrame:
    """(method_name, file, complexity, coverage, score) from methods() and coverage by file (rel, executed, missing).

    A file without coverage and a function without recorded lines have null coverage and null score. Line sets stay
    arrays, so a function's share is counted within its row, and files without functions are never exploded."""
    joined = found.join(coverage, found["file"] == coverage["rel"], "left")
    covered = S.span_coverage(F.col("executed"), F.col("missing"), F.col("start_line"), F.col("end_line"))
    return _scored(joined.withColumn("coverage", covered))


def score_by_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """score() from coverage by line (rel, line, executed, missing), any number of rows a line.

    Lines are made one row each before they meet functions. The join is by file, with the span as its condition, and
    counting needs no second shuffle but by function."""
    one = lines.groupBy("rel", "line").agg(F.bool_or("executed").alias("executed"))
    inside = (found["file"] == one["rel"]) & one["line"].between(found["start_line"], found["end_line"])
    counted = found.join(one, inside, "left").groupBy("file", "ord", "method_name", "complexity")
    counted = counted.agg(F.count("line").alias("recorded"), F.count_if("executed").alias("hit"))
    return _scored(counted.withColumn("coverage", S.coverage_of(F.col("hit"), F.col("recorded"))))


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("method_name", "file", "complexity", "coverage", S.risk_score(F.col("complexity"), F.col("coverage")).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """Highest score first, unknown ones last, then by file and name."""
    return scores.orderBy(F.desc_nulls_last("score"), "file", "method_name")


def verdict(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: max_score (0 if none is known), failed, status (2 if failed)."""
    top = scores.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))
    return top.withColumn("failed", F.col("max_score") > threshold).withColumn("status", F.when(F.col("failed"), 2).otherwise(0))
