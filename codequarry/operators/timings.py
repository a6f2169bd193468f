"""Timings of functions: aggregation, merging, attribution, shares, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S

OVERHEAD_MICROS, TOP = 30.0, 20


def measures() -> list:
    """Aggregates of single timings (micros)."""
    return [F.count("micros").alias("calls"), F.sum("micros").alias("total"), F.min("micros").alias("least"), F.max("micros").alias("most")]


def aggregate(events: DataFrame) -> DataFrame:
    """(key, calls, total, least, most) from (key, micros). Hash aggregation does its first part before the shuffle."""
    return events.groupBy("key").agg(*measures())


def merge(partials: DataFrame) -> DataFrame:
    """aggregate() from partial aggregates of the same columns; a null least counts for nothing."""
    return partials.groupBy("key").agg(F.sum("calls").alias("calls"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def inventory(methods: DataFrame, prefix: str = "") -> DataFrame:
    """(key, file, line) of methods (file, ord, method_name, start_line): module-qualified names, the first of equal ones."""
    key = F.concat(P.module_prefix(F.col("file")), F.lit("."), "method_name")
    first = methods.groupBy(key.alias("key")).agg(F.min(F.struct(P.parts(F.col("file")).alias("path"), "ord", "file", "start_line")).alias("at"))
    return first.select("key", F.col("at.file").alias("file"), F.col("at.start_line").alias("line"))


def attribute(timings: DataFrame, known: DataFrame) -> DataFrame:
    """timings with file and line of the inventory (key, file, line: one row a key); unknown keys are left out."""
    return timings.join(known, "key").withColumn("mean", S.mean_micros(F.col("total"), F.col("calls")))


def with_share(entries: DataFrame) -> DataFrame:
    """Adds share, the percentage of the sum of all totals; 0 where that is 0. The sum is one row, joined to all: its
    size is fixed, and no task holds all rows."""
    whole = entries.agg(F.sum("total").alias("_whole"))
    share = F.coalesce(F.try_divide(F.col("total"), F.col("_whole")) * 100.0, F.lit(0.0))
    return entries.join(F.broadcast(whole)).withColumn("share", share).drop("_whole")


def top(entries: DataFrame, n: int | None = TOP) -> DataFrame:
    """The n longest totals, all if n is null; ties by ord where the input has it, then by key."""
    ordered = entries.orderBy(F.desc("total"), *(["ord"] if "ord" in entries.columns else []), "key")
    return ordered if n is None else ordered.limit(n)


def over(entries: DataFrame, millis: float) -> DataFrame:
    """One row: how many totals are over so many milliseconds, the worst of them (0 if none), status."""
    ms = F.col("total") / 1000.0
    out = entries.agg(F.count_if(ms > millis).alias("exceeding"), F.coalesce(F.max(ms), F.lit(0.0)).alias("worst_ms"))
    return out.withColumn("status", F.when(F.col("exceeding") > 0, 2).otherwise(0))


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
