"""Running timing aggregates over a stream.

State is one row for each key. Checkpoints make it exactly-once: a batch that fails is done again from the state
before it, so nothing counts twice, and no two writers meet in one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators import timings


def running(events: DataFrame) -> DataFrame:
    """timings.aggregate of a stream of (key, micros)."""
    return timings.aggregate(events)


def write(aggregates: DataFrame, name: str, checkpoint: str | None = None) -> DataStreamWriter:
    """A writer of whole aggregates to an in-memory table, for all that is there now."""
    out = aggregates.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return out.option("checkpointLocation", checkpoint) if checkpoint else out


def finish(query: StreamingQuery, spark: SparkSession, name: str) -> DataFrame:
    """The table, once all that was there has been read; what failed the stream is raised."""
    query.awaitTermination()
    return spark.table(name)
