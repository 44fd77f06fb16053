"""The decision in force per finding over a growing log: beyond what the batch operators promise, with their rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def in_force(log: DataFrame, by: str = "flag_id", order: str = "id") -> DataFrame:
    """The latest decision of each finding so far, reopened ones included: a streaming aggregate keeps one row a finding as its state."""
    rest = [c for c in log.columns if c != by]
    return log.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("last")).select(by, "last.*")


def counted(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per kind and window of time; events later than ``late`` are too late to count."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select("window.start", kind, "n")


def to_table(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer of each batch's rows by ``write`` (rows, batch number); a batch that is run again has the same number."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
