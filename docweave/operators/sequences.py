"""Windows over ordered rows: gaps, islands, rows in force, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_gaps(orders: DataFrame, by: str, order: list[str], start: str, until: str) -> DataFrame:
    """Each row with the days since the previous one and the whole days between the previous row's end and its start (null under 1)."""
    w = Window.partitionBy(by).orderBy(*order)
    before, ended = F.lag(start).over(w), F.lag(until).over(w)
    days = F.date_diff(F.col(start), ended) - 1
    return orders.withColumn("days_since_previous", F.date_diff(F.col(start), before)).withColumn("gap_days", F.when(days >= 1, days)).withColumn("position", F.row_number().over(w))


def periods(rows: DataFrame, by: list[str], first: str, last: str, key: str, tolerance: int) -> DataFrame:
    """``rows`` with period (from 1) and main: a row begins a period if it starts over ``tolerance`` days after all earlier rows have ended.

    The period with the most distinct keys is main, the earliest of equal ones.
    """
    w = Window.partitionBy(*by).orderBy(first, key)
    reached = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.date_diff(F.col(first), reached) > tolerance).cast("int"), F.lit(1))
    marked = rows.withColumn("begins_", begins).withColumn("period", F.sum("begins_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("begins_")
    size = marked.groupBy(*by, "period").agg(F.count_distinct(key).alias("size_"))
    best = size.groupBy(*by).agg(F.max_by("period", F.struct("size_", -F.col("period"))).alias("main_"))
    return marked.join(best, by).withColumn("main", F.col("period") == F.col("main_")).drop("main_")


def in_force(decisions: DataFrame, by: list[str], order: str, decision: str, reopened: str = "reopened") -> DataFrame:
    """The latest decision of each group, none if that is the reopening one."""
    last = decisions.groupBy(*by).agg(F.max_by(F.struct(*[c for c in decisions.columns if c not in by]), order).alias("last"))
    return last.select(*by, "last.*").where(F.col(decision) != reopened)


def merged_ranges(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of ranges; ranges that touch are merged. One without a start is its own; one without an end reaches nothing that another doesn't."""
    w = Window.partitionBy(*by).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col(start) > reached).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("island_", island).groupBy(*by, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order, with their rank."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def nearest_heading(spans: DataFrame, headings: DataFrame, by: str) -> DataFrame:
    """``spans`` (by, start, end) with the last heading at or before start and the first at or after end, by one merged window each."""
    rows = spans.select(by, "start", "end", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("heading"))
    h = headings.select(by, F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("start").cast("long").alias("heading"))
    w = Window.partitionBy(by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = rows.unionByName(h).withColumn("before", F.last("heading", ignorenulls=True).over(w)).where("kind = 1")
    again = one.select(by, "start", "end", F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("heading"), "before")
    h = h.withColumn("kind", F.lit(1)).withColumn("before", F.lit(None).cast("long"))
    w = Window.partitionBy(by).orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return again.unionByName(h).withColumn("after", F.first("heading", ignorenulls=True).over(w)).where("kind = 0").select(by, "start", "end", "before", "after")
