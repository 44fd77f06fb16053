"""Timelines and intervals over uncertain dates.

An event row has case_id, type, seq (its place in the record), ts, precision (datetime, date, month, year, unknown) and needs_review.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = "INTERVAL 1 DAY"


def usable() -> Column:
    return F.col("ts").isNotNull() & F.col("precision").isin("date", "datetime")


def with_bounds(events: DataFrame) -> DataFrame:
    """Adds lo and hi, the earliest and latest moment: a point for datetimes, a whole day for dates."""
    day = F.date_trunc("day", "ts")
    point = F.col("precision") == "datetime"
    return events.withColumn("lo", F.when(point, F.col("ts")).otherwise(day)).withColumn("hi", F.when(point, F.col("ts")).otherwise(day + F.expr(DAY)))


def hours(later: Column, earlier: Column) -> Column:
    """Hours between two moments, rounded half to even at two decimals."""
    return F.bround((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9), 2)


def timeline(events: DataFrame, repeating: Collection[str]) -> DataFrame:
    """Mentions merged into events: one per type, or one per type and day for repeating types with a date.

    State: undated without a usable date, conflict with several days, needs_review with a mention marked for review, else ok.
    """
    group = F.when(F.col("type").isin(*repeating) & F.col("ts").isNotNull(), F.to_date("ts"))
    day = F.when(usable(), F.to_date("ts"))
    out = events.withColumn("group_day", group).groupBy("case_id", "type", "group_day").agg(
        F.count("*").alias("mentions"),
        F.min(F.when(usable(), F.col("ts"))).alias("ts"),
        F.min_by(F.when(usable(), F.col("precision")), F.when(usable(), F.struct("ts", "seq"))).alias("precision"),
        F.count_distinct(day).alias("days"),
        F.concat_ws(",", F.sort_array(F.collect_set(day.cast("string")))).alias("candidate_dates"),
        F.bool_or("needs_review").alias("reviewed"),
    )
    state = F.when(F.col("days") == 0, "undated").when(F.col("days") > 1, "conflict").when(F.col("reviewed"), "needs_review").otherwise("ok")
    return out.select("case_id", "type", "group_day", "mentions", "ts", F.coalesce("precision", F.lit("unknown")).alias("precision"), state.alias("state"), "candidate_dates")


def first_after(starts: DataFrame, ends: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """For each start the first end that can follow it: of the ends whose latest moment isn't before the start's earliest, the one with the smallest earliest.

    Ends have one of two widths, so an end can follow a start from the start's earliest moment less the width. Starts and ends are merged
    by time in one window per case and width, instead of being paired.
    """
    s = starts.select(*by, F.struct(*[c for c in starts.columns if c not in by]).alias("start"))
    e = ends.select(*by, F.struct("lo", "seq", "hi").alias("end"), (F.col("precision") == "datetime").alias("point"))
    probes = None
    for point in (True, False):
        at = F.col("start.lo") if point else F.col("start.lo") - F.expr(DAY)
        one = s.select(*by, "start", F.lit(None).cast("struct<lo:timestamp,seq:long,hi:timestamp>").alias("end"), F.lit(point).alias("point"), at.alias("at"), F.lit(0).alias("kind"))
        probes = one if probes is None else probes.unionByName(one)
    rows = probes.unionByName(e.select(*by, F.lit(None).cast(s.schema["start"].dataType).alias("start"), F.struct(F.col("end.lo").alias("lo"), F.col("end.seq").cast("long").alias("seq"), F.col("end.hi").alias("hi")).alias("end"), "point", F.col("end.lo").alias("at"), F.lit(1).alias("kind")))
    window = Window.partitionBy(*by, "point").orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = rows.withColumn("first", F.min("end").over(window)).where("kind = 0")
    best = found.groupBy(*by, "start").agg(F.min("first").alias("end")).where("end IS NOT NULL")
    return best.select(*by, "start", "end")


def interval_bounds(starts: DataFrame, ends: DataFrame, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per case the shortest and longest reading in hours over all starts, each with its first end. Cases without a pair are absent."""
    pairs = first_after(starts, ends, by)
    low = F.min(F.unix_micros("end.lo") - F.unix_micros("start.hi"))
    high = F.max(F.unix_micros("end.hi") - F.unix_micros("start.lo"))
    out = pairs.groupBy(*by).agg(low.alias("low_us"), high.alias("high_us"))
    return out.select(*by, F.greatest(F.bround(F.col("low_us") / F.lit(3.6e9), 2), F.lit(0.0)).alias("low"), F.bround(F.col("high_us") / F.lit(3.6e9), 2).alias("high"))


def measure(events: DataFrame, from_type: str, to_type: str, threshold: float | None, confirmed: bool) -> DataFrame:
    """Per case the interval between two types of events and its status against a threshold in hours.

    Mentions that need no review are preferred on each side; all readings decide whether a red result must be looked at.
    """
    e = with_bounds(events.where(usable() & F.col("type").isin(from_type, to_type))).select("case_id", "type", "seq", "precision", "needs_review", "lo", "hi")
    side = e.groupBy("case_id").agg(
        F.count_if(F.col("type") == from_type).alias("starts"), F.count_if((F.col("type") == from_type) & ~F.col("needs_review")).alias("clean_starts"),
        F.count_if(F.col("type") == to_type).alias("ends"), F.count_if((F.col("type") == to_type) & ~F.col("needs_review")).alias("clean_ends"),
    )
    picked = e.join(side, "case_id").withColumn("clean", F.when(F.col("type") == from_type, F.col("clean_starts")).otherwise(F.col("clean_ends")))
    picked = picked.where(~F.col("needs_review") | (F.col("clean") == 0)).select(*e.columns)
    start, end = F.col("type") == from_type, F.col("type") == to_type
    best = interval_bounds(picked.where(start), picked.where(end))
    every = interval_bounds(e.where(start), e.where(end)).select("case_id", F.col("low").alias("all_low"))
    cases = events.select("case_id").distinct().join(side, "case_id", "left").join(best, "case_id", "left").join(every, "case_id", "left")
    review = ((F.col("clean_starts") == 0) & (F.col("starts") > 0)) | ((F.col("clean_ends") == 0) & (F.col("ends") > 0))
    t = F.lit(threshold).cast("double")
    status = (
        F.when(F.col("low").isNull(), "cannot_compute")
        .when(t.isNull(), "measured")
        .when(F.lit(not confirmed) | review, "needs_review")
        .when(F.col("high") <= t, "within_benchmark")
        .when((F.col("low") > t) & (F.coalesce("all_low", "low") <= t), "needs_review")
        .when(F.col("low") > t, "exceeds_benchmark")
        .otherwise("may_exceed")
    )
    return cases.select("case_id", "low", "high", F.when(F.col("low").isNotNull(), F.coalesce("all_low", "low")).alias("all_low"), status.alias("status"))
