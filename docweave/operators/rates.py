"""Rates per decider against a baseline of peers.

A ruling row has case_id, place (court and kind of data), charge, judge (null while its name awaits confirmation), code, date,
doc, doc_order and pos. A rate has an id, the codes of its denominator and numerator, and how a case's rulings combine: the first or the last
decides, any hit counts, or all must hit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.intervals import family_quantiles, newcombe, wilson, z_value

FAR = "9999-12-31"


@dataclass(frozen=True)
class Rate:
    id: str
    denominator: tuple[str, ...]
    numerator: tuple[str, ...]
    combine: str  # first, last, any, all


def _order() -> Column:
    """Null dates after all others, then document order, then place in the document."""
    return F.struct(F.coalesce("date", F.lit(FAR).cast("date")), "doc_order", "pos")


def relevant(rulings: DataFrame, rates: Sequence[Rate]) -> DataFrame:
    """``rulings`` once for each rate that counts their code, with rate_id, combine and hit (in the numerator): one pass for all rates."""
    by_code: dict[str, list[Column]] = {}
    for rate in rates:
        for code in rate.denominator:
            by_code.setdefault(code, []).append(F.struct(F.lit(rate.id).alias("rate_id"), F.lit(rate.combine).alias("combine"), F.lit(code in rate.numerator).alias("hit")))
    counted = F.lit(None)
    for code, marks in by_code.items():
        counted = F.when(F.col("code") == code, F.array(*marks)).otherwise(counted)
    return rulings.select(*rulings.columns, F.explode(counted).alias("rate_")).select(*rulings.columns, "rate_.*")


def ordered_outcomes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, counted and decider of first and last rates, one row per case. Cases whose order is unknown are left out: undated rulings that
    the document's order can't place and that could change the outcome or the judge.
    """
    keys = [*by, "rate_id", "combine"]
    row, order, written = F.struct("hit", "judge"), _order(), F.struct("doc_order", "pos")
    window = Window.partitionBy(*keys).orderBy("doc_order", "pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.where(F.col("combine").isin("first", "last")).withColumn("latest", F.max("date").over(window))
    dated = F.when(F.col("date").isNotNull(), order)
    ends = [end(row, by_).alias(f"{name}_{way}") for way, end in (("first", F.min_by), ("last", F.max_by)) for name, by_ in (("chronological", order), ("in_document", written), ("dated", dated))]
    out = seen.groupBy(*keys).agg(
        *ends,
        F.count(F.when(F.col("date").isNull(), 1)).alias("undated"),
        F.count_distinct("doc").alias("docs"),
        F.coalesce(F.bool_and(F.col("latest").isNull() | F.col("date").isNull() | (F.col("date") >= F.col("latest"))), F.lit(True)).alias("sorted"),
        F.collect_set(F.when(F.col("date").isNull(), F.struct("hit", F.coalesce(F.col("judge").cast("string"), F.lit("")).alias("judge")))).alias("open"),
    )
    end = lambda name: F.when(F.col("combine") == "first", F.col(f"{name}_first")).otherwise(F.col(f"{name}_last"))
    settled = F.col("undated") == 0
    placed = (F.col("docs") == 1) & F.col("sorted")
    out = out.withColumn("row", F.when(settled, end("chronological")).when(placed, end("in_document")).otherwise(F.coalesce(end("dated"), end("chronological"))))
    own = F.struct(F.col("row.hit").alias("hit"), F.coalesce(F.col("row.judge").cast("string"), F.lit("")).alias("judge"))
    known = settled | placed | (F.size(F.array_union("open", F.array(own))) <= 1)
    return out.where(known).select(*by, "rate_id", F.col("row.hit").alias("counted"), F.col("row.judge").alias("decider"))


def any_outcomes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, counted and decider of any and all rates: the first ruling that settles the outcome, else the first."""
    row, order = F.struct("hit", "judge"), _order()
    settles = F.col("hit") == (F.col("combine") == "any")
    out = rows.where(F.col("combine").isin("any", "all")).groupBy(*by, "rate_id").agg(F.coalesce(F.min_by(row, F.when(settles, order)), F.min_by(row, order)).alias("row"))
    return out.select(*by, "rate_id", F.col("row.hit").alias("counted"), F.col("row.judge").alias("decider"))


def rate_counts(rulings: DataFrame, rates: Sequence[Rate]) -> DataFrame:
    """rate_id, place, charge, judge, n, k, base_n, base_k, base_judges for judges with at least one case.

    A first or last rate counts a case for the judge of its deciding ruling, all other decided cases are the baseline. An any or all rate counts
    the judge's own rulings of a case; the baseline is the others' cases in which the judge never sits. Baselines are totals less the
    judge's share, so judges and cases are never paired.
    """
    where = ("rate_id", "place", "charge")
    rows = relevant(rulings, rates)
    decided = ordered_outcomes(rows, ("place", "charge", "case_id")).where(F.col("decider").isNotNull())
    own = decided.groupBy(*where, F.col("decider").alias("judge")).agg(F.count("*").alias("n"), F.count_if("counted").alias("k"))
    total = own.groupBy(*where).agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.count("*").alias("judges"))
    out = own.join(total, [*where])
    first = out.select(*where, "judge", "n", "k", (F.col("all_n") - F.col("n")).alias("base_n"), (F.col("all_k") - F.col("k")).alias("base_k"), (F.col("judges") - 1).alias("base_judges"))

    known = rows.where(F.col("judge").isNotNull())
    own = any_outcomes(known, ("place", "charge", "judge", "case_id")).groupBy(*where, "judge").agg(F.count("*").alias("n"), F.count_if("counted").alias("k"))
    peers = any_outcomes(known, ("place", "charge", "case_id"))
    total = peers.groupBy(*where).agg(F.count("*").alias("all_n"), F.count_if("counted").alias("all_k"), F.count_distinct("decider").alias("judges"))
    sits = rulings.where(F.col("judge").isNotNull()).select("case_id", "judge").distinct()
    shared = peers.join(sits, "case_id")
    mine = shared.groupBy(*where, "judge").agg(F.count("*").alias("my_n"), F.count_if("counted").alias("my_k"))
    each = peers.groupBy(*where, "decider").agg(F.count("*").alias("d_n"))
    # deciders all of whose cases have the judge in them
    inside = shared.groupBy(*where, "judge", "decider").agg(F.count("*").alias("in_n")).join(each, [*where, "decider"]).where("in_n = d_n")
    inside = inside.groupBy(*where, "judge").agg(F.count("*").alias("gone"))
    out = own.join(total, [*where]).join(mine, [*where, "judge"], "left").join(inside, [*where, "judge"], "left")
    less = lambda a, b: F.col(a) - F.coalesce(b, F.lit(0))
    return first.unionByName(out.select(*where, "judge", "n", "k", less("all_n", "my_n").alias("base_n"), less("all_k", "my_k").alias("base_k"), less("judges", "gone").alias("base_judges")))


def indicators(rulings: DataFrame, rates: list[Rate], minimum: int = 5, alpha: float = 0.05) -> DataFrame:
    """One row per judge, charge and rate: counts, and if both sides have ``minimum`` cases the rates, their intervals and the pattern.

    The difference's confidence is split over the indicators that are shown for the judge, however many. Numbers of hidden indicators are null.
    """
    counts = rate_counts(rulings, rates)
    counts = counts.withColumn("shown", (F.col("n") >= minimum) & (F.col("base_n") >= minimum))
    counts = counts.withColumn("compared", F.sum(F.col("shown").cast("int")).over(Window.partitionBy("place", "judge")))
    # a quantile for each number of comparisons that there is: Spark sends the table to all where it is small
    numbers = counts.select(F.greatest("compared", F.lit(1)).cast("long").alias("k_")).distinct()
    quantiles = family_quantiles(numbers, "k_", "zk", alpha)
    counts = counts.withColumn("k_", F.greatest("compared", F.lit(1)).cast("long")).join(quantiles, "k_")
    z = F.lit(z_value(1 - alpha))
    low, high = wilson(F.col("k"), F.col("n"), z)
    base_low, base_high = wilson(F.col("base_k"), F.col("base_n"), z)
    zk = F.col("zk")
    d_low, d_high = newcombe(F.col("k"), F.col("n"), F.col("base_k"), F.col("base_n"), zk)
    only = lambda c: F.when(F.col("shown"), c)
    return counts.select(
        "place", "charge", "judge", "rate_id", "n", "base_n", "base_judges", "shown", F.col("compared").cast("long").alias("compared"),
        only(F.col("k") / F.col("n")).alias("rate"), only(low).alias("ci_low"), only(high).alias("ci_high"),
        only(F.col("base_k") / F.col("base_n")).alias("base_rate"), only(base_low).alias("base_low"), only(base_high).alias("base_high"),
        only(d_low).alias("diff_low"), only(d_high).alias("diff_high"), only((d_low > 0) | (d_high < 0)).alias("pattern"),
    )


def descriptive(rulings: DataFrame, codes: list[str], minimum: int = 5) -> DataFrame:
    """Numbers of value codes per judge and charge: cases, and from ``minimum`` cases on the count, least, mean and largest value."""
    rows = rulings.where(F.col("code").isin(*codes) & F.col("value").isNotNull() & F.col("judge").isNotNull())
    out = rows.groupBy("place", "charge", "judge", "code").agg(
        F.count_distinct("case_id").alias("cases"), F.count("*").alias("n_"), F.min("value").alias("least_"), F.max("value").alias("largest_"), F.avg("value").alias("mean_")
    )
    shown = F.col("cases") >= minimum
    return out.select("place", "charge", "judge", "code", "cases", shown.alias("shown"), *(F.when(shown, F.col(f"{c}_")).alias(c) for c in ("n", "least", "largest", "mean")))


def order_unknown(rulings: DataFrame, rate: Rate) -> DataFrame:
    """case_id of the cases that a first or last rate leaves out because their order is unknown."""
    rows = relevant(rulings, [rate])
    return rows.select("case_id").distinct().join(ordered_outcomes(rows, ("case_id",)), "case_id", "left_anti")
