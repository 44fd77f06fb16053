"""Operators on findings and extracted items: merging, batching under a budget, marks, durations, templates, filters of model notes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Number words.
SMALL = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def best_by_key(rows: DataFrame, key: list[str], quality: list[Column], position: Column) -> DataFrame:
    """One row per key, the best by quality, then the first; with place, the order in which keys were first seen."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("seen_", F.min(position).over(w)).withColumn("k_", F.row_number().over(w.orderBy(*quality, position)))
    return ranked.where("k_ = 1").drop("k_").withColumnRenamed("seen_", "first_seen")


def batches(rows: DataFrame, by: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """Rows with batch: a group's rows in order, at most ``most`` to a batch and ``budget`` in sum of size; a row over the budget is a batch of its own.

    Each batch depends on where the last one ended, so a group is walked in order.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        batch, count, total, out = 0, 0, 0, []
        for n in group[size]:
            if count and (count == most or total + n > budget):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + n
            out.append(batch)
        return group.assign(batch=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch int"
    return rows.groupBy(by).applyInPandas(walk, schema)


def merged_marks(marks: DataFrame, by: str) -> DataFrame:
    """Overlapping marks (start, end, kind priority, label) as one, with the strongest kind and all labels; marks that only touch stay apart."""
    w = Window.partitionBy(by).orderBy("start", "end", "label")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = marks.where(F.col("end") > F.col("start")).withColumn("island_", island)
    out = rows.groupBy(by, "island_").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("priority").alias("priority"), F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("labels"))
    return out.drop("island_")


def number_of_words(text: str) -> int | None:
    """The number that words up to the hundreds spell, or figures; None for anything else."""
    words = text.lower().replace("-", " ").replace(" and ", " ").split()
    if len(words) == 1 and words[0].isdigit():
        return int(words[0])
    total, seen = 0, False
    for word in words:
        if word in SMALL:
            total += SMALL[word]
        elif word in TENS:
            total += TENS[word]
        elif word == "hundred":
            total = max(total, 1) * 100
        else:
            return None
        seen = True
    return total if seen else None


def duration_text(low: Column, high: Column) -> Column:
    """Hours, or a range in days and hours; figures without needless zeros."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), r"0+$", ""), r"\.$", "")
    span = F.concat(F.lit("between "), plain(low / 24), F.lit(" and "), plain(high / 24), F.lit(" days ("), plain(low), F.lit(" to "), plain(high), F.lit(" hours)"))
    return F.when(low == high, F.concat(plain(low), F.lit(" hours"))).otherwise(span)


def filtered_notes(rows: DataFrame, id_col: str, note_col: str, blocked: list[str], removed: str = "[removed]") -> DataFrame:
    """id and note with blocked terms replaced; a note that hides one behind look-alike letters is dropped whole; blank notes are null."""
    import re

    pattern = re.compile(r"(?<![\w-])(?:" + "|".join(f"(?:{b})" for b in blocked) + r")(?![\w-])", re.IGNORECASE)
    # letters of other scripts that look like Latin ones
    alike = str.maketrans("аеорсухіјԁԛѕ", "aeopcyxijdqs")

    def one(note: str | None) -> str | None:
        plain = unicodedata.normalize("NFKC", note or "").translate(INVISIBLE).strip()
        if not plain:
            return None
        if not pattern.search(plain):
            bare = "".join(c for c in unicodedata.normalize("NFKD", plain.translate(alike)) if not unicodedata.combining(c))
            return removed if pattern.search(bare) else plain
        return pattern.sub(removed, plain)

    def over(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(n) for n in batch.column(1).to_pylist()], pa.string())], names=["id", "note"])

    return rows.select(F.col(id_col).alias("id"), F.col(note_col).alias("note")).mapInArrow(over, f"id {rows.schema[id_col].dataType.simpleString()}, note string")


def merged_items(rows: DataFrame, by: list[str], items: str, kind: str, position: str) -> DataFrame:
    """Per group the distinct items in the order in which they came, and the first kind that isn't null."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(position, items))), lambda s: s[items])
    return rows.groupBy(*by).agg(F.array_distinct(F.flatten(parts)).alias(items), F.min_by(kind, F.when(F.col(kind).isNotNull(), F.col(position))).alias(kind))


def in_order(segments: Column, source: Column) -> Column:
    """Whether all segments stand in the source one after another, white space aside: each is looked for in what follows the last."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    rest = F.aggregate(segments, bare(source), lambda left, x: F.when(F.contains(left, bare(x)), F.substr(left, F.instr(left, bare(x)) + F.length(bare(x)))))
    return rest.isNotNull()
