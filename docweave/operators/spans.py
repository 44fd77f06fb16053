"""Spans and evidence: provenance, overlap and containment joins, exact quotes, set operations on findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """The first sixteen hexadecimal digits of SHA-256 over the parts; null parts are written as None."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


def span_checks(spans: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``spans`` (doc_id, start, end, span_text) with ok: the span is its document's text at its offsets, of that length and not blank."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("doc_text_"))
    out = spans.join(d, "doc_id", "left")
    own = F.substr("doc_text_", F.col("start") + 1, F.col("end") - F.col("start"))
    ok = F.coalesce(own == F.col("span_text"), F.lit(False)) & (F.col("start") >= 0) & (F.col("end") - F.col("start") == F.length("span_text")) & (F.trim("span_text") != "")
    return out.withColumn("ok", ok).drop("doc_text_")


def enforced(findings: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """Findings with kept and the number of bad spans: a finding with any bad span, or none at all, is dropped."""
    per = checked.groupBy(key).agg(F.count_if(~F.col("ok")).alias("bad"), F.count("*").alias("spans"))
    out = findings.join(per, key, "left")
    return out.withColumn("bad", F.coalesce("bad", F.lit(0).cast("long"))).withColumn("spans", F.coalesce("spans", F.lit(0).cast("long"))).withColumn("kept", (F.col("bad") == 0) & (F.col("spans") > 0))


def overlapping(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Pairs of spans of the same document that overlap: equal key first, so that Spark deals them by document."""
    left, right = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    return left.join(right, (F.col(f"a_{by}") == F.col(f"b_{by}")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote stands in a text, overlaps counted."""
    literal = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.regexp_count(text, literal)


def located(text: Column, quote: Column) -> Column:
    """The offset of a quote that stands in a text once, else null: an ambiguous quote is never guessed."""
    return F.when(occurrences(text, quote) == 1, F.instr(text, quote) - 1)
