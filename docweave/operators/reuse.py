"""Text reuse on word shingles: inverted-index join, containment over the union of accepted sources, covered characters, score.

A passage has case_id, passage (its id), start (offset of its text in the document) and text. Words are runs of letters, digits and underscores, in lower
case, with the code-point offsets that they have in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences

_WORD = re.compile(r"\w+")
#: Words that carry no content.
STOP_WORDS = (
    "about above after again against all also and any are because been before being below between both but can could did does doing down "
    "during each either for from further had has have having her here hers him his how into its itself may might more most must nor not now off "
    "once only other our ours out over own same shall she should some such than that the their theirs them then there these they this those "
    "through too under until upon very was were what when where which while who whom whose why will with within without would you your"
).split()


def shingles(passages: DataFrame, size: int = 5, min_words: int = 6) -> DataFrame:
    """case_id, passage, gram (64 bits of a shingle), start, end of every occurrence of every shingle; passages under ``min_words`` have none.

    One pass over each text in Arrow batches: an array of a text's words, exploded with its neighbours, is far slower in the JVM.
    """
    schema = f"case_id {passages.schema['case_id'].dataType.simpleString()}, passage {passages.schema['passage'].dataType.simpleString()}, gram string, start long, end long"
    names = ["case_id", "passage", "gram", "start", "end"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, grams, starts, ends = [], [], [], []
            for row, (offset, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]
                if len(found) < min_words:
                    continue
                for k in range(len(found) - size + 1):
                    at.append(row)
                    grams.append(" ".join(w[0] for w in found[k : k + size]))
                    starts.append(offset + found[k][1])
                    ends.append(offset + found[k + size - 1][2])
                if len(at) > 200_000:
                    yield made(batch, at, grams, starts, ends)
                    at, grams, starts, ends = [], [], [], []
            if at:
                yield made(batch, at, grams, starts, ends)

    def made(batch: pa.RecordBatch, at: list, grams: list, starts: list, ends: list) -> pa.RecordBatch:
        rows = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(grams), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=names)

    found = passages.select("case_id", "passage", F.col("start").cast("long").alias("start"), "text").mapInArrow(over, schema)
    return found.withColumn("gram", F.xxhash64("gram"))


def pair_overlaps(left: DataFrame, right: DataFrame, same_case: bool = False) -> DataFrame:
    """passage, source, shared, n_passage, n_source, jaccard and containment of pairs that share a shingle. Shingles are distinct per passage."""
    a = left.select("case_id", "passage", "gram").distinct()
    b = right.select(F.col("case_id").alias("source_case"), F.col("passage").alias("source"), "gram").distinct()
    on = (a["gram"] == b["gram"]) & (a["case_id"] == b["source_case"]) if same_case else a["gram"] == b["gram"]
    shared = a.join(b, on).groupBy("case_id", "passage", "source").agg(F.count("*").alias("shared"))
    n_a = a.groupBy("case_id", "passage").agg(F.count("*").alias("n_passage"))
    n_b = b.groupBy("source").agg(F.count("*").alias("n_source"))
    out = shared.join(n_a, ["case_id", "passage"]).join(n_b, "source")
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_passage") + F.col("n_source") - F.col("shared"))).withColumn("containment", F.col("shared") / F.col("n_passage"))


def verbatim(left: DataFrame, right: DataFrame, jaccard: float = 0.5, containment: float = 0.6, min_share: float = 0.1) -> DataFrame:
    """Pairs of passages that copy sources, with passage_containment over the union of the accepted sources.

    A source is accepted with max(2, min_share of the passage's shingles) shared ones or as a near-copy; a passage counts if the union covers
    ``containment`` of it or a source is a near-copy.
    """
    pairs = pair_overlaps(left, right).withColumn("near", F.col("jaccard") >= jaccard)
    accepted = pairs.where((F.col("shared") >= F.greatest(F.lit(2.0), F.lit(min_share) * F.col("n_passage"))) | F.col("near"))
    b = right.select(F.col("passage").alias("source"), "gram").distinct()
    a = left.select("case_id", "passage", "gram").distinct()
    covered = accepted.select("case_id", "passage", "source").join(a, ["case_id", "passage"]).join(b, ["source", "gram"]).groupBy("case_id", "passage").agg(F.count_distinct("gram").alias("covered"))
    whole = accepted.groupBy("case_id", "passage").agg(F.bool_or("near").alias("any_near"))
    kept = accepted.join(covered, ["case_id", "passage"]).join(whole, ["case_id", "passage"])
    kept = kept.withColumn("passage_containment", F.col("covered") / F.col("n_passage"))
    kept = kept.where((F.col("passage_containment") >= containment) | F.col("any_near"))
    return kept.select("case_id", "passage", "source", "shared", *(F.bround(c, 4).alias(c) for c in ("jaccard", "containment", "passage_containment")))


def covered_ranges(left: DataFrame, right: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Merged character ranges of the passages' shingles that their accepted sources share."""
    b = right.select(F.col("passage").alias("source"), "gram").distinct()
    hits = pairs.select("case_id", "passage", "source").join(b, "source").select("case_id", "passage", "gram").distinct().join(left, ["case_id", "passage", "gram"])
    return sequences.merged_ranges(hits.select(*by, "start", "end").distinct(), by, "start", "end")


def score(ranges: DataFrame, reasoning: DataFrame, by: str = "case_id") -> DataFrame:
    """Per case the covered characters and their share of the reasoning's, 1 at most; null without reasoning."""
    covered = ranges.groupBy(by).agg(F.sum(F.col("end") - F.col("start")).alias("verbatim_chars"))
    chars = reasoning.groupBy(by).agg(F.sum(F.length("text")).alias("reasoning_chars"))
    out = chars.join(covered, by, "left").withColumn("verbatim_chars", F.coalesce("verbatim_chars", F.lit(0)))
    return out.withColumn("score", F.least(F.lit(1.0), F.try_divide(F.col("verbatim_chars"), F.col("reasoning_chars"))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def content_words(text: Column) -> Column:
    """Distinct words of three characters or more that are no stop words and no numbers."""
    kept = F.filter(words(text), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\p{N}+$"))
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(w) for w in STOP_WORDS]))


def lead_shingles(tokens: DataFrame, by: list[str], size: int) -> DataFrame:
    """Shingles of a token table (by, pos, word) with built-in windows: the word and the ``size`` - 1 after it."""
    w = Window.partitionBy(*by).orderBy("pos")
    parts = [F.col("word"), *(F.lead("word", k).over(w) for k in range(1, size))]
    out = tokens.select(*by, "pos", *(p.alias(f"w{k}") for k, p in enumerate(parts))).where(F.col(f"w{size - 1}").isNotNull())
    return out.select(*by, "pos", F.concat_ws(" ", *(f"w{k}" for k in range(size))).alias("gram"))
