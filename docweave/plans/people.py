"""Sequential operators: names, sentences, chunks and quotes, on customers, orders and documents. SQL can't express them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import similarity
from docweave.operators import registry, segments, text

from .base import Tables, query

SURNAMES = "amberly castor dunmore fenwick garrow halden iverly jessop".split()
GIVEN = "nora milo tessa arlo judith peter".split()


def names(t: Tables) -> DataFrame:
    """A customer is a case whose judge's name is written in one of several ways; a nation is a place."""
    k = F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    given, surname = F.initcap(pick(GIVEN, F.floor(k / 7))), F.initcap(pick(SURNAMES, k))
    raw = (
        F.when(k % 11 == 0, F.concat_ws(" ", F.substring(given, 1, 1), surname)).when(k % 13 == 0, F.concat_ws(" ", F.lit("Hon. Judge"), given, F.concat(surname, F.lit("h"))))
        .when(k % 17 == 0, F.lit("The Presiding Judge")).otherwise(F.concat_ws(" ", F.lit("Judge"), given, surname))
    )
    dates = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_set(F.to_date("o_orderdate"))).alias("dates"))
    rows = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("place"), k.cast("string").alias("case_id"), raw.alias("raw_name")).join(dates, "c_custkey", "left")
    key = text.normalise_name(F.col("raw_name"), list(registry.Settings.titles))
    return rows.select("place", "case_id", "raw_name", key.alias("key"), "dates", F.lit(None).cast("string").alias("same_as"), (F.col("c_custkey") % 101 == 0).alias("apart"))


@query()
def judge_registry(t: Tables) -> DataFrame:
    """Names of each place registered or waiting."""
    return registry.register(names(t))


@query()
def sentence_spans(t: Tables) -> DataFrame:
    """Sentences with offsets."""
    return segments.spans_of(t.documents, segments.all_sentences, "doc_id", "text").drop("text")


@query()
def chunk_spans(t: Tables) -> DataFrame:
    """Chunks of whole sentences that overlap."""
    return segments.spans_of(t.documents, lambda x: segments.chunks(x, 2500, 200), "doc_id", "text").drop("text")


@query()
def passage_spans(t: Tables) -> DataFrame:
    """Search passages."""
    return segments.spans_of(t.documents, lambda x: segments.passages(x, 800, 80, 160), "doc_id", "text").drop("text")


@query()
def bounded_spans(t: Tables) -> DataFrame:
    """Bounded passages."""
    return segments.spans_of(t.documents, segments.bounded, "doc_id", "text").drop("text")


@query("SELECT doc_id AS id, length(text) AS n FROM documents")
def window_lengths(t: Tables) -> DataFrame:
    """Windows of a text add up to the text."""
    w = segments.spans_of(t.documents, lambda x: segments.windows(x, 2000), "doc_id", "text")
    return w.groupBy("id").agg(F.sum(F.length("text")).alias("n"))


@query()
def located_quotes(t: Tables) -> DataFrame:
    """Quotes of a document found exactly, in canonical form, or by similarity."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                quote = own[10:70]
                quote = quote if i % 3 == 0 else quote.replace(" ", "  ") if i % 3 == 1 else quote[:30] + "q" + quote[31:]
                found.append(similarity.locate(own, quote, (0, 400)) or (None, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64())))], names=["doc_id", "start", "end", "match", "score"])

    return t.documents.where("length(text) > 100").select("doc_id", "text").mapInArrow(over, "doc_id long, start int, end int, match string, score double")
