"""From replies of models to records: cached replies, quotes that take their places in order, orders' dates, outcomes after the check of spans, builds by content."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.similarity import Finder

from . import text

#: Labels of an order's date, in the order in which they count, and what stands before the date on which detention ends.
DATE_LABELS = ("Date", "Order date", "Dated")
UNTIL = r"(?i)\b(?:detention|detained|custody|remand(?:ed)?)\b[^.]{0,160}?\buntil\s+(?:and\s+including\s+)?"
#: Words of a search that carry no meaning, and the symbols of documents by their kind.
SEARCH_STOP = "the and for with that this from was were has have had are not but his her their its into who which been also".split()
SYMBOLS = {"ccpr_views": r"CCPR/C/[^/\s]+/D/(\d+(?:-\d+)?)/(\d{4})", "wgad_opinion": r"A/HRC/WGAD/(\d{4})/(\d+)"}
SYMBOL_REACH = 3000


def replayed(requests: DataFrame, replies: DataFrame, key: str, reply: str, live: bool = False) -> DataFrame:
    """``requests`` with reply and status: hit, miss, or damaged for a stored reply that isn't a JSON object; when ``live``, damaged ones are misses to be asked again."""
    stored = replies.select(F.col(key).alias("key_"), F.col(reply).alias("reply"))
    whole = F.coalesce(F.startswith(F.get_json_object("reply", "$"), F.lit("{")), F.lit(False))
    status = F.when(F.col("key_").isNull(), "miss").when(whole, "hit").otherwise("miss" if live else "damaged")
    out = requests.join(stored, F.col(key) == F.col("key_"), "left").withColumn("status", status)
    return out.withColumn("reply", F.when(F.col("status") == "hit", F.col("reply"))).drop("key_")


def request_key(*parts: Column) -> Column:
    """SHA-256 of the canonical JSON of a request."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def placed_quotes(docs: DataFrame, id_col: str, text_col: str, quotes_col: str) -> DataFrame:
    """id, n (from 0), start, end, match and score of each quote of a document's list, in its order: a place that an exact quote has taken isn't given again.

    Quotes that can't be placed have nulls. Documents without text or quotes give no rows.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n int, start int, end int, match string, score double"
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, (body, quotes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                finder = Finder(body or "")
                for n, quote in enumerate(quotes or () if body else ()):
                    at.append(k)
                    found.append((n, *(finder.consume(quote) or (None,) * 4)))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds))], names=["id", "n", "start", "end", "match", "score"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[quotes_col].alias("quotes")).mapInArrow(over, schema)


def order_dates(body: Column) -> tuple[Column, Column]:
    """The day of an order, from the first of DATE_LABELS whose line has one, and the last day until which it orders detention."""
    lines = F.split(body, "\n")

    def value(label: str) -> Column:
        """What stands after the label on the first line that has it and a value."""
        prefix = label.lower() + ":"
        own = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(prefix)))
        return F.get(F.filter(F.transform(own, lambda x: F.trim(F.substr(x, F.lit(len(prefix) + 1)))), lambda x: F.length(x) > 0), 0)

    days = [text.parse_date(value(label)) for label in DATE_LABELS]
    until = F.regexp_extract_all(body, F.lit(UNTIL + text.WRITTEN_DATE.removeprefix("(?i)")), F.lit(1))
    return F.coalesce(*days), F.try_element_at(F.filter(F.transform(until, text.parse_date), lambda d: d.isNotNull()), F.lit(-1))


def query_words(words: Column) -> Column:
    """The distinct words of a search of three letters or more that carry meaning."""
    found = F.regexp_extract_all(F.lower(words), F.lit(r"([a-z][a-z'-]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in SEARCH_STOP]))


def symbol(kind: Column, body: Column) -> Column:
    """The symbol of a document of that kind near its begin, null if there is none."""
    head = F.substr(body, F.lit(1), F.lit(SYMBOL_REACH))
    out = F.lit(None).cast("string")
    for name, pattern in SYMBOLS.items():
        out = F.when(kind == name, F.nullif(F.regexp_extract(head, pattern, 0), F.lit(""))).otherwise(out)
    return out


def precedent_id(kind: Column, url: Column, mark: Column, most: int = 80) -> Column:
    """The id that a document has by its kind: from its symbol, else its symbol's or address's slug."""
    views, opinion = SYMBOLS["ccpr_views"], SYMBOLS["wgad_opinion"]
    part = lambda pattern, k: F.regexp_extract(mark, pattern, k)
    own = F.coalesce(F.nullif(text.slug(F.coalesce(mark, F.lit(""))), F.lit("")), F.nullif(text.url_slug(url), F.lit("")))
    prefix = F.when(kind == "court_judgment", "court-").when(kind == "collection_document", "col-").otherwise("tw-")
    return (
        F.when(kind == "ccpr_views", F.when(mark.rlike(views), F.concat_ws("-", F.lit("ccpr"), part(views, 1), part(views, 2))))
        .when(kind == "wgad_opinion", F.when(mark.rlike(opinion), F.concat_ws("-", F.lit("wgad"), part(opinion, 1), part(opinion, 2).cast("long").cast("string"))))
        .otherwise(F.regexp_replace(F.substr(F.concat(prefix, own), F.lit(1), F.lit(most)), r"-+$", ""))
    )


def context_notes(notes: DataFrame, by: Sequence[str], order: str, least: float = 0.35, most: int = 1) -> DataFrame:
    """The notes nearest to a part's context: ``notes`` has similarity, labelled and mentions. Labelled ones, and those that don't mention the context, are none."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("similarity").desc(), order))
    open_ = notes.where((F.col("similarity") >= least) & ~F.coalesce("labelled", F.lit(False)) & F.coalesce("mentions", F.lit(False)))
    return open_.withColumn("place", place).where(F.col("place") <= most)


def after_check(outcomes: DataFrame, kept: DataFrame) -> DataFrame:
    """What modules show once findings with bad spans are gone: ``outcomes`` has module, status, measure, total and finding, ``kept`` the findings that stay.

    An absence falls back to no_evidence, an interval to cannot_compute, a renewal's share and a judge's rate aren't shown, and a copied
    passage goes; lost says which rows that is.
    """
    stay = kept.select(F.col("finding").alias("stays_")).distinct()
    lost = F.col("finding").isNotNull() & F.col("stays_").isNull()
    out = outcomes.join(stay, F.col("finding") == F.col("stays_"), "left").withColumn("lost", lost).drop("stays_")
    fallback = F.when(F.col("module") == "absence", "no_evidence").when(F.col("module") == "clock", "cannot_compute").when(F.col("module") == "judges", "hidden")
    out = out.where(~(F.col("lost") & (F.col("module") == "reuse")))
    unmeasured = F.col("lost") & F.col("module").isin("renewal", "judges", "clock")
    return out.withColumn("status", F.when(F.col("lost"), F.coalesce(fallback, F.col("status"))).otherwise(F.col("status"))).withColumn("measure", F.when(~unmeasured, F.col("measure")))


def rescored(outcomes: DataFrame, by: str) -> DataFrame:
    """Per case the share of its reasoning that the copied passages that are left cover, 1 at most; null without reasoning."""
    reuse = outcomes.where(F.col("module") == "reuse").groupBy(by).agg(F.sum("measure").alias("covered"), F.max("total").alias("total"))
    return reuse.withColumn("score", F.least(F.lit(1.0), F.try_divide(F.col("covered").cast("double"), F.col("total"))))


def stale(current: DataFrame, built: DataFrame, key: str, digest: str, stage: str) -> DataFrame:
    """(key, stage) of what a build has to do again: rows that a stage has not built from the same content, and every later stage of theirs.

    ``built`` has key, digest and stage numbers from 0; ``stage`` columns are numbered in the order of the build. What is gone from ``current`` isn't listed.
    """
    done = built.select(F.col(key).alias("k_"), F.col(digest).alias("d_"), F.col(stage).alias("s_")).distinct()
    stages = built.select(F.max(stage).alias("last_"))  # one row
    match = current.select(key, digest).join(done, (F.col(key) == F.col("k_")) & (F.col(digest) == F.col("d_")), "left")
    # stages count only as far as none before them is missing
    whole = match.groupBy(key, digest).agg(F.sort_array(F.collect_set("s_")).alias("have"))
    first = F.aggregate("have", F.lit(0), lambda n, s: F.when(s.cast("int") == n, n + 1).otherwise(n))
    out = whole.withColumn("first_", first).join(F.broadcast(stages)).where(F.col("first_") <= F.coalesce("last_", F.lit(0)))
    return out.select(key, F.explode(F.sequence(F.col("first_"), F.coalesce("last_", F.lit(0)).cast("int"))).alias(stage))


def anchored(anchors: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``anchors`` (id, quote and more) whose quote stands in its document once, with start."""
    from . import spans

    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body_"))
    out = anchors.join(body, "id").withColumn("start", spans.located(F.col("body_"), F.col("quote")))
    return out.where("start IS NOT NULL").drop("body_")


def gold_timeline(anchors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unique anchors of one type and date as one entry: mentions in document order, and how many."""
    out = anchors.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "start"))).alias("mentions"))
    return out.withColumn("n", F.size("mentions").cast("long"))
