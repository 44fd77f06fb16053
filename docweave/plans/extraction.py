"""Replies, orders, symbols, builds: queries on records made from rows of the tables, and spans of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import extraction, segments, spans

from . import texts
from .base import Tables, query


@query("""
WITH q AS (SELECT c_custkey AS id, sha256('{"model":"m","user":"' || c_name || '"}') AS key FROM customer),
r AS (SELECT sha256('{"model":"m","user":"' || c_name || '"}') AS key, CASE WHEN c_custkey % 7 = 0 THEN '{"a": ' ELSE '{"a":' || c_nationkey || '}' END AS reply FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT id, CASE WHEN r.key IS NULL THEN 'miss' WHEN reply LIKE '%}' THEN 'hit' ELSE 'damaged' END AS status, CASE WHEN reply LIKE '%}' THEN reply END AS reply FROM q LEFT JOIN r USING (key)""")
def reply_replay(t: Tables) -> DataFrame:
    """Requests answered from stored replies by the hash of their canonical form; misses and damaged entries apart."""
    key = extraction.request_key(F.lit("m").alias("model"), F.col("c_name").alias("user")).alias("key")
    replies = t.customer.where("c_mktsegment <> 'BUILDING'").select(key, F.when(F.col("c_custkey") % 7 == 0, '{"a": ').otherwise(F.concat(F.lit('{"a":'), F.col("c_nationkey").cast("string"), F.lit("}"))).alias("reply"))
    return extraction.replayed(t.customer.select(F.col("c_custkey").alias("id"), key), replies, "key", "reply").select("id", "status", "reply")


@query()
def placed_quotes(t: Tables) -> DataFrame:
    """The same quote named twice, and one that isn't there: each place is taken once."""
    first, second = F.substr("text", F.lit(11), F.lit(40)), F.substr("text", F.lit(31), F.lit(40))
    rows = t.documents.where("length(text) > 80").select("doc_id", "text", F.array(first, second, first, F.lit("words that no document of these has")).alias("quotes"))
    return extraction.placed_quotes(rows, "doc_id", "text", "quotes")


_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS date, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE + (30 + o_orderkey % 60)::INT END AS until FROM orders""")
def order_dates(t: Tables) -> DataFrame:
    """The date of an order by its labels, and the last day until which it orders detention."""
    o = t.orders
    day = F.to_date("o_orderdate")
    until = F.date_add(day, (30 + F.col("o_orderkey") % 60).cast("int"))
    head = F.when(F.col("o_orderkey") % 5 == 0, "Court: A\nDate: unknown").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Dated: 1 January 1999\nDate: "), F.date_format(day, "d MMMM yyyy"))).otherwise(F.concat(F.lit("Order date: "), F.date_format(day, "dd.MM.yyyy")))
    body = F.when(F.col("o_orderkey") % 3 == 0, "The accused stays in custody.").otherwise(
        F.concat(F.lit("He was remanded in custody until 3 March 1998. The court orders detention for now, until and including "), F.date_format(until, "MMMM d, yyyy"), F.lit(". It was signed."))
    )
    found, last = extraction.order_dates(F.concat(head, F.lit("\n\n"), body))
    return o.select(F.col("o_orderkey").alias("id"), found.alias("date"), last.alias("until"))


@query(r"""
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}')), lambda w: w NOT IN ('the','and','for','with','that','this','from','was','were','has','have','had','are','not','but','his','her','their','its','into','who','which','been','also'))), ' ') AS words FROM documents WHERE text IS NOT NULL""")
def search_words(t: Tables) -> DataFrame:
    """the words of a search."""
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(extraction.query_words(F.col("text"))), " ").alias("words"))


@query("""
WITH d AS (SELECT page_id, ['ccpr_views', 'wgad_opinion', 'court_judgment', 'tw_report'][(page_id % 4 + 1)::INT] AS kind, url FROM pages),
s AS (SELECT *, CASE WHEN page_id % 3 <> 0 AND kind = 'ccpr_views' THEN 'CCPR/C/100/D/' || page_id || '/2010' WHEN page_id % 3 <> 0 AND kind = 'wgad_opinion' THEN 'A/HRC/WGAD/2015/0' || page_id END AS symbol FROM d),
u AS (SELECT *, trim(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '([^/]+)/*$', 1), '(?i)\\.(pdf|html?)$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM s)
SELECT page_id, symbol, CASE WHEN kind = 'ccpr_views' THEN 'ccpr-' || (CASE WHEN symbol IS NOT NULL THEN page_id END) || '-2010' WHEN kind = 'wgad_opinion' THEN 'wgad-2015-' || (CASE WHEN symbol IS NOT NULL THEN page_id END)
  ELSE rtrim(left(CASE WHEN kind = 'court_judgment' THEN 'court-' ELSE 'tw-' END || nullif(slug, ''), 80), '-') END AS id FROM u""")
def symbols_and_ids(t: Tables) -> DataFrame:
    """the symbol near a document's begin, and the id by its kind."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("ccpr_views", "wgad_opinion", "court_judgment", "tw_report")]), (F.col("page_id") % 4 + 1).cast("int"))
    n = F.col("page_id").cast("string")
    shown = F.when(F.col("page_id") % 3 == 0, "No symbol here.").when(kind == "ccpr_views", F.concat(F.lit("Views CCPR/C/100/D/"), n, F.lit("/2010, then CCPR/C/9/D/1/1999"))).otherwise(F.concat(F.lit("Opinion A/HRC/WGAD/2015/0"), n, F.lit(" of it")))
    mark = extraction.symbol(kind, shown)
    return t.pages.select("page_id", mark.alias("symbol"), extraction.precedent_id(kind, F.col("url"), mark).alias("id"))


@query("""
WITH n AS (SELECT conv_id, turn, role, (length(text) % 23) / 22.0 AS similarity, contains(lower(text), 'and') AS labelled, contains(lower(text), 'the') AS mentions FROM conversations)
SELECT conv_id, role, turn FROM n WHERE similarity >= 0.35 AND NOT labelled AND mentions QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY similarity DESC, turn) = 1""")
def context_notes(t: Tables) -> DataFrame:
    """K2: the note nearest to a part's context that has no label and mentions it."""
    n = t.conversations.select("conv_id", "turn", "role", ((F.length("text") % 23) / 22.0).alias("similarity"), F.contains(F.lower("text"), F.lit("and")).alias("labelled"), F.contains(F.lower("text"), F.lit("the")).alias("mentions"))
    return extraction.context_notes(n, ["conv_id", "role"], "turn").select("conv_id", "role", "turn")


_OUTCOMES = f"""
{texts._CUT}, k AS (SELECT doc_id % 97 AS finding, doc_id % 11 <> 0 AND trim(substr(text, s + 1, e - s), ' ') <> '' AS ok FROM c), good AS (SELECT finding FROM k GROUP BY finding HAVING bool_and(ok)),
o AS (SELECT l_orderkey AS case_id, l_linenumber AS n, l_partkey AS part, ['absence', 'clock', 'reuse', 'renewal', 'judges'][(l_partkey % 5 + 1)::INT] AS module, CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey % 97 END AS finding, l_quantity::BIGINT AS measure FROM lineitem),
l AS (SELECT *, finding IS NOT NULL AND finding NOT IN (SELECT finding FROM good) AS lost FROM o)"""


def outcomes(t: Tables) -> DataFrame:
    """An item is a module's outcome, its supplier modulo 97 the finding that it rests on."""
    module = F.element_at(F.array(*[F.lit(m) for m in ("absence", "clock", "reuse", "renewal", "judges")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), module.alias("module"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") % 97).alias("finding"), F.lit("shown").alias("status"),
        F.col("l_quantity").cast("long").alias("measure"), F.lit(100).cast("long").alias("total"),
    )
    checked = spans.span_checks(texts.cut_spans(t), t.documents, "doc_id", "text")
    kept = checked.groupBy("finding").agg(F.bool_and("ok").alias("ok")).where("ok")
    return extraction.after_check(rows, kept)


@query(f"""
WITH {_OUTCOMES.strip()}
SELECT module, CASE WHEN NOT lost THEN 'shown' WHEN module = 'absence' THEN 'no_evidence' WHEN module = 'clock' THEN 'cannot_compute' WHEN module = 'judges' THEN 'hidden' ELSE 'shown' END AS status,
  count(*) AS n, coalesce(sum(CASE WHEN lost AND module IN ('renewal', 'judges', 'clock') THEN NULL ELSE measure END), 0)::BIGINT AS measured FROM l WHERE NOT (lost AND module = 'reuse') GROUP BY ALL""")
def checked_outcomes(t: Tables) -> DataFrame:
    """What each module shows once findings with bad spans are gone."""
    return outcomes(t).groupBy("module", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("measure"), F.lit(0)).alias("measured"))


@query(f"WITH {_OUTCOMES.strip()} SELECT case_id, sum(measure)::BIGINT AS covered, least(1.0, sum(measure) / 100.0) AS score FROM l WHERE module = 'reuse' AND NOT lost GROUP BY case_id")
def rescored_reuse(t: Tables) -> DataFrame:
    """Scores of copying after passages went."""
    return extraction.rescored(outcomes(t), "case_id").select("case_id", "covered", "score")


@query("""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS digest, unnest(range(CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 4 ELSE 1 END)) AS stage FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL),
c AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL), f AS (SELECT c.doc_id, count(b.stage) AS first FROM c LEFT JOIN b ON c.doc_id = b.doc_id AND c.digest = b.digest GROUP BY c.doc_id)
SELECT doc_id, unnest(range(first, 4))::INT AS stage FROM f""")
def stale_stages(t: Tables) -> DataFrame:
    """C20: the stages of a build that have to run again, by content."""
    digest = F.sha2("text", 256)
    d = t.documents.where("text IS NOT NULL")
    n = F.when(F.col("doc_id") % 3 == 0, 2).when(F.col("doc_id") % 3 == 1, 4).otherwise(1)
    built = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(digest).alias("digest"), F.explode(F.sequence(F.lit(0), n - 1)).alias("stage"))
    return extraction.stale(d.select("doc_id", digest.alias("digest")), built, "doc_id", "digest", "stage")


@query(f"""
WITH {texts._CUT}, q AS (SELECT doc_id, text, substr(text, s + 1, 2 + (doc_id % 9)::INT) AS quote FROM c),
u AS (SELECT doc_id, quote, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM q),
w AS (SELECT doc_id, quote, i, string_agg(ch, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM u),
a AS (SELECT doc_id, min(i) FILTER (starts_with(s, quote)) AS start FROM w GROUP BY doc_id HAVING count_if(starts_with(s, quote)) = 1)
SELECT doc_id % 4 AS type, doc_id % 30 AS day, count(*) AS n, string_agg(doc_id || '-' || start, ',' ORDER BY doc_id) AS mentions FROM a GROUP BY ALL""")
def gold_timeline(t: Tables) -> DataFrame:
    """Anchors that stand in their document once, by type and date."""
    s = ((F.col("doc_id") * 7) % 40).cast("int")
    d = t.documents.where("length(text) > 80")
    anchors = d.select(F.col("doc_id").alias("id"), F.substr("text", s + 1, (2 + F.col("doc_id") % 9).cast("int")).alias("quote"), (F.col("doc_id") % 4).alias("type"), (F.col("doc_id") % 30).alias("day"))
    found = extraction.gold_timeline(extraction.anchored(anchors, d, "doc_id", "text"), ["type", "day"])
    return found.select("type", "day", "n", F.array_join(F.transform("mentions", lambda m: F.concat_ws("-", m["id"], m["start"])), ",").alias("mentions"))


@query("""
SELECT c_custkey AS id, '{"case":"' || c_custkey || '","decision":"' || c_mktsegment || '","note":' || CASE WHEN c_custkey % 2 = 0 THEN '"seen"' ELSE 'null' END || '}' AS line FROM customer""")
def feedback_lines(t: Tables) -> DataFrame:
    """Decisions as lines of JSON."""
    note = F.when(F.col("c_custkey") % 2 == 0, "seen").alias("note")
    return t.customer.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_custkey").cast("string").alias("case"), F.col("c_mktsegment").alias("decision"), note), {"ignoreNullFields": "false"}).alias("line"))


@query()
def search_passage_spans(t: Tables) -> DataFrame:
    """Search passages between footnotes."""
    return segments.spans_of(t.documents, segments.search_passages, "doc_id", "text").drop("text")


@query()
def list_item_spans(t: Tables) -> DataFrame:
    """Sentences of list items."""
    return segments.spans_of(t.documents, segments.item_sentences, "doc_id", "text").drop("text")
