"""Text segmentation, dates, cleaning, phrase search, spans and sets, on documents, pages, conversations and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators import sequences, spans, text

from .base import Tables, query

_LINES = """
l AS (SELECT doc_id AS id, unnest(s) AS text, unnest(range(len(s)))::INT AS line,
  unnest(list_transform(range(len(s)), lambda i: length(array_to_string(s[1:i], chr(10))) + (i > 0)::INT))::INT AS start FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"""


def lines(t: Tables) -> DataFrame:
    return text.pieces(t.documents, "doc_id", F.col("text"))


@query(f"WITH {_LINES.strip()} SELECT id, line, start, length(text) AS n, start + length(text) AS \"end\" FROM l WHERE trim(text) <> ''")
def document_lines(t: Tables) -> DataFrame:
    """Lines with their offsets in the whole text."""
    n = F.length("text")
    return lines(t).where(F.trim("text") != "").select("id", "line", "start", n.cast("long").alias("n"), (F.col("start") + n).cast("long").alias("end"))


@query(f"""
WITH {_LINES.strip()}, c AS (SELECT id, line, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) AS sentence, unnest(range(1, len(regexp_extract_all(text, '[^.!?]+[.!?]*')) + 1)) AS k FROM l)
SELECT id, count(*) AS sentences, max(length(trim(sentence))) AS longest FROM c WHERE trim(sentence) <> '' GROUP BY id""")
def simple_sentences(t: Tables) -> DataFrame:
    """T2 without abbreviations and quotations, T6: sentences per document."""
    s = lines(t).select("id", F.explode(F.regexp_extract_all("text", F.lit("([^.!?]+[.!?]*)"), F.lit(1))).alias("s")).withColumn("s", F.trim("s")).where("s <> ''")
    return s.groupBy("id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("long").alias("longest"))


_STYLE = r"""
CASE WHEN length(t) > 0 AND length(t) <= 90 AND w <= 12 AND NOT regexp_matches(t, '[;!?]$') AND (NOT regexp_matches(t, '[.,:]$') OR caps) THEN
  CASE WHEN regexp_matches(t, '^[IVXLC]+[.)]\s+\S') THEN 'roman' WHEN regexp_matches(t, '^\d+(?:\.\d+)+\.?\s+\S') THEN 'decimal' WHEN regexp_matches(t, '^\d+[.)]\s+\S') THEN 'digit'
    WHEN regexp_matches(t, '^[A-Z][.)]\s+\S') THEN 'letter' WHEN regexp_matches(t, '^\([a-z0-9]{1,3}\)\s+\S') THEN 'paren' WHEN caps THEN 'caps'
    WHEN w <= 10 AND regexp_matches(t, '^(?:\p{Lu}[\p{L}\p{N}''-]*(?:\s+|$)|(?:a|an|and|as|at|by|for|in|of|on|or|the|to|with)(?:\s+|$))+$') AND regexp_matches(t, '^\p{Lu}') AND length(letters) > 3 THEN 'title' END END"""


@query(rf"""
WITH {_LINES.strip()}, a AS (SELECT id, line, trim(text, ' ') AS t, regexp_replace(trim(text, ' '), '[^\p{{L}}]', '', 'g') AS letters, len(regexp_split_to_array(trim(text, ' '), '\s+')) AS w FROM l),
b AS (SELECT *, length(letters) > 2 AND letters = upper(letters) AND letters <> lower(letters) AS caps FROM a),
c AS (SELECT *, {_STYLE.strip()} AS style FROM b),
d AS (SELECT *, first_value(CASE WHEN style IN ('roman', 'decimal', 'digit', 'letter', 'paren') THEN style END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS f FROM c)
SELECT id, line, style, last_value(CASE WHEN style IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section,
  last_value(CASE WHEN style = 'caps' OR (style IS NOT NULL AND f IS NULL) OR style = f THEN t END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS chapter FROM d""")
def line_sections(t: Tables) -> DataFrame:
    """Heading styles, and the section and chapter that each line stands in."""
    return text.sections(lines(t)).select("id", "line", "style", "section", "chapter")


@query(r"""
SELECT conv_id AS id, arg_min(trim(substr(text, 4)), turn) AS value FROM conversations WHERE starts_with(lower(text), 'the') AND trim(substr(text, 4)) <> '' GROUP BY conv_id""")
def caption_values(t: Tables) -> DataFrame:
    """The first line of each record that begins with a label."""
    rows = t.conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("line"), "text")
    value = F.trim(F.substr("text", F.lit(4)))
    return rows.where(F.lower("text").startswith("the")).withColumn("value", value).where("value <> ''").groupBy("id").agg(F.min_by("value", "line").alias("value"))


@query(r"""
SELECT o_orderkey AS id, t, CASE o_orderkey % 6
  WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN d END AS parsed, regexp_matches(t, '\b(?:1[89]\d{2}|2\d{3})\b') AS has_year
FROM (SELECT o_orderkey, o_orderdate::DATE AS d, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d %B %Y') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y')
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN 'the ' || strftime(o_orderdate, '%-d') || 'th day of ' || strftime(o_orderdate, '%B, %Y') ELSE strftime(o_orderdate, '%m/%Y') END AS t FROM orders)""")
def parsed_dates(t: Tables) -> DataFrame:
    """Dates written in five ways are read; a bare month and year isn't a date."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    written = (
        F.when(k == 0, F.date_format(d, "dd MMMM yyyy")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.date_format(d, "dd.MM.yyyy")).when(k == 3, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 4, F.concat(F.lit("the "), F.date_format(d, "d"), F.lit("th day of "), F.date_format(d, "MMMM, yyyy"))).otherwise(F.date_format(d, "MM/yyyy"))
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), written.alias("t"))
    return rows.select("id", "t", text.parse_date(F.col("t")).alias("parsed"), F.col("t").rlike(r"\b(?:1[89]\d{2}|2\d{3})\b").alias("has_year"))


@query(r"""
SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || ' x ', '\r\n?', chr(10), 'g'), chr(173), ''),
  '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)""")
def cleaned_text(t: Tables) -> DataFrame:
    """Cleaned texts."""
    c = text.clean_text(F.concat("text", F.lit("\r\n\n\n\n x ")))
    return t.documents.select("doc_id", c.alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, CASE WHEN length(text) < 500 THEN 'short' WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.5 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) THEN 'letters'
  WHEN len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ('the', 'and', 'of', 'to', 'that', 'with', 'which', 'was', 'were', 'for', 'this', 'has', 'have', 'been'))) < 0.05 * len(regexp_extract_all(lower(text), '[a-z]+')) THEN 'words' END AS problem FROM documents""")
def language_gate(t: Tables) -> DataFrame:
    """why a text isn't kept as English prose."""
    return t.documents.select("doc_id", text.language_problem(F.col("text")).alias("problem"))


@query(r"""
SELECT page_id, trim(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '([^/]+)/*$', 1), '(?i)\.(?:pdf|html?)$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages""")
def url_slugs(t: Tables) -> DataFrame:
    """slugs and hosts of addresses."""
    return t.pages.select("page_id", text.url_slug(F.col("url")).alias("slug"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"))


@query(r"""
SELECT page_id, substr(html, instr(html, '<h1>') + 4, instr(html, '</h1>') - instr(html, '<h1>') - 4) AS title, len(regexp_extract_all(html, '<a [^>]*>')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def page_outline(t: Tables) -> DataFrame:
    """Title, links and paragraphs of pages by patterns."""
    h = F.col("html")
    title = F.substr("html", F.instr("html", "<h1>") + 4, F.instr("html", "</h1>") - F.instr("html", "<h1>") - 4)
    return t.pages.select("page_id", title.alias("title"), F.regexp_count(h, F.lit("<a [^>]*>")).cast("long").alias("links"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"))


@query(r"""
WITH m AS (SELECT doc_id, text, string_split_regex(text, '(?i)of\s+the') AS parts, regexp_extract_all(text, '(?i)of\s+the') AS hits FROM documents),
k AS (SELECT *, unnest(range(1, least(len(hits), 3) + 1)) AS hit FROM m WHERE len(hits) > 0)
SELECT doc_id, len(hits) AS total, hit::INT AS hit, s::BIGINT AS match_start, (s + length(hits[hit]))::BIGINT AS match_end, length(left(text, s)) - length(replace(left(text, s), chr(10), '')) + 1 AS line
FROM (SELECT *, length(array_to_string(parts[1:hit], '')) + length(array_to_string(hits[1:hit - 1], '')) AS s FROM k)""")
def phrase_hits(t: Tables) -> DataFrame:
    """Up to three hits of a phrase per document, whatever the white space and case, with offsets and line numbers."""
    rows = text.occurrences(t.documents.select("doc_id", "text"), "text", F.lit("of the"))
    line = text.line_number(F.col("text"), F.col("match_start"))
    return rows.select("doc_id", F.col("total").cast("long").alias("total"), F.col("hit").cast("int").alias("hit"), F.col("match_start").cast("long").alias("match_start"), F.col("match_end").cast("long").alias("match_end"), line.cast("long").alias("line"))


@query(r"""
SELECT c_custkey, lower(trim(regexp_replace('  ' || c_mktsegment || '  ' || c_name, '\s+', ' ', 'g'))) AS key,
  array_to_string(list_filter(regexp_extract_all(lower(replace('Hon. Judge ' || c_name || ' O''Neill Lord', '''', '')), '[a-z]+'), lambda w, i: i > 2), ' ') AS name,
  substr(sha256(c_custkey::VARCHAR || chr(31) || coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'None')), 1, 16) AS id,
  length(c_name) // 4 AS tokens FROM customer""")
def keys_and_names(t: Tables) -> DataFrame:
    """Comparison keys, names without leading titles, stable ids, token estimates."""
    raw = F.concat(F.lit("Hon. Judge "), F.col("c_name"), F.lit(" O'Neill Lord"))
    return t.customer.select(
        "c_custkey",
        text.key_text(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  "), F.col("c_name"))).alias("key"),
        text.normalise_name(raw, ["hon", "judge", "lord"]).alias("name"),
        spans.stable_id(F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("id"),
        F.floor(F.length("c_name") / 4).cast("long").alias("tokens"),
    )


_CUT = "c AS (SELECT doc_id, text, (doc_id * 7) % 40 AS s, (doc_id * 7) % 40 + 12 + doc_id % 9 AS e FROM documents WHERE length(text) > 80)"


def cut_spans(t: Tables) -> DataFrame:
    """Spans cut from documents; those of every eleventh document are altered."""
    s = (F.col("doc_id") * 7) % 40
    e = s + 12 + F.col("doc_id") % 9
    rows = t.documents.where(F.length("text") > 80).select("doc_id", s.cast("int").alias("start"), e.cast("int").alias("end"), "text")
    own = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    own = F.when(F.col("doc_id") % 11 == 0, F.concat(F.substr(own, F.lit(2)), F.lit("~"))).otherwise(own)
    return rows.withColumn("span_text", own).drop("text").withColumn("finding", F.col("doc_id") % 97)


@query(f"""
WITH {_CUT}, k AS (SELECT doc_id % 97 AS finding, doc_id % 11 <> 0 AND trim(substr(text, s + 1, e - s), ' ') <> '' AS ok FROM c)
SELECT n AS finding, count(ok) AS spans, (count(*) FILTER (NOT ok))::BIGINT AS bad, coalesce(bool_and(ok), false) AS kept FROM range(100) r(n) LEFT JOIN k ON n = finding GROUP BY n""")
def provenance(t: Tables) -> DataFrame:
    """A finding stays only if all of its spans are their documents' text."""
    checked = spans.span_checks(cut_spans(t), t.documents, "doc_id", "text")
    findings = t.spark.range(100).select(F.col("id").alias("finding"))
    return spans.enforced(findings, checked, "finding").select("finding", "spans", "bad", "kept")


@query(f"""
WITH {_CUT}, k AS (SELECT doc_id % 97 AS finding, doc_id % 11 <> 0 AND trim(substr(text, s + 1, e - s), ' ') <> '' AS ok FROM c), f AS (SELECT finding, bool_and(ok) AS kept FROM k GROUP BY finding)
SELECT finding % 5 AS module, (count_if(kept))::BIGINT AS kept, (count_if(NOT kept))::BIGINT AS dropped, coalesce(count_if(kept)::DOUBLE / nullif(count(*), 0), 1.0) AS rate FROM f GROUP BY ALL""")
def provenance_rate(t: Tables) -> DataFrame:
    """Kept and dropped findings per module and the share kept."""
    checked = spans.span_checks(cut_spans(t), t.documents, "doc_id", "text")
    f = checked.groupBy("finding").agg(F.bool_and("ok").alias("kept")).withColumn("module", F.col("finding") % 5)
    out = f.groupBy("module").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("kept").cast("double"), F.col("kept") + F.col("dropped")), F.lit(1.0)))


@query("""
SELECT a.l_orderkey AS id, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
  AND a.l_partkey % 60 < b.l_partkey % 60 + b.l_quantity AND b.l_partkey % 60 < a.l_partkey % 60 + a.l_quantity""")
def overlapping_spans(t: Tables) -> DataFrame:
    """Spans of the same document that overlap."""
    s = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + F.col("l_quantity")).alias("end"))
    return spans.overlapping(s, s, "id").where("a_n < b_n").select(F.col("a_id").alias("id"), F.col("a_n").alias("a"), F.col("b_n").alias("b"))


@query(f"""
WITH {_CUT}, q AS (SELECT doc_id, text, substr(text, s + 1, 2 + (doc_id % 9)::INT) AS quote FROM c),
u AS (SELECT doc_id, quote, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM q),
w AS (SELECT doc_id, quote, i, string_agg(ch, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM u)
SELECT doc_id, (count_if(starts_with(s, quote)))::INT AS occurrences, CASE WHEN count_if(starts_with(s, quote)) = 1 THEN (min(i) FILTER (starts_with(s, quote)))::INT END AS start FROM w GROUP BY doc_id""")
def unique_quotes(t: Tables) -> DataFrame:
    """J16 exact, C24: quotes that stand in their document once; overlapping repeats count."""
    rows = t.documents.where("length(text) > 80")
    s = ((F.col("doc_id") * 7) % 40).cast("int")
    rows = rows.select("doc_id", "text", F.substr("text", s + 1, (2 + F.col("doc_id") % 9).cast("int")).alias("quote"))
    return rows.select("doc_id", spans.occurrences(F.col("text"), F.col("quote")).alias("occurrences"), spans.located(F.col("text"), F.col("quote")).cast("int").alias("start"))


@query("""
WITH h AS (SELECT l_orderkey AS id, l_partkey % 200 AS start FROM lineitem WHERE l_linenumber <= 2), s AS (SELECT l_orderkey AS id, l_suppkey * 20 AS start, l_suppkey * 20 + l_quantity::BIGINT AS "end" FROM lineitem WHERE l_linenumber = 3)
SELECT s.id, s.start, s."end", (SELECT max(h.start) FROM h WHERE h.id = s.id AND h.start <= s.start) AS before, (SELECT min(h.start) FROM h WHERE h.id = s.id AND h.start >= s."end") AS after FROM s""")
def nearest_headings(t: Tables) -> DataFrame:
    """The last heading at or before a span and the first at or after it."""
    h = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 200).alias("start"))
    s = t.lineitem.where("l_linenumber = 3").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") * 20).alias("start"), (F.col("l_suppkey") * 20 + F.col("l_quantity").cast("long")).alias("end"))
    return sequences.nearest_heading(s, h, "id")


_NEG = "('no', 'not', 'never', 'without', 'denied', 'refused', 'absent', 'unable', 'nor', 'none', 'nobody', 'nothing', 'cannot')"


@query(rf"""
WITH b AS (SELECT doc_id, text || ' No. 45 was not denied; it wasn''t none' AS s, text || CASE WHEN doc_id % 2 = 0 THEN ' was not denied it wasn''t none' ELSE ' was denied' END AS q FROM documents),
w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(s), ' no\. 45', ' 45'), '[a-z'']+'), lambda x: x IN {_NEG} OR x LIKE '%n''t')) AS a, list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z'']+'), lambda x: x IN {_NEG} OR x LIKE '%n''t')) AS b FROM b)
SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 AS mismatch FROM w""")
def negation_mismatch(t: Tables) -> DataFrame:
    """Quotes that drop a negation of their sentence."""
    base = F.col("text")
    s = F.concat(base, F.lit(" No. 45 was not denied; it wasn't none"))
    q = F.concat(base, F.when(F.col("doc_id") % 2 == 0, " was not denied it wasn't none").otherwise(" was denied"))
    return t.documents.select("doc_id", (F.size(F.array_except(text.negations(s), text.negations(q))) > 0).alias("mismatch"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w IN ('no', 'not', 'never', 'nor', 'in', 'on') GROUP BY ALL),
h AS (SELECT doc_id, unnest(regexp_extract_all(lower(left(text, 200)), '[a-z]+')) AS w FROM documents), k AS (SELECT doc_id, w, count(*) AS n FROM h GROUP BY ALL)
SELECT c.doc_id, (count_if(c.n > coalesce(k.n, 0)))::BIGINT AS dropped FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.w = k.w GROUP BY c.doc_id""")
def dropped_negations(t: Tables) -> DataFrame:
    """Words that a sentence has more often than its quote, by a multiset difference."""
    d = t.documents
    counted = lambda c: d.select("doc_id", F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    whole = counted(F.col("text")).where(F.col("w").isin("no", "not", "never", "nor", "in", "on"))
    quote = counted(F.substr("text", F.lit(1), F.lit(200))).withColumnRenamed("n", "m")
    return whole.join(quote, ["doc_id", "w"], "left").groupBy("doc_id").agg(F.count_if(F.col("n") > F.coalesce("m", F.lit(0))).alias("dropped"))


@query(r"""
SELECT conv_id, turn, own, own OR (coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), false) AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role, false)) AS grounded
FROM (SELECT *, contains(p, ' the ') OR contains(p, ' and ') AS own FROM (SELECT *, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') || ' ' AS p FROM conversations))""")
def grounded_mentions(t: Tables) -> DataFrame:
    """A keyword of the sentence itself, or of the one before it in the same part."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("own", text.mentions(F.col("text"), ["the", "and"]))
    before = F.coalesce(F.lag("own").over(w), F.lit(False)) & F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False))
    return rows.select("conv_id", "turn", "own", (F.col("own") | before).alias("grounded"))


@query("""
WITH p AS (SELECT DISTINCT role FROM conversations), c AS (SELECT DISTINCT conv_id FROM conversations),
l AS (SELECT DISTINCT ON (conv_id, role) conv_id, role, label FROM (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 'contradicts' WHEN length(text) % 5 <= 3 THEN 'supports' ELSE 'unlabelled' END AS label FROM conversations)
  ORDER BY conv_id, role, CASE label WHEN 'contradicts' THEN 0 WHEN 'supports' THEN 1 ELSE 2 END)
SELECT conv_id, CASE WHEN bool_or(coalesce(label, '') = 'contradicts') THEN 'violation' WHEN bool_and(coalesce(label, '') = 'supports') THEN 'compliance' ELSE 'no_evidence' END AS status,
  coalesce(string_agg(CASE WHEN label IS NULL THEN role END, ',' ORDER BY role), '') AS uncovered FROM c CROSS JOIN p LEFT JOIN l USING (conv_id, role) GROUP BY conv_id""")
def guarantee_status(t: Tables) -> DataFrame:
    """The strongest label per part; a contradiction violates, all parts supported comply, else there is no evidence."""
    n = F.length("text") % 5
    label = F.when(n == 0, "contradicts").when(n <= 3, "supports").otherwise("unlabelled")
    order = F.when(F.col("label") == "contradicts", 0).when(F.col("label") == "supports", 1).otherwise(2)
    best = t.conversations.withColumn("label", label).groupBy("conv_id", "role").agg(F.min_by("label", order).alias("label"))
    # roles are a handful: the parts that every record must cover
    parts = F.broadcast(t.conversations.select("role").distinct())
    grid = t.conversations.select("conv_id").distinct().join(parts).join(best, ["conv_id", "role"], "left")
    la = F.coalesce("label", F.lit(""))
    out = grid.groupBy("conv_id").agg(F.bool_or(la == "contradicts").alias("c"), F.bool_and(la == "supports").alias("s"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("label").isNull(), F.col("role"))))).alias("uncovered"))
    return out.select("conv_id", F.when(F.col("c"), "violation").when(F.col("s"), "compliance").otherwise("no_evidence").alias("status"), "uncovered")


@query("""
WITH s AS (SELECT conv_id, turn, role, length(text) % 23 AS sim, contains(lower(text), 'the') AS hit FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY sim DESC, turn) AS k FROM s WHERE sim >= 3), c AS (SELECT conv_id, turn, hit, sim, false AS best FROM s WHERE hit UNION ALL SELECT conv_id, turn, hit, sim, k = 1 FROM a WHERE k <= 2),
d AS (SELECT conv_id, turn, bool_or(best) AS best, max(sim) AS sim FROM c GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, best ORDER BY sim DESC, turn) AS r, count(*) FILTER (best) OVER (PARTITION BY conv_id) AS kept FROM d)
SELECT conv_id, turn, best FROM e WHERE best OR r <= 4 - kept""")
def shortlist(t: Tables) -> DataFrame:
    """K1: keyword hits and the most similar rows of each part; the best of each part is protected, the rest share what is left of four places."""
    s = t.conversations.select("conv_id", "turn", "role", (F.length("text") % 23).alias("sim"), F.contains(F.lower("text"), F.lit("the")).alias("hit"))
    a = sequences.top_per_group(s.where("sim >= 3"), ["conv_id", "role"], [F.col("sim").desc(), F.col("turn")], 2)
    c = s.where("hit").select("conv_id", "turn", "sim", F.lit(False).alias("best")).unionByName(a.select("conv_id", "turn", "sim", (F.col("rank") == 1).alias("best")))
    d = c.groupBy("conv_id", "turn").agg(F.bool_or("best").alias("best"), F.max("sim").alias("sim"))
    e = d.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "best").orderBy(F.col("sim").desc(), "turn"))).withColumn("kept", F.count_if("best").over(Window.partitionBy("conv_id")))
    return e.where(F.col("best") | (F.col("r") <= 4 - F.col("kept"))).select("conv_id", "turn", "best")


@query("""
SELECT kind, (count_if(found))::BIGINT AS found, count(*) AS wanted, count_if(found)::DOUBLE / count(*) AS recall FROM (
  SELECT CASE WHEN toxic = 1 THEN 'must_not' ELSE 'expected' END AS kind, d.doc_id IS NOT NULL AND length(d.text) > 400 AS found FROM labels l LEFT JOIN documents d USING (doc_id)) GROUP BY kind""")
def evaluation_recall(t: Tables) -> DataFrame:
    """Expected and forbidden items that were found."""
    d = t.documents.select("doc_id", (F.length("text") > 400).alias("long"))
    rows = t.labels.join(d, "doc_id", "left").select(F.when(F.col("toxic") == 1, "must_not").otherwise("expected").alias("kind"), F.coalesce("long", F.lit(False)).alias("found"))
    return rows.groupBy("kind").agg(F.count_if("found").alias("found"), F.count("*").alias("wanted")).withColumn("recall", F.col("found").cast("double") / F.col("wanted"))


@query("""
SELECT s_suppkey AS id, arg_min(n_nationkey, n_nationkey) AS source FROM supplier JOIN nation ON starts_with(s_name, 'Supplier#') AND (s_nationkey = n_nationkey OR starts_with(n_name, substr(s_name, 1, 1))) GROUP BY s_suppkey""")
def document_sources(t: Tables) -> DataFrame:
    """The first source of each document by kind or by prefix; sources are a small catalogue."""
    s = t.supplier.where(F.col("s_name").startswith("Supplier#"))
    on = (F.col("s_nationkey") == F.col("n_nationkey")) | F.col("n_name").startswith(F.substr("s_name", F.lit(1), F.lit(1)))
    return s.join(F.broadcast(t.nation), on).groupBy(F.col("s_suppkey").alias("id")).agg(F.min("n_nationkey").alias("source"))


@query("SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, min(doc_id) AS oldest FROM documents GROUP BY source, lang")
def source_counts(t: Tables) -> DataFrame:
    """Documents, characters and the oldest row per source and language."""
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("oldest"))


@query("SELECT 'missing' AS kind, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) UNION ALL SELECT 'unlabelled', doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def rebuild_guard(t: Tables) -> DataFrame:
    """Ids that a rebuild would drop, and ids without a label."""
    d = t.documents.where("doc_id % 3 <> 0").select("doc_id")
    gone = t.labels.select("doc_id").join(d, "doc_id", "left_anti").select(F.lit("missing").alias("kind"), "doc_id")
    return gone.unionByName(d.join(t.labels, "doc_id", "left_anti").select(F.lit("unlabelled").alias("kind"), "doc_id"))


@query("""
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 4 END AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 4 END, o_orderdate::DATE, o_orderkey)::INT AS place FROM orders""")
def review_queue(t: Tables) -> DataFrame:
    """A case's findings by status, then date, then id."""
    s = F.col("o_orderstatus")
    p = F.when(s == "F", 1).when(s == "P", 2).otherwise(4)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(p, F.to_date("o_orderdate"), "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("id"), p.alias("priority"), place.alias("place"))


@query("""
SELECT c_mktsegment AS court, count(*) AS cases, (count_if(c_acctbal < 0))::BIGINT AS pending, sum(n)::BIGINT AS documents FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def library_list(t: Tables) -> DataFrame:
    """Cases per court with pending ones and documents, by a left join."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(n, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("court")).agg(F.count("*").alias("cases"), F.count_if(F.col("c_acctbal") < 0).alias("pending"), F.sum("n").alias("documents"))


@query("""
SELECT id, case_id, payload FROM (SELECT event_id AS id, user_id AS case_id, props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_case_rows(t: Tables) -> DataFrame:
    """The newest stored row of each case."""
    row = F.max_by(F.struct(F.col("event_id").alias("id"), F.col("props").alias("payload")), F.struct("ts", "event_id"))
    return t.events.groupBy(F.col("user_id").alias("case_id")).agg(row.alias("r")).select("r.id", "case_id", "r.payload")


@query("""SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, (count_if((props::JSON->>'k')::BIGINT > 50))::BIGINT AS large FROM events GROUP BY event_type""")
def stored_json(t: Tables) -> DataFrame:
    """JSON payloads read with a stated schema."""
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k > 50).alias("large"))
