"""Findings, facets, marks, budgets and reports on proxies of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators import findings, sequences, spans

from .base import Tables, query


@query("""
SELECT user_id, event_type, event_id, first_seen, value FROM (SELECT *, min(event_id) OVER w AS first_seen, row_number() OVER (w ORDER BY value DESC, event_id) AS k FROM events WINDOW w AS (PARTITION BY user_id, event_type)) WHERE k = 1""")
def best_event_by_key(t: Tables) -> DataFrame:
    """The best row of each key, with the place where the key was first seen."""
    return findings.best_by_key(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("value").desc()], F.col("event_id"))


@query()
def label_batches(t: Tables) -> DataFrame:
    """Turns of a conversation in batches of at most four and 900 characters."""
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("size"))
    return findings.batches(rows, "conv_id", "turn", "size", 4, 900)


@query("""
WITH m AS (SELECT l_orderkey AS doc, l_partkey % 80 AS start, l_partkey % 80 + l_quantity::BIGINT AS "end", CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority, l_linestatus || l_linenumber AS label FROM lineitem),
i AS (SELECT *, sum(b) OVER (PARTITION BY doc ORDER BY start, "end", label ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, coalesce((start >= max("end") OVER (PARTITION BY doc ORDER BY start, "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS b FROM m WHERE "end" > start))
SELECT doc, min(start) AS start, max("end") AS "end", min(priority) AS priority, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM i GROUP BY doc, island""")
def merged_marks(t: Tables) -> DataFrame:
    """Overlapping marks as one with the strongest kind and all labels."""
    flag = F.col("l_returnflag")
    start = F.col("l_partkey") % 80
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.when(flag == "R", 1).when(flag == "A", 2).otherwise(3).alias("priority"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("label"))
    return findings.merged_marks(rows, "doc")


@query("""
SELECT o_orderkey AS id, CASE WHEN low = high THEN printf('%g hours', low) ELSE printf('between %g and %g days (%g to %g hours)', low / 24, high / 24, low, high) END AS text, printf('%d%%', round(100 * share)::INT) AS percent,
  replace(replace(o_orderpriority, '-', '\\-'), '.', '\\.') AS escaped
FROM (SELECT *, (o_orderkey % 40 * 24)::DOUBLE AS low, (o_orderkey % 40 * 24 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 48 END)::DOUBLE AS high, (o_orderkey % 101) / 100.0 AS share FROM orders)""")
def rendered_messages(t: Tables) -> DataFrame:
    """Durations, percentages and escaped text."""
    low = (F.col("o_orderkey") % 40 * 24).cast("double")
    high = low + F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(48.0)
    percent = F.format_string("%d%%", F.round(100 * (F.col("o_orderkey") % 101) / 100.0).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("id"), findings.duration_text(low, high).alias("text"), percent.alias("percent"), F.regexp_replace("o_orderpriority", r"([-.])", r"\\$1").alias("escaped"))


@query()
def filtered_notes(t: Tables) -> DataFrame:
    """Notes without blocked words."""
    return findings.filtered_notes(t.documents, "doc_id", "text", ["idiot", "moron", "clown", "pathetic", "worthless"])


@query("""
WITH f AS (SELECT l_suppkey AS precedent, p_brand AS facet, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + l_quantity::BIGINT AS pos, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS kind, p_type AS fact FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT precedent, facet, fact, min(pos) AS p FROM f GROUP BY ALL)
SELECT precedent, facet, (SELECT string_agg(fact, '|' ORDER BY p) FROM d WHERE d.precedent = f.precedent AND d.facet = f.facet) AS facts, arg_min(kind, pos) FILTER (kind IS NOT NULL) AS kind FROM f GROUP BY precedent, facet""")
def merged_facets(t: Tables) -> DataFrame:
    """Facts of a facet in order, and the first finding's kind."""
    f = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    f = f.select(F.col("l_suppkey").alias("precedent"), F.col("p_brand").alias("facet"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("pos"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("kind"), F.array("p_type").alias("facts"))
    return findings.merged_items(f, ["precedent", "facet"], "facts", "kind", "pos").withColumn("facts", F.array_join("facts", "|"))


@query("""
SELECT o_custkey AS case_id, k AS standard, arg_min(o_orderkey, seq) AS finding, count(*) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, unnest([o_orderstatus, o_orderpriority]) AS k FROM orders)
WHERE (k IN ('F', 'O') OR k LIKE '1-%') AND o_orderkey % 7 <> 0 GROUP BY ALL""")
def finding_signals(t: Tables) -> DataFrame:
    """Findings joined to the standards that they signal, rejected ones apart; the first finding of each."""
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t.orders.withColumn("seq", seq).withColumn("standard", F.explode(F.array("o_orderstatus", "o_orderpriority")))
    rejected = t.orders.where("o_orderkey % 7 = 0").select("o_orderkey")
    rows = rows.where(F.col("standard").isin("F", "O") | F.col("standard").startswith("1-")).join(rejected, "o_orderkey", "left_anti")
    return rows.groupBy(F.col("o_custkey").alias("case_id"), "standard").agg(F.min_by("o_orderkey", "seq").alias("finding"), F.count("*").alias("findings"))


@query("""
SELECT g.c_custkey AS gold, count(DISTINCT e.event_id) AS events, min(e.event_id) AS first FROM customer g JOIN events e ON e.user_id = g.c_custkey AND ((e.event_type = 'purchase' AND g.c_custkey % 2 = 0) OR (e.value BETWEEN 10 AND 20)) GROUP BY ALL""")
def gold_matches(t: Tables) -> DataFrame:
    """Gold items matched by type or by range, as the distinct union of two joins that each have a key."""
    g, e = t.customer.select(F.col("c_custkey").alias("gold")), t.events.select(F.col("user_id").alias("gold"), "event_id", "event_type", "value")
    one = g.where("gold % 2 = 0").join(e.where("event_type = 'purchase'"), "gold").select("gold", "event_id")
    two = g.join(e.where("value BETWEEN 10 AND 20"), "gold").select("gold", "event_id")
    return one.union(two).distinct().groupBy("gold").agg(F.count("*").alias("events"), F.min("event_id").alias("first"))


@query("""
WITH c AS (SELECT user_id AS case_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events)
SELECT case_id, event_id, event_type, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, event_id)::INT AS rank FROM c WHERE k = 1 QUALIFY rank <= 3""")
def distinct_references(t: Tables) -> DataFrame:
    """The best hit of each reference, then the best three."""
    rows = t.events.select(F.col("user_id").alias("case_id"), "event_id", "event_type", "value")
    order = [F.col("value").desc(), F.col("event_id")]
    return sequences.top_per_group(sequences.top_per_group(rows, ["case_id", "event_type"], order, 1, "k"), ["case_id"], order, 3).select("case_id", "event_id", "event_type", "rank")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS place FROM r WHERE k <= 8""")
def reply_passages(t: Tables) -> DataFrame:
    """The eight best rows, put back in the order of the text."""
    top = sequences.top_per_group(t.events, ["user_id"], [F.col("value").desc(), F.col("event_id")], 8)
    return top.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"))


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
f AS (SELECT conv_id, turn, 2 * k AS p FROM r UNION ALL SELECT conv_id, turn + 1, 2 * k + 1 FROM r WHERE turn < last), d AS (SELECT conv_id, turn, min(p) AS p FROM f GROUP BY ALL)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY p)::INT AS place FROM d QUALIFY place <= 4""")
def argument_passages(t: Tables) -> DataFrame:
    """K3: ranked passages, each followed by its neighbour, the first place of each counting; four of them."""
    w = Window.partitionBy("conv_id")
    r = t.conversations.withColumn("k", F.row_number().over(w.orderBy(F.length("text").desc(), "turn"))).withColumn("last", F.max("turn").over(w))
    f = r.select("conv_id", "turn", (2 * F.col("k")).alias("p")).unionByName(r.where("turn < last").select("conv_id", (F.col("turn") + 1).alias("turn"), (2 * F.col("k") + 1).alias("p")))
    d = f.groupBy("conv_id", "turn").agg(F.min("p").alias("p"))
    return sequences.top_per_group(d, ["conv_id"], [F.col("p")], 4, "place").select("conv_id", "turn", "place")


@query("""
WITH p AS (SELECT a.vec_id AS precedent, b.vec_id % 60 AS paragraph, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id),
s AS (SELECT precedent, count(DISTINCT paragraph) AS support, max(c) AS cosine FROM p WHERE c >= 0.2 GROUP BY precedent)
SELECT precedent, support, round(cosine, 4) AS cosine, row_number() OVER (ORDER BY round(cosine + 0.01 * least(support, 10), 6) DESC, precedent)::INT AS rank FROM s QUALIFY rank <= 5""")
def wording_support(t: Tables) -> DataFrame:
    """Distinct paragraphs that support a precedent, and the five best by cosine and support."""
    from docweave.operators import vectors

    side = lambda rows, label: rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), label.alias("label"))
    # the best of each paragraph, if it supports at all
    c = vectors.best_by_label(side(t.embeddings.where("vec_id % 20 = 0"), F.lit(0)), side(t.embeddings, F.col("vec_id") % 60), 1, 0.2)
    s = c.groupBy(F.col("query_id").alias("precedent")).agg(F.count_distinct("label").alias("support"), F.max("c").alias("cosine"))
    top = s.withColumn("score", F.round(F.col("cosine") + 0.01 * F.least("support", F.lit(10)), 6)).orderBy(F.col("score").desc(), "precedent").limit(5)
    # a report of five rows
    return top.select("precedent", "support", F.round("cosine", 4).alias("cosine"), F.row_number().over(Window.orderBy(F.col("score").desc(), "precedent")).alias("rank"))


@query("""
SELECT c_name AS surname, min(c_mktsegment) AS party FROM (SELECT substr(c_name, length(c_name) - 1) AS c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) GROUP BY c_name HAVING count(DISTINCT c_mktsegment) = 1""")
def counsel_roster(t: Tables) -> DataFrame:
    """Surnames that belong to one party only."""
    rows = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.substr("c_name", F.length("c_name") - 1).alias("surname"), "c_mktsegment")
    return rows.groupBy("surname").agg(F.count_distinct("c_mktsegment").alias("n"), F.min("c_mktsegment").alias("party")).where("n = 1").drop("n")


@query("""
SELECT o_custkey AS case_id, count(*) AS orders, max(o_totalprice) AS score, (count_if(o_orderstatus = 'F'))::BIGINT AS flags, coalesce(max(n), 0)::BIGINT AS notes FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON o_custkey = user_id GROUP BY o_custkey""")
def case_signals(t: Tables) -> DataFrame:
    """Per case its score, flags and notes."""
    n = t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("n"))
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("score"), F.count_if(F.col("o_orderstatus") == "F").alias("flags"))
    return o.join(n, "o_custkey", "left").select(F.col("o_custkey").alias("case_id"), "orders", "score", "flags", F.coalesce("n", F.lit(0).cast("long")).alias("notes"))


@query("""
SELECT doc_id, instr(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(substr(text, 1, 12), '\\s+', '', 'g')) > 0 AND instr(substr(regexp_replace(text, '\\s+', '', 'g'), length(regexp_replace(substr(text, 1, 12), '\\s+', '', 'g')) + 1), regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'zzqq zz' ELSE substr(text, 31, 10) END, '\\s+', '', 'g')) > 0 AS in_order
FROM documents WHERE length(text) > 60""")
def ordered_segments(t: Tables) -> DataFrame:
    """Segments that stand in a source one after another, white space aside."""
    second = F.when(F.col("doc_id") % 3 == 0, "zzqq zz").otherwise(F.substr("text", F.lit(31), F.lit(10)))
    return t.documents.where("length(text) > 60").select("doc_id", findings.in_order(F.array(F.substr("text", F.lit(1), F.lit(12)), second), F.col("text")).alias("in_order"))


@query("""
SELECT doc_id AS id, sha256(text) AS checksum, count(*) OVER (PARTITION BY sha256(text)) AS copies, source = 'src0' AS private, coalesce(source = 'src0', true) AS local_only FROM documents""")
def snapshot_checks(t: Tables) -> DataFrame:
    """Checksums, copies, and the privacy gate that fails closed."""
    sha = F.sha2("text", 256)
    copies = t.documents.groupBy(sha.alias("checksum")).agg(F.count("*").alias("copies"))
    rows = t.documents.select(F.col("doc_id").alias("id"), sha.alias("checksum"), (F.col("source") == "src0").alias("private"))
    return rows.join(copies, "checksum").select("id", "checksum", "copies", "private", F.coalesce("private", F.lit(True)).alias("local_only"))


@query("""
SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey > 20 THEN 'far' END, CASE WHEN c_custkey % 10 = 0 THEN 'round' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer""")
def review_reasons(t: Tables) -> DataFrame:
    """The reasons that hold for a row, as a compact list."""
    reasons = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "negative"), F.when(F.col("c_nationkey") > 20, "far"), F.when(F.col("c_custkey") % 10 == 0, "round")))
    return t.customer.select(F.col("c_custkey").alias("id"), F.array_join(reasons, ",").alias("reasons"))


@query("""
WITH z AS (SELECT o_custkey AS id, list(o_orderdate::DATE ORDER BY o_orderkey) AS d, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus <> 'P') AS k FROM orders GROUP BY o_custkey)
SELECT id, len(d) AS dates, len(k) AS found, CASE WHEN len(d) = len(k) THEN array_to_string(list_transform(list_zip(d, k), lambda p: p[1]::VARCHAR || ':' || p[2]::VARCHAR), ',') END AS zipped FROM z""")
def zipped_dates(t: Tables) -> DataFrame:
    """Dates paired with what was found where their counts agree, else null."""
    row = F.array_sort(F.collect_list(F.struct("o_orderkey", F.to_date("o_orderdate").cast("string").alias("d"))))
    z = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(row, lambda s: s["d"]).alias("d"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))).alias("k"))
    zipped = F.array_join(F.transform(F.arrays_zip("d", "k"), lambda p: F.concat(p["d"], F.lit(":"), p["k"].cast("string"))), ",")
    found = F.nullif(F.size("k"), F.lit(0))
    return z.select("id", F.size("d").cast("long").alias("dates"), found.cast("long").alias("found"), F.when(F.size("d") == F.size("k"), zipped).alias("zipped"))


@query("""
WITH k AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1)
SELECT coalesce(CASE WHEN user_id % 4 <> 0 THEN t::DATE::VARCHAR END, 'u' || user_id) AS hearing, count(*) AS n FROM k GROUP BY 1""")
def hearing_keys(t: Tables) -> DataFrame:
    """Dated notes by date, undated ones by their own id."""
    k = t.events.groupBy("user_id").agg(F.min("ts").alias("t"))
    key = F.coalesce(F.when(F.col("user_id") % 4 != 0, F.to_date("t").cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return k.groupBy(key.alias("hearing")).agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, regexp_matches(text, '(?i)\\bthe\\b') AS burden, regexp_matches(text, '(?i)\\band\\b') AS statement, NOT bool_or(regexp_matches(text, '(?i)\\bthe\\b|\\band\\b')) OVER (PARTITION BY conv_id)
  AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3 AS discussion FROM conversations""")
def focus_screens(t: Tables) -> DataFrame:
    """Passages screened by patterns; where none matched in a case, its first three are discussion."""
    w = Window.partitionBy("conv_id")
    any_ = F.bool_or(F.col("text").rlike(r"(?i)\bthe\b|\band\b")).over(w)
    return t.conversations.select("conv_id", "turn", F.col("text").rlike(r"(?i)\bthe\b").alias("burden"), F.col("text").rlike(r"(?i)\band\b").alias("statement"), (~any_ & (F.row_number().over(w.orderBy("turn")) <= 3)).alias("discussion"))


@query("""
SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN lead(l_linenumber) OVER w = l_linenumber + 1 AND lead(l_returnflag) OVER w <> l_returnflag THEN l_quantity * 12 + lead(l_quantity) OVER w END AS months
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)""")
def adjacent_durations(t: Tables) -> DataFrame:
    """Years and months that follow each other, as months."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    follows = (F.lead("l_linenumber").over(w) == F.col("l_linenumber") + 1) & (F.lead("l_returnflag").over(w) != F.col("l_returnflag"))
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.when(follows, F.col("l_quantity") * 12 + F.lead("l_quantity").over(w)).alias("months"))


@query("""
WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 60 AS s, l_partkey % 60 + l_quantity AS e FROM lineitem)
SELECT a.id, a.n, count(b.n) AS inside, CASE WHEN count(b.n) = 1 THEN min(b.n) END AS single FROM c a LEFT JOIN c b ON a.id = b.id AND a.n <> b.n AND b.s >= a.s AND b.e <= a.e WHERE a.n = 1 GROUP BY ALL""")
def contained_dates(t: Tables) -> DataFrame:
    """Spans inside another of the same document, and the only one if there is one."""
    c = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 60).alias("s"), (F.col("l_partkey") % 60 + F.col("l_quantity")).alias("e"))
    a, b = c.where("n = 1"), c.select(F.col("id").alias("b_id"), F.col("n").alias("m"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    j = a.join(b, (F.col("id") == F.col("b_id")) & (F.col("n") != F.col("m")) & (F.col("b_s") >= F.col("s")) & (F.col("b_e") <= F.col("e")), "left")
    return j.groupBy("id", "n").agg(F.count("m").alias("inside"), F.min("m").alias("m")).select("id", "n", "inside", F.when(F.col("inside") == 1, F.col("m")).alias("single"))


@query("""
SELECT o_custkey AS case_id, o_orderkey AS position, count(*) AS kept, (count(*) - count(DISTINCT l_partkey % 10))::DOUBLE / count(*) AS share FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def renewal_shares(t: Tables) -> DataFrame:
    """The share of an order's grounds that stood in earlier ones."""
    w = Window.partitionBy("o_orderkey", F.col("l_partkey") % 10).orderBy("l_linenumber")
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("again", F.row_number().over(w) > 1)
    out = rows.groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("position")).agg(F.count("*").alias("kept"), F.count_if("again").alias("repeated"))
    return out.select("case_id", "position", "kept", F.try_divide(F.col("repeated").cast("double"), F.col("kept")).alias("share"))


@query("""
SELECT o_orderkey AS id, o_custkey IS NOT NULL AS known, o_totalprice >= 0 AS priced, o_orderstatus IN ('F', 'O', 'P') AS coded, o_orderdate IS NOT NULL AS dated FROM orders""")
def record_violations(t: Tables) -> DataFrame:
    """The rules that a record keeps or breaks, as columns."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").isNotNull().alias("known"), (F.col("o_totalprice") >= 0).alias("priced"), F.col("o_orderstatus").isin("F", "O", "P").alias("coded"), F.col("o_orderdate").isNotNull().alias("dated"))


@query("""
SELECT c_custkey AS id, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS fingerprint FROM customer""")
def fingerprints(t: Tables) -> DataFrame:
    """Fingerprints of records as JSON, by which stored results are known to be stale."""
    return t.customer.select(F.col("c_custkey").alias("id"), F.sha2(F.to_json(F.struct("c_custkey", "c_mktsegment")), 256).alias("fingerprint"))


@query("SELECT k AS id FROM (SELECT DISTINCT user_id AS k FROM events) WHERE k IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)")
def pruned_keys(t: Tables) -> DataFrame:
    """Exactly the keys that are used."""
    used = t.customer.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"))
    return t.events.select(F.col("user_id").alias("id")).distinct().join(used, "id", "left_semi")


@query("""
SELECT event_type AS module, count(*) AS n, (count_if(value > 50))::BIGINT AS shown, count(DISTINCT user_id) AS cases, 'Over ' || count(DISTINCT user_id) || ' cases, ' || count(*) || ' findings.' AS line FROM events GROUP BY event_type""")
def report_lines(t: Tables) -> DataFrame:
    """Counts by module, rendered as the lines of a report."""
    e = t.events.groupBy(F.col("event_type").alias("module")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("shown"), F.count_distinct("user_id").alias("cases"))
    return e.withColumn("line", F.format_string("Over %d cases, %d findings.", "cases", "n"))


@query("""
SELECT id, (count_if(ok))::BIGINT AS good, bool_and(ok) AS intact FROM (SELECT l_orderkey AS id, substr(sha256(l_orderkey || chr(31) || l_linenumber), 1, 16) <> '' AND l_quantity > 0 AS ok FROM lineitem) GROUP BY id""")
def corpus_assembly(t: Tables) -> DataFrame:
    """Documents whose every part is there."""
    ok = (spans.stable_id(F.col("l_orderkey"), F.col("l_linenumber")) != "") & (F.col("l_quantity") > 0)
    return t.lineitem.select(F.col("l_orderkey").alias("id"), ok.alias("ok")).groupBy("id").agg(F.count_if("ok").alias("good"), F.bool_and("ok").alias("intact"))
