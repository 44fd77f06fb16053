"""Timelines, intervals, order chains, decisions and evaluation, on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import sequences, timeline

from .base import Tables, query

_EVENTS = """
e AS (
  SELECT user_id AS case_id, event_type AS type, event_id AS seq, CASE WHEN event_id % 13 <> 0 THEN ts END AS ts,
    CASE event_id % 5 WHEN 0 THEN 'datetime' WHEN 4 THEN 'month' ELSE 'date' END AS precision, event_id % 7 = 0 AS needs_review
  FROM events
)"""


def events(t: Tables) -> DataFrame:
    """A user is a case; every thirteenth mention has no date, and precision and review marks follow the id."""
    i = F.col("event_id")
    precision = F.when(i % 5 == 0, "datetime").when(i % 5 == 4, "month").otherwise("date")
    return t.events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("type"), i.alias("seq"), F.when(i % 13 != 0, F.col("ts").cast("timestamp")).alias("ts"), precision.alias("precision"), (i % 7 == 0).alias("needs_review"))


@query(f"""
WITH {_EVENTS.strip()}, u AS (SELECT *, ts IS NOT NULL AND precision IN ('date', 'datetime') AS usable, CASE WHEN type IN ('view', 'click') AND ts IS NOT NULL THEN ts::DATE END AS group_day FROM e)
SELECT case_id, type, group_day, count(*) AS mentions, min(ts) FILTER (usable) AS ts,
  coalesce(arg_min(precision, (ts, seq)) FILTER (usable), 'unknown') AS precision,
  CASE WHEN count(DISTINCT CASE WHEN usable THEN ts::DATE END) = 0 THEN 'undated' WHEN count(DISTINCT CASE WHEN usable THEN ts::DATE END) > 1 THEN 'conflict'
    WHEN bool_or(needs_review) THEN 'needs_review' ELSE 'ok' END AS state,
  coalesce(string_agg(DISTINCT CASE WHEN usable THEN (ts::DATE)::VARCHAR END, ',' ORDER BY CASE WHEN usable THEN (ts::DATE)::VARCHAR END), '') AS candidate_dates
FROM u GROUP BY case_id, type, group_day""")
def event_timeline(t: Tables) -> DataFrame:
    """Mentions merged into timeline events with state and candidate dates."""
    return timeline.timeline(events(t), ("view", "click"))


def _measure_sql(start: str, end: str, threshold: str, confirmed: str) -> str:
    pairs = """
SELECT s.case_id, s.lo, s.hi, arg_min(e.lo, (e.lo, e.seq)) AS e_lo, arg_min(e.hi, (e.lo, e.seq)) AS e_hi
FROM {0} s JOIN {0} e ON s.case_id = e.case_id AND s.type = '{1}' AND e.type = '{2}' AND e.hi >= s.lo GROUP BY s.case_id, s.seq, s.lo, s.hi"""
    hours = "round_even({} / 3.6e9, 2)"
    return f"""
WITH {_EVENTS.strip()}, b AS (
  SELECT *, CASE precision WHEN 'datetime' THEN ts ELSE date_trunc('day', ts) END AS lo, CASE precision WHEN 'datetime' THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS hi,
    bool_and(needs_review) OVER (PARTITION BY case_id, type) AS none_clean
  FROM e WHERE ts IS NOT NULL AND precision IN ('date', 'datetime') AND type IN ('{start}', '{end}')
), c AS (SELECT * FROM b WHERE NOT needs_review OR none_clean),
review AS (SELECT case_id, bool_or(none_clean) AS review FROM b GROUP BY case_id),
p AS ({pairs.format('c', start, end)}), q AS ({pairs.format('b', start, end)}),
m AS (SELECT case_id, greatest({hours.format('min(epoch_us(e_lo) - epoch_us(hi))')}, 0) AS low, {hours.format('max(epoch_us(e_hi) - epoch_us(lo))')} AS high FROM p GROUP BY case_id),
n AS (SELECT case_id, greatest({hours.format('min(epoch_us(e_lo) - epoch_us(hi))')}, 0) AS all_low FROM q GROUP BY case_id)
SELECT case_id, low, high, CASE WHEN low IS NOT NULL THEN coalesce(all_low, low) END AS all_low,
  CASE WHEN low IS NULL THEN 'cannot_compute' WHEN {threshold} IS NULL THEN 'measured' WHEN NOT {confirmed} OR review THEN 'needs_review'
    WHEN high <= {threshold} THEN 'within_benchmark' WHEN low > {threshold} AND coalesce(all_low, low) <= {threshold} THEN 'needs_review'
    WHEN low > {threshold} THEN 'exceeds_benchmark' ELSE 'may_exceed' END AS status
FROM (SELECT DISTINCT case_id FROM e) LEFT JOIN review USING (case_id) LEFT JOIN m USING (case_id) LEFT JOIN n USING (case_id)"""


@query(_measure_sql("signup", "purchase", "48.0", "true"))
def clock_confirmed(t: Tables) -> DataFrame:
    """Intervals between signups and purchases against a confirmed threshold."""
    return timeline.measure(events(t), "signup", "purchase", 48.0, True)


@query(_measure_sql("view", "error", "72.0", "false"))
def clock_unconfirmed(t: Tables) -> DataFrame:
    """A threshold that isn't confirmed can't be exceeded."""
    return timeline.measure(events(t), "view", "error", 72.0, False)


@query(_measure_sql("signup", "error", "NULL::DOUBLE", "true"))
def clock_measured(t: Tables) -> DataFrame:
    """No threshold, so the interval is measured only."""
    return timeline.measure(events(t), "signup", "error", None, True)


def orders(t: Tables) -> DataFrame:
    """An order's end is thirty days after it; every seventh has none."""
    day = F.to_date("o_orderdate")
    return t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), day.alias("date"), F.when(F.col("o_orderkey") % 7 != 0, F.date_add(day, 30)).alias("until"))


@query("""
SELECT o_custkey AS case_id, o_orderkey AS doc_id, d AS date, until, (d - lag(d) OVER w)::INT AS days_since_previous,
  CASE WHEN d - lag(until) OVER w - 1 >= 1 THEN (d - lag(until) OVER w - 1)::INT END AS gap_days, (row_number() OVER w)::INT AS position
FROM (SELECT *, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + 30 END AS until FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)""")
def order_gaps(t: Tables) -> DataFrame:
    """Each order with the days since the previous one and the days that no order covers."""
    return sequences.coverage_gaps(orders(t), "case_id", ["date", "doc_id"], "date", "until")


@query("""
SELECT o_custkey AS case_id, o_orderkey AS doc_id, d AS date FROM (
  SELECT *, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS k FROM orders) WHERE k > 1""")
def extension_events(t: Tables) -> DataFrame:
    """Every dated order after a case's first one."""
    rows = sequences.coverage_gaps(orders(t), "case_id", ["date", "doc_id"], "date", "until")
    return rows.where("position > 1").select("case_id", "doc_id", "date")


@query("""
SELECT l.o_custkey AS case_id, l.o_orderkey AS later, count(e.o_orderkey) AS earlier, max(e.o_orderkey) AS last_earlier
FROM orders l JOIN orders e ON l.o_custkey = e.o_custkey AND (e.o_orderdate, e.o_orderkey) < (l.o_orderdate, l.o_orderkey) GROUP BY ALL""")
def earlier_orders(t: Tables) -> DataFrame:
    """Each order's earlier orders of the same case, counted by a running window instead of a self-join."""
    from pyspark.sql import Window

    w = Window.partitionBy("case_id").orderBy("at", "later").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("later"), F.col("o_orderdate").alias("at"))
    return rows.withColumn("earlier", F.count("*").over(w)).withColumn("last_earlier", F.max("later").over(w)).where("earlier > 0").drop("at")


@query("""
WITH o AS (SELECT o_custkey AS name, o_orderkey AS case_id, o_orderdate::DATE AS first, o_orderdate::DATE + (o_orderkey % 40)::INT AS last FROM orders),
p AS (SELECT *, sum(b) OVER (PARTITION BY name ORDER BY first, case_id) AS period FROM (
  SELECT *, coalesce((first - max(last) OVER (PARTITION BY name ORDER BY first, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 180)::INT, 1) AS b FROM o)),
s AS (SELECT name, period, count(DISTINCT case_id) AS n FROM p GROUP BY ALL)
SELECT name, case_id, first, last, period::BIGINT AS period, period = (SELECT arg_max(period, (n, -period)) FROM s WHERE s.name = p.name) AS main FROM p""")
def career_periods(t: Tables) -> DataFrame:
    """A name's cases cut where over 180 days lie between them; the largest period is the main one."""
    day = F.to_date("o_orderdate")
    rows = t.orders.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("case_id"), day.alias("first"), F.date_add(day, (F.col("o_orderkey") % 40).cast("int")).alias("last"))
    return sequences.periods(rows, ["name"], "first", "last", "case_id", 180)


_LOG = """
l AS (SELECT user_id AS flag_id, event_id AS id, CASE event_type WHEN 'error' THEN 'reopened' WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'edited' ELSE 'rejected' END AS decision,
  CASE user_id % 5 WHEN 0 THEN 'absence' WHEN 1 THEN 'clock' WHEN 2 THEN 'reuse' WHEN 3 THEN 'judges' ELSE 'renewal' END AS module FROM events)"""


def decisions(t: Tables) -> DataFrame:
    """Events as decisions on a user's finding, in order of their id; errors reopen."""
    kind, u = F.col("event_type"), F.col("user_id") % 5
    decision = F.when(kind == "error", "reopened").when(kind == "view", "accepted").when(kind == "click", "edited").otherwise("rejected")
    module = F.when(u == 0, "absence").when(u == 1, "clock").when(u == 2, "reuse").when(u == 3, "judges").otherwise("renewal")
    return t.events.select(F.col("user_id").alias("flag_id"), F.col("event_id").alias("id"), decision.alias("decision"), module.alias("module"))


@query(f"""
WITH {_LOG.strip()} SELECT flag_id, id, decision, module FROM l QUALIFY row_number() OVER (PARTITION BY flag_id ORDER BY id DESC) = 1 AND decision <> 'reopened'""")
def decisions_in_force(t: Tables) -> DataFrame:
    """The latest decision of each finding, none if it was reopened."""
    return sequences.in_force(decisions(t), ["flag_id"], "id", "decision")


@query(f"""
WITH {_LOG.strip()}, c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY flag_id ORDER BY id DESC) = 1 AND decision <> 'reopened'),
f AS (SELECT c_custkey AS flag_id, CASE c_custkey % 5 WHEN 0 THEN 'absence' WHEN 1 THEN 'clock' WHEN 2 THEN 'reuse' WHEN 3 THEN 'judges' ELSE 'renewal' END AS module FROM customer WHERE c_custkey % 3 <> 0)
SELECT f.module, count(*) AS findings, count(c.flag_id) AS reviewed, count_if(decision = 'accepted')::BIGINT AS accepted, count_if(decision = 'edited')::BIGINT AS edited, count_if(decision = 'rejected')::BIGINT AS rejected,
  CASE WHEN count(c.flag_id) > 0 THEN (count_if(decision IN ('accepted', 'edited')))::DOUBLE / count(c.flag_id) END AS kept_share
FROM f LEFT JOIN c USING (flag_id) GROUP BY f.module""")
def feedback_summary(t: Tables) -> DataFrame:
    """Findings, decisions in force and the share kept, per module."""
    force = sequences.in_force(decisions(t), ["flag_id"], "id", "decision").select("flag_id", "decision")
    u = F.col("c_custkey") % 5
    module = F.when(u == 0, "absence").when(u == 1, "clock").when(u == 2, "reuse").when(u == 3, "judges").otherwise("renewal")
    findings = t.customer.where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("flag_id"), module.alias("module"))
    out = findings.join(force, "flag_id", "left").groupBy("module").agg(
        F.count("*").alias("findings"), F.count("decision").alias("reviewed"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "edited", "rejected"))
    )
    return out.withColumn("kept_share", F.try_divide((F.col("accepted") + F.col("edited")).cast("double"), F.col("reviewed")))


@query(f"""
WITH {_LOG.strip()}, c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY flag_id ORDER BY id DESC) = 1 AND decision <> 'reopened')
SELECT flag_id, decision FROM c WHERE flag_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)""")
def stale_decisions(t: Tables) -> DataFrame:
    """Decisions in force on findings that aren't shown any more."""
    shown = t.customer.where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("flag_id"))
    return sequences.in_force(decisions(t), ["flag_id"], "id", "decision").select("flag_id", "decision").join(shown, "flag_id", "left_anti")


@query(f"""
WITH {_LOG.strip()}, c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY flag_id ORDER BY id DESC) = 1 AND decision <> 'reopened')
SELECT CASE WHEN decision = 'rejected' THEN 'rejected' ELSE 'kept' END AS verdict, CASE WHEN k IS NOT NULL THEN 'shown' ELSE 'gone' END AS presence, count(*) AS n
FROM c LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) ON flag_id = k GROUP BY ALL""")
def regression_buckets(t: Tables) -> DataFrame:
    """Kept and rejected findings that the current analysis still shows or no longer does."""
    shown = t.customer.where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("flag_id"), F.lit("shown").alias("presence"))
    rows = sequences.in_force(decisions(t), ["flag_id"], "id", "decision").join(shown, "flag_id", "left")
    verdict = F.when(F.col("decision") == "rejected", "rejected").otherwise("kept")
    return rows.groupBy(verdict.alias("verdict"), F.coalesce("presence", F.lit("gone")).alias("presence")).agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey AS case_id, o_orderkey AS finding, 'F' || row_number() OVER (PARTITION BY o_custkey ORDER BY min(l_linenumber), o_orderkey) AS number
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY o_custkey, o_orderkey""")
def finding_numbers(t: Tables) -> DataFrame:
    """Findings of a case numbered by their first citation."""
    from pyspark.sql import Window

    cited = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("first"))
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("case_id")).join(cited, "o_orderkey")
    number = F.concat(F.lit("F"), F.row_number().over(Window.partitionBy("case_id").orderBy("first", "o_orderkey")))
    return rows.select("case_id", F.col("o_orderkey").alias("finding"), number.alias("number"))


@query("""
SELECT c_nationkey AS country, count(*) AS records, count_if(o_orderstatus <> 'P')::BIGINT AS eligible, count_if(o_orderstatus = 'F')::BIGINT AS violations, count_if(o_orderstatus = 'P')::BIGINT AS inadmissible,
  CASE WHEN count_if(o_orderstatus <> 'P') >= 5 THEN count_if(o_orderstatus = 'F')::DOUBLE / count_if(o_orderstatus <> 'P') END AS rate
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def outcome_summary(t: Tables) -> DataFrame:
    """Outcomes by country; a rate only from five records on the merits."""
    s = F.col("o_orderstatus")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("country")).agg(
        F.count("*").alias("records"), F.count_if(s != "P").alias("eligible"), F.count_if(s == "F").alias("violations"), F.count_if(s == "P").alias("inadmissible")
    )
    return rows.withColumn("rate", F.when(F.col("eligible") >= 5, F.col("violations").cast("double") / F.col("eligible")))


@query("""
SELECT o_custkey AS case_id, o_orderpriority AS stage, CASE WHEN count(DISTINCT label) FILTER (specific) > 1 THEN 'ambiguous' ELSE coalesce(arg_min(label, o_orderkey) FILTER (specific), arg_min(label, o_orderkey)) END AS penalty
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'fine' WHEN 'O' THEN 'imprisonment' ELSE 'other' END AS label, o_orderstatus <> 'P' AS specific FROM orders) GROUP BY ALL""")
def penalty_summary(t: Tables) -> DataFrame:
    """Per case and stage the first specific label, ambiguous if there are several, else the first label."""
    s = F.col("o_orderstatus")
    label, specific = F.when(s == "F", "fine").when(s == "O", "imprisonment").otherwise("other"), s != "P"
    rows = t.orders.withColumn("label", label).groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("stage")).agg(
        F.count_distinct(F.when(specific, F.col("label"))).alias("n"), F.min_by("label", F.when(specific, F.col("o_orderkey"))).alias("own"), F.min_by("label", "o_orderkey").alias("any")
    )
    return rows.select("case_id", "stage", F.when(F.col("n") > 1, "ambiguous").otherwise(F.coalesce("own", "any")).alias("penalty"))


@query("""
SELECT o_custkey AS case_id, count(*) AS orders, count(DISTINCT o_orderstatus) AS kinds, string_agg(DISTINCT o_orderdate::DATE::VARCHAR, ',' ORDER BY o_orderdate::DATE::VARCHAR) AS dates
FROM orders GROUP BY o_custkey""")
def name_occurrences(t: Tables) -> DataFrame:
    """Distinct occurrences with their sorted distinct dates."""
    return t.orders.groupBy(F.col("o_custkey").alias("case_id")).agg(
        F.count("*").alias("orders"), F.count_distinct("o_orderstatus").alias("kinds"), F.concat_ws(",", F.sort_array(F.collect_set(F.to_date("o_orderdate").cast("string")))).alias("dates")
    )
