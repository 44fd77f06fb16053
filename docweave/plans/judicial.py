"""Rates per judge on orders: a customer is a case, an order a ruling, its status the code, a nation the judge, the customer's region the court."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.intervals import family_z, z_value
from docweave.operators import rates

from .base import Tables, query

RATES = [
    rates.Rate("final_first", ("F", "P", "O"), ("F",), "first"),
    rates.Rate("open_last", ("F", "O"), ("O",), "last"),
    rates.Rate("pending_any", ("F", "P", "O"), ("P",), "any"),
    rates.Rate("final_all", ("F", "O"), ("F",), "all"),
]
#: Rates times market segments: what the SQL has quantiles for.
MOST = 20
ALPHA = 0.05


def rulings(t: Tables) -> DataFrame:
    """One order in four was decided by another nation, one in nine has an unconfirmed judge; every case's data is of one kind."""
    case = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t.orders.join(case, F.col("o_custkey") == F.col("c_custkey"))
    judge = F.when(F.col("o_orderkey") % 9 != 0, F.when(F.col("o_orderkey") % 4 == 0, (F.col("c_nationkey") + 5) % 25).otherwise(F.col("c_nationkey")))
    return o.select(
        F.col("o_custkey").alias("case_id"),
        F.col("n_regionkey").alias("place"),
        F.col("c_mktsegment").alias("charge"),
        judge.alias("judge"),
        F.col("o_orderstatus").alias("code"),
        F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("date"),
        (F.col("o_orderkey") % 3).alias("doc"),
        (F.col("o_orderkey") % 3).alias("doc_order"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_totalprice").alias("value"),
    )


_RULINGS = """
r AS (
  SELECT o_custkey AS case_id, n_regionkey AS place, c_mktsegment AS charge,
    CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN (c_nationkey + 5) % 25 ELSE c_nationkey END END AS judge,
    o_orderstatus AS code, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS date, o_orderkey % 3 AS doc, o_orderkey AS pos, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def _sql_set(codes: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


def _sql_ordered(rate: rates.Rate) -> str:
    """Cases of a first or last rate with their outcome and decider, by a window over each case's rulings."""
    way = "" if rate.combine == "first" else "DESC"
    return f"""
SELECT place, charge, case_id, hit AS counted, judge AS decider FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY
      CASE WHEN undated = 0 THEN coalesce(date, DATE '9999-12-31') WHEN placed THEN NULL ELSE CASE WHEN all_undated THEN DATE '2000-01-01' ELSE date END END {way} NULLS LAST, doc {way}, pos {way}) AS k,
    bool_and(undated = 0 OR placed OR date IS NOT NULL OR (hit = pick_hit AND coalesce(judge, -1) = pick_judge)) OVER (PARTITION BY case_id) AS known
  FROM (
    SELECT *, first_value(hit) OVER p AS pick_hit, first_value(coalesce(judge, -1)) OVER p AS pick_judge FROM (
      SELECT *, count(*) FILTER (date IS NULL) OVER c AS undated, count(date) OVER c = 0 AS all_undated,
        min(doc) OVER c = max(doc) OVER c AND bool_and(fits) OVER c AS placed
      FROM (
        SELECT *, code IN {_sql_set(rate.numerator)} AS hit,
          coalesce(date >= max(date) OVER (PARTITION BY case_id ORDER BY doc, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fits
        FROM r WHERE code IN {_sql_set(rate.denominator)}
      ) WINDOW c AS (PARTITION BY case_id)
    ) WINDOW p AS (PARTITION BY case_id ORDER BY (date IS NULL AND NOT all_undated)::INT, date {way} NULLS LAST, doc {way}, pos {way})
  )
) WHERE k = 1 AND known"""


def _sql_counts(rate: rates.Rate) -> str:
    if rate.combine in ("first", "last"):
        return f"""
SELECT '{rate.id}' AS rate_id, a.place, a.charge, a.judge, a.n, a.k,
  (SELECT count(*) FROM d_{rate.id} b WHERE b.place = a.place AND b.charge = a.charge AND b.decider <> a.judge) AS base_n,
  (SELECT count(*) FROM d_{rate.id} b WHERE b.place = a.place AND b.charge = a.charge AND b.decider <> a.judge AND counted) AS base_k,
  (SELECT count(DISTINCT decider) FROM d_{rate.id} b WHERE b.place = a.place AND b.charge = a.charge AND b.decider <> a.judge) AS base_judges
FROM (SELECT place, charge, decider AS judge, count(*) AS n, count_if(counted) AS k FROM d_{rate.id} WHERE decider IS NOT NULL GROUP BY ALL) a"""
    return f"""
SELECT '{rate.id}' AS rate_id, a.place, a.charge, a.judge, a.n, a.k, count(b.case_id) AS base_n, count(b.case_id) FILTER (b.counted) AS base_k, count(DISTINCT b.decider) AS base_judges
FROM (SELECT place, charge, judge, count(*) AS n, count_if(counted) AS k FROM o_{rate.id} GROUP BY ALL) a
LEFT JOIN d_{rate.id} b ON a.place = b.place AND a.charge = b.charge
  AND NOT EXISTS (SELECT 1 FROM sits s WHERE s.case_id = b.case_id AND s.judge = a.judge)
GROUP BY ALL"""


def _sql_any(rate: rates.Rate, by: str) -> str:
    want = "true" if rate.combine == "any" else "false"
    return f"""
SELECT DISTINCT ON ({by}) {by}, hit AS counted, judge AS decider FROM (
  SELECT *, code IN {_sql_set(rate.numerator)} AS hit FROM r WHERE judge IS NOT NULL AND code IN {_sql_set(rate.denominator)}
) ORDER BY {by}, (hit = {want}) DESC, coalesce(date, DATE '9999-12-31'), doc, pos"""


def _sql() -> str:
    parts = [_RULINGS.strip(), "sits AS (SELECT DISTINCT case_id, judge FROM r WHERE judge IS NOT NULL)"]
    for rate in RATES:
        if rate.combine in ("first", "last"):
            parts.append(f"d_{rate.id} AS ({_sql_ordered(rate)})")
        else:
            parts += [f"d_{rate.id} AS ({_sql_any(rate, 'place, charge, case_id')})", f"o_{rate.id} AS ({_sql_any(rate, 'place, charge, judge, case_id')})"]
    parts.append("c AS (" + " UNION ALL ".join(_sql_counts(rate) for rate in RATES) + ")")
    parts.append("s AS (SELECT *, n >= 5 AND base_n >= 5 AS shown FROM c)")
    parts.append("f AS (SELECT *, sum(shown::INT) OVER (PARTITION BY place, judge)::BIGINT AS compared FROM s)")
    parts.append(f"g AS (SELECT *, {z_value(1 - ALPHA)!r}::DOUBLE AS z, ([{', '.join(f'{z!r}::DOUBLE' for z in family_z(ALPHA, MOST))}])[greatest(compared, 1)::INT] AS zk FROM f)")

    def bounds(k: str, n: str, z: str) -> tuple[str, str]:
        p = f"({k}::DOUBLE / {n})"
        centre = f"({p} + {z} * {z} / (2.0 * {n})) / (1 + {z} * {z} / {n})"
        half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n})"
        return f"(CASE WHEN {k} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, {centre} - {half}) END)", f"(CASE WHEN {k} = {n} THEN 1.0::DOUBLE ELSE least(1.0, {centre} + {half}) END)"

    low, high = bounds("k", "n", "z")
    base_low, base_high = bounds("base_k", "base_n", "z")
    l1, h1 = bounds("k", "n", "zk")
    l2, h2 = bounds("base_k", "base_n", "zk")
    p1, p2 = "(k::DOUBLE / n)", "(base_k::DOUBLE / base_n)"
    parts.append(f"h AS (SELECT *, {l1} AS l1, {h1} AS h1, {l2} AS l2, {h2} AS h2 FROM g WHERE shown)")
    parts.append(f"i AS (SELECT *, {p1} - {p2} - sqrt(({p1} - l1) ** 2 + (h2 - {p2}) ** 2) AS diff_low, {p1} - {p2} + sqrt((h1 - {p1}) ** 2 + ({p2} - l2) ** 2) AS diff_high FROM h)")
    return f"""
WITH {", ".join(parts)}
SELECT place, charge, judge, rate_id, n, base_n, base_judges, shown, compared, {p1} AS rate, {low} AS ci_low, {high} AS ci_high,
  {p2} AS base_rate, {base_low} AS base_low, {base_high} AS base_high, diff_low, diff_high, diff_low > 0 OR diff_high < 0 AS pattern
FROM i
UNION ALL
SELECT place, charge, judge, rate_id, n, base_n, base_judges, shown, compared, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE NOT shown"""


@query(_sql())
def judge_rate_indicators(t: Tables) -> DataFrame:
    """Rates per judge, charge and rate against the peers of the same court, with intervals and patterns."""
    return rates.indicators(rulings(t), RATES, minimum=5, alpha=ALPHA)


@query(f"""
WITH {_RULINGS.strip()}
SELECT place, charge, judge, code, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) >= 5 AS shown,
  CASE WHEN count(DISTINCT case_id) >= 5 THEN count(*) END AS n, CASE WHEN count(DISTINCT case_id) >= 5 THEN min(value) END AS least,
  CASE WHEN count(DISTINCT case_id) >= 5 THEN max(value) END AS largest, CASE WHEN count(DISTINCT case_id) >= 5 THEN avg(value) END AS mean
FROM r WHERE code = 'F' AND judge IS NOT NULL GROUP BY place, charge, judge, code""")
def judge_descriptive(t: Tables) -> DataFrame:
    """Numeric codes per judge and charge, hidden under five cases."""
    return rates.descriptive(rulings(t), ["F"], minimum=5)


@query(f"""
WITH {_RULINGS.strip()}, d AS ({_sql_ordered(RATES[0])})
SELECT DISTINCT case_id FROM r WHERE code IN ('F', 'P', 'O') AND case_id NOT IN (SELECT case_id FROM d)""")
def judge_order_unknown(t: Tables) -> DataFrame:
    """Cases left out because undated rulings leave their order unknown."""
    return rates.order_unknown(rulings(t), RATES[0])
