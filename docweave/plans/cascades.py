"""Rule cascades on sentences made from rows of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import rules

from .base import Tables, query

SPEAKERS = rules.Speakers(
    statute=r"\b(?:provides|pursuant to|under)\b", report=r"^the court (?:notes|recalls) that the (?:prosecution|defence)\b", party=r"^the (?:prosecution|defence) (?:argues|submits)\b",
    endorsed=r"^the (?:prosecution|defence) rightly\b", goes_on=r"^(?:it|he|she|they) (?:further|also)\b", court=r"^the court (?:finds|holds)\b", recital=r"\bis charged with\b",
    chapters=r"submissions|charges|facts", reasons=r"reasons|assessment",
)
SENTENCES = [
    "The Court finds the account credible.", "The defence argues that the search was unlawful.", "It further relies on the log.", "The defence rightly argues delay.", "Article 14(3) provides:",
    "Everyone has the right to be present.", "The accused is charged with fraud.", "The case was heard in March.", "The Court notes that the prosecution disagrees.",
]
PENALTIES = [
    "The prosecutor requested two years and six months of imprisonment.", "He was sentenced to imprisonment of 18 months.", "The offence is punishable by up to five years in prison.", "The court imposed no prison sentence.",
    "She was sentenced to a fine.", "The crime is punishable by the death penalty.", "The weather was fine.", "The prosecution seeks life imprisonment.", "He was sentenced to prison of 3 to 5 years.",
]


def _sentence(words: list[str], n: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


@query()
def passage_reasons(t: Tables) -> DataFrame:
    """Why passages aren't the court's own reasoning; turns are passages, every fifth is a heading."""
    n = F.xxhash64("conv_id", "turn") % 1000 + 1000
    kind = F.when(F.col("turn") % 5 == 4, "heading").when(F.col("turn") == 0, "header").otherwise("body")
    chapter = F.when(F.col("conv_id") % 4 == 0, "Submissions of the parties").when(F.col("conv_id") % 4 == 1, "Reasons")
    rows = t.conversations.select("conv_id", "turn", kind.alias("kind"), _sentence(SENTENCES, n).alias("text"), chapter.alias("chapter"), (F.col("turn") % 2 == 0).alias("fresh"))
    return rules.classified(rows, "conv_id", "turn", SPEAKERS).select("conv_id", "turn", "kind", "reason")


@query("""
WITH p(k, judgment, stage, kind, least, most) AS (VALUES
  (0, NULL, 'requested', 'imprisonment', 30, 30), (1, true, 'imposed', 'imprisonment', 18, 18), (2, NULL, 'statutory', 'imprisonment', NULL, 60), (4, true, 'imposed', 'fine', NULL, NULL),
  (5, NULL, 'statutory', 'death_penalty', NULL, NULL), (7, NULL, 'requested', 'life_imprisonment', NULL, NULL), (8, true, 'imposed', 'imprisonment', 36, 60))
SELECT o_orderkey, stage, kind, least::DOUBLE AS least, most::DOUBLE AS most FROM orders JOIN p ON o_orderkey % 9 = k AND (judgment IS NULL OR o_orderkey % 2 = 0)""")
def penalty_statements(t: Tables) -> DataFrame:
    """Stage, kind and months of the penalties that sentences state."""
    rows = t.orders.select("o_orderkey", _sentence(PENALTIES, F.col("o_orderkey")).alias("text"), (F.col("o_orderkey") % 2 == 0).alias("judgment"))
    return rules.mapped(rows, rules.penalty, ["text", "judgment"], ["o_orderkey"], "stage string, kind string, least double, most double")


@query(r"""
SELECT o_orderkey AS id, len(c) AS n, coalesce(c[1], '') AS first FROM (SELECT o_orderkey, regexp_extract_all('Under Article ' || o_orderkey || '(2) and s. 4, rule ' || o_custkey || ' or Section 5a',
  '((?:\b(?:Article|Art\.|Section|Sec\.|Rule|Regulation|Paragraph|Para\.|s\.)|§)\s*\d+[A-Za-z]?(?:\(\d+\))*)') AS c FROM orders)""")
def statute_citations(t: Tables) -> DataFrame:
    """Statute citations."""
    text = F.concat(F.lit("Under Article "), F.col("o_orderkey").cast("string"), F.lit("(2) and s. 4, rule "), F.col("o_custkey").cast("string"), F.lit(" or Section 5a"))
    c = rules.citations(text)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.size(c).cast("long").alias("n"), F.coalesce(F.get(c, 0), F.lit("")).alias("first"))


@query("""
WITH a(k, numbers, unreadable) AS (VALUES (0, [1, 3], false), (1, [], false), (2, [2], false), (3, [], true), (4, [4], true), (5, [], false)),
j AS (SELECT o_orderkey, list_sort(list_distinct(x.numbers || y.numbers)) AS n, x.unreadable OR y.unreadable AS u FROM orders JOIN a x ON o_orderkey % 6 = x.k JOIN a y ON o_custkey % 6 = y.k)
SELECT o_orderkey, array_to_string(n, ',') AS numbers, len(n) > 0 AS addressed, len(n) > 0 OR NOT u AS checked FROM j""")
def answer_checks(t: Tables) -> DataFrame:
    """Passages that answers name; an answer that can't be read leaves the argument unchecked."""
    answers = ["P1, P3", "none", "P2: the court answers", "see above", "4 and 9", ""]
    rows = t.orders.select("o_orderkey", F.array(_sentence(answers, F.col("o_orderkey")), _sentence(answers, F.col("o_custkey"))).alias("items"))

    def check(items: list[str]) -> tuple:
        numbers, unreadable = rules.named(items, 5)
        return numbers, bool(numbers), bool(numbers) or not unreadable

    found = rules.mapped(rows, check, ["items"], ["o_orderkey"], "numbers array<bigint>, addressed boolean, checked boolean")
    return found.withColumn("numbers", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ","))


@query()
def bounded_excerpts(t: Tables) -> DataFrame:
    """Windows of a text under a budget."""
    patterns = (r"\bthe of\b", r"Apache|MIT|GNU")
    return rules.mapped(t.documents, lambda x: ([a for a, _ in w], sum(b - a for a, b in w)) if x and (w := rules.excerpts(x, patterns, 3000)) else None, ["text"], ["doc_id"], "starts array<bigint>, used bigint")


@query("""
SELECT f.l_orderkey AS id, count(*) AS kept FROM lineitem f WHERE (f.l_returnflag, f.l_linestatus) IN (('R', 'F'), ('N', 'O')) GROUP BY ALL""")
def compatible_findings(t: Tables) -> DataFrame:
    """Findings whose kind fits their document, by the table of allowed pairs."""
    allowed = t.spark.createDataFrame([("R", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return t.lineitem.join(F.broadcast(allowed), ["l_returnflag", "l_linestatus"], "left_semi").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("kept"))


@query("""
SELECT o_orderkey AS id, regexp_extract(t, 'charged with ([a-z ]+?)(?:,| under|\\.)', 1) AS charge, starts_with(t, 'SYNTHETIC:') AS made_up FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SYNTHETIC: ' ELSE '' END || 'The accused is charged with ' || lower(o_orderpriority) || ' fraud' || CASE WHEN o_orderkey % 3 = 0 THEN ' under Article 3.' ELSE ', as stated.' END AS t FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED')""")
def charge_wording(t: Tables) -> DataFrame:
    """The charge that a sentence words, and the marker of made-up records."""
    rows = t.orders.where("o_orderpriority <> '4-NOT SPECIFIED'")
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "SYNTHETIC: ").otherwise(""), F.lit("The accused is charged with "), F.lower("o_orderpriority"), F.lit(" fraud"), F.when(F.col("o_orderkey") % 3 == 0, " under Article 3.").otherwise(", as stated."))
    return rows.select(F.col("o_orderkey").alias("id"), F.regexp_extract(text, r"charged with ([a-z ]+?)(?:,| under|\.)", 1).alias("charge"), text.startswith("SYNTHETIC:").alias("made_up"))
