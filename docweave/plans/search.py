"""Text reuse, vectors, linking and search, on documents, benchmark, embeddings, part and lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators import links, reuse, sequences, text, vectors
from docweave.operators.storage import once

from .base import Tables, query

LONG = 400


def passages(t: Tables) -> DataFrame:
    """Lines of documents as reasoning passages, with the code-point offset of each line."""
    rows = text.pieces(t.documents, "doc_id", F.col("text"))
    return rows.select(F.col("id").alias("case_id"), F.col("line").cast("long").alias("passage"), F.col("start").cast("long").alias("start"), "text")


def sources(t: Tables) -> DataFrame:
    return t.benchmark.select(F.lit(0).cast("long").alias("case_id"), F.col("item_id").cast("long").alias("passage"), F.lit(0).cast("long").alias("start"), "text")


_TOKENS = r"""
l AS (SELECT doc_id AS case_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS passage,
  unnest(list_transform(range(len(string_split(text, chr(10)))), lambda i: length(array_to_string(string_split(text, chr(10))[1:i], chr(10))) + (i > 0)::INT)) AS start FROM documents),
w AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM l),
g AS (SELECT case_id, passage, array_to_string(words[k:k + 4], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - 3)) AS k FROM w WHERE len(words) >= 6)),
sw AS (SELECT item_id AS source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM benchmark),
s AS (SELECT source, array_to_string(words[k:k + 4], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - 3)) AS k FROM sw WHERE len(words) >= 6)),
da AS (SELECT DISTINCT case_id, passage, gram FROM g), ds AS (SELECT DISTINCT source, gram FROM s),
na AS (SELECT case_id, passage, count(*) AS n_passage FROM da GROUP BY ALL), ns AS (SELECT source, count(*) AS n_source FROM ds GROUP BY ALL),
p AS (SELECT case_id, passage, source, count(*) AS shared FROM da JOIN ds USING (gram) GROUP BY ALL),
q AS (SELECT *, shared / (n_passage + n_source - shared) AS jaccard, shared / n_passage AS containment FROM p JOIN na USING (case_id, passage) JOIN ns USING (source)),
acc AS (SELECT *, jaccard >= 0.5 AS near FROM q WHERE shared >= greatest(2, 0.1 * n_passage) OR jaccard >= 0.5),
cov AS (SELECT case_id, passage, count(DISTINCT gram) AS covered FROM acc JOIN da USING (case_id, passage) JOIN ds USING (source, gram) GROUP BY ALL),
v AS (SELECT acc.*, covered / n_passage AS passage_containment FROM acc JOIN cov USING (case_id, passage)
  QUALIFY covered / n_passage >= 0.6 OR bool_or(near) OVER (PARTITION BY case_id, passage))"""


@query(f"WITH {_TOKENS.strip()} SELECT case_id, passage, source::BIGINT AS source, shared, n_passage, n_source, jaccard, containment FROM q")
def shingle_overlaps(t: Tables) -> DataFrame:
    """Passages and sources that share a five-word shingle, with exact Jaccard and containment."""
    return reuse.pair_overlaps(once(reuse.shingles(passages(t))), once(reuse.shingles(sources(t))))


@query(f"WITH {_TOKENS.strip()} SELECT case_id, passage, source::BIGINT AS source, shared, round_even(jaccard, 4) AS jaccard, round_even(containment, 4) AS containment, round_even(passage_containment, 4) AS passage_containment FROM v")
def verbatim_reuse(t: Tables) -> DataFrame:
    """A1: passages that copy sources, by the union of the accepted ones."""
    return reuse.verbatim(once(reuse.shingles(passages(t))), once(reuse.shingles(sources(t))))


@query()
def reuse_scores(t: Tables) -> DataFrame:
    """A2, A3, C4: merged covered characters and the share of each document's text that copies."""
    left, right = once(reuse.shingles(passages(t))), once(reuse.shingles(sources(t)))
    ranges = reuse.covered_ranges(left, right, reuse.verbatim(left, right), ["case_id"])
    return reuse.score(ranges, passages(t))


@query("""
WITH r AS (SELECT l_orderkey AS id, (l_partkey % 97) AS start, (l_partkey % 97) + l_quantity::BIGINT AS "end" FROM lineitem),
m AS (SELECT *, sum(b) OVER (PARTITION BY id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, coalesce((start > max("end") OVER (PARTITION BY id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS b FROM r))
SELECT id, min(start) AS start, max("end") AS "end" FROM m GROUP BY id, island""")
def merged_ranges(t: Tables) -> DataFrame:
    """A2: unions of ranges; touching ranges merge."""
    start = F.col("l_partkey") % 97
    # SQL's cast rounds to the nearest, halves to even
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), start.alias("start"), (start + F.rint("l_quantity").cast("long")).alias("end"))
    return sequences.merged_ranges(rows, ["id"], "start", "end")


_STOP = "[" + ", ".join(f"'{w}'" for w in reuse.STOP_WORDS) + "]"


@query(rf"""
SELECT doc_id, len(c) AS n, array_to_string(list_sort(c), ' ') AS words FROM (
  SELECT doc_id, list_filter(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\p{{N}}+'))), lambda w: NOT list_contains({_STOP}, w)) AS c FROM documents)""")
def document_content_words(t: Tables) -> DataFrame:
    """Distinct content words of each document."""
    c = reuse.content_words(F.col("text"))
    return t.documents.select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), F.array_join(F.array_sort("c"), " ").alias("words"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS norm, len(embedding) AS dims FROM embeddings")
def vector_norms(t: Tables) -> DataFrame:
    """V2: lengths of vectors."""
    return t.embeddings.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dims"))


@query("""
WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL)
SELECT label, i::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def facet_mean_vectors(t: Tables) -> DataFrame:
    """The mean vector of each label at length 1."""
    means = vectors.mean_vectors(t.embeddings, ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("d", "x")).select("label", (F.col("d") + 1).alias("dim"), F.round("x", 6).alias("x"))


def _queries(t: Tables, every: int) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


def _side(rows: DataFrame, label: Column | None = None) -> DataFrame:
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.lit(0) if label is None else label).alias("label"))


@query(f"""
SELECT query_id, vec_id, round(c, 4) AS cosine FROM (SELECT a.vec_id AS query_id, b.vec_id, {_DOT.format('a.embedding', 'b.embedding')} AS c, b.label FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) <= 3""")
def wording_matches(t: Tables) -> DataFrame:
    """The three nearest vectors of a stated query set, from a least cosine on."""
    pairs = vectors.paired(_queries(t, 20), t.embeddings).where("query_id <> vec_id").withColumn("c", vectors.clipped(vectors.dot(F.col("q"), F.col("embedding")))).where("c >= 0.3")
    return vectors.top_k(pairs, ["query_id"], [F.col("c").desc(), F.col("vec_id")], 3).select("query_id", "vec_id", F.round("c", 4).alias("cosine"))


_CONTENT = rf"list_filter(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\p{{N}}+'))), lambda w: NOT list_contains({_STOP}, w))"
_DIM = 256


@query(f"""
WITH d AS (SELECT doc_id, {_CONTENT} AS c FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
b AS (SELECT item_id, {_CONTENT} AS c FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(c) AS w FROM d), bw AS (SELECT item_id, unnest(c) AS w FROM b),
dh AS (SELECT doc_id, ('0x' || substr(sha1(w), 1, 8))::BIGINT % {_DIM} AS h, count(*) AS n FROM dw GROUP BY ALL), bh AS (SELECT item_id, ('0x' || substr(sha1(w), 1, 8))::BIGINT % {_DIM} AS h, count(*) AS n FROM bw GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM dh GROUP BY ALL), bn AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM bh GROUP BY ALL),
s AS (SELECT doc_id, item_id, count(*) AS shared_words FROM dw JOIN bw USING (w) GROUP BY ALL HAVING count(*) >= 3),
p AS (SELECT doc_id, item_id, round(sum(dh.n * bh.n) / any_value(dn.l * bn.l), 6) AS cosine, any_value(shared_words) AS shared_words FROM s JOIN dh USING (doc_id) JOIN bh USING (item_id, h) JOIN dn USING (doc_id) JOIN bn USING (item_id) GROUP BY ALL)
SELECT doc_id AS query_id, item_id, cosine, shared_words FROM p WHERE cosine >= 0.35 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, item_id) = 1""")
def paraphrase_matches(t: Tables) -> DataFrame:
    """For a stated set of documents the nearest benchmark text by hashed words over the cosine threshold that also shares three content words.

    Pairs come from the words that they share, so none is scored that can't match.
    """

    def side(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        c = reuse.content_words(F.col("text"))
        rows = rows.where("text IS NOT NULL").select(F.col(key), c.alias("c"))
        return rows.select(key, F.explode("c").alias("w")), rows.select(key, vectors.hashed_words(F.col("c"), _DIM).alias(f"v_{key}"))

    dw, dv = side(t.documents.where("doc_id % 20 = 0"), "doc_id")
    bw, bv = side(t.benchmark, "item_id")
    pairs = dw.join(bw, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared_words")).where("shared_words >= 3")
    scored = pairs.join(dv, "doc_id").join(bv, "item_id").withColumn("cosine", F.round(vectors.dot(F.col("v_doc_id"), F.col("v_item_id")) / (vectors.norm(F.col("v_doc_id")) * vectors.norm(F.col("v_item_id"))), 6))
    best = vectors.top_k(scored.where("cosine >= 0.35"), ["doc_id"], [F.col("cosine").desc(), F.col("item_id")], 1)
    return best.select(F.col("doc_id").alias("query_id"), "item_id", "cosine", "shared_words")


@query(f"""
WITH c AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round_even({_DOT.format('a.embedding', 'b.embedding')}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0),
top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 200)
SELECT query_id, vec_id, cosine, (label % 3) / 3.0 AS share, round(0.75 * cosine + 0.25 * (label % 3) / 3.0, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(0.75 * cosine + 0.25 * (label % 3) / 3.0, 6) DESC, vec_id)::INT AS rank
FROM top QUALIFY rank <= 10""")
def passage_search(t: Tables) -> DataFrame:
    """K4, C11: two hundred candidates by cosine, ranked again with the share of the query's words."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = vectors.paired(q, t.embeddings).withColumn("cosine", F.bround(vectors.dot(F.col("q"), F.col("embedding")), 4))
    top = vectors.top_k(pairs, ["query_id"], [F.col("cosine").desc(), F.col("vec_id")], 200).drop("rank")
    share = (F.col("label") % 3) / 3.0
    top = top.withColumn("share", share).withColumn("score", F.round(vectors.hybrid_score(F.col("cosine"), F.col("share"), 0.25, F.lit(3)), 6))
    return vectors.top_k(top, ["query_id"], [F.col("score").desc(), F.col("vec_id")], 10).select("query_id", "vec_id", "cosine", "share", "score", "rank")


@query(f"""
WITH m AS (SELECT label AS facet, array_agg(x ORDER BY i) AS q FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)
SELECT facet, vec_id % 50 AS precedent, arg_max(vec_id, (c, -vec_id)) AS fact, round(max(c), 4) AS cosine FROM (
  SELECT facet, vec_id, {_DOT.format('q', 'embedding')} / sqrt({_DOT.format('q', 'q')}) AS c FROM m JOIN embeddings ON facet = label) GROUP BY ALL""")
def nearest_facts(t: Tables) -> DataFrame:
    """Per facet and precedent the fact nearest to the facet's mean vector, the earliest on a tie."""
    means = vectors.mean_vectors(t.embeddings, ["label"], "embedding").withColumnRenamed("embedding", "q")
    c = t.embeddings.join(means, "label").withColumn("c", vectors.dot(F.col("q"), F.col("embedding")))
    return c.groupBy(F.col("label").alias("facet"), (F.col("vec_id") % 50).alias("precedent")).agg(F.max_by("vec_id", F.struct("c", -F.col("vec_id"))).alias("fact"), F.round(F.max("c"), 4).alias("cosine"))


@query(f"""
WITH c AS (SELECT a.vec_id AS query_id, b.vec_id, b.vec_id % 40 AS doc, {_DOT.format('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY c DESC, vec_id) AS in_doc FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (in_doc > 2)::INT, c DESC, vec_id)::INT AS place FROM d)
SELECT query_id, vec_id, doc, place FROM f WHERE place <= 6""")
def chat_sources(t: Tables) -> DataFrame:
    """Six sources, at most two of a document before others are exhausted."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    c = vectors.paired(q, t.embeddings).where("query_id <> vec_id").select("query_id", "vec_id", (F.col("vec_id") % 40).alias("doc"), vectors.dot(F.col("q"), F.col("embedding")).alias("c"))
    order = [F.col("c").desc(), F.col("vec_id")]
    d = vectors.top_k(c, ["query_id", "doc"], order, 6)
    f = sequences.top_per_group(d, ["query_id"], [(F.col("rank") > 2).cast("int"), *order], 6, "place")
    return f.select("query_id", "vec_id", "doc", "place")


@query(f"""
WITH c AS (SELECT a.vec_id AS query_id, b.vec_id, b.vec_id % 30 AS reference, {_DOT.format('a.embedding', 'b.embedding')} AS c, len(list_intersect(range(a.vec_id // 20 % 4), range(b.vec_id % 4))) / 3.0 AS overlap FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, reference ORDER BY c DESC, vec_id) AS k FROM c),
r AS (SELECT query_id, reference, round(0.75 * max(c) + 0.25 * max(overlap) FILTER (k = 1), 6) AS score, arg_max(vec_id, (c, -vec_id)) AS best FROM b WHERE k <= 2 GROUP BY ALL)
SELECT query_id, reference, score, best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference)::INT AS rank FROM r QUALIFY rank <= 3""")
def triangulated_references(t: Tables) -> DataFrame:
    """The two best passages of each reference, then three references by cosine and shared indicators."""
    marks = lambda c: F.when(c % 4 > 0, F.sequence(F.lit(0).cast("long"), c % 4 - 1)).otherwise(F.array().cast("array<bigint>"))
    reference = _side(t.embeddings, F.col("vec_id") % 30)
    c = vectors.best_by_label(_side(t.embeddings.where("vec_id % 20 = 0")), reference, 2).withColumnRenamed("label", "reference")
    c = c.withColumn("overlap", F.size(F.array_intersect(marks(F.floor(F.col("query_id") / 20)), marks(F.col("vec_id")))) / 3.0)
    b = vectors.top_k(c, ["query_id", "reference"], [F.col("c").desc(), F.col("vec_id")], 2)
    r = b.groupBy("query_id", "reference").agg(F.round(0.75 * F.max("c") + 0.25 * F.max(F.when(F.col("rank") == 1, F.col("overlap"))), 6).alias("score"), F.max_by("vec_id", F.struct("c", -F.col("vec_id"))).alias("best"))
    return sequences.top_per_group(r, ["query_id"], [F.col("score").desc(), F.col("reference")], 3)


@query(f"""
SELECT o.vec_id, o.label, round(max({_DOT.format('o.embedding', 'f.embedding')}) FILTER (f.label = o.label), 4) AS own, round(max({_DOT.format('o.embedding', 'f.embedding')}) FILTER (f.label <> o.label), 4) AS context,
  max({_DOT.format('o.embedding', 'f.embedding')}) FILTER (f.label <> o.label) > max({_DOT.format('o.embedding', 'f.embedding')}) FILTER (f.label = o.label) AS context_nearer
FROM embeddings o JOIN embeddings f ON o.vec_id % 20 = 0 AND f.vec_id <> o.vec_id GROUP BY ALL""")
def context_resemblance(t: Tables) -> DataFrame:
    """Whether an observation is nearer to a context fact than to its own indicator's."""
    c = vectors.own_and_other(_side(t.embeddings.where("vec_id % 20 = 0"), F.col("label")), _side(t.embeddings, F.col("label")))
    nearer = (F.col("other") > F.col("own")).alias("context_nearer")
    return c.select(F.col("query_id").alias("vec_id"), F.col("label").cast("int").alias("label"), F.round("own", 4).alias("own"), F.round("other", 4).alias("context"), nearer)


_FACETS = "f AS (SELECT DISTINCT l_suppkey AS precedent, p_brand || ' ' || p_type AS facet FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _facet() -> F.Column:
    return F.concat("p_brand", F.lit(" "), "p_type").alias("facet")


def facets(t: Tables) -> DataFrame:
    """A supplier is a precedent, a brand and type a facet."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("precedent"), _facet()).distinct()


def weights(f: DataFrame) -> DataFrame:
    """facet, df and idf."""
    n = f.agg(F.count_distinct("precedent").alias("n"))  # one row
    return f.groupBy("facet").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("facet", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


@query(f"WITH {_FACETS} SELECT facet, count(*) AS df, ln(((SELECT count(DISTINCT precedent) FROM f) + 1) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY facet")
def facet_weights(t: Tables) -> DataFrame:
    """Document frequency and weight of each facet."""
    return weights(facets(t))


@query(f"""
WITH {_FACETS}, d AS (SELECT facet, ln(((SELECT count(DISTINCT precedent) FROM f) + 1) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY facet),
c AS (SELECT DISTINCT l_orderkey AS case_id, p_brand || ' ' || p_type AS facet FROM lineitem JOIN part ON l_partkey = p_partkey),
l AS (SELECT case_id, precedent, count(*) AS shared, round(sum(idf), 6) AS idf_sum FROM c JOIN f USING (facet) JOIN d USING (facet) GROUP BY ALL
  HAVING count(*) >= 2 AND bool_or(facet < 'Brand#3'))
SELECT case_id, precedent, shared, idf_sum, row_number() OVER (PARTITION BY case_id ORDER BY idf_sum DESC, shared DESC, precedent DESC)::INT AS rank FROM l QUALIFY rank <= 8""")
def precedent_links(t: Tables) -> DataFrame:
    """Precedents that share two facets with a case, one of them of procedure; the best eight, ties by descending id."""
    f = once(facets(t))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("case_id"), _facet())
    sets = lines.groupBy("case_id").agg(F.sort_array(F.collect_set("facet")).alias("facets"))
    idf = weights(f).where("facet IS NOT NULL").select("facet", "idf", (F.col("facet") < "Brand#3").alias("procedure"))
    return links.links_of_sets(sets, idf, f.where("facet IS NOT NULL"), 8)
