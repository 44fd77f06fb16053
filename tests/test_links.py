"""Links from cases to precedents against DuckDB: rare facets, nulls, several blocks, ties."""

import random

import duckdb
import numpy as np
import pytest

from docweave.operators import links
from docweave.plans import ORACLE, QUERIES
from docweave.plans.search import facets, weights


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Facets from very common to those of one precedent, orders of one row to sixty, nulls in keys and names."""
    folder, r = tmp_path_factory.mktemp("links"), random.Random(5)
    parts = [(k, f"Brand#{1 + k % 5}", f"T{k % 40}") for k in range(200)] + [(200, None, "T1"), (201, "Brand#1", None), (202, "Brand#1", "R1"), (203, "Brand#2", "R2")]
    rows = [(o, min(int(r.expovariate(0.03)), 201), r.randrange(90)) for o in range(0, 2000, 4) for _ in range(60 if o == 400 else r.randrange(1, 8))]
    rows += [(None, 3, 5), (20, None, 6), (40, 3, None), (60, 7, None), (80, 200, 7), (100, 201, 8), (10000, 202, None), (10000, 203, None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    c = duckdb.connect()
    for name in ("part", "lineitem"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return str(folder), c


def _plain(rows):
    return sorted([(*r[:3], round(r[3], 6), r[4]) for r in rows], key=lambda r: (r[0], r[4]))


def test_precedent_links_are_those_of_the_sql(spark, small):
    folder, c = small
    want = c.execute(ORACLE["precedent_links"]).fetchall()
    assert len(want) > 500 and any(r[1] is None for r in want) and len({r[2] for r in want}) > 3
    assert _plain(QUERIES["precedent_links"](spark, folder).collect()) == _plain(want)


def test_facets_with_a_null_part(spark, small):
    folder, c = small
    plain = lambda rows: sorted((str(r[0]), r[1], round(r[2], 6)) for r in rows)
    assert plain(QUERIES["facet_weights"](spark, folder).collect()) == plain(c.execute(ORACLE["facet_weights"]).fetchall())


def test_blocks_do_not_matter(spark, small):
    from pyspark.sql import functions as F

    from docweave.plans.base import Tables

    t = Tables(spark, small[0])
    f = facets(t)
    rows = t.lineitem.where("l_orderkey % 20 = 0").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cases = rows.select(F.col("l_orderkey").alias("case_id"), F.concat("p_brand", F.lit(" "), "p_type").alias("facet")).distinct().join(weights(f), "facet")
    cases = cases.select("case_id", "facet", "idf", (F.col("facet") < "Brand#3").alias("procedure"))
    known = f.where("facet IS NOT NULL")
    got = _plain(links.best_links(cases, known, 8, 300).collect())
    assert links.posting_blocks(known, 300).count() > 3
    assert got and got == _plain(links.best_links(cases, known, 8).collect())


def test_common_facets_make_no_pairs():
    """Every precedent has every facet: the places come without any being scored."""
    own = links.Block(list(range(999, -1, -1)), ["a", "b", "c"], [1000] * 3, np.tile(np.arange(1000, dtype="<i4"), 3).tobytes())
    assert own.with_all(["a", "b", "c"], 8).tolist() == list(range(8))


def test_every_order_is_a_case(spark, tmp_path):
    """Orders of any id, null too, most of whose links are found at once, some of which have no facet of procedure or one that few precedents have."""
    r = random.Random(8)
    parts = [(k, f"Brand#{1 + k % 5}", f"T{k}") for k in range(20)]
    rows = [(None, k, s) for s in range(150) for k in range(20) if k < 18 and r.random() < 0.9 or s % 40 == k]
    rows = [(1_000 + n, k, s) for n, (_, k, s) in enumerate(rows)] + [(o, k, 5) for o in range(1, 300, 3) for k in r.sample(range(20), r.randrange(1, 7))]
    rows += [(None, 1, 5), (None, 2, 6), (-7, 1, 5), (-7, 0, 5), (301, 2, 5), (301, 3, 5)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for name in ("part", "lineitem"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    plain = lambda rows: sorted(map(str, ((*x[:3], round(x[3], 6), x[4]) for x in rows)))
    got = QUERIES["precedent_links"](spark, str(tmp_path)).collect()
    assert {None, -7, 4, 7} <= {x[0] for x in got} and 301 not in {x[0] for x in got}
    assert plain(got) == plain(c.execute(ORACLE["precedent_links"]).fetchall())


def test_sets_do_not_depend_on_the_blocks(spark, tmp_path):
    """What is found at once in one block, in several and by scoring is the same."""
    r = random.Random(9)
    names = [f"f{k}" for k in range(9)]
    known = spark.createDataFrame([(p, f) for p in range(400) for f in names if r.random() < 0.7], "precedent long, facet string")
    weights = spark.createDataFrame([(f, 1 + k / 10, k % 3 == 0) for k, f in enumerate(names)], "facet string, idf double, procedure boolean")
    sets = spark.createDataFrame([(c, sorted(r.sample(names, r.randrange(1, 10)))) for c in range(500)], "case_id long, facets array<string>")
    of = {p: set() for p in range(400)}
    for p, f in known.collect():
        of[p].add(f)
    want = []
    for case, facets in sets.collect():
        shared = [(p, [f for f in facets if f in of[p]]) for p in of]
        scored = [(-round(sum(1 + int(f[1:]) / 10 for f in s), 6), -len(s), -p) for p, s in shared if len(s) >= 2 and any(int(f[1:]) % 3 == 0 for f in s)]
        want += [(case, -p, -n, -total, k) for k, (total, n, p) in enumerate(sorted(scored)[:8], 1)]
    for most in (300, links.BLOCK):
        assert _plain(links.links_of_sets(sets, weights, known, 8, most).collect()) == _plain(want)
