"""Unions of ranges against DuckDB: nulls, halves, and equal rows, whose order SQL leaves open."""

import duckdb

from docweave.plans import ORACLE, QUERIES


def _got(spark, folder, rows):
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    got = sorted(map(str, map(tuple, QUERIES["merged_ranges"](spark, str(folder)).collect())))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    return got, c


def test_nulls_and_halves_are_those_of_the_sql(spark, tmp_path):
    rows = [(1, 10, None), (1, 10, 20.0), (1, 25, 3.0), (1, 90, 1.0), (2, None, 5.0), (2, 5, 5.0), (3, 10, 2.5), (3, 13, 3.5), (4, 10, 3.5), (4, 14, 1.0), (None, 1, 1.0), (None, 2, 4.0)]
    got, c = _got(spark, tmp_path, rows)
    assert got == sorted(map(str, c.execute(ORACLE["merged_ranges"]).fetchall()))


def test_equal_rows_are_one_range(spark, tmp_path):
    """Whatever their order, equal rows make no range more and join none that lie apart."""
    rows = [(k, s, q) for k in range(3000) for s, q in ((22, 13.0), (40, 26.0), (40, 26.0), (40, 26.0), (90, 1.0))]
    got, _ = _got(spark, tmp_path, rows)
    assert got == sorted(str((k, *r)) for k in range(3000) for r in ((22, 35), (40, 66), (90, 91)))
