"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from docweave.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that the smallest tables have no rows for.
MAY_BE_EMPTY = {"shingle_overlaps", "verbatim_reuse"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    got = duck.execute(ORACLE[name])
    columns, want = [d[0] for d in got.description], got.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, rows) == _rows(columns, want)
    assert rows or name in MAY_BE_EMPTY


def _spans(spark, name):
    by = {}
    for r in QUERIES[name](spark, SF).orderBy("id", "n").collect():
        by.setdefault(r.id, []).append((r.start, r.end))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return by, texts


def test_sentences_cover_texts(spark):
    """Spans in order, without white space around, that leave out nothing but white space; one ends at a mark, a blank line or the end."""
    by, texts = _spans(spark, "sentence_spans")
    for i, text in texts.items():
        spans, at = by.get(i, []), 0
        for start, end in spans:
            assert text[at:start].strip() == "" and text[start:end].strip() == text[start:end] != ""
            at = end
        assert text is None or text[at:].strip() == ""
        for (_, end), (start, _) in zip(spans, spans[1:], strict=False):
            assert text[:end].rstrip("\"'”’»)]")[-1] in ".!?" or "\n" in text[end:start]


@pytest.mark.parametrize(("name", "size", "least"), [("chunk_spans", 2500, 0), ("passage_spans", 800, 80), ("bounded_spans", 700, 40), ("search_passage_spans", 800, 120)])
def test_groups_are_whole_sentences(spark, name, size, least):
    sentences, texts = _spans(spark, "sentence_spans")
    by, _ = _spans(spark, name)
    for i, spans in by.items():
        starts, ends = {a for a, _ in sentences[i]}, {b for _, b in sentences[i]}
        for start, end in spans:
            single = any(a <= start and end <= b for a, b in sentences[i])
            assert end - start >= least and (end - start <= size or single)
            assert name == "bounded_spans" or (start in starts and (end in ends or single))
        if name == "chunk_spans":
            assert spans[0][0] == sentences[i][0][0] and spans[-1][1] == sentences[i][-1][1]
            assert all(b[0] <= a[1] + 2 or texts[i][a[1] : b[0]].strip() == "" for a, b in zip(spans, spans[1:], strict=False))


def test_located_quotes_are_what_was_asked(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["located_quotes"](spark, SF).collect()
    found = [r for r in rows if r.start is not None]
    assert len(rows) == sum(len(t) > 100 for t in texts.values()) and len(found) > 0.9 * len(rows)
    for r in found:
        own, quote = texts[r.doc_id][r.start : r.end], texts[r.doc_id][10:70]
        if r.match in ("exact", "normalized"):
            assert " ".join(own.split()) == " ".join(quote.strip().rstrip(".,;:").split()).strip("\"'“”‘’")
        else:
            assert r.score >= 90 and abs(len(own) - len(quote)) < 30


def test_places_are_taken_once(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = {}
    for r in QUERIES["placed_quotes"](spark, SF).collect():
        by.setdefault(r.id, {})[r.n] = r
    for i, rows in by.items():
        assert sorted(rows) == [0, 1, 2, 3] and rows[3].start is None
        exact = [(r.start, r.end) for r in rows.values() if r.match == "exact"]
        assert len(set(exact)) == len(exact)
        if texts[i].count(texts[i][10:50].strip()) == 1 and rows[0].match == "exact":
            assert rows[2].match != "exact"


def test_reuse_scores_on_a_small_case(spark, tmp_path):
    source = "the quick brown fox jumps over the lazy dog tonight again"
    docs = [(1, f"{source}\nnothing else is here at all today friends"), (2, "no words of it stand in this other text"), (3, f"before {source}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, source)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.case_id: (r.verbatim_chars, r.score) for r in QUERIES["reuse_scores"](spark, str(tmp_path)).collect()}
    chars = {i: sum(map(len, t.split("\n"))) for i, t in docs}
    assert got == {1: (len(source), len(source) / chars[1]), 2: (0, 0.0), 3: (len(source), len(source) / chars[3])}


def test_registry_outcomes_add_up(spark):
    from docweave.plans.people import names
    from docweave.plans.base import Tables

    rows = QUERIES["judge_registry"](spark, SF).collect()
    assert len(rows) == names(Tables(spark, SF)).count()
    shown = {(r.place, r.display_name) for r in rows if r.status == "registered"}
    for r in rows:
        assert (r.status == "registered") == (r.judge_id is not None) == (r.reason is None)
        if r.reason in ("initials only", "close to a registered name", "same name, years apart from its other cases"):
            assert (r.place, r.candidate) in shown
    assert all(r.reason == "only a title" for r in rows if r.raw_name == "The Presiding Judge" and r.status == "pending")
