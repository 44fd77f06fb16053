"""File sources, versioned sinks and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docweave.operators import sequences
from docweave.sources import files
from docweave.streaming import decisions


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "case.yaml").write_text("id: x")
    (tmp_path / "a" / "note.txt").write_bytes("﻿SYNTHETIC: made up\r\ncafé\r\n".encode())
    (tmp_path / "a" / "b" / "case.yaml").write_text("id: y")
    (tmp_path / "a" / "b" / "empty.md").write_bytes(b"")
    (tmp_path / "a" / "b" / "bad.exe").write_bytes(b"\xff\xfe")
    rows = files.problems(files.scan(spark, str(tmp_path)))
    assert {r.path: (r.depth, r.problem) for r in rows.collect()} == {"a/case.yaml": (1, None), "a/note.txt": (1, None), "a/b/case.yaml": (2, None), "a/b/bad.exe": (2, "kind")}
    assert [tuple(r) for r in files.roots(rows).collect()] == [("a/case.yaml", 1, None)]
    text = files.marked(files.decoded(rows).withColumn("synthetic", F.lit(True)), "text", "synthetic").where("path = 'a/note.txt'").first()
    assert (text.text, text.consistent) == ("café\n", True)
    assert files.decode(b"a\xff") == "a�" and files.decode(None) == ""


def test_pages_join(spark):
    df = spark.createDataFrame([(["One sentence.", "Two halves of", " ", "a sentence"],)], "p array<string>")
    assert df.select(files.joined_pages(F.col("p"))).first()[0] == "One sentence.\n\nTwo halves of\na sentence"


def test_staged_uploads(spark):
    df = spark.createDataFrame([(1, f"f{k}", 10) for k in range(3)] + [(2, "big", 100), (3, "ok", 5)], "upload int, path string, length long")
    got = {r.upload: r.upload_problem for r in files.staged(df, 2, 50).collect()}
    assert got == {1: "too many files", 2: "too large", 3: None}


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    for n in (2, 5):
        files.write_version(spark.range(n), root)
    assert files.read_version(spark, root).count() == 5


def test_streams(spark, tmp_path):
    log = [(1, 1, "accepted"), (1, 2, "reopened"), (2, 3, "rejected"), (1, 4, "edited")]
    schema = "flag_id long, id long, decision string"
    spark.createDataFrame(log[:3], schema).write.parquet(f"{tmp_path}/log")
    kept = {}

    def keep(rows, number):
        kept.update({r.flag_id: r.decision for r in rows.collect()})

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
        q = decisions.to_table(decisions.in_force(stream), keep, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    assert kept == {1: "reopened", 2: "rejected"}
    spark.createDataFrame(log[3:], schema).write.mode("append").parquet(f"{tmp_path}/log")
    run()
    batch = sequences.in_force(spark.read.schema(schema).parquet(f"{tmp_path}/log"), ["flag_id"], "id", "decision")
    assert kept == {r.flag_id: r.decision for r in batch.collect()} == {1: "edited", 2: "rejected"}


def test_windowed_counts(spark):
    at = dt.datetime(2025, 1, 1, 5)
    df = spark.createDataFrame([(at, "a"), (at, "a"), (at + dt.timedelta(days=1), "b")], "ts timestamp, kind string")
    assert sorted((r.kind, r.n) for r in decisions.counted(df, "ts", "kind").collect()) == [("a", 2), ("b", 1)]


def test_corpus_of_another_build_is_refused(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([("schema", "3"), ("model", "m")], "name string, value string").write.parquet(f"{path}/meta")
    spark.createDataFrame([(1, "a")], "id long, text string").write.parquet(f"{path}/rows")
    assert files.read_checked(spark, path, {"schema": "3"}, {"id": "bigint"}).count() == 1
    with pytest.raises(ValueError, match="schema is '3'"):
        files.read_checked(spark, path, {"schema": "4", "model": "m"}, {})
    with pytest.raises(ValueError, match="text string"):
        files.read_checked(spark, path, {"schema": "3"}, {"text": "binary"})


def test_manifests_are_plain_mappings():
    assert files.safe_mapping("a: 1\nb: [x, {c: d}]") == {"a": 1, "b": ["x", {"c": "d"}]}
    for bad in ("a: &x [1]\nb: *x", "a: 1\na: 2", "a: {b: 1, b: 2}", "- 1", "a: !!python/object/apply:os.getcwd []", "? [1]\n: 2"):
        with pytest.raises(Exception):  # noqa: B017
            files.safe_mapping(bad)
