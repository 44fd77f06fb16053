"""A training corpus from ``documents``: the operators of docweave.llm, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import langid, linededup, mixing, neardup, packing
from docweave.llm.common import discard, tables, written
from docweave.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language can't be told go: texts without letters, and those whose n-grams hardly lean to any language.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those that lean to no language. Null ids and languages stay; labels aren't changed."""
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs.where(F.coalesce(langid.remainder(F.col("doc_id"), 4) != 2, F.lit(False)))))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that five-word shingles with a similarity of 0.8 link: that with the smallest id.

    Null and blank texts and rows without an id stay. Rows that share an id and differ in text are documents of their own; equal ones are one group.
    """
    return neardup.survivors(docs.select(*COLUMNS), k=5, percent=80).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts. A text that only repeats others stays as an empty one; null texts and rows without an id stay as they are."""
    return linededup.dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each row as many copies as the mix takes it: none, one or two.

    Null sources are a source of their own, null texts have size 0, and rows without an id go by their text.
    """
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of 2048. A document that is there twice has its pieces twice; a null or empty text is the end's id alone."""
    pieces = packing.tokenize(docs, tokenizer_path(), capacity=2048, end_id=0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express language identification, MinHash groups, or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written in the shared folder and read again; a stage's own tables go when it is written."""
    docs, at_first = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, at_first, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
