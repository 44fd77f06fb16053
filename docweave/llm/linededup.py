"""Substring deduplication by hashing lines.

A unit is a line, cut further where its own words say so: before a word whose hash is the smallest of the words around it, so that the same
passage falls into the same units wherever in a line it was pasted, and units hold about seven words. Units are normalised
(case, white space) and hashed; digests are grouped over all documents, and the earliest occurrence by document rank and position is
kept. Of the other occurrences, those in a run of neighbouring ones with at least ``min_words`` words in all are removed, so that a
short line that many documents happen to share stays. At a run's ends, units that occur more than ``COMMON`` times as often as the run's
median word are no part of it: a common heading above a repeated passage stays too. Where such units have ``min_words`` words or more at one end,
they are a run of their own: a popular passage beside a rarer one goes, and fewer than ``min_words`` words stay at either end. Removed spans
keep the offsets that they had in the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, prepare, tables, written
from .neardup import mixed, text_key, word_hashes

#: Words on either side among which a cut's hash is the smallest.
REACH = 3
MIN_WORDS = 30
COMMON = 1.25

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def units(text: bytes, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, words, digest) of the units of a text in UTF-8. White space between units belongs to none."""
    lower = text.lower()
    words = lower.split()
    none = np.empty(0, np.int64)
    if not words:
        return none, none, none, np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    # a word that follows a line end begins a line
    line = np.cumsum(data == 10)[start]
    new_line = np.r_[True, line[1:] != line[:-1]]
    # the smallest hash of the words around it in its line; of equal ones none is, so repeated words are not cut at
    number = np.cumsum(new_line)
    smallest = np.ones(len(h), bool)
    for step in range(1, reach + 1):
        if step >= len(h):
            break
        same = number[step:] == number[:-step]
        smallest[step:] &= ~same | (h[step:] < h[:-step])
        smallest[:-step] &= ~same | (h[:-step] < h[step:])
    first = np.flatnonzero(new_line | smallest)
    last = np.r_[first[1:], len(h)] - 1
    digest = np.zeros(len(first), np.uint64)
    size = last - first + 1
    # words are mixed with their place in the unit, then summed
    place = np.arange(len(h)) - np.repeat(first, size)
    digest = np.add.reduceat(mixed(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), first)
    return start[first], end[last], size, mixed(digest + size.astype(np.uint64))


def unit_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, unit, words, digest of every unit of every text."""
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [units((t or "").encode("utf-8")) for t in batch.column(2).to_pylist()]
        n = [len(f[0]) for f in found]
        at = pa.array(np.repeat(np.arange(len(n)), n))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array(np.concatenate([np.arange(k) for k in n]).astype(np.int32)),
                pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
                pa.array(np.concatenate([f[3] for f in found]).view(np.int64)),
            ],
            names=["doc_id", "text_key", "unit", "words", "digest"],
        )

    source = docs.select(docs[id_col].alias("doc_id"), text_key(docs[text_col]).alias("text_key"), docs[text_col].cast("string").alias("text"))
    return map_batches(source.where("doc_id IS NOT NULL AND text IS NOT NULL"), rows, f"doc_id {id_type}, text_key long, unit int, words int, digest long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and units: the repeats among a text's units, with their words and counts, for texts that have some.

    Texts are cut into units once, and the units written. Digests are counted before they meet their units again, and the earliest occurrence
    comes with the count. A text goes by its id and its key, so that other texts of the same id are not cut by it.
    """
    spark, at_first = docs.sparkSession, tables()
    rows = written(unit_rows(docs, id_col, text_col), "units")
    place = F.struct("doc_id", "text_key", "unit")
    earliest = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that it comes to the join by a shuffle of its own and a digest that very many units share can be split
    again = rows.join(written(earliest, "earliest"), "digest").where(place != F.col("first"))
    again = again.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("unit", "words", "n"))).alias("units"))
    again = written(again, "repeats")
    discard(spark, at_first, again)
    return again


def _stretches(size: np.ndarray, n: np.ndarray, first: int, last: int, min_words: int, whole: bool) -> list[tuple[int, int]]:
    """The stretches to remove of the neighbouring units from ``first`` to ``last``. If ``whole``, they all go where no ``min_words`` are left between common ends."""
    words = int(size[first:last].sum())
    if words < min_words:
        return []
    order = first + np.argsort(n[first:last], kind="stable")
    median = n[order][np.searchsorted(np.cumsum(size[order]), words / 2)]
    own = first + np.flatnonzero(n[first:last] <= COMMON * median)
    left, right = int(own[0]), int(own[-1]) + 1
    middle = [(left, right)]
    if size[left:right].sum() < min_words:
        if whole:
            return [(first, last)]
        middle = []
    # what is trimmed occurs more often than the median by a factor, so this ends soon
    return _stretches(size, n, first, left, min_words, True) + middle + _stretches(size, n, right, last, min_words, True)


def runs(numbers: np.ndarray, words: np.ndarray, often: np.ndarray, min_words: int) -> np.ndarray:
    """The numbers of the units in runs of neighbouring ones that have ``min_words`` words or more, without common units at their ends.

    Common units at an end that have ``min_words`` words or more themselves are a run of their own.
    """
    out = []
    cuts = np.flatnonzero(np.diff(numbers) > 1) + 1
    for number, size, n in zip(np.split(numbers, cuts), np.split(words, cuts), np.split(often, cuts), strict=True):
        out += [number[a:b] for a, b in _stretches(size, n, 0, len(number), min_words, False)]
    return np.concatenate(out) if out else numbers[:0]


def cut(text: str, removed: np.ndarray, numbers: tuple[np.ndarray, np.ndarray]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the removed units, and the spans (code points) taken out: each from its first unit to its last."""
    start, end = numbers
    data = text.encode("utf-8")
    first = np.flatnonzero(np.r_[True, np.diff(removed) > 1])
    last = np.r_[first[1:], len(removed)] - 1
    parts, spans, at, chars = [], [], 0, 0
    for a, b in zip(start[removed[first]].tolist(), end[removed[last]].tolist(), strict=True):
        kept = data[at:a].decode("utf-8")
        gone = data[a:b].decode("utf-8")
        parts.append(kept)
        spans.append((chars + len(kept), chars + len(kept) + len(gone)))
        chars += len(kept) + len(gone)
        at = b
    parts.append(data[at:].decode("utf-8"))
    joined = parts[0]
    for part in parts[1:]:
        # the white space on both sides of a removed span becomes that of one side: a line end if there was one
        left, right = joined.rstrip(), part.lstrip()
        gap = joined[len(left) :] + part[: len(part) - len(right)]
        joined = left + (("\n" if "\n" in gap else " ") if left and right else "") + right
    return joined, spans


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text left after removal, and n_removed, removed_chars and removed_spans (start and end code points in the whole text).

    Ranks are ids, then text keys and positions, smallest first. Null and blank texts stay as they are, and so do texts without repeats; rows
    without an id are neither searched nor changed. A text that only repeats others becomes empty. Rows that share an id and text are one
    document and cut alike; rows that share an id alone are documents of their own. Columns of the added names are replaced; all others are kept.
    """
    prepare(docs.sparkSession)
    added = ["n_removed", "removed_chars", "removed_spans", "repeats_"]
    base = docs.drop(*added)
    if base.schema[text_col].dataType.simpleString() != "string":
        base = base.withColumn(text_col, F.col(text_col).cast("string"))
    gone = repeated(base, id_col, text_col).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.col("units").alias("repeats_"))
    joined = base.join(gone, (base[id_col] == gone["id_"]) & (text_key(base[text_col]) == gone["key_"]), "left").drop("id_", "key_")
    at, names = base.columns.index(text_col), base.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["n_removed int, removed_chars long, removed_spans array<struct<start:int,end:int>>"])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, taken, chars, spans = [], [], [], []
        for text, found in zip(batch.column(at).to_pylist(), batch.column(len(names)), strict=True):
            removed, out = (), []
            if found.is_valid:
                removed = runs(*(b.to_numpy().astype(np.int64) for b in found.values.flatten()), min_words)
            if len(removed):
                # only texts that lose something are cut into units again
                start, end, _, _ = units((text or "").encode("utf-8"))
                text, out = cut(text, removed, (start, end))
            texts.append(text)
            taken.append(len(removed))
            chars.append(sum(b - a for a, b in out))
            spans.append([{"start": a, "end": b} for a, b in out])
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(taken, pa.int32()), pa.array(chars, pa.int64()), pa.array(spans, pa.list_(span))],
            names=[*names, *added[:3]],
        )

    return map_batches(joined, rows, schema)
