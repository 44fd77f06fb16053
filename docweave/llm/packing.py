"""Best-fit packing of token sequences by best-two-fit over length counts.

Two pieces of the same length are interchangeable, so bins are planned from the count of each length, of which there are at most
``capacity``, and not from the rows. A plan is a list of patterns, each a multiset of lengths and how many bins have it: fill a bin
greedily with the largest length that fits; when none does, replace the bin's smallest piece by two unpacked pieces that fill the
gap more tightly than it did; repeat the bin for as long as the counts last. The plan's size depends on ``capacity`` alone.
Rows then find their place by rank: rows count themselves by length in each written task, a prefix sum over the tasks makes the
ranks global, and each length's ranks run through the plan's patterns in order. No row is compared with another.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_batches, prepare, written

#: Distinct words whose ids a worker keeps at most, those met lately.
CACHE_WORDS = 300_000
#: Code points of the longest word that is kept; longer ones are encoded each time they come.
LONG_WORD = 64


class Encoder:
    """Texts to ids. Words meet no white space, so a word's ids don't depend on others: each distinct word is encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        for begin in range(0, len(words), 50_000):
            some = words[begin : begin + 50_000]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            data, ends = np.array(got.ids, "<u4").tobytes(), np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some)), side="right") * 4
            start = 0
            for word, end in zip(some, ends.tolist(), strict=True):
                self.words[word] = data[start:end]
                start = end

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, and the end). Nulls have none. The tokenizer drops white space."""
        texts = pc.fill_null(texts, "")
        # ASCII case doesn't count, but in the names of special tokens; a token ends between a letter and a mark that is no apostrophe
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        words = pc.list_flatten(split).dictionary_encode()
        # far faster than to_pylist, which makes a scalar of each
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.old = {}, self.words
        new = [name for name in names if name not in self.words]
        self.words.update((name, self.old[name]) for name in new if name in self.old)
        self.learn([name for name in new if name not in self.old])
        known = [self.words[name] for name in names]
        for name in new:
            if len(name) > LONG_WORD:
                del self.words[name]
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        code = words.indices.to_numpy()
        per_word = size[code]
        ends = np.cumsum(per_word)
        ids = flat[np.repeat(begin[code] - ends + per_word, per_word) + np.arange(ends[-1] if len(ends) else 0)]
        at = split.offsets.to_numpy()
        return ids, np.r_[0, ends][at - at[0]]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary file."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its text's ids and then ``end_id``; a null or empty text has ``end_id`` alone. Documents of more than ``capacity``
    ids are cut into pieces of that many, the last one shorter. Repeated rows give repeated pieces.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def rows(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        at, piece, start, pieces = [], [], [], []
        held = 0

        def done() -> None:
            nonlocal held
            out.append(
                pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(p) // 4 for p in pieces], pa.int64()), pa.array(pieces, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
            )
            held = 0
            for x in (at, piece, start, pieces):
                x.clear()

        ids, at_text = encoder(tokenizer_path)(batch.column(1))
        for k in range(batch.num_rows):
            data = ids[at_text[k] : at_text[k + 1]].tobytes() + end
            for n, begin in enumerate(range(0, len(data), width)):
                at.append(k)
                piece.append(n)
                start.append(begin // 4)
                pieces.append(data[begin : begin + width])
                held += len(pieces[-1])
                if held > 16 << 20:
                    done()
        if at:
            done()
        return out

    out = map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), rows, f"doc_id {id_type}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("doc_id", id_col)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces of it in each of these bins), ...]), ...] for pieces of 1 to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1 to {capacity}")
        left[length] = n
    patterns = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return patterns
        used: dict[int, int] = {}
        gap = capacity
        # greedy: the largest length that fits, as often as it fits
        for length in there[::-1].tolist():
            if length <= gap:
                k = min(gap // length, int(left[length]))
                used[length] = k
                gap -= k * length
            if not gap:
                break
        if gap and len(used):
            # best two: swap the smallest piece for two unpacked ones that fit its gap more tightly
            small = min(used)
            room = gap + small
            spare = left.copy()
            for length, k in used.items():
                spare[length] -= k
            low = np.flatnonzero(spare[: room + 1] > 0)
            low = low[low > 0]
            if len(low):
                partner = low[np.maximum(np.searchsorted(low, room - low, side="right") - 1, 0)]
                both = low + partner
                both[(both > room) | ((partner == low) & (spare[low] < 2))] = -1
                best = int(both.argmax())
                if both[best] > small:
                    used[small] -= 1
                    for length in (int(low[best]), int(partner[best])):
                        used[length] = used.get(length, 0) + 1
                    if not used[small]:
                        del used[small]
        bins = min(int(left[length]) // k for length, k in used.items())
        for length, k in used.items():
            left[length] -= bins * k
        patterns.append((bins, sorted(used.items(), reverse=True)))


class Slots:
    """A plan as arrays by length: where the ranks of each run begin, its first bin, pieces in a bin, and first offset."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]) -> None:
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        first = 0
        for bins, items in patterns:
            offset = 0
            for length, k in items:
                by.setdefault(length, []).append((ranks.get(length, 0), first, k, offset))
                ranks[length] = ranks.get(length, 0) + bins * k
                offset += k * length
            first += bins
        self.bins = first
        self.by = {length: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for length, runs in by.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces with these lengths and ranks among the pieces of their length."""
        to, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            size = int(length[rows[0]])
            starts, first, k, offset = self.by[size]
            run = np.searchsorted(starts, rank[rows], side="right") - 1
            inside = rank[rows] - starts[run]
            to[rows] = first[run] + inside // k[run]
            at[rows] = offset[run] + inside % k[run] * size
        return to, at


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences have no gaps and at most ``capacity`` ids, and are as few as best-two-fit makes them.

    Pieces are written once. Columns of the names sequence_id, offset, task and rank in ``pieces`` are replaced; all others are
    kept. Lengths that are null, under 1 or over ``capacity`` raise an error. An empty table stays empty.
    """
    spark = pieces.sparkSession
    prepare(spark)
    pieces = pieces.drop("sequence_id", "offset", "task", "rank").withColumn(length_col, F.col(length_col).cast("long"))
    at = pieces.columns.index(length_col)
    schema = StructType([*pieces.schema.fields, StructField("task", LongType()), StructField("rank", LongType())])
    names = [f.name for f in schema]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column(at).null_count:
                raise ValueError("a length is null")
            length = batch.column(at).to_numpy(zero_copy_only=False)
            if length.min() < 1 or length.max() > capacity:
                raise ValueError(f"a length is not in 1 to {capacity}")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(new, np.diff(np.r_[new, len(length)])) + seen[ordered]
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task)), pa.array(rank)], names=names)

    rows = written(pieces.mapInArrow(counted, schema), "pieces")
    each = rows.groupBy("task", length_col).agg(F.count("*").alias("n"))
    each = each.withColumn("before", F.sum("n").over(Window.partitionBy(length_col).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    each = written(each, "counts")
    # at most ``capacity`` rows
    counts = {r[0]: r[1] for r in each.groupBy(length_col).agg(F.sum("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(plan(counts, capacity)))
    before = each.select(F.col("task").alias("of_task"), F.col(length_col).alias("of_length"), F.coalesce("before", F.lit(0)).alias("before"))
    # as many rows as tasks times lengths: never broadcast, however small it looks
    ranked = rows.join(before.hint("merge"), (rows["task"] == before["of_task"]) & (rows[length_col] == before["of_length"]))
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    out_schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    out_names = [f.name for f in out_schema]

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        bins, offset = slots.value.place(batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins), pa.array(offset)], names=out_names)

    return map_batches(ranked, placed, out_schema)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its id, length and ids, for pieces that carry an ``ids`` column."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    # a sequence has at most ``capacity`` pieces
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
    )
