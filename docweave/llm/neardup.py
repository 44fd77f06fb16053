"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on the full shingle sets.

1. Each text's distinct word shingles are hashed to 64 bits. Texts with equal sets (exact copies among them) are one class from
   here on, so a group of a million copies is one row.
2. A class has MinHash values in bands; classes that share a band are in a bucket. The number of bands follows from the
   threshold: a pair at the threshold misses all bands with a chance of under ``MISS``.
3. Classes that share a bucket with another get an odd sketch: more MinHash samples, each toggling one bit of a bitmap. The population
   count of two bitmaps' XOR estimates the pair's similarity, the more precisely the higher it is.
4. Buckets are cut into chunks of bounded size, each with the bucket's smallest class. In a chunk a maximum spanning forest by
   estimate proposes links, so a bucket of n classes proposes n - 1 at most. The links are confirmed on the full sets and joined to components.
5. In buckets that still hold several components, every class outside the bucket's largest component is compared with all classes of
   other components by larger sketches, in square tiles of bounded size; pairs whose estimate lies within ``SIGMAS`` standard deviations (of sampling and bitmap) of
   the threshold are confirmed too. So no link between components is left out, while pairs inside one are never listed.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import Recent, discard, give_back, map_batches, prepare, tables, written
from .components import components

ROWS_PER_BAND = 4
#: The chance that a pair at the threshold shares no band.
MISS = 1e-6
SKETCH_SAMPLES = 512
SKETCH_BITS = 2048
#: Larger sketches for what is left to compare: the narrower the band of doubt around the threshold, the fewer pairs have to be confirmed.
FINE_SAMPLES = 2048
FINE_BITS = 8192
SIGMAS = 5.5
#: Classes in a chunk of a bucket, about. The larger, the fewer components are left to compare.
CHUNK = 1024
#: Classes on either side of a tile, about.
TILE = 512

_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n 64-bit numbers of a seeded sequence."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x51ED27F5 & _MASK))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


#: Hashes of the words that a worker met lately.
word_hashes = Recent(word_hash, 50_000)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles.

    Words are runs of other bytes than blank and 9 to 13, with A-Z in lower case. A text of fewer than k words is one shingle.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def minhashes(sets: list[np.ndarray], seed: int, n: int) -> np.ndarray:
    """(sets, n) MinHash values of non-empty sets."""
    out = np.empty((len(sets), n), np.uint64)
    if not sets:
        return out
    times, plus = stream(seed, n) | np.uint64(1), stream(seed + 1, n)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[begin:end])
        at = np.cumsum([0] + [len(s) for s in sets[begin : end - 1]])
        y = np.empty_like(x)
        for j in range(n):
            np.multiply(x, times[j], out=y)
            np.add(y, plus[j], out=y)
            out[begin:end, j] = np.minimum.reduceat(y, at)
        begin = end
    return out


def n_bands(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS_PER_BAND))


def bands(values: np.ndarray) -> np.ndarray:
    """(sets, bands) 64-bit keys; the band's number is part of its key."""
    n = values.shape[1] // ROWS_PER_BAND
    out = np.empty((len(values), n), np.uint64)
    for b in range(n):
        key = np.full(len(values), b + 1, np.uint64)
        for r in range(ROWS_PER_BAND):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, b * ROWS_PER_BAND + r])
        out[:, b] = key
    return out


def odd_sketch(values: np.ndarray, bits: int) -> np.ndarray:
    """(sets, bits / 64) bitmaps: sample j with value v toggles the bit that j and v hash to."""
    place = mixed(values + stream(7, values.shape[1])) % np.uint64(bits)
    out = np.zeros((len(values), bits), np.uint8)
    rows = np.repeat(np.arange(len(values)), values.shape[1])
    np.bitwise_xor.at(out, (rows, place.ravel().astype(np.int64)), 1)
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def estimate(one: np.ndarray, others: np.ndarray, samples: int) -> np.ndarray:
    """Similarity of a sketch with others: an odd difference of d bits in n comes from -n/2 ln(1 - 2d/n) toggles, 2 for each sample that differs."""
    n = others.shape[1] * 64
    odd = np.bitwise_count(others ^ one).sum(axis=1, dtype=np.int64)
    return 1 + n / (4 * samples) * np.log(np.maximum(1 - 2 * odd / n, 1e-9))


def least_estimate(threshold: float, samples: int, bits: int = SKETCH_BITS) -> float:
    """SIGMAS standard deviations of sampling and of collisions in the bitmap under the threshold."""
    toggles = 2 * samples * (1 - threshold)
    collisions = (bits / 4 * math.expm1(4 * toggles / bits) - toggles) / (2 * samples) ** 2
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / samples + collisions)


def forest(sketches: np.ndarray, samples: int, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest by estimated similarity, of those of at least ``least``. Prim's, a row of estimates at a time."""
    n = len(sketches)
    best, to = np.full(n, -np.inf), np.full(n, -1)
    out, free = [], np.ones(n, bool)
    here = 0
    for _ in range(n - 1):
        free[here] = False
        rest = np.flatnonzero(free)
        e = estimate(sketches[here], sketches[rest], samples)
        better = e > best[rest]
        best[rest[better]] = e[better]
        to[rest[better]] = here
        nearest = int(rest[best[rest].argmax()])
        if best[nearest] >= least:
            out.append((int(to[nearest]), nearest))
        here = nearest
    return out


def _arrays(batch: pa.RecordBatch | pa.Table, name: str, dtype: str, width: int) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def text_key(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text.cast("string"))


def sets_of(docs: DataFrame, k: int, n_hashes: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (128 bits of the whole set, null if it is empty), band_keys."""
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in batch.column(2).to_pylist()]
        full = [j for j, s in enumerate(sets) if len(s)]
        keys = iter(bands(minhashes([sets[j] for j in full], 11, n_hashes)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "text_key", "n_shingles", "set_key", "band_keys"],
        )

    source = docs.select(docs[id_col].alias("doc_id"), text_key(docs[text_col]).alias("text_key"), docs[text_col].cast("string").alias("text"))
    return map_batches(source, rows, f"doc_id {id_type}, text_key long, n_shingles long, set_key binary, band_keys binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles and sketch of ``wanted`` (node and the id and text_key of one of its documents)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
        sketches = odd_sketch(minhashes(sets, 23, SKETCH_SAMPLES), SKETCH_BITS)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sketches], pa.binary())],
            names=["node", "shingles", "sketch"],
        )

    source = docs.select(docs[id_col].alias("doc"), text_key(docs[text_col]).alias("doc_key"), docs[text_col].cast("string").alias("text"))
    source = source.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(wanted, ["doc", "doc_key"]).dropDuplicates(["doc", "doc_key"])
    return map_batches(source.select("node", "text"), rows, "node long, shingles array<bigint>, sketch binary")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """node and a larger sketch of ``sets`` (node, shingles)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [s.values.to_numpy().view(np.uint64) for s in batch.column(1)]
        # a few at a time: each sample of each set is a number
        sketches = [s.tobytes() for k in range(0, len(own), 64) for s in odd_sketch(minhashes(own[k : k + 64], 29, FINE_SAMPLES), FINE_BITS)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.binary())], names=["node", "sketch"])

    return map_batches(sets.select("node", "shingles"), rows, "node long, sketch binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 |A and B| >= percent |A or B| on the full sets."""
    one = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    two = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    both = pairs.join(one, "v").join(two, "u")
    common = F.size(F.array_intersect("a", "b"))
    both = both.select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("sizes"))
    return both.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("u", "v")


def by_chunk(df: DataFrame, pairs: Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(u, v) nodes of the index pairs that ``pairs`` gives for whole chunks.

    Rows are dealt by ranges of bucket and chunk and sorted by them; ``pairs`` gets a batch of whole chunks and where each begins, and the end.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows = held
            elif not batch.num_rows:
                continue
            else:
                rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if rows is None:
                give_back()
                return
            key = rows.column("bucket").to_numpy(), rows.column("chunk").to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])
            if batch is not None:
                held = rows.slice(int(starts[-1]))
                rows = rows.slice(0, int(starts[-1]))
            else:
                starts = np.r_[starts, rows.num_rows]
            if rows.num_rows:
                node = rows.column("node")
                for u, v in pairs(rows, starts):
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v))], names=["u", "v"])
        give_back()

    # by ranges: a chunk stays whole, and tasks have about as many rows each, where hashes would put several large chunks in one
    df = df.repartitionByRange("bucket", "chunk").sortWithinPartitions("bucket", "chunk")
    return df.mapInArrow(over, "u long, v long")


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, component and component_id of every row of ``docs``; the component is null for rows that are linked with nothing."""
    spark, at_first = docs.sparkSession, tables()
    threshold = percent / 100
    hashes = n_bands(threshold) * ROWS_PER_BAND
    rows = written(sets_of(docs, k, hashes, id_col, text_col), "sets")
    # a class: all documents with the same set. Its first document stands for it, and its node is a number that it gets as it is written
    classes = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("band_keys").alias("band_keys"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("first.doc_id").alias("doc"), F.col("first.text_key").alias("doc_key"), "band_keys")
    classes = written(classes, "classes")

    def exploded(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = _arrays(batch, "band_keys", "<i8", hashes // ROWS_PER_BAND)
        at = np.repeat(np.arange(len(keys)), keys.shape[1])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys.ravel())], names=["node", "bucket"])

    each = map_batches(classes.select("node", "band_keys"), exploded, "node long, bucket long")
    buckets = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    # tables of one row a bucket are written before they are joined, so that a large bucket can be split there
    buckets = written(buckets.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "buckets")
    member = written(each.join(buckets, "bucket"), "members")
    wanted = classes.select("node", "doc", "doc_key").join(member.select("node").distinct(), "node", "left_semi")
    near = written(full_sets(docs, wanted, k, id_col, text_col), "shingles")
    sketches = near.select("node", "sketch")
    least = least_estimate(threshold, SKETCH_SAMPLES)
    width = SKETCH_BITS // 64

    def group(n: Column) -> Column:
        """A class falls in other groups of n in other buckets, so that all meet."""
        return F.pmod(F.xxhash64("node", "bucket"), n).cast("int")

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def spanning(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sketch = _arrays(rows, "sketch", "<u8", width)
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        two = two[estimate(sketch[two], sketch[two + 1], SKETCH_SAMPLES) >= least]
        found = [(two, two + 1)]
        for begin, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            edges = np.array(forest(sketch[begin : begin + n], SKETCH_SAMPLES, least), np.int64).reshape(-1, 2) + begin
            found.append((edges[:, 0], edges[:, 1]))
        yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    chunks = F.when(F.col("node") == F.col("first"), upto(F.col("chunks"))).otherwise(F.array(group(F.col("chunks"))))
    placed = member.withColumn("chunk", F.explode(chunks))
    proposed = by_chunk(placed.select("bucket", "chunk", "node").join(sketches, "node"), spanning)
    links = written(confirmed(in_order(proposed), near, percent), "links")
    comps = written(components(links), "components")

    # the rest: buckets that still hold several components, and in them the classes outside the largest
    labelled = member.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    split = sizes.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("n_components")).where("n_components > 1")
    split = written(split.select("bucket", F.col("main.component").alias("main"), F.col("main.c").alias("n_main")), "split")
    open_ = written(labelled.join(split, "bucket").withColumn("rest", F.col("component") != F.col("main")), "open")
    fine = written(fine_sketches(near.join(open_.select("node").distinct(), "node", "left_semi")), "fine")
    doubt = least_estimate(threshold, FINE_SAMPLES, FINE_BITS)
    down = F.ceil((F.col("n") - F.col("n_main")) / TILE).cast("int")
    across_ = F.ceil(F.col("n_main") / TILE).cast("int")
    # tiles of a group of the rest and one of the largest component, and of two groups of the rest
    own = group(F.col("down"))
    pairs_of_rest = F.transform(upto(F.col("down")), lambda other: F.least(own, other) * F.col("down") + F.greatest(own, other))
    beside = F.transform(upto(F.col("across")), lambda other: F.col("down") * F.col("down") + own * F.col("across") + other)
    below = F.transform(upto(F.col("down")), lambda other: F.col("down") * F.col("down") + other * F.col("across") + group(F.col("across")))
    open_ = open_.withColumn("down", down.cast("long")).withColumn("across", across_.cast("long"))
    open_ = open_.withColumn("chunk", F.explode(F.when(F.col("rest"), F.concat(pairs_of_rest, beside)).otherwise(below)))
    keys = classes.select("node", "band_keys")
    open_ = open_.select("bucket", "chunk", "node", "component", "rest", own.alias("group")).join(fine, "node").join(keys, "node")

    def across(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a rest class and one of another component, in the first bucket that both share."""
        sketch, key = _arrays(rows, "sketch", "<u8", FINE_BITS // 64), _arrays(rows, "band_keys", "<i8", hashes // ROWS_PER_BAND)
        component, rest, bucket, part = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("component", "rest", "bucket", "group"))
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            here = np.arange(begin, end)
            main = ~rest[begin:end]
            of_rest, two = not main.any(), part[begin] != part[begin:end].max() or part[begin] != part[begin:end].min()
            found = [], []
            for i in here[~main].tolist():
                other = here[(component[begin:end] != component[i]) & (((here > i) & ((part[begin:end] != part[i]) | (not two))) if of_rest else main)]
                other = other[estimate(sketch[i], sketch[other], FINE_SAMPLES) >= doubt]
                if len(other):
                    first = key[i][(key[other] == key[i]).argmax(axis=1)]
                    other = other[first == bucket[begin]]
                    found[0].append(np.full(len(other), i))
                    found[1].append(other)
            if found[0]:
                yield np.concatenate(found[0]), np.concatenate(found[1])

    more = written(confirmed(in_order(by_chunk(open_, across)), near, percent), "more")
    final = comps
    if more.limit(1).count():
        edges = comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
        final = written(components(edges), "final")
    docs_of = classes.select("node", "set_key", "doc")
    smallest = final.join(docs_of, "node").groupBy(F.col("component").alias("of")).agg(F.min("doc").alias("smallest"))
    smallest = written(smallest, "smallest")
    label = docs_of.join(final, "node", "left").join(smallest, F.col("component") == F.col("of"), "left")
    label = label.select("set_key", F.coalesce("component", "node").alias("component"), F.coalesce("smallest", "doc").alias("component_id"))
    label = written(label, "labels")
    discard(spark, at_first, rows, label)
    out = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(label, "set_key", "left")
    own_id = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_key", "n_shingles", F.when(own_id, F.col("component")).alias("component"), F.when(own_id, F.coalesce("component_id", "doc_id")).alias("component_id"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two documents are linked if their sets of k-word shingles have a similarity of at least ``percent`` hundredths;
    component_id is the smallest id that links reach, and kept says that it is the document's own. Null or blank texts have the empty
    set and are linked with nothing, equal ones neither. Rows without an id are kept and have no component. A row is a document: rows that
    share an id and differ in text are linked by their own texts alone, and may fall in different components. Only the id and text columns are read.
    """
    out = linked(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows: that with the smallest id, of such the one with the smallest text key, then other columns.

    Null and blank texts and rows without an id all stay. Rows that are equal in id and text are one group too.
    """
    names = docs.columns
    found = linked(docs, k, percent, id_col, text_col).where("component IS NOT NULL").select("component", "doc_id", "text_key")
    first = written(found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")), "first")
    gone = found.join(first, "component").where(F.struct("doc_id", "text_key") != F.col("first"))
    gone = written(gone.select(F.col("doc_id").alias("gone_"), F.col("text_key").alias("gone_key_")).distinct(), "gone")
    left = docs.withColumn("text_key_", text_key(docs[text_col]))
    left = left.join(gone, (F.col(id_col) == F.col("gone_")) & (F.col("text_key_") == F.col("gone_key_")), "left_anti")
    # equal rows meet; those that are linked with nothing don't
    apart = F.when(F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    atomic = [F.col(f.name) for f in docs.schema if f.name not in (id_col, text_col) and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    left = left.withColumn("apart_", apart)
    order = Window.partitionBy(id_col, "text_key_", "apart_").orderBy(*(atomic or [F.lit(0)]))
    return left.withColumn("place_", F.row_number().over(order)).where("place_ = 1").select(*names)
