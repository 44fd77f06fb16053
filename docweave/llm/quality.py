"""Quality scores from random-indexing word vectors and a small network with calibrated probabilities.

Words are hashed to buckets by what they spell and by their kind (word, upper-case word, number, marks). Each bucket has a sparse random index
vector; the sum of its neighbours' index vectors over the whole corpus, and its own, is its word vector. A document is the mean of
its words' vectors. A two-layer numpy network is fitted on a bounded sample of labelled documents, and its probabilities are
calibrated by one temperature on a part of the sample that it wasn't fitted on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, map_batches, prepare
from .langid import remainder

#: Buckets of each of the four kinds of words.
BUCKETS = 2048
KINDS = 4
DIMENSIONS = 32
WINDOW = 2
#: Labelled documents that the network is fitted on at most: those with the smallest hashes of their id.
MAX_SAMPLE = 8192
HIDDEN = 32
_MARKS = r"([^\pL\pN\s]+)"


def bucket_of(word: str) -> int:
    kind = 3 if not word[0].isalnum() else 2 if not word.isalpha() else 1 if len(word) > 1 and word.isupper() else 0
    return kind * BUCKETS + zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS


_buckets = Recent(bucket_of, 200_000)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word of all texts, where each text's words begin, and the end). Marks are words of their own."""
    texts = pc.replace_substring_regex(pc.fill_null(texts, ""), _MARKS, r" \1 ")
    split = pc.utf8_split_whitespace(texts)
    words = pc.list_flatten(split).dictionary_encode()
    code = np.array([_buckets[w] if w else -1 for w in words.dictionary.to_pylist()], np.int64)
    each = code[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    there = each >= 0
    return each[there], np.r_[0, np.cumsum(there)][at]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places of each bucket's index vector: +1 at the first, -1 at the second."""
    rng = np.random.default_rng(20_011)
    first = rng.integers(0, DIMENSIONS, BUCKETS * KINDS)
    return first, (first + rng.integers(1, DIMENSIONS, BUCKETS * KINDS)) % DIMENSIONS


def contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(buckets, dimensions) word vectors of unit length, from all texts. Each task sums before its rows are shuffled."""
    prepare(docs.sparkSession)
    names = [f"v{j}" for j in range(DIMENSIONS)]
    total = BUCKETS * KINDS

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = index_vectors()
        sums, seen = np.zeros(total * DIMENSIONS), np.zeros(total, np.int64)
        for batch in batches:
            word, at = words_of(batch.column(0))
            if not len(word):
                continue
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            seen += np.bincount(word, minlength=total)
            for step in range(1, WINDOW + 1):
                same = text[step:] == text[:-step]
                left, right = word[:-step][same], word[step:][same]
                for one, other in ((left, right), (right, left)):
                    sums += np.bincount(one * DIMENSIONS + plus[other], minlength=len(sums))
                    sums -= np.bincount(one * DIMENSIONS + minus[other], minlength=len(sums))
        there = np.flatnonzero(seen)
        table = sums.reshape(total, DIMENSIONS)[there]
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(seen[there]), *(pa.array(table[:, j].astype(np.float32)) for j in range(DIMENSIONS))], names=["bucket", "n", *names])

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(over, f"bucket int, n long, {', '.join(f'{n} float' for n in names)}")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).toPandas()
    plus, minus = index_vectors()
    out = np.zeros((total, DIMENSIONS))
    b = got["bucket"].to_numpy(np.int64)
    out[b] = got[names].to_numpy(float) / np.maximum(1, got["n"].to_numpy())[:, None]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.maximum(norm, 1e-12) * (norm > 0)
    own = np.zeros_like(out)
    own[np.arange(total), plus] += 2**-0.5
    own[np.arange(total), minus] -= 2**-0.5
    out = out + own
    # rounded, so that the order of the sums doesn't show
    return np.round(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), 5).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(texts, dimensions) means of the words' vectors; zeros for a text without words."""
    word, at = words_of(texts)
    out = np.zeros((len(at) - 1, vectors.shape[1]))
    n = np.diff(at)
    full = np.flatnonzero(n)
    for begin in range(0, len(full), 64):
        some = full[begin : begin + 64]
        low, high = at[some[0]], at[some[-1] + 1]
        out[some] = np.add.reduceat(vectors[word[low:high]], at[some] - low, axis=0, dtype=np.float64) / n[some][:, None]
    return out


@dataclass
class Network:
    """Standardisation, a tanh layer, a linear layer, and the temperature. ``flat`` is the answer where nothing could be learned."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    flat: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.flat)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on four fifths of the rows; the temperature that gives the least log loss on the last fifth."""
    if len(set(y.tolist())) < 2:
        return Network(flat=float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    apart, own = order[:cut], order[cut:]
    if len(set(y[own].tolist())) < 2:
        own = order
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            a, b = z[rows], y[rows]
            h = np.tanh(a @ p[0] + p[1])
            d = (_sigmoid(h @ p[2] + p[3]) - b) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    out = net.logits(x[apart])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    net.temperature = float(grid[np.argmin([_loss(out / t, y[apart]) for t in grid])])
    return net


def sample(labels: DataFrame, id_col: str, label_col: str, max_sample: int) -> DataFrame:
    """(id, y) of at most ``max_sample`` ids, those with the smallest hash; an id with several labels has the smallest."""
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.groupBy("id").agg(F.min("y").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(max_sample)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_sample: int = MAX_SAMPLE) -> Network:
    """The network fitted on a bounded sample of ``labels``; only the sample's texts are read for it, and ``max_sample`` vectors reach the driver."""
    prepare(docs.sparkSession)
    chosen = sample(labels, id_col, label_col, max_sample)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(batch.column(2), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    # of max_sample rows at most
    joined = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    got = map_batches(joined, rows, f"id {docs.schema[id_col].dataType.simpleString()}, y int, x binary").toPandas().sort_values("id")
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(len(got), vectors.shape[1])
    return train(x, got["y"].to_numpy(float))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with score and predicted. Whole texts are scored; null and empty ones as a text without words."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, net = shared.value
        s = net.scores(pooled(batch.column(len(keep)), own))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["score double, predicted int"])
    return map_batches(docs.select(*keep, docs[text_col].cast("string").alias("text_")), rows, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """id_col, held_out, score and predicted for every row of ``docs``.

    Labels of ids whose crc32 modulo 3 is 1 are held out; rows without an id too. Where no label can be learned from, scores are 0.5; with labels
    of one kind only, that kind. Labels without a document count for nothing; of several texts with a
    labelled id the smallest is learned from, so reruns agree.
    """
    vectors = contexts(docs, text_col)
    network = fit(docs, labels.where(remainder(labels[id_col], 3) != 1), vectors, id_col, text_col, label_col, max_sample)
    held_out = F.coalesce(remainder(docs[id_col], 3) == 1, F.lit(True))
    return score(docs.withColumn("held_out", held_out), vectors, network, [id_col, "held_out"], text_col)
