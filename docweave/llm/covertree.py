"""Exact top-k inner products by dual-tree search over cover trees.

1. Landmarks, a net of a bounded sample, cut the vectors into cells, and cells into blocks of bounded size. The data are dealt by
   block once and written, so near vectors lie together, and no later step shuffles them.
2. Queries come in passes of bounded size. A query first meets a block of its own cell: its kth score there is where its search begins.
3. In a pass all tasks get the queries, with these scores, in one cover tree, and build a cover tree over each block that they hold.
   A node has a centre, all vectors below it lie within its covering radius, and its children's centres are further
   apart than half of that radius. For a pair of nodes no inner product exceeds c.d + |c| r_d + |d| r_c + r_c r_d; the pair, or
   at the roots the whole block, is pruned when that is under the worst kth score of the query node's queries, which rises from block to block.
4. A task gives the scores that reach the first step's; a query's best k of all tasks are merged by score and id.

Ties are never pruned, and scores are integers, so the answer is that of a search of all pairs. Of equal vectors no more than the k + 1 smallest
ids can be among a query's best, so a group of a million copies is k + 1 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a block, about, and in a cell until there are MAX_CELLS.
BLOCK = 4096
CELL = 1024
MAX_CELLS = 256
#: Bytes of the queries of a pass, and of the sample that the landmarks are taken from.
PASS_BYTES = 8 << 20
SAMPLE_BYTES = 2 << 20
LEAF = 32


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    points: np.ndarray
    children: list[Node]

    def stack(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, norms and radii of the children."""
        if not hasattr(self, "_stack"):
            self._stack = np.array([c.centre for c in self.children]), np.array([c.norm for c in self.children]), np.array([c.radius for c in self.children])
        return self._stack


def build(x: np.ndarray, points: np.ndarray | None = None, centre: int | None = None, distance: np.ndarray | None = None) -> Node:
    """A cover tree over the rows ``points`` of x. Each level's centres are a greedy net of half the radius; the own centre is the first of them."""
    if points is None:
        points = np.arange(len(x))
    if centre is None:
        centre = int(points[0])
    if distance is None:
        distance = np.sqrt(((x[points] - x[centre]) ** 2).sum(axis=1))
    radius = float(distance.max())
    node = Node(x[centre], float(np.sqrt((x[centre] ** 2).sum())), radius, points, [])
    if len(points) <= LEAF or radius == 0:
        return node
    left, nearest, at = points, distance, centre
    groups: list[tuple[int, np.ndarray, np.ndarray]] = []
    while len(left):
        within = nearest <= radius / 2
        groups.append((at, left[within], nearest[within]))
        left = left[~within]
        if len(left):
            at = int(left[0])
            nearest = np.sqrt(((x[left] - x[at]) ** 2).sum(axis=1))
    # lone centres share leaves: a net in many dimensions has mostly those
    small = [g for g in groups if len(g[1]) <= 2]
    node.children = [build(x, p, c, d) for c, p, d in groups if len(p) > 2]
    if small:
        rest = np.concatenate([p for _, p, _ in small])
        for begin in range(0, len(rest), LEAF * 8):
            some = rest[begin : begin + LEAF * 8]
            if len(some) == len(points):
                return node
            away = np.sqrt(((x[some] - x[centre]) ** 2).sum(axis=1))
            node.children.append(Node(x[centre], node.norm, float(away.max()), some, []))
    return node


LOW, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Search:
    """The best k of data for each query. Vectors are whole numbers; scores are exact, cut to the range of a long."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        """``least``: a score that k others of the query are known to reach, LOW where that isn't known."""
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.as_float = queries.astype(np.float64)
        self.norms = np.sqrt((self.as_float**2).sum(axis=1))
        self.largest = float(np.abs(self.as_float).max(initial=1))
        self.scores = np.full((len(queries), k), LOW)
        self.ids = np.full((len(queries), k), NO_ID)
        self.least = np.full(len(queries), LOW) if least is None else least
        self.worst = self.least.astype(np.float64)
        self.tree = build(self.as_float) if len(queries) else None
        self.pairs = 0

    def add(self, data: np.ndarray, ids: np.ndarray) -> None:
        """Searches a block of data."""
        if self.tree is None or not len(data):
            return
        self.data, self.data_ids, self.data_float = data, ids, data.astype(np.float64)
        self.fits = self.largest * max(np.abs(self.data_float).max(initial=1), 1) * max(1, data.shape[1]) < 2**53
        root = build(self.data_float)
        bound = self.bounds(self.tree, root.centre[None], np.array([root.norm]), np.array([root.radius]))[0]
        if bound >= self.worst_of(self.tree):
            self.visit(self.tree, root)

    def worst_of(self, node: Node) -> float:
        return float(self.worst[node.points].min())

    def bounds(self, node: Node, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
        b = centres @ node.centre + node.norm * radii + norms * node.radius + node.radius * radii
        return np.maximum(b + 1e-9 * (np.abs(b) + node.norm * norms) + 1e-6, float(LOW))

    def visit(self, q: Node, d: Node) -> None:
        if not d.children:
            if not q.children or len(q.points) <= LEAF:
                self.base(q, d)
                return
            bound = self.bounds(d, *q.stack())
            for child, b in zip(q.children, bound, strict=True):
                if b >= self.worst_of(child):
                    self.visit(child, d)
            return
        # the better data nodes first, so that the kth scores rise early
        bound = self.bounds(q, *d.stack())
        for k in np.argsort(-bound):
            if bound[k] < self.worst_of(q):
                return
            child = d.children[k]
            if q.children and q.radius > child.radius:
                for own in q.children:
                    if float(self.bounds(own, child.centre[None], np.array([child.norm]), np.array([child.radius]))[0]) >= self.worst_of(own):
                        self.visit(own, child)
            else:
                self.visit(q, child)

    def products(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where these hold every sum, else in unbounded integers."""
        if self.fits:
            return (self.as_float[q] @ self.data_float[d].T).astype(np.int64)
        exact = self.queries[q].astype(object) @ self.data[d].astype(object).T
        return np.clip(exact, LOW, NO_ID).astype(np.int64)

    def base(self, q: Node, d: Node) -> None:
        """Scores of a leaf's queries, each a node of its own without radius, that the data leaf's bound doesn't exclude."""
        bound = self.as_float[q.points] @ d.centre + self.norms[q.points] * d.radius
        bound = np.maximum(bound + 1e-9 * (np.abs(bound) + self.norms[q.points] * d.norm) + 1e-6, float(LOW))
        points = q.points[bound >= self.worst[q.points]]
        if not len(points):
            return
        self.pairs += len(points) * len(d.points)
        score, ids = self.products(points, d.points), self.data_ids[d.points]
        there = (score >= self.worst[points][:, None]) & (self.query_ids[points][:, None] != ids[None])
        for row in np.flatnonzero(there.any(axis=1)).tolist():
            point, own = points[row], there[row]
            s, i = np.r_[self.scores[point], score[row, own]], np.r_[self.ids[point], ids[own]]
            order = np.lexsort((i, ~s))  # ~s falls as s rises; a negated long may not fit
            order = order[np.argsort(i[order] == NO_ID, kind="stable")][: self.k]
            self.scores[point], self.ids[point] = s[order], i[order]
            if i[order[-1]] != NO_ID:
                self.worst[point] = max(self.worst[point], float(s[order[-1]]))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, vector ids, scores) of what reaches the least scores."""
        there = (self.ids != NO_ID) & (self.scores >= self.least[:, None])
        return np.repeat(self.query_ids, there.sum(axis=1)), self.ids[there], self.scores[there]


def landmarks(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``sample``, each the furthest from those before it, ``n`` at most."""
    if not len(sample):
        return sample
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers: shorter vectors end in zeros, which change no inner product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(at)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < size[:, None]] = flat
    return out


def _in_cells(rows: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """``rows`` (id, v) with the number of the nearest centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        norms = (c**2).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                cell = (norms[None] - 2 * (matrix(batch.column(1), width).astype(np.float64) @ c.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return rows.mapInArrow(over, "id long, v array<bigint>, cell int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same cell and block."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("cell").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
        for begin, end in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)].tolist()), strict=True):
            if held and key[begin] != before:
                yield pa.Table.from_batches(held)
                held = []
            before = key[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _searched(located: DataFrame, queries: tuple, k: int, width: int, own_cell: bool, visited: Accumulator | None) -> DataFrame:
    """query_id, vec_id and score of what each task's blocks have for the queries (ids, vectors, cells, least scores)."""
    shared = located.sparkSession.sparkContext.broadcast(queries)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, cells, least = shared.value
        whole = None if own_cell else Search(vectors, ids, k, least)
        pairs = 0
        for block in _blocks(batches):
            search = whole
            if own_cell:
                own = cells == block.column("cell")[0].as_py()
                search = Search(vectors[own], ids[own], k)
            search.add(matrix(block.column("v"), width), block.column("id").to_numpy())
            if own_cell:
                pairs += search.pairs
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in search.found()], names=["query_id", "vec_id", "score"])
        if whole is not None:
            pairs += whole.pairs
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in whole.found()], names=["query_id", "vec_id", "score"])
        if visited is not None:
            visited.add(pairs)

    return located.mapInArrow(over, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", visited: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose id is divisible by ``every``.

    Components are floor(scale * x) in doubles. Vectors that are null or hold null or non-finite components take no part, nor do rows without
    an id. A row is no candidate of its own id. Repeated rows count once; of different vectors with one id the largest is taken.
    Vectors of different lengths are compared as if the shorter ended in zeros. Components and scores beyond a long are cut to its range, where they tie. Other columns are
    not read. ``visited`` counts the pairs that were scored.
    """
    v = F.transform(vectors[vector_col].cast("array<double>"), lambda x: F.floor(x * scale))
    whole = F.forall(vectors[vector_col].cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.coalesce(whole, F.lit(False)) & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("id"), v.alias("v"))
    rows = written(rows.groupBy("id").agg(F.max("v").alias("v")), "vectors")
    is_query = F.col("id") % every == 0
    n, n_queries, width = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)

    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(16 * MAX_CELLS, SAMPLE_BYTES // (8 * width)))).toArrow()
    centres = landmarks(matrix(sample.column("v"), width).astype(np.float64), min(MAX_CELLS, max(1, n // CELL)))
    if not len(centres):
        centres = np.zeros((1, width))
    same = Window.partitionBy("v").orderBy("id")
    data = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    celled = written(_in_cells(data, centres, width), "cells")
    counts = dict(celled.groupBy("cell").count().collect())  # of MAX_CELLS rows at most
    blocks = [max(1, -(-counts.get(c, 0) // BLOCK)) for c in range(len(centres))]
    of_cell = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("cell") + 1)
    located = celled.withColumn("block", F.pmod(F.xxhash64("id"), of_cell).cast("int"))
    # a few blocks to a file, so that a pass has tasks enough
    files = max(1, min(sum(blocks), max(24, sum(blocks) // 8)))
    located = written(located.repartition(files, "cell", "block").sortWithinPartitions("cell", "block", "id"), "blocks")

    passes = max(1, -(-n_queries * 8 * width // PASS_BYTES))
    queries = written(_in_cells(rows.where(is_query), centres, width).withColumn("pass", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(passes)).cast("int")), "queries")
    got = None
    for number in range(passes):
        some = queries.where(F.col("pass") == number).orderBy("id").toArrow()
        ids, own, cells = some.column("id").to_numpy(), matrix(some.column("v"), width), some.column("cell").to_numpy()
        begin = _searched(located.where("block = 0"), (ids, own, cells, None), k, width, True, visited)
        kth = begin.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k)
        kth = dict(kth.select("query_id", F.element_at("s", k)).toPandas().itertuples(index=False, name=None))
        least = np.array([kth.get(i, LOW) for i in ids.tolist()], np.int64)
        found = written(_searched(located, (ids, own, cells, least), k, width, False, visited), "found")
        got = found if got is None else got.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
