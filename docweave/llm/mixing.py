"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id. A source takes its documents with the smallest hashes up to its budget; which hash that
is, is found without sorting: sizes are summed by source and leading digits of the hash, the running sum shows the bucket in which
the budget ends, and only the documents of that bucket are summed again by their next digits. After the last level the bucket's
documents have the same leading digits and are taken or left together, whichever ends nearer to the budget. A document is
taken by comparing its hash with its source's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hexadecimal digits of a histogram level: 4096 buckets a source.
DIGITS = 3
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"
#: Above every hash.
ALL = "g"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def mix_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """A document's hash is of its id, or of its text where it has none."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text.cast("string"), F.lit(""))))
    return F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank: its place from 0 in code point order, null last. Sorted by range; only partition counts reach the driver."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "sources")
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("part").count().collect())
    before, n = {}, 0
    for part, count in counts:
        before[part] = n
        n += count
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    shift = F.create_map(*[F.lit(x) for part in before for x in (part, before[part])]) if before else F.lit(None)
    return ordered.withColumn("rank", (own + shift[F.col("part")]).cast("long") if before else F.lit(0).cast("long")).drop("part")


def targets(sources: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """``sources`` (source, source_size) with target.

    Targets are proportional to the weights, which repeat over the sources in code point order, and sum to share[0]/share[1] of all
    sizes. A target over ``most`` times its source's size stops there and the excess is shared again, until none is above. Each
    round is one sum over the sources; the driver gets sums alone.
    """
    weighted = ranked(sources)
    rank = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank + 1).cast("int"))
    weighted = written(weighted.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "weights")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    whole = total * share[0] / share[1]
    level: Column | None = None
    capped, free = 0, 1
    n_capped = -1
    while True:
        above = F.lit(False) if level is None else F.col("cap") <= level
        got = weighted.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if got[2] == n_capped:
            break
        n_capped, capped, free = got[2], got[0] or 0, got[1]
        if not free:
            break
        level = F.lit(whole - capped) * F.col("weight") / F.lit(free)
    target = F.col("cap").cast("double") if level is None or not free else F.least(F.col("cap").cast("double"), level)
    return weighted.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, levels: int = LEVELS, digits: int = DIGITS) -> DataFrame:
    """(source, below): documents of a source with a hash under ``below`` are taken, for (source, budget) of ``budgets``.

    ``docs`` has source, size and hash. Sums are taken per source and bucket before they meet, so a hot source is no hot task.
    """
    open_ = budgets.select("source", F.col("budget"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    found = None
    for level in range(levels):
        here = docs
        if level:
            edge = open_.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            here = docs.join(edge, docs["source"].eqNullSafe(edge["s"]) & (F.substring("hash", 1, level * digits) == edge["p"]), "left_semi")
        sums = here.groupBy(F.col("source").alias("s"), F.substring("hash", 1, (level + 1) * digits).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("n").over(run))
        rows = sums.join(open_.select("source", "budget", "before"), sums["s"].eqNullSafe(open_["source"])).withColumn("upto", F.col("upto") + F.col("before"))
        edge = F.col("upto") > F.col("budget")
        first = rows.where(edge).groupBy("s").agg(F.min_by(F.struct("bucket", "n", "upto", "budget"), "bucket").alias("edge"))
        first = written(first.select(F.col("s").alias("source"), "edge.*"), f"edge{level}")
        rest = open_.join(first.select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), "left_anti")
        # no bucket goes over the budget: all of them are in; past the first level that can't happen, as the edge's sum went over
        done = rest.select("source", F.lit(ALL).alias("below"))
        found = done if found is None else found.unionByName(done)
        open_ = first.select("source", "budget", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("n")).alias("before"), F.col("upto"))
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("before"))
    last = open_.select("source", F.when(nearer, F.concat("prefix", F.lit(ALL))).otherwise(F.col("prefix")).alias("below"))
    return found.unionByName(last)


def goals(rows: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """s (source), source_size, target, rounds and below for each source of ``rows`` (source, size, hash): one row a source, written."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sources, weights, share, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = written(goal.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")), "targets")
    below = thresholds(rows, goal.where("source_size > 0"))
    goal = goal.join(below.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # Spark sends it to all where its size, which is then known, is under the threshold
    return written(goal.select(F.col("source").alias("s"), "source_size", "target", "rounds", "below"), "goals")


def _sizes(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"), mix_hash(docs[id_col], docs[text_col], seed).alias("hash")), "sizes"
    )


def _copies(hash_: Column, most: int) -> Column:
    return F.least(F.col("rounds") + F.coalesce((hash_ < F.col("below")).cast("long"), F.lit(0)), F.lit(most))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of ``docs``.

    A source whose target is at least its size has each document floor(target / size) times and, up to the rest of the target, once
    more. Null texts have size 0 and null sources are a source of their own. Rows that share an id share their
    hash, and so are taken alike, each up to ``most`` times; rows without an id go by their text. The hash alone decides, so reruns agree. A source of
    size 0 has target 0. Only narrow columns are written; other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = _sizes(docs, seed, id_col, text_col, source_col)
    goal = goals(rows, weights, share, most)
    out = rows.join(goal, rows["source"].eqNullSafe(goal["s"]))
    out = out.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("hash"), most).alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as mix() takes it. Rows carry their hash, so texts meet the sources' thresholds and no other rows."""
    names = docs.columns
    goal = goals(_sizes(docs, seed, id_col, text_col, source_col), weights, share, most)
    out = docs.withColumn("hash_", mix_hash(docs[id_col], docs[text_col], seed))
    out = out.join(goal, F.col(source_col).cast("string").eqNullSafe(F.col("s"))).withColumn("copies_", _copies(F.col("hash_"), most)).where("copies_ > 0")
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int")))).select(*[F.col(n) for n in names])
