"""Shared helpers: the shared folder, written intermediate tables, Arrow batch size."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch handed to Python. Texts can be long, so batches are kept small.
BATCH_ROWS = 512

_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_number = itertools.count()
_own = threading.local()


def prepare(spark: SparkSession) -> None:
    """Lower the Arrow batch size where it is larger than BATCH_ROWS, so that long texts fit in a worker."""
    if not 0 < int(spark.conf.get(_ARROW)) <= BATCH_ROWS:
        spark.conf.set(_ARROW, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and all runs in one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir: a folder that the driver and the executors of {master} share")
        set_dir = f"file://{tempfile.mkdtemp(prefix='docweave-')}"
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docweave/{next(_number):04d}-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _own.paths = [*tables(), path]
    return out


def tables() -> list[str]:
    """The tables that this thread has written and not discarded."""
    return getattr(_own, "paths", [])


def discard(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Delete the tables written since tables() was ``before``, but for those of ``keep``. Only for tables that nothing reads any more."""
    stay = {*before, *(df.written_to for df in keep)}
    for path in tables():
        if path not in stay:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _own.paths = [path for path in tables() if path in stay]


def give_back() -> None:
    """Hand what a task has freed back to the system: a worker lives on, and what it holds counts against its executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if isinstance(out, list):
                    yield from out
                elif out is not None:
                    yield out
        give_back()

    return df.mapInArrow(over, schema)


class Recent(dict):
    """A cache by ``make`` that holds the keys used lately, ``limit`` of them at most; long keys aren't kept.

    A worker lives through many stages, so what it keeps counts against its executor's memory.
    """

    def __init__(self, make: Callable, limit: int) -> None:
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value
