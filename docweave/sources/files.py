"""File sources and table sinks: folders of records, uploads, decoding, manifests, staged intake, versioned writes."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_FILE_BYTES = 5_000_000
MARKER = "SYNTHETIC:"


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (below ``folder``), depth, length and content of every file; the folder may be in any store that Spark reads. Spark gives no row for an empty file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    base = folder.split("://")[-1].rstrip("/")
    below = F.regexp_replace("path", F.concat(F.lit(r"^.*?\Q"), F.lit(base), F.lit(r"\E/+")), F.lit(""))
    return files.select(below.alias("path"), "length", "content").withColumn("depth", F.size(F.split("path", "/")) - 1)


def problems(files: DataFrame, most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``files`` with problem: too large, empty, outside the folder, or not of a kind that is read; null for a file to keep."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    problem = F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "outside").when(F.col("length") > most_bytes, "too large").when(F.col("length") == 0, "empty").when(~kind.isin("txt", "md", "yaml", "json"), "kind")
    return files.withColumn("problem", problem)


def roots(files: DataFrame, manifest: str = "case.yaml") -> DataFrame:
    """The shallowest manifest of an upload, and an error if two stand at that depth: path, n, error."""
    found = files.where(F.element_at(F.split("path", "/"), -1) == manifest)
    best = found.groupBy().agg(F.min("depth").alias("least"))
    at = found.join(F.broadcast(best), F.col("depth") == F.col("least")).groupBy("least").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    return at.select("path", "n", F.when(F.col("n") > 1, "several manifests at the same depth").alias("error"))


def decode(data: bytes | None) -> str:
    """UTF-8 with or without a mark, line feeds, and composed characters; bytes that aren't text are replaced."""
    text = (data or b"").decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", text)


def decoded(files: DataFrame) -> DataFrame:
    """``files`` without content, with text. Composing characters has no built-in function, so it is done in Arrow batches."""
    keep = [c for c in files.columns if c not in ("content", "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema] + ["text string"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([decode(c.as_py()) for c in batch.columns[-1]], pa.string())], names=[*keep, "text"])

    return files.select(*keep, "content").mapInArrow(over, schema)


def marked(rows: DataFrame, text: str, synthetic: str) -> DataFrame:
    """``rows`` with the marker line of made-up records taken off, and consistent: whether the marker agrees with the declaration."""
    has = F.col(text).startswith(MARKER)
    bare = F.when(has, F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(F.col(text))
    return rows.withColumn("consistent", has == F.col(synthetic)).withColumn(text, bare)


def joined_pages(pages: Column) -> Column:
    """Texts of pages as one: a page that ends a sentence is followed by a blank line, else by a line feed; blank pages are left out."""
    kept = F.filter(F.transform(pages, lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(kept, F.lit(""), lambda a, p: F.when(a == "", p).when(a.rlike(r"[.!?:]$"), F.concat(a, F.lit("\n\n"), p)).otherwise(F.concat(a, F.lit("\n"), p)))


def staged(files: DataFrame, most_files: int = 100, most_bytes: int = 50_000_000) -> DataFrame:
    """Uploads (upload, path, length) with the problem of the whole upload: none, too many or too large."""
    w = Window.partitionBy("upload")
    n, total = F.count("*").over(w), F.sum("length").over(w)
    return files.withColumn("upload_problem", F.when(n > most_files, "too many files").when(total > most_bytes, "too large"))


def write_version(df: DataFrame, root: str, pointer_rows: str = "current") -> str:
    """Write ``df`` to a new folder below ``root``, then append a row that names it: readers see the old version or the new one, never a part."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/{pointer_rows}")
    return version


def read_version(spark: SparkSession, root: str, pointer_rows: str = "current") -> DataFrame:
    version = spark.read.parquet(f"{root}/{pointer_rows}").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}")


def read_checked(spark: SparkSession, path: str, expected: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """A Parquet corpus whose meta table (name, value) beside it says what ``expected`` says and whose columns have the types given; anything else is refused."""
    meta = {r[0]: r[1] for r in spark.read.parquet(f"{path}/meta").where(F.col("name").isin(*expected)).collect()}
    wrong = sorted(name for name, value in expected.items() if meta.get(name) != value)
    if wrong:
        raise ValueError(f"corpus {path} was built otherwise: {', '.join(f'{n} is {meta.get(n)!r}, not {expected[n]!r}' for n in wrong)}")
    rows = spark.read.parquet(f"{path}/rows")
    types = dict(rows.dtypes)
    odd = sorted(c for c, kind in columns.items() if types.get(c) != kind)
    if odd:
        raise ValueError(f"corpus {path} has other columns: {', '.join(f'{c} {types.get(c)}' for c in odd)}")
    return rows


def safe_mapping(source: str, most_chars: int = 1_000_000) -> dict:
    """A YAML mapping without aliases (which can grow without end), repeated keys or objects; anything else is an error."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml package") from error
    if len(source) > most_chars:
        raise ValueError(f"over {most_chars} characters")
    if any(isinstance(event, yaml.events.AliasEvent) for event in yaml.parse(source, Loader=yaml.SafeLoader)):
        raise ValueError("aliases aren't read")
    stack = [yaml.compose(source, Loader=yaml.SafeLoader)]
    while stack:
        node = stack.pop()
        if isinstance(node, yaml.MappingNode):
            keys = [key.value for key, _ in node.value if isinstance(key, yaml.ScalarNode)]
            twice = sorted({k for k in keys if keys.count(k) > 1})
            if twice or len(keys) < len(node.value):
                raise ValueError(f"keys stand twice or aren't plain: {', '.join(twice)}")
            stack += [value for _, value in node.value]
        elif isinstance(node, yaml.SequenceNode):
            stack += node.value
    out = yaml.safe_load(source)
    if not isinstance(out, dict):
        raise ValueError("not a mapping")
    return out
