"""WARC archives: write, read, and assemble transactions.

Writing: every page becomes a request, a response or revisit, and a metadata record. Request and metadata name the
response or revisit in WARC-Concurrent-To. Each record is a gzip member of its own, so a segment of an archive is a plain
.warc.gz file; segments are rows (archive, segment, content) of a Parquet table in the shared folder, which only Spark
has to reach. Reading: segments, or .warc and .warc.gz files read as binaryFile, are parsed record by record.
Assembly: request, response or revisit, and metadata are joined by their concurrent-to identifiers into one nested row
per capture; resolved() joins a revisit with the response that it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, scratch_path, written

SEGMENT_BYTES = 8 << 20
#: Names of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"

RECORDS = (
    "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_digest string, payload_ok boolean, payload_bytes long, block_bytes long, fields map<string,string>, archive string, segment int, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(*parts: object) -> str:
    h = hashlib.md5("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _clean(value: str) -> str:
    """Header values hold no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", _EPOCH), *headers, ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in lines).encode() + b"\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def capture(url: str, payload: bytes, digest: str, seed: tuple[object, ...], fields: dict[str, str], refers_to: str | None) -> bytes:
    """The three records of a capture. A revisit has the response's headers and no payload."""
    main = _urn(*seed, "response")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    about = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = "application/http; msgtype=response"
    if refers_to is None:
        out = record("response", main, [*about, ("Content-Type", kind)], http + payload)
    else:
        out = record("revisit", main, [*about, ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE), ("Content-Type", kind)], http)
    joined = [("WARC-Target-URI", url), ("WARC-Concurrent-To", main)]
    ask = f"GET {_clean(url)} HTTP/1.1\r\n\r\n".encode()
    out += record("request", _urn(*seed, "request"), [*joined, ("Content-Type", "application/http; msgtype=request")], ask)
    note = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields.items()).encode()
    return out + record("metadata", _urn(*seed, "metadata"), [*joined, ("Content-Type", "application/warc-fields")], note)


def plan(rows: DataFrame, min_payload_bytes: int) -> DataFrame:
    """(id, digest, holder, repeated) of the rows that revisit another or are there more than once.

    Among equal payloads the largest id holds the response. Digests are counted before they are joined back, so that a payload
    which a third of all pages have is one row on its side, and the other side is one that Spark can split.
    """
    each = rows.where(F.col("payload_bytes") >= min_payload_bytes).groupBy("id", "digest").agg(F.count("*").alias("n"))
    holders = each.groupBy("digest").agg(F.max("id").alias("holder"), F.sum("n").alias("all_n")).where("all_n > 1").select("digest", "holder")
    again = each.join(written(holders, "holders"), "digest").select("id", "digest", F.when(F.col("id") != F.col("holder"), F.col("holder")).alias("holder"), (F.col("n") > 1).alias("repeated"))
    return again.where("repeated OR holder IS NOT NULL")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one capture per row of ``pages`` to archives under ``path``.

    Null html is an empty payload and null urls an empty target. Rows without an id are responses. Repeated rows give
    repeated captures whose record ids name their place; those with the largest id of a payload are all responses. An empty table gives an empty archive table.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.encode(pages[html_col].cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    again = plan(rows.select("id", "digest", "payload_bytes"), min_payload_bytes).select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "holder", "repeated")
    joined = rows.join(again, rows["id"].eqNullSafe(again["again_id"]) & (rows["digest"] == again["again_digest"]), "left")
    joined = joined.select(F.col("id").cast("string"), "url", F.when(F.col("holder").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", F.col("holder").cast("string"), F.coalesce("repeated", F.lit(False)))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, segment, ordinal = f"part-{TaskContext.get().partitionId():06d}", 0, 0
        held, size = [], 0

        def done(segment: int) -> pa.RecordBatch:
            info = record("warcinfo", _urn(archive, segment, "info"), [("WARC-Filename", f"{archive}-{segment:05d}.warc.gz"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([segment], pa.int32()), pa.array([info + b"".join(held)], pa.binary())], names=["archive", "segment", "content"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for page, url, payload, n_bytes, sha1, holder, repeated in zip(*columns, strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                seed = (archive, ordinal) if repeated else (page, digest)
                fields = {"pageId": page or "", "payloadBytes": str(n_bytes)}
                if holder is not None:
                    fields["refersToPage"] = holder
                held.append(capture(url or "", payload or b"", digest, seed, fields, None if holder is None else _urn(holder, digest, "response")))
                size += len(held[-1])
                ordinal += 1
                if size >= segment_bytes:
                    yield done(segment)
                    segment, size = segment + 1, 0
                    held.clear()
        if held:
            yield done(segment)

    joined.mapInArrow(segments, "archive string, segment int, content binary").write.option("compression", "uncompressed").parquet(path)


def members(content: bytes) -> Iterator[bytes]:
    """The records' bytes: gzip members one after another, or plain records back to back."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, step = memoryview(content), 0, 1 << 16
    while at + 1 < len(view) and view[at] == 0x1F and view[at + 1] == 0x8B:
        z, parts = zlib.decompressobj(31), []
        while at < len(view) and not z.eof:
            piece = view[at : at + step]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record. Text before a version line and cut-off records are skipped."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end, width = data.find(b"\r\n\r\n", at), 4
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        start = end + width
        if not length.isdigit() or start + int(length) > len(data):
            at += 5
            continue
        at = start + int(length)
        yield headers, data[start:at]


def http_payload(block: bytes) -> bytes:
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if block[:5] == b"HTTP/" and at >= 0 else block


def _angle(value: str | None) -> str | None:
    return value.strip("<> ") if value else None


def read(segments: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of ``segments`` (archive, segment, content), with the payload's own bytes if ``payloads``.

    payload_ok says whether a response's payload has the digest that its header states. Null contents have no records.
    """
    prepare(segments.sparkSession)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for archive, segment, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            out: list[tuple] = []
            for data in members(content or b""):
                for h, block in parse(data):
                    kind, payload = h.get("warc-type", ""), None
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    ok, n_bytes, fields = None, None, {}
                    if kind == "response":
                        payload = http_payload(block)
                        own = payload_digest(payload)
                        ok, n_bytes = stated in (None, own), len(payload)
                        stated = own
                    elif kind == "metadata":
                        for line in block.decode("utf-8", "replace").split("\r\n"):
                            name, colon, value = line.partition(":")
                            if colon:
                                fields[name.strip()] = value.strip()
                    out.append(
                        (_angle(h.get("warc-record-id")), kind, _angle(h.get("warc-concurrent-to")), _angle(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-date"), stated, ok, n_bytes, len(block), list(fields.items()), archive, segment, payload if payloads else None)
                    )
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    names = [c.split()[0] for c in RECORDS.split(", ")]
    text = pa.string()
    types = [text, text, text, text, text, text, text, pa.bool_(), pa.int64(), pa.int64(), pa.map_(text, text), text, pa.int32(), pa.binary()]
    return map_batches(segments.select("archive", "segment", "content"), lambda b: list(rows(b)), RECORDS)


def read_table(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of archives written by write(); segments are dealt out a few to a batch, whatever their file."""
    return read(spark.read.schema("archive string, segment int, content binary").parquet(path), payloads)


def read_files(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of .warc and .warc.gz files. A file is one row, so one task's memory holds it; Spark reads none over 2 GB: cut larger archives at member ends first."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.lit(0).alias("segment"), "content")
    return read(files, payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: main (the response or revisit), request, metadata, and whether all three are there.

    Records meet by the record that they are concurrent to; a response or revisit stands for itself. Where several records
    of a kind name the same response, the one with the smallest id is taken, and n_records counts them all. Requests and metadata
    that name no existing record give a row of their own whose main is null. warcinfo and other kinds take no part. A response whose payload
    hasn't the digest that its header states isn't complete.
    """
    kept = ["record_id", "target_uri", "warc_date", "payload_digest", "payload_ok", "payload_bytes", "refers_to", "warc_type", "fields"]
    is_main = F.col("warc_type").isin("response", "revisit")
    own = records.where(F.col("warc_type").isin("request", "response", "revisit", "metadata") & F.col("record_id").isNotNull())
    nested = F.struct(*kept)
    grouped = (
        own.withColumn("capture_id", F.when(is_main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
        .withColumn("nested", nested)
        .groupBy("capture_id")
        .agg(
            F.min_by("nested", F.when(is_main, F.col("record_id"))).alias("main"),
            F.min_by("nested", F.when(F.col("warc_type") == "request", F.col("record_id"))).alias("request"),
            F.min_by("nested", F.when(F.col("warc_type") == "metadata", F.col("record_id"))).alias("metadata"),
            F.count("*").alias("n_records"),
        )
    )
    whole = F.col("main").isNotNull() & F.col("request").isNotNull() & F.col("metadata").isNotNull() & F.coalesce(F.col("main.payload_ok"), F.lit(True))
    return grouped.withColumn("complete", whole)


def resolved(captures: DataFrame) -> DataFrame:
    """``captures`` with response: main and metadata of the response that a revisit refers to, null for other captures and where that is not there.

    Captures are written first, and the responses too, so that one which very many revisits refer to can be split where they meet.
    """
    captures = written(captures, "captures")
    responses = captures.where(F.col("main.warc_type") == "response").select(F.col("main.record_id").alias("of_"), F.struct("main", "metadata").alias("response"))
    responses = written(responses, "responses")
    to = F.when(F.col("main.warc_type") == "revisit", F.col("main.refers_to"))
    return captures.withColumn("to_", to).join(responses, F.col("to_") == F.col("of_"), "left").drop("to_", "of_")


def archive(pages: DataFrame, min_payload_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and return the assembled captures."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col, min_payload_bytes)
    return assemble(read_table(spark, path))
