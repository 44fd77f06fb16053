"""TIFF media columns: write byte payloads as TIFF images, walk the images' directories and emit one row per page.

The reader follows the chain of image directories of either byte order, takes strips or tiles of unpacked, PackBits, LZW or
deflate data, undoes horizontal and floating-point predictors, puts tiles and planes together and returns the samples. It works on
one image at a time, in memory that a page's samples bound. Directories that can't be read give a row with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, prepare

#: Tags, types and codes of the TIFF 6.0 format and its supplements.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257

PAGE_COLUMNS = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def unpack_bits(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        at += 1
        if head < 128:
            out.append(data[at : at + head + 1])
            at += head + 1
        elif head > 128:
            out.append(data[at : at + 1] * (257 - head))
            at += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as runs, the rest as literals."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    starts = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)].tolist()
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            piece = literal[k : k + 128]
            out.append(len(piece) - 1)
            out.extend(piece)
        literal.clear()

    for begin, end in zip(starts, starts[1:], strict=False):
        n = end - begin
        if n < 3:
            literal.extend(data[begin:end])
            continue
        flush()
        while n > 0:
            k = min(n, 128)
            if k == 1:
                out.extend((0, data[begin]))
            else:
                out.extend((257 - k, data[begin]))
            n -= k
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first; codes widen one entry early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, out, previous = list(first), 9, [], None
    held = bits = 0
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, previous = list(first), 9, None
            continue
        if previous is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out.append(entry)
        previous = entry
        if len(table) >= 511:
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    table: dict[bytes, int] = {}
    width, word = 9, b""

    def fresh() -> None:
        nonlocal table, width
        table, width = {bytes([k]): k for k in range(256)}, 9

    fresh()
    put(LZW_CLEAR, 9)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        size = len(table) + 2
        if size == 4095:
            put(LZW_CLEAR, 12)
            fresh()
        elif size >= 512:
            width = 12 if size >= 2048 else 11 if size >= 1024 else 10
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        if len(table) + 3 >= 512:
            width = 12 if len(table) + 3 >= 2048 else 11 if len(table) + 3 >= 1024 else 10
    put(LZW_END, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def compress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.compress(data, 1)
    raise ValueError(f"compression {compression}")


def decompress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression}")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 4096, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of pages, each (height, width) or (height, width, samples) of unsigned 8- or 16-bit samples."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        bits = page.dtype.itemsize * 8
        blocks = []
        if tile is None:
            rows = max(1, min(rows_per_strip, height))
            cuts = [page[y : y + rows] for y in range(0, height, rows)]
        else:
            padded = np.pad(page, ((0, -height % tile[1]), (0, -width % tile[0]), (0, 0)))
            cuts = [padded[y : y + tile[1], x : x + tile[0]] for y in range(0, height, tile[1]) for x in range(0, width, tile[0])]
        for cut in cuts:
            if predictor == 2:
                cut = np.concatenate([cut[:, :1], cut[:, 1:] - cut[:, :-1]], axis=1)
            blocks.append(compress(cut.astype(cut.dtype.newbyteorder(order)).tobytes(), compression))
        offsets = []
        for block in blocks:
            offsets.append(len(out))
            out += block
        if len(out) % 2:
            out.append(0)
        tags: list[tuple[int, int, list[int]]] = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        sizes = [len(b) for b in blocks]
        if tile is None:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_SIZES, 4, sizes)]
        else:
            tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_SIZES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """(byte order, values by tag) of each image directory. A directory is visited once, so looped chains end."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                size = struct.calcsize(TYPES[kind]) * count
                where = at + 10 + 12 * k
                if size > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, where))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def samples(data: bytes, order: str, tags: dict[int, list]) -> np.ndarray:
    """The (height, width, samples) array of a directory."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, n = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, [])):
        raise ValueError(f"{tags.get(BITS)} bits a sample")
    kind = {1: "u", 2: "i", 3: "f"}[one(SAMPLE_FORMAT, 1)]
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    planes = n if one(PLANAR, 1) == 2 and n > 1 else 1
    depth = n // planes
    if TILE_OFFSETS in tags:
        across, down = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        offsets, sizes = tags[TILE_OFFSETS], tags[TILE_SIZES]
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets = tags[STRIP_OFFSETS]
        sizes = tags.get(STRIP_SIZES) or [len(data) - offsets[0]]
    columns, rows = -(-width // across), -(-height // down)
    out = np.zeros((height, width, n), dtype.newbyteorder("="))
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(k, columns * rows)
        y, x = place // columns * down, place % columns * across
        tall = down if TILE_OFFSETS in tags else min(down, height - y)
        raw = decompress(data[offset : offset + size], compression)
        need = tall * across * depth * dtype.itemsize
        if len(raw) < need:
            raise ValueError(f"block {k} has {len(raw)} of {need} bytes")
        if predictor == 3:
            # bytes of a row are differenced across planes of equal significance, the most significant first
            rows_of = np.frombuffer(raw, np.uint8, need).reshape(tall, across * depth * dtype.itemsize).copy()
            for c in range(depth):
                rows_of[:, c::depth] = np.cumsum(rows_of[:, c::depth], axis=1, dtype=np.uint8)
            block = rows_of.reshape(tall, dtype.itemsize, across * depth).transpose(0, 2, 1)
            block = np.ascontiguousarray(block).view(np.dtype(f">{kind}{dtype.itemsize}")).reshape(tall, across, depth)
        else:
            block = np.frombuffer(raw, dtype, tall * across * depth).reshape(tall, across, depth)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
            elif predictor != 1:
                raise ValueError(f"predictor {predictor}")
        out[y : y + tall, x : x + across, plane * depth : plane * depth + depth] = block[: height - y, : width - x]
    return out


def pages_of(data: bytes) -> Iterator[tuple]:
    """Rows of PAGE_COLUMNS for one image; what can't be read gives a row with its error and no pixels."""
    page = 0
    try:
        for order, tags in directories(data):
            try:
                image = samples(data, order, tags)
                height, width, n = image.shape
                yield page, width, height, n, image.dtype.itemsize * 8, tags.get(COMPRESSION, [NONE])[0], image.tobytes(), None
            except Exception as error:  # noqa: BLE001  a damaged page is a row, not the end of the job
                yield page, tags.get(WIDTH, [None])[0], tags.get(HEIGHT, [None])[0], None, None, tags.get(COMPRESSION, [NONE])[0], None, str(error)[:200]
            page += 1
    except Exception as error:  # noqa: BLE001
        yield page, None, None, None, None, None, None, str(error)[:200]


def payload_of(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    """(bytes of the text, these and zeros up to a positive multiple of ``unit``)."""
    data = (text or "").encode("utf-8")
    return len(data), data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def layout_of(payload: bytes) -> dict:
    """The parameters of encode() for a payload, dealt by its checksum, so that equal payloads have equal images and every codec is in use."""
    n = zlib.crc32(payload)
    compression = (DEFLATE, PACKBITS, LZW, DEFLATE)[n & 3]
    return {
        "compression": compression,
        "predictor": 1 if compression == PACKBITS else 1 + (n >> 2 & 1),
        "tile": (32, 64) if n >> 3 & 1 else None,
        "rows_per_strip": 128,
        "order": "<>"[n >> 4 & 1],
    }


def store(docs: DataFrame, width: int = 64, page_rows: int = 1024, layout: Callable[[bytes], dict] = layout_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an image of 8-bit samples, ``width`` of them a row and ``page_rows`` rows a page.

    ``layout`` has the parameters of encode() for a payload. A null or empty text is one row of zeros. Equal texts have equal media. Repeated rows
    give repeated rows.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for text in batch.column(1):
            n, payload = payload_of(text.as_py(), width)
            image = np.frombuffer(payload, np.uint8).reshape(-1, width)
            sizes.append(n)
            media.append(encode([image[y : y + page_rows] for y in range(0, len(image), page_rows)], **layout(payload)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    out = map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), rows, f"doc_id {id_type}, n_bytes long, media binary")
    return out.withColumnRenamed("doc_id", id_col)


def feature_of(pixels: bytes) -> str:
    """Mean and entropy of the bytes and a 64-bit difference hash of 65 equal stretches."""
    a = np.frombuffer(pixels, np.uint8)
    counts = np.bincount(a, minlength=256)
    share = counts[counts > 0] / max(1, len(a))
    cuts = len(a) * np.arange(66, dtype=np.int64) // 65
    total = np.r_[0, np.cumsum(a, dtype=np.int64)]
    means = (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(1, cuts[1:] - cuts[:-1])
    bits = np.packbits(means[1:] > means[:-1]).tobytes().hex()
    return f"{a.mean() if len(a) else 0:.6f} {abs(float(-(share * np.log2(share)).sum())):.6f} {bits}"


def read_pages(stored: DataFrame, media_col: str = "media", features: bool = True) -> DataFrame:
    """One row per page of every image: the other columns of ``stored``, PAGE_COLUMNS and, if asked for, feature.

    Columns of those names in ``stored`` are replaced. A null or empty image has no pages.
    """
    prepare(stored.sparkSession)
    added = PAGE_COLUMNS + (", feature string" if features else "")
    names = [c.split()[0] for c in added.split(", ")]
    keep = [c for c in stored.columns if c not in names and c != media_col]
    types = [pa.int32()] * 6 + [pa.binary(), pa.string()] + [pa.string()] * features
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*keep).schema] + [added])

    def rows(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        at, found, out, held = [], [], [], 0

        def done() -> None:
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            out.append(pa.RecordBatch.from_arrays([*kept, *(pa.array([r[k] for r in found], t) for k, t in enumerate(types))], names=[*keep, *names]))
            at.clear()
            found.clear()

        for k, media in enumerate(batch.column(len(keep))):
            for row in pages_of(media.as_py() or b"") if media.as_py() else ():
                at.append(k)
                found.append((*row, feature_of(row[6]) if row[6] is not None else None) if features else row)
                held += len(row[6] or b"")
                if held > 32 << 20:
                    done()
                    held = 0
        if at:
            done()
        return out

    return map_batches(stored.select(*keep, media_col), rows, schema)


def joined(pages: DataFrame) -> DataFrame:
    """One row per image of what read_pages() gives, whose pages follow each other: its other columns, n_pages, pixels of all pages, error and feature.

    Pages are joined as they pass, without a shuffle; a task holds one image at a time. If a page can't be read, the image has no pixels, and the first error.
    """
    prepare(pages.sparkSession)
    own = [c.split()[0] for c in PAGE_COLUMNS.split(", ")] + ["feature"]
    keep = [c for c in pages.columns if c not in own and c != "n_pages"]
    names = [*keep, "n_pages", "pixels", "error", "feature"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema] + ["n_pages int, pixels binary, error string, feature string"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        parts: list[bytes] = []
        first, error, size = None, None, 0

        def close() -> None:
            nonlocal size
            pixels = None if error else b"".join(parts)
            done.append((first, len(parts), pixels, error, None if error else feature_of(pixels)))
            size += len(pixels or b"")
            parts.clear()

        def out() -> pa.RecordBatch:
            nonlocal size
            columns = [pa.concat_arrays([d[0].column(k) for d in done]) for k in range(len(keep))]
            columns += [pa.array([d[k] for d in done], t) for k, t in ((1, pa.int32()), (2, pa.binary()), (3, pa.string()), (4, pa.string()))]
            done.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            page, pixels, errors = (batch.column(len(keep) + k) for k in range(3))
            for k in range(batch.num_rows):
                if page[k].as_py() == 0:
                    if first is not None:
                        close()
                        if size > 16 << 20 or len(done) >= 256:
                            yield out()
                    first, error = batch.slice(k, 1), None
                parts.append(pixels[k].as_py() or b"")
                error = error or errors[k].as_py()
        if first is not None:
            close()
            yield out()

    return pages.select(*keep, "page", "pixels", "error").mapInArrow(over, schema)
