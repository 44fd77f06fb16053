"""op4 and op5: TIFF media and exact top-k search."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from docweave.llm import covertree, tiff
from docweave.llm.queries import op4_tiff_pages

DOCS = "doc_id long, text string, media string, page int, feature string"


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.DEFLATE_OLD, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    rng = np.random.default_rng(compression)
    for dtype in (np.uint8, np.uint16):
        for shape in ((1, 1), (7, 64), (70, 33), (40, 30, 3)):
            for layout in ({"rows_per_strip": 16}, {"tile": (16, 32)}):
                for order in "<>":
                    image = rng.integers(0, rng.choice([2, 30, 256]), shape).astype(dtype)
                    pages = list(tiff.pages_of(tiff.encode([image, image[::-1]], compression, predictor, order=order, **layout)))
                    assert [p[6] for p in pages] == [image.tobytes(), image[::-1].tobytes()]
                    assert [p[0] for p in pages] == [0, 1] and pages[0][7] is None


def test_byte_codecs():
    rng = np.random.default_rng(0)
    for k in range(120):
        data = bytes(rng.integers(0, rng.choice([1, 2, 5, 256]), rng.integers(0, 9000)).astype(np.uint8))
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # the example of the PackBits description
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_planes_and_floating_point_predictor():
    """Planes stored apart, and rows of floats whose bytes are differenced by significance."""
    values = np.linspace(-3, 7, 12, dtype=np.float32).reshape(3, 4)
    rows = values.astype(">f4").view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    coded = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], axis=1).astype(np.uint8).tobytes()

    def image(tags, blocks):
        data, offsets = bytearray(b"II*\0\0\0\0\0"), []
        for block in blocks:
            offsets.append(len(data))
            data += block
        tags = tags | {tiff.STRIP_OFFSETS: offsets, tiff.STRIP_SIZES: [len(b) for b in blocks]}
        entries = b""
        for tag, v in sorted(tags.items()):
            packed = struct.pack(f"<{len(v)}I", *v)
            if len(packed) > 4:
                at, packed = len(data), struct.pack("<I", len(data))
                data += struct.pack(f"<{len(v)}I", *v)
                assert at
            entries += struct.pack("<HHI", tag, 4, len(v)) + packed
        struct.pack_into("<I", data, 4, len(data))
        return bytes(data) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"

    base = {tiff.WIDTH: [4], tiff.HEIGHT: [3], tiff.COMPRESSION: [1]}
    page = next(tiff.pages_of(image(base | {tiff.BITS: [32], tiff.SAMPLE_FORMAT: [3], tiff.PREDICTOR: [3]}, [coded])))
    assert page[7] is None and np.array_equal(np.frombuffer(page[6], np.float32).reshape(3, 4), values)
    planes = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    page = next(tiff.pages_of(image(base | {tiff.BITS: [8, 8], tiff.SAMPLES: [2], tiff.PLANAR: [2]}, [planes[0].tobytes(), planes[1].tobytes()])))
    assert page[6] == planes.transpose(1, 2, 0).tobytes()


def test_damaged_images_are_rows():
    good = tiff.encode([np.zeros((4, 64), np.uint8)])
    for data in (b"xx", good[:40], good.replace(b"x\x01", b"y\x01", 1)):
        pages = list(tiff.pages_of(data))
        assert pages and pages[0][7]
    looped = bytearray(good)
    looped[-4:] = looped[4:8]
    assert len(list(tiff.pages_of(bytes(looped)))) == 1


def test_tiff_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 31, "x" * 64, "x" * 65, "long " * 200_000, "a"]
    spark.createDataFrame([(k, t, "clash", 5, "f") for k, t in enumerate(texts)] + [(2, "a", None, None, None), (None, "a", None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op4_tiff_pages(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        data = ((texts[r.doc_id] if r.doc_id is not None else "a") or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        media = tiff.encode([image[y : y + 1024] for y in range(0, len(image), 1024)], **tiff.layout_of(payload))
        assert r.error is None and r.n_pages == -(-len(payload) // 65536)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), tiff.feature_of(payload))
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op4_tiff_pages(spark, f"{tmp_path}/e").count() == 0


def _plain_feature(payload):
    n, counts = len(payload), Counter(payload)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    cuts = [n * k // 65 for k in range(66)]
    means = [sum(payload[a:b]) / max(1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    bits = sum((y > x) << (63 - k) for k, (x, y) in enumerate(zip(means, means[1:], strict=False)))
    return f"{sum(payload) / n:.6f} {abs(entropy):.6f} {bits:016x}"


def test_tiff_query_against_plain_bytes(spark):
    """All documents: payloads, checksums and features from the texts alone, and every codec, predictor and layout in use."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, layouts = op4_tiff_pages(spark, sf).collect(), set()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.error, r.feature) == (zlib.crc32(payload[-64:]), None, _plain_feature(payload))
        layouts.add(tuple(tiff.layout_of(payload).values()))
    assert {x[0] for x in layouts} == {tiff.DEFLATE, tiff.LZW, tiff.PACKBITS} and {x[1] for x in layouts} == {1, 2} and len({x[2] for x in layouts}) == len({x[4] for x in layouts}) == 2


def test_pages_of_an_image_are_joined(spark):
    good, bad = tiff.encode([np.full((2, 4), k, np.uint8) for k in range(3)], tiff.PACKBITS), tiff.encode([np.ones((2, 4), np.uint8)])[:40]
    stored = spark.createDataFrame([(1, good), (2, bad), (3, None), (1, good)], "doc_id long, media binary").coalesce(1)
    assert [(r.doc_id, r.page) for r in tiff.read_pages(stored).collect()] == [(1, 0), (1, 1), (1, 2), (2, 0), (1, 0), (1, 1), (1, 2)]
    rows = tiff.joined(tiff.read_pages(stored)).collect()
    assert [(r.doc_id, r.n_pages, bytes(r.pixels) if r.pixels is not None else None) for r in rows] == [(1, 3, bytes([0] * 8 + [1] * 8 + [2] * 8)), (2, 1, None), (1, 3, bytes([0] * 8 + [1] * 8 + [2] * 8))]
    assert rows[1].error


def _plain(x, ids, every, k):
    out = []
    for q in range(len(x)):
        if ids[q] % every == 0:
            s = sorted(((-int(x[q] @ x[d]), int(ids[d])) for d in range(len(x)) if ids[d] != ids[q]))[:k]
            out += [(int(ids[q]), r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "ties"])
def test_dual_tree_is_exact(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12))
    if kind == "clustered":
        x = x * 0.05 + np.repeat(rng.normal(size=(7, 12)), 100, axis=0)
    if kind == "ties":
        x = np.repeat(x[:20], 35, axis=0)
    x, ids = np.floor(64 * x).astype(np.int64), rng.permutation(700).astype(np.int64)
    q = ids % 10 == 0
    search = covertree.Search(x[q], ids[q], 5)
    for rows in np.split(np.arange(700), [250, 600]):
        search.add(x[rows], ids[rows])
    got = sorted((int(i), r + 1, int(search.ids[k, r]), int(search.scores[k, r])) for k, i in enumerate(ids[q]) for r in range(5))
    assert got == _plain(x, ids, 10, 5)
    if kind == "clustered":
        assert search.pairs < 70 * 700  # some pairs of nodes were pruned


def test_cover_tree_covers():
    x = np.random.default_rng(8).normal(size=(500, 3))

    def walk(node):
        assert (np.sqrt(((x[node.points] - node.centre) ** 2).sum(axis=1)) <= node.radius + 1e-9).all()
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children]).tolist()) == sorted(node.points.tolist())
        for child in node.children:
            walk(child)

    walk(covertree.build(x))


def test_top_k_operator(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 60)
    monkeypatch.setattr(covertree, "CELL", 100)
    monkeypatch.setattr(covertree, "PASS_BYTES", 6 * 8 * 2)  # two queries a pass
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[200:290] = x[199]  # a group of copies
    rows = [(int(k), [float(v) for v in x[k]], k % 3) for k in range(300)]
    rows[5], rows[50], rows[7], rows[8] = (5, None, 0), (50, [1.0, None], 0), (7, [float("nan")] * 6, 0), (8, [float("inf")] * 6, 0)
    rows += [(9, [float(v) for v in x[9]], 7), (None, [1.0] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    use = [k for k in range(300) if k not in (5, 50, 7, 8)]
    whole = np.floor(256 * x.astype(np.float64))
    got = sorted(tuple(r) for r in covertree.top_k(frame).collect())
    assert got == _plain(whole[use], np.array(use), 50, 5)
    assert sorted(tuple(r) for r in covertree.top_k(frame.repartition(9)).collect()) == got


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(covertree, "CELL", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + 0.02 * rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    visited = spark.sparkContext.accumulator(0)
    got = sorted(tuple(r) for r in covertree.top_k(frame, visited=visited).collect())
    assert got == _plain(np.floor(256 * x), np.arange(6000), 50, 5)
    assert 0 < visited.value < 0.2 * 120 * 6000


def test_top_k_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert covertree.top_k(spark.createDataFrame([], schema)).count() == 0
    assert covertree.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = covertree.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [-1.0, 0.0, 9.0])], schema)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 65536), (2, 0), (3, -65536)]
    big = covertree.top_k(spark.createDataFrame([(0, [1e300, 3e5]), (1, [0.0, 3e5]), (2, [1e300, 0.0])], schema)).orderBy("rank").collect()
    assert [r.vec_id for r in big] == [2, 1] and big[0].score == 2**63 - 1
