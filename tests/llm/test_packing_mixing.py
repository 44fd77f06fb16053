"""op3 and op10: packing and mixing."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import mixing, packing
from docweave.llm.queries import ORACLE, op3_best_two_fit, op10_source_mixing, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, offset int"


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(1, 60))}
    plan = packing.plan(counts, capacity)
    used = defaultdict(int)
    for bins, items in plan:
        assert bins > 0 and sum(length * k for length, k in items) <= capacity
        for length, k in items:
            used[length] += bins * k
    assert used == counts
    total = sum(length * n for length, n in counts.items())
    assert sum(b for b, _ in plan) <= max(-(-total // capacity) + 1, 11 * total // (9 * capacity) + 1 + sum(n for length, n in counts.items() if 2 * length > capacity))


def test_best_two_fit_beats_greedy():
    # greedy leaves 6 + 3 in a bin of 10; the two pieces of 2 fill it
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]
    assert packing.plan({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_places_are_gapless():
    rng = np.random.default_rng(3)
    length = rng.integers(1, 65, 3000)
    length[:900] = 7  # a third of all pieces has one length
    slots = packing.Slots(packing.plan(dict(zip(*np.unique(length, return_counts=True), strict=True)), 64))
    rank = np.empty(len(length), np.int64)
    for n in np.unique(length):
        rank[length == n] = np.arange((length == n).sum())
    to, at = slots.place(length, rank)
    ends = defaultdict(int)
    for b, o, n in sorted(zip(to.tolist(), at.tolist(), length.tolist(), strict=True)):
        assert o == ends[b]
        ends[b] += n
    assert max(ends.values()) <= 64 and len(ends) == slots.bins


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    rng = random.Random(1)
    letters = "aé ΣσςİıßǅŉﬀǺ̀  \x85\x1c\x1f\x0b\n\t'stre0५中😀.,'s'LL,."
    texts = ["", " ", "A.,.B. x, ", "a <|endoftext|>b", "<|ENDOFTEXT|> THE.", None] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    ids, at = own(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_packing_query(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [None, "", "one two", "one two", "word " * 5000, "a" * 30_000, "é."] + [f"text number {k} " * (k % 90) for k in range(300)]
    docs = [(k, t, None, None, None, 1, 2) for k, t in enumerate(texts)] + [(2, "one two", None, None, None, 1, 2)]
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_best_two_fit(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = []
    for k, t, *_ in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k, n, 2048 * n, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) == -(-sum(w[3] for w in want) // 2048)


def test_packing_empty_and_bad_lengths(spark):
    assert packing.pack(packing.tokenize(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(1, None)], "id long, length long")).collect()


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, f"some words {k} " * k, None, None, None, 0, 0) for k in range(60)], DOCS)
    pieces = packing.tokenize(docs, tokenizer_path(), capacity=256)
    got = packing.sequences(packing.pack(pieces, capacity=256)).collect()
    assert sum(r.length for r in got) == sum(r.length for r in pieces.collect())
    assert all(len(r.ids) == 4 * r.length <= 1024 for r in got)


def _documents(seed, n):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "zz", "c"]
    return [(k, rng.choice([None, "", "w " * rng.randint(0, 40), "one\x0btwo\tthree  "]), "en", "hot" if rng.random() < 0.35 else rng.choice(sources), 0, 0, 0) for k in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(1, 400), (2, 7), (3, 1)])
def test_mixing_against_sql(spark, tmp_path, seed, n):
    spark.createDataFrame(_documents(seed, n), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op10_source_mixing(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(c.execute(ORACLE["op10_source_mixing"]).fetchall())


def test_mixing_targets_and_reruns(spark):
    docs = spark.createDataFrame(_documents(9, 3000), DOCS)
    rows = mixing.mix(docs).collect()
    taken, target, size, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r.size
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert all(target[s] <= 2 * size[s] for s in target)
    weights = dict(zip(sorted((s for s in target if s is not None), key=lambda s: s.encode()) + [None], [5, 2, 1] * 3, strict=False))
    level = {s: target[s] / weights[s] for s in target if target[s] < 2 * size[s]}
    assert len({round(v, 6) for v in level.values()}) <= 1
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None, "a", 0, 0, 0), (None, "", None, None, 0, 0, 0)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_mixed_rows_of_one_id_in_two_sources(spark):
    rows = [(k, f"w{k} " * 20, "en", f"s{k % 3}", 0, 0, 0) for k in range(60)] + [(7, "other " * 20, "en", "s0", 0, 0, 0), (None, "a b", "en", None, 0, 0, 0), (None, "c d", "en", None, 0, 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.copies
    got = Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect())
    assert got == +want and max(got[7, "s0"], got[7, "s1"]) <= 2
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0


def test_marks_after_letters_are_no_new_words():
    """Ids are those of whole texts, while words that differ in the marks at their ends are encoded once."""
    coder = packing.Encoder(tokenizer_path())
    texts = ["word word$$$ word&&& Word!! word-word a.'s it's it''s x='ll (y)'t z≠ á. é.b q_r 1.2 3a.4 ok:“no”.", "w.,;:!?x [a]b {c}`d ~e^f g\\h i/j k@l m#n", "say <|endoftext|> a$b", "ǅ.x İ, i̇. K$"]
    for text in texts:
        ids, ends = coder(pa.array([text]))
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]
    assert "word$$$" not in coder.words and "word" in coder.words
