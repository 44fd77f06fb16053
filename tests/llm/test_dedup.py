"""op7 and op9, the components and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from docweave.llm import components, linededup, neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int"


def _plain_groups(docs, k, percent):
    sets, out = {}, {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    for i in ids:
        out[i] = (len(sets[i]), find(i), find(i) == i)
    return out


def _family(seed, n, base_words, changes):
    """Copies of a text, each with some words changed: many pairs lie close to the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(100000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "percent", "chunk"), [(3, 85, 1024), (3, 85, 16), (5, 80, 32)])
def test_groups_against_all_pairs(spark, monkeypatch, k, percent, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "TILE", max(8, chunk // 4))
    rng = random.Random(k)
    texts = _family(1, 120, 120, 7) + _family(2, 40, 60, 4) + ["Same Text here"] * 60 + ["same text HERE"] * 5 + [None, "", "  \t ", "one", "one", "two words", "Two words"]
    texts += [" ".join(f"r{rng.randrange(3000)}" for _ in range(rng.randint(1, 80))) for _ in range(120)] + ["common line shared by all " + " ".join(f"q{rng.randrange(9000)}" for _ in range(20)) for _ in range(50)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, None, None, None, 3) for i, t in docs], DOCS).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(frame, k, percent).collect()}
    assert got == _plain_groups(docs, k, percent)


def test_groups_defined_rows(spark):
    rows = [(1, "a b c d", None, None, None, 0), (1, "a b c d", None, None, None, 0), (2, "A b C d", None, None, None, 0), (None, "a b c d", None, None, None, 0), (4, None, None, None, None, 0), (5, "long " * 300_000, None, None, None, 0)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(rows, DOCS), 3, 85).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (4, 0, 4, True), (5, 1, 5, True)], key=str)
    assert neardup.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(12)
    x, y, z = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    docs = spark.createDataFrame([(1, x, "a", "s", 1, 0), (5, y, "a", "s", 1, 0), (5, x, "a", "s", 1, 0), (8, y, "a", "s", 1, 0), (9, z, "b", "s", 1, 0), (9, z, "a", "s", 1, 0), (4, "", "a", "s", 1, 0), (4, "", "a", "s", 1, 0)], DOCS)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.groups(docs, 3, 85).collect())
    assert got == [(1, 1, True), (4, 4, True), (4, 4, True), (5, 1, False), (5, 5, True), (8, 5, False), (9, 9, True), (9, 9, True)]
    left = sorted((r.doc_id, r.text, r.lang) for r in neardup.survivors(docs, 3, 85).collect())
    assert left == sorted([(1, x, "a"), (5, y, "a"), (9, z, "a"), (4, "", "a"), (4, "", "a")])


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    for similarity in (0.75, 0.85, 0.95):
        errors = []
        for _ in range(30):
            union = np.unique(rng.integers(0, 1 << 62, 600).astype(np.uint64))
            common = int(similarity * len(union))
            rest = len(union) - common
            a, b = np.r_[union[:common], union[common : common + rest // 2]], np.r_[union[:common], union[common + rest // 2 :]]
            s = neardup.odd_sketch(neardup.minhashes([a, b], 23, neardup.SKETCH_SAMPLES), neardup.SKETCH_BITS)
            errors.append(neardup.estimate(s[0], s[1:], neardup.SKETCH_SAMPLES)[0] - similarity)
        assert abs(np.mean(errors)) < 0.015 and np.max(np.abs(errors)) < 4 * (similarity * (1 - similarity) / neardup.SKETCH_SAMPLES) ** 0.5 + 0.02


@pytest.mark.parametrize(("n", "samples"), [(neardup.SKETCH_BITS, neardup.SKETCH_SAMPLES), (neardup.FINE_BITS, neardup.FINE_SAMPLES)])
@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_odd_sketches_lose_no_more_than_bands(threshold, n, samples):
    # exact for ideal hashes: samples that differ are binomial, each toggles two bits at random
    least = neardup.least_estimate(threshold, samples, n)
    odd = np.arange(n + 1)
    lost = 1 + n / (4 * samples) * np.log(np.maximum(1 - 2 * odd / n, 1e-9)) < least
    at, chance, loss = np.zeros(n + 1), (threshold) ** samples, 0.0
    at[0] = 1
    for m in range(samples + 1):
        loss += chance * at[lost].sum()
        chance *= (samples - m) / (m + 1) * (1 - threshold) / threshold
        for _ in range(2):
            at = np.r_[0, (at * (n - odd) / n)[:-1]] + np.r_[(at * odd / n)[1:], 0]
    assert loss <= neardup.MISS, loss


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(7, 7), (None, 3), (300, 300)]
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def _plain_dedup(docs, min_words):
    """The same rules, document by document."""
    parsed = {i: linededup.units((t or "").encode()) for i, t in sorted(docs)}
    count, seen, out = Counter(d for u in parsed.values() for d in u[3].tolist()), {}, {}
    for i, (start, end, words, digest) in parsed.items():
        again = [u for u, d in enumerate(digest.tolist()) if seen.setdefault(d, (i, u)) != (i, u)]
        runs, gone = [], []
        for u in again:
            if runs and runs[-1][-1] == u - 1:
                runs[-1].append(u)
            else:
                runs.append([u])
        for run in runs:
            per_word = sorted(count[int(digest[u])] for u in run for _ in range(int(words[u])))
            median = per_word[(len(per_word) + 1) // 2 - 1]
            while run and count[int(digest[run[0]])] > linededup.COMMON * median:
                run.pop(0)
            while run and count[int(digest[run[-1]])] > linededup.COMMON * median:
                run.pop()
            if sum(int(words[u]) for u in run) >= min_words:
                gone.append((int(start[run[0]]), int(end[run[-1]])))
        out[i] = gone
    return out


def test_dedup_against_plain_version(spark):
    rng = random.Random(4)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(4000)}"
    line = lambda n: " ".join(word() for _ in range(n))
    passage, header, docs = line(60), "A short header line", []
    for i in range(80):
        parts = [header, line(rng.randint(5, 60)), line(rng.randint(1, 90))]
        if i % 3 == 0:
            parts.insert(rng.randrange(4), passage)
        if i % 7 == 0:  # pasted into a line
            w = parts[-1].split()
            parts[-1] = " ".join(w[: len(w) // 2] + passage.split() + w[len(w) // 2 :])
        docs.append((i, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, passage), (103, "é " + passage.upper() + " ü"), (104, "same " * 5000), (105, "same " * 5000)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in docs], DOCS).repartition(5)
    got = {r.doc_id: r for r in linededup.dedup(frame).collect()}
    want, texts = _plain_dedup(docs, linededup.MIN_WORDS), dict(docs)
    assert len(got) == len(docs)
    for i, spans in want.items():
        data = (texts[i] or "").encode()
        assert [(s["start"], s["end"]) for s in got[i].removed_spans] == [(len(data[:a].decode()), len(data[:b].decode())) for a, b in spans]
        assert got[i].removed_chars == sum(len(data[a:b].decode()) for a, b in spans)
        assert (got[i].text is None) == (texts[i] is None) and got[i].lang == "en"
    whole = " ".join(passage.split()[10:50])
    assert sum(whole in (r.text or "") for r in got.values()) == 1  # the earliest keeps it, pasted or not
    assert all(header in got[i].text for i in range(80)) and got[102].text == "" and got[100].text is None
    assert not any(s for i, s in want.items() if i < 80 and i % 3 and i % 7)


@pytest.mark.parametrize("popular_first", [True, False])
def test_popular_passage_beside_a_rarer_one(spark, popular_first):
    rng = random.Random(8)
    line = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    header, popular, rare = "A short header line", line(60), line(100)
    both = [popular, rare] if popular_first else [rare, popular]
    docs = [(i, "\n".join([line(30), popular, line(30)])) for i in range(40)]
    docs += [(i, "\n".join([line(30), *both, line(30)])) for i in (50, 51)]
    docs += [(i, "\n".join([header, line(40)])) for i in range(60, 160)] + [(200, "\n".join([header, *both, header]))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in docs], DOCS)
    got = {r.doc_id: r.text for r in linededup.dedup(frame).collect()}
    assert [i for i, t in got.items() if popular in t] == [0] and [i for i, t in got.items() if rare in t] == [50]
    assert got[200] == f"{header}\n{header}"
    assert [got[i] for i in range(60, 160)] == [t for i, t in docs if 60 <= i < 160]


def test_runs_keep_short_common_ends():
    # numbers of units, their words and counts: the reviewed case, a heading above it, and ends that hold two popular passages
    run = lambda words, often: linededup.runs(np.arange(len(words)), np.array(words), np.array(often), 24).tolist()
    assert run([12] * 5 + [10] * 10, [3000] * 5 + [2] * 10) == list(range(15))
    assert run([4] + [12] * 5 + [10] * 10, [9000] + [3000] * 5 + [2] * 10) == list(range(1, 16))
    assert run([10] * 10 + [4], [2] * 10 + [9000]) == list(range(10))
    assert run([20, 20] + [10] * 10, [9000, 3000] + [2] * 10) == list(range(12))
    assert run([23, 23], [9000, 2]) == [] and run([23], [2]) == []
    assert linededup.MIN_WORDS == 30


def test_passages_inside_lines_are_caught(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passages = [line(51) for _ in range(300)]
    docs = [(1000 * k + i, f"{line(60)} {p} {line(60)}") for k in (0, 1) for i, p in enumerate(passages)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in docs], DOCS)
    got = {r.doc_id: r.n_removed for r in linededup.dedup(frame).collect()}
    assert not any(got[i] for i in range(300))
    assert sum(got[1000 + i] == 0 for i in range(300)) <= 1  # 31 with a reach of 6


def test_texts_that_share_an_id_are_cut_by_their_own_repeats(spark):
    rng = random.Random(13)
    a, b, u = ("\n".join(" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(50)) for _ in range(2)) for x in "abu")
    docs = spark.createDataFrame([(i, t, None, None, None, 0) for i, t in ((3, a), (7, u), (7, a), (9, b))], DOCS)
    got = sorted((r.doc_id, r.text) for r in linededup.dedup(docs).collect())
    assert got == sorted([(3, a), (7, u), (7, ""), (9, b)])


def test_dedup_against_every_stretch_of_words(spark):
    """Independent of units: what is taken out stands earlier word for word, and of stretches of 60 words that do little is left."""
    rng = random.Random(14)
    line = lambda n: " ".join(f"v{rng.randrange(10**7)}" for _ in range(n))
    shared, docs = [line(n) for n in (51, 60, 75, 120)], []
    for i in range(120):
        words = line(rng.randint(20, 150)).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] += "\n"
        for p in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randrange(len(words))
            words[at:at] = p.split()
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in docs], DOCS).repartition(4)
    got = {r.doc_id: r for r in linededup.dedup(frame).collect()}
    before, clean = "", 0
    for i, text in docs:
        for s in got[i].removed_spans:
            assert f" {' '.join(text[s.start : s.end].split())} " in f" {before} "
        had = [p for p in shared if p in " ".join(text.split()) and p in before]
        left = set(got[i].text.split())
        for p in had:
            assert sum(w in left for w in p.split()) <= 31 or len(p.split()) == 51
        clean += not had
        assert had or got[i].text == text
        before += " " + " ".join(text.split())
    assert clean > 20


def test_units_cover_words_and_keep_lines():
    text = "one two\nthree  four\r\nfive " + "six " * 40 + "\n\n" + " ".join(f"w{k}" for k in range(200))
    start, end, words, _ = linededup.units(text.encode())
    joined = [text.encode()[a:b].decode() for a, b in zip(start, end, strict=True)]
    assert " ".join(joined).split() == text.split() and sum(words) == len(text.split())
    assert not any("\n" in j for j in joined)
    assert all((a[1:] >= b[:-1]).all() for a, b in ((start, end),))


def test_dedup_defined_rows(spark):
    p = " ".join(f"word{k}" for k in range(60))
    rows = [(1, p, None, None, None, 0), (1, p, None, None, None, 0), (None, p, None, None, None, 0), (2, p + "\n" + p, None, None, None, 0)]
    got = sorted(((r.doc_id, r.text) for r in linededup.dedup(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, p), (1, p), (None, p), (2, "")], key=str)
    assert linededup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    en, de = "the house and a garden with trees in summer".split(), "das haus und der garten mit bäumen im sommer".split()
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "s", "en", "er", str(rng.randrange(99))]) for _ in range(n))
    docs = [(i, text(en if i % 2 else de, 150), "en" if i % 2 else "de", f"s{i % 3}", None, 0) for i in range(60)]
    passage = text(en, 70)
    docs += [(100, docs[3][1], "en", "s0", None, 0), (101, docs[3][1] + " more", "en", "s0", None, 0), (102, "12345 !!", None, None, None, 0), (103, None, None, None, None, 0)]
    docs += [(110 + k, text(en, 80) + "\n" + passage, "en", "s1", None, 0) for k in range(4)]
    spark.createDataFrame(docs, DOCS).drop("bucket").write.parquet(f"{tmp_path}/documents.parquet")
    current, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, current, str(tmp_path)).write.parquet(path)
        current = spark.read.parquet(path)
        kept[name] = current.toPandas()
        if name != "packing":
            assert tuple(current.columns) == corpus_pipeline.COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "source_mixing", "packing"]
    assert set(kept["language_id"]["doc_id"]) == {d[0] for d in docs} - {102, 103}
    assert set(kept["near_duplicates"]["doc_id"]) == set(kept["language_id"]["doc_id"]) - {100, 101}
    deduped = kept["substring_dedup"]
    assert set(deduped["doc_id"]) == set(kept["near_duplicates"]["doc_id"]) and (deduped["text"].str.len() == deduped["n_chars"]).all()
    middle = " ".join(passage.split()[15:55])
    assert deduped["text"].str.contains(middle, regex=False).sum() == 1
    mixed = kept["source_mixing"]["doc_id"].value_counts()
    assert set(mixed.index) <= set(deduped["doc_id"]) and mixed.max() <= 2
    packed = kept["packing"]
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all() and set(packed["doc_id"]) == set(mixed.index)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    text = lambda: " ".join(f"{rng.choice(['the', 'and', 'house', 'garden'])}{rng.choice(['', 's', 'er'])} w{rng.randrange(10**5)}" for _ in range(60))
    x, y = text(), text()
    rows = [(1, x, "en", None, None, 0), (5, y, "en", "s0", None, 0), (5, x, "en", "s1", None, 0), (8, y, None, "s1", None, 0), (5, y, "en", "s0", None, 0), (None, x, "en", "s0", None, 0), (9, None, "en", "s0", None, 0), (9, "", "en", None, None, 0)]
    rows += [(20 + k, text(), "en", f"s{k % 2}", 0, 0) for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left if r.text not in {t[1] for t in rows[8:]}) == sorted([(1, x), (5, y), (0, x), (9, ""), (9, "")])
    cut = {(r.doc_id, r.source): r.text for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert cut[1, None] == x and cut[5, "s0"] == y and cut[5, "s1"] == "" and cut[8, "s1"] == "" and cut[None, "s0"] == x and cut[9, "s0"] is None
    mixed = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert max(mixed.values()) <= 4 and mixed[5, y, "s0"] in (0, 2, 4)  # two equal rows, each at most twice
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS)
