"""Language identification by bit-sliced Bloom filters over character n-grams.

Letters are coded in six bits and three codes are an n-gram. Counts of every language's n-grams over all training texts give, by their
share of the language's n-grams, the set of each language; the sets are stored in one Bloom filter whose slots are bitmasks of languages, so the
bitwise and of an n-gram's slots is the mask of all languages that contain it. A text's set bits are counted per language and corrected
for each language's false positives; the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare, written

UNKNOWN = "und"
GRAMS = 1 << 18
HASHES = 3
#: An n-gram belongs to a language if it has at least this share of the language's n-grams, and RATIO of its largest share in any.
MIN_SHARE = 2e-5
RATIO = 0.05

#: Fixed value: Unicode's categories of letters; numerals such as ½, ², ① and Ⅷ are none.
_LETTER = regex.compile(r"\p{L}")
#: Languages that a model holds at most: an n-gram's mask has a bit for each.
MAX_LANGUAGES = 4096


def _codes() -> np.ndarray:
    """Byte to code: 0 for bytes that are no letters, 1 to 26 for a to z, 27 to 63 for bytes of other letters."""
    out = np.zeros(256, np.uint32)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[128:] = 27 + np.arange(128) % 37
    return out


CODES = _codes()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts, where each text's begin, and the end). N-grams have a letter in the middle."""
    data = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    code = CODES[np.frombuffer(b"".join(data), np.uint8)]
    ends = np.cumsum([0] + [len(d) for d in data])
    middle = np.flatnonzero(code[1:-1]) + 1 if len(code) > 2 else np.empty(0, np.int64)
    gram = (code[middle - 1] << np.uint32(12)) | (code[middle] << np.uint32(6)) | code[middle + 1]
    return gram, np.searchsorted(middle, ends)


def counted(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n) over all rows; each task counts before its rows are shuffled."""
    prepare(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(n[there])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                gram, _ = grams([t for la, t in zip(langs, texts, strict=True) if la == lang])
                if lang not in held:
                    if len(held) >= 64:
                        yield from done()
                    held[lang] = np.zeros(GRAMS, np.int64)
                held[lang] += np.bincount(gram, minlength=GRAMS)
        yield from done()

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(over, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """slots: language bitmasks, ceil(languages / 64) words each; false: each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """(n-grams, words) masks of the languages that contain each n-gram."""
        out = None
        for h in range(HASHES):
            slot = self.slots[places(gram, h, len(self.slots))]
            out = slot if out is None else out & slot
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t if t and _LETTER.search(t) else "" for t in texts]
        n_languages = len(self.languages)
        if not n_languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        gram, at = grams(known)
        mask = self.masks(gram)
        n = np.diff(at)
        hits = np.zeros((len(texts), n_languages))
        full = np.flatnonzero(n)
        for k in range(n_languages):
            if len(full):
                bit = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[full, k] = np.add.reduceat(bit, at[:-1][full], dtype=np.int64)
        share = np.maximum(0, (hits / np.maximum(n, 1)[:, None] - self.false) / (1 - self.false))
        best = share.argmax(axis=1)
        score = share.max(axis=1) / np.maximum(share.sum(axis=1), 1e-12)
        return [self.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), known, strict=True)], np.where([bool(t) for t in known], np.clip(score, 0, 1), 0.0)


def places(gram: np.ndarray, h: int, n: int) -> np.ndarray:
    """Multiplicative hashing to n slots, a power of two."""
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[h]
    return ((gram.astype(np.uint64) + np.uint64(1)) * np.uint64(odd)) >> np.uint64(64 - (n.bit_length() - 1))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of all rows of ``docs`` whose language and text aren't null.

    The driver gets the n-grams that have MIN_SHARE of their language's: 1 / MIN_SHARE a language at most. More than MAX_LANGUAGES languages are an error.
    """
    n = written(counted(docs, lang_col, text_col), "grams")
    totals = n.groupBy("lang").agg(F.sum("n").alias("total")).where("total > 0").limit(MAX_LANGUAGES + 1)
    totals = written(totals, "totals")
    if totals.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # of MAX_LANGUAGES rows at most
    shares = n.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= MIN_SHARE)
    rows = shares.toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    gram = rows["gram"].to_numpy(np.int64)
    largest = np.zeros(GRAMS)
    np.maximum.at(largest, gram, rows["share"].to_numpy())
    keep = rows["share"].to_numpy() >= RATIO * largest[gram]
    gram = gram[keep]
    number = np.searchsorted(np.array(languages, object), rows["lang"].to_numpy()[keep]) if len(gram) else np.empty(0, np.int64)
    size = 1 << max(16, (8 * max(1, len(np.unique(gram))) - 1).bit_length())
    slots = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
    bit = np.uint64(1) << (number % 64).astype(np.uint64)
    for h in range(HASHES):
        np.bitwise_or.at(slots, (places(gram, h, size).astype(np.int64), number // 64), bit)
    filled = np.array([((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Model(languages, slots, np.minimum(filled**HASHES, 0.5))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model knows no language. Columns of those
    names in ``docs`` are replaced; all others are kept. Texts are never cut.
    """
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text_col)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["lang_pred string, score double"])
    return map_batches(docs.select(*keep), rows, schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def identify(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, held_out, lang_pred, score and the columns ``keep``: learned from the labelled rows that aren't held out, applied to all.

    Rows without an id are not learned from and count as held out. lang, source and id are no inputs of a prediction.
    """
    held_out = F.coalesce(remainder(docs[id_col], 4) == 2, F.lit(True))
    model = fit(docs.where(~held_out))
    out = predict(docs.select(*dict.fromkeys([id_col, "text", *keep]), held_out.alias("held_out")), model)
    return out.select(*dict.fromkeys([id_col, *keep]), "held_out", "lang_pred", "score")
