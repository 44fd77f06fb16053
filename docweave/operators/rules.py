"""Rule cascades over sentences: who speaks in a passage, what penalty a sentence states, which passages an answer names, bounded excerpts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import SMALL, TENS
from .text import CITATION


def citations(text: Column) -> Column:
    """Statute citations of a text in order."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


@dataclass(frozen=True)
class Speakers:
    """Patterns, matched in lower case on a sentence with single blanks, of each kind of passage that isn't the court's own reasoning."""

    statute: str
    report: str  # the court reports what a party says
    party: str  # a party opens the sentence and states its case
    endorsed: str  # the court adopts it
    goes_on: str  # the report continues
    court: str  # the court speaks
    recital: str
    chapters: str  # titles of chapters that hold no reasoning
    reasons: str  # words of a title that make it one that does
    introduces: str = r"(?:provides?|reads?|states?)(?: as follows)?\s*:$"
    quotation: str = r"[“\"«]"


def _has(pattern: str, text: str) -> bool:
    return bool(pattern) and re.search(pattern, text) is not None


def speakers(sentences: Iterable[tuple[str, str, str | None, bool]], rules: Speakers) -> list[str | None]:
    """Per (kind, text, chapter, begins a paragraph) why it isn't the court's reasoning, None if it is. A report and a quoted provision carry on."""
    out: list[str | None] = []
    carried, pending, quoting = False, False, False
    for kind, raw, chapter, fresh in sentences:
        text = " ".join(raw.replace("’", "'").split()).lower()
        reason = None
        if kind == "heading":
            carried = pending = quoting = False
        elif kind in ("header", "signature"):
            reason = "header_or_signature"
        elif pending or (quoting and (not fresh or re.match(rules.quotation, text))):
            quoting, pending, reason = True, False, "statute_quote"
        else:
            quoting = False
            endorsed = _has(rules.endorsed, text)
            court = endorsed or _has(rules.court, text)
            title = (chapter or "").strip().lower()
            if _has(rules.statute, text) and (_has(rules.quotation, text) or re.search(CITATION, raw)):
                carried, pending, reason = False, _has(rules.introduces, text), "statute_quote"
            elif _has(rules.report, text) or (not endorsed and _has(rules.party, text)) or (carried and not court and _has(rules.goes_on, text)):
                carried, reason = True, "party_position"
            else:
                carried = False
                if not court and _has(rules.recital, text):
                    reason = "charge_recital"
                elif re.match(rf"(?:the\s+)?(?:{rules.chapters})\b", title) and not _has(rules.reasons, title):
                    reason = "non_reasoning_section"
        out.append(reason)
    return out


def classified(rows: DataFrame, by: str, order: str, rules: Speakers) -> DataFrame:
    """``rows`` (by, order, kind, text, chapter, fresh) with reason; a document is walked in order, as each passage depends on those before it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", reason string"

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(reason=speakers(zip(group["kind"], group["text"].fillna(""), group["chapter"].where(group["chapter"].notna(), None), group["fresh"], strict=True), rules))

    return rows.groupBy(by).applyInPandas(walk, schema)


#: What a sentence says of a penalty's stage, in the order in which the stages are tried. Each cue is a begin of a word, or a phrase, and what
#: must follow it within so many characters; cues of the last column count in judgments only.
CUES: Sequence[tuple[str, tuple[str, ...], tuple[str, ...], int, bool]] = (
    ("requested", ("prosecut*",), ("request*", "seek*", "ask*"), 100, False),
    ("imposed", ("sentenc*",), ("to suffer",), 80, True),
    ("statutory", ("*shall be punished*", "*is to be punished*", "*punishable*", "*liability to a sentence*", "*liable to*", "*maximum penalty*", "*maximum sentence*", "*statutory*", "*penalty of*"), (), 0, False),
    ("imposed", ("sentence", "sentences", "sentenced"), ("imprison*", "prison*", "death*", "fine*"), 100, True),
)
#: Phrases of penalties, of their absence, and of the bounds of a term.
PENAL = ("imprison", "prison", "sentenc", "death penalty", "fine")
ABSENT = ("not request", "not seek", "not sentenc", "no prison sentence", "no custodial sentence", "no imprisonment", "no term of imprisonment", "without imprisonment", "acquitt")
AT_MOST, AT_LEAST = ("up to", "not more than", "at most", "maximum"), ("not less than", "at least", "minimum")
BOUND_REACH, LIFE_REACH, MOST_UNITS = 35, 25, 10_000


def _places(text: str, cue: str) -> list[tuple[int, int]]:
    """Where a cue stands: a phrase of whole words, with * for the rest of a word or anything around."""
    body = re.escape(cue.strip("*"))
    return [m.span() for m in re.finditer(("" if cue.startswith("*") else r"\b") + body + ("" if cue.startswith("*") else r"\w*" if cue.endswith("*") else r"\b"), text)]


def stage_of(text: str, judgment: bool) -> str | None:
    """The stage of the first cue that a sentence in lower case has."""
    for stage, leads, follows, reach, only in CUES:
        if only and not judgment:
            continue
        ends = [end for cue in leads for _, end in _places(text, cue)]
        after = [start for cue in follows for start, _ in _places(text, cue)]
        if ends and (not follows or any(0 <= start - end <= reach for end in ends for start in after)):
            return stage
    return None


@dataclass(frozen=True)
class Term:
    """A length of time as written: from ``low`` to ``high`` units, and whether it is a range or ends in a half."""

    start: int
    end: int
    low: float
    high: float
    unit: str
    plain: bool


class _Reader:
    """Reads terms from the tokens of a sentence, from left to right: number [(figures)] [to number [(figures)]] [and a half] unit."""

    TOKEN = re.compile(r"[a-z]+|\d+(?:\.\d+)?|[-–()]|[^\sa-z\d]")

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(m[0], m.start(), m.end()) for m in self.TOKEN.finditer(text)]

    def word(self, k: int) -> str:
        return self.tokens[k][0] if k < len(self.tokens) else ""

    def small(self, k: int) -> tuple[float, int] | None:
        """A number under a hundred in words, and the token after it."""
        word = self.word(k)
        if word in TENS:
            ones = k + 2 if self.word(k + 1) == "-" else k + 1
            n = SMALL.get(self.word(ones), 0)
            return (TENS[word] + n, ones + 1) if 0 < n < 10 else (TENS[word], k + 1)
        return (SMALL[word], k + 1) if word in SMALL else None

    def number(self, k: int) -> tuple[float, int] | None:
        if self.word(k)[:1].isdigit():
            return float(self.word(k)), k + 1
        found = self.small(k)
        if found and 0 < found[0] < 10 and self.word(found[1]) == "hundred":
            rest = self.small(found[1] + 1 + (self.word(found[1] + 1) == "and"))
            found = (100 * found[0] + rest[0], rest[1]) if rest else (100 * found[0], found[1] + 1)
        return found

    def figured(self, k: int) -> tuple[float, int] | None:
        """A number and, in brackets, the same in figures."""
        found = self.number(k)
        if found and self.word(found[1]) == "(" and self.word(found[1] + 1)[:1].isdigit() and self.word(found[1] + 2) == ")":
            return found[0], found[1] + 3
        return found

    def term(self, k: int) -> tuple[Term, int] | None:
        start = self.tokens[k][1]
        if start and (self.text[start - 1].isalnum() or self.text[start - 1] in "_-"):
            return None
        low = self.figured(k)
        if not low:
            return None
        at, high = low[1], None
        if self.word(at) in ("to", "-", "–") and (high := self.figured(at + 1)):
            at = high[1]
        half = 0.0
        if self.word(at) == "and" and self.word(at + 1 + (self.word(at + 1) == "a")) == "half":
            half, at = 0.5, at + 2 + (self.word(at + 1) == "a")
        at += self.word(at) == "-"
        unit = self.word(at).rstrip("s")
        if unit not in ("year", "month", "day") or self.word(at) not in (unit, unit + "s"):
            return None
        least, most = low[0], (high or low)[0]
        return Term(start, self.tokens[at][2], least + (0 if high else half), most + half, unit, not high and not half), at + 1

    def terms(self) -> list[Term]:
        out, k = [], 0
        while k < len(self.tokens):
            found = self.term(k)
            if found:
                out.append(found[0])
            k = found[1] if found else k + 1
        return out


def _term_in_months(text: str, terms: Sequence[Term], marks: Sequence[int]) -> tuple[float | None, float | None]:
    """(least, most) months of the term that stands nearest to a mark. Days aren't turned into months."""
    k = min(range(len(terms)), key=lambda n: min(abs(terms[n].start - mark) for mark in marks))
    for years, months in ((terms[j], terms[j + 1]) for j in (k - 1, k) if 0 <= j < len(terms) - 1):
        joined = text[years.end : months.start].split() == ["and"]
        if joined and years.plain and months.plain and (years.unit, months.unit) == ("year", "month") and years.low <= MOST_UNITS and months.low < 12:
            return (years.low * 12 + months.low,) * 2
    term = terms[k]
    if term.unit == "day" or not term.low <= term.high <= MOST_UNITS:
        return None, None
    factor = 12 if term.unit == "year" else 1
    least, most = term.low * factor, term.high * factor
    before = text[max(0, term.start - BOUND_REACH) : term.start]
    if least == most and any(phrase in before for phrase in AT_MOST):
        return None, most
    if least == most and any(phrase in before for phrase in AT_LEAST):
        return least, None
    return least, most


def penalty(sentence: str, judgment: bool) -> tuple[str, str, float | None, float | None] | None:
    """(stage, kind, least months, most months) that a sentence states, None if none."""
    text = " ".join(sentence.split()).lower()
    if not any(word in text for word in PENAL) or any(phrase in text for phrase in ABSENT):
        return None
    stage = stage_of(text, judgment)
    marks = [start for cue in ("*imprison", "prison") for start, _ in _places(text, cue)]
    lives = [end for cue in ("life", "lifelong", "life-long", "life long") for _, end in _places(text, cue)]
    for_life = any(0 <= start - end <= LIFE_REACH for end in lives for cue in ("imprisonment", "prison") for start, _ in _places(text, cue))
    months: tuple[float | None, float | None] = (None, None)
    if "death penalty" in text or "sentenced to death" in text:
        kind = "death_penalty"
    elif for_life or "imprisonment for life" in text:
        kind = "life_imprisonment"
    elif "prison" not in text:
        kind = "fine" if any(_places(text, cue) for cue in ("fine", "fines", "fined")) else "other"
    else:
        kind, terms = "imprisonment", _Reader(text).terms()
        months = _term_in_months(text, terms, marks or [0]) if terms else months
    return (stage, kind, *months) if stage else None


#: What answers that name no passage say.
NO_PASSAGE = frozenset(("", "none", "no", "nothing", "n/a", "null", "-", "no passage", "no passages"))


def named(items: Sequence[str], count: int) -> tuple[list[int], bool]:
    """The passages from 1 to ``count`` that an answer names, and whether it holds anything else: an unreadable answer proves nothing.

    An item is P, a number and a colon before any words, or numbers with or without P between commas and "and".
    """
    entries: list[str] = []
    for item in items:
        head, colon, _ = item.partition(":")
        quoted = colon and re.fullmatch(r"\s*P\d+\s*", head)
        entries += [head] if quoted else re.sub(r"\band\b", ",", item).split(",")
    plain = [entry.strip() for entry in entries]
    read = [int(digits) if (digits := entry.removeprefix("P")).isdecimal() and 1 <= int(digits) <= count else None for entry in plain]
    unread = [entry for entry, number in zip(plain, read, strict=True) if number is None]
    return sorted({n for n in read if n is not None}), any(entry.lower().strip(".") not in NO_PASSAGE for entry in unread)


@dataclass
class Budget:
    """Spans taken one after another until ``left`` characters are used up; those inside one that is taken, and what is left of under ``least``, aren't."""

    left: int
    least: int
    taken: list[tuple[int, int]] = field(default_factory=list)

    def take(self, start: int, end: int) -> None:
        end = min(end, start + self.left)
        covered = max((b for a, b in self.taken if a <= start), default=-1) >= end
        if not covered and end - start >= self.least:
            self.taken.append((start, end))
            self.left -= end - start


def excerpts(text: str, patterns: Sequence[str], share: int, least: int = 100, before: int = 200, after: int = 800, head: int = 500, tail: int = 900) -> list[tuple[int, int]]:
    """Windows around the first and last match of each pattern, then the text's head and tail, within ``share`` characters."""
    budget = Budget(share, least)
    for pattern in patterns:
        spans = [m.span() for m in re.finditer(pattern, text, re.I | re.S)]
        for start, end in dict.fromkeys(spans[:1] + spans[-1:]):
            budget.take(max(0, start - before), min(len(text), end + after))
    budget.take(0, min(head, len(text)))
    budget.take(max(0, len(text) - tail), len(text))
    return budget.taken


def excerpts_of(texts: Sequence[str], patterns: Sequence[str], total: int, least_share: int = 1500) -> list[list[tuple[int, int]]]:
    """excerpts() of several sources under a total: each has an equal share, or ``least_share``, of what is left."""
    out = []
    for text in texts:
        out.append(excerpts(text, patterns, min(total, max(least_share, total // max(1, len(texts))))))
        total -= sum(b - a for a, b in out[-1])
    return out


def mapped(rows: DataFrame, function: Callable[..., tuple | None], inputs: Sequence[str], keep: Sequence[str], schema: str) -> DataFrame:
    """Rows for which ``function`` of the input columns gives a tuple: the columns ``keep`` and that tuple by ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in added.fields]
    whole = StructType([*rows.select(*keep).schema.fields, *added.fields])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(keep) + k).to_pylist() for k in range(len(inputs))]
            found = [(k, got) for k, args in enumerate(zip(*columns, strict=True)) if (got := function(*args)) is not None]
            if found:
                at = pa.array([k for k, _ in found])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), *(pa.array([g[k] for _, g in found], kind) for k, kind in enumerate(types))], names=whole.names)

    return rows.select(*keep, *[F.col(c).alias(f"in_{k}") for k, c in enumerate(inputs)]).mapInArrow(over, whole)
