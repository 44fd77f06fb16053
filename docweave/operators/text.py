"""Text operators in built-in functions: lines and blocks with code-point offsets, headings, captions, dates, phrases, passages of prose.

Offsets are code points. They come from lengths of pieces or from instr, never from regexp_instr, which counts UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a statute citation, a written date and a month look like, and common English words.
CITATION = r"((?:\b(?:Article|Art\.|Section|Sec\.|Rule|Regulation|Paragraph|Para\.|s\.)|§)\s*\d+[A-Za-z]?(?:\(\d+\))*)"
MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?"
WRITTEN_DATE = (
    rf"(?i)(\b\d{{1,2}}(?:st|nd|rd|th)?(?:\s+day)?(?:\s+of)?\s+{MONTH},?\s+\d{{4}}\b|\b{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
    r"|\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b)"
)
ENGLISH_WORDS = "the and of to that with which was were for this has have been".split()
MONTHS = "january february march april may june july august september october november december".split()


def placed(parts: Column, gap: int = 1) -> Column:
    """start and text of parts that follow each other with ``gap`` characters between them: one pass, and only numbers are carried along."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(parts, none, lambda s, x: F.struct((s["at"] + F.length(x) + gap).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]
    return F.zip_with(starts, parts, lambda at, x: F.struct(at.alias("start"), x.alias("text")))


def pieces(df: DataFrame, id_col: str, text: Column, separator: str = "\n") -> DataFrame:
    """id, line (from 0), start and text of the parts of a text between ``separator``, offsets of the whole text."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(placed(F.split(text, F.lit(separator)), len(separator))).alias("line", "part_"))
    return rows.select("id", "line", "part_.start", "part_.text")


def trimmed(rows: DataFrame) -> DataFrame:
    """Spans without white space at their ends; blank ones are left out."""
    inner = F.regexp_extract("text", r"(?s)^\s*(.*?)\s*$", 1)
    lead = F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))
    out = rows.withColumn("inner_", inner).where("inner_ <> ''")
    return out.withColumn("start", F.col("start") + lead).withColumn("text", F.col("inner_")).drop("inner_").withColumn("end", F.col("start") + F.length("text"))


def heading_style(line: Column) -> Column:
    """roman, decimal, digit, letter, paren, caps or title for a line that can be a heading, else null."""
    t = F.trim(line)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    caps = (F.length(letters) > 2) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    words = F.size(F.split(t, r"\s+"))
    title = (words <= 10) & t.rlike(r"^(?:\p{Lu}[\p{L}\p{N}'-]*(?:\s+|$)|(?:a|an|and|as|at|by|for|in|of|on|or|the|to|with)(?:\s+|$))+$") & t.rlike(r"^\p{Lu}") & (F.length(letters) > 3)
    style = (
        F.when(t.rlike(r"^[IVXLC]+[.)]\s+\S"), "roman")
        .when(t.rlike(r"^\d+(?:\.\d+)+\.?\s+\S"), "decimal")
        .when(t.rlike(r"^\d+[.)]\s+\S"), "digit")
        .when(t.rlike(r"^[A-Z][.)]\s+\S"), "letter")
        .when(t.rlike(r"^\([a-z0-9]{1,3}\)\s+\S"), "paren")
        .when(caps, "caps")
        .when(title, "title")
    )
    short = (F.length(t) > 0) & (F.length(t) <= 90) & (words <= 12) & ~t.rlike(r"[;!?]$")
    return F.when(short & (~t.rlike(r"[.,:]$") | caps), style)


def sections(lines: DataFrame, by: str = "id") -> DataFrame:
    """Lines with style, section (the last heading at or before) and chapter (the last heading of the text's first numbered style, or of capitals)."""
    w = Window.partitionBy(by).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    styled = lines.withColumn("style", heading_style(F.col("text")))
    heading = F.when(F.col("style").isNotNull(), F.trim("text"))
    numbered = F.when(F.col("style").isin("roman", "decimal", "digit", "letter", "paren"), F.col("style"))
    styled = styled.withColumn("first_", F.first(numbered, ignorenulls=True).over(upto))
    is_chapter = F.col("style").isNotNull() & ((F.col("style") == "caps") | F.col("first_").isNull() | (F.col("style") == F.col("first_")))
    styled = styled.withColumn("section", F.last(heading, ignorenulls=True).over(upto)).withColumn("chapter", F.last(F.when(is_chapter, F.trim("text")), ignorenulls=True).over(upto))
    return styled.drop("first_")


def label_values(lines: DataFrame, label: str, by: str = "id") -> DataFrame:
    """The value of the first ``label: value`` line of each text."""
    prefix = label.lower() + ":"
    value = F.trim(F.substr("text", F.lit(len(prefix) + 1)))
    found = lines.where(F.lower("text").startswith(prefix)).withColumn("value", value).where("value <> ''")
    return found.groupBy(by).agg(F.min_by("value", "line").alias("value"))


def occurrences(df: DataFrame, text_col: str, phrase: Column, most: int = 3) -> DataFrame:
    """Start offsets of the first ``most`` occurrences of a phrase, any white space between its words and any case; one row each.

    The found text is located by splitting at the matches, so offsets are code points.
    """
    escaped = F.concat(F.lit(r"(?i)"), F.array_join(F.transform(F.split(F.trim(phrase), r"\s+"), lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), r"\s+"))
    out = df.withColumn("pattern_", escaped)
    matches = F.expr(f"regexp_extract_all({text_col}, pattern_, 0)")
    parts = F.expr(f"split({text_col}, pattern_)")
    out = out.withColumn("matches_", matches).where(F.size("matches_") > 0).withColumn("parts_", parts).withColumn("total", F.size("matches_"))
    k = F.col("k_")
    before = F.aggregate(F.slice("parts_", F.lit(1), k + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("matches_", F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
    out = out.withColumn("k_", F.explode(F.sequence(F.lit(0), F.least(F.col("total"), F.lit(most)) - 1)))
    return out.withColumn("match_start", before).withColumn("match_end", before + F.length(F.element_at("matches_", k + 1))).withColumn("hit", k + 1).drop("pattern_", "matches_", "parts_", "k_")


def line_number(text: Column, offset: Column) -> Column:
    prefix = F.substr(text, F.lit(1), offset)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def parse_date(text: Column) -> Column:
    """A date written out or in figures, day first unless the year leads; null for ranges, bare months and years, and what isn't a date."""
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    t = F.regexp_replace(F.regexp_replace(t, r"^(?:the )?(\d{1,2})(?:st|nd|rd|th)? (?:day )?of ", "$1 "), r"(\d)(st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(t, r"[,.](?= |$)", "")
    month = F.array(*[F.lit(m[:3]) for m in MONTHS])

    def made(year: Column, mon: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(mon, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    name = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    dmy, mdy, num, iso = rf"^(\d{{1,2}}) {name} (\d{{4}})$", rf"^{name} (\d{{1,2}}) (\d{{4}})$", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})$"
    number = lambda c: F.array_position(month, c).cast("string")
    return (
        F.when(t.rlike(dmy), made(part(dmy, 3), number(part(dmy, 2)), part(dmy, 1)))
        .when(t.rlike(mdy), made(part(mdy, 3), number(part(mdy, 1)), part(mdy, 2)))
        .when(t.rlike(num), made(part(num, 3), part(num, 2), part(num, 1)))
        .when(t.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3)))
    )


def clean_text(text: Column) -> Column:
    """Line ends as line feeds, no soft hyphens, control characters or trailing blanks, one blank line at most. Unicode forms are left alone."""
    t = F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("­"), F.lit(""))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def language_problem(text: Column, least: int = 500) -> Column:
    """short, letters or words for a text that isn't kept as English prose, else null."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    ascii_ = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), F.lit(1))
    english = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_WORDS)))
    return F.when(F.length(text) < least, "short").when(ascii_ < 0.5 * letters, "letters").when(english < 0.05 * F.size(words), "words")


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits in words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def url_slug(url: Column) -> Column:
    """The slug of the last path segment without .pdf or .html."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return slug(F.regexp_replace(last, r"(?i)\.(?:pdf|html?)$", ""))


def key_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalise_name(raw: Column, titles: list[str]) -> Column:
    """ASCII words in lower case without leading titles; apostrophes join what they separate."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(raw, "['`]", "")), F.lit("([a-z]+)"), F.lit(1))
    titled = F.transform(words, lambda w: w.isin(*titles))
    first = F.array_position(titled, F.lit(False))
    return F.array_join(F.when(first > 0, F.slice(words, first.cast("int"), F.greatest(F.size(words), F.lit(1)))).otherwise(F.array().cast("array<string>")), " ")


#: Words that reverse a sentence.
NEGATIONS = "no not never without denied refused absent unable nor none nobody nothing cannot".split()


def negations(text: Column) -> Column:
    """The negation words of a text; the No of a numbered decision isn't one."""
    t = F.regexp_replace(text, r"(?i)\bno\.(?=\s+\S)|\bno\s+(?=\d)", " ")
    words = F.regexp_extract_all(F.lower(t), F.lit("([a-z']+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: w.isin(*NEGATIONS) | w.endswith("n't")))


def mentions(text: Column, keywords: list[str]) -> Column:
    """Whether a keyword stands in the text as whole words, punctuation aside."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(padded, F.lit(f" {k} "))
    return found
