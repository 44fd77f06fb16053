"""op1 and op2: main text and WARC archives."""

import base64
import hashlib
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import html_extract, warc
from docweave.llm.queries import op1_html_main_text, op2_warc_transactions

PAGES = "page_id long, url string, html string, text string, n_chars int"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>one\n  two&nbsp;three</p><p>four", "one two three four"),
        ("a<b>b</b>c &amp;amp; &eacute;&#x41;", "abc &amp; éA"),
        ("<nav>menu</nav><article><h1>Title</h1><p>x<br>y<p>z</article><footer>f</footer>", "Title x y z"),
        ("<article><p>Be.</p><script>var t='</p>';</script><style>p{}</style><form>q</form><aside>s</aside><!-- c --><p>End.</p></article>", "Be. End."),
        ("<header><h1>Site</h1></header><main><p>Body text here.</p><div class='cookie-notice'>ok</div></main>", "Body text here."),
        ("<article><p>Article words.</p></article><section id='comments'><article class='comment'>no</article></section>", "Article words."),
        ("<body><div class=ad>Buy now!</div><div id=story><p>A long enough story is told here, word by word.</p><p>Short.</p></div><div class='sidebar'>side</div></body>", "A long enough story is told here, word by word. Short."),
        ("<article>unclosed <b>bold<p>next", "unclosed bold next"),
        ("<p>a</p></div></article>b", "a b"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html)[0] == text


WORDS = "A sentence of the story that goes on for a while, as sentences of stories do. " * 4
CARD = "<article><a href=x><img src=y><h3><b>More</b></h3></a><p><a href=z><i>Teaser</i></a></p></article>"


@pytest.mark.parametrize(
    "html",
    [
        f"<article><h1>Title</h1><p>{WORDS}</p><p>Short.</p><p>{WORDS}</p></article><div>{CARD * 3}</div>",
        f"<div>{CARD * 2}</div><article><h1>Title</h1><p>{WORDS}</p><p>Short.</p><p>{WORDS}</p>{CARD}</article>",
        f"<div>{CARD * 3}</div><div><h1>Title</h1><p>{WORDS}</p><p>Short.</p><p>{WORDS}</p></div>",
    ],
)
def test_smoothed_content_chooses_articles(html):
    assert html_extract.main_text(html)[0] == f"Title {WORDS}Short. {WORDS}".strip()


def test_all_articles_with_content_stay():
    assert html_extract.main_text(f"<article><p>{WORDS}</p></article><article><p>{WORDS}</p></article>")[0] == f"{WORDS}{WORDS}".strip()


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-ads", "with-comments", "share-enabled"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_with_class_words_keep_the_text(name, inner):
    aside = "<div class=sidebar><p>Side.</p></div><div class='related'><article><p>Card.</p></article></div><div id=comments><p>Nice.</p><p>Yes.</p></div>"
    html = f"<body><div class='{name}'><{inner}><h1>Title</h1><p>{WORDS}</p><p>Short <span class=share>Share</span> line.</p><p>{WORDS}</p></{inner}>{aside}</div></body>"
    assert html_extract.main_text(html)[0] == f"Title {WORDS}Short line. {WORDS}".strip()


def test_comments_longer_than_the_story_go():
    html = f"<body><div id=story><p>{WORDS}</p><p>{WORDS}</p></div><div id=comments><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></div></body>"
    assert html_extract.main_text(html)[0] == f"{WORDS}{WORDS}".strip()


@pytest.mark.parametrize("html", ["<div>text ", "<div class=ad>text ", "<p>text ", "<article>text ", "<b>text ", "<a>text ", "<header><h1>text "])
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    text = html_extract.main_text(html * 100_000)[0]
    assert time.process_time() - began < 10
    if html in ("<div>text ", "<p>text ", "<article>text ", "<b>text "):
        assert len(text) > 5 * 99_990


@pytest.mark.parametrize("html", ["<div id=page class=has-sidebar><article><p>Hello you.</p></article></div>", "<div class='post social-science'><p>Hello you.</p></div>"])
def test_names_of_layouts_and_topics_keep_the_text(html):
    assert html_extract.main_text(html)[0] == "Hello you."


def test_the_threshold_decides(monkeypatch):
    menu = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
    html = f"<body><div class=teaser><p>Tease.</p></div><article><h1>Title</h1>{menu}<p>{WORDS}</p><div class=ad>Buy.</div><p>{WORDS}</p></article></body>"
    assert html_extract.main_text(html)[0] == f"Title {WORDS}{WORDS}".strip()
    monkeypatch.setattr(html_extract, "threshold", lambda values: -1.0)
    assert "One Two" in html_extract.main_text(html)[0]


def _plain_article(page):
    """The text of the article element, by patterns on the markup: the test tables have one in each page and nothing foreign in it but scripts and the like."""
    found = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    inner = re.sub(r"<(script|style|form|aside|nav)\b.*?</\1>|<!--.*?-->", "", found[1] if found else "", flags=re.S)
    inner = re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", inner)
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_query_against_patterns(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op1_html_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, _plain_article(pages[r.page_id].html), len(r.text))


def test_smoothing_and_threshold():
    flat = html_extract.smoothed(np.full(7, 3.0))
    assert np.allclose(flat, 3.0)
    assert html_extract.threshold(np.array([1.0, 1.2, 9.0, 9.5])) == pytest.approx(5.175)
    assert html_extract.threshold(np.array([2.0, 2.0])) == 2.0


def test_extract_defined_rows(spark):
    long = "<article>" + "<p>word &lt;x&gt;</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "clash", 5), (2, None, "", "clash", 5), (3, "u", long, "c", 0), (3, "u", long, "c", 0), (None, "u", "<p>é</p>", None, None)]
    got = {(r.page_id, r.text[:5], r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "word ", 9 * 20_000 - 1), (None, "é", 1)}
    assert html_extract.extract(spark.createDataFrame(rows, PAGES)).count() == 5
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_records_round_trip():
    payload = "höllo\r\n\r\nWARC/1.1 in text".encode()
    digest = warc.payload_digest(payload)
    data = warc.capture("http://x/\r\nbad", payload, digest, (1,), {"pageId": "1"}, None)
    records = [r for m in warc.members(data) for r in warc.parse(m)]
    assert [h["warc-type"] for h, _ in records] == ["response", "request", "metadata"]
    assert warc.http_payload(records[0][1]) == payload
    assert {h.get("warc-concurrent-to") for h, _ in records[1:]} == {records[0][0]["warc-record-id"]}
    plain = b"".join(zlib.decompress(m, 31) if m[:2] == b"\x1f\x8b" else m for m in warc.members(data))
    assert len(list(warc.parse(plain))) == 3
    assert list(warc.parse(plain[:-60]))[:2] == list(warc.parse(plain))[:2]


def test_warc_query_against_plain_version(spark, tmp_path):
    rows = [(k, f"http://h/{k}", h, "x", 0) for k, h in [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "ü"), (7, "a"), (7, "a"), (8, "b" * 300_000)]]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in op2_warc_transactions(spark, str(tmp_path)).collect())
    last = {}
    for k, _, h, *_ in rows:
        last[h or ""] = max(k, last.get(h or "", k))
    want = []
    for k, _, h, *_ in rows:
        p, holder = (h or "").encode(), last[h or ""]
        want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if k == holder else "revisit", None if k == holder else holder))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_warc_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa", None, 0), (2, "u", "aa", None, 0), (3, "u", "a" * 50, None, 0), (4, "u", "a" * 50, None, 0), (None, None, "a" * 50, None, 0)], PAGES)
    got = {(r.page, r.kind) for r in warc.archive(pages, min_payload_bytes=10).select(F.col("metadata.fields")["pageId"].alias("page"), F.col("main.warc_type").alias("kind")).collect()}
    assert got == {("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response"), ("", "response")}
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_assembly_of_orphans(spark):
    schema = warc.RECORDS
    row = lambda i, kind, to=None: (i, kind, to, None, "u", "d", None, None, None, 0, {}, "a", 0, None)
    records = spark.createDataFrame([row("r1", "response"), row("q1", "request", "r1"), row("m2", "metadata", "r1"), row("m1", "metadata", "r1"), row("q2", "request", "gone"), row("w", "warcinfo"), row(None, "response")], schema)
    got = {r.capture_id: (r.main is not None, r.metadata.record_id if r.metadata else None, r.n_records, r.complete) for r in warc.assemble(records).collect()}
    assert got == {"r1": (True, "m1", 4, True), "gone": (False, None, 1, False)}


def test_warc_files(spark, tmp_path):
    data = warc.capture("http://x/", b"payload", warc.payload_digest(b"payload"), (9,), {"pageId": "9"}, None)
    (tmp_path / "one.warc.gz").write_bytes(data)
    (tmp_path / "two.warc").write_bytes(b"".join(warc.members(data)))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_files(spark, f"file://{tmp_path}", payloads=True).where("warc_type = 'response'").collect()
    assert [bytes(r.payload) for r in got] == [b"payload", b"payload"] and all(r.payload_ok for r in got)
