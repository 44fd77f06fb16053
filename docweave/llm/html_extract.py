"""Main-text extraction from HTML.

The standard-library parser's events are turned, in one streaming pass, into lines: a line is the text between two block-level tags, with
the number of tags met since the line before it. Each line has a text-to-tag ratio, smoothed with a Gaussian kernel over the
neighbouring lines. What an element says of itself by its tag, role or class is a prior that scales the smoothed ratios of the
lines in it, and no more: two-means clustering then finds the threshold, and lines above it are content.

Regions are container elements. The search for the main region goes down from the page to the innermost container that holds nearly all of the
content, or to an article or main with most of it. In the main region all lines stay, short ones too, but for those in containers that the
clustering rejects: ones with a prior of which less than half is content, ones made of links without any content, and articles
without content (cards). So the page's structure says what belongs together, and the clustered ratios say which of it is the text.

A page has one number of a parent for each container, and sums run once from the last container to the first: the work is linear in
the page, however deep it is nested.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, prepare

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content isn't shown as text.
DROPPED = frozenset("head title script style noscript template svg math iframe object embed canvas audio video button select textarea input datalist map noframes".split())
#: Elements that the standard has for other things than an article's text.
ASIDE = frozenset("nav aside footer header form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td center blockquote ul ol dl table figure".split()) | ASIDE
#: Elements whose start ends an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: First or last parts of a class or id that name something other than the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead header footer sidebar sidebars aside "
    "widget widgets comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay subscribe subscription newsletter signup login share sharing related recommended recommendations "
    "trending skip hidden copyright disclaimer".split()
)
#: Parts that say that the name is of a state or a layout.
STATES = frozenset("has no with without is not enabled disabled free".split())
ARTICLE_WORDS = frozenset("comment comments reply replies respond ad advert advertisement related promo sponsored widget".split())
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

PLAIN, NAMED, KIND, UNSEEN = 0, 1, 2, 3
#: What the smoothed ratio of a line is multiplied with, by what the elements around it say: nothing, their name, their kind.
PRIORS = np.array([1.0, 0.05, 0.0])
#: Shares of the content that a container, or an article or main, must hold for the search to go down to it.
NEARLY_ALL, MOST = 0.8, 0.5


def named_aside(value: str, words: frozenset[str]) -> bool:
    """Whether a whole name of a class or id says that the element isn't the article: sidebar, site-footer, commentList, but not has-sidebar."""
    for name in value.split():
        parts = _PARTS.findall(_CAMEL.sub(" ", name).lower())
        if parts and (parts[0] in words or parts[-1] in words) and STATES.isdisjoint(parts):
            return True
    return False


def marking(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """PLAIN, NAMED (by class or id), KIND (by tag or role) or UNSEEN."""
    if tag in DROPPED:
        return UNSEEN
    found = KIND if tag in ASIDE else PLAIN
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return found
    words = ARTICLE_WORDS if tag == "article" else ASIDE_WORDS
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and (value or "").lower() == "true") or (name == "style" and value and _UNSEEN.search(value)):
            return UNSEEN
        if name == "role" and value and value.strip().lower() in ASIDE_ROLES:
            found = max(found, KIND)
        elif name in ("class", "id") and value and named_aside(value, words):
            found = max(found, NAMED)
    return found


class Lines(HTMLParser):
    """Parser events to lines.

    Line k has ``tags[k]`` tags since the line before and is made of pieces; piece i is ``pieces[i]``, a text in container ``holder[i]`` of line ``line[i]``,
    and ``linked[i]`` of its code points are in links. Container c has ``kind[c]`` (its tag), ``parent[c]`` (a smaller number) and ``mark[c]``.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[int] = []
        self.pieces: list[str] = []
        self.holder: list[int] = []
        self.line: list[int] = []
        self.linked: list[int] = []
        self.kind, self.parent, self.mark = ["page"], [0], [PLAIN]
        self.open: list[tuple[str, int]] = []  # open elements, and the container that each is, or 0
        self.n_open: dict[str, int] = {}
        self.at = [0]  # open containers
        self.unseen = 0  # open elements that aren't shown; at most one is tracked, by its depth
        self.parts: list[tuple[int, bool, str]] = []
        self.since = 0

    def updatepos(self, i: int, j: int) -> int:  # line numbers aren't asked for
        return j

    def flush(self) -> None:
        if not self.parts:
            return
        if any(not text.isspace() for _, _, text in self.parts):
            number, before = len(self.tags), -1
            for holder, link, text in self.parts:
                if holder == before:
                    self.pieces[-1] += text
                    self.linked[-1] += link * len(text)
                else:
                    self.pieces.append(text)
                    self.holder.append(holder)
                    self.line.append(number)
                    self.linked.append(link * len(text))
                    before = holder
            self.tags.append(self.since)
            self.since = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.since += 1
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P and self.n_open.get("p"):
                self._close_p()
        if tag in VOID:
            return
        own = 0
        if not self.unseen:
            mark = marking(tag, attrs)
            if mark == UNSEEN:
                self.unseen = len(self.open) + 1
            elif mark or tag in CONTAINERS:
                own = len(self.kind)
                self.kind.append(tag)
                self.parent.append(self.at[-1])
                self.mark.append(mark)
                self.at.append(own)
        self.open.append((tag, own))
        self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def _close_p(self) -> None:
        """An open p ends here unless a block opened inside it."""
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == "p":
                self._pop(depth)
                return
            if self.open[depth][0] not in INLINE:
                return

    def _pop(self, depth: int) -> None:
        for tag, own in self.open[depth:]:
            self.n_open[tag] -= 1
            if own:
                self.at.pop()
        del self.open[depth:]
        if self.unseen > depth:
            self.unseen = 0

    def handle_endtag(self, tag: str) -> None:
        self.since += 1
        if tag not in INLINE:
            self.flush()
        if tag in VOID or not self.n_open.get(tag):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._pop(depth)
                return
            # an inline end tag never ends a block
            if tag in INLINE and self.open[depth][0] not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        holder = self.at[-1]
        if self.kind[holder] == "header" and (self.n_open.get("article") or self.n_open.get("main")) and any(self.n_open.get(h) for h in HEADINGS):
            holder = self.parent[holder]  # an article's heading stands in its header
        self.parts.append((holder, bool(self.n_open.get("a")), data))

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a window of three standard deviations, renormalised at the ends."""
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The boundary of two-means clustering in one dimension; all values are content when they don't differ."""
    low, high = float(values.min()), float(values.max())
    if high - low <= 1e-9 * abs(high):
        return low
    for _ in range(64):
        cut = (low + high) / 2
        above = values > cut
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


class Page:
    """A parsed page as arrays over its pieces, with sums over containers and all within them."""

    def __init__(self, lines: Lines, sigma: float) -> None:
        self.kind, self.parent = lines.kind, lines.parent
        self.line, self.holder = np.array(lines.line, np.int64), np.array(lines.holder, np.int64)
        self.size = np.array([len(" ".join(p.split())) for p in lines.pieces], np.int64)
        self.linked = np.minimum(np.array(lines.linked, np.int64), self.size)
        whole = np.bincount(self.line, self.size, len(lines.tags))
        self.ratio = smoothed(whole / np.maximum(1, np.array(lines.tags)), sigma)
        self.mark = np.array(lines.mark)

    def within(self, values: np.ndarray) -> np.ndarray:
        """Sums over the pieces in each container and the containers in it."""
        out = np.bincount(self.holder, values, len(self.kind)).tolist()
        for c in range(len(out) - 1, 0, -1):
            out[self.parent[c]] += out[c]
        return np.array(out)

    def handed_down(self, own: np.ndarray) -> np.ndarray:
        """For each container the largest of its own value and those around it."""
        out = own.tolist()
        for c in range(1, len(out)):
            out[c] = max(out[c], out[self.parent[c]])
        return np.array(out)

    def content(self, mark: np.ndarray) -> np.ndarray:
        """The code points of each piece that are content: all or none, by the clustered ratio of its line under the priors."""
        scaled = self.ratio[self.line] * PRIORS[self.handed_down(mark)[self.holder]]
        above = (scaled >= threshold(scaled)) & (scaled > 0) if scaled.any() else np.zeros(len(scaled), bool)
        return np.where(above, self.size, 0)

    def best_article(self, mass: np.ndarray, mark: np.ndarray) -> int:
        """The article, or else main, that holds the most content; 0 if none does."""
        for kind in ("article", "main"):
            found = [c for c in range(1, len(self.kind)) if self.kind[c] == kind and mark[c] == PLAIN and mass[c]]
            if found:
                return max(found, key=lambda c: mass[c])
        return 0

    def trusted(self) -> np.ndarray:
        """Marks without the names of containers that hold the best article, or nearly all content and most text: a wrapper may name what it lays out."""
        mark = np.where(self.mark == NAMED, PLAIN, self.mark)
        mass, size = self.within(self.content(mark)), self.within(self.size * (self.handed_down(mark)[self.holder] == PLAIN))
        if not mass[0]:
            return self.mark
        holds = (mass >= NEARLY_ALL * mass[0]) & (3 * size >= 2 * size[0])
        around = self.parent[c] if (c := self.best_article(mass, self.mark)) else 0
        while around:
            holds[around] = True
            around = self.parent[around]
        return np.where((self.mark == NAMED) & holds, PLAIN, self.mark)

    def kept(self) -> np.ndarray:
        """Which pieces are the main text."""
        mark = self.trusted()
        content = self.content(mark)
        if not content.any():  # rather than no text at all, what only names speak against
            mark = np.where(mark == NAMED, PLAIN, mark)
            content = self.content(mark)
        mass, size, linked = self.within(content), self.within(self.size), self.within(self.linked)
        best = self.region(mass, np.bincount(self.holder, content, len(self.kind)))
        cards = [c for c in range(1, len(self.kind)) if self.kind[c] == "article"]
        first = max((mass[c] for c in cards), default=0)
        longest = max((size[c] for c in cards if mass[c] == first), default=0)
        rejected = np.zeros(len(self.kind), np.int64)
        rejected[(mark != PLAIN) & (2 * mass < size)] = 1
        rejected[(mass == 0) & (2 * linked > size)] = 1
        for c in cards:
            # another article stays if it is mostly content or half as long as the one with the most
            if c != best and mass[c] < first and 2 * mass[c] < size[c] and 2 * size[c] < longest:
                rejected[c] = 1
        rejected[0] = 0
        inside = np.zeros(len(self.kind), np.int64)
        inside[best] = 1
        if self.kind[best] == "article":  # a page may have several
            inside[[c for c in cards if mass[c] or 2 * size[c] >= longest]] = 1
        c = best
        while c:  # what is around the region is no ground against it
            rejected[c] = 0
            c = self.parent[c]
        return (self.handed_down(inside)[self.holder] == 1) & (self.handed_down(rejected)[self.holder] == 0)

    def region(self, mass: np.ndarray, own: np.ndarray) -> int:
        """The innermost container that holds nearly all of the page's content, or of that of an article or main with most of it.

        A container with content lines of its own isn't left for one within it.
        """
        best, children = 0, [[] for _ in self.kind]
        for c in range(1, len(self.kind)):
            if mass[c]:
                children[self.parent[c]].append(c)
        goal = mass[0]
        articles = [c for c in range(1, len(self.kind)) if self.kind[c] == "article" and mass[c]]
        if articles and sum(mass[c] for c in articles if not self._nested(c)) >= MOST * goal:
            return max(articles, key=lambda c: mass[c])
        while children[best]:
            child = max(children[best], key=lambda c: mass[c])
            marked = self.kind[child] in ("article", "main")
            if mass[child] < (MOST if marked else NEARLY_ALL) * goal or (own[best] and not marked) or self.kind[child] in ("ul", "ol", "dl", "table", "figure", "blockquote"):
                break
            best, goal = child, mass[child] if marked else goal
        return best

    def _nested(self, c: int) -> bool:
        return self._in_article[self.parent[c]]

    @property
    def _in_article(self) -> list[bool]:
        if not hasattr(self, "_articles"):
            self._articles = self.handed_down(np.array([k == "article" for k in self.kind], np.int64)).astype(bool).tolist()
        return self._articles


def main_text(html: str, sigma: float = 1.0) -> tuple[str, int, int]:
    """(main text, lines in all, lines kept)."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    if not parser.tags:
        return "", 0, 0
    page = Page(parser, sigma)
    out: list[list[str]] = []
    before = -1
    for k in np.flatnonzero(page.kept()).tolist():
        if parser.line[k] != before:
            out.append([])
            before = parser.line[k]
        out[-1].append(parser.pieces[k])
    texts = [t for t in (" ".join("".join(pieces).split()) for pieces in out) if t]
    return " ".join(texts), len(parser.tags), len(texts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """One row per page: its id, url, main text, code points, lines seen and lines kept.

    Null or empty html, and pages without text, give the empty string. Repeated rows give repeated rows; an empty table
    an empty one. Other columns of ``pages`` are not read, whatever their names. Texts are never cut.
    """
    prepare(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(html.as_py() or "", sigma) for html in batch.column(2)]
        texts = [f[0] for f in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([f[1] for f in found], pa.int32()),
                pa.array([f[2] for f in found], pa.int32()),
            ],
            names=["id", "url", "text", "n_chars", "n_lines", "n_kept"],
        )

    out = map_batches(
        pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")),
        rows,
        f"id {id_type}, url string, text string, n_chars long, n_lines int, n_kept int",
    )
    return out.withColumnRenamed("id", id_col)
