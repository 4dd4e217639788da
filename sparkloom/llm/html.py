"""Main text of web pages from a stream of parser events.

The standard library's parser reads the page once; nothing but the current path of open elements and the blocks of
text is kept. Every block is a line with a text-to-tag ratio: its characters by the tags met in it, links weighing
more. The ratios' logarithms are smoothed with a Gaussian over the neighbouring lines and clustered in two by a
threshold (refined as the mean of the two clusters' means). What elements or their class and id names give away as
menus, notices, adverts, forms or comments never counts. Content lines in one marked article element, or in one run
outside all such elements, belong together, and the heaviest is the article. It then grows: to all lines below the
element (and the heading before it), so short paragraphs inside it are not lost, or over the unmarked lines between
and next to the run's. An element without most of the content, such as a teaser, is not the article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Out, map_arrow, rows

SIGMA = 2.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object embed canvas audio video map select textarea button option datalist".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset address".split())
#: Elements that an opening tag of the same group ends, though they were left open.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIER = {"li": {"ul", "ol", "menu"}, "p": {"div", "section", "article", "td", "th", "li", "blockquote", "body", "main", "aside", "nav", "footer", "header", "form", "figure", "table"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side-?bar|footer\w*|foot|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice\w*|disclaimer|newsletter|subscri\w*|signup|login|share\w*|sharing|social\w*|comments?|commentlist|comment\w*|respond|replies|disqus|related|recommend\w*|popular|trending|widget\w*|popup|modal|overlay|paginat\w*|pager|skip-?link|tags?|tagcloud|copyright|legal)(?=$|[\s_-])",
    re.IGNORECASE,
)
HEADER = re.compile(r"(?:^|[\s_-])(?:site-?header|page-?header|header|head|top)(?=$|[\s_-])", re.IGNORECASE)
BODY = re.compile(r"(?:^|[\s_-])(?:article-?(?:body|content|text)|post-?(?:body|content|text)|entry-?(?:content|text|body)|story-?(?:body|content)|main-?(?:content|text)|articlebody)(?=$|[\s_-])", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHITE = re.compile(r"\s+")


class Blocks(HTMLParser):
    """Blocks of text with what is known of each: ``text, ratio, container, bad, home, tag, linked``.

    ``home`` is the element around the block's own, ``tag`` the block's own; ``linked`` tells that most of it is links.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, bool, bool, int, int, int, str]] = []  # tag, silent, boilerplate, container, element, the one around it, its tag
        self.blocks: list[tuple[str, float, int, bool, int, str, bool]] = []
        self.elements = 0
        #: Of each container the outermost one around it; a body part next to another of the same element counts as that one.
        self.outermost: dict[int, int] = {0: 0}
        self._parts: dict[int, int] = {}
        self._text: list[str] = []
        self._tags = self._linked = self._link_chars = 0
        self._in_link = False
        self._state = (False, False, 0, 0, 0, "")
        #: How many of each element are open; those of inline ones since every open block. They spare vain walks.
        self._open_now: Counter[str] = Counter()
        self._inline: list[Counter[str]] = [Counter()]

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self._text)).strip()
        if text:
            _, bad, container, _, home, tag = self._state
            self.blocks.append((text, len(text) / (1 + self._tags + 2 * self._linked), container, bad, home, tag, 2 * self._link_chars > len(text)))
        self._text, self._tags, self._linked, self._link_chars, self._in_link = [], 0, 0, 0, False

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        silent, bad, container, element, home, name = self._state
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}"
        whole = tag in ("article", "main") or a.get("role") in ("main", "article")
        kind = whole or a.get("itemprop") == "articleBody" or bool(BODY.search(names))
        # An element that holds the page (html, body, the article itself) is not judged by its names.
        if tag not in ("html", "body") and not kind:
            in_article = bool(container)
            header = tag == "header" and not in_article or (HEADER.search(names) and not in_article and tag in ("div", "section", "header", "table", "ul"))
            bad |= bool(tag in ASIDE or header or a.get("role") in ROLES or MARKS.search(names) or a.get("aria-hidden") == "true" or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower())
        silent |= tag in SILENT
        if kind and not bad:
            new = len(self.outermost)
            self.outermost[new] = self.outermost[container] or (new if whole else self._parts.setdefault(element, new))
            container = new
        self.path.append((tag, *self._state))
        self._open_now[tag] += 1
        if tag in INLINE:
            self._inline[-1][tag] += 1
        else:
            self._inline.append(Counter())
            self.elements += 1
            element, home, name = self.elements, element, tag
        self._state = (silent, bad, container, element, home, name)

    def _cut(self, k: int) -> None:
        for tag, *_ in self.path[k:]:
            self._open_now[tag] -= 1
        for tag, *_ in reversed(self.path[k:]):
            if tag in INLINE:
                self._inline[-1][tag] -= 1
            else:
                self._inline.pop()
        del self.path[k:]

    def _close_to(self, k: int) -> None:
        self.flush()
        self._state = self.path[k][1:]
        self._cut(k)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._state[0] and tag not in ("body", "p", "div", "article", "main"):
            if tag not in VOID:
                self._open(tag, attrs)
            return
        if tag in ("html", "body") and any(p[0] == tag for p in self.path):
            return
        if self.path and self.path[-1][0] == "head" and tag in ("body", "p", "div", "article", "main"):
            self._close_to(len(self.path) - 1)
        self._tags += 1
        if tag == "a":
            self._linked += 1
            self._in_link = any(k == "href" for k, _ in attrs)
        if tag in INLINE:
            if tag == "br":
                self._text.append(" ")
            elif tag not in VOID:
                self._open(tag, attrs) if attrs else None
            return
        self.flush()
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for k in range(len(self.path) - 1, -1, -1) if any(self._open_now[t] for t in ends) else ():
            t = self.path[k][0]
            if t in ends:
                self._close_to(k)
                break
            if t in BARRIER.get("p" if ends == {"p"} else tag, ()):
                break
        if tag not in VOID:
            self._open(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        elif not self._state[0]:
            self._tags += 1
            if tag == "a":
                self._in_link = False
        if not (self._inline[-1] if tag in INLINE else self._open_now)[tag]:
            return
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k][0] == tag:
                if tag in INLINE:
                    state = self.path[k][1:]
                    if state != self._state:
                        self.flush()
                    self._state = state
                    self._cut(k)
                else:
                    self._close_to(k)
                return
            if tag in INLINE and self.path[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self._state[0]:
            self._text.append(data)
            if self._in_link:
                self._link_chars += len(data.strip())


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian over neighbouring lines; the kernel is cut at three sigmas and renormalised at the ends."""
    r = int(3 * sigma)
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    n = len(x)
    return np.convolve(x, g)[r : r + n] / np.convolve(np.ones(n), g)[r : r + n]


def threshold(x: np.ndarray) -> float:
    """Between the two clusters: the mean of their means, refined until it stands."""
    t = float(x.mean())
    for _ in range(50):
        hi, lo = x[x >= t], x[x < t]
        if not len(hi) or not len(lo):
            break
        new = (float(hi.mean()) + float(lo.mean())) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _title(lines: list[tuple], root: dict[int, int], own: list[int]) -> int:
    """The first line of *own*, or the heading before it with unmarked lines alone between them, if *own* has none."""
    if any(lines[i][5] == "h1" for i in own):
        return own[0]
    i = own[0] - 1
    while i >= 0 and root.get(i) == 0:
        if lines[i][5] == "h1":
            return i
        i -= 1
    return own[0]


def _runs(lines: list[tuple], content: list[int]) -> list[list[int]]:
    """Content lines in runs; unmarked lines between two never part them.

    Boilerplate between two parts them where it is longer than the kernel reaches and no element holds lines of both.
    """
    runs: list[list[int]] = []
    homes: list[set[int]] = []
    for i in content:
        if runs:
            at = runs[-1][-1]
            k = next((k for k in range(len(runs) - 1, -1, -1) if lines[i][4] in homes[k]), len(runs) - 1)
            if k < len(runs) - 1 or lines[i][4] in homes[k] or i - at <= 1 + int(3 * SIGMA) or not any(b[3] for b in lines[at:i]):
                for r, h in zip(runs[k + 1 :], homes[k + 1 :], strict=True):
                    runs[k] += r
                    homes[k] |= h
                del runs[k + 1 :], homes[k + 1 :]
                runs[k].append(i)
                homes[k].add(lines[i][4])
                continue
        runs.append([i])
        homes.append({lines[i][4]})
    return runs


def _grown(lines: list[tuple], root: dict[int, int], first: int, last: int) -> tuple[int, int]:
    """The run with the unmarked lines at its ends, such as headings and short paragraphs.

    Lines of links end it, also those beside the text that smoothing has raised over the threshold.
    """
    while first < last and lines[first][6] and lines[first][5] not in HEADINGS:
        first += 1
    while first < last and lines[last][6] and lines[last][5] not in HEADINGS:
        last -= 1
    free = lambda i: root.get(i) == 0 and (not lines[i][6] or lines[i][5] in HEADINGS)
    while first and free(first - 1):
        first -= 1
    while last + 1 < len(lines) and free(last + 1):
        last += 1
    return first, last


def main_text(html: str | None) -> str:
    """Blocks of the main content, one a line; empty if there is none."""
    if not html:
        return ""
    p = Blocks()
    p.feed(html)
    p.close()
    p.flush()
    lines = p.blocks
    good = [i for i, b in enumerate(lines) if not b[3]]
    if not good:
        return ""
    # Logarithms, as the ratio grows with the line: one giant paragraph must not make the others look like menus.
    ratio = np.array([0.0 if b[3] else np.log1p(b[1]) for b in lines])
    flat = smooth(ratio)
    content = flat >= min(threshold(flat), flat[good].max())
    size = {i: len(lines[i][0]) for i in good}
    chosen = [i for i in good if content[i]]
    # A container's lines are those of everything below it; what lies between two parts of a body is of the body.
    root = {i: p.outermost[lines[i][2]] for i in good}
    heavy = lambda r: sum(size[i] for i in r)
    free = [i for i in chosen if not root[i]]
    run = max(_runs(lines, free), key=heavy) if free else []
    marked: dict[int, int] = {}
    for i in chosen:
        if c := root[i]:
            marked[c] = marked.get(c, 0) + size[i]
    best = max(marked, key=lambda c: (marked[c], -c), default=0)
    if best and marked[best] >= heavy(run):  # the heaviest content is marked and grows to its element
        own = [i for i in good if root[i] == best]
        first, last, other = _title(lines, root, own), own[-1], (0, best)
    else:
        (first, last), other = _grown(lines, root, run[0], run[-1]), None
    return "\n".join(lines[i][0] for i in good if first <= i <= last and (other is None or root[i] in other))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null, empty and text-free pages give an empty text. Broken markup is read as far as it goes. Repeated rows are
    extracted each; other columns are ignored.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for page_id, url, html in rows(batches):
            text = main_text(html)
            if out.add((page_id, url, text, len(text)), len(text)):
                yield out.take()
        yield out.take()

    return map_arrow(base, extract, "page_id long, url string, text string, n_chars long")
