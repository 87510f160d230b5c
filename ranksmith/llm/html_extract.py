"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, threshold.

The standard library's parser streams a page once. Its events build lines (one a block
element), each with its text, the number of tags in it and the element around it; elements that
never hold article text (scripts, styles, menus, page headers and footers, sidebars, forms) are
left out by tag, role or state. The ratios of text to tags are smoothed by a Gaussian and split
into two clusters by a threshold; the lines above it are the content, if one of them has at least
FLOOR characters a tag. Regions selected are all articles that have lines, else all mains, else
the lowest element around all content lines (around more than one line); where that is no less
than the body, what lies between the first and the last content line and headings right before.
All lines of a region are kept, short ones too, in page order: character references decoded,
white space runs in a line one space, trimmed, joined by two line feeds.

Containers (never paragraphs, headings or the like) whose class or id names notices, adverts,
sharing or reader comments by its last telling word (`ad-slot`, `cookie-notice`; not `ad-hoc`,
nor beside a word of content as in `story share`) are left out of the lines that are clustered,
unless they hold an article, or the page has no content without them, nor an article.

Null and empty pages, and pages without content, give the empty text. Repeated rows are each
extracted; extra columns are ignored; an empty table gives an empty result. Nothing is dropped or
capped by length; a page is one row and one pass, linear in its length: elements know their
parent, open elements are found by tables, never by walks, and a comment, tag or declaration
that nothing closes goes on to the end of the page, as browsers have it. No shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LINE = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
#: Tags whose start ends an open paragraph.
_ENDS_P = _LINE - frozenset("body html caption tbody td tfoot th thead tr title legend option optgroup".split())
#: Tags whose start ends an open one of the same kind within the same list or table.
_SAME = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",)),
}
_NONE: dict = {}
_NEVER = frozenset(
    "aside button canvas datalist dialog embed footer form head iframe input menu nav noscript object script search select style "
    "svg template textarea title".split()
)
_CONTENT = ("article", "main")
_BIT = {k: 1 << i for i, k in enumerate(_CONTENT)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Elements that a class or id can name as furniture.
_NAMED = frozenset("aside center details dir div dl fieldset figure header menu ol section span table ul".split())
#: What names furniture if it is the last telling word, and only says what kind of box it is.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation topbar "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login sharing share social related recommended recommendations comments commentlist disqus replies "
    "pagination pager toolbar disclaimer".split()
)
_BOX = frozenset("area bar block box button buttons container content group holder icons inner items link links list menu module outer panel placeholder post posts row section slot stories strip thread unit widget wrap wrapper zone".split())
_TELLS_CONTENT = frozenset("article body entry main page post story text".split())
_TAG = re.compile(r"[^\s/>]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_furniture(names: list[str]) -> bool:
    """Whether one of the names says furniture and none says content."""
    found = False
    for name in names:
        parts = [p.lower() for p in _PARTS.findall(name)]
        while len(parts) > 1 and parts[-1] in _BOX:
            parts.pop()
        if not parts:
            continue
        if parts[-1] in _FURNITURE and not (len(parts) > 1 and parts[0] in ("with", "has", "no", "without")):
            found = True
        elif len(parts) == 1 and parts[0] in _TELLS_CONTENT:
            return False
    return found


_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACES = re.compile(r"\s+")
SIGMA, RADIUS = 1.0, 2
#: Characters a tag that the best line of a page without article must have.
FLOOR = 15
_HARD, _FORM = 2, 1


class _Lines(HTMLParser):
    """Lines of a page: [text parts, tags, element]. Elements are numbered as they open; parent,
    end (the last number inside), and whether an article, a main or named furniture is around."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.parent, self.end, self.tag = [0], [0], ["html"]
        self.around = [0]  # a bit for each of _CONTENT
        self.named = [0]  # the outermost element named as furniture that is around, or 0
        self.holds: set[int] = set()  # named elements that hold an article or main
        #: Open blocks: (tag, number, left out, {inline tag: places}, [(inline tag, number, left out)])
        self.blocks: list[tuple] = [("html", 0, 0, {}, [])]
        self.at: dict[str, list[int]] = {"html": [0]}  # places of open blocks by tag
        self.new = True

    def _out(self) -> int:
        tag, _, out, _, inline = self.blocks[-1]
        return inline[-1][2] if inline else out

    def _inner(self) -> int:
        _, number, _, _, inline = self.blocks[-1]
        return inline[-1][1] if inline else number

    def _last(self, tags: tuple[str, ...]) -> int:
        """The place of the last open block of these tags, or -1."""
        at = -1
        for t in tags:
            if (places := self.at.get(t)) and places[-1] > at:
                at = places[-1]
        return at

    def parse_comment(self, i, report=1) -> int:
        return at + 3 if (at := self.rawdata.find("-->", i + 2)) >= 0 else len(self.rawdata)

    def parse_bogus_comment(self, i, report=1) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    parse_pi = parse_html_declaration = parse_bogus_comment

    def parse_endtag(self, i) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_starttag(self, i) -> int:
        close = self.rawdata.find(">", i)
        if close < 0:
            return len(self.rawdata)
        if (end := super().parse_starttag(i)) >= 0:
            return end
        self.handle_starttag(_TAG.match(self.rawdata, i + 1)[0].lower(), [])  # attributes that can't be read
        return close + 1

    def _pop(self, to: int) -> None:
        """Close the open blocks from place `to` on."""
        last = len(self.parent) - 1
        while len(self.blocks) > max(to, 1):
            tag, number, _, _, inline = self.blocks.pop()
            for _, n, _ in inline:
                self.end[n] = last
            self.end[number] = last
            self.at[tag].pop()
        self.new = True

    def _left_out(self, tag: str, a: dict) -> int:
        if tag in ("form", "fieldset"):
            return _FORM
        if tag in _NEVER:
            return _HARD
        if tag == "header":
            return 0 if self._last(_CONTENT) >= 0 else _HARD
        if not a:
            return 0
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style") or "")
        return _HARD if hidden or (a.get("role") or "").lower() in _ROLES else 0

    def handle_starttag(self, tag, attrs) -> None:
        block = tag in _LINE
        if tag in _ENDS_P and self.blocks[-1][0] == "p":
            self._pop(len(self.blocks) - 1)
        if tag in _SAME:
            twins, within = _SAME[tag]
            if (i := self._last(twins)) > self._last(within):
                self._pop(i)
        a = dict(attrs) if attrs else _NONE
        out = self._out()
        top = self.blocks[-1]
        if out == _FORM and tag in _CONTENT:
            out = 0  # a page wrapped in one form
        elif not out and top[0] == "header" and block and tag not in _HEADINGS and tag not in ("div", "section"):
            out = _HARD  # of an article's own header only the headings stay
        else:
            out = out if out == _HARD else max(out, self._left_out(tag, a))
        if block:
            self.new = True
        elif tag == "br" and not out:
            self._text(" ")
        if not self.new and self.lines:
            self.lines[-1][1] += 1
        if tag in _VOID:
            return
        outer, number = self._inner(), len(self.parent)
        self.parent.append(outer)
        self.end.append(number)
        self.tag.append(tag)
        self.around.append(self.around[outer] | _BIT.get(tag, 0))
        named = self.named[outer]
        if tag in _CONTENT and named and not out:
            self.holds.add(named)
        if not named and tag in _NAMED and ("class" in a or "id" in a) and _names_furniture(f"{a.get('class') or ''} {a.get('id') or ''}".split()):
            named = number
        self.named.append(named)
        if block:
            self.at.setdefault(tag, []).append(len(self.blocks))
            self.blocks.append((tag, number, out, {}, []))
        else:
            top = self.blocks[-1]
            top[3].setdefault(tag, []).append(len(top[4]))
            top[4].append((tag, number, out))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("p", "div", "script", "style", "a", "span", "b", "i"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in _LINE:
            i = self._last((tag,))
            if i > 0 and not (tag == "p" and i < self._last(_CONTENT)):
                self._pop(i)
            return
        _, _, _, places, inline = self.blocks[-1]
        if places.get(tag):  # an inline end closes what is open in its block, no block
            last = len(self.parent) - 1
            for t, n, _ in inline[places[tag][-1] :]:
                places[t].pop()
                self.end[n] = last
            # popped places are the last of each tag, so the list is cut at the first of them
            del inline[sum(map(len, places.values())) :]

    def _text(self, data: str) -> None:
        if self.new:
            if data.isspace():
                return
            self.lines.append([[], 1, self._inner()])
            self.new = False
        self.lines[-1][0].append(data)

    def handle_data(self, data) -> None:
        if not self._out():
            self._text(data)

    def close(self) -> None:
        super().close()
        self._pop(1)
        self.end[0] = len(self.parent) - 1


def _smoothed(x: np.ndarray) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    pad = np.pad(x, RADIUS)
    return np.convolve(pad, k, "valid") / np.convolve(np.pad(np.ones(len(x)), RADIUS), k, "valid")


def _threshold(x: np.ndarray) -> float:
    """Middle of the two cluster means of the (logarithmic) ratios, by Lloyd's steps."""
    lo, hi = float(x.min()), float(x.max())
    if hi - lo < 1e-9:
        return lo
    for _ in range(20):
        cut = (lo + hi) / 2
        a, b = x[x < cut], x[x >= cut]
        new = (float(a.mean()) if len(a) else lo, float(b.mean()) if len(b) else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def _region(p: _Lines, lines: list[tuple[str, int, int]], content: np.ndarray) -> list[bool]:
    """Which lines to keep on a page without article and main."""
    ids = sorted(e for _, _, e in lines)
    held = lambda e: bisect_right(ids, p.end[e]) - bisect_left(ids, e)
    mine = [lines[i][2] for i in np.flatnonzero(content)]
    e, top = min(mine), max(mine)
    while e and (p.end[e] < top or held(e) < 2):
        e = p.parent[e]
    if p.tag[e] not in ("html", "body"):
        return [e <= x <= p.end[e] for _, _, x in lines]
    first, last = np.flatnonzero(content)[[0, -1]]
    while first and p.tag[lines[first - 1][2]] in _HEADINGS:
        first -= 1
    return [first <= i <= last for i in range(len(lines))]


def extract(html: str | None) -> str:
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    every = [(t, tags, e) for parts, tags, e in p.lines if (t := _SPACES.sub(" ", "".join(parts)).strip())]
    plain = [x for x in every if not p.named[x[2]] or p.named[x[2]] in p.holds]
    for lines in (plain, [] if any(p.around) else every):
        if not lines:
            continue
        ratio = np.array([len(t) / tags for t, tags, _ in lines])
        plainly = np.log1p(ratio)
        smooth = _smoothed(plainly)
        content = smooth >= _threshold(smooth)
        for bit in _BIT.values():
            inside = [p.around[e] & bit for _, _, e in lines]
            if any(inside):
                return "\n\n".join(t for (t, _, _), k in zip(lines, inside) if k)
        if ratio[content].max(initial=0) >= FLOOR:
            own = content & (plainly >= _threshold(plainly))  # not only by what is next to it
            keep = _region(p, lines, own if own.any() else content)
            return "\n\n".join(t for (t, _, _), k in zip(lines, keep) if k)
    return ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches):
        for b in batches:
            text = [extract(x.as_py()) for x in b.column(2)]
            tidy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
