"""Main text of web pages by tree scoring.

Blocks (paragraphs, headings, cells, text directly inside a container) give points for
length and commas to the containers above them; a container's points are discounted by the
share of its text that is link text. The best container is kept together with those of its
siblings that look like its continuation; what is marked as menu, header, footer, sidebar,
notice, advert, form, script or reader comment is left out wherever it stands.

One page is one row: the work is a map over the pages without any shuffle, and a page is
held as flat arrays in page order, so deep nesting costs no recursion.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_rows, query, read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("address blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# a start tag of the first kind ends an open element of the second kind
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
# an implied end never reaches beyond these
SCOPE = frozenset("table ul ol dl select article section div main body html".split())
LEFT_OUT = frozenset(
    "aside button canvas dialog footer form head iframe input map math menu nav noscript object script search select style svg template textarea "
    "title video audio datalist".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
# words of class and id that mark what isn't the article
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "copyright discussion disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination paywall popup print promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip skyscraper social "
    "sponsor sponsored subscribe subscription syndication tags teaser toc toolbar tooltip widget".split())
GOOD = frozenset("article body content entry main page post story text".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

LENGTH_UNIT, LENGTH_POINTS = 100, 3.0  # a block's length counts up to three hundred characters
SIBLING_SHARE, MENU_DENSITY = 0.2, 0.5


class _Page(HTMLParser):
    """Elements and text runs in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.off, self.good, self.home = ["#page"], [-1], [False], [False], [0]  # home: the block an element is in
        self.open = [0]
        # places in the stack of open elements by name, of the scopes and of the blocks, each ending
        # with 0 for none: no tag costs more than the elements it ends
        self.where: dict[str, list[int]] = {}
        self.scopes, self.blocks = [0], [0]
        self.runs: list[tuple[int, int, str, bool]] = []  # block, element, text, inside a link
        self.block, self.links = 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            return self.handle_data(" ")
        if tag in BLOCK:
            self.block += 1
            if tag not in ("html", "body"):
                self._end("p")
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        if tag in VOID:
            return None
        here = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.home.append(here if tag in BLOCK else self.home[self.open[-1]])
        self.where.setdefault(tag, [0]).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        given = {k: v or "" for k, v in attrs}
        words = WORDS.findall(f"{given.get('class', '')} {given.get('id', '')}".lower()) if given else ()
        whole = tag in ("html", "body", "article", "main")
        self.off.append(tag in LEFT_OUT or tag == "header" or not whole and bool(given) and (
            not MARKS.isdisjoint(words) or given.get("role", "").lower() in ROLES or "hidden" in given
            or given.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(given.get("style", "")))) or
            tag == "article" and not {"comment", "comments", "reply", "teaser", "related"}.isdisjoint(words))
        self.good.append(whole and tag != "html" and tag != "body" or not GOOD.isdisjoint(words))
        self.open.append(here)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as a browser: the slash of other than void tags means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        at = self.where.get(tag, [0])[-1]
        # a stray end tag of an inline element ends no block
        if at and (tag in BLOCK or at > self.blocks[-1]):
            self._cut(at)

    def _end(self, *names: str) -> None:
        """End the innermost open element of these names within the innermost scope."""
        at = max(self.where.get(name, [0])[-1] for name in names)
        if at > self.scopes[-1]:
            self._cut(at)

    def _cut(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.tag[self.open.pop()]
            self.where[tag].pop()
            self.links -= tag == "a"
            if tag in SCOPE:
                self.scopes.pop()
            if tag in BLOCK:
                self.blocks.pop()

    def handle_data(self, data: str) -> None:
        self.runs.append((self.block, self.open[-1], data, self.links > 0))


def _shown(page: _Page) -> list[bool]:
    """Per element: neither it nor anything above it is left out. A container that is marked
    but holds an article or main element stays."""
    holds = [False] * len(page.tag)
    for k in range(len(page.tag) - 1, 0, -1):
        if (page.tag[k] in ("article", "main") and not page.off[k]) or holds[k]:
            holds[page.parent[k]] = True
    heads = [False] * len(page.tag)
    for k in range(len(page.tag) - 1, 0, -1):  # a header of the article itself keeps its headings
        if page.tag[k] in HEADING or heads[k]:
            heads[page.parent[k]] = True
    shown, inside = [True] * len(page.tag), [False] * len(page.tag)
    for k in range(1, len(page.tag)):
        up = page.parent[k]
        inside[k] = inside[up] or page.tag[k] in ("article", "main")
        own_header = page.tag[k] == "header" and inside[up] and heads[k]
        shown[k] = shown[up] and (not page.off[k] or holds[k] and page.tag[k] not in LEFT_OUT or own_header)
    return shown


def main_blocks(html: str | None) -> list[str]:
    """Blocks of the main text in page order; [] for null, empty or text-free pages."""
    page = _Page()
    page.feed(html or "")
    page.close()
    shown = _shown(page)
    n = len(page.tag)
    blocks: list[list] = []  # block, element, parts, characters, link characters, all runs' elements
    for block, at, text, linked in page.runs:
        if not shown[at]:
            continue
        chars = len(text) - text.count(" ")
        if not blocks or blocks[-1][0] != block:
            blocks.append([block, page.home[at], [], 0, 0])
        blocks[-1][2].append(text)
        blocks[-1][3] += chars
        blocks[-1][4] += chars if linked else 0
    for b in blocks:
        b[2] = " ".join("".join(b[2]).split())
    blocks = [b for b in blocks if b[2]]
    if not blocks:
        return []

    chars, links, points = [0.0] * n, [0.0] * n, [0.0] * n
    for _, at, text, size, linked in blocks:
        chars[at] += size
        links[at] += linked
        gain = (len(text) >= 25) + min(len(text) / LENGTH_UNIT, LENGTH_POINTS) + text.count(",") + text.count("،") + text.count("、")
        up, level = (page.parent[at] if page.tag[at] in PARAGRAPH else at), 0
        while up >= 0 and level < 4:
            points[up] += gain / (1, 2, 6, 9)[level]
            up, level = page.parent[up], level + 1
    for k in range(n - 1, 0, -1):
        chars[page.parent[k]] += chars[k]
        links[page.parent[k]] += links[k]
    density = [links[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    score = [points[k] * (1 - density[k]) * (1.5 if page.good[k] else 1.0) for k in range(n)]
    best = max(range(n), key=lambda k: (score[k], -k))
    at, whole = best, -1
    while at > 0:  # the sections of one article belong together
        if page.tag[at] == "article" or page.tag[at] == "main" and whole < 0:
            whole = at
        at = page.parent[at]
    best = whole if whole > 0 else best

    kept = [False] * n
    up = page.parent[best]
    for k in range(max(best, 0), n):
        kept[k] = k == best or page.parent[k] >= 0 and kept[page.parent[k]]
    if up >= 0 and page.tag[best] != "main":
        least = SIBLING_SHARE * score[best]
        for k in range(1, n):
            if page.parent[k] == up and k != best and shown[k] and chars[k]:
                same = page.tag[k] == page.tag[best] and score[k] >= least and score[k] > 0
                long = page.tag[k] in PARAGRAPH and page.tag[k] not in ("li", "td") and chars[k] > 80 and density[k] < 0.25
                head = page.tag[k] in HEADING and density[k] < MENU_DENSITY and k < best
                kept[k] = same or long or head or (page.tag[best] != "article" and score[k] >= max(least, 1.0) and density[k] < 0.25)
            elif not kept[k] and page.parent[k] >= 0 and page.parent[k] != up:
                kept[k] = kept[page.parent[k]]
    for k in range(best + 1, n):  # lists of links inside the article
        if kept[k] and (not kept[page.parent[k]] and page.parent[k] >= best or page.tag[k] in ("ul", "ol", "dl") and density[k] > MENU_DENSITY and chars[best] > chars[k]):
            kept[k] = False
    return [b[2] for b in blocks if kept[b[1]]]


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int32())])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks: one row per page row, repeated rows too.

    A null, empty or text-free page has the empty text; null ids and urls pass through; other
    columns of the input are left behind, so their names can't clash.
    """
    def make():
        def one(page_id, url, html):
            found = main_blocks(html)
            text = " ".join(found)
            return page_id, url, text, len(text), len(found)
        return one

    taken = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return taken.mapInArrow(by_rows(make, SCHEMA), "page_id long, url string, text string, n_chars long, n_blocks int")


@query("op1_html_extraction")
def op1_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return extract_pages(read(spark, sf_dir, "pages"))
