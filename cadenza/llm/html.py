"""Main text of web pages by tree scoring.

A page is read once into a tree of elements and the text blocks in them. Every block of
running text passes points, for itself, its commas and its length, to the elements above
it, fewer the higher they stand; an element's sum is discounted by the share of its text
that stands in links. The best element is kept, with those of its siblings that score
well or look like its paragraphs and headings; and so are, beside the elements above it,
those that hold as good a text. Elements and roles that are no text at all, such as nav
or button, never take part. Others, such as form, aside or footer, and names in class and
id decide nothing by themselves: an element that they say holds something else passes
fewer points on, and is cut out of the best element unless it is where the text stands.
Pages don't need each other, so Spark only maps over them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre td th li dd dt blockquote figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "script style noscript template head title nav button select option textarea input label iframe object embed svg canvas math audio video map dialog menu".split()
)
# What these hold is hardly ever, or not always, the article; header only outside of it.
KINDS = {"footer": "strong", "aside": "beside", "form": "beside", "header": "beside"}
BREAKS = frozenset("br wbr img hr".split())
# An open element of the second kind ends where one of the first kind begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo search dialog alert alertdialog menu menubar".split())
# Words in class and id that say what an element holds: readers' comments,
# what is hardly ever an article, and what may be a column or box with the article in it.
COMMENTS = frozenset("comment comments commentlist discussion discussions disqus feedback replies reply respond responses".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter pagination popup promo promoted promotion sharing signup social sponsor sponsored subscribe".split()
)
WEAK = frozenset("aside banner notice notices recommended related share sidebar widget widgets".split())
# Words that say nothing beside those: where a thing stands, and that it is a thing.
NEUTRAL = frozenset(
    "area article articles author bar block body bottom box btn button buttons card container content count depth entry even first footer form global group head header heading icon icons inline inner item items js last layout left link links list main module meta news odd outer page panel parent pane post posts primary right row secondary section site slot static sticky story text thread title top unit user view widget wrap wrapper".split()
)
# Words that settle a compound, whatever stands beside them.
CERTAIN = frozenset("ads adsense doubleclick sponsored".split())
# Words that say that an element holds the article, whatever stands in it besides.
CONTENT = frozenset("article article-body article-content body-content content entry entry-content main main-content page-content post post-body post-content story story-body".split())
# Names that only say what a wrapper has beside the article.
HAS = re.compile(r"(?:has|with|no|without)[_-]\w+", re.IGNORECASE)
#: Share of points that an element so named passes on, and share of the page's or the best element's text from which on it stays.
POINTS = {"comments": 0.02, "strong": 0.02, "beside": 0.02, "weak": 0.2}
STAYS = {"comments": 1.01, "strong": 0.8, "beside": 0.5, "weak": 0.5}
#: Lists and boxes of so many links, and of little else, are menus wherever they stand.
MENU_LINKS, MENU_SHARE = 3, 0.9
#: Within an article or main, a menu has more links than lists of sources have.
ARTICLE_LINKS = 6
MAIN = frozenset(("article", "main"))
PAGES = frozenset(("#", "html", "body"))
#: How far up points go; the n-th element above the paragraph's parent gets a 1 / (n + 1) part.
REACH = 5
SIBLING_SHARE = 0.2
#: Share of the best score from which on an element beside one of those above the best is part of the text.
COUSIN_SHARE = 0.5
MAX_LINKS = 0.5


def named(attrs: dict[str, str | None]) -> str | None:
    """What the words in class and id say that an element holds, if it is not the article.

    A compound counts where all its words are of these kinds or neutral: ``comment-list``
    and ``sidebar-right`` do, ``share-price`` and ``related-work`` don't.
    """
    found, names = None, HAS.sub(" ", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").split()
    if any(name.lower() in CONTENT for name in names):
        return None
    for name in names:
        words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
        if words & CERTAIN:
            found = "strong"
        if not words or not words <= COMMENTS | STRONG | WEAK | NEUTRAL:
            continue
        if words & COMMENTS:
            return "comments"
        if words & STRONG - {"footer"} or words == {"footer"} or words & {"footer"} and words <= STRONG | NEUTRAL:
            found = "strong"
        elif words & WEAK and found is None:
            found = "weak"
    return found


class _Page(HTMLParser):
    """Elements as lists by number, children after parents; blocks as (element, text, in links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.drop = ["#"], [0], [False]
        self.kind: list[str | None] = [None]
        self.anchors: list[int] = [0]
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # depths of what is open, by tag
        self.open_blocks = [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._linked = 0

    def flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._block(), text, min(self._linked, len(text))))
            self._text = []
        self._linked = 0

    def _block(self) -> int:
        return self.stack[self.open_blocks[-1]]

    def _depth(self, tags: set[str]) -> int:
        """How deep the last open element of these tags stands; 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _pop(self, depth: int) -> None:
        if self.open_blocks[-1] >= depth:
            self.flush()
        for at in range(len(self.stack) - 1, depth - 1, -1):
            self.open[self.tag[self.stack[at]]].pop()
        while self.open_blocks[-1] >= depth:
            self.open_blocks.pop()
        del self.stack[depth:]

    def _close(self, tags: set[str], fences: set[str]) -> None:
        depth = self._depth(tags)
        if depth > self._depth(fences):
            self._pop(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BREAKS:
            self._text.append(" ")
        if tag in BLOCKS:
            self.flush()
            if tag != "html" and tag != "body":
                self._close({"p"}, {"button", "td", "th", "table", "article", "section", "div", "li"} if tag != "p" else {"button", "td", "th", "table"})
        if tag in ENDS:
            self._close(ENDS[tag], FENCES[tag])
        if tag in VOID:
            return
        up = self.stack[-1]
        own, kind = dict(attrs), None
        drop = self.drop[up] or tag in DROPPED
        if not drop and tag in KINDS and not self._depth({"blockquote"} if tag == "footer" else MAIN if tag == "header" else set()):
            kind = KINDS[tag]
        if not drop and attrs and tag not in ("html", "body"):
            kind = min((k for k in (named(own), kind) if k), key=POINTS.get, default=None)
            if (own.get("role") or "").lower() in ("complementary", "form"):
                kind = kind or "beside"
            drop = (own.get("role") or "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "").lower()
        if drop and not self.drop[up]:
            self.flush()
        self.tag.append(tag)
        self.parent.append(up)
        self.drop.append(drop)
        self.kind.append(kind)
        self.anchors.append(int(tag == "a" and not drop))
        self.stack.append(len(self.tag) - 1)
        self.open.setdefault(tag, []).append(len(self.stack) - 1)
        if tag in BLOCKS:
            self.open_blocks.append(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        depth = self._depth({tag})
        if depth:
            node = self.stack[depth]
            if self.drop[node] and not self.drop[self.parent[node]]:
                self._text.clear()
                self._linked = 0
            self._pop(depth)

    def handle_data(self, data: str) -> None:
        if not self.drop[self.stack[-1]]:
            self._text.append(data)
            if self.open.get("a"):
                self._linked += len(data.strip())


def _weights(page: _Page) -> list[float]:
    """The share of its points that an element passes on, by its name and those of all above it."""
    out = [1.0]
    for node in range(1, len(page.tag)):
        out.append(min(out[page.parent[node]], POINTS.get(page.kind[node], 1.0)))
    return out


def _upwards(page: _Page, values: list[int]) -> list[int]:
    """Each element's sum with those of all in it."""
    out = list(values)
    for node in range(len(out) - 1, 0, -1):  # children stand after their parents
        out[page.parent[node]] += out[node]
    return out


def _best(page: _Page, length: list[int], linked: list[int]) -> tuple[int, list[float]]:
    """The best element, and the scores of all.

    Where the best lies in an article or main that is not named for something else, that
    one is best instead; then an element scores as much as the best one in it, as points
    may not reach up to the article.
    """
    n = len(page.tag)
    points, weight = [0.0] * n, _weights(page)
    for node, text, links in page.blocks:
        if page.tag[node] in HEADINGS:
            continue
        own = weight[node] * (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - links / len(text))
        at = page.parent[node] if page.tag[node] in PARAGRAPHS else node
        for level in range(REACH):
            points[at] += own / (level + 1)
            if at == 0:
                break
            at = page.parent[at]
    score = [p * (1 - linked[i] / length[i]) if length[i] else 0.0 for i, p in enumerate(points)]
    # where all text stands in elements named for something else, what holds all of those is not the article
    some = any(weight[node] == 1.0 for node, _, _ in page.blocks)
    best = max(range(n), key=lambda i: (score[i] if some or page.tag[i] not in PAGES else 0.0, -i))
    at = best
    while at:
        if page.tag[at] in MAIN and weight[at] == weight[best]:
            best = at
            for node in range(n - 1, 0, -1):
                score[page.parent[node]] = max(score[page.parent[node]], score[node])
            break
        at = page.parent[at]
    return best, score


def _menus(page: _Page, length: list[int], linked: list[int]) -> list[bool]:
    """Which elements are lists or boxes of links and little else."""
    anchors, text = _upwards(page, page.anchors), [False] * len(page.tag)
    for node in range(1, len(page.tag)):
        text[node] = text[page.parent[node]] or page.tag[node] in MAIN and page.kind[node] is None
    return [page.tag[i] not in PARAGRAPHS and anchors[i] >= (ARTICLE_LINKS if text[i] else MENU_LINKS) and linked[i] >= MENU_SHARE * length[i] > 0 for i in range(len(page.tag))]


def _inside(page: _Page, best: int, score: list[float], length: list[int], linked: list[int]) -> list[bool]:
    """Which elements are part of the main text."""
    n, menus, weight = len(page.tag), _menus(page, length, linked), _weights(page)
    chosen, above = {best}, set()
    at = best
    while at:
        above.add(at)
        at = page.parent[at]
    children: dict[int, list[int]] = {page.parent[node]: [] for node in above}
    most = list(score)
    for node in range(n - 1, 0, -1):
        if page.parent[node] in children and length[node] and not page.drop[node] and node not in above:
            children[page.parent[node]].append(node)
        most[page.parent[node]] = max(most[page.parent[node]], most[node])
    if best and page.tag[best] not in ("main", "body", "html"):
        for node in children[page.parent[best]]:
            if score[node] >= SIBLING_SHARE * score[best] or (page.tag[node] in PARAGRAPHS | HEADINGS and linked[node] < MAX_LINKS * length[node]):
                chosen.add(node)
    for up in above - {best}:  # a part of the text may lie deeper than another
        for node in children[page.parent[up]]:
            if most[node] >= COUSIN_SHARE * score[best] > 0 and weight[node] == weight[best] and linked[node] < MAX_LINKS * length[node]:
                chosen.add(node)
    whole = sum(length[node] for node in chosen)
    inside = [False] * n
    inside[0] = 0 in chosen
    for node in range(1, n):
        inside[node] = node in chosen or inside[page.parent[node]]
        if inside[node] and node not in above:
            kind = page.kind[node]
            inside[node] = not (kind and length[node] <= STAYS[kind] * whole or menus[node])
    return inside


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line; empty if there is none."""
    page = _Page()
    try:
        page.feed(html or "")
        if page.rawdata.startswith(("<!", "<?")):  # a comment or declaration without end hides what follows
            page.rawdata = ""
        page.close()
    except AssertionError:  # html.parser gives up on some malformed declarations; what came before counts
        pass
    page.flush()
    if not page.blocks:
        return ""
    own, links = [0] * len(page.tag), [0] * len(page.tag)
    for node, text, linked in page.blocks:
        own[node] += len(text)
        links[node] += linked
    length, linked = _upwards(page, own), _upwards(page, links)
    best, score = _best(page, length, linked)
    inside = _inside(page, best, score, length, linked)
    return "\n\n".join(text for node, text, _ in page.blocks if inside[node])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    A null or empty page has an empty text. Of elements that score alike the first is
    best. Repeated rows are read each by itself. Pages of any length are read whole, one
    at a time, so a page's tree must fit a task. An empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
