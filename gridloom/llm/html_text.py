"""Operator 7: main text of HTML pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, the parent most; a container's points are
discounted by its link density. The best container, the article around it, and siblings that score well or read like
text are kept. Elements that are never text of an article (scripts, forms, navigation, adverts, comments, ...) are cut out
first, by tag, role and the names in class and id.

**Names** count whole: a name is of boilerplate if it is one of ``CUT_WORDS``, or made of those and of ``NEUTRAL`` words only
(``site-header``), never for a part of it (``has-sidebar``). An element so named stays if it also bears a name made of
``GOOD_WORDS``, contains ``main``, contains ``article`` and is in none, or holds most of the page's text out of links. For names
of discussions (``TALK``) only the first two reasons count, as comments can be longer than the article and articles
themselves. If nothing is left, names are ignored.

A page is parsed by one forward scan into a flat list of elements, so neither deep nesting nor unclosed tags, quotes or
comments cost more than time in proportion to the page. Character references are decoded; white space inside a block becomes one
space, and blocks are joined in page order by one.

Null or empty html: empty text. Text without any container: all of it. Ties: the first container. Repeated rows and null
keys: rows of their own. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
CUT_TAGS = RAW | frozenset(
    "nav header footer aside form button select option input object embed canvas audio video dialog menu head".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
CUT_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert sidebar aside menu menubar nav navbar navigation breadcrumb "
    "breadcrumbs header masthead topbar footer bottombar comment comments commentlist discussion disqus respond "
    "reply replies share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login popup modal overlay widget toolbar pagination pager skip hidden paywall".split()
)
TALK = frozenset("comment comments commentlist discussion disqus respond reply replies".split())
NEUTRAL = frozenset(
    "site top bottom left right primary secondary global inner area bar block box buttons button column container group "
    "items item links link list panel posts section slot unit wrap wrapper widgets form icons".split()
)
COMPOUNDS = frozenset(
    "main-nav main-menu main-navigation page-footer post-footer entry-footer article-footer post-navigation post-comments "
    "article-comments blog-sidebar visually-hidden is-hidden".split()
)
MOST = 0.6  # share of the page's text out of links that a wrapper of the article holds
GOOD_WORDS = frozenset("article body content entry main post text story blog page".split())
START_POINTS = {"article": 25, "main": 15, "div": 5, "section": 3, "td": 3, "blockquote": 3, "pre": 3}
START_POINTS |= dict.fromkeys("ul ol li dl dd dt address".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
CLOSES = {  # an opening tag that ends an open element of these kinds, up to the scope beside it
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
LEVELS = 5
SHORT = 25  # a shorter paragraph only counts if nothing else does
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
# One attribute after another, or a quoted text without a name: what stands inside a value is never a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Elements in document order, with parents before children, and the runs of text between tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut, self.bonus = ["#"], [0], [False], [0]
        self.named: dict[int, bool] = {}  # elements with a name of boilerplate; True for discussions
        self.runs: list[tuple[int, int, str]] = []  # element, block, text
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # where the open elements of each tag are in ``open``
        self.block = 0
        self._blocks = 0
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                tag = size
            if tag > at:
                self._text(source[at:tag])
            if tag == size:
                break
            at = self._markup(source, tag)

    def _markup(self, source: str, at: int) -> int:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            return len(source) if end < 0 else end + 3
        if source.startswith(("<!", "<?"), at):
            end = source.find(">", at)
            return len(source) if end < 0 else end + 1
        closing = source.startswith("/", at + 1)
        name = NAME.match(source, at + 1 + closing)
        if not name:
            self._text("<")
            return at + 1
        rest = REST.match(source, name.end())
        end = rest.end() if rest else source.find(">", name.end()) + 1 or len(source)
        tag = name[0].lower()
        if closing:
            self._close(tag)
        else:
            attributes = source[name.end() : end - 1]
            self._start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(source, end)
                end = stop.start() if stop else len(source)
        return end

    def _break(self) -> None:
        self._blocks += 1
        self.block = self._blocks

    def _text(self, text: str) -> None:
        self.runs.append((self.open[-1], self.block, text))

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._break()
            if tag != "br":
                self._end_of({"p"}, {"button", "td", "th", "li", "div", "section", "article", "blockquote"})
        if tag in CLOSES:
            self._end_of(*CLOSES[tag])
        cut, bonus = self.cut[self.open[-1]] or tag in CUT_TAGS, START_POINTS.get(tag, 0)
        named = None
        if attributes and tag not in ("html", "body"):
            more, points, named = _judged(attributes)
            cut, bonus = cut or more and tag not in ("article", "main"), bonus + points
        if tag in VOID:
            return
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.cut.append(cut)
        self.bonus.append(bonus)
        if named is not None and tag not in ("article", "main"):
            self.named[len(self.tag) - 1] = named
        if not attributes.endswith("/") or tag not in RAW:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def _nearest(self, kinds: set[str]) -> int:
        return max((self.places[t][-1] for t in kinds if self.places.get(t)), default=0)

    def _leave(self, k: int) -> None:
        """End the open elements from the k-th on; each is ended once, so time stays in proportion to the page."""
        for e in self.open[k:]:
            self.places[self.tag[e]].pop()
        del self.open[k:]

    def _end_of(self, kinds: set[str], scope: set[str]) -> None:
        k = self._nearest(kinds)
        if k > self._nearest(scope):
            self._leave(k)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._break()
        if k := self._nearest({tag}):
            self._leave(k)


def _boilerplate(name: str) -> set[str]:
    """The words by which a whole name of class or id is one of boilerplate; none if it is not."""
    words = {w.lower() for w in WORD.findall(name) if len(w) > 1}
    found = words & CUT_WORDS
    return found if found and (words <= CUT_WORDS | NEUTRAL or name.lower().replace("_", "-") in COMPOUNDS) else set()


def _judged(attributes: str) -> tuple[bool, int, bool | None]:
    """Whether role or style rule the element out, points its names are worth, and whether they are of boilerplate.

    The last is None if they are not, True for a discussion and False for anything else.
    """
    cut, points, found, good = False, 0, set(), False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in WORD.findall(one)}
                found |= _boilerplate(one)
                good |= bool(words) and words <= GOOD_WORDS
                points += 25 * bool(words & GOOD_WORDS)
        elif name == "role":
            cut |= value.lower() in CUT_ROLES
        elif name == "style":
            cut |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            cut = True
    return cut, min(points, 25), bool(found & TALK) if found and not good else None


def _cut_by_name(page: Page) -> None:
    """Rule out the elements named as boilerplate that do not hold the article."""
    if not page.named:
        return
    n = len(page.tag)
    below, within = [0] * n, [False] * n  # 1: an article below, 2: main
    for e in range(n - 1, 0, -1):
        if not page.cut[e]:
            below[page.parent[e]] |= below[e] | {"article": 1, "main": 2}.get(page.tag[e], 0)
    cut, link = list(page.cut), [False] * n
    for e in range(1, n):
        up = page.parent[e]
        cut[e] |= cut[up] or page.named.get(e, False) and not below[e] & 2
        within[e] = within[up] or page.tag[e] == "article"
        link[e] = link[up] or page.tag[e] == "a"
    plain = [0] * n
    for e, _, text in page.runs:
        if not cut[e] and not link[e]:
            plain[e] += len(text.strip())
    for e in range(n - 1, 0, -1):
        plain[page.parent[e]] += plain[e]
    for e in range(1, n):
        if page.named.get(e) is False:
            holds = below[e] & 2 or below[e] & 1 and not within[e] or plain[e] > MOST * plain[0]
            cut[e] |= not holds
        cut[e] |= cut[page.parent[e]]
    page.cut = cut


def _texts(page: Page) -> tuple[list[int], list[int], dict[int, list[str]]]:
    """Characters below each element, those in links, and each element's own paragraphs (blocks)."""
    n = len(page.tag)
    length, linked = [0] * n, [0] * n
    blocks: dict[tuple[int, int], list[str]] = {}
    holder = list(range(n))  # nearest element that is not inline
    link = [False] * n
    for e in range(1, n):
        if page.tag[e] in INLINE:
            holder[e] = holder[page.parent[e]]
        link[e] = link[page.parent[e]] or page.tag[e] == "a"
    for e, block, text in page.runs:
        if not page.cut[e] and (size := len(text.strip())):
            length[e] += size
            linked[e] += size * link[e]
            blocks.setdefault((holder[e], block), []).append(text)
    for e in range(n - 1, 0, -1):
        length[page.parent[e]] += length[e]
        linked[page.parent[e]] += linked[e]
    own: dict[int, list[str]] = {}
    for (e, _), parts in blocks.items():
        own.setdefault(e, []).append("".join(parts))
    return length, linked, own


def _scores(page: Page, own: dict[int, list[str]]) -> dict[int, float]:
    scores: dict[int, float] = {}
    for e, paragraphs in own.items():
        text = "".join(paragraphs).strip()
        points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= SHORT else 0.05
        # Text right in a container is a paragraph of it; otherwise the paragraph's parent comes first.
        above = e if page.tag[e] in ("div", "section", "article", "main", "td", "body", "#") else page.parent[e]
        for level in range(LEVELS):
            scores.setdefault(above, page.bonus[above])
            scores[above] += points / (1, 2, 6, 9, 12)[level]
            if above == 0:
                break
            above = page.parent[above]
    return scores


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    plain = page.cut
    _cut_by_name(page)
    found = _best(page)
    if not found and page.cut != plain:
        page.cut = plain
        found = _best(page)
    return found


def _best(page: Page) -> str:
    """The text of the best container, of what is not ruled out."""
    length, linked, own = _texts(page)
    scores = _scores(page, own)
    if not scores:
        return ""
    density = lambda e: linked[e] / length[e] if length[e] else 0.0
    final = {e: s * (1 - density(e)) for e, s in scores.items()}
    best = min(final, key=lambda e: (-final[e], e))
    kept = {best}
    above = best
    while above and page.tag[above] not in ("article", "main"):
        above = page.parent[above]
    if above:
        kept = {above}
    elif best:
        floor = max(10.0, 0.2 * final[best])
        for e in range(1, len(page.tag)):
            if page.parent[e] == page.parent[best] and e != best and not page.cut[e]:
                reads = page.tag[e] == "p" and (length[e] > 80 and density(e) < 0.25 or length[e] and not linked[e])
                if final.get(e, 0) >= floor or reads:
                    kept.add(e)
    inside = [False] * len(page.tag)
    for e in range(len(page.tag)):
        inside[e] = e in kept or bool(e) and inside[page.parent[e]]
    found, last = [], None
    for e, block, text in page.runs:
        if inside[e] and not page.cut[e]:
            if block == last:
                found[-1].append(text)
            else:
                found.append([text])
                last = block
    whole = (" ".join(html.unescape("".join(parts)).split()) for parts in found)
    return " ".join(b for b in whole if b)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, the main text and its length in code points."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes],
                names=["page_id", "url", "text", "n_chars"],
            )

    mine = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in mine.schema}
    return mine.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
