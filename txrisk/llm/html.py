"""Main-text extraction from web pages by tree scoring.

A page is read into a tree of elements. Parts that are never the article go by their tags and roles. Every remaining
paragraph earns points for its length and commas; it passes them to its container in full, to the next ancestor by half,
and less further up, and a container's sum is discounted by its share of link text. Elements with class words of page
furniture are suspects. A suspect goes, however long it is, unless it holds the best container outside all suspects. Only
where the page has no article or main element with text outside suspects, and nearly all text is inside them, is the best
container sought among them. The best container is kept, widened to the article or main element around it, and joined by
those of its siblings that score well beside it and are no suspects; beside an article these are articles. Comments are
never part of an article. The text is what is left inside, blocks in page order.

Defined cases: null or empty html gives an empty text; unclosed and crossing tags are closed as browsers do for
paragraphs, list items and table parts; an article that holds a headline only is that headline; a page without any text
outside the removed parts gives an empty text; repeated rows are extracted alike; nothing is cut off, whatever its length;
further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A quote counts after an equals sign only; the possessive parts keep a tag that never ends from being tried again.
_TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:-->|$)|[!?][^>]*(?:>|$)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
    r"""(?P<attrs>(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+)>)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Elements by how HTML treats them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp noscript template svg".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Parts of a page that are not its article.
DROPPED_TAGS = set("head nav footer aside form button select datalist menu dialog object embed canvas audio video".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted banner cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "sidebar sidenav widget widgets related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation "
    "topbar toolbar masthead footer pagination pager skip comment comments commentlist disqus replies respond".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus reply replies".split())
# Words of wrappers around an article, whatever else their class says.
WRAPPER_WORDS = set("article body content entry layout main page post story text wrapper".split())
KEPT_ALWAYS = {"html", "body", "main"}
PARAGRAPHS = set("p pre blockquote li dd dt td th figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SIBLING = 0.2  # share of the best container's points that a sibling needs
SUSPECT = 0.75  # share of them that an element with class words of page furniture needs
OUTSIDE = 0.1  # share of all points below which text outside suspects is not the article
LINKED = 0.5  # share of link text from which a suspect or a sibling is a list of links


class Page:
    """Elements in page order: each with its tag, parent, whether it is removed and the class words that make it suspect;
    and the pieces of text between."""

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped = ["html"], [-1], [False]
        self.block, self.linked, self.articles = [0], [False], [0]  # nearest block, inside a link, articles around
        self.suspect: dict[int, set[str]] = {}
        self.texts: list[tuple[int, str]] = []
        self._open = [0]
        at = 0
        while at < len(source):
            mark = source.find("<", at)
            found = _TAG.match(source, mark) if mark >= 0 else None
            if found is None:  # text up to here, and a stray sign
                stop = len(source) if mark < 0 else mark + 1
                self._text(source[at:stop])
                at = stop
                continue
            self._text(source[at:mark])
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["end"]:
                self._close(name)
            else:
                self._start(name, found["attrs"])
                if name in RAW:
                    at = self._skip_raw(source, at, name)

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._open[-1], html.unescape(text)))

    def _skip_raw(self, source: str, at: int, name: str) -> int:
        ends = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
        self._open.pop()
        return ends.end() if ends else len(source)

    def _break(self) -> None:
        self.texts.append((self._open[-1], " "))

    def _start(self, name: str, attrs: str) -> None:
        if name in ("html", "body") and name in [self.tag[n] for n in self._open]:
            return
        if name in BLOCKS:
            self._implied_end({"p"}, {"table", "td", "th", "button", "article", "section", "div"} if name != "p" else set())
        if name in CLOSES:
            self._implied_end(*CLOSES[name])
        if name in BLOCKS or name == "br":
            self._break()
        if name in VOID:
            return
        above = self._open[-1]
        self.tag.append(name)
        self.parent.append(above)
        self.block.append(len(self.tag) - 1 if name in BLOCKS else self.block[above])
        self.linked.append(name == "a" or name not in BLOCKS and self.linked[above])
        self.articles.append(self.articles[above] + (name == "article"))
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attrs)} if attrs else {}
        self.dropped.append(self.dropped[above] or name in RAW or self._is_dropped(name, found))
        if not self.dropped[-1]:
            words = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}"))
            if self._is_suspect(name, words):
                self.suspect[len(self.tag) - 1] = words
        self._open.append(len(self.tag) - 1)

    def _implied_end(self, closing: set[str], within: set[str]) -> None:
        """Close the innermost element of ``closing``, unless one of ``within`` is opened inside it."""
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in closing:
                del self._open[depth:]
                self._break()
                if closing == {"tr", "td", "th"}:
                    self._implied_end(closing, within)
                return
            if tag in within or tag in BLOCKS and tag not in closing and closing == {"p"}:
                return

    def _close(self, name: str) -> None:
        if name == "br":
            self._break()
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag == name:
                del self._open[depth:]
                break
            if name not in BLOCKS and tag in BLOCKS:  # an inline end tag does not close blocks
                return
        if name in BLOCKS:
            self._break()

    def _is_dropped(self, name: str, found: dict[str, str]) -> bool:
        if name in DROPPED_TAGS or name == "header" and not self.articles[-1]:
            return True
        if not found or name in KEPT_ALWAYS:
            return False
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            return True
        return found.get("role") in DROPPED_ROLES

    def _is_suspect(self, name: str, words: set[str]) -> bool:
        if name in KEPT_ALWAYS:
            return False
        if name == "article":
            return bool(words & COMMENT_WORDS)
        # Inline elements and headings of the article may have any class.
        return name in BLOCKS and name not in HEADINGS and name != "p" and bool(words & DROPPED_WORDS) or (
            name == "p" and bool(words & (COMMENT_WORDS | {"ad", "ads", "advert", "advertisement", "notice", "cookie", "newsletter", "share"}))
        )

    def scores(self, without: list[bool]) -> tuple[list[float], list[float]]:
        """Points of every element, discounted by its share of link text, and that share; elements ``without`` count nothing."""
        size = len(self.tag)
        own: dict[int, list[str]] = {}
        length, linked = [0] * size, [0] * size
        for node, text in self.texts:
            if without[node] or not text.strip():
                continue
            own.setdefault(self.block[node], []).append(text)
            length[node] += len(text.strip())
            if self.linked[node]:
                linked[node] += len(text.strip())
        for node in range(size - 1, 0, -1):
            length[self.parent[node]] += length[node]
            linked[self.parent[node]] += linked[node]
        # A division without blocks inside is a paragraph of its container.
        divided = {self.block[self.parent[n]] for n in range(1, size) if self.tag[n] in BLOCKS}
        points = [0.0] * size
        for block, texts in own.items():
            if self.tag[block] in HEADINGS:
                continue
            text = " ".join(" ".join(texts).split())
            value = 1 + text.count(",") + min(len(text) / 100, 3)
            leaf = self.tag[block] == "div" and block not in divided and self.tag[self.parent[block]] not in ("html", "body")
            holder = self.parent[block] if block and (self.tag[block] in PARAGRAPHS or leaf) else block
            level = 0
            while holder >= 0:
                points[holder] += value / (1 if level == 0 else 2 if level == 1 else 3 * level)
                holder, level = self.parent[holder], level + 1
        share = [k / n if n else 0.0 for k, n in zip(linked, length)]
        return [p * (1 - k) if n else 0.0 for p, k, n in zip(points, share, length)], share

    def _below(self, nodes: set[int]) -> list[bool]:
        """Which elements are in ``nodes`` or inside one of them."""
        out = [False] * len(self.tag)
        for node in range(len(self.tag)):
            out[node] = node in nodes or self.parent[node] >= 0 and out[self.parent[node]]
        return out

    def _or(self, nodes: set[int]) -> list[bool]:
        return [a or b for a, b in zip(self.dropped, self._below(nodes))] if nodes else self.dropped

    def main_nodes(self) -> tuple[set[int], set[int]]:
        """The elements whose contents are the article, and the suspects among their contents that are not."""
        wrappers = {n for n, words in self.suspect.items() if words & WRAPPER_WORDS}
        for node, tag in enumerate(self.tag):
            if tag in ("article", "main", "h1") and not self.dropped[node] and node not in self.suspect:
                while node >= 0:
                    if node in self.suspect:
                        wrappers.add(node)
                    node = self.parent[node]
        plain = set(self.suspect) - wrappers
        comments = {n for n in plain if self.suspect[n] & COMMENT_WORDS}
        best_of = lambda score, among: max(among, key=lambda n: (score[n], -n))
        every = range(len(self.tag))
        score, _ = self.scores(self._or(plain))
        best, furniture = best_of(score, every), plain
        named = {n for n in every if self.tag[n] in ("article", "main") and not self.dropped[n]}
        if plain and not self._with_text(named, self._or(plain)):  # is the article itself in a suspect?
            inside = self._below(named)
            among = [n for n in every if inside[n]] if self._with_text(named, self._or(comments)) else every
            for hidden, least in ((comments, OUTSIDE), (set(), 0.0)):
                wider, _ = self.scores(self._or(hidden))
                other = best_of(wider, among)
                if wider[other] > 0 and score[best] <= least * wider[other]:
                    score, best, furniture = wider, other, hidden
        if score[best] <= 0:
            headlines = self._with_text(named, self._or(plain))
            return ({min(headlines)}, plain) if headlines else (set(), set())
        above, node = set(), best
        around = None
        while node >= 0:
            if self.tag[node] == "article" or self.tag[node] == "main" and around is None:
                around = node
            above.add(node)
            node = self.parent[node]
        points, share = self.scores(self.dropped)
        top = list(points)  # of the best element inside
        for node in range(len(top) - 1, 0, -1):
            top[self.parent[node]] = max(top[self.parent[node]], top[node])
        lost = {
            n for n in self.suspect
            if n not in above and (
                n in furniture or n in comments or share[n] >= LINKED or top[n] < (SIBLING if n in wrappers else SUSPECT) * score[best]
            )
        }
        root = best if around is None else around
        kept = {root}
        for node in range(1, len(self.tag)):
            if node != root and self.parent[node] == self.parent[root] and not self.dropped[node] and node not in lost | plain:
                good = top[node] >= SIBLING * score[best] and share[node] < LINKED
                good = good and (self.tag[root] != "article" or self.tag[node] == "article")
                if good or around is None and (self.tag[node] == "p" or self.tag[node] in HEADINGS):
                    kept.add(node)
        return kept, lost

    def _with_text(self, nodes: set[int], without: list[bool]) -> set[int]:
        """Those of ``nodes`` that have text, in what is not in ``without``."""
        filled = [False] * len(self.tag)
        for node, text in self.texts:
            filled[node] = filled[node] or not without[node] and bool(text.strip())
        for node in range(len(self.tag) - 1, 0, -1):
            filled[self.parent[node]] = filled[self.parent[node]] or filled[node]
        return {n for n in nodes if filled[n]}

    def text(self) -> str:
        kept, lost = self.main_nodes()
        inside, outside = self._below(kept), self._or(lost)
        return " ".join("".join(t for n, t in self.texts if inside[n] and not outside[n]).split())


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extracted(column: Column) -> Column:
    """The main text of an html column."""

    @F.arrow_udf("string")
    def extract(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in columns:
            yield pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extract(column.cast("string"))
