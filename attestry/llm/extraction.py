"""Main text of HTML pages by tree scoring.

Elements that are never part of an article (scripts, menus, footers, forms and the like, known by tag or role, and
hidden ones) are cut. So is an element whose class or id names what surrounds an article (``comments``,
``cookie-notice``, ``related-posts``), however much text it holds, unless no article or sentence stands outside such elements; an
``article`` only if the name is that of a comment or the like. A name with such a word among others counts half, and
its element is cut if it reads like a menu or elements of that name hold little of the page's text; ``no-sidebar``
or ``comments-open`` say nothing. Each remaining block of text gives points for its length and its commas, less its
share of link text, to its container, half of them to the one above, and so on. The container with the most points is
kept with those of its siblings that read like text; an ``article`` or ``main`` around it is kept whole, with its own
siblings by the same rule, or those of the outermost one where they are nested. Lists of links are left out, but in
such an ``article`` or ``main`` only where they are its first or last part, without a sentence and without a heading.

Defined results: a null, empty or textless page has an empty text; character references are decoded once; an
unclosed comment, script or tag runs to the end of the page; pages of any length are read whole, in one pass; repeated
pages give repeated rows; of containers with equal points the outermost is the best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import extended, slices, table

# fixed values: names of HTML elements and the words that pages use for what surrounds an article
#: What is little of a page's text, from which share of text in links an element with a class word against it reads
#: like a menu, what its text counts if it is kept, and from how many characters on a block without a full stop is text.
LITTLE, MENU, SUSPECT, LINE = 0.25, 0.5, 0.5, 60
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select svg math object canvas audio video noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
CUT = frozenset("nav footer aside form button dialog menu head fieldset datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status tablist".split())
CUT_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs combx comment comments commentlist consent cookie cookies"
    " disqus dropdown footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo"
    " promoted related remark replies reply respond share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription syndication"
    " toolbar widget widgets".split()
)
KEEP = frozenset("html body main".split())
#: Words that say where or in what shape a part stands, words that turn a name into a remark on the layout, and what speaks against an article.
SHAPES = frozenset(
    "area list section box block wrapper wrap container inner outer posts articles items thread form links link bar slot unit panel group post entry"
    " article page site main top bottom left right".split()
)
REMARKS = frozenset("no not non has with without is open closed enabled disabled off".split())
ARTICLE_WORDS = frozenset("comment comments remark reply replies related ad ads advert advertisement promo".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main body html td th aside nav form footer header blockquote".split())
LISTS = frozenset("ul ol dl table".split())
PARTS = LISTS | frozenset("li dt dd caption thead tbody tfoot tr td th".split())
HOLDERS = frozenset("# html body main article section div center td th".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<=\s)(hidden)(?=[\s/]|\Z)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
COMMA = re.compile("[,،、，;]")
SENTENCE = re.compile(r"[.!?…。！？]['\")\]»”’]*\Z")


def is_cut(tag: str, attributes: str, in_article: bool) -> bool | tuple[str, bool]:
    """Whether an element cannot be part of the article.

    Where only a class or id speaks against it: that name, and whether a part of it is of such words alone.
    """
    if tag in CUT or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    suspect: bool | tuple[str, bool] = False
    for name, value, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if hidden or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if tag in KEEP:
            continue
        if name == "role" and value.lower() in CUT_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in WORD.findall(part)]
                against = [w in (ARTICLE_WORDS if tag == "article" else CUT_WORDS) and not (in_article and w == "header") for w in words]
                if any(against) and REMARKS.isdisjoint(words):
                    whole = all(bad or w in SHAPES for bad, w in zip(against, words, strict=True))
                    if whole or tag != "article":
                        suspect = (suspect[0], suspect[1] or whole) if suspect else (f"{tag} {name} {value}", whole)
    return suspect


class Page:
    """Elements in page order, with their parents, and blocks of text with the element that holds them."""

    def __init__(self, html: str):
        self.tags, self.parents, self.blocks = ["#"], [-1], []  # blocks: (element, text, characters in links)
        self.stack, self.off, self.links = [0], 0, 0  # off: the depth at which a cut element was opened
        self.suspects: dict[int, tuple[str, bool]] = {}  # elements with a class word against them, as is_cut says it
        self._words: list[str] = []
        self._linked = 0
        self._read(html)

    def _flush(self) -> None:
        text = " ".join("".join(self._words).split())
        if text:
            holder = next(e for e in reversed(self.stack) if self.tags[e] not in INLINE)
            self.blocks.append((holder, text, min(self._linked, len(text))))
        self._words, self._linked = [], 0

    def _text(self, raw: str) -> None:
        if raw and not self.off:
            text = unescape(raw)
            self._words.append(text)
            if self.links:
                self._linked += len(text.strip())

    def _pop_to(self, depth: int) -> None:
        """Close elements until ``depth`` of them are open."""
        while len(self.stack) > depth:
            if self.tags[self.stack[-1]] not in INLINE and not self.off:
                self._flush()
            tag = self.tags[self.stack.pop()]
            if tag == "a":
                self.links -= 1
            if self.off > len(self.stack):
                self.off = 0

    def _close(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            found = self.tags[self.stack[depth]]
            if found == tag:
                return self._pop_to(depth)
            if tag in INLINE and found not in INLINE or tag == "p" and found in SCOPES:
                return None
        return None

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; items end the item before them."""
        ends = SELF_CLOSING.get(tag)
        for depth in range(len(self.stack) - 1, 0, -1):
            found = self.tags[self.stack[depth]]
            if found == "p" or ends and found in ends:
                self._pop_to(depth)
                if not ends:
                    return
            elif found in SCOPES and not (ends and found in ("td", "th")):
                return

    def _open(self, tag: str, attributes: str, closed: bool) -> None:
        inline = tag in INLINE
        if not inline:
            self._close_implied(tag)
            if not self.off:
                self._flush()
        if tag in VOID or closed and not inline:
            if not self.off and tag in ("br", "hr"):
                self._words.append(" ")
            return
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.stack.append(len(self.tags) - 1)
        self.links += tag == "a"
        if not self.off:
            cut = is_cut(tag, attributes, any(self.tags[e] in ("article", "main") for e in self.stack))
            if cut is True:
                self.off = len(self.stack)
            elif cut:
                self.suspects[len(self.tags) - 1] = cut

    def _read(self, html: str) -> None:
        at = 0
        for_raw = {}
        while at < len(html):
            found = TAG.search(html, at)
            if not found:
                self._text(html[at:])
                break
            self._text(html[at : found.start()])
            at = found.end()
            slash, tag, attributes = found.groups()
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self._close(tag)
            elif tag in RAW and not attributes.rstrip().endswith("/"):
                if tag not in for_raw:
                    for_raw[tag] = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I)
                end = for_raw[tag].search(html, at)
                at = end.end() if end else len(html)
            elif tag == "td" or tag == "th":
                self._words.append(" ")
                self._open(tag, attributes, False)
            else:
                self._open(tag, attributes, attributes.rstrip().endswith("/") and tag not in ("p", "div", "a", "li"))
        self._pop_to(1)
        self._flush()

    def _sizes(self) -> tuple[list[int], list[int]]:
        """Characters of each element, and those of them in links."""
        n = len(self.tags)
        size, linked = [0] * n, [0] * n
        for element, text, in_links in self.blocks:
            size[element] += len(text)
            linked[element] += in_links
        for element in range(n - 1, 0, -1):  # parents come before their children
            size[self.parents[element]] += size[element]
            linked[self.parents[element]] += linked[element]
        return size, linked

    def _weights(self) -> list[float]:
        """What the text in each element counts; blocks in suspects that are cut are taken out."""
        n = len(self.tags)
        weight = [1.0] * n
        if self.suspects:
            size, linked = self._sizes()
            held: dict[str, int] = {}
            for element, (why, _) in self.suspects.items():
                held[why] = held.get(why, 0) + size[element]
            named, framed = [False] * n, [False] * n
            for element in range(1, n):
                named[element] = named[self.parents[element]] or element in self.suspects and self.suspects[element][1]
                framed[element] = framed[self.parents[element]] or self.tags[element] in ("article", "main")
            others = any(
                not named[e] and (framed[e] or SENTENCE.search(text) or len(text) >= LINE) and in_links < MENU * len(text) for e, text, in_links in self.blocks
            )
            for element in range(1, n):
                weight[element] = weight[self.parents[element]]
                if element in self.suspects:
                    why, whole = self.suspects[element]
                    cut = (others if whole else held[why] < LITTLE * size[0]) or linked[element] > MENU * size[element]
                    weight[element] = 0.0 if cut else weight[element] * SUSPECT
            self.blocks = [b for b in self.blocks if weight[b[0]]]
        return weight

    def main_text(self) -> list[str]:
        """Blocks of the best container and its siblings."""
        n = len(self.tags)
        weight = self._weights()
        size, linked = self._sizes()
        points, n_links = [0.0] * n, [0] * n
        for element, tag in enumerate(self.tags):
            if tag == "a":
                n_links[element] += 1
        for element, text, in_links in self.blocks:
            gain = weight[element] * (1.0 + len(COMMA.findall(text)) + len(text) / 100.0) * (1.0 - in_links / len(text))
            above = element
            if self.tags[element] in PARTS:  # items and cells speak for what holds their list
                while self.tags[above] in PARTS:
                    above = self.parents[above]
            elif self.tags[element] not in HOLDERS:
                above = self.parents[element]
            while above >= 0 and gain > 1e-3:
                points[above] += gain
                above, gain = self.parents[above], gain / 2
        for element in range(n - 1, 0, -1):
            n_links[self.parents[element]] += n_links[element]
        score = [p * (1.0 - link / s) if s else 0.0 for p, link, s in zip(points, linked, size, strict=True)]
        best = max(range(n), key=lambda e: (score[e], -e))
        if not score[best] > 0:
            return []
        frame, above = best, best
        while above > 0:  # the outermost article or main around the best
            if self.tags[above] in ("article", "main"):
                frame = above
            above = self.parents[above]
        roots = {frame}
        for element in range(1, n):
            if self.parents[element] == self.parents[frame] and element != frame and size[element]:
                density = linked[element] / size[element]
                plain = self.tags[element] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") and density < 0.25
                if plain or score[element] >= 0.2 * score[best]:
                    roots.add(element)
        inside = [False] * n
        kept_whole = self.tags[frame] in ("article", "main")
        at_edge = self._edge_lists(frame) if kept_whole else set()
        for element in range(n):
            menu = self.tags[element] in LISTS and n_links[element] > 1 and linked[element] > 0.6 * size[element]
            if menu and kept_whole and self._within(element, frame):
                menu = element in at_edge
            inside[element] = (element in roots or element > 0 and inside[self.parents[element]]) and not menu
        return [text for element, text, _ in self.blocks if inside[element]]

    def _within(self, element: int, frame: int) -> bool:
        while element > frame:
            element = self.parents[element]
        return element == frame

    def _edge_lists(self, frame: int) -> set[int]:
        """Lists that hold the first or last blocks of ``frame``, have no sentence and no heading in front of them."""
        mine = [(e, text) for e, text, _ in self.blocks if self._within(e, frame)]

        def list_of(element: int) -> int | None:
            found = None
            while element > frame:
                if self.tags[element] in LISTS:
                    found = element
                element = self.parents[element]
            return found

        out = set()
        for blocks in (mine, mine[::-1]):
            edge = list_of(blocks[0][0]) if blocks else None
            if edge is None:
                continue
            held = [k for k, (e, _) in enumerate(blocks) if list_of(e) == edge]
            before = blocks[len(held)] if blocks is not mine and len(held) < len(blocks) else None
            plain = not any(SENTENCE.search(blocks[k][1]) for k in held)
            if plain and len(held) < len(blocks) and not (before and self.tags[before[0]] in HEADINGS):
                out.add(edge)
        return out


def extract(html: str | None) -> str:
    """Main text of one page: blocks joined by an empty line."""
    return "\n\n".join(Page(html).main_text()) if html else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the HTML and with ``text`` and ``n_chars``, in place of columns of these names; nothing is moved between tasks."""
    others = pages.drop(html, "text", "n_chars", "_html").columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(value.as_py()) for value in batch.column(len(others))]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string()), sizes], [*others, "text", "n_chars"])

    rows = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html).cast("string").alias("_html"))  # the last column
    return rows.mapInArrow(work, extended(rows.drop("_html"), text=T.StringType(), n_chars=T.LongType()))


def op5_html_extraction(spark, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")
