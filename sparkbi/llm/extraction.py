"""Main text of web pages by scoring the element tree.

Text blocks give points for their length and their commas to the elements around them: all of
them to the nearest container, half to the next, less further out. An element's points are
reduced by the share of its text that is links. The best element is kept together with those of
its siblings that look like text too; an article or main element around it is taken whole.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are cut out
beforehand by element and by the words of their class, id and role. A wrapper that only mentions
such a word, like ``has-sidebar``, is not cut by its name if it holds the page's article or most of its points;
nor is a form that a page is wrapped in.

White space inside a block becomes one space, character references are decoded, blocks are
joined by an empty line in page order. Nulls: a null page is an empty one and gives empty text;
null ids and urls are kept. Repeated pages give repeated rows. Broken markup is read like a
browser does: unclosed elements end with their parents, stray end tags are ignored; a quote that never closes is a
plain character and a tag that never closes is text. Very long pages are read whole, in time that grows with their
length; of equal scores the element that starts first wins. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkbi.llm.common import ship_by_value

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html div section article main".split())
DROPPED = frozenset(
    "head script style noscript template iframe textarea title nav footer aside button select dialog svg object canvas "
    "audio video menu xmp noframes".split()
)
NOISE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar sidenav rail "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus "
    "reply replies respond discussion share sharing social related recommended recommendations pagination pager toolbar widget widgets "
    "navigation search complementary contentinfo hidden".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCK = frozenset("p pre blockquote li dd dt td th figcaption".split())
LEAST_FORM = 2.0  # points from which a form is a wrapper of text; labels and fields stay below
WELCOME = frozenset("article content entry post story text body main".split())

OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile("[>\"']")
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPLIT_NAMES = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _names(attributes: str) -> tuple[frozenset[str], bool, bool]:
    """Words of class, id and role, whether the element is hidden, and whether a whole name is a word of ``NOISE``."""
    found, hidden, exact = set(), False, False
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        elif name in ("class", "id", "role"):
            found.update(word.lower() for word in SPLIT_NAMES.split(value) if word)
            exact = exact or not NOISE.isdisjoint(value.lower().split())
    return frozenset(found), hidden, exact


def _points(text: str, links: int) -> float:
    """What a block of text gives to the elements around it."""
    return ((len(text) >= 25) + text.count(",") + len(text) / 100) * (1 - links / len(text))


class _Tags:
    """Ends of tags, found in one walk over the page however broken its quotes are."""

    def __init__(self, source: str):
        self.source, self.quotes = source, True
        self.last = {mark: source.rfind(mark) for mark in ">\"'"}

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag read up to ``at``; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        place = at
        while self.quotes and (found := STOP.search(self.source, place)):
            place, mark = found.start(), found[0]
            if mark == ">":
                return place
            place = self.source.index(mark, place + 1) + 1 if place < self.last[mark] else place + 1
        self.quotes = False  # all that follows would be one quote: from here quotes do not hide a tag's end
        return self.source.index(">", at)


class _Page:
    """Elements in page order as parallel lists, and blocks of text: (container, text, link characters)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.names, self.dropped = ["#page"], [-1], [frozenset()], [False]
        self.named = [0]  # cut by name only: 1 if the name mentions a word of NOISE, 2 if it is one
        self.blocks: list[tuple[int, str, int]] = []
        self.open = [0]
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.links = 0
        self.pieces: list[str] = []
        self.link_characters = 0
        self._read(source)
        self._cut_by_name()

    def _container(self) -> int:
        return next(node for node in reversed(self.open) if self.tags[node] not in INLINE)

    def _end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self._container(), text, min(self.link_characters, len(text))))
            self.pieces, self.link_characters = [], 0

    def _text(self, raw: str) -> None:
        if raw and not self.dropped[self.open[-1]]:
            text = markup.unescape(raw)
            self.pieces.append(text)
            if self.links:
                self.link_characters += len(text.strip())

    def _close_to(self, place: int) -> None:
        for node in self.open[place:]:
            if self.tags[node] not in INLINE:
                self._end_block()
                break
        self.links -= sum(self.tags[node] == "a" for node in self.open[place:])
        self.opened.subtract(self.tags[node] for node in self.open[place:])
        del self.open[place:]

    def _close_open(self, tags: set[str] | frozenset[str]) -> None:
        """End the innermost open element of ``tags`` unless a list, table or section lies between."""
        if not any(self.opened[tag] for tag in tags):
            return None
        for place in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[place]]
            if tag in tags:
                return self._close_to(place)
            if tag in SCOPE:
                return None

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag not in INLINE:
            self._end_block()
            self._close_open(CLOSES_ITSELF.get(tag, {"p", *HEADING} if tag in HEADING else {"p"}))
            if tag in CLOSES_ITSELF:
                self._close_open({"p"})
        if tag in VOID:
            return
        if tag == "a" and self.links:
            self._end("a")
        names, hidden, exact = _names(attributes) if attributes else (frozenset(), False, False)
        parent = self.open[-1]
        whole = tag in ("html", "body", "main", "article")
        noisy = not whole and (tag == "form" or bool(names & NOISE))
        noise = not whole and (hidden or tag in DROPPED or (noisy and tag in INLINE))
        if tag == "header" and not self.opened["article"]:
            noise = True
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.dropped.append(self.dropped[parent] or noise)
        self.named.append(noisy * (1 + exact))
        self.open.append(len(self.tags) - 1)
        self.opened[tag] += 1
        self.links += tag == "a"

    def _end(self, tag: str) -> None:
        if not self.opened[tag]:
            return None
        for place in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[place]] == tag:
                return self._close_to(place)
            if tag in INLINE and self.tags[self.open[place]] in SCOPE:
                return None

    def _read(self, source: str) -> None:
        at, tags = 0, _Tags(source)
        while found := OPENING.search(source, at):
            if found[1]:
                close = source.find("-->", found.end())
                end = close + 2 if close >= 0 else len(source)
            else:
                end = source.find(">", found.end()) if found[2] and found.end() <= tags.last[">"] else tags.end(found.end())
            if end < 0:
                break  # no tag ends any more
            self._text(source[at : found.start()])
            at = end + 1
            if not found[4]:
                continue
            tag = found[4].lower()
            if found[3]:
                if tag not in INLINE:
                    self._end_block()
                self._end(tag)
                continue
            self._start(tag, source[found.end() : end])
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = close.end() if close else len(source)
                self._end(tag)
        self._text(source[at:])
        self._close_to(1)
        self._end_block()

    def _cut_by_name(self) -> None:
        """Drop what is noise by its name, but no element that holds the page's article or most of its points."""
        if not any(self.named):
            return
        count = len(self.tags)
        under = [0] * count  # the plainest name of noise at or above
        for node in range(1, count):
            under[node] = max(under[self.parents[node]], self.named[node])
        points, mains, articles = [0.0] * count, [0] * count, [0] * count
        for container, text, links in self.blocks:
            if self.tags[container] not in HEADING:
                points[container] += _points(text, links)
        for node in range(count):
            if not self.dropped[node]:
                mains[node] = self.tags[node] == "main"
                articles[node] = self.tags[node] in ("article", "main") and not self.names[node] & NOISE
        outside = [sum(value for value, noisy in zip(values, under) if not noisy) for values in (points, mains, articles)]
        rivals = [sum(own for own, noisy in zip(points, under) if noisy <= named) / 2 for named in range(3)]
        for last in (False, True):  # plain names are weighed at last, if all else leaves nothing
            cut, held = [False] * count, [list(values) for values in (points, mains, articles)]
            for node in range(count - 1, 0, -1):  # children follow their parents; what is cut counts for nothing above
                if self.named[node]:
                    most = held[0][node] > max(outside[0], rivals[self.named[node]])
                    most = most and (self.tags[node] != "form" or held[0][node] >= LEAST_FORM)
                    article = held[2][node] > 0 and not outside[2]
                    if self.named[node] == 1:
                        kept = most or article
                    else:
                        kept = (held[1][node] > 0 and not outside[1]) or (most and (article or last))
                    cut[node] = not kept
                if not cut[node]:
                    for values in held:
                        values[self.parents[node]] += values[node]
            if held[0][0]:
                break
        for node in range(1, count):
            self.dropped[node] = self.dropped[node] or cut[node] or self.dropped[self.parents[node]]
        self.blocks = [block for block in self.blocks if not self.dropped[block[0]]]

    def main_blocks(self) -> list[str]:
        if not self.blocks:
            return []
        count = len(self.tags)
        length, linked, score = [0] * count, [0] * count, [0.0] * count
        for container, text, links in self.blocks:
            length[container] += len(text)
            linked[container] += links
            if self.tags[container] in HEADING:
                continue
            points = _points(text, links)
            node, level = (self.parents[container] if self.tags[container] in TEXT_BLOCK else container), 0
            while node >= 0:
                score[node] += points / (1, 2)[level] if level < 2 else points / (3 * level)
                node, level = self.parents[node], level + 1
        for node in range(count - 1, 0, -1):  # children follow their parents
            length[self.parents[node]] += length[node]
            linked[self.parents[node]] += linked[node]
        share = [links / total if total else 0.0 for links, total in zip(linked, length)]
        liking = [1.25 if tag in ("article", "main") or names & WELCOME else 1.0 for tag, names in zip(self.tags, self.names)]
        final = [points * (1 - part) * factor for points, part, factor in zip(score, share, liking)]
        best = max(range(count), key=lambda node: (final[node], -node))
        around, node = None, best
        while node > 0:
            if self.tags[node] == "article" or (self.tags[node] == "main" and around is None):
                around = node
            node = self.parents[node]
        best = around if around is not None else best
        kept = {best}
        for node in range(1, count):
            if self.parents[node] == self.parents[best] and node != best and not self.dropped[node] and length[node]:
                plain = self.tags[node] in TEXT_BLOCK and length[node] > 80 and share[node] < 0.25
                title = self.tags[node] in HEADING and not linked[node]
                if final[node] >= max(1.0, 0.2 * final[best]) or plain or title:
                    kept.add(node)
        inside = [False] * count
        for node in range(count):
            menu = self.tags[node] in ("ul", "ol", "table", "div", "section") and share[node] > 0.6 and node not in kept
            inside[node] = node in kept or (node > 0 and inside[self.parents[node]] and not menu)
        return [text for container, text, _ in self.blocks if inside[container]]


def main_text(source: str | None) -> str:
    """The main text of one page; empty if there is none."""
    return "\n\n".join(_Page(source).main_blocks()) if source else ""


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Columns: id, url, ``text`` and ``n_chars`` (code points), one row per page."""
    wanted = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "n_chars"])

    made = wanted.mapInArrow(read, "id long, url string, text string, n_chars long")
    return made.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")


ship_by_value(__name__)
