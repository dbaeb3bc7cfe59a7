"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import apart, slices, table

_OPEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The rest of a tag. A quote opens a value behind "=" alone; no part can match in two ways, so that no text is tried again.
_REST = re.compile(r"""((?>[^>=]+|=\s*+(?>"[^"]*"|'[^']*')?)*+)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that are never part of the article.
OUTSIDE = RAW | set("head nav footer aside form button select input dialog menu svg canvas object embed audio video map".split())
#: Words in class, id or role that name what is no part of an article, wherever it stands.
AROUND = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar
breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login
paywall social share sharing related comment comments commentlist disqus widget widgets pagination""".split())
#: Those of them that name bars of links. Within an article they may be what it is about, so there they leave out only what is mostly links, or next to nothing.
LINKS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs social share sharing related pagination".split())
#: The part of links from which, and the characters up to which, density agrees with such a name.
LINK_SHARE, BRIEF = 1 / 3, 60
#: Words that an article may have in it too: such an element is left out beside the chosen subtree, but not within it.
BESIDE = set("""banner aside rail topbar toolbar notice notices alert recommended recommendations trending popular discussion reply replies
respond pager search copyright legal disclaimer tags skip hidden contentinfo complementary""".split())
#: How much more the sum of these elements counts.
WEIGHTS, BESIDE_WEIGHT = {"article": 3.0, "main": 1.5}, 0.25
#: First or last words of a class that only say how a page is laid out, as in has-sidebar or share-enabled.
STATES = set("has have no not non without with hide show is are enabled disabled enable disable on off none ready active inactive left right".split())
#: Why an element is left out: a word of BESIDE; words of AROUND among others of a class, or alone; or because it is not shown.
NEAR, LOOSE, WHOLE, HIDDEN = 1, 2, 3, 4
#: An opening tag closes these if they are open, up to the nearest of the borders.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = set("ul ol dl table div article section main body td th blockquote form nav aside header footer".split())


def _marked(tag: str, attributes: str) -> tuple[int, bool]:
    """Whether class, id, role or visibility put an element outside of the article: 0, NEAR, LOOSE, WHOLE or HIDDEN; and whether no words but those of LINKS do."""
    mark, links = 0, True
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN, False
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _NAMES.findall(token)]
                if not words or words[0] in STATES or words[-1] in STATES - {"left", "right"}:
                    continue
                if any(w in AROUND for w in words):
                    links = links and all(w in LINKS for w in words if w in AROUND)
                    mark = max(mark, WHOLE if all(w in AROUND or w in BESIDE for w in words) else LOOSE)
                elif any(w in BESIDE for w in words):
                    mark = max(mark, NEAR)
    return mark, links and mark > NEAR


class Page:
    """The elements of a page in order, each with its parent; and its texts with the element they are in."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.marked = ["html"], [-1], [0]
        self.links: set[int] = set()  # elements that are marked by words of LINKS alone
        self.texts: list[tuple[int, str]] = []  # an empty text is the edge of a block
        self.open: Counter[str] = Counter()
        stack, at, n, quoted = [0], 0, len(html), True
        while at < n:
            found = _OPEN.search(html, at)
            end = found.start() if found else n
            if end > at:
                self.texts.append((stack[-1], html[at:end]))
            if not found:
                break
            at = found.end()
            closing, tag, attributes = found[1], found[2], ""
            if not tag:
                continue
            rest = _REST.match(html, at) if quoted else None
            if rest:
                attributes, at = rest[1], rest.end()
            else:  # a quote that nothing closes: from here on a tag ends at the next ">", or with the page
                quoted = False
                close = html.find(">", at)
                attributes, at = html[at : close if close >= 0 else n], close + 1 if close >= 0 else n
            tag = tag.lower()
            if closing:
                self._close(stack, {tag})
                continue
            if tag == "html":
                continue
            if tag in BLOCKS:
                self._close(stack, {"p"}, BORDERS)
            if tag in CLOSES:
                self._close(stack, CLOSES[tag], BORDERS)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            mark, links = _marked(tag, attributes) if attributes and tag not in ("html", "body", "main") else (0, False)
            self.marked.append(mark)
            if links:
                self.links.add(len(self.tags) - 1)
            if tag in BLOCKS:
                self.texts.append((stack[-1], ""))
            elif tag in ("br", "td", "th", "img"):
                self.texts.append((stack[-1], " "))
            if tag in RAW:
                over = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = over.end() if over else n
            elif tag not in VOID:
                stack.append(len(self.tags) - 1)
                self.open[tag] += 1

    def _close(self, stack: list[int], tags: set[str], borders: set[str] = frozenset()) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in tags:
                if any(self.tags[x] in BLOCKS for x in stack[k:]):
                    self.texts.append((stack[k - 1], ""))
                self.open.subtract(self.tags[x] for x in stack[k:])
                del stack[k:]
                return
            if tag in borders:
                return

    def plain(self) -> list[int]:
        """Characters of each element outside of links and of elements that are never part of the article."""
        n = len(self.tags)
        chars, skipped = [0] * n, [False] * n
        for i in range(1, n):
            skipped[i] = skipped[self.parents[i]] or self.tags[i] == "a" or self.tags[i] in OUTSIDE - {"form"} or self.marked[i] >= WHOLE
        for i, text in self.texts:
            if not skipped[i]:
                chars[i] += len(text) - text.count(" ")
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
        return chars

    def told(self) -> set[int]:
        """Elements that are marked as bars of links but are text, in an article or as a paragraph: longer than BRIEF, and with less than LINK_SHARE of links."""
        if not self.links:
            return set()
        n = len(self.tags)
        chars, linked, inside, link = [0] * n, [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parents[i]
            inside[i] = inside[p] or self.tags[p] in ("article", "main")
            link[i] = link[p] or self.tags[i] == "a"
        for i, text in self.texts:
            size = len(text) - text.count(" ")
            chars[i] += size
            linked[i] += size if link[i] else 0
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
            linked[self.parents[i]] += linked[i]
        return {i for i in self.links if (inside[i] or self.tags[i] == "p") and chars[i] > BRIEF and linked[i] < chars[i] * LINK_SHARE}

    def outside(self, named: bool = True) -> list[bool]:
        """Which elements are around the article, or within such ones; unless named, the words of class, id and role do not count.

        A class that has other words too does not leave out an element that holds most of the page's text outside of links.
        """
        n = len(self.tags)
        plain = self.plain() if LOOSE in self.marked else None
        told = self.told()
        marked = [m == HIDDEN or named and i not in told and (m == WHOLE or m == LOOSE and plain[i] * 2 <= plain[0]) for i, m in enumerate(self.marked)]
        holds = [False] * n  # an article or main element of the page itself
        inside = [False] * n
        for i in range(1, n):
            p = self.parents[i]
            inside[i] = inside[p] or self.tags[p] in ("article", "main")
        for i in range(n - 1, 0, -1):
            if holds[i] or self.tags[i] == "main" or self.tags[i] == "article" and not marked[i]:
                holds[self.parents[i]] = True
        out = [False] * n
        for i in range(1, n):
            tag = self.tags[i]
            own = tag in OUTSIDE and not (tag == "form" and holds[i]) or marked[i] and not holds[i] or tag == "header" and not inside[i] and not holds[i]
            out[i] = out[self.parents[i]] or own
        return out

    def content(self, named: bool = True) -> list[bool]:
        """Which elements are the article: the subtree of greatest sum of its children's densities, and others as dense as the path to it."""
        n, parents, out = len(self.tags), self.parents, self.outside(named)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i, text in self.texts:
            if text and not out[i]:
                chars[i] += len(text) - text.count(" ")
        for i in range(n - 1, 0, -1):
            if out[i]:
                continue
            if self.tags[i] == "a":
                link_chars[i], link_tags[i] = chars[i], tags[i] + 1
            p = parents[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
        share = link_chars[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, lc = chars[i], link_chars[i]
            if c and not out[i]:
                t, lt = max(tags[i], 1), max(link_tags[i], 1)
                base = log(c / max(c - lc, 1) * lc + share * c + e)
                density[i] = c / t * log(max(c / max(lc, 1) * t / lt, 1 + 1e-9)) / log(max(base, 1 + 1e-9))
        around = [0] * n  # the block around each element
        for i in range(1, n):  # inline elements count with the block around them
            p = parents[i]
            around[i] = p if self.tags[p] in BLOCKS else around[p]
            if self.tags[i] in BLOCKS:
                sums[around[i]] += density[i]
        beside = [False] * n
        for i in range(1, n):
            beside[i] = beside[parents[i]] or named and self.marked[i] == NEAR
        sums = [x * WEIGHTS.get(tag, 1.0) * (BESIDE_WEIGHT if near else 1.0) for x, tag, near in zip(sums, self.tags, beside, strict=True)]
        best = max(range(n), key=sums.__getitem__)
        if not sums[best]:
            best = max(range(n), key=density.__getitem__)
        threshold, at = density[best], best
        while at >= 0:
            threshold = min(threshold, density[at])
            at = parents[at]
        sums[best] = max(sums) + 1
        top = list(range(n))  # the element of greatest sum in each subtree
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if not out[i] and sums[top[i]] > sums[top[p]]:
                top[p] = top[i]
        chosen, state = [False] * n, [0] * n  # 1: to be searched, as all above it are below the threshold
        state[0] = 1
        for i in range(n):
            p = parents[i]
            if i and not out[i] and state[p] == 1 and not chosen[p]:
                state[i] = 1
            if state[i] == 1 and density[i] >= threshold and density[i]:
                chosen[top[i] if sums[top[i]] else i] = True
                state[i] = 2
        inside = [False] * n  # within the subtree of greatest sum, if it is less than the page
        for i in range(1, n):
            kept = not beside[i] or inside[parents[i]]
            inside[i] = kept and (inside[parents[i]] or i == best and self.tags[i] != "body")
            chosen[i] = (chosen[i] or chosen[parents[i]]) and not out[i] and kept
        return chosen

    def text(self) -> str:
        """Blocks of the article, white space made one space, with an empty line between them; if marks leave none, those of the tree without marks."""
        return self._text(True) or (self._text(False) if any(0 < m < HIDDEN for m in self.marked) else "")

    def _text(self, named: bool) -> str:
        chosen, blocks, block = self.content(named), [], []
        for i, text in [*self.texts, (0, "")]:
            if not text:
                if words := "".join(block).split():
                    blocks.append(" ".join(words))
                block = []
            elif chosen[i]:
                block.append(unescape(text))  # a reference does not go on in the next element
        return "\n\n".join(blocks)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but the html, and main_text, in place of one of this name. A null or empty page has an empty text; every page is read whole. Repeated rows are pages of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            texts = [Page(h).text() if h else "" for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "main_text"])

    plain = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c not in ("main_text", html)], pages[f"`{html}`"].alias(f"{apart(pages)}html"))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[:-1], T.StructField("main_text", T.StringType())]))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    return extracted(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
