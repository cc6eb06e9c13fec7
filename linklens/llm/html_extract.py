"""Main-text extraction by tree scoring.

A page is read into a light tree of block elements and links. Each paragraph
gives points, one plus its commas plus up to three for its length, to its parent
in full, to its grandparent by half and to further ancestors by a third of their
distance; an element's points are discounted by the share of its text that is
inside links. The element with the most points is the container of the article;
inside an article or main element that whole element is. Siblings that score a
fifth of it, or are paragraphs with little linked text, are kept with it. Without
an article or main element every block outside the container is kept too if at
least half of its text, or of an element around it that doesn't hold the
container, is outside links: headings, short blocks and sections elsewhere.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are taken out wherever they stand, known by element, role or
class; nothing else is dropped. Text is joined per block: character references
are decoded, white space becomes one space, blocks are joined by two line ends.

Defined cases: a null or empty page gives an empty text, and so does a page of
boilerplate only; a page cut off inside an element keeps the text before the cut;
repeated rows and null ids keep their own rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z][\w-]*)", re.S)

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre
    section summary table tbody td tfoot th thead tr ul caption""".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object".split())
DROPPED = frozenset("""nav aside footer form menu dialog button select input label fieldset canvas audio
    video head""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEAVES = frozenset("p pre td th li blockquote h1 h2 h3 h4 h5 h6 dt dd figcaption caption address".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table div section article main body".split())
ROLES = frozenset("""navigation banner contentinfo complementary search form alert alertdialog dialog
    menu menubar toolbar""".split())
# a class or id that is one of these, or has one between hyphens or underscores
PART = frozenset("""advert adverts advertisement advertising sponsor sponsored sidebar sidebars cookie cookies
    consent gdpr newsletter subscribe comment comments disqus replies respond breadcrumb breadcrumbs
    navbar navigation popup modal promo promoted related recommended share sharing social
    pagination pager""".split())
# a class or id that is one of these as a whole
WHOLE = frozenset("""ad ads adbox adsense ad-slot ad-container ad-banner banner nav menu topnav footer
    site-footer page-footer header site-header page-header masthead topbar notice notices site-notice alert
    toc skip skip-link widget widgets tags toolbar login signup search searchbox""".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for name, a, b, c, bare in ATTR.findall(text):
        out.setdefault((name or bare).lower(), a or b or c)
    return out


def _unwanted(attrs: dict[str, str]) -> bool:
    """Boilerplate by class, id, role or visibility."""
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or \
            attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "").lower()):
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        if name in WHOLE or not PART.isdisjoint(re.split("[-_]+", name)):
            return True
    return False


class Page:
    """The tree: elements in page order, and the text runs of each block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.skip, self.by_class = ["#page"], [-1], [False], [False]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self._run: list[tuple[int, str]] = []
        self._stack = [0]
        self._open_tags: Counter[str] = Counter()
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self._run:
            self.blocks.append((self._block_of(self._run[0][0]), self._run))
            self._run = []

    def _block_of(self, node: int) -> int:
        while node and self.tag[node] not in BLOCKS:
            node = self.parent[node]
        return node

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCKS:
            self._flush()
            self._close("p")
        for other in CLOSED_BY.get(tag, ()):
            if not self._open_tags[other]:
                continue
            for n in reversed(self._stack):
                if self.tag[n] == other:
                    self._close(other)
                    break
                if self.tag[n] in SCOPES and not (other == "tr" and self.tag[n] != "table"):
                    break
        unwanted = bool(attrs) and tag not in ("html", "body") and _unwanted(attrs)
        drop = tag in DROPPED or (
            tag == "header" and not self._open_tags["article"] + self._open_tags["main"])
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.skip.append(drop)
        self.by_class.append(unwanted)
        self._stack.append(len(self.tag) - 1)
        self._open_tags[tag] += 1
        if tag in ("article", "main", "h1") and not drop:
            # what holds the article isn't boilerplate, whatever its class says
            for n in self._stack[:-1]:
                self.by_class[n] = self.by_class[n] and self.tag[n] in ("article", "aside")

    def _close(self, tag: str) -> None:
        if not self._open_tags[tag]:
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[i]] == tag:
                if any(self.tag[n] in BLOCKS for n in self._stack[i:]):
                    self._flush()
                self._open_tags.subtract(self.tag[n] for n in self._stack[i:])
                del self._stack[i:]
                return

    def _read(self, html: str) -> None:
        at = 0
        lower = None
        while True:
            m = TAG.search(html, at)
            text = html[at:m.start()] if m else html[at:]
            if text:
                self._run.append((self._stack[-1], text))
            if not m:
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing = name.lower(), m[1] or m[4]
            if closing:
                if tag not in VOID:
                    self._close(tag)
            elif tag in RAW:
                if lower is None:
                    lower = html.lower()
                end = lower.find(f"</{tag}", at)
                if len(lower) != len(html):
                    found = re.compile(f"</{tag}", re.I).search(html, at)
                    end = found.start() if found else -1
                at = len(html) if end < 0 else end
            elif tag == "br":
                self._run.append((self._stack[-1], " "))
            elif tag == "hr":
                self._flush()
            elif tag not in VOID and (tag in BLOCKS or tag in DROPPED or tag in ("a", "span")):
                self._open(tag, _attributes(m[3] or ""))

    def text(self) -> str:
        n = len(self.tag)
        skip = [False] * n
        for i in range(1, n):
            skip[i] = skip[self.parent[i]] or self.skip[i] or self.by_class[i]
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        has_block = [False] * n
        for i in range(1, n):
            if self.tag[i] in BLOCKS:
                has_block[self.parent[i]] = True

        kept: list[tuple[int, str, bool]] = []
        points, length, linked = [0.0] * n, [0] * n, [0] * n
        for block, run in self.blocks:
            run = [(node, t) for node, t in run if not skip[node]]
            text = " ".join(unescape("".join(t for _, t in run)).split())
            if not text:
                continue
            in_links = sum(len(t) for node, t in run if in_link[node])
            kept.append((block, text, 2 * in_links <= len(text)))
            length[block] += len(text)
            linked[block] += in_links
            gives = 1 + text.count(",") + min(len(text) / 100, 3)
            leaf = self.tag[block] in LEAVES or not has_block[block]
            node, step = (self.parent[block], 0) if leaf and block else (block, 0)
            while node >= 0:
                points[node] += gives if step == 0 else gives / 2 if step == 1 else gives / (3 * step)
                node, step = self.parent[node], step + 1
        if not kept:
            return ""
        for i in range(n - 1, 0, -1):
            length[self.parent[i]] += length[i]
            linked[self.parent[i]] += linked[i]
        density = [min(1.0, k / m) if m else 0.0 for k, m in zip(linked, length)]
        value = [p * (1 - d) for p, d in zip(points, density)]
        best = max(range(n), key=lambda i: (value[i], -i))
        node = best
        while node > 0:
            if self.tag[node] in ("article", "main"):
                best = node
            node = self.parent[node]

        roots = {best}
        if best and self.tag[best] != "body":
            least = max(10.0, value[best] / 5)
            for i in range(1, n):
                if self.parent[i] == self.parent[best] and length[i] and (
                        value[i] >= least or (self.tag[i] == "p" and density[i] < 0.25)):
                    roots.add(i)
        around, node = {0}, best
        while node > 0:
            around.add(node)
            node = self.parent[node]
        whole = self.tag[best] not in ("article", "main")
        inside = [False] * n
        for i in range(n):
            inside[i] = i in roots or (i > 0 and inside[self.parent[i]]) or (
                whole and i not in around and length[i] > 0 and density[i] <= 0.5)
        return "\n\n".join(text for block, text, plain in kept if inside[block] or (whole and plain))


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                text = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(pa.string()), pa.array(text, type=pa.string())],
                    names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def op7_html_extract(pages: DataFrame) -> DataFrame:
    """The contract's main text and its code points."""
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
