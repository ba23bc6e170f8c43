"""Main text of web pages, with site templates removed (operator 7).

1. Each page is read once into its elements; every element outside the article, and every list-like element of links inside it,
   gets a hash of its whole subtree (tag, class, contents).  Spark counts, for each host, on how many different pages each
   hash occurs; task-side and partial counts come before the shuffle, so a host with a third of all pages is no larger than
   its number of different subtrees.
2. Subtrees that a ``SHARE`` of a host's different pages hold (three of them at least) are its template.  Pages are read again: what remains is the text of
   their articles (or of main, or of the body) without template subtrees and without what the markup itself names as
   menu, header, footer, sidebar, notice, advert, form, script, style or reader comment.

Pages that are equal in their main text, without what the markup names as something else, count as one, so copies of an article don't
make it a template under whatever comments and footers; paragraphs, headings, quotations and preformatted text are never template by
themselves, and in an article only lists of links are.  The template hashes go to the tasks by broadcast, ``BROADCAST`` at a time (8 bytes each); more of
them take more narrow steps.  Pages are never shuffled.

Names are whole tokens of class or id (``sidebar``, ``comment-list``, ``site-footer``; not ``no-sidebar`` or ``category-social``).  An article,
and a paragraph, heading, quotation, preformatted text or figure in one, is named as something else only as a comment or advert; a container in an article or main as
anything else only if it also holds no such element, or is mostly links, or has a form's controls.  If all articles and mains of a page are in elements so named, those with
the fewest such elements around them are the page's, and their wrappers count as unnamed, if they hold more text than what is left otherwise.

A block is the text between borders of block-level elements: references decoded, white space (br too) as one space, trimmed.
Cases: null and empty html give ""; tags that aren't closed end where the next block, item or parent ends; a stray "<" is text;
pages without a host share one; equal rows are separate pages with equal text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from .text import utf8

#: Share of a host's different pages that makes a subtree a template, of three pages at least; template hashes broadcast at once.
SHARE, FEWEST, BROADCAST = 0.2, 3, 1_000_000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title iframe template svg textarea select canvas audio video button".split()
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements, roles and words of class or id that name what isn't the article.
NOT_ARTICLE = frozenset("nav footer aside form head menu dialog fieldset".split())
WRAPPERS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar aside menu submenu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended newsletter subscribe subscription"
    " comment comments commentlist disqus respond reply replies discussion login signup search widget skip pagination pager".split()
)
#: Words that may stand before and after those in a token; what names an article as a comment or advert; what names no section of an article.
BEFORE = frozenset("site page main global primary secondary top bottom left right sticky fixed mobile desktop post entry article blog user reader".split())
AFTER = frozenset("list area section box block wrap wrapper container bar links link button buttons btn form slot unit item items thread body content inner text title author meta posts articles stories region panel column row group icons toggle".split())
NOT_POST = frozenset("ad ads advert adverts advertisement sponsored comment comments commentlist reply replies respond".split())
TOPICS, HEADER = frozenset(["discussion"]), frozenset(["header"])
LISTS = frozenset("ul ol menu div section table dl aside nav".split())
#: Names of containers beside NOT_POST: a search box, say, or a sidebar.
STRONG = WORDS - TOPICS
#: Elements of forms.
CONTROLS = frozenset("form input button select textarea".split())
#: What an article tells in.
TELLING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption".split())
#: Text that is never template by itself.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(50_000)
def _named(tokens: str, words: frozenset[str]) -> bool:
    """Whether a token is one of the words, or made of them and of words of structure around them."""
    for token in tokens.split():
        parts = _WORD.findall(token)
        while len(parts) > 1 and parts[0] in BEFORE:
            parts = parts[1:]
        if parts and parts[0] in words and all(x in words or x in AFTER or x.isdigit() for x in parts[1:]):
            return True
    return False


class _Element:
    __slots__ = ("article", "from_block", "key", "link", "main", "named", "out", "parts", "since", "tag")

    def __init__(self, tag, out, named, article, main, link, key, from_block):
        self.since = None  # of a container in an article that its name tells from it: elements of text and forms before it
        self.tag, self.out, self.named, self.article, self.main, self.link, self.key, self.from_block, self.parts = tag, out, named, article, main, link, key, from_block, []


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n places are in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0


class Page:
    """blocks: (text, out: named as something else, in an article, in main, characters in links); subtrees: (hash, first block, end)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, bool, bool, int]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.named: list[tuple[int, ...]] = []  # of each block, the elements around it that only their names tell from the article
        self.roots: set[tuple[int, ...]] = set()  # the same of each outermost article and main
        self.names = 0
        self.unended: set[str] = set()  # raw elements that have no end from here on
        self.text: list[str] = []
        self.links = 0
        self.weak: list[tuple[int, int]] = []  # of containers in an article, from and to which block, that their name and their contents tell from it
        self.chars, self.linked = [0], [0]  # of all blocks so far: characters, and those in links
        self.telling = self.controls = 0  # elements so far that an article tells in, and of forms
        self.opened: Counter[str] = Counter()
        top = _Element("", False, (), False, False, False, "", 0)
        self.stack = [top]
        self._read(html)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        if any(self.named):
            self._settle()
        for k in np.flatnonzero(_covered(self.weak, len(self.blocks))).tolist():
            self.blocks[k] = (self.blocks[k][0], True, *self.blocks[k][2:])

    def _read(self, html: str) -> None:
        """Cuts html into tags, text and what is neither; one pass, as what has no end is known beforehand."""
        at, n, last, cdata = 0, len(html), html.rfind(">"), html.rfind("]]>")
        while at < n:
            begin = html.find("<", at)
            if begin < 0 or begin > last and not html.startswith("<!--", begin):
                self._data(html[at:])
                return
            sign = html[begin + 1 : begin + 2]
            end, tag, m = 0, None, None
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4) + 3
                end = end if end > 2 else n
            elif begin < cdata and html.startswith("<![CDATA[", begin):
                end = html.find("]]>", begin) + 3
            elif sign in ("!", "?"):
                end = html.find(">", begin) + 1
            elif sign == "/" or sign.isalpha():
                m = _TAG.match(html, begin)
                end = m.end() if m else 0
            if not end:  # a "<" that is text
                self._data(html[at : begin + 1])
                at = begin + 1
                continue
            if begin > at:
                self._data(html[at:begin])
            at = end
            if m is None:
                if html.startswith("<![CDATA[", begin) and html.startswith("]]>", end - 3):
                    self._data(html[begin + 9 : end - 3], False)
                continue
            tag = (m[2] or m[5]).lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            self.controls += tag in CONTROLS
            if tag in _RAW_END:
                close = _RAW_END[tag].search(html, at) if not m[0].endswith("/>") and tag not in self.unended else None
                if close:
                    if tag == "textarea":
                        self._data(html[at : close.start()])
                    at = close.end()
                elif not m[0].endswith("/>"):
                    self.unended.add(tag)
                    if tag in ("script", "style"):
                        at = n
                self.stack[-1].parts.append(tag)
                continue
            self._start(tag, m[3] or m[6] or "", m[0].endswith("/>"))

    def _settle(self) -> None:
        """Marks the blocks in elements named as something else, but for those that hold the page's article."""
        free: set[int] = set()
        inside = [(set(names), len(b[0])) for b, names in zip(self.blocks, self.named) if (b[2] or b[3]) and not b[1]]
        if inside and all(names for names, _ in inside):
            size = {root: sum(n for names, n in inside if names <= set(root)) for root in self.roots}
            root = min((r for r in size if size[r]), key=lambda r: (len(r), -size[r], r), default=())
            if size.get(root, 0) > sum(len(b[0]) for b, names in zip(self.blocks, self.named) if not b[1] and not names):
                free = set(root)
        self.blocks = [(b[0], b[1] or not free.issuperset(names), *b[2:]) for b, names in zip(self.blocks, self.named)]

    def _data(self, text: str, decode: bool = True) -> None:
        text = entities.unescape(text) if decode and "&" in text else text
        self.text.append(text)
        if self.stack[-1].link:
            self.links += len(text.strip())

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                e = self.stack[-1]
                self.blocks.append((text, e.out, e.article, e.main, self.links))
                self.named.append(e.named)
                self.chars.append(self.chars[-1] + len(text))
                self.linked.append(self.linked[-1] + self.links)
                e.parts.append(text)
            self.text = []
        self.links = 0

    def _start(self, tag: str, attributes: str, empty: bool) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        block = tag in BLOCKS
        if block:
            self._flush()
            if self.stack[-1].tag != "p" and any(e.tag == "p" for e in self.stack[-4:]) or self.stack[-1].tag == "p":
                self._end("p")
            if tag in CLOSES_ITSELF:
                self._end(tag, CLOSES_ITSELF[tag])
        if tag in VOID:
            return
        e = self.stack[-1]
        if not block and tag != "a":
            if empty:
                return
            self._open(_Element(tag, e.out, e.named, e.article, e.main, e.link, "", len(self.blocks)))
            self._inherit(e)
            return
        named = {k.lower(): v.strip("\"'").lower() for k, v in _NAMES.findall(attributes)} if attributes else {}
        words = named.get("class", "") + " " + named.get("id", "")
        role = named.get("role", "")
        article = e.article or tag == "article"
        main = e.main or tag == "main" or role == "main" or "articlebody" in named.get("itemprop", "")
        root = article > e.article or main > e.main
        out = e.out or tag in NOT_ARTICLE - WRAPPERS or role in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        other, since = False, None
        self.telling += tag in TELLING
        if tag == "article" and not e.article:
            other = _named(words, NOT_POST)
        elif article and tag in TELLING:  # in an article, one word in a name is no evidence against its text
            other = _named(words, NOT_POST)
        elif e.article or e.main:  # in what the page tells, a word in a name is evidence together with the contents
            other = tag in WRAPPERS or _named(words, NOT_POST)
            if not other and _named(words, STRONG):
                since = self.telling, self.controls
        elif tag not in ("html", "body") and not (root and main > e.main):
            other = tag in WRAPPERS or _named(words, STRONG) or not article and (tag == "header" or _named(words, HEADER))
        names = e.named
        if other:
            self.names += 1
            names = (*names, self.names)
        if root and not out and not (e.article or e.main):
            self.roots.add(names)
        self._open(_Element(tag, out, names, article, main, e.link or tag == "a", named.get("class", ""), len(self.blocks)))
        self.stack[-1].since = since
        if not block:
            self._inherit(e)

    def _open(self, e: _Element) -> None:
        self.stack.append(e)
        self.opened[e.tag] += 1

    def _inherit(self, parent: _Element) -> None:
        """An inline element's text belongs to its parent's block."""
        self.stack[-1].parts = parent.parts

    def _end(self, tag: str, within: tuple[str, ...] = ("td", "th", "article", "section", "div", "body")) -> None:
        if not self.opened[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if tag in ("p", *CLOSES_ITSELF) and self.stack[k].tag in within:
                return

    def _close(self) -> None:
        e = self.stack[-1]
        if e.tag in BLOCKS:
            self._flush()
        self.stack.pop()
        self.opened[e.tag] -= 1
        if e.tag not in BLOCKS:
            return
        parent, upto = self.stack[-1], len(self.blocks)
        digest = xxhash.xxh3_64_intdigest("\x00".join((e.tag, e.key, *e.parts)))
        parent.parts.append(f"\x01{digest:x}")
        chars, linked = self.chars[upto] - self.chars[e.from_block], self.linked[upto] - self.linked[e.from_block]
        links = 2 * linked >= chars
        if e.since and upto > e.from_block and (links or self.telling == e.since[0] or self.controls > e.since[1]):
            self.weak.append((e.from_block, upto))
        if upto == e.from_block or e.tag in PROSE or e.tag in ("html", "body", "article", "main"):
            return
        if not e.article or e.tag in LISTS and links:
            self.subtrees.append((digest, e.from_block, upto))

    def main_text(self, template: set[int] = frozenset()) -> str:
        inside = _covered([(a, b) for digest, a, b in self.subtrees if digest in template], len(self.blocks))
        left = [b for b, out in zip(self.blocks, inside.tolist()) if not out and not b[1]]
        for k in (2, 3):
            if any(b[k] and not b[1] for b in self.blocks):
                left = [b for b in left if b[k]]
                break
        return "\n".join(b[0] for b in left)


def host_of(url: str | None) -> bytes:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower().encode() if m else b""


def _keyed(url: str | None, digests) -> list[int]:
    """Subtree hashes as hashes of this host."""
    seed = xxhash.xxh3_64_intdigest(host_of(url))
    return [int(np.int64(np.uint64((d * 0x9E3779B97F4A7C15 ^ seed * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1))) for d in digests]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, subtree, page) of each subtree, and of each page itself (subtree: null)."""
    for b in batches:
        seen: set[tuple[int, int | None, int]] = set()
        for url, raw in zip(b.column("url").to_pylist(), utf8(b.column("html"))):
            page = Page(raw.decode())
            whole, (host,) = xxhash.xxh3_64_intdigest(page.main_text()) >> 1, _keyed(url, (0,))
            seen.add((host, None, whole))
            seen.update((host, k, whole) for k in set(_keyed(url, (d for d, _, _ in page.subtrees))))
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["host", "subtree", "page"])


def templates(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(subtree): hashes of (host, subtree) that at least this share of the host's different pages hold, and at least ``FEWEST`` of them."""
    held = pages.select("url", "html").mapInArrow(_subtrees, "host long, subtree long, page long").distinct()
    counts = cut(held.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")))
    all_ = counts.where("subtree is null").select("host", F.col("pages").alias("all"))
    return counts.where("subtree is not null").where(F.col("pages") >= FEWEST).join(all_, "host").where(F.col("pages") >= share * F.col("all")).select("subtree")


def extracted(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    spark = pages.sparkSession
    found = cut(templates(pages, share))
    steps = max(1, -(-found.count() // BROADCAST))
    out = pages.select("page_id", "url", "html", F.lit(None).cast("array<bigint>").alias("drop"))
    for k in range(steps):  # each marks the page's subtrees that are among some of the templates
        some = found if steps == 1 else found.where(F.pmod(F.xxhash64("subtree"), F.lit(steps)) == k)
        shared = spark.sparkContext.broadcast(np.sort(some.toArrow().column("subtree").to_numpy()))
        if k < steps - 1:
            out = out.mapInArrow(_marked(shared), out.schema)
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return out.mapInArrow(_texts(shared), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def _hits(page: Page, url: str | None, template: np.ndarray) -> set[int]:
    """The digests of the page's subtrees whose hashes are in the sorted template."""
    digests = [d for d, _, _ in page.subtrees]
    if not digests or not len(template):
        return set()
    keys = np.array(_keyed(url, digests), np.int64)
    at = np.minimum(np.searchsorted(template, keys), len(template) - 1)
    return {d for d, hit in zip(digests, (template[at] == keys).tolist()) if hit}


def _signed(digests) -> list[int]:
    return [int(np.int64(np.uint64(d))) for d in digests]


def _marked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drop = [[*(old or ()), *_signed(_hits(Page(raw.decode()), url, shared.value))] for url, raw, old in zip(b.column("url").to_pylist(), utf8(b.column("html")), b.column("drop").to_pylist())]
            yield b.set_column(b.schema.get_field_index("drop"), "drop", pa.array(drop, pa.list_(pa.int64())))

    return run


def _texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = []
            for url, raw, drop in zip(b.column("url").to_pylist(), utf8(b.column("html")), b.column("drop").to_pylist()):
                page = Page(raw.decode())
                text.append(page.main_text(_hits(page, url, shared.value) | {d & (1 << 64) - 1 for d in drop or ()}))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run
