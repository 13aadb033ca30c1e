"""Main-text extraction from HTML with site template removal.

Every block element's subtree is hashed twice: with its text (tag, class, id, text
and children), and by structure alone (the path of elements to it, class and id
without digits, the shapes of its children, where equal neighbours count once and
inline markup does not).  On Spark the hashes are counted per host, over pages told
apart by their longest block, so copies of one article do not make its paragraphs
look like a template.  Subtrees that recur are the host's template and are deleted
from its pages:

* with the same text on ``MIN_PAGES`` and on ``MIN_SHARE`` of the host's pages,
  anywhere on the page;
* with the same structure on as many, or on ``MANY_PAGES`` pages of a host of any
  size, if they stand outside the page's content, or are links for ``LINKED`` of
  their characters in content that no element declares.

The content is what is inside ``article`` or ``main``; on a page without them, the
innermost container with ``CONTENT`` of the text that is no link.  Articles share
the structure of their paragraphs, so inside the content structure alone decides
nothing but lists of links.  What is boilerplate by its element or its class goes
as well, and pages with an ``article`` or ``main`` element keep only what is inside.

Text is split into blocks at block elements; inside a block character
references are decoded and white space becomes one space.

Defined results.  Null or empty html: empty text.  Pages without a host (null or
odd url) are extracted without a template.  Repeated pages are extracted row by
row; unclosed and stray tags are tolerated; an empty table gives no rows; very
long pages are parsed whole; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import annotate, cut

MIN_PAGES = 3          # different pages a template subtree is on, at least
MIN_SHARE = 0.5        # share of the host's different pages it is on, at least
MANY_PAGES = 20        # different pages that make a structure a template whatever its share
CONTENT = 0.6          # share of the page's text that its content holds
LINKED = 0.8           # share of link characters of a list of links

# Fixed element lists of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
         "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search",
         "section", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
          "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "menu", "dl", "table", "select", "article", "main", "body"}
# Elements that can be the content of a page that declares none.
HOLDS = {"html", "body", "div", "section", "td", "center"}
# Boilerplate by element; header and footer elements of an article's own are judged apart.
DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "template", "head", "svg", "math", "object", "canvas",
        "audio", "video", "button", "select", "datalist", *RAW}
# Boilerplate by a word of class, id or role.
WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
         "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav",
         "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "related",
         "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
         "subscribe", "toolbar", "widget", "contentinfo", "complementary", "alert"}
HEADER_WORDS = {"header", "masthead", "topbar"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I | re.S)
WORD = re.compile(r"[a-z]+")
NUMBER = re.compile(rb"[0-9]+")
RESULTS = "text string, n_chars long, n_template long"


def _digest(*parts: bytes) -> bytes:
    return xxhash.xxh3_64_digest(b"\0".join(parts))


_known_digest = lru_cache(1 << 14)(_digest)      # paths and shapes repeat from page to page


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


@lru_cache(1 << 12)
def _attributes(attrs: str) -> tuple[bytes, bytes, set[str], bool, bool]:
    """Key of class, id, role and hiding, the key without digits, its words, whether the element is the main one, hidden."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    key = " ".join(f"{k}={v}" for k, v in sorted(found.items())).encode("utf-8", "replace")
    words = set(WORD.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
    return key, NUMBER.sub(b"0", key), words, found.get("role", "") == "main", \
        "hidden" in found or found.get("aria-hidden", "").lower() == "true"


class Element:
    """An open element: what its subtree's hashes are made of, and the flags its text inherits."""

    __slots__ = ("tag", "key", "kind", "path", "children", "shapes", "first", "main", "drop")

    def __init__(self, tag: str, key: bytes, kind: bytes, path: bytes, first: int, main: bool, drop: bool):
        self.tag, self.key, self.kind, self.path, self.first, self.main, self.drop = tag, key, kind, path, first, main, drop
        self.children: list[bytes] = []
        self.shapes: list[bytes] = []

    def shape(self, part: bytes) -> None:
        if not self.shapes or self.shapes[-1] != part:
            self.shapes.append(part)


class Page:
    """Blocks of a page and the block ranges of its subtrees.

    ``blocks``: (text, is main text, is boilerplate).  ``trees``: (hash with text,
    hash of the structure, first block, block after the last, can be the content)
    of every block element with text.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.trees: list[tuple[int, int, int, int, bool]] = []
        self._plain: list[int] = []            # characters outside links, per block
        self._buffer: list[str] = []
        self._dropped: list[str] = []
        self._outside = {False: 0, True: 0}    # characters outside links of the two buffers
        self._stack = [Element("", b"", b"", b"", 0, False, False)]
        self._open: dict[str, int] = {}
        if source:
            self._parse(source)
        self._plain_to = [0, *accumulate(self._plain)]
        self._size_to = [0, *accumulate(len(t) - t.count(" ") for t, _, _ in self.blocks)]
        self._content = self._find_content()

    def _flush(self) -> None:
        top = self._stack[-1]
        for buffer, drop in ((self._buffer, False), (self._dropped, True)):
            if buffer:
                t = " ".join("".join(buffer).split())
                if t:
                    self.blocks.append((t, top.main, drop))
                    self._plain.append(self._outside[drop])
                buffer.clear()
                self._outside[drop] = 0

    def _text(self, raw: str) -> None:
        if not raw:
            return
        t = html.unescape(raw) if "&" in raw else raw
        top = self._stack[-1]
        (self._dropped if top.drop else self._buffer).append(t)
        words = t.split()
        if words:
            t = " ".join(words)
            if not self._open.get("a"):
                self._outside[top.drop] += len(t) - len(words) + 1
            top.children.append(t.encode("utf-8", "replace"))
            top.shape(b"t")

    def _push(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
        else:
            self._buffer.append("")
        above = self._stack[-1]
        main, drop = above.main, above.drop
        key, kind, words, declared, hidden = _attributes(attrs if ATTR.search(attrs) else "")
        if tag in ("article", "main") or declared:
            main = main or not drop
        drop = drop or tag in DROP or hidden or bool(words & WORDS) and tag not in ("html", "body") \
            or not main and (tag == "header" or bool(words & HEADER_WORDS) and tag not in ("html", "body"))
        path = _known_digest(above.path, tag.encode(), kind) if tag in BLOCK else above.path
        self._stack.append(Element(tag, key, kind, path, len(self.blocks), main, drop))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop(self) -> None:
        top = self._stack[-1]
        if top.tag in BLOCK:
            self._flush()
        self._stack.pop()
        self._open[top.tag] -= 1
        if not top.children:
            return
        above = self._stack[-1]
        d = _digest(top.tag.encode(), top.key, *top.children)
        above.children.append(d)
        if top.tag not in BLOCK and top.tag != "a":
            for part in top.shapes:              # inline markup is transparent
                above.shape(part)
            return
        shape = _known_digest(top.tag.encode(), top.kind, *top.shapes)
        above.shape(shape)
        if top.tag in BLOCK and len(self.blocks) > top.first:
            self.trees.append((_number(d), _number(_known_digest(b"structure", top.path, shape)), top.first, len(self.blocks),
                               top.tag in HOLDS))

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Close the nearest open element of ``tags`` with all inside it, unless a ``stop`` element is nearer."""
        if not any(self._open.get(t) for t in tags):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            t = self._stack[depth].tag
            if t in tags:
                while len(self._stack) > depth:
                    self._pop()
                return
            if t in stop:
                return

    def _parse(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            m = TAG.search(s, at)
            if m is None:
                self._text(s[at:])
                break
            self._text(s[at:m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, attrs = tag.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                self._close({tag}, set())
                if tag in BLOCK:
                    self._flush()
                continue
            if tag in BLOCK and self._open.get("p"):
                self._close({"p"}, {"td", "th", "li", "button", "object", "table", "article", "main", "div", "section"})
            if tag in CLOSES:
                self._close(CLOSES[tag], SCOPE)
            if tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._text(" ")
                continue
            self._push(tag, attrs)
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}", re.I).search(s, at)
                at = end.start() if end else n
                self._pop()
            elif attrs.rstrip().endswith("/") and tag in ("svg", "math", "path"):
                self._pop()
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _find_content(self) -> tuple[int, int] | None:
        """Blocks of the content of a page that declares none (the innermost container with most of the text)."""
        if any(main and not drop for _, main, drop in self.blocks):
            return None
        plain = [0, *accumulate(n * (not drop) for n, (_, _, drop) in zip(self._plain, self.blocks))]
        got = (0, len(self.blocks))
        for _, _, a, b, holds in self.trees:
            if holds and b - a < got[1] - got[0] and plain[b] - plain[a] >= CONTENT * plain[-1]:
                got = a, b
        return got

    def _structural(self, a: int, b: int) -> bool:
        """Whether the subtree of these blocks may be judged by its structure alone."""
        if not self._holds_content(a, b):
            return True
        return self._content is not None and self._plain_to[b] - self._plain_to[a] <= (1 - LINKED) * (self._size_to[b] - self._size_to[a])

    def _holds_content(self, a: int, b: int) -> bool:
        """Whether the subtree of these blocks has a part of the content."""
        if self._content is None:
            return any(main for _, main, _ in self.blocks[a:b])
        first, last = self._content
        return a < last and b > first

    def hashes(self) -> tuple[set[int], set[int]]:
        """Hashes of the subtrees with their text, and of the structure of those that may be judged by it."""
        return {t[0] for t in self.trees}, {t[1] for t in self.trees if self._structural(t[2], t[3])}

    def identity(self) -> int:
        """Hash of the longest block of the content, which tells pages apart."""
        longest = max(self._main(), key=lambda x: len(x[0]), default=("", False, False))[0]
        return _number(_digest(longest.encode("utf-8", "replace")))

    def _main(self) -> list[tuple[str, bool, bool]]:
        if self._content is not None:
            a, b = self._content
            return [x for x in self.blocks[a:b] if not x[2]]
        return [x for x in self.blocks if x[1] and not x[2]]

    def deleted(self, template: frozenset[int]) -> set[int]:
        """Numbers of the blocks in subtrees of ``template``."""
        gone: set[int] = set()
        total = len(self._main())
        for h, shape, a, b, _ in self.trees:
            same = h in template and not (b - a > total / 2 and self._holds_content(a, b))
            if same or shape in template and self._structural(a, b):
                gone.update(range(a, b))
        return gone

    def rest(self, gone: set[int]) -> str:
        """The main text without the blocks ``gone``."""
        declared = self._content is None
        return "\n".join(t for i, (t, main, drop) in enumerate(self.blocks) if not drop and i not in gone and (main or not declared))

    def text(self, template: frozenset[int]) -> str:
        """The main text without the subtrees of ``template``."""
        return self.rest(self.deleted(template))


def host(url: Column) -> Column:
    """Host of a url in lower case, null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(h) > 0, h)


def site_templates(pages: DataFrame, source: str = "html", url: str = "url", min_pages: int = MIN_PAGES,
                   min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """``(host, template)``: the subtree hashes that recur on each host.

    A host has at most (subtrees of an average page) / ``min_share`` of them by
    share, and (its subtrees) / ``many_pages`` by number.
    """
    src = pages.select(host(F.col(url)).alias("host"), F.col(source).alias("html")).where("host is not null")

    def trees(b: pa.RecordBatch) -> list:
        got = [Page(x) for x in b.column("html").to_pylist()]
        both = [p.hashes() for p in got]
        return [pa.array([p.identity() for p in got], pa.int64()),
                pa.array([list(x[0]) for x in both], pa.list_(pa.int64())),
                pa.array([list(x[1]) for x in both], pa.list_(pa.int64()))]

    # one row per page and hash; a hash of null stands for the page itself
    both = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("tree"), F.lit(False).alias("structure"))),
                    F.transform("texts", lambda x: F.struct(x.alias("tree"), F.lit(False).alias("structure"))),
                    F.transform("shapes", lambda x: F.struct(x.alias("tree"), F.lit(True).alias("structure"))))
    seen = annotate(src, ["host"], {"html": F.col("html")}, trees, "page long, texts array<long>, shapes array<long>") \
        .select("row.host", "page", F.explode(both).alias("t")).select("host", "page", "t.*").distinct()
    counts = cut(seen.groupBy("host", "tree", "structure").agg(F.count("*").alias("n")), "subtrees")
    hosts = counts.where("tree is null").select("host", F.col("n").alias("pages"))
    often = counts.where("tree is not null").where(F.col("n") >= F.least(F.lit(min_pages), F.lit(many_pages))).join(hosts, "host") \
        .where((F.col("n") >= min_pages) & (F.col("n") >= F.col("pages") * min_share) | F.col("structure") & (F.col("n") >= many_pages))
    return cut(often.groupBy("host").agg(F.collect_list("tree").alias("template")), "templates")


def extract(pages: DataFrame, keep: list[str], source: str = "html", url: str = "url", **limits) -> DataFrame:
    """``(row, text, n_chars, n_template)`` for every page; ``n_template`` counts the blocks its host's template deleted."""
    templates = site_templates(pages, source, url, **limits).withColumnRenamed("host", "_host")
    src = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(source).alias("html"),
                       host(F.col(url)).alias("_host")).join(templates, "_host", "left")

    def run(b: pa.RecordBatch) -> list:
        texts, gone, last, known = [], [], None, frozenset()
        for x, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist()):
            if t != last:
                last, known = t, frozenset(t or ())
            page = Page(x)
            blocks = page.deleted(known)
            texts.append(page.rest(blocks))
            gone.append(len(blocks))
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())]

    done = annotate(src, ["kept"], {"html": F.col("html"), "template": F.col("template")}, run, RESULTS)
    return done.withColumn("row", F.col("row.kept"))
