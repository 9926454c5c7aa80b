"""Main text of web pages by removal of site templates.

Every page is read once into elements (with the implied ends of HTML, unclosed and truncated pages included), and what may
be main text is written down with the elements around it.  The subtree of each block element outside the article, and of
each block of mostly links inside it, gets a hash of tag, text and subtrees.  Spark counts on how many pages of a host each
hash stands, summed up before the shuffle; subtrees on at least ``pages`` pages and ``share`` of the host's pages are its
template and are deleted from the blocks written down.  Paragraphs of an article are never templates: a sentence that all
articles share stays.  For hosts with few pages, fixed rules also drop what HTML itself or a class name marks as menu,
header, footer, sidebar, notice, advert, form or comments.  Names are compared whole; inside an article only those that
can mean nothing else count, others need a block of mostly links, and a heading is never dropped for its name.
A page with <article> (or else <main>) keeps only what is in there.

White space inside a block becomes one space, blocks are joined by one newline, character references are decoded as
HTML 5 says.  Defined results: null or empty html gives an empty text; a null url is a host of its own kind; equal
rows give equal results; an empty table gives an empty result.  Reading takes time in proportion to the page's length,
however deep its elements lie; a page is held in memory whole.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import materialize
from .text import slices

#: Rows of templates that go to every task; beyond it they are joined to the pages by host.
MOST_SENT = 100_000
SALTS = 64

# Names that HTML and common practice give to parts of a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript iframe svg math textarea title xmp noembed noframes"
DROPPED = frozenset("nav footer aside form button dialog menu search head template object canvas audio video select datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that mark adverts, comments, menus and notices wherever they stand.
MARKS = frozenset("ad ads advert adverts advertisement advertising ad-banner ad-container ad-slot ad-unit ad-wrapper adsbygoogle breadcrumb breadcrumbs comments comment-list comments-area comments-section consent cookie cookies cookie-banner cookie-consent cookie-notice disqus gdpr masthead main-nav nav-menu navbar newsletter newsletter-signup pager pagination popup reader-comments share-buttons sidebar site-footer site-header site-nav skip-link social-links social-share sponsored".split())
#: Names that mark them outside articles, and inside only a block of mostly links.
MAY_MARK = frozenset("banner comment footer header-nav login menu modal nav navigation notice notices overlay promo promotion related related-articles related-posts replies reply share sharing signup skip social sponsor subscribe toolbar widget widgets".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog menu menubar toolbar".split())
#: End tags reach no element outside one of these.
BARRIERS = frozenset("table td th caption button".split())
ENDS_P = BLOCKS - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption", "title"}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+"  # a quote counts only right behind an equals sign
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:svg|math)(?=[\s/>])" + _ATTRS + r"(?<=/)>|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>])" + _ATTRS + r"(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>" + _ATTRS + r")(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))""")
_SPACES = re.compile(r"[ \t\n\r\f\v   -     　\u0085]+")


class _Element:
    __slots__ = ("tag", "dropped", "article", "main", "maybe", "parts", "size", "linked", "key", "up")

    def __init__(self, tag: str, up: "_Element | None"):
        self.tag, self.dropped, self.article, self.main, self.maybe = tag, bool(up and up.dropped), bool(up and up.article), bool(up and up.main), False
        self.parts: list[bytes] = []
        self.size = self.linked = 0
        self.key = 0  # hash, once closed, if the element may be a template
        self.up = up


def _names(attrs: str) -> tuple[set[str], set[str]]:
    """Whole class names and ids of a tag in lower case, and its roles."""
    names: set[str] = set()
    roles: set[str] = set()
    for m in _ATTR.finditer(attrs):
        kind = m[1].lower()
        if kind in ("class", "id", "role"):
            (roles if kind == "role" else names).update((m[2] or m[3] or m[4] or "").lower().split())
    return names, roles


def read_page(source: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """Blocks of main text; for each the place of the innermost element around it that may be a template, or -1; the hashes of these elements and for each the place of the next one around it."""
    root = _Element("html", None)
    stack, blocks, words, elements = [root], [], [], [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    open_blocks, barriers = [0], [0]

    def flush() -> None:
        text = _SPACES.sub(" ", "".join(words)).strip(" ")
        words.clear()
        if text:
            blocks.append((text, stack[-1]))

    def close() -> None:
        e = stack.pop()
        places[e.tag].pop()
        if open_blocks[-1] == len(stack):
            open_blocks.pop()
        if barriers[-1] == len(stack):
            barriers.pop()
        digest = xxhash.xxh64(e.tag.encode("utf-8", "surrogatepass") + b"\0" + b"".join(e.parts)).intdigest()
        e.parts = []
        up = stack[-1]
        up.parts.append(digest.to_bytes(8, "little"))
        up.size += e.size
        up.linked += e.size if e.tag == "a" else e.linked
        links = 2 * e.linked > e.size
        e.maybe = e.maybe and links
        if e.tag in BLOCKS and e.size and e.tag not in ("article", "main") and (not e.article or e.tag != "p" and links):
            e.key = digest - (digest >> 63 << 64)

    def close_to(k: int) -> None:
        while len(stack) > k:
            close()

    at, any_article, any_main = 0, False, False
    for m in [*_TOKEN.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        at = m.end() if m else at
        if text:
            text = _html.unescape(text)
            words.append(text)
            plain = _SPACES.sub(" ", text).strip(" ")
            if plain:
                stack[-1].parts.append(plain.encode("utf-8", "surrogatepass"))
                stack[-1].size += len(plain)
        if m is None or not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        block = tag in BLOCKS
        if m["end"]:
            k = places[tag][-1] if places[tag] else 0
            if k and k >= (barriers[-1] if tag not in ("table", "tr", "tbody", "thead", "tfoot") else 0) and (block or tag in DROPPED or k > open_blocks[-1]):  # </b> ends no paragraph
                if block:
                    flush()
                close_to(k)
            elif tag in ("p", "body", "html"):
                flush()
            continue
        if block:
            flush()
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P and places["p"] and places["p"][-1] > barriers[-1]:
            close_to(places["p"][-1])
        if tag in CLOSES:
            limit = max((places[t][-1] for t in LIMITS[tag] if places[t]), default=0)
            inside = [places[t][i] for t in CLOSES[tag] if (i := bisect_right(places[t], limit)) < len(places[t])]
            if inside:
                close_to(min(inside))
        e = _Element(tag, stack[-1])
        e.article |= tag == "article"
        attrs = m["attrs"]
        names, roles = _names(attrs) if "=" in attrs else (set(), set())
        e.main |= tag == "main" or "main" in roles
        any_article |= e.article
        any_main |= e.main
        if not e.dropped and tag not in ("article", "main"):
            marked = tag not in HEADINGS and not names.isdisjoint(MARKS) or not roles.isdisjoint(ROLES)
            may = tag not in HEADINGS and not names.isdisjoint(MAY_MARK)
            e.dropped = tag in DROPPED or tag == "header" and not e.article or marked or may and not e.article
            e.maybe = may and not e.dropped
        places[tag].append(len(stack))
        if block:
            open_blocks.append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        stack.append(e)
        elements.append(e)
        if attrs.endswith("/") and not block:
            close()
    flush()
    close_to(1)
    gone, wanted = {id(root): False}, []
    for e in elements[1:]:  # each stands behind those around it
        gone[id(e)] = e.maybe or gone[id(e.up)]
    for text, e in blocks:
        if not e.dropped and not gone[id(e)] and (e.article if any_article else e.main if any_main else True):
            wanted.append((text, e))
    needed: set[int] = set()
    for _, e in wanted:
        while e is not None and id(e) not in needed:
            needed.add(id(e))
            e = e.up
    keys, ups, place = [], [], {id(root): -1}
    for e in elements[1:]:
        if id(e) in needed:
            around = place[id(e.up)]
            if e.key:
                place[id(e)] = len(keys)
                keys.append(e.key)
                ups.append(around)
            else:
                place[id(e)] = around
    return [t for t, _ in wanted], [place[id(e)] for _, e in wanted], keys, ups


def without(blocks: list[str], inner: list[int], keys: list[int], ups: list[int], gone: set[int]) -> str:
    """Blocks that no deleted element holds, joined."""
    if not gone or not keys:
        return "\n".join(blocks)
    deleted: list[bool] = []
    for key, up in zip(keys, ups):
        deleted.append(key in gone or up >= 0 and deleted[up])
    return "\n".join(t for t, i in zip(blocks, inner) if i < 0 or not deleted[i])


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


READ = "host string, page_id long, url string, blocks array<string>, inner array<int>, keys array<long>, ups array<int>"


def read_pages(pages: DataFrame) -> DataFrame:
    """What may be main text of each page, with the elements around it: each page is read once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                got = [read_page(s.as_py() or "") for s in part.column("html")]
                lists = [pa.array([g[i] for g in got], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int32()))]
                yield pa.record_batch([part.column("host"), part.column("page_id"), part.column("url"), *lists], names=["host", "page_id", "url", "blocks", "inner", "keys", "ups"])

    return pages.select(host_of("url").alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, READ)


def templates(read: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """(host, key) of every subtree that is part of its host's template; ``read`` comes from read_pages."""
    found = read.select("host", F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), "keys"))).alias("key"))  # 0 stands for the page itself
    counted = found.groupBy("host", "key").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("key") == 0, F.col("n"))).over(Window.partitionBy("host"))
    return counted.where((F.col("n") >= least) | (F.col("key") == 0)).withColumn("pages", total).where(f"key <> 0 and n >= {least} and n >= {share} * pages").select("host", "key")


def main_text(pages: DataFrame, *, least: int = 3, share: float = 0.2) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    read = materialize(read_pages(pages))
    found = materialize(templates(read, least, share))
    out = "page_id long, url string, text string, n_chars long"

    def texts(batches: Iterator[pa.RecordBatch], sent: dict[str, set[int]] | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [set(g or ()) for g in batch.column("gone").to_pylist()] if sent is None else [sent.get(h, set()) for h in batch.column("host").to_pylist()]
            result = [without(*page, g) for *page, g in zip(*(batch.column(c).to_pylist() for c in ("blocks", "inner", "keys", "ups")), gone)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(result, pa.string()), pa.array([len(t) for t in result], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    few = found.limit(MOST_SENT + 1).collect()
    if len(few) <= MOST_SENT:
        sent: dict[str, set[int]] = {}
        for r in few:
            sent.setdefault(r["host"], set()).add(r["key"])
        return read.mapInArrow(lambda it: texts(it, sent), out)
    # One row per host (a template needs a share of the pages, so a host has few), repeated for each salt of hot hosts.
    lists = found.groupBy("host").agg(F.collect_list("key").alias("gone")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = read.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(lists, ["host", "salt"], "left").mapInArrow(lambda it: texts(it, None), out)
