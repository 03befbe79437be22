"""HTML extraction with site template removal.

Every element's subtree is hashed in two ways: whole (tag, class, text, children) and, for subtrees that are mostly links, by its
shape (tag, class, children without their number). Spark counts per host on how many different pages each hash occurs.
Template, and gone with what is in them, are: whole subtrees outside the article on at least MIN_PAGES pages; whole subtrees
inside the article and shapes outside it on at least MIN_PAGES pages that are MIN_SHARE of the host's. Pages with the same
html count once, and a subtree with more than half of its page's text does not count, so copies of an article are no template.
Paragraphs, headings and other text blocks are never template by themselves, so a sentence that many articles share stays.

What a page keeps is then judged by tag, role and class names, for hosts with few pages and boilerplate whose text varies:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go; if the page has an article,
only that stays, else its main element, else its body. A class name counts if all words of it are known ones. It never
removes an element that holds an article, main element or main heading, and counts for nothing if no text would be left.

Tags are read one after the other with a stack, so depth is no limit. A start tag closes the elements that HTML lets it
close (a paragraph before a block, an item before an item), and an end tag closes what is open inside its element.

Cases: a null html is empty and gives an empty text; a null or malformed url has the host ""; rows alike in all three columns
are one page to the counts and each gets its text; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellis.llm.common import spread_join, written

#: A subtree is template on at least MIN_PAGES different pages, by its shape or inside an article if these are MIN_SHARE of the host's.
MIN_PAGES, MIN_SHARE = 5, 0.3
#: The template hashes of the pages are broadcast up to this many, beyond it they are joined by shuffle.
BROADCAST_HASHES = 1_000_000

# The tags of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr tbody thead tfoot summary".split())
BLOCKS = TEXT_BLOCKS | frozenset("html body head article main section div header footer nav aside form ul ol dl table figure address details dialog fieldset hr menu noscript template center hgroup search svg select option button canvas object video audio".split())
DROPPED = frozenset("head nav footer aside form noscript template dialog menu svg select button canvas object video audio script style textarea title iframe noembed noframes xmp fieldset search".split())
CLOSES_P = BLOCKS - frozenset("html body head option button noscript template select svg canvas object video audio tr td th tbody thead tfoot caption li dt dd".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer "
    "sidebar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "toolbar banner masthead skip".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies".split())
HEADER_NAMES = frozenset(("header", "topbar", "widget"))
#: Words beside those names that say nothing of their own.
NEUTRAL = frozenset(
    "site page main top bottom left right upper lower primary secondary global local box block container wrapper wrap list section area bar button buttons link links post posts form inner outer item items "
    "module unit slot panel content holder row col column js the to my is and for us text message policy icons media network articles stories reader user article thread".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
MAIN, INSIDE, SHAPE = 0, 1, 2


def _named(attributes: list[tuple[str, str]], names: frozenset[str]) -> bool:
    """Whether some class or id is made of these names and neutral words alone."""
    for name, value in attributes:
        if name != "role":
            for token in value.split():
                words = {w.lower() for w in WORD.findall(token)}
                if words & names and words <= names | NEUTRAL:
                    return True
    return False


class _Open:
    """An open element: what its start tag says, what was there before it, and what it has held so far."""

    __slots__ = ("blocks", "chars", "goes", "inside", "label", "links", "main", "pieces", "prose", "shapes", "subtrees", "tag", "weak")

    def __init__(self, tag: str, label: str, goes: bool, weak: bool, inside: bool, blocks: int, pieces: int):
        self.tag, self.label, self.goes, self.weak, self.inside, self.blocks, self.pieces = tag, label, goes, weak, inside, blocks, pieces
        self.subtrees: list[str] = []
        self.shapes: list[str] = []
        self.chars = self.links = 0
        self.main = self.prose = False


class Page:
    """One pass over a page: the hashes of its candidate subtrees, and its text blocks without ``template``."""

    def __init__(self, html: str, template: frozenset[int] = frozenset(), names: bool = True):
        self.template, self.names = template, names
        #: hash, kind and text length of each candidate; the number of subtrees that went as template
        self.found: list[tuple[int, int, int]] = []
        self.n_template = 0
        self.blocks: list[str] = []
        self.pieces: list[str] = []
        self.ranges: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.stack = [_Open("", "", False, False, False, 0, 0)]
        self.inside = {"article": 0, "main": 0}
        self.link = self.by_name = False
        self._read(html)
        while len(self.stack) > 1:
            self._close()
        self._flush()

    def text(self) -> str:
        for tag in ("article", "main"):
            if found := [b for first, after in self.ranges[tag] for b in self.blocks[first:after]]:
                return "\n".join(found)
        return "\n".join(self.blocks)

    def candidates(self) -> set[tuple[int, int]]:
        """(hash, kind) of the subtrees with at most half of the page's text."""
        return {(h, kind) for h, kind, chars in self.found if 2 * chars <= self.stack[0].chars}

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">") + 1  # no tag ends after the last ">", so nothing is looked for there but what needs no end
        while (token := TOKEN.search(html, at, last)) is not None:
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            if UNCLOSED.match(token[0]) and not (token[0].endswith("-->") and len(token[0]) > 6 if token[0].startswith("<!--") else token[0].endswith("]]>")):
                at = token.start()  # it goes on to the end of the page
                break
            end, tag, rest = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
            if not tag:
                if token[0].startswith("<![CDATA["):
                    self._text(token[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if tag == "a":
                self.link = not end
            if end:
                self._end(tag)
            elif tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(html, at, last)
                at = stop.end() if stop else len(html)
                if tag not in DROPPED:
                    self._text(html[token.end() : stop.start() if stop else at])
            elif tag in VOID:
                self.pieces.append(" ") if tag == "br" else self._flush() if tag == "hr" else None
            else:
                self._start(tag, rest)
        if at < len(html):
            opened = UNCLOSED.search(html, at)
            self._text(html[at : opened.start() if opened else len(html)])
            if opened and opened[0] != "<!--":
                self._text(html[opened.end() :])

    def _text(self, raw: str) -> None:
        self.pieces.append(raw)
        if words := raw.split():
            text, top = " ".join(words), self.stack[-1]
            top.subtrees.append(text)
            top.chars += len(text)
            top.links += len(text) * self.link

    def _flush(self) -> None:
        if self.pieces:
            if words := unescape("".join(self.pieces)).split():
                self.blocks.append(" ".join(words))
            self.pieces = []

    def _start(self, tag: str, rest: str) -> None:
        attributes = [(n.lower(), a or b or c) for n, a, b, c in ATTRIBUTE.findall(rest)] if "=" in rest else []
        inside = self.inside["article"] + self.inside["main"] > 0
        goes = tag in DROPPED or tag == "header" and not inside or any(n == "role" and ROLES.intersection(value.lower().split()) for n, value in attributes)
        goes = goes or tag not in ("html", "body", "main") and _named(attributes, COMMENT_NAMES)
        weak = self.names and tag not in ("html", "body", "article", "main") and _named(attributes, NAMES if inside else NAMES | HEADER_NAMES)
        if tag not in BLOCKS and not goes and not weak:
            return  # inline markup: its text belongs to the block around it
        if tag in CLOSES_P:
            self._close_to({"p"}, {"button", "table", "td", "th", "article"})
        if tag in CLOSED_BY:
            for _ in range(3):
                self._close_to(CLOSED_BY[tag], SCOPES[tag])
        if tag in BLOCKS:
            self._flush()
        if tag in self.inside:
            self.inside[tag] += 1
        self.stack.append(_Open(tag, " ".join(f"{n}={v}" for n, v in attributes if n == "class"), goes, weak, inside, len(self.blocks), len(self.pieces)))

    def _close_to(self, tags: set[str], scope: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k].tag in scope:
                return

    def _end(self, tag: str) -> None:
        if tag not in BLOCKS and not any(e.tag == tag for e in self.stack[-3:]):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                return

    def _close(self) -> None:
        element = self.stack.pop()
        tag, above, blocks = element.tag, self.stack[-1], element.blocks
        if tag in BLOCKS:
            self._flush()
        if tag in self.inside:
            self.inside[tag] -= 1
        digest = hashlib.blake2b("\x01".join((tag, element.label, *element.subtrees)).encode("utf-8", "replace"), digest_size=8).digest()
        above.subtrees.append(digest.hex())
        above.chars += element.chars
        above.links += element.links
        above.main |= element.main or tag in ("article", "main", "h1")
        shape = hashlib.blake2b("\x02".join((tag, element.label, *(s for k, s in enumerate(element.shapes) if k == 0 or s != element.shapes[k - 1]))).encode("utf-8", "replace"), digest_size=8).digest()
        above.shapes.append(shape.hex())
        goes = element.goes
        if tag not in TEXT_BLOCKS and tag not in ("html", "body", "head", "article", "main"):
            keys = [(int.from_bytes(digest, "little", signed=True) ^ element.inside, INSIDE if element.inside else MAIN)]
            if not element.inside and 2 * element.links > element.chars:
                keys.append((~int.from_bytes(shape, "little", signed=True), SHAPE))
            self.found += [(h, kind, element.chars) for h, kind in keys]
            if any(h in self.template for h, _ in keys):
                goes = True
                self.n_template += 1
        if not goes and element.weak and not element.main and blocks < len(self.blocks) + (element.pieces < len(self.pieces)):
            goes = self.by_name = True
        if goes:
            del self.blocks[blocks:]
            del self.pieces[element.pieces :]
            for kept in self.ranges.values():
                while kept and kept[-1][1] > blocks:
                    kept.pop()
        elif tag in self.inside and not self.inside[tag] and len(self.blocks) > blocks:
            self.ranges[tag].append((blocks, len(self.blocks)))


def main_text(html: str, template: frozenset[int] = frozenset()) -> tuple[str, int]:
    """The main text of a page and how many of its subtrees went as template."""
    page = Page(html, template)
    text = page.text()
    if not text and page.by_name:
        text = Page(html, template, names=False).text()
    return text, page.n_template


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _numbered(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(row, host, html): row is a number by url and html."""
    html = F.coalesce(pages[html_col], F.lit(""))
    return pages.select(F.xxhash64(pages[url_col], html).alias("row"), host_of(pages[url_col]).alias("host"), html.alias("html"))


def template_hashes(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(row, template): the hashes of each page's subtrees that are template of its host; pages without any are left out."""
    rows = _numbered(pages, url_col, html_col).withColumn("version", F.xxhash64("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(row, host, version, h, kind) for row, host, version, html in zip(batch["row"], batch["host"], batch["version"], batch["html"], strict=True) for h, kind in Page(html).candidates()]
            yield pd.DataFrame(found, columns=["row", "host", "version", "h", "kind"]).astype({"row": "int64", "host": "object", "version": "int64", "h": "int64", "kind": "int32"})

    each = written(rows.select("row", "host", "version", "html").mapInPandas(run, "row long, host string, version long, h long, kind int"), "subtrees")
    counts = each.groupBy("host", "h", "kind", "version").agg(F.count("*").alias("rows")).groupBy("host", "h", "kind").agg(F.count("*").alias("pages"), F.sum("rows").alias("n"))
    sizes = rows.select("host", "version").distinct().groupBy("host").agg(F.count("*").alias("of"))
    often = counts.filter(F.col("pages") >= min_pages).join(sizes, "host").filter((F.col("kind") == MAIN) | (F.col("pages") >= F.col("of") * min_share))
    often = written(often.select("host", "h", "n"), "often")
    return spread_join(each.select("row", "host", "h"), often, ["host", "h"]).groupBy("row").agg(F.collect_set("h").alias("template"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (blocks joined by one line feed), n_chars (its code points) and n_template (subtrees removed as template)."""
    known = written(template_hashes(pages, url_col, html_col), "templates")
    size = known.agg(F.coalesce(F.sum(F.size("template") + 1), F.lit(0)).alias("n")).first()["n"]
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    joined = rows.withColumn("row", F.xxhash64("url", "html")).join(F.broadcast(known) if size <= BROADCAST_HASHES else known, "row", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [main_text(html, frozenset() if template is None else frozenset(template.tolist())) for html, template in zip(batch["html"], batch["template"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": [t for t, _ in made], "n_chars": [len(t) for t, _ in made], "n_template": [n for _, n in made]})

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "template").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long, n_template long")
