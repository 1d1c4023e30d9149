"""The main text of web pages, with site templates found by counting element subtrees per host.

A first pass hashes the subtrees of every page, those of menus and footers too; Spark counts, for each host, in how many
different articles each occurs. Subtrees that recur are the host's template, and the second pass deletes them. Parts that
name themselves as something else than text are template sooner than others; within a marked article, where a host's own
text may be quoted again, a subtree must recur in more articles than elsewhere. Only then what is left of navigation,
header, footer, sidebar, notice, advert, form, script, style or comments goes by its name, and of the rest the articles
are taken, if the page marks any. Within an article, names that words of the text may also have (`notice`, `modal`) are
no reason to delete a part that doesn't recur.

Null and empty pages have an empty text. Pages that are repeated, or share their article, count once for a template.
Malformed markup is read as browsers do as far as text goes: unclosed and stray tags, cut-off pages, comments. Pages of
any length are read whole. Null or odd addresses share a host without name. An empty table gives no rows. Only the
columns asked for are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import salted_join, stored, trimmed

#: A subtree is template if it occurs in at least LEAST articles; outside of marked articles on hosts with few pages in
#: half of them, but FEW at least. The small share keeps the number of subtrees of a large host's template bounded.
LEAST, SHARE, FEW = 20, 0.01, 3
#: What follows the hash of a subtree within, and outside of, a part marked as the article, and of a part whose name says
#: that it may be no text; such a one is template if it occurs in FEW articles.
INNER, OUTER, NAMED = b"\1", b"\0", b"\2"
#: Hosts with templates are broadcast up to this number of subtree hashes; beyond it a salted join brings them.
BROADCAST_HASHES = 500_000

# Element names and words by which page parts name themselves.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
GONE = frozenset(
    "script style title textarea xmp iframe noembed noframes head noscript template svg canvas object audio video map "
    "nav footer aside form button select option datalist dialog menu menuitem label fieldset".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address center details summary header hgroup hr search "
    "head nav footer aside form fieldset dialog menu".split()
)
SCOPES = frozenset("html table td th caption button object template".split())
CLOSES = {
    "li": ("li", "ul ol menu".split()), "dt": ("dt dd", "dl".split()), "dd": ("dt dd", "dl".split()), "tr": ("tr td th", "table".split()),
    "td": ("td th", "tr table".split()), "th": ("td th", "tr table".split()), "tbody": ("thead tbody tfoot tr td th", "table".split()),
}
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup social share sharing related "
    "recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead topbar header "
    "footer comment comments commentlist disqus reply replies respond reactions login search pagination pager toolbar skip copyright".split()
)
#: Of these names, those that a part of an article's text may have too.
WEAK = frozenset(
    "sponsor sponsored promo promotion banner notice notices notification alert popup modal overlay widget widgets menu header search "
    "related recommended reply replies respond reactions login pagination pager toolbar skip copyright".split()
)
REMARKS = frozenset("comment comments reply".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MAIN = frozenset("content main article post entry story maincontent articlebody".split())

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</([A-Za-z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<([A-Za-z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
CUT = re.compile(r"<(?=[A-Za-z/!?])")
WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("name", "gone", "named", "start", "hashed", "main", "label")

    def __init__(self, name: str, gone: bool, named: bool, start: int, main: int, label: str):
        self.name, self.gone, self.named, self.start, self.main, self.label = name, gone, named, start, main, label
        self.hashed: list[bytes] = []


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if "=" in text else {}


class Page:
    """One pass over a page: its blocks of text, the regions that may be the article, the hashes of its subtrees.

    by_name: whether parts go by their names; without, only what the template holds goes. matched: how many subtrees did.
    """

    def __init__(self, html: str, template: frozenset[bytes] = frozenset(), hashing: bool = True, by_name: bool = True):
        self.template, self.hashing, self.by_name = template, hashing or bool(template), by_name
        self.blocks: list[str] = []
        self.line: list[str] = []  # visible text since the last block
        self.shadow: list[str] | None = None  # all text since then, where some of it is hidden
        self.subtrees: set[bytes] = set()
        self.regions: list[tuple[int, int, int]] = []  # rank, first block, end
        self.stack: list[Element] = [Element("", False, False, 0, 0, "")]
        self.open: dict[str, int] = {}  # open elements by name
        self.hidden, self.inside, self.body, self.matched = 0, 0, 0, 0
        self.read(html)

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = TOKEN.search(html, at)
            if found is None:
                rest = html[at:]
                cut = CUT.search(rest)
                self.text(rest[: cut.start()] if cut else rest)
                break
            if found.start() > at:
                self.text(html[at : found.start()])
            at = found.end()
            if name := found[1] or found[4]:
                name = name.lower()
                self.start(name, found[2] or found[5] or "")
                if name in RAW:
                    close = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                    self.end(name)
                    at = close.end() if close else end
            elif found[3]:
                self.end(found[3].lower())
        while len(self.stack) > 1:
            self.pop()
        self.flush()

    def text(self, text: str) -> None:
        if self.hidden:
            if not self.hashing:
                return
            if self.shadow is None:
                self.shadow = list(self.line)
        text = unescape(text) if "&" in text else text
        if not self.hidden:
            self.line.append(text)
        if self.shadow is not None:
            self.shadow.append(text)

    def flush(self) -> None:
        if self.line:
            if text := " ".join("".join(self.line).split()):
                self.blocks.append(text)
                if self.hashing and self.shadow is None:
                    self.stack[-1].hashed.append(text.encode("utf-8", "replace"))
            self.line.clear()
        if self.shadow is not None:
            if text := " ".join("".join(self.shadow).split()):
                self.stack[-1].hashed.append(text.encode("utf-8", "replace"))
            self.shadow = None

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            self.text(" ")
            return
        block = name in BLOCKS
        if block and self.open.get("p"):
            self.close_to(("p",), SCOPES)
        if name in CLOSES:
            names, limit = CLOSES[name]
            self.close_to(tuple(names.split()), limit)
        if block:
            self.flush()
        if name in VOID:
            return
        given = attributes(rest)
        label = f"{given.get('class', '')} {given.get('id', '')}".lower()
        gone, named = self.judged(name, rest, given, frozenset(WORDS.findall(label)))
        main = 0
        if not self.hidden and not gone:
            main = 1 if name == "article" else 2 if name == "main" or given.get("role") == "main" else 3 if name in ("div", "section", "td") and not MAIN.isdisjoint(WORDS.findall(label)) else 0
        self.stack.append(Element(name, gone, named, len(self.blocks), main, label))
        self.open[name] = self.open.get(name, 0) + 1
        self.hidden += gone
        self.inside += main in (1, 2)
        self.body += main > 0

    def judged(self, name: str, rest: str, given: dict[str, str], words: frozenset[str]) -> tuple[bool, bool]:
        """Whether a part goes by what it says of itself, and whether it says that it may be no text."""
        if name in ("html", "body", "main"):
            return False, False
        if name in RAW or name in ("head", "noscript", "template"):
            return True, False
        gone = name in GONE or given.get("role", "").lower() in ROLES or given.get("aria-hidden") == "true"
        gone |= "hidden" in rest.lower() and bool(HIDDEN.search(QUOTED.sub("", rest)))
        gone |= "display:none" in given.get("style", "").replace(" ", "").lower()
        gone |= name == "header" and not self.inside
        named = gone
        if not gone and words and name != "header":
            found = (REMARKS if name == "article" else PARTS) & words
            named = bool(found)
            gone = bool(found - WEAK if self.inside else found)
        return gone and self.by_name, named

    def end(self, name: str) -> None:
        if not self.open.get(name):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == name:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].name in ("td", "th", "table") and name not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html", "div", "article", "main", "section"):
                return

    def close_to(self, names: tuple[str, ...], limit) -> None:
        if not any(self.open.get(n) for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].name in limit:
                return

    def pop(self) -> None:
        e = self.stack[-1]
        if e.name in BLOCKS:
            self.flush()
        self.stack.pop()
        self.open[e.name] -= 1
        self.inside -= e.main in (1, 2)
        self.body -= e.main > 0
        apart = e.named or self.hidden > 0
        self.hidden -= e.gone
        if self.hashing and e.hashed:
            digest = hashlib.blake2b(b"\0".join([e.name.encode("utf-8", "replace"), e.label.encode("utf-8", "replace"), *e.hashed]), digest_size=8).digest()
            # The parent is hashed as it was counted, whatever becomes of this part.
            self.stack[-1].hashed.append(digest)
            if e.name not in ("html", "body", "main", "article") and not e.main:
                placed = digest + (NAMED if apart else INNER if self.body else OUTER)
                if placed in self.template:
                    self.matched += 1
                    del self.blocks[e.start :]
                    self.regions = [r for r in self.regions if r[1] < e.start]
                else:
                    self.subtrees.add(placed)
        if e.main and not self.hidden:
            self.regions.append((e.main, e.start, len(self.blocks)))

    def main_blocks(self) -> list[str]:
        """The blocks of all outermost articles in page order; of the main part, where they hold little of it or there are none; else of the longest part that may be one, or of the whole body."""
        def size(blocks: list[str]) -> int:
            return sum(map(len, blocks))

        articles, end = [], 0
        for _, a, b in sorted((r for r in self.regions if r[0] == 1), key=lambda r: (r[1], -r[2])):
            if a >= end:
                articles += self.blocks[a:b]
                end = b
        for rank in (2, 3):
            best = max((self.blocks[a:b] for r, a, b in self.regions if r == rank), key=size, default=[])
            if rank == 2 and articles and 4 * size(articles) >= size(best):
                return articles
            if best:
                return best
        return articles or self.blocks


def main_text(html: str | None, template: frozenset[bytes] = frozenset()) -> str:
    return "\n".join(Page(html, template, hashing=False).main_blocks()) if html else ""


def host_of(url: str) -> Column:
    """The host in lower case, without port and user; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(df: DataFrame, url: str = "url", html: str = "html", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host and template: the hashes of the subtrees that recur across the host's articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            articles, hashes = [], []
            for text in batch.column(1).to_pylist():
                page = Page(text or "")
                articles.append(hashlib.blake2b("\n".join(page.main_blocks()).encode("utf-8", "replace"), digest_size=16).digest())
                hashes.append(sorted(page.subtrees))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(articles, pa.binary()), pa.array(hashes, pa.list_(pa.binary()))], names=["host", "article", "subtrees"])

    found = df.select(host_of(url).alias("host"), F.col(html).alias("_html")).mapInArrow(trimmed(run), "host string, article binary, subtrees array<binary>")
    # Each article of a host counts once: of its copies, one stands for all.
    found = stored(found, "subtrees")
    totals = found.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles")).where(F.col("articles") >= FEW)
    seen = found.select("host", "article", F.explode("subtrees").alias("subtree")).distinct()
    counted = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW)
    few = F.greatest(F.lit(FEW), F.least(F.lit(least), F.ceil(F.col("articles") / 2)))
    place = F.substring("subtree", -1, 1)
    enough = F.when(place == F.lit(INNER), F.lit(least)).when(place == F.lit(NAMED), F.lit(FEW)).otherwise(few)
    wide = salted_join(counted, totals, ["host"], seed="subtree").where((F.col("n") >= enough) & (F.col("n") >= share * F.col("articles")))
    # At most the mean number of subtrees in an article divided by the share: bounded for each host.
    return stored(wide.groupBy("host").agg(F.collect_set("subtree").alias("template")), "templates")


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The columns of keep and the main text of every page."""
    known = templates(df, url, html, least, share)
    rows = df.select(*keep, host_of(url).alias("_host"), F.col(html).alias("_html"))
    side = known.withColumnRenamed("host", "_host")
    if (known.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_HASHES:
        joined = rows.join(F.broadcast(side), "_host", "left")
    else:
        joined = salted_join(rows, side, ["_host"], "left", seed=keep[0])
    names = [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, template in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                texts.append(main_text(page, frozenset(template or ())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=names)

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("text", T.StringType())])
    return joined.select(*keep, "_html", "template").mapInArrow(trimmed(run), schema)
