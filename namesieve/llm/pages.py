"""Main text of web pages by two passes over their blocks.

A scan of the markup cuts a page into blocks, the text between two block-level tags, and notes for
each its words, stop words, linked characters and place: inside an article, the main part, a content
box or none of them, and whether an element around it is never content (menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts).

The text is looked for in the innermost place that the page has.  The first pass decides blocks by
link density, length and stop-word density; blocks too short or too poor in stop words for a
decision are ambiguous.  The second pass gives each of them the label of its nearest decided
neighbours.  Inside an article, main part or content box nothing is dropped without a reason:
an ambiguous block is content there unless both decided neighbours are boilerplate.

Defined results: null, empty and blank pages have no blocks and an empty text; markup that is never
closed reaches to the end of its parent; references that are no characters stay as they are;
repeated rows get equal results; an empty table gives no rows; pages of any length are scanned whole
in one pass, their blocks are one row; the results have the named columns only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import slices

SLICE_BYTES = 4 << 20

# Frequent function words of languages with spaces.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    one you were all her she there would their we him been has when who will no if out so what up into than them can
    le la les de des du un une et est en que qui dans pour pas sur au aux par plus ce il elle ne se avec sont son mais
    der die das und den von zu mit sich dem ein eine nicht ist im auf des auch es an als für werden aus oder nach bei
    el los las y del que en un una por con no para al lo su es como más o pero sus este ha si porque
    il di che e per non una sono della os do da em um uma não het een van op te dat zijn voor
    """.split()
)

# Elements by their part in a page.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre
    search section summary table tbody td template tfoot th thead tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TABLE_PARTS = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"))
SCOPES = frozenset(("td", "th", "caption", "table", "template", "object"))
NEVER = frozenset(
    """
    aside audio button canvas datalist dialog fieldset footer form label legend menu nav noscript object optgroup
    option search select svg template video
    """.split()
)
# An item ends the item before it, up to the list that holds both.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}

# Words of class and id names.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
NEVER_NAMES = COMMENT_NAMES | frozenset(
    """
    ad ads adsense adv advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs consent
    cookie cookies copyright disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice overlay
    pager pagination popup promo promoted promotion recommended related search share sharing sidebar signup skip
    social sponsor sponsored subscribe toolbar widget
    """.split()
)
HEADER_NAMES = frozenset("header masthead topbar".split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
NEVER_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
NEGATED = ("has", "no", "not", "with", "without")

TOKEN = re.compile(
    r"""(?isx)
    <!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>
    |<(?:[!?/][^>]*|/?[a-z][^>]*)(?:>|\Z)
    """
)
ATTRIBUTE = re.compile(
    r"""(?ix)(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-])"""
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

PAGE, BOX, MAIN, ARTICLE = range(4)
PLACES = ("page", "box", "main", "article")


class Open(NamedTuple):
    """An open element and what holds inside it."""

    tag: str
    is_block: bool
    never: bool
    block_never: bool
    place: int
    link: bool
    heading: bool


@dataclass
class Block:
    text: str
    place: int
    never: bool
    heading: bool
    linked: int
    n_words: int = 0
    n_stop: int = 0
    label: str | None = None

    @property
    def n_chars(self) -> int:
        return len(self.text) - self.text.count(" ")


@dataclass(frozen=True)
class BlockRules:
    """Decisions of the first pass.

    A block with a larger share of linked characters than ``max_linked`` is boilerplate.  One of
    ``min_chars`` characters is content if ``min_stop`` of its words are stop words; outside of any
    content place it is boilerplate if fewer than ``low_stop`` are.
    """

    max_linked: float = 0.5
    min_chars: int = 60
    min_stop: float = 0.2
    low_stop: float = 0.1
    stop_words: frozenset[str] = STOP_WORDS


@lru_cache(maxsize=4096)
def own_place(tag: str, attrs: str) -> tuple[bool, bool, bool, int]:
    """Of an element itself: never content, a header, holds comments, its place."""
    never = tag in NEVER
    header = tag == "header"
    comments = False
    place = {"article": ARTICLE, "main": MAIN}.get(tag, PAGE)
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for each in value.split():
                parts = [p.lower() for p in NAME_PARTS.findall(each)]
                parts += [p for p in re.split(r"[^a-z]+", each.lower()) if p]
                if not parts or parts[0] in NEGATED:
                    continue
                comments |= not COMMENT_NAMES.isdisjoint(parts)
                never |= not NEVER_NAMES.isdisjoint(parts)
                header |= not HEADER_NAMES.isdisjoint(parts)
                if not CONTENT_NAMES.isdisjoint(parts):
                    place = max(place, BOX)
        elif name == "role":
            never |= value.lower() in NEVER_ROLES
            place = max(place, {"main": MAIN, "article": ARTICLE}.get(value.lower(), PAGE))
        elif name == "itemprop":
            place = max(place, ARTICLE if value == "articleBody" else PAGE)
        elif name == "style":
            never |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name == "hidden" or value.lower() == "true":
            never = True
    if tag in ("html", "body", "main"):
        never = header = comments = False
    return never, header, comments, place


class Scan:
    """Cuts one page into blocks; every tag and character is looked at once."""

    def __init__(self) -> None:
        self.stack: list[Open] = []
        self.counts: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.state: tuple[int, bool, bool] | None = None

    def page(self, source: str) -> list[Block]:
        at = 0
        for token in TOKEN.finditer(source):
            if token.start() > at:
                self.text(source[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"]:
                self.close(tag)
            else:
                self.open(tag, token["attrs"])
        self.text(source[at:])
        self.flush()
        return self.blocks

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top.never and not top.block_never:
            return  # inside a line that goes on behind it
        if "&" in raw:
            raw = html.unescape(raw)
        if self.state is None:
            if not raw or raw.isspace():
                return
            self.state = (top.place, top.block_never, top.heading) if top else (PAGE, False, False)
        self.parts.append(raw)
        if top and top.link:
            self.linked += sum(map(len, raw.split()))

    def flush(self) -> None:
        if self.state is not None:
            place, never, heading = self.state
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, place, never, heading, self.linked))
        self.parts, self.linked, self.state = [], 0, None

    def cut(self, size: int) -> None:
        """Closes all elements from position ``size`` of the stack on."""
        for each in self.stack[size:]:
            self.counts[each.tag] -= 1
        del self.stack[size:]

    def line(self) -> int:
        """Position of the innermost open block-level element, or -1."""
        i = len(self.stack) - 1
        while i >= 0 and not self.stack[i].is_block:
            i -= 1
        return i

    def open(self, tag: str, attrs: str) -> None:
        is_block = tag in BLOCKS
        if is_block:
            self.flush()
            i = self.line()
            if i >= 0 and (self.stack[i].tag == "p" or (tag in HEADINGS and self.stack[i].tag in HEADINGS)):
                self.cut(i)
            if tag in SIBLINGS:
                self.end_sibling(*SIBLINGS[tag])
        elif tag == "br":
            if self.state is not None:
                self.parts.append("\n")
            return
        if tag in VOID or (not is_block and re.search(r"(?:^|[\s\"'])/$", attrs)):
            return
        parent = self.stack[-1] if self.stack else Open("", True, False, False, PAGE, False, False)
        never, header, comments, place = own_place(tag, attrs if ATTRIBUTE.search(attrs) else "")
        if tag == "article":
            # An article inside an article is a comment on it.
            never = comments or parent.place == ARTICLE
        elif tag == "main" and parent.never:
            # The main part never lies in menus and the like: one of them was not closed.
            parent = Open("", True, False, False, PAGE, False, False)
        never = never or parent.never or (header and parent.place < MAIN)
        self.stack.append(
            Open(
                tag, is_block, never, never if is_block else parent.block_never, max(parent.place, place),
                parent.link or (tag == "a" and "href" in attrs.lower()), parent.heading or tag in HEADINGS,
            )
        )
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def end_sibling(self, items: tuple[str, ...], holders: tuple[str, ...]) -> None:
        if not any(self.counts.get(t) for t in items):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in items:
                return self.cut(i)
            if self.stack[i].tag in holders:
                return

    def close(self, tag: str) -> None:
        is_block = tag in BLOCKS
        if is_block:
            self.flush()
        if not self.counts.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            each = self.stack[i]
            if each.tag == tag:
                return self.cut(i)
            if each.is_block and not is_block:
                return
            if each.tag in SCOPES and tag not in TABLE_PARTS:
                return


def searched_place(blocks: list[Block]) -> int:
    """The innermost place with text; articles that hold the smaller part of the main part are teasers."""
    chars, decided = [0] * len(PLACES), [False] * len(PLACES)
    for b in blocks:
        if not b.never:
            chars[b.place] += b.n_chars
            decided[b.place] |= b.label == "content"
    if chars[ARTICLE] and (decided[ARTICLE] or not decided[MAIN] or chars[ARTICLE] >= chars[MAIN]):
        return ARTICLE
    return next((p for p in (MAIN, ARTICLE, BOX) if chars[p]), PAGE)


def first_pass(block: Block, rules: BlockRules) -> str | None:
    """The label of a block by itself, or None if it is ambiguous."""
    words = LETTERS.findall(block.text.lower())
    block.n_words, block.n_stop = len(words), sum(w in rules.stop_words for w in words)
    chars = block.n_chars
    if block.linked > rules.max_linked * chars:
        return None if block.heading else "boilerplate"
    if chars < rules.min_chars or block.heading:
        return None
    if block.n_stop and block.n_stop >= rules.min_stop * block.n_words:
        return "content"
    if block.place == PAGE and block.n_stop < rules.low_stop * block.n_words:
        return "boilerplate"
    return None


def label_blocks(blocks: list[Block], rules: BlockRules = BlockRules()) -> list[Block]:
    """Both passes; every block gets the label ``content`` or ``boilerplate``."""
    for b in blocks:
        b.label = "boilerplate" if b.never else first_pass(b, rules)
    place = searched_place(blocks)
    if place == PAGE:
        row = blocks
    else:
        row = [b for b in blocks if b.place >= place and not b.never]
        for b in blocks:
            if b.place < place:
                b.label = "boilerplate"
    before, last = [], None
    for i, b in enumerate(row):
        before.append(last)
        last = (i, b.label) if b.label else last
    after = None
    for i in range(len(row) - 1, -1, -1):
        b, left = row[i], before[i]
        if b.label:
            after = (i, b.label)
            continue
        sides = [side[1] if side else None for side in (left, after)]
        if place != PAGE:
            b.label = "boilerplate" if sides == ["boilerplate", "boilerplate"] else "content"
        elif left and after and sides[0] != sides[1]:
            nearer = left if i - left[0] < after[0] - i else after
            b.label = "content" if i - left[0] == after[0] - i else nearer[1]
        else:
            # Nothing on the whole page speaks against a block without any decided neighbour.
            b.label = "content" if "content" in sides or not (left or after) else "boilerplate"
    return blocks


BLOCK = (
    "array<struct<text: string, place: string, linked: double, n_words: long, n_stop: long, content: boolean>>"
)
ARROW_BLOCK = pa.list_(
    pa.struct(
        [("text", pa.string()), ("place", pa.string()), ("linked", pa.float64()), ("n_words", pa.int64()),
         ("n_stop", pa.int64()), ("content", pa.bool_())]
    )
)


def _row(block: Block) -> tuple:
    linked = block.linked / max(block.n_chars, 1)
    place = "never" if block.never else PLACES[block.place]
    return block.text, place, linked, block.n_words, block.n_stop, block.label == "content"


_FIELDS = [f.name for f in ARROW_BLOCK.value_type]


def _judged(pages: DataFrame, keys: Sequence[str], source: str, rules: BlockRules) -> DataFrame:
    """``key``, a struct of ``keys``, and the ``blocks`` of each page; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source", SLICE_BYTES):
                found = []
                for text in part.column("source").to_pylist():
                    labelled = label_blocks(Scan().page(text or ""), rules)
                    found.append([dict(zip(_FIELDS, _row(b))) for b in labelled])
                arrays = [part.column("key"), pa.array(found, ARROW_BLOCK)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "blocks"])

    rows = pages.select(F.struct(*keys).alias("key"), F.col(source).alias("source"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, blocks {BLOCK}")


def page_blocks(
    pages: DataFrame, keys: Sequence[str] = ("page_id", "url"), source: str = "html", rules: BlockRules = BlockRules()
) -> DataFrame:
    """``keys`` and all ``blocks`` of each page in order, with their figures and labels."""
    return _judged(pages, keys, source, rules).select(*[F.col("key")[k].alias(k) for k in keys], "blocks")


def main_text(
    pages: DataFrame, keys: Sequence[str] = ("page_id", "url"), source: str = "html", rules: BlockRules = BlockRules()
) -> DataFrame:
    """``keys, text, n_chars``: the content blocks of each page, joined by line breaks."""
    kept = F.transform(F.filter("blocks", lambda b: b["content"]), lambda b: b["text"])
    rows = _judged(pages, keys, source, rules).select("key", F.array_join(kept, "\n").alias("joined"))
    return rows.select(
        *[F.col("key")[k].alias(k) for k in keys],
        F.col("joined").alias("text"), F.length("joined").cast("long").alias("n_chars"),
    )
