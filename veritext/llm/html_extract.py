"""Main text of web pages by two-pass block rules.

Markup is scanned once into blocks of text, each with its length, its share of
stop words, its share of linked characters and the containers it stands in.
First pass: a block in a menu, header, footer, sidebar, notice, advert, form or
comment container, or made of links, is decided bad; a long one rich in stop
words is decided good, in an article container a long one of any words; the
others (short or poor in stop words) stay open.  An article container that holds
a decided good block (any of them, on a page without decided good blocks) makes
its open blocks good.  What stands around an article counts too: in a sidebar or
the like (not in a form, which often holds the whole page) it is bad, in a
container that merely has a bad name it is bad unless it holds more decided good
text than all other parts of the page.  Inside an article a bad name (other than
of reader comments and adverts) or a share of links leaves a block open, both
make it bad; on headings names mean nothing.  Second pass: an open block takes
the label of the nearest decided block, good at a tie; on a page without decided
blocks all open ones are good.

Defined results: a null or empty html gives an empty text; markup cut off at the
end of the page is dropped, text cut off there is kept; unclosed and stray tags
are closed or skipped like browsers do; repeated rows each give a row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# common function words of the languages the pages are written in; a parameter
STOP_WORDS = frozenset((
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all "
    "were when we there can an your which their if will each about "
    "le la les de des du un une et est en que qui dans pour pas sur au avec par plus ce se son il elle ne nous vous "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an er so dass "
    "el los las que y del se por con para una su al lo como más pero sus este entre cuando muy sin sobre").split())

BLOCK = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol option p pre section select
summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select xmp noframes".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
BAD_TAGS = frozenset("nav header footer aside form button fieldset dialog menu head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu".split())
COMMENT = frozenset("comment comments commentlist disqus respond replies discussion".split())
SECTION = frozenset("replies discussion".split())  # of COMMENT, but a part of an article too
ADVERT = frozenset("ad ads advert advertisement advertising adverts sponsored".split())
BAD_NAMES = COMMENT | ADVERT | frozenset("""banner breadcrumb breadcrumbs colophon consent
cookie cookies copyright disclaimer footer gdpr hidden imprint legal login masthead menu modal nav navbar navigation newsletter notice notices
notification pager pagination popup promo promotion related recommended share sharing sidebar signup skip social
sponsor subscribe toolbar widget""".split())

# a comment, a tag, a tag with an unclosed quote (it ends at the next >), other markup
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")
OUT = "page_id long, url string, text string"


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False
    main: int = 0  # the innermost article container it stands in
    wrapped: int = 0  # of them, the outermost in a container of a bad name
    named: bool = False  # it has a bad name inside its article
    text: str = ""


@dataclass
class Rules:
    """Thresholds of the first pass."""

    linked: float = 0.5
    long: int = 140
    stop_share: float = 0.2
    stop_words: frozenset = STOP_WORDS


def judged(tag: str, attributes: str, inside_main: bool) -> str:
    """What a container is: '' (nothing), 'bad', 'form', 'named' (bad by its name only), 'comment' or 'main'."""
    names, whole, role, hidden = set(), set(), "", False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names.update(NAME.findall(value))
            whole.update(value.split())
        elif key == "role":
            role = value
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    if hidden or role in BAD_ROLES - {"form"}:
        return "bad"
    if tag in HEADING:
        return ""
    if tag in ("body", "html"):
        return ""
    if whole & COMMENT - SECTION if tag in MAIN else names & (COMMENT - SECTION if inside_main else COMMENT):
        return "comment"
    if tag in MAIN or role in ("main", "article"):
        return "main"
    if tag == "form" or role == "form":
        return "form"
    # an article's own heading is part of it
    if tag == "noscript":
        return "named"
    if tag in BAD_TAGS and not (inside_main and tag == "header") or inside_main and whole & ADVERT:
        return "bad"
    return "named" if names & BAD_NAMES else ""


class Inside(NamedTuple):
    """What the open containers make of the text in them."""

    bad: bool = False  # in a bad container or reader comments
    main: int = 0  # innermost article container, by its place in the page
    form: bool = False  # in a form inside it
    named: bool = False  # in a container of a bad name inside it
    name: bool = False  # in a container of a bad name anywhere
    wrapped: int = 0  # outermost article container in one

    def enter(self, kind: str, at: int) -> Inside:
        if kind in ("bad", "comment"):
            return self._replace(bad=True)
        if kind == "form":
            return self._replace(form=True)
        if kind == "named":
            return self._replace(named=True, name=True)
        if kind == "main":
            return self._replace(main=at, form=False, named=False, wrapped=self.wrapped or (at if self.name else 0))
        return self


class OpenTags:
    """The stack of open tags, with the places of each name in it, so that
    deep nesting costs no search."""

    def __init__(self):
        self.stack: list[tuple[str, Inside]] = []
        self.places: dict[str, list[int]] = {}

    def inside(self) -> Inside:
        return self.stack[-1][1] if self.stack else Inside()

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, tag: str, kind: str, at: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.inside().enter(kind, at)))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.places[self.stack.pop()[0]].pop()


def blocks(page: str) -> tuple[list[Block], dict[int, int]]:
    """The page's blocks in order, and for each article container the one
    around it (0: none)."""
    out, block, around = [], Block(), {}
    tags = OpenTags()
    at, links = 0, 0

    def close() -> None:
        nonlocal block
        text = SPACE.sub(" ", html.unescape("".join(block.pieces))).strip()
        if text:
            block.text = text
            block.pieces = []
            out.append(block)
        here = tags.inside()
        block = Block(bad=here.bad or here.form or (not here.main and here.named), main=here.main,
                      wrapped=here.wrapped, named=bool(here.main) and here.named)

    def add(text: str) -> None:
        block.pieces.append(text)
        if links:
            block.linked += len(SPACE.sub("", text))

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            # an unfinished tag at the end of the page is dropped
            cut = re.search(r"<[/a-zA-Z!?]", rest)
            add(rest[:cut.start()] if cut else rest)
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        attributes = m[3] or m[6] or ""
        if not tag:
            continue
        if m[1] or m[4]:  # end tag
            if tag == "a" and links:
                links -= 1
            if tags.last(tag) >= 0:
                if tag in BLOCK:
                    close()
                tags.cut(tags.last(tag))
                if tag in BLOCK:
                    close()
            elif tag == "p":
                close()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            close()
            links = 0
            ends = {"li": "li", "td": "td", "th": "td", "tr": "tr", "dt": "dd", "dd": "dt", "option": "option"}.get(tag)
            for name in ("p", *([ends, tag] if ends else [])):
                k = tags.last(name)
                if k >= 0 and (name == "p" or max(map(tags.last, ("ul", "ol", "table", "dl"))) < k):
                    tags.cut(k)
        if tag == "a":
            links += 1
        if tag not in VOID:
            main = tags.inside().main
            kind = judged(tag, attributes, bool(main)) if tag in BLOCK or attributes else ""
            kind = kind if tag in BLOCK or kind not in ("", "main") else ""
            if kind == "main":
                around[at] = main
            tags.push(tag, kind, at)
        if tag in BLOCK:
            close()
    close()
    return out, around


def first_pass(found: list[Block], around: dict[int, int], rules: Rules) -> list[bool | None]:
    """Good, bad or open (None) for every block."""
    out: list[bool | None] = []
    linked = [b.linked > rules.linked * len(b.text.replace(" ", "")) for b in found]
    for b, link in zip(found, linked, strict=True):
        if b.bad:
            out.append(False)
        elif link:
            out.append(None if b.main and not b.named else False)
        elif len(b.text) < rules.long:
            out.append(None)
        else:
            words = [w.lower() for w in WORD.findall(b.text)]
            share = sum(w in rules.stop_words for w in words) / max(1, len(words))
            out.append(True if b.main and not b.named or share >= rules.stop_share else None)
    # good text of the articles in containers of a bad name, and (0) of the others
    weight = dict.fromkeys((0, *(b.wrapped for b in found)), 0)
    for b, x in zip(found, out, strict=True):
        weight[b.wrapped] += len(b.text) if x else 0
    if True in out or any(x is None and b.main and not b.wrapped for b, x in zip(found, out, strict=True)):
        out = [False if b.wrapped and weight[b.wrapped] <= weight[0] else x for b, x in zip(found, out, strict=True)]
    # without any good block a page's articles are what it has
    holding: set[int] = set()
    for b, x in zip(found, out, strict=True):
        main = b.main if x or True not in out else 0
        while main and main not in holding:
            holding.add(main)
            main = around[main]
    for i, b in enumerate(found):
        if out[i] is None and b.main and not b.named:
            out[i] = True if b.main in holding else False if linked[i] else None
    return out


def second_pass(labels: list[bool | None]) -> list[bool]:
    decided = [i for i, x in enumerate(labels) if x is not None]
    if not decided:
        return [True] * len(labels)
    out, k = [], 0
    for i, x in enumerate(labels):
        if x is None:
            while k + 1 < len(decided) and decided[k + 1] < i:
                k += 1
            near = [decided[k], *decided[k + 1:k + 2]]
            least = min(abs(j - i) for j in near)
            x = any(labels[j] for j in near if abs(j - i) == least)
        out.append(x)
    return out


def main_text(page: str | None, rules: Rules | None = None) -> str:
    found, around = blocks(page or "")
    keep = second_pass(first_pass(found, around, rules or Rules()))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            rules: Rules | None = None) -> DataFrame:
    """``page_id, url, text`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(h, rules) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), text], ["page_id", "url", "text"])

    return pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"cast(`{url_col}` as string) as url",
                            f"cast(`{html_col}` as string) as html").mapInArrow(run, OUT)
