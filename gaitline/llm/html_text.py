"""Main text of web pages by line-block distribution (operator 9).

A page becomes lines: one for each block of text, markup stripped, with blank lines where
containers begin and end. A line weighs what it has of text, up to a bound; a heading, and
a line of a marked article, weigh more; lines of menus, notices, forms and the like, and
lines that are mostly links, weigh nothing. The weights in a window that slides over the
lines surge where the article begins and dive to nothing where it ends: the text between
is kept where the surge is high enough beside the highest of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, text_slices

# Element names by their part in a page, and words of class, id or role that mark what isn't the article.
RAW = frozenset("script style noscript template textarea title iframe svg math select object audio video canvas datalist".split())
APART = frozenset("nav footer aside menu dialog button head".split())
PERHAPS = frozenset("form header".split())
OUTER = frozenset("html body form".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LOOSE = frozenset("p li dt dd td th tr option".split())
BOX = frozenset("address article body center details div fieldset footer form header hgroup html main nav section aside menu dialog head".split())
LIST = frozenset("blockquote dl figure ol table tbody tfoot thead ul".split())
BLOCK = BOX | LIST | LOOSE | HEADING | frozenset("caption figcaption hr legend pre summary button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond replies related recommended recommendations widget toolbar pagination pager search skip copyright complementary contentinfo".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_HINT = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}

FULL = 300  # a line's text counts up to so many characters
SHORT = 300  # a block that its names mark as noise, and under so many characters, is noise
LEAD = 100  # what a heading weighs more
MARKED = 800  # what a line of a marked article weighs more: so much that it is a surge beside any other
WIDTH = 2


@dataclass(eq=False)
class Block:
    """An open or closed element: what it holds, and why it may not belong to the article."""

    name: str
    parent: Block | None  # the next block outwards that may be noise
    sure: bool = False  # by its element
    noisy: bool = False  # by words of class, id or role
    first: int = 0  # the number of lines before it
    lines: int = 0
    chars: int = 0
    linked: int = 0
    closed: bool = False
    out: bool = False


@dataclass
class Line:
    text: str
    linked: int
    tag: str
    marked: bool
    block: Block | None
    gap: list[Block] = field(default_factory=list)  # the containers that begin or end before it


def _noisy(attributes: str, inside: bool) -> bool:
    """Whether a name of class, id or role marks what isn't the article; has-, no- and with- tell of a wrapper, header words within an article of its title."""
    names = (n for m in _HINT.finditer(attributes) for n in "".join(m.groups(default="")).lower().split())
    words = {w for n in names if not n.startswith(("has-", "no-", "with-", "has_", "no_", "with_")) for w in _WORDS.findall(n)} & NOISE
    return bool(words - {"header", "masthead"} if inside else words)


def page_lines(page: str) -> list[Line]:
    """The lines of a page in order, with the blocks they lie in."""
    lines: list[Line] = []
    text: list[str] = []
    gap: list[Block] = []
    stack: list[tuple[str, Block | None, bool]] = []  # name, what may be noise from here on, whether it is a block of its own
    count: dict[str, list[int]] = {}  # places of the open elements of a name
    made: list[int] = []  # places of blocks of their own
    endless: set[str] = set()  # raw elements of which no end is left
    loose: list[int] = []  # places of open p, li and the like
    boxes: list[int] = []  # places of open containers
    linked = links = article = contained = 0
    tag = ""
    at, size = 0, len(page)

    def inner() -> Block | None:
        return stack[-1][1] if stack else None

    def flush() -> None:
        nonlocal text, linked, gap
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                block = inner()
                lines.append(Line(line, linked, tag, article > 0, block, gap))
                gap = []
                for k in boxes[-1:]:
                    holders[k].lines += 1
                if block is not None:
                    block.chars += len(line)
                    block.linked += min(linked, len(line))
            text, linked = [], 0

    holders: dict[int, Block] = {}  # the container at each place of the stack

    def pop(k: int, name: str = "") -> None:
        """Closes all from place ``k`` on; only the one called ``name`` was closed by itself."""
        nonlocal article, links, contained
        while len(stack) > k:
            own, block, new = stack.pop()
            count[own].pop()
            if own in ("article", "main"):
                article -= 1
            elif own == "a":
                links -= 1
            if loose and loose[-1] == len(stack):
                loose.pop()
            if boxes and boxes[-1] == len(stack):
                boxes.pop()
                contained -= own not in OUTER
                held = holders.pop(len(stack))
                gap.append(held)
                if boxes and held.lines:
                    holders[boxes[-1]].lines += held.lines
            if new:
                made.pop()
                block.closed = own == name and len(stack) == k
                if block.parent is not None:
                    block.parent.chars += block.chars
                    block.parent.linked += block.linked

    while at < size:
        m = _TOKEN.match(page, at)
        if m is None:  # an open quote runs to the end of the page
            cut = page.find(">", at)
            at = cut + 1 if cut >= 0 else size
            continue
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group(4):
                text.append(m.group(4))
                if links > 0:
                    linked += len(m.group(4).strip())
            continue
        name, closing = name.lower(), bool(m.group(1))
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if closing:
            if count.get(name):
                k = count[name][-1]
                if made and made[-1] >= k:
                    flush()
                if name in BLOCK or not boxes or k > boxes[-1]:  # an inline element never closes a container
                    pop(k, name)
            tag = "" if name in LOOSE or name in HEADING else tag
            continue
        if name in RAW:
            end = None if name in endless else _ENDS[name].search(page, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else size if name in ("script", "style") else at
            continue
        if name in VOID:
            continue
        if name in BLOCK and count.get("head"):  # nothing of a head makes a block
            pop(count["head"][0])
        if name in BLOCK:
            while loose and loose[-1] > (boxes[-1] if boxes else -1) and (name not in LOOSE or stack[loose[-1]][0] == name or stack[loose[-1]][0] in ("p", "li")):
                pop(loose[-1])  # a paragraph or list item ends where the next block begins
                if name in LOOSE and name != "p":
                    break
            tag = name if name in LOOSE or name in HEADING else ""
        if m.group(3).endswith("/"):
            continue
        sure = name in APART or name == "form" or name == "header" and not contained
        noisy = not sure and name not in ("html", "body", "header") and not (name == "p" and article > 0) and _noisy(m.group(3), article > 0)
        if noisy:
            flush()
        block = Block(name, inner(), sure, noisy, len(lines)) if sure or noisy else inner()
        place = len(stack)
        stack.append((name, block, sure or noisy))
        count.setdefault(name, []).append(place)
        if sure or noisy:
            made.append(place)
        if name in LOOSE:
            loose.append(place)
        elif name in BOX or name in LIST:
            boxes.append(place)
            contained += name not in OUTER
            holders[place] = Block(name, block)
            gap.append(holders[place])
        if name in ("article", "main"):
            article += 1
        elif name == "a":
            links += 1
    flush()
    pop(0)
    return lines


def _blanks(gap: list[Block]) -> int:
    """Blank lines for the containers that begin or end here: half a one for a list or a container of one line."""
    halves = sum(1 if b.name in LIST or b.lines == 1 else 2 for b in gap if b.lines or b.name in LIST)
    return (halves + 1) // 2


class _Chains:
    """Whether anything around a place, from its block outwards, has a property; each block is asked once, however deep it lies."""

    def __init__(self, has: Callable[[Block], bool]):
        self.has, self.known = has, {}

    def __call__(self, block: Block | None) -> bool:
        chain = []
        while block is not None and block not in self.known:
            chain.append(block)
            block = block.parent
        found = block is not None and self.known[block]
        for b in reversed(chain):
            found = self.known[b] = found or self.has(b)
        return found


def _judge(lines: list[Line]) -> list[bool]:
    """Whether each line lies in a block that isn't of the article.

    Elements for menus, footers and the like count at once, unless they were never closed and hold most of
    the text; forms and headers unless they hold most. The words of class, id and role are weak evidence: such a block
    goes if it is short, or mostly links, or begins behind the densest place of the page; never if it wraps the page:
    if it holds all the text, or is long and holds most of it with little before it. Of one that is never closed only the first line goes, as what follows may be the article again. A header
    counts where it stands in the body itself; within other containers it may be the title's, so the surge decides.
    """
    total = sum(len(x.text) for x in lines)
    asked: set[Block] = set()
    for x in lines:
        b = x.block
        while b is not None and b not in asked:
            asked.add(b)
            most = 2 * b.chars > total and b.chars >= SHORT and 2 * b.linked < b.chars
            b.out = b.sure and not (most and (b.name in PERHAPS or not b.closed))
            if b.out:
                break
            b = b.parent
    gone = _Chains(lambda b: b.out)
    before = [0, *accumulate(0 if gone(x.block) else len(x.text) for x in lines)]
    left = before[-1]

    def wrapper(b: Block) -> bool:
        return b.chars == left or 2 * b.chars > left and b.chars >= SHORT > before[b.first]

    doubtful = _Chains(lambda b: b.out or (b.noisy and not wrapper(b)))
    plain = [0 if doubtful(x.block) else min(FULL, max(0, len(x.text) - x.linked)) for x in lines]
    dense = max(range(len(lines)), key=lambda k: sum(plain[k : k + WIDTH]), default=0)
    asked = set()
    for x in lines:
        b = x.block
        while b is not None and b not in asked:
            asked.add(b)
            if b.noisy and not wrapper(b):
                b.out = b.chars < SHORT or 2 * b.linked >= b.chars or b.first > dense
            b = b.parent
    lost = _Chains(lambda b: b.out and (b.sure or b.closed))

    def opens(k: int, b: Block | None) -> bool:
        """Whether line k is the first of a block that isn't of the article; blocks that begin with the line are its innermost."""
        while b is not None and b.first == k:
            if b.out:
                return True
            b = b.parent
        return False

    return [lost(x.block) or opens(k, x.block) for k, x in enumerate(lines)]


def weighed(lines: list[Line]) -> tuple[list[str], list[int]]:
    """The distribution: texts ("" for a blank line and for links that are never kept) and their weights.

    What lies in blocks that are not of the article leaves no trace, so that a notice within the text does not cut it.
    """
    texts: list[str] = []
    weights: list[int] = []
    gap: list[Block] = []
    out_of_article = _judge(lines)
    hidden, noisy = _Chains(lambda b: b.out), _Chains(lambda b: b.noisy)
    for x, out in zip(lines, out_of_article, strict=True):
        gap += [b for b in x.gap if not hidden(b.parent)]
        if out:
            continue
        blanks, gap = _blanks(gap), []
        mostly_links = 2 * x.linked > len(x.text)
        never = mostly_links and x.tag != "p" and x.tag not in HEADING
        texts += [""] * (blanks + never)
        weights += [0] * (blanks + never)
        if never:
            continue
        faint = noisy(x.block) and not x.marked
        own = 0 if mostly_links else min(FULL, len(x.text)) // (4 if faint else 1) + (LEAD if x.tag in HEADING else 0) + (MARKED if x.marked else 0)
        texts.append(x.text)
        weights.append(own)
    return texts, weights


def surges(weights: list[int], width: int = WIDTH, share: float = 1 / 3) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to its dive: where the sums over ``width`` lines stay above nothing, and reach ``share`` of the greatest sum.

    A lower range between two of these belongs to the text as well.
    """
    n = len(weights)
    sums = [sum(weights[k : k + width]) for k in range(n)]
    bar = share * max(sums, default=0)
    ranges, k = [], 0
    while k < n:
        if not sums[k]:
            k += 1
            continue
        begin = k
        while k < n and sums[k]:
            k += 1
        ranges.append((begin, min(n, k + width - 1), max(sums[begin:k]) >= bar))
    high = [k for k, r in enumerate(ranges) if r[2]]
    return [r[:2] for r in ranges[high[0] : high[-1] + 1]] if high else []


def extract(page: str | None) -> str:
    """The article of a page: its blocks, joined by an empty line; "" for a page without text."""
    texts, weights = weighed(page_lines(page or ""))
    kept = [texts[k] for a, b in surges(weights) for k in range(a, b) if texts[k]]
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` (never null) and ``n_chars``, one row per page.

    A missing or empty page gives "" and 0; a page is read whole, however long. Broken
    markup is read as far as it goes. Repeated rows give equal rows, an empty table an
    empty one; other columns are not read, whatever their names. No shuffle.
    """
    rows = pages.select(*map(column, (*keep, html_col)))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, len(keep), 1 << 21):
            texts = [extract(h) for h in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return rows.mapInArrow(run, schema)
