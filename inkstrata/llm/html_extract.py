"""Main text of pages by two passes of block rules.

First pass: each block is good, bad, short or near-good by the density of stop words, its length, its link density and
the elements it stands in. Second pass: short and near-good blocks take the label of their nearest decided neighbours;
what stands in an article or main element leans to good, and elements that never hold an article are bad outright.

Names that mark what stands around an article also occur on wrappers of whole pages (`has-sidebar`, a form around
everything). So they count as whole words of a class without such a modifier, and an element that bears one is a wrapper
after all where it holds the page's article, or where hardly any text is left beside it.

Pages are read in one pass from left to right, in time linear in their length, however broken the markup is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can do for from had has have he her his i if in into is it its more no not of on one or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your"
    " aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat haben ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wer wie wir zu zum zur"
    " au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur tout un une vous y"
    " al como con de del desde donde el ella en entre era es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también te tiene un una uno y ya".split()
)
#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template iframe svg object embed canvas math head title textarea select button option datalist audio video".split())
#: Elements that are never part of an article, and those that are none but may be wrapped around one.
AROUND = frozenset("nav header footer aside menu dialog".split())
WRAPPERS = frozenset("form fieldset".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what stands around an article; those that never wrap a page; words that unmark.
AROUND_NAMES = frozenset("banner breadcrumb breadcrumbs masthead menu modal nav navbar navigation notice pagination popup search share sharing sidebar social toolbar widget alert".split())
NEVER_WRAPPERS = frozenset("ad ads comment comments cookie cookies consent disqus footer gdpr newsletter related replies reply respond subscribe contentinfo complementary".split())
NEVER_STARTS = ("advert", "promo", "sponsor")
UNMARK = frozenset("has no with without not is enabled disabled hide hidden show on off open closed layout".split())
#: The beginning of a tag, its next attribute (quotes count after an equals sign only), and words of a name.
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
_ENDED = re.compile(r"[.!?\u2026:;\"'\u201d\u00bb)]$")


@dataclass
class Block:
    text: str
    linked: int
    node: int
    heading: bool
    around: bool = False
    inside: bool = False
    label: str = ""


@dataclass
class Tree:
    """Elements that matter to the blocks below them, by number; 0 is the page."""

    parent: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    hard: list[bool] = field(default_factory=lambda: [False])  # never part of an article
    soft: list[bool] = field(default_factory=lambda: [False])  # neither, unless it wraps one
    strict: list[bool] = field(default_factory=lambda: [False])  # soft, and no wrapper

    def add(self, parent: int, name: str, hard: bool, soft: bool, strict: bool) -> int:
        for column, value in ((self.parent, parent), (self.name, name), (self.hard, hard), (self.soft, soft), (self.strict, strict)):
            column.append(value)
        return len(self.name) - 1


def marked(names: str) -> tuple[bool, bool]:
    """Whether the words of class, id and role mark what stands around an article, and whether that never wraps a page."""
    found = never = False
    for name in names.split():
        parts = [x.lower() for x in _PART.findall(name)]
        if UNMARK.isdisjoint(parts):
            strict = not NEVER_WRAPPERS.isdisjoint(parts) or any(x.startswith(NEVER_STARTS) for x in parts)
            found, never = found or strict or not AROUND_NAMES.isdisjoint(parts), never or strict
    return found, never


def tag_end(page: str, at: int) -> tuple[int, str]:
    """Where the tag whose name ends at `at` ends, and what stands between."""
    end = page.find(">", at)
    if end < 0:
        return len(page), page[at:]
    inside = page[at:end]
    if "'" not in inside and not inside.count('"') % 2:
        return end + 1, inside
    here = at
    while (m := _ATTRIBUTE.match(page, here)) is not None:
        here = m.end()
    end = page.find(">", here)
    return (len(page), page[at:]) if end < 0 else (end + 1, page[at:end])


def attributes(inside: str) -> tuple[str, bool]:
    """The words of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for key, a, b, c in _ATTRIBUTE.findall(inside):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            names.append(value)
        hidden = hidden or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and bool(_NONE.search(value)))
    return " ".join(names), hidden


class Ends:
    """The next end tag of an element, by one search of the page for each name."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def after(self, name: str, at: int) -> int:
        """Where the element's next end tag ends, or -1."""
        if name not in self.found:
            ends = [(m.start(), m.end()) for m in re.finditer(rf"</{re.escape(name)}(?![a-zA-Z0-9_-])", self.page, re.I)]
            self.found[name] = ([a for a, _ in ends], [b for _, b in ends])
        starts, ends = self.found[name]
        k = bisect_left(starts, at)
        return tag_end(self.page, ends[k])[0] if k < len(starts) else -1


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, with what they stand in."""
    out: list[Block] = []
    tree, ends = Tree(), Ends(page)
    stack: list[tuple[str, int]] = []  # element, its node
    open_: Counter = Counter()
    parts: list[str] = []
    linked = in_link = node = 0
    line_break = heading = False

    def close() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), node, heading))
        parts.clear()
        linked, heading = 0, False

    def say(text: str) -> None:
        nonlocal linked, line_break
        if text:
            parts.append(text)
            if in_link:
                linked += len(" ".join(html.unescape(text).split()))
            if not text.isspace():
                line_break = False

    def pop() -> None:
        nonlocal node
        open_[stack.pop()[0]] -= 1
        node = stack[-1][1] if stack else 0

    at, end = 0, len(page)
    while at < end:
        less = page.find("<", at)
        if less < 0:
            say(page[at:])
            break
        say(page[at:less])
        if page.startswith("<!--", less):
            at = page.find("-->", less + 4)
            at = end if at < 0 else at + 3
            continue
        m = _TAG.match(page, less)
        if m is None:
            if page[less + 1 : less + 2] in ("!", "?"):
                at = page.find(">", less)
                at = end if at < 0 else at + 1
            else:  # a sign in the text
                say("<")
                at = less + 1
            continue
        name = m[1].lower()
        at, inside = tag_end(page, m.end())
        if page[less + 1] == "/":
            if name == "a":
                in_link = 0
            if name in BLOCKS:
                close()
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in SILENT:
            if name == "head":
                continue
            if name not in VOID and not inside.endswith("/"):
                ended = ends.after(name, at)
                at = ended if ended >= 0 else end if name in _RAW else at
            parts.append(" ")
            continue
        if name == "br":
            if line_break:
                close()
            parts.append(" ")
            line_break = True
            continue
        if name == "a":
            in_link = 1
        if name in BLOCKS:
            close()
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                pop()  # these end where the next one begins
        if name in VOID:
            continue
        names, hidden = attributes(inside) if "=" in inside or "hidden" in inside.lower() else ("", False)
        soft, strict = marked(names) if names and name not in ("html", "body") else (False, False)
        hard = hidden or name in AROUND and not (name == "header" and not names and open_["article"] + open_["main"])
        soft = soft or name in WRAPPERS
        own = node
        if hard or soft or name in ("article", "main"):
            if name not in BLOCKS:
                close()
            own = tree.add(node, name, hard, soft, strict)
        if name in BLOCKS or own != node:
            stack.append((name, own))
            open_[name] += 1
            node = own
    close()
    settle(out, tree)
    return out


def settle(found: list[Block], tree: Tree, little: float = 0.25) -> None:
    """Decides which elements stand around the article and which hold it."""
    n = len(tree.name)
    for k in range(1, n):
        tree.hard[k] = tree.hard[k] or tree.hard[tree.parent[k]]
    mass = [0] * n
    for b in found:
        if not tree.hard[b.node]:
            mass[b.node] += len(b.text) - b.linked
    for k in range(n - 1, 0, -1):
        mass[tree.parent[k]] += mass[k]

    def inherited(own: list[bool]) -> list[bool]:
        got = list(own)
        for k in range(1, n):
            got[k] = got[k] or got[tree.parent[k]]
        return got

    below, never = inherited(tree.soft), inherited(tree.strict)
    holds = [k for k in range(1, n) if tree.name[k] in ("article", "main") and not tree.hard[k] and mass[k]]
    if not any(not below[k] for k in holds):
        beside = sum(len(b.text) - b.linked for b in found if not tree.hard[b.node] and not below[b.node])
        pool = [k for k in holds if not never[k]] or [k for k in range(1, n) if tree.soft[k] and not tree.hard[k] and not never[k] and mass[k]]
        best = max(pool, key=mass.__getitem__, default=0)
        if best and beside < little * mass[best]:
            k = best
            while k:
                tree.soft[k] = False
                k = tree.parent[k]
    around = inherited([h or s for h, s in zip(tree.hard, tree.soft, strict=True)])
    inside = inherited([tree.name[k] in ("article", "main") and not around[k] for k in range(n)])
    for b in found:
        b.around, b.inside = around[b.node], inside[b.node]


def nearest(found: list[Block], frame: bool) -> list[str | None]:
    """For each block the label of the last decided one before it, of the article's own alone for blocks in an article;
    without `frame`, what stands in elements around the article decides nothing."""
    out, own, any_ = [], None, None
    for b in found:
        out.append(own if b.inside else any_)
        if b.label in ("good", "bad"):
            any_ = any_ if b.around and not frame else b.label
            own = b.label if b.inside else own
    return out


def classify(found: list[Block], most_links: float = 0.33, short: int = 70, long: int = 200, low: float = 0.12, high: float = 0.24) -> None:
    """Labels blocks `good` or `bad`, by their own features first and by their neighbours then."""
    whole = any(b.inside and not b.around for b in found)
    density = []
    for b in found:
        words = b.text.lower().split()
        density.append(sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words))
        if b.around or b.linked > most_links * len(b.text) or (whole and not b.inside):
            b.label = "bad"
        elif len(b.text) < short or b.heading:
            b.label = "short"
        elif density[-1] >= high:
            b.label = "good" if len(b.text) > long else "near"
        elif density[-1] >= low:
            b.label = "near"
        else:
            b.label = "near" if b.inside else "bad"
    for wanted in ("near", "short"):
        # The nearest decided block either way; beside text of some length and an article's own blocks the frame doesn't count.
        before, after = nearest(found, wanted == "short"), nearest(found[::-1], wanted == "short")[::-1]
        for b, sides in zip(found, zip(before, after, strict=True), strict=True):
            if b.label != wanted:
                continue
            if b.inside:
                b.label = "bad" if sides == ("bad", "bad") and b.linked else "good"
            elif wanted == "near":
                b.label = "bad" if sides == ("bad", "bad") else "good"
            else:
                b.label = "good" if "good" in sides and (b.heading or "bad" not in sides or _ENDED.search(b.text)) else "bad"
    if not any(b.label == "good" for b in found):
        # A page of a sentence or two: those that are written like text.
        for b, share in zip(found, density, strict=True):
            if not b.around and not b.heading and not b.linked and share >= low and _ENDED.search(b.text):
                b.label = "good"


def extract(page: str) -> str:
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row a page: its main text and the number of its code points.

    A null or empty page, and one without an article, gives an empty text. Repeated rows and null ids or addresses keep
    a row each; broken and cut markup is read as far as it goes; an empty table gives an empty result; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = [extract(page.as_py() or "") for page in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
