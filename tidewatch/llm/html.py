"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags, by one linear scan.  First pass: a block of enough text is decided by its
share of stop words, its length and its link density; what stands in navigation, forms, footers, asides, comments and the
like, or is hidden, is out.  Blocks too short or too sparse to tell stay open.  Second pass: an open block takes the label
of its nearest decided neighbours; where they disagree, the nearer one counts, and at equal distance the block is out.
The page's edges are no neighbours.  Inside an article only the article's blocks are neighbours, and its edges count as in.
A page in a language without any of the stop words is decided by length and links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrow import hidden, map_rows

# Element names of HTML, and words that mark page furniture in class, id and role attributes.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select"
    " summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video xmp noembed noframes".split())
VOID = frozenset("hr".split())
OUT = frozenset("nav aside form menu dialog button select fieldset head search footer".split())
IN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "nav navbar navigation menu menubar topbar toolbar header masthead banner footer colophon contentinfo sidebar side complementary aside"
    " ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices"
    " alert popup modal overlay comment comments commentlist respond reply replies disqus discussion share sharing social follow related"
    " recommended recommendations breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login search searchform"
    " widget toc skip hidden".split()
)
GENERIC = frozenset("list box item items section container wrapper wrap site page block area inner outer top bottom left right bar main global content group form link links text title body col row panel unit slot".split())
ROLES_IN = frozenset("main article".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she"
    " there would their we him been has when who will no more if out so up said what its about than into them can only other"
    " de la le les et des en un une du que est dans qui par pour au il sur pas plus avec son se ce ne sont aux mais ou"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei"
    " el los las y del se por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy".split()
)
#: Code points under which a block is too short to tell, or long; shares of stop words; share of linked text that is too much.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.25
LINKED = 0.4

#: Share of stop words' letters in a page's unlinked text under which its language is taken to have no known stop words.
FOREIGN = 0.03

TAG_NAME, SPACE, KEY, EQUALS, BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
TOLD = frozenset("class id role style hidden aria-hidden".split())
NAME = re.compile(r"[a-z]+")
EDGES = ".,;:!?\"'()[]{}%*#$&<>«»„“”‘’…·|/\\-–—_=+~`^@"


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # code points inside links
    tag: str
    place: int  # number of the article that it is in, -1 in page furniture, 0 elsewhere


class Scanner:
    """Tags and text of a page, each code point looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def until(self, mark: str, at: int) -> int:
        """Where the first ``mark`` from ``at`` on ends, or the page."""
        found = self.page.find(mark, at)
        return len(self.page) if found < 0 else found + len(mark)

    def attributes(self) -> tuple[dict[str, str], bool]:
        """The attributes that tell something, and whether the tag closes itself.  A quote that never ends ends with the tag."""
        page, told = self.page, {}
        while True:
            begin = self.at
            self.at = at = SPACE.match(page, begin).end()
            if at >= len(page):
                return told, False
            if page[at] == ">":
                self.at += 1
                return told, at > begin and page[at - 1] == "/"
            key = KEY.match(page, at)
            self.at = at = key.end()
            value = ""
            if equals := EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote and quote in "\"'":
                    end = page.find(quote, at + 1) if at < self.last[quote] else -1
                    if end < 0:
                        end = page.find(">", at) if at < self.last[">"] else len(page)
                        self.at = end
                    else:
                        self.at = end + 1
                    value = page[at + 1 : end]
                else:
                    bare = BARE.match(page, at)
                    value, self.at = bare[0], bare.end()
            if (name := key[0].lower()) in TOLD and name not in told:
                told[name] = value.lower()

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str], bool]]:
        """("text", text, {}, False), ("open", name, attributes, closes itself) and ("close", name, {}, False) in order."""
        page, size = self.page, len(self.page)
        while self.at < size:
            mark = page.find("<", self.at)
            if mark < 0:
                mark = size
            if mark > self.at:
                yield "text", page[self.at : mark], {}, False
            self.at = mark
            if mark == size:
                return
            after = page[mark + 1 : mark + 9]
            if after.startswith("!--"):
                self.at = self.until("-->", mark + 4)
            elif after == "![CDATA[":
                self.at = self.until("]]>", mark + 9)
            elif after[:1] in ("!", "?"):
                self.at = self.until(">", mark + 1)
            elif name := TAG_NAME.match(page, mark + 1):
                self.at = name.end()
                told, alone = self.attributes()
                yield "open", name[0].lower(), told, alone
            elif name := (after[:1] == "/" and TAG_NAME.match(page, mark + 2)):
                self.at = self.until(">", name.end())
                yield "close", name[0].lower(), {}, False
            elif after[:1] == "/":
                self.at = self.until(">", mark + 1)
            else:
                self.at = mark + 1
                yield "text", "<", {}, False


@lru_cache(maxsize=64)
def end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE)


def furniture(value: str) -> bool:
    """Whether a class, id or role is a piece of page furniture: all its words are such or say nothing."""
    for token in value.split():
        words = NAME.findall(token)
        if words and not FURNITURE.isdisjoint(words) and all(w in FURNITURE or w in GENERIC for w in words):
            return True
    return False


def place_of(name: str, told: dict[str, str], inside: bool) -> int | None:
    """What an element says about the blocks inside: 1 in, -1 out, None nothing."""
    if name in OUT or name == "header" and not inside:
        return -1
    if told:
        if "hidden" in told or told.get("aria-hidden") == "true" or HIDDEN.search(told.get("style", "")):
            return -1
        if told.get("role") in ROLES_IN:
            return 1
        if name not in ("body", "html", "article", "main") and any(furniture(told[k]) for k in ("class", "id", "role") if k in told):
            return -1
    return 1 if name in IN else None


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order.  Unclosed and stray tags are borne; raw elements are skipped to their end."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # open block-level elements: name, place, whether a header inside an article
    depth: Counter = Counter()
    parts: list[str] = []
    linked, in_link, tag, articles = 0, False, "body", 0
    scan = Scanner(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            place = stack[-1][1] if stack else 0
            if stack and stack[-1][2] and tag not in HEADINGS and place > 0:
                place = -1
            found.append(Block(text, min(linked, len(text)), tag, place))
        parts.clear()
        linked = 0

    for kind, name, told, alone in scan:
        if kind == "text":
            parts.append(name)
            linked += len(name) * in_link
            continue
        if kind == "close":
            if name == "a":
                in_link = False
            elif name in BLOCK:
                flush()
                tag = "body"
                while depth[name]:
                    top = stack.pop()[0]
                    depth[top] -= 1
                    if top == name:
                        break
            continue
        if name in RAW and not alone:
            end = end_of(name).search(page, scan.at)
            scan.at = scan.until(">", end.end()) if end else len(page)
            continue
        if name == "a":
            in_link = True
        elif name in ("br", "img", "input"):
            parts.append(" ")
        if name in BLOCK:
            flush()
            tag = name
            ends = ("p", *HEADINGS) if name in ("p", *HEADINGS) else ("li",) if name == "li" else ()
            if stack and stack[-1][0] in ends:
                depth[stack.pop()[0]] -= 1  # these end where the next begins
            if not alone and name not in VOID:
                above, header = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                own = place_of(name, told, above > 0)
                # what is out stays out, but for an article that begins inside
                if own is None or above == -1 and own == 1 and name not in IN or own == 1 and above > 0:
                    own = above
                elif own == 1:
                    articles += 1
                    own = articles
                stack.append((name, own, header or name == "header"))
                depth[name] += 1
    flush()
    return found


def stop_words(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(EDGES) in STOP_WORDS for w in words), len(words)


def decide(b: Block, foreign: bool) -> bool | None:
    """First pass: True in, False out, None too short or too sparse to tell."""
    n = len(b.text)
    if b.place == -1 or b.linked > LINKED * n and (b.place == 0 or b.tag == "li"):
        return False
    if n < SHORT:
        return False if b.linked and not b.place else None
    if foreign:
        return True if n > LONG else None
    hits, words = stop_words(b.text)
    if hits >= STOP_HIGH * words:
        return True
    if hits >= STOP_LOW * words:
        return True if n > LONG else None
    return None if b.place else False


def labels_of(blocks: list[Block]) -> list[tuple[bool, bool]]:
    """Of every block whether it is in, and whether the first pass said so."""
    words = [w for b in blocks if b.place >= 0 and not b.linked for w in b.text.lower().split()]
    common = sum(len(w) for w in words if w.strip(EDGES) in STOP_WORDS)
    foreign = common < FOREIGN * sum(map(len, words))
    known = [decide(b, foreign) for b in blocks]

    def nearest(order: range) -> list[tuple[int, bool | None]]:
        """For each block the distance and the label of the last decided one before it in ``order``; inside an article, of the
        last one there or else of the article's edge."""
        found: list[tuple[int, bool | None]] = [(0, None)] * len(blocks)
        inside: dict[int, tuple[int, bool]] = {}
        page = None
        for i in order:
            place = blocks[i].place
            if place > 0:
                inside.setdefault(place, (i - order.step, True))
            if last := inside[place] if place > 0 else page:
                found[i] = (abs(i - last[0]), last[1])
            if known[i] is not None:
                page = (i, known[i])
                if place > 0:
                    inside[place] = page
        return found

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    out = []
    for i, b in enumerate(blocks):
        keep = known[i]
        if keep is None:
            (near, left), (far, right) = before[i], after[i]
            if left == right or right is None:
                keep = left
            elif left is None or b.tag in HEADINGS:
                keep = right  # a heading goes with what it heads
            else:
                keep = left if near < far else right if far < near else False
        out.append((bool(keep), known[i] is not None))
    return out


def main_text(page: str | None) -> list[str]:
    """Texts of the page's main blocks, in page order."""
    blocks = blocks_of(page or "")
    return [b.text for b, (keep, _) in zip(blocks, labels_of(blocks), strict=True) if keep]


def extracted(pages: DataFrame, html_col: str = "html", through: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``pages`` -> the columns ``through``, ``blocks`` (array of the main blocks' texts), ``text`` and ``n_chars``.

    The blocks are joined by two newlines; ``text`` is empty and ``n_chars`` 0 where nothing is left, as for a null or
    empty page.  Pages are taken whole and one by one, so repeated rows, ties and clashing column names change nothing.
    """

    def make():  # noqa: ANN202
        def run(values: list) -> dict:
            blocks = [main_text(v) for v in values]
            texts = ["\n\n".join(b) for b in blocks]
            return {"blocks": blocks, "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    (page,) = hidden(pages, "page")
    rows = pages.select(*through, F.col(html_col).alias(page))
    return map_rows(rows, make, "blocks array<string>, text string, n_chars long", [page], list(through))
