"""Main text of web pages by two-pass block rules.

A page is read once, from left to right, and cut into blocks at block-level tags; each block knows its text, the share of
its letters inside links, the share of its words that are stop words (of the list that fits it best), and the elements
around it. The first pass calls a block good, bad or undecided from these. The second looks at what surrounds it: blocks that
stand alike in the same container are a run, and the run with most good text is the article's; what lies outside of it, in
runs with little text against it, is bad, as adverts, footers and notices are whatever they are called. Then it gives
undecided blocks the label of their nearest decided neighbours. Elements that never hold article text (navigation, footers, forms, adverts, comments and
the like, by tag, role or class) decide their blocks before any rule. An <article> or <main> around a block is one more
signal for it: fewer stop words are asked for, and on a page without any good block those inside that aren't bad are.
Where none of the lists fits a page, as in other languages, length and links decide alone.

The reader takes time in proportion to the page, whatever is in it: tags are matched without going back, an element is
left in as many steps as it had open elements inside, and a mark that has no end takes the rest of the page with it.

Defined cases: a null or empty html gives an empty text; markup that isn't closed ends where its parent does; a comment,
script or tag without an end takes the rest of the page; a page with no block that passes gives an empty text; very long
pages are read whole; repeated rows are read each on its own; null ids and urls are kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Frequent words of four languages.
STOP_WORDS = {
    "en": "the of and a to in is that it was for on are with as be by this at from or have an not but which they you were",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au il pas plus ne se ce avec ou son sont elle",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass bei aus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha este si",
}
_STOP = [frozenset(w.split()) for w in STOP_WORDS.values()]

#: Elements by their part in a page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
MUTE = frozenset("noscript template svg math object canvas audio video select button datalist".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
#: Elements that are parts of running text: their text stands in what holds them.
FLOW = frozenset(
    "address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre section table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose open ends outside an end tag inside doesn't reach, and the end tags that reach through them.
SCOPES = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
#: An element that begins ends these, if they are what is open innermost.
ENDED = {
    **{h: HEADINGS for h in HEADINGS},
    **dict.fromkeys(("dd", "dt"), frozenset(("dd", "dt"))),
    **dict.fromkeys(("td", "th"), frozenset(("td", "th"))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset("td th tr tbody thead tfoot".split())),
    **{t: frozenset((t,)) for t in ("li", "option")},
    "tr": frozenset(("td", "th", "tr")),
    "body": frozenset(("head",)),
}
#: Words in class, id or role that name parts beside the article; whole words, as names are cut at - and _.
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion comment comments commentlist reply "
    "replies disqus sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer foot copyright cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social "
    "related recommended widget toolbar pagination pager masthead topbar header skip complementary contentinfo "
    "discussion responses teaser outbrain taboola".split()
)
_OPEN = re.compile("<(?=[a-zA-Z/!?])")
#: A tag: its name and attributes, whose values may hold any signs in quotes. Nothing that was matched is given up again.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'][^\s]*+))?+""")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_NAME_CUT = re.compile(r"[^a-z0-9]+")
_WHITE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
#: References to characters by more digits than any character's number has, which unescape() can't read.
_ZEROS, _HUGE = re.compile("(&#[xX]?)0{6,}+"), re.compile("&#(?:[0-9]{9,}+|[xX][0-9a-fA-F]{9,}+);?")

SHORT, LONG = 40, 80
LOW_STOP, HIGH_STOP, LINKS, FEW_LINKS = 0.10, 0.20, 0.5, 0.2
#: Share of a page's words under which no list fits it.
FITTING = 0.05
#: Letters of good text that a run outside the article's must have against it; outside of an <article> or <main> that holds it.
RUN_SHARE, OUTSIDE_SHARE = 0.2, 1.0


@dataclass
class Block:
    text: str
    linked: int = 0
    aside: bool = False
    main: int = 0  # the number of the outermost <article> or <main> around it, or zero
    heading: bool = False
    run: tuple[int, str] = (0, "")  # the container that it stands in, and the element that it is if that is one itself
    label: str = ""


def _beside(attributes: str) -> bool:
    """Whether an element's attributes name a part beside the article, or hide it."""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            for name in value.lower().split():
                if not name.startswith(("has-", "no-", "with-")) and ASIDE_NAMES.intersection(_NAME_CUT.split(name)):
                    return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
    return False


_beside_known = lru_cache(4096)(_beside)


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"\g<1>0", text))
    return unescape(text)


class _Reader:
    """What is open while a page is read: block elements, and inline ones that bear on their text."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.pieces: list[str] = []
        self.linked, self.link = 0, False  # letters of the block inside links; whether a link is open
        self.asides = self.mains = self.mutes = self.headings = self.inline = 0
        self.main_number = self.containers = 0
        self.about = (False, 0, False, (0, ""))
        # tag, beside, main, mute, heading, whether a link was open, the place of the block that it is or stands in, its run
        # and the container that it is or stands in
        self.open: list[tuple[str, bool, bool, bool, bool, bool, int, tuple[int, str], int]] = []
        self.scopes, self.total = [Counter()], Counter()

    def text(self, text: str) -> None:
        if self.mutes:
            return
        plain = _decoded(text)
        self.pieces.append(plain)
        if self.link:
            self.linked += len(plain.strip())

    def flush(self) -> None:
        """Ends the block of text; what follows is another."""
        if self.pieces:
            text = _WHITE.sub(" ", "".join(self.pieces)).strip()
            if text:
                aside, main, heading, run = self.about
                self.out.append(Block(text, self.linked, aside, main, heading, run))
            self.pieces, self.linked = [], 0
        run = self.open[-1][7] if self.open else (0, "")
        self.about = (self.asides > 0, self.main_number if self.mains else 0, self.headings > 0, run)

    def enter(self, tag: str, beside: bool, mute: bool) -> None:
        main, heading, block = tag in MAIN, tag in HEADINGS, tag in BLOCK
        if main and not self.mains:
            self.main_number += 1
        base = len(self.open) if block or not self.open else self.open[-1][6]
        run, container = self.open[-1][7:] if self.open else ((0, ""), 0)
        if block and tag in FLOW:
            run = (container, "")
        elif block:
            self.containers += 1
            run, container = (container, tag), self.containers
        self.open.append((tag, beside, main, mute, heading, self.link, base, run, container))
        self.asides, self.mains, self.mutes, self.headings = self.asides + beside, self.mains + main, self.mutes + mute, self.headings + heading
        self.inline += not block
        self.scopes[-1][tag] += 1
        self.total[tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())

    def leave(self) -> str:
        tag, beside, main, mute, heading, link, *_ = self.open.pop()
        if tag in SCOPES:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        self.total[tag] -= 1
        self.asides, self.mains, self.mutes, self.headings = self.asides - beside, self.mains - main, self.mutes - mute, self.headings - heading
        self.inline -= tag not in BLOCK
        self.link = self.link and link
        return tag

    def leave_block(self, tags: frozenset[str]) -> bool:
        """Leaves the innermost block element if it is one of these, with the inline ones in it."""
        if not self.open or self.open[self.open[-1][6]][0] not in tags:
            return False
        while self.leave() not in BLOCK:
            pass
        return True

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text("\n")
        elif tag == "hr":
            self.leave_block(_P)
            self.flush()
        if tag in VOID:
            return
        closed = attributes.endswith("/")
        block, mute = tag in BLOCK, tag in MUTE
        if block:
            self.leave_block(_P)
            if ended := ENDED.get(tag):
                while self.leave_block(ended):
                    pass
        elif tag == "a":
            self.link = not closed
        beside = False
        if tag not in _WHOLE:
            beside = tag in ASIDE or tag == "header" and not self.mains
            if attributes and not beside:
                beside = (_beside_known if len(attributes) < 200 else _beside)(attributes)
        if block or (mute or beside or self.inline) and not closed:
            self.enter(tag, beside, mute)
        if block:
            self.flush()

    def end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.scopes[-1][tag]:
            self.flush()
            return
        if tag == "a":
            self.link = False
        if tag == "p":
            self.leave_block(_P)
        elif (self.total if tag in TABLE_PARTS else self.scopes[-1])[tag]:
            through = False
            while (left := self.leave()) != tag:
                through |= left in BLOCK
            if through and tag not in BLOCK:
                self.flush()
        if tag in BLOCK:
            self.flush()


_P, _WHOLE = frozenset(("p",)), frozenset(("html", "body", "main"))


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    reader, at, n = _Reader(), 0, len(html)
    while at < n:
        m = _OPEN.search(html, at)
        stop = m.start() if m else n
        if stop > at:
            reader.text(html[at:stop])
        if not m:
            break
        found = _TAG.match(html, stop)
        if found:
            at, tag, attributes = found.end(), found[2].lower(), found[3].strip()
            if found[1]:
                reader.end(tag)
            elif tag in RAW and not attributes.endswith("/"):
                last = _RAW_END[tag].search(html, at)
                at = last.start() if last else n
            else:
                reader.begin(tag, attributes)
        elif html.startswith("<!--", stop):
            last = _COMMENT_END.search(html, stop + 2)
            at = last.end() if last else n
        elif html[stop + 1] in "!?/" and not html[stop + 2 : stop + 3].isalpha() or html[stop + 1] in "!?":
            at = html.find(">", stop) + 1 or n
        else:  # a tag without an end
            break
    reader.flush()
    return reader.out


def _fitting(found: list[Block]) -> bool:
    """Whether one of the lists fits a page."""
    words = [w for b in found if not b.aside for w in _WORD.findall(b.text.lower())]
    return max(sum(w in s for w in words) for s in _STOP) >= FITTING * len(words)


def _density(text: str) -> float:
    """The share of stop words, of the list of which there are most."""
    words = _WORD.findall(text.lower())
    return max(sum(w in s for w in words) for s in _STOP) / max(1, len(words))


def _label(b: Block, fits: bool) -> str:
    """good, bad, or undecided: short, plain (no links, few stop words), near, linked."""
    length, links = len(b.text), b.linked / len(b.text)
    if b.aside:
        return "bad"
    if links > LINKS:
        return "linked" if b.main and not b.heading else "bad"
    if b.heading or length < SHORT:
        return "short" if b.heading or b.main or links <= FEW_LINKS else "bad"
    density = _density(b.text) if fits else HIGH_STOP
    # An <article> or <main> around the block is worth a step of stop words.
    if density >= (LOW_STOP if b.main else HIGH_STOP):
        return "good" if length > LONG else "near"
    if density >= LOW_STOP or b.main:
        return "near"
    return "bad" if links else "plain"


def first_pass(found: list[Block]) -> None:
    """Labels each block by itself; where that leaves no good block, without the lists, and then by <article> and <main>."""
    fits = _fitting(found)
    for b in found:
        b.label = _label(b, fits)
    if fits and not any(b.label == "good" for b in found):
        for b in found:
            b.label = _label(b, False)
    if not any(b.label == "good" for b in found):
        for b in found:
            if b.main and not b.heading and b.label in ("near", "short"):
                b.label = "good"


def inside_runs(within: list[Block]) -> list[Block]:
    """Calls bad what lies outside of the article's run, in runs with little good text against it, and gives the other blocks.
    Headings just before the run, and what is in the same <article> or <main> (in any, if the run is in none), are among these."""
    letters: Counter = Counter()
    for b in within:
        if b.label == "good":
            letters[b.run] += len(b.text)
    if not letters:
        return within
    best, most = max(letters.items(), key=lambda x: x[1])
    places = [i for i, b in enumerate(within) if b.label == "good" and b.run == best]
    first, last, number = places[0], places[-1], within[places[0]].main
    while first and within[first - 1].heading and within[first - 1].label == "short":
        first -= 1
    inside = []
    for i, b in enumerate(within):
        own = first <= i <= last or b.run == best or b.main and number in (0, b.main)
        if own or letters[b.run] >= most * (OUTSIDE_SHARE if number and not b.main else RUN_SHARE):
            inside.append(b)
        else:
            b.label = "bad"
    return inside


def second_pass(found: list[Block]) -> None:
    """What lies outside of the article's run is bad; undecided blocks take the labels of their nearest decided neighbours.
    Such blocks and parts beside the article are no neighbours."""
    within = inside_runs([b for b in found if not b.aside])
    labels = [b.label for b in within]
    n = len(within)

    def nearest(order: range) -> list[int | None]:
        last, out = None, [None] * n
        for i in order:
            out[i] = last
            if labels[i] in ("good", "bad"):
                last = i
        return out

    for i, (b, left, right) in enumerate(zip(within, nearest(range(n)), nearest(range(n - 1, -1, -1)))):
        sides = [x for x in (left, right) if x is not None]
        if b.label == "near":
            b.label = "good" if any(labels[x] == "good" for x in sides) else "bad"
        elif b.label == "linked":
            # Links stay where the same article goes on behind them.
            b.label = "good" if [(labels[x], within[x].main) for x in sides] == [("good", b.main)] * 2 else "bad"
        elif b.label in ("short", "plain"):
            # A heading belongs to what follows it; of two neighbours equally far the good one counts.
            if b.heading:
                sides = [x for x in (right,) if x is not None]
            close = min((abs(x - i) for x in sides), default=0)
            b.label = "good" if any(labels[x] == "good" for x in sides if abs(x - i) == close) else "bad"


def main_text(html: str) -> str:
    found = blocks(html)
    first_pass(found)
    second_pass(found)
    return "\n\n".join([b.text for b in found if b.label == "good"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h or "") for h in b["html"]]
            out = pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts})
            yield out.assign(n_chars=[len(t) for t in texts])

    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return typed.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
