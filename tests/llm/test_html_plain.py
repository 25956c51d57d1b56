"""HTML extraction against a plain version: the standard library's parser, walks over the stack, rules by scanning."""

import collections
import random
import re
import time
from html.parser import HTMLParser

import pandas as pd
import pytest

from cyclaris.llm import html_text as h

from ..helpers import DATA
from .cases import saved

INLINE_END = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.parts, self.link, self.silent, self.mains, self.ids = [], [], [], False, None, 0, 0
        self.about = self.state()

    def state(self):
        on = lambda k: any(e[k] for e in self.stack)
        blocks = [(n, e["tag"]) for n, e in enumerate(self.stack) if e["tag"] in h.BLOCK]
        holders = [(self.stack[n]["id"], t) for n, t in blocks if t not in h.FLOW]
        own = blocks[-1:] and blocks[-1][1] not in h.FLOW
        run = ([0, *(i for i, _ in holders)][-1 - bool(own)], blocks[-1][1] if own else "")
        return {"aside": on("beside"), "main": self.mains if on("main") else 0, "heading": on("heading"), "run": run}

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(t for t, _ in self.parts)).strip()
        if text:
            self.found.append({"text": text, "linked": sum(len(t.strip()) for t, k in self.parts if k), **self.about})
        self.parts, self.about = [], self.state()

    def pop(self):
        e = self.stack.pop()
        self.link = self.link and e["link"]
        return e["tag"]

    def pop_block(self, tags):
        at = max((i for i, e in enumerate(self.stack) if e["tag"] in h.BLOCK), default=None)
        while at is not None and self.stack[at]["tag"] in tags:
            while len(self.stack) > at:
                self.pop()
            at = max((i for i, e in enumerate(self.stack) if e["tag"] in h.BLOCK), default=None) if tags != {"p"} else None

    def handle_starttag(self, tag, attrs):
        if tag in h.RAW:
            self.silent = tag
        elif tag in ("br", "hr"):
            if tag == "br" and not any(e["mute"] for e in self.stack):
                self.parts.append(("\n", False))
            if tag == "hr":
                self.pop_block({"p"})
                self.flush()
        elif tag not in h.VOID:
            if tag in h.BLOCK:
                self.pop_block({"p"})
                self.pop_block(h.HEADINGS if tag in h.HEADINGS else INLINE_END.get(tag, set()))
            elif tag == "a":
                self.link = True
            in_main = any(e["main"] for e in self.stack)
            named = False
            for k, v in attrs:
                if k in ("class", "id", "role"):
                    for word in (v or "").lower().split():
                        pieces = set(re.split("[^a-z0-9]+", word))
                        named |= bool(pieces & h.ASIDE_NAMES) and word.split("-")[0] not in ("has", "no", "with")
                named |= k == "hidden" or k == "style" and "display:none" in (v or "").replace(" ", "")
            beside = tag not in ("html", "body", "main") and (tag in h.ASIDE or tag == "header" and not in_main or named)
            inline = any(e["tag"] not in h.BLOCK for e in self.stack)
            if tag in h.BLOCK or tag in h.MUTE or beside or inline:
                self.mains += tag in h.MAIN and not in_main
                self.ids += 1
                self.stack.append({"id": self.ids, "tag": tag, "beside": beside, "main": tag in h.MAIN, "mute": tag in h.MUTE, "heading": tag in h.HEADINGS, "link": self.link})
            if tag in h.BLOCK:
                self.flush()

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None
            return
        if tag == "a":
            self.link = False
        through = False
        if tag == "p":
            self.pop_block({"p"})
        else:
            low = 0
            if tag not in h.TABLE_PARTS:
                low = max((i for i, e in enumerate(self.stack) if e["tag"] in h.SCOPES), default=-1) + 1
            at = max((i for i in range(low, len(self.stack)) if self.stack[i]["tag"] == tag), default=None)
            while at is not None and len(self.stack) > at:
                through |= self.pop() in h.BLOCK
        if tag in h.BLOCK or tag == "br" or through:
            self.flush()

    def handle_data(self, data):
        if not self.silent and not any(e["mute"] for e in self.stack):
            self.parts.append((data, self.link))


def words(text):
    return re.findall(r"\w+", text.lower())


def share(text):
    w = words(text)
    return max(sum(x in s.split() for x in w) for s in h.STOP_WORDS.values()) / max(1, len(w))


def label(b, fits):
    n, links = len(b["text"]), b["linked"] / len(b["text"])
    stop = share(b["text"]) if fits else 1
    if b["aside"]:
        return "bad"
    if links > 0.5:
        return "linked" if b["main"] and not b["heading"] else "bad"
    if b["heading"] or n < 40:
        return "short" if b["heading"] or b["main"] or links <= 0.2 else "bad"
    if stop >= (0.1 if b["main"] else 0.2):
        return "good" if n > 80 else "near"
    if stop >= 0.1 or b["main"]:
        return "near"
    return "bad" if links else "plain"


def plain_text(html):
    p = Plain()
    p.feed(html)
    p.close()
    p.flush()
    found = p.found
    beside = [w for b in found if not b["aside"] for w in words(b["text"])]
    fits = max(sum(x in s.split() for x in beside) for s in h.STOP_WORDS.values()) >= 0.05 * len(beside)
    first = [label(b, fits) for b in found]
    if "good" not in first:
        first = [label(b, False) for b in found]
    if "good" not in first:
        first = ["good" if b["main"] and not b["heading"] and x in ("near", "short") else x for b, x in zip(found, first)]
    row = [(b, x) for b, x in zip(found, first) if not b["aside"]]
    good = [(b["run"], len(b["text"])) for b, x in row if x == "good"]
    size = {r: sum(n for q, n in good if q == r) for r, _ in good}
    if size:
        best = next(r for r, _ in good if size[r] == max(size.values()))
        inside = [i for i, (b, x) in enumerate(row) if x == "good" and b["run"] == best]
        number, title = row[inside[0]][0]["main"], inside[0]
        while title > 0 and row[title - 1][0]["heading"] and row[title - 1][1] == "short":
            title -= 1
        for i, (b, _) in enumerate(row):
            if i < title or i > inside[-1]:
                if b["run"] != best and not (b["main"] and number in (0, b["main"])):
                    if size.get(b["run"], 0) < size[best] * (1 if number and not b["main"] else 0.2):
                        row[i] = None
        row = [x for x in row if x]
    kept = []
    for i, (b, x) in enumerate(row):
        left = [j for j in range(i) if row[j][1] in ("good", "bad")][-1:]
        right = [j for j in range(i + 1, len(row)) if row[j][1] in ("good", "bad")][:1]
        if x == "near":
            x = "good" if any(row[j][1] == "good" for j in left + right) else "bad"
        elif x == "linked":
            x = "good" if left and right and all(row[j][1] == "good" and row[j][0]["main"] == b["main"] for j in left + right) else "bad"
        elif x in ("short", "plain"):
            sides = right if b["heading"] else left + right
            close = [j for j in sides if abs(j - i) == min(abs(k - i) for k in sides)]
            x = "good" if any(row[j][1] == "good" for j in close) else "bad"
        if x == "good":
            kept.append(b["text"])
    return "\n\n".join(kept)


def test_pages_of_the_table_equal_the_plain_version():
    for html in pd.read_parquet(f"{DATA}/pages.parquet")["html"]:
        bare = re.sub("(</?)article", r"\1div", html)
        assert h.main_text(html) == plain_text(html) and h.main_text(bare) == plain_text(bare)


def test_random_pages_equal_the_plain_version():
    rng = random.Random(5)
    names = "div div p p p p li ul h2 article main nav aside header table tr td span b a a button svg section hr br script".split()
    attributes = ["", "", "", "", ' class="ad"', " class='side-bar x'", ' id="comments"', " hidden", ' class="has-ad"', ' title="a > b"']
    stop = "the of and a to in is that it was for on are with".split()
    for _ in range(3000):
        open_, out = [], []
        for _ in range(rng.randint(1, 40)):
            if rng.random() < 0.4:
                w = [rng.choice(stop) if rng.random() < rng.choice((0.05, 0.3)) else rng.choice(("xylo", "zebra", "mond", "&eacute;t&#233;", "&amp;")) for _ in range(rng.choice((2, 8, 30)))]
                out.append(" ".join(w))
            elif rng.random() < 0.4 and open_:
                out.append(f"</{open_.pop() if rng.random() < 0.8 else rng.choice(open_)}>")
            else:
                tag = rng.choice(names)
                if tag == "script":
                    out.append("<script>if (a < b) '</p>'</script>")
                else:
                    out.append(f"<{tag}{rng.choice(attributes)}>")
                    if tag not in ("hr", "br"):
                        open_.append(tag)
        html = " ".join(out)
        assert h.main_text(html) == plain_text(html), html


def without(html, asides=False, article=False):
    """A page without class, id and role; with elements beside the article, or the article's own, made into plain ones."""
    html = re.sub(r' (?:class|id|role)="[^"]*"', "", html)
    html = re.sub(r"(</?)(?:nav|footer|aside|header|form|menu)(?=[ >])", r"\1div", html) if asides else html
    return re.sub(r"(</?)article(?=[ >])", r"\1div", html) if article else html


@pytest.mark.parametrize(("asides", "article", "most"), [(False, False, 0.001), (False, True, 0.005), (True, False, 0.005), (True, True, 0.02)])
def test_the_rules_decide_without_names(asides, article, most):
    """Shares of blocks beside the article that are kept, and of its own that are lost, without any name to go by."""
    kept = beside = lost = own = 0
    for html in pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]:
        true = collections.Counter(b.text for b in h.blocks(html) if b.main and not b.aside)
        rest = collections.Counter(b.text for b in h.blocks(html)) - true
        have = collections.Counter(h.main_text(without(html, asides, article)).split("\n\n"))
        kept, beside = kept + (have & (rest - true)).total(), beside + rest.total()
        lost, own = lost + (true - have).total(), own + true.total()
    assert beside > 1500 and own > 2000
    assert kept <= most * beside and lost <= 0.02 * own


def test_runs():
    text = "The cat was on the mat and it is a long sentence that goes on for the sake of the test with words of all kinds to be read. " * 3
    story = f"<h1>Title</h1><p>{text}</p><div>{text}</div><p>{text}</p>"
    want = "\n\n".join(["Title", *[text.strip()] * 3])
    notice = "<div>This is the notice that you have to read and it is not a part of it.</div>"
    for body in (f"{notice}<article>{story}</article>{notice}", f"{notice}<div>{story}</div>{notice}", f"{notice}<div><h1>Title</h1></div><div>{story[14:]}</div>{notice}", f"<article>{story}</article>{notice}<p>{text}</p>"):
        assert h.main_text(f"<body>{body}</body>") == want
    two = f"<article>{story}</article><article><p>{text}</p></article>"
    assert h.main_text(two) == want + "\n\n" + text.strip()


def test_the_rules_find_the_article_without_its_tags():
    lost = kept = 0
    decided = collections.Counter()
    for html in pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]:
        found = h.blocks(re.sub("(</?)article", r"\1div", html))
        h.first_pass(found)
        decided.update(b.label in ("good", "bad") for b in found if not b.aside)
        h.second_pass(found)
        true, have = (collections.Counter(x) for x in (h.main_text(html).split("\n\n"), [b.text for b in found if b.label == "good"]))
        lost, kept = lost + (true - have).total(), kept + true.total()
        assert not have - true
    assert lost <= 0.02 * kept and decided[True] > 0 and decided[False] > 0


HOSTILE = [
    "<a ", "<a '", '<a x="', "<![CDATA[", "<div><b>", "<p ", "&#0", "&#9", "<table><td>", "<", "<!-", "</", "<script>", "a=b ", "= ", "<li><p>", "<button>",
    "<span class=ad><div>", " ", "</div>", "<!-->", "<b class=ad>", "x ", "<h1>", "<article>", "<a>",
]


@pytest.mark.parametrize("mark", HOSTILE)
@pytest.mark.parametrize("tail", ["", "</i></div>", "</span></b>"])
def test_hostile_pages_take_linear_time(mark, tail):
    for html in (mark * (400_000 // len(mark)) + tail, "<a " + mark * (200_000 // len(mark)), (mark + tail) * (300_000 // len(mark + tail)), "<p>" * 30_000 + tail * 30_000):
        began = time.process_time()
        assert isinstance(h.main_text(html), str)
        assert time.process_time() - began < 2


def test_odd_marks():
    assert h.main_text("<head><title>x</title><body><article><p>One &#0000065; &#99999999999; two.</article>") == "One A � two."
    assert h.main_text("<article><p>a < b and c > d</p><!-- <p>no --><p>e<!--->f</p></article>") == "a < b and c > d\n\nef"
    assert h.main_text('<article><p title="x > y">Yes.</p><a href="z') == "Yes."


def test_links_inside_an_article_stay_where_it_goes_on():
    text = "The cat was on the mat and it is a long sentence that goes on for the sake of the test with words of all kinds to be read"
    assert h.main_text(f"<article><p>{text}.</p><p><a href=/r>The report.</a></p><p>{text} too.</p></article>") == f"{text}.\n\nThe report.\n\n{text} too."


def test_empty_table_and_a_very_long_page(spark, tmp_path):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert h.query(spark, saved(spark.createDataFrame([], schema), tmp_path / "a", "pages")).count() == 0
    long_page = "<article>" + "".join(f"<p>The cat was on the mat {i}, and it is a long sentence that goes on for the sake of it</p>" for i in range(50_000)) + "</article>"
    rows = spark.createDataFrame([(1, None, long_page, "mine", 3), (None, "u", "", None, None)], schema)
    got = {r["page_id"]: r["text"] for r in h.query(spark, saved(rows, tmp_path / "b", "pages")).collect()}
    assert got[1].count("\n\n") == 49_999 and got[None] == ""
