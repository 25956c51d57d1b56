"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one last token in its encoding: the token that ends there, whose left neighbour is the
last token of what lies before it, and that is compatible with this neighbour, i.e. the two side by side encode to
themselves. An automaton with suffix links over the vocabulary finds all tokens that end at each place of a word;
pair-compatibility tests leave one; back-pointers give the ids. Words are pieces of the pre-tokenizer's pattern; the ids
of recent words and of runs between white space are kept in bounded tables, since text repeats its words. Texts are decoded
from their ids alone.

Defined cases: a null text counts as empty; a very long text is encoded whole; an empty text has no ids and decodes to an empty text; special tokens that
stand in a text are encoded as such, as the tokenizers library does; repeated rows are encoded each on its own; null ids
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import tokenizer_path

#: Entries that a worker keeps in each of its tables, twice that while it starts anew; bounds memory, not results.
KEPT = 250_000
_SPACE = re.compile("[\t-\r ]+")
#: Characters beyond these go through the library's normalizer and pre-tokenizer, whose version of Unicode then counts.
_BEYOND = re.compile("[^\x00-\x7f\xa1-\u024f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Recent:
    """What was made of recent keys: the newest entries and those before them, at most KEPT of each."""

    def __init__(self, make) -> None:
        self.make, self.new, self.old = make, {}, {}

    def __call__(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.new) >= KEPT:
                self.new, self.old = {}, self.new
            self.new[key] = found
        return found


class Vocabulary:
    """The vocabulary and merges of a tokenizer file, over symbols of one character each.

    The last symbol of a word differs from the same byte elsewhere if the file names an end-of-word suffix; it is the
    byte's character shifted by END.
    """

    END = 0xE000

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        if spec.get("decoder") is not None or any(t[k] for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError("this tokenizer file decodes or finds its special tokens in another way")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        special = set(self.special)
        ids = {self._symbols(t): i for t, i in model["vocab"].items() if t not in special}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self._symbols(left, inner=True), self._symbols(right)
            whole = ids[a + b]
            if whole in self.parts:
                raise ValueError("a token has two merges")
            self.rank[ids[a], ids[b]] = rank
            self.parts[whole] = (ids[a], ids[b], rank)
        for a, b, rank in self.parts.values():
            if any(self.parts.get(x, (0, 0, -1))[2] > rank for x in (a, b)):
                raise ValueError("a merge comes before one that it needs")
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for symbols, i in ids.items():
            # A token that its own merges don't give as a whole can't be part of an encoding.
            if len(symbols) == 1 or self._is_whole(i):
                self.automaton.add_word(symbols, (len(symbols), i))
        self.ids = {s: i for s, i in ids.items() if len(s) == 1 or self._is_whole(i)}
        self.automaton.make_automaton()

    def _symbols(self, token: str, inner: bool = False) -> str:
        if self.suffix and not inner and token.endswith(self.suffix) and token != self.suffix:
            token = token.removesuffix(self.suffix)
            return token[:-1] + chr(ord(token[-1]) + self.END)
        return token

    def _is_whole(self, token: int) -> bool:
        if token not in self.parts:
            return False
        left, right, _ = self.parts[token]
        ends = (left not in self.parts or self._is_whole(left)) and (right not in self.parts or self._is_whole(right))
        return ends and self._meet(left, right, self.parts[token][2])

    def _meet(self, left: int, right: int, limit: int) -> bool:
        """Whether left and right, side by side, both come about before any merge of rank under limit joins their parts.

        Parts of left along its right edge live from their own merge until the merge that takes them up; so do the parts
        of right along its left edge. A merge across the border happens while both its parts live: before the left one is
        taken up, or not after the right one is (equal merges run from the left).
        """
        a, b, end_a, end_b = left, right, limit, limit
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < end_a and rank <= end_b and (a, b) != (left, right):
                return False
            if rank is not None and (a, b) == (left, right) and rank < limit:
                return False
            in_a, in_b = self.parts.get(a), self.parts.get(b)
            if in_a is None and in_b is None:
                return True
            # Back in time: undo the later of the two merges; of equal ones the right one, as the left one ran first.
            if in_b is None or in_a is not None and in_a[2] > in_b[2]:
                a, end_a = in_a[1], in_a[2]
            else:
                b, end_b = in_b[0], in_b[2]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.fits) > 4 * KEPT:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self._meet(left, right, 1 << 60)
        return known

    def encode(self, symbols: str) -> list[int]:
        """Ids of one word, given in symbols."""
        whole = self.ids.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        last, back, known = [-1] * (n + 1), [0] * (n + 1), self.fits.get
        for end, (length, token) in self.automaton.iter(symbols):
            end += 1
            if last[end] < 0:
                start = end - length
                before = last[start]
                if start == 0:
                    fits = True
                elif before < 0:
                    continue
                elif (fits := known(before << 32 | token)) is None:
                    fits = self.compatible(before, token)
                if fits:
                    last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]


class WordEncoder:
    """Encodes and decodes whole texts as a tokenizer file with NFC, lower case, a word pattern and word ends says."""

    def __init__(self, path: str) -> None:
        import regex

        self.vocabulary, self.path, self.library = Vocabulary(path), path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("this tokenizer file prepares its text in another way")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.bytes = dict(enumerate(byte_alphabet()))
        self.word, self.run = Recent(self._word), Recent(self._run)
        special = self.vocabulary.special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.made = {t: i.to_bytes(4, "little") for t, i in special.items()}
        # Special tokens hold no white space, so that none reaches over several runs.
        if any(_SPACE.search(t) for t in special):
            raise ValueError("a special token holds white space")
        shown = self.vocabulary.shown
        self.shown = [shown.get(i, "") for i in range(max(shown) + 1)]

    def _word(self, word: str) -> bytes:
        """The ids of one piece of the pattern."""
        # A byte that can be printed in ASCII stands for itself.
        symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)
        last = chr(ord(symbols[-1]) + Vocabulary.END) if self.vocabulary.suffix else symbols[-1]
        return np.array(self.vocabulary.encode(symbols[:-1] + last), "<u4").tobytes()

    def _symbols_of(self, run: str) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))]
        back = {c: b for b, c in self.bytes.items()}
        return [self.word(bytes([back[c] for c in w]).decode()) for w in pieces]

    def _plain(self, run: str) -> list[bytes]:
        if _BEYOND.search(run):
            return self._symbols_of(run)
        return list(map(self.word, self.pattern.findall(unicodedata.normalize("NFC", run).lower())))

    def _run(self, run: str) -> bytes:
        """The ids of what stands between white space."""
        if self.cut is None or not self.cut.search(run):
            return b"".join(self._plain(run))
        pieces = [p for p in self.cut.split(run) if p]
        return b"".join([x for p in pieces for x in ([self.made[p]] if p in self.made else self._plain(p))])

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian bytes."""
        runs = _SPACE.split(text)
        out = list(map(self.run.new.get, runs))
        at = -1
        try:
            while True:
                at = out.index(None, at + 1)
                r = runs[at]
                out[at] = self.run(r) if len(r) < 100 else self._run(r)
        except ValueError:
            return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, number and digest of its ids, digest of what they decode to, maybe ids."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(tokenizer)
        for b in batches:
            rows = []
            for text in b["text"]:
                ids = code(text or "")
                digests = (hashlib.sha256(x).hexdigest() for x in (ids, code.decode(ids).encode()))
                rows.append((len(ids) // 4, *digests, ids if keep_ids else None))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"], index=b.index)
            out.insert(0, "doc_id", b["doc_id"].astype("Int64"))
            yield out if keep_ids else out.drop(columns="ids")

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return typed.mapInPandas(encode, schema + ", ids binary" if keep_ids else schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
