"""A Katz backoff language model over words, of any order (pairs of words by default), and the scores of whole texts under it.

P(w|h) = d(c) c / c(h) for n-grams hw seen in training, with Good-Turing discounts d of the order for counts up to 5, and
alpha(h) P(w|h') for the others, where h' is h without its first word; P(w) in turn is discounted, and what it leaves is the
probability of the one unknown word. alpha(h) is what the discounts leave over what P(w|h') of the words seen after h leave
of one, so every distribution sums to one exactly. A context whose counts are all above 5 (or not discounted) sets aside one
count more than it has. A context not seen in training is passed over. The recursion is one from order to order: each order
is a pass that gives every token its count, its context's count and its probability, from those of the order below.

Texts are cut into blocks with word numbers of their own. Counts travel as packed arrays, one for each block and part of
the hash space: to the part, which adds them up, and back to the block where the block needs them. No vocabulary is ever
broadcast. A frequent context is spread over as many parts as its count asks for; its sums are joined across them. Parts are
proportional to the tokens. `store` writes the model, that is the words, the n-grams with their counts, and the sums that
backoff weights are made of, as tables by order and part.

Words are told apart by 96 bits of two hashes (among 10^10 words two are alike with a chance of under 10^-9), n-grams by the
corpus numbers of their words, so not by hashes at all.

Defined cases: a null text counts as empty; an empty text is the one token that ends it; a very long text is one text of its
block, however long; without training texts every word has probability one (score zero), as in the base score; a null id
counts as an empty id (held out); repeated rows are scored, and learned from, each on its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written

#: Words to an n-gram, in the query too (README: what three take); bytes of text to a block; tokens to a part; highest count that is discounted.
ORDER, BLOCK_BYTES, PART_TOKENS, DISCOUNTED = 2, 4 << 20, 1_000_000, 5
#: Rounds in which the n-grams of an order beyond the second are dealt, a share of the parts in each, so that the files of a
#: shuffle stay small.
ROUNDS = 2
#: What ends a text; no word holds a space.
END = b" "
#: The number of the start of a text as a word of a context; the numbers of words begin at 1.
START = 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; of numbers of several bytes first all first bytes, then all second ones and so on."""
    import zstandard

    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    body = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for x in raw[4:at].decode().split(","):
        kind, n = x.split(":")
        dtype = np.dtype(kind)
        size = int(n) * dtype.itemsize
        planes = np.frombuffer(raw[at : at + size], np.uint8).reshape(dtype.itemsize, int(n))
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(int(n)))
        at += size
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def steps(a: np.ndarray) -> np.ndarray:
    """Rising numbers as small differences; np.cumsum undoes it."""
    return smallest(np.diff(a, prepend=0))


def scattered(a: np.ndarray) -> np.ndarray:
    """Numbers, hashed to 64 bits."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(n: np.ndarray, top: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing discounts of counts 0..top from n, how many types have each count 0..top + 1; one where they make no sense."""
    d = np.ones(top + 1)
    if n[1] > 0:
        rest = (top + 1) * n[top + 1] / n[1]
        for r in range(1, top + 1):
            if n[r] > 0 and rest < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                d[r] = x if 0 < x < 1 else 1.0
    return d


class Unigrams:
    """P(w) from training counts; a word with count zero is the unknown one."""

    def __init__(self, total: int, by_count: np.ndarray, sums_above: int) -> None:
        self.total, self.d = total, discounts(by_count)
        r = np.arange(DISCOUNTED + 1)
        self.scale = max(total, 1)
        kept = (self.d * r * by_count[: DISCOUNTED + 1])[1:].sum() + sums_above
        unknown = 1 - kept / self.scale
        if unknown < 1e-12:
            self.scale, unknown = total + 1, 1 / (total + 1)
        self.unknown = unknown if total else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        known = self.d[np.minimum(c, DISCOUNTED)] * c / self.scale
        known = np.where(c > DISCOUNTED, c / self.scale, known)
        return np.where(c > 0, known, self.unknown)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after their discounts."""
    return np.where(c > DISCOUNTED, c, d[np.minimum(c, DISCOUNTED)] * c)


def counted(c: np.ndarray) -> list[int]:
    """Of counts: how many are 1..DISCOUNTED + 1, the sum of those above DISCOUNTED, how many and how much in all."""
    n = np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return [*n[1 : DISCOUNTED + 2].tolist(), int(c[c > DISCOUNTED].sum()), int((c > 0).sum()), int(c.sum())]


def _stats(df: DataFrame) -> list[int]:
    n = DISCOUNTED + 4
    row = df.agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(n))).first()
    return [int(x or 0) for x in row]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


BLOCK = "kind string, block long, n_tokens long, ids array<long>, lengths binary, held binary, tokens binary, words binary"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Blocks of texts as numbers of their own words (word 0 ends a text), and the blocks' words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest, number = xxhash.xxh64_intdigest, TaskContext.get().partitionId() << 24

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(self) + 1
                return n

        def rows() -> pd.DataFrame:
            lengths = np.array([len(t) for t in texts], np.uint32)
            tokens, held = np.concatenate(texts), np.array([held_out(i) for i in ids])
            trained = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(words) + 1)
            known = [END, *words]
            hashes = np.fromiter((digest(w, 7) for w in known), np.uint64, len(known))
            checks = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))
            texts_of = ("texts", number, len(tokens), ids, pack(smallest(lengths)), pack(held), pack(smallest(tokens)), None)
            words_of = ("words", number, None, None, None, None, None, pack(hashes, checks, smallest(trained)))
            return pd.DataFrame([texts_of, words_of], columns=[x.split()[0] for x in BLOCK.split(", ")]).astype({"n_tokens": "Int64"})

        words, texts, ids, size = Numbers(), [], [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].astype("Int64"), b["text"]):
                data = (text or "").encode().lower()  # of bytes: ASCII letters, and then ASCII white space
                found = data.split()
                texts.append(np.fromiter((*map(words.__getitem__, found), 0), np.uint32, len(found) + 1))
                ids.append(None if pd.isna(doc) else int(doc))
                size += len(data) + 16
                if size >= block_bytes:
                    yield rows()
                    words, texts, ids, size, number = Numbers(), [], [], 0, number + 1
        if texts:
            yield rows()

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = written(typed.mapInPandas(cut, BLOCK), "blocks", by="kind")
    return made.where("kind = 'texts'").drop("words"), made.where("kind = 'words'").select("block", "words")


def word_counts(words: DataFrame, parts: int, store: bool = False) -> DataFrame:
    """The words of all blocks, counted: rows of a block and part with the block's word numbers and, for each, its corpus
    number and training count; and a row without a block for each part, with counts of counts, and the model's table of hashes,
    numbers and counts if it is to be stored."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, data in zip(b["block"], b["words"]):
                hashes, checks, c = unpack(data)
                part = (hashes % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(int(p), block, pack(steps(i), hashes[i], checks[i], c[i])) for p in np.unique(part) for i in [order[ends[p] : ends[p + 1]]]]
                yield pd.DataFrame(rows, columns=["part", "block", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(x) for x in pdf["data"]]
        hashes, checks = (np.concatenate([g[k] for g in got]) for k in (1, 2))
        order = np.lexsort((checks, hashes))
        new = np.append(True, (np.diff(hashes[order]) != 0) | (np.diff(checks[order]) != 0))
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        hashes, checks = hashes[order[new]], checks[order[new]]
        total = np.bincount(inverse, np.concatenate([g[3] for g in got]), len(hashes)).astype(np.int64)
        part = int(pdf["part"].iloc[0])
        # The more frequent, the smaller the number.
        place = np.empty(len(total), np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = place * parts + part + 1
        rows, at = [], 0
        for block, (own, *_) in zip(pdf["block"], got):
            i = inverse[at : at + len(own)]
            rows.append((part, block, pack(own, smallest(number[i]), smallest(total[i])), None))
            at += len(own)
        rows.append((part, None, pack(hashes, checks, smallest(number), smallest(total)) if store else None, counted(total)))
        out = pd.DataFrame(rows, columns=["part", "block", "counts", "stats"])
        out["block"] = out["block"].astype("Int64")
        return out

    dealt = words.mapInPandas(deal, "part long, block long, data binary")
    return written(dealt.groupBy("part").applyInPandas(add, "part long, block long, counts binary, stats array<long>"), "words")


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys, where in it each kind begins, and the kind of each key."""
    order = np.argsort(key)
    new = np.append(True, np.diff(key[order]) != 0)[: len(key)]
    kind = np.empty(len(key), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), kind


class Order:
    """What all blocks and parts know: the parts, the count from which a context is spread over several, the last order, and
    the discounts of the orders done so far."""

    def __init__(self, parts: int, unigrams: Unigrams, kinds: int, starts: int, last: int) -> None:
        self.parts, self.unigrams, self.kinds, self.starts, self.last = parts, unigrams, kinds, starts, last
        self.wide = max(1, unigrams.total // (4 * parts))
        self.d: dict[int, np.ndarray] = {}


class Dealt:
    """Where the n-grams of a block went and what the parts answer: probabilities of the n-grams."""

    def __init__(self, part: np.ndarray, total: np.ndarray, about: Order) -> None:
        """part and total: of each n-gram its part, and the count of its context."""
        self.part, self.total, self.about = part, total, about
        self.order = np.argsort(part.astype(np.uint16) if about.parts < 1 << 16 else part, kind="stable")
        self.ends = np.append(0, np.cumsum(np.bincount(part, minlength=about.parts)))
        self.spread = np.flatnonzero(total >= about.wide)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for p in np.flatnonzero(np.diff(self.ends)).tolist():
            yield p, self.order[self.ends[p] : self.ends[p + 1]]

    def probabilities(self, answers: dict[int, bytes], sums_of_spread: np.ndarray, n: int, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each n-gram its count, its context's scale and its probability; lower: its probability in the order below."""
        size, r, d = len(self.part), np.arange(1, DISCOUNTED + 1), self.about.d[n]
        count, mask, sums = np.zeros(size, np.int64), np.zeros(size, np.uint8), {}
        for p, i in self:
            count_i, mask[i], high, seen, *counts = unpack(answers[p])
            count[i] = count_i
            unseen = i[count_i == 0]
            unseen = unseen[self.total[unseen] < self.about.wide]
            sums[p] = unseen, np.column_stack((*counts, high, seen)).astype(float)
        mask[self.spread] = (sums_of_spread[:, :DISCOUNTED] > 0) @ (1 << r - 1)
        # Contexts whose counts all stay as they are leave nothing: they set one count aside.
        none_left = (mask & int(((d[1:] < 1) * (1 << r - 1)).sum())) == 0
        scale = self.total + none_left
        p = discounted(count, d) / scale
        left_out = self.spread[count[self.spread] == 0]
        of_spread = sums_of_spread[count[self.spread] == 0]
        for i, s in (*sums.values(), (left_out, of_spread)):
            kept = (s[:, :DISCOUNTED] * (d[1:] * r)).sum(axis=1) + s[:, DISCOUNTED]
            left = np.where(none_left[i], 1.0, self.total[i] - kept)
            p[i] = left / scale[i] / (1 - s[:, DISCOUNTED + 1]) * lower[i]
        return count, scale, p


class Block:
    """The tokens of a block and what each order gives them."""

    def __init__(self, lengths: bytes, held: bytes, tokens: bytes, back: list[bytes], about: Order) -> None:
        (lengths,), (self.held,), (tokens,) = map(unpack, (lengths, held, tokens))
        self.about, self.n = about, 1
        self.lengths, self.tokens = lengths.astype(np.int64), tokens.astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        got = [unpack(x) for x in back]
        own = [np.cumsum(g[0], dtype=np.int64) for g in got]
        n = sum(map(len, own))
        self.words, self.c = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, (_, number, c) in zip(own, got):
            self.words[i], self.c[i] = number, c
        # Of each token, in the order reached: its n-gram's code and count, the scale of its context, its probability.
        self.code, self.count, self.scale, self.p = self.tokens, self.c[self.tokens], None, about.unigrams(self.c)[self.tokens]
        if about.last > 1:
            self._next()

    def _before(self, x: np.ndarray, start: int) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.begins] = start
        return out

    def _next(self) -> None:
        """The n-grams of the next order whose contexts were seen in training: positions, kinds, contexts, parts."""
        seen = self._before(self.count, self.about.starts)
        self.at = np.flatnonzero(seen > 0)
        context = self._before(self.code, int(self.code.max(initial=0)) + 1)[self.at]
        self.sorted, begin, self.kind = grouped(context * len(self.words) + self.tokens[self.at])
        self.first = self.at[self.sorted[begin]]
        self.context, self.runs = context[self.sorted[begin]], np.diff(np.append(begin, len(self.at)))
        self.word, self.before, shifted = self.words[self.tokens[self.first]], [], self.words[self.tokens]
        for _ in range(self.n):
            shifted = self._before(shifted, START)
            self.before.append(shifted[self.first])
        mixed = np.zeros(len(self.first), np.uint64)
        for x in self.before:
            mixed = scattered(mixed + scattered(x))
        total = seen[self.first]
        spread = (total // self.about.wide + 1).astype(np.uint64)
        part = scattered(mixed + scattered(self.word) % spread) % np.uint64(self.about.parts)
        self.dealt = Dealt(part.astype(np.int64), total, self.about)

    def deal(self, rounds: int = 1, at_round: int = 0) -> Iterator[tuple[int, bytes]]:
        """Parts of a round and what goes there: contexts (n-grams of each, whether spread, words, scales of the order below),
        and for each n-gram its word, training count, and count in the order below."""
        trained = np.bincount(self.kind, np.repeat(~self.held, self.lengths)[self.at], len(self.first)).astype(np.int64)
        lower = self.count[self.first]
        for p, i in self.dealt:
            if p % rounds != at_round:
                continue
            at = np.flatnonzero(np.append(True, np.diff(self.context[i]) != 0))
            j = i[at]
            scale = () if self.scale is None else (smallest(self.scale[self.first[j]]),)
            contexts = [smallest(np.diff(np.append(at, len(i)))), self.dealt.total[j] >= self.about.wide, *(smallest(x[j]) for x in self.before), *scale]
            yield p, pack(smallest(self.word[i]), smallest(trained[i]), smallest(lower[i]), *contexts)

    def asks(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts that are spread over parts, a row of words each, and of each n-gram in them the context's row."""
        i = self.dealt.spread
        _, first, row = np.unique(self.context[i], return_index=True, return_inverse=True)
        return np.column_stack([x[i[first]] for x in self.before]), row

    def advance(self, answers: dict[int, bytes], spread: dict[tuple, list[float]]) -> None:
        """Takes what the parts answered and the sums of spread contexts; the block has reached the next order then."""
        asked, row = self.asks()
        sums = np.array([spread[tuple(x)] for x in asked.tolist()], float).reshape(-1, DISCOUNTED + 2)[row]
        self.n += 1
        count, scale, p = self.dealt.probabilities(answers, sums, self.n, self.p[self.first])
        size = len(self.tokens)
        code, counts, scales = np.full(size, len(self.first)), np.zeros(size, np.int64), np.ones(size, np.int64)
        for out, x in ((self.p, p), (counts, count), (scales, scale), (code, np.arange(len(p)))):
            out[self.at] = x[self.kind]
        self.code, self.count, self.scale = code, counts, scales
        if self.n < self.about.last:
            self._next()

    def sums(self, of_tokens: np.ndarray) -> np.ndarray:
        """Of each text the sum over its tokens."""
        return np.add.reduceat(of_tokens, self.begins)

    def base(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: whether held out, tokens, known tokens, base score."""
        logs = np.log10((self.c + 0.1) / (self.about.unigrams.total + 0.1 * (self.about.kinds + 1)))
        return self.held, self.lengths, self.sums((self.c > 0)[self.tokens].astype(np.int64)), self.sums(logs[self.tokens])

def _scores(ids: np.ndarray, some: np.ndarray, base: tuple, logs: np.ndarray, about: Order) -> pd.DataFrame:
    out = pd.DataFrame(dict(zip(("held_out", "n_tokens", "n_known", "base_score"), base)) | {"train_tokens": about.unigrams.total, "score": logs})
    out.insert(0, "doc_id", pd.arrays.IntegerArray(ids.copy(), ~some))
    return out[[x.split()[0] for x in SCORES.split(", ")]]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def answered(pdf: pd.DataFrame, n: int, about: Order, store: bool) -> Iterator[tuple]:
    """Of the n-grams of one part from all blocks, rows of ANSWERS: what each block gets, counts of counts, sums of contexts
    that are spread over parts, and (in a model that is stored) the n-grams."""
    part, blocks, context = int(pdf["part"].iloc[0]), pdf["block"].tolist(), [[] for _ in range(n - 1)]
    word, trained, c, each, wide, lower = [], [], [], [], [], []
    for data in pdf["data"]:
        w, t, c_i, k, wide_i, *more = unpack(data)
        for all_, x in ((word, w), (trained, t), (c, c_i), (each, k), (wide, wide_i), *zip(context, more), *((lower, x) for x in more[n - 1 :])):
            all_.append(x)
    sizes = list(map(len, word))
    of, context = np.zeros(sum(map(len, each)), np.int64), [np.concatenate(x).astype(np.int64) for x in context]
    for x in context:
        _, begin, of = grouped(of * (int(x.max(initial=0)) + 1) + x)
    contexts = len(begin)
    at = np.empty(contexts, np.int64)
    at[of] = np.arange(len(of))
    wide, context = np.concatenate(wide)[at], [x[at] for x in context]
    scale = np.concatenate(lower).astype(np.int64)[at] if lower else None
    of = np.repeat(of, np.concatenate(each))
    word = np.concatenate(word).astype(np.int64)
    order, begin, kind = grouped(of * (int(word.max(initial=0)) + 1) + word)
    first = order[begin]
    del order
    count = np.bincount(kind, np.concatenate(trained), len(first)).astype(np.int64)
    own, c = of[first], np.concatenate(c).astype(np.int64)[first]
    below = about.unigrams(c) if n == 2 else discounted(c, about.d[n - 1]) / scale[own]
    seen, sums = count > 0, np.zeros((contexts, DISCOUNTED + 2))
    for r in range(1, DISCOUNTED + 1):
        sums[:, r - 1] = np.bincount(own[count == r], minlength=contexts)
    high = count > DISCOUNTED
    sums[:, DISCOUNTED] = np.bincount(own[high], count[high], contexts)
    sums[:, DISCOUNTED + 1] = np.bincount(own[seen], below[seen], contexts)
    mask = ((sums[:, :DISCOUNTED] > 0) @ (1 << np.arange(DISCOUNTED))).astype(np.uint8)
    at = 0
    for block, size in zip(blocks, sizes):
        i, k = count[kind[at : at + size]], of[at : at + size]
        s = sums[k[(i == 0) & ~wide[k]]]
        *counts, high = (smallest(s[:, j].astype(np.int64)) for j in range(DISCOUNTED + 1))
        yield part, block, pack(smallest(i), mask[k], high, s[:, -1], *counts), None, None, None
        at += size
    yield part, None, None, counted(count), None, None
    for i in np.flatnonzero(wide):
        yield part, None, None, None, [int(x[i]) for x in context], sums[i].tolist()
    if store:
        yield part, -1, pack(*context, own[seen], word[first][seen], count[seen], sums.ravel()), None, None, None


ANSWERS = "part long, block long, data binary, stats array<long>, context array<long>, sums array<double>"
#: Contexts that a block asks for go under this number, as they are for no part.
ASKED = -1
SOURCE = ("block", "ids", "lengths", "held", "tokens", "back", "answers", "spread")


def _by_order(answers, spread) -> tuple[dict[int, dict[int, bytes]], dict[int, dict[tuple, list[float]]]]:
    of_parts, of_contexts = {}, {}
    for x in answers:
        of_parts.setdefault(x["n"], {})[x["part"]] = x["data"]
    for x in spread:
        of_contexts.setdefault(x["n"], {})[tuple(x["context"])] = x["sums"]
    return of_parts, of_contexts


def _reached(row, about: Order) -> Block:
    """A block in the order that its answers reach."""
    out = Block(row.lengths, row.held, row.tokens, list(row.back), about)
    of_parts, of_contexts = _by_order(row.answers, row.spread)
    for n in sorted(about.d):
        out.advance(of_parts.get(n, {}), of_contexts.get(n, {}))
    return out


def _with_answers(blocks_: DataFrame, answers: list[tuple[int, DataFrame]], spread: list[tuple[int, DataFrame]]) -> DataFrame:
    """blocks_ with answers (n, part, data) and spread (n, context, sums)."""
    out = blocks_
    for name, tables, fields in (("answers", answers, ["part", "data"]), ("spread", spread, ["context", "sums"])):
        shape = {"answers": "part:long,data:binary", "spread": "context:array<long>,sums:array<double>"}[name]
        none = F.array().cast(f"array<struct<n:int,{shape}>>")
        every = None
        for n, x in tables:
            x = x.select("block", F.struct(F.lit(n).alias("n"), *fields).alias("x"))
            every = x if every is None else every.unionByName(x)
        if every is None:
            out = out.withColumn(name, none)
            continue
        every = every.groupBy("block").agg(F.collect_list("x").alias(name))
        out = out.join(every, "block", "left").withColumn(name, F.coalesce(name, none))
    return out


def scored(docs: DataFrame, order: int = ORDER, store: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    store: a path for the model's tables, a folder for each order, if they are to be kept.
    """
    made, words = blocks(docs)
    tokens = made.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(4, -(-tokens // PART_TOKENS))
    counts = word_counts(words, parts, bool(store))
    *by_count, above, kinds, total = _stats(counts)

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [int((~unpack(x)[0]).sum()) for x in b["held"]]})

    starts = made.select("held").mapInPandas(trained, "n long").agg(F.sum("n")).first()[0] or 0
    dropped(words, "kind=words")
    about = Order(parts, Unigrams(total, np.array([0, *by_count]), above), kinds, starts, order)
    if store:
        counts.where("block is null").select("part", F.col("counts").alias("data")).write.parquet(f"{store}/order=1")
    back = counts.where("block is not null").groupBy("block").agg(F.collect_list("counts").alias("back"))
    whole = made.select("block", "ids", "lengths", "held", "tokens").join(back, "block")

    answers, spread = [], []
    for n in range(2, order + 1):
        rounds, found = ROUNDS if n > 2 else 1, None
        for at_round in range(rounds):

            def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for row in b.itertuples(index=False):
                        own = _reached(row, about)
                        if not at_round and len(asked := own.asks()[0]):
                            yield pd.DataFrame({"part": [ASKED], "block": [row.block], "data": [pack(asked.ravel())]})
                        rows = [(p, row.block, data) for p, data in own.deal(rounds, at_round)]
                        yield pd.DataFrame(rows, columns=["part", "block", "data"])

            def answer(pdf: pd.DataFrame) -> pd.DataFrame:
                rows = []
                if pdf["part"].iloc[0] >= 0:
                    rows = list(answered(pdf, n, about, bool(store)))
                else:
                    for block, data in zip(pdf["block"], pdf["data"]):
                        rows += [(ASKED, block, None, None, x, None) for x in unpack(data)[0].reshape(-1, n - 1).tolist()]
                out = pd.DataFrame(rows, columns=["part", "block", "data", "stats", "context", "sums"])
                return out.astype({"block": "Int64"})

            dealt = _with_answers(whole, answers, spread).select(*SOURCE).mapInPandas(deal, "part long, block long, data binary")
            # What a block asks for is dealt by the block.
            key = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("block"), F.lit(parts))).otherwise(F.col("part")).alias("to")
            made_now = written(dealt.groupBy(key).applyInPandas(answer, ANSWERS), "answers")
            found = made_now if found is None else found.unionByName(made_now)
        *by_count, _, _, _ = _stats(found.where("stats is not null"))
        about.d[n] = discounts(np.array([0, *by_count]))
        sums = found.where("sums is not null").groupBy("context")
        sums = sums.agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(DISCOUNTED + 2))).alias("sums"))
        asks = found.where(F.col("part") == ASKED).select("context", "block")
        spread.append((n, written(asks.join(sums, "context").select("block", "context", "sums"), "spread")))
        answers.append((n, found.where("part >= 0 and block >= 0").select("block", "part", "data")))
        if store:
            found.where("block = -1").select("part", "data").write.parquet(f"{store}/order={n}")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                own, some = _reached(row, about), ~pd.isna(row.ids)
                yield _scores(np.where(some, row.ids, 0).astype(np.int64), some, own.base(), own.sums(np.log10(own.p)), about)

    return _with_answers(whole, answers, spread).select(*SOURCE).mapInPandas(finish, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
