"""Best-fit decreasing packing of token sequences, exact over any number of documents.

Lengths lie in 1..capacity, so the packing of all pieces follows from the histogram of lengths alone. The driver packs
that histogram (at most `capacity` numbers): runs of equal pieces go into runs of equal bins, and a segment tree over
remaining capacities gives the tightest open bin in logarithmic time. The result is a list of rules, a few for each
length; an executor turns a piece's rank among the pieces of its length into its bin and offset. No pieces are gathered
anywhere, and a length that a third of all pieces share costs nothing extra.

Defined cases: a null text counts as empty; an empty text is one piece of one token (the end id). A very long text is
encoded whole and cut into pieces of the capacity. Repeated rows are
packed each on its own; null ids are kept. An empty table gives an empty result. Columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CAPACITY, END_ID = 1024, 2
#: Rows of (task, length, number) up to which they are broadcast, a few MB; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them for the file `path`.

    The merges run in tiktoken over the same vocabulary (`path` with .tiktoken at its end), about four times as fast;
    a text that its pattern engine gives up on goes through the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def _slowly(self, text: str) -> bytes:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_padding()
            self.slow.no_truncation()
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:  # the engine's stack ran out, or the text can't be encoded, which the library then says
            return self._slowly(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of each document; task and nth count the pieces of one length within a task."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = encode(text or "") + end
                n, at, k = len(ids) // 4, 0, 0
                size = n % capacity or capacity
                while at < n:
                    rows.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), task, seen[size]))
                    seen[size] += 1
                    at, k, size = at + size, k + 1, capacity
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.mapInPandas(cut, PIECES)


class TightestBin:
    """A segment tree over remaining capacities 0..n that counts the runs of open bins of each."""

    def __init__(self, n: int) -> None:
        self.width = 1 << n.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, remaining: int, by: int) -> None:
        i = remaining + self.width
        while i:
            self.count[i] += by
            i //= 2

    def at_least(self, size: int) -> int | None:
        """The smallest remaining capacity of an open bin that is not under size."""
        i = size + self.width
        if self.count[i]:
            return size
        while i > 1 and (i % 2 or not self.count[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.width:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.width


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Best-fit decreasing for histogram[length] pieces of each length: rules and the number of bins.

    A rule: pieces first..last-1 of a length fill bins from `bin` on, `each` pieces to a bin, the first at `offset`.
    """
    tree, runs, rules, bins = TightestBin(capacity), {}, [], 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            if (r := tree.at_least(size)) is None:
                # Each new bin takes pieces until none fits: it is the tightest open bin as soon as it is opened.
                each = capacity // size
                n = -(-left // each)
                tree.add(capacity, 1)
                runs.setdefault(capacity, []).append((bins, n))
                bins += n
                continue
            start, n = runs[r].pop()
            tree.add(r, -1)
            each = r // size
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each if full * each < left else 0
            for at, count, k in ((start, full, each), (start + full, 1 if rest else 0, rest)):
                if count:
                    rules.append((size, rank, rank + count * k, at, k, capacity - r))
                    rank += count * k
                    left -= count * k
                    if r - k * size:
                        runs.setdefault(r - k * size, []).append((at, count))
                        tree.add(r - k * size, 1)
            used = full + bool(rest)
            if used < n:
                runs.setdefault(r, []).append((start + used, n - used))
                tree.add(r, 1)
    made = np.array(rules, np.int64).reshape(-1, 6)
    return dict(zip(("size", "first", "last", "bin", "each", "offset"), made.T)), bins


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    rules, _ = plan(histogram, capacity)
    order = np.lexsort((rules["first"], rules["size"]))
    rules = {k: v[order] for k, v in rules.items()}
    lows = spark.sparkContext.broadcast((rules, rules["size"] * (1 << 48) + rules["first"]))
    # One row for each task and length, so a length's window has as many rows as there are tasks.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    if counts.count() <= BROADCAST_ROWS:
        ahead = F.broadcast(ahead)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, keys = lows.value
        for b in batches:
            rank, size = (b["ahead"] + b["nth"]).to_numpy(), b["length"].to_numpy()
            i = np.searchsorted(keys, size * (1 << 48) + rank, side="right") - 1
            t = rank - rule["first"][i]
            b["sequence_id"] = rule["bin"][i] + t // rule["each"][i]
            b["offset"] = rule["offset"][i] + t % rule["each"][i] * size
            yield b.drop(columns=["task", "nth", "ahead"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ahead"]
    return cut.join(ahead, ["task", "length"]).select(*columns).mapInPandas(place, schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
