"""SimHash near-duplicates: whole-text fingerprints, and all pairs of them within a radius, as components.

Fingerprints are deduplicated first, so copies cost nothing further. Two fingerprints within `RADIUS` bits agree on at
least one of RADIUS + 1 blocks of bits, so rows are dealt out by (block, its value). The number of blocks grows with the
number of fingerprints: of b blocks, every choice of b - RADIUS that can agree is a key. A key with too many rows is cut
again by the blocks of its remaining bits, which loses no pair either, until it fits. Within a bucket, fingerprints stand as bit planes:
64 of them to a word. A query's distances to all of them come from carry-save counters over the planes; a stretch of
planes is left as soon as all its distances exceed the radius. The bucket is searched breadth first, each fingerprint
against those not yet reached, so a dense group costs few passes and gives a tree of links, not all its pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint zero, which links like any other; a
text of fewer words than a shingle is one shingle; a very long text is hashed whole, its bits counted in pieces; repeated rows are members of the same component; a null id is carried,
and never is a component's id unless all its members' are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import looked_up, table, written
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Rows of a bucket beyond which it is cut again; the search copes with any size.
BUCKET_ROWS = 20_000
#: Planes that are counted before the distances are looked at, and words that are left together.
PLANES_AT_ONCE, WORDS_AT_ONCE, QUERIES = 16, 64, 64


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    hashes = np.fromiter(
        (digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """The fingerprints of texts, as signed longs."""
    return pd.Series(np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(F.col("text").cast("string")).alias("fp"))


def _unpacked(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row i has bit i of every fingerprint, 64 fingerprints to a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the n fingerprints in planes are within the radius of each query: a row of n booleans for each."""
    words = planes.shape[1]
    near = np.zeros((len(queries), words), np.uint64)
    flip = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    digits = (radius + 1).bit_length()
    for low in range(0, words, WORDS_AT_ONCE):
        part = planes[:, low : low + WORDS_AT_ONCE]
        alive = np.arange(len(queries))
        counters = [np.zeros((len(alive), part.shape[1]), np.uint64) for _ in range(digits)]
        over = np.zeros((len(alive), part.shape[1]), np.uint64)
        for first in range(0, 64, PLANES_AT_ONCE):
            for i in range(first, first + PLANES_AT_ONCE):
                carry = part[i] ^ flip[alive, i, None]
                for k in range(digits):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                over |= carry
            # More than the radius: the counter is beyond it, or has run over.
            more, equal = np.zeros_like(over), np.full_like(over, ~np.uint64(0))
            for k in reversed(range(digits)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    more |= equal & counters[k]
                    equal &= ~counters[k]
            far = over | more
            keep = ~(far == ~np.uint64(0)).all(axis=1)
            if not keep.all():
                alive, over, far = alive[keep], over[keep], far[keep]
                counters = [c[keep] for c in counters]
            if not len(alive):
                break
        else:
            near[alive, low : low + WORDS_AT_ONCE] = ~far
    return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def starred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links with the same components: from the least of each to every other."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        for side in (i, j):
            np.minimum.at(least, side, low)
            np.minimum.at(least, before[side], low)
        least = least[least]
        if (least == before).all():
            break
    other = least != np.arange(len(nodes))
    return nodes[least[other]], nodes[other]


def forest(fps: np.ndarray, radius: int = RADIUS, pairwise: int = BUCKET_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that join the fingerprints of a bucket exactly as all links within the radius would.

    Up to `pairwise` fingerprints are held against all that follow them. Of more, one component at a time is searched
    breadth first against those not yet reached.
    """
    left, froms, tos = np.unique(fps), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    if len(left) <= pairwise:
        for at in range(0, len(left), QUERIES):
            batch, rest = left[at : at + QUERIES], left[at:]
            found = within(_unpacked(rest), len(rest), batch, radius)
            if not np.triu(found, 1).any():
                continue
            # Members of the batch that reach the same one are joined to the first such member.
            meet = (found.astype(np.float32) @ found.T.astype(np.float32)) > 0
            while (wider := (meet.astype(np.float32) @ meet.astype(np.float32)) > 0).sum() > meet.sum():
                meet = wider
            hit = np.flatnonzero(found.any(axis=0))
            froms += [batch[meet.argmax(axis=1)], batch[found[:, hit].argmax(axis=0)]]
            tos += [batch, rest[hit]]
    else:
        frontier = left[:0]
        while len(left):
            if not len(frontier):
                frontier, left = left[:1], left[1:]
            batch, frontier = frontier[:QUERIES], frontier[QUERIES:]
            found = within(_unpacked(left), len(left), batch, radius)
            hit = found.any(axis=0)
            froms.append(batch[found[:, hit].argmax(axis=0)])
            tos.append(left[hit])
            frontier, left = np.concatenate((frontier, left[hit])), left[~hit]
    return starred(np.concatenate(froms), np.concatenate(tos))


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """The bits in n blocks of nearly equal size."""
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def choices(bits: list[int], n: int, radius: int = RADIUS) -> list[list[int]]:
    """Sets of bits such that two fingerprints within the radius agree on one set at least."""
    cut = blocks(bits, n)
    return [sorted(sum((cut[i] for i in c), [])) for c in combinations(range(n), n - radius)]


def block_count(rows: int) -> int:
    """Blocks so that a bucket of evenly spread fingerprints has few rows: 13, 21, 27 or 32 bits to a key."""
    return 5 if rows < 1 << 23 else 6 if rows < 1 << 31 else 7 if rows < 1 << 37 else 8


def _masked(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between the fingerprints of prints (fp, distinct): those of a forest of all pairs in the radius."""
    sets = choices(list(range(64)), block_count(prints.count()), radius)
    masks = [F.col("fp").bitwiseAND(F.lit(_masked(s))) for s in sets]
    key = F.array(*(F.struct(F.lit(str(i)).alias("path"), m.alias("value")) for i, m in enumerate(masks)))
    rows = prints.select("fp", F.inline(key).alias("path", "value"))
    bits_of = {str(i): s for i, s in enumerate(sets)}
    # Keys of too many rows are cut by blocks of the bits that they don't fix, as two within the radius agree on these. A key
    # that leaves no more bits than the radius has 2 ** radius fingerprints at most.
    depth, done = 0, None
    while True:
        hot = written(rows.groupBy("path", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows), "hot")
        paths = [r[0] for r in hot.select("path").distinct().collect()]  # at most as many as there are sets of bits
        cuts = {}
        for p in paths:
            if len(free := [b for b in range(64) if b not in bits_of[p]]) > radius:
                finer = choices(free, radius + 1, radius)
                cuts[p] = [(f"{p}.{i}", _masked(sorted({*bits_of[p], *s}))) for i, s in enumerate(finer)]
                bits_of |= {f"{p}.{i}": sorted({*bits_of[p], *s}) for i, s in enumerate(finer)}
        if not cuts:
            done = rows if done is None else done.unionByName(rows)
            break
        hot = hot.where(F.col("path").isin(list(cuts))).withColumn("key", F.concat_ws(":", "path", "value"))
        keyed = rows.withColumn("key", F.concat_ws(":", "path", "value"))
        kept = keyed.join(hot.select("key"), "key", "left_anti").drop("key")
        done = kept if done is None else done.unionByName(kept)
        made = F.create_map(*(x for p, c in cuts.items() for x in (F.lit(p), F.array(*(F.struct(F.lit(a).alias("path"), F.lit(m).alias("mask")) for a, m in c)))))
        split = looked_up(keyed.drop("path", "value"), hot, "key").select("fp", F.inline(made[F.col("path")]).alias("path", "mask"))
        rows, depth = written(split.select("fp", "path", F.col("fp").bitwiseAND(F.col("mask")).alias("value")), f"cut-{depth}"), depth + 1

    def search(parts: list[np.ndarray]) -> pd.DataFrame:
        a, b = forest(np.concatenate(parts).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def search_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[np.ndarray] = []
        last = None
        for b in batches:
            path, value, fp = b["path"].to_numpy(), b["value"].to_numpy(np.int64), b["fp"].to_numpy(np.int64)
            ends = [*(np.flatnonzero((path[1:] != path[:-1]) | (value[1:] != value[:-1])) + 1).tolist(), len(fp)]
            for at, end in zip([0, *ends], ends):
                if (key := (path[at], value[at])) != last and rest:
                    if sum(map(len, rest)) > 1:
                        yield search(rest)
                    rest = []
                last = key
                rest.append(fp[at:end])
        if sum(map(len, rest)) > 1:
            yield search(rest)

    dealt = done.repartition("path", "value").sortWithinPartitions("path", "value").select("path", "value", "fp")
    return dealt.mapInPandas(search_all, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each fingerprint in prints (doc_id, fp): n, how many rows have it, its component's smallest fingerprint and
    smallest doc_id."""
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    found = components(links(each.select("fp"), radius), "a", "b")
    named = each.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = written(named.withColumn("component", F.coalesce("component", "fp")), "members")
    # A component may hold a large part of all fingerprints: it is no key of a shuffle then.
    least = written(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "least")
    named = looked_up(named.drop("first"), least, "component", "members")
    return written(named.select("fp", "n", "component", "component_id"), "named")


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component (a fingerprint), component_id (a doc_id)."""
    prints = written(fingerprints(docs), "prints")
    return looked_up(prints, classes(prints, radius), "fp").drop("n")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: of each component that with the smallest doc_id.

    Rows whose doc_id is null or stands in several rows can't be told apart by it; these few get their fingerprints anew.
    """
    groups = written(grouped(docs, radius), "groups")
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("doc_id").isNotNull())
    repeated = written(repeated.select(F.col("doc_id").alias("id")), "repeated")
    lost = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id"))
    lost = written(lost.union(repeated).distinct(), "lost")
    # Rows are carried as one column, so theirs can have any names.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("by"))
    once = rows.where("id is not null").join(lost, "id", "left_anti").select("row")
    others = rows.join(repeated, "id", "left_semi").select("row", "id", "by").union(rows.where("id is null").select("row", "id", "by"))
    others = others.withColumn("fp", fingerprint_of("by"))
    named = groups.groupBy("fp").agg(F.count("*").alias("n"), F.first("component").alias("component"), F.first("component_id").alias("least"))
    others = looked_up(others, written(named, "named"), "fp").where("id <=> least")
    # Equal ids in one component: that with the least text. The minimum is taken before the shuffle, so no key is hot.
    picked = others.groupBy("component").agg(F.min_by("row", F.coalesce("by", F.lit(""))).alias("row"))
    return once.unionByName(picked.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", hexed, "component_id")
