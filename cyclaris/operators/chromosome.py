"""The nearest transform of sequences too long for one row's transform, by correlation in blocks.

A sequence comes as fragments, and each fragment goes through one shuffle, to the task of its sequence. A sequence of up to `WHOLE`
blocks of B letters is transformed as one row. A longer one is correlated in blocks: for each family of transforms and each block
of B lags all blocks of the sequence with the letters that lie so far on (overlap-save: B letters against 2 B). The spectra of
the blocks are added up before the one inverse transform, so a task holds the sequence as one byte a letter, spectra of
2 B letters (one row: of `WHOLE` B), and nothing that grows with both.

Families and blocks of lags of a sequence are dealt to several tasks, each with a copy of its letters, only as far as it
has more than its share of the work: the work of all sequences is cut into some `TASKS` parts. So fewer than `TASKS` copies are made
beyond the letters themselves, however many sequences there are and however long they are.

The work of a long sequence is n / B transforms of 2 B letters for each letter of the alphabet, family and lag block: larger blocks mean
less work and more memory (about 100 bytes a letter of a block). Results equal approx.nearest_transform, ties included.

Defined cases: letters are bytes, as `fasta_ranges` gives them, any without complement is its own; a sequence without letters has
(SHIFT, 0, 0); fragments may be of any length, empty ones too, and must have a place that orders them; a null key is a
key; an empty table gives an empty result. A sequence may have up to 2 GB, less what a worker's memory lacks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .approx import _COMPLEMENT, _decoded, _nearest

BLOCK = 1 << 20
#: Blocks of a sequence that is transformed as one row.
WHOLE = 4
#: Into how many parts the work of all sequences is cut.
TASKS = 256


def blocks(found: DataFrame, key: str, place: str = "place", seq: str = "seq", size: int = BLOCK) -> DataFrame:
    """key, block (from 0), seq: the letters of fragments (key, place, seq) in blocks of equal size, the last one of a key shorter."""
    rows = found.select(F.col(key).alias("key"), F.col(place).alias("place"), F.coalesce(F.col(seq), F.lit("")).alias("seq"))
    # Only lengths are sorted by place; a key has a row for each fragment.
    before = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select("key", "place", F.length("seq").cast("long").alias("n")).withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("place") == F.col("_place"))
    placed = rows.join(offsets.select(F.col("key").alias("_key"), F.col("place").alias("_place"), "at", "n"), same)
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.greatest("n", F.lit(1)) - 1) / size)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * size - F.col("at"), F.col("n"))
    piece = F.col("seq").substr((start + 1).cast("int"), (end - start).cast("int"))
    pieces = cut.select("key", "block", (F.col("at") + start).alias("at"), piece.alias("seq"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "")
    return pieces.groupBy("key", "block").agg(joined.alias("seq"))


def best_lag(w: np.ndarray, family: int, lag_block: int, size: int) -> tuple[int, int]:
    """The least distance, and the first k that has it, of the transforms k of a family in a block of lags; w: letters as bytes."""
    n = len(w)
    image = w if family == 0 else w[::-1]
    if family == 2:
        image = np.where(image < 128, _COMPLEMENT[np.minimum(image, 127)], image).astype(np.uint8)
    total = np.zeros(size + 1, np.complex128)
    letters = np.unique(w)
    for at in range(0, n, size):
        own = w[at : at + size]
        start = (at + lag_block * size) % n
        on = image[start : start + 2 * size]
        if len(on) < 2 * size:
            on = np.take(image, np.arange(start, start + 2 * size), mode="wrap")
        for letter in letters:
            total += np.conj(np.fft.rfft(own == letter, 2 * size)) * np.fft.rfft(on == letter)
    k = lag_block * size
    matches = np.rint(np.fft.irfft(total, 2 * size)[: min(size, n - k)]).astype(np.int64)
    if family == 0 and k == 0:
        matches[0] = -1  # the identity
    best = int(matches.argmax())
    return n - int(matches[best]), k + best


def nearest(found: DataFrame, key: str, place: str = "place", seq: str = "seq", include_rc: bool = True, size: int = BLOCK) -> DataFrame:
    """key, length, nearest_family, nearest_k, dmin, dmin_normalized of the sequences whose fragments are given."""
    rows = found.select(F.col(key).alias("key"), F.col(place).alias("place"), F.coalesce(F.col(seq), F.lit("")).alias("seq"))
    kind = rows.schema["key"].dataType.simpleString()
    families = 3 if include_rc else 2
    # A row for each sequence that is dealt to several tasks, fewer than TASKS.
    m = F.ceil(F.col("n") / size)
    work = rows.groupBy("key").agg(F.sum(F.length("seq")).cast("long").alias("n")).where(m > WHOLE).select("key", (families * m).alias("pairs"), (families * m * m).cast("double").alias("work"))
    shares = work.crossJoin(F.broadcast(work.agg(F.sum("work").alias("all"))))
    parts = F.least(F.col("pairs"), F.ceil(F.col("work") * TASKS / F.col("all")))
    heavy = shares.select(F.col("key").alias("_key"), parts.alias("parts")).where("parts > 1")

    def search(group: pa.Table) -> pa.Table:
        w = np.frombuffer("".join(group.sort_by("nth").column("seq").to_pylist()).encode("latin-1", "replace"), np.uint8)
        n, part, parts = len(w), group.column("part")[0].as_py(), group.column("parts")[0].as_py()
        best = None
        if 0 < n <= WHOLE * size:
            f, k, d = (int(x[0]) for x in _nearest(w[None, :].astype(np.uint32), include_rc))
            best = d, f, k
        elif n:
            pairs = [(f, lag_block) for f in range(families) for lag_block in range(-(-n // size))]
            best = min((d, f, k) for f, lag_block in pairs[part::parts] for d, k in [best_lag(w, f, lag_block, size)])
        d, f, k = best or (None, None, None)
        return pa.table({"key": group.column("key").slice(0, 1).combine_chunks(), "n": pa.array([n], pa.int64()), "distance": pa.array([d], pa.int64()), "f": pa.array([f], pa.int32()), "k": pa.array([k], pa.int64())})

    copied = rows.join(F.broadcast(heavy), F.col("key").eqNullSafe(F.col("_key")), "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = copied.select("key", "place", "seq", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # Numbered where they are grouped, so that a place may be of any type that Spark orders.
    placed = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("key", "part").orderBy("place"))).drop("place")
    each = placed.groupBy("key", "part").applyInArrow(search, f"key {kind}, n long, distance long, f int, k long")
    made = each.groupBy("key").agg(F.max("n").alias("n"), F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "f", "k"))).alias("b"))
    start = F.struct(F.col("n").alias("distance"), F.lit(-1).alias("f"), F.lit(1).cast("long").alias("k"))
    nearest_of = _decoded(F.least(F.coalesce("b", start), start), F.col("n"))
    made = made.select(F.col("key").alias(key), F.col("n").alias("length"), nearest_of.alias("_n"))
    share = F.when(F.col("length") == 0, 0.0).otherwise(F.col("_n.distance") / F.nullif("length", F.lit(0)))
    return made.select(key, "length", F.col("_n.family").alias("nearest_family"), F.col("_n.k").alias("nearest_k"), F.col("_n.distance").alias("dmin"), share.alias("dmin_normalized"))

