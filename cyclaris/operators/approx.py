"""Approximate symmetry: the least Hamming distance of a sequence to a transform of it, and the transform that has it.

The transforms are S^k (k from 1), S^k R and, unless left out, S^k RC (k from 0). Ties go to the first of these families
and then to the smallest k. Three plans give the same results:

    arrow    circular correlation by FFT over batches of equal lengths, n log n each; the default
    sql      higher-order functions, n * n, without Python
    explode  one row a transform and a grouped minimum, for relational use; n * n letters a sequence, by definition

Letters are code points; any that has no complement is its own, in all three plans alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.sequence import COMPLEMENT, IUPAC, _col, hamming, letters, rev_comp, reverse, shift

FAMILIES = ("SHIFT", "REVERSE_SHIFT", "RC_SHIFT")
NEAREST = StructType([StructField("family", StringType()), StructField("k", LongType()), StructField("distance", LongType())])
#: The complement of each code point under 128; others are their own.
_COMPLEMENT = np.arange(128, dtype=np.uint32)
_COMPLEMENT[list(IUPAC.encode())] = list(COMPLEMENT.encode())
#: Letters of a batch of one length that are correlated at once.
_AT_ONCE = 1 << 20


def _transform_length(n: int) -> int:
    """n if it has small prime factors only; else the least such length that two sequences of n letters fit in."""

    def rest(x: int) -> int:
        for p in (2, 3, 5, 7):
            while x % p == 0:
                x //= p
        return x

    if n < 64 or rest(n) == 1:
        return n
    length = 2 * n
    while rest(length) > 1:
        length += 1
    return length


def _nearest(rows: np.ndarray, include_rc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """family, k, distance for sequences of one length, a row of code points each."""
    m, n = rows.shape
    if n == 0:
        zero = np.zeros(m, np.int64)
        return zero, zero, zero
    size = _transform_length(n)
    # A reversed sequence has the conjugate spectrum, each frequency turned, and a complement trades letters in pairs: so a transform for
    # each letter gives the spectra of all images, and sums of products one inverse transform for each family.
    sums: list = [0.0] * (3 if include_rc else 2)
    found = set(np.unique(rows).tolist())
    while found:
        letter = found.pop()
        other = int(_COMPLEMENT[letter]) if include_rc and letter < 128 else letter
        pair = [np.fft.rfft(rows == x, size, axis=1) for x in ([letter] if other == letter else [letter, other])]
        found.discard(other)
        for x in pair:
            sums[0] = sums[0] + (x.real**2 + x.imag**2)
            sums[1] = sums[1] + x * x
        if include_rc:
            sums[2] = sums[2] + len(pair) * (pair[0] * pair[-1])
    turn = np.exp(-2j * np.pi / size * (np.arange(size // 2 + 1) * (n - 1) % size))
    matches = [np.fft.irfft(x if i == 0 else np.conj(x) * turn, size, axis=1) for i, x in enumerate(sums)]
    if size > n:  # the letters that a turn takes round the end
        matches = [x[:, :n] + x[:, size - n :] for x in matches]
    distance = n - np.rint(np.stack(matches, axis=1)).astype(np.int64)
    distance[:, 0, 0] = n + 1  # the identity
    flat = distance.reshape(m, -1)
    best = flat.argmin(axis=1)
    value = flat[np.arange(m), best]
    none = value >= n  # then the start of the search stands: SHIFT by 1
    return np.where(none, 0, best // n), np.where(none, 1, best % n), np.minimum(value, n)


def nearest_of(seqs: list[str | None], include_rc: bool) -> list[tuple[str, int, int] | None]:
    out: list[tuple[str, int, int] | None] = [None] * len(seqs)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(seqs):
        if s is not None:
            by_length.setdefault(len(s), []).append(i)
    for n, members in by_length.items():
        step = max(1, _AT_ONCE // max(n, 1))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            rows = np.frombuffer("".join(seqs[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), n)
            for i, f, k, d in zip(part, *_nearest(rows, include_rc)):
                out[i] = (FAMILIES[f], int(k), int(d))
    return out


def _udf(include_rc: bool):
    @F.pandas_udf(NEAREST)
    def nearest(seqs: pd.Series) -> pd.DataFrame:
        found = nearest_of(seqs.tolist(), include_rc)
        rows = [x or (None, None, None) for x in found]
        frame = pd.DataFrame(rows, columns=["family", "k", "distance"])
        return frame.astype({"k": "Int64", "distance": "Int64"})

    return nearest


def _candidates(seq: Column, include_rc: bool) -> Column:
    """(distance, family number, k) of every transform, and the start of the search."""
    n, own = F.length(seq), letters(seq)
    ks = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def family(number: int, image: Column) -> Column:
        def at(k: Column) -> Column:
            moved = F.concat(F.slice(image, k + 1, F.greatest(n, F.lit(1))), F.slice(image, 1, k))
            differ = F.size(F.filter(F.zip_with(own, moved, lambda p, q: p != q), lambda x: x))
            return F.struct(differ.cast("long").alias("distance"), F.lit(number).alias("f"), k.cast("long").alias("k"))

        return F.transform(ks, at)

    start = F.array(F.struct(n.cast("long").alias("distance"), F.lit(-1).alias("f"), F.lit(1).cast("long").alias("k")))
    shifts = F.filter(family(0, own), lambda x: x["k"] > 0)
    parts = [start, shifts, family(1, F.reverse(own))]
    if include_rc:
        parts.append(family(2, letters(rev_comp(seq))))
    return F.concat(*parts)


def _decoded(best: Column, n: Column) -> Column:
    names = F.array(*(F.lit(x) for x in FAMILIES))
    found = F.struct(
        names[F.greatest(best["f"], F.lit(0))].alias("family"), best["k"].alias("k"), best["distance"].alias("distance")
    )
    zero = F.lit(0).cast("long")
    empty = F.struct(F.lit(FAMILIES[0]).alias("family"), zero.alias("k"), zero.alias("distance"))
    return F.when(n == 0, empty).when(n > 0, found)


def nearest_transform(seq: Column | str, include_rc: bool = True, strategy: str = "arrow") -> Column:
    """The nearest transform as (family, k, distance)."""
    seq = _col(seq)
    if strategy == "arrow":
        return _udf(include_rc)(seq)
    if strategy != "sql":
        raise ValueError("as a column: arrow or sql")
    return _decoded(F.array_min(_candidates(seq, include_rc)), F.length(seq))


def dmin(seq: Column | str, include_rc: bool = True, strategy: str = "arrow") -> Column:
    """The distance of the nearest transform."""
    return nearest_transform(seq, include_rc, strategy)["distance"]


def normalized(distance: Column, seq: Column | str) -> Column:
    n = F.length(_col(seq))
    return F.when(n == 0, F.lit(0.0)).otherwise(distance / F.nullif(n, F.lit(0)))


def dmin_normalized(seq: Column | str, include_rc: bool = True, strategy: str = "arrow") -> Column:
    """dmin / n; 0 for an empty sequence."""
    return normalized(dmin(seq, include_rc, strategy), seq)


def transforms(df: DataFrame, seq: str = "seq", include_rc: bool = True) -> DataFrame:
    """df with one row for each transform of its sequence: family, k, transformed, distance."""
    images = [F.col(seq), reverse(seq)] + ([rev_comp(seq)] if include_rc else [])
    each = F.array(*(F.struct(F.lit(i).alias("_f"), x.alias("_image")) for i, x in enumerate(images)))
    rows = df.where(F.length(seq) > 0).select("*", F.inline(each))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length(seq) - 1)).alias("_k")).where("_f > 0 or _k > 0")
    moved = shift("_image", F.col("_k"))
    names = F.array(*(F.lit(x) for x in FAMILIES))
    return rows.withColumns(
        {"family": names[F.col("_f")], "k": F.col("_k").cast("long"), "transformed": moved, "distance": hamming(seq, moved)}
    ).drop("_f", "_image", "_k")


def with_nearest(df: DataFrame, seq: str = "seq", include_rc: bool = True, strategy: str = "arrow", key: list[str] | None = None) -> DataFrame:
    """df with nearest_family, nearest_k, dmin and dmin_normalized. The explode plan needs a key of df."""
    if strategy == "explode":
        if not key:
            raise ValueError("the explode plan needs a key")
        number = F.array_position(F.array(*(F.lit(x) for x in FAMILIES)), F.col("family")) - 1
        best = F.min(F.struct("distance", number.cast("int").alias("f"), "k")).alias("_b")
        found = transforms(df, seq, include_rc).groupBy(*key).agg(best)
        start = F.struct(F.length(seq).cast("long").alias("distance"), F.lit(-1).alias("f"), F.lit(1).cast("long").alias("k"))
        made = df.join(found, key, "left").withColumn("_n", _decoded(F.least(F.coalesce("_b", start), start), F.length(seq))).drop("_b")
    else:
        made = df.withColumn("_n", nearest_transform(seq, include_rc, strategy))
    return made.withColumns(
        {
            "nearest_family": F.col("_n.family"), "nearest_k": F.col("_n.k"), "dmin": F.col("_n.distance"),
            "dmin_normalized": normalized(F.col("_n.distance"), seq),
        }
    ).drop("_n")
