"""Exact symmetry under the dihedral group of shifts and reversed shifts, by closed forms.

A sequence w is fixed by S^k exactly if w stands at offset k in ww, and its reversal is a rotation of it exactly if it
stands in ww. So period and orbit take one search in a doubled string, without making the 2n transforms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions.sequence import _col, rev_comp, reverse, shift


@F.pandas_udf(LongType())
def _period(seqs: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else max(1, (s + s).find(s, 1)) for s in seqs], dtype="Int64")


@F.pandas_udf(LongType())
def _classes(seqs: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else 2 - (s[::-1] in s + s) for s in seqs], dtype="Int64")


def rotational_period(seq: Column | str, strategy: str = "sql") -> Column:
    """Least k > 0 with S^k w = w; 1 for an empty sequence.

    The "sql" plan searches letter by letter, n * n steps at worst (long runs of one letter with an odd one), and stays in
    the JVM; "arrow" searches in linear time whatever the letters, for long sequences full of repeats.
    """
    seq = _col(seq)
    if strategy == "arrow":
        return _period(seq)
    found = F.position(seq, F.concat(seq, seq), F.lit(2)) - 1
    return F.when(F.length(seq) == 0, F.lit(1)).otherwise(found).cast("long")


def orbit_size(seq: Column | str, strategy: str = "sql") -> Column:
    """Number of distinct transforms; 0 for an empty sequence."""
    seq = _col(seq)
    if strategy == "arrow":
        return F.when(F.length(seq) == 0, F.lit(0)).otherwise(_period(seq) * _classes(seq)).cast("long")
    classes = F.when(F.position(reverse(seq), F.concat(seq, seq)) > 0, 1).otherwise(2)
    return F.when(F.length(seq) == 0, F.lit(0)).otherwise(rotational_period(seq) * classes).cast("long")


def orbit_ratio(seq: Column | str, strategy: str = "sql") -> Column:
    """orbit_size / 2n; 1 for an empty sequence."""
    seq = _col(seq)
    n = F.length(seq)
    return F.when(n == 0, F.lit(1.0)).otherwise(orbit_size(seq, strategy) / F.nullif(2 * n, F.lit(0)))


def is_palindrome(seq: Column | str) -> Column:
    return _col(seq) == reverse(seq)


def is_rc_fixed(seq: Column | str) -> Column:
    return _col(seq) == rev_comp(seq)


def orbit(seq: Column | str) -> Column:
    """The distinct transforms as an array; for short sequences, as it has n letters in each of up to 2n members."""
    seq = _col(seq)
    ks = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)))
    both = F.concat(F.transform(ks, lambda k: shift(seq, k)), F.transform(ks, lambda k: shift(reverse(seq), k)))
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def least_rotation(s: str) -> str:
    """The first rotation of a text in the order of its letters, in linear time: of two candidate places, the one that loses a
    comparison leaves out all places up to where it lost."""
    n, i, j, k = len(s), 0, 1, 0
    t = s + s
    while i < n and j < n and k < n:
        a, b = t[i + k], t[j + k]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        j += i == j
        k = 0
    at = min(i, j)
    return t[at : at + n]


@F.pandas_udf(StringType())
def _orbit_key(seqs: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else min(least_rotation(s), least_rotation(s[::-1])) for s in seqs], dtype=object)


def orbit_key(seq: Column | str, strategy: str = "arrow") -> Column:
    """The first member of a sequence's orbit, which all sequences of the orbit share: to group by, without their members.

    "arrow" takes linear time; "sql" compares all 2n members, without Python, for short sequences.
    """
    seq = _col(seq)
    if strategy == "arrow":
        return _orbit_key(seq)
    return F.when(F.length(seq) == 0, F.lit("")).when(seq.isNotNull(), F.array_min(orbit(seq)))


def distinct_orbits(df: DataFrame, seq: str = "seq", strategy: str = "arrow") -> DataFrame:
    """orbit_key, n_rows and n_sequences (distinct ones) of each orbit that the sequences of df fall into."""
    keyed = df.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("_s")).agg(F.count("*").alias("n"))
    keyed = keyed.select(orbit_key("_s", strategy).alias("orbit_key"), "n")
    return keyed.groupBy("orbit_key").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_sequences"))


def symmetry_stats(seq: Column | str, strategy: str = "sql") -> dict[str, Column]:
    """The six metrics by name."""
    return {
        "length": F.length(_col(seq)).cast("long"),
        "orbit_size": orbit_size(seq, strategy),
        "orbit_ratio": orbit_ratio(seq, strategy),
        "is_palindrome": is_palindrome(seq),
        "is_rc_fixed": is_rc_fixed(seq),
        "rotational_period": rotational_period(seq, strategy),
    }


def with_symmetry_stats(df: DataFrame, seq: str = "seq", strategy: str = "sql") -> DataFrame:
    return df.withColumns(symmetry_stats(seq, strategy))
