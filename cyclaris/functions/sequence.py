"""Column functions on circular nucleotide sequences, kept as upper-case strings over A, C, G, T and the IUPAC codes.

All of them are built-in expressions. A null sequence gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements (S, W and N are their own).
IUPAC, COMPLEMENT = "ACGTRYKMBDHV", "TGCAYRMKVHDB"
BASES = "ACGT"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _int(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def length(seq: Column | str) -> Column:
    return F.length(_col(seq)).cast("long")


def shift(seq: Column | str, k: Column | int) -> Column:
    """S^k: rotation to the left by k, which may be negative or beyond the length."""
    seq = _col(seq)
    by = F.coalesce(F.pmod(_int(k), F.nullif(F.length(seq), F.lit(0))), F.lit(0)).cast("int")
    return F.concat(seq.substr(by + 1, F.length(seq)), seq.substr(F.lit(1), by))


def reverse(seq: Column | str) -> Column:
    return F.reverse(_col(seq))


def complement(seq: Column | str) -> Column:
    return F.translate(_col(seq), IUPAC, COMPLEMENT)


def rev_comp(seq: Column | str) -> Column:
    return complement(reverse(seq))


def letters(seq: Column | str) -> Column:
    return F.split(_col(seq), "")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of places that differ; sequences of unequal lengths raise an error."""
    a, b = _col(a), _col(b)
    differ = F.filter(F.zip_with(letters(a), letters(b), lambda p, q: p != q), lambda x: x)
    wrong = F.raise_error(F.lit("sequences have unequal lengths"))
    return F.when(F.length(a) != F.length(b), wrong.cast("long")).otherwise(F.size(differ).cast("long"))


def gc_content(seq: Column | str) -> Column:
    """Share of the letters G and C; ambiguous letters count in the length; 0 for an empty sequence."""
    seq = _col(seq)
    n = F.length(seq)
    gc = n - F.length(F.translate(seq, "GC", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(gc / F.nullif(n, F.lit(0)))


def is_dna(seq: Column | str) -> Column:
    """Whether a sequence has A, C, G and T only."""
    return _col(seq).rlike("^[ACGT]*$")


def base_codes(seq: Column | str) -> Column:
    """A, C, G, T as 0 to 3; another letter raises an error."""
    seq = _col(seq)
    codes = F.transform(F.filter(letters(seq), lambda c: c != ""), lambda c: (F.position(c, F.lit(BASES)) - 1).cast("int"))
    wrong = F.raise_error(F.lit("not a sequence of A, C, G, T"))
    return F.when(is_dna(seq), codes).otherwise(F.when(seq.isNotNull(), wrong.cast("array<int>")))


def complement_code(code: Column | str) -> Column:
    """The code of the complementary base."""
    return _col(code).bitwiseXOR(F.lit(3))


def gc_shuffle(seq: Column | str, seed: int = 42) -> Column:
    """A random permutation of the letters, which keeps the composition: the null model."""
    return F.array_join(F.shuffle(letters(seq), seed), "")
