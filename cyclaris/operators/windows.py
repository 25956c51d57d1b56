"""Positional windows over long sequences and their symmetry metrics.

Windows don't wrap around; a short tail is left out; windows with other letters than A, C, G, T are left out unless asked
for. Sequences are cut twice, into chunks and then into windows, so that the work stays linear in the sequence and no row
carries a whole chromosome beyond the first cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .approx import with_nearest
from .exact import symmetry_stats

WINDOW_SIZES = (100, 500, 1000, 5000, 10000)
_PER_CHUNK = 128


def _cut(df: DataFrame, text: str, start: str, size: Column, step: Column, least: Column) -> DataFrame:
    """Rows of pieces of text: size letters (fewer at the end, not under least) at every step; start moves along."""
    at = F.sequence(F.lit(0), F.length(text) - least, step)
    rows = df.where(F.length(text) >= least).select("*", F.explode(at).alias("_at"))
    piece = F.col(text).substr(F.col("_at") + 1, size)
    return rows.withColumns({text: piece, start: F.col(start) + F.col("_at")}).drop("_at")


def windows(df: DataFrame, window: int | tuple[int, ...], step: int | None = None, seq: str = "seq", keep_ambiguous: bool = False) -> DataFrame:
    """df with a row for each window: window_length, window_start (from 0), and the window in place of the sequence.

    Several lengths take one pass over df.
    """
    sizes = (window,) if isinstance(window, int) else window
    each = F.array(*(F.struct(F.lit(w).alias("_w"), F.lit(step or w).alias("_s")) for w in sizes))
    df = df.withColumn("window_start", F.lit(0).cast("long")).select("*", F.inline(each))
    w, s = F.col("_w"), F.col("_s")
    cut = _cut(df, seq, "window_start", s * (_PER_CHUNK - 1) + w, s * _PER_CHUNK, w)
    cut = _cut(cut, seq, "window_start", w, s, w)
    cut = cut.withColumn("window_length", w.cast("long")).drop("_w", "_s")
    return cut if keep_ambiguous else cut.where(F.col(seq).rlike("^[ACGT]+$"))


def window_stats(
    df: DataFrame, sizes: tuple[int, ...] = WINDOW_SIZES, step: int | None = None, key: str = "replicon_id",
    seq: str = "seq", strategy: str = "arrow", keep_ambiguous: bool = False,
) -> DataFrame:
    """The window table: exact and approximate metrics of every window of every size."""
    cut = windows(df.select(key, F.col(seq).alias("seq")), tuple(sizes), step, "seq", keep_ambiguous)
    metrics = symmetry_stats("seq")
    made = with_nearest(cut, "seq", strategy=strategy)
    names = ("orbit_ratio", "is_palindrome", "is_rc_fixed", "orbit_size")
    return made.select(
        key, "window_length", "window_start", *(metrics[n].alias(n) for n in names), "dmin", "dmin_normalized"
    )


def window_summary(table: DataFrame, key: str = "replicon_id") -> DataFrame:
    """Of each sequence and window length: number of windows, least, mean and largest dmin_normalized."""
    mean: Column = F.sum("dmin") / (F.count("*") * F.first("window_length"))
    return table.groupBy(key, "window_length").agg(
        F.count("*").alias("n_windows"),
        F.min("dmin_normalized").alias("min_dmin_normalized"),
        mean.alias("avg_dmin_normalized"),
        F.max("dmin_normalized").alias("max_dmin_normalized"),
    )
