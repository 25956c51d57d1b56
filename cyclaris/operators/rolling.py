"""Symmetry metrics of overlapping windows, from sums that neighbouring windows share.

A window's distance to its shift by k is a sum of mismatches at lag k and at lag n - k, both over a stretch of the sequence, so
prefix sums of mismatches at a lag give it for all windows at once. Its distance to a shifted reversal is that of two
stretches to their own reversals, of n - k letters and of k; these come from stretches two letters shorter, or longer, for all
places at once. So all windows of a sequence, with all their transforms, take some dozen operations on whole vectors for each
k: letters times window length, however much the windows overlap, and no window is made.

The orbit, period, palindromes and fixed points are told from the same distances (those that are 0). Results equal
windows.window_stats, which is the better plan for windows that don't overlap. Short texts of a batch share a vector. Memory is that
of a chunk, some `CHUNK` letters or four windows, and a few vectors of its length.

Defined cases: as for windows: they don't wrap, a short tail is left out, windows with letters other than A, C, G, T are left out
unless asked for (their number is a rolling count); a null or short sequence has no windows; an empty table none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .approx import _COMPLEMENT, FAMILIES
from .windows import _cut

#: Letters of a chunk, or four windows if these are more.
CHUNK = 1 << 16


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(x, dtype=np.int32)), dtype=np.int32)


def _to_reversals(s: np.ndarray, image: np.ndarray, n: int, at: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[np.ndarray]:
    """For k from 0: the distance of the windows of n letters to S^k of their reversal; image: what s is held against; at(x, i):
    x at i places behind the windows' starts."""
    # Letters beyond the ends are unlike all others.
    t = np.pad(s, n, constant_values=np.iinfo(s.dtype).max)
    u = np.pad(image, n, constant_values=np.iinfo(s.dtype).max - 1)
    size = len(t)
    kind = np.int16 if n < 1 << 14 else np.int32

    def ends(length: int) -> np.ndarray:
        """Mismatches that the two ends of each stretch of a length add."""
        differ = (t[: size - length + 1] != u[length - 1 :]).view(np.int8)
        return differ << 1 if length > 1 else differ

    def first() -> list[np.ndarray]:
        return [np.zeros(size + 1, kind), ends(1).astype(kind)]

    # Of stretches of a length, and one less: the distance to their own reversal, by place.
    whole = first()
    for length in range(2, n + 1):
        whole = [whole[1], whole[0][1:-1] + ends(length)]
    longer = [(whole[1], 0), (whole[0], 0)]  # (by place, the first place) of n letters, n - 1, and so on
    shorter = first()
    for k in range(n):
        high, start = longer[k % 2]
        low = shorter[k % 2]
        yield at(high, n - start) + at(low, 2 * n - k)
        length = n - k
        # Two letters fewer: without what the ends of the longer stretch, one place before, have added.
        longer[k % 2] = (high - ends(length)[start : start + len(high)], start + 1)
        shorter[k % 2] = low[1:-1] + ends(k + 2)


def of_windows(s: np.ndarray, n: int, step: int = 1, include_rc: bool = True) -> dict[str, np.ndarray]:
    """The metrics of the windows of n letters at every step of a sequence of code points."""
    places = np.arange(0, len(s) - n + 1, step)
    count = len(places)
    clean = _sums(~np.isin(s, np.frombuffer(b"ACGT", np.uint8)))
    images = [s] + ([np.where(s < 128, _COMPLEMENT[np.minimum(s, 127)], s)] if include_rc else [])
    if len(s) and s.max() < 128:
        images = [x.astype(np.uint8) for x in images]
    s = images[0]

    def at(x: np.ndarray, i: int) -> np.ndarray:
        return x[i : i + step * (count - 1) + 1 : step] if count else x[:0]

    # Distance, family and k in one number, so that the least one is the nearest transform; SHIFT by 1 if all letters differ.
    best = np.full(count, n * 3 * n + 1, np.int32 if n < 1 << 14 else np.int64)
    period = np.full(count, n, np.int32)
    mirrored = np.zeros(count, bool)

    def offered(d: np.ndarray, f: int, k: int) -> None:
        key = d.astype(best.dtype)
        key *= 3 * n
        key += f * n + k
        np.minimum(best, key, out=best)

    for k in range(1, n // 2 + 1):  # S^k and S^(n - k) are as far
        near, far = _sums(s[:-k] != s[k:]), _sums(s[: k - n] != s[n - k :])
        d = at(near, n - k) - at(near, 0) + at(far, k) - at(far, 0)
        offered(d, 0, k)
        if (same := d == 0).any():
            period[same & (period == n)] = k
    fixed = []
    for f, image in enumerate(images, 1):
        for k, d in enumerate(_to_reversals(s, image, n, at)):
            offered(d, f, k)
            if k == 0:
                fixed.append(d == 0)
            if f == 1:
                mirrored |= d == 0
    orbit = period.astype(np.int64) * np.where(mirrored, 1, 2)
    best, rest = np.divmod(best, 3 * n)
    none = best >= n  # then the start of the search stands
    return {
        "at": places, "orbit_size": orbit, "is_palindrome": fixed[0], "is_rc_fixed": fixed[-1], "rotational_period": period.astype(np.int64),
        "family": np.where(none, 0, rest // n).astype(np.int8), "k": np.where(none, 1, rest % n).astype(np.int64), "dmin": best.astype(np.int64),
        "is_clean": at(clean, n) == at(clean, 0),
    }


def _held(text: str, step: int) -> int:
    """The letters that a text takes in a vector where each text begins at a step."""
    return len(text) + -len(text) % step


def _together(texts: Iterable[str], most: int, step: int = 1) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts that take `most` letters in all, or one that takes more; and how many came before them."""
    first, part, letters = 0, [], 0
    for text in texts:
        if part and letters + _held(text, step) > most:
            yield first, part
            first, part, letters = first + len(part), [], 0
        part.append(text)
        letters += _held(text, step)
    if part:
        yield first, part


def of_texts(texts: list[str], n: int, step: int = 1) -> dict[str, np.ndarray]:
    """The metrics of the windows of all texts, in one vector as a short text takes as many operations as a long one; and in "text"
    the number of a window's text. Windows that would reach into the next text are left out."""
    held = [_held(x, step) for x in texts]
    m = of_windows(np.frombuffer("".join(x.ljust(h, "-") for x, h in zip(texts, held)).encode("utf-32-le"), np.uint32), n, step)
    begin = np.cumsum([0, *held])[:-1]
    m["text"] = np.searchsorted(begin, m["at"], "right") - 1
    m["at"] = m["at"] - begin[m["text"]]
    within = m["at"] + n <= np.array([len(x) for x in texts])[m["text"]]
    return {k: v[within] for k, v in m.items()}


def rolling_stats(df: DataFrame, window: int, step: int = 1, key: str = "replicon_id", seq: str = "seq", keep_ambiguous: bool = False) -> DataFrame:
    """The window table for windows that overlap: key, window_length, window_start, orbit_ratio, is_palindrome, is_rc_fixed,
    orbit_size, dmin, dmin_normalized, and besides rotational_period, nearest_family and nearest_k."""
    if window < 1 or step < 1:
        raise ValueError("window and step must be positive")
    starts = max(1, max(CHUNK, 4 * window) // step)
    rows = df.select(F.col(key).alias("id"), F.col(seq).alias("seq"), F.lit(0).cast("long").alias("start"))
    chunks = _cut(rows, "seq", "start", F.lit((starts - 1) * step + window), F.lit(starts * step), F.lit(window))
    kind = df.schema[key].dataType.simpleString()

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts_of = b.column("start").to_numpy()
            for i, texts in _together(b.column("seq").to_pylist(), (starts - 1) * step + window, step):
                m = of_texts(texts, window, step)
                if not keep_ambiguous:
                    m = {k: v[m["is_clean"]] for k, v in m.items()}
                row = m["text"] + i
                names = pa.array(FAMILIES).take(pa.array(m["family"]))
                columns = {
                    "id": b.column("id").take(pa.array(row)), "window_start": m["at"] + starts_of[row], "orbit_ratio": m["orbit_size"] / (2 * window),
                    **{k: m[k] for k in ("is_palindrome", "is_rc_fixed", "orbit_size", "dmin")}, "dmin_normalized": m["dmin"] / window,
                    "rotational_period": m["rotational_period"], "nearest_family": names, "nearest_k": m["k"],
                }
                yield pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))

    schema = (
        f"id {kind}, window_start long, orbit_ratio double, is_palindrome boolean, is_rc_fixed boolean, orbit_size long, dmin long, "
        "dmin_normalized double, rotational_period long, nearest_family string, nearest_k long"
    )
    made = chunks.select("id", "seq", "start").mapInArrow(roll, schema)
    rest = [c for c in made.columns if c not in ("id", "window_start")]
    return made.select(F.col("id").alias(key), F.lit(window).cast("long").alias("window_length"), "window_start", *rest)
