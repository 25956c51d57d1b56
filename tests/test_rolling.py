"""Overlapping windows from shared sums against the metrics of each window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclaris import queries
from cyclaris.operators import approx, exact, rolling, windows

from .helpers import DATA

ROWS = ("window_start", "orbit_ratio", "is_palindrome", "is_rc_fixed", "orbit_size", "dmin", "dmin_normalized")


def plain(text, n):
    """(distance, family, k) of the nearest transform, and the orbit, of one window."""
    comp = dict(zip("ACGTRYKMBDHV", "TGCAYRMKVHDB"))
    images = [text, text[::-1], "".join(comp.get(c, c) for c in text[::-1])]
    best, orbit = (n, -1, 1), set()
    for f, image in enumerate(images):
        for k in range(n):
            moved = image[k:] + image[:k]
            if f < 2:
                orbit.add(moved)
            if f or k:
                best = min(best, (sum(a != b for a, b in zip(text, moved)), f, k))
    return best, len(orbit)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 12, 25])
def test_windows_of_every_length(n):
    rng = random.Random(n)
    for letters in ("ACGT", "AC", "A", "ACGTNRé"):
        text = "".join(rng.choices(letters, k=70)) + "ACACACACACACACGTGT"
        for step in (1, 3):
            m = rolling.of_windows(np.frombuffer(text.encode("utf-32-le"), np.uint32), n, step)
            for i, at in enumerate(m["at"].tolist()):
                w = text[at : at + n]
                (d, f, k), orbit = plain(w, n)
                assert (m["dmin"][i], max(f, 0), m["k"][i], m["orbit_size"][i]) == (d, m["family"][i], k, orbit)
                assert m["is_palindrome"][i] == (w == w[::-1]) and m["is_clean"][i] == (set(w) <= set("ACGT"))
            assert len(m["at"]) == len(range(0, len(text) - n + 1, step))


@pytest.mark.parametrize(("n", "step"), [(16, 1), (40, 7), (64, 64)])
def test_same_as_the_window_table(spark, monkeypatch, n, step):
    monkeypatch.setattr(rolling, "CHUNK", 300)
    rng = random.Random(2)
    rows = [("a", "".join(rng.choices("ACGT", k=1500))), ("b", "ACGT" * 50 + "N" + "A" * 80), ("c", "ACG"), ("d", None), ("e", ""), (None, "ACGTTGCA" * 10)]
    df = spark.createDataFrame(rows, "replicon_id string, seq string")
    got = rolling.rolling_stats(df, n, step).select("replicon_id", *ROWS).collect()
    want = windows.window_stats(df, (n,), step).select("replicon_id", *ROWS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and got
    ambiguous = rolling.rolling_stats(df, n, step, keep_ambiguous=True)
    assert ambiguous.count() > len(got)
    near = ambiguous.join(windows.windows(df, n, step, keep_ambiguous=True), ["replicon_id", "window_start"])
    near = near.withColumn("x", approx.nearest_transform("seq", strategy="sql")).withColumn("p", exact.rotational_period("seq"))
    assert near.where("x.family <> nearest_family or x.k <> nearest_k or x.distance <> dmin or p <> rotational_period").count() == 0


def test_nothing_to_roll_over(spark):
    df = spark.createDataFrame([], "replicon_id string, seq string")
    assert rolling.rolling_stats(df, 5).count() == 0
    with pytest.raises(ValueError):
        rolling.rolling_stats(df, 0)
    assert rolling.rolling_stats(df.select(F.lit(1).alias("replicon_id"), "seq"), 5).schema["replicon_id"].dataType.simpleString() == "int"


@pytest.mark.parametrize(("n", "step"), [(1, 1), (5, 1), (5, 3), (12, 20)])
def test_short_texts_share_a_vector(monkeypatch, n, step):
    rng = random.Random(n)
    texts = ["".join(rng.choices("ACGTNé", (9, 9, 9, 9, 1, 1), k=rng.choice([n, n + 1, 3 * n + 7]))) for _ in range(40)]
    want = [rolling.of_windows(np.frombuffer(x.encode("utf-32-le"), np.uint32), n, step) for x in texts]
    calls, of_windows = [], rolling.of_windows
    monkeypatch.setattr(rolling, "of_windows", lambda *a: calls.append(a) or of_windows(*a))
    got = rolling.of_texts(texts, n, step)
    assert len(calls) == 1
    for k in want[0]:
        assert np.array_equal(np.concatenate([m[k] for m in want]), got[k])
    assert np.array_equal(got["text"], np.repeat(np.arange(len(texts)), [len(m["at"]) for m in want]))


def test_texts_are_taken_by_their_letters():
    texts = ["a" * 3, "b" * 3, "c" * 9, "d", "e"]
    assert list(rolling._together(texts, 6)) == [(0, texts[:2]), (2, texts[2:3]), (3, texts[3:])]
    assert list(rolling._together(texts, 6, 5)) == [(i, [x]) for i, x in enumerate(texts)] and not list(rolling._together([], 6))


def test_texts_are_dealt_to_tasks(spark):
    made = queries._texts(spark, DATA).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(made) > 1 and max(r["n"] for r in made) < sum(r["n"] for r in made)
