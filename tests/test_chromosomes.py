"""Correlation in blocks and orbit keys against the plans for single rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cyclaris.operators import approx, chromosome, exact


def cut(rng, text, longest):
    at, out = 0, []
    while at < len(text):
        n = rng.randrange(0, longest)
        out.append(text[at : at + n])
        at += n
    return out or [""]


@pytest.mark.parametrize(("size", "rc"), [(16, True), (64, False), (1024, True), (1 << 15, True)])
def test_blocks_give_the_nearest_transform(spark, size, rc):
    rng = random.Random(size)
    seqs = {"": "", "a": "A", "b": "AC", "r": "".join(rng.choices("ACGT", k=1200)), "n": "".join(rng.choices("ACGTN", k=700)), "p": "ACGGT" * 150, "t": "A" * 300 + "C"}
    seqs["m"] = seqs["r"][:500] + seqs["r"][:500][::-1] + "G"
    seqs["o"] = "".join(itertools.chain.from_iterable(itertools.repeat(c, 50) for c in "ACGT"))
    seqs[None] = "GATTACA" * 3
    if size == 1 << 15:
        seqs = {"long": "".join(rng.choices("ACGT", k=150_001)), "pal": (x := "".join(rng.choices("ACGT", k=40_000))) + x[::-1]}
    rows = [(k, i, x) for k, s in seqs.items() for i, x in enumerate(cut(rng, s, 1 + 2 * size))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, place int, seq string")
    got = {r["id"]: tuple(r)[1:5] for r in chromosome.nearest(df, "id", include_rc=rc, size=size).collect()}
    want = {k: (len(s), *approx.nearest_of([s], rc)[0]) for k, s in seqs.items()}
    assert got == want
    whole = {(r["key"], r["block"]): r["seq"] for r in chromosome.blocks(df, "id", size=size).collect()}
    assert {k: "".join(whole[k, b] for b in range(sum(x == k for x, _ in whole))) for k in seqs} == seqs
    assert all(len(v) == size for (k, b), v in whole.items() if (k, b + 1) in whole)


def test_no_fragments(spark):
    assert chromosome.nearest(spark.createDataFrame([], "id long, place int, seq string"), "id").count() == 0


def test_least_rotation():
    for n in range(9):
        for letters in itertools.product("AC", repeat=n):
            s = "".join(letters)
            assert exact.least_rotation(s) == min((s[k:] + s[:k] for k in range(n)), default="")
    rng = random.Random(4)
    for _ in range(300):
        s = "".join(rng.choices("ACGT", k=rng.randrange(1, 30))) * rng.randrange(1, 4)
        assert exact.least_rotation(s) == min(s[k:] + s[:k] for k in range(len(s)))


def test_orbit_keys(spark):
    rows = ["ACGT", "GTAC", "TGCA", "AACC", "", None, "A" * 5, "é" * 2 + "a", "aéé", "ACGGT", "TGGCA"]
    df = spark.createDataFrame([(x,) for x in rows], "seq string")
    both = df.select("seq", exact.orbit_key("seq").alias("a"), exact.orbit_key("seq", "sql").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and {r["seq"]: r["a"] for r in both}["TGGCA"] == "ACGGT"
    found = {tuple(r) for r in exact.distinct_orbits(df.union(df.limit(1))).collect()}
    assert ("ACGT", 4, 3) in found and exact.distinct_orbits(df.where(F.lit(False))).count() == 0


def test_letters_are_shuffled_once(spark, monkeypatch):
    """Short sequences aren't copied at all, and long ones only as far as there are tasks for the copies."""
    monkeypatch.setattr(chromosome, "TASKS", 6)
    rng = random.Random(7)
    seqs = {f"s{i}": "".join(rng.choices("ACGT", k=50 + i)) for i in range(40)} | {f"l{i}": "".join(rng.choices("ACGTN", k=900 + 50 * i)) for i in range(3)}
    rows = [(k, i, x) for k, s in seqs.items() for i, x in enumerate(cut(rng, s, 40))]
    rng.shuffle(rows)
    made = chromosome.nearest(spark.createDataFrame(rows, "id string, place int, seq string"), "id", size=16)
    assert {r["id"]: tuple(r)[1:5] for r in made.collect()} == {k: (len(s), *approx.nearest_of([s], True)[0]) for k, s in seqs.items()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("FlatMapGroupsInArrow") :]
    assert grouped.count("FlatMapGroupsInArrow") == 1 and "collect_list" not in plan
    joins = [line for line in grouped.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 1 and "strategy=broadcast" in joins[0]


def test_transforms_of_any_length():
    """Lengths with large prime factors are padded; all equal a plain search."""
    rng = random.Random(3)
    for n in (*range(1, 12), 63, 64, 67, 97, 121, 128, 134, 200, 211):
        assert approx._transform_length(n) == n or n >= 64
        for letters in ("ACGT", "A", "ANRY", "xAT"):
            s = "".join(rng.choices(letters, k=n))
            for rc in (True, False):
                images = [s, s[::-1]] + [s[::-1].translate(str.maketrans("ACGTRYKMBDHV", "TGCAYRMKVHDB"))] * rc
                every = [(sum(p != q for p, q in zip(s, x[k:] + x[:k])), f, k) for f, x in enumerate(images) for k in range(n) if f or k]
                d, f, k = min([(n, -1, 1), *every])
                assert approx.nearest_of([s], rc) == [(approx.FAMILIES[max(f, 0)], k, d)]
