import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclaris.functions import sequence as s
from cyclaris import queries
from cyclaris.functions import sql
from cyclaris.functions.sql import register
from cyclaris.operators import approx, exact, windows

from .helpers import DATA

COMP = str.maketrans("ACGTRYKMBDHV", "TGCAYRMKVHDB")
#: sequence, orbit, palindrome, rc_fixed, period, nearest (family, k, distance), dmin without RC
GOLDEN = [
    ("", 0, True, True, 1, ("SHIFT", 0, 0), 0),
    ("A", 1, True, False, 1, ("REVERSE_SHIFT", 0, 0), 0),
    ("AC", 2, False, False, 2, ("REVERSE_SHIFT", 1, 0), 0),
    ("AT", 2, False, True, 2, ("REVERSE_SHIFT", 1, 0), 0),
    ("AAAA", 1, True, False, 1, ("SHIFT", 1, 0), 0),
    ("AAAAAAA", 1, True, False, 1, ("SHIFT", 1, 0), 0),
    ("ACGT", 8, False, True, 4, ("RC_SHIFT", 0, 0), 2),
    ("ACGTACGT", 8, False, True, 4, ("SHIFT", 4, 0), 0),
    ("ACCA", 4, True, False, 4, ("REVERSE_SHIFT", 0, 0), 0),
    ("AACCAA", 6, True, False, 6, ("REVERSE_SHIFT", 0, 0), 0),
    ("ACGTTGCA", 8, True, False, 8, ("REVERSE_SHIFT", 0, 0), 0),
    ("GGCC", 4, False, True, 4, ("REVERSE_SHIFT", 2, 0), 0),
    ("AACC", 4, False, False, 4, ("REVERSE_SHIFT", 2, 0), 0),
    ("ACGTACGTACGT", 8, False, True, 4, ("SHIFT", 4, 0), 0),
    ("ACGTACGTAA", 20, False, False, 10, ("RC_SHIFT", 2, 2), 4),
]


def brute(w, rc=True):
    n = len(w)
    best, images = (n, -1, 1), [w, w[::-1]] + ([w[::-1].translate(COMP)] if rc else [])
    for f, b in enumerate(images):
        for k in range(f == 0, n):
            best = min(best, (sum(x != y for x, y in zip(w, b[k:] + b[:k])), f, k))
    return ("SHIFT", 0, 0) if n == 0 else (approx.FAMILIES[max(best[1], 0)], best[2], best[0])


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(g[0],) for g in GOLDEN], "seq string")


def test_exact_metrics(golden):
    got = {r["seq"]: r for r in exact.with_symmetry_stats(golden).collect()}
    for seq, orbit, pal, rc, period, _, _ in GOLDEN:
        r = got[seq]
        assert (r["orbit_size"], r["is_palindrome"], r["is_rc_fixed"], r["rotational_period"]) == (orbit, pal, rc, period), seq
        assert r["orbit_ratio"] == (orbit / (2 * len(seq)) if seq else 1.0)


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_nearest_golden(golden, strategy):
    made = golden.select("seq", approx.nearest_transform("seq", strategy=strategy).alias("n"), approx.dmin("seq", False, strategy).alias("plain"))
    got = {r["seq"]: (tuple(r["n"]), r["plain"]) for r in made.collect()}
    assert got == {g[0]: (g[5], g[6]) for g in GOLDEN}


def test_plans_agree_with_brute_force(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    seqs += ["".join(rng.choice("ACGTNRY") for _ in range(rng.randint(1, 30))) for _ in range(20)] + ["ACGT" * 9]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, seq string")
    made = approx.with_nearest(df, strategy="explode", key=["i"])
    made = made.withColumns({"a": approx.nearest_transform("seq"), "b": approx.nearest_transform("seq", strategy="sql")})
    for r in made.collect():
        want = brute(r["seq"])
        assert tuple(r["a"]) == tuple(r["b"]) == (r["nearest_family"], r["nearest_k"], r["dmin"]) == want, r["seq"]
        assert r["dmin_normalized"] == (want[2] / len(r["seq"]) if r["seq"] else 0.0)


def test_long_sequence_fft_against_brute_force():
    rng = random.Random(1)
    w = "".join(rng.choice("ACGT") for _ in range(700))
    assert approx.nearest_of([w, None, w[:300]], True) == [brute(w), None, brute(w[:300])]


def test_operators(spark):
    df = spark.createDataFrame([("ACGTACGT",), ("",), (None,)], "seq string")
    r = df.select(
        s.shift("seq", 1).alias("a"), s.shift("seq", -3).alias("b"), s.shift("seq", 17).alias("c"), s.reverse("seq").alias("d"),
        s.complement("seq").alias("e"), s.rev_comp("seq").alias("f"), s.gc_content("seq").alias("g"), s.base_codes("seq").alias("h"),
    ).collect()
    assert tuple(r[0])[:7] == ("CGTACGTA", "CGTACGTA", "CGTACGTA", "TGCATGCA", "TGCATGCA", "ACGTACGT", 0.5)
    assert r[0]["h"] == [0, 1, 2, 3] * 2
    assert (r[1]["a"], r[1]["g"], r[1]["h"]) == ("", 0.0, [])
    assert all(x is None for x in r[2])


def test_shifts_add_up(spark):
    df = spark.createDataFrame([("ACGTTGCAA",)], "seq string")
    both, once = df.select(s.shift(s.shift("seq", 2), 3), s.shift("seq", 5)).first()
    assert both == once


def test_hamming(spark):
    df = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "TGCA"), ("ACGT", "ACGA"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(s.hamming("a", "b")).collect()] == [0, 4, 1, 0]
    with pytest.raises(Exception, match="unequal lengths"):
        spark.createDataFrame([("ACGT", "A")], "a string, b string").select(s.hamming("a", "b")).collect()


def test_codes_of_other_letters_raise(spark):
    with pytest.raises(Exception, match="not a sequence"):
        spark.createDataFrame([("ACGN",)], "seq string").select(s.base_codes("seq")).collect()


def test_shuffle_keeps_composition(spark):
    df = spark.createDataFrame([("AACCGGTTAC" * 5,)], "seq string")
    before, after, again = df.select("seq", s.gc_shuffle("seq", 3), s.gc_shuffle("seq", 3)).first()
    assert sorted(before) == sorted(after) and before != after and after == again


def test_orbit_members(golden):
    for r in golden.select("seq", exact.orbit("seq").alias("o")).collect():
        w = r["seq"]
        assert set(r["o"]) == {b[k:] + b[:k] for b in (w, w[::-1]) for k in range(len(w))}


def test_sql_functions(spark, golden):
    names = register(spark)
    assert {"shift", "orbit_size", "dmin", "nearest_transform"} <= set(names)
    golden.createOrReplaceTempView("golden")
    made = spark.sql(
        "select seq, orbit_size(seq) o, rotational_period(seq) p, orbit_ratio(seq) r, is_palindrome(seq) a, is_rc_fixed(seq) b,"
        " dmin(seq) d, nearest_transform(seq).family f, shift(seq, -1) s, rev_comp(seq) c, hamming_distance(seq, reverse(seq)) h,"
        " gc_content(seq) g, dmin_normalized(seq) dn from golden"
    )
    got = {r["seq"]: r for r in made.collect()}
    for g in GOLDEN:
        r, w = got[g[0]], g[0]
        assert (r["o"], r["a"], r["b"], r["p"], r["f"], r["d"]) == (*g[1:5], g[5][0], g[5][2])
        assert r["s"] == w[-1:] + w[:-1] and r["c"] == w[::-1].translate(COMP) and r["h"] == sum(x != y for x, y in zip(w, w[::-1]))


def test_plan_stays_in_the_jvm(spark, golden):
    plan = exact.with_symmetry_stats(golden)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Physical Plan")[1]
    assert F is not None


def test_letters_beyond_ascii_in_all_plans(spark):
    seqs = ["ACGé", "é", "éé", "漢ACGT漢", "😀A😀A", "NéNé", "", "ÄCGTÄ"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(seqs)], "id int, seq string")
    plans = [approx.with_nearest(df, strategy=p, key=["id"]) for p in ("arrow", "sql", "explode")]
    a, b, c = (sorted(map(tuple, x.select("id", "nearest_family", "nearest_k", "dmin").collect())) for x in plans)
    assert a == b == c


def test_linear_period_equals_the_other_plan(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("AC") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["ACG" * 5, "", None, "é" * 3]
    df = spark.createDataFrame([(w,) for w in seqs], "seq string")
    names = ["orbit_size", "orbit_ratio", "rotational_period"]
    a, b = (exact.with_symmetry_stats(df, strategy=p).select("seq", *names).collect() for p in ("sql", "arrow"))
    assert a == b
    long = spark.createDataFrame([("A" * 2_000_000 + "C",)], "seq string")
    assert exact.with_symmetry_stats(long, strategy="arrow").select(*names[:1]).first()[0] == 2_000_001


def plain_dmin(w, rc=True):
    """Least distance to a transform, by comparing all."""
    x = np.frombuffer(w.encode(), np.uint8)
    n, images = len(x), [x, x[::-1]]
    if rc:
        images.append(np.frombuffer(w[::-1].translate(str.maketrans("ACGT", "TGCA")).encode(), np.uint8))
    best = n
    for f, image in enumerate(images):
        doubled = np.concatenate((image, image))
        for k in range(f == 0, n):
            best = min(best, int((doubled[k : k + n] != x).sum()))
    return best


def test_dmin_of_texts_by_brute_force(spark):
    got = {r["doc_id"]: r["dmin"] for r in queries.QUERIES["dmin_text"](spark, DATA).collect()}
    texts = {r["doc_id"]: r["seq"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", queries._t().alias("seq")).collect()}
    assert got.keys() == texts.keys()
    for i, w in texts.items():
        if w is not None and 0 < len(w) < 1500:
            assert got[i] == plain_dmin(w)


def test_window_table_by_brute_force(spark):
    texts = {str(r["doc_id"]): r["seq"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", queries._t().alias("seq")).collect()}
    rows = queries.QUERIES["window_table"](spark, DATA).collect()
    want = {(i, n, k) for i, w in texts.items() for n in windows.WINDOW_SIZES for k in range(0, len(w or "") - n + 1, n)}
    assert {(r["replicon_id"], r["window_length"], r["window_start"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        n, w = r["window_length"], texts[r["replicon_id"]][r["window_start"] : r["window_start"] + r["window_length"]]
        assert 0 <= r["dmin"] <= n and r["dmin_normalized"] == r["dmin"] / n and r["is_palindrome"] == (w == w[::-1])
        if n <= 500:
            assert r["dmin"] == plain_dmin(w)
            both = {w[k:] + w[:k] for k in range(n)} | {w[::-1][k:] + w[::-1][:k] for k in range(n)}
            assert r["orbit_size"] == len(both) and r["orbit_ratio"] == len(both) / (2 * n)


def test_double_cover_in_sql(spark):
    sql.register(spark)
    got = spark.sql("select verify_double_cover(n) as ok from values (2L), (3L), (16L), (1000L), (null) as t(n)").collect()
    assert [r["ok"] for r in got] == [True] * 4 + [None]
    with pytest.raises(Exception, match="n >= 2"):
        spark.sql("select verify_double_cover(1L)").collect()
