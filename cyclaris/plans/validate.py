"""Checks of the algebra and of the metrics, and agreement of independent plans for the same metric."""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as s
from ..operators import approx, exact, lift

#: Sequences that checks run on.
OPERATOR_CASES = ("ACGTACGTAA",)
SYMMETRY_CASES = ("ACGTACGT", "AAAAAAA", "ACGTACGTACGT", "ACGTTGCA")
FIXED_CASES = ("ACGT", "ACGTACGT", "AAAA", "ACCA", "AACCAA", "ACGTTGCA", "GGCC", "ACGTACGTACGT")
RANDOM_LENGTHS = (4, 8, 16, 32, 64, 100)
TOLERANCE = 1e-12


def sequences(spark: SparkSession, seqs: tuple[str, ...] | list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in seqs], "seq string")


def test_sequences(n_random: int = 100, seed: int = 42) -> list[str]:
    """The fixed cases and as many random ones of each length; the same ones for the same seed."""
    rng = random.Random(seed)
    made = ["".join(rng.choice(s.BASES) for _ in range(n)) for n in RANDOM_LENGTHS for _ in range(n_random // len(RANDOM_LENGTHS))]
    return [*FIXED_CASES, *made]


def _long(df: DataFrame, keep: tuple[str, ...], checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each check of each sequence; message says of a check that failed what was found."""
    rows = [F.struct(F.lit(k).alias("check_name"), v.alias("passed"), F.when(v, "").otherwise(m).alias("message")) for k, (v, m) in checks.items()]
    out = df.select("*", F.inline(F.array(*rows)))
    return out.withColumn("details", F.create_map(F.lit("seq"), F.col("seq"))).select(*keep, "check_name", "passed", "message", "details")


def _gives(what: str, found: Column) -> Column:
    return F.concat_ws(" ", F.lit(what), F.col("seq"), F.lit("gives"), found.cast("string"))


class Operators(NamedTuple):
    """The four operators whose relations are checked."""

    shift: Callable[[Column, Column | int], Column] = s.shift
    reverse: Callable[[Column], Column] = s.reverse
    complement: Callable[[Column], Column] = s.complement
    rev_comp: Callable[[Column], Column] = s.rev_comp


def operator_checks(df: DataFrame, *keep: str, of: Operators | None = None) -> DataFrame:
    """check_name, passed, message, details (and columns to keep) for each sequence (seq): the relations of the operators.

    of: operators in place of the engine's own, such as those of a user, or wrong ones that the checks must find.
    """
    of = of or Operators(s.shift, s.reverse, s.complement, s.rev_comp)
    seq, n = F.col("seq"), F.length("seq")
    wrong = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: of.reverse(of.shift(seq, k)) != of.shift(of.reverse(seq), n - k))
    both = of.reverse(of.complement(seq))
    return _long(
        df,
        keep,
        {
            "shift_cyclic": (of.shift(seq, n) == seq, _gives("a whole turn of", of.shift(seq, n))),
            "reverse_involution": (of.reverse(of.reverse(seq)) == seq, _gives("two reversals of", of.reverse(of.reverse(seq)))),
            "complement_involution": (of.complement(of.complement(seq)) == seq, _gives("two complements of", of.complement(of.complement(seq)))),
            "rc_commutative": ((of.rev_comp(seq) == both) & (of.rev_comp(seq) == of.complement(of.reverse(seq))), _gives("RC and R with K differ: RC of", of.rev_comp(seq))),
            "dihedral_relation": (F.size(wrong) == 0, F.concat(F.lit("reversed shifts differ for k = "), F.array_join(wrong.cast("array<string>"), ", "))),
        },
    )


def symmetry_checks(df: DataFrame, *keep: str, strategy: str = "arrow") -> DataFrame:
    """check_name, passed, message, details (and columns to keep) for each sequence: bounds of the metrics."""
    n = F.length("seq")
    made = exact.with_symmetry_stats(df).withColumns(
        {"dmin": approx.dmin("seq", strategy=strategy), "_plain": approx.dmin("seq", False, strategy)}
    )
    size, ratio, d = F.col("orbit_size"), F.col("orbit_ratio"), F.col("dmin")
    return _long(
        made,
        keep,
        {
            "orbit_divides_2n": (F.coalesce(F.pmod(2 * n, F.nullif(size, F.lit(0))) == 0, n == 0), _gives("orbit_size of", size)),
            "orbit_ratio_bounds": ((n == 0) | ((ratio >= 1 / F.nullif(2 * n, F.lit(0))) & (ratio <= 1)), _gives("orbit_ratio of", ratio)),
            "dmin_bounds": (d.between(0, n), _gives("dmin of", d)),
            "dmin_periodic_zero": ((F.col("rotational_period") >= n) | (F.col("_plain") == 0), _gives("dmin without RC of the periodic", F.col("_plain"))),
        },
    )


def technical_validation(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """All checks on the sequences of cases (seq), or on the fixed ones."""
    a = operator_checks(sequences(spark, OPERATOR_CASES) if cases is None else cases)
    return a.unionByName(symmetry_checks(sequences(spark, SYMMETRY_CASES) if cases is None else cases))


def all_passed(found: DataFrame) -> bool:
    return bool(found.agg(F.bool_and("passed")).first()[0])


def brute_orbit_size(seq: Column | str) -> Column:
    return F.size(exact.orbit(seq)).cast("long")


#: Metric: the two plans that must agree.
PLANS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "orbit_size": (exact.orbit_size, brute_orbit_size),
    "orbit_ratio": (exact.orbit_ratio, lambda q: F.when(F.length(q) == 0, 1.0).otherwise(brute_orbit_size(q) / F.nullif(2 * F.length(q), F.lit(0)))),
    "is_palindrome": (exact.is_palindrome, lambda q: s.hamming(q, s.reverse(q)) == 0),
    "is_rc_fixed": (exact.is_rc_fixed, lambda q: s.hamming(q, s.rev_comp(q)) == 0),
    "dmin": (approx.dmin, lambda q: approx.dmin(q, strategy="sql")),
}


def compared(df: DataFrame, plans: dict = PLANS) -> DataFrame:
    """function_name, seq, a, b, error, passed for each sequence and metric."""
    seq = F.col("seq")
    wide = df.withColumns({f"_{k}_{i}": plan(seq) for k, both in plans.items() for i, plan in zip("ab", both)})
    rows = F.array(
        *(
            F.struct(F.lit(k).alias("function_name"), F.col(f"_{k}_a").cast("double").alias("a"), F.col(f"_{k}_b").cast("double").alias("b"))
            for k in plans
        )
    )
    long = wide.select("seq", F.inline(rows)).withColumn("error", F.abs(F.col("a") - F.col("b")))
    same = F.when(F.col("function_name") == "orbit_ratio", F.col("error") < TOLERANCE).otherwise(F.col("error") == 0)
    return long.withColumn("passed", F.coalesce(same, F.col("a").eqNullSafe(F.col("b"))))


#: Failing inputs that a result names.
SHOWN = 20


def first_failures(rows: DataFrame, n: int = SHOWN) -> DataFrame:
    """function_name (null: of all) and failed_cases, the first n failing inputs of rows (function_name, input, passed).

    Ranks are cut to n before the shuffle, so no function's failures are ever together.
    """
    failed = rows.where("not passed").select("function_name", "input").distinct()
    ranked = failed.withColumn("nth", F.row_number().over(Window.partitionBy("function_name").orderBy("input"))).where(F.col("nth") <= n)
    each = ranked.groupBy("function_name").agg(F.sort_array(F.collect_list("input")).alias("failed_cases"))
    # Of all functions: from the first n of each, so at most n rows a function.
    every = ranked.agg(F.slice(F.array_sort(F.collect_set("input")), 1, n).alias("failed_cases"))
    return each.unionByName(every.select(F.lit(None).cast("string").alias("function_name"), "failed_cases"))


def cross_validation(df: DataFrame, spark: SparkSession | None = None, plans: dict = PLANS) -> DataFrame:
    """n_tests, n_passed, n_failed, max_error, failed_cases (the first `SHOWN`) of each function, and the total (function_name null).

    With a session the double cover of orders 2 to 16 is tested too, against the elements counted one by one.
    """
    rows = compared(df, plans).select("function_name", F.col("seq").alias("input"), "error", "passed")
    if spark is not None:
        cover = lift.double_cover(lift.orders(spark, lift.RESULT_ORDERS), "elements")
        ok = F.col("verified") & (F.col("n_elements") == 4 * F.col("n"))
        rows = rows.unionByName(cover.select(F.lit("verify_double_cover").alias("function_name"), F.col("n").cast("string").alias("input"), F.lit(0.0).alias("error"), ok.alias("passed")))
    counts = rows.rollup("function_name").agg(
        F.count("*").alias("n_tests"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.max("error").alias("max_error")
    )
    named = first_failures(rows).withColumnRenamed("function_name", "_of")
    none = F.array().cast("array<string>")
    found = counts.join(named, F.col("function_name").eqNullSafe(F.col("_of")), "left")
    return found.withColumn("failed_cases", F.coalesce("failed_cases", none)).drop("_of")
