"""The functions as SQL functions of a session: scalar ones, and table functions to be called by LATERAL.

    select t.id, w.* from t, lateral windows(t.seq, 24, 6) w

`windows`, `orbit` and `dihedral_transforms` are SQL all through, with one generator each, so they become generators within the caller's
plan. Two generators, one over the other, would be a join of the caller's rows with their own results, and these broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.approx import NEAREST, nearest_of
from ..operators.lift import is_double_cover

#: SQL body of each function; they are inlined, so the optimizer sees through them.
_BODIES = {
    "shift(seq STRING, k BIGINT) RETURNS STRING": (
        "concat(substr(seq, cast(coalesce(pmod(k, nullif(length(seq), 0)), 0) as int) + 1), "
        "substr(seq, 1, cast(coalesce(pmod(k, nullif(length(seq), 0)), 0) as int)))"
    ),
    "complement(seq STRING) RETURNS STRING": "translate(seq, 'ACGTRYKMBDHV', 'TGCAYRMKVHDB')",
    "rev_comp(seq STRING) RETURNS STRING": "translate(reverse(seq), 'ACGTRYKMBDHV', 'TGCAYRMKVHDB')",
    "hamming_distance(a STRING, b STRING) RETURNS BIGINT": (
        "case when length(a) <> length(b) then cast(raise_error('sequences have unequal lengths') as bigint) else "
        "cast(size(filter(zip_with(split(a, ''), split(b, ''), (p, q) -> p <> q), x -> x)) as bigint) end"
    ),
    "gc_content(seq STRING) RETURNS DOUBLE": (
        "case when length(seq) = 0 then 0d else (length(seq) - length(translate(seq, 'GC', ''))) / nullif(length(seq), 0) end"
    ),
    "rotational_period(seq STRING) RETURNS BIGINT": (
        "cast(case when length(seq) = 0 then 1 else locate(seq, concat(seq, seq), 2) - 1 end as bigint)"
    ),
    "orbit_size(seq STRING) RETURNS BIGINT": (
        "cast(case when length(seq) = 0 then 0 else (locate(seq, concat(seq, seq), 2) - 1) * "
        "(case when locate(reverse(seq), concat(seq, seq)) > 0 then 1 else 2 end) end as bigint)"
    ),
    "orbit_ratio(seq STRING) RETURNS DOUBLE": (
        "case when length(seq) = 0 then 1d else (locate(seq, concat(seq, seq), 2) - 1) * "
        "(case when locate(reverse(seq), concat(seq, seq)) > 0 then 1 else 2 end) / nullif(2 * length(seq), 0) end"
    ),
    "is_palindrome(seq STRING) RETURNS BOOLEAN": "seq = reverse(seq)",
    "is_rc_fixed(seq STRING) RETURNS BOOLEAN": "seq = translate(reverse(seq), 'ACGTRYKMBDHV', 'TGCAYRMKVHDB')",
    "windows(seq STRING, window INT, step INT) RETURNS TABLE (window_start BIGINT, window_seq STRING)": (
        "select i * step, substr(seq, cast(i * step as int) + 1, window) from (select explode("
        "case when length(seq) >= window then sequence(0L, (length(seq) - window) div step) else cast(array() as array<bigint>) end) as i)"
    ),
    "orbit(seq STRING) RETURNS TABLE (member STRING)": (
        "select explode(case when coalesce(length(seq), 0) = 0 then cast(array() as array<string>) else array_distinct(flatten(transform(sequence(0, greatest(length(seq), 1) - 1), "
        "i -> array(concat(substr(seq, i + 1), substr(seq, 1, i)), concat(substr(reverse(seq), i + 1), substr(reverse(seq), 1, i)))))) end)"
    ),
    "dihedral_transforms(seq STRING) RETURNS TABLE (family STRING, k BIGINT, transformed STRING, distance BIGINT)": (
        "select family, k, transformed, cast(size(filter(zip_with(split(seq, ''), split(transformed, ''), (p, q) -> p <> q), x -> x)) as bigint) from ("
        "select family, k, concat(substr(image, cast(k as int) + 1), substr(image, 1, cast(k as int))) as transformed from ("
        "select element_at(array('SHIFT', 'REVERSE_SHIFT', 'RC_SHIFT'), cast(i div length(seq) as int) + 1) as family, i % length(seq) as k, "
        "case i div length(seq) when 0 then seq when 1 then reverse(seq) else translate(reverse(seq), 'ACGTRYKMBDHV', 'TGCAYRMKVHDB') end as image from ("
        "select explode(case when coalesce(length(seq), 0) = 0 then cast(array() as array<bigint>) else sequence(1L, greatest(3L * length(seq), 2L) - 1L) end) as i)))"
    ),
    "engine_version() RETURNS STRING": f"'{__version__}'",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; returns their names."""
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("long")
    def dmin(seqs: pd.Series) -> pd.Series:
        return pd.Series([x and x[2] for x in nearest_of(seqs.tolist(), True)], dtype="Int64")

    @F.pandas_udf("double")
    def dmin_normalized(seqs: pd.Series) -> pd.Series:
        found = nearest_of(seqs.tolist(), True)
        return pd.Series([x and (x[2] / len(s) if s else 0.0) for x, s in zip(found, seqs)], dtype="float64")

    @F.pandas_udf(NEAREST)
    def nearest_transform(seqs: pd.Series) -> pd.DataFrame:
        rows = [x or (None, None, None) for x in nearest_of(seqs.tolist(), True)]
        return pd.DataFrame(rows, columns=["family", "k", "distance"]).astype({"k": "Int64", "distance": "Int64"})

    @F.pandas_udf("boolean")
    def verify_double_cover(ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(n) else is_double_cover(int(n)) for n in ns], dtype="boolean")

    for f in (dmin, dmin_normalized, nearest_transform, verify_double_cover):
        spark.udf.register(f.__name__, f)
    names = [h.split("(")[0] for h in _BODIES]
    return [*names, "dmin", "dmin_normalized", "nearest_transform", "verify_double_cover"]
