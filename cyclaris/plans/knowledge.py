"""Metrics as knowledge records with bounds, validity and provenance.

Every table is unpivoted by its exporter into (sort, record_type, metric_name, value, number, ...); one projection turns
the union of them into records. `value` is a VARIANT, as it holds numbers, strings and booleans.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, SCHEMA_VERSION = "0.1.0", "1.0.0"

#: Metric and the text of its predicate over the value x.
PREDICATES = {
    "gc_fraction": "0 <= x <= 1",
    "orbit_ratio": "0.25 <= x <= 1",
    "dmin_over_L": "0 <= x <= 1",
    "dmin_normalized": "0 <= x <= 1",
    "length_bp": "x > 0",
    "taxonomy_id": "x >= 0",
    "dihedral_order": "x > 0 and even",
    "verified_double_cover": "boolean",
    "relations_satisfied": "boolean",
    "confidence": "0 <= x <= 1",
}
#: Metrics that are known exactly.
DETERMINISTIC = (
    "length_bp", "taxonomy_id", "replicon_type", "assembly_accession", "replicon_id", "checksum_sha256",
    "dihedral_order", "lift_group", "verified_double_cover", "relations_satisfied",
)
_CONTEXT = {
    "assembly_accession": "string", "replicon_id": "string", "replicon_accession": "string", "window_length": "bigint",
    "experiment_id": "string",
}


def git_sha() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


#: The predicates as conditions on x, the value as a number, and is_boolean.
_CONDITIONS = {
    "x > 0": "x > 0",
    "x >= 0": "x >= 0",
    "0 <= x <= 1": "x between 0 and 1",
    "0.25 <= x <= 1": "x between 0.25 and 1",
    "x > 0 and even": "x > 0 and pmod(x, 2d) = 0",
    "boolean": "is_boolean",
}
RULE = "metric_name string, predicate string, condition string"
#: Rules of a table beyond which it is no rule table.
MOST_RULES = 10_000


def rules(spark: SparkSession) -> DataFrame:
    """The rules as a table: metric_name, predicate (as records show it) and condition, SQL over x, the value as a number (null if
    it is none), shown, the value as text, and is_boolean. Rows added to it are rules like the others."""
    return spark.createDataFrame([(m, p, _CONDITIONS[p]) for m, p in PREDICATES.items()], RULE)


def compiled(table: DataFrame | None = None) -> Column:
    """One expression for a table of rules (without one: the fixed ones): (holds, predicate) of a row with metric_name, x,
    is_boolean and shown.

    All rules of a metric must hold; its predicate names them in order, joined by " and ". A condition that a value can't
    answer (null) holds and isn't named. Conditions are checked by Spark as it plans; the table may have MOST_RULES rows.
    """
    if table is None:
        rows = [(m, p, _CONDITIONS[p]) for m, p in PREDICATES.items()]
    else:
        rows = [tuple(r) for r in table.select("metric_name", "predicate", "condition").distinct().limit(MOST_RULES + 1).collect()]
        if len(rows) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
    by_metric: dict[str, list[tuple[str, str]]] = {}
    for metric, predicate, condition in sorted(rows):
        by_metric.setdefault(metric, []).append((predicate, condition))

    every = F.lit(None).cast("array<struct<p:string,ok:boolean>>")
    for name, found in by_metric.items():
        answers = F.array(*(F.struct(F.lit(p).alias("p"), F.expr(f"({c})").cast("boolean").alias("ok")) for p, c in found))
        every = F.when(F.col("metric_name") == name, answers).otherwise(every)
    answered = F.filter(F.coalesce(every, F.array().cast("array<struct<p:string,ok:boolean>>")), lambda r: r["ok"].isNotNull())
    predicate = F.nullif(F.array_join(F.transform(answered, lambda r: r["p"]), " and "), F.lit(""))
    return F.struct(F.forall(answered, lambda r: r["ok"]).alias("holds"), predicate.alias("predicate"))


def _cell(number: int, name: str, column: Column, kind: str, epsilon: float | None, confidence: float | None) -> Column:
    """One metric of a row; kind is the column's type."""
    numeric = kind not in ("string", "date", "timestamp")
    return F.struct(
        F.lit(number).alias("metric_no"),
        F.lit(name).alias("metric_name"),
        column.cast("variant").alias("value"),
        column.cast("string").alias("shown"),
        (column if numeric else F.lit(None)).cast("double").alias("number"),
        F.lit(kind == "boolean").alias("is_boolean"),
        F.lit(epsilon).cast("double").alias("epsilon"),
        F.lit(confidence).cast("double").alias("confidence"),
    )


def unpivoted(
    df: DataFrame, kind: str, metrics: dict[str, str], sort: int, bounds: Callable[[str], tuple] = lambda _: (None, None)
) -> DataFrame:
    """A row for each metric (column: name) of df that has a value; context columns that df lacks are null."""
    types = dict(df.dtypes)
    cells = [_cell(i, m, F.col(f"`{c}`"), types[c], *bounds(m)) for i, (c, m) in enumerate(metrics.items()) if c in types]
    cells = cells or [_cell(0, "", F.lit(None).cast("string"), "string", None, None)]
    context = [(F.col(c) if c in types else F.lit(None)).cast(t).alias(c) for c, t in _CONTEXT.items()]
    row = F.concat_ws("/", *(F.col(f"`{c}`").cast("string") for c in df.columns if c not in metrics))
    keys = (F.lit(sort).alias("table_no"), row.alias("row"), F.lit(kind).alias("record_type"))
    return df.select(*keys, *context, F.inline(F.array(*cells))).where("shown is not null")


def export_replicons(df: DataFrame) -> DataFrame:
    names = ("length_bp", "gc_fraction", "taxonomy_id", "replicon_type", "checksum_sha256")
    return unpivoted(df, "replicon_metric", {n: n for n in names}, 0)


def export_lifts(df: DataFrame) -> DataFrame:
    names = ("dihedral_order", "lift_group", "verified_double_cover", "relations_satisfied")
    return unpivoted(df, "dicyclic_lift", {n: n for n in names}, 1)


def _experiment_bounds(name: str) -> tuple[float, float]:
    return (0.01, 0.95) if name.endswith("_acc") or name == "p_value_vs_markov2" else (0.0, 1.0)


def export_experiments(df: DataFrame) -> DataFrame:
    names = (
        "chain_length", "n_trials", "seed", "baseline_markov1_acc", "baseline_markov2_acc", "quaternion_acc", "p_value_vs_markov2",
    )
    return unpivoted(df, "quaternion_result", {n: n for n in names}, 2, _experiment_bounds)


def _approx(sort: int, df: DataFrame) -> DataFrame:
    aliases = {"d_min": "d_min", "dmin": "dmin", "d_min_over_L": "dmin_over_L", "dmin_normalized": "dmin_over_L", "dmin_over_L": "dmin_over_L"}
    return unpivoted(df, "approx_symmetry", aliases, sort, lambda _: (0.0, 1.0))


def export_approx(df: DataFrame) -> DataFrame:
    return _approx(3, df)


def export_approx_summary(df: DataFrame) -> DataFrame:
    return _approx(4, df)


def export_windows(df: DataFrame) -> DataFrame:
    names = ("orbit_ratio", "orbit_size", "is_palindrome", "is_rc_fixed", "dmin")
    metrics = {n: n for n in names} | {"dmin_normalized": "dmin_over_L"}
    return unpivoted(df, "window_metric", metrics, 5, lambda _: (0.0, 1.0))


#: Table name: exporter. A table of one's own is added here. export_windows isn't, as the orbit ratios of windows may rightly
#: be under the format's bound of 0.25, which verification would report.
EXPORTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "atlas_replicons": export_replicons,
    "dicyclic_lifts": export_lifts,
    "quaternion_results": export_experiments,
    "approx_symmetry_stats": export_approx,
    "approx_symmetry_summary": export_approx_summary,
}


#: The names of these fields are fixed by the record format.
def base_provenance(pipeline_max: int = 200, pipeline_seed: int = 42, sha: str | None = None, timestamp: str | None = None) -> dict[str, Column]:
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return {
        "atlas_git_sha": F.lit(sha or git_sha()),
        "atlas_version": F.lit(VERSION),
        "demetrios_schema_version": F.lit(SCHEMA_VERSION),
        "timestamp_utc": F.lit(timestamp) if timestamp else now,
        "pipeline_max": F.lit(pipeline_max).cast("bigint"),
        "pipeline_seed": F.lit(pipeline_seed).cast("bigint"),
        "ncbi_filter": F.struct(F.lit("complete genome").alias("assembly_level"), F.lit("RefSeq").alias("source")),
    }


def records(rows: DataFrame, provenance: dict[str, Column], rule_table: DataFrame | None = None) -> DataFrame:
    """record_type, metric_name, value, epsilon, confidence, validity, provenance of unpivoted rows, with their sort keys.

    rule_table: the rules that validity is told by, in place of the fixed ones.
    """
    exact = F.col("metric_name").isin(*DETERMINISTIC)
    context = [F.col(c) for c in _CONTEXT]
    return rows.withColumnRenamed("number", "x").select(
        "table_no", "row", "metric_no", "record_type", "metric_name", "value", "shown",
        F.when(exact, F.lit(0.0)).otherwise(F.col("epsilon")).alias("epsilon"),
        F.when(exact, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        compiled(rule_table).alias("validity"),
        F.struct(*(v.alias(k) for k, v in provenance.items()), *context).alias("provenance"),
    )


def union(tables: dict[str, DataFrame], exporters: dict[str, Callable] = EXPORTERS) -> DataFrame:
    """The unpivoted rows of all tables that have an exporter: a bag."""
    made = None
    for name, exporter in exporters.items():
        if name in tables and tables[name] is not None:
            part = exporter(tables[name])
            made = part if made is None else made.unionByName(part)
    if made is None:
        raise ValueError("none of the tables has an exporter")
    return made


def to_lines(made: DataFrame) -> DataFrame:
    """Records as JSON text in `value`, in table, row and metric order; nulls are written."""
    fields = ("record_type", "metric_name", "value", "epsilon", "confidence", "validity", "provenance")
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return made.select("table_no", "row", "metric_no", line.alias("value"))


def provenance_line(spark: SparkSession, tables: list[str], total: int, pipeline_max: int = 200, pipeline_seed: int = 42) -> DataFrame:
    """One row of JSON about a run."""
    base = base_provenance(pipeline_max, pipeline_seed)
    about = F.struct(
        base["timestamp_utc"].alias("export_timestamp"), base["atlas_git_sha"].alias("atlas_git_sha"),
        F.lit(VERSION).alias("atlas_version"), F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(F.lit(pipeline_max).alias("max"), F.lit(pipeline_seed).alias("seed")).alias("pipeline_params"),
        F.array(*map(F.lit, tables)).cast("array<string>").alias("tables_exported"), F.lit(total).alias("total_records"),
        F.struct(F.lit("complete genome").alias("assembly_level"), F.lit("RefSeq").alias("source"), F.lit("required").alias("ftp_path")).alias("ncbi_filter"),
    )
    return spark.range(1).select(F.to_json(about).alias("value"))
