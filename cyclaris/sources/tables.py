"""Tables as CSV, with Parquet beside it, and JSON and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists

REPLICON_TABLE = (
    "assembly_accession string, replicon_id string, replicon_type string, length_bp bigint, gc_fraction double, "
    "taxonomy_id bigint, checksum_sha256 string"
)
LIFT_TABLE = "dihedral_order bigint, verified_double_cover boolean, lift_group string, relations_satisfied boolean"
RESULT_TABLE = "n bigint, dicyclic_order bigint, dihedral_order bigint, double_cover_verified boolean, group_notation string"
WINDOW_TABLE = (
    "replicon_id string, window_length bigint, window_start bigint, orbit_ratio double, is_palindrome boolean, "
    "is_rc_fixed boolean, orbit_size bigint, dmin bigint, dmin_normalized double"
)
STATS_TABLE = "replicon_id string, window_length bigint, dmin_normalized double"
SUMMARY_TABLE = (
    "replicon_id string, window_length bigint, n_windows bigint, min_dmin_normalized double, avg_dmin_normalized double, "
    "max_dmin_normalized double"
)
SCHEMAS = {
    "atlas_replicons": REPLICON_TABLE,
    "dicyclic_lifts": LIFT_TABLE,
    "quaternion_results": RESULT_TABLE,
    "atlas_windows_exact": WINDOW_TABLE,
    "approx_symmetry_stats": STATS_TABLE,
    "approx_symmetry_summary": SUMMARY_TABLE,
}
#: Schemas of records that other tools fill in.
METADATA = (
    "run_id string, start_time timestamp, end_time timestamp, engine_version string, package_versions map<string,string>, "
    "parameters map<string,string>, random_seed bigint, status string"
)
EXPERIMENT = (
    "experiment_id string, condition string, chain_length bigint, n_trials bigint, seed bigint, baseline_markov1_acc double, "
    "baseline_markov2_acc double, quaternion_acc double, p_value_vs_markov2 double"
)
LIFT_DETAIL = (
    "replicon_id string, dihedral_order bigint, verified_double_cover boolean, lift_group string, "
    "verification_method string, num_elements_checked bigint, relations_satisfied boolean"
)


def write_table(df: DataFrame, folder: str, name: str, parquet: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    if parquet:
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table, or None if it isn't there; columns that a file lacks are null."""
    path = f"{folder}/{name}.csv"
    if not exists(spark, path):
        return None
    return spark.read.option("header", True).option("enforceSchema", True).schema(SCHEMAS[name]).csv(path)


def write_json_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
