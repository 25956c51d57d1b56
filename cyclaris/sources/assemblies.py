"""Assembly summaries: reading, filtering, projecting, seeded sampling, and the addresses of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADER = "#assembly_accession"
REQUIRED, OPTIONAL = ("assembly_accession", "assembly_level", "ftp_path"), ("taxid", "organism_name")
SCHEMA = "assembly_accession string, assembly_level string, ftp_path string, taxid bigint, organism_name string"


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated summary; without a header line or a required column the result is empty."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith(_HEADER)).first()
    names = head[0].removeprefix("#").rstrip("\r").split("\t") if head else []
    if not set(REQUIRED) <= set(names):
        return spark.createDataFrame([], SCHEMA)
    at = {n: names.index(n) for n in (*REQUIRED, *OPTIONAL) if n in names}
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(cells.alias("c"))
    rows = rows.where(F.size("c") > max(at[n] for n in REQUIRED))
    return rows.select(
        *(F.get("c", F.lit(at[n])).alias(n) for n in REQUIRED),
        (F.get("c", F.lit(at["taxid"])).try_cast("bigint") if "taxid" in at else F.lit(0).cast("bigint")).alias("taxid"),
        (F.get("c", F.lit(at["organism_name"])) if "organism_name" in at else F.lit("Unknown")).alias("organism_name"),
    )


def complete_genomes(df: DataFrame, level: str = "complete genome") -> DataFrame:
    """Assemblies of a level that have an address."""
    return df.where((F.lower("assembly_level") == level.lower()) & (F.col("ftp_path") != "na"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Defaults for missing metadata."""
    return df.withColumns(
        {
            "taxid": F.coalesce("taxid", F.lit(0).cast("bigint")),
            "organism_name": F.coalesce("organism_name", F.lit("Unknown organism")),
        }
    )


def sample_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if there are fewer), the same ones for the same seed: those with the least hashes."""
    return df.orderBy(sample_key(seed, F.col(key)), key).limit(n)


def file_url(ftp_path: Column) -> Column:
    """The address of an assembly's sequence file."""
    https = F.regexp_replace(ftp_path, "^ftp://", "https://")
    return F.concat(https, F.lit("/"), F.element_at(F.split(https, "/"), -1), F.lit("_genomic.fna.gz"))


def query_assemblies(spark: SparkSession, path: str, n: int = 200, seed: int = 42, level: str = "complete genome") -> DataFrame:
    """The sample of complete genomes that a run works on; `taxon` has no meaning for a summary file."""
    return seeded_sample(complete_genomes(read_summary(spark, path), level), n, "assembly_accession", seed)
