"""FASTA files to replicons, manifests and checksums."""

from __future__ import annotations

import time
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gc_content
from .files import exists, put

REPLICON = (
    "assembly_accession string, replicon_id string, replicon_accession string, replicon_type string, length_bp bigint, "
    "gc_fraction double, taxonomy_id bigint, taxonomy_name string, source_db string, download_date date, "
    "checksum_sha256 string"
)
COLUMNS = [x.split()[0] for x in REPLICON.split(", ")]
#: Fixed value: what counts as an accession at the start of a header. Prefixes such as NZ_CP don't match.
ACCESSION = r"^([A-Z]{1,2}_?[0-9]+(?:\.[0-9]+)?)"


def replicon_type(header: Column, number: Column) -> Column:
    """PLASMID, CHROMOSOME or OTHER from a header and its number in the file (from 1)."""
    low = F.lower(header)
    return (
        F.when(low.contains("plasmid"), "PLASMID")
        .when(low.contains("chromosome") | (number == 1), "CHROMOSOME")
        .otherwise("OTHER")
    )


def replicon_accession(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, ACCESSION, 1), F.lit(""))


def assembly_of(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(_genomic)?\.(fna|fa|fasta)(\.gz)?$", "")


def records(text: DataFrame) -> DataFrame:
    """From whole files (file_name, value): assembly_accession, number (from 1), header, seq."""
    cut = F.filter(F.split("value", r"(?:^|\r?\n)>"), lambda x: F.trim(x) != "")
    rows = text.select(assembly_of(F.col("file_name")).alias("assembly_accession"), F.posexplode(cut).alias("pos", "r"))
    head = F.regexp_extract("r", r"^[^\r\n]*", 0)
    body = F.col("r").substr(F.length(head) + 1, F.length("r"))
    return rows.select(
        "assembly_accession",
        (F.col("pos") + 1).cast("long").alias("number"),
        head.alias("header"),
        F.upper(F.regexp_replace(body, r"\s+", "")).alias("seq"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """records of the files under path, gzipped or not.

    A file is one row and one task, as a gzipped file can't be split and a sequence has to be one row in the end; a file
    must therefore be under 2 GB of text.
    """
    text = spark.read.text(path, wholetext=True)
    return records(text.select(F.col("_metadata.file_name").alias("file_name"), "value"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file_name, assembly_accession and the SHA-256 of each file's own (compressed) bytes."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), assembly_of(name).alias("assembly_accession"), F.sha2("content", 256).alias("checksum_sha256"))


def replicons(found: DataFrame, assemblies: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """The manifest rows of records, with their sequences as seq; metadata that is missing gets its default."""
    df = found
    if assemblies is not None:
        df = df.join(assemblies.select("assembly_accession", "taxid", "organism_name"), "assembly_accession", "left")
    else:
        df = df.withColumns({"taxid": F.lit(None).cast("bigint"), "organism_name": F.lit(None).cast("string")})
    if sums is not None:
        df = df.join(sums.select("assembly_accession", "checksum_sha256"), "assembly_accession", "left")
    else:
        df = df.withColumn("checksum_sha256", F.lit(None).cast("string"))
    return df.select(
        "assembly_accession",
        F.concat("assembly_accession", F.lit("_rep"), F.col("number").cast("string")).alias("replicon_id"),
        replicon_accession(F.col("header")).alias("replicon_accession"),
        replicon_type(F.col("header"), F.col("number")).alias("replicon_type"),
        F.length("seq").cast("long").alias("length_bp"),
        gc_content("seq").alias("gc_fraction"),
        F.coalesce("taxid", F.lit(0).cast("bigint")).alias("taxonomy_id"),
        F.coalesce("organism_name", F.lit("Unknown organism")).alias("taxonomy_name"),
        F.lit("REFSEQ").alias("source_db"),
        F.current_date().alias("download_date"),
        F.coalesce("checksum_sha256", F.lit("")).alias("checksum_sha256"),
        "seq",
    )


def ingest(spark: SparkSession, path: str, assemblies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Replicons of the files under path, and the files that gave none (unreadable or empty), which are passed over."""
    sums = checksums(spark, path)
    found = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True)
    rows = records(found.select(F.col("_metadata.file_name").alias("file_name"), "value"))
    quarantine = sums.join(rows.select("assembly_accession").distinct(), "assembly_accession", "left_anti")
    return replicons(rows, assemblies, sums), quarantine.select("file_name")


def write_manifest(df: DataFrame, path: str) -> None:
    """Appends JSON lines; a second run of the same input repeats its rows, which read_manifest undoes."""
    df.select(*COLUMNS).write.mode("append").option("ignoreNullFields", False).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows, one for each replicon_id; a path that isn't there gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], REPLICON)
    rows = spark.read.schema(REPLICON).option("recursiveFileLookup", True).json(path)
    return rows.where("replicon_id is not null").dropDuplicates(["replicon_id"])


def write_checksums(sums: DataFrame, path: str) -> None:
    """Lines as sha256sum writes them."""
    line = F.concat_ws("  ", "checksum_sha256", "file_name").alias("value")
    sums.select(line).coalesce(1).write.mode("overwrite").text(path)


def download(spark: SparkSession, url: str, folder: str, attempts: int = 3, wait: float = 1.0, opened=urllib.request.urlopen) -> str:
    """Fetches one file into a folder of any store unless it is there; waits longer after each failure."""
    to = f"{folder.rstrip('/')}/{url.rsplit('/', 1)[-1]}"
    for i in range(1, attempts + 1):
        if exists(spark, to):
            break
        try:
            with opened(url) as got:
                put(spark, to, iter(lambda: got.read(1 << 20), b""))
        except OSError:
            if i == attempts:
                raise
            time.sleep(wait * 2**i)
    return to
