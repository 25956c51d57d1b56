"""From files to tables to knowledge: what the command line runs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lift, windows
from ..sources import assemblies, downloads, fasta, files, tables
from . import knowledge, validate, verify


def build_theoretical_tables(spark: SparkSession, folder: str) -> None:
    """The two tables that need no genomes."""
    tables.write_table(lift.dicyclic_lifts(spark).orderBy("dihedral_order").coalesce(1), folder, "dicyclic_lifts")
    tables.write_table(lift.quaternion_results(spark).orderBy("n").coalesce(1), folder, "quaternion_results")


def replicon_table(manifest: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in tables.REPLICON_TABLE.split(", ")]
    return manifest.select(*names)


def build_tables(spark: SparkSession, data_dir: str, window_sizes: tuple[int, ...] = windows.WINDOW_SIZES, step: int | None = None) -> None:
    """All tables; without replicons in the manifest only the theoretical ones."""
    folder = f"{data_dir}/tables"
    manifest = fasta.read_manifest(spark, f"{data_dir}/manifest/manifest.jsonl")
    build_theoretical_tables(spark, folder)
    if manifest.isEmpty():
        return
    tables.write_table(replicon_table(manifest), folder, "atlas_replicons")
    raw = f"{data_dir}/raw"
    if files.exists(spark, raw):
        known = manifest.select("replicon_id")
        found = fasta.replicons(fasta.read_fasta(spark, raw)).join(known, "replicon_id", "left_semi")
        made = windows.window_stats(found, window_sizes, step)
        made.write.mode("overwrite").parquet(f"{folder}/atlas_windows_exact.parquet")
        made = spark.read.parquet(f"{folder}/atlas_windows_exact.parquet")
        tables.write_table(made, folder, "atlas_windows_exact")
        tables.write_table(made.select("replicon_id", "window_length", "dmin_normalized"), folder, "approx_symmetry_stats")
        tables.write_table(windows.window_summary(made), folder, "approx_symmetry_summary")


def _by_driver(urls: DataFrame, folder: str, get) -> list[tuple[str, str]]:
    failed = []
    for (url,) in urls.collect():  # at most max_genomes
        try:
            get(url, folder)
        except OSError as e:
            failed.append((url, str(e)))
    return failed


def _by_tasks(spark: SparkSession, urls: DataFrame, folder: str, per_host: int, how: dict) -> list[tuple[str, str]]:
    files.put_folder(spark, folder)
    log = files.scratch(spark, "downloads")
    downloads.fetched(urls, folder, per_host, **how).write.parquet(log)
    failed = spark.read.parquet(log).where("error is not null").select("url", "error")
    return [tuple(r) for r in failed.limit(SHOWN_FAILURES).collect()]


#: Files passed over that a run names; the table of downloads has all.
SHOWN_FAILURES = 100


def fetch(spark: SparkSession, data_dir: str, summary_path: str | None = None, max_genomes: int = 200, seed: int = 42, level: str = "complete genome", get=None, per_host: int = downloads.PER_HOST, **how) -> DataFrame:
    """Downloads what the summary (a path or an address) names, reads all raw files, appends the manifest; the files passed over.

    Tasks fetch the files, per_host at a time from a host; how: see downloads.fetched. The summary itself is one file. get(url,
    folder), if given, fetches each file in the driver instead, for stores and networks that only it reaches.
    """
    about = None
    if summary_path:
        if summary_path.startswith(("http://", "https://", "ftp://")):
            how_one = {k: v for k, v in how.items() if k in ("attempts", "wait", "opened")}
            summary_path = get(summary_path, f"{data_dir}/summary") if get else fasta.download(spark, summary_path, f"{data_dir}/summary", **how_one)
        about = assemblies.query_assemblies(spark, summary_path, max_genomes, seed, level)
        urls = about.select(assemblies.file_url(F.col("ftp_path")).alias("url"))
        for url, error in (_by_driver(urls, f"{data_dir}/raw", get) if get else _by_tasks(spark, urls, f"{data_dir}/raw", per_host, how)):
            print(f"passed over: {url}: {error}")
        about = about.withColumn("assembly_accession", fasta.assembly_of(F.element_at(F.split("ftp_path", "/"), -1)))
    made, passed_over = fasta.ingest(spark, f"{data_dir}/raw", about)
    old = fasta.read_manifest(spark, f"{data_dir}/manifest/manifest.jsonl").select("replicon_id")
    fresh = made.join(old, "replicon_id", "left_anti")
    fasta.write_manifest(fresh.select(*fasta.COLUMNS), f"{data_dir}/manifest/manifest.jsonl")
    fasta.write_checksums(fasta.checksums(spark, f"{data_dir}/raw"), f"{data_dir}/manifest/checksums.sha256")
    return passed_over


def run_pipeline(spark: SparkSession, data_dir: str, max_genomes: int = 200, seed: int = 42, skip_download: bool = False, validate_only: bool = False, summary_path: str | None = None, window_sizes: tuple[int, ...] = windows.WINDOW_SIZES) -> int:
    """fetch, validate (a failure ends the run), tables; 0 if all went well."""
    if not (skip_download or validate_only):
        fetch(spark, data_dir, summary_path, max_genomes, seed)
    if not validate.all_passed(validate.technical_validation(spark)):
        return 1
    if not validate_only:
        build_tables(spark, data_dir, window_sizes)
    return 0


def export(spark: SparkSession, data_dir: str, pipeline_max: int = 200, pipeline_seed: int = 42) -> int:
    """Knowledge records of all tables that are there; their number."""
    found = {n: tables.read_table(spark, f"{data_dir}/tables", n) for n in knowledge.EXPORTERS}
    found = {n: t for n, t in found.items() if t is not None}
    out = f"{data_dir}/epistemic"
    total = 0
    if found:
        made = knowledge.records(knowledge.union(found), knowledge.base_provenance(pipeline_max, pipeline_seed))
        lines = knowledge.to_lines(made).orderBy("table_no", "row", "metric_no")
        tables.write_json_lines(lines, "value", f"{out}/atlas_knowledge.jsonl")
        total = spark.read.text(f"{out}/atlas_knowledge.jsonl").count()
    about = knowledge.provenance_line(spark, sorted(found), total, pipeline_max, pipeline_seed)
    tables.write_json_lines(about.coalesce(1), "value", f"{out}/atlas_provenance.json")
    return total


def verify_file(spark: SparkSession, data_dir: str, records_path: str | None = None, strict: bool = False) -> int:
    """Writes the report; 0 if all checks passed, 1 if not or if there are no records."""
    path = records_path or f"{data_dir}/epistemic/atlas_knowledge.jsonl"
    if not files.exists(spark, path):
        return 1
    lines = verify.read_lines(spark, path)
    table = tables.read_table(spark, f"{data_dir}/tables", "atlas_replicons")
    ids = None if table is None or table.isEmpty() else table.select("replicon_id")
    found = verify.checks(lines, ids, strict)
    text, passed = verify.report(found, lines, datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S"))
    files.put(spark, f"{data_dir}/epistemic/atlas_knowledge_report.md", [text.encode()])
    return 0 if passed else 1
