import gzip
import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from cyclaris import cli
from cyclaris.plans import knowledge, pipeline, validate, verify
from cyclaris.sources import assemblies, fasta, files, tables
from cyclaris.streaming.replicons import read_stream

FASTA = ">NC_000913.3 Escherichia chromosome\nACGTACGTNN\nacgt\n>NZ_CP01.1 some plasmid pX\r\nGGCC\r\n>JAB01 other contig\nACGTACGTACGTACGTAAAA\n"


@pytest.fixture
def data_dir(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    with gzip.open(raw / "GCF_1_genomic.fna.gz", "wb") as f:
        f.write(FASTA.encode())
    (raw / "GCF_2_genomic.fna.gz").write_bytes(b"this is not gzip")
    return tmp_path


def test_fasta_replicons(spark, data_dir):
    made, passed_over = fasta.ingest(spark, str(data_dir / "raw"))
    rows = sorted(made.collect(), key=lambda r: r["replicon_id"])
    got = [(r["replicon_id"], r["replicon_type"], r["replicon_accession"], r["length_bp"], r["seq"]) for r in rows]
    assert got == [
        ("GCF_1_rep1", "CHROMOSOME", "NC_000913.3", 14, "ACGTACGTNNACGT"),
        ("GCF_1_rep2", "PLASMID", None, 4, "GGCC"),
        ("GCF_1_rep3", "OTHER", None, 20, "ACGTACGTACGTACGTAAAA"),
    ]
    assert rows[0]["gc_fraction"] == 6 / 14 and rows[0]["taxonomy_name"] == "Unknown organism" and rows[0]["source_db"] == "REFSEQ"
    assert rows[0]["checksum_sha256"] == hashlib.sha256((data_dir / "raw/GCF_1_genomic.fna.gz").read_bytes()).hexdigest()
    assert [r[0] for r in passed_over.collect()] == ["GCF_2_genomic.fna.gz"]


def test_manifest_and_checksums(spark, data_dir, tmp_path):
    path = str(tmp_path / "manifest.jsonl")
    assert fasta.read_manifest(spark, path).count() == 0
    made = fasta.replicons(fasta.read_fasta(spark, str(data_dir / "raw/GCF_1_genomic.fna.gz")))
    for _ in range(2):
        fasta.write_manifest(made, path)
    assert fasta.read_manifest(spark, path).count() == 3
    fasta.write_checksums(fasta.checksums(spark, str(data_dir / "raw")), str(tmp_path / "sums"))
    lines = [x.split("  ") for r in spark.read.text(str(tmp_path / "sums")).collect() for x in [r[0]]]
    assert {x[1] for x in lines} == {"GCF_1_genomic.fna.gz", "GCF_2_genomic.fna.gz"} and all(len(x[0]) == 64 for x in lines)


SUMMARY = """## some comment
#assembly_accession\ttaxid\torganism_name\tassembly_level\tftp_path
GCF_1\t511145\tEscherichia\tComplete Genome\tftp://h/a/GCF_1_v
GCF_2\tx9\tOther\tcomplete genome\thttps://h/a/GCF_2_v
GCF_3\t3\tDraft\tContig\tftp://h/a/GCF_3_v

GCF_4\t4\tGone\tComplete Genome\tna
short\t1
"""


def test_assembly_summary(spark, tmp_path):
    (tmp_path / "s.txt").write_text(SUMMARY)
    made = assemblies.complete_genomes(assemblies.read_summary(spark, str(tmp_path / "s.txt")))
    got = [(r["assembly_accession"], r["taxid"]) for r in made.orderBy("assembly_accession").collect()]
    assert got == [("GCF_1", 511145), ("GCF_2", None)]
    urls = [r[0] for r in made.select(assemblies.file_url(made["ftp_path"])).orderBy("assembly_accession").collect()]
    assert urls[0] == "https://h/a/GCF_1_v/GCF_1_v_genomic.fna.gz"
    (tmp_path / "t.txt").write_text("#other\theader\na\tb\n")
    assert assemblies.read_summary(spark, str(tmp_path / "t.txt")).count() == 0
    one = [r[0] for r in assemblies.query_assemblies(spark, str(tmp_path / "s.txt"), 1).select("assembly_accession").collect()]
    assert one == [r[0] for r in assemblies.query_assemblies(spark, str(tmp_path / "s.txt"), 1).select("assembly_accession").collect()] and len(one) == 1


def test_whole_pipeline(spark, data_dir):
    d = str(data_dir)
    (data_dir / "raw/GCF_2_genomic.fna.gz").unlink()
    (data_dir / "s.txt").write_text(SUMMARY)
    fetched = []
    pipeline.fetch(spark, d, str(data_dir / "s.txt"), 2, get=lambda url, to: fetched.append(url))
    assert len(fetched) == 2
    assert pipeline.run_pipeline(spark, d, skip_download=True, window_sizes=(4, 8)) == 0
    windows = tables.read_table(spark, f"{d}/tables", "atlas_windows_exact")
    assert windows.where("replicon_id = 'GCF_1_rep3'").count() == 5 + 2
    assert tables.read_table(spark, f"{d}/tables", "approx_symmetry_summary").count() > 0
    assert cli.main(["export", d], spark) == 0
    assert cli.main(["verify", d], spark) == 0
    report = (data_dir / "epistemic/atlas_knowledge_report.md").read_text()
    assert "## All checks passed" in report and "16. **no_miracles**" in report
    assert cli.main(["pipeline", "--data-dir", d, "--validate-only"], spark) == 0
    assert pipeline.verify_file(spark, d, f"{d}/nothing") == 1


def test_without_genomes_the_counts_are_those_of_the_theory(spark, tmp_path):
    d = str(tmp_path)
    assert pipeline.run_pipeline(spark, d, skip_download=True) == 0
    assert pipeline.export(spark, d) == 16
    lines = verify.read_lines(spark, f"{d}/epistemic/atlas_knowledge.jsonl")
    assert verify.checks(lines).count() == 128
    about = json.loads(spark.read.text(f"{d}/epistemic/atlas_provenance.json").first()[0])
    assert about["total_records"] == 16 and about["ncbi_filter"]["ftp_path"] == "required"


def _record(**changes):
    prov = {"atlas_git_sha": "a", "timestamp_utc": "t", "pipeline_seed": 1, "pipeline_max": 2, "assembly_accession": "x", "replicon_id": "r1"}
    base = {"record_type": "replicon_metric", "metric_name": "gc_fraction", "value": 0.5, "epsilon": None, "confidence": None, "validity": {"holds": True}, "provenance": prov}
    return json.dumps(base | changes)


def _failures(spark, tmp_path, lines, **options):
    (tmp_path / "k.jsonl").write_text("\n".join(lines))
    ids = spark.createDataFrame([("r1",)], "replicon_id string")
    found = verify.checks(verify.read_lines(spark, str(tmp_path / "k.jsonl")), ids, **options)
    return sorted((r["record_idx"], r["rule"]) for r in found.where("not passed").collect()), found


def test_verifier_rules(spark, tmp_path):
    prov = json.loads(_record())["provenance"]
    lines = [
        _record(), "", "{broken", _record(value=1.5), _record(value="1.5"), _record(epsilon=-1), _record(confidence=True),
        _record(confidence=2), _record(validity=None), _record(validity={"holds": False}), _record(provenance=None),
        _record(provenance=prov | {"replicon_id": "r9"}), _record(provenance=prov | {"atlas_git_sha": ""}), "[1]",
    ]
    got, found = _failures(spark, tmp_path, lines)
    assert got == [
        (3, "json_parse"), (4, "gc_fraction_range"), (6, "epsilon_nonneg"), (8, "confidence_range"), (9, "validity_present"),
        (10, "validity_holds"), (11, "provenance_present"), (12, "join_replicon"), (13, "provenance_atlas_git_sha"), (14, "json_parse"),
    ]
    assert found.where("record_idx = 1").count() == 12
    text, passed = verify.report(found, verify.read_lines(spark, str(tmp_path / "k.jsonl")))
    assert not passed and "### json_parse: 2" in text and "* line 12: replicon_id r9 isn't in the replicon table" in text


def test_report_of_more_checks_than_a_hundredth_of_an_int(spark):
    n = 2**31 // 100 + 2
    found = spark.range(n).select(F.lit("a_rule").alias("rule"), (F.col("id") > 0).alias("passed"), F.lit("wrong").alias("message"), F.col("id").alias("record_idx"))
    text, passed = verify.report(found, spark.createDataFrame([("{}",)], "value string"))
    assert not passed and f"* checks: {n}\n* passed: {n - 1}\n* failed: 1\n* percent passed: 100.0\n" in text
    assert verify.report(found.limit(0), spark.createDataFrame([("{}",)], "value string"))[0].count("* percent passed: 0.0") == 1


def test_checks_shuffle_no_record(spark, tmp_path):
    """Lines are numbered and ids are looked up without a record in any shuffle, whatever the ids' number; JSON that is no object fails."""
    lines = [_record(), " \t" + _record(), '"{"', "[{}]", " {x", "{}"]
    (tmp_path / "k.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.createDataFrame([("r1",)], "replicon_id string")
        found = verify.checks(verify.read_lines(spark, str(tmp_path / "k.jsonl")), ids)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in found.where("not passed").select("record_idx", "rule").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "hashpartitioning(_asked" in plan and "hashpartitioning(file" in plan
    below = plan[plan.index("hashpartitioning(_asked") :].split("\n")[1]
    assert "record#" not in below.split("AS _asked")[-1] and plan.count("BroadcastHashJoin") == 2
    assert sorted(i for i, r in got if r == "json_parse") == [3, 4, 5]


def test_strict_miracles(spark, tmp_path):
    line = _record(epsilon=0.1, derivation={"source_epsilons": [0.2, 0.05]})
    assert _failures(spark, tmp_path, [line])[0] == []
    assert _failures(spark, tmp_path, [line], strict=True)[0] == [(1, "no_miracles")]
    ruled = _record(epsilon=0.1, derivation={"source_epsilons": [0.2], "rule": "mean"})
    assert _failures(spark, tmp_path, [ruled], strict=True)[0] == []


def test_orbit_ratio_bound_is_an_option(spark, tmp_path):
    line = _record(metric_name="orbit_ratio", value=0.125)
    assert _failures(spark, tmp_path, [line])[0] == [(1, "orbit_ratio_range")]
    assert _failures(spark, tmp_path, [line], orbit_ratio_min=0.1)[0] == []


def test_exporters_pass_over_what_is_missing(spark):
    df = spark.createDataFrame([("a", "r", None)], "assembly_accession string, replicon_id string, length_bp bigint")
    assert knowledge.export_replicons(df).count() == 0
    other = spark.createDataFrame([(4, 16)], "n bigint, dicyclic_order bigint")
    assert knowledge.export_experiments(other).count() == 0


def test_cross_validation(spark):
    seqs = validate.test_sequences()
    assert len(seqs) == 104 and seqs == validate.test_sequences()
    total = validate.cross_validation(validate.sequences(spark, seqs), spark).where("function_name is null").first()
    assert (total["n_tests"], total["n_failed"]) == (535, 0)


def test_stream_of_replicons(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "GCF_9_genomic.fna").write_text(FASTA)
    q = read_stream(spark, str(src)).writeStream.format("memory").queryName("replicons").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("replicons").count() == 3


def test_kernel_counters(spark):
    good = '{"metric_name": "gc_fraction", "value": 0.5, "epsilon": 0.0, "confidence": 1.0, "provenance": {"atlas_git_sha": "a", "timestamp_utc": "t"}}'
    lines = [good, "", good.replace("0.5", "1.5").replace('"a"', '""'), "{", '{"value": 1}', "  ", good]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "record_idx long, value string")
    # Four records of seven checks with 0, 2, 1 and 0 failures, and a line that doesn't parse.
    assert tuple(verify.kernel_summary(df).first()) == (7, 29, 25, 4)
    assert verify.kernel_failures(df).count() == 4
    assert tuple(verify.kernel_summary(df.where("record_idx < 0")).first()) == (0, 0, 0, 0)


def test_lines_of_several_files_are_numbered_as_one(spark, tmp_path):
    lines = [f"line {i}" if i % 3 else "" for i in range(1, 400)]
    for part, (lo, hi) in enumerate(((0, 100), (100, 101), (101, 399))):
        (tmp_path / f"part-{part}").write_text("".join(x + "\n" for x in lines[lo:hi]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = verify.read_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, got.collect())) == list(enumerate(lines, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_download_tries_again_and_leaves_nothing_half(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if len(asked) < 3 or self.path.endswith("gone"):
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"x" * 3_000_000)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, folder = f"http://127.0.0.1:{server.server_port}", f"file://{tmp_path}/raw"
    try:
        to = fasta.download(spark, f"{url}/a.fna.gz", folder, wait=0.01)
        assert len(asked) == 3 and (tmp_path / "raw/a.fna.gz").read_bytes() == b"x" * 3_000_000
        assert fasta.download(spark, f"{url}/a.fna.gz", folder) == to and len(asked) == 3
        with pytest.raises(OSError):
            fasta.download(spark, f"{url}/gone", folder, wait=0.01)
    finally:
        server.shutdown()
    assert sorted(p.name for p in (tmp_path / "raw").iterdir() if not p.name.startswith(".")) == ["a.fna.gz"]
    sums = fasta.checksums(spark, folder).first()
    assert sums["checksum_sha256"] == hashlib.sha256(b"x" * 3_000_000).hexdigest()


def test_fetch_from_an_address(spark, data_dir):
    d, asked = f"{data_dir}/other", []

    def get(url, folder):
        asked.append(url)
        if not url.endswith("summary.txt"):
            raise OSError("no route")
        files.put(spark, f"{folder}/summary.txt", [SUMMARY.encode()])
        return f"{folder}/summary.txt"

    files.put(spark, f"{d}/raw/GCF_9_genomic.fna", [b">NC_1.1 x\nACGT\n"])
    pipeline.fetch(spark, d, "https://h/summary.txt", 2, get=get)
    assert len(asked) == 3 and fasta.read_manifest(spark, f"{d}/manifest/manifest.jsonl").count() == 1


def test_checks_catch_what_is_broken(spark, monkeypatch):
    from cyclaris.plans import validate

    df = spark.createDataFrame([("CCGTA",), ("GACC",)], "seq string")
    assert validate.all_passed(validate.operator_checks(df))
    monkeypatch.setattr(validate.s, "shift", lambda q, k: F.concat(F.lit("A"), F.substring(q, 2, 99)))
    monkeypatch.setattr(validate.s, "rev_comp", lambda q: F.upper(q))
    failed = {r["check_name"]: r["message"] for r in validate.operator_checks(df).where("not passed").collect()}
    assert failed.keys() == {"shift_cyclic", "rc_commutative", "dihedral_relation"} and "1, 2" in failed["dihedral_relation"]
    monkeypatch.setattr(validate.exact, "with_symmetry_stats", lambda d: d.withColumns({"orbit_size": F.lit(7), "orbit_ratio": F.lit(1.5), "rotational_period": F.lit(1)}))
    failed = {r["check_name"] for r in validate.symmetry_checks(df).where("not passed").collect()}
    assert failed == {"orbit_divides_2n", "orbit_ratio_bounds", "dmin_periodic_zero"}


def test_entry_tells_a_missing_part_from_a_missing_package(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).parent.parent
    code = "import sys; sys.path.insert(0, {0!r}); import builtins; real = builtins.__import__\n" \
        "def fake(name, *a, **k):\n    if name.split('.')[0] == {1!r}: raise ModuleNotFoundError(name, name={2!r})\n    return real(name, *a, **k)\n" \
        "builtins.__import__ = fake\nimport __spark_entry__ as e; print(len(e.queries()))"
    gone = subprocess.run([sys.executable, "-c", code.format(str(repo), "corpus_pipeline", "corpus_pipeline")], capture_output=True, text=True)
    assert gone.returncode == 0 and int(gone.stdout) > 50
    if (repo / "corpus_pipeline.py").exists():
        broken = subprocess.run([sys.executable, "-c", code.format(str(repo), "corpus_pipeline", "xxhash")], capture_output=True, text=True)
        assert broken.returncode != 0 and "xxhash" in broken.stderr
