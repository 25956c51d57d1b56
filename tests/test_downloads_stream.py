"""Downloads by tasks against a server of the test's own, and the manifest of a stream."""

import collections
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cyclaris.plans import pipeline
from cyclaris.sources import downloads, fasta
from cyclaris.streaming import replicons


@pytest.fixture
def server():
    state = {"asked": collections.Counter(), "now": 0, "most": 0, "cut": set(), "gone": set(), "slow": 0.0, "files": {}}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.rsplit("/", 1)[-1]
            with lock:
                state["asked"][name] += 1
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(state["slow"])
            try:
                if name in state["gone"]:
                    self.send_error(404)
                    return
                body = state["files"].get(name, b">NC_1.1 x\n" + name.encode().translate(None, b"._") * 1000)
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                first = state["asked"][name] == 1 and name in state["cut"]
                self.wfile.write(body[: len(body) // 2] if first else body)
            finally:
                with lock:
                    state["now"] -= 1

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{made.server_port}"
    yield state
    made.shutdown()


def urls_of(spark, server, names):
    return spark.createDataFrame([(n and f"{server['url']}/{n}",) for n in names], "url string").repartition(4)


def test_tasks_fetch_within_a_hosts_limit(spark, server, tmp_path):
    names = [f"f{i}.fna" for i in range(12)]
    server.update(slow=0.05, cut={"f3.fna"}, gone={"f5.fna"})
    df = urls_of(spark, server, [*names, "f0.fna", None, "other/f1.fna"])
    folder = f"file://{tmp_path}/raw"
    (tmp_path / "raw").mkdir()
    got = {r["url"].removeprefix(server["url"] + "/"): r for r in downloads.fetched(df, folder, wait=0.01).collect()}
    assert server["most"] <= 2 and server["asked"]["f0.fna"] == 1 and server["asked"]["f3.fna"] == 2 and server["asked"]["f5.fna"] == 3
    assert {n for n, r in got.items() if r["error"]} == {"f5.fna", "other/f1.fna"} and len(got) == 13
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == sorted(set(names) - {"f5.fna"})
    assert all((tmp_path / "raw" / n).stat().st_size == r["bytes"] for n, r in got.items() if not r["error"])
    again = downloads.fetched(df, folder, wait=0.01).where("error is null").collect()
    assert not any(r["fetched"] for r in again) and server["asked"]["f0.fna"] == 1
    assert downloads.fetched(df.where("false"), folder).count() == 0


def test_a_lost_task_costs_its_unfinished_file(spark, server, tmp_path):
    names = [f"g{i}.fna" for i in range(8)]
    (tmp_path / "raw").mkdir()
    df, folder, broken = urls_of(spark, server, names), f"file://{tmp_path}/raw", str(tmp_path / "broken")

    def opened(url):
        import os
        import urllib.request

        if url.endswith("g6.fna") and not os.path.exists(broken):
            open(broken, "w").close()
            raise RuntimeError("the task is lost")
        return urllib.request.urlopen(url)

    with pytest.raises(Exception, match="the task is lost"):
        downloads.fetched(df, folder, 1, opened=opened).collect()
    assert not (tmp_path / "raw/g6.fna").exists()
    done = downloads.fetched(df, folder, 1, opened=opened).collect()
    assert not any(r["error"] for r in done) and all(n == 1 for n in server["asked"].values()) and len(server["asked"]) == 8


def test_waits_between_requests(spark, server, tmp_path):
    began = time.monotonic()
    assert downloads.fetched(urls_of(spark, server, ["a.fna", "b.fna", "c.fna"]), f"file://{tmp_path}", 1, 0.3).where("fetched").count() == 3
    assert time.monotonic() - began > 0.6


def test_pipeline_fetches_by_tasks(spark, server, tmp_path):
    rows = [f"GCF_{i}\tComplete Genome\t{server['url']}/GCF_{i}" for i in range(3)]
    server["files"] = {"summary.txt": "\n".join(["#assembly_accession\tassembly_level\tftp_path", *rows]).encode()}
    server["files"] |= {f"GCF_{i}_genomic.fna.gz": __import__("gzip").compress(b">NC_7.1 x\nACGT\n>p plasmid\nGG\n") for i in range(2)}
    server["gone"] = {"GCF_2_genomic.fna.gz"}
    d = f"file://{tmp_path}/data"
    passed = pipeline.fetch(spark, d, f"{server['url']}/summary.txt", 10, wait=0.01)
    assert passed.count() == 0 and fasta.read_manifest(spark, f"{d}/manifest/manifest.jsonl").count() == 4
    pipeline.fetch(spark, d, f"{server['url']}/summary.txt", 10, wait=0.01)
    assert fasta.read_manifest(spark, f"{d}/manifest/manifest.jsonl").count() == 4 and server["asked"]["GCF_0_genomic.fna.gz"] == 1


def test_stream_writes_each_batch_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "manifest")
    source.mkdir()
    (source / "a.fna").write_text(">NC_1.1 x\nACGT\n>NC_2.1 plasmid\nGGCC\n")
    replicons.stream_manifest(spark, str(source), path, str(tmp_path / "c1")).awaitTermination()
    (source / "b.fna").write_text(">NC_3.1 y\nAAAA\n")
    for checkpoint in ("c1", "c1", "c2"):  # new files, none, all anew
        replicons.stream_manifest(spark, str(source), path, str(tmp_path / checkpoint)).awaitTermination()
    got = fasta.read_manifest(spark, path)
    assert sorted(r["replicon_id"] for r in got.collect()) == ["a_rep1", "a_rep2", "b_rep1"]
    raw = spark.read.option("recursiveFileLookup", True).schema(fasta.REPLICON).json(path)
    assert raw.count() == 6  # two streams
    batch = got.withColumn("more", got["length_bp"])
    for _ in range(2):  # a batch that runs again
        replicons.write_manifest_batch(batch, 7, str(tmp_path / "other"), "s")
    assert spark.read.option("recursiveFileLookup", True).schema(fasta.REPLICON).json(str(tmp_path / "other")).count() == 3
