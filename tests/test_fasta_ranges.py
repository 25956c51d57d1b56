"""The FASTA source by ranges of bytes: every cut gives the records that a plain reading gives."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cyclaris.sources import fasta_ranges as fr


def text_of(rng: random.Random, long_line: bool = False) -> bytes:
    out = [rng.choice([b"", b"ACGT\nstray\n", b"\n\n"])]
    for i in range(rng.randrange(1, 12)):
        end = rng.choice([b"\n", b"\r\n"])
        out.append(b">" + f"NC_{i}.1 record é > {i}".encode()[: rng.randrange(1, 30)] + end)
        for _ in range(rng.choice([0, 1, 3, 30])):
            out.append(bytes(rng.choices(b"acgtACGTN ", k=rng.choice([0, 1, 70, 5000 if long_line else 60]))) + end)
    return b"".join(out).rstrip(b"\n") if rng.random() < 0.5 else b"".join(out)


def records_of(text: bytes) -> list[tuple[str, str]]:
    out = []
    for line in text.split(b"\n"):
        if line.startswith(b">"):
            out.append([line[1:].removesuffix(b"\r").decode(errors="replace"), b""])
        elif out:
            out[-1][1] += bytes(c for c in line.upper() if c not in b" \t\r\x0b\x0c")
    return [(h, s.decode()) for h, s in out]


def block(text: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(text) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def blocks(text: bytes, size: int) -> bytes:
    return b"".join(block(text[i : i + size]) for i in range(0, len(text), size)) + block(b"")


def joined(ranges) -> list[tuple[str, str]]:
    """Records from the fragments of the ranges in order."""
    out = []
    for text in ranges:
        for _, header, letters in fr.fragments_of(text):
            if header is not None:
                out.append([header, ""])
            if out:
                out[-1][1] += letters.decode()
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(3))
def test_every_cut_gives_the_same_records(tmp_path, monkeypatch, seed):
    from pyarrow import fs

    monkeypatch.setattr(fr, "FRAGMENT", 50)
    monkeypatch.setattr(fr, "READ_BYTES", 37)
    rng, store = random.Random(seed), fs.LocalFileSystem()
    for _ in range(2):
        text = text_of(rng)
        path = tmp_path / "x.fna"
        path.write_bytes(text)
        with store.open_input_file(str(path)) as f:
            for step in (1, 64, 1000, len(text) + 1):
                cuts = [(a, min(a + step, len(text))) for a in range(0, len(text), step)]
                assert joined(fr.plain(f, a, b) for a, b in cuts) == records_of(text)
    # Lines longer than what a range looks back
    monkeypatch.setattr(fr, "HEADER_BYTES", 100)
    text = b">h1\n" + b"ACGT" * 2000 + b"\n>h2\n" + b"G" * 500
    path.write_bytes(text)
    with store.open_input_file(str(path)) as f:
        assert joined(fr.plain(f, a, min(a + 300, len(text))) for a in range(0, len(text), 300)) == records_of(text)


@pytest.mark.parametrize("size", [40, 900, 65_280])
def test_blocks_and_whole_gzip(tmp_path, size):
    from pyarrow import fs

    rng, store, path = random.Random(size), fs.LocalFileSystem(), tmp_path / "x.fna.gz"
    for _ in range(1):
        text = b"".join(text_of(rng, True) + b"\n" for _ in range(3))
        data = blocks(text, size)
        path.write_bytes(data)
        with store.open_input_file(str(path)) as f:
            assert fr.is_blocked(f.read(18))
            for step in (3000, 70_000, len(data) + 1):
                assert joined(fr.blocked(f, a, min(a + step, len(data))) for a in range(0, len(data), step)) == records_of(text)
        path.write_bytes(gzip.compress(text[:500]) + gzip.compress(text[500:]))
        with store.open_input_file(str(path)) as f:
            assert joined([fr.gzipped(f, 0, f.size())]) == records_of(text)
    path.write_bytes(gzip.compress(text)[:-20])
    with store.open_input_file(str(path)) as f, pytest.raises(ValueError):
        joined([fr.gzipped(f, 0, f.size())])


def test_source(spark, tmp_path):
    rng, want = random.Random(3), []
    for i in range(4):
        text = b">first\n" + b"\n".join(text_of(rng, True) for _ in range(4))
        name = ("a.fna", "b.fa", "c_genomic.fna.gz", "d.fasta.gz")[i]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes((text, text, blocks(text, 3000), gzip.compress(text))[i])
        want += [(name.split(".")[0].removesuffix("_genomic"), n, h, s) for n, (h, s) in enumerate(records_of(text), 1)]
    (tmp_path / "in" / "e.fna").write_bytes(b"")
    (tmp_path / "in" / "notes.txt").write_bytes(b">no\nA\n")
    found = fr.fragments(spark, str(tmp_path / "in"), 20_000)
    got = [tuple(r)[1:] for r in fr.assembled(found).collect()]
    assert sorted(got) == sorted(want) and found.rdd.getNumPartitions() > 12
    stats = fr.record_stats(found, fragments=F.count("*")).collect()
    sizes = {(r["assembly_accession"], r["number"]): (r["header"], r["length_bp"], round(r["gc_fraction"], 12)) for r in stats}
    assert sizes == {(a, n): (h, len(s), round((s.count("G") + s.count("C")) / max(1, len(s)), 12)) for a, n, h, s in want}


def test_no_files(spark, tmp_path):
    assert fr.fragments(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.fna").write_bytes(b"no header\n")
    assert fr.assembled(fr.fragments(spark, str(tmp_path / "a.fna"))).count() == 0


def test_small_ranges_share_tasks_and_part_files_count_as_one(spark, tmp_path):
    want = []
    for i, folder in enumerate(("x", "y")):
        (tmp_path / folder).mkdir()
        for part in range(3):
            records = [(f"h{i}{part}{j}", "ACGT" * (1 + 700 * (j % 2))) for j in range(4)]
            (tmp_path / folder / f"part-{part}.fa").write_text("".join(f">{h}\n{q}\n" for h, q in records))
            want += [(folder, 4 * part + j, h, len(q), q) for j, (h, q) in enumerate(records, 1)]
    parts = fr._Reader({"path": str(tmp_path), "range_bytes": "20"}).partitions()
    ranges = sum(len(p.cuts) - 1 for p in parts)
    assert ranges > 1600 and 100 <= len(parts) <= 120
    found = fr.fragments(spark, str(tmp_path), 20, folders=True)
    got = fr.record_stats(found, seq=fr.sequence()).select(F.element_at(F.split("file_path", "/"), -1), "number", "header", "length_bp", "seq")
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("step", [1, 7, 100])
def test_headers_are_counted_as_they_are_read(tmp_path, step):
    from pyarrow import fs

    text, path = b"".join(text_of(random.Random(s)) + b"\n" for s in range(5)), tmp_path / "x.fna"
    path.write_bytes(text)
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        for a in range(0, len(text), step):
            one = fr.plain(f, a, min(a + step, len(text)))
            assert fr.heads_of(one) == max((h for h, _, _ in fr.fragments_of(one)), default=0)
