"""Web archives packed in ZIP files: writing them, and reading their records by ranges without extraction.

An archive is a ZIP file with stored (uncompressed) members: archive/data.warc.gz, in which every record is a gzip member
of its own, and indexes/index.cdxj, one JSON line for each record with its offset and length. The reader takes the end of
the file, finds the end-of-central-directory record or, where numbers run over, its ZIP64 form, parses the central
directory, and turns a stored member into a range of the file; records are then ranges within that range.

Of pages with equal payloads that with the largest page_id is written as a response, the others as revisits of it. The
groups come from digests and an aggregate, so no group of copies meets in one task; payloads aren't shuffled unless the
table of groups is too large to be broadcast. Archives are written by tasks into the shared folder under names of their
own; a manifest lists those of the attempts that ended well, so a lost executor leaves at worst a file that nobody reads.

Defined cases: a null html is an empty payload; empty payloads are equal to each other; rows of equal page_id and payload
are all responses if theirs is the largest page_id; a null page_id ranks below all others; a null url becomes a URN;
a very long payload is one record, read in pieces; further columns are ignored; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

#: An archive is closed when its records take so many bytes; bytes that a reader takes at once.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 4 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    urn = f"urn:page:{page_id}"
    target = "".join(url.split()) if url and url.strip() else urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{urn}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


class ArchiveWriter:
    """Writes one archive to a stream, record by record."""

    def __init__(self, stream: io.RawIOBase) -> None:
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.bytes, self.lines = 0, []

    def add(self, data: bytes, **about: object) -> None:
        self.member.write(data)
        self.lines.append(json.dumps(about | {"offset": self.bytes, "length": len(data), "filename": RECORDS}))
        self.bytes += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX, "".join(f"{x}\n" for x in self.lines))
        self.zip.close()


def _opened(uri: str):
    """A file system that reaches uri, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def archived(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives into folder; the manifest: path, n_records."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("_d", F.unhex(F.sha2("html", 256)))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("_d").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    groups = written(groups.where("_n > 1 and _last is not null").select("_d", "_last"), "payloads")
    own = F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))
    rows = rows.join(groups, "_d", "left").withColumn("refers_to", F.when(own, F.col("_last")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        done, out, stream, name = [], None, None, ""

        def close() -> None:
            out.close()
            stream.close()
            done.append((f"{folder}/{name}", len(out.lines)))

        for b in batches:
            ids, refers = (b[c].astype("Int64") for c in ("page_id", "refers_to"))
            for page, url, text, ref in zip(ids, b["url"], b["html"], refers):
                page, ref = (None if pd.isna(x) else int(x) for x in (page, ref))
                if out is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    stream = system.open_output_stream(f"{at}/{name}")
                    out = ArchiveWriter(stream)
                out.add(record(page, url, text.encode(), ref), page=page, url=url)
                if out.bytes >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "n_records"])

    out = rows.select("page_id", "url", "html", "refers_to").mapInPandas(write, "path string, n_records long")
    return written(out, "manifest")


# Reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class Archive:
    """A ZIP file of which ranges can be read."""

    def __init__(self, read, size: int) -> None:
        self.read, self.size = read, size  # read(offset, length) -> bytes
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark stood inside the comment
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("numbers run over, but there is no ZIP64 locator")
            at = struct.unpack_from("<Q", locator, 8)[0]
            wide = self.read(at, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory at its place")
            count, length, offset = struct.unpack_from("<QQQ", wide, 32)
        data, at, out = self.read(offset, length), 0, []
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size = struct.unpack_from("<II", data, at + 20)
            n, extra, comment = struct.unpack_from("<HHH", data, at + 28)
            header_at = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            fields = data[at + 46 + n : at + 46 + n + extra]
            size, _, header_at = self._wide(fields, size, packed, header_at)
            out.append(Member(name, method, size, header_at))
            at += 46 + n + extra + comment
        return out

    @staticmethod
    def _wide(fields: bytes, *numbers: int) -> list[int]:
        """size, packed size and offset, of which those that run over stand in the ZIP64 field in this order."""
        at, values = 0, list(numbers)
        while at + 4 <= len(fields):
            kind, n = struct.unpack_from("<HH", fields, at)
            if kind == 1:
                inner = at + 4
                for i, x in enumerate(numbers):
                    if x == 0xFFFFFFFF:
                        values[i] = struct.unpack_from("<Q", fields, inner)[0]
                        inner += 8
            at += 4 + n
        return values

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} isn't stored but compressed")
        head = self.read(m.header_at, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        n, extra = struct.unpack_from("<HH", head, 26)
        return m.header_at + 30 + n + extra, m.size

    def records(self, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
        """Offset in the archive, and bytes, of every record that an index lists; neighbours are read together."""
        for name in sorted(self.members):
            if not (name.startswith("indexes/") and name.endswith(".cdxj")):
                continue
            lines = [json.loads(x) for x in self.read(*self.place(name)).splitlines() if x.strip()]
            ranges = []
            for x in lines:
                start, size = self.place(x["filename"])
                if x["offset"] + x["length"] > size:
                    raise ValueError("an index points beyond its member")
                ranges.append((start + x["offset"], x["length"]))
            i = 0
            while i < len(ranges):
                j = i + 1
                while j < len(ranges) and ranges[j][0] == sum(ranges[j - 1]) and sum(ranges[j]) - ranges[i][0] <= read_bytes:
                    j += 1
                block = self.read(ranges[i][0], sum(ranges[j - 1]) - ranges[i][0])
                for at, length in ranges[i:j]:
                    yield at, block[at - ranges[i][0] :][:length]
                i = j


def parsed(data: bytes) -> dict[str, object]:
    """A record's fields; its payload if it has one. Its digest is checked."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError("a payload differs from its digest")

    def page(field: str) -> int | None:
        found = fields.get(field, "<urn:page:None>").strip("<>").rpartition(":")[2]
        return None if found == "None" else int(found)

    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": stated,
        "refers_to": page("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


FIELDS = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "binary"}


def records(manifest: DataFrame, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """All records of the archives in manifest (path): archive, offset, length and the fields asked for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                system, at = _opened(path)
                with system.open_input_file(at) as f:
                    rows, held = [], 0
                    for offset, data in Archive(lambda o, n: f.read_at(n, o), f.size()).records():
                        found = parsed(data)
                        rows.append((path, offset, len(data), *(found[k] for k in fields)))
                        held += len(data)
                        if held > READ_BYTES:
                            yield frame(rows)
                            rows, held = [], 0
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["archive", "offset", "length", *fields])
        for c in {"page_id", "refers_to"} & {*fields}:
            out[c] = out[c].astype("Int64")
        return out

    schema = ", ".join(["archive string", "offset long", "length long", *(f"{k} {FIELDS[k]}" for k in fields)])
    # An archive to a task, as far as there are tasks.
    spread = manifest.select("path").repartition(max(1, manifest.count()))
    return spread.mapInPandas(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archived(table(spark, sf_dir, "pages"), new_path(spark, "archives"))
    wanted = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return records(manifest, wanted).select(*wanted)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages),
bits as (
  select *, array_to_string(list_transform(string_split(d, ''), lambda h: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', h) - 1)::int + 1, 4)), '') as b,
    max(page_id) over (partition by html) as last_id
  from p),
named as (
  select page_id, strlen(html)::bigint as payload_bytes, last_id, array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * substr(b, 5 * i + 1, 1)::int + 8 * substr(b, 5 * i + 2, 1)::int
    + 4 * substr(b, 5 * i + 3, 1)::int + 2 * substr(b, 5 * i + 4, 1)::int + substr(b, 5 * i + 5, 1)::int + 1)::int, 1)), '') as payload_digest
  from bits)
select page_id, payload_bytes, payload_digest,
  case when last_id is not null and page_id is distinct from last_id then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from last_id then last_id end as refers_to
from named
"""
