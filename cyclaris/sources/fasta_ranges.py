"""FASTA files of any size as a Spark data source whose tasks read ranges of bytes.

A plain or block-gzipped file is cut into ranges of `range_bytes`; one that is gzipped as a whole is a single range, as it can't be
read from its middle. A range gives fragments: the header of a record, where the record begins in it, and letters of the
record, at most `FRAGMENT` a row. A line belongs to the range that its bytes lie in, so a line of any length is read by many
tasks; only headers are read as a whole, by the range in which they begin. A range looks back at most `HEADER_BYTES` to
see whether it begins within a header. A task reads one range, or several on end where there are many small ones: at least
`LEAST_TASKS` tasks are made of them, and none of more than `RANGE_BYTES`.

`fragments` numbers the records over the ranges of each file: what a range begins with belongs to the last record of the ranges
before it. Measures of records are sums over fragments (`record_stats`), so a chromosome is never one row; `assembled` puts
sequences together where they may be one. With `folders` the files of a folder count as one, in the order of their names, as
the part files of a table that was written by many tasks.

Files are read by the tasks themselves, through pyarrow's file systems: any address that these know (file, s3, gs, hdfs). For a
store that only Spark's readers reach there is `fasta.read_fasta`.

Defined cases: letters before a file's first header belong to no record and are left out; a record without letters has one
fragment with none; blank lines, carriage returns and other white space within sequences are dropped; an empty file or
folder gives no rows; headers longer than `HEADER_BYTES` are an error; a header that isn't UTF-8 has its wrong bytes replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fasta import assembly_of
from .files import scratch

RANGE_BYTES, FRAGMENT, HEADER_BYTES, READ_BYTES = 32 << 20, 1 << 20, 1 << 16, 1 << 20
ENDINGS = ".fna,.fa,.fasta,.fna.gz,.fa.gz,.fasta.gz"
#: Tasks that small ranges are dealt to at least, before one reads several.
LEAST_TASKS = 100
#: Ranges up to which their table (some 100 bytes a row) is broadcast.
MOST_RANGES = 300_000
SCHEMA = "file_path string, range_no long, fragment_no long, heads long, header string, seq string"
_SPACE = b" \t\n\r\x0b\x0c"
#: The start of a block of a block-gzipped file, up to its size, and where in it the size stands.
_BLOCK, _BLOCK_HEAD, _BLOCK_SIZE_AT = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 16


@dataclass
class Bytes:
    """A range of a file's text: what it holds, and what stands before and behind it."""

    before: Callable[[int], bytes]
    own: Callable[[], Iterator[bytes]]
    after: Callable[[], Iterator[bytes]]


def plain(f, start: int, end: int) -> Bytes:
    """A range of an uncompressed file; f is open for reading at any place."""

    def between(a: int, b: int) -> Iterator[bytes]:
        while a < b:
            f.seek(a)
            got = f.read(min(READ_BYTES, b - a))
            if not got:
                return
            a += len(got)
            yield got

    size = f.size()
    return Bytes(lambda n: b"".join(between(max(0, start - n), start)), lambda: between(start, end), lambda: between(end, size))


def is_blocked(head: bytes) -> bool:
    """Whether a file that begins so is gzipped in blocks."""
    return head[:4] == _BLOCK and head[12:16] == _BLOCK_HEAD


def _block_at(data: bytes, at: int) -> int:
    """The first place from `at` on where a block begins, or -1. A place counts if another block, or the end, follows it."""
    while (at := data.find(_BLOCK, at)) >= 0:
        if is_blocked(data[at : at + 18]):
            nxt = at + int.from_bytes(data[at + _BLOCK_SIZE_AT : at + 18], "little") + 1
            if nxt >= len(data) or is_blocked(data[nxt : nxt + 18]) or data[nxt : nxt + 4] == _BLOCK[: len(data) - nxt]:
                return at
        at += 1
    return -1


def blocked(f, start: int, end: int) -> Bytes:
    """A range of a block-gzipped file: the blocks that begin in it."""
    size = f.size()

    def read(a: int, n: int) -> bytes:
        f.seek(a)
        return f.read(n)

    def first_block(a: int) -> int:
        """Where the first block from a on begins; the file's end if there is none."""
        if a == 0 or a >= size:
            return min(a, size)
        # A block has at most 64 KB, so another begins among so many bytes, and one more follows.
        at = _block_at(read(a, 3 << 16), 0)
        return size if at < 0 else a + at

    def blocks(a: int, b: int) -> Iterator[bytes]:
        """The text of the blocks that begin from a (a block's beginning) up to b."""
        held, at = b"", a
        while a < b:
            if a + (1 << 16) > at + len(held):
                held, at = read(a, READ_BYTES), a
            n = int.from_bytes(held[a - at + _BLOCK_SIZE_AT : a - at + 18], "little") + 1
            if len(held) < a - at + 18 or not is_blocked(held[a - at : a - at + 18]) or a + n > size:
                raise ValueError("the file is cut off or damaged")
            yield zlib.decompress(held[a - at : a - at + n], 31)
            a += n

    mine, behind = first_block(start), first_block(end)

    def before(n: int) -> bytes:
        back = 4 * n
        while True:
            a = first_block(max(0, mine - back))
            text = b"".join(blocks(a, mine))
            if a == 0 or len(text) >= n:
                return text[-n:]
            back *= 4

    return Bytes(before, lambda: blocks(mine, behind), lambda: blocks(behind, size))


def gzipped(f, start: int, end: int) -> Bytes:
    """A file gzipped as a whole, in one or more members."""

    def own() -> Iterator[bytes]:
        d, data = zlib.decompressobj(31), b""
        f.seek(0)
        while data or (data := f.read(READ_BYTES)):
            text = d.decompress(data, READ_BYTES)
            data = d.unconsumed_tail
            if text:
                yield text
            if d.eof:
                data = d.unused_data or f.read(READ_BYTES)
                d = zlib.decompressobj(31)
                if not data.strip(b"\0"):
                    return
        if text := d.flush():
            yield text
        if not d.eof:
            raise ValueError("the file is cut off or damaged")

    return Bytes(lambda n: b"", own, lambda: iter(()))


def fragments_of(text: Bytes) -> Iterator[tuple[int, str | None, bytes]]:
    """(headers so far, header or None, letters) of a range, letters in capitals."""
    before = text.before(HEADER_BYTES)
    line = before.rfind(b"\n") + 1
    at_start = line == len(before)  # the range begins with a line
    whole = line > 0 or len(before) < HEADER_BYTES  # that line's beginning is known
    in_header = not at_start and whole and before[line : line + 1] == b">"
    heads, header, letters, fresh = 0, None, bytearray(), False
    title: bytearray | None = None  # a header of one's own that isn't complete

    def flushed(everything: bool) -> Iterator[tuple[int, str | None, bytes]]:
        nonlocal header, fresh
        while len(letters) > FRAGMENT or everything and (letters or fresh):
            yield heads, header, bytes(letters[:FRAGMENT])
            del letters[:FRAGMENT]
            header, fresh = None, False

    def titled() -> None:
        nonlocal heads, header, fresh, title
        heads, header, fresh = heads + 1, title.removesuffix(b"\r").decode(errors="replace"), True
        title = None

    for chunk in text.own():
        at = 0
        while at < len(chunk):
            if in_header or title is not None:
                end = chunk.find(b"\n", at)
                stop = len(chunk) if end < 0 else end
                if title is not None:
                    title += chunk[at:stop]
                    if len(title) > HEADER_BYTES:
                        raise ValueError(f"a header has more than {HEADER_BYTES} bytes")
                if end >= 0:
                    if title is not None:
                        titled()
                    in_header = False
                    at_start = True
                at = stop + (end >= 0)
            elif at_start and chunk[at : at + 1] == b">":
                yield from flushed(True)
                title, at_start = bytearray(), False
                at += 1
            else:
                end = chunk.find(b"\n>", at)
                stop = len(chunk) if end < 0 else end + 1
                letters += chunk[at:stop].translate(None, _SPACE).upper()
                at_start = chunk[stop - 1 : stop] == b"\n"
                at = stop
                yield from flushed(False)
    if title is not None:
        for chunk in text.after():
            end = chunk.find(b"\n")
            title += chunk if end < 0 else chunk[:end]
            if len(title) > HEADER_BYTES:
                raise ValueError(f"a header has more than {HEADER_BYTES} bytes")
            if end >= 0:
                break
        titled()
    yield from flushed(True)


def heads_of(text: Bytes) -> int:
    """How many headers begin in a range: as many as lines that begin there with >."""
    last, n = text.before(1)[-1:] or b"\n", 0
    for chunk in text.own():
        n += chunk.count(b"\n>") + (last == b"\n" and chunk[:1] == b">")
        last = chunk[-1:] or last
    return n


@dataclass
class Ranges(InputPartition):
    """Ranges of a file on end, from a number on: a range begins at each of `cuts` but the last."""

    path: str
    number: int
    cuts: list[int]
    kind: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.endings, self.only_heads = tuple(options.get("endings", ENDINGS).split(",")), options.get("only_heads", "false") == "true"

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info]
        if info.type == fs.FileType.Directory:
            found = [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.base_name.endswith(self.endings)]
        ranges = []
        for x in sorted(found, key=lambda x: x.path):
            kind = "plain"
            if x.path.endswith(".gz"):
                with store.open_input_file(x.path) as f:
                    kind = "blocked" if is_blocked(f.read(18)) else "gzipped"
            step = max(1, x.size if kind == "gzipped" else self.range_bytes)
            ranges.append((x.path, [*range(0, x.size, step), x.size], kind))
        most = max(1, RANGE_BYTES // self.range_bytes)
        each = min(most, max(1, sum(len(cuts) - 1 for _, cuts, _ in ranges) // LEAST_TASKS))
        made = [Ranges(path, i, cuts[i : i + each + 1], kind) for path, cuts, kind in ranges for i in range(0, len(cuts) - 1, each)]
        return made or [Ranges("", 0, [], "plain")]

    def read(self, part: Ranges) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        if not part.path:
            return
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, counts = [], []

        def batch(path: str, number: int) -> pa.RecordBatch:
            """What rows hold, all of one range."""
            cells = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:])]
            return pa.RecordBatch.from_arrays([pa.repeat(path, len(rows)), pa.repeat(pa.scalar(number, pa.int64()), len(rows)), *cells], schema=schema)

        with store.open_input_file(part.path) as f:
            for number, (start, end) in enumerate(zip(part.cuts, part.cuts[1:]), part.number):
                text, size = {"plain": plain, "blocked": blocked, "gzipped": gzipped}[part.kind](f, start, end), 0
                if self.only_heads:
                    counts.append({"file_path": part.path, "range_no": number, "fragment_no": 0, "heads": heads_of(text)})
                    continue
                for i, (heads, header, letters) in enumerate(fragments_of(text)):
                    rows.append((i, heads, header, letters.decode(errors="replace")))
                    size += len(letters) + 256
                    if size > FRAGMENT:
                        yield batch(part.path, number)
                        rows, size = [], 0
                if rows:
                    yield batch(part.path, number)
                    rows = []
        if counts:
            yield pa.RecordBatch.from_pylist(counts, schema=schema)


class FastaRanges(DataSource):
    """spark.read.format("fasta_ranges").load(address); options: range_bytes, endings (comma-joined), only_heads (a row for each
    range, with its count of headers)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def fragments(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, endings: str = ENDINGS, folders: bool = False) -> DataFrame:
    """file_path, assembly_accession, number (of the record in its file, from 1), header (in a record's first fragment), place (of
    the fragment in its record, growing) and seq of all FASTA files under path.

    folders: the files of a folder count as one, in the order of their names, and file_path is the folder's.
    """
    spark.dataSource.register(FastaRanges)
    source = spark.read.format("fasta_ranges").option("range_bytes", range_bytes).option("endings", endings)
    # A row for each range. Its first records' numbers follow the headers of the ranges before it.
    whole = F.regexp_replace("file_path", "/[^/]*$", "") if folders else F.col("file_path")
    order = Window.partitionBy(whole).orderBy("file_path", "range_no")
    ahead = F.coalesce(F.sum("heads").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = source.option("only_heads", "true").load(path)
    counted = counted.select("file_path", "range_no", ahead.alias("ahead"), F.row_number().over(order).cast("long").alias("nth"))
    at = scratch(spark, "fasta-ranges")
    counted.write.parquet(at)
    sizes = spark.read.schema(counted.schema).parquet(at)
    # So that no sequence is shuffled; beyond so many ranges Spark joins them as it sees fit.
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_RANGES else sizes
    rows = source.option("only_heads", "false").load(path).join(sizes, ["file_path", "range_no"])
    name = F.element_at(F.split("file_path", "/"), -1)
    place = F.struct(F.col("nth").alias("range_no"), "fragment_no").alias("place")
    rows = rows.withColumn("number", F.col("ahead") + F.col("heads")).where("number > 0").withColumn("file_path", whole)
    return rows.select("file_path", assembly_of(name).alias("assembly_accession"), "number", "header", place, "seq")


def record_stats(found: DataFrame, **more: Column) -> DataFrame:
    """file_path, assembly_accession, number, header, length_bp and gc_fraction of each record of fragments; more: further sums or the like
    over a record's fragments. Fragments are summed where they are read, so no sequence is shuffled."""
    gc = F.sum(F.length("seq") - F.length(F.replace(F.replace("seq", F.lit("G")), F.lit("C"))))
    n = F.sum(F.length("seq"))
    made = found.groupBy("file_path", "assembly_accession", "number").agg(F.max("header").alias("header"), n.cast("long").alias("length_bp"), gc.alias("gc"), *(c.alias(k) for k, c in more.items()))
    share = F.when(F.col("length_bp") == 0, 0.0).otherwise(F.col("gc") / F.nullif("length_bp", F.lit(0)))
    return made.withColumn("gc_fraction", share.cast("double")).drop("gc")


def sequence() -> Column:
    """The sequence of a record, as an aggregate over its fragments: beside others in record_stats, so that files are read once. It must be
    under 2 GB, as a row is."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "seq"))), lambda x: x["seq"]), "")


def assembled(found: DataFrame) -> DataFrame:
    """file_path, assembly_accession, number, header, seq: the records of fragments as rows, as fasta.records gives them."""
    made = found.groupBy("file_path", "assembly_accession", "number").agg(F.max("header").alias("header"), sequence().alias("seq"))
    return made.select("file_path", "assembly_accession", "number", "header", "seq")
