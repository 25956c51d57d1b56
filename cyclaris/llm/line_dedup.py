"""Lines that stand in many documents, dropped from all but one of them.

Lines are exploded and normalised, and every line long enough gives a row (document, line's number, 128-bit hash of its key).
Documents are counted once for each hash, after partial counts, so that a line of a third of all documents is no hot key.
Hashes in many documents are then looked up for every line (frequent ones by broadcast, `common.looked_up`), which gives
the numbers of the lines that go; texts are put together from what stays, by position. Line texts are never shuffled, and a
text only where the table of what goes is too large for Spark to broadcast.

A document is told apart by its doc_id: rows with equal ids are one document, and so are all rows whose id is null, which
counts as less than any other. What goes from a row is found by doc_id and text, so it doesn't depend on the order or the
partitions in which rows are read.

Defined cases: a null or empty text is one empty line; a blank line's key is empty and too short to count; lines repeated
within a document count once and go, or stay, together; copies of a row are treated alike; a very long text gives as many
rows as it has lines; an empty table gives an empty result; further columns go along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import looked_up, table, written

#: Code points from which a key counts, and documents from which it is dropped.
MIN_CHARS, MIN_DOCUMENTS = 40, 5
#: Rows that a task gives on at once.
ROWS_AT_ONCE = 1 << 16


def key_of(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, in lower case as far as it is ASCII."""
    return line.strip().lower()


def _text(text: Column | str = "text") -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text's name (two hashes of it) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t1 and t2 (the text's name), line (from 0) and key (a hash of 16 bytes) of each line whose key is long enough."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, t1, t2, texts = (batch.column(i) for i in range(4))
            rows, lines, keys = [], [], []

            def made() -> pa.RecordBatch:
                at = pa.array(np.array(rows, np.int64))
                key = pa.array(keys, pa.binary())
                return pa.record_batch([*(x.take(at) for x in (ids, t1, t2)), pa.array(lines, pa.int32()), key], ["doc_id", "t1", "t2", "line", "key"])

            for row, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                for i, line in enumerate(text.split(b"\n")):
                    key = key_of(line)
                    # A character has one to four bytes.
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode(errors="replace")) >= min_chars):
                        rows.append(row)
                        lines.append(i)
                        keys.append(digest(key))
                if len(rows) >= ROWS_AT_ONCE:
                    yield made()
                    rows.clear(), lines.clear(), keys.clear()
            if rows:
                yield made()

    rows = _named(docs).select("doc_id", "t1", "t2", "text")
    return rows.mapInArrow(cut, "doc_id long, t1 long, t2 long, line int, key binary")


def frequent(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """key, n (its documents) and keeper (the largest doc_id that holds it) of the keys in many documents."""
    some_null = F.max(F.col("doc_id").isNull().cast("long"))
    counted = lines.groupBy("key").agg((F.count_distinct("doc_id") + some_null).alias("n"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n") >= min_documents)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, t1, t2 and gone (numbers of the lines that go, in order) of the documents that lose lines."""
    lines = keyed_lines(docs, min_chars)
    hits = looked_up(lines, written(frequent(lines, min_documents), "frequent-lines"), "key")
    hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # A set: copies of a row have the same numbers, and are many rows of one group perhaps.
    return hits.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("line")).alias("gone"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers; null where there are none."""

    def one(text, numbers):
        if numbers is None:
            return None
        out = set(numbers.tolist())
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in out])

    return pd.Series([one(t, g) for t, g in zip(texts, gone)], dtype=object)


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """row (the columns of docs, text without the lines that go), n_lines (before) and n_dropped of each row of docs.

    A text that loses nothing stays as it is, null included.
    """
    gone = written(dropped_lines(docs, min_chars, min_documents), "dropped-lines")
    text = _text()
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
    )
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "gone")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    found = rows.join(gone, same, "left").select("row", "gone")
    whole = _text(F.col("row.text"))
    short = _without(F.when(F.col("gone").isNotNull(), whole), "gone")
    found = found.select("row", "gone", short.alias("short"))
    kind = docs.schema["text"].dataType
    row = F.col("row").withField("text", F.coalesce(F.col("short").cast(kind), F.col("row.text")))
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.coalesce(F.size("gone"), F.lit(0))
    return found.select(row.alias("row"), n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(_text(F.col("row.text")), 256).alias("kept_sha256")
    return deduplicated(docs).select("row.doc_id", "n_lines", "n_dropped", digest)


ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= {MIN_CHARS} group by key
  having count(distinct doc_id) + max((doc_id is null)::int) >= {MIN_DOCUMENTS}),
m as (select k.*, f.key is not null and k.doc_id is distinct from keeper as goes from k left join f using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (goes) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not goes), '')) as kept_sha256
from m group by r
"""
