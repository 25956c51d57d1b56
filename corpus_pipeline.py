"""A pipeline over documents: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents.

Defined cases: a null or empty text is rejected by the quality rules; a very long one is judged, scanned and packed whole; rows
with null or equal doc_ids are told apart by their texts; repeated rows are copies, of which one stays; extra columns go
along until packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cyclaris.llm import packing, quality, secrets, simhash
from cyclaris.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules."""
    return quality.filtered(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id."""
    return simhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret of their texts replaced by its kind in brackets."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all rows, packed into sequences."""
    return packing.packed(docs, packing.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The near-duplicate and packing stages have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
