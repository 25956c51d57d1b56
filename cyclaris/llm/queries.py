"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, embedding_dedup, html_text, katz, line_dedup, packing, prefix_trie, quality, secrets, sharding, simhash, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.query,
    "op8_html_extraction": html_text.query,
    "op9_secret_scans": secrets.query,
    "op2_warc": warc.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op3_bpe": bpe.query,
    "op4_simhash": simhash.query,
    "op5_sharding": sharding.query,
    "op6_katz_scores": katz.query,
    "op7_best_fit_packing": packing.query,
    "op11_whitening": whitening.query,
    "op12_line_dedup": line_dedup.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op2_warc": warc.ORACLE,
    "op9_secret_scans": secrets.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
