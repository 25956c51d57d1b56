import collections

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cyclaris.llm import packing, queries, quality, secrets

from ..helpers import DATA, duck, rows_of
from .cases import documents, saved, texts
from .test_text_operators import plain_fingerprint, true_labels


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of(duck().sql(queries.ORACLES[name]))


def test_a_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_against_a_plain_version(spark, tmp_path):
    df = documents(spark, texts() + [(50 + i, f"{t} variant {i}") for i, (_, t) in enumerate(texts()) if t and i < 3])
    got = corpus_pipeline.run(spark, saved(df.repartition(2), tmp_path, "documents")).collect()
    passed = [(r["doc_id"], r["text"]) for r in quality.judged(df).where("kept").collect()]
    prints = np.unique(np.array([plain_fingerprint(t) for _, t in passed], np.uint64))
    label = dict(zip(prints.tolist(), true_labels(prints)))
    groups = collections.defaultdict(list)
    for i, t in passed:
        groups[label[plain_fingerprint(t)]].append((i is None, i or 0, t))
    kept = [min(g) for g in groups.values()]
    clean = secrets.redacted(documents(spark, [(None if none else i, t) for none, i, t in kept])).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    want = collections.Counter({r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean})
    have = collections.Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want and any("[assign]" in r["text"] for r in clean)


def test_stages_keep_the_columns_of_documents(spark):
    df = documents(spark).repartition(2)
    before = {tuple(r)[2:4] + tuple(r)[5:] for r in df.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, df, "")
        assert made.columns == df.columns
        assert {tuple(r)[2:4] + tuple(r)[5:] for r in made.collect()} == before  # whatever the columns are called
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secrets", "packing"]


def test_pipeline_of_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, saved(documents(spark, []), tmp_path, "documents")).count() == 0
