"""Line dedup, whitening and the prefix trie against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclaris.llm import line_dedup, prefix_trie, whitening

from ..helpers import duck, rows_of
from .cases import documents, saved, texts

# Line dedup

LONG = [f"  This is the passage number {i} that stands in several documents\r" for i in range(4)]


def line_rows():
    rows = texts()
    rows += [(100 + i, "\n".join(["own line of this document, number " + str(i) * 20, LONG[0], LONG[1].upper(), LONG[0]])) for i in range(6)]
    rows += [(200, LONG[0] + "\n" + LONG[2]), (200, LONG[2]), (200, LONG[2]), (201, LONG[2]), (202, LONG[2]), (203, LONG[2])]  # four documents
    rows += [(None, LONG[3]), (None, LONG[3] + "\n\n"), (301, LONG[3]), (302, LONG[3].lower()), (303, "x\n" + LONG[3]), (304, LONG[3])]  # five: nulls are one
    rows += [(400 + i, "short line\n" + "é" * 39 + "\n" + "É" * 40) for i in range(5)]
    return rows + [(500 + i, "\n".join(f"line {j} of a very long text with many lines in it" for j in range(20_000))) for i in range(5)]


def plain_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            docs = held[key(line)]
            known = [d for d in docs if d is not None]
            if len(key(line)) < 40 or len(docs) < 5 or i == (max(known) if known else None):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 3])
def test_lines(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr("cyclaris.llm.common.HOT_ROWS", hot)
    folder = saved(documents(spark, line_rows()).repartition(3), tmp_path, "documents")
    got = sorted(map(tuple, line_dedup.query(spark, folder).collect()), key=repr)
    assert got == plain_lines(line_rows()) and sum(r[2] for r in got) > 80_000


def test_lines_equal_sql(spark, tmp_path):
    folder = saved(documents(spark, line_rows()), tmp_path, "documents")
    con = duck()
    con.execute(f"create or replace view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert rows_of(line_dedup.query(spark, folder)) == rows_of(con.sql(line_dedup.ORACLE))


def test_lines_keep_rows_and_columns(spark):
    names = "doc_id long, text string, gone int, short string, row string, id long, t1 long, _id long, _t1 long, key string, line int, n_lines string"
    df = spark.createDataFrame([(i, LONG[0] + f"\n{i}" if i else None, 1, "s", "r", 2, 3, 4, 5, "k", 6, "n") for i in range(7)], names)
    got = line_dedup.deduplicated(df)
    assert got.select("row.*").columns == df.columns
    rows = {r["row"]["doc_id"]: r for r in got.collect()}
    assert rows[0]["row"]["text"] is None and rows[0]["n_lines"] == 1 and rows[6]["row"]["text"] == LONG[0] + "\n6"
    assert rows[1]["row"]["text"] == "1" and tuple(rows[1]["row"])[2:] == (1, "s", "r", 2, 3, 4, 5, "k", 6, "n")


def test_no_lines(spark, tmp_path):
    assert line_dedup.query(spark, saved(documents(spark, []), tmp_path, "documents")).count() == 0


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int, whitened double, v int")


def padded(rows):
    return [(i, v, None, "x", 1, 0.5, 2) for i, v in rows]


def plain_whitening(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    centred = u - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q[:, ::-1][:, :4] / np.sqrt(e[::-1][:4]), e[::-1][:4] / e.sum()


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((300, 12)) * np.array([5, 3, 2, 1.5, *[0.4] * 8])).astype(np.float32)
    good = np.concatenate((good, np.repeat(good[:1], 200, axis=0)))  # a vector in very many rows
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    nan, inf = float("nan"), float("inf")
    bad = [(9000, None), (9001, []), (9002, [None] * 12), (9003, [nan] * 12), (9004, [inf, *[0.0] * 11]), (9005, [1.0] * 5), (9006, [-inf] * 12)]
    df = vectors(spark, padded(rows + bad + [(None, rows[7][1]), (7, rows[7][1])])).repartition(5)
    got = whitening.query(spark, saved(df, tmp_path, "embeddings")).toPandas()
    n, deviation, whitened, explained = plain_whitening(np.floor(256 * good.astype(np.float64)).astype(np.int64))
    assert set(got["n"]) == {n} and len(got) == 4 * 502 and got["vec_id"].isna().sum() == 4
    got = got[got["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    assert (got["deviation"].to_numpy().reshape(-1, 4) == deviation[:, None]).all()
    w = got["whitened"].to_numpy().reshape(-1, 4)
    assert np.abs(w * np.sign((w * whitened).sum(axis=0)) - whitened).max() < 1e-10
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4)[0], explained, rtol=1e-10) and got["identity_error"].max() < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_variance(spark, tmp_path, rows):
    folder = saved(vectors(spark, padded(rows)), tmp_path, "embeddings")
    assert whitening.query(spark, folder).count() == 0


def test_whitening_of_few_dimensions_and_large_entries(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1e30]), (3, [float(2**60), 1e30])]
    got = whitening.query(spark, saved(vectors(spark, padded(rows)), tmp_path, "embeddings")).collect()
    assert sorted({(r["vec_id"], r["component"]) for r in got}) == [(1, 1), (2, 1), (3, 1)] or len(got) == 6
    assert all(r["deviation"] is None for r in got)
    rows = whitening.quantised(vectors(spark, padded(rows)))
    exact = {r["vec_id"]: r["deviation"] for r in whitening.whitened(rows, whitening.fit(rows)).collect()}
    low, high, at = -(2**63), 2**63 - 1, 2**63 - 1
    x = {1: (256, 512), 2: (768, low), 3: (at, high)}
    s = [sum(v[i] for v in x.values()) for i in (0, 1)]
    want = {k: sum((3 * v[i] - s[i]) ** 2 for i in (0, 1)) for k, v in x.items()}
    assert all(exact[k] is None if len(str(v)) > 38 else int(exact[k]) == v for k, v in want.items())


def test_lanczos_breaks_down_and_starts_anew():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for values in ([5.0] * 3 + [2.0] * 2 + [0.0] * 35, [1.0] * 40, [9.0, 4.0, *[0.0] * 38], list(np.linspace(10, 9, 40))):
        a = q @ np.diag(values) @ q.T
        for steps in (2, 5, 24):
            e, v, residuals, _ = whitening.lanczos(lambda b: a @ b, 40, steps=steps, starts=3000)
            assert np.allclose(e, sorted(values)[::-1][:4], atol=1e-11) and np.abs(v.T @ v - np.eye(4)).max() < 1e-12 and residuals.max() < 1e-11


# Prefix trie

TURNS = "conv_id long, turn long, role string, text string, name string, up int, kind int, depth long, t long, n_convs int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, 3, 4, 5) for r in rows], TURNS)


def conversation_rows():
    rng, rows = random.Random(5), []
    for c in [*range(0, 130), 200, 207, 219, 1000, -3, -20, -27]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes it is", "no", "a b\tc", ""])))
    rows += [(300 + i, t, "user", f"the same turn {t}") for i in range(60) for t in range(5)]  # copies of a conversation
    rows += [(500, None, None, None), (500, None, "user", "b"), (500, None, "user", "a"), (500, 3, "x", "y"), (500, 3, "x", "y"), (None, 1, "user", "lost")]
    return rows + [(700, t, "user", "again") for t in range(400)] + [(701, 0, "user", "long " * 20_000)]


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        words = len(path[-1][1].split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * words
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == path)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie(spark, tmp_path):
    folder = saved(conversations(spark, conversation_rows()).repartition(3), tmp_path, "conversations")
    made = prefix_trie.query(spark, folder)
    assert tuple(made.columns) == COLUMNS and dict(made.dtypes)["depth"] == "bigint"
    assert sorted(map(tuple, made.collect()), key=repr) == plain_trie(conversation_rows())
    con = duck()
    con.execute(f"create or replace view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    assert rows_of(made) == rows_of(con.sql(prefix_trie.ORACLE))


@pytest.mark.parametrize("parts", [1, 2, 7, 60])
def test_trie_over_borders(spark, monkeypatch, parts):
    """Nodes that span many partitions, children looked up by broadcast, ids handed on in small pieces."""
    monkeypatch.setattr("cyclaris.llm.common.HOT_ROWS", 2)
    monkeypatch.setattr("cyclaris.llm.prefix_trie.CHUNK_CHARS", 60)
    df = prefix_trie.rebuilt(prefix_trie.arrays(conversations(spark, conversation_rows())))
    ordered = df.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    assert sorted(map(tuple, prefix_trie.nodes(ordered).select(*COLUMNS).collect()), key=repr) == plain_trie(conversation_rows())


def test_trie_of_nothing(spark, tmp_path):
    assert prefix_trie.query(spark, saved(conversations(spark, []), tmp_path, "conversations")).count() == 0


def test_trie_keys_are_the_turns(spark):
    df = conversations(spark, [(40, 1, "user", "ab"), (40, 2, "usera", "b"), (41, 1, "user", "ab")])
    a = {r["conv_id"]: r["turns"] for r in prefix_trie.arrays(df).collect()}
    assert a[40][0] == a[41][0] and a[40][0]["a"] != a[40][1]["a"] and prefix_trie.arrays(df.where(F.lit(False))).count() == 0
