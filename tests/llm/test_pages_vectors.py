"""Web archives, HTML extraction and embedding near-duplicates."""

import base64
import collections
import hashlib
import io
import zipfile

import duckdb
import numpy as np
import pytest

from cyclaris.llm import embedding_dedup, html_text, warc

from ..helpers import rows_of
from .cases import saved, union_find

PAGES = "page_id long, url string, html string, refers_to long, record_type string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, None, None, None) for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (None, "http://a/n", "<p>same</p>"), (7, "u 7", None),
    (8, "", ""), (9, "http://a/é", "é" * 70_000), (10, "x", "<p>other</p>"), (10, "x", "<p>other</p>"), (None, None, "<p>alone</p>"),
]


def test_warc_round_trip(spark, tmp_path):
    got = sorted(map(tuple, warc.query(spark, saved(pages(spark, ROWS).repartition(2), tmp_path, "pages")).collect()), key=repr)
    groups = collections.defaultdict(list)
    for i, _, h in ROWS:
        groups[h or ""].append(i)
    want = []
    for i, _, h in ROWS:
        last = max((x for x in groups[h or ""] if x is not None), default=None)
        data = (h or "").encode()
        own = last is None or i == last
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else last))
    assert got == sorted(want, key=repr)


def test_warc_of_planted_copies_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    bodies = [f"<p>page {i} é {'x' * int(rng.integers(0, 3000))}</p>" for i in range(40)] + ["", "<p>hot</p>"]
    rows = [(int(i), f"http://h/{i}", bodies[min(41, int(rng.integers(0, 60)))]) for i in rng.permutation(600)]
    path = saved(pages(spark, rows).repartition(5), tmp_path, "pages")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    want = rows_of(con.sql(warc.ORACLE))
    got = warc.query(spark, path)
    assert rows_of(got) == want and {r[3] for r in want[1:]} | {r[4] for r in want[1:]} >= {"response", "revisit"}


def test_warc_payloads_and_small_archives(spark, tmp_path):
    folder = f"file://{tmp_path}/arc"
    manifest = warc.archived(pages(spark, ROWS), folder, archive_bytes=300)
    assert manifest.count() > 2
    got = {(r["page_id"], r["payload"] and bytes(r["payload"])) for r in warc.records(manifest).collect() if r["record_type"] == "response"}
    assert (9, ("é" * 70_000).encode()) in got and (5, b"<p>same</p>") in got
    smaller = warc.archived(pages(spark, ROWS), f"file://{tmp_path}/min", min_bytes=12)
    kinds = {(r["page_id"], r["record_type"]) for r in warc.records(smaller).collect()}
    assert (1, "response") in kinds and (10, "response") in kinds


def test_warc_of_no_pages(spark, tmp_path):
    assert warc.query(spark, saved(pages(spark, []), tmp_path, "pages")).count() == 0


def archive_of(data: bytes) -> warc.Archive:
    return warc.Archive(lambda o, n: data[o : o + n], len(data))


def test_reader_finds_the_directory_behind_a_comment_with_marks():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", "hello")
        z.writestr("é.txt", "x", zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 and then PK\x05\x06" + b"y" * 40
    found = archive_of(out.getvalue())
    at, n = found.place("a.txt")
    assert out.getvalue()[at : at + n] == b"hello" and set(found.members) == {"a.txt", "é.txt"}
    with pytest.raises(ValueError, match="compressed"):
        found.place("é.txt")
    with pytest.raises(ValueError, match="not a ZIP"):
        archive_of(b"nothing")


def test_reader_takes_zip64_numbers(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            z.writestr(f"{i}", str(i) * 60)
    data = out.getvalue()
    assert b"PK\x06\x06" in data
    found = archive_of(data)
    for i in range(5):
        at, n = found.place(f"{i}")
        assert data[at : at + n] == str(i).encode() * 60


# HTML

LONG = "The cat was on the mat and it is a long sentence that goes on for the sake of the test with words of all kinds to be read"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    body = (
        "<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><!-- ad > --><div class='ad'>Buy now, it is the best of all the things "
        f"that are on sale</div><article><h1>Title</h1><p><b>{LONG}.<br><p>Fish &amp; chips &#233;.</p><div class=notice-box>Subscribe to the news of the "
        f"town and the region</div><p>{LONG},\n  and more.</p></article><aside>Other</aside><section id=comments><p>{LONG} a comment</p></section>"
        f"<form><label>{LONG}</label><input></form><footer>&copy; me</footer>"
    )
    assert html_text.main_text(page(body)) == f"Title\n\n{LONG}.\n\nFish & chips é.\n\n{LONG}, and more."


def test_rules_decide_where_no_element_tells():
    body = f"<div><a href=1>One</a> <a href=2>Two</a></div><h2>Head</h2><p>{LONG}.</p><p>Short.</p><p>{LONG} again.</p><p>The end.</p><div><a href=3>{LONG}</a></div>"
    assert html_text.main_text(page(body)) == f"Head\n\n{LONG}.\n\nShort.\n\n{LONG} again.\n\nThe end."


def test_article_of_a_related_post_is_not_the_page():
    for card in ("<article class=teaser>", "<article>"):
        body = f"<div id=content><h1>Head</h1><p>{LONG}.</p><p>{LONG} again.</p></div>{card}<a href=/x>Another post to read</a></article>"
        assert html_text.main_text(page(body)) == f"Head\n\n{LONG}.\n\n{LONG} again."


def test_rules_decide_inside_an_article():
    rows = "Kx12 77 Zeta9 | Qw34 88 Yota7 | Pl56 99 Xena5 | Mn78 11 Wolf3 | Bv90 22 Vega1 | Hj21 33 Ulm2"
    linked = f"<p><a href=/y>{LONG}</a></p>"
    assert html_text.main_text(page(f"<article><h1>Head</h1><p>{LONG}.</p>{linked}</article>")) == f"Head\n\n{LONG}."
    assert html_text.main_text(page(f"<p>{LONG}.</p><main><p>{rows}</p></main>")) == f"{LONG}.\n\n{rows}"
    assert html_text.main_text(page("<article><h1>Head</h1><p>Just a line.</p></article>")) == "Head\n\nJust a line."


def test_languages_without_a_list():
    text = "Kissa istui matolla koko pitkän iltapäivän, eikä kukaan talossa tullut huomanneeksi, miten hiljaista siellä jo oli"
    assert html_text.main_text(page(f"<h2>Kissa</h2><p>{text}.</p><div><a href=/k>{text}</a></div>")) == f"Kissa\n\n{text}."


@pytest.mark.parametrize("html", ["", "<", "<p", "</p></p>", "<script>", "<!-- ", "<p><b><i>x", "plain", "&#xD800; &bogus;", "<article></article>"])
def test_broken_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_extraction_of_rows(spark, tmp_path):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>")), (1, "u", page(f"<article><p>{LONG}</p></article>")), (None, None, None), (2, "v", "<p>" * 5000)]
    got = html_text.query(spark, saved(pages(spark, rows), tmp_path, "pages")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)


# Vectors

VECTORS = "vec_id long, embedding array<float>, label int, node int, shard int, n_links int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], VECTORS)


def planted(rng, n_far, groups):
    x = [rng.normal(size=32) for _ in range(n_far)]
    for size, spread in groups:
        c = rng.normal(size=32)
        x += [c + spread * rng.normal(size=32) for _ in range(size)]
    return [np.asarray(v, np.float32).tolist() for v in x]


def test_groups_of_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = planted(rng, 1500, [(400, 0.1), (30, 0.2), (60, 0.33)])
    x += [x[-1]] * 40 + [x[3]] * 2
    rows = [(i, v) for i, v in enumerate(x)]
    df = vectors(spark, rows)
    got = {r["vec_id"]: r for r in embedding_dedup.query(spark, saved(df.repartition(3), tmp_path, "embeddings")).collect()}
    u = embedding_dedup._unit(np.array(x, np.float64))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    true = near.sum(axis=1)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= true).all() and n.sum() >= 0.97 * true.sum()
    root = union_find(len(x), zip(*np.nonzero(near)))
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert np.mean([got[i]["component_id"] == least[r] for i, r in enumerate(root)]) > 0.99
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    result = spark.createDataFrame([(i, int(r["n_links"])) for i, r in got.items()], "vec_id long, n_links long")
    assert embedding_dedup.recall(df, result) >= 0.9


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]),
        (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (10, [0.0, -3.0]), (11, [1e-30, 0.0]), (12, []),
    ]
    got = sorted(map(tuple, embedding_dedup.query(spark, saved(vectors(spark, rows), tmp_path, "embeddings")).collect()), key=repr)
    near = {1, 2, 9, 11}
    want = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 12)] + [(1, 4, 1, True)] + [(i, 4, 1, False) for i in (2, 9, 9, 11)]
    want += [(None, 1, None, True)] * 2
    assert got == sorted(want, key=repr) and near


def test_no_vectors(spark, tmp_path):
    assert embedding_dedup.query(spark, saved(vectors(spark, []), tmp_path, "embeddings")).count() == 0


def test_pruned_graph_reaches_every_vector():
    rng = np.random.default_rng(3)
    x = embedding_dedup._unit(rng.normal(size=(700, 16))).astype(np.float32)
    adjacency = embedding_dedup.graph(x)
    a, b = embedding_dedup.search(x, adjacency, np.arange(700), 0.6)
    true = x @ x.T >= 0.6
    np.fill_diagonal(true, False)
    assert len(set(zip(a.tolist(), b.tolist()))) >= 0.9 * true.sum()


def test_links_of_a_tight_group_over_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = planted(rng, 1600, [(700, 0.22), (120, 0.33)])
    monkeypatch.setattr(embedding_dedup, "SHARD", 50)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 200)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.grouped(rows).collect()}
    u = embedding_dedup._unit(np.array(x, np.float64))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    true = near.sum(axis=1)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert true.sum() > 100_000 and (n <= true).all() and n.sum() >= 0.97 * true.sum()
    root = union_find(len(x), zip(*np.nonzero(near)))
    assert len({got[i]["component_id"] for i in range(len(x))}) == len(set(root))


def test_links_of_dense_cells_over_blocks_and_salts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.array(planted(rng, 300, [(200, 0.2), (90, 0.33)]), np.float64)
    unit = embedding_dedup._unit(x)
    c = embedding_dedup.chained(embedding_dedup.centroids(unit, 9).astype(np.float32))
    weight = rng.integers(1, 4, len(x))
    rows = spark.createDataFrame([(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(x, weight))], "node long, vector array<double>, weight long")
    monkeypatch.setattr(embedding_dedup, "BLOCK_QUERIES", 70)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    own = embedding_dedup.nearest(unit.astype(np.float32), c)
    for dense in (np.arange(9) % 3 == 0, np.ones(9, bool), np.zeros(9, bool)):
        asked = near & (dense[own][:, None] | dense[own][None])
        found = embedding_dedup.crossing(rows, {32: (40, c, np.sqrt(1 - 0.9**2), dense)}, 0.9, block=60).collect()
        n = np.zeros(len(x), int)
        for r in found:
            n[r["node"]] += r["n"]
        assert (n == asked @ weight).all()
        assert len(set(union_find(len(x), [(r["root"], r["node"]) for r in found if r["root"] >= 0]))) == len(set(union_find(len(x), zip(*np.nonzero(asked)))))


def check_against_brute_force(spark, x, share=0.97, parts=3):
    rows = spark.createDataFrame([(i, np.asarray(v).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts)
    got = {r["vec_id"]: r for r in embedding_dedup.grouped(rows).collect()}
    u = embedding_dedup._unit(np.array(x, np.float64))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= share * near.sum()
    return got, near


@pytest.mark.parametrize("force", ["deep", "streamed", "random"])
def test_shards_are_cut_until_they_fit_and_searched_across(spark, monkeypatch, force):
    rng = np.random.default_rng(17)
    x = planted(rng, 900, [(300, 0.2), (150, 0.33), (2, 0.05), (7, 0.1)])
    monkeypatch.setattr(embedding_dedup, "SHARD", 30 if force == "deep" else 60)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 70 if force == "deep" else 150)
    monkeypatch.setattr(embedding_dedup, "FRONTIER", 37)
    # No cell is tight, so that all links come from the graph.
    monkeypatch.setattr(embedding_dedup, "tight", lambda x, c, radius: np.zeros(len(c), bool))
    monkeypatch.setattr(embedding_dedup, "RECALL", 0.0)
    if force == "streamed":
        monkeypatch.setattr(embedding_dedup, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(embedding_dedup, "ASSIGNED_ROWS", 100)
    if force == "random":
        monkeypatch.setattr(embedding_dedup, "UNCUT", 0.1)
    got, near = check_against_brute_force(spark, x)
    assert near.sum() > 10_000


def test_a_large_dense_group(spark):
    rng = np.random.default_rng(23)
    c = rng.normal(size=16)
    x = np.concatenate((c + 0.15 * rng.normal(size=(6000, 16)), rng.normal(size=(3000, 16))))
    check_against_brute_force(spark, x, 0.99, 6)


def test_planted_table_equals_sql(spark, tmp_path):
    rng, x = np.random.default_rng(29), []
    for size in (2, 3, 10, 60, 200):
        for spread in (0.05, 0.2, 0.3, 0.35):
            c = rng.normal(size=24)
            x += [c + spread * rng.normal(size=24) for _ in range(size)]
    x += list(rng.normal(size=(500, 24)))
    x += [x[0]] * 5 + [2 * x[9], -x[9], 1e-100 * x[30], x[40] * (1 + 1e-12)]
    # Two at 0.9 to within a rounding, one just over and one just under it, in double precision only.
    e = np.eye(24)
    x += [e[0], 0.9 * e[0] + np.sqrt(0.19 - 1e-9) * e[1], 0.9 * e[0] + np.sqrt(0.19 + 1e-9) * e[2]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    path = saved(df, tmp_path, "embeddings")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    want = rows_of(con.sql(embedding_dedup.ORACLE))
    assert rows_of(embedding_dedup.query(spark, path)) == want
    links = dict((r[3], r[2]) for r in want[1:])
    n = len(x)
    assert links[n - 3] == 1 and links[n - 2] >= 1 and links[n - 1] == 0


def test_vectors_told_apart_in_double_precision_only(spark):
    x = [[1.0, 0.0], [0.9, float(np.sqrt(0.19) - 1e-9)], [1.0, 1e-12], [1e300, 0.0]]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.grouped(rows).collect()} == {0: 3, 1: 3, 2: 3, 3: 3}


def test_a_run_of_low_recall_is_widened(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = planted(rng, 1600, [(700, 0.22)])
    x += [x[-1]] * 3
    monkeypatch.setattr(embedding_dedup, "SHARD", 50)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 200)
    monkeypatch.setattr(embedding_dedup, "RECALL", 0.999)
    monkeypatch.setattr(embedding_dedup, "margin", lambda *_: -1.0)
    monkeypatch.setattr(embedding_dedup, "tight", lambda x, c, radius: np.zeros(len(c), bool))
    monkeypatch.setattr(embedding_dedup, "AUDITED_ROWS", 20)
    # The group comes first in ids, so that ids divisible by 50 are among it.
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x[::-1])], "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.grouped(rows).collect()}
    u = embedding_dedup._unit(np.array(x[::-1], np.float32))
    near = u @ u.T >= 0.9
    assert [got[i] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
