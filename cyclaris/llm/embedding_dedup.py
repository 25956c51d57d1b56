"""Near-duplicate vectors by search in a robust-pruned flat graph.

Equal vectors are one class, so copies cost nothing further. Class vectors go to the shards of their nearest centroids,
several each, so that shards overlap; a shard that is too large is cut again by centroids of its own, as often as it takes
(one that its centroids don't cut is cut at random). In each shard a flat graph is built: of every vector's nearest others
and some far ones, robust pruning keeps those that no kept one stands for. Adjacency lists of the same vector from several
shards are united into one graph, with the similarity of every edge.

Every vector then is a query of one shard, that of its nearest centroid: a greedy search from the shard's medoid and from
the vector's own place finds its surroundings, and the range expansion goes on from every vector found within the (slightly
widened) radius. Edges that lead out of the shard go to a table of the frontier: round by round its vectors are fetched,
held against the shard's queries, and their own edges followed where a query is in range, until no shard reaches a new
vector. An edge is followed only if the triangle inequality lets its end be in range of a query. What is found is verified
in double precision. Only counts and trees of links leave a task, never pairs.

Vectors of tight cells of the first centroids, where most link to each other, go to no shard: a graph search looks at a
node once for each of its many links to nodes in range, so all links of these are found in blocks: such a vector is held
against the vectors of every cell that its range can reach. How far behind a cell's border that is follows the data
(`margin`). Blocks of cells and of queries are bounded, large cells are salted, and the arithmetic is one of matrices.

Centroids are fitted on a bounded sample (`SAMPLE` vectors a level and a shard); every vector is indexed and searched. Each
run audits itself and logs the recall: the links of every vector whose id is divisible by `AUDITED` are held against brute
force; where the recall is under `RECALL` all links are found anew in blocks, with the margin that loses none, and where it
still is, the run fails. Found links are verified and each vector counts each of its links once, so that a count over the
true one is an error.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing (they are kept, and
are components of their own); vectors of different dimensions don't link; very long vectors are compared whole; repeated
rows are members of one class; a null vec_id is carried and names no component unless all its members' are null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, table, written
from .components import components
from .simhash import starred

log = logging.getLogger(__name__)

RADIUS, SLACK = 0.9, 0.05
#: Vectors to a shard on average and at most before it is cut again; shards to a vector; vectors that centroids are fitted on.
SHARD, SHARD_MOST, OVERLAP, SAMPLE = 1000, 4000, 3, 20_000
#: Share of a shard that a cut of it may leave in one piece; more, and it is cut at random. Bytes of centroids that are
#: broadcast; rows of a shard to a task that assigns them otherwise.
UNCUT, BROADCAST_BYTES, ASSIGNED_ROWS = 0.9, 64 << 20, 100_000
#: Neighbours before and after pruning, backward links at most, far candidates, factor of pruning, width of the greedy
#: search, queries at once.
POOL, DEGREE, BACK, FAR, ALPHA, BEAM, QUERIES = 40, 20, 200, 12, 1.2, 24, 256
#: Vectors of the frontier that one task holds against a shard's queries.
FRONTIER = 4096
#: Vectors of a block, queries that one task holds against it, deviations that a margin allows for, vectors it is measured on.
BLOCK, BLOCK_QUERIES, DEVIATIONS, MEASURED = 2048, 8192, 3, 4000
#: Ids that are audited are divisible by this; the recall below which the search is widened; audited vectors at once.
AUDITED, RECALL, AUDITED_ROWS = 50, 0.9, 10_000
#: A cell is tight if this share of its sampled pairs link.
TIGHT = 0.2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square runs over or under
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def pruned(x: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of every row's candidates at once; -1 fills up."""
    n, width = pool.shape
    here = np.arange(n)[:, None]
    dead = (pool < 0) | (pool == here)
    dist = np.where(dead, np.inf, 1 - np.einsum("nd,nkd->nk", x, x[pool]))
    order = np.argsort(dist, axis=1, kind="stable")
    pool, dist = np.take_along_axis(pool, order, 1), np.take_along_axis(dist, order, 1)
    alive, out = np.isfinite(dist), np.full((n, degree), -1, np.int64)
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        best = pool[here[:, 0], first]
        out[some, k] = best[some]
        between = 1 - np.einsum("nd,nkd->nk", x[best], x[pool])
        alive &= ~((alpha * between <= dist) & some[:, None])
        alive[here[:, 0], first] = False
    return out


def graph(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Adjacency of the flat graph over unit vectors."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    near = min(POOL, n - 1)
    tops = []
    for i in range(0, n, 512):
        sims = x[i : i + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -np.inf
        tops.append(np.argpartition(-sims, near - 1, axis=1)[:, :near])
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    out = pruned(x, np.concatenate((np.concatenate(tops), far), axis=1))
    # Links run both ways, as among vectors of nearly equal distances many are in nobody's pruned list. Where one is in too
    # many, those come first that are in few themselves.
    a, b = np.nonzero(out >= 0)
    near_of = out[a, b]
    known = np.bincount(near_of, minlength=n)
    order = np.lexsort((known[a], near_of))
    froms, tos = near_of[order], a[order]
    nth = np.arange(len(froms)) - np.searchsorted(froms, froms)
    kept = nth < BACK
    back = np.full((n, min(BACK, int(known.max(initial=0)))), -1, np.int64)
    back[froms[kept], nth[kept]] = tos[kept]
    return np.concatenate((out, back), axis=1)


def search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) with similarity radius or more: greedy from the medoid, then on from all that are in range."""
    n, q = len(x), len(queries)
    seen, expanded = np.zeros((q, n), bool), np.zeros((q, n), bool)
    sims = np.full((q, n), -np.inf, np.float32)
    medoid = int((x @ x.mean(axis=0)).argmax())
    every = np.arange(q)

    def visit(row: np.ndarray, node: np.ndarray) -> None:
        new = ~seen[row, node]
        key = np.unique(row[new] * n + node[new])
        row, node = key // n, key % n
        seen[row, node] = True
        for i in range(0, len(row), 1 << 15):
            r, v = row[i : i + (1 << 15)], node[i : i + (1 << 15)]
            sims[r, v] = np.einsum("pd,pd->p", x[queries[r]], x[v])

    def expand(row: np.ndarray, node: np.ndarray) -> None:
        expanded[row, node] = True
        for i in range(0, len(row), 1 << 14):
            around = adjacency[node[i : i + (1 << 14)]]
            a, b = np.nonzero(around >= 0)
            visit(row[i : i + (1 << 14)][a], around[a, b])

    # From the medoid; and as every query has a place of its own in the graph, from there.
    visit(every, np.full(q, medoid))
    visit(every, queries)
    width = min(BEAM, n)
    active = every
    while len(active):
        beam = np.argpartition(-sims[active], width - 1, axis=1)[:, :width]
        value = sims[active[:, None], beam]
        value[expanded[active[:, None], beam]] = -np.inf
        best = np.argpartition(-value, min(3, width - 1), axis=1)[:, :4]
        a, b = np.nonzero(np.isfinite(np.take_along_axis(value, best, 1)))
        if not len(a):
            break
        expand(active[a], beam[a, best[a, b]])
        active = active[np.unique(a)]
    while True:
        a, b = np.nonzero((sims >= radius) & ~expanded)
        if not len(a):
            break
        expand(a, b)
    a, b = np.nonzero(sims >= radius)
    other = queries[a] != b
    return queries[a[other]], b[other]


def verified(sims: np.ndarray, queries: np.ndarray, others: np.ndarray, radius: float) -> np.ndarray:
    """Which similarities (of single precision, a row for each query) are in the radius, in double precision."""
    hit = sims >= radius
    a, b = np.nonzero(np.abs(sims - radius) < 1e-5)
    for i in range(0, len(a), 1 << 14):
        p, r = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
        hit[p, r] = np.einsum("pd,pd->p", queries[p], others[r]) >= radius
    return hit


def wide(radius: float) -> float:
    """The least similarity of an edge whose end can be in the widened radius of a query that its start is in range of."""
    near = max(-1.0, radius - SLACK)
    return 2 * near * near - 1


class Found:
    """What is found of a task's vectors: the weight that each links to, and links that join them as all their links would."""

    def __init__(self) -> None:
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.links.append((a, b))
        if sum(len(x) for x, _ in self.links) > 1 << 20:
            self.links = [starred(*map(np.concatenate, zip(*self.links)))]

    def rows(self, node: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        """node, n, root."""
        n = n.astype(np.int64)
        a, b = starred(*map(np.concatenate, zip(*self.links))) if self.links else (node[:0], node[:0])
        n, root = np.concatenate((n, np.zeros(len(b), np.int64))), np.concatenate((np.full(len(node), -1), a))
        return pd.DataFrame({"node": np.concatenate((node, b)), "n": n, "root": root})[(n > 0) | (root >= 0)]


def chained(c: np.ndarray) -> np.ndarray:
    """Centroids in an order in which near ones mostly follow each other."""
    left, order = np.ones(len(c), bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, c @ c[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return c[order]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])


def margin(x: np.ndarray, c: np.ndarray, radius: float) -> float:
    """How far behind the border of another cell a vector may be that has links there.

    For y in cell B within the radius of x in cell A, x . (A - B) is at most |A - B| times the sine of the angle. So much
    is seldom needed: the margin is some deviations of a random direction among those that the data has, and what links in x
    need at least.
    """
    most = float(np.sqrt(max(0.0, 1 - radius * radius)))
    x = x[:MEASURED]
    own = nearest(x, c)
    rest = (x - c[own]).astype(np.float64)
    values = np.linalg.eigvalsh(rest.T @ rest)
    found = DEVIATIONS * most * float(np.sqrt((values * values).sum()) / values.sum()) if values[-1] > 0 else most
    to = x @ c.T
    for i in range(0, len(x), 512):
        a, b = np.nonzero(x[i : i + 512] @ x.T >= radius)
        a += i
        a, b = a[own[a] != own[b]], b[own[a] != own[b]]
        for j in range(0, len(a), 1 << 16):
            p, q = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            apart = np.sqrt(((c[own[p]] - c[own[q]]) ** 2).sum(axis=1))
            need = (to[p, own[p]] - to[p, own[q]]) / np.maximum(apart, 1e-9)
            found = max(found, 1.1 * float(need.max()))
    return min(most, found)


def tight(x: np.ndarray, c: np.ndarray, radius: float) -> np.ndarray:
    """Which cells are tight, by what is in x of each."""
    own, out = nearest(x, c), np.zeros(len(c), bool)
    for k in range(len(c)):
        some = x[own == k][:256]
        if len(some) >= 8:
            out[k] = ((some @ some.T >= radius).sum() - len(some)) >= TIGHT * len(some) * (len(some) - 1)
    return out


def reached(x: np.ndarray, own: np.ndarray, c: np.ndarray, cells: np.ndarray, far: float, dense: np.ndarray) -> np.ndarray:
    """Which of the cells each vector of cell `own` has to be held against: a pair of which one is in a dense cell at least
    is seen from its first cell."""
    to, here = x @ c[cells].T, np.einsum("nd,nd->n", x, c[own])
    square = (c * c).sum(axis=1)
    apart = np.sqrt(np.maximum(0, square[own][:, None] + square[cells][None] - 2 * c[own] @ c[cells].T))
    near = (here[:, None] - to <= far * apart + 1e-6) | (cells[None] == own[:, None])
    return near & (cells[None] >= own[:, None]) & (dense[own][:, None] | dense[cells][None])


def hit_links(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of hits: links (i, j) that join rows (numbers from 0) and columns (numbers behind them) as the hits do."""
    n, rest = len(hit), hit.copy()
    froms, tos = [], []
    while rest.sum() > 64 * sum(hit.shape):
        first = int(rest.sum(axis=1).argmax())
        columns, size = rest[first], 0
        while columns.sum() > size:
            size = columns.sum()
            rows = rest[:, columns].any(axis=1)
            columns = rest[rows].any(axis=0)
        tos += [np.flatnonzero(rows), n + np.flatnonzero(columns)]
        froms += [np.full(len(t), first) for t in tos[-2:]]
        rest[rows] = False
    a, b = np.nonzero(rest)
    return np.concatenate((*froms, a)).astype(np.int64), np.concatenate((*tos, n + b)).astype(np.int64)


class Block:
    """The vectors of a block of cells, against which queries are held."""

    def __init__(self, rows: pd.DataFrame, first: int, c: np.ndarray, far: float, dense: np.ndarray, radius: float) -> None:
        rows = rows.sort_values("cell", kind="stable")
        self.first, self.c, self.far, self.dense, self.radius = first, c, far, dense, radius
        self.node, self.weight = rows["node"].to_numpy(), rows["weight"].to_numpy(np.float64)
        self.unit = _unit(np.stack(rows["vector"].to_numpy()))
        self.single = self.unit.astype(np.float32)
        self.cells, at = np.unique(rows["cell"].to_numpy() - first, return_index=True)
        self.spans = list(zip(at, [*at[1:], len(rows)]))
        self.n, self.found = np.zeros(len(rows)), Found()

    def against(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of the queries to the block's vectors: node, n."""
        node, weight = rows["node"].to_numpy(), rows["weight"].to_numpy(np.float64)
        own = rows["cell"].to_numpy() - self.first
        unit = _unit(np.stack(rows["vector"].to_numpy()))
        single, n = unit.astype(np.float32), np.zeros(len(rows))
        near = reached(single, own, self.c, self.cells, self.far, self.dense)
        for k, (lo, hi) in enumerate(self.spans):
            asked = np.flatnonzero(near[:, k])
            for at in range(0, len(asked), 1024):
                for low in range(lo, hi, 4096):
                    q, top = asked[at : at + 1024], min(hi, low + 4096)
                    hit = verified(single[q] @ self.single[low:top].T, unit[q], self.unit[low:top], self.radius)
                    inside = own[q] == self.cells[k]
                    if inside.any():
                        hit &= node[q][:, None] != self.node[low:top][None]
                    if not hit.any():
                        continue
                    a, b = hit_links(hit)
                    both = np.concatenate((node[q], self.node[low:top]))
                    self.found.add(both[a], both[b])
                    count = hit.astype(np.float64)
                    n[q] += count @ self.weight[low:top]
                    # Within a cell each of the two is a query.
                    self.n[low:top] += np.where(inside, 0, weight[q]) @ count
        return pd.DataFrame({"node": node, "n": n.astype(np.int64), "root": np.full(len(node), -1)})[n > 0]

    def rest(self) -> pd.DataFrame:
        """What the queries brought the block's vectors, and links that join all: node, n, root."""
        return self.found.rows(self.node, self.n)


def crossing(rows: DataFrame, tops: dict, radius: float, block: int | None = None) -> DataFrame:
    """Of rows (node, vector, weight): node, n, root for all links of vectors in dense cells.

    tops: for each dimension the number of its first cell, the centroids of the cells, the margin, and which are dense.
    """
    spark, block = rows.sparkSession, block or BLOCK
    known = spark.sparkContext.broadcast(tops)
    rows = rows.where(F.size("vector").isin(list(tops)))

    def split(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, int, np.ndarray, float, np.ndarray]]:
        for dim, part in b.groupby(b["vector"].map(len), sort=False):
            for at in range(0, len(part), 2048):
                some = part.iloc[at : at + 2048]
                yield some, _unit(np.stack(some["vector"].to_numpy())).astype(np.float32), *known.value[dim]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, x, first, c, *_ in split(b):
                yield part.assign(cell=first + nearest(x, c))

    shape = "node long, vector array<double>, weight long, cell long"
    placed = written(rows.select("node", "vector", "weight").mapInPandas(place, shape), "placed")
    sizes = {r[0]: r[1] for r in placed.groupBy("cell").agg(F.count("*")).collect()}  # at most one for each centroid
    first_block, salts, number = {}, {}, 0
    for first, c, *_ in tops.values():
        filled = 0
        for cell in range(first, first + len(c)):
            n = sizes.get(cell, 0)
            if filled and filled + n > block:
                number, filled = number + 1, 0
            first_block[cell], salts[cell] = number, max(1, -(-n // block))
            filled += n
            if salts[cell] > 1:
                number, filled = number + salts[cell], 0
        number += filled > 0
    blocks = spark.sparkContext.broadcast((first_block, salts))

    def asked(part: pd.DataFrame, x: np.ndarray, first: int, c: np.ndarray, far: float, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (by number) and the blocks that they are queries of."""
        begins, parts = (np.array([d[i] for i in range(first, first + len(c))]) for d in blocks.value)
        i, j = np.nonzero(reached(x, part["cell"].to_numpy() - first, c, np.arange(len(c)), far, dense))
        i, j, nth = np.repeat(i, parts[j]), np.repeat(j, parts[j]), np.concatenate([np.arange(0), *(np.arange(k) for k in parts[j])])
        key = np.unique(i * (number + 1) + begins[j] + nth)
        return key // (number + 1), key % (number + 1)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, *about in split(b):
                block_, n = np.unique(asked(part, *about)[1], return_counts=True)
                yield pd.DataFrame({"block": block_, "n": n})

    # A block that nobody asks has no pieces, and its vectors aren't dealt.
    each = placed.mapInPandas(tally, "block long, n long").groupBy("block").agg(F.sum("n")).collect()
    pieces = spark.sparkContext.broadcast({b: -(-n // BLOCK_QUERIES) for b, n in each})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, *about in split(b):
                node, cell = part["node"].to_numpy(), part["cell"].to_numpy()
                i, to = asked(part, *about)
                home = np.array([blocks.value[0][k] + m % blocks.value[1][k] for k, m in zip(cell, node)])
                copies = np.array([pieces.value.get(h, 0) for h in home])
                piece = np.concatenate((*(np.arange(k) for k in copies), [node[r] % pieces.value[t] for r, t in zip(i, to)]))
                at = np.concatenate((np.repeat(np.arange(len(part)), copies), i))
                out = part.iloc[at].reset_index(drop=True)
                is_query = np.arange(len(at)) >= copies.sum()
                yield out.assign(block=np.concatenate((np.repeat(home, copies), to)), piece=piece.astype(np.int64), query=is_query)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, now = None, [], None
        for b in batches:
            for key, part in b.groupby(["block", "piece"]):
                if key != last:
                    if now:
                        yield now.rest()
                    last, held, now = key, [], None
                held.append(part[~part["query"]])
                if len(part := part[part["query"]]):
                    if now is None:
                        now = Block(pd.concat(held), *known.value[len(part["vector"].iloc[0])], radius)
                    yield now.against(part)
        if now:
            yield now.rest()

    order = ["block", "piece", "query"]
    dealt = placed.mapInPandas(deal, f"{shape}, block long, piece long, query boolean")
    dealt = dealt.repartition("block", "piece").sortWithinPartitions(*order)
    return written(dealt.mapInPandas(compare, "node long, n long, root long"), "crossing")


FIT = "path string, was long, k long, c binary, dense binary, far double"
MEMBERS = "node long, vector array<double>, weight long, home boolean, path string, was long"


def _fit(level: int, radius: float):
    """Of a sample of each shard (path, was, n, vector): the centroids that cut it."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        path, n, was = pdf["path"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["was"].iloc[0])
        k, row = max(1, -(-n // SHARD)), {"path": path, "was": n}
        if n > UNCUT * was:  # its centroids didn't cut the last one
            return pd.DataFrame([row | {"k": k, "c": None, "dense": None, "far": 0.0}])
        x = _unit(np.stack(pdf["vector"].to_numpy())).astype(np.float32)
        c = chained(centroids(x.astype(np.float64), min(k, max(1, len(x) // 8))).astype(np.float32))
        dense, far = np.zeros(len(c), bool), 0.0
        if not level:
            dense, far = tight(x, c, radius) if len(c) > 1 else dense, margin(x, c, radius)
        return pd.DataFrame([row | {"k": len(c), "c": c.tobytes(), "dense": dense.tobytes(), "far": far}])

    return fit


def _assigned(part: pd.DataFrame, was: int, k: int, c: bytes | None, dense: bytes | None) -> pd.DataFrame:
    """The rows of one shard, once for each shard that it is cut into and they are in."""
    node, home, path = part["node"].to_numpy(), part["home"].to_numpy(bool), part["path"].iloc[0]
    if c is None:
        child, copies = (node * 0x9E3779B1 >> 7)[:, None] % k, 1
    else:
        centers = np.frombuffer(c, np.float32).reshape(k, -1)
        x = _unit(np.stack(part["vector"].to_numpy())).astype(np.float32)
        sims, copies = x @ centers.T, min(OVERLAP, k)
        first = sims.argmax(axis=1)
        sims[np.arange(len(x)), first] = np.inf
        near = np.argpartition(-sims, copies - 1, axis=1)[:, :copies]
        # The nearest comes first; the vector's home stays with it.
        child = np.where(near == first[:, None], near[:, :1], near)
        child[:, 0] = first
        loose = ~np.frombuffer(dense, bool)[first]
        part, home, child = part[loose], home[loose], child[loose]
    rows = part.iloc[np.repeat(np.arange(len(part)), copies)]
    at_home = (home[:, None] & (np.arange(copies) == 0)[None]).ravel()
    rows = rows.assign(home=at_home, path=[f"{path}.{i}" for i in child.ravel()], was=was)
    return rows[["node", "vector", "weight", "home", "path", "was"]]


def _cut(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """rows (of shards in fits, with n) in the shards that theirs are cut into."""
    spark = rows.sparkSession
    columns = [x.split()[0] for x in MEMBERS.split(", ")]
    if (fits.agg(F.sum(F.length("c"))).first()[0] or 0) <= BROADCAST_BYTES and fits.count() <= 10_000:
        known = spark.sparkContext.broadcast({r["path"]: (r["was"], r["k"], r["c"], r["dense"]) for r in fits.collect()})

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, part in b.groupby("path", sort=False):
                    yield _assigned(part, *known.value[path])

        return rows.select(*columns).mapInPandas(assign, MEMBERS)

    # A shard's centroids come before its rows, in each of the tasks that its rows are dealt to.
    salts = F.ceil(F.col("n") / ASSIGNED_ROWS).cast("long")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("k", "long"), ("c", "binary"), ("dense", "binary"))]
    own = rows.select(*columns, *none, F.pmod(F.xxhash64("node"), salts).alias("salt"), F.lit(1).alias("kind"))
    heads = fits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("was") / ASSIGNED_ROWS).cast("long") - 1)))
    heads = heads.selectExpr(
        "cast(null as long) node", "cast(null as array<double>) vector", "cast(null as long) weight", "cast(null as boolean) home",
        "path", "was", "k", "c", "dense", "salt", "0 as kind",
    )

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for b in batches:
            for _, part in b.groupby(["path", "salt"], sort=False):
                if part["kind"].iloc[0] == 0:
                    head, part = part.iloc[0], part.iloc[1:]
                if len(part):
                    part = part.astype({"node": "int64", "weight": "int64"})
                    yield _assigned(part[columns], int(head["was"]), int(head["k"]), head["c"], head["dense"])

    dealt = own.unionByName(heads).repartition("path", "salt").sortWithinPartitions("path", "salt", "kind")
    return dealt.mapInPandas(stream, MEMBERS)


def _dealt(classes: DataFrame, radius: float = RADIUS) -> tuple[DataFrame, dict]:
    """node, vector, weight, home, path (a row for each shard that the class is in, none for those of tight cells); and what
    crossing() takes of the cells of each dimension."""
    path = F.concat(F.lit("d"), F.size("vector").cast("string")).alias("path")
    work = classes.select("node", "vector", "weight", F.lit(True).alias("home"), path, F.lit(1 << 60).alias("was"))
    done, tops, level = None, {}, 0
    while True:
        sizes = written(work.groupBy("path").agg(F.count("*").alias("n")), "sizes")
        open_ = sizes.where(F.col("n") > (SHARD_MOST if level else 0))
        if open_.isEmpty():
            done = work if done is None else done.unionByName(work)
            return done, tops
        sized = looked_up(work, sizes, "path")
        limit = SHARD_MOST if level else 0
        closed = sized.where(F.col("n") <= limit).drop("n")
        if level:
            done = closed if done is None else done.unionByName(closed)
        sized = sized.where(F.col("n") > limit)
        chance = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / (1 << 30)
        sample = sized.where(chance < 1.2 * SAMPLE / F.col("n")).select("path", "was", "n", "vector")
        fits = written(sample.groupBy("path").applyInPandas(_fit(level, radius), FIT), "centroids")
        if not level:
            number = 0
            for r in fits.collect():  # one for each dimension
                c = np.frombuffer(r["c"], np.float32).reshape(r["k"], -1)
                tops[c.shape[1]] = (number, c, r["far"], np.frombuffer(r["dense"], bool))
                number += len(c)
        work, level = written(_cut(sized, fits), "dealt"), level + 1


def audit(classes: DataFrame, counts: DataFrame, radius: float) -> float:
    """Share of the links of the classes (node, vector, weight, asked) that are asked for which counts (node, n) has."""
    ask = written(classes.where("asked").join(counts, "node", "left").select("node", "vector", F.coalesce("n", F.lit(0)).alias("n")), "asked")
    rounds, true, has = -(-ask.count() // AUDITED_ROWS), 0, 0
    for i in range(rounds):
        pdf = ask.where(F.pmod(F.xxhash64("node"), F.lit(rounds)) == i).toPandas()  # about AUDITED_ROWS rows
        if not len(pdf):
            continue
        groups = {d: (g["node"].to_numpy(), _unit(np.stack(g["vector"].to_numpy()))) for d, g in pdf.groupby(pdf["vector"].map(len))}
        mine = classes.sparkSession.sparkContext.broadcast(groups)

        def count(batches: Iterator[pd.DataFrame], mine=mine) -> Iterator[pd.DataFrame]:
            total = {d: np.zeros(len(nodes)) for d, (nodes, _) in mine.value.items()}
            single = {d: q.astype(np.float32) for d, (_, q) in mine.value.items()}
            for b in batches:
                for dim, part in b.groupby(b["vector"].map(len)):
                    nodes, q = mine.value.get(dim, (None, None))
                    for at in range(0, len(part) if q is not None else 0, 1024):
                        some = part.iloc[at : at + 1024]
                        x = _unit(np.stack(some["vector"].to_numpy()))
                        hits = verified(single[dim] @ x.astype(np.float32).T, q, x, radius)
                        hits &= nodes[:, None] != some["node"].to_numpy()[None]
                        total[dim] += hits @ some["weight"].to_numpy(np.float64)
            for dim, n in total.items():
                yield pd.DataFrame({"node": mine.value[dim][0], "n": n.astype(np.int64)})[n > 0]

        truth = classes.select("node", "vector", "weight").mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n")).toPandas()
        truth = dict(zip(*truth.to_numpy(np.int64).T)) if len(truth) else {}
        mine.destroy()
        for node, n in zip(pdf["node"], pdf["n"]):
            if n > truth.get(node, 0):
                raise RuntimeError("a vector counts more links than it has")
            has, true = has + n, true + truth.get(node, 0)
    return has / true if true else 1.0


FOUND = "path string, node long, n long, root long, reach long"


def _rows(path: str, found: pd.DataFrame, reach: np.ndarray) -> pd.DataFrame:
    """What a task found and the vectors that it reaches beyond its own."""
    reach = pd.DataFrame({"reach": pd.array(reach, "Int64")})
    out = pd.concat((found.astype("Int64"), reach), ignore_index=True)
    return out.assign(path=path)[["path", "node", "n", "root", "reach"]]


def _flat(lists: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *lists.to_numpy()]).astype(kind)


def searched(members: DataFrame, graph_: DataFrame, radius: float) -> DataFrame:
    """node, n, root for all links that searches in the united graph (node, near, sims) find: within each shard first, and
    then, round by round, among the vectors that its queries reach outside."""
    edge, direct = wide(radius), radius - SLACK

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        node, weight, home = pdf["node"].to_numpy(), pdf["weight"].to_numpy(np.float64), np.flatnonzero(pdf["home"].to_numpy(bool))
        unit = _unit(np.stack(pdf["vector"].to_numpy()))
        single = unit.astype(np.float32)
        order = np.argsort(node)
        known, sizes = node[order], pdf["near"].map(len).to_numpy()
        near, sims, row = _flat(pdf["near"], np.int64), _flat(pdf["sims"], np.float64), np.repeat(np.arange(len(node)), sizes)
        at = np.minimum(np.searchsorted(known, near), len(known) - 1)
        inside = known[at] == near
        per_row = np.bincount(row[inside], minlength=len(node))
        adjacency = np.full((len(node), max(1, int(per_row.max()))), -1, np.int64)
        adjacency[row[inside], np.arange(inside.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)] = order[at[inside]]
        found, n, in_range = Found(), np.zeros(len(node)), np.zeros(len(node), bool)
        for i in range(0, len(home), QUERIES):
            a, b = search(single, adjacency, home[i : i + QUERIES], direct)
            in_range[b] = True
            for j in range(0, len(a), 1 << 16):
                p, q = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                real = np.einsum("pd,pd->p", unit[p], unit[q]) >= radius
                p, q = p[real], q[real]
                n += np.bincount(p, weight[q], len(node))
                found.add(node[p], node[q])
        asks = np.zeros(len(node), bool)
        asks[home] = True
        out = ~inside & ((asks[row] & (sims >= direct)) | (in_range[row] & (sims >= edge)))
        return _rows(pdf["path"].iloc[0], found.rows(node, n), np.unique(near[out]))

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["query"].to_numpy(bool)
        if asks.all() or not asks.any():
            return _rows(pdf["path"].iloc[0], pd.DataFrame({"node": [], "n": [], "root": []}), np.zeros(0, np.int64))
        mine, others = pdf[asks], pdf[~asks]
        node, to, weight = mine["node"].to_numpy(), others["node"].to_numpy(), others["weight"].to_numpy(np.float64)
        unit, x = (_unit(np.stack(p["vector"].to_numpy())) for p in (mine, others))
        q, single = unit.astype(np.float32), x.astype(np.float32)
        n, found, ranged = np.zeros(len(node)), Found(), np.zeros(len(to), bool)
        for i in range(0, len(node), 1024):
            sims = q[i : i + 1024] @ single.T
            ranged |= (sims >= direct).any(axis=0)
            hit = verified(sims, unit[i : i + 1024], x, radius)
            n[i : i + 1024] = hit @ weight
            a, b = hit_links(hit)
            both = np.concatenate((node[i : i + 1024], to))
            found.add(both[a], both[b])
        near, sims, row = _flat(others["near"], np.int64), _flat(others["sims"], np.float64), np.repeat(np.arange(len(to)), others["near"].map(len))
        return _rows(pdf["path"].iloc[0], found.rows(node, n), np.unique(near[ranged[row] & (sims >= edge)]))

    whole = members.join(graph_, "node")
    found = written(whole.select("path", "node", "vector", "weight", "home", "near", "sims").groupBy("path").applyInPandas(find, FOUND), "found")
    every, visited = found, members.select("path", "node")
    nodes = members.where("home").select("node", "vector", "weight").join(graph_, "node")
    while True:
        front = found.where("reach is not null").select("path", F.col("reach").alias("node")).distinct()
        front = written(front.join(visited, ["path", "node"], "left_anti"), "frontier")
        counts = written(front.groupBy("path").agg(F.ceil(F.count("*") / FRONTIER).cast("long").alias("chunks")), "chunks")
        if counts.isEmpty():
            return every.where("node is not null").select("node", "n", "root")
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")
        # A path's row is joined to those of one shard at most, or to what one shard reaches, chunk by chunk.
        new = front.join(nodes, "node").join(counts, "path").select("path", chunk, "node", "vector", "weight", "near", "sims", F.lit(False).alias("query"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("near", "array<long>"), ("sims", "array<float>"))]
        asks = members.where("home").join(counts, "path").select(
            "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "node", "vector", "weight", *none, F.lit(True).alias("query")
        )
        found = written(asks.unionByName(new).groupBy("path", "chunk").applyInPandas(reach, FOUND), "found")
        every, visited = every.unionByName(found), visited.unionByName(front)


def linked(classes: DataFrame, radius: float = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Of classes (node, vector, weight, asked): (node, n) with the vectors that each links to, and links (a, b)."""
    asked, classes = classes, classes.drop("asked")
    members, tops = _dealt(classes, radius)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        x = _unit(np.stack(pdf["vector"].to_numpy())).astype(np.float32)
        out = graph(x)
        sims = np.concatenate([np.einsum("nd,nkd->nk", x[i : i + 256], x[out[i : i + 256]]) for i in range(0, len(x), 256)])
        return pd.DataFrame({"node": node, "near": [node[r[r >= 0]] for r in out], "sims": [s[r >= 0] for r, s in zip(out, sims)]})

    lists = members.groupBy("path").applyInPandas(build, "node long, near array<long>, sims array<float>")
    # A class is in few shards, so its united list is short.
    edges = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("near", "sims")))).alias("e")
    union = lists.groupBy("node").agg(edges).select("node", F.col("e.near").alias("near"), F.col("e.sims").alias("sims"))
    union = written(union, "graph")
    found = searched(members, union, radius)
    if parted := {d: t for d, t in tops.items() if t[3].any()}:
        found = found.unionByName(crossing(classes, parted, radius))
    counts = written(found.groupBy("node").agg(F.sum("n").alias("n")), "counts")
    share = audit(asked, counts, radius)
    log.info("recall of the links of vectors with ids divisible by %d: %.4f", AUDITED, share)
    if share < RECALL:
        most = float(np.sqrt(max(0.0, 1 - radius * radius)))
        found = crossing(classes, {d: (first, c, most, np.ones(len(c), bool)) for d, (first, c, *_) in tops.items()}, radius)
        counts = written(found.groupBy("node").agg(F.sum("n").alias("n")), "counts")
        if (share := audit(asked, counts, radius)) < RECALL:
            raise RuntimeError(f"recall {share:.4f} is under {RECALL}")
        log.info("recall after a search in blocks: %.4f", share)
    return counts, found.where("root >= 0").select(F.col("root").alias("a"), F.col("node").alias("b"))


def grouped(vectors: DataFrame, radius: float = RADIUS) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.coalesce(fine & F.exists("vector", lambda v: v != 0), F.lit(False))
    asked = F.coalesce(F.max(F.col("vec_id") % AUDITED == 0), F.lit(False))
    classes = rows.where(fine).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), asked.alias("asked"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    counts, links = linked(classes.select("node", "vector", "weight", "asked"), radius)
    joined = classes.join(counts, "node", "left").join(components(links, "a", "b"), "node", "left")
    joined = written(joined.withColumn("component", F.coalesce("component", "node")), "joined")
    # A component may hold a large part of all classes, and a class of all rows: neither is one key of a shuffle then.
    named = written(joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n_")), "named")
    about = looked_up(joined, named, "component", "n_").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", "weight"
    )
    about = written(about, "about")
    key = F.when(fine, F.col("vector"))
    keyed = rows.select("vec_id", key.alias("vector"))
    out = looked_up(keyed.where("vector is not null"), about, "vector", "weight").select("vec_id", "n_links", "component_id")
    alone = keyed.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.withColumn("n_links", F.col("n_links").cast("long")).unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(vectors: DataFrame, result: DataFrame, every: int = 50, radius: float = RADIUS) -> float:
    """Share of the links of vectors whose id is divisible by `every` that the result counts, against brute force in blocks;
    a vector that counts more links than it has counts for none."""
    ask = vectors.where(F.col("vec_id") % every == 0).toPandas()
    if not len(ask):
        return 1.0
    mine = vectors.sparkSession.sparkContext.broadcast((ask["vec_id"].to_numpy(), _unit(np.stack(ask["embedding"].to_numpy()))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = mine.value
        for b in batches:
            hits = (q @ _unit(np.stack(b["embedding"].to_numpy())).T >= radius) & (ids[:, None] != b["vec_id"].to_numpy()[None])
            yield pd.DataFrame({"vec_id": ids, "n": hits.sum(axis=1)})

    true = vectors.select("vec_id", "embedding").mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    has = F.when(F.col("n_links") <= F.col("n"), F.col("n_links")).otherwise(0)
    both = true.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(has), F.sum("n")).first()
    return both[0] / both[1] if both[1] else 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (
  select row_number() over () as row_id, vec_id, embedding::double[] as e,
    coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0, false) as fine
  from embeddings),
u as (select row_id, vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v where fine),
pairs as (
  select a.row_id as a, b.row_id as b from u a join u b on a.row_id <> b.row_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) >= {RADIUS}),
reach as (select row_id as a, row_id as b from v union select r.a, p.b from reach r join pairs p on r.b = p.a),
least as (select a as row_id, min(vec_id) as component_id from reach join v on reach.b = v.row_id group by a),
counts as (select a as row_id, count(*) as n_links from pairs group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from v left join counts using (row_id) left join least using (row_id)
"""
