"""Connected components of a graph given as a table of links, by large-star and small-star steps.

Each step is a grouped minimum and a lookup of it. The minimum is taken before the shuffle, and nodes with very many links
(hubs) are looked up in a broadcast table (`common.looked_up`), so that no task has all the links of one. The number of steps grows with
the logarithm of the longest chain. After every step the links are a table in the shared folder, so that lost executors
cost one step.

Defined cases: links from a node to itself and repeated links change nothing; a node without links to others has no row; no
links give an empty result; nodes must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import HOT_ROWS, dropped, looked_up, written


def _star(links: DataFrame, large: bool, hubs: bool) -> tuple[DataFrame, list[DataFrame]]:
    """One step over links (u, v) with v < u; it returns such links again, and the tables that they are made from.

    hubs: whether there are links enough for one. Their tables are then written, as the lookup reads them several times.
    """
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    made = []
    if hubs:
        least = written(least, "least")
        made.append(least)
        joined = looked_up(both, least, "u")
    else:
        joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return out, made


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that reaches a smaller one; component is the smallest that it reaches."""
    count = Observation()
    links = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = written(links.observe(count, F.count("*").alias("n")), "links")
    state, n = None, count.get["n"]
    while True:
        hubs, seen = n > HOT_ROWS, Observation()  # fewer links in all make no hub
        stepped, made = _star(links, True, hubs)
        if hubs:
            stepped = written(stepped, "links")
            made.append(stepped)
        stepped, more = _star(stepped, False, hubs)
        after = written(stepped.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")), "links")
        now = seen.get
        for table in (links, *made, *more):
            dropped(table)
        links = after
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, n = now, now["n"]
