"""Resharding by minimum-cost flow: from the sizes of old shards and new capacities to the transfers that move fewest bytes.

The law is `rows`: the new shards' counts are at most one apart. An old shard is a file of the table, or the files in a
folder shard=N, which has that number. What an old shard may keep stays in one new shard, and a new shard keeps rows of one old
shard at most. Which old shards keep anything is found by a flow first where there are more of them than new shards: a full new
shard, and one that holds one row more, are units that flow to old shards, at what these then keep. A number in a folder's
name is fixed; others are free. All that keep nothing count as one. What an old shard gives up are its smallest rows, as every
row that moves counts the same towards the counts and its own bytes towards the cost. The flow network has one node for each
new shard and the old shard that stays there, never one for a row, and its edges cost the bytes of the rows on them:

    source -> old shard -> new shard of its number -> sink     what stays costs nothing
              old shard -> pool, in blocks of rows             each block at its bytes
              gone -> pool                                     old shards beyond the new ones give up all
              pool -> new shards; new shard -> spare -> sink   the one row more that some new shards hold

Which of the new shards hold one row more is left to the flow. Successive shortest paths solve both on the driver, as their size
depends on the number of new shards alone: an old shard of more rows than a new one holds can be no more than they are, and of the
others only as many as there are new shards, those of most bytes, can be among the best. What the flow takes of the table are
counts, bytes and, of each old shard that is too large, the bytes of the rows that leave it in any case and of the one that is in
question.

No text is shuffled. A row's place in its old shard by (size, file, position) comes from a range partitioning of these three
numbers, for the old shards that give up rows only; the driver gets the first row of each transfer. A task that reads a file
knows from these where each row goes. Only files that lose rows are rewritten; the others stay as they are, parts of their
new shard. A row's slot is its position in its file behind the rows of the files before it.

Defined cases: a null text has no bytes (size 16, CRC-32 zero); repeated rows are placed each on its own; null ids are kept;
very long texts are rows like others; an empty table gives an empty result; columns besides doc_id and text go along to
the files that `rewritten` writes, under their own names, but for those that bear the name of a result or of a working column (`MADE`,
`HELD`), which replaces them; files outside of shard=N folders, where others are in such, keep nothing; a table that doesn't come from
files is written to files first.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, new_path, table, written

SHARDS, OVERHEAD = 40, 16
#: Files up to which their numbers are broadcast.
BROADCAST_FILES = 100_000
#: Rows to a part of the range partitioning, and parts at most: the driver gets and broadcasts a row for each.
PART_ROWS, PARTS = 1 << 20, 50_000


@dataclass(frozen=True)
class Transfer:
    """Rows first..last-1 of an old shard, by rank, go to a new shard."""

    old: int
    new: int
    first: int
    last: int


class Network:
    """A flow network with costs, solved by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.edges: list[list] = []  # to, capacity left, cost; edge i ^ 1 is its reverse
        self.out: dict[object, list[int]] = {}

    def add(self, a: object, b: object, capacity: int, cost: int | Fraction) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.edges))
            self.out.setdefault(y, [])
            self.edges.append([y, c, w])
        return len(self.edges) - 2

    def send(self, source: object, sink: object) -> tuple[int, int | Fraction]:
        """The largest flow of the smallest cost: amount and cost. Costs are not below zero."""
        height, amount, total = dict.fromkeys(self.out, 0), 0, 0
        number = {x: i for i, x in enumerate(self.out)}
        while True:
            far, came, heap = {source: 0}, {}, [(0, number[source], source)]
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y, c, w = self.edges[e]
                    if c and (n := d + w + height[x] - height[y]) < far.get(y, n + 1):
                        far[y], came[y] = n, e
                        heapq.heappush(heap, (n, number[y], y))
            if sink not in far:
                return amount, total
            most = max(far.values())
            for x in height:
                height[x] += far.get(x, most)
            path, x = [], sink
            while x != source:
                path.append(came[x])
                x = self.edges[came[x] ^ 1][0]
            by = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= by
                self.edges[e ^ 1][1] += by
                total += by * self.edges[e][2]
            amount += by


def transfers(counts: dict[int, int], gives: dict[int, list[tuple[int, int]]], shards: int) -> tuple[list[Transfer], int]:
    """What each old shard keeps and gives up so that the new shards' counts are at most one apart, and the bytes that move.

    counts: rows of each old shard. gives: of each that gives up rows, blocks of rows and their bytes in the order in which
    rows leave: of one without a new shard, all; of another, those beyond a full new shard, and the one more that it could
    keep if its new shard were among those with one row more.
    """
    total = sum(counts.values())
    low, spare = divmod(total, shards)
    if not total:
        return [], 0
    net, stays, leaves = Network(), {}, {}
    gone = {i: n for i, n in counts.items() if i >= shards}
    if gone:
        net.add("source", "gone", sum(gone.values()), 0)
        net.add("gone", "pool", sum(gone.values()), Fraction(sum(b for i in gone for _, b in gives[i]), sum(gone.values())))
    for i, n in counts.items():
        if i < shards:
            net.add("source", ("old", i), n, 0)
            stays[i] = net.add(("old", i), ("new", i), n, 0)
            leaves[i] = [net.add(("old", i), "pool", rows, Fraction(b, rows)) for rows, b in gives.get(i, []) if rows]
    into = {j: net.add("pool", ("new", j), total, 0) for j in range(shards)}
    for j in range(shards):
        net.add(("new", j), "sink", low, 0)
        net.add(("new", j), "spare", 1, 0)
    net.add("spare", "sink", spare, 0)
    amount, cost = net.send("source", "sink")
    if amount != total or cost != int(cost):
        raise RuntimeError("the flow doesn't place every row whole")
    out, wanting = [], [[j, net.edges[into[j] ^ 1][1]] for j in range(shards)]
    for i in sorted(counts):
        left = counts[i] if i in gone else sum(net.edges[e ^ 1][1] for e in leaves[i])
        at = 0
        while at < left:
            if not wanting[0][1]:
                wanting.pop(0)
                continue
            n = min(left - at, wanting[0][1])
            out.append(Transfer(i, wanting[0][0], at, at + n))
            wanting[0][1] -= n
            at += n
        if at < counts[i]:
            out.append(Transfer(i, i, at, counts[i]))
    return out, int(cost)


def keepers(kept: dict[int, tuple[int, int]], shards: int, spare: int) -> list[int]:
    """Which old shards keep rows, so that the bytes that stay are most; kept: of each the bytes that stay in a new shard, and in
    one that holds one row more, of which there are `spare`."""
    net, most = Network(), max((b for _, b in kept.values()), default=0)
    chosen = {}
    for kind, n in enumerate((shards - spare, spare)):
        net.add("source", kind, n, 0)
        for i, stays in kept.items():
            chosen[kind, i] = net.add(kind, ("old", i), 1, most - stays[kind])
    for i in kept:
        net.add(("old", i), "sink", 1, 0)
    net.send("source", "sink")
    return sorted(i for (_, i), e in chosen.items() if not net.edges[e][1])


def _filed(docs: DataFrame) -> DataFrame:
    """docs with file and position of each row, written to files first if it doesn't come from any."""
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*MADE, *HELD)]
    try:
        return docs.select(*kept, *where)
    except AnalysisException:
        return written(docs.select(*kept), "old").select(*kept, *where)


#: Names of results, which columns of the table can't keep.
MADE = ("size", "text_crc32", "shard", "slot")
HELD = ("_file", "_row", "_no", "_old", "_first", "_cuts", "_moves")
_TEXT = "cast(text as string)"
_SIZE = f"cast(coalesce(octet_length({_TEXT}), 0) + {OVERHEAD} as bigint) as size"
_CRC = f"crc32(cast(coalesce({_TEXT}, '') as binary)) as text_crc32"


#: The old shard of files without a label, where others have one.
_NONE = -1


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """rows (_old, size, _no, _row; so many) as a table in the shared folder, with _nth, the rank in the old shard by size."""
    spark = rows.sparkSession
    keys = ["_old", "size", "_no", "_row"]
    dealt = rows.repartitionByRange(min(PARTS, max(1, -(-total // PART_ROWS))), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    # At most one for each part and one more for each old shard: few enough for the driver.
    runs = dealt.groupBy("_part", "_old").agg(F.count("*").alias("n"), F.min("_at").alias("first_at"))
    ahead, shifts = {}, []
    for part, old, n, first_at in sorted(map(tuple, runs.collect())):
        shifts.append((part, old, ahead.get(old, 0) - first_at))
        ahead[old] = ahead.get(old, 0) + n
    moved = F.broadcast(spark.createDataFrame(shifts, "_part long, _old int, _shift long"))
    out = dealt.join(moved, ["_part", "_old"])
    return out.withColumn("_nth", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


@dataclass
class Plan:
    """Where the rows of a table's files go."""

    docs: DataFrame  # with _file and _row
    files: DataFrame  # _file, _no, _old, n, bytes
    runs: DataFrame  # _old, _first (the shard of its first rows), _cuts (size, _no, _row of a run's first row, new), _moves
    moves: list[Transfer]
    bytes: int

    def rows(self, moving: bool) -> DataFrame:
        """The rows of files that lose rows, or of the others, with _old and shard."""
        runs = self.runs.where(F.col("_moves") == moving)
        files = self.files.select("_file", "_no", "_old").join(F.broadcast(runs), "_old")
        # As many as there are files: broadcast where they are few, else joined by a shuffle.
        files = F.broadcast(files) if self.files.count() <= BROADCAST_FILES else files
        rows = self.docs.selectExpr("*", _SIZE, _CRC).join(files, "_file")
        behind = F.filter("_cuts", lambda c: F.struct(c["size"], c["_no"], c["_row"]) <= F.struct("size", "_no", "_row"))
        shard = F.when(F.size(behind) > 0, F.element_at(behind, -1)["new"]).otherwise(F.col("_first"))
        return rows.withColumn("shard", shard).drop("_no", "_first", "_cuts", "_moves")


def planned(docs: DataFrame, shards: int = SHARDS) -> Plan:
    """The transfers for the files that docs comes from."""
    spark, docs = docs.sparkSession, _filed(docs)
    sizes = written(docs.selectExpr("_file", "_row", _SIZE), "sizes")
    files = sizes.groupBy("_file").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # One row for each file, so one task numbers them.
    number = (F.row_number().over(Window.orderBy("_file")) - 1).alias("_no")
    label = F.regexp_extract("_file", "/shard=([0-9]{1,9})/", 1)
    files = written(files.select("*", number, F.when(label != "", label.cast("int")).alias("_label")), "numbered-files")
    total, labels = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("_label")).first()
    low, spare = divmod(total, shards)
    # Old shards: by the labels of their folders if there are any, else a file each.
    unit = F.coalesce("_label", F.lit(_NONE)) if labels else F.col("_no")
    files = files.withColumn("_unit", unit)
    units = written(files.groupBy("_unit").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "old-shards")
    numbers = looked_up(sizes, files, "_file").select(F.col("_unit").alias("_old"), "size", "_no", "_row")
    # Fewer than there are new shards, as each has more rows than one of these holds.
    large = {r[0]: (r[1], r[2]) for r in units.where(F.col("n") > low).collect() if r[0] != _NONE and (not labels or r[0] < shards)}
    edges, ranks = {}, None
    if large:
        asked = spark.createDataFrame([(i, n - low - 1) for i, (n, _) in large.items()], "_old int, _edge long")
        ranks = ranked(numbers.join(F.broadcast(asked.select("_old")), "_old", "left_semi"), sum(n for n, _ in large.values()))
        at_edge = ranks.join(F.broadcast(asked), "_old").where("_nth <= _edge")
        leaving = F.sum(F.when(F.col("_nth") < F.col("_edge"), F.col("size")))
        for i, sure, more in at_edge.groupBy("_old").agg(leaving, F.sum(F.when(F.col("_nth") == F.col("_edge"), F.col("size")))).collect():
            edges[i] = sure or 0, more
    if labels:
        place = {i: i for (i,) in units.where(F.col("_unit").between(0, shards - 1)).select("_unit").collect()}
    elif units.count() <= shards:
        place = {i: i for (i,) in units.select("_unit").collect()}
    else:
        small = units.where(F.col("n") <= low).orderBy(F.desc("bytes"), "_unit").limit(shards).collect()
        kept = {r["_unit"]: (r["bytes"], r["bytes"]) for r in small}
        kept |= {i: (b - sum(edges[i]), b - edges[i][0]) for i, (_, b) in large.items()}
        chosen = keepers(kept, shards, spare)
        free = iter(sorted(set(range(shards)) - set(chosen)))
        place = {i: i if i < shards else next(free) for i in chosen}
    placed = F.broadcast(spark.createDataFrame(list(place.items()), "_unit int, _place int"))
    files = files.join(placed, "_unit", "left").withColumn("_old", F.coalesce("_place", F.lit(shards)))
    files = written(files.select("_file", "_no", "_old", "_unit", "n", "bytes"), "files")
    about = {r[0]: (r[1], r[2]) for r in files.groupBy("_old").agg(F.sum("n"), F.sum("bytes")).collect()}
    counts = {i: n for i, (n, _) in about.items()}
    gives = {place[i]: [(large[i][0] - low - 1, edges[i][0]), (1, edges[i][1])] for i in large if i in place}
    if ranks is not None:
        ranks = ranks.withColumnRenamed("_old", "_unit").join(placed, "_unit").drop("_unit").withColumnRenamed("_place", "_old")
    if shards in counts:
        gives[shards] = [about[shards]]
        gone = looked_up(sizes, files, "_file").where(F.col("_old") == shards).select("_old", "size", "_no", "_row")
        gone = ranked(gone, counts[shards])
        ranks = gone if ranks is None else ranks.unionByName(gone)
    moves, cost = transfers(counts, gives, shards)
    first = {t.old: t.new for t in moves if not t.first}
    runs = {i: [] for i in first}
    later = [(t.old, t.first, t.new) for t in moves if t.first]
    if later:
        starts = ranks.join(F.broadcast(spark.createDataFrame(later, "_old int, _nth long, new int")), ["_old", "_nth"])
        for r in starts.orderBy("_old", "_nth").collect():  # one for each transfer
            runs[r["_old"]].append((r["size"], r["_no"], r["_row"], r["new"]))
    lost = {t.old for t in moves if t.old != t.new}
    schema = "_old int, _first int, _cuts array<struct<size:long,_no:int,_row:long,new:int>>, _moves boolean"
    table_ = spark.createDataFrame([(i, first[i], runs[i], i in lost) for i in first], schema)
    return Plan(docs, files, table_, moves, cost)


def rewritten(docs: DataFrame, path: str, shards: int = SHARDS) -> Plan:
    """Writes the rows of files that lose some in their new shards under path, a folder for each; returns the plan."""
    plan = planned(docs, shards)
    plan.rows(True).drop("_file", "_row", "_old").write.partitionBy("shard").parquet(path)
    return plan


def resharded(plan: Plan, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the new shards, from the files as they lie there: those written under path, and those that stayed; and
    of each file how many rows of its shard come before it. A row's slot is that plus its _row."""
    spark = plan.docs.sparkSession
    stayed = plan.rows(False).drop("_old")
    columns = [f"`{c}`" for c in stayed.columns if c not in ("_file", "_row")]
    moved = spark.read.schema(stayed.select(columns).schema).parquet(path)
    moved = moved.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = moved.unionByName(stayed)
    files = written(rows.groupBy("shard", "_file").agg(F.count("*").alias("n")), "new-files")
    before = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = written(files.select("_file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead")), "new-slots")
    return rows, files


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    rows, files = resharded(rewritten(table(spark, sf_dir, "documents"), path), path)
    # Sizes and sums of the texts as they lie in the files; only these are joined to what is known of the files.
    text = "cast(coalesce(text, '') as binary)"
    made = rows.selectExpr("doc_id", f"cast(octet_length({text}) + {OVERHEAD} as bigint) as size", f"crc32({text}) as text_crc32", "shard", "_file", "_row")
    return looked_up(made, files, "_file").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_ahead") + F.col("_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
