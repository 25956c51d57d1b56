"""The prefix trie of conversations: each distinct sequence of first turns is a node.

A conversation is an array of turn digests (two longs a turn, 128 bits). The arrays are sorted over the whole cluster by
ranges, so conversations that share a prefix are neighbours. A sweep over each partition keeps a stack of the nodes that are open
along the current array; the length of the common prefix (LCP) with the next array says which close. What a node counts
is additive over neighbouring arrays: members, shared words (an array shares its first LCP turns with the array before it),
children (a node opens where the LCP is shorter than its depth), childless nodes (an array that the next one doesn't extend).

A partition can't know where its first and last array's prefixes end, so these nodes leave the sweep as pieces, named by depth
and a hash of their turns. Pieces are added up by a grouped sum; a table with one row for each partition, its first and last
array, gives the corrections: at each border the nodes above the LCP were opened twice, lack the words that the border's arrays
share, and hold a childless node too many if the later array extends the earlier. So no trie, no node's members and no list of
neighbours is ever in one place; a partition's memory holds the open nodes and their finished children's rows.

Only the digests of turns are shuffled, never their texts (but for ties, below), and the ids of conversations that end at a node
are hashed in their order as they come; those of a node that spans partitions are handed on in pieces of at most
`CHUNK_CHARS` and hashed in order, as one digest over them can't be had otherwise.

Defined cases: a null role or text is empty; rows without conv_id are left out; turns of equal number are put in order of role,
then text (so are those without number, which come first); repeated rows are turns of their own; a very long conversation is an
array of 24 bytes a turn in one row; an empty table gives an empty result; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, table, written

#: Turns may be taken from the first conversation of so many, and so many turns less one at most.
GROUP, HEADS = 20, 4
#: Characters of ids that a node holds before it hands them on, and rows that a sweep gives on at once.
CHUNK_CHARS, ROWS_AT_ONCE = 1 << 20, 1 << 14

_TURN = "array<struct<a:bigint,b:bigint,words:bigint>>"
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
#: What a sweep gives, by kind. NODE: a finished node; up is its parent's name where parent_conv_id isn't known yet, and name its
#: own where its ids were handed on. PIECE: a part of a node. IDS: ids that end at a node, conv_id is the first. BORDER: a
#: partition's first and last array, the words of the first, and its conv_id.
NODE, PIECE, IDS, BORDER = range(4)
_SWEPT = {
    "kind": "int", "name": "binary", "up": "binary", "conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint",
    **dict.fromkeys(_COUNTS, "bigint"), "ends_sha256": "string", "ids": "string",
    **dict.fromkeys(("first", "last", "words"), "array<bigint>"),
}


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest (a, b) and words of each row that has a conv_id."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "role", "text"), "words": words})


def arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (a, b, words) in order, of each conversation."""
    rows = turns_of(conversations)
    turn = F.struct("turn", "a", "b", "words")
    made = written(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")), "conversations")
    bare = F.transform("t", lambda x: F.struct(x["a"], x["b"], x["words"])).cast(_TURN).alias("turns")
    ties = F.exists(F.filter("t", lambda x, i: (i > 0) & x["turn"].eqNullSafe(F.get("t", i - 1)["turn"])), lambda x: F.lit(True))
    made = made.withColumn("ties", ties)
    tied = made.where("ties").select("conv_id")
    if tied.isEmpty():
        return made.select("conv_id", bare)
    # Equal turn numbers: their rows' places come from role and text.
    again = rows.join(tied, "conv_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    again = again.select("conv_id", F.struct(place.alias("turn"), "a", "b", "words").alias("x"))
    again = again.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("t"))
    return made.where("not ties").select("conv_id", bare).unionByName(again.select("conv_id", bare))


def rebuilt(own: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, key (two longs a turn) and words of each conversation, its first turns taken from the first of its group."""
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    # At most 2 * group - 1 conversations to a group, those about zero.
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, max(1, heads - 1)))).over(Window.partitionBy("base"))
    made = own.withColumn("base", base).withColumns({"head": head, "h": h})
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(_TURN))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    made = made.select("conv_id", F.concat(taken, rest).alias("t"))
    key = F.flatten(F.transform("t", lambda x: F.array(x["a"], x["b"])))
    return made.select("conv_id", key.alias("key"), F.transform("t", lambda x: x["words"]).alias("words"))


def _names(key: bytes) -> list[bytes]:
    """The names of all prefixes of an array, from the root."""
    import xxhash

    state, out = xxhash.xxh3_128(), []
    for d in range(len(key) // 16 + 1):
        if d:
            state.update(key[16 * (d - 1) : 16 * d])
        out.append(state.digest() + d.to_bytes(8, "big"))
    return out


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two arrays have in common at their starts."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 16
    differ = np.frombuffer(a[:n], np.int64) != np.frombuffer(b[:n], np.int64)
    return int(differ.argmax()) // 2


class _Node:
    """An open node: its counts so far, its finished children's rows, and the ids that ended at it and weren't handed on.

    name: set once ids were handed on, as their digest is then made elsewhere.
    """

    __slots__ = ("chars", "children", "conv", "convs", "depth", "ends", "leaves", "name", "saved", "waiting", "words")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.name = depth, words, None
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.chars, self.waiting = [], 0, []

    def add(self, conv: int) -> None:
        """A conversation that ends here."""
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += 1
        self.ends.append(conv)
        self.chars += 20

    def complete(self) -> None:
        """No more arrays begin with it here."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.convs - 1) * self.words

    def adopt(self, child: _Node) -> None:
        self.conv = child.conv if self.conv is None else min(self.conv, child.conv)
        self.convs += child.convs
        self.leaves += child.leaves
        self.saved += child.saved
        self.children += 1

    def row(self, kind: int) -> dict:
        counts = dict(zip(_COUNTS, (self.convs, self.children, self.leaves, self.saved)))
        return {"kind": kind, "name": self.name, "conv_id": self.conv, "depth": self.depth, **counts}

    def handed_on(self) -> dict:
        """The ids so far, to be hashed elsewhere; the node must have a name."""
        made = {"kind": IDS, "name": self.name, "conv_id": self.ends[0], "ids": ",".join(map(str, self.ends))}
        self.ends, self.chars = [], 0
        return made


def swept(ordered: DataFrame) -> DataFrame:
    """What the partitions of ordered (conv_id, key, words) give, which must be sorted by key and conv_id."""
    kinds = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[t]) for n, t in _SWEPT.items()])

    def arrays_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray]]:
        for b in batches:
            flat = []
            for c in (b.column(1), b.column(2)):
                flat += [c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)]
            key_at, keys, word_at, words = flat
            for i, conv in enumerate(b.column(0).to_pylist()):
                yield conv, keys[key_at[i] : key_at[i + 1]].tobytes(), words[word_at[i] : word_at[i + 1]]

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        stack: list[_Node] = []
        first = last = None
        # Open nodes of a depth under `shared` are prefixes of the first array, so they may have begun elsewhere.
        shared, names = 0, []

        def popped(border: bool) -> Iterator[dict]:
            """Closes the innermost node. Its children's rows have waited for its smallest member; a border node's is known only
            when its pieces are together."""
            node = stack.pop()
            node.complete()
            if border:
                node.name = names[node.depth]
            sha = None if node.name else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
            if node.name and node.ends:
                yield node.handed_on()
            parent = {"up": node.name} if border else {"parent_conv_id": node.conv}
            for child in node.waiting:
                yield child | parent
            if border:
                yield node.row(PIECE) | {"up": names[node.depth - 1] if node.depth else None}
            elif stack:
                stack[-1].waiting.append(node.row(NODE) | {"ends_sha256": sha})
            if stack:
                stack[-1].adopt(node)

        for conv, key, words in arrays_of(batches):
            if last is None:
                first, first_conv, first_words, names, shared, common = key, conv, words, _names(key), len(key) // 16 + 1, 0
                stack.append(_Node(0, 0))
            else:
                common = lcp(last, key)
            while len(stack) - 1 > common:
                border = len(stack) - 1 < shared
                shared = min(shared, len(stack) - 1) if border else shared
                yield from popped(border)
            while len(stack) - 1 < len(key) // 16:
                stack.append(_Node(len(stack), int(words[len(stack) - 1])))
            top = stack[-1]
            top.add(conv)
            if top.chars >= CHUNK_CHARS:
                top.name = top.name or _names(key)[-1]
                yield top.handed_on()
            last = key
        if last is not None:
            names = _names(last)
            while stack:
                yield from popped(True)
            ends = {k: np.frombuffer(v, np.int64).tolist() for k, v in (("first", first), ("last", last))}
            yield {"kind": BORDER, "conv_id": first_conv, "words": first_words.tolist(), **ends}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for e in events(batches):
            made.append(e)
            if len(made) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        yield pa.RecordBatch.from_pylist(made, schema)

    return ordered.select("conv_id", "key", "words").mapInArrow(sweep, ", ".join(f"{n} {t}" for n, t in _SWEPT.items()))


def _corrections(borders: DataFrame) -> DataFrame:
    """For each node that goes on over a border: its name, and what its pieces count too much or too little."""
    order = Window.orderBy("first", "conv_id")  # a row for each partition
    pairs = borders.select(F.lag("last").over(order).alias("before"), "first", "words").where("before is not null")

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"name": [], "depth": [], "n_children": [], "n_leaves": [], "saved_tokens": []}
            for r in b.to_pylist():
                last, first = (np.array(r[k], np.int64).tobytes() for k in ("before", "first"))
                common = lcp(last, first)
                names, words = _names(first[: 16 * common]), 0
                for d in range(common, -1, -1):
                    words += r["words"][d - 1] if d else 0
                    for k, v in zip(out, (names[d], d, -int(d < common), -int(16 * common == len(last)), words)):
                        out[k].append(v)
            yield pa.record_batch([pa.array(v, pa.binary() if k == "name" else pa.int64()) for k, v in out.items()], list(out))

    return pairs.mapInArrow(correct, "name binary, depth long, n_children long, n_leaves long, saved_tokens long")


def _digests(ids: DataFrame) -> DataFrame:
    """name and sha (of its ids in order, comma-joined) of the nodes whose ids were handed on, as a stream in one pass."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def out(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.binary(), pa.string()))], ["name", "sha"])

        for b in batches:
            done = []
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n == name:
                    state.update(b"," + text.encode())
                else:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256(text.encode())
            yield out(done)
        if state is not None:
            yield out([(name, state.hexdigest())])

    dealt = ids.repartition("name").sortWithinPartitions("name", "conv_id").select("name", "ids")
    return dealt.mapInArrow(hashed, "name binary, sha string")


def nodes(ordered: DataFrame) -> DataFrame:
    """The nodes of the trie of ordered (conv_id, key, words; sorted over the cluster by key and conv_id): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = written(swept(ordered), "sweep", by="kind")
    pieces = found.where(F.col("kind") == PIECE).select("name", "up", "conv_id", "depth", *_COUNTS)
    wrong = _corrections(found.where(F.col("kind") == BORDER))
    sums = (F.sum(c).alias(c) for c in _COUNTS)
    whole = pieces.unionByName(wrong, allowMissingColumns=True).groupBy("name").agg(F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums)
    whole = written(whole, "border-nodes")
    parents = whole.select(F.col("name").alias("up"), F.col("conv_id").alias("parent"), F.col("n_children").alias("n"))
    columns = ("name", "conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256")
    single = found.where(F.col("kind") == NODE)
    inner = single.where("up is null").select(*columns)
    # A border node may have very many children, the root above all: they are looked up, not shuffled to one task.
    under = looked_up(single.where("up is not null"), parents, "up").withColumn("parent_conv_id", F.col("parent")).select(*columns)
    border = whole.join(parents, "up", "left").withColumns({"parent_conv_id": F.col("parent"), "ends_sha256": F.lit(None).cast("string")})
    every = inner.unionByName(under).unionByName(border.select(*columns))
    # Named rows are few: nodes that touch a border, and those at which very many conversations end.
    named = every.where("name is not null").join(_digests(found.where(F.col("kind") == IDS)), "name", "left")
    named = named.withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest()))).select(*columns)
    return every.where("name is null").unionByName(named).drop("name")


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    made = rebuilt(arrays(conversations), group, heads)
    return nodes(made.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of an id's decimal digits: each digit's code, then eight steps of the reflected polynomial (fixed value).
_CRC = """xor(list_reduce(flatten([[ascii(d), -1, -1, -1, -1, -1, -1, -1, -1] for d in string_split(conv_id::varchar, '')]),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295::bigint), 4294967295::bigint)"""
ORACLE = rf"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
c as (select distinct conv_id from t),
h as (select conv_id, conv_id - conv_id % {GROUP} as base, {_CRC} % {HEADS} as h from c),
r as (select h.conv_id, i, role, text from h join t on t.conv_id = h.base where i <= h
  union all select h.conv_id, i + {HEADS}, role, text from h join t on t.conv_id = h.conv_id where i > h),
placed as (select conv_id, row_number() over (partition by conv_id order by i) as depth,
    list({{'role': role, 'text': text}}) over (partition by conv_id order by i) as path,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words from r),
m as (select conv_id, depth, path, words from placed union all select conv_id, 0, [], 0 from c),
ends as (select conv_id, max(depth) as depth from m group by conv_id),
n as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    string_agg(case when e.depth is not null then conv_id::varchar end, ',' order by conv_id) as ids
  from m left join ends e using (conv_id, depth) group by path),
p as (select n.*, u.conv_id as parent_conv_id, u.path as up from n left join n u on u.depth = n.depth - 1 and u.path = n.path[:n.depth - 1]),
k as (select up as path, count(*) as n_children from p where up is not null group by up),
own as (select p.*, coalesce(n_children, 0) as n_children from p left join k using (path)),
below as (select a.path, count(*) filter (own.n_children = 0) as n_leaves, sum((own.n_convs - 1) * own.words) as saved_tokens
  from own join m a on a.conv_id = own.conv_id and a.depth <= own.depth group by a.path)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::bigint as saved_tokens,
  sha256(coalesce(ids, '')) as ends_sha256
from own join below using (path)
"""
