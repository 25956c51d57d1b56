"""Secret scans in DataFrame operations only, with linking of credentials that come in several parts.

Strong kinds (assign, access, hex) are reported wherever they stand. Weak kinds are names of accounts (id), long random
strings (key) and addresses of services (endpoint): a weak one is reported only where complementary parts stand in the
same scope, a block of text between blank lines, however long it is and wherever in it they stand:

    id        a secret (assign, hex or key)
    key       an access identifier or an id
    endpoint  a secret, and an access identifier or an id

Positions come from the pieces between matches (split) and the matches themselves, so no code leaves the JVM. The parts
of a text are exploded, placed in the scope that covers them, and joined to what their scope holds: an interval join that
gives one row a part and never a pair. A text without parts gives one row; texts are never shuffled. Letters "in either
case" are those of ASCII, spelt out in the patterns, as engines differ in what else they fold (U+017F to s, U+212A to k).

Defined cases: a null text counts as empty; an empty text has no spans; a very long text is scanned whole, in one row; overlapping matches of different kinds are all
reported; repeated rows are scanned each on its own; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written


def _either(names: str) -> str:
    """A pattern for names, its ASCII letters in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", names)


_SECRET = f"({_either('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_NAME = f"({_either('username|user_?id|user|login|account|client_?id|access_?key_?id')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
#: kind: pattern, and what a match must fulfil besides (m: the match, g: the pattern's group 2).
KINDS = {
    "assign": (_SECRET, lambda m: F.length(F.regexp_extract(m, _SECRET, 2)) >= 6),
    "access": (r"AKIA[A-Z0-9]{16,}", None),
    "hex": (r"[0-9a-f]{24,}", None),
    "id": (_NAME, lambda m: F.length(F.regexp_extract(m, _NAME, 2)) >= 3),
    "key": (
        r"[A-Za-z0-9+/]{40,}",
        lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"),
    ),
    "endpoint": (f"({_either('https?|jdbc|mysql|postgresql|postgres|redis|mongodb|amqp')}|[Ss]3)" + r"""://[^\x00-\x20"'<>]+""", None),
}
BASE, SECRETS, NAMES = ("assign", "access", "hex"), ("assign", "hex", "key"), ("access", "id")
_BREAK = r"\n[\x20\x09\x0D]*\n"
_RANK = {k: i for i, k in enumerate(KINDS)}


def _matches(text: Column, kind: str, pattern: str, fulfils) -> Column:
    """The matches of one kind in a text in order, each with its rank, number, length and the gap before it."""
    rank = _RANK.get(kind, len(_RANK))
    # zip pads the last gap, behind which no match stands, with a null
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m")
    )
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())

    def row(p: Column, i: Column) -> Column:
        valid = F.lit(True) if fulfils is None else fulfils(p["m"])
        return F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), F.length(p["gap"]).alias("gap"),
            F.length(p["m"]).alias("len"), valid.alias("valid"),
        )

    return F.when(text.rlike(pattern), F.transform(pairs, row)).otherwise(_NONE())


def _NONE() -> Column:
    return F.array().cast("array<struct<rank:int,i:int,gap:int,len:int,valid:boolean>>")


def parts_of(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row for each part (start, end, rank, shown) of each row of docs, or one of nulls; key must be unique."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    parts = F.concat(*(_matches(F.col("_t"), k, p, f) for k, (p, f) in KINDS.items()))
    breaks = F.when(F.size("_p") > 0, _matches(F.col("_t"), "break", _BREAK, None)).otherwise(_NONE())
    df = docs.select(*key, whole.alias("_t")).withColumn("_p", parts).withColumn("_all", F.concat("_p", breaks))
    df = df.select(*key, F.explode_outer("_all").alias("_x")).select(*key, "_x.*")
    of_kind = Window.partitionBy(*key, "rank").orderBy("i")
    df = df.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(of_kind).cast("int"))
    df = df.select(*key, "rank", (F.col("end") - F.col("len")).alias("start"), "end", "valid")

    def is_one(kinds) -> Column:
        return F.col("valid") & F.col("rank").isin([_RANK[k] for k in kinds])

    ordered = Window.partitionBy(*key).orderBy("start")
    df = df.withColumn("scope", F.count_if(F.col("rank") == len(_RANK)).over(ordered))
    whole = Window.partitionBy(*key, "scope")
    secret, name = F.max(is_one(SECRETS)).over(whole), F.max(is_one(NAMES)).over(whole)
    secret_or_other = {"id": secret, "key": name, "endpoint": secret & name}
    shown = is_one(BASE)
    for kind, linked in secret_or_other.items():
        shown = shown | (is_one([kind]) & linked)
    return df.withColumn("shown", F.coalesce(shown, F.lit(False)))


def found(docs: DataFrame, key: list[str]) -> DataFrame:
    """One row for each row of docs: its key, and spans, an array of (start, end, kind) in order; key must be unique."""
    span = F.when(F.col("shown"), F.struct("start", "rank", "end"))
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.transform(
        F.sort_array(F.collect_list(span)), lambda s: F.struct(s["start"], s["end"], names[s["rank"]].alias("kind"))
    )
    return parts_of(docs, key).groupBy(*key).agg(spans.alias("spans"))


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    return found(rows, ["doc_id", "_row"]).drop("_row")


def redacted(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; n_chars, where there is one, follows the text.

    Spans are found for each distinct text and joined by two hashes of it to the rows in which a kind can stand at all; other
    rows, those without a text too, pass as they are and are in no join. Rows are carried as one column, so theirs can have any
    names.
    """
    text = F.col("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.cast("string").alias("text"))
    some = F.coalesce(any_part(F.col("text")), F.lit(False))
    # Written, as it is read twice and telling these rows apart costs the most here.
    asked = written(rows.where(some).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")}), "asked")
    by_text = ["a", "b"]
    # Equal texts have equal spans, so one of each is scanned, and a group of copies is no hot key here.
    texts = asked.groupBy(*by_text).agg(F.any_value("text").alias("text"))
    parts = parts_of(texts, by_text).where("shown")
    # Spans of different kinds can overlap; what they cover together is replaced once, under the first one's kind.
    earlier = Window.partitionBy(*by_text).orderBy("start", "rank")
    ahead = earlier.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("start") >= F.coalesce(F.max("end").over(ahead), F.lit(0))
    parts = parts.withColumn("apart", apart.cast("int")).withColumn("cover", F.sum("apart").over(earlier))
    covers = parts.groupBy(*by_text, "cover").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "rank"))["rank"].alias("rank")
    )
    kind = F.array(*(F.lit(k) for k in KINDS))[F.col("rank")].alias("kind")
    spans = covers.groupBy(*by_text).agg(F.sort_array(F.collect_list(F.struct("start", "end", kind))).alias("spans"))
    spans = written(spans, "spans")
    before, after = mark.split("{}")

    def cut(s: Column, i: Column) -> Column:
        last = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])
        return F.concat(F.col("text").substr(last + 1, s["start"] - last), F.lit(before), s["kind"], F.lit(after))

    tail = F.col("text").substr(F.element_at("spans", -1)["end"] + 1, F.length("text"))
    clean = F.concat(F.array_join(F.transform("spans", cut), ""), tail)
    found = asked.join(spans, by_text, "left").withColumn("clean", F.when(F.col("spans").isNotNull(), clean))
    row = F.col("row").withField("text", F.coalesce(F.col("clean").cast(docs.schema["text"].dataType), F.col("row.text")))
    if "n_chars" in docs.columns:
        length = F.length("clean").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("clean").isNotNull(), length).otherwise(F.col("row.n_chars")))
    return rows.where(~some).select("row").union(found.select(row.alias("row"))).select("row.*")


def any_part(text: Column) -> Column:
    """Whether any kind can stand in the text at all."""
    any_kind = F.lit(False)
    for pattern, _ in KINDS.values():
        any_kind = any_kind | text.rlike(pattern)
    return any_kind


def listed(kinds) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scanned(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
    )


def _sql_kind(kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    gaps = f"regexp_split_to_array(text, '{quoted}')"
    return f"""select row_id, {_RANK.get(kind, len(_RANK))} as rank, unnest(list_zip({gaps}, regexp_extract_all(text, '{quoted}'))) as p,
        generate_subscripts({gaps}, 1) as i from d where regexp_matches(text, '{quoted}')"""


def _group_2(pattern: str, least: int) -> str:
    return f"length(regexp_extract(m, '{pattern.replace(chr(39), 2 * chr(39))}', 2)) >= {least}"


def _oracle() -> str:
    kinds = " union all ".join(_sql_kind(k, p) for k, (p, _) in KINDS.items())
    r = _RANK
    valid = f"""case rank when {r["assign"]} then {_group_2(_SECRET, 6)} when {r["id"]} then {_group_2(_NAME, 3)}
      when {r["key"]} then regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[0-9]')
      else true end"""
    secrets, names = (", ".join(str(r[k]) for k in ks) for ks in (SECRETS, NAMES))
    shown = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
found as ({kinds} union all {_sql_kind("break", _BREAK)}),
placed as (
  select row_id, rank, p[2] as m, sum(length(p[1]) + coalesce(length(p[2]), 0)) over (partition by row_id, rank order by i) as stop
  from found),
parts as (
  select row_id, rank, m, stop - length(m) as start, stop, {valid} as valid from placed where m is not null),
scoped as (
  select *, sum((rank = {len(_RANK)})::int) over (partition by row_id order by start) as scope from parts),
linked as (
  select *, max((valid and rank in ({secrets}))::int) over near as secret, max((valid and rank in ({names}))::int) over near as name
  from scoped window near as (partition by row_id, scope)),
spans as (
  select row_id, rank, start::bigint || ':' || stop::bigint as place, start from linked where valid and (rank < 3
    or rank = {r["id"]} and secret = 1 or rank = {r["key"]} and name = 1 or rank = {r["endpoint"]} and secret = 1 and name = 1)),
each as (
  select row_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    string_agg([{shown}][rank + 1] || ':' || place, ',' order by start, rank) filter (rank < 3) as base,
    string_agg([{shown}][rank + 1] || ':' || place, ',' order by start, rank) as spans from spans group by row_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join each using (row_id)
"""


ORACLE = _oracle()
