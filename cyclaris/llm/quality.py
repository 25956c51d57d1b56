"""Quality rules in DataFrame operations only, as a short-circuit cascade.

Base measures are computed once per text, by expressions that stay linear (or n log n) in the words of the text: the
3-word windows are hashed with their position into one sorted array, neighbours with equal hashes are candidates, and
the candidates' words decide, so a hash that two windows share by chance changes nothing. No row is ever shuffled.

The cascade: on a sample each rule's rejections are counted and its evaluations timed, all rules in one job: a row of the
sample reads the clock, evaluates a rule several times, and reads it again; the shortest of some readings counts, so that
pauses and first runs don't. Rules then run in the order of rejections per cost, and a text leaves at the first rule that it
fails. Rules that reject nothing of the sample come last, by name: a text that reaches them is expected to pass them all, so
their order saves nothing. Costs count in powers of `COST_STEP` from `COST_LEAST` on and ties go by name, so that little noise doesn't
change the order; a cost between two powers may fall to either. The order changes the work, never the verdict; `rejected_by`
names the rule at which a text left, and is the same in every run with the same order. The sample is the first rows that the first
input splits give, which reads as many splits as it needs: it orders rules and nothing else.

Defined cases: a null or blank text has no words and is rejected by the base rule; a very long text is measured whole (only
the sample leaves it out); repeated rows are judged each on its own; null ids are kept; an empty table gives an empty result; `judged` keeps further columns unless they bear a result's
name, which then replaces them; `filtered` gives the rows back as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, put, table

MIN_WORDS, MAX_REPEATED = 50, 50
#: The sample on which rules are timed: so many rows, of texts up to this length. Evaluations of a rule between two readings
#: of the clock, and such readings for each row, of which the shortest counts.
SAMPLE_ROWS, SAMPLE_CHARS, EVALUATIONS, TIMES = 300, 50_000, 4, 3
#: Seconds of one evaluation below which rules cost the same, and the factor between one cost and the next.
COST_LEAST, COST_STEP = 5e-6, 4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules beyond the base rule: the condition under which a text is rejected.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_words",
    "exclamations": "5 * regexp_count(_text, '!') > n_words",
    "upper_case": "2 * regexp_count(_text, '[A-Z]') > word_chars",
    "digits": "2 * regexp_count(_text, '[0-9]') > word_chars",
}

_STEPS = (
    {"_text": "coalesce(cast(text as string), '')"},
    {
        "_w": r"filter(split(_text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')",
        "_lines": r"filter(split(_text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')",
    },
    {
        "n_words": "cast(size(_w) as bigint)",
        "word_chars": "cast(length(array_join(_w, '')) as bigint)",
        "n_symbols": "cast(regexp_count(_text, '[#*$%&|<>]') as bigint)",
        "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) as bigint)",
        "_bits": "length(bin(size(_w)))",
    },
    # Of each window: its hash, and in the low bits its position.
    {
        "_h": """if(n_words < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, size(_w) - 3),
             i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), _bits) | i)))"""
    },
    {
        "_c": """transform(filter(_h, (x, i) -> shiftright(x, _bits) = shiftright(get(_h, i - 1), _bits)
                or shiftright(x, _bits) = shiftright(get(_h, i + 1), _bits)),
             x -> cast(x & (shiftleft(1L, _bits) - 1) as int))"""
    },
    {"_v": "sort_array(transform(_c, i -> struct(concat_ws(' ', slice(_w, i + 1, 3)) as s, i as i)))"},
    {
        "_r": """sort_array(transform(filter(_v, (x, i) -> x.s = get(_v, i - 1).s or x.s = get(_v, i + 1).s),
             x -> x.i))"""
    },
    {
        "n_repeat_words": """aggregate(transform(_r, (x, i) -> if(i = 0, 3, least(3, x - get(_r, i - 1)))),
             0L, (a, x) -> a + x)"""
    },
)


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base measures, base_failed, and the text as _text."""
    temp = {"_w", "_lines", "_bits", "_h", "_c", "_v", "_r"}
    kept = [c for c in docs.columns if c not in {*BASE, "base_failed", "rejected_by", "kept", "_text", *temp}]
    df = docs.select(*(F.col(f"`{c}`") for c in kept))
    for step in _STEPS:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    # A filter on the measures must not be pushed below them, as their expressions would then be nested in one another;
    # it isn't pushed below the generator that gives them.
    one = F.inline(F.array(F.struct(*BASE))).alias(*BASE)
    df = df.drop(*temp).select(*(F.col(f"`{c}`") for c in kept), "_text", one)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def sampled(base: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """What the rules need of a bounded sample of the texts that pass the base rule: rows come split by split until there
    are enough."""
    fine = base.where(~F.col("base_failed") & (F.length("_text") <= SAMPLE_CHARS))
    fine = fine.select("_text", *(F.col(f"`{c}`") for c in fine.columns if c != "_text" and any(c in r for r in rules.values())))
    rows = fine.select(F.to_json(F.struct("*"))).limit(SAMPLE_ROWS).collect()
    spark, path = base.sparkSession, new_path(base.sparkSession, "sample")
    put(spark, path, "\n".join([r[0] for r in rows]))
    return spark.read.schema(fine.schema).json(path).coalesce(1)


def _nanoseconds(rule: str) -> Column:
    """The shortest time that so many evaluations of a rule take on a row."""
    clock = "java_method('java.lang.System', 'nanoTime')"
    run = f"aggregate(sequence(1, {EVALUATIONS}), 0, (_n, _i) -> _n + if({rule}, _i, 0))"
    readings = [F.expr(f"array(cast({clock} as bigint), cast({run} as bigint), cast({clock} as bigint))") for _ in range(TIMES)]
    return F.array_min(F.transform(F.array(*readings), lambda x: x[2] - x[0]))


def costs(sample: DataFrame, rules: dict[str, str] = RULES) -> dict[str, tuple[float, int]]:
    """Of each rule: the cost of one evaluation in steps, and the rows of the sample that it rejects."""
    timed = sample.select(_nanoseconds("_i < 0").alias("_idle"), *(F.struct(_nanoseconds(r).alias("ns"), F.expr(r).alias("out")).alias(k) for k, r in rules.items()))
    sums = [F.struct(F.sum(F.col(k)["ns"] - F.col("_idle")), F.count_if(F.col(k)["out"])).alias(k) for k in rules]
    found, out = timed.agg(F.count("*").alias("_rows"), *sums).first(), {}
    for k in rules:
        ns, rejected = found[k]
        each = (ns or 0) / 1e9 / max(1, found["_rows"] * EVALUATIONS)
        out[k] = COST_STEP ** max(0, round(math.log(max(each, COST_LEAST) / COST_LEAST, COST_STEP))), rejected
    return out


def ordered_rules(base: DataFrame, rules: dict[str, str] = RULES) -> list[str]:
    """Names of the rules by rejections per cost on a bounded sample, the most rewarding first; ties by name."""
    found = costs(sampled(base, rules), rules)
    return sorted(rules, key=lambda k: (-found[k][1] / found[k][0], k))


def first_failed(order: list[str], rules: dict[str, str] = RULES) -> Column:
    """The rule at which a text leaves the cascade, or null; later rules aren't evaluated."""
    return F.coalesce(*(F.when(F.expr(rules[k]), F.lit(k)) for k in order), F.lit(None).cast("string"))


def judged(docs: DataFrame, rules: dict[str, str] = RULES, order: list[str] | None = None) -> DataFrame:
    """docs with the base measures, base_failed, rejected_by and kept."""
    base = measured(docs)
    order = order or ordered_rules(base, rules)
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_failed(order, rules))
    return base.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop("_text")


def filtered(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The rows of docs that pass, as they are, whatever their columns are called."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return judged(rows, rules).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", *BASE, "base_failed", "kept")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_COUNT = "length(regexp_replace(coalesce(text, ''), '[^{}]', '', 'g'))"
ORACLE = rf"""
with d as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as text, {_WORDS} as w, {_LINES} as l
  from documents),
windows as (
  select row_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) > 2),
named as (
  select row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from windows),
repeated as (
  select row_id, i from (select *, count(*) over (partition by row_id, s) as n from named) where n > 1),
covered as (
  select row_id, count(distinct j) as n_repeat_words from (
    select row_id, unnest([i, i + 1, i + 2]) as j from repeated) group by row_id),
base as (
  select doc_id, text, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    {_COUNT.format("#*$%&|<>")} as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join covered using (row_id)),
failed as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > n_words or 2 * word_chars < 5 * n_words or word_chars > 12 * n_words
    or 2 * n_dup_lines > n_words or 5 * {_COUNT.format("!")} > n_words
    or 2 * {_COUNT.format("A-Z")} > word_chars or 2 * {_COUNT.format("0-9")} > word_chars) as kept
from failed
"""
