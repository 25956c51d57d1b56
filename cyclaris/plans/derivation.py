"""Derivations between records, followed over whole chains: a bound on errors can't fall along one unless a rule says why.

A record may have a `record_id`, and in `derivation` the `sources` that it was derived from (ids of records) and a `rule`. Three checks
are made of each record with sources:

    derivation_sources   every source is a record
    derivation_ends      no chain of sources leads into a cycle
    no_miracles_chain    the record's epsilon isn't below that of any record that it derives from, directly or through
                         records without a rule; a record with a rule may have any, and stands for itself towards others

A record is settled in the round after the last of its sources is; it then has the greatest epsilon seen by its links. Each link is followed
once, in the round after its source is settled, so what is shuffled and written in all rounds is a row or two for each link, and a row for
each round that a record waits with some of its sources settled. Links and records are kept by the executors, dealt by the id that they are
joined by, and are read in every round but not shuffled. The number of rounds is the length of the longest chain; each is written
to the shared folder. Records that are never settled are those whose sources lead into a cycle. Among these alone, the greatest
epsilon moves along the links by rounds until none is raised, and a round takes only the records whose value the last one raised.
Links of one source are in one task, as rows that are read one after the other.

Defined cases: records that share an id count together (the greatest epsilon, all their sources, a rule only if all have one); a
missing epsilon is 0, as for a check of one record; ids are text or numbers, and compared as text; null sources are
left out; a record may be a source several times; a record without id can have sources; lines that don't parse, and records without
sources, have no such checks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from .verify import CHECK, _as_records, _get, _number, _text, check

#: Links of a task of a round.
PER_TASK = 1 << 18


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def derivations(lines: DataFrame) -> DataFrame:
    """record_idx, id, epsilon, has_rule and sources (an array, empty if there are none) of each line; one that is no record has neither id
    nor sources."""
    # No filter here: it would be moved ahead of the parsing, and the line made and parsed twice.
    sources = F.try_variant_get("record", "$.derivation.sources", "array<string>")
    sources = F.array_distinct(F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return _as_records(lines).select(
        "record_idx", _text("record_id").alias("id"), F.coalesce(_number(_get("epsilon")), F.lit(0.0)).alias("epsilon"),
        _get("derivation.rule").isNotNull().alias("has_rule"), sources.alias("sources"),
    )


def bounds(links: DataFrame, own: DataFrame) -> DataFrame:
    """id and bound: the greatest value of own (id, epsilon) that links (id, source) lead to from an id, its own included."""
    bound = _kept(own.select("id", F.col("epsilon").alias("bound"), F.lit(True).alias("raised")), "bounds")
    while True:
        raised = bound.where("raised").select(F.col("id").alias("source"), "bound")
        reached = links.join(raised, "source").groupBy("id").agg(F.max("bound").alias("offered"))
        joined = bound.drop("raised").join(reached, "id", "left")
        after = joined.select("id", F.greatest("bound", "offered").alias("bound"), F.coalesce(F.col("offered") > F.col("bound"), F.lit(False)).alias("raised"))
        bound = _kept(after, "bounds")
        if bound.where("raised").isEmpty():
            return bound.select("id", "bound")


@contextmanager
def _tasks(spark: SparkSession, n: int) -> Iterator[None]:
    """Shuffles have n partitions within: as many as tables kept in n partitions, so that these aren't shuffled to be joined."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def closure(links: DataFrame, own: DataFrame) -> DataFrame:
    """id, bound and endless of all ids of own (id, epsilon), each there once, that links (id, source, passes; each pair once) connect: the
    greatest epsilon that links which pass lead to, its own included, and whether links lead into a cycle. Sources that own lacks have a null bound."""
    spark, links = links.sparkSession, _kept(links, "links")
    counted = own.select("id", "epsilon", F.lit(0).alias("n")).union(links.select("id", F.lit(None).cast("double"), F.lit(1)))
    nodes = _kept(counted.groupBy("id").agg(F.max("epsilon").alias("epsilon"), F.sum("n").alias("n")), "nodes")
    # A round reads all that is kept but makes little of it, so many small tasks would take longer to begin than to run.
    n = max(spark.sparkContext.defaultParallelism, math.ceil(links.count() / PER_TASK))
    links, nodes = links.repartition(n, "source").persist(), nodes.repartition(n, "id").persist()
    try:
        with _tasks(spark, n):
            return _closure(links, nodes)
    finally:
        links.unpersist()
        nodes.unpersist()


def _closure(links: DataFrame, nodes: DataFrame) -> DataFrame:
    spark, rounds = links.sparkSession, []
    # Settled in the first round: ids without links, and sources that are no records.
    absent = links.join(nodes.select(F.col("id").alias("source")), "source", "left_anti").select("source").distinct()
    after = nodes.where("n = 0").select("id", F.col("epsilon").alias("bound"), "n", F.lit(True).alias("settled"))
    after = after.union(absent.select("source", F.lit(None).cast("double"), F.lit(0).cast("bigint"), F.lit(True)))
    while True:
        rounds.append(scratch(spark, "settled"))
        after.write.parquet(rounds[-1])
        last = spark.read.schema(after.schema).parquet(rounds[-1])
        waiting = last.where("not settled").select("id", "bound", "n")
        if last.where("settled").isEmpty():
            break
        sources = last.where("settled").select(F.col("id").alias("source"), "bound").hint("shuffle_hash")
        offers = links.join(sources, "source").select("id", F.when(F.col("passes"), F.col("bound")).alias("bound"), F.lit(1).cast("bigint").alias("n"))
        seen = offers.union(waiting).groupBy("id").agg(F.max("bound").alias("offered"), F.sum("n").alias("seen")).hint("shuffle_hash")
        after = nodes.join(seen, "id").select("id", F.greatest("epsilon", "offered").alias("bound"), F.col("seen").alias("n"), (F.col("seen") == F.col("n")).alias("settled"))
    settled = spark.read.schema(last.schema).parquet(*rounds).where("settled").select("id", "bound")
    never = nodes.where("n > 0").join(settled.select("id"), "id", "left_anti").join(waiting.drop("n"), "id", "left")
    never = _kept(never.select("id", F.greatest("epsilon", "bound").alias("epsilon")), "never")
    found = settled.withColumn("endless", F.lit(False))
    if never.isEmpty():
        return found
    among = links.where("passes").join(never.select("id"), "id", "left_semi").join(never.select(F.col("id").alias("source")), "source", "left_semi")
    return found.union(bounds(_kept(among.select("id", "source"), "links"), never).withColumn("endless", F.lit(True)))


def derivation_checks(lines: DataFrame) -> DataFrame:
    """rule, passed, message, record_idx of the three checks."""
    rows = _kept(derivations(lines), "derivations")
    known = rows.where("id is not null").groupBy("id").agg(F.max("epsilon").alias("epsilon"))
    each = rows.select("record_idx", "id", "has_rule", F.explode("sources").alias("source"))
    links = each.where("id is not null").groupBy("id", "source").agg(F.bool_or(~F.col("has_rule")).alias("passes"))
    found = each.join(closure(links, known).withColumnRenamed("id", "source"), "source", "left")
    of_record = found.groupBy("record_idx").agg(
        F.max("bound").alias("bound"), F.bool_or(F.col("bound").isNull()).alias("unknown"), F.bool_or(F.coalesce("endless", F.lit(False))).alias("endless"),
        F.min(F.when(F.col("bound").isNull(), F.col("source"))).alias("absent"),
    )
    made = rows.where(F.size("sources") > 0).join(of_record, "record_idx")
    falls = ~F.col("has_rule") & (F.col("epsilon") < F.col("bound"))
    checks = F.array(
        check("derivation_sources", ~F.col("unknown"), F.concat(F.lit("no record is called "), F.col("absent"))),
        check("derivation_ends", ~F.col("endless"), "its sources lead into a cycle"),
        check("no_miracles_chain", ~F.coalesce(falls, F.lit(False)), F.concat(F.lit("epsilon is "), F.col("epsilon").cast("string"), F.lit(" and that of a source "), F.col("bound").cast("string"))),
    ).cast(CHECK)
    return made.select("record_idx", F.inline(checks)).select("rule", "passed", "message", "record_idx")
