"""Derivations over chains, rules as a table, table functions, bounded failures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cyclaris.functions import sql
from cyclaris.operators import approx, exact
from cyclaris.plans import derivation, knowledge, validate


def lines_of(spark, records):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "record_idx long, value string")


def record(name, epsilon, sources=None, rule=None):
    made = {"record_id": name, "epsilon": epsilon}
    if sources is not None:
        made["derivation"] = {"sources": sources} | ({"rule": rule} if rule else {})
    return made


def failures(spark, records):
    return {(r["record_idx"], r["rule"]) for r in derivation.derivation_checks(lines_of(spark, records)).where("not passed").collect()}


def test_chains_and_cycles(spark):
    chain = [record("a", 0.5), record("b", 0.5, ["a"]), record("c", 0.4, ["b"]), record("d", 0.45, ["c"]), record("e", 0.1, ["d"], "measured"), record("f", 0.1, ["e"])]
    assert failures(spark, chain) == {(2, "no_miracles_chain"), (3, "no_miracles_chain")}
    loop = [record("x", 0.1, ["y"]), record("y", 0.1, ["x"]), record("z", 0.1, ["y"]), record("w", 0.0, ["w"], "self"), record("v", 0.2, ["nowhere", "x"])]
    ends = "derivation_ends"
    assert failures(spark, loop) == {(0, ends), (1, ends), (2, ends), (3, ends), (4, ends), (4, "derivation_sources")}


def test_odd_records(spark):
    odd = ["", "no json", "[1]", record("a", None), record("a", 0.3), record(None, 0.1, ["a", "a", None]), record("b", 0.3, [7]), record(7, 0.2), record("c", 0.0, []), {"derivation": {"sources": "x"}}]
    found = derivation.derivation_checks(lines_of(spark, odd)).collect()
    assert {r["record_idx"] for r in found} == {5, 6} and {(r["record_idx"], r["rule"]) for r in found if not r["passed"]} == {(5, "no_miracles_chain")}
    assert derivation.derivation_checks(lines_of(spark, [])).count() == 0


def plain_failures(records):
    by_id = {}
    for r in records:
        by_id.setdefault(r["record_id"], []).append(r)

    def src(r):
        return r.get("derivation", {}).get("sources", [])

    def walk(r, rules_stop):
        seen, todo = set(), list(src(r))
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                for x in by_id.get(s, []):
                    if not (rules_stop and x.get("derivation", {}).get("rule")):
                        todo += src(x)
        return seen

    out = set()
    for i, r in enumerate(records):
        if not src(r):
            continue
        if any(s not in by_id for s in src(r)):
            out.add((i, "derivation_sources"))
        if any(s in by_id and any(s in walk(x, False) for x in by_id[s]) for s in walk(r, False)):
            out.add((i, "derivation_ends"))
        above = [x["epsilon"] for s in walk(r, True) for x in by_id.get(s, [])]
        if not r["derivation"].get("rule") and above and r["epsilon"] < max(above):
            out.add((i, "no_miracles_chain"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_derivations(spark, seed):
    rng, records = random.Random(seed), []
    for i in range(120):
        some = [f"r{rng.randrange(max(0, i - 12), i + (rng.random() < 0.03) * 5 + 1)}" for _ in range(rng.choice([0, 1, 1, 2]))]
        records.append(record(f"r{i}" if rng.random() < 0.95 else "r1", rng.randrange(8) / 8, some, rng.choice([None, None, None, "rule"])))
    assert failures(spark, records) == plain_failures(records)


def test_rules_of_a_table(spark):
    rows = spark.createDataFrame([("m", 3.0, False, "3"), ("m", None, False, "x"), ("n", 2.0, False, "2"), ("b", None, True, "true"), ("length_bp", -1.0, False, "-1")], "metric_name string, x double, is_boolean boolean, shown string")
    table = spark.createDataFrame([("m", "small", "x < 3"), ("m", "text", "shown rlike '^[0-9]'"), ("b", "boolean", "is_boolean")], knowledge.RULE)
    made = [tuple(r["v"]) for r in rows.select(knowledge.compiled(table).alias("v")).collect()]
    assert made == [(False, "small and text"), (False, "text"), (True, None), (True, "boolean"), (True, None)]
    made = [tuple(r["v"]) for r in rows.select(knowledge.compiled(knowledge.rules(spark).union(table)).alias("v")).collect()]
    assert made[4] == (False, "x > 0")
    with pytest.raises(ValueError):
        knowledge.compiled(spark.range(10_001).select(F.col("id").cast("string").alias("metric_name"), F.lit("p").alias("predicate"), F.lit("true").alias("condition")))


def test_table_functions(spark):
    sql.register(spark)
    t = spark.createDataFrame([(1, "ACGTA"), (2, ""), (3, None), (4, "AC")], "id int, seq string")
    got = spark.sql("select id, w.* from {t} t, lateral windows(t.seq, 2, 2) w order by 1, 2", t=t).collect()
    assert [tuple(r) for r in got] == [(1, 0, "AC"), (1, 2, "GT"), (4, 0, "AC")]
    members = spark.sql("select id, collect_set(o.member) as m from {t} t, lateral orbit(t.seq) o group by id", t=t).collect()
    want = {r["id"]: set(r["m"]) for r in t.select("id", exact.orbit("seq").alias("m")).where("id in (1, 4)").collect()}
    assert {r["id"]: set(r["m"]) for r in members} == want
    best = spark.sql("select id, min(distance) as d from {t} t, lateral dihedral_transforms(t.seq) x group by id", t=t).collect()
    lone = spark.sql("select id, dmin(seq) as d from {t} t where length(seq) > 0", t=t).collect()
    assert {tuple(r) for r in best} == {tuple(r) for r in lone}
    assert "ArrowEval" not in spark.sql("select w.* from {t} t, lateral windows(t.seq, 2, 2) w", t=t)._jdf.queryExecution().executedPlan().toString()


def test_table_functions_are_no_joins(spark):
    sql.register(spark)
    t = spark.createDataFrame([(1, "ACGTN"), (2, ""), (3, None), (4, "A"), (5, "ACGTN"), (6, "AC")], "id int, seq string")
    for call in ("windows(t.seq, 2, 2)", "orbit(t.seq)", "dihedral_transforms(t.seq)"):
        plan = spark.sql(f"select t.id, x.* from {{t}} t, lateral {call} x", t=t)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    got = spark.sql("select id, x.family, x.k, x.transformed, x.distance from {t} t, lateral dihedral_transforms(t.seq) x", t=t)
    want = approx.transforms(t.where("seq <> ''")).drop("seq")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() == 2 * (3 * 5 - 1) + 2 + 5


def test_failures_are_bounded_before_the_shuffle(spark):
    rows = spark.range(5000).select((F.col("id") % 2).cast("string").alias("function_name"), F.format_string("%05d", "id").alias("input"), F.lit(False).alias("passed"))
    made = validate.first_failures(rows)
    assert "WindowGroupLimit" in made._jdf.queryExecution().executedPlan().toString()
    found = {r["function_name"]: r["failed_cases"] for r in made.collect()}
    assert found["0"] == [f"{i:05d}" for i in range(0, 40, 2)] and found[None] == [f"{i:05d}" for i in range(20)]


def test_what_rounds_write_grows_with_the_links(spark, monkeypatch):
    chains, length = 20, 12
    records = [record(f"{c}-{i}", 0.5, [f"{c}-{i - 1}", f"{c}-{i // 2}"] if i else None) for c in range(chains) for i in range(length)]
    records += [record("x", 0.4, ["y", "0-11", "nowhere"]), record("y", 0.4, ["x"]), record("z", 0.6, ["x"]), record("w", 0.45, ["z", "1-0"], "rule"), record("v", 0.1, ["w"])]
    paths, scratch, partitions = [], derivation.scratch, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(derivation, "scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    at = chains * length
    ends = {(at + i, "derivation_ends") for i in range(5)}
    bounds = {(at + i, "no_miracles_chain") for i in (0, 1, 4)}
    assert failures(spark, records) == ends | bounds | {(at, "derivation_sources")} == plain_failures(records)
    written = sum(spark.read.parquet(p).count() for p in paths)
    assert written < 3 * sum(1 + len(r.get("derivation", {}).get("sources", [])) for r in records)
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions


def test_links_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(derivation, "PER_TASK", 30)
    test_random_derivations(spark, 3)
