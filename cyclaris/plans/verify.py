"""Verification of knowledge records: parsing, rules, a join against the replicons, and a report.

Records come as numbered lines of JSON. Rules give arrays of (rule, passed, message), exploded to one row a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECK = "array<struct<rule:string,passed:boolean,message:string>>"
#: What the report lists as rules, by gate. The names of rules and gates are fixed by the report's format.
GATES = {
    "Schema Compliance": {
        "provenance_present": "a record says where it comes from",
        "provenance_atlas_git_sha": "the code's revision is named",
        "provenance_timestamp_utc": "so is the time of the run",
        "provenance_pipeline_seed": "and the seed of its sample",
        "provenance_pipeline_max": "and how many genomes were asked for",
        "provenance_assembly_accession": "a replicon's record names its assembly",
        "provenance_replicon_id": "and the replicon",
        "epsilon_nonneg": "an error bound isn't negative",
        "confidence_range": "a confidence is a share",
        "validity_holds": "the metric's own condition is met",
    },
    "Data Integrity": {
        "gc_fraction_range": "the share of G and C is one",
        "orbit_ratio_range": "an orbit has a quarter of all transforms at least",
        "dmin_range": "a distance by length is a share",
        "length_positive": "sequences have letters",
        "join_replicon": "the replicon that a record names is in the replicon table",
    },
    "Epistemic Invariants": {"no_miracles": "what is derived is no more certain than its sources, unless a rule says why"},
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """record_idx (line number from 1, blank lines counted) and value of the lines under path.

    Several files count as one, in the order of their names. Lines are numbered within the pieces in which they are read, and
    a piece's numbers begin behind the lines of the pieces before it, so that no file has to be in one task. The table of pieces is
    broadcast (some 200 bytes for each piece, so for each 128 MB at most): no line is shuffled.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    piece = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = text.select("value", *piece, F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(F.broadcast(sizes), ["file", "start"]).select((F.col("ahead") + F.col("at") - F.col("first") + 1).alias("record_idx"), "value")


def _as_records(lines: DataFrame) -> DataFrame:
    """record_idx and record (a VARIANT, null where the line is no JSON object) of all lines."""
    # JSON is an object if it begins with a brace; to have the schema of the whole record reckoned takes longer than to parse it.
    is_object = F.ltrim("value", F.lit(" \t\r\n")).startswith("{")
    return lines.select("record_idx", F.when(is_object, F.try_parse_json("value")).alias("record"))


def parsed(lines: DataFrame) -> DataFrame:
    """record_idx and record (a VARIANT, null where the line is no JSON object); blank lines are left out."""
    return _as_records(lines.where(F.trim("value") != ""))


def _get(path: str) -> Column:
    """A field as VARIANT; an absent one and a JSON null are both null."""
    return _there(F.try_variant_get("record", f"$.{path}", "variant"))


def _there(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), v)


#: What the checks read of a record, of its provenance and of its validity.
_FIELDS = ("record_type", "metric_name", "value", "epsilon", "confidence", "validity", "provenance")
_PROVENANCE = ("atlas_git_sha", "timestamp_utc", "pipeline_seed", "pipeline_max", "assembly_accession", "replicon_id")
_VALIDITY = ("holds", "predicate")


def _struct_of(v: Column | str, names: tuple[str, ...]) -> Column:
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")


def _read_once(rows: DataFrame) -> DataFrame:
    """Rows with what the checks ask of a record as columns: each field is looked up and told apart once, not by every check."""
    rows = rows.withColumn("_r", _struct_of("record", _FIELDS))
    rows = rows.withColumns({"_p": _struct_of("_r.provenance", _PROVENANCE), "_v": _struct_of("_r.validity", _VALIDITY)})
    r = {n: F.col(f"_r.{n}") for n in _FIELDS}
    made = {
        "has_provenance": _there(r["provenance"]).isNotNull(), "has_validity": _there(r["validity"]).isNotNull(),
        "kind": F.try_variant_get(r["record_type"], "$", "string"), "metric": F.try_variant_get(r["metric_name"], "$", "string"),
        **{n: _number(_there(r[n])) for n in ("value", "epsilon", "confidence")},
        **{f"blank_{n}": _is_blank(_there(F.col(f"_p.{n}"))) for n in _PROVENANCE if not n.startswith("pipeline")},
        **{f"has_{n}": _there(F.col(f"_p.{n}")).isNotNull() for n in _PROVENANCE if n.startswith("pipeline")},
        "has_holds": _there(F.col("_v.holds")).isNotNull(), "holds": F.try_variant_get(_there(F.col("_v.holds")), "$", "boolean"),
    }
    return rows.select("record_idx", "record", *(c.alias(f"_{k}") for k, c in made.items()))


def _text(path: str) -> Column:
    return F.try_variant_get("record", f"$.{path}", "string")


def _number(v: Column) -> Column:
    """Numbers and booleans as double; strings don't count, whatever they hold."""
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT|BIGINT|BOOLEAN)"), F.try_variant_get(v, "$", "double"))


def _is_blank(v: Column) -> Column:
    return v.isNull() | ((F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == ""))


def check(rule: str, passed: Column, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    passed = F.coalesce(passed, F.lit(False))
    shown = F.when(passed, F.lit("")).otherwise(F.coalesce(message, F.lit("")))
    return F.struct(F.lit(rule).alias("rule"), passed.alias("passed"), shown.alias("message"))


def _some(*pairs: tuple[Column, Column]) -> Column:
    """An array of the checks whose condition holds."""
    return F.filter(F.array(*(F.when(cond, c) for cond, c in pairs)), lambda x: x.isNotNull())


def _outside(name: Column | str, field: str, allowed: str) -> Column:
    """What was found in a field, and what may stand there."""
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit(" is "), _text(field), F.lit(f"; allowed: {allowed}"))


def provenance_checks() -> Column:
    always, replicon = F.lit(True), F.col("_kind") == "replicon_metric"
    rows = [(always, check(f"provenance_{f}", ~F.col(f"_blank_{f}"), f"provenance.{f} is absent or empty")) for f in ("atlas_git_sha", "timestamp_utc")]
    rows += [(always, check(f"provenance_{f}", F.col(f"_has_{f}"), f"provenance.{f} is absent")) for f in ("pipeline_seed", "pipeline_max")]
    rows += [
        (replicon, check(f"provenance_{f}", ~F.col(f"_blank_{f}"), f"provenance.{f} is absent or empty in a replicon's record"))
        for f in ("assembly_accession", "replicon_id")
    ]
    missing = F.array(check("provenance_present", F.lit(False), "no provenance"))
    return F.when(~F.col("_has_provenance"), missing).otherwise(_some(*rows))


def bound_checks() -> Column:
    eps, conf = F.col("_epsilon"), F.col("_confidence")
    return F.array(
        check("epsilon_nonneg", eps.isNull() | (eps >= 0), _outside("epsilon", "epsilon", "from 0")),
        check("confidence_range", conf.isNull() | conf.between(0, 1), _outside("confidence", "confidence", "0 to 1")),
    )


def validity_checks() -> Column:
    false = F.col("_holds") == F.lit(False)
    shown = F.concat(
        F.lit("validity.holds is false: "), F.coalesce(_text("metric_name"), F.lit("no metric")), F.lit(" is "),
        F.coalesce(_text("value"), F.lit("absent")), F.lit(", asked for is "), F.coalesce(_text("validity.predicate"), F.lit("nothing")),
    )
    return F.array(
        F.when(~F.col("_has_validity"), check("validity_present", F.lit(False), "no validity"))
        .when(~F.col("_has_holds"), check("validity_holds", F.lit(False), "no validity.holds"))
        .otherwise(check("validity_holds", ~F.coalesce(false, F.lit(False)), shown))
    )


def value_checks(orbit_ratio_min: float = 0.25) -> Column:
    metric, x = F.col("_metric"), F.col("_value")

    def row(names: tuple[str, ...], rule: str, holds: Column, said: str) -> tuple[Column, Column]:
        return metric.isin(*names) & x.isNotNull(), check(rule, holds, _outside(metric, "value", said))

    return _some(
        row(("gc_fraction",), "gc_fraction_range", x.between(0, 1), "0 to 1"),
        row(("orbit_ratio",), "orbit_ratio_range", x.between(orbit_ratio_min, 1), f"{orbit_ratio_min:g} to 1"),
        row(("dmin_over_L", "dmin_normalized"), "dmin_range", x.between(0, 1), "0 to 1"),
        row(("length_bp",), "length_positive", x > 0, "above 0"),
    )


def miracle_checks(strict: bool = False) -> Column:
    """Passes always; the strict form fails derived records without a rule whose epsilon is under that of a source."""
    if not strict:
        return F.array(check("no_miracles", F.lit(True), ""))
    sources = F.array_max(F.try_variant_get("record", "$.derivation.source_epsilons", "array<double>"))
    free = _get("derivation").isNull() | _get("derivation.rule").isNotNull() | sources.isNull()
    own = F.coalesce("_epsilon", F.lit(0.0))
    return F.array(check("no_miracles", free | (own >= sources), "epsilon is below that of a source, and no rule is given"))


def checks(lines: DataFrame, replicon_ids: DataFrame | None = None, strict: bool = False, orbit_ratio_min: float = 0.25) -> DataFrame:
    """rule, passed, message, record_idx of every check. Without replicon ids (column replicon_id) the join is left out."""
    rows = parsed(lines)
    broken = F.array(check("json_parse", F.lit(False), "the line is no JSON object"))
    made = F.concat(
        provenance_checks(), bound_checks(), validity_checks(), value_checks(orbit_ratio_min), miracle_checks(strict)
    )
    each = F.when(F.col("record").isNull(), broken).otherwise(made).cast(CHECK)
    found = _read_once(rows).select("record_idx", F.inline(each))
    if replicon_ids is not None:
        known = replicon_ids.select(F.col("replicon_id").alias("_id")).where("_id is not null").distinct().withColumn("_known", F.lit(True))
        asked = F.when(_text("record_type") == "replicon_metric", _text("provenance.replicon_id"))
        # What is joined are numbers and ids alone, so that no record is shuffled where the ids are too many to broadcast.
        joined = rows.where("record is not null").select("record_idx", asked.alias("_asked")).join(known, F.col("_asked") == F.col("_id"), "left")
        said = F.concat(F.lit("replicon_id "), F.col("_asked"), F.lit(" isn't in the replicon table"))
        one = F.array(check("join_replicon", F.col("_asked").isNull() | F.col("_known").isNotNull(), said)).cast(CHECK)
        found = found.unionByName(joined.select("record_idx", F.inline(one)))
    return found.select("rule", "passed", "message", "record_idx")


def _kernel_checks(lines: DataFrame) -> DataFrame:
    """record_idx, record and made (the checks of the stricter-typed profile of seven rules) of each line that isn't blank."""
    rows = lines.where(F.trim("value") != "").withColumn("record", F.try_parse_json("value"))
    x, eps, conf = _number(_get("value")), _number(_get("epsilon")), _number(_get("confidence"))
    metric = _text("metric_name")

    def filled(field: str) -> Column:
        v = _get(f"provenance.{field}")
        return (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") != "")

    ok = {
        "atlas_git_sha": filled("atlas_git_sha"),
        "timestamp_utc": filled("timestamp_utc"),
    }
    ranges = (
        F.when(metric.isin("gc_fraction", "dmin_over_L", "dmin_normalized"), x.between(0, 1))
        .when(metric == "orbit_ratio", x.between(0.25, 1))
        .when(metric == "length_bp", x > 0)
    )
    holds = F.try_variant_get(_get("validity.holds"), "$", "boolean")
    all_checks = F.array(
        check("ProvenanceGitSha", ok["atlas_git_sha"], "provenance.atlas_git_sha is no text or empty"),
        check("ProvenanceTimestamp", ok["timestamp_utc"], "provenance.timestamp_utc is no text or empty"),
        check("EpsilonNonNegative", eps.isNull() | (eps >= 0), _outside("epsilon", "epsilon", "from 0")),
        check("ConfidenceRange", conf.isNull() | conf.between(0, 1), _outside("confidence", "confidence", "0 to 1")),
        check("ValidityHolds", F.coalesce(holds, F.lit(True)), F.concat(F.lit("validity.holds is false, asked for is "), F.coalesce(_text("validity.predicate"), F.lit("nothing")))),
        check("MetricConstraint", F.coalesce(ranges, F.lit(True)), _outside(metric, "value", "the metric's range")),
    )
    gone = F.array(check("ProvenancePresent", F.lit(False), "no provenance"))
    each = F.when(F.col("record").isNull() | _get("provenance").isNull(), gone).otherwise(all_checks)
    return rows.select("record_idx", "record", each.alias("made"))


def kernel_failures(lines: DataFrame) -> DataFrame:
    """The failures of the stricter-typed profile of seven rules: rule, message, record_idx (from 0)."""
    made = _kernel_checks(lines).select((F.col("record_idx") - 1).alias("record_idx"), F.inline("made"))
    return made.where("not passed").select("rule", "message", "record_idx")


def kernel_summary(lines: DataFrame) -> DataFrame:
    """That profile's counters, one row: total_records (blank lines too), total_checks, passed, failed.

    A record counts seven checks, whatever of it could be checked; a line that doesn't parse is one failed check.
    """
    failed = F.size(F.filter("made", lambda c: ~c["passed"]))
    n = F.when(F.col("record").isNull(), 1).otherwise(7)
    sums = {"total_checks": n, "passed": n - failed, "failed": failed}
    made = _kernel_checks(lines).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()))
    return lines.agg(F.count("*").alias("total_records")).join(made)


def summary(found: DataFrame, lines: DataFrame) -> DataFrame:
    """total_records, total_checks, passed, failed, pass_rate: one row."""
    total = lines.where(F.trim("value") != "").agg(F.count("*").alias("total_records"))
    n, p = F.count("*"), F.count_if("passed")
    made = found.agg(n.alias("total_checks"), p.alias("passed"), (n - p).alias("failed"), F.bround(100 * p / F.greatest(n, F.lit(1)), 2).alias("pass_rate"))
    return total.join(made)


def rule_counts(found: DataFrame) -> DataFrame:
    """Failures of each rule, most first."""
    return found.where("not passed").groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def top_failures(found: DataFrame, n: int = 10) -> DataFrame:
    """The first n failures of each rule."""
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("record_idx"))
    return found.where("not passed").withColumn("nth", nth.cast("long")).where(F.col("nth") <= n)


def first_failures(found: DataFrame, n: int = 20) -> DataFrame:
    return found.where("not passed").orderBy("record_idx", "rule").limit(n)


def unknown_replicons(lines: DataFrame, replicon_ids: DataFrame) -> DataFrame:
    """Records whose replicon isn't known: an anti join."""
    rows = parsed(lines).where(_text("record_type") == "replicon_metric")
    rows = rows.select("record_idx", _text("provenance.replicon_id").alias("replicon_id")).where("replicon_id is not null")
    return rows.join(replicon_ids.select("replicon_id").distinct(), "replicon_id", "left_anti")


def report(found: DataFrame, lines: DataFrame, generated: str = "") -> tuple[str, bool]:
    """The report as Markdown, and whether all passed. What comes to the driver are at most ten rows a rule.

    Checks are counted by rule in one pass and never kept; a second pass, for the first failures, is only made if there are any.
    """
    total = lines.where(F.trim("value") != "").count()
    by_rule = found.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed")).collect()
    n, p = sum(r["n"] for r in by_rule), sum(r["passed"] for r in by_rule)
    # Counts are longs, also where a number of the driver's would be an int, of which the hundredfold of 21.5 million checks is none.
    n_long, p_long = (F.lit(v).cast("long") for v in (n, p))
    rate = lines.sparkSession.range(1).select(F.bround(100 * p_long / F.greatest(n_long, F.lit(1)), 2)).first()[0]
    s = (total, n, p, n - p, rate)
    counts = sorted(((r["rule"], r["n"] - r["passed"]) for r in by_rule if r["n"] > r["passed"]), key=lambda x: (-x[1], x[0]))
    tops = [tuple(r) for r in top_failures(found).select("rule", "record_idx", "message").orderBy("rule", "record_idx").collect()] if counts else []
    names = ("records", "checks", "passed", "failed", "percent passed")
    out = ["# Check of the knowledge records", "", f"Written {generated}", "", *(f"* {k}: {v}" for k, v in zip(names, s)), ""]
    out += ["## All checks passed", ""] if not s[3] else ["## Some checks failed", ""]
    for rule, n in counts:
        out += [f"### {rule}: {n}", "", *(f"* line {i}: {m}" for r, i, m in tops if r == rule)]
        out += [f"* {n - 10} further lines"] * (n > 10) + [""]
    out += ["## What was checked", ""]
    number = 0
    for title, rules in GATES.items():
        out += [f"{title}:", ""]
        for rule, text in rules.items():
            number += 1
            out.append(f"{number}. **{rule}**: {text}")
        out.append("")
    return "\n".join(out), not s[3]
