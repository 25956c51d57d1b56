"""Queries of the engine's own operators over the driver's tables, and the SQL that gives the same rows.

The tables hold no nucleotides, so sequences come from rules that both engines know:

    K  the MD5 of a key, its 16 digits mapped to four letters: 32 letters
    D  the decimal digits of a key, mapped to four letters: short, so often symmetric
    T  the letters A, C, G, T of a whole text
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequence as s
from .functions import sql
from .operators import approx, chromosome, exact, lift, rolling, windows
from .plans import derivation, knowledge, pipeline, validate, verify
from .sources import assemblies, fasta, fasta_ranges, files, tables
from .streaming import replicons

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a table of some megabytes is read by one or two, and what is done with
    each row here takes far longer than to read it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _k(key: str) -> Column:
    return F.translate(F.md5(F.col(key).cast("string")), "0123456789abcdef", "ACGT" * 4)


def _d(key: str) -> Column:
    return F.translate((F.col(key) * 7919).cast("string"), "0123456789", "ACGTACGTAC")


def _t(text: str = "text") -> Column:
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


K = "translate(md5(cast({} as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
D = "translate(cast({} * 7919 as varchar), '0123456789', 'ACGTACGTAC')"
T = "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))"
RC = "translate(reverse({}), 'ACGTRYKMBDHV', 'TGCAYRMKVHDB')"
PERIOD = "cast(case when length(seq) = 0 then 1 else strpos(substr(seq || seq, 2), seq) end as bigint)"
ORBIT = (
    f"cast(case when length(seq) = 0 then 0 else {PERIOD} * case when strpos(seq || seq, reverse(seq)) > 0 then 1 else 2 end "
    "end as bigint)"
)
RATIO = f"case when length(seq) = 0 then 1.0::double else ({ORBIT})::double / (2 * length(seq)) end"


# Operators on sequences


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select("o_orderkey", _k("o_orderkey").alias("seq"), (F.col("o_custkey") % 90 - 45).alias("k"))


_ORDERS = f"with t as (select o_orderkey, {K.format('o_orderkey')} as seq, o_custkey % 90 - 45 as k from orders) "


@query("seq_shift", _ORDERS + "select o_orderkey, substr(seq, (((k % 32) + 32) % 32 + 1)::int) || substr(seq, 1, (((k % 32) + 32) % 32)::int) as shifted from t")
def seq_shift(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", s.shift("seq", F.col("k")).alias("shifted"))


@query("seq_reverse", _ORDERS + "select o_orderkey, reverse(seq) as reversed from t")
def seq_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", s.reverse("seq").alias("reversed"))


@query("seq_complement", _ORDERS + "select o_orderkey, translate(seq, 'ACGTRYKMBDHV', 'TGCAYRMKVHDB') as complement from t")
def seq_complement(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", s.complement("seq").alias("complement"))


@query("seq_rev_comp", _ORDERS + f"select o_orderkey, {RC.format('seq')} as rev_comp from t")
def seq_rev_comp(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", s.rev_comp("seq").alias("rev_comp"))


@query("seq_hamming", f"select c_custkey, hamming({K.format('c_custkey')}, {K.format('c_nationkey')})::bigint as distance from customer")
def seq_hamming(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select("c_custkey", s.hamming(_k("c_custkey"), _k("c_nationkey")).alias("distance"))


@query("gc_content", f"with t as (select doc_id, {T} as seq from documents) select doc_id, case when length(seq) = 0 then 0.0::double else (length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))::double / length(seq) end as gc from t")
def gc_content(spark: SparkSession, d: str) -> DataFrame:
    seq = _read(spark, d, "documents").select("doc_id", _t().alias("seq"))
    return seq.select("doc_id", s.gc_content("seq").alias("gc"))


@query("base_encode", f"select c_custkey, translate({K.format('c_custkey')}, 'ACGT', '0123') as codes, translate({K.format('c_custkey')}, 'ACGT', '3210') as complement_codes from customer")
def base_encode(spark: SparkSession, d: str) -> DataFrame:
    made = _read(spark, d, "customer").select("c_custkey", s.base_codes(_k("c_custkey")).alias("c"))
    other = F.transform("c", s.complement_code)
    return made.select("c_custkey", *(F.array_join(F.transform(x, lambda v: v.cast("string")), "").alias(n) for n, x in (("codes", F.col("c")), ("complement_codes", other))))


@query("gc_shuffle_invariant", f"select c_custkey, 32::bigint as n, true as same_letters from customer where length({K.format('c_custkey')}) = 32")
def gc_shuffle_invariant(spark: SparkSession, d: str) -> DataFrame:
    made = _read(spark, d, "customer").select("c_custkey", _k("c_custkey").alias("seq"))
    made = made.withColumn("moved", s.gc_shuffle("seq", 7))
    same = F.array_sort(s.letters("seq")) == F.array_sort(s.letters("moved"))
    return made.select("c_custkey", s.length("moved").alias("n"), same.alias("same_letters"))


# Exact symmetry


@query(
    "orbit_members",
    f"""with t as (select s_suppkey, {D.format('s_suppkey')} as seq from supplier),
    u as (select s_suppkey, seq, unnest(range(0, length(seq))) as k from t)
    select distinct s_suppkey, member from (
      select s_suppkey, substr(seq, k::int + 1) || substr(seq, 1, k::int) as member from u
      union all select s_suppkey, substr(reverse(seq), k::int + 1) || substr(reverse(seq), 1, k::int) from u)""",
)
def orbit_members(spark: SparkSession, d: str) -> DataFrame:
    made = _read(spark, d, "supplier").select("s_suppkey", _d("s_suppkey").alias("seq"))
    return made.select("s_suppkey", F.explode(exact.orbit("seq")).alias("member"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _spread(_read(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", _d("p_partkey").alias("seq"))


_PARTS = f"with t as (select p_partkey, {D.format('p_partkey')} as seq from part) "
_COUNTED = (
    _PARTS
    + """, u as (select p_partkey, seq, unnest(range(0, length(seq))) as k from t),
    m as (select p_partkey, length(seq) as n, substr(seq, k::int + 1) || substr(seq, 1, k::int) as member from u
      union all select p_partkey, length(seq), substr(reverse(seq), k::int + 1) || substr(reverse(seq), 1, k::int) from u)
    """
)


@query("orbit_size", _COUNTED + "select p_partkey, count(distinct member) as orbit_size from m group by p_partkey")
def orbit_size(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("p_partkey", exact.orbit_size("seq").alias("orbit_size"))


@query("orbit_ratio", _COUNTED + "select p_partkey, count(distinct member)::double / (2 * any_value(n)) as orbit_ratio from m group by p_partkey")
def orbit_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("p_partkey", exact.orbit_ratio("seq").alias("orbit_ratio"))


@query("palindromes", _PARTS + "select p_partkey, seq from t where seq = reverse(seq)")
def palindromes(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).where(exact.is_palindrome("seq"))


@query("rc_fixed", f"with t as (select p_partkey, {D.format('p_partkey')} as half from part), u as (select p_partkey, half || {RC.format('half')} as seq from t union all select p_partkey, half from t) select p_partkey, seq from u where seq = {RC.format('seq')}")
def rc_fixed(spark: SparkSession, d: str) -> DataFrame:
    half = _parts(spark, d)
    made = half.select("p_partkey", F.concat("seq", s.rev_comp("seq")).alias("seq")).unionByName(half)
    return made.where(exact.is_rc_fixed("seq"))


@query("rotational_period", f"with t as (select p_partkey, repeat({D.format('p_partkey')}, 3) as seq from part) select p_partkey, {PERIOD} as period from t")
def rotational_period(spark: SparkSession, d: str) -> DataFrame:
    made = _parts(spark, d).select("p_partkey", F.repeat("seq", F.lit(3)).alias("seq"))
    return made.select("p_partkey", exact.rotational_period("seq").alias("period"))


_STATS = f"length(seq)::bigint as length, {ORBIT} as orbit_size, {RATIO} as orbit_ratio, seq = reverse(seq) as is_palindrome, seq = {RC.format('seq')} as is_rc_fixed, {PERIOD} as rotational_period"


@query("symmetry_stats", f"with t as (select c_custkey, {K.format('c_custkey')} as seq from customer) select c_custkey, {_STATS} from t")
def symmetry_stats(spark: SparkSession, d: str) -> DataFrame:
    made = _read(spark, d, "customer").select("c_custkey", _k("c_custkey").alias("seq"))
    return exact.with_symmetry_stats(made).drop("seq")


@query("symmetry_stats_text", f"with t as (select doc_id, {T} as seq from documents) select doc_id, {_STATS} from t")
def symmetry_stats_text(spark: SparkSession, d: str) -> DataFrame:
    made = _read(spark, d, "documents").select("doc_id", _t().alias("seq"))
    return exact.with_symmetry_stats(made).drop("seq")


@query("distinct_orbits", f"""with t as (select {D.format('p_partkey')} as seq from part union all select reverse({D.format('s_suppkey')}) from supplier),
    u as (select distinct seq, unnest(range(0, greatest(length(seq), 1))) as k from t),
    m as (select seq, substr(seq, k::int + 1) || substr(seq, 1, k::int) as member from u
      union all select seq, substr(reverse(seq), k::int + 1) || substr(reverse(seq), 1, k::int) from u),
    f as (select seq, min(member) as orbit_key from m group by seq)
    select orbit_key, count(*) as n_rows, count(distinct seq) as n_sequences from t join f using (seq) group by 1""")
def distinct_orbits(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers, whose sequences may be turned ones of each other."""
    turned = _read(spark, d, "supplier").select(s.reverse(_d("s_suppkey")).alias("seq"))
    return exact.distinct_orbits(_parts(spark, d).select("seq").union(turned))


# Approximate symmetry


def _nearest_sql(source: str, key: str, rc: bool = True) -> str:
    third = f" union all select {key}, seq, 2, {RC.format('seq')} from t" if rc else ""
    return f"""with t as ({source}),
    f as (select {key}, seq, 0 as f, seq as b from t union all select {key}, seq, 1, reverse(seq) from t{third}),
    u as (select {key}, seq, f, b, unnest(range(0, length(seq))) as k from f),
    c as (select {key}, length(seq) as n, hamming(seq, substr(b, k::int + 1) || substr(b, 1, k::int))::bigint as d, f, k from u where f > 0 or k > 0
      union all select {key}, length(seq), length(seq)::bigint, -1, 1 from t),
    m as (select {key}, any_value(n) as n, min({{'d': d, 'f': f, 'k': k}}) as b from c where n > 0 group by {key}
      union all select {key}, 0, {{'d': 0::bigint, 'f': -1, 'k': 0::bigint}} from t where length(seq) = 0) """


_CUSTOMERS = f"select c_custkey, {K.format('c_custkey')} as seq from customer"
_FAMILY = "case greatest(b.f, 0) when 0 then 'SHIFT' when 1 then 'REVERSE_SHIFT' else 'RC_SHIFT' end"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _spread(_read(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", _k("c_custkey").alias("seq"))


@query("dmin", _nearest_sql(_CUSTOMERS, "c_custkey") + "select c_custkey, b.d as dmin from m")
def dmin(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select("c_custkey", approx.dmin("seq").alias("dmin"))


@query("dmin_no_rc", _nearest_sql(_CUSTOMERS, "c_custkey", False) + "select c_custkey, b.d as dmin from m")
def dmin_no_rc(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select("c_custkey", approx.dmin("seq", include_rc=False, strategy="sql").alias("dmin"))


@query("dmin_normalized", _nearest_sql(_CUSTOMERS, "c_custkey") + "select c_custkey, b.d::double / n as dmin_normalized from m")
def dmin_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select("c_custkey", approx.dmin_normalized("seq").alias("dmin_normalized"))


@query("nearest_transform", _nearest_sql(_CUSTOMERS, "c_custkey") + f"select c_custkey, {_FAMILY} as nearest_family, b.k as nearest_k, b.d as dmin, b.d::double / n as dmin_normalized from m")
def nearest_transform(spark: SparkSession, d: str) -> DataFrame:
    return approx.with_nearest(_customers(spark, d)).drop("seq")


@query("nearest_transform_explode", ORACLES["nearest_transform"])
def nearest_transform_explode(spark: SparkSession, d: str) -> DataFrame:
    return approx.with_nearest(_customers(spark, d), strategy="explode", key=["c_custkey"]).drop("seq")


_PARTS_ONLY = f"select p_partkey, {D.format('p_partkey')} as seq from part"


@query("nearest_transform_short", _nearest_sql(_PARTS_ONLY, "p_partkey") + f"select p_partkey, {_FAMILY} as nearest_family, b.k as nearest_k, b.d as dmin from m")
def nearest_transform_short(spark: SparkSession, d: str) -> DataFrame:
    made = approx.with_nearest(_parts(spark, d), strategy="sql")
    return made.select("p_partkey", "nearest_family", "nearest_k", "dmin")


@query("dmin_text")
def dmin_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, so n * n letters a text in SQL; tests hold the FFT against the other plans."""
    made = _read(spark, d, "documents").select("doc_id", _t().alias("seq"))
    return approx.with_nearest(made).drop("seq")


@query("dihedral_transforms", f"""with t as ({_PARTS_ONLY}),
    f as (select p_partkey, seq, 'SHIFT' as family, seq as b from t union all select p_partkey, seq, 'REVERSE_SHIFT', reverse(seq) from t
      union all select p_partkey, seq, 'RC_SHIFT', {RC.format('seq')} from t),
    u as (select *, unnest(range(0, length(seq))) as k from f),
    m as (select p_partkey, family, k, seq, substr(b, k::int + 1) || substr(b, 1, k::int) as transformed from u where family <> 'SHIFT' or k > 0)
    select p_partkey, family, k, transformed, hamming(seq, transformed)::bigint as distance from m""")
def dihedral_transforms(spark: SparkSession, d: str) -> DataFrame:
    return approx.transforms(_parts(spark, d)).drop("seq")


@query("dmin_chromosomes")
def dmin_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    """A sequence of all the letters of a supplier's items, in blocks of 32,768; n * n letters a sequence in SQL, so tests hold it
    against the other plans."""
    k = F.concat_ws("/", "l_orderkey", "l_linenumber")
    letters = F.translate(F.concat(*(F.md5(F.concat(k, F.lit(x))) for x in "abcd")), "0123456789abcdef", "ACGT" * 4)
    # Items of one number in one order are written one after the other; their letters are made behind the shuffle.
    alike = _read(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    made = alike.select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("place"), F.repeat(letters, F.col("n").cast("int")).alias("seq"))
    return chromosome.nearest(made, "l_suppkey", size=1 << 15)


# Windows


def _window_source(length: int) -> str:
    return f"""with s as (select doc_id, {T} as whole from documents),
    w as (select doc_id, whole, unnest(range(0, length(whole) - {length - 1}, {length})) as pos from s where length(whole) >= {length}),
    v as (select doc_id, pos as window_start, substr(whole, pos::int + 1, {length}) as seq from w) """


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _spread(_read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select(F.col("doc_id").cast("string").alias("replicon_id"), _t().alias("seq"))


@query("window_exact", _window_source(24) + f"select doc_id::varchar as replicon_id, 24::bigint as window_length, window_start, {RATIO} as orbit_ratio, seq = reverse(seq) as is_palindrome, seq = {RC.format('seq')} as is_rc_fixed, {ORBIT} as orbit_size from v")
def window_exact(spark: SparkSession, d: str) -> DataFrame:
    cut = windows.windows(_texts(spark, d), 24)
    stats = exact.symmetry_stats("seq")
    return cut.select("replicon_id", "window_length", "window_start", *(stats[n].alias(n) for n in ("orbit_ratio", "is_palindrome", "is_rc_fixed", "orbit_size")))


_WINDOW_DMIN = _nearest_sql(_window_source(24).replace("with s", "with s", 1) + "select doc_id::varchar || '/' || window_start::varchar as id, seq from v", "id")


@query("window_dmin", _WINDOW_DMIN + "select split_part(id, '/', 1) as replicon_id, split_part(id, '/', 2)::bigint as window_start, b.d as dmin, b.d::double / 24 as dmin_normalized from m")
def window_dmin(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_stats(_texts(spark, d), (24,)).select("replicon_id", "window_start", "dmin", "dmin_normalized")


@query("window_summary", _WINDOW_DMIN + "select split_part(id, '/', 1) as replicon_id, 24::bigint as window_length, count(*) as n_windows, min(b.d)::double / 24 as min_dmin_normalized, sum(b.d)::double / (count(*) * 24) as avg_dmin_normalized, max(b.d)::double / 24 as max_dmin_normalized from m group by 1")
def window_summary(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_summary(windows.window_stats(_texts(spark, d), (24,)))


@query("window_table")
def window_table(spark: SparkSession, d: str) -> DataFrame:
    """The default window lengths over whole texts."""
    return windows.window_stats(_texts(spark, d))


_ROLLING = f"""with s as (select doc_id, {T} as whole from documents),
    w as (select doc_id, whole, unnest(range(0, length(whole) - 11)) as pos from s where length(whole) >= 12),
    v as (select doc_id, pos as window_start, substr(whole, pos::int + 1, 12) as seq from w) """


@query("window_rolling", _nearest_sql(_ROLLING + "select doc_id::varchar || '/' || window_start::varchar as id, seq from v", "id") + f""", o as (select id, seq, {ORBIT} as orbit_size, {PERIOD} as rotational_period from t)
    select split_part(id, '/', 1) as replicon_id, count(*) as n_windows, sum(b.d)::bigint as sum_dmin, sum(b.k)::bigint as sum_k, count(*) filter (b.f = 2) as n_rc,
      sum(orbit_size)::bigint as sum_orbit, sum(rotational_period)::bigint as sum_period, count(*) filter (seq = reverse(seq)) as n_palindromes,
      count(*) filter (seq = {RC.format('seq')}) as n_fixed, max(split_part(id, '/', 2)::bigint * (b.d + 1)) as largest from m join o using (id) group by 1""")
def window_rolling(spark: SparkSession, d: str) -> DataFrame:
    """A window of 12 letters at every letter of every text, summed up for each text."""
    made = rolling.rolling_stats(_texts(spark, d), 12)
    return made.groupBy("replicon_id").agg(
        F.count("*").alias("n_windows"), F.sum("dmin").alias("sum_dmin"), F.sum("nearest_k").alias("sum_k"), F.count_if(F.col("nearest_family") == "RC_SHIFT").alias("n_rc"),
        F.sum("orbit_size").alias("sum_orbit"), F.sum("rotational_period").alias("sum_period"), F.count_if("is_palindrome").alias("n_palindromes"),
        F.count_if("is_rc_fixed").alias("n_fixed"), F.max(F.col("window_start") * (F.col("dmin") + 1)).alias("largest"),
    )


# Quaternions: a group for each supplier

_ELEMENTS = """with g as (select distinct s_suppkey + 2 as n from supplier), e as (select n, unnest(range(0, 2 * n)) as k from g),
    r as (select n, k, unnest([false, true]) as is_reflection from e),
    q as (select n, k, is_reflection, case when is_reflection then 0 else cos(pi() * k / n) end as w,
      case when is_reflection then 0 else sin(pi() * k / n) end as x from r),
    p as (select *, (round_even(atan2(x, w) * n / pi(), 0)::bigint % n + n) % n as pk,
      (round_even(atan2(-x, -w) * n / pi(), 0)::bigint % n + n) % n as nk from q) """
#: The relations by angles: a^k is the rotation by pi k / n, b is j, and b^-1 a b turns a's second component round.
_RELATIONS = """abs(cos(2 * n * (pi() / n)) - 1) < 1e-10 and abs(sin(2 * n * (pi() / n))) < 1e-10 as a_power_2n,
    abs(cos(n * (pi() / n)) + 1) < 1e-10 and abs(sin(n * (pi() / n))) < 1e-10 as b_squared,
    abs(sin(-pi() / n) + sin(pi() / n)) < 1e-10 as conjugation"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").select((F.col("s_suppkey") + 2).alias("n")).distinct()


@query("dicyclic_elements", _ELEMENTS + "select n, k, is_reflection, pk as projected_k from p")
def dicyclic_elements(spark: SparkSession, d: str) -> DataFrame:
    made = lift.elements(_groups(spark, d))
    return made.select("n", "k", "is_reflection", lift.project(F.col("q"), F.col("n"))["k"].alias("projected_k"))


@query("dicyclic_reflections", "with g as (select distinct s_suppkey + 2 as n from supplier), e as (select n, unnest(range(0, 2 * n)) as k from g) select n, k, k % n as reflection_index from e")
def dicyclic_reflections(spark: SparkSession, d: str) -> DataFrame:
    made = lift.elements(_groups(spark, d)).where("is_reflection")
    return made.select("n", "k", lift.reflection_index(F.col("q"), F.col("n")).alias("reflection_index"))


@query("double_cover", _ELEMENTS + "select n, count(*) as n_elements, bool_and(pk = nk) as verified from p group by n")
def double_cover(spark: SparkSession, d: str) -> DataFrame:
    return lift.double_cover(_groups(spark, d))


@query("generator_relations", f"select distinct s_suppkey + 2 as n, {_RELATIONS} from (select *, s_suppkey + 2 as n from supplier)")
def generator_relations(spark: SparkSession, d: str) -> DataFrame:
    return lift.relations(_groups(spark, d))


@query("dicyclic_lifts", _ELEMENTS + f", c as (select n, bool_and(pk = nk) as verified from p group by n), rel as (select n, {_RELATIONS} from g) select 2 * n as dihedral_order, verified as verified_double_cover, 'Dic_' || n as lift_group, a_power_2n and b_squared and conjugation as relations_satisfied from c join rel using (n)")
def dicyclic_lifts(spark: SparkSession, d: str) -> DataFrame:
    return lift.dicyclic_lifts(spark, _groups(spark, d))


@query("quaternion_results", _ELEMENTS + "select n, 4 * n as dicyclic_order, 2 * n as dihedral_order, bool_and(pk = nk) as double_cover_verified, 'Dic_' || n || ' → D_' || n as group_notation from p group by n")
def quaternion_results(spark: SparkSession, d: str) -> DataFrame:
    return lift.quaternion_results(spark, _groups(spark, d))


# Sources

_ASSEMBLIES = """with a as (select 'GCF_' || c_custkey as assembly_accession, case c_custkey % 3 when 0 then 'Complete Genome'
      when 1 then 'complete genome' else 'Contig' end as assembly_level, case when c_custkey % 5 = 0 then 'na' else
      'ftp://host/GCF/' || c_custkey || '/GCF_' || c_custkey || '_v1' end as ftp_path, case when c_custkey % 4 = 0 then 'x' || c_custkey
      else c_custkey::varchar end as taxid, case when c_custkey % 7 = 0 then null else c_name end as organism_name from customer) """


def _assemblies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = k.cast("string")
    level = F.when(k % 3 == 0, "Complete Genome").when(k % 3 == 1, "complete genome").otherwise("Contig")
    ftp = F.when(k % 5 == 0, "na").otherwise(F.concat(F.lit("ftp://host/GCF/"), text, F.lit("/GCF_"), text, F.lit("_v1")))
    return _read(spark, d, "customer").select(
        F.concat(F.lit("GCF_"), text).alias("assembly_accession"), level.alias("assembly_level"), ftp.alias("ftp_path"),
        F.when(k % 4 == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("taxid"),
        F.when(k % 7 != 0, F.col("c_name")).alias("organism_name"),
    )


@query("filter_complete", _ASSEMBLIES + "select assembly_accession, ftp_path from a where lower(assembly_level) = 'complete genome' and ftp_path <> 'na'")
def filter_complete(spark: SparkSession, d: str) -> DataFrame:
    return assemblies.complete_genomes(_assemblies(spark, d)).select("assembly_accession", "ftp_path")


@query("safe_cast_project", _ASSEMBLIES + "select assembly_accession, coalesce(try_cast(taxid as bigint), 0) as taxid, coalesce(organism_name, 'Unknown organism') as organism_name from a")
def safe_cast_project(spark: SparkSession, d: str) -> DataFrame:
    made = _assemblies(spark, d).withColumn("taxid", F.col("taxid").try_cast("bigint"))
    return assemblies.with_defaults(made).select("assembly_accession", "taxid", "organism_name")


@query("seeded_sample", _ASSEMBLIES + "select assembly_accession from a order by sha256('42:' || assembly_accession), assembly_accession limit 200")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return assemblies.seeded_sample(_assemblies(spark, d), 200, "assembly_accession").select("assembly_accession")


@query("assembly_urls", _ASSEMBLIES + "select assembly_accession, replace(ftp_path, 'ftp://', 'https://') || '/' || split_part(ftp_path, '/', -1) || '_genomic.fna.gz' as url from a where ftp_path <> 'na'")
def assembly_urls(spark: SparkSession, d: str) -> DataFrame:
    made = _assemblies(spark, d).where("ftp_path <> 'na'")
    return made.select("assembly_accession", assemblies.file_url(F.col("ftp_path")).alias("url"))


_HEADERS = """with h as (select p_partkey, case p_partkey % 4 when 0 then 'NC_' || p_partkey || '.1' when 1 then 'NZ_CP' || p_partkey || '.2'
      when 2 then 'U' || p_partkey else 'contig_' || p_partkey end || ' ' || p_name || case p_partkey % 5 when 0 then ' Plasmid pX'
      when 1 then ', CHROMOSOME' when 2 then ' chromosome, plasmid' else '' end as header, p_size as number from part) """


def _headers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    start = (
        F.when(k % 4 == 0, F.concat(F.lit("NC_"), k, F.lit(".1"))).when(k % 4 == 1, F.concat(F.lit("NZ_CP"), k, F.lit(".2")))
        .when(k % 4 == 2, F.concat(F.lit("U"), k)).otherwise(F.concat(F.lit("contig_"), k))
    )
    end = F.when(k % 5 == 0, " Plasmid pX").when(k % 5 == 1, ", CHROMOSOME").when(k % 5 == 2, " chromosome, plasmid").otherwise("")
    return _read(spark, d, "part").select("p_partkey", F.concat(start, F.lit(" "), "p_name", end).alias("header"), F.col("p_size").alias("number"))


@query("classify_header", _HEADERS + "select p_partkey, case when header ilike '%plasmid%' then 'PLASMID' when header ilike '%chromosome%' or number = 1 then 'CHROMOSOME' else 'OTHER' end as replicon_type from h")
def classify_header(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("p_partkey", fasta.replicon_type(F.col("header"), F.col("number")).alias("replicon_type"))


@query("extract_accession", _HEADERS + r"select p_partkey, nullif(regexp_extract(header, '^([A-Z]{1,2}_?[0-9]+(?:\.[0-9]+)?)', 1), '') as accession from h")
def extract_accession(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("p_partkey", fasta.replicon_accession(F.col("header")).alias("accession"))


_REPLICONS = f"""with rep as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as number,
      {K.format('c_custkey')} as seq from customer),
    r as (select 'GCF_' || c_nationkey as assembly_accession, 'GCF_' || c_nationkey || '_rep' || number as replicon_id,
      case when c_custkey % 3 = 0 then null else 'NC_' || c_custkey || '.1' end as replicon_accession,
      case when c_custkey % 3 = 0 then 'PLASMID' when number = 1 then 'CHROMOSOME' else 'OTHER' end as replicon_type,
      length(seq)::bigint as length_bp,
      (length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))::double / length(seq) as gc_fraction,
      0::bigint as taxonomy_id, 'Unknown organism' as taxonomy_name, 'REFSEQ' as source_db, '' as checksum_sha256, seq from rep) """


def _fasta_files(spark: SparkSession, d: str) -> DataFrame:
    """One FASTA file a nation, as text; sequences are broken into lines of 20 letters, some in lower case."""
    k = F.col("c_custkey").cast("string")
    head = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("p"), k, F.lit(" plasmid"))).otherwise(F.concat(F.lit("NC_"), k, F.lit(".1 x")))
    seq = F.when(F.col("c_custkey") % 2 == 0, F.lower(_k("c_custkey"))).otherwise(_k("c_custkey"))
    entry = F.concat(F.lit(">"), head, F.lit("\n"), seq.substr(1, 20), F.lit("\n"), seq.substr(21, 20), F.lit("\n"))
    made = _read(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", entry.alias("e")))).alias("all"))
    return made.select(F.concat(F.lit("GCF_"), "c_nationkey", F.lit("_genomic.fna.gz")).alias("file_name"), F.array_join(F.transform("all", lambda x: x["e"]), "").alias("value"))


def _replicons(spark: SparkSession, d: str) -> DataFrame:
    return fasta.replicons(_spread(fasta.records(_fasta_files(spark, d)), "number"))


@query("fasta_replicons", _REPLICONS + "select * from r")
def fasta_replicons(spark: SparkSession, d: str) -> DataFrame:
    return _replicons(spark, d).drop("download_date")


@query("replicon_table", _REPLICONS + "select assembly_accession, replicon_id, replicon_type, length_bp, gc_fraction, taxonomy_id, checksum_sha256 from r")
def replicon_table(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.replicon_table(_replicons(spark, d))


# Knowledge

_SHOWN = ("record_type", "metric_name", "shown", "epsilon", "confidence", "holds", "predicate", "replicon_id")


def _shown(rows: DataFrame) -> DataFrame:
    made = knowledge.records(rows, knowledge.base_provenance(sha="0", timestamp="2000-01-01T00:00:00Z"))
    return made.select("record_type", "metric_name", "shown", "epsilon", "confidence", "validity.*", "provenance.replicon_id")


def _record_sql(kind: str, metric: str, value: str, source: str, bounds: str, holds: str, predicate: str, rid: str) -> str:
    return f"select '{kind}' as record_type, '{metric}' as metric_name, {value} as shown, {bounds}, {holds} as holds, {predicate}::varchar as predicate, {rid} as replicon_id from {source}"


_EXACT, _NONE = "0.0::double as epsilon, 1.0::double as confidence", "null::double as epsilon, null::double as confidence"
_KNOWN_REPLICONS = " union all ".join(
    [
        _record_sql("replicon_metric", "length_bp", "length_bp::varchar", "r", _EXACT, "length_bp > 0", "'x > 0'", "replicon_id"),
        _record_sql("replicon_metric", "gc_fraction", "null", "r", _NONE, "gc_fraction between 0 and 1", "'0 <= x <= 1'", "replicon_id"),
        _record_sql("replicon_metric", "taxonomy_id", "taxonomy_id::varchar", "r", _EXACT, "taxonomy_id >= 0", "'x >= 0'", "replicon_id"),
        _record_sql("replicon_metric", "replicon_type", "replicon_type", "r", _EXACT, "true", "null", "replicon_id"),
        _record_sql("replicon_metric", "checksum_sha256", "checksum_sha256", "r", _EXACT, "true", "null", "replicon_id"),
    ]
)
_KNOWN_LIFTS = " union all ".join(
    [
        _record_sql("dicyclic_lift", "dihedral_order", "(2 * n)::varchar", "(select distinct s_suppkey + 2 as n from supplier)", _EXACT, "true", "'x > 0 and even'", "null::varchar"),
        _record_sql("dicyclic_lift", "lift_group", "'Dic_' || n", "(select distinct s_suppkey + 2 as n from supplier)", _EXACT, "true", "null", "null::varchar"),
        _record_sql("dicyclic_lift", "verified_double_cover", "'true'", "(select distinct s_suppkey + 2 as n from supplier)", _EXACT, "true", "'boolean'", "null::varchar"),
        _record_sql("dicyclic_lift", "relations_satisfied", "'true'", "(select distinct s_suppkey + 2 as n from supplier)", _EXACT, "true", "'boolean'", "null::varchar"),
    ]
)


def _no_fraction(df: DataFrame) -> DataFrame:
    """Engines write doubles as text in ways of their own, so the text of the fraction is left out of the comparison."""
    return df.withColumn("shown", F.when(~F.col("metric_name").isin("gc_fraction", "dmin_over_L"), F.col("shown")))


@query("knowledge_replicons", _REPLICONS + _KNOWN_REPLICONS)
def knowledge_replicons(spark: SparkSession, d: str) -> DataFrame:
    return _no_fraction(_shown(knowledge.export_replicons(_replicons(spark, d))))


@query("knowledge_lifts", _KNOWN_LIFTS)
def knowledge_lifts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(knowledge.export_lifts(lift.dicyclic_lifts(spark, _groups(spark, d))))


_APPROX_ROWS = _nearest_sql(_CUSTOMERS, "c_custkey") + ", a as (select 'c' || c_custkey as replicon_id, b.d as dmin, b.d::double / n as dn from m) "
_KNOWN_APPROX = " union all ".join(
    [
        _record_sql("approx_symmetry", "dmin", "dmin::varchar", "a", _EXACT, "true", "null", "replicon_id"),
        _record_sql("approx_symmetry", "dmin_over_L", "null", "a", _EXACT, "dn between 0 and 1", "'0 <= x <= 1'", "replicon_id"),
    ]
)


def _approx_table(spark: SparkSession, d: str) -> DataFrame:
    made = approx.with_nearest(_customers(spark, d))
    return made.select(F.concat(F.lit("c"), "c_custkey").alias("replicon_id"), F.lit(32).cast("long").alias("window_length"), "dmin", "dmin_normalized")


@query("knowledge_approx", _APPROX_ROWS + _KNOWN_APPROX)
def knowledge_approx(spark: SparkSession, d: str) -> DataFrame:
    return _no_fraction(_shown(knowledge.export_approx(_approx_table(spark, d))))


def _experiments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, d, "customer").select(
        k.cast("string").alias("experiment_id"), (k % 9).alias("chain_length"), (k % 100).alias("n_trials"),
        F.when(k % 2 == 0, k).alias("seed"), (k % 4 / 4.0).alias("quaternion_acc"),
    )


@query("knowledge_experiments", """with e as (select c_custkey as k from customer)
    select 'quaternion_result' as record_type, 'chain_length' as metric_name, 0.0::double as epsilon, 1.0::double as confidence, true as holds, k as id from e
    union all select 'quaternion_result', 'n_trials', 0.0, 1.0, true, k from e
    union all select 'quaternion_result', 'seed', 0.0, 1.0, true, k from e where k % 2 = 0
    union all select 'quaternion_result', 'quaternion_acc', 0.01, 0.95, true, k from e""")
def knowledge_experiments(spark: SparkSession, d: str) -> DataFrame:
    made = knowledge.records(knowledge.export_experiments(_experiments(spark, d)), knowledge.base_provenance(sha="0"))
    return made.select("record_type", "metric_name", "epsilon", "confidence", "validity.holds", F.col("provenance.experiment_id").cast("long").alias("id"))


@query("knowledge_windows", _window_source(24) + f"""select 'orbit_ratio' as metric_name, count(*) as n, count(*) filter ({RATIO} >= 0.25) as n_holds from v
    union all select 'orbit_size', count(*), count(*) from v union all select 'is_palindrome', count(*), count(*) from v
    union all select 'is_rc_fixed', count(*), count(*) from v union all select 'dmin', count(*), count(*) from v
    union all select 'dmin_over_L', count(*), count(*) from v""")
def knowledge_windows(spark: SparkSession, d: str) -> DataFrame:
    made = knowledge.records(knowledge.export_windows(windows.window_stats(_texts(spark, d), (24,))), knowledge.base_provenance(sha="0"))
    return made.groupBy("metric_name").agg(F.count("*").alias("n"), F.count_if("validity.holds").alias("n_holds"))


@query("knowledge_union", _APPROX_ROWS + ", " + _REPLICONS.removeprefix("with ") + f"select record_type, metric_name, count(*) as n, count(*) filter (holds) as n_holds from ({_KNOWN_REPLICONS} union all {_KNOWN_LIFTS} union all {_KNOWN_APPROX}) group by all")
def knowledge_union(spark: SparkSession, d: str) -> DataFrame:
    tables = {"atlas_replicons": _replicons(spark, d), "dicyclic_lifts": lift.dicyclic_lifts(spark, _groups(spark, d)), "approx_symmetry_stats": _approx_table(spark, d)}
    made = _shown(knowledge.union(tables))
    return made.groupBy("record_type", "metric_name").agg(F.count("*").alias("n"), F.count_if("holds").alias("n_holds"))


# Verification: records with planted faults, one a customer

_FAULTS = """with f as (select c_custkey as i, c_custkey % 23 = 0 as broken, c_custkey % 29 = 0 and c_custkey % 23 <> 0 as blank,
      case c_custkey % 4 when 1 then 'dicyclic_lift' when 2 then 'approx_symmetry' else 'replicon_metric' end as kind,
      case c_custkey % 5 when 0 then 'gc_fraction' when 1 then 'orbit_ratio' when 2 then 'dmin_over_L' when 3 then 'length_bp' else 'replicon_type' end as metric,
      (c_custkey % 17) / 8.0 - 0.25 as x, c_custkey % 31 = 0 as quoted, c_custkey % 11 as e, c_custkey % 13 as c, c_custkey % 7 as v,
      c_custkey % 19 = 0 as no_prov, c_custkey % 6 as p, c_custkey % 50 as rid from customer),
    ok as (select * from f where not broken and not blank),
    pr as (select * from ok where not no_prov),
    checks as (
      select 'json_parse' as rule, false as passed, i from f where broken
      union all select 'provenance_present', false, i from ok where no_prov
      union all select 'provenance_atlas_git_sha', p <> 0, i from pr
      union all select 'provenance_timestamp_utc', p <> 1, i from pr
      union all select 'provenance_pipeline_seed', p <> 2, i from pr
      union all select 'provenance_pipeline_max', p <> 3, i from pr
      union all select 'provenance_assembly_accession', p <> 4, i from pr where kind = 'replicon_metric'
      union all select 'provenance_replicon_id', p <> 5, i from pr where kind = 'replicon_metric'
      union all select 'epsilon_nonneg', e <> 0, i from ok
      union all select 'confidence_range', c > 1, i from ok
      union all select case when v = 0 then 'validity_present' else 'validity_holds' end, v not in (0, 1, 2), i from ok
      union all select 'gc_fraction_range', x between 0 and 1, i from ok where metric = 'gc_fraction' and not quoted
      union all select 'orbit_ratio_range', x between 0.25 and 1, i from ok where metric = 'orbit_ratio' and not quoted
      union all select 'dmin_range', x between 0 and 1, i from ok where metric = 'dmin_over_L' and not quoted
      union all select 'length_positive', x > 0, i from ok where metric = 'length_bp' and not quoted
      union all select 'no_miracles', true, i from ok
      union all select 'join_replicon', no_prov or kind <> 'replicon_metric' or p = 5 or rid < 40, i from ok) """


def _lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")

    def lit(v: str) -> Column:
        return F.lit(v)

    kind = F.when(k % 4 == 1, "dicyclic_lift").when(k % 4 == 2, "approx_symmetry").otherwise("replicon_metric")
    metric = F.when(k % 5 == 0, "gc_fraction").when(k % 5 == 1, "orbit_ratio").when(k % 5 == 2, "dmin_over_L").when(k % 5 == 3, "length_bp").otherwise("replicon_type")
    x = (k % 17 / 8.0 - 0.25).cast("double").cast("string")
    value = F.when(k % 31 == 0, F.concat(lit('"'), x, lit('"'))).otherwise(x)
    epsilon = F.when(k % 11 == 0, "-0.5").when(k % 11 == 1, "null").otherwise("0.0")
    confidence = F.when(k % 13 == 0, "1.5").when(k % 13 == 1, "-1").otherwise("1.0")
    validity = F.when(k % 7 == 0, "null").when(k % 7 == 1, '{"holds": false, "predicate": "x"}').when(k % 7 == 2, '{"predicate": null}').otherwise('{"holds": true, "predicate": null}')
    fields = {
        "atlas_git_sha": F.when(k % 6 == 0, '""').otherwise('"abc"'),
        "timestamp_utc": F.when(k % 6 == 1, "null").otherwise('"2000-01-01T00:00:00Z"'),
        "pipeline_seed": F.when(k % 6 == 2, "null").otherwise("42"),
        "pipeline_max": F.when(k % 6 == 3, "null").otherwise("200"),
        "assembly_accession": F.when(k % 6 == 4, '""').otherwise('"GCF_1"'),
        "replicon_id": F.when(k % 6 == 5, "null").otherwise(F.concat(lit('"r'), (k % 50).cast("string"), lit('"'))),
    }
    prov = F.concat(lit("{"), F.concat_ws(", ", *(F.concat(lit(f'"{n}": '), v) for n, v in fields.items())), lit("}"))
    prov = F.when(k % 19 == 0, "null").otherwise(prov)
    parts = {"record_type": F.concat(lit('"'), kind, lit('"')), "metric_name": F.concat(lit('"'), metric, lit('"')), "value": value, "epsilon": epsilon, "confidence": confidence, "validity": validity, "provenance": prov}
    line = F.concat(lit("{"), F.concat_ws(", ", *(F.concat(lit(f'"{n}": '), v) for n, v in parts.items())), lit("}"))
    line = F.when(k % 23 == 0, '{"record_type": ').when(k % 29 == 0, "  ").otherwise(line)
    return _spread(_read(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("record_idx"), line.alias("value"))


def _ids(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("replicon_id"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return verify.checks(_lines(spark, d), _ids(spark))


@query("verify_checks", _FAULTS + "select rule, passed, i as record_idx from checks")
def verify_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d).select("rule", "passed", "record_idx")


@query("verify_rule_counts", _FAULTS + "select rule, count(*) as n from checks where not passed group by rule")
def verify_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return verify.rule_counts(_checks(spark, d))


@query("verify_top10_per_rule", _FAULTS + "select rule, record_idx, nth from (select rule, i as record_idx, row_number() over (partition by rule order by i) as nth from checks where not passed) where nth <= 10")
def verify_top10_per_rule(spark: SparkSession, d: str) -> DataFrame:
    return verify.top_failures(_checks(spark, d)).select("rule", "record_idx", "nth")


@query("verify_first20", _FAULTS + "select rule, i as record_idx from checks where not passed order by i, rule limit 20")
def verify_first20(spark: SparkSession, d: str) -> DataFrame:
    return verify.first_failures(_checks(spark, d)).select("rule", "record_idx")


@query("verify_summary", _FAULTS + "select (select count(*) from f where not blank) as total_records, count(*) as total_checks, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, round_even(100.0::double * count(*) filter (passed) / greatest(count(*), 1), 2) as pass_rate from checks")
def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return verify.summary(verify.checks(lines, _ids(spark)), lines)


@query("verify_join_anti", _FAULTS + "select i as record_idx, 'r' || rid as replicon_id from pr where kind = 'replicon_metric' and p <> 5 and rid >= 40")
def verify_join_anti(spark: SparkSession, d: str) -> DataFrame:
    return verify.unknown_replicons(_lines(spark, d), _ids(spark)).select("record_idx", "replicon_id")


@query("verify_kernel", _FAULTS + """select rule, i - 1 as record_idx from (
      select 'ProvenancePresent' as rule, i from f where broken or (not blank and no_prov)
      union all select 'ProvenanceGitSha', i from pr where p = 0
      union all select 'ProvenanceTimestamp', i from pr where p = 1
      union all select 'EpsilonNonNegative', i from pr where e = 0
      union all select 'ConfidenceRange', i from pr where c <= 1
      union all select 'ValidityHolds', i from pr where v = 1
      union all select 'MetricConstraint', i from pr where not quoted and (metric in ('gc_fraction', 'dmin_over_L') and x not between 0 and 1
        or metric = 'orbit_ratio' and x not between 0.25 and 1 or metric = 'length_bp' and x <= 0))""")
def verify_kernel(spark: SparkSession, d: str) -> DataFrame:
    return verify.kernel_failures(_lines(spark, d)).select("rule", "record_idx")


@query("verify_kernel_summary", _FAULTS + """, failures as (
      select i from f where broken or (not blank and no_prov)
      union all select i from pr where p = 0
      union all select i from pr where p = 1
      union all select i from pr where e = 0
      union all select i from pr where c <= 1
      union all select i from pr where v = 1
      union all select i from pr where not quoted and (metric in ('gc_fraction', 'dmin_over_L') and x not between 0 and 1
        or metric = 'orbit_ratio' and x not between 0.25 and 1 or metric = 'length_bp' and x <= 0)),
    n as (select count(*) as total_records, sum(case when broken then 1 when blank then 0 else 7 end)::bigint as total_checks from f)
    select total_records, total_checks, total_checks - (select count(*) from failures) as passed, (select count(*) from failures) as failed from n""")
def verify_kernel_summary(spark: SparkSession, d: str) -> DataFrame:
    return verify.kernel_summary(_lines(spark, d))


@query("verify_file_lines", """select row_number() over (order by c_custkey) as record_idx, case when c_custkey % 7 = 0 then '' else c_name end as value
      from customer""")
def verify_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written to several files, read back with the numbers that they have in all files together."""
    path = files.scratch(spark, "lines")
    line = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("value")
    _read(spark, d, "customer").repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").select(line).write.text(path)
    return verify.read_lines(spark, path)


@query("fasta_files", _REPLICONS + "select replicon_id, replicon_type, length_bp, gc_fraction, seq from r")
def fasta_files(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped FASTA files, a folder for each nation, read back."""
    path = files.scratch(spark, "fasta")
    _fasta_files(spark, d).repartition("file_name").write.partitionBy("file_name").option("lineSep", "\n").option("compression", "gzip").text(path)
    text = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), "file_name=([^/]+)/", 1).alias("file_name")
    return fasta.replicons(fasta.records(text.select(name, "value"))).select("replicon_id", "replicon_type", "length_bp", "gc_fraction", "seq")


_LETTERS = "translate(" + " || ".join(f"md5(l_orderkey::varchar || '/' || l_linenumber::varchar || '{x}')" for x in "abcd") + ", '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query("fasta_ranges", f"""with l as (select l_orderkey, l_linenumber, {_LETTERS} as letters from lineitem),
    r as (select l_orderkey, string_agg(letters, '' order by l_linenumber, letters) as seq from l group by l_orderkey)
    select l_orderkey % 5 as file_no, row_number() over (partition by l_orderkey % 5 order by l_orderkey) as number,
      'NC_' || l_orderkey || '.1 order' as header, length(seq)::bigint as length_bp,
      (length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))::double / length(seq) as gc_fraction, md5(seq) as seq_md5 from r""")
def fasta_ranges_query(spark: SparkSession, d: str) -> DataFrame:
    """Plain FASTA files, a record for each order and a line of 128 letters for each of its items, read by ranges of 256 KB.

    A file is a folder of part files by ranges of orders, so that it is written, as it is read, by many tasks.
    """
    path, k = files.scratch(spark, "fasta"), F.concat_ws("/", "l_orderkey", "l_linenumber")
    letters = F.translate(F.concat(*(F.md5(F.concat(k, F.lit(x))) for x in "abcd")), "0123456789abcdef", "ACGT" * 4)
    items = _read(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("file_no"), "l_orderkey", "l_linenumber")
    items = items.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_no", "l_orderkey")
    items = items.withColumn("nth", F.row_number().over(Window.partitionBy("file_no", "l_orderkey").orderBy("l_linenumber")))
    head = F.when(F.col("nth") == 1, F.concat(F.lit(">NC_"), "l_orderkey", F.lit(".1 order\n"))).otherwise("")
    made = items.sortWithinPartitions("file_no", "l_orderkey", "nth").select("file_no", F.concat(head, letters).alias("value"))
    made.write.partitionBy("file_no").text(path)
    found = fasta_ranges.fragments(spark, path, 1 << 18, ".txt", folders=True)
    stats = fasta_ranges.record_stats(found, seq=fasta_ranges.sequence())
    file_no = F.regexp_extract("file_path", "file_no=([0-9]+)$", 1).cast("long").alias("file_no")
    return stats.select(file_no, "number", "header", "length_bp", "gc_fraction", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query("csv_round_trip", _REPLICONS + "select assembly_accession, replicon_id, replicon_type, length_bp, gc_fraction, taxonomy_id, nullif(checksum_sha256, '') as checksum_sha256 from r")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The replicon table as CSV, read back."""
    path = files.scratch(spark, "csv")
    tables.write_table(replicon_table(spark, d), path, "atlas_replicons")
    made = tables.read_table(spark, path, "atlas_replicons")
    return made.withColumn("checksum_sha256", F.nullif("checksum_sha256", F.lit("")))


@query("manifest_round_trip", _REPLICONS + "select assembly_accession, replicon_id, replicon_accession, replicon_type, length_bp, gc_fraction, taxonomy_id, taxonomy_name, source_db, checksum_sha256 from r")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as JSON lines, written twice and read back once."""
    path, rows = files.scratch(spark, "manifest"), _replicons(spark, d)
    fasta.write_manifest(rows, path)
    fasta.write_manifest(rows, path)
    return fasta.read_manifest(spark, path).drop("download_date")


@query("stream_manifest", ORACLES["manifest_round_trip"])
def stream_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest that a stream keeps: half of the files, then all, then a stream begun anew over them."""
    source, path, checkpoint = (files.scratch(spark, n) for n in ("stream", "manifest", "checkpoint"))
    made = _fasta_files(spark, d).repartition("file_name")
    name = F.regexp_extract(F.col("_metadata.file_path"), "file_name=([^/]+)/", 1)
    first = F.crc32(F.col("file_name").cast("binary")) % 2 == 0
    for half, at in ((first, checkpoint), (~first, checkpoint), (F.lit(False), checkpoint), (F.lit(False), f"{checkpoint}-2")):
        made.where(half).write.mode("append").partitionBy("file_name").option("lineSep", "\n").text(source)
        replicons.stream_manifest(spark, source, path, at, name=name).awaitTermination()
    return fasta.read_manifest(spark, path).drop("download_date")


@query("knowledge_verified", _REPLICONS + """select rule, count(*) as n from (
      select unnest(['provenance_atlas_git_sha', 'provenance_timestamp_utc', 'provenance_pipeline_seed', 'provenance_pipeline_max',
        'provenance_assembly_accession', 'provenance_replicon_id', 'epsilon_nonneg', 'confidence_range', 'validity_holds', 'no_miracles',
        'join_replicon']) as rule from r, range(5)
      union all select unnest(['gc_fraction_range', 'length_positive']) from r) group by rule""")
def knowledge_verified(spark: SparkSession, d: str) -> DataFrame:
    """Records written as lines of JSON and read back, numbered: every check passes."""
    made, path = _replicons(spark, d), files.scratch(spark, "knowledge")
    lines = knowledge.to_lines(knowledge.records(knowledge.export_replicons(made), knowledge.base_provenance(sha="0", timestamp="2000-01-01T00:00:00Z")))
    tables.write_json_lines(lines, "value", path)
    found = verify.checks(verify.read_lines(spark, path), made.select("replicon_id"))
    return found.where("passed").groupBy("rule").agg(F.count("*").alias("n"))


@query("export_report", _REPLICONS + """, s as (select count(*) as n, count(*) filter (replicon_type = 'PLASMID') as p,
      count(*) filter (replicon_type = 'CHROMOSOME') as c, 4 * count(*) + count(*) filter (checksum_sha256 <> '') as records from r),
    runs as (select 'clean' as run, n, 0 as p, 0 as c, records from s union all select 'planted', n, p, c, records from s),
    t as (select *, 11 * records + 2 * n as checks, 2 * (p + c) as failed from runs)
    select run, item, value from (select run,
        unnest(['exit_status', 'exported', 'provenance', 'outcome', 'records', 'checks', 'passed', 'failed',
          'validity_holds', 'gc_fraction_range', 'length_positive', 'lines']) as item,
        unnest([(failed > 0)::int::varchar, records::varchar, 'atlas_replicons, maximum 50, seed 7, records ' || records,
          case when failed > 0 then 'Some checks failed' else 'All checks passed' end,
          records::varchar, checks::varchar, (checks - failed)::varchar, failed::varchar, nullif(p + c, 0)::varchar, nullif(p, 0)::varchar, nullif(c, 0)::varchar,
          (least(10, p + c) + least(10, p) + least(10, c))::varchar]) as value from t) where value is not null""")
def export_report(spark: SparkSession, d: str) -> DataFrame:
    """Tables to records, provenance file, verification, report and exit status, all through files: as they are, and with faults.

    A replicon has a record for each of four metrics, and one for its checksum if it has one: an empty field of a table is null.
    """
    clean, kind = replicon_table(spark, d), F.col("replicon_type")
    planted = clean.withColumns(
        {"gc_fraction": F.when(kind == "PLASMID", 1.5).otherwise(F.col("gc_fraction")), "length_bp": F.when(kind == "CHROMOSOME", 0).otherwise(F.col("length_bp"))}
    )
    found = []
    for run, table in (("clean", clean), ("planted", planted)):
        folder = files.scratch(spark, run)
        tables.write_table(table, f"{folder}/tables", "atlas_replicons")
        total = pipeline.export(spark, folder, 50, 7)
        told = [("exit_status", str(pipeline.verify_file(spark, folder))), ("exported", str(total))]
        found.append(spark.createDataFrame(told, "item string, value string").withColumn("run", F.lit(run)))
        about = spark.read.schema("tables_exported array<string>, pipeline_params struct<max: bigint, seed: bigint>, total_records bigint").json(f"{folder}/epistemic/atlas_provenance.json")
        said = F.format_string("%s, maximum %d, seed %d, records %d", F.array_join("tables_exported", " "), "pipeline_params.max", "pipeline_params.seed", "total_records")
        found.append(about.select(F.lit("provenance").alias("item"), said.alias("value"), F.lit(run).alias("run")))
        report = spark.read.text(f"{folder}/epistemic/atlas_knowledge_report.md")
        named = F.regexp_extract("value", "^(?:###|[*]) ([a-z_]+): ([0-9]+)$", 1)
        item = F.when(F.col("value").rlike("^## .* checks "), "outcome").when(named != "", named)
        value = F.regexp_extract("value", "^(?:##|(?:###|[*]) [a-z_]+:) (.*)$", 1)
        found.append(report.select(item.alias("item"), value.alias("value"), F.lit(run).alias("run")).where("item is not null"))
        shown = report.agg(F.count_if(F.col("value").startswith("* line ")).cast("string").alias("value"))
        found.append(shown.select(F.lit("lines").alias("item"), "value", F.lit(run).alias("run")))
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    return made


# Validation


@query("algebra_checks", "select c_custkey, unnest(['shift_cyclic', 'reverse_involution', 'complement_involution', 'rc_commutative', 'dihedral_relation']) as check_name, true as passed from customer")
def algebra_checks(spark: SparkSession, d: str) -> DataFrame:
    return validate.operator_checks(_customers(spark, d), "c_custkey").select("c_custkey", "check_name", "passed")


@query("algebra_failures", _PARTS + """select p_partkey, o.operators, c.check_name, case
        when operators = 'late shift' and check_name = 'shift_cyclic' then substr(seq, 2) || substr(seq, 1, 1) = seq
        when operators = 'late shift' and check_name = 'dihedral_relation'
          then substr(seq, 2 % length(seq) + 1) || substr(seq, 1, 2 % length(seq)) = seq
        when operators = 'half complement' and check_name = 'complement_involution' then translate(seq, 'AC', '') = seq
        when operators = 'half complement' and check_name = 'rc_commutative' then translate(seq, 'GT', '') = seq
        else true end as passed
      from t, (select unnest(['late shift', 'half complement']) as operators) o,
        (select unnest(['shift_cyclic', 'reverse_involution', 'complement_involution', 'rc_commutative', 'dihedral_relation']) as check_name) c""")
def algebra_failures(spark: SparkSession, d: str) -> DataFrame:
    """Wrong operators, which the checks must find: a shift that goes one too far, a complement of two letters only."""
    wrong = {
        "late shift": validate.Operators(shift=lambda seq, k: s.shift(seq, k + 1)),
        "half complement": validate.Operators(complement=lambda seq: F.translate(seq, "AC", "TG")),
    }
    late, half = (validate.operator_checks(_parts(spark, d), "p_partkey", of=o).withColumn("operators", F.lit(k)) for k, o in wrong.items())
    told = (F.col("message") == "") == F.col("passed")  # a message for each failure, and for nothing else
    return late.unionByName(half).where(told).select("p_partkey", "operators", "check_name", "passed")


@query("symmetry_checks", _PARTS + "select unnest(['orbit_divides_2n', 'orbit_ratio_bounds', 'dmin_bounds', 'dmin_periodic_zero']) as check_name, count(*) as n, count(*) as n_passed from t group by 1")
def symmetry_checks(spark: SparkSession, d: str) -> DataFrame:
    found = validate.symmetry_checks(_parts(spark, d))
    return found.groupBy("check_name").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query("strategy_crosscheck", "with c as (select count(*) as n from part) select f as function_name, n as n_tests, n as n_passed, 0::bigint as n_failed from c, (select unnest(['orbit_size', 'orbit_ratio', 'is_palindrome', 'is_rc_fixed', 'dmin']) as f) union all select 'verify_double_cover', 15, 15, 0 union all select null, 5 * n + 15, 5 * n + 15, 0 from c")
def strategy_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    found = validate.cross_validation(_parts(spark, d).select("seq"), spark)
    return found.select("function_name", "n_tests", "n_passed", "n_failed")


@query("technical_validation", "with c as (select count(*) as n from supplier) select unnest(['shift_cyclic', 'reverse_involution', 'complement_involution', 'rc_commutative', 'dihedral_relation', 'orbit_divides_2n', 'orbit_ratio_bounds', 'dmin_bounds', 'dmin_periodic_zero']) as check_name, n, true as passed from c")
def technical_validation(spark: SparkSession, d: str) -> DataFrame:
    cases = _read(spark, d, "supplier").select(_d("s_suppkey").alias("seq"))
    return validate.technical_validation(spark, cases).groupBy("check_name").agg(F.count("*").alias("n"), F.bool_and("passed").alias("passed"))


@query("crosscheck_failures", _PARTS + f""", f as (select 'period_is_orbit' as function_name, seq from t where {PERIOD} <> {ORBIT} union all select 'palindrome_is_rc', seq from t where (seq = reverse(seq)) <> (seq = {RC.format('seq')})),
    r as (select *, dense_rank() over (partition by function_name order by seq) as nth from f),
    c as (select function_name, count(*) as n_failed, string_agg(distinct seq, ',' order by seq) filter (nth <= 20) as failed_cases from r group by 1),
    u as (select string_agg(seq, ',' order by seq) as failed_cases from (select distinct seq from f order by seq limit 20)),
    n as (select count(*) as n from part)
    select g.name as function_name, n as n_tests, n - coalesce(n_failed, 0) as n_passed, coalesce(n_failed, 0) as n_failed, coalesce(failed_cases, '') as failed_cases
      from (select unnest(['period_is_orbit', 'palindrome_is_rc', 'orbit_size']) as name) g left join c on function_name = name, n
    union all select null, 3 * n, 3 * n - (select count(*) from f), (select count(*) from f), coalesce(u.failed_cases, '') from u, n""")
def crosscheck_failures(spark: SparkSession, d: str) -> DataFrame:
    """Two pairs of plans that don't agree, and one that does: the counts, and the first failing inputs."""
    plans = {
        "period_is_orbit": (exact.rotational_period, exact.orbit_size), "palindrome_is_rc": (exact.is_palindrome, exact.is_rc_fixed),
        "orbit_size": validate.PLANS["orbit_size"],
    }
    found = validate.cross_validation(_parts(spark, d).select("seq"), plans=plans)
    return found.select("function_name", "n_tests", "n_passed", "n_failed", F.array_join("failed_cases", ",").alias("failed_cases"))


# SQL text over the registered functions


def _sql(spark: SparkSession, d: str, text: str, **views: DataFrame) -> DataFrame:
    sql.register(spark)
    return spark.sql(text, **views)


@query("sql_scalar", f"with t as (select c_custkey, {K.format('c_custkey')} as seq from customer) select c_custkey, {ORBIT} as orbit_size, {RATIO} as orbit_ratio, {PERIOD} as rotational_period, seq = reverse(seq) as is_palindrome, seq = {RC.format('seq')} as is_rc_fixed, substr(seq, 6) || substr(seq, 1, 5) as shifted, {RC.format('seq')} as rev_comp, hamming(seq, {RC.format('seq')})::bigint as distance from t")
def sql_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _sql(
        spark, d,
        """select c_custkey, orbit_size(seq) as orbit_size, orbit_ratio(seq) as orbit_ratio, rotational_period(seq) as rotational_period,
          is_palindrome(seq) as is_palindrome, is_rc_fixed(seq) as is_rc_fixed, shift(seq, 37) as shifted, rev_comp(seq) as rev_comp,
          hamming_distance(seq, rev_comp(seq)) as distance from {t}""",
        t=_customers(spark, d),
    )


@query("sql_dmin", _nearest_sql(_CUSTOMERS, "c_custkey") + f"select c_custkey, b.d as dmin, b.d::double / n as dmin_normalized, {_FAMILY} as family, b.k as k from m")
def sql_dmin(spark: SparkSession, d: str) -> DataFrame:
    return _sql(
        spark, d, "select c_custkey, dmin(seq) as dmin, dmin_normalized(seq) as dmin_normalized, n.family, n.k from (select *, nearest_transform(seq) as n from {t})", t=_customers(spark, d)
    )


@query("sql_windows", f"""with s as (select doc_id, {T} as whole from documents),
    w as (select doc_id, whole, unnest(range(0, length(whole) - 23, 6)) as pos from s where length(whole) >= 24),
    v as (select doc_id, pos as window_start, substr(whole, pos::int + 1, 24) as seq from w)
    select doc_id, count(*) as n_windows, max(window_start) as last_start, sum({ORBIT})::bigint as orbits, count(*) filter (seq = {RC.format('seq')}) as n_fixed from v group by doc_id""")
def sql_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows by a table function, and metrics of them by scalar ones."""
    return _sql(
        spark, d,
        """select doc_id, count(*) as n_windows, max(w.window_start) as last_start, sum(orbit_size(w.window_seq)) as orbits,
          count_if(is_rc_fixed(w.window_seq)) as n_fixed from {t} t, lateral windows(t.seq, 24, 6) w group by doc_id""",
        t=_read(spark, d, "documents").select("doc_id", _t().alias("seq")),
    )


@query("sql_orbit", ORACLES["orbit_members"])
def sql_orbit(spark: SparkSession, d: str) -> DataFrame:
    made = _read(spark, d, "supplier").select("s_suppkey", _d("s_suppkey").alias("seq"))
    return _sql(spark, d, "select s_suppkey, o.member from {t} t, lateral orbit(t.seq) o", t=made)


@query("sql_transforms", ORACLES["dihedral_transforms"])
def sql_transforms(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, "select p_partkey, x.family, x.k, x.transformed, x.distance from {t} t, lateral dihedral_transforms(t.seq) x", t=_parts(spark, d))


# Rules as a table, derivations


@query("knowledge_rules", """with e as (select c_custkey as k from customer), s as (select r_regionkey as r from region),
    bound as (select max(r_regionkey) as b from region)
    select metric_name, predicate, holds, count(*) as n from (
      select 'chain_length' as metric_name, 'odd' as predicate, (k % 9) % 2 = 1 as holds from e
      union all select 'n_trials', 'under 50 and up to ' || (b + 40), k % 100 < 50 and k % 100 <= b + 40 from e, bound
      union all select 'seed', null, true from e where k % 2 = 0
      union all select 'quaternion_acc', '0 <= x <= 1', (k % 4) / 4.0 between 0 and 1 from e)
    group by all""")
def knowledge_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that no code knows, one of them with a bound out of a table, beside the fixed ones."""
    bound = _read(spark, d, "region").agg((F.max("r_regionkey") + 40).cast("string").alias("b"))
    more = spark.createDataFrame(
        [("chain_length", "odd", "x % 2 = 1"), ("n_trials", "under 50", "x < 50"), ("quaternion_acc", "0 <= x <= 1", "x between 0 and 1"), ("quaternion_acc", "later", "date(null) > current_date()")],
        knowledge.RULE,
    )
    more = more.union(bound.select(F.lit("n_trials"), F.concat(F.lit("up to "), "b"), F.concat(F.lit("x <= "), "b")))
    made = knowledge.records(knowledge.export_experiments(_experiments(spark, d)), knowledge.base_provenance(sha="0"), knowledge.rules(spark).union(more))
    return made.groupBy("metric_name", "validity.predicate", "validity.holds").agg(F.count("*").alias("n")).where("metric_name in ('chain_length', 'n_trials', 'seed', 'quaternion_acc')")


#: A record for each order; most derive from a neighbour, by chains of up to a dozen, some of which end in a cycle or nowhere.
_DERIVED = """with recursive o as (select o_orderkey as k, (o_orderkey * 7 % 11) / 16.0 as eps, o_orderkey % 5 = 0 as has_rule from orders),
    e as (select k, k - 1 as s from o where k % 4 <> 0 union select k, k - 2 from o where k % 4 = 2 union select k, k - 1 from o where k % 4 = 0 and k % 12 <> 0
      union select k, k + 3 from o where k % 400 = 0 union select k, -1 from o where k % 97 = 0),
    walk(k, s) as (select k, s from e union select w.k, e.s from walk w join e on e.k = w.s join o on o.k = w.s and not o.has_rule),
    reach(k, s) as (select k, s from e union select r.k, e.s from reach r join e on e.k = r.s),
    bound as (select w.k, max(o.eps) as b from walk w join o on o.k = w.s group by w.k),
    loops as (select distinct r.k from reach r join reach c on c.k = r.s and c.s = r.s),
    absent as (select distinct k from e where s not in (select k from o)) """


@query("derivation_closure", _DERIVED + """select 'derivation_sources' as rule, k as record_idx, k not in (select k from absent) as passed from (select distinct k from e)
    union all select 'derivation_ends', k, k not in (select k from loops) from (select distinct k from e)
    union all select 'no_miracles_chain', k, has_rule or coalesce(eps >= b, true) from (select distinct k from e) join o using (k) left join bound using (k)""")
def derivation_closure(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.lit(None).cast("bigint")
    sources = F.array(
        F.when((k % 4 != 0) | (k % 12 != 0), k - 1), F.when(k % 4 == 2, k - 2), F.when(k % 400 == 0, k + 3), F.when(k % 97 == 0, F.lit(-1)), none
    )
    names = F.transform(F.filter(sources, lambda s: s.isNotNull()), lambda s: F.concat(F.lit('"o'), s, F.lit('"')))
    rule = F.when(k % 5 == 0, ', "rule": "measured anew"').otherwise("")
    line = F.concat(
        F.lit('{"record_id": "o'), k, F.lit('", "epsilon": '), (k * 7 % 11 / 16.0).cast("double").cast("string"),
        F.lit(', "derivation": {"sources": ['), F.array_join(names, ", "), F.lit("]"), rule, F.lit("}}"),
    )
    lines = _spread(_read(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("record_idx"), line.alias("value"))
    return derivation.derivation_checks(lines).select("rule", "record_idx", "passed")
