"""Rows that every operator must get through: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROSE = (
    "The committee was asked to look at the plan of the new bridge and it was found that the cost of the work is more than "
    "what had been set aside for it by the town so they will have to find the rest from other sources before any of the "
    "builders can be paid for what they do on the river banks this coming year"
)
EXTRA = "start int, end int, rank int, size int, shard int, slot int, fp long, kept boolean, spans string, n_words string, part int, block int, "
HIDDEN = "_a _b _m _n _id _row _file _old _no _t _p _x _all row id text2 a b fp by clean gone".split()
EXTRA += ", ".join(f"{n} string" for n in HIDDEN if n not in ("fp",))
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def texts() -> list[tuple[int | None, str | None]]:
    long_text = " ".join(f"w{i % 977} {i}" for i in range(30_000))
    return [
        (1, PROSE), (2, PROSE), (3, PROSE.replace("bridge", "ferry")), (3, PROSE.replace("bridge", "ferry")), (4, None), (5, ""),
        (6, " \n\t "), (7, "one"), (8, "one two three"), (None, PROSE + " and more"), (None, None), (9, long_text),
        (10, "é ß 漢字 😀 Σας İ \x1c\x85  x y"), (11, "a b c " * 200), (12, 'token = "0123456789abcdef0123456789" user=bob\n' + PROSE),
        (13, "<|endoftext|> <|startoftext|> #*$%&|<>"), (14, "same line here\n" * 40), (15, PROSE.upper()), (5, ""), (-7, "x" * 5000),
    ]


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None, "s", None, *[None] * 12, *(n for n in HIDDEN if n != "fp")) for i, t in rows], SCHEMA)


def saved(df: DataFrame, folder, name: str) -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def union_find(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]
