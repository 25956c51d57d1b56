"""What the operators of this subpackage share: the shared folder, tables written to it, row access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for the writes of tables: shuffle files go once a write is done (else they stay until the driver collects its
#: garbage), and batches for Python are bounded in bytes.
_WRITES = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary one, in local
    runs only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cyclaris-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def cleaned(spark: SparkSession) -> None:
    """Deletes all that this session wrote to the shared folder; results that still read it must have been saved."""
    while _made:
        removed(spark, _made.pop())


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors don't take it along.

    by: a column of whose values each gets a folder of its own.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), {k: spark.conf.get(k, None) for k in _WRITES}
    for k, v in _WRITES.items():
        spark.conf.set(k, v)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more rows than this is looked up in a broadcast table; so many of them at most, those with most rows.
HOT_ROWS, HOT_KEYS = 4096, 10_000


def looked_up(rows: DataFrame, about: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined (inner) with what is known about their key; about has each key once, and in n how many rows have it.

    Frequent keys, at most HOT_KEYS of them, are broadcast, so that no shuffle puts the rows of one into one task; the rows
    of the others are joined by a shuffle. Both tables are read several times: they should be written ones.
    """
    hot = F.broadcast(about.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n), key).limit(HOT_KEYS))
    by_broadcast = rows.join(hot, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(about, key)
    return by_broadcast.unionByName(rest)


def dropped(df: DataFrame, folder: str = "") -> None:
    """Deletes a table that written() gave, or one folder of it, that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.endswith(folder):
            removed(df.sparkSession, path)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text as one file of the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
