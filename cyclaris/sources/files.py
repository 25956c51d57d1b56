"""Files in whatever store Spark reads: all through Hadoop's file systems, none through the driver's own disk."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def put_folder(spark: SparkSession, path: str) -> None:
    """Makes a folder unless it is there."""
    fs, at = _at(spark, path)
    fs.mkdirs(at)


def put(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> str:
    """Writes one file under a name of its own and gives it its name once it is whole."""
    (fs, part), (_, at) = _at(spark, f"{path}.{uuid.uuid4().hex}.part"), _at(spark, path)
    out = fs.create(part, True)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    except BaseException:
        out.close()
        fs.delete(part, False)
        raise
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; in local runs one is made if need be."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cyclaris-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
