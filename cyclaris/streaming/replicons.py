"""New sequence files as a stream of replicons, and the manifest that a stream keeps.

A batch of the stream writes its rows to a folder of its own, named by the stream's id and the batch's number, in place of
what is there. A batch that runs again after a loss therefore writes the same rows once, and a stream that begins anew (another
checkpoint) never writes over an older one's; `fasta.read_manifest` gives each replicon once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gc_content
from ..operators.exact import symmetry_stats
from ..sources.fasta import COLUMNS, records, replicon_accession, replicon_type, replicons


def _files(spark: SparkSession, folder: str, name: Column | None) -> DataFrame:
    text = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return text.select((F.col("_metadata.file_name") if name is None else name).alias("file_name"), "value")


def write_manifest_batch(batch: DataFrame, number: int, path: str, stream: str) -> None:
    """Writes a batch's rows in place of what the same batch has written before."""
    batch.select(*COLUMNS).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/stream={stream}/batch={number}")


def stream_manifest(spark: SparkSession, folder: str, path: str, checkpoint: str, watermark: str = "7 days", name: Column | None = None):
    """A stream that keeps the manifest at path up to date with the files in folder: it takes all that are new, and ends.

    name: a file's name, from which its assembly comes, where that isn't simply the file's. Each replicon_id is kept once within the
    watermark; state and progress are in the checkpoint.
    """
    rows = replicons(records(_files(spark, folder, name)))
    timed = rows.withColumn("seen", F.current_timestamp()).withWatermark("seen", watermark).dropDuplicatesWithinWatermark(["replicon_id"])

    def save(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_manifest_batch(batch, number, path, stream)

    return timed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, folder: str, watermark: str = "7 days") -> DataFrame:
    """Replicons of files as they appear in folder, each replicon_id once within the watermark."""
    text = spark.readStream.format("text").option("wholetext", True).load(folder)
    files = text.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("at"), "value")
    rows = records(files).withColumn("replicon_id", F.concat("assembly_accession", F.lit("_rep"), F.col("number").cast("string")))
    timed = rows.withColumn("seen", F.current_timestamp()).withWatermark("seen", watermark)
    return timed.dropDuplicatesWithinWatermark(["replicon_id"]).select(
        "assembly_accession", "replicon_id",
        replicon_accession(F.col("header")).alias("replicon_accession"),
        replicon_type(F.col("header"), F.col("number")).alias("replicon_type"),
        gc_content("seq").alias("gc_fraction"), *(v.alias(k) for k, v in symmetry_stats("seq").items()),
    )
