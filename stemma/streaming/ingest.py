"""Streaming ingest: raw files as they arrive, parsed in micro-batches, written so that a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.parse.pipeline import parse_submissions, table_of


def read_stream(spark: SparkSession, folder: str, glob: str = "*.txt", files_per_batch: int = 1000) -> DataFrame:
    """Submissions of new files: accession_number, cik (none yet), year, text."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    acc = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.where("length > 0").select(acc.alias("accession_number"), F.lit(None).cast("string").alias("cik"), F.regexp_extract(acc, r"^\d{10}-(\d{2})-", 1).try_cast("int").alias("yy"), F.decode("content", "ISO-8859-1").alias("text")).select(
        "accession_number", "cik", F.when(F.col("yy") > 50, F.col("yy") + 1900).otherwise(F.col("yy") + 2000).alias("year"), "text"
    )


def start(submissions: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Parse every batch and write its nodes under the batch's number: a batch that is run again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        nodes = table_of(parse_submissions(df), "nodes").withColumn("batch", F.lit(number))
        nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    w = submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
