"""Runs: the three output tables as partitioned parquet, written partition by partition and resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.parse.pipeline import PARSER_VERSION, parse_submissions, table_of
from stemma.session import materialize

TABLES = {"nodes": ["accession_number", "sequence", "node_id"], "documents": ["accession_number", "sequence"], "rejected": ["accession_number", "sequence", "raw_start"]}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def finished_parts(spark: SparkSession, run: str, part: str = "year") -> DataFrame:
    """Values of the partition column that a run already holds documents for."""
    if not exists(spark, f"{run}/documents"):
        return spark.createDataFrame([], f"{part} int")
    return spark.read.parquet(f"{run}/documents").select(F.col(part).cast("int").alias(part)).distinct()


#: Rows of one output file at most; a large partition is written by as many tasks as it has such portions.
ROWS_PER_FILE = 1_000_000


def write_run(submissions: DataFrame, run: str, part: str = "year", overwrite: bool = False, keep_text: bool = False) -> None:
    """Parse submissions and add their tables to a run; partitions that are there are skipped unless overwritten.

    The parse is done once and kept in the shared folder.  Each table is then written with its rows sorted by key;
    a partition that is written replaces what a broken try may have left of it.  The documents table, which tells what
    is finished, is written last.
    """
    spark = submissions.sparkSession
    todo = submissions if overwrite else submissions.join(finished_parts(spark, run, part), part, "left_anti")
    parsed = materialize(parse_submissions(todo, keep_text).withColumn(part, F.try_element_at("documents.filed_year", F.lit(1))), "parsed")
    for name in ("nodes", "rejected", "documents"):
        rows = parsed.df.select(part, F.explode(name).alias("r")).select(part, "r.*")
        (
            rows.repartition(part, "accession_number")
            .sortWithinPartitions(part, *TABLES[name])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", ROWS_PER_FILE)
            .option("compression", "zstd")
            .partitionBy(part)
            .parquet(f"{run}/{name}")
        )
    parsed.drop()


def read_run(spark: SparkSession, run: str, name: str, part: str | None = None, value=None) -> DataFrame:
    """A table of a run, of one partition if given (only its files are read)."""
    df = spark.read.parquet(f"{run}/{name}")
    return df.where(F.col(part) == value) if part else df


def document_rows(spark: SparkSession, run: str, accession: str, sequence: int) -> dict[str, DataFrame]:
    """The three row sets of one document."""
    return {n: read_run(spark, run, n).where((F.col("accession_number") == accession) & (F.col("sequence") == sequence)) for n in TABLES}


def cached_parse(submissions: DataFrame, cache: str) -> DataFrame:
    """Nodes of submissions; those whose accession number, text and parser version are in the cache aren't parsed again.

    ``CACHE/status`` tells of every submission of the last call whether it was found ('hit') or parsed ('miss').
    """
    spark, key = submissions.sparkSession, ["accession_number", "input_sha256"]
    keyed = submissions.withColumn("input_sha256", F.sha2(F.encode("text", "ISO-8859-1"), 256))
    rows = f"{cache}/nodes"
    if exists(spark, rows):
        hit = spark.read.parquet(rows).where(F.col("parser_version") == PARSER_VERSION)
        known = hit.select(*key).distinct()
        fresh = keyed.join(known, key, "left_anti")
        old = hit.join(keyed.select(*key).distinct(), key, "left_semi").drop("input_sha256")
        state = keyed.select(*key).distinct().join(known.withColumn("norm_cache", F.lit("hit")), key, "left")
    else:
        fresh, old, state = keyed, None, keyed.select(*key).distinct().withColumn("norm_cache", F.lit(None).cast("string"))
    state = materialize(state.withColumn("norm_cache", F.coalesce("norm_cache", F.lit("miss"))), "status").df
    new = materialize(parse_submissions(fresh).select(F.col("documents")[0]["input_sha256"].alias("input_sha256"), F.explode("nodes").alias("r")).select("input_sha256", "r.*"), "fresh").df
    out = new.drop("input_sha256") if old is None else old.unionByName(new.drop("input_sha256"))
    kept = materialize(out, "cached").df
    new.write.mode("append").parquet(rows)
    state.write.mode("overwrite").parquet(f"{cache}/status")
    return kept


__all__ = ["cached_parse", "document_rows", "finished_parts", "read_run", "table_of", "write_run"]
