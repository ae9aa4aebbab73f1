"""A library of runs: corpora, saved document sets, review decisions, gold labels, original texts.

Small records (sets, decisions, gold files) are kept as JSON lines that are only
ever added to; the last line of a name or place counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.sources.control import latest_of

DOC = ["accession_number", "sequence"]
SETS = "name string, title string, version bigint, members array<struct<accession_number: string, sequence: int>>"
DECISIONS = "accession_number string, sequence int, raw_start bigint, decision string, note string, decided_at timestamp"


def corpora(spark: SparkSession, root: str) -> DataFrame:
    """Runs under a folder: name and which of the tables nodes, documents and rejected each holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for x in fs.listStatus(path) if fs.exists(path) else []:
        tables = [t for t in ("nodes", "documents", "rejected") if x.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), t))]
        if "documents" in tables:
            rows.append((x.getPath().getName(), tables))
    return spark.createDataFrame(sorted(rows), "name string, tables array<string>")


def save_set(documents: DataFrame, folder: str, name: str, title: str, version: int) -> None:
    """Add a version of a set: the distinct documents (accession_number, sequence) that it holds."""
    member = F.struct("accession_number", F.col("sequence").cast("int").alias("sequence"))
    row = documents.select(member.alias("m")).distinct().agg(F.array_sort(F.collect_list("m")).alias("members"))
    row.select(F.lit(name).alias("name"), F.lit(title).alias("title"), F.lit(version).cast("long").alias("version"), "members").write.mode("append").json(folder)


def list_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Name, title, last version and size of every set."""
    return latest_of(spark.read.schema(SETS).json(folder), ["name"], ["version"]).select("name", "title", "version", F.size("members").alias("n_documents"))


def get_set(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Documents of the last version of a set."""
    last = latest_of(spark.read.schema(SETS).json(folder).where(F.col("name") == name), ["name"], ["version"])
    return last.select(F.explode("members").alias("m")).select("m.*")


def decide(decisions: DataFrame, folder: str) -> None:
    """Add review decisions (accession_number, sequence, raw_start, decision, note, decided_at)."""
    decisions.write.mode("append").json(folder)


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The last decision of every place."""
    return latest_of(spark.read.schema(DECISIONS).json(folder), [*DOC, "raw_start"], ["decided_at", "decision"])


def document_text(submissions: DataFrame, documents: DataFrame) -> DataFrame:
    """Original text of documents (accession_number, sequence, doc_raw_start, doc_raw_end), cut from the submission."""
    t = submissions.select("accession_number", "text").dropDuplicates(["accession_number"])
    span = F.substr("text", (F.col("doc_raw_start") + 1).cast("int"), (F.col("doc_raw_end") - F.col("doc_raw_start")).cast("int"))
    return documents.select(*DOC, "doc_raw_start", "doc_raw_end").join(t, "accession_number").select(*DOC, span.alias("original"))


def worst_documents(metrics: DataFrame, n: int) -> DataFrame:
    """The n documents that lack most: incomplete, disordered, or with items far too small or large."""
    bad = metrics.where(~F.col("complete") | ~F.col("in_order") | (F.col("n_tiny") > 0) | (F.col("n_huge") > 0))
    lacking = F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", ",")))
    return bad.withColumn("n_missing", lacking).orderBy(F.col("n_missing").desc(), *DOC).limit(n)


# ---------------------------------------------------------------- gold labels


def _gold(text: str) -> dict | None:
    """One gold file: the few lines that a label skeleton consists of."""
    out: dict = {"nodes": []}
    for line in text.splitlines():
        body = line.strip()
        if body.startswith("- {") and body.endswith("}"):
            fields, rest = {}, body[3:-1]
            for name in ("label", "raw_start", "title"):
                at = rest.find(f"{name}:")
                if at < 0:
                    continue
                value = rest[at + len(name) + 1 :].lstrip()
                if value.startswith('"'):
                    fields[name] = json.JSONDecoder().raw_decode(value)[0]
                elif value.startswith("["):
                    fields[name] = "".join(json.JSONDecoder().raw_decode(value)[0])
                else:
                    fields[name] = value.split(",", 1)[0].strip()
            if str(fields.get("raw_start", "")).isdigit() and fields.get("label") not in (None, "null"):
                out["nodes"].append({"label": fields["label"].upper(), "raw_start": int(fields["raw_start"]), "title": fields.get("title")})
        elif ":" in body and not line.startswith((" ", "-", "nodes:", "absent:")):
            name, value = body.split(":", 1)
            out[name] = value.strip().strip('"')
    return out if out.get("accession") else None


def load_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of reviewed files: accession_number, sequence, reviewed, label_canon, raw_start, title; one row per label."""
    schema = "accession_number string, sequence int, reviewed boolean, label_canon string, raw_start bigint, title string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                g = _gold(text)
                for n in g["nodes"] if g else []:
                    rows.append((g["accession"], int(g.get("sequence") or 1), g.get("reviewed") == "true", n["label"], n["raw_start"], n["title"]))
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string())
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["accession_number", "sequence", "reviewed", "label_canon", "raw_start", "title"])

    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    return files.mapInArrow(run, schema)


def set_sizes(df: DataFrame, by: Column) -> DataFrame:
    """Documents per value of an expression."""
    return df.select(*DOC, by.alias("value")).distinct().groupBy("value").agg(F.count("*").alias("n_documents"))
