"""Command line: python -m stemma.cli COMMAND ... (a thin layer over the library)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from stemma.operators import analytics, library, review
from stemma.session import build_session
from stemma.sources import control, manifest, runs, sgml


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stemma")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *opts: [s.add_argument(*o[0], **o[1]) for s in [sub.add_parser(name)] for o in opts]
    arg = lambda *n, **k: (n, k)
    add("parse", arg("raw"), arg("run"), arg("--overwrite", action="store_true"), arg("--keep-text", action="store_true"), arg("--kind", choices=["10k", "10q", "ex10", "ex13", "text"]), arg("--limit", type=int))
    add("manifest", arg("index"), arg("out"), arg("--forms", default="10-K-family"), arg("--years"), arg("--amendments", action="store_true"))
    add("show", arg("run"), arg("accession"), arg("sequence", type=int))
    add("report", arg("run"), arg("--worst", type=int, default=0))
    add("sections", arg("run"), arg("raw"), arg("out"), arg("labels", nargs="+"))
    add("diff", arg("run_a"), arg("run_b"))
    add("hashes", arg("run"), arg("out"))
    add("verify", arg("run"), arg("expected"))
    add("gold-init", arg("run"), arg("out"))
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = build_session("stemma")
    read = lambda run, name: runs.read_run(spark, run, name)
    if a.command == "parse":
        s = sgml.read_submissions(spark, a.raw)
        yy = F.regexp_extract("accession_number", r"^\d{10}-(\d{2})-", 1).try_cast("int")
        s = s.select("accession_number", F.lit(None).cast("string").alias("cik"), F.when(yy > 50, yy + 1900).otherwise(yy + 2000).alias("year"), "text")
        if a.kind:
            bare = control.fixture_rows(s.select(F.col("accession_number").alias("path")), "").select(F.col("archive_path").alias("accession_number"), F.col("accession_number").alias("acc"), "sequence")
            s = s.join(bare, "accession_number").drop("accession_number").withColumnRenamed("acc", "accession_number") if a.kind == "text" else s
            s = s.withColumn("kind", F.lit(a.kind))
        if a.limit:
            s = s.orderBy("accession_number").limit(a.limit)
        runs.write_run(s, a.run, overwrite=a.overwrite, keep_text=a.keep_text)
    elif a.command == "manifest":
        rows = manifest.parse_index(spark.read.text(a.index))
        rows = manifest.select_forms(rows, manifest.expand_forms(a.forms), "form", a.amendments).withColumn("year", manifest.year_of(F.col("filed"))).withColumn("accession_number", manifest.accession_of(F.col("filename")))
        if a.years:
            rows = rows.where(F.col("year").isin(manifest.parse_years(a.years)))
        rows.where("accession_number is not null").write.mode("overwrite").parquet(a.out)
    elif a.command == "show":
        rows = runs.document_rows(spark, a.run, a.accession, a.sequence)
        rows["nodes"].orderBy("node_id").select("node_id", "parent_id", "level_kind", "label_canon", "title", "raw_start", "raw_end", "path_str").show(500, truncate=80)
        rows["rejected"].orderBy("raw_start").show(500, truncate=80)
    elif a.command == "report":
        docs = read(a.run, "documents")
        years = docs.select("accession_number", F.coalesce("filed_year", F.col("year").cast("int")).alias("filed_year"))
        for quarterly in (False, True):
            metrics = analytics.document_metrics(read(a.run, "nodes"), years, quarterly, docs)
            analytics.summarize(metrics, ["filed_year"]).orderBy("filed_year").show(200)
            if a.worst:
                library.worst_documents(metrics, a.worst).show(a.worst, truncate=60)
    elif a.command == "sections":
        texts = sgml.read_submissions(spark, a.raw).select("accession_number", "text")
        analytics.sections(read(a.run, "nodes"), a.labels, texts).write.mode("overwrite").parquet(a.out)
    elif a.command == "diff":
        analytics.label_changes(read(a.run_a, "nodes"), read(a.run_b, "nodes")).groupBy("change").count().show()
        analytics.meta_moves(read(a.run_a, "nodes"), read(a.run_b, "nodes")).show()
    elif a.command in ("hashes", "verify"):
        h = analytics.document_hashes(read(a.run, "nodes").drop("year"), rejected=read(a.run, "rejected").drop("year"), documents=read(a.run, "documents"))
        if a.command == "hashes":
            h.write.mode("overwrite").parquet(a.out)
        else:
            review.verify(spark.read.parquet(a.expected), h, ["accession_number", "sequence"]).show()
    elif a.command == "gold-init":
        review.skeleton(read(a.run, "nodes")).write.mode("overwrite").json(a.out)


if __name__ == "__main__":
    main()
