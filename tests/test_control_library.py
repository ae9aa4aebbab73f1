"""Stored paths, indexes, work rows, gold labels, sets, decisions, bare texts, and broken runs."""

import urllib.error

import pytest
from pyspark.sql import functions as F

from stemma.operators import analytics, library
from stemma.parse import pipeline
from stemma.sources import control, runs


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_paths(spark):
    pairs = control.prefix_map("/srv/sec/=/data/edgar/; old/= ")
    assert pairs == [("/srv/sec/", "/data/edgar/"), ("old/", "")] and control.prefix_map("") == []
    for bad in ("x", "=y"):
        with pytest.raises(SystemExit):
            control.prefix_map(bad)
    at = lambda p: one(spark, control.rewrite_path(F.lit(p), "/root/", pairs))
    assert [at("/srv/sec/a"), at("old/b"), at("c"), at("/abs")] == ["/data/edgar/a", "/root/b", "/root/c", "/abs"]
    assert one(spark, control.archive_path(F.lit("0000000001-05-000001"), F.lit("0042"), "/r/")) == "/r/archives/edgar/data/42/0000000001-05-000001.txt"
    assert one(spark, control.relative_archive_path(F.lit("a"), F.lit("x"))) is None
    assert one(spark, control.resolve_input(F.lit("d/x.txt"), F.lit("fixtures"), "/r", "/f")) == "/f/d/x.txt"
    assert one(spark, control.source_path(F.lit("x.txt"), F.lit("text"), "/r")) == "x.txt"
    with pytest.raises(SystemExit):
        control.data_root("")


def test_fixture_rows_and_primary_html(spark):
    files = spark.createDataFrame([("/repo/t/0000000001-05-000001_3.txt",), ("/repo/t/plain.txt",)], "path string")
    got = [(r["accession_number"], r["sequence"], r["archive_path"]) for r in control.fixture_rows(files, "/repo").collect()]
    assert got == [("0000000001-05-000001", 3, "t/0000000001-05-000001_3.txt"), ("plain", 0, "t/plain.txt")]
    docs = spark.createDataFrame([("a", None, "10-K", True), ("a", 2, "10-K", None), ("b", None, "EX-13", True)], "accession_number string, sequence int, doc_type string, is_html boolean")
    assert [tuple(r) for r in control.primary_is_html(docs, ["10-K"]).collect()] == [("a", False)]


def test_indexes_are_fetched_once(tmp_path):
    calls = []

    def getter(url):
        calls.append(url)
        if "QTR4" in url:
            raise urllib.error.HTTPError(url, 404, "no", {}, None)
        return b"index"

    paths, counts = control.ensure_indexes([2001], str(tmp_path), getter, "http://x")
    assert counts == {"quarters_read": 3, "quarters_unavailable": 1} and len(paths) == 3 and len(calls) == 4
    control.ensure_indexes([2001], str(tmp_path), getter, "http://x")
    assert len(calls) == 5  # only the quarter that isn't there is asked for again


def test_sets_decisions_and_corpora(spark, tmp_path):
    folder = str(tmp_path / "sets")
    docs = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "accession_number string, sequence int")
    library.save_set(docs, folder, "s", "First", 1)
    library.save_set(docs.limit(1), folder, "s", "Second", 2)
    assert [tuple(r) for r in library.list_sets(spark, folder).collect()] == [("s", "Second", 2, 1)]
    assert [tuple(r) for r in library.get_set(spark, folder, "s").collect()] == [("a", 1)]
    where = str(tmp_path / "decisions")
    for k, word in enumerate(["no", "yes"]):
        library.decide(spark.sql(f"SELECT 'a' AS accession_number, 1 AS sequence, 5L AS raw_start, '{word}' AS decision, '' AS note, TIMESTAMP '2020-01-0{k + 1}' AS decided_at"), where)
    assert [r["decision"] for r in library.decisions(spark, where).collect()] == ["yes"]
    spark.range(1).write.parquet(str(tmp_path / "runs/r1/documents"))
    assert [tuple(r) for r in library.corpora(spark, str(tmp_path / "runs")).collect()] == [("r1", ["documents"])]
    assert library.corpora(spark, str(tmp_path / "none")).collect() == []


def test_gold_labels_are_read_and_scored(spark, tmp_path):
    (tmp_path / "g.yaml").write_text('accession: a-1\nsequence: 2\nreviewed: true\nnodes:\n  - {label: "Item 1", raw_start: 10, title: "x, \\"y\\""}\n  - {label: "ITEM 2", raw_start: 900, title: ["t"]}\n  - {label: null, raw_start: 3}\nabsent: []\n')
    (tmp_path / "h.yaml").write_text("nothing here\n")
    g = library.load_gold(spark, str(tmp_path))
    assert sorted(tuple(r) for r in g.collect()) == [("a-1", 2, True, "ITEM 1", 10, 'x, "y"'), ("a-1", 2, True, "ITEM 2", 900, "t")]
    found = spark.createDataFrame([("a-1", 2, "ITEM 1", 40), ("a-1", 2, "ITEM 2", 100)], "accession_number string, sequence int, label_canon string, raw_start long")
    r = analytics.score_places(found, g, ["accession_number", "sequence", "label_canon"], "raw_start").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 1)


TEXT = "ARTICLE I\n\nTERM\n\n1.01 Rent. The tenant pays the rent every month and keeps the rooms in good repair.\n\n1.02 Use. The rooms are a shop.\n"


def test_bare_text_is_one_exhibit():
    nodes, _, docs = pipeline.parse_submission("a", "1", 2005, TEXT, kind="text", sequence=3)
    assert docs[0]["grammar"] == "contract" and docs[0]["sequence"] == 3 and docs[0]["error"] is None
    one = next(n for n in nodes if n["label_canon"] == "SECTION 1.01")
    assert TEXT[one["raw_start"] :].startswith("1.01 Rent.")


def test_work_rows_choose_their_document():
    block = lambda kind, seq, name: f"<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>{seq}\n<FILENAME>{name}\n<TEXT>\nx\n</TEXT>\n</DOCUMENT>\n"
    docs = pipeline.split(block("EX-10", 2, "a.txt") + block("10-K", 1, "b.pdf") + block("10-K405", 3, "c.txt") + block("EX-10.1", "", "d.txt"))
    pick = lambda *a: [d["filename"] for d in pipeline.chosen(docs, *a)]
    assert pick("10k", None, "10-K405") == ["c.txt"] and pick("10k", None, "10-K/A") == ["c.txt"] and pick("10k", None, "8-K") == ["a.txt"]
    assert pick("ex10", 2, "") == ["a.txt"] and pick("ex10", 9, "") == [] and len(pick(None, None, "")) == 4


def test_a_broken_run_is_written_anew(spark, tmp_path):
    run = str(tmp_path / "run")
    filing = "<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: EX-10\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>EX-10\n<SEQUENCE>1\n<TEXT>\n" + TEXT + "</TEXT>\n</DOCUMENT>\n"
    s = spark.createDataFrame([("a", "1", 2005, filing), ("b", "1", 2006, filing)], "accession_number string, cik string, year int, text string")
    runs.write_run(s.where("year = 2005"), run)
    runs.write_run(s, run)  # 2005 is finished and skipped
    n = spark.read.parquet(f"{run}/nodes").count()
    # A try that broke after its nodes were written: no documents row tells of 2007.
    spark.read.parquet(f"{run}/nodes").where("year = 2006").drop("year").withColumn("year", F.lit(2007)).write.mode("append").partitionBy("year").parquet(f"{run}/nodes")
    runs.write_run(s.where("year = 2006").withColumn("year", F.lit(2007)), run)
    assert spark.read.parquet(f"{run}/nodes").where("year < 2007").count() == n
    assert spark.read.parquet(f"{run}/nodes").where("year = 2007").count() == spark.read.parquet(f"{run}/nodes").where("year = 2006").count()
