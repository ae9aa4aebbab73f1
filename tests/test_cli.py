from pyspark.sql import functions as F

from stemma import cli
from stemma.operators import blocks as B


def test_commands(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    for r in spark.read.parquet("/root/testdata/sf0.001/submissions.parquet").select("accession_number", "text").distinct().collect():
        (src / f"{r['accession_number']}.txt").write_bytes(r["text"].encode("latin-1"))
    (tmp_path / "idx").write_text("Description: x\nCIK|Company|Form|Date Filed|Filename\n1|A|B Co|10-K|2005-03-01|edgar/data/1/0000000001-05-000001.txt\n2|C|8-K|2005-03-01|edgar/data/2/0000000002-05-000001.txt\n")
    run = f"file://{tmp_path}/run"
    cli.main(["parse", f"file://{src}", run])
    cli.main(["report", run])
    cli.main(["diff", run, run])
    cli.main(["hashes", run, f"file://{tmp_path}/h"])
    cli.main(["verify", run, f"file://{tmp_path}/h"])
    cli.main(["sections", run, f"file://{src}", f"file://{tmp_path}/s", "ITEM 1", "SECTION 1.01"])
    cli.main(["gold-init", run, f"file://{tmp_path}/g"])
    cli.main(["manifest", f"file://{tmp_path}/idx", f"file://{tmp_path}/m"])
    d = spark.read.parquet(f"{run}/documents").first()
    cli.main(["show", run, d["accession_number"], str(d["sequence"])])
    assert "true" in capsys.readouterr().out
    assert spark.read.parquet(f"file://{tmp_path}/m").select("company").collect()[0][0] == "A|B Co"
    s = spark.read.parquet(f"file://{tmp_path}/s")
    assert s.count() > 0 and s.where(F.length("section") != F.col("raw_end") - F.col("raw_start")).count() == 0


def test_block_windows_on_nulls(spark):
    sch = "accession_number string, sequence int, idx int, text string, is_page_break boolean, norm_start long, raw_start long, raw_end long"
    b = spark.createDataFrame([("a", 1, 0, "abc", None, 0, 10, 13), ("a", 1, 1, None, True, 5, 20, 20), ("a", 1, 2, "12", False, 9, 30, 32), ("a", 1, 3, "word", None, 13, 40, 44), ("a", 1, 4, "x", None, 19, 50, 51)], sch)
    assert [r["distance"] for r in B.page_distance(b).orderBy("idx").collect()] == [None, None, 0, 0, 4]
    p = spark.createDataFrame([("a", 1, 14), ("a", 1, 18), ("b", 1, 2)], "accession_number string, sequence int, p long")
    assert sorted((r["p"], r["raw"]) for r in B.norm_to_raw(p, b, "p").collect()) == [(2, None), (14, 41), (18, 44)]
