import gzip
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from stemma.operators import analytics, review
from stemma.sources import fetch, manifest, runs
from stemma.streaming import ingest

SUBS = "/root/testdata/sf0.001/submissions.parquet"


def _subs(spark):
    s = spark.read.parquet(SUBS).groupBy("accession_number").agg(F.max("cik").alias("cik"), F.max("text").alias("text"))
    return s.withColumn("year", F.when(F.substring("accession_number", 12, 2) > "50", 1990).otherwise(2005))


def test_run_is_resumable(spark, tmp_path):
    out = f"file://{tmp_path}/run"
    s = _subs(spark)
    runs.write_run(s.where("year = 2005"), out)
    first = runs.read_run(spark, out, "nodes").count()
    assert first > 0
    runs.write_run(s, out)
    runs.write_run(s, out)
    n = runs.read_run(spark, out, "documents")
    assert n.count() == n.select("accession_number", "sequence").distinct().count()
    assert runs.read_run(spark, out, "nodes", "year", 2005).count() == first
    one = n.first()
    rows = runs.document_rows(spark, out, one["accession_number"], one["sequence"])
    assert rows["documents"].count() == 1 and rows["nodes"].count() == one["n_nodes"]


def test_cache_gives_the_same(spark, tmp_path):
    s, cache = _subs(spark), f"file://{tmp_path}/cache"
    a = sorted(map(str, runs.cached_parse(s, cache).collect()))
    b = sorted(map(str, runs.cached_parse(s, cache).collect()))
    assert a == b and a


def test_cache_keeps_copies_of_a_text_apart(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    text = "<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<TEXT>\nITEM 1. BUSINESS\n\nWe make things.\n</TEXT>\n</DOCUMENT>\n"
    of = lambda *names: {r["accession_number"] for r in runs.cached_parse(spark.createDataFrame([(a, a, 2005, text) for a in names], "accession_number string, cik string, year int, text string"), cache).collect()}
    assert of("a") == {"a"}
    assert of("b") == {"b"}
    assert of("a", "b", "c") == {"a", "b", "c"}


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    for r in _subs(spark).collect():
        (src / f"{r['accession_number']}.txt").write_bytes(r["text"].encode("latin-1"))
    for _ in range(2):
        q = ingest.start(ingest.read_stream(spark, str(src)), out, f"file://{tmp_path}/ck", once=True)
        q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("accession_number").distinct().count() == len(list(src.iterdir()))
    assert got.count() == got.select("accession_number", "sequence", "node_id").distinct().count()


def test_fetch(tmp_path):
    rows = [{"accession_number": f"a{i}", "cik": "1", "archive_path": f"x/a{i}.txt"} for i in range(4)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a0.txt").write_text("here")

    def getter(url):
        if url.endswith("2"):
            raise OSError("broken")
        return b"data"

    log = tmp_path / "log.jsonl"
    call = lambda **k: fetch.fetch(rows, str(tmp_path), lambda r: "http://h/" + r["accession_number"], "me me@example.org", str(log), getter=getter, **k)
    assert call(dry_run=True) == {"present": 1, "fetched": 0, "failed": 0, "left": 3}
    assert call() == {"present": 1, "fetched": 2, "failed": 1, "left": 0}
    assert call(limit=0) == {"present": 3, "fetched": 0, "failed": 0, "left": 1}
    lines = [json.loads(x) for x in log.read_text().splitlines()]
    assert [x["bytes"] for x in lines] == [4, None, 4]
    with pytest.raises(ValueError):
        fetch.check_agent("nobody")


def test_get_tries_again():
    class Reply:
        headers = {"Content-Encoding": "gzip"}

        def read(self):
            return gzip.compress(b"ok")

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

    answers = [urllib.error.HTTPError("u", 503, "busy", {"Retry-After": "7"}, None), urllib.error.URLError("x"), Reply()]
    waits = []

    def opener(req):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert fetch.get("http://h", "a@b", opener, fetch.Throttle(0), waits.append) == b"ok"
    assert waits == [7.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        fetch.get("http://h", "a@b", lambda r: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", {}, None)), fetch.Throttle(0), waits.append)


def test_specs():
    assert manifest.parse_years("1994-1996, 2001,1995") == [1994, 1995, 1996, 2001]
    for bad in ("1996-1994", "94"):
        with pytest.raises(ValueError):
            manifest.parse_years(bad)
    assert manifest.expand_forms("10-Q-family,10-Q,8-K") == ["10-Q", "10-QSB", "10-QT", "8-K"]


def test_review(spark):
    df = spark.createDataFrame([("d", "<p>ab</p><b>c</b>", [1, 4, 10])], "k string, payload string, places array<int>")
    marked = review.inject_markers(df, ["k"]).first()["marked"]
    assert marked.replace("<mark>>>></mark>", "") == "<p>ab</p><b>c</b>" and marked.count("<mark>") == 3
    v = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, None, "y"), ("a", 3, "bad", "z")], "k string, at int, error string, said string")
    assert [r["said"] for r in review.last_verdicts(v, ["k"], "at").collect()] == ["y"]
    t = spark.createDataFrame([("abcdefghij", 4, 6)], "t string, a int, b int")
    assert t.select(review.mark_window(F.col("t"), F.col("a"), F.col("b"), 2)).first()[0] == "cd>>>efgh"
    assert t.select(review.clean_window(F.lit("a\n- 12 -\nPage 3\nb"))).first()[0] == "a\nb"
    e = spark.createDataFrame([("1", "i", "o"), ("2", "i", "o"), ("3", "i", "o"), ("4", "i", "o")], "k string, input_sha256 string, output_sha256 string")
    f = spark.createDataFrame([("1", "i", "o"), ("2", "x", "o"), ("3", "i", "y")], "k string, input_sha256 string, output_sha256 string")
    r = review.verify(e, f, ["k"]).first()
    assert (r["n"], r["n_missing"], r["n_inputs_differ"], r["n_outputs_differ"], r["n_equal"], r["ok"]) == (4, 1, 1, 1, 1, False)
    assert review.review_queue(e, f, ["k"]).count() == 1
    assert [r["k"] for r in review.seeded_sample(e, 2, "s", ["k"]).collect()] == [r["k"] for r in review.seeded_sample(e.repartition(3), 2, "s", ["k"]).collect()]


def test_document_hashes_ignore_order_and_versions(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/nodes.parquet")
    a = {tuple(r) for r in analytics.document_hashes(n).collect()}
    b = {tuple(r) for r in analytics.document_hashes(n.repartition(5).orderBy(F.rand(3)).withColumn("parser_version", F.lit("z"))).collect()}
    assert a == b and a


def test_hashes_cover_rejected_and_failed(spark):
    n = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, "y")], "accession_number string, sequence int, node_id int, title string")
    rej = "accession_number string, sequence int, raw_start long, reason string"
    docs = spark.createDataFrame([("a", 1, "i", 3, None), ("b", 1, "i", 3, None), ("c", None, "i", 3, "broken")], "accession_number string, sequence int, input_sha256 string, input_bytes long, error string")
    run = lambda *r: analytics.document_hashes(n, rejected=spark.createDataFrame(list(r), rej), documents=docs)
    by = lambda h: {r["accession_number"]: r for r in h.collect()}
    p, q = ("a", 1, 5, "low"), ("a", 1, 9, "toc")
    one, two = by(run(p, q)), by(run(q, p))
    assert one == two and (one["a"]["n_nodes"], one["a"]["n_rejected"]) == (2, 2)
    others = [by(run(*r))["a"]["output_sha256"] for r in ((p,), (p, p, q), (p, ("a", 1, 9, "low")))]
    assert len({one["a"]["output_sha256"], *others}) == 4
    assert one["b"]["output_sha256"] and one["b"]["n_nodes"] == 0 and one["c"]["output_sha256"] is None
    with pytest.raises(Exception, match="not in documents"):
        run(p, ("z", 1, 1, "low")).collect()
    good = run(p, q)
    lost = analytics.document_hashes(n.limit(0), rejected=spark.createDataFrame([], rej), documents=docs.withColumn("error", F.lit("broken")))
    ok, bad = (review.verify(good, x, ["accession_number", "sequence"]).first() for x in (good, lost))
    assert (ok["n"], ok["n_missing"], ok["n_equal"], ok["n_outputs_differ"]) == (3, 0, 2, 1)
    assert (bad["n_missing"], bad["n_outputs_differ"], bad["ok"]) == (0, 3, False)


def test_metrics_count_every_document(spark):
    sch = "accession_number string, sequence int, doc_type string, grammar string, level_kind string, label_canon string, covers_items array<string>, raw_start long, raw_end long"
    tops = [(a, 1, t, g, "document", None, None, 0, 9000) for a, t, g in (("k0", "10-K", "form10k"), ("x0", "EX-13", "form10k"), ("q0", "10-Q", "form10q"), ("q1", "10-Q", "form10q"))]
    items = [("q1", 1, "10-Q", "form10q", "item", f"ITEM {x}", None, 100 * i, 100 * i + 300) for i, x in enumerate(["I.1", "I.2", "I.3", "II.5", "II.6", "II.9"], 1)]
    nodes = spark.createDataFrame([*tops, *items], sch)
    years = spark.createDataFrame([(a, 2000) for a in ("k0", "x0", "q0", "q1", "e0")], "accession_number string, filed_year int")
    docs = spark.createDataFrame([("e0", None, "10-K", "form10k", "broken"), ("k0", 1, "10-K", "form10k", None)], "accession_number string, sequence int, doc_type string, grammar string, error string")
    of = lambda *more, **k: {r["accession_number"]: r for r in analytics.document_metrics(nodes, years, *more, **k).collect()}
    assert set(of()) == {"k0"} and set(of(documents=docs)) == {"k0", "e0"}
    for a, r in of(documents=docs).items():
        assert (r["n_items"], r["complete"], r["in_order"]) == (0, False, a == "k0")
    assert analytics.summarize(analytics.document_metrics(nodes, years, documents=docs), ["filed_year"]).where("filed_year = 2000").first()["n_docs"] == 2
    q = of(True)
    assert (q["q0"]["complete"], q["q0"]["missing"]) == (False, "I.1,I.2,I.3,II.6")
    r = q["q1"]
    assert (r["complete"], r["complete_with_omissions"], r["missing"], r["missing_omittable"], r["unexpected"]) == (True, True, "", "II.1,II.2,II.3,II.4", "II.9")


def test_score_places(spark):
    sch = "doc string, seq int, label string, at int"
    found = spark.createDataFrame([("d", 1, "A", 100), ("d", 1, "A", 400), ("d", 1, "B", 5)], sch)
    truth = spark.createDataFrame([("d", 1, "A", 130), ("d", 1, "A", 140), ("d", 1, "C", 5)], sch)
    r = analytics.score_places(found, truth, ["doc", "seq", "label"], "at").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 2)
