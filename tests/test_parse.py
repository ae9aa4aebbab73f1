"""Parsing: blocks, labels, clause lists, contents pages, trees, paths, and invariants over real filings."""

import itertools
import random

import pytest

from stemma.operators.tree import heaviest_chain
from stemma.parse import pipeline
from stemma.parse.blocks import html_blocks, text_blocks
from stemma.functions.heads import roman
from stemma.parse.grammars import GRAMMARS, clause_readings
from stemma.parse.trees import read_clauses


def filing(body, kind="10-K"):
    return f"<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: {kind}\nCENTRAL INDEX KEY: 0000000042\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>1\n<TEXT>\n{body}\n</TEXT>\n</DOCUMENT>\n"


def items(text, kind="10-K"):
    n, r, d = pipeline.parse_submission("0000000001-05-000001", "42", 2005, filing(text, kind))
    assert d[0]["error"] is None
    return n, r, d[0]


PROSE = "The company sells goods in many places and expects that its costs will rise over the next year. " * 4


def test_text_blocks_and_offsets():
    s = "  PART I\n\nITEM 1. BUSINESS\nWe make things.\n<PAGE> 3\n          A CENTRED LINE FOR THE PAGE\n-----\nx\n\n<TABLE>\na   1\n</TABLE>\n"
    blocks, norm = text_blocks(s, 100)
    assert [b.text for b in blocks] == ["PART I", "ITEM 1. BUSINESS\nWe make things.", "<PAGE>", "A CENTRED LINE FOR THE PAGE", "x", "a 1"]
    assert blocks[3].underline and blocks[5].in_table and blocks[2].is_page_break
    for b in blocks:
        assert norm[b.norm_start : b.norm_end] == b.text
        if b.kind == "para":
            assert s[b.raw_start - 100 : b.raw_end - 100].split() == b.text.split()


def test_html_blocks():
    s = '<html><p align=center><b>ITEM 1</b></p><table><tr><td>Item 2<td>Properties</tr></table>a<br>b<br><br>c<p style="display:none">no</p><p>&#147;q&#148; &#160;x</p><a href="#t">Table of Contents</a></html>'
    blocks, norm = html_blocks(s, 0)
    texts = [b.text for b in blocks]
    assert texts == ["ITEM 1", "Item 2", "Properties", "a\nb", "c", "“q” x", "Table of Contents"]
    assert blocks[0].bold and blocks[0].center and blocks[1].row_text == "Item 2 Properties" and blocks[-1].kind == "nav"
    for b in blocks:
        assert norm[b.norm_start : b.norm_end] == b.text
    assert s[blocks[0].raw_start : blocks[0].raw_end] == "ITEM 1"


def test_broken_references_keep_the_text():
    assert html_blocks("<p>a&#\n160;b &#147Change</p>", 0)[0][0].text.endswith("Change")


@pytest.mark.parametrize(
    ("html", "want"),
    [("<p>a</p><!-- open <p>b</p>", ["a", "<!-- open", "b"]), ("<p>a</ >b</>c</p>", ["abc"]), ("<p align='x>y</p>z", ["y", "z"]), ("<p>a<![CDATA[b<c]]></p>", ["ab<c"]), ("<!DOCTYPE html><?xml x?><p>a<3</p>", ["a<3"]), ("<p>a</p><p", ["a", "<p"]), ("a &unknown; &amp b", ["a &unknown; & b"])],
)
def test_broken_markup_keeps_the_text(html, want):
    assert [b.text for b in html_blocks(html, 0)[0]] == want


def test_links_back_to_the_contents_are_dropped():
    link = '<a href="#toc">Table of Contents</a>'
    assert [b.text for b in html_blocks(f"<p>{link} ITEM 1. BUSINESS</p><p>Our goods {link}</p><p>{link}</p>", 0)[0]] == ["ITEM 1. BUSINESS", "Our goods", "Table of Contents"]


@pytest.mark.parametrize(
    ("grammar", "line", "want"),
    [
        ("form10k", "PART II", "PART II"), ("form10k", "Item 7A. Quantitative", "ITEM 7A"), ("form10k", "ITEM ONE - BUSINESS", "ITEM 1"), ("form10k", "Item XV. Exhibits", "ITEM 15"), ("form10k", "Item 1(A). Risk Factors", "ITEM 1A"),
        ("form10k", "Item 1(a) General", "ITEM 1"), ("form10k", "Item 17. X", None), ("form10k", "Item 1122 Compliance", "ITEM 1122"), ("form10q", "Item 1. Legal Proceedings", "ITEM II.1"), ("form10q", "Item 1. Financial Statements", "ITEM I.1"),
        ("form10q", "Item 4T. Controls", "ITEM I.4"), ("form10q", "Item 6. (a) Exhibits", "ITEM II.6"), ("form10q", "Item 2", "ITEM ?.2"), ("contract", "ARTICLE IV Loans", "ARTICLE 4"), ("contract", "Section 2.1 Term", "SECTION 2.01"), ("contract", "(iv) the rent", "(iv)"), ("contract", "41.1 x", None),
    ],
)
def test_labels(grammar, line, want):
    g = GRAMMARS[grammar]
    got = None
    for lv in g.levels:
        h = lv.scan(line)
        got = (g.read(lv, h) if h else None) or got
        if got:
            break
    assert (got and got[0]) == want


def test_numerals_and_readings():
    assert [roman(x) for x in ("IV", "XIX", "IIII", "")] == [4, 19, None, None]
    assert ("alpha", 9, 0.0) in clause_readings("i") and ("roman", 1, 0.0) in clause_readings("i")
    assert ("alpha", 27, 0.0) in clause_readings("aa") and clause_readings("12") == [("num", 12, 0.0)]


def test_clause_lists():
    read = lambda marks: [p and p[0] for p in read_clauses([(0.6, clause_readings(m)) for m in marks])]
    assert read(["a", "b", "i", "ii", "iii", "c", "d"]) == [0, 0, 1, 1, 1, 0, 0]
    assert read(["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"]) == [0] * 10
    assert read(["a", "i", "A", "1", "2", "B", "ii", "b"]) == [0, 1, 2, 3, 3, 2, 1, 0]
    assert read(["g", "h", "i", "ii", "iii", "i", "j"]) == [0, 0, 1, 1, 1, 0, 0]
    assert read(["a", "b", "a", "b", "i", "ii", "c"]) == [0, 0, 0, 0, 1, 1, 0]
    assert read(["a", "c", "d"]) == [0, 0, 0] and read([]) == [] and read(["u", "v", "w", "x"]) == [0, 0, 0, 0]


def test_chain_is_heaviest():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        keys, w = [rng.randint(1, 6) for _ in range(n)], [rng.choice([0.3, 0.5, 0.8]) for _ in range(n)]
        best = max(sum(w[i] for i in s) for k in range(1, n + 1) for s in itertools.combinations(range(n), k) if all(keys[a] < keys[b] for a, b in zip(s, s[1:])))
        got = heaviest_chain(keys, w)
        assert abs(sum(w[i] for i in got) - best) < 1e-6 and all(keys[a] < keys[b] for a, b in zip(got, got[1:]))
    assert heaviest_chain([], []) == []


def test_form_with_contents_page():
    names = [("1", "BUSINESS"), ("2", "PROPERTIES"), ("3", "LEGAL PROCEEDINGS"), ("5", "MARKET FOR REGISTRANT'S COMMON EQUITY"), ("7", "MANAGEMENT'S DISCUSSION AND ANALYSIS")]
    toc = "\n".join(f"Item {k}. {t.title()} ........ {i}" for i, (k, t) in enumerate(names))
    body = "\n\n".join(f"ITEM {k}. {t}\n\n{PROSE}" for k, t in names)
    text = f"TABLE OF CONTENTS\n\n{toc}\n\nPART I\n\n{body}\n\nSIGNATURES\n\nPursuant to the requirements of Section 13 of the Securities Exchange Act, the registrant has duly caused this report to be signed.\n/s/ A B"
    nodes, rejected, doc = items(text)
    assert [n["label_canon"] for n in nodes if n["level_kind"] == "item"] == [f"ITEM {k}" for k, _ in names]
    assert doc["toc_found"] and doc["items_found"] == ["1", "2", "3", "5", "7"]
    assert sum(r["reason"] == "toc" for r in rejected) == 5
    synth = [n for n in nodes if "gram.synth_part" in n["rule_ids"]]
    assert [n["label_canon"] for n in synth] == ["PART II"] and synth[0]["head_raw_start"] == synth[0]["head_raw_end"]
    whole = filing(text)
    seven = next(n for n in nodes if n["label_canon"] == "ITEM 7")
    assert whole[seven["raw_start"] : seven["raw_end"]].startswith("ITEM 7.") and "SIGNATURES" not in whole[seven["raw_start"] : seven["raw_end"]]
    assert doc["back_start"] == whole.index("SIGNATURES")


def test_contract():
    text = "LEASE\n\nARTICLE I\n\nTERM\n\n1.01 Rent. The tenant pays the rent in March of every year and keeps the rooms in good repair.\n\n(a) the first part of it;\n\n(b) the second part of it;\n\n(i) small;\n\n(ii) large;\n\n1.02 Use. The rooms are used as a shop.\n\nARTICLE II\n\n2.01 Notices. All notices are in writing.\n\nIN WITNESS WHEREOF, the parties have executed this Lease.\n"
    nodes, _, doc = items(text, "EX-10.1")
    kinds = [(n["level_kind"], n["label_canon"]) for n in nodes]
    assert ("section", "SECTION 1.02") in kinds and ("article", "ARTICLE 2") in kinds and ("clause_roman", "(ii)") in kinds
    assert next(n for n in nodes if n["label_canon"] == "ARTICLE 1")["title"] == "TERM"
    assert next(n for n in nodes if n["label_canon"] == "(ii)")["path_str"] == "2.1.1.2.2.0.0.0"
    assert doc["grammar"] == "contract"


def test_quarterly_parts():
    text = f"PART I\n\nItem 1. Financial Statements\n\n{PROSE}\n\nItem 2. Management's Discussion and Analysis\n\n{PROSE}\n\nPART II\n\nItem 1.\n\n{PROSE}\n\nItem 6. Exhibits\n\n{PROSE}"
    nodes, _, _ = items(text, "10-Q")
    assert [n["label_canon"] for n in nodes if n["level_kind"] == "item"] == ["ITEM I.1", "ITEM I.2", "ITEM II.1", "ITEM II.6"]


def test_empty_and_odd_inputs():
    for text in ("", "no envelope", "<DOCUMENT><TYPE>10-K</DOCUMENT>", filing(""), filing("<html></html>"), filing("\x00\x85 \xa0")):
        n, r, d = pipeline.parse_submission("x", None, None, text)
        assert all(x["error"] is None for x in d)


def test_invariants_over_filings(spark):
    s = spark.read.parquet("/root/testdata/sf0.01/submissions.parquet").select("accession_number", "text").distinct().collect()
    for row in s:
        nodes, rejected, docs = pipeline.parse_submission(row["accession_number"], "1", 2005, row["text"])
        assert all(d["error"] is None for d in docs)
        by_doc: dict = {}
        for n in nodes:
            by_doc.setdefault(n["sequence"], []).append(n)
        for own in by_doc.values():
            ids = {n["node_id"]: n for n in own}
            for n in own:
                assert n["raw_start"] <= n["raw_end"] and len(n["path"]) == 8 and n["meta"] in (1, 2, 3)
                if n["parent_id"] >= 0:
                    assert ids[n["parent_id"]]["node_id"] < n["node_id"] or ids[n["parent_id"]]["raw_start"] >= n["raw_start"]
                if n["label_raw"] and n["level_kind"] in ("item", "section") and n["head_raw_start"] == n["raw_start"]:
                    assert row["text"][n["raw_start"] : n["raw_start"] + 40].strip()
            paths = [n["path_str"] for n in own if n["meta"] != 1 and n["depth"] <= 6]
            assert len(set(paths)) >= 0.9 * len(paths)


def test_result_does_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    s = spark.read.parquet("/root/testdata/sf0.01/submissions.parquet").select("accession_number", "cik", F.lit(2005).alias("year"), "text").distinct()
    hashes = []
    for n in (1, 3, 8):
        x = pipeline.table_of(pipeline.parse_submissions(s.repartition(n)), "nodes")
        hashes.append(x.agg(F.bit_xor(F.xxhash64(*x.columns)), F.count("*")).first())
    assert hashes[0] == hashes[1] == hashes[2]


def test_article_restart_behind_many_section_restarts():
    from stemma.parse import outline
    from stemma.parse.blocks import Block
    from stemma.parse.headings import Candidate

    cand = lambda kind, order, at: Candidate(0, kind, "", "", "", 0.9, [], order, at, at + 5, at)
    cands = [cand("article", 1, 0), *[cand("section", 101 + i % 4, 10 + 10 * i) for i in range(160)]]
    lines = [("word " * 60, 2000, 0.0), ("/s/ John Doe", 2300, 0.1), ("LOAN AGREEMENT", 2400, 1.0)]
    blocks = [Block(i, t, at, at + len(t), caps_ratio=caps) for i, (t, at, caps) in enumerate(lines)]
    cuts, borders = outline.restarts(blocks, [*cands, cand("article", 1, 3000)], [])
    assert 3000 in cuts and borders == [3000] and len(cuts) == outline.MAX_SEGMENTS - 1


def test_section_restarts_rise_below_the_highest_so_far():
    from stemma.parse import outline
    from stemma.parse.headings import Candidate

    def cuts(orders, **kw):
        cands = [Candidate(0, "section", "", "", kw.get("title", "T"), kw.get("score", 0.9), list(kw.get("rules", [])), o, 10 * i, 10 * i + 5, 10 * i) for i, o in enumerate(orders)]
        return outline.restarts([], cands, [])[0]

    assert cuts([101, 102, 103, 104, 101, 102, 103]) == [40]
    assert cuts([101, 102, 103, 101, 102, 103]) == []  # the third doesn't stay below the highest
    assert cuts([101, 102, 103, 104, 101, 102]) == [] and cuts([]) == []
    assert cuts([101, 102, 103, 104, 101, 102, 103], rules=["pos.in_table"], title="") == []
    assert cuts([101, 102, 103, 104, 101, 102, 103], rules=["toc.leader_or_pageno"]) == []


def test_instruments_and_their_evidence():
    from stemma.parse import outline
    from stemma.parse.blocks import Block

    assert outline.instrument_name("SECURITY AGREEMENT") == "SECURITY AGREEMENT" and outline.instrument_name("the agreement") is None
    assert outline.named_in_words('This Loan Agreement (the "Agreement") is made') == "LOAN AGREEMENT"
    texts = ["The Borrower pays. " + "some words of prose here " * 12, "/s/ A. Name", "PLEDGE AGREEMENT", "The Pledgor and the Lender agree"]
    blocks = [Block(i, t, 100 * i, 100 * i + 50) for i, t in enumerate(texts)]
    s = outline.Story(blocks)
    assert s.prose_between(-1, 50) and not s.prose_between(50, 400) and s.opens_instrument(50, 400)
    assert s.evidence(50, 400) == ["seg.prior_closed", "seg.new_title", "seg.new_parties"]
    assert s.evidence(150, 250) == ["seg.new_title"]


def test_clauses_outside_sections():
    body = "\n\n".join(f"({x}) the {w} part of this schedule" for x, w in zip("abc", ("first", "second", "third")))
    text = f"LEASE\n\nARTICLE I\n\nTERM\n\n1.01 Rent. The tenant pays the rent in March of every year.\n\nARTICLE II\n\nSCHEDULE A\n\n{body}\n"
    nodes, rejected, _ = items(text, "EX-10.1")
    kept = [n for n in nodes if n["level_kind"].startswith("clause")]
    assert [n["label_canon"] for n in kept] == ["(a)", "(b)", "(c)"]
    recital = "WHEREAS, the parties agree as they do\n\n" + "\n\n".join(f"({x}) so they have said to all" for x in "abc")
    nodes, rejected, _ = items("LEASE\n\n" + recital + "\n\nARTICLE I\n\nTERM\n\n1.01 Rent. The tenant pays the rent.\n", "EX-10.1")
    assert sum(r["reason"] == "clause_outside_section" for r in rejected) == 3


def test_further_items_of_a_heading():
    from stemma.parse import headings

    assert headings._further("and 2. Business") == (["2"], False, 5)
    assert headings._further(", 7A and 8 Title")[0] == ["7A", "8"] and headings._further("through 14. X")[:2] == (["14"], True)
    assert headings._further("Business and 2") == ([], False, 0) and headings._further("and (2)")[0] == []
    assert headings._named_again("Business and Item 2. Properties; Items 3") == ["2", "3"] and headings._named_again("Item 4, " * 20000) == ["4"] * 19999
    assert headings._formula("1.00 minus the Eurodollar Reserve Percentage") and headings._formula("(1.00 - Reserve Requirement)") and not headings._formula("1.01 Reserve Account of the Fund")


@pytest.mark.parametrize(
    ("text", "want"),
    [("is incorporated by reference", ""), (" of this item is hereby set forth in Part II", " of this item "), ("has been filed with", ""), ("was good. It is included in", None), ("is sold by", None), ("", None)],
)
def test_pointing_words(text, want):
    from stemma.functions import phrases

    assert phrases.refers_elsewhere(text) == want


def test_wording():
    from stemma.functions import phrases as P

    assert P.continued("ITEM 7 (Continued)") and P.continued("(cont.)") and P.continued("Cont'd") and not P.continued("Continental")
    assert P.attests("Pursuant to the requirements of Section 13 or 15(d), the registrant has duly caused this") and not P.attests("in accordance with Section 13. It has caused harm.")
    assert P.signed("/s/ A. B") and P.signed("By: ____") and P.signed("Name: A\nTitle: B") and P.signed("have duly caused this to be executed") and not P.signed("by the sea")
    assert P.no_heading("Item 1") and P.no_heading("Sales of 1999 rose:") and P.no_heading("May 5, 2001") and not P.no_heading("Liquidity and Capital Resources")
    assert P.new_subject(" the plan ") and not P.new_subject(" of item ")


def _cand(label, order, start, *rules, score=0.7, title="", covers=()):
    from stemma.parse.headings import Candidate

    return Candidate(0, "item", label, label, title, score, list(rules), order, start, start + 5, start, covers=list(covers))


def test_out_of_order_items():
    from stemma.parse.trees import out_of_order

    q, k = GRAMMARS["form10q"], GRAMMARS["form10k"]
    chosen = [_cand("ITEM 2", 20, 100, covers=["3"])]
    tm = "gram.item.title_match"
    late = [_cand("ITEM 1B", 12, 900, tm), _cand("ITEM 1B", 12, 950, tm, score=0.9), _cand("ITEM 3", 30, 910, tm), _cand("ITEM 4", 40, 920), _cand("ITEM 5", 50, 930, tm, "rej.fm_table"), _cand("ITEM 6", 60, 940, tm)]
    got = out_of_order([*chosen, *late], chosen, k, {id(late[-1])})
    assert got == [late[1]] and late[1].has("seq.out_of_order_tiebreak")
    several = _cand("ITEM II.2", 120, 50, "lbl.item.multi", title="Defaults upon Senior Securities", covers=["3"])
    assert out_of_order([several], [], q, set()) == [several] and several.has("seq.out_of_order_multi")
    assert out_of_order([several], [_cand("ITEM II.3", 130, 10)], q, set()) == []


def test_vetoed_index_rows():
    from stemma.parse import contents

    v = "toc.vetoed_region"
    rows = [_cand(f"ITEM {i}", 10 * i, i, v) for i in (1, 2, 3, 4)]
    body = _cand("ITEM 3", 30, 500, "gram.item.title_match")
    contents.vetoed_rows([*rows, body])
    assert [c.has("rej.vetoed_index_row") for c in rows] == [False, False, True, False]
    assert contents.index_members([*rows, body]) == {id(c) for c in rows}
    fresh = [_cand(f"ITEM ?.{i}", 10 * i, n, v) for n, i in enumerate((1, 2, 1, 2))]
    contents.vetoed_rows([*fresh, _cand("ITEM ?.2", 20, 500, "gram.item.title_match")])
    assert [c.has("rej.vetoed_index_row") for c in fresh] == [False, True, False, True] and not contents.index_members(fresh)
    mixed = [_cand(f"ITEM {i}", 10 * i, n, v) for n, i in enumerate((1, 2, 1, 2))]
    contents.vetoed_rows([*mixed, _cand("ITEM 2", 20, 500, "gram.item.title_match")])
    assert not any(c.has("rej.vetoed_index_row") for c in mixed)


def test_sections_that_carry_a_sentence_on():
    from stemma.parse import headings as H
    from stemma.parse.headings import Candidate

    def hit(text):
        c = Candidate(0, "section", "", "", "", 0.6, [], 1, 0, 0, text.index("Section"))
        H.section_references([c], text)
        return c.has("rej.section_xref")

    assert hit("as it is stated in and pursuant to the\n\nSection 2.5, above") and hit("the rights that the Lender may have under,\nSection 9.2")
    assert not hit("as it is stated in and pursuant to the\nSection 2.5 Term of the Lease")
    assert not hit("keeps the rooms insured at all times; or\nSection 6.1 (i) the rent") and not hit("keeps the rooms insured at all times;\nor\nSection 6.1 (i) the rent")
    assert not hit("The end of it.\nSection 6.1") and not hit("Notices to\nSection 6.1") and not hit("Section 6.1")
