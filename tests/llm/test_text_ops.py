import random
import re
import unicodedata

import pyarrow as pa
import pytest

from stemma.llm import canonical, encoding, markup, quality, unify

# ---------------------------------------------------------------- character forms

SAME = ["L’Étoile", "Завод", "Μονάδα", "Δ Hedge", "β-Casein", "§ 1.01", "Łódź", "“q” – —", "東洋", "", "abc", "x²"]
ODD = {"Ａｂ": "Ab", "𝗣𝗮rt": "Part", "ofﬁce": "office", "cafe\u0301": "café", "It\u200bem": "Item", "\ufeffA": "A", "a\u00a0b": "a b", "РАRТ Ⅱ": "PART II", "Іtеm ϹO": "Item CO", "a\u0323\u0302": "ậ", "Ω\u2126": "ΩΩ", "\u0301": "\u0301"}


def test_unify(spark):
    values = [*SAME, *ODD, None, *ODD]
    df = spark.createDataFrame([(v, "x") for v in values], "value string, unified string")
    got = {r["value"]: (r["unified"], r["odd"]) for r in unify.unify_values(df).collect()}
    for v in SAME:
        if not v.isascii():
            assert got[v] == (v, False), v
        else:
            assert v not in got
    for v, want in ODD.items():
        assert got[v][0] == want, v
        assert got[v][1] == (v != "\u0301"), v
    back = unify.unify_columns(df, ["value"])
    assert back.count() == len(values)
    assert sum(r["value"] is None for r in back.collect()) == 1
    assert unify.unify_columns(df.limit(0), ["value"]).collect() == []


def test_composition_equals_the_standard(spark):
    rng = random.Random(3)
    bases, marks = "aeoAŝxΑα\u1100가각\u0b47\u1e9b", "\u0301\u0300\u0308\u0331\u0323\u0302\u031b\u0345\u0313\u1161\u11a8\u0b3e\u0b56"
    values = ["".join(rng.choice(bases + marks * 2) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    values += ["a\u0331\u0301", "\u1100\u1161\u11a8", "a\u0323\u0302", *[unicodedata.normalize("NFD", c) for c in "éèüñçåôÅÉǖṩ가ᾂ"]]
    got = {r["value"]: r["unified"] for r in unify.unify_values(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    scripts = re.compile("[α-ωΑ-Ω]")  # look-alikes in Latin words are another matter
    for v in values:
        if not v.isascii() and not scripts.search(v):
            assert got[v] == unicodedata.normalize("NFC", v), ascii(v)


def test_look_alikes_of_other_scripts(spark):
    got = {r["value"]: r["unified"] for r in unify.unify_values(spark.createDataFrame([("Ոoօ",), ("Տale",), ("Ꭺct",), ("Հայ",)], "value string")).collect()}
    assert got["Հայ"] == "Հայ" and got["Ꭺct"] == "Act" and got["Տale"] == "Sale"


def test_a_session_without_confusables_is_an_error():
    from types import SimpleNamespace as Fake

    def session(**checker):
        builder = lambda: Fake(build=lambda: Fake(**checker))
        return Fake(_jvm=Fake(com=Fake(ibm=Fake(icu=Fake(text=Fake(SpoofChecker=Fake(Builder=builder)))))))

    def broken(_):
        raise ConnectionError("the JVM is gone")

    for spark in (Fake(), Fake(_jvm=None), session(), session(getSkeleton=broken), session(getSkeleton=lambda text: text[:9])):
        with pytest.raises(RuntimeError, match="ICU"):
            unify.look_alikes(spark)
    assert unify.look_alikes(session(getSkeleton=lambda text: text)) == unify.LOOK_ALIKE


# ---------------------------------------------------------------- labels and titles

LABELS = [
    ("item", "lTEIM 9-A –", (None, 9, "A")), ("item", "PART II - ITME II", (2, 2, "")), ("item", "ITEM l(A) of PAT II -", (2, 1, "A")), ("item", "itm Seven A -", (None, 7, "A")),
    ("item", "Item 9G", (None, 9, "G")), ("item", "Item I.4", (1, 4, "")), ("item", "item II-I A", (2, 1, "A")), ("item", "ITEIVI 7-A.", (None, 7, "A")), ("item", "Note 15", None),
    ("item", "I T E M l4.", (None, 14, "")), ("item", "Pat II iitem 1)", (2, 1, "")), ("item", "", None), ("item", "Item", None), ("part", "P4RT # ii:", (None, 2, "")),
    ("part", "Book II", None), ("article", "ARTIGLE No. NINETEEN)", (None, 19, "")), ("article", "A R T I C L E5", (None, 5, "")), ("article", "Preamble", None), ("item", "Item Ninety", None),
]


@pytest.mark.parametrize(("kind", "label", "want"), LABELS)
def test_read_label(kind, label, want):
    got = canonical.read_label(label, kind)
    assert (got and got[1:]) == want


def test_map_records(spark):
    ref = spark.createDataFrame(
        [(1, "PART I", None, None, "part", None), (2, "ITEM 1", None, "Company Operations and Product Lines", "item", "form10k"), (3, "ITEM I.1", "PART I, ITEM 1", "Unaudited Interim Accounts", "item", "form10q")],
        "ref_id int, label_canon string, alt_label string, ref_title string, level_kind string, grammar string",
    )
    c = spark.createDataFrame(
        [("a", 1, 1, "item", "ITEN 1"), ("a", 1, 1, "item", "ITEN 1"), ("a", 1, 2, "item", "Item 1."), ("a", 1, 3, "item", "Item 5"), ("a", 1, 4, "part", "Prt. l"), ("a", 1, 5, "item", None), ("a", None, 6, "item", "part 1 item 1"), ("a", 1, 7, "section", "x")],
        "accession_number string, sequence int, cand_no int, kind string, label_raw string",
    )
    n = spark.createDataFrame(
        [("b", 1, 1, "item", None, "form10k", "Co. Ops & Product Lines"), ("b", 1, 2, "item", None, "form10q", "Co. Ops & Product Lines"), ("b", 1, 3, "item", None, None, "UNAUDITED INTERIM ACCTS"), ("b", 1, 4, "item", None, "form10k", None), ("b", 1, 5, "item", "ITEM 1", "form10k", "x"), ("b", 1, 6, "item", None, "form10k", "")],
        "accession_number string, sequence int, node_id int, level_kind string, label_canon string, grammar string, title string",
    )
    got = sorted((r["rec_table"], r["rec_no"], r["ref_id"]) for r in canonical.map_records(c, n, ref).collect())
    assert got == [("candidates", 1, 2), ("candidates", 3, -1), ("candidates", 4, 1), ("candidates", 6, 3), ("nodes", 1, 2), ("nodes", 2, -1), ("nodes", 3, 3), ("nodes", 4, -1), ("nodes", 6, -1)]
    assert canonical.map_records(c.limit(0), n.limit(0), ref).collect() == []


@pytest.mark.parametrize("typed, want", [("mgmt", "management"), ("info", "information"), ("qtrly", "quarterly"), ("dept", "department"), ("disclosurs", "disclosures"), ("units", "units"), ("of", "of"), ("x", "x"), ("12", "12"), ("financial", "financial"), ("add'l", "additional")])
def test_short_forms_are_written_out(typed, want):
    v = canonical.Vocabulary(["Management Information", "Quarterly Department Disclosures", "Uncertainties", "Financial and Additional"])
    assert v.written(typed) == want


def test_similarity_join_equals_brute_force(spark):
    titles = ["rate and price update", "rates and prices update", "interim control review", "internal control evaluation", "", "zzz", "price update rate"]
    entries = [(i, "title", None, canonical.title_tokens(t)) for i, t in enumerate(["Rate and Price Update", "Internal Control Evaluation", "Interim Control Review"])]
    df = spark.createDataFrame([("title", t, None, t) for t in titles], "side string, value string, grp string, form string")
    got = {r["value"]: (r["ref_id"], round(r["similarity"], 9)) for r in canonical.similarity_join(df, entries, {"title": 0.3}).collect()}
    want = {}
    for t in titles:
        x = set(canonical.title_tokens(t))
        sims = [(len(x & set(e)) / len(x | set(e)) if x | set(e) else 0, -i) for i, _, _, e in entries]
        s, i = max(sims)
        if s >= 0.3:
            want[t] = (-i, round(s, 9))
    assert got == want


# ---------------------------------------------------------------- encodings


def _garble(s, enc):
    table = {b: c for c, b in encoding._byte_of(enc).items()}
    return "".join(c if c.isascii() else "".join(table[b] for b in c.encode()) for c in s)


def test_chains_undo_garbling():
    for s in ["é", "’", "“", "€", "§", "ñ"]:
        for enc in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251"):
            once = _garble(s, enc)
            assert s in dict(encoding.candidates(once)), (s, enc)
        twice = _garble(_garble(s, "cp1252"), "cp1252")
        assert s in dict(encoding.candidates(twice))


def test_affected(spark):
    clean = ["The Company’s café in São Belmiro — “Net Worth” — § 3", "SÃO Âmbito ¿Qué? Dürrholz®", "ЗАВОД ПРИБОР", "plain", None, "", "A&#151;B", "x &#8217; y"] + ["Niños’ crème über Århus, holder’s “Liens” é"] * 30
    bad = ["The Companyâ\x80\x99s", "cafÃ© in town", "the Company\x92s", "canï¿½t", "Montr�vale", "don&#226;&#8364;&#8482;t", "SÃƒÂ£o", "Company‚Äôs"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean + bad)], "k int, text string, restored string")
    got = {r["k"]: (r["restored"], r["n_lost"]) for r in encoding.affected(df, ["k"]).collect()}
    assert sorted(got) == list(range(len(clean), len(clean) + len(bad)))
    n = len(clean)
    assert got[n][0] == "The Company’s" and got[n + 1][0] == "café in town" and got[n + 2][0] == "the Company’s"
    assert got[n + 3] == ("can�t", 1) and got[n + 5][0] == "don’t" and got[n + 6][0] == "São" and got[n + 7][0] == "Company’s"
    assert encoding.affected(df.limit(0), ["k"]).collect() == []


# ---------------------------------------------------------------- markup

PLAIN = ["x < 4 and y > 3", "R&D and P&L #4 [62]", "** Filed; * previously filed", "* * * left out * * *", "Series A\\B notes 5 1/2% // 6%", "a = b ~ c; 3 * 5 = 15; name_of_unit", "$1 to $2, 5 & 6", "[Reserved] (the Issuer) ____ 3", "", "Title *"]
MARKED = {
    "a<br>b": "a\nb", "<b>Item 1</b> x": "Item 1 x", "held</TD by 6": "held\n\n by 6", 'margin-left:4pt">Text': "Text", "a&nbsp;b &amp; c": "a b & c", "&lt;u&gt;x&lt;/u&gt; y": "x y",
    "## H\n\ntext": "## H\n\ntext", "a **b c** d": "a b c d", "[x](exhibit_1.htm) y": "x y", "```\ncode\n```": "```\ncode\n```", "|a|1|\n|---|---|\n|b|2|": "a | 1\n\nb | 2",
    "== H ==\nbody": "## H\n\nbody", "'''x''' y": "x y", "[[a|b]] c": "b c", "{{note|1}} z": "z", "\\textbf{x} y": "x y", "\\begin{itemize}\n\\item a\n\\end{itemize}": "- a",
    "<ul><li>a<li>b</ul>": "- a\n- b", "<table><tr><td>a<td>1</tr></table>": "a | 1", "<pre>x  y</pre>": "```\nx  y\n```", "<!-- c -->z": "z", "<script>var a</script>k": "k", "<h2>T</h2>b": "## T\n\nb",
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_signs_stay(text):
    assert markup.clean(text) == (text, "")


@pytest.mark.parametrize(("text", "want"), MARKED.items())
def test_markup_is_cleaned(text, want):
    got, kinds = markup.clean(text)
    assert kinds
    assert got == want


def test_formula_is_kept():
    got, kinds = markup.clean("rate $r_{t} = \\frac{9}{57}$ now")
    assert kinds == "latex" and "$r_{t} = \\frac{9}{57}$" in got


def test_menus_are_dropped():
    body = "<p>" + "The tenant pays the rent, the taxes, and the costs of the lease. " * 5 + "</p>"
    html = "<div><ul><li><a href=#a>Home page of the firm</a><li><a href=#b>Contents of the report</a></ul></div><div>" + body * 3 + "</div>"
    got, _ = markup.clean(html)
    assert "Home page" not in got and got.count("The tenant pays") == 15


@pytest.mark.parametrize("text", ["<b>" * 5000 + "x", "**a " * 20_000, "__a " * 20_000, "''a " * 20_000, "<a href=\"" * 3000, "<" * 50_000, "&lt;p&gt;" * 5000, "a <b " * 5000])
def test_very_long_and_deep_texts(text):
    got, kinds = markup.clean(text)
    assert got is not None


def test_long_label_is_none():
    assert canonical.read_label("Item (" * 2000, "item") is None
    assert canonical.read_label("PART I " + ":," * 50_000, "item") is None


@pytest.mark.parametrize("label, want", [("Item 7A " + ". " * 500, ("item", None, 7, "A")), ("PART II" + "." * 300 + " ITEM 6", ("item", 2, 6, "")), ("Item " + "0" * 500 + "1", ("item", None, 1, "")), ("Item" + " " * 900 + "9", ("item", None, 9, ""))])
def test_long_labels_are_read(label, want):
    assert canonical.read_label(label, "item") == want


def test_clean_texts(spark):
    df = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "<b>x</b>", "m"), (4, "plain", "m")], "k int, text string, markup string")
    assert {r["k"]: r["clean_text"] for r in markup.clean_texts(df, ["k"]).collect()} == {1: None, 2: "", 3: "x", 4: "plain"}
    assert [r["k"] for r in markup.clean_texts(df, ["k"], True).collect()] == [3]
    assert markup.clean_texts(df.limit(0), ["k"]).collect() == []


# ---------------------------------------------------------------- quality

PROSE = "The tenant pays the rent in March. We expect that costs will rise, but our plans are the same as before. "


def test_quality(spark):
    rows = {
        1: None, 2: "", 3: "  \n ", 4: PROSE * 6, 5: PROSE.upper() * 4, 6: "\n".join(f"Revenue\t{i},123\t({i}45)\t9{i}" for i in range(20)),
        7: "\n".join(f"{i}. Water Meters" for i in range(1, 25)), 8: "\n".join(["Print Next Page Help"] * 30), 9: "k3Jd8+s/Pq0ZxW7v" * 40, 10: PROSE * 500,
    }
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows.items()], "doc_id int, text string, kind string")
    words = spark.createDataFrame([(w,) for w in "the in we that but our as in a of to".split()], "word string")
    got = {r["doc_id"]: r for r in quality.assess(docs, words, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert [got[k]["kind"] for k in (1, 2, 3)] == ["blank"] * 3
    assert got[1]["mean_word_length"] is None and got[1]["n_words"] == 0
    assert [got[k]["kind"] for k in (4, 5, 10)] == ["prose"] * 3
    assert "prose" not in [got[k]["kind"] for k in (6, 7, 8, 9)]
    assert got[6]["kind"] == "table" and got[7]["kind"] == "list"
    assert got[4]["n_words"] == len((PROSE * 6).split())
    assert quality.assess(docs.limit(0), words, ["doc_id"]).collect() == []


def test_slices_do_not_change_features():
    import numpy as np

    texts = pa.array([PROSE, None, "a\tb\t1\n\nc", "", "é’s “x.”\n- y"] * 7)
    common = quality.common_table(["the", "a"])
    whole = quality._batch_counts(texts, common)
    parts = [quality._batch_counts(texts.slice(i, 1), common) for i in range(len(texts))]
    assert np.array_equal(whole[0], np.concatenate([p[0] for p in parts], axis=1))


def test_margin_sample_ignores_order(spark, monkeypatch):
    monkeypatch.setattr(encoding, "VALIDATION_ROWS", 20)
    texts = [f"a{chr(97 + i % 26)} caf\u00e9 {chr(0x3B1 + i % 20)}{chr(0x3B1 + i // 20)} z" for i in range(100)]

    def sample(rows):
        out = [b for part in (rows[:50], rows[50:]) for b in encoding._count(iter([pa.RecordBatch.from_pydict({"t": part[:7]}), pa.RecordBatch.from_pydict({"t": part[7:]})]))]
        found = {(g, c) for b in out for k, g, _, c in zip(*(b.column(i).to_pylist() for i in range(4))) if k == 0}
        return sorted(found)[:20]

    assert sample(texts) == sample(texts[::-1]) and len(sample(texts)) == 20


def test_margins_come_from_all_clean_runs(spark):
    rng = random.Random(5)
    signs = "éßøñ" + "".join(map(chr, range(0x3B1, 0x3C9)))
    lines = [f"the {rng.choice('abcde')}{''.join(rng.choice(signs) for _ in range(rng.randint(1, 3)))}{rng.choice('xyz ')}{rng.choice(['', '', '', 'ü', '–', '’'])} of it" for _ in range(7000)]
    lines = [x for x in lines if not encoding.suspicious(x)]
    model = encoding.train(spark.createDataFrame([(x,) for x in lines], "text string").repartition(3))
    gains, pairs, runs = [], [], {(x[m.start() - 2 : m.start()], m[0], x[m.end() : m.end() + 2]) for x in lines for m in re.finditer(r"[^\x00-\x7f]+", x)}
    assert len(runs) > 2 * encoding.VALIDATION_ROWS
    ends = [("", a[0], a[1] + run + z) for a, run, z in runs if not a[0].isascii()]
    for a, run, z in [*runs, *ends]:
        own = model.score(a, run, z)
        gains += [own - model.score(a, g, z) for e in encoding.ENCODINGS for g in [_garble(run, e)] if encoding.undo_once(g, e) == run != g]
        pairs += [model.score(a, t, z) - own for t, _ in encoding.pair_candidates(run)]
    margin = max(1.0, sorted(gains)[len(gains) // 100] / 2)
    assert model.margin == margin and model.pair_margin == max(0.0, *pairs) + margin
    assert not any(encoding.Repairer(model).repair(x)[0] for x in lines)


def test_contexts_are_handed_on_whatever_is_remembered(monkeypatch):
    monkeypatch.setattr(encoding, "SEEN_CHARS", 30)
    texts = [f"a é{chr(0x3B1 + i % 20)} z" for i in range(200)]
    got = [c for b in encoding._count(pa.RecordBatch.from_pydict({"t": [t]}) for t in texts) for c in b.column(3).to_pylist() if c]
    assert set(got) == {f"a é{chr(0x3B1 + i)} z"[-6:] for i in range(20)}


def test_restoration_of_held_out_text(spark):
    """Clean text garbled on purpose comes back: 0.99 of it exactly."""
    words = "Größe façade naïve “quoted” – the company’s résumé § 4 año coût €5 Überschuß señor".split()
    rng = random.Random(11)
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(400)]
    model = encoding.train(spark.createDataFrame([(x,) for x in lines[:200]], "text string"))
    fix = encoding.Repairer(model)
    cases = [(x, encoding_name) for x in lines[200:] for encoding_name in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")]
    right = sum(fix.repair(_garble(x, e))[1] == x for x, e in cases)
    assert right >= 0.99 * len(cases)
    assert not any(fix.repair(x)[0] for x in lines[200:])


def test_single_byte_read_as_another(spark):
    """Mac Roman read as Windows and the like: most comes back, right text stays."""
    words = "the company’s report – “quoted” naïve Größe § 4 coût and Überschuß of señor".split()
    rng = random.Random(12)
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(400)]
    fix = encoding.Repairer(encoding.train(spark.createDataFrame([(x,) for x in lines[:300]], "text string")))
    wrong = [(x, x.encode("mac_roman").decode("cp1252")) for x in lines[300:]]
    right = [fix.repair(g)[1] for _, g in wrong]
    hit = sum(a == x for a, (x, _) in zip(right, wrong))
    assert hit >= 0.5 * len(wrong), hit
    assert not any(fix.repair(x)[0] for x in lines)
    assert dict(encoding.pair_candidates("Õ"))["’"] == "cp1252<mac_roman"


def test_named_references_with_digits():
    garbled = "M&Atilde;&frac14;ller"
    assert encoding.resolve_references(garbled) == "M\u00c3\u00bcller" and encoding.suspicious(garbled)
    batch = pa.RecordBatch.from_pydict({"t": [garbled]})
    assert list(encoding._count(iter([batch])))[0].num_rows == 0  # no clean text to learn from
    assert not encoding.suspicious("5 m&sup2; &amp; x&y;") and encoding.resolve_references("&amp;&lt;") == "&amp;&lt;"


def test_markup_of_any_length_and_depth():
    from stemma.llm import markup

    assert markup.clean(r"\textbf{\emph{\underline{\textit{\textsc{deep}}}}} x") == ("deep x", "latex")
    assert markup.clean("AT&amp;T <i>x</i> then &lt;b&gt;bold&lt;/b&gt; end")[0] == "AT&T x then bold end"
    assert markup.clean("<div>" * 3000 + "<p>hi there</p>" + "</div>" * 3000)[0] == "hi there"
    assert markup.clean("**" + "a" * 5000 + "** b") == ("a" * 5000 + " b", "markdown")
    assert markup.clean("<title>Only title")[0] == "Only title"
    assert markup.clean("x <script>var x = 1</script>y")[0] == "x y"


def test_the_same_sentence_over_and_over_is_junk(spark):
    sentence = "We paid no dividends in 2013 and don’t plan to pay any before 1996."
    prose = "The company sells goods in many places. It expects that its costs will rise over the next year, and it plans for that."
    docs = spark.createDataFrame([(1, "\n".join([sentence] * 9)), (2, "\n".join([prose, sentence, prose.replace("goods", "seeds"), sentence]))], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in ("the", "in", "and", "it", "to", "that", "we")], "word string")
    assert {r["doc_id"]: r["kind"] for r in quality.assess(docs, words, ["doc_id"]).collect()} == {1: "junk", 2: "prose"}
