"""Queries over filings, blocks, candidates and nodes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import labels as L
from stemma.functions import phrases
from stemma.functions import text as X
from stemma.operators import analytics as A
from stemma.operators import candidates as C
from stemma.operators import profile as P
from stemma.operators import tree as T
from stemma.sources import control
from stemma.sources import manifest as M
from stemma.sources import sgml as S
from stemma.session import materialize, table

DOC = ["accession_number", "sequence"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def _t(spark, d, name):
    return table(spark, d, name).distinct()


# ---------------------------------------------------------------- submissions


@query(r"""WITH h AS (SELECT DISTINCT accession_number, regexp_extract(text, '(?is)<SEC-HEADER>(.*?)</SEC-HEADER>', 1) AS h FROM submissions)
SELECT accession_number, nullif(regexp_replace(regexp_extract(h, '(?i)CENTRAL\s+INDEX\s+KEY:\s*(\d+)', 1), '^0+', ''), '') AS header_cik,
trim(regexp_extract(h, '(?i)COMPANY\s+CONFORMED\s+NAME:\s*([^\r\n<]+)', 1)) AS company,
upper(trim(regexp_extract(h, '(?i)CONFORMED\s+SUBMISSION\s+TYPE:\s*([^\r\n<]+)', 1))) AS form_type FROM h""")
def header_fields(spark, d):
    return S.header_fields(table(spark, d, "submissions").select("accession_number", "text"), ["accession_number"]).distinct()


_SPLIT = r"""s AS (SELECT DISTINCT accession_number, text FROM submissions),
m AS (SELECT accession_number, regexp_extract_all(text, '(?is)<DOCUMENT>.*?</DOCUMENT>') AS ms, string_split_regex(text, '(?is)<DOCUMENT>.*?</DOCUMENT>') AS gs FROM s),
x AS (SELECT accession_number, k - 1 AS block_no, ms[k] AS body, list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda g: length(g))), 0) AS doc_start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m)),
docs AS (SELECT accession_number, block_no::INTEGER AS block_no, body, doc_start::BIGINT AS doc_start, (doc_start + length(body))::BIGINT AS doc_end,
  regexp_extract(body, '(?is)<TEXT>(.*?)</TEXT>', 1) AS payload, instr(lower(body), '<text>') AS t FROM x)"""


@query(rf"""WITH {_SPLIT} SELECT accession_number, block_no, TRY_CAST(nullif(trim(regexp_extract(body, '(?i)<SEQUENCE>\s*([^\r\n<]*)', 1)), '') AS INTEGER) AS sequence,
nullif(trim(regexp_extract(body, '(?i)<TYPE>\s*([^\r\n<]*)', 1)), '') AS doc_type, nullif(trim(regexp_extract(body, '(?i)<FILENAME>\s*([^\r\n<]*)', 1)), '') AS filename,
nullif(trim(regexp_extract(body, '(?i)<DESCRIPTION>\s*([^\r\n<]*)', 1)), '') AS description,
t > 0 AND NOT regexp_matches(payload[:4096], '(?i)^\s*<(XML|PDF)>') AND regexp_matches(payload[:4096], '(?i)<!DOCTYPE\s+HTML|<\s*html\b|content-type[^>]*text/html|<\s*body\b|<\s*div\b|<\s*p\b|<\s*font\b|<ix:|xmlns:ix=') AS is_html,
doc_start, doc_end, CASE WHEN t > 0 THEN doc_start + t + 5 ELSE -1 END::BIGINT AS text_start, CASE WHEN t > 0 THEN doc_start + t + 5 + length(payload) ELSE -1 END::BIGINT AS text_end FROM docs""")
def split_documents(spark, d):
    # Texts stay where they are: copies fall away among the offsets.
    return S.split_documents(table(spark, d, "submissions").select("accession_number", "text"), ["accession_number"]).distinct()


@query(rf"""WITH {_SPLIT} SELECT accession_number, block_no, sha256(payload) AS payload_sha256, length(payload)::BIGINT AS n_chars FROM docs""")
def payload_hashes(spark, d):
    x = S.split_documents(table(spark, d, "submissions").select("accession_number", "text"), ["accession_number"], F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload_sha256"), F.length("payload").cast("long").alias("n_chars"))
    return x.select("accession_number", "block_no", "payload_sha256", "n_chars").distinct()


@query("SELECT DISTINCT accession_number, true AS same_hash, true AS same_size FROM submissions")
def input_hashes(spark, d):
    s = table(spark, d, "submissions").select("accession_number", "text", "input_sha256", "input_bytes")
    raw = F.encode("text", "ISO-8859-1")
    # A character is a byte: the text read as latin-1 gives back the very bytes that were hashed.
    return s.select("accession_number", (F.sha2(raw, 256) == F.col("input_sha256")).alias("same_hash"), (F.length(raw) == F.col("input_bytes")).alias("same_size")).distinct()


@query(r"""WITH b AS (SELECT DISTINCT * FROM document_blocks WHERE text_start >= 0 AND NOT coalesce(regexp_matches(filename, '(?i)\.(pdf|gif|jpg|jpeg|png|xls|xlsx|zip|xml|xsd|json)$'), false)),
f AS (SELECT accession_number, min(submission_type) AS submission_type FROM manifest GROUP BY 1),
x AS (SELECT b.accession_number, b.block_no, b.doc_type, f.submission_type, upper(coalesce(doc_type, '')) AS k, upper(trim(submission_type)) AS st, regexp_replace(upper(trim(submission_type)), '/A$', '') AS bf FROM b JOIN f USING (accession_number)),
y AS (SELECT *, CASE WHEN k = st THEN 0 WHEN k = bf THEN 1 WHEN starts_with(k, CASE WHEN contains(bf, '-') THEN split_part(bf, '-', 1) || '-' || split_part(bf, '-', 2)[:1] ELSE bf END) THEN 2 ELSE 3 END AS match_rank FROM x)
SELECT accession_number, submission_type, block_no, doc_type, match_rank FROM y QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY match_rank, block_no) = 1""")
def primary_documents(spark, d):
    forms = table(spark, d, "manifest").groupBy("accession_number").agg(F.min("submission_type").alias("submission_type"))
    return S.primary_documents(_t(spark, d, "document_blocks"), forms)


_CREDIT = r"""x AS (SELECT DISTINCT accession_number, block_no, doc_type, coalesce(regexp_matches(doc_type, '(?i)^EX-10([^0-9]|$)'), false) AS right_type,
text_start >= 0 AND text_end - text_start >= 60000 AND NOT regexp_matches(coalesce(filename, ''), '(?i)\.(pdf|gif|jpg|jpeg|png|xls|xlsx|zip|xml|xsd|json)$') AS sized,
regexp_matches(coalesce(description, ''), '(?i)\b(credit|loan|term loan|revolving|financing|facilit(y|ies))\b.*\bagreement\b') OR regexp_matches(coalesce(filename, ''), '(?i)credit|loan|facilit') AS named,
NOT regexp_matches(coalesce(filename, ''), '(?i)amend|waiver|joinder|consent|supplement|guarant|pledge|mortgage') AND (NOT regexp_matches(coalesce(description, ''), '(?i)\b(amendment|amended and restated amendment|joinder|waiver|consent|guarant\w*|pledge|security agreement|mortgage|supplement|letter|schedule|exhibit list|commitment)\b')
 OR (regexp_matches(coalesce(description, ''), '(?i)amended\s+and\s+restated') AND NOT regexp_matches(coalesce(description, ''), '(?i)\bamendment\b'))) AS plain FROM document_blocks)"""


@query(f"WITH {_CREDIT} SELECT *, right_type AND sized AND named AND plain AS chosen FROM x")
def credit_tests(spark, d):
    """Every document block with the tests of a credit agreement."""
    return S.credit_tests(_t(spark, d, "document_blocks")).select("accession_number", "block_no", "doc_type", "right_type", "sized", "named", "plain", "chosen").distinct()


@query(f"WITH {_CREDIT} SELECT accession_number, block_no, doc_type FROM x WHERE right_type AND sized AND named AND plain")
def credit_agreements(spark, d):
    return S.credit_agreements(_t(spark, d, "document_blocks")).select("accession_number", "block_no", "doc_type").distinct()


@query(r"""WITH f AS (SELECT accession_number, min(submission_type) AS st FROM manifest GROUP BY 1)
SELECT DISTINCT b.accession_number, b.block_no, CASE WHEN starts_with(upper(coalesce(doc_type, '')), 'EX-') THEN 'contract' WHEN starts_with(replace(upper(coalesce(doc_type, '')), '-', ''), '10Q')
AND NOT starts_with(replace(upper(coalesce(st, '')), '-', ''), '10K') THEN 'form10q' ELSE 'form10k' END AS grammar FROM document_blocks b LEFT JOIN f USING (accession_number)""")
def grammar_routes(spark, d):
    f = table(spark, d, "manifest").groupBy("accession_number").agg(F.min("submission_type").alias("st"))
    b = _t(spark, d, "document_blocks").join(f, "accession_number", "left")
    return b.select("accession_number", "block_no", S.grammar_of(F.col("doc_type"), F.col("st")).alias("grammar")).distinct()


# ---------------------------------------------------------------- manifests

_PRESENT = "p AS (SELECT accession AS accession_number, n_bytes, sha256, fetched_at FROM fetch_log WHERE n_bytes > 0 QUALIFY row_number() OVER (PARTITION BY accession ORDER BY fetched_at DESC, n_bytes DESC NULLS LAST, sha256 DESC NULLS LAST, url DESC NULLS LAST) = 1)"
_ROWS = f"""{_PRESENT}, r AS (SELECT m.*, p.accession_number IS NOT NULL AS present FROM (SELECT DISTINCT * FROM manifest) m LEFT JOIN p USING (accession_number)
QUALIFY row_number() OVER (PARTITION BY m.accession_number ORDER BY p.accession_number IS NOT NULL DESC, TRY_CAST(m.cik AS BIGINT) NULLS LAST, m.cik, m.archive_path) = 1)"""


def _rows(spark, d):
    return M.one_per_filing(table(spark, d, "manifest"), M.present_files(table(spark, d, "fetch_log")))


@query(f"WITH {_PRESENT} SELECT accession_number, n_bytes, sha256, epoch_us(fetched_at) AS fetched_us FROM p")
def fetched_files(spark, d):
    p = M.present_files(table(spark, d, "fetch_log"))
    return p.select("accession_number", "n_bytes", "sha256", F.unix_micros("fetched_at").alias("fetched_us"))


@query(f"WITH {_ROWS} SELECT accession_number, cik, submission_type, year, agent_cik, present FROM r")
def manifest_rows(spark, d):
    return _rows(spark, d).select("accession_number", "cik", "submission_type", "year", "agent_cik", "present")


@query(f"WITH {_ROWS} SELECT accession_number, cik FROM r WHERE NOT present")
def missing_files(spark, d):
    return M.missing_files(_rows(spark, d), M.present_files(table(spark, d, "fetch_log"))).select("accession_number", "cik")


@query("SELECT DISTINCT accession_number, submission_type FROM manifest WHERE submission_type IN ('10-K', '10-K405', '10-KSB', '10-KT', '10-K405T', '10-KSB40', '10-KT405') OR (submission_type LIKE '%/A' AND regexp_replace(submission_type, '/A$', '') IN ('10-K', '10-K405', '10-KSB', '10-KT', '10-K405T', '10-KSB40', '10-KT405'))")
def annual_forms(spark, d):
    return M.select_forms(table(spark, d, "manifest"), M.expand_forms("10-K-family"), include_amendments=True).select("accession_number", "submission_type").distinct()


@query("""WITH l AS (SELECT DISTINCT cik, company_name, accession_number FROM submissions)
SELECT nullif(ltrim(cik, '0'), '') AS cik, company_name || '|Co' AS company, '10-K' AS form, '2005-03-01' AS filed, accession_number AS accession, 2005 AS year FROM l WHERE cik IS NOT NULL AND company_name IS NOT NULL""")
def index_lines(spark, d):
    s = table(spark, d, "submissions").select("cik", "company_name", "accession_number").distinct().where("cik is not null and company_name is not null")
    line = F.concat_ws("|", F.regexp_replace("cik", "^0+", ""), "company_name", F.lit("Co"), F.lit("10-K"), F.lit("2005-03-01"), F.concat(F.lit("edgar/data/1/"), "accession_number", F.lit(".txt")))
    head = s.select(F.explode(F.array(F.lit("Description: Master Index"), F.lit("CIK|Company|Form|Date Filed|Filename"), F.lit("--------"))).alias("value"))
    p = M.parse_index(s.select(line.alias("value")).unionByName(head))
    return p.select("cik", "company", "form", "filed", M.accession_of(F.col("filename")).alias("accession"), M.year_of(F.col("filed")).alias("year"))


@query("SELECT year, q::INTEGER AS quarter, format('https://www.sec.gov/Archives/edgar/full-index/{}/QTR{}/master.idx', year, q) AS url FROM (SELECT DISTINCT year FROM manifest WHERE year IS NOT NULL) y, (SELECT unnest([1, 2, 3, 4]) AS q) z")
def index_urls(spark, d):
    return M.index_urls(table(spark, d, "manifest"))


@query(f"""WITH {_ROWS}, c AS (SELECT year, agent_cik, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, agent_cik) AS k FROM r GROUP BY year, agent_cik),
x AS (SELECT r.year, r.accession_number, coalesce(CASE WHEN c.k <= 3 THEN c.agent_cik END, 'other') AS cell FROM r LEFT JOIN c ON c.year = r.year AND c.agent_cik = r.agent_cik),
y AS (SELECT *, row_number() OVER (PARTITION BY year, cell ORDER BY accession_number) - 1 AS i, count(*) OVER (PARTITION BY year, cell) AS n FROM x)
SELECT year, cell, accession_number FROM y WHERE n <= 2 OR i IN (0, n // 2)""")
def stratified_sample(spark, d):
    return M.stratify(_rows(spark, d)).select("year", "cell", "accession_number")


# ---------------------------------------------------------------- profiles


def _payloads(spark, d):
    """Document blocks with their payload, cut where the submission is read; blocks of copies come again."""
    return S.split_documents(table(spark, d, "submissions").select("accession_number", "text"), ["accession_number"], F.coalesce("payload", F.lit("")).alias("payload"))


def _owners(spark, d):
    return table(spark, d, "submissions").groupBy("accession_number").agg(F.max("cik").alias("cik"), F.max("company_name").alias("company"))


@query(rf"""WITH {_SPLIT} SELECT accession_number, block_no, len(regexp_extract_all(payload, '(?i)<font\b'))::INTEGER AS font_tag, len(regexp_extract_all(payload, '(?i)<div\b'))::INTEGER AS div_tag,
len(regexp_extract_all(payload, '(?i)<td\b'))::INTEGER AS td_tag, len(regexp_extract_all(payload, '(?i)<PAGE>'))::INTEGER AS page_mark, len(regexp_extract_all(payload, '(?i)<img\b'))::INTEGER AS img_tag,
len(regexp_extract_all(payload, '(?i)<hr\b'))::INTEGER AS hr_tag, len(regexp_extract_all(payload, '(?i)Regulation\s+AB|Item\s+11\d\d\b|General Instruction J|as the Depositor|Issuing Entity|Servicing Criteria|Asset[- ]Backed'))::INTEGER AS reg_ab FROM docs""")
def signal_counts(spark, d):
    return P.signals(_payloads(spark, d), ["accession_number", "block_no"]).select("accession_number", "block_no", "font_tag", "div_tag", "td_tag", "page_mark", "img_tag", "hr_tag", "reg_ab").distinct()


def _profile_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(payload, '(?i){p.replace(chr(39), chr(39) * 2)}'))"
    few = ["workiva_comment", "activedisclosure_comment", "toppan_bridge_comment", "compsci_comment", "bowne_link2", "hidden_white_text", "font_tag", "div_tag", "img_tag"]
    counts = ", ".join(f"{n(P.SIGNALS[k])} AS {k}" for k in few)
    words = " + ".join(f"len(regexp_extract_all(payload[:{P.ABS_WINDOW}], '(?i){p}'))" for p in P.ABS_WORDS)
    family = " ".join(f"WHEN agent IN ({', '.join(repr(a) for a in members)}) THEN '{name}'" for name, members in reversed(P.AGENTS.items()))
    return rf"""WITH {_SPLIT}, o AS (SELECT accession_number, max(cik) AS cik, max(company_name) AS company FROM submissions GROUP BY 1),
g AS (SELECT accession_number, block_no, substr(accession_number, 1, 10) AS agent, t > 0 AND NOT regexp_matches(payload[:4096], '(?i)^\s*<(XML|PDF)>') AND regexp_matches(payload[:4096], '{S.HTML_SIGN}|<ix:|xmlns:ix=') AS html,
regexp_matches(payload[:{S.IX_CHARS}], '{S.IX_SIGN}') AS ix, {counts}, {words} AS abs_words FROM docs),
f AS (SELECT g.*, company, CASE {family} WHEN TRY_CAST(agent AS BIGINT) = TRY_CAST(cik AS BIGINT) THEN 'self' ELSE 'other' END AS family FROM g LEFT JOIN o USING (accession_number)),
p AS (SELECT *, CASE WHEN workiva_comment > 0 THEN 'workiva' WHEN activedisclosure_comment > 0 THEN 'activedisclosure' WHEN toppan_bridge_comment > 0 THEN 'toppan_bridge' WHEN compsci_comment > 0 THEN 'compsci'
WHEN bowne_link2 > 0 AND family IN ('self', 'other') THEN 'bowne' ELSE family END AS publisher FROM f)
SELECT DISTINCT accession_number, block_no, agent AS agent_cik, publisher, CASE WHEN NOT html THEN 'text' WHEN hidden_white_text >= 3 AND img_tag >= 3 THEN 'image_text' WHEN ix THEN 'ixbrl'
WHEN publisher IN ('self', 'other') THEN CASE WHEN font_tag > div_tag THEN 'html_early' ELSE 'html_generic' END ELSE 'html_publisher' END AS era,
abs_words >= 2 OR coalesce(regexp_matches(company, '(?i){P.ABS_NAME}'), false) AS is_abs FROM p"""


@query(_profile_sql())
def profiles(spark, d):
    return P.profiles(_payloads(spark, d), _owners(spark, d))


@query(r"""WITH t AS (SELECT accession_number, max(text) AS text FROM submissions GROUP BY 1),
n AS (SELECT DISTINCT n.accession_number, n.sequence, node_id, substr(text, (raw_start + 1)::BIGINT, greatest(raw_end - raw_start, 0)::BIGINT) AS span FROM nodes n JOIN t USING (accession_number) WHERE level_kind = 'item'),
x AS (SELECT accession_number, sequence, node_id, trim(regexp_replace(regexp_replace(span, '<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')) AS t FROM n),
y AS (SELECT *, length(t) < 4096 AS short, regexp_matches(t, '(?i)incorporated(.|\n){0,80}?by\s+reference|incorporated\s+herein|by\s+reference\s+to') AS ref, regexp_matches(t, '(?i)exhibit\s+(no\.?\s*)?13\b') AS ex,
regexp_matches(regexp_replace(t, '(?i)(this|of\s+this|in\s+this)\s+annual\s+report|annual\s+report\s+(on|in)\s+form\s+10-?k', ' ', 'g'), '(?i)annual\s+report') AS ar,
regexp_matches(t, '(?i)\bF-\d|index\s+to\s+(the\s+)?(consolidated\s+)?financial\s+statements|item\s+1[45]\b|(this|of\s+this|in\s+this)\s+(annual\s+)?report\s+on\s+form\s+10-?k|follow(s|ing)\s+the\s+signature|elsewhere\s+(in|herein)') AS ip FROM x)
SELECT accession_number, sequence, node_id, CASE WHEN short THEN ref AND (ex OR ar) END AS by_reference, CASE WHEN short AND ref AND (ex OR ar) THEN CASE WHEN ex THEN 'ex13' ELSE 'annual_report' END END AS target,
CASE WHEN short THEN NOT (ref AND (ex OR ar)) AND (ref OR ip) END AS cross_reference FROM y""")
def stub_flags(spark, d):
    t = table(spark, d, "submissions").groupBy("accession_number").agg(F.max("text").alias("text"))
    n = table(spark, d, "nodes").where("level_kind = 'item'").select(*DOC, "node_id", "raw_start", "raw_end").distinct().join(t, "accession_number")
    size = F.greatest(F.col("raw_end") - F.col("raw_start"), F.lit(0))
    n = n.withColumn("span", F.substr("text", (F.col("raw_start") + 1).cast("int"), size.cast("int")))
    return P.stub_flags(n, [*DOC, "node_id"])


# ---------------------------------------------------------------- text


@query(rf"""WITH {_SPLIT}, l AS (SELECT accession_number, block_no, string_split(payload, chr(10)) AS ls FROM docs)
SELECT accession_number, block_no, (k - 1)::INTEGER AS line_no, (coalesce(list_sum(list_transform(ls[1:k-1], lambda x: length(x) + 1)), 0))::INTEGER AS line_start, length(ls[k])::INTEGER AS line_length FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM l)""")
def line_offsets(spark, d):
    return X.line_rows(_payloads(spark, d), ["accession_number", "block_no"], "payload").distinct()


@query(rf"""WITH {_SPLIT}, l AS (SELECT accession_number, block_no, list_sort(list_filter(list_transform(string_split(payload, chr(10)), lambda x: length(rtrim(x))), lambda n: n >= 50)) AS n FROM docs)
SELECT accession_number, block_no, CASE WHEN len(n) = 0 THEN 80 ELSE greatest(70, n[len(n) // 2 + 1] + 2) END::INTEGER AS width FROM l""")
def page_widths(spark, d):
    n = F.sort_array(F.filter(F.transform(F.split("payload", "\n", -1), lambda x: F.length(F.rtrim(x))), lambda k: k >= 50))
    mid = F.try_element_at(n, (F.floor(F.size(n) / 2) + 1).cast("int"))
    return _payloads(spark, d).select("accession_number", "block_no", F.when(F.size(n) == 0, 80).otherwise(F.greatest(F.lit(70), mid + 2)).cast("int").alias("width")).distinct()


@query(r"""SELECT DISTINCT accession_number, sequence, idx, length(text)::INTEGER AS n_chars, len(string_split(text, chr(10)))::INTEGER AS n_lines,
CASE WHEN length(regexp_replace(text, '[^\pL]', '', 'g')) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\pL]', '', 'g')), 6) END::DOUBLE AS caps FROM blocks WHERE text IS NOT NULL""")
def block_shapes(spark, d):
    b = table(spark, d, "blocks").where("text is not null")
    return b.select(*DOC, "idx", F.length("text").alias("n_chars"), F.size(F.split("text", "\n", -1)).alias("n_lines"), F.round(X.caps_ratio(F.col("text")), 6).alias("caps")).distinct()


@query(r"""SELECT DISTINCT accession_number, sequence, cand_no, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(title, '(?s)((\.\s?){4,}|(_\s?){4,}).*$', ''), '[ \t\r\n\f]+', ' ', 'g')), '^[ .:;,\-–—*]+', ''), '[ .:;,\-–—*]+$', '') AS title,
lower(trim(regexp_replace(title, '[ \t\r\n\f]+', ' ', 'g'))) AS plain FROM candidates WHERE title IS NOT NULL""")
def clean_titles(spark, d):
    c = table(spark, d, "candidates").where("title is not null")
    return c.select(*DOC, "cand_no", X.clean_title(F.col("title")).alias("title"), X.norm_title(F.col("title")).alias("plain")).distinct()


@query(r"""WITH b AS (SELECT DISTINCT accession_number, sequence, idx, text FROM blocks WHERE text IS NOT NULL),
m AS (SELECT *, regexp_extract_all(text, '\d+(\.\d+)?%') AS ms, string_split_regex(text, '\d+(\.\d+)?%') AS gs FROM b)
SELECT accession_number, sequence, idx, ms[k] AS hit, (list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda g: length(g))), 0))::INTEGER AS hit_start FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m)""")
def match_offsets(spark, d):
    hits = X.match_rows(table(spark, d, "blocks"), [*DOC, "idx"], "text", r"\d+(?:\.\d+)?%")
    return hits.select(*DOC, "idx", F.col("match").alias("hit"), F.col("start").alias("hit_start")).distinct()


# ---------------------------------------------------------------- labels

_KEY = r"""CASE WHEN label_canon LIKE 'PART %' THEN list_position(['I', 'II', 'III', 'IV', 'V'], label_canon[6:]) WHEN label_canon LIKE 'ARTICLE %' THEN TRY_CAST(label_canon[9:] AS INTEGER)
WHEN label_canon LIKE 'ITEM %' THEN CASE WHEN label_canon LIKE 'ITEM II.%' THEN 100 ELSE 0 END + TRY_CAST(regexp_extract(label_canon, '(\d+)[A-C]?$', 1) AS INTEGER) * 10 + CASE right(label_canon, 1) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 0 END
WHEN label_canon LIKE 'SECTION %' THEN TRY_CAST(split_part(label_canon[9:], '.', 1) AS INTEGER) * 10000 + coalesce(TRY_CAST(split_part(label_canon[9:], '.', 2) AS INTEGER), 0) * 100 + coalesce(TRY_CAST(split_part(label_canon[9:], '.', 3) AS INTEGER), 0) END"""


@query(f"SELECT DISTINCT label_canon, ({_KEY})::INTEGER AS order_key FROM (SELECT label_canon FROM nodes UNION SELECT label_canon FROM label_reference) WHERE label_canon IS NOT NULL")
def label_order_keys(spark, d):
    x = table(spark, d, "nodes").select("label_canon").union(table(spark, d, "label_reference").select("label_canon")).where("label_canon is not null").distinct()
    return x.select("label_canon", L.order_key(F.col("label_canon")).alias("order_key"))


# Labels without what is set before them; the keyword's letters drawn together.
_PRINTED = r"""WITH c AS (SELECT DISTINCT kind, label_raw, upper(ltrim(translate(regexp_replace(label_raw, '[\s\pZ]', ' ', 'g'), '０１２３４５６７８９', '0123456789'), ' "''([*•-')) AS t FROM candidates WHERE label_raw IS NOT NULL AND kind IN ({kinds})),
k AS (SELECT *, regexp_replace(t, '^([A-Z])\s?([A-Z])\s?([A-Z])\s?([A-Z])', '\1\2\3\4') AS four, regexp_replace(t, '^([A-Z])\s?([A-Z])\s?([A-Z])\s?([A-Z])\s?([A-Z])\s?([A-Z])\s?([A-Z])', '\1\2\3\4\5\6\7') AS seven FROM c)"""
_ROMANS = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII', 'XIX', 'XX', 'XXI', 'XXII', 'XXIII', 'XXIV', 'XXV', 'XXVI', 'XXVII', 'XXVIII', 'XXIX', 'XXX', 'XXXI', 'XXXII', 'XXXIII', 'XXXIV', 'XXXV', 'XXXVI', 'XXXVII', 'XXXVIII', 'XXXIX', 'XL']"
_WORDS = str(L.WORDS)


def _printed(spark, d, *kinds):
    c = table(spark, d, "candidates").where(F.col("label_raw").isNotNull() & F.col("kind").isin(*kinds)).select("kind", "label_raw").distinct()
    return C.printed_names(c)


@query(_PRINTED.format(kinds="'part', 'section'") + r""", n AS (SELECT *, regexp_extract(four, '^PART\s+([A-Z]+|[0-9])(\s*[.:,–—-]|\s|$)', 1) AS w, regexp_replace(regexp_replace(seven, '^SECTION\s+', '§'), '^§\s*', '§') AS s FROM k),
m AS (SELECT *, regexp_extract(s, '^(§?)([0-9]{1,2})((\.[0-9]{1,2})?)((\.[0-9]{1,2})?)([^0-9%].*)?$', ['mark', 'a', 'b', 'b2', 'c', 'c2', 'rest']) AS x FROM n)
SELECT kind, label_raw, CASE kind WHEN 'part' THEN 'PART ' || ['I', 'II', 'III', 'IV'][coalesce(TRY_CAST(w AS INTEGER), list_position(['I', 'II', 'III', 'IV'], w), list_position(['ONE', 'TWO', 'THREE', 'FOUR'], w))]
WHEN 'section' THEN CASE WHEN TRY_CAST(x.a AS INTEGER) BETWEEN 1 AND 40 AND regexp_matches(x.rest, '^(\s*[.:–—-]+|\s+|[A-Z"“]|$)')
THEN CASE WHEN x.b <> '' THEN 'SECTION ' || TRY_CAST(x.a AS INTEGER) || '.' || lpad(TRY_CAST(x.b[2:] AS INTEGER)::VARCHAR, 2, '0') || x.c WHEN x.mark = '§' AND NOT regexp_matches(x.rest, '^\s*[.:–—-]*\s*[0-9(]') THEN 'SECTION ' || TRY_CAST(x.a AS INTEGER) END END END AS label FROM m""")
def printed_labels(spark, d):
    return _printed(spark, d, "part", "section")


@query(_PRINTED.format(kinds="'item', 'article'") + rf""", n AS (SELECT *, regexp_extract(seven, '^ARTICLE\s+([A-Z]+|[0-9]{{1,2}})(\s*[.:–—-]|\s|$)', 1) AS w, CASE WHEN starts_with(four, 'ITEM') THEN regexp_replace(regexp_replace(four[5:], '^S', ''), '^\s*NO\.?', ' ') END AS r FROM k),
m AS (SELECT *, regexp_extract(r, '^\s*([0-9]+|[A-Z]+)', 1) AS num, regexp_replace(r, '^\s*([0-9]+|[A-Z]+)', '') AS tail FROM n),
v AS (SELECT *, CASE WHEN regexp_matches(num, '^[0-9]+$') THEN TRY_CAST(num AS INTEGER) WHEN list_position({_ROMANS}[1:16], num) > 0 THEN list_position({_ROMANS}[1:16], num) WHEN regexp_matches(r, '^\s') THEN list_position({_WORDS}[1:16], num) END AS val,
regexp_extract(tail, '^\s*(\.\s*)?([A-C])([^\pL\pN_]|$)', 2) AS suf, coalesce(try_cast(w AS INTEGER), list_position({_ROMANS}, w), list_position({_WORDS}, w)) AS art FROM m),
z AS (SELECT *, CASE WHEN suf <> '' THEN regexp_replace(tail, '^\s*(\.\s*)?[A-C]', '') ELSE tail END AS rest FROM v),
y AS (SELECT *, 'ITEM ' || val || suf AS name, regexp_matches(regexp_replace(rest, '^\s*\([A-Z]\)', ''), '^(\s*[.:,;)–—-]+|\s+|$)') AS ends FROM z)
SELECT kind, label_raw, CASE WHEN kind = 'article' THEN CASE WHEN art BETWEEN 1 AND 40 THEN 'ARTICLE ' || art END
WHEN length(num) <= 4 AND val >= 1100 AND regexp_matches(regexp_replace(tail, '^\([A-Z]\)(\([0-9]+\))?', ''), '^(\s*[.:,;)–—-]+|\s+|$)') AND val::VARCHAR IN ({", ".join(repr(x) for x in L.ITEMS_REGAB)}) THEN 'ITEM ' || val
WHEN ends AND val::VARCHAR || suf IN ({", ".join(repr(x) for x in L.ITEMS_10K)}) AND (num !~ '^[0-9]+$' OR length(num) <= 2) THEN name END AS label FROM y""")
def printed_items(spark, d):
    return _printed(spark, d, "item", "article")


@query(r"""SELECT DISTINCT y.year::INTEGER AS year, array_to_string(list_sort(list_filter(['1','2','3','4','5','6','7','8','9','10','11','12','13','14'] || CASE WHEN y.year >= 1998 THEN ['7A'] ELSE [] END || CASE WHEN y.year >= 2004 THEN ['15'] ELSE [] END
|| CASE WHEN y.year >= 2006 THEN ['1A','1B'] ELSE [] END || CASE WHEN y.year >= 2008 THEN ['9A'] ELSE [] END || CASE WHEN y.year >= 2010 THEN ['9B'] ELSE [] END || CASE WHEN y.year >= 2024 THEN ['1C','9C'] ELSE [] END, lambda x: true)), ',') AS items FROM manifest y WHERE y.year IS NOT NULL""")
def expected_items(spark, d):
    y = table(spark, d, "manifest").select(F.col("year").cast("int").alias("year")).where("year is not null").distinct()
    return y.select("year", F.array_join(F.array_sort(L.expected_items(F.col("year"))), ",").alias("items"))


@query(r"""WITH c AS (SELECT DISTINCT regexp_extract(label_raw, '^\s*\(([a-zA-Z]{1,2}|[ivxlIVXL]{1,6}|\d{1,2})\)', 1) AS m FROM candidates WHERE starts_with(kind, 'clause') AND label_raw IS NOT NULL)
SELECT m AS marker, TRY_CAST(m AS INTEGER) AS num, CASE WHEN regexp_matches(m, '^[a-z]$') THEN ascii(m) - 96 WHEN regexp_matches(m, '^[a-z]{2}$') AND m[1] = m[2] THEN ascii(m) - 70 END::INTEGER AS alpha,
CASE WHEN regexp_matches(m, '^[A-Z]$') THEN ascii(m) - 64 WHEN regexp_matches(m, '^[A-Z]{2}$') AND m[1] = m[2] THEN ascii(m) - 38 END::INTEGER AS upper_alpha,
list_position(['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx','xxi','xxii','xxiii','xxiv','xxv','xxvi','xxvii','xxviii','xxix','xxx'], m)::INTEGER AS roman FROM c WHERE m <> '' AND m NOT IN ('l', 'c', 'd', 'm')""")
def clause_values(spark, d):
    c = table(spark, d, "candidates").where("startswith(kind, 'clause') and label_raw is not null").select(F.regexp_extract("label_raw", r"^\s*\(([a-zA-Z]{1,2}|[ivxlIVXL]{1,6}|\d{1,2})\)", 1).alias("marker")).distinct()
    m = F.col("marker")
    return c.where("marker <> '' and marker not in ('l', 'c', 'd', 'm')").select(
        "marker", L.clause_value(m, "num").alias("num"), L.clause_value(m, "alpha").cast("int").alias("alpha"), L.clause_value(m, "upper").cast("int").alias("upper_alpha"), L.clause_value(m, "roman").cast("int").alias("roman")
    )


@query("""SELECT DISTINCT ref_id, label_canon, CASE WHEN starts_with(label_canon, 'ITEM II.') THEN 'PART II' WHEN starts_with(label_canon, 'ITEM I.') THEN 'PART I' WHEN label_canon IN ('ITEM 1', 'ITEM 1A', 'ITEM 1B', 'ITEM 1C', 'ITEM 2', 'ITEM 3', 'ITEM 4') THEN 'PART I'
WHEN regexp_matches(label_canon, '^ITEM (5|6|7|7A|8|9|9A|9B|9C)$') THEN 'PART II' WHEN regexp_matches(label_canon, '^ITEM 1[0-4]$') THEN 'PART III' WHEN regexp_matches(label_canon, '^ITEM 1[56]$') THEN 'PART IV' ELSE 'PART V' END AS part FROM label_reference WHERE level_kind = 'item'""")
def parts_of_items(spark, d):
    r = table(spark, d, "label_reference").where("level_kind = 'item'").select("ref_id", "label_canon").distinct()
    return r.select("ref_id", "label_canon", L.part_of_item(F.col("label_canon"), F.lit(True)).alias("part"))


# ---------------------------------------------------------------- candidates


@query("""WITH b AS (SELECT DISTINCT accession_number, sequence, idx, text, bold, underline, caps_ratio, center, font_size_rel, blank_before, preceding_comment, in_table FROM blocks),
f AS (SELECT *, coalesce(bold, false) AS f1, coalesce(underline, false) AS f2, coalesce(caps_ratio >= 0.85 AND length(split_part(text, chr(10), 1)) >= 6, false) AS f3, coalesce(center, false) AS f4, coalesce(font_size_rel > 1.05, false) AS f5,
coalesce(len(string_split(text, chr(10))) <= 3 AND length(text) <= 220, false) AS f6, coalesce(in_table, false) AS f7, coalesce(regexp_matches(preceding_comment, '(?i)item|part'), false) AS f8 FROM b)
SELECT accession_number, sequence, idx, round(0.5 + coalesce(blank_before, false)::INT * 0.05 + f1::INT * 0.15 + f2::INT * 0.15 + f3::INT * 0.15 + f4::INT * 0.05 + f5::INT * 0.1 + f6::INT * 0.1 - f7::INT * 0.1 + f8::INT * 0.2, 3)::DOUBLE AS style_score,
concat_ws(' ', CASE WHEN f1 THEN 'sty.bold' END, CASE WHEN f2 THEN 'sty.underline' END, CASE WHEN f3 THEN 'sty.caps' END, CASE WHEN f4 THEN 'sty.center' END, CASE WHEN f5 THEN 'sty.font_size' END, CASE WHEN f6 THEN 'pos.short_block' END,
CASE WHEN f7 THEN 'pos.in_table' END, CASE WHEN f8 THEN 'pub.comment_marker' END) AS style_rules FROM f""")
def style_scores(spark, d):
    cols = [*DOC, "idx", "text", "bold", "underline", "caps_ratio", "center", "font_size_rel", "blank_before", "preceding_comment", "in_table"]
    return C.style_scores(table(spark, d, "blocks").select(*cols).distinct(), [*DOC, "idx"])


_C = "c AS (SELECT DISTINCT * FROM candidates)"


@query(f"""WITH {_C}, k AS (SELECT *, upper(trim(label_raw)) AS l FROM c WHERE label_raw IS NOT NULL)
SELECT accession_number, sequence, cand_no, last_at FROM (SELECT *, max(head_raw_start) OVER (PARTITION BY accession_number, sequence, kind, l) AS last_at FROM k) WHERE last_at > head_raw_start""")
def copies_later(spark, d):
    return C.copies_later(_t(spark, d, "candidates"), F.upper(F.trim("label_raw"))).select(*DOC, "cand_no", "last_at")


@query(f"""WITH {_C} SELECT accession_number, sequence, cand_no FROM (SELECT *, count(*) OVER (PARTITION BY accession_number, sequence, kind, upper(trim(label_raw))) AS n FROM c WHERE label_raw IS NOT NULL) WHERE n = 1""")
def sole_copies(spark, d):
    return C.sole_copies(_t(spark, d, "candidates"), F.upper(F.trim("label_raw"))).select(*DOC, "cand_no")


@query(f"""WITH {_C} SELECT accession_number, sequence, cand_no, copy_no::INTEGER AS copy_no FROM (SELECT *, row_number() OVER (PARTITION BY accession_number, sequence, kind, upper(trim(label_raw)), lower(trim(regexp_replace(title, '[ \\t\\r\\n\\f]+', ' ', 'g'))) ORDER BY head_raw_start, cand_no) AS copy_no
FROM c WHERE label_raw IS NOT NULL AND title IS NOT NULL) WHERE copy_no > 1""")
def page_repeats(spark, d):
    return C.page_repeats(_t(spark, d, "candidates"), X.norm_title(F.col("title"))).select(*DOC, "cand_no", "copy_no")


_RUNS = f"""{_C}, o AS (SELECT *, coalesce(block_idx - lag(block_idx) OVER w > 4, true)::INT AS opens FROM c WINDOW w AS (PARTITION BY accession_number, sequence ORDER BY block_idx, cand_no)),
q AS (SELECT *, sum(opens) OVER (PARTITION BY accession_number, sequence ORDER BY block_idx, cand_no ROWS UNBOUNDED PRECEDING) AS run FROM o),
runs AS (SELECT accession_number, sequence, run::BIGINT AS run, min(block_idx) AS first_block, max(block_idx) AS last_block, count(*) AS n_members, round(avg(coalesce(toc_hint, false)::INT), 6) AS hint_share FROM q GROUP BY 1, 2, 3)"""


@query(f"WITH {_RUNS} SELECT * FROM runs")
def candidate_runs(spark, d):
    return C.runs(_t(spark, d, "candidates"))


@query(f"WITH {_RUNS} SELECT * FROM runs WHERE n_members >= 4 AND hint_share >= 0.5")
def contents_regions(spark, d):
    return C.contents_regions(_t(spark, d, "candidates"))


@query(f"""WITH {_RUNS} SELECT c.accession_number, c.sequence, c.cand_no FROM c JOIN (SELECT * FROM runs WHERE n_members >= 4 AND hint_share >= 0.5) r
ON r.accession_number = c.accession_number AND r.sequence = c.sequence AND c.block_idx BETWEEN r.first_block AND r.last_block""")
def candidates_in_contents(spark, d):
    c = _t(spark, d, "candidates")
    r = C.contents_regions(c).select(*DOC, "first_block", (F.col("last_block") + 1).alias("past"))
    return T.containing(c.select(*DOC, "cand_no", "block_idx"), r, DOC, "block_idx", "first_block", "past").select(*DOC, "cand_no")


@query(f"""WITH {_C}, x AS (SELECT *, first_value(cand_no) OVER w AS first_cand, first_value(score) OVER w AS s0 FROM c WHERE order_key IS NOT NULL AND score IS NOT NULL WINDOW w AS (PARTITION BY accession_number, sequence, kind, order_key ORDER BY head_raw_start, cand_no))
SELECT accession_number, sequence, kind, order_key, first_cand, cand_no, round(score::DOUBLE - s0::DOUBLE, 6) AS gain FROM x WHERE cand_no <> first_cand AND round(score::DOUBLE - s0::DOUBLE, 6) >= 0.3""")
def strong_duplicates(spark, d):
    return C.strong_duplicates(_t(spark, d, "candidates"))


@query(f"""WITH {_C}, x AS (SELECT *, upper(trim(label_raw)) AS label FROM c WHERE label_raw IS NOT NULL AND kind IN ('item', 'part', 'article')),
n AS (SELECT DISTINCT accession_number, sequence, upper(trim(label_raw)) AS label FROM nodes WHERE label_raw IS NOT NULL)
SELECT accession_number, sequence, label, cand_no, round(score::DOUBLE, 6) AS score FROM x ANTI JOIN n USING (accession_number, sequence, label) QUALIFY row_number() OVER (PARTITION BY accession_number, sequence, label ORDER BY score DESC NULLS LAST, head_raw_start, cand_no) = 1""")
def best_unclaimed(spark, d):
    return C.best_unclaimed(_t(spark, d, "candidates"), table(spark, d, "nodes"))


@query(None)
def item_chains(spark, d):
    c = _t(spark, d, "candidates").where("kind = 'item' and not coalesce(toc_hint, false)").select(*DOC, "cand_no", "kind", "order_key", "score", "head_raw_start")
    return T.pick_chains(c, DOC, ["head_raw_start", "cand_no"], "order_key", "score").select(*DOC, "cand_no", "chosen")


# ---------------------------------------------------------------- trees

_N = "n AS (SELECT DISTINCT accession_number, sequence, node_id, parent_id, depth::INT AS depth, level_kind, label_canon, label_raw, grammar, cik, raw_start, raw_end, head_raw_start, segment::INT AS segment, meta::INT AS meta, path FROM nodes)"


def _nodes(spark, d):
    return table(spark, d, "nodes").withColumn("depth", F.col("depth").cast("int")).withColumn("segment", F.col("segment").cast("int")).withColumn("meta", F.col("meta").cast("int")).distinct()


@query(f"""WITH {_N} SELECT a.accession_number, a.sequence, a.node_id, coalesce(min(b.raw_start), max(e.top)) AS span_end FROM n a JOIN (SELECT accession_number, sequence, max(raw_end) AS top FROM n GROUP BY 1, 2) e ON e.accession_number = a.accession_number AND e.sequence = a.sequence
LEFT JOIN n b ON b.accession_number = a.accession_number AND b.sequence = a.sequence AND b.raw_start > a.raw_start AND b.depth <= a.depth GROUP BY 1, 2, 3""")
def span_ends(spark, d):
    n = _nodes(spark, d)
    top = n.groupBy(*DOC).agg(F.max("raw_end").alias("top"))
    return T.span_ends(n.join(top, DOC), DOC, "raw_start", "depth", "top").select(*DOC, "node_id", "span_end")


@query(f"""WITH {_N}, o AS (SELECT *, row_number() OVER (PARTITION BY accession_number, sequence ORDER BY raw_start, node_id) AS k FROM n)
SELECT a.accession_number, a.sequence, a.node_id, coalesce(arg_max(b.node_id, b.k), -1)::INTEGER AS found_parent FROM o a LEFT JOIN o b ON b.accession_number = a.accession_number AND b.sequence = a.sequence AND b.k < a.k AND b.depth < a.depth GROUP BY 1, 2, 3""")
def parents_by_depth(spark, d):
    return T.parents_by_depth(_nodes(spark, d), DOC, ["raw_start", "node_id"], "depth", "node_id").select(*DOC, "node_id", "found_parent")


@query(f"WITH {_N} SELECT accession_number, sequence, node_id, row_number() OVER (PARTITION BY accession_number, sequence, parent_id, segment ORDER BY raw_start, node_id)::INTEGER AS ordinal FROM n")
def sibling_ordinals(spark, d):
    return T.sibling_ordinals(_nodes(spark, d), DOC, "parent_id", ["raw_start", "node_id"], "segment").select(*DOC, "node_id", "ordinal")


@query(f"WITH {_N} SELECT accession_number, sequence, node_id, CASE WHEN path IS NOT NULL THEN array_to_string(path, '.') END AS path_text, CASE WHEN path IS NOT NULL THEN len(path) END::INTEGER AS slots FROM n")
def path_strings(spark, d):
    n = _nodes(spark, d)
    return n.select(*DOC, "node_id", T.path_string().alias("path_text"), F.when(F.col("path").isNotNull(), F.size("path")).alias("slots"))


@query(f"""WITH {_N} SELECT accession_number, sequence, depth, level_kind AS modal_kind, c AS n_modal, t::BIGINT AS n_nodes FROM (SELECT *, sum(c) OVER (PARTITION BY accession_number, sequence, depth) AS t, row_number() OVER (PARTITION BY accession_number, sequence, depth ORDER BY c DESC, level_kind NULLS LAST) AS r
FROM (SELECT accession_number, sequence, depth, level_kind, count(*) AS c FROM n GROUP BY 1, 2, 3, 4)) WHERE r = 1""")
def level_profiles(spark, d):
    return T.level_profile(_nodes(spark, d), DOC, "depth", "level_kind")


@query(f"""WITH {_N}, b AS (SELECT accession_number, sequence, (max(raw_end) * 0.9)::BIGINT AS back_start FROM n GROUP BY 1, 2)
SELECT n.accession_number, n.sequence, node_id, CASE WHEN raw_start < back_start AND raw_end > back_start THEN back_start ELSE raw_end END AS cut_end FROM n JOIN b USING (accession_number, sequence)""")
def truncated_spans(spark, d):
    n = _nodes(spark, d)
    b = n.groupBy(*DOC).agg(F.round(F.max("raw_end") * F.lit(0.9)).cast("long").alias("back_start"))
    return T.truncate_spans(n, b, DOC).select(*DOC, "node_id", "cut_end")


@query(f"""WITH {_N}, p AS (SELECT accession_number, sequence, raw_start, max(label_canon) AS part FROM n WHERE level_kind = 'part' AND label_canon IS NOT NULL GROUP BY 1, 2, 3)
SELECT i.accession_number, i.sequence, i.node_id, arg_max(p.part, p.raw_start) AS part_before FROM n i LEFT JOIN p ON p.accession_number = i.accession_number AND p.sequence = i.sequence AND p.raw_start <= i.raw_start WHERE i.level_kind = 'item' GROUP BY 1, 2, 3""")
def part_context(spark, d):
    n = _nodes(spark, d)
    items = n.where("level_kind = 'item'").select(*DOC, "node_id", "raw_start")
    parts = n.where("level_kind = 'part' and label_canon is not null").select(*DOC, "raw_start", F.col("label_canon").alias("part"))
    return T.latest_before(items, parts, DOC, "raw_start", "raw_start", "part").select(*DOC, "node_id", "part_before")


@query(f"""WITH {_N}, b AS (SELECT DISTINCT accession_number, sequence, idx, raw_start AS s, raw_end AS e FROM blocks)
SELECT n.accession_number, n.sequence, n.node_id, arg_min(b.idx, ((NOT (n.head_raw_start >= b.s AND n.head_raw_start < b.e))::INT * 1000000000::BIGINT + b.s) * 1000000 + b.idx) AS near_id FROM n JOIN (SELECT DISTINCT accession_number, sequence FROM b) k USING (accession_number, sequence)
LEFT JOIN b ON b.accession_number = n.accession_number AND b.sequence = n.sequence AND ((n.head_raw_start >= b.s AND n.head_raw_start < b.e) OR (b.s >= n.head_raw_start AND b.s <= n.head_raw_start + 400)) GROUP BY 1, 2, 3""")
def nearest_blocks(spark, d):
    b = table(spark, d, "blocks").select(*DOC, "idx", F.col("raw_start").alias("s"), F.col("raw_end").alias("e")).distinct()
    n = _nodes(spark, d).select(*DOC, "node_id", "head_raw_start").join(b.select(*DOC).distinct(), DOC)
    return T.nearest_ahead(n, b, DOC, "head_raw_start", "s", "e", "idx").select(*DOC, "node_id", "near_id")


# ---------------------------------------------------------------- analytics

_YEARS = "y AS (SELECT accession_number, min(year)::INTEGER AS filed_year FROM manifest GROUP BY 1)"


def _years(spark, d):
    return table(spark, d, "manifest").groupBy("accession_number").agg(F.min("year").cast("int").alias("filed_year"))


@query(f"""WITH {_N}, t AS (SELECT accession_number, max(text) AS text FROM submissions GROUP BY 1), h AS (SELECT DISTINCT accession_number, sequence, node_id, label_canon, raw_start, raw_end FROM n WHERE label_canon IN ('ITEM 7', 'ITEM I.2'))
SELECT accession_number, sequence, node_id, label_canon, row_number() OVER (PARTITION BY accession_number, sequence, label_canon ORDER BY raw_start, node_id)::INTEGER AS ordinal, sha256(substr(text, (raw_start + 1)::BIGINT, greatest(raw_end - raw_start, 0)::BIGINT)) AS section_sha256 FROM h JOIN t USING (accession_number)""")
def section_texts(spark, d):
    s = A.sections(table(spark, d, "nodes"), ["ITEM 7", "ITEM I.2"], table(spark, d, "submissions"))
    return s.select(*DOC, "node_id", "label_canon", "ordinal", F.sha2("section", 256).alias("section_sha256"))


_METRICS = f"""{_N}, {_YEARS}, k AS (SELECT accession_number, sequence, split_part(label_canon, ' ', 2) AS key, min(raw_start) AS at_, max(raw_end - raw_start) AS size, any_value(label_canon) AS label_canon FROM n WHERE level_kind = 'item' AND label_canon IS NOT NULL AND grammar = 'form10k' GROUP BY 1, 2, 3),
o AS (SELECT *, ({_KEY}) AS ord FROM k), b AS (SELECT *, coalesce(at_ < lag(at_) OVER (PARTITION BY accession_number, sequence ORDER BY ord, key), false) AS back FROM o),
z AS (SELECT accession_number, sequence, max(raw_end) - min(raw_start) AS doc_size FROM n GROUP BY 1, 2),
g AS (SELECT accession_number, sequence, list_sort(list(key)) AS found, NOT bool_or(back) AS in_order, count(*) FILTER (size < 200) AS n_tiny, count(*) FILTER (size > 0.6 * doc_size) AS n_huge FROM b JOIN z USING (accession_number, sequence) GROUP BY 1, 2),
w AS (SELECT g.*, filed_year, ['1','2','3','4','5','6','7','8','9','10','11','12','13','14'] || CASE WHEN filed_year >= 1998 THEN ['7A'] ELSE [] END || CASE WHEN filed_year >= 2004 THEN ['15'] ELSE [] END || CASE WHEN filed_year >= 2006 THEN ['1A','1B'] ELSE [] END
 || CASE WHEN filed_year >= 2008 THEN ['9A'] ELSE [] END || CASE WHEN filed_year >= 2010 THEN ['9B'] ELSE [] END || CASE WHEN filed_year >= 2024 THEN ['1C','9C'] ELSE [] END AS want FROM g LEFT JOIN y USING (accession_number)),
metrics AS (SELECT accession_number, sequence, filed_year, len(found)::INTEGER AS n_items, len(want)::INTEGER AS n_expected, array_to_string(list_filter(list_sort(want), lambda x: NOT list_contains(found, x)), ',') AS missing,
array_to_string(list_filter(found, lambda x: NOT list_contains(want, x)), ',') AS unexpected, in_order, n_tiny::INTEGER AS n_tiny, n_huge::INTEGER AS n_huge, len(list_filter(want, lambda x: NOT list_contains(found, x))) = 0 AS complete FROM w)"""


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def document_metrics(spark, d):
    return A.document_metrics(_nodes(spark, d), _years(spark, d))


@query(f"WITH {_METRICS} SELECT filed_year, count(*) AS n_docs, round(avg(complete::INT), 3) AS complete_share, round(avg(in_order::INT), 3) AS in_order_share, round(avg(n_items), 3) AS mean_items FROM metrics GROUP BY ROLLUP (filed_year)")
def metrics_by_year(spark, d):
    return A.summarize(A.document_metrics(_nodes(spark, d), _years(spark, d)), ["filed_year"])


_METRICS_10Q = f"""{_N}, {_YEARS}, q AS (SELECT DISTINCT accession_number, sequence FROM n WHERE grammar = 'form10q'),
k AS (SELECT accession_number, sequence, split_part(label_canon, ' ', 2) AS key, min(raw_start) AS at_, max(raw_end - raw_start) AS size, any_value(label_canon) AS label_canon FROM n WHERE level_kind = 'item' AND label_canon IS NOT NULL AND grammar = 'form10q' GROUP BY 1, 2, 3),
o AS (SELECT *, ({_KEY}) AS ord FROM k), b AS (SELECT *, coalesce(at_ < lag(at_) OVER (PARTITION BY accession_number, sequence ORDER BY ord, key), false) AS back FROM o),
z AS (SELECT accession_number, sequence, max(raw_end) - min(raw_start) AS doc_size FROM n GROUP BY 1, 2),
g AS (SELECT accession_number, sequence, list_sort(list(key)) AS found, NOT bool_or(back) AS in_order, count(*) FILTER (size < 200) AS n_tiny, count(*) FILTER (size > 0.6 * doc_size) AS n_huge FROM b JOIN z USING (accession_number, sequence) GROUP BY 1, 2),
w AS (SELECT q.accession_number, q.sequence, filed_year, coalesce(found, []::VARCHAR[]) AS found, coalesce(in_order, true) AS in_order, coalesce(n_tiny, 0) AS n_tiny, coalesce(n_huge, 0) AS n_huge, ['II.1','II.2','II.3','II.4','II.5'] AS may,
 ['I.1','I.2','II.6'] || CASE WHEN filed_year >= 1998 THEN ['I.3'] ELSE [] END || CASE WHEN filed_year >= 2003 THEN ['I.4'] ELSE [] END || CASE WHEN filed_year >= 2006 THEN ['II.1A'] ELSE [] END AS want FROM q LEFT JOIN g USING (accession_number, sequence) LEFT JOIN y USING (accession_number)),
v AS (SELECT *, list_filter(list_sort(want), lambda x: NOT list_contains(found, x)) AS gone, list_filter(may, lambda x: NOT list_contains(found, x)) AS left_out FROM w),
metrics AS (SELECT accession_number, sequence, filed_year, len(found)::INTEGER AS n_items, len(want)::INTEGER AS n_expected, array_to_string(gone, ',') AS missing,
array_to_string(list_filter(found, lambda x: NOT list_contains(want, x) AND NOT list_contains(may, x)), ',') AS unexpected, in_order, n_tiny::INTEGER AS n_tiny, n_huge::INTEGER AS n_huge, len(gone) = 0 AS complete,
array_to_string(left_out, ',') AS missing_omittable, len(gone) = 0 AND len(left_out) > 0 AS complete_with_omissions FROM v)"""


@query(f"WITH {_METRICS_10Q} SELECT * FROM metrics")
def document_metrics_10q(spark, d):
    return A.document_metrics(_nodes(spark, d), _years(spark, d), quarterly=True)


@query(f"""WITH {_N}, {_YEARS}, k AS (SELECT accession_number, sequence, label_canon, count(*) AS c, min(raw_start) AS at_ FROM n WHERE level_kind = 'item' AND label_canon IN ('ITEM 1', 'ITEM 7', 'ITEM 8') GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(at_ <= lag(at_) OVER (PARTITION BY accession_number, sequence ORDER BY label_canon), false) AS back FROM k), g AS (SELECT accession_number, sequence, count(*) = 3 AND max(c) = 1 AND NOT bool_or(back) AS ok FROM b GROUP BY 1, 2)
SELECT filed_year, count(*) AS n_docs, sum(coalesce(ok, false)::INT)::BIGINT AS n_covered FROM (SELECT DISTINCT accession_number, sequence FROM n) LEFT JOIN g USING (accession_number, sequence) LEFT JOIN y USING (accession_number) GROUP BY 1""")
def coverage_by_year(spark, d):
    return A.coverage(_nodes(spark, d), _years(spark, d), ["1", "7", "8"])


@query("""WITH a AS (SELECT accession_number, sequence, label_canon, min(raw_start) AS p FROM nodes WHERE label_canon IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT accession_number, sequence, label_canon, min(raw_start) AS q FROM nodes_rerun WHERE label_canon IS NOT NULL GROUP BY 1, 2, 3)
SELECT * FROM (SELECT accession_number, sequence, label_canon, CASE WHEN q IS NULL THEN 'lost' WHEN p IS NULL THEN 'gained' WHEN p <> q THEN 'moved' END AS change FROM a FULL JOIN b USING (accession_number, sequence, label_canon)) WHERE change IS NOT NULL""")
def run_label_changes(spark, d):
    return A.label_changes(table(spark, d, "nodes"), table(spark, d, "nodes_rerun"))


@query("""WITH a AS (SELECT accession_number, sequence, node_id, max(meta)::INT AS meta_a, max(CASE WHEN path IS NOT NULL THEN array_to_string(path, '.') END) AS pa FROM nodes GROUP BY 1, 2, 3), b AS (SELECT accession_number, sequence, node_id, max(meta)::INT AS meta_b, max(CASE WHEN path IS NOT NULL THEN array_to_string(path, '.') END) AS pb FROM nodes_rerun GROUP BY 1, 2, 3)
SELECT meta_a, meta_b, count(*) AS n_nodes, sum((pa IS DISTINCT FROM pb)::INT)::BIGINT AS n_paths_changed FROM a JOIN b USING (accession_number, sequence, node_id) GROUP BY 1, 2""")
def run_meta_moves(spark, d):
    rerun = table(spark, d, "nodes_rerun").withColumn("meta", F.col("meta").cast("int"))
    return A.meta_moves(_nodes(spark, d), rerun)


def _canonical_sql() -> str:
    """The canonical form of a node row in SQL."""
    kinds = {"confidence": "coalesce(TRY_CAST({c} AS DECIMAL(28,6))::VARCHAR, {c}::VARCHAR)", **{k: "'[' || array_to_string(list_transform({c}, lambda x: coalesce('=' || x::VARCHAR, '~')), ',') || ']'" for k in ("rule_ids", "path", "covers_items")}}
    names = """accession_number agent_cik cik confidence covers_items depth doc_type grammar head_raw_end head_raw_start ibr_target ibr_target_in_submission item_cross_reference item_incorporated_by_reference label_canon
    label_raw level_kind meta node_id norm_end norm_start order_key parent_id path path_str profile_era profile_publisher raw_end raw_start rule_ids satisfies_item segment sequence title""".split()
    return " || chr(31) || ".join(f"'{c}' || coalesce('=' || {kinds.get(c, '{c}::VARCHAR').format(c=c)}, '~')" for c in names)


@query(f"""WITH h AS (SELECT DISTINCT accession_number, sequence, node_id, sha256({_canonical_sql()}) AS h FROM nodes)
SELECT accession_number, sequence, sha256(array_to_string(['nodes'] || list(h ORDER BY node_id NULLS FIRST, h) || ['rejected'], chr(10))) AS output_sha256, count(*) AS n_nodes, 0::BIGINT AS n_rejected FROM h GROUP BY ALL""")
def document_hashes(spark, d):
    return A.document_hashes(table(spark, d, "nodes"))


@query(None)
def run_hashes(spark, d):
    """Hashes of a whole run: node rows and rejected rows of every document of the parsed submissions."""
    return A.document_hashes(_parsed(spark, d, "nodes"), rejected=_parsed(spark, d, "rejected"), documents=_parsed(spark, d, "documents"))


@query("""WITH a AS (SELECT DISTINCT accession AS accession_number, sha256 AS ha FROM fetch_log WHERE n_bytes > 0), b AS (SELECT DISTINCT accession_number, input_sha256 AS hb FROM submissions),
j AS (SELECT a.accession_number AS ka, b.accession_number AS kb, ha, hb FROM a FULL JOIN b ON a.accession_number = b.accession_number)
SELECT CASE WHEN kb IS NULL THEN 'only_left' WHEN ka IS NULL THEN 'only_right' WHEN ha IS NULL OR hb IS NULL THEN 'unknown' WHEN ha = hb THEN 'equal' ELSE 'differs' END AS state, count(*) AS n FROM j GROUP BY 1""")
def hash_comparison(spark, d):
    log = table(spark, d, "fetch_log").where("n_bytes > 0").select(F.col("accession").alias("accession_number"), F.col("sha256").alias("h"))
    return A.compare_hashes(log, table(spark, d, "submissions").select("accession_number", F.col("input_sha256").alias("h")), ["accession_number"], "h")


@query(f"""WITH {_YEARS}, {_N}, x AS (SELECT DISTINCT n.accession_number, n.sequence, filed_year FROM n LEFT JOIN y USING (accession_number)), h AS (SELECT *, sha256('seed1:' || accession_number || ':' || sequence) AS draw FROM x)
SELECT accession_number, sequence, filed_year, draw FROM h QUALIFY row_number() OVER (PARTITION BY filed_year ORDER BY draw, accession_number, sequence) <= 2""")
def keyed_draw(spark, d):
    x = table(spark, d, "nodes").select(*DOC).distinct().join(_years(spark, d), "accession_number", "left")
    return A.bottom_k(x, ["filed_year"], 2, "seed1", DOC)


@query("""WITH s AS (SELECT coalesce(profile_era, 'none') AS era, count(DISTINCT accession_number || ':' || sequence) AS n FROM nodes GROUP BY 1), x AS (SELECT *, n * 40 / sum(n) OVER () AS share FROM s), f AS (SELECT *, floor(share) AS fl, 40 - sum(floor(share)) OVER () AS rest FROM x)
SELECT era, n, least(fl + (row_number() OVER (ORDER BY round(share - fl, 9) DESC, era) <= rest)::INT, n)::BIGINT AS quota FROM f""")
def stratum_quotas(spark, d):
    s = table(spark, d, "nodes").groupBy(F.coalesce("profile_era", F.lit("none")).alias("era")).agg(F.countDistinct(*DOC).alias("n"))
    return A.largest_remainder(s, "era", "n", 40)


@query("""SELECT 'level_kind' AS facet, level_kind AS value, count(*) AS n FROM nodes WHERE grammar IN ('form10k') GROUP BY 2 UNION ALL SELECT 'grammar', grammar, count(*) FROM nodes WHERE level_kind IN ('item', 'part') GROUP BY 2
UNION ALL SELECT 'profile_era', profile_era, count(*) FROM nodes WHERE grammar IN ('form10k') AND level_kind IN ('item', 'part') GROUP BY 2""")
def node_facets(spark, d):
    return A.facets(table(spark, d, "nodes"), ["level_kind", "grammar", "profile_era"], {"grammar": ["form10k"], "level_kind": ["item", "part"]})


@query("""SELECT accession_number, sequence, node_id, title FROM (SELECT DISTINCT accession_number, sequence, node_id, title, label_raw FROM nodes WHERE grammar = 'form10k') WHERE contains(lower(regexp_replace(concat_ws(' ', label_raw, title), '\\s+', ' ', 'g')), 'court actions')""")
def heading_search(spark, d):
    n = table(spark, d, "nodes").select(*DOC, "node_id", "title", "label_raw", "grammar").distinct()
    return A.search(n, ["label_raw", "title"], "Court  actions", grammar="form10k").select(*DOC, "node_id", "title")


@query("SELECT DISTINCT accession_number, sequence, node_id FROM nodes ORDER BY accession_number, sequence, node_id LIMIT 50 OFFSET 100")
def node_page(spark, d):
    return A.page(table(spark, d, "nodes").select(*DOC, "node_id").distinct(), [*DOC, "node_id"], 100, 50)


@query(f"""WITH {_N} SELECT accession_number, sequence, max(cik) AS cik, count(*) AS n_nodes, sum(starts_with(level_kind, 'clause')::INT)::BIGINT AS n_clauses, max(depth)::INTEGER AS max_depth, coalesce(sum(starts_with(level_kind, 'clause')::INT), 0) >= 20 AS rich
FROM (SELECT DISTINCT accession_number, sequence, cik, node_id, depth, level_kind FROM n WHERE grammar = 'contract') GROUP BY 1, 2""")
def contract_stats(spark, d):
    return A.contract_stats(_nodes(spark, d))


# A label has one place per document in most cases; the pairs of those that have more are matched in order, which the
# two places nearest in rank show: the k-th of each side, for runs in which both sides lie within reach of each other.
@query("""WITH f AS (SELECT DISTINCT accession_number, sequence, label_canon, head_raw_start AS p FROM nodes_rerun WHERE label_canon IS NOT NULL), t AS (SELECT DISTINCT accession_number, sequence, label_canon, head_raw_start AS p FROM nodes WHERE label_canon IS NOT NULL),
e AS (SELECT *, false AS tr FROM f UNION ALL SELECT *, true FROM t),
w AS (SELECT accession_number, sequence, label_canon, list({'p': p, 't': tr} ORDER BY p, tr) FILTER (p IS NOT NULL) AS es, count(*) FILTER (p IS NULL AND tr) AS nt, count(*) FILTER (p IS NULL AND NOT tr) AS nf FROM e GROUP BY ALL),
m AS (SELECT *, list_reduce(list_prepend({'tp': 0, 'q': []::STRUCT(p BIGINT, t BOOLEAN)[]}, list_transform(coalesce(es, []), lambda x: {'tp': 0, 'q': [x]})), lambda a, b: CASE
 WHEN len(list_filter(a.q, lambda y: b.q[1].p - y.p <= 50)) > 0 AND list_filter(a.q, lambda y: b.q[1].p - y.p <= 50)[1].t <> b.q[1].t
 THEN {'tp': a.tp + 1, 'q': list_filter(a.q, lambda y: b.q[1].p - y.p <= 50)[2:]} ELSE {'tp': a.tp, 'q': list_append(list_filter(a.q, lambda y: b.q[1].p - y.p <= 50), b.q[1])} END).tp AS tp FROM w)
SELECT accession_number, sequence, sum(tp)::BIGINT AS tp, sum(len(list_filter(coalesce(es, []), lambda x: NOT x.t)) + nf - tp)::BIGINT AS fp, sum(len(list_filter(coalesce(es, []), lambda x: x.t)) + nt - tp)::BIGINT AS fn FROM m GROUP BY 1, 2""")
def place_scores(spark, d):
    pick = lambda n: n.where("label_canon is not null").select(*DOC, "label_canon", "head_raw_start").distinct()
    return A.score_places(pick(table(spark, d, "nodes_rerun")), pick(table(spark, d, "nodes")), [*DOC, "label_canon"], "head_raw_start")


@query("""WITH c AS (SELECT DISTINCT accession_number, sequence, head_raw_start FROM candidates), n AS (SELECT DISTINCT accession_number, sequence, head_raw_start FROM nodes)
SELECT c.accession_number, c.sequence, c.head_raw_start, CASE WHEN n.accession_number IS NOT NULL THEN 'accepted' ELSE 'rejected' END AS status FROM c LEFT JOIN n ON n.accession_number = c.accession_number AND n.sequence = c.sequence AND n.head_raw_start = c.head_raw_start""")
def candidate_fates(spark, d):
    c = table(spark, d, "candidates")
    return A.anchor_status(c.select(*DOC, "head_raw_start").distinct(), table(spark, d, "nodes"), c, "head_raw_start")


# ---------------------------------------------------------------- parsing


def _submissions(spark, d):
    s = table(spark, d, "submissions").groupBy("accession_number").agg(F.max("cik").alias("cik"), F.max("text").alias("text"))
    return s.join(_years(spark, d).select("accession_number", F.col("filed_year").alias("year")), "accession_number", "left")


_PARSED: dict[tuple[str, str], object] = {}


def _parsed(spark, d, name):
    """A table of the parse of all submissions; within a session they are parsed once for all the queries that read it."""
    from stemma.parse import pipeline
    from stemma.sources.runs import exists

    key = (spark.sparkContext.applicationId, d)
    if key not in _PARSED or not exists(spark, _PARSED[key].path):
        _PARSED[key] = materialize(pipeline.parse_submissions(_submissions(spark, d)), "parsed")
    return pipeline.table_of(_PARSED[key].df, name)


@query(None)
def parse_nodes(spark, d):
    return _parsed(spark, d, "nodes")


@query(None)
def parse_documents(spark, d):
    return _parsed(spark, d, "documents")


@query(None)
def parse_rejected(spark, d):
    return _parsed(spark, d, "rejected")


_HEAD = "<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: 10-K\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<TEXT>\n"
_ONE, _TWO, _SEVEN = "PART I\n\nITEM 1. BUSINESS\n\n", "\n\nITEM 2. PROPERTIES\n\n", "\n\nPART II\n\nITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS\n\n"
_TAIL = "\n</TEXT>\n</DOCUMENT>\n"


@query(f"""WITH f AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT *, {len(_HEAD)} AS h FROM f)
SELECT doc_id, 'ITEM 1' AS label, (h + 8)::BIGINT AS raw_start, (h + {len(_ONE) + 2} + n)::BIGINT AS raw_end FROM o
UNION ALL SELECT doc_id, 'ITEM 2', h + {len(_ONE) + 2} + n, h + {len(_ONE) + len(_TWO) + 2} + n + 5 FROM o
UNION ALL SELECT doc_id, 'ITEM 7', h + {len(_ONE) + len(_TWO) + 5 + 11} + n, h + {len(_ONE) + len(_TWO) + len(_SEVEN) + 5 + 8} + n FROM o""")
def recovered_items(spark, d):
    """Filings built around every document; the parse must find the items where the construction put them."""
    from stemma.parse import pipeline

    docs = table(spark, d, "documents").where("text is not null")
    # A text that looks like HTML would be read as HTML: its opening brackets are exchanged, lengths stay.
    text = F.concat(F.lit(_HEAD), F.lit(_ONE), F.translate("text", "<", "("), F.lit(_TWO), F.lit("None."), F.lit(_SEVEN), F.lit("Steady."), F.lit(_TAIL))
    s = docs.select(F.col("doc_id").cast("string").alias("accession_number"), F.lit(None).cast("string").alias("cik"), F.lit(2005).alias("year"), text.alias("text"))
    n = pipeline.table_of(pipeline.parse_submissions(s), "nodes").where("level_kind = 'item'")
    return n.select(F.col("accession_number").cast("long").alias("doc_id"), F.col("label_canon").alias("label"), "raw_start", "raw_end")


# ---------------------------------------------------------------- blocks

_B = "b AS (SELECT DISTINCT accession_number, sequence, idx, text, is_page_break, caps_ratio, norm_start, norm_end, raw_start, raw_end FROM blocks)"


def _blocks(spark, d):
    return table(spark, d, "blocks").select(*DOC, "idx", "text", "is_page_break", "caps_ratio", "norm_start", "norm_end", "raw_start", "raw_end").distinct()


@query(rf"""WITH {_B}, x AS (SELECT *, coalesce(is_page_break, false)::INT AS brk, CASE WHEN coalesce(is_page_break, false) OR coalesce(regexp_matches(text, '(?i)^\s*(-\s*\d+\s*-|page\s+\d+|\d{{1,3}}|[ivx]{{1,5}})\s*$'), true) THEN 0 ELSE length(text) END AS size FROM b),
y AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY accession_number, sequence ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page FROM x)
SELECT accession_number, sequence, idx, CASE WHEN page > 0 THEN coalesce(sum(size) OVER (PARTITION BY accession_number, sequence, page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS distance FROM y""")
def page_distances(spark, d):
    from stemma.operators import blocks as B

    return B.page_distance(_blocks(spark, d))


@query(rf"""WITH {_B} SELECT accession_number, sequence, idx, idx - max(CASE WHEN regexp_matches(text, '{phrases.pattern(phrases.INSTRUMENTS)}') THEN idx END)
OVER (PARTITION BY accession_number, sequence ORDER BY idx ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS back FROM b""")
def instrument_distance(spark, d):
    from stemma.operators import blocks as B

    return B.evidence_before(_blocks(spark, d), B.INSTRUMENT)


@query(rf"""WITH {_B} SELECT accession_number, sequence, idx, coalesce(sum(coalesce(regexp_matches(text, '(?i)dividends|net sales'), false)::INT) OVER (PARTITION BY accession_number, sequence ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 6000 FOLLOWING), 0)::BIGINT AS n_after FROM b""")
def evidence_after(spark, d):
    from stemma.operators import blocks as B

    return B.evidence_after(_blocks(spark, d), "(?i)dividends|net sales")


@query(rf"""WITH {_B}, x AS (SELECT *, max(norm_end) OVER (PARTITION BY accession_number, sequence) AS top FROM b)
SELECT accession_number, sequence, min(idx) AS idx, min(raw_start) AS back_start FROM x WHERE regexp_matches(text, '{phrases.opening([*phrases.BACK_HEADS, *phrases.WITNESS])}') AND norm_start * 2 >= top GROUP BY 1, 2""")
def back_heads(spark, d):
    from stemma.operators import blocks as B

    return B.first_back_heads(_blocks(spark, d))


@query(rf"""WITH {_B} SELECT accession_number, sequence, idx, coalesce(sum(coalesce(length(text) > 200 AND regexp_matches(text, '[a-z]{{3,}}\s+[a-z]{{3,}}\s+[a-z]{{3,}}'), false)::INT) OVER (PARTITION BY accession_number, sequence ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prose_before FROM b""")
def prose_prefix(spark, d):
    from stemma.operators import blocks as B

    return B.prose_blocks_between(_blocks(spark, d))


@query(f"""WITH {_B}, c AS (SELECT DISTINCT accession_number, sequence, cand_no, norm_start AS p FROM candidates WHERE norm_start IS NOT NULL), s AS (SELECT accession_number, sequence, norm_start, max({{'n': norm_start, 'r': raw_start, 'e': raw_end}}) AS seg FROM b WHERE norm_start IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT c.accession_number, c.sequence, c.cand_no, c.p, arg_max(s.seg, s.norm_start) AS seg FROM c LEFT JOIN s ON s.accession_number = c.accession_number AND s.sequence = c.sequence AND s.norm_start <= c.p GROUP BY 1, 2, 3, 4)
SELECT accession_number, sequence, cand_no, CASE WHEN seg IS NOT NULL THEN least(seg.r + p - seg.n, seg.e) END AS raw FROM j""")
def norm_to_raw(spark, d):
    from stemma.operators import blocks as B

    c = table(spark, d, "candidates").select(*DOC, "cand_no", F.col("norm_start").alias("p")).where("p is not null").distinct()
    return B.norm_to_raw(c, _blocks(spark, d).where("norm_start is not null"), "p").select(*DOC, "cand_no", "raw")


# ---------------------------------------------------------------- where things are


@query("""SELECT DISTINCT accession_number, cik, 'archives/edgar/data/' || TRY_CAST(cik AS BIGINT) || '/' || accession_number || '.txt' AS relative_path,
CASE WHEN archive_path IS NOT NULL THEN '/data/' || CASE WHEN starts_with(archive_path, 'archives/') THEN 'mirror/' || substr(archive_path, 10) ELSE archive_path END END AS local_path FROM manifest""")
def archive_paths(spark, d):
    """Places of filings under the data root, and stored paths on this machine."""
    m = table(spark, d, "manifest").select("accession_number", "cik", "archive_path").distinct()
    here = control.rewrite_path(F.col("archive_path"), "/data", [("archives/", "mirror/")])
    return m.select("accession_number", "cik", control.relative_archive_path(F.col("accession_number"), F.col("cik")).alias("relative_path"), here.alias("local_path")).distinct()


@query("SELECT accession_number, (min({'y': year, 'c': cik})).c AS cik FROM manifest GROUP BY 1")
def index_ciks(spark, d):
    m = table(spark, d, "manifest").select("cik", F.col("year").alias("filed_date"), F.lit("").alias("company_name"), F.concat(F.lit("x/"), "accession_number", F.lit(".txt")).alias("source_path"))
    return control.index_ciks(m).select("accession_number", "cik")


@query("""SELECT accession_number, (min({'s': coalesce(sequence, 2147483647), 'h': coalesce(is_html, false)})).h AS is_html FROM document_blocks WHERE doc_type IN ('10-K', '10-Q', '10-K405') GROUP BY 1""")
def primary_html(spark, d):
    return control.primary_is_html(table(spark, d, "document_blocks"), ["10-K", "10-Q", "10-K405"])


@query("""SELECT DISTINCT accession_number, sha1(concat_ws(chr(31), '10k', archive_path, accession_number, 'type ' || coalesce(submission_type, '10-K'))) AS row_key FROM manifest""")
def work_keys(spark, d):
    m = table(spark, d, "manifest")
    return m.select("accession_number", control.row_key(F.lit("10k"), F.col("archive_path"), F.col("accession_number"), F.lit(None), F.col("submission_type")).alias("row_key")).distinct()
