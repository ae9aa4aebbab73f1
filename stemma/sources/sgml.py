"""Full submissions: header fields, document blocks with offsets, primary document, payloads.

Texts are read as latin-1, so a character is a byte and offsets are byte offsets.
All operators are column expressions or explodes; nothing is shuffled but the
choice of the primary document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions.text import finditer

# Patterns of the envelope.
HEADER = r"(?is)<(SEC-HEADER|IMS-HEADER)>(.*?)</\1>"
DOCUMENT = r"(?is)<DOCUMENT>.*?</DOCUMENT>"
HTML_SIGN = r"(?i)<!DOCTYPE\s+HTML|<\s*html\b|content-type[^>]*text/html|<\s*body\b|<\s*div\b|<\s*p\b|<\s*font\b"
IX_SIGN = r"(?i)<ix:|xmlns:ix="
OTHER_WRAPPER = r"(?i)^\s*<(XML|PDF)>"
IX_HEADER = r"(?is)<ix:header>.*?</ix:header>"
BINARY_NAME = r"(?i)\.(pdf|gif|jpg|jpeg|png|xls|xlsx|zip|xml|xsd|json)$"
CREDIT_TYPE, CREDIT_TYPE_EX4 = r"(?i)^EX-10(?![0-9])", r"(?i)^EX-4(?![0-9])"
CREDIT_DESCRIPTION = r"(?i)\b(credit|loan|term loan|revolving|financing|facilit(?:y|ies))\b.*\bagreement\b"
CREDIT_NAME = r"(?i)credit|loan|facilit"
CREDIT_NAME_NOT = r"(?i)amend|waiver|joinder|consent|supplement|guarant|pledge|mortgage"
CREDIT_NOT = r"(?i)\b(amendment|amended and restated amendment|joinder|waiver|consent|guarant\w*|pledge|security agreement|mortgage|supplement|letter|schedule|exhibit list|commitment)\b"
SNIFF_CHARS, IX_CHARS, CREDIT_CHARS = 4096, 8192, 60_000


def read_submissions(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(accession_number, path, text, input_sha256, input_bytes) of raw files; empty files are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.where("length > 0").select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("accession_number"),
        "path",
        F.decode("content", "ISO-8859-1").alias("text"),
        F.sha2("content", 256).alias("input_sha256"),
        F.col("length").alias("input_bytes"),
    )


def header_text(text: Column) -> Column:
    return F.regexp_extract(text, HEADER, 2)


def conformed_name(header: Column) -> Column:
    return F.trim(F.regexp_extract(header, r"(?i)COMPANY\s+CONFORMED\s+NAME:\s*([^\r\n<]+)", 1))


def header_cik(header: Column) -> Column:
    """First index key without leading zeros; null if there is none."""
    raw = F.regexp_extract(header, r"(?i)CENTRAL\s+INDEX\s+KEY:\s*(\d+)", 1)
    return F.regexp_replace(F.nullif(raw, F.lit("")), r"^0+(?=.)", "")


def conformed_type(header: Column) -> Column:
    return F.upper(F.trim(F.regexp_extract(header, r"(?i)CONFORMED\s+SUBMISSION\s+TYPE:\s*([^\r\n<]+)", 1)))


def header_fields(df: DataFrame, key: list[str]) -> DataFrame:
    h = df.select(*key, header_text(F.col("text")).alias("h"))
    return h.select(*key, header_cik(F.col("h")).alias("header_cik"), conformed_name(F.col("h")).alias("company"), conformed_type(F.col("h")).alias("form_type"))


def looks_html(payload: Column) -> Column:
    head = F.substring(payload, 1, SNIFF_CHARS)
    return ~head.rlike(OTHER_WRAPPER) & (head.rlike(HTML_SIGN) | head.rlike(IX_SIGN))


def is_inline_xbrl(payload: Column) -> Column:
    return F.substring(payload, 1, IX_CHARS).rlike(IX_SIGN)


def blank_ix_header(payload: Column) -> Column:
    """Inline headers blanked without changing the length."""
    hits = finditer(payload, IX_HEADER)
    return F.aggregate(
        hits,
        payload,
        lambda t, h: F.concat(F.substr(t, F.lit(1), h["start"]), F.repeat(F.lit(" "), h["end"] - h["start"]), F.substr(t, h["end"] + 1)),
    )


def _field(body: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, rf"(?i)<{name}>\s*([^\r\n<]*)", 1)), F.lit(""))


def split_documents(df: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """One row per document block: key, block_no, sequence, doc_type, filename, description, is_html and offsets.

    ``more`` are columns made from ``payload``, the text of the block.
    A sequence that isn't all digits is null; a block without payload has -1 for its text offsets.
    """
    x = df.select(*key, F.posexplode(finditer(F.col("text"), DOCUMENT)).alias("block_no", "m"))
    body = F.col("m.match")
    before = F.length(F.regexp_extract(body, r"(?is)^(.*?<TEXT>).*?</TEXT>", 1))
    x = x.withColumn("before", before).withColumn("payload", F.regexp_extract(body, r"(?is)<TEXT>(.*?)</TEXT>", 1))
    seq = _field(body, "SEQUENCE")
    has = F.col("before") > 0
    start = F.col("m.start") + F.col("before")
    return x.select(
        *key,
        "block_no",
        F.when(seq.rlike(r"^\d+$"), seq).try_cast("int").alias("sequence"),
        _field(body, "TYPE").alias("doc_type"),
        _field(body, "FILENAME").alias("filename"),
        _field(body, "DESCRIPTION").alias("description"),
        (has & looks_html(F.col("payload"))).alias("is_html"),
        F.col("m.start").cast("long").alias("doc_start"),
        F.col("m.end").cast("long").alias("doc_end"),
        F.when(has, start).otherwise(-1).cast("long").alias("text_start"),
        F.when(has, start + F.length("payload")).otherwise(-1).cast("long").alias("text_end"),
        *more,
    )


def payload(text: Column, start: Column, end: Column) -> Column:
    """The text payload between two offsets; empty if there is none."""
    return F.when(start >= 0, F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def payloads(submissions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Document blocks with their payload, by accession number."""
    s = submissions.groupBy("accession_number").agg(F.max("text").alias("text"))
    return blocks.join(s, "accession_number").select(*[blocks[c] for c in blocks.columns], payload(F.col("text"), F.col("text_start"), F.col("text_end")).alias("payload"))


def base_form(form: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(form)), r"/A$", "")


def primary_documents(blocks: DataFrame, forms: DataFrame) -> DataFrame:
    """The main document of each submission: exact type, base type, type with the same stem, else the first.

    ``forms`` has accession_number and submission_type.  Blocks without text or with the name of a binary file don't count.
    """
    kind = F.upper(F.coalesce("doc_type", F.lit("")))
    st = F.upper(F.trim("submission_type"))
    base = base_form(F.col("submission_type"))
    stem = F.when(base.contains("-"), F.concat(F.split(base, "-")[0], F.lit("-"), F.substring(F.split(base, "-")[1], 1, 1))).otherwise(base)
    rank = F.when(kind == st, 0).when(kind == base, 1).when(kind.startswith(stem), 2).otherwise(3)
    usable = (F.col("text_start") >= 0) & ~F.coalesce(F.col("filename").rlike(BINARY_NAME), F.lit(False))
    w = Window.partitionBy("accession_number").orderBy("rank", "block_no")
    return (
        blocks.where(usable)
        .join(forms.select("accession_number", "submission_type"), "accession_number")
        .withColumn("rank", rank)
        .withColumn("n", F.row_number().over(w))
        .where("n = 1")
        .select("accession_number", "submission_type", "block_no", "doc_type", F.col("rank").alias("match_rank"))
    )


def credit_tests(blocks: DataFrame, *, include_ex4: bool = False, min_chars: int = CREDIT_CHARS) -> DataFrame:
    """Document blocks with the tests of a full credit or loan agreement, and ``chosen`` where all hold.

    right_type, sized (its text has at least ``min_chars``), named (by description or file name), and plain (neither says
    that it is an amendment, a waiver or the like; restated agreements stay).
    """
    d, f = F.coalesce("description", F.lit("")), F.coalesce("filename", F.lit(""))
    right = F.coalesce(F.col("doc_type").rlike(CREDIT_TYPE), F.lit(False))
    if include_ex4:
        right = right | F.coalesce(F.col("doc_type").rlike(CREDIT_TYPE_EX4), F.lit(False))
    restated = d.rlike(r"(?i)amended\s+and\s+restated") & ~d.rlike(r"(?i)\bamendment\b")
    x = blocks.withColumns({
        "right_type": right,
        "sized": (F.col("text_start") >= 0) & (F.col("text_end") - F.col("text_start") >= min_chars) & ~f.rlike(BINARY_NAME),
        "named": d.rlike(CREDIT_DESCRIPTION) | f.rlike(CREDIT_NAME),
        "plain": ~f.rlike(CREDIT_NAME_NOT) & (~d.rlike(CREDIT_NOT) | restated),
    })
    return x.withColumn("chosen", F.col("right_type") & F.col("sized") & F.col("named") & F.col("plain"))


def credit_agreements(blocks: DataFrame, *, include_ex4: bool = False, min_chars: int = CREDIT_CHARS) -> DataFrame:
    """Document blocks that hold a full credit or loan agreement."""
    return credit_tests(blocks, include_ex4=include_ex4, min_chars=min_chars).where("chosen").select(*blocks.columns)


def grammar_of(doc_type: Column, header_type: Column) -> Column:
    """Grammar by document type; a 10-Q tag under a 10-K header counts as 10-K."""
    t = F.upper(F.coalesce(doc_type, F.lit("")))
    h = F.regexp_replace(F.upper(F.coalesce(header_type, F.lit(""))), "-", "")
    quarter = F.regexp_replace(t, "-", "").startswith("10Q")
    return F.when(t.startswith("EX-"), "contract").when(quarter & ~h.startswith("10K"), "form10q").otherwise("form10k")
