"""Profile of a document: signal counts, publisher, era, and what an item stub points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.phrases import pattern
from stemma.functions.text import strip_tags
from stemma.sources.sgml import is_inline_xbrl

# Agents by the first ten digits of the accession number, and the signals counted in a body.
AGENTS = {
    "donnelley": ["0000912057", "0001047469", "0001193125", "0000950170"],
    "bowne": [
        "0000893220", "0000950123", "0000950124", "0000950131", "0000950134", "0000950135", "0000950137", "0000950144", "0000950152", "0000950109", "0000950116", "0000950129", "0000950130", "0000950133",
        "0000950136", "0000950148", "0000950149", "0000950150", "0000950153", "0000950168", "0000950172", "0000898430", "0000927016", "0000936392",
    ],
    "merrill": ["0001104659", "0001056404"], "vintage": ["0001144204"], "edgar_agents": ["0001213900"], "m2_compliance": ["0001493152"], "rdg": ["0001437749"], "workiva": ["0001628280"],
    "activedisclosure": ["0001564590"], "toppan_bridge": ["0001558370"], "novaworks": ["0001477932"], "broadridge": ["0001140361"], "globalone": ["0001171843"], "newsfile": ["0001062993"],
    "issuer_direct": ["0001185185"], "edgar_online": ["0001019056"],
}
SIGNALS = {
    "workiva_comment": r"Created with Wdesk|Workiva",
    "activedisclosure_comment": r"ActiveDisclosure",
    "toppan_bridge_comment": r"Toppan Merrill Bridge",
    "compsci_comment": r"CompSci Transform",
    "bowne_link2": r"<!--\s*link2\s",
    "donnelley_toc_anchor": r"<A NAME=\"toc_",
    "page_break_style": r"page-break-(?:before|after)",
    "hr_tag": r"<hr\b",
    "font_tag": r"<font\b",
    "div_tag": r"<div\b",
    "td_tag": r"<td\b",
    "page_mark": r"<PAGE>",
    "hidden_white_text": r"font-size:\s*1pt;\s*color:\s*white",
    "img_tag": r"<img\b",
    "pre_tag": r"<pre\b",
    "cross_reference_index": pattern(["cross reference index", "cross-reference index"]),
    "reg_ab": pattern(["Regulation AB", "General Instruction J", "as the Depositor", "Issuing Entity", "Servicing Criteria", "Asset-Backed", "Asset Backed"]) + r"|\bItem\s+11\d\d\b",
}
ABS_WINDOW = 50_000
ABS_PHRASES = ["regulation ab", "general instruction j", "as depositor", "as the depositor", "issuing entity", "servicing criteria", "noteholder(s)", "certificateholder(s)", "pooling and servicing"]
ABS_WORDS = [rf"{pattern(ABS_PHRASES)}|\bItem\s+11\d\d\b"]
TRUSTS = [f"{kind}{s} trust" for kind in ("owner", "master", "grantor", "auto", "loan", "mortgage", "funding") for s in ("", "s")]
ABS_NAME = pattern(["receivables", "asset-backed", "asset backed", "abs", "pass-through", "pass through", "certificates", *TRUSTS]) + r"|securitiz|passthrough|assetbacked|\btrust\s+(?:19|20)\d\d|\b(?:19|20)\d\d-[a-z0-9]+\b"
STUB_CHARS, REFERENCE_GAP = 4096, 80
BY_REFERENCE = rf"(?i)incorporated[\s\S]{{0,{REFERENCE_GAP}}}?{pattern(['by reference'])}|{pattern(['incorporated herein', 'by reference to'])}"
OWN_REPORT = "(?i)" + pattern(["this annual report", *[f"annual report {w} form {f}" for w in ("on", "in") for f in ("10-k", "10k")]])
EXHIBIT_13 = "(?i)" + pattern(["exhibit 13", "exhibit no 13", "exhibit no. 13", "exhibit no.13"])
INTERNAL = ["index to financial statements", "index to the financial statements", "index to consolidated financial statements", "index to the consolidated financial statements", "item 14", "item 15", "following the signature", "follows the signature", "elsewhere in", "elsewhere herein"]
INTERNAL += [f"this {a}report on form {f}" for a in ("", "annual ") for f in ("10-k", "10k")]
INTERNAL_POINTER = rf"(?i)\bF-\d|{pattern(INTERNAL)}"


def signal_columns(body: Column) -> dict[str, Column]:
    out = {k: F.regexp_count(body, F.lit("(?i)" + p)) for k, p in SIGNALS.items()}
    head = F.substring(body, 1, ABS_WINDOW)
    total = F.lit(0)
    for p in ABS_WORDS:
        total = total + F.regexp_count(head, F.lit("(?i)" + p))
    out["reg_ab_specific"] = total
    out["reg_ab_generic"] = F.regexp_count(head, F.lit("(?i)Asset[- ]Backed"))
    return out


def signals(docs: DataFrame, keep: list[str], body: str = "payload", company: str | None = None) -> DataFrame:
    """Counts of all signals in every body."""
    name = F.coalesce(F.col(company).rlike("(?i)" + ABS_NAME), F.lit(False)).cast("int") if company else F.lit(0)
    return docs.select(*keep, *[c.cast("int").alias(k) for k, c in signal_columns(F.col(body)).items()], name.alias("reg_ab_name"))


def is_structured(specific: Column, name: Column) -> Column:
    """Asset-backed filing: two telling words, or the name of the company."""
    return (specific >= 2) | (name > 0)


def publisher(accession: Column, cik: Column, sig) -> Column:
    agent = F.substring(accession, 1, 10)
    family = F.when(agent.try_cast("long") == cik.try_cast("long"), "self").otherwise("other")
    for name, members in AGENTS.items():
        family = F.when(agent.isin(members), name).otherwise(family)
    return (
        F.when(sig["workiva_comment"] > 0, "workiva")
        .when(sig["activedisclosure_comment"] > 0, "activedisclosure")
        .when(sig["toppan_bridge_comment"] > 0, "toppan_bridge")
        .when(sig["compsci_comment"] > 0, "compsci")
        .when((sig["bowne_link2"] > 0) & family.isin("self", "other"), "bowne")
        .otherwise(family)
    )


def era(is_html: Column, ixbrl: Column, family: Column, sig) -> Column:
    early = F.when(sig["font_tag"] > sig["div_tag"], "html_early").otherwise("html_generic")
    return (
        F.when(~F.coalesce(is_html, F.lit(False)), "text")
        .when((sig["hidden_white_text"] >= 3) & (sig["img_tag"] >= 3), "image_text")
        .when(ixbrl, "ixbrl")
        .when(family.isin("self", "other"), early)
        .otherwise("html_publisher")
    )


def profiles(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Publisher, era and asset-backed flag of every document (accession_number, block_no, is_html, payload).

    ``owners`` has accession_number, cik and company.  Signals are counted where the payload is; only the counts move.
    """
    s = signals(docs.withColumn("ix", is_inline_xbrl(F.col("payload"))), ["accession_number", "block_no", "is_html", "ix"]).distinct().join(owners, "accession_number", "left")
    named = F.coalesce(F.col("company").rlike("(?i)" + ABS_NAME), F.lit(False)).cast("int")
    sig = {c: F.col(c) for c in s.columns}
    s = s.withColumn("publisher", publisher(F.col("accession_number"), F.col("cik"), sig))
    return s.select(
        "accession_number",
        "block_no",
        F.substring("accession_number", 1, 10).alias("agent_cik"),
        "publisher",
        era(F.col("is_html"), F.col("ix"), F.col("publisher"), sig).alias("era"),
        is_structured(F.col("reg_ab_specific"), named).alias("is_abs"),
    )


def stub_flags(df: DataFrame, keep: list[str], span: str = "span") -> DataFrame:
    """What short item texts point to: by_reference, target (ex13 or annual_report), cross_reference; null for long ones."""
    x = df.select(*keep, strip_tags(F.col(span)).alias("t"))
    t = F.col("t")
    short = F.length(t) < STUB_CHARS
    ref, ex13 = t.rlike(BY_REFERENCE), t.rlike(EXHIBIT_13)
    outside = ex13 | F.regexp_replace(t, OWN_REPORT, " ").rlike(r"(?i)annual\s+report")
    flag = ref & outside
    return x.select(
        *keep,
        F.when(short, flag).alias("by_reference"),
        F.when(short & flag, F.when(ex13, "ex13").otherwise("annual_report")).alias("target"),
        F.when(short, ~flag & (ref | t.rlike(INTERNAL_POINTER))).alias("cross_reference"),
    )
