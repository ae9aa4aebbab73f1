"""Queries of the text operators, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.llm import canonical, encoding, markup, pack, quality, tokenize, unify
from stemma.session import table


def p7_ids(spark, d):
    return tokenize.encode_column(table(spark, d, "documents"), "text", ["doc_id"])


def p8_pack(spark, d):
    return pack.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_report(spark, d):
    return pack.fill_report(p8_pack(spark, d))


REC = ["rec_table", "accession_number", "sequence", "idx"]


def _records(spark, d):
    """Texts of blocks and submissions under one key."""
    b = table(spark, d, "blocks").select(F.lit("blocks").alias("rec_table"), "accession_number", "sequence", "idx", "text")
    s = table(spark, d, "submissions").select(F.lit("submissions").alias("rec_table"), "accession_number", F.lit(-1).alias("sequence"), F.lit(-1).alias("idx"), "text")
    return b.unionByName(s)


def p2_found(spark, d):
    return encoding.affected(_records(spark, d), REC).select(*REC).distinct()


def p2_restored(spark, d):
    """Affected records with their restored text, the chains undone, and the number of characters lost."""
    return encoding.affected(_records(spark, d), REC).distinct()


def p3_found(spark, d):
    return canonical.map_records(table(spark, d, "candidates"), table(spark, d, "nodes"), table(spark, d, "label_reference"))


BLOCK = ["accession_number", "sequence", "idx"]


def p4_found(spark, d):
    return markup.clean_texts(table(spark, d, "blocks"), BLOCK, only_marked=True).select(*BLOCK).distinct()


def p4_clean(spark, d):
    """Every block with its clean text and the kinds of markup found."""
    return markup.clean_texts(table(spark, d, "blocks"), BLOCK).distinct()


def p6_found(spark, d):
    return unify.odd_fields(table(spark, d, "candidates"), ["accession_number", "sequence", "cand_no"], ["label_raw", "title"])


def p6_unified(spark, d):
    """Label and title of every candidate in consistent form."""
    c = table(spark, d, "candidates").select("accession_number", "sequence", "cand_no", "label_raw", "title")
    return unify.unify_columns(c, ["label_raw", "title"])


def p9_found(spark, d):
    kinds = quality.assess(table(spark, d, "documents"), table(spark, d, "common_words"), ["doc_id"])
    return kinds.where(F.col("kind").isin("list", "table", "junk")).select("doc_id").distinct()


def p9_labels(spark, d):
    """Shares of the line kinds and the kind of every document."""
    kinds = quality.assess(table(spark, d, "documents"), table(spark, d, "common_words"), ["doc_id"])
    return kinds.select("doc_id", *[f"{k}_share" for k in quality.KINDS], "kind")


def p9_stats(spark, d):
    """Text statistics of every document."""
    return quality.assess(table(spark, d, "documents"), table(spark, d, "common_words"), ["doc_id"]).select("doc_id", *quality.STATS)


def queries():
    return {f.__name__: f for f in (p2_found, p2_restored, p3_found, p4_found, p4_clean, p6_found, p6_unified, p7_ids, p8_pack, p8_report, p9_found, p9_labels, p9_stats)}


_STATS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT list(lower(word)) AS known FROM common_words),
c AS (SELECT doc_id, len(regexp_extract_all(t, '[^\t\n\x0b\f\r ]+')) AS n_words, length(regexp_replace(t, '[\t\n\x0b\f\r ]+', '', 'g')) AS n_chars,
  length(regexp_replace(t, '[\pL\pN\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS n_signs,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\t\n\x0b\f\r ]+', '', 'g')) > 0) AS lines,
  regexp_extract_all(lower(t), '\pL+') AS runs, known FROM d, w)
SELECT doc_id, n_words::BIGINT AS n_words, CASE WHEN n_words > 0 THEN round(n_chars / n_words, 6) END AS mean_word_length,
  CASE WHEN n_chars > 0 THEN round(n_signs / n_chars, 6) END AS symbol_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?,;:][\t\x0b\f\r ]*$'))) / len(lines), 6) END AS stopped_line_share,
  CASE WHEN len(runs) > 0 THEN round(len(list_filter(runs, lambda x: list_contains(known, x))) / len(runs), 6) END AS common_word_share FROM c"""


def oracle_sql():
    return {"p9_stats": _STATS}
