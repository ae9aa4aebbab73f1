"""Work lists: index lines, form filters, one row per filing, missing files, samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The members of the form families.
FAMILIES = {
    "10-K-family": ["10-K", "10-K405", "10-KSB", "10-KT", "10-K405T", "10-KSB40", "10-KT405"],
    "10-Q-family": ["10-Q", "10-QSB", "10-QT"],
}


def parse_years(spec: str) -> list[int]:
    """Years of '1994-1996,2001'; a range that runs backwards is an error."""
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", part)
        if not m:
            raise ValueError(f"not a year or range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if b < a:
            raise ValueError(f"range runs backwards: {part!r}")
        out.update(dict.fromkeys(range(a, b + 1)))
    return list(out)


def expand_forms(spec: str) -> list[str]:
    """Forms of a comma list in which families are written out, each once, in order."""
    out: dict[str, None] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        out.update(dict.fromkeys(FAMILIES.get(part, [part])))
    return list(out)


def parse_index(lines: DataFrame) -> DataFrame:
    """Rows of a pipe-separated index (column ``value``): cik, company, form, filed, filename.

    Lines of another shape are skipped; a company name may itself hold pipes.
    """
    p = F.split("value", r"\|")
    n = F.size(p)
    shaped = lines.where((n >= 5) & p[0].rlike(r"^\d+$") & F.element_at(p, -2).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return shaped.select(
        p[0].alias("cik"),
        F.array_join(F.slice(p, 2, n - 4), "|").alias("company"),
        F.element_at(p, -3).alias("form"),
        F.element_at(p, -2).alias("filed"),
        F.element_at(p, -1).alias("filename"),
    )


def accession_of(filename: Column) -> Column:
    """Accession number in a file name, null if it has none of the dashed form."""
    return F.nullif(F.regexp_extract(filename, r"(?:^|/)(\d{10}-\d{2}-\d{6})(?:\.[^/]*)?$", 1), F.lit(""))


def year_of(filed: Column) -> Column:
    return F.substring(filed, 1, 4).try_cast("int")


def is_amendment(form: Column) -> Column:
    return form.endswith("/A")


def select_forms(df: DataFrame, forms: list[str], column: str = "submission_type", include_amendments: bool = False) -> DataFrame:
    """Rows of the forms; their amendments only if wanted or listed."""
    f = F.col(column)
    keep = f.isin(forms)
    if include_amendments:
        keep = keep | (is_amendment(f) & F.regexp_replace(f, r"/A$", "").isin(forms))
    return df.where(keep)


def one_per_filing(manifest: DataFrame, present: DataFrame, only_present: bool = False) -> DataFrame:
    """One manifest row per accession number: a present file first, then the smallest cik.

    ``present`` has the accession numbers of files that are there.
    """
    there = present.select(F.col("accession_number"), F.lit(True).alias("present")).distinct()
    w = Window.partitionBy("accession_number").orderBy(F.col("present").desc(), F.col("cik").try_cast("long").asc_nulls_last(), "cik", "archive_path")
    out = manifest.distinct().join(there, "accession_number", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    out = out.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return out.where("present") if only_present else out


def present_files(log: DataFrame) -> DataFrame:
    """Accession numbers whose last try succeeded with content, with that try's size, hash and time."""
    w = Window.partitionBy("accession").orderBy(F.col("fetched_at").desc(), F.col("n_bytes").desc_nulls_last(), F.col("sha256").desc_nulls_last(), F.col("url").desc_nulls_last())
    last = log.where(F.col("n_bytes") > 0).withColumn("n", F.row_number().over(w)).where("n = 1")
    return last.select(F.col("accession").alias("accession_number"), "n_bytes", "sha256", "fetched_at")


def missing_files(rows: DataFrame, present: DataFrame) -> DataFrame:
    return rows.join(present.select("accession_number"), "accession_number", "left_anti")


def index_urls(years: DataFrame, base: str = "https://www.sec.gov/Archives") -> DataFrame:
    """Quarter index of every year of ``years`` (column year): year, quarter, url."""
    q = years.select("year").where(F.col("year").isNotNull()).distinct().select("year", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("quarter"))
    return q.select("year", "quarter", F.format_string(base + "/edgar/full-index/%d/QTR%d/master.idx", F.col("year"), F.col("quarter")).alias("url"))


def positional_picks(df: DataFrame, k: int, partition: list[str], order: list[str]) -> DataFrame:
    """k evenly spaced rows of each partition, those at floor(i * n / k)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*partition))
    at = F.row_number().over(w) - 1
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("n_") / k))
    return df.withColumn("n_", n).withColumn("at_", at).where((F.col("n_") <= k) | F.array_contains(picks, F.col("at_").cast("long"))).drop("n_", "at_")


def stratify(rows: DataFrame, k: int = 2, top: int = 3) -> DataFrame:
    """Per year the ``top`` agents by number of filings (ties by name) and 'other', k picks of each."""
    counts = rows.groupBy("year", "agent_cik").agg(F.count("*").alias("c"))
    w = Window.partitionBy("year").orderBy(F.col("c").desc(), "agent_cik")
    best = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("year", "agent_cik", F.col("agent_cik").alias("cell"))
    cells = rows.join(best, ["year", "agent_cik"], "left").withColumn("cell", F.coalesce("cell", F.lit("other")))
    return positional_picks(cells, k, ["year", "cell"], ["accession_number"])
