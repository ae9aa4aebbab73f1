"""Where things are: stored paths on this machine, control tables, quarter indexes, inputs of conformance rows.

Paths are column expressions, so whole work lists are resolved in one projection.
The root of the data and the prefix pairs are arguments; ``data_root`` and
``prefix_map`` read them from the environment for the command line.
"""

from __future__ import annotations

import os
import urllib.error
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.sources.fetch import is_present, write_whole

ROOT_VARIABLE, PREFIX_VARIABLE = "STEMMA_DATA_ROOT", "STEMMA_PATH_PREFIXES"


def data_root(given: str | None = None) -> str:
    root = given or os.environ.get(ROOT_VARIABLE)
    if not root:
        raise SystemExit(f"no data root: give one or set {ROOT_VARIABLE}")
    return root.rstrip("/")


def prefix_map(spec: str | None = None) -> list[tuple[str, str]]:
    """(old, new) pairs of 'old=new;old=new'; a pair without '=' or without old is an error."""
    spec = os.environ.get(PREFIX_VARIABLE, "") if spec is None else spec
    out = []
    for pair in filter(None, (x.strip() for x in spec.split(";"))):
        old, sign, new = pair.partition("=")
        if not sign or not old:
            raise SystemExit(f"not a pair old=new: {pair!r}")
        out.append((old, new))
    return out


def rewrite_path(path: Column, root: str, pairs: list[tuple[str, str]] = ()) -> Column:
    """A stored path on this machine: the first prefix that fits is exchanged, what is relative then is under the root."""
    moved = F.coalesce(*[F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))) for old, new in pairs], path)
    return F.when(moved.startswith("/"), moved).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), moved))


def relative_archive_path(accession: Column, cik: Column) -> Column:
    """Place of a filing under the data root; null for a cik that is no number."""
    return F.concat(F.lit("archives/edgar/data/"), cik.try_cast("bigint").cast("string"), F.lit("/"), accession, F.lit(".txt"))


def archive_path(accession: Column, cik: Column, root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), relative_archive_path(accession, cik))


def resolve_input(path: Column, kind: Column, root: str, fixtures: str) -> Column:
    """Where the input of a conformance row lies: fixtures in their own folder, all else under the root."""
    under = F.when(kind == "fixtures", F.lit(fixtures.rstrip("/") + "/")).otherwise(F.lit(root.rstrip("/") + "/"))
    return F.when(path.startswith("/"), path).otherwise(F.concat(under, path))


def source_path(path: Column, kind: Column, root: str, pairs: list[tuple[str, str]] = ()) -> Column:
    """The file that a work row reads: bare texts as they are given, all else resolved."""
    return F.when(kind == "text", path).otherwise(rewrite_path(path, root, pairs))


def row_key(kind: Column, path: Column, accession: Column, sequence: Column, form: Column) -> Column:
    """Key of what decides which document a work row gives: exhibits and texts by sequence, forms by their type."""
    pick = F.when(kind.isin("ex10", "ex13", "text"), F.concat(F.lit("seq "), F.coalesce(sequence.cast("string"), F.lit("-")))).otherwise(F.concat(F.lit("type "), F.coalesce(form, F.lit("10-K"))))
    return F.sha1(F.concat_ws("\x1f", kind, path, accession, pick))


def fixture_rows(files: DataFrame, root: str) -> DataFrame:
    """Conformance rows of bare text files (column path) named ACCESSION_SEQUENCE.txt; other names count as sequence 0."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    split = name.rlike(r"^.+_\d+$")
    return files.select(
        F.when(split, F.regexp_extract(name, r"^(.+)_\d+$", 1)).otherwise(name).alias("accession_number"),
        F.lit("0").alias("cik"),
        F.when(split, F.regexp_extract(name, r"_(\d+)$", 1)).otherwise("0").cast("int").alias("sequence"),
        F.lit("fixtures").alias("kind"),
        F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substr("path", F.lit(len(root.rstrip("/")) + 2))).otherwise(F.col("path")).alias("archive_path"),
        F.lit("text").alias("profile_era"),
    )


# ---------------------------------------------------------------- control tables


def load_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A control table; the columns and the condition reach the scan."""
    df = spark.read.parquet(f"{root.rstrip('/')}/control/{name}")
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def snapshot_name(spark: SparkSession, root: str, name: str = "filings") -> str:
    """Name of the last file of a control table, '' if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/control/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ""
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return max((n for n in names if n.endswith(".parquet")), default="")


def index_ciks(index: DataFrame, path: str = "source_path") -> DataFrame:
    """cik and company of every accession number of an index: its first row by date filed, then by cik."""
    acc = F.regexp_extract(path, r"/([0-9-]{20})\.txt$", 1)
    first = F.min(F.struct("filed_date", "cik", "company_name")).alias("x")
    return index.withColumn("accession_number", acc).where("accession_number <> ''").groupBy("accession_number").agg(first).select("accession_number", "x.cik", "x.company_name")


def primary_is_html(documents: DataFrame, types: list[str]) -> DataFrame:
    """accession_number and is_html of its first document of the types, in order of sequence (null last); a null flag is false."""
    x = documents.where(F.col("doc_type").isin(types)).select("accession_number", F.coalesce("sequence", F.lit(2**31 - 1)).alias("s"), F.coalesce("is_html", F.lit(False)).alias("is_html"))
    return x.groupBy("accession_number").agg(F.min(F.struct("s", "is_html")).alias("x")).select("accession_number", "x.is_html")


# ---------------------------------------------------------------- quarter indexes


def index_path(folder: str, year: int, quarter: int) -> str:
    return f"{folder.rstrip('/')}/{year}/QTR{quarter}/master.idx"


def ensure_index(year: int, quarter: int, folder: str, getter: Callable[[str], bytes], url: str, refresh: bool = False) -> str | None:
    """The kept index of a quarter, fetched if it isn't there; None for a quarter that the source hasn't got."""
    path = index_path(folder, year, quarter)
    if is_present(path) and not refresh:
        return path
    try:
        write_whole(path, getter(url))
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise
    return path


def ensure_indexes(years: list[int], folder: str, getter: Callable[[str], bytes], base: str, refresh: bool = False) -> tuple[list[str], dict[str, int]]:
    """Paths of the indexes of all quarters, and how many were read or are unavailable."""
    paths = []
    counts = {"quarters_read": 0, "quarters_unavailable": 0}
    for y in years:
        for q in (1, 2, 3, 4):
            got = ensure_index(y, q, folder, getter, f"{base}/edgar/full-index/{y}/QTR{q}/master.idx", refresh)
            counts["quarters_read" if got else "quarters_unavailable"] += 1
            paths += [got] if got else []
    return paths, counts


def latest_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
