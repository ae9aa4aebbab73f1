"""Column expressions over text: match positions, ratios, titles, page width."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finditer(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches, offsets from 0; the pattern must not match nothing.

    The gaps between matches come from ``split``, the matches from
    ``regexp_extract_all``; a match starts where gaps and matches before it end.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        hit = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["match"].alias("match"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    whole = F.filter(pairs, lambda x: x["match"].isNotNull())
    return F.aggregate(whole, start, step, lambda acc: acc["out"])


def match_rows(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """One row per match of a pattern: ``keys``, start, end, match; linear in the text, however many matches it has.

    For texts with few matches ``finditer`` stays in the JVM; this goes once through Arrow.  Null texts have none.
    """
    find = regex.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(i, m.start(), m.end(), m[0]) for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()) if t for m in find.finditer(t)]
            at, start, end, match = zip(*hits) if hits else ((),) * 4
            cols = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(match, pa.string())], names=[*keys, "start", "end", "match"])

    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "start int, end int, match string"])
    return df.select(*keys, text).mapInArrow(run, schema)


def line_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line: ``keys``, line_no from 0, line_start, line_length; an empty text has one empty line, a null none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                at = 0
                for n, line in enumerate(t.split("\n") if t is not None else ()):
                    rows.append((i, n, at, len(line)))
                    at += len(line) + 1
            row, number, start, size = zip(*rows) if rows else ((),) * 4
            cols = [b.column(k).take(pa.array(row, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.int32()) for x in (number, start, size)]], names=[*keys, "line_no", "line_start", "line_length"])

    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "line_no int, line_start int, line_length int"])
    return df.select(*keys, text).mapInArrow(run, schema)


def caps_ratio(text: Column) -> Column:
    """Share of letters that are capitals; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def clean_title(title: Column) -> Column:
    """Title up to its dot leader, blanks collapsed, punctuation at the ends removed."""
    cut = F.regexp_replace(title, r"(?s)(?:(?:\.\s?){4,}|(?:_\s?){4,}).*$", "")
    return F.regexp_replace(collapse(cut), r"^[ .:;,\-–—*]+|[ .:;,\-–—*]+$", "")


def norm_title(title: Column) -> Column:
    return F.lower(collapse(title))


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"<[^>]*>", " "))
