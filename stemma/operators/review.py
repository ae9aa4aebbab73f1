"""Review of parses: windows of context, verdicts, gold labels, markers in the source, verification counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import finditer

DOC = ["accession_number", "sequence"]
CONTEXT, MARKER = 400, ">>>"


def mark_window(norm: Column, start: Column, end: Column, window: int = CONTEXT, marker: str = MARKER) -> Column:
    """Text around a heading with a marker before it."""
    low = F.greatest(start - window, F.lit(0))
    return F.concat(F.substr(norm, (low + 1).cast("int"), (start - low).cast("int")), F.lit(marker), F.substr(norm, (start + 1).cast("int"), (end - start + window).cast("int")))


def clean_window(text: Column) -> Column:
    """A window without lines of page furniture."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"(?i)^\s*(?:-?\s*\d{1,4}\s*-?|page\s+\d+|table of contents|<page>)\s*$"))
    return F.array_join(lines, "\n")


def last_verdicts(verdicts: DataFrame, key: list[str], order: str, scored_only: bool = True) -> DataFrame:
    """The last verdict of each key; those with an error don't count if ``scored_only``."""
    v = verdicts.where("error is null") if scored_only else verdicts
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return v.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def window_status(windows: DataFrame, nodes: DataFrame, rejected: DataFrame, at: str = "raw_start") -> DataFrame:
    """accepted, the reason of a rejection, or no_candidate, for each window's place."""
    n = nodes.select(*DOC, F.col("head_raw_start").alias(at)).distinct().withColumn("ok", F.lit(True))
    r = rejected.groupBy(*DOC, F.col("raw_start").alias(at)).agg(F.min("reason").alias("reason"))
    x = windows.join(n, [*DOC, at], "left").join(r, [*DOC, at], "left")
    return x.withColumn("status", F.when(F.col("ok"), "accepted").otherwise(F.coalesce("reason", F.lit("no_candidate")))).drop("ok", "reason")


def review_queue(windows: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Windows without a decision."""
    return windows.join(decisions.select(*key).distinct(), key, "left_anti")


def seeded_sample(df: DataFrame, n: int, seed: str, ident: list[str]) -> DataFrame:
    """n rows by keyed hash, in order of their ids: the same for every partitioning."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ident]), 256)
    return df.withColumn("h_", h).orderBy("h_", *ident).limit(n).drop("h_").orderBy(*ident)


def safe_point(payload: Column, at: Column) -> Column:
    """The nearest offset at or behind ``at`` that is not inside a tag, or inside script, style, title or a text area."""
    spans = finditer(payload, r"(?is)<(?:script|style|title|textarea)\b.*?</(?:script|style|title|textarea)\s*>|<[^<>]*>")
    inside = F.filter(spans, lambda s: (s["start"] < at) & (at < s["end"]))
    return F.when(F.size(inside) > 0, F.element_at(inside, 1)["end"]).otherwise(at)


def inject_markers(df: DataFrame, key: list[str], payload: str = "payload", places: str = "places") -> DataFrame:
    """Payloads with a marker at each of ``places`` (offsets, any order), moved to safe points."""
    safe = F.array_sort(F.array_distinct(F.transform(places, lambda p: safe_point(F.col(payload), p))))
    cuts = F.concat(F.array(F.lit(0)), safe, F.array(F.length(payload)))
    parts = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.substr(F.col(payload), F.element_at(cuts, i) + 1, F.element_at(cuts, i + 1) - F.element_at(cuts, i)))
    return df.select(*key, F.array_join(parts, f"<mark>{MARKER}</mark>").alias("marked"))


def verify(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Counters of a verification: rows, missing inputs, inputs and outputs that differ, and whether all is well.

    Both sides have input_sha256 and output_sha256; a missing input is reported but is no failure.  A document that was
    found without an output hash (its parse failed) is an output that differs.
    """
    f = found.select(*key, F.col("input_sha256").alias("fi"), F.col("output_sha256").alias("fo"), F.lit(True).alias("there"))
    e = expected.select(*[F.col(k).alias(f"e_{k}") for k in key], "input_sha256", "output_sha256")
    x = e.join(f, reduce(and_, [F.col(f"e_{k}").eqNullSafe(F.col(k)) for k in key]), "left")
    gone = F.col("there").isNull()
    read = ~gone & F.col("fi").eqNullSafe(F.col("input_sha256"))
    same = F.coalesce(F.col("fo") == F.col("output_sha256"), F.lit(False))
    out = x.agg(
        F.count("*").alias("n"),
        F.count_if(gone).alias("n_missing"),
        F.count_if(~gone & ~read).alias("n_inputs_differ"),
        F.count_if(read & ~same).alias("n_outputs_differ"),
        F.count_if(read & same).alias("n_equal"),
    )
    return out.withColumn("ok", (F.col("n_inputs_differ") == 0) & (F.col("n_outputs_differ") == 0))


def skeleton(nodes: DataFrame) -> DataFrame:
    """Label skeleton of every document as text, one line per node, to be reviewed by hand."""
    line = F.format_string("- {label: %s, raw_start: %d, title: %s}", F.coalesce("label_canon", F.lit("null")), F.col("raw_start"), F.to_json(F.array(F.coalesce("title", F.lit("")))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return nodes.where("level_kind in ('part', 'item', 'article', 'section')").groupBy(*DOC).agg(F.concat(F.lit("reviewed: false\nnodes:\n"), body).alias("skeleton"))
