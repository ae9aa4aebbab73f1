"""Operators over heading candidates: style scores, repeats, runs, copies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.parse.grammars import GRAMMARS

DOC = ["accession_number", "sequence"]
# What style adds to a candidate's score, in the order in which the rules fire, and the bounds of the rules.
STYLE = [("sty.bold", 0.15), ("sty.underline", 0.15), ("sty.caps", 0.15), ("sty.center", 0.05), ("sty.font_size", 0.10), ("pos.short_block", 0.10), ("pos.in_table", -0.10), ("pub.comment_marker", 0.20)]
BLANK_BEFORE = 0.05  # scored, but no rule
CAPS_FROM, CAPS_CHARS, LARGER_FROM, SHORT_LINES, SHORT_CHARS = 0.85, 6, 1.05, 3, 220
STYLED = ["sty.bold", "sty.caps", "sty.underline", "sty.font_size"]
GAP_BLOCKS, RUN_LEAST = 4, 4
DUPLICATE_MARGIN = 0.3


def _rules() -> list[tuple[str, float, Column]]:
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    lines = F.split("text", "\n", -1)
    tests = {
        "sty.bold": f("bold"),
        "sty.underline": f("underline"),
        "sty.caps": F.coalesce((F.col("caps_ratio") >= CAPS_FROM) & (F.length(lines[0]) >= CAPS_CHARS), F.lit(False)),
        "sty.center": f("center"),
        "sty.font_size": F.coalesce(F.col("font_size_rel") > LARGER_FROM, F.lit(False)),
        "pos.short_block": F.coalesce((F.size(lines) <= SHORT_LINES) & (F.length("text") <= SHORT_CHARS), F.lit(False)),
        "pos.in_table": f("in_table"),
        "pub.comment_marker": F.coalesce(F.col("preceding_comment").rlike("(?i)item|part"), F.lit(False)),
    }
    return [(k, v, tests[k]) for k, v in STYLE]


def style_scores(blocks: DataFrame, keep: list[str], base: float = 0.5) -> DataFrame:
    """Base score plus what each style rule that fires adds, and the ids of those rules in firing order."""
    total = F.lit(base) + F.when(F.coalesce(F.col("blank_before"), F.lit(False)), BLANK_BEFORE).otherwise(0.0)
    for _, delta, test in _rules():
        total = total + F.when(test, delta).otherwise(0.0)
    ids = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, _, t in _rules()]))
    return blocks.select(*keep, F.round(total, 3).alias("style_score"), F.array_join(ids, " ").alias("style_rules"))


def is_styled(rules: Column) -> Column:
    return F.arrays_overlap(rules, F.array(*[F.lit(x) for x in STYLED]))


def copies_later(c: DataFrame, label: Column) -> DataFrame:
    """Candidates whose label occurs again later in their document, with the last such place."""
    x = c.withColumn("label_", label)
    w = Window.partitionBy(*DOC, "kind", "label_")
    return x.where(F.col("label_").isNotNull()).withColumn("last_at", F.max("head_raw_start").over(w)).where("last_at > head_raw_start").drop("label_")


def sole_copies(c: DataFrame, label: Column) -> DataFrame:
    """Candidates that are the only one of their label in their document (left anti join against the copies)."""
    x = c.withColumn("label_", label).where(F.col("label_").isNotNull())
    twice = x.groupBy(*DOC, "kind", "label_").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return x.join(twice, [*DOC, "kind", "label_"], "left_anti").drop("label_")


def page_repeats(c: DataFrame, title: Column) -> DataFrame:
    """Later candidates that carry the same label and title as an earlier one of their document."""
    x = c.withColumn("label_", F.upper(F.trim("label_raw"))).withColumn("title_", title)
    w = Window.partitionBy(*DOC, "kind", "label_", "title_").orderBy("head_raw_start", "cand_no")
    return x.where("label_ is not null and title_ is not null").withColumn("copy_no", F.row_number().over(w)).where("copy_no > 1").drop("label_", "title_")


def runs(c: DataFrame, gap: int = GAP_BLOCKS) -> DataFrame:
    """Islands of candidates at most ``gap`` blocks apart: first and last block, members, share with a contents hint."""
    w = Window.partitionBy(*DOC).orderBy("block_idx", "cand_no")
    opens = F.coalesce(F.col("block_idx") - F.lag("block_idx").over(w) > gap, F.lit(True)).cast("int")
    x = c.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    return x.groupBy(*DOC, "run").agg(
        F.min("block_idx").alias("first_block"),
        F.max("block_idx").alias("last_block"),
        F.count("*").alias("n_members"),
        F.round(F.avg(F.coalesce(F.col("toc_hint"), F.lit(False)).cast("int")), 6).alias("hint_share"),
    )


def contents_regions(c: DataFrame) -> DataFrame:
    """Runs that look like a table of contents: enough members, at least half with a hint."""
    return runs(c).where((F.col("n_members") >= RUN_LEAST) & (F.col("hint_share") >= 0.5))


def strong_duplicates(c: DataFrame, margin: float = DUPLICATE_MARGIN) -> DataFrame:
    """Later candidates of a key that score at least ``margin`` above the first of that key."""
    x = c.where("order_key is not null and score is not null")
    w = Window.partitionBy(*DOC, "kind", "order_key").orderBy("head_raw_start", "cand_no")
    first = F.first(F.struct("cand_no", "score")).over(w)
    y = x.withColumn("first_", first)
    gain = F.round(F.col("score").cast("double") - F.col("first_.score").cast("double"), 6)
    return y.where((F.col("cand_no") != F.col("first_.cand_no")) & (gain >= margin)).select(*DOC, "kind", "order_key", F.col("first_.cand_no").alias("first_cand"), "cand_no", gain.alias("gain"))


def best_unclaimed(c: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best candidate (score, then place) of every label that no node of the document has."""
    label = F.upper(F.trim("label_raw"))
    x = c.withColumn("label", label).where("label is not null and kind in ('item', 'part', 'article')")
    taken = nodes.where("label_raw is not null").select(*DOC, F.upper(F.trim("label_raw")).alias("label")).distinct()
    w = Window.partitionBy(*DOC, "label").orderBy(F.col("score").desc_nulls_last(), "head_raw_start", "cand_no")
    return x.join(taken, [*DOC, "label"], "left_anti").withColumn("r", F.row_number().over(w)).where("r = 1").select(*DOC, "label", "cand_no", F.round(F.col("score").cast("double"), 6).alias("score"))


def printed_names(values: DataFrame) -> DataFrame:
    """(kind, label_raw, label): what the parser's own reader calls each label; null where it reads none.

    Kinds are part, item (of annual reports), article, section and clause; of
    other kinds nothing is read.  A null label stays null.
    """

    def run(batches):
        by_kind: dict[str, list] = {}
        for g in (GRAMMARS["form10k"], GRAMMARS["contract"]):
            for lv in g.levels:
                by_kind.setdefault(lv.kind, []).append((g, lv))

        def name(kind: str | None, raw: str | None) -> str | None:
            for g, lv in by_kind.get(kind, ()):
                h = lv.scan(raw) if raw is not None else None
                read = g.read(lv, h) if h else None
                if read:
                    return read[0]
            return None

        for b in batches:
            names = [name(k, r) for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], names=["kind", "label_raw", "label"])

    return values.select("kind", "label_raw").mapInArrow(run, "kind string, label_raw string, label string")
