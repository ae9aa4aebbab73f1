"""Window operators over the blocks of documents: page breaks, evidence before and after, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import phrases
from stemma.operators.tree import latest_before

DOC = ["accession_number", "sequence"]
# Shapes of page furniture and of prose, and bounds.
FURNITURE = r"(?i)^\s*(?:-\s*\d+\s*-|page\s+\d+|\d{1,3}|[ivx]{1,5})\s*$"
CAPTION, BACK_HEAD = phrases.opening(phrases.CAPTIONS), phrases.opening([*phrases.BACK_HEADS, *phrases.WITNESS])
INSTRUMENT = phrases.pattern(phrases.INSTRUMENTS)
PROSE = r"[a-z]{3,}\s+[a-z]{3,}\s+[a-z]{3,}"
LOOK_BACK, LOOK_AHEAD = 60, 6000


def _order(w=None):
    return Window.partitionBy(*DOC).orderBy("idx")


def page_distance(blocks: DataFrame) -> DataFrame:
    """Visible characters between each block and the last page break before it; null before the first break."""
    is_break = F.coalesce(F.col("is_page_break"), F.lit(False)).cast("int")
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.coalesce(F.col("text").rlike(FURNITURE), F.lit(True)), 0).otherwise(F.length("text"))
    x = blocks.withColumn("brk", is_break).withColumn("size", F.when(is_break == 1, 0).otherwise(size))
    x = x.withColumn("page", F.coalesce(F.sum("brk").over(before), F.lit(0)))
    within = Window.partitionBy(*DOC, "page").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("distance", F.when(F.col("page") > 0, F.coalesce(F.sum("size").over(within), F.lit(0)))).select(*DOC, "idx", F.col("distance").cast("long").alias("distance"))


def evidence_before(blocks: DataFrame, pattern: str, limit: int = LOOK_BACK) -> DataFrame:
    """Distance back to the nearest block that matches, among the last ``limit``; null if there is none."""
    w = _order().rowsBetween(-limit, 0)
    hit = F.when(F.coalesce(F.col("text").rlike(pattern), F.lit(False)), F.col("idx"))
    return blocks.withColumn("at", F.last(hit, ignorenulls=True).over(w)).select(*DOC, "idx", (F.col("idx") - F.col("at")).alias("back"))


def evidence_after(blocks: DataFrame, pattern: str, limit: int = LOOK_AHEAD) -> DataFrame:
    """How many of the next ``limit`` blocks match."""
    w = _order().rowsBetween(1, limit)
    hit = F.coalesce(F.col("text").rlike(pattern), F.lit(False)).cast("int")
    return blocks.withColumn("n", F.coalesce(F.sum(hit).over(w), F.lit(0))).select(*DOC, "idx", F.col("n").cast("long").alias("n_after"))


def first_back_heads(blocks: DataFrame) -> DataFrame:
    """Per document the first block that opens like back matter, behind the first half of the text."""
    x = blocks.withColumn("top", F.max("norm_end").over(Window.partitionBy(*DOC)))
    hit = x.where(F.col("text").rlike(BACK_HEAD) & (F.col("norm_start") * 2 >= F.col("top")))
    return hit.groupBy(*DOC).agg(F.min("idx").alias("idx"), F.min("raw_start").alias("back_start"))


def instrument_titles(blocks: DataFrame) -> DataFrame:
    """Blocks of capitals that name an instrument."""
    return blocks.where(F.length("text").between(4, 140) & (F.col("caps_ratio") >= 0.8) & F.col("text").rlike(INSTRUMENT)).select(*DOC, "idx")


def prose_blocks_between(blocks: DataFrame) -> DataFrame:
    """Number of prose paragraphs before each block (a prefix sum: what lies between two blocks is a difference)."""
    w = _order().rowsBetween(Window.unboundedPreceding, -1)
    hit = F.coalesce((F.length("text") > 200) & F.col("text").rlike(PROSE), F.lit(False)).cast("int")
    return blocks.withColumn("n", F.coalesce(F.sum(hit).over(w), F.lit(0))).select(*DOC, "idx", F.col("n").cast("long").alias("prose_before"))


def norm_to_raw(points: DataFrame, blocks: DataFrame, at: str) -> DataFrame:
    """Raw offset of places in the normalised text: in the last block that begins at or before, not beyond its end."""
    seg = F.struct(F.col("norm_start").alias("n"), F.col("raw_start").alias("r"), F.col("raw_end").alias("e"))
    states = blocks.select(*DOC, F.col("norm_start").alias("since"), seg.alias("seg"))
    x = latest_before(points, states, DOC, at, "since", "seg")
    s = F.col("seg_before")
    return x.withColumn("raw", F.least(s["r"] + F.col(at) - s["n"], s["e"])).drop("seg_before")
