"""Analytics over node tables: sections, completeness, run comparison, draws, hashes, facets."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stemma.functions import labels as L

DOC = ["accession_number", "sequence"]
TINY, HUGE = 200, 0.6
# The columns that tell versions and are left out of hashes.
VERSIONS = ["parser_version", "normalizer_version"]


def item_keys(nodes: DataFrame) -> DataFrame:
    """Item keys of every document, once per node and covered item: DOC, key, raw_start, raw_end, covered."""
    own = nodes.where((F.col("level_kind") == "item") & F.col("label_canon").isNotNull())
    a = own.select(*DOC, F.substring_index("label_canon", " ", -1).alias("key"), "raw_start", "raw_end", F.lit(False).alias("covered"))
    b = own.where("covers_items is not null").select(*DOC, F.explode("covers_items").alias("key"), "raw_start", "raw_end", F.lit(True).alias("covered"))
    return a.unionByName(b)


def sections(nodes: DataFrame, labels: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Sections of the given labels, numbered where a label repeats; with their text if submissions are given."""
    hit = nodes.where(F.col("label_canon").isin(labels)).select(*DOC, "node_id", "label_canon", "title", "raw_start", "raw_end").distinct()
    w = Window.partitionBy(*DOC, "label_canon").orderBy("raw_start", "node_id")
    out = hit.withColumn("ordinal", F.row_number().over(w))
    if texts is None:
        return out
    t = texts.groupBy("accession_number").agg(F.max("text").alias("text"))
    n = F.greatest(F.col("raw_end") - F.col("raw_start"), F.lit(0))
    return out.join(t, "accession_number").withColumn("section", F.substr(F.col("text"), (F.col("raw_start") + 1).cast("int"), n.cast("int"))).drop("text")


def _form_documents(nodes: DataFrame, grammar: str, documents: DataFrame | None) -> DataFrame:
    """The distinct documents of a form's grammar: DOC, failed.  Those of ``documents`` too, if given, whether they have nodes or not.

    An EX-13 is read with the 10-K grammar but is no form and owes no items: it counts only if it has some.
    """
    item = (F.col("level_kind") == "item") & F.col("label_canon").isNotNull()
    x = nodes.where(F.col("grammar") == grammar).select(*DOC, "doc_type", F.lit(False).alias("failed"), item.alias("item"))
    if documents is not None:
        x = x.unionByName(documents.where(F.col("grammar") == grammar).select(*DOC, "doc_type", F.col("error").isNotNull().alias("failed"), F.lit(False).alias("item")))
    g = x.groupBy(*DOC).agg(F.max("doc_type").alias("doc_type"), F.max("failed").alias("failed"), F.max("item").alias("item"))
    return g.where(F.col("item") | ~F.coalesce(F.upper("doc_type").startswith("EX-13"), F.lit(False))).select(*DOC, "failed")


def document_metrics(nodes: DataFrame, years: DataFrame, quarterly: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """Completeness of every document against the items expected in its year.

    ``years`` has accession_number and filed_year; ``documents``, the table of a run, adds documents without nodes and
    those that failed.  Columns: n_items, n_expected, n_missing, missing, unexpected, in_order (first places rise with
    the items; without items true unless the parse failed), tiny and huge items, complete.  Quarterly, the expected items are the required
    ones; missing_omittable are those a filer may leave out, which are neither missing nor unexpected, and
    complete_with_omissions says that a complete document left out some.
    """
    grammar = "form10q" if quarterly else "form10k"
    k = item_keys(nodes.where(F.col("grammar") == grammar))
    first = k.groupBy(*DOC, "key").agg(F.min("raw_start").alias("at"), F.max(F.col("raw_end") - F.col("raw_start")).alias("size"))
    first = first.withColumn("ord", L.order_key(F.concat(F.lit("ITEM "), "key")))
    w = Window.partitionBy(*DOC).orderBy("ord", "key")
    first = first.withColumn("back", F.coalesce(F.col("at") < F.lag("at").over(w), F.lit(False)))
    span = nodes.groupBy(*DOC).agg((F.max("raw_end") - F.min("raw_start")).alias("doc_size"))
    x = first.join(span, DOC).groupBy(*DOC).agg(
        F.array_sort(F.collect_set("key")).alias("found"),
        (~F.max("back")).alias("in_order"),
        F.sum((F.col("size") < TINY).cast("int")).alias("n_tiny"),
        F.sum((F.col("size") > HUGE * F.col("doc_size")).cast("int")).alias("n_huge"),
    )
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"x.{c}")) for c in DOC]
    x = _form_documents(nodes, grammar, documents).alias("d").join(x.alias("x"), same, "left").select(
        *[F.col(f"d.{c}") for c in DOC],
        "failed",
        F.coalesce("found", F.array().cast("array<string>")).alias("found"),
        F.coalesce("in_order", ~F.col("failed")).alias("in_order"),
        F.coalesce("n_tiny", F.lit(0)).alias("n_tiny"),
        F.coalesce("n_huge", F.lit(0)).alias("n_huge"),
    )
    y = x.join(years.groupBy("accession_number").agg(F.min("filed_year").alias("filed_year")), "accession_number", "left")
    want = F.array_sort(L.expected_items(F.coalesce("filed_year", F.lit(0)), quarterly))
    may = F.array(*[F.lit(i) for i in L.OMITTABLE_10Q])
    missing, extra, left_out = F.array_except(want, "found"), F.array_except("found", want), F.array_except(may, "found")
    complete = (F.size(missing) == 0) & ~F.col("failed")
    return y.select(
        *DOC,
        "filed_year",
        F.size("found").alias("n_items"),
        F.size(want).alias("n_expected"),
        F.array_join(missing, ",").alias("missing"),
        F.array_join(F.array_except(extra, may) if quarterly else extra, ",").alias("unexpected"),
        "in_order",
        F.col("n_tiny").cast("int").alias("n_tiny"),
        F.col("n_huge").cast("int").alias("n_huge"),
        complete.alias("complete"),
        *([F.array_join(left_out, ",").alias("missing_omittable"), (complete & (F.size(left_out) > 0)).alias("complete_with_omissions")] if quarterly else []),
    )


def summarize(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Documents and mean completeness per group, with totals over all groups."""
    return metrics.rollup(*by).agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg(F.col("complete").cast("int")), 3).alias("complete_share"),
        F.round(F.avg(F.col("in_order").cast("int")), 3).alias("in_order_share"),
        F.round(F.avg("n_items"), 3).alias("mean_items"),
    )


def coverage(nodes: DataFrame, years: DataFrame, core: list[str]) -> DataFrame:
    """Per year: documents, and those that hold every core item exactly once with rising places."""
    k = item_keys(nodes).where(F.col("key").isin(core)).groupBy(*DOC, "key").agg(F.count("*").alias("n"), F.min("raw_start").alias("at"))
    k = k.withColumn("ord", L.order_key(F.concat(F.lit("ITEM "), "key")))
    back = F.coalesce(F.col("at") <= F.lag("at").over(Window.partitionBy(*DOC).orderBy("ord")), F.lit(False))
    d = k.withColumn("back", back).groupBy(*DOC).agg(F.count("*").alias("keys"), F.max("n").alias("most"), F.max("back").alias("back"))
    ok = (F.col("keys") == len(core)) & (F.col("most") == 1) & ~F.col("back")
    docs = nodes.select(*DOC).distinct().join(d.select(*DOC, ok.alias("ok")), DOC, "left")
    y = docs.join(years.groupBy("accession_number").agg(F.min("filed_year").alias("filed_year")), "accession_number", "left")
    return y.groupBy("filed_year").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("n_covered"))


def label_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels that one of two runs lacks, and labels whose place moved: DOC, label_canon, change."""
    first = lambda n: n.where("label_canon is not null").groupBy(*DOC, "label_canon").agg(F.min("raw_start").alias("at"))
    x, y = first(a).withColumnRenamed("at", "at_a"), first(b).withColumnRenamed("at", "at_b")
    both = x.join(y, [*DOC, "label_canon"], "full_outer")
    change = F.when(F.col("at_b").isNull(), "lost").when(F.col("at_a").isNull(), "gained").when(F.col("at_a") != F.col("at_b"), "moved")
    return both.withColumn("change", change).where("change is not null").select(*DOC, "label_canon", "change")


def meta_moves(a: DataFrame, b: DataFrame) -> DataFrame:
    """How often nodes of two runs change their region (meta), by pair of regions."""
    key = [*DOC, "node_id"]
    pick = lambda n, c: n.groupBy(*key).agg(F.max("meta").alias(c), F.max(F.array_join(F.col("path").cast("array<string>"), ".")).alias(f"path_{c}"))
    x = pick(a, "meta_a").join(pick(b, "meta_b"), key)
    return x.groupBy("meta_a", "meta_b").agg(F.count("*").alias("n_nodes"), F.sum((~F.col("path_meta_a").eqNullSafe(F.col("path_meta_b"))).cast("int")).alias("n_paths_changed"))


def draw_key(seed: str, *cols: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]), 256)


def bottom_k(df: DataFrame, stratum: list[str], k: int, seed: str, ident: list[str]) -> DataFrame:
    """The k rows of each stratum with the smallest keyed hash."""
    x = df.withColumn("draw", draw_key(seed, *ident))
    w = Window.partitionBy(*stratum).orderBy("draw", *ident)
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def largest_remainder(strata: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """``quota`` of n for each stratum in proportion to its size; what is left goes to the largest remainders (ties by key)."""
    everything = Window.partitionBy(F.lit(1))  # strata are few
    x = strata.withColumn("share", F.col(size) * F.lit(n) / F.sum(size).over(everything)).withColumn("floor", F.floor("share"))
    x = x.withColumn("rest", F.lit(n) - F.sum("floor").over(everything))
    w = everything.orderBy(F.round(F.col("share") - F.col("floor"), 9).desc(), key)
    quota = F.least(F.col("floor") + (F.row_number().over(w) <= F.col("rest")).cast("int"), F.col(size))
    return x.withColumn("quota", quota.cast("long")).select(key, size, "quota")


def compare_hashes(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer comparison of two hash lists: how many are equal, differ, or are only on one side."""
    x, y = a.select(*key, F.col(value).alias("ha")).distinct(), b.select(*key, F.col(value).alias("hb")).distinct()
    j = x.withColumn("ina", F.lit(True)).join(y.withColumn("inb", F.lit(True)), key, "full_outer")
    state = (
        F.when(F.col("inb").isNull(), "only_left").when(F.col("ina").isNull(), "only_right").when(F.col("ha").isNull() | F.col("hb").isNull(), "unknown").when(F.col("ha") == F.col("hb"), "equal").otherwise("differs")
    )
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def canonical(rows: DataFrame) -> Column:
    """A row as one string: its columns in order of name, nulls told from empty texts, numbers with six decimals.

    Version stamps don't count.
    """
    parts = []
    for f in sorted(rows.schema.fields, key=lambda f: f.name):
        if f.name in VERSIONS:
            continue
        c, kind = F.col(f.name), f.dataType.simpleString()
        if kind in ("float", "double"):
            text = F.when(F.isnan(c), "nan").otherwise(F.coalesce(c.try_cast("decimal(28,6)").cast("string"), c.cast("string")))
        elif kind.startswith("array"):
            text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("~"))), ","), F.lit("]"))
        else:
            text = c.cast("string")
        parts.append(F.concat(F.lit(f.name), F.coalesce(F.concat(F.lit("="), text), F.lit("~"))))
    return F.concat_ws("\x1f", *parts)


def _row_hashes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of every row with ``h``, the SHA-256 of its canonical form."""
    return rows.select(*columns, F.sha2(canonical(rows), 256).alias("h"))


def document_hashes(nodes: DataFrame, key: list[str] = DOC, order: str = "node_id", rejected: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """SHA-256 of the canonical node rows and then the rejected rows of each document, whatever order and version they come in.

    Rows are hashed where they are; only the hashes of a document's rows meet, nodes in order of the node (copies
    count once), rejected rows in order of their hash (copies count).  With ``documents`` there is one row per row of
    it, with its input_sha256 and input_bytes: the output hash is null where error is set, and that of no rows where
    nothing was found; rows of a document that isn't there are an error.
    """
    kind = nodes.schema[order].dataType
    each = _row_hashes(nodes, [*key, order]).distinct().select(*key, F.lit(0).alias("side"), F.col(order).alias("o"), "h")
    if rejected is not None:
        each = each.unionByName(_row_hashes(rejected, key).select(*key, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("o"), "h"))
    g = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("side", "o", "h"))).alias("rows"))
    if documents is None:
        known, about = g, []
    else:
        about = [c for c in ("input_sha256", "input_bytes") if c in documents.columns]
        known = documents.select(*key, *about, "error", F.lit(True).alias("there")).join(g, key, "full_outer")
    part = lambda side: F.transform(F.filter(F.coalesce("rows", F.array().cast(g.schema["rows"].dataType)), lambda x: x["side"] == side), lambda x: x["h"])
    digest = F.sha2(F.array_join(F.concat(F.array(F.lit("nodes")), part(0), F.array(F.lit("rejected")), part(1)), "\n"), 256)
    if documents is not None:
        stray = F.raise_error(F.concat(F.lit("rows of a document that is not in documents: "), F.concat_ws(" ", *key))).cast("string")
        digest = F.when(F.col("there").isNull(), stray).when(F.col("error").isNull(), digest)
    return known.select(*key, *about, digest.alias("output_sha256"), F.size(part(0)).cast("long").alias("n_nodes"), F.size(part(1)).cast("long").alias("n_rejected"))


def facets(df: DataFrame, columns: list[str], chosen: dict[str, list]) -> DataFrame:
    """Counts per value of every column under the filters of the other columns."""
    out = None
    for c in columns:
        x = df
        for other, values in chosen.items():
            if other != c:
                x = x.where(F.col(other).isin([v for v in values if v is not None]) | (F.col(other).isNull() if None in values else F.lit(False)))
        part = x.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def search(df: DataFrame, text_columns: list[str], words: str, **equal) -> DataFrame:
    """Rows whose columns equal the given values and whose texts hold the words, blanks and case apart."""
    joined = F.lower(F.regexp_replace(F.concat_ws(" ", *text_columns), r"\s+", " "))
    out = df.where(joined.contains(" ".join(words.lower().split())))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def contract_stats(nodes: DataFrame) -> DataFrame:
    """Per exhibit: clauses, greatest depth, nodes, and whether it has enough for a sample."""
    x = nodes.where("grammar = 'contract'").select(*DOC, "cik", "node_id", "depth", "level_kind").distinct()
    g = x.groupBy(*DOC).agg(F.max("cik").alias("cik"), F.count("*").alias("n_nodes"), F.sum(F.col("level_kind").startswith("clause").cast("int")).alias("n_clauses"), F.max("depth").cast("int").alias("max_depth"))
    return g.withColumn("rich", F.coalesce(F.col("n_clauses"), F.lit(0)) >= 20)


def score_places(found: DataFrame, truth: DataFrame, key: list[str], at: str, tolerance: int = 50) -> DataFrame:
    """One-to-one matches of equal keys at most ``tolerance`` apart: hits, false finds and misses per document.

    ``key`` begins with the two columns of the document.  The places of a key are merged in order, and each true place
    takes the first free found place within reach, which gives the most matches; equal places count each for itself.
    Nulls in a key meet nulls.  Null places match nothing.
    """
    f = found.select(*key, F.col(at).cast("long").alias("at"), F.lit(False).alias("true"))
    t = truth.select(*key, F.col(at).cast("long").alias("at"), F.lit(True).alias("true"))
    doc = key[:2]
    both = f.unionByName(t).repartition(*key).sortWithinPartitions(*key, "at", "true")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, tally = None, deque(), [0, 0, 0]
        sums: dict[tuple, list[int]] = {}

        def rows(docs: list[tuple]) -> pa.RecordBatch:
            heads = [pa.array([d[i] for d in docs], both_schema.field(i).type) for i in range(2)]
            return pa.RecordBatch.from_arrays([*heads, *[pa.array([sums[d][k] for d in docs], pa.int64()) for k in range(3)]], names=[*doc, "tp", "fp", "fn"])

        def close() -> None:
            if now is not None:
                for place, is_true in waiting:
                    tally[2 if is_true else 1] += 1
                own = sums.setdefault(now[:2], [0, 0, 0])
                for k in range(3):
                    own[k] += tally[k]

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for *k, place, is_true in zip(*cols):
                if tuple(k) != now:
                    close()
                    now, tally = tuple(k), [0, 0, 0]
                    waiting = deque()
                while waiting and (place is None or place - waiting[0][0] > tolerance):
                    tally[2 if waiting.popleft()[1] else 1] += 1
                if place is None:
                    tally[2 if is_true else 1] += 1
                elif waiting and waiting[0][1] != is_true:
                    waiting.popleft()
                    tally[0] += 1
                else:
                    waiting.append((place, is_true))
            # Documents come in order: all but the one at hand are done.
            yield rows([d for d in sums if d != now[:2]])
            sums = {d: n for d, n in sums.items() if d == now[:2]}
        close()
        yield rows(list(sums))

    both_schema = to_arrow_schema(both.schema)
    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in doc)
    return both.mapInArrow(run, f"{kinds}, tp bigint, fp bigint, fn bigint").groupBy(*doc).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def anchor_status(anchors: DataFrame, nodes: DataFrame, rejected: DataFrame, at: str) -> DataFrame:
    """Whether a node, a dropped candidate or nothing stands at each place (nodes first)."""
    n = nodes.select(*DOC, F.col("head_raw_start").alias(at), F.lit(True).alias("accepted")).distinct()
    r = rejected.select(*DOC, F.col("head_raw_start").alias(at), F.lit(True).alias("dropped")).distinct()
    x = anchors.join(n, [*DOC, at], "left").join(r, [*DOC, at], "left")
    return x.withColumn("status", F.when(F.col("accepted"), "accepted").when(F.col("dropped"), "rejected").otherwise("absent")).drop("accepted", "dropped")
