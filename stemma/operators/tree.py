"""Span, parent, path and nearest-row operators over nodes and blocks of documents.

Rows of one document meet in one partition and are worked on with windows whose
order is total, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATH_LENGTH = 8


def deepest(nodes: DataFrame, depth: str) -> int:
    """Greatest depth of a table: one small aggregate, so that windows are made for the depths there are."""
    return max(0, nodes.agg(F.max(depth).cast("int").alias("d")).first()["d"] or 0)


def span_ends(nodes: DataFrame, doc: list[str], start: str, depth: str, end_of_doc: str) -> DataFrame:
    """``span_end``: start of the next node at the same or a lower depth, else the end of the document."""
    # Backwards, so that the running minimum grows row by row instead of being taken anew for every row.
    w = Window.partitionBy(*doc).orderBy(F.col(start).desc()).rangeBetween(Window.unboundedPreceding, -1)
    per_depth = [F.min(F.when(F.col(depth) <= k, F.col(start))).over(w) for k in range(deepest(nodes, depth) + 1)]
    ends = F.try_element_at(F.array(*per_depth), F.greatest(F.col(depth).cast("int"), F.lit(0)) + 1)
    return nodes.withColumn("span_end", F.coalesce(ends, F.col(end_of_doc)))


def parents_by_depth(nodes: DataFrame, doc: list[str], order: list[str], depth: str, node: str) -> DataFrame:
    """``found_parent``: the last node before with a lower depth, -1 if there is none."""
    w = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per_depth = [F.last(F.when(F.col(depth) < k, F.col(node)), ignorenulls=True).over(w) for k in range(1, deepest(nodes, depth) + 1)]
    found = F.try_element_at(F.array(F.lit(None).cast("int"), *per_depth), F.greatest(F.col(depth).cast("int"), F.lit(0)) + 1)
    return nodes.withColumn("found_parent", F.coalesce(found, F.lit(-1)))


def sibling_ordinals(nodes: DataFrame, doc: list[str], parent: str, order: list[str], segment: str | None = None) -> DataFrame:
    """``ordinal`` from 1 among the nodes of one parent, counted anew in each segment."""
    keys = [*doc, parent, *([segment] if segment else [])]
    return nodes.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def path_string(path: str = "path"):
    return F.array_join(F.col(path).cast("array<string>"), ".")


def level_profile(nodes: DataFrame, doc: list[str], depth: str, kind: str) -> DataFrame:
    """Per document and depth the most frequent kind (ties by name), its count, and the number of nodes."""
    c = nodes.groupBy(*doc, depth, kind).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*doc, depth)
    return (
        c.withColumn("total", F.sum("n").over(w))
        .withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), F.col(kind).asc_nulls_last())))
        .where("r = 1")
        .select(*doc, depth, F.col(kind).alias("modal_kind"), F.col("n").alias("n_modal"), F.col("total").alias("n_nodes"))
    )


def truncate_spans(nodes: DataFrame, boundary: DataFrame, doc: list[str]) -> DataFrame:
    """Spans that begin before the boundary of their document (columns doc, back_start) end there at the latest."""
    cut = (F.col("raw_start") < F.col("back_start")) & (F.col("raw_end") > F.col("back_start"))
    return nodes.join(boundary, doc, "left").withColumn("cut_end", F.when(cut, F.col("back_start")).otherwise(F.col("raw_end"))).drop("back_start")


def latest_before(events: DataFrame, states: DataFrame, by: list[str], at: str, since: str, value: str) -> DataFrame:
    """As-of join backwards: ``value`` of the last state at or before each event, null before the first.

    Events and states go into one ordered stream; a state comes before an event at the same place.
    Of several states at one place the largest value counts.
    """
    e = events.withColumn("pos_", F.col(at).cast("long")).withColumn("state_", F.lit(1)).withColumn("value_", F.lit(None).cast(states.schema[value].dataType))
    s = states.groupBy(*by, F.col(since).cast("long").alias("pos_")).agg(F.max(value).alias("value_")).withColumn("state_", F.lit(0))
    w = Window.partitionBy(*by).orderBy("pos_", "state_").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(s, allowMissingColumns=True).withColumn("found_", F.last("value_", ignorenulls=True).over(w))
    return both.where("state_ = 1").drop("pos_", "state_", "value_").withColumnRenamed("found_", f"{value}_before")


def containing(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Range join inside a document: points with the spans [start, end) that hold them."""
    return points.join(spans, by).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def nearest_ahead(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, ident: str, ahead: int = 400) -> DataFrame:
    """The span that holds each point, else the next one that begins within ``ahead``; null if neither."""
    holds = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    near = (F.col(start) >= F.col(at)) & (F.col(start) <= F.col(at) + ahead)
    hit = points.join(spans.select(*by, start, end, ident), by).where(holds | near)
    best = hit.groupBy(*points.columns).agg(F.min(F.struct((~holds).alias("far"), F.col(start).alias("s"), F.col(ident).alias("i"))).alias("b"))
    return points.join(best.select(*points.columns, F.col("b.i").alias("near_id")), points.columns, "left")


# ---------------------------------------------------------------- chains


def heaviest_chain(keys: list[int], weights: list[float]) -> list[int]:
    """Indices of the heaviest subsequence with strictly rising keys, in O(n log n).

    Of equal weights (to 9 digits along the way, to 6 at the end) the later member is taken.
    A tree of prefix maxima over the ranks of the keys gives the best chain that a member can follow.
    """
    n = len(keys)
    rank = {k: i for i, k in enumerate(sorted(set(keys)), 1)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    best, back = [0.0] * n, [-1] * n
    for i in range(n):
        top = (0.0, -1)
        r = rank[keys[i]] - 1
        while r > 0:
            top = max(top, tree[r])
            r -= r & -r
        if top[0] > 1e-9:
            back[i] = top[1]
        best[i] = round(weights[i] + max(0.0, top[0]), 9)
        r = rank[keys[i]]
        while r < len(tree):
            tree[r] = max(tree[r], (best[i], i))
            r += r & -r
    if not n:
        return []
    at = max(range(n), key=lambda i: (round(best[i], 6), i))
    out = []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def _mark_chains(group: list[str], key: str, weight: str):
    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        keys, weights = t[key].to_pylist(), t[weight].to_pylist()
        at = [i for i, (k, w) in enumerate(zip(keys, weights)) if k is not None and w is not None]
        picked = {at[i] for i in heaviest_chain([int(keys[i]) for i in at], [float(weights[i]) for i in at])}
        flags = pa.chunked_array([pa.array([i in picked for i in range(t.num_rows)], pa.bool_())])
        return t.append_column("chosen", flags).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            names = list(zip(*[b.column(b.schema.get_field_index(g)).to_pylist() for g in group]))
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if held and names[i] != last:
                    yield done(held)
                    held = []
                held.append(b.slice(i, j - i))
                last = names[i]
                i = j
        if held:
            yield done(held)

    return run


def pick_chains(candidates: DataFrame, group: list[str], order: list[str], key: str, weight: str) -> DataFrame:
    """Marks the members of the heaviest rising chain of each group in ``chosen``.

    Groups (documents) are spread by hash, sorted, and streamed: a task holds one document at a time.
    Rows without key or weight aren't chosen.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields]
    spread = candidates.repartition(*group).sortWithinPartitions(*group, *order)
    return spread.mapInArrow(_mark_chains(group, key, weight), ", ".join([*fields, "chosen boolean"]))
