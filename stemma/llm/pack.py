"""Filling containers of fixed capacity by minimum bin slack.

Only the histogram of item lengths decides how containers are filled: at most
``capacity`` lengths with a count each, however many items there are.  The
planner takes the longest length left, finds by a bitset subset-sum over the
remaining multiset the fill closest to the capacity, backtracks how often each
length is in it, and repeats this pattern for as many containers as the counts
allow.  Every item then finds its container from its rank among the items of
its length: ranks are counted within salted buckets and shifted by the totals of
the buckets before, so a length that a third of all items share is no hot spot.

Defined results: an item longer than the capacity is cut into full pieces and a
rest (pieces numbered from 0); no other item is cut.  An item of length 0 (null
or empty text) takes no room and goes into container 1.  Specs without a
positive capacity are left out.  Repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm import tokenize
from stemma.session import materialize

#: Items per bucket when ranks are counted.
BUCKET_ROWS = 500_000
LEAST_BUCKETS = 16


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of which lengths (descending) sum up closest to ``room`` without exceeding it."""
    mask = (1 << room + 1) - 1
    goal = 1 << room
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for n in lengths:
        if n > room:
            continue
        left = min(counts[n], room // n)
        k = 1
        while left > 0:
            k = min(k, left)
            grown = reach | reach << n * k & mask
            if grown != reach:
                steps.append((n, k, reach))
                reach = grown
            left -= k
            k *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + k
            at -= n * k
    return used


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(how many of each length go into a container, number of such containers)."""
    counts = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        fill = best_fill(lengths if counts[top] else lengths[1:], counts, capacity - top) if capacity > top else {}
        counts[top] += 1
        fill[top] = fill.get(top, 0) + 1
        times = min(counts[n] // k for n, k in fill.items())
        out.append((fill, times))
        gone = False
        for n, k in fill.items():
            counts[n] -= k * times
            gone |= not counts[n]
        if gone:
            lengths = [n for n in lengths if counts[n]]
    return out


def _plan_rows(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(tables))
    spec = np.asarray(t["spec_no"])
    cap, length, n = (np.asarray(t[c]) for c in ("capacity", "length", "n"))
    rows: list[tuple[int, int, int, int, int]] = []
    for s in np.unique(spec):
        at = spec == s
        first = 1
        used: dict[int, int] = {}
        for fill, times in plan_patterns(dict(zip(length[at].tolist(), n[at].tolist())), int(cap[at][0])):
            for size, k in fill.items():
                rows.append((int(s), size, used.get(size, 0), first, k))
                used[size] = used.get(size, 0) + k * times
            first += times
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["spec_no", "length", "rank_from", "container_from", "per_container"])


def pieces(sizes: DataFrame, specs: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """Items of every spec: ``keep`` columns, spec_no, capacity, piece_no, length."""
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_no"), F.lit(c).cast("int").alias("capacity")) for s, c in specs]))
    n, cap = F.col("n_tokens"), F.col("capacity")
    full = F.floor((n - 1) / cap).cast("int")
    return (
        sizes.withColumn("spec", each)
        .select(*keep, "n_tokens", "spec.*")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(full, F.lit(0)))))
        .select(*keep, "spec_no", "capacity", "piece_no", F.least(cap, n - F.col("piece_no") * cap).cast("int").alias("length"))
    )


def _place(plan: pa.Table):
    """Container of each (spec_no, length, rank), by one binary search over all rank ranges."""
    spec, length, start, first, per = (np.asarray(plan[c]).astype(np.int64) for c in ("spec_no", "length", "rank_from", "container_from", "per_container"))
    order = np.lexsort((start, length, spec))
    spec, length, start, first, per = (x[order] for x in (spec, length, start, first, per))
    group = spec << 32 | length
    groups, begin = np.unique(group, return_index=True)
    end = np.append(begin[1:], len(group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rank = np.asarray(cols["rank"])
            want = np.asarray(cols["spec_no"]).astype(np.int64) << 32 | np.asarray(cols["length"]).astype(np.int64)
            out = np.ones(len(rank), np.int64)
            some = np.flatnonzero(np.asarray(cols["length"]) > 0)
            by = some[np.lexsort((rank[some], want[some]))]
            if len(by):
                kinds, where = np.unique(want[by], return_index=True)
                stop = np.append(where[1:], len(by))
                for g, x, y in zip(np.searchsorted(groups, kinds), where, stop):
                    lo, hi = begin[g], end[g]
                    r = rank[by[x:y]]
                    i = lo + np.searchsorted(start[lo:hi], r, "right") - 1
                    out[by[x:y]] = first[i] + (r - start[i]) // per[i]
            rest = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[cols[n] for n in rest], pa.array(out)], names=[*rest, "container_id"])

    return run


def pack(sizes: DataFrame, specs: list[tuple[int, int]], keep: list[str], order: str) -> DataFrame:
    """Container of every piece of every item, for each (spec_no, capacity).

    ``sizes`` has the ``keep`` columns and ``n_tokens``; ``order`` names the kept
    column that breaks ties.  Columns: keep, spec_no, capacity, piece_no, length, container_id.
    """
    specs = [(s, c) for s, c in specs if s is not None and c is not None and c > 0]
    spark = sizes.sparkSession
    kept = ", ".join(f"`{c}` {sizes.schema[c].dataType.simpleString()}" for c in keep)
    if not specs:
        return spark.createDataFrame([], f"{kept}, spec_no int, capacity int, piece_no int, length int, container_id bigint")
    # Equal sizes are counted before they are split by spec.
    by_size = sizes.groupBy("n_tokens").agg(F.count("*").alias("n"))
    histogram = pieces(by_size, specs, ["n"]).groupBy("spec_no", "capacity", "length").agg(F.sum("n").alias("n"))
    # At most `capacity` rows per spec, whatever the number of items.
    plan = histogram.coalesce(1).mapInArrow(_plan_rows, "spec_no int, length int, rank_from bigint, container_from bigint, per_container int").toArrow()
    total = sizes.count()
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS + 1)
    items = pieces(sizes, specs, keep).withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    from pyspark.sql import Window

    place = ["spec_no", "length", "bucket"]
    within = F.row_number().over(Window.partitionBy(*place).orderBy(order, "piece_no")) - 1
    # At most capacity x buckets rows per spec.
    before = items.groupBy(*place).agg(F.count("*").alias("n"))
    w = Window.partitionBy("spec_no", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*place, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    ranked = (
        items.withColumn("within", within)
        .join(before, place)
        .select(*keep, "spec_no", "capacity", "piece_no", "length", (F.col("within") + F.col("base")).cast("long").alias("rank"))
    )
    return ranked.mapInArrow(_place(plan), f"{kept}, spec_no int, capacity int, piece_no int, length int, container_id bigint")


def pack_texts(documents: DataFrame, specs: DataFrame, folder: str = tokenize.TOKENIZER_DIR) -> DataFrame:
    """Pack ``documents`` (doc_id, text) for every row of ``specs`` (spec_no, capacity_tokens, tokenizer).

    ``specs`` is a configuration table: one row per container size.
    """
    given = sorted({(r["tokenizer"], r["spec_no"], r["capacity_tokens"]) for r in specs.collect() if r["capacity_tokens"] is not None and r["spec_no"] is not None and r["tokenizer"] is not None})
    parts = []
    for name in sorted({t for t, _, _ in given}):
        sizes = materialize(tokenize.count_column(documents, "text", ["doc_id"], name, folder), "sizes").df
        parts.append(pack(sizes, [(s, c) for t, s, c in given if t == name], ["doc_id"], "doc_id"))
    if not parts:
        kept = documents.select("doc_id").withColumn("n_tokens", F.lit(0))
        return pack(kept, [], ["doc_id"], "doc_id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_report(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, containers needed at least, and the share of room left unused."""
    room = F.col("n_containers") * F.col("capacity")
    return (
        packed.groupBy("spec_no", "capacity", "container_id")
        .agg(F.sum("length").alias("filled"))
        .groupBy("spec_no", "capacity")
        .agg(F.count("*").alias("n_containers"), F.sum("filled").alias("n_tokens"), F.max("filled").cast("long").alias("fullest"))
        .select("spec_no", "capacity", "n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("n_least"), F.round(1 - F.col("n_tokens") / room, 6).alias("unused_share"))
    )
