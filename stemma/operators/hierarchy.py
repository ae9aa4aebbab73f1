"""Parent-child rows to full hierarchies by parallel tree contraction.

Every round of a contraction removes, in one pass over what is left,

* *rake*: every leaf, recording the node it hung on;
* *compress*: an independent set of nodes with exactly one child, whose child
  is hooked to the node above.  A node is taken when its coin of the round is
  smaller than those of the node above and the child below, so no two
  neighbours go together.

A tree of n nodes, however deep or broad, is gone after O(log n) rounds.  A
cycle can't be raked away; compression shrinks it to a node that is its own
parent.  Such cores are where contraction doesn't end, and they expose the
cycles.  Reversing the recorded rounds gives root, depth, cycle membership and
subtree size of every removed node; paths follow from the recorded parents.

Where the rounds run:

1. Rows are laid out in blocks of neighbouring ids of one group (at most
   2 ** BLOCK_BITS distinct ids, so a block fits a task whatever the size of
   its group).  Each block is contracted where it lies, in numpy; nodes with a
   child in another block, or whose parent is in another block, are *held*.
2. If no parent lies in another block than its child, that was all.  Otherwise
   the held nodes, with what was compressed between them, are contracted by
   rounds of joins on (group, node) until REST_ROWS or fewer are left, which one
   task finishes.  All sizes give the same rows.

A node with very many children is no hot spot: its children are counted where
they lie and only counts move.  Copies are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.session import Materialized, materialize

#: A block holds the ids that agree above these many low bits.
BLOCK_BITS = 16
#: Held nodes that one task finishes; more than these go through rounds of joins first.
REST_ROWS = 500_000
MAX_ROUNDS = 10_000
#: Path elements that one Arrow batch may hold.
BATCH_ELEMENTS = 1 << 20

DONE, HUNG, HELD = 0, 1, 2
ROOT, ELSEWHERE = -1, -2


# ---------------------------------------------------------------- one block


class Forest:
    """Contraction of the nodes at hand; ``up`` is the place of the parent, ROOT, or ELSEWHERE."""

    def __init__(self, up: np.ndarray, pinned: np.ndarray, size: np.ndarray, extra: np.ndarray, gap: np.ndarray, stated: np.ndarray) -> None:
        self.n = len(up)
        self.first_up, self.pinned, self.stated = up, pinned, stated
        self.up, self.size, self.extra, self.gap = up.copy(), size.copy(), extra.copy(), gap.copy()
        self.rounds: list[tuple] = []
        self.live = np.arange(self.n)
        self.core = np.zeros(self.n, bool)
        self._contract()
        self._replay()

    def _contract(self) -> None:
        n, up = self.n, self.up
        rng = np.random.default_rng(n)
        live = self.live
        only = np.zeros(n, np.int64)
        while len(live):
            over = up[live]
            hung = (over >= 0) & (over != live)
            kids = np.bincount(over[hung], minlength=n)
            only[over[hung]] = live[hung]
            leaf = (kids[live] == 0) & ~self.pinned[live]
            tops = live[leaf & (over == ROOT)]
            cores = live[leaf & (over == live)]
            rake = live[leaf & hung]
            unary = live[(kids[live] == 1) & ~self.pinned[live] & hung]
            below = only[unary]
            inner = (kids[below] > 0) | self.pinned[below]
            unary, below = unary[inner], below[inner]
            coin = rng.permutation(n)
            over_u = up[unary]
            take = (coin[unary] < coin[over_u]) & ((coin[unary] < coin[below]) | (over_u == below))
            mid, low, high = unary[take], below[take], up[unary[take]]
            if not len(tops) + len(cores) + len(rake) + len(mid):
                break
            np.add.at(self.size, up[rake], self.size[rake] + self.extra[rake])
            self.rounds.append((tops, cores, rake, up[rake], self.gap[rake], mid, low, high, self.gap[mid], self.extra[low]))
            self.core[cores] = True
            self.extra[low] += self.extra[mid] + self.size[mid]
            self.gap[low] += self.gap[mid]
            up[low] = high
            gone = np.zeros(n, bool)
            for part in (tops, cores, rake, mid):
                gone[part] = True
            live = live[~gone[live]]
        self.live = live

    def _replay(self) -> None:
        n = self.n
        self.top = np.arange(n)
        self.dist = np.zeros(n, np.int64)
        self.total = self.size.copy()
        self.on_cycle = self.core.copy()
        #: held node whose fate decides whether this one lies on a cycle
        self.below = np.full(n, -1, np.int64)
        held = np.zeros(n, bool)
        held[self.live] = True
        self.held = held
        for _tops, _cores, rake, on, gap, mid, low, high, gap_mid, extra in reversed(self.rounds):
            self.top[mid] = self.top[high]
            self.dist[mid] = self.dist[high] + gap_mid
            self.on_cycle[mid] = self.on_cycle[low]
            self.below[mid] = np.where(held[low], low, self.below[low])
            self.total[mid] = self.size[mid] + extra + np.where(held[low], 0, self.total[low])
            self.top[rake] = self.top[on]
            self.dist[rake] = self.dist[on] + gap

    def status(self) -> np.ndarray:
        """0 tree, 1 orphan, 2 cycle, 3 below_cycle; of held tops it has no meaning."""
        at_core = self.core[self.top]
        return np.where(self.on_cycle, 2, np.where(at_core, 3, np.where(self.stated[self.top], 1, 0)))


def _places(codes: np.ndarray, ids: np.ndarray, want_codes: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Place of each wanted (group, id) among the given ones, -1 if it isn't there."""
    if not len(ids) or not len(want):
        return np.full(len(want), -1, np.int64)
    values, ranks = np.unique(np.concatenate([ids, want]), return_inverse=True)
    key = np.concatenate([codes, want_codes]) * len(values) + ranks
    own, asked = key[: len(ids)], key[len(ids) :]
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], asked), len(ids) - 1)
    return np.where(own[order][at] == asked, order[at], -1)


def _walk(first_up: np.ndarray, stops: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
    """(node, level) below each start in depth-first order; stops are listed, not entered."""
    child_of = np.flatnonzero((first_up >= 0) & wanted)
    order = child_of[np.argsort(first_up[child_of], kind="stable")]
    counts = np.bincount(first_up[order], minlength=len(first_up))
    ends = np.cumsum(counts)
    begin, end, kids = (ends - counts).tolist(), ends.tolist(), order.tolist()
    stop = stops.tolist()
    for s in starts.tolist():
        stack = [(s, 0)]
        while stack:
            u, level = stack.pop()
            yield u, level
            if not level or not stop[u]:
                for c in reversed(kids[begin[u] : end[u]]):
                    stack.append((c, level + 1))


def _codes(t: pa.Table, names: list[str]) -> np.ndarray:
    code = np.zeros(t.num_rows, np.int64)
    for c in names:
        col = t[c].combine_chunks()
        part = np.asarray(col.dictionary_encode(null_encoding="encode").indices).astype(np.int64)
        code = np.unique(code * (int(part.max()) + 1) + part, return_inverse=True)[1] if len(part) else code
    return code


_STATUS = np.array(["tree", "orphan", "cycle", "below_cycle"])


def _longs(a: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    return pa.array(a, pa.int64(), mask=None if there is None else ~there)


def _numbers(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, is there)."""
    c = t[name].combine_chunks()
    return np.asarray(c.fill_null(0)).astype(np.int64), np.asarray(c.is_valid())


def _solve(t: pa.Table, group: list[str], bits: int | None, want: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Contract the nodes of whole blocks (or, with ``bits`` None, of whole groups with vias and weights)."""
    stub = np.asarray(t["stub"]) if bits is not None else np.zeros(t.num_rows, bool)
    codes = _codes(t, group)
    ids, _ = _numbers(t, "id")
    nodes = np.flatnonzero(~stub)
    own, own_codes = ids[nodes], codes[nodes]
    p, has_p = _numbers(t, "p")
    p, has_p = p[nodes], has_p[nodes]
    n = len(nodes)
    up = np.full(n, ROOT, np.int64)
    found = _places(own_codes, own, own_codes[has_p], p[has_p])
    up[has_p] = found
    pinned = np.zeros(n, bool)
    vias: list = []
    if bits is not None:
        up[has_p & ((p >> bits) != (own >> bits))] = ELSEWHERE
        hit = _places(own_codes, own, codes[stub], ids[stub])
        pinned[hit[hit >= 0]] = True
        size, extra, gap, stated, has_stated = np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), p, has_p
    else:
        vias = t["via"].to_pylist()
        (size, _), (extra, _) = _numbers(t, "size"), _numbers(t, "extra")
        gap = np.array([len(v) + 1 for v in vias], np.int64)
        stated, has_stated = _numbers(t, "stated")
    f = Forest(up, pinned, size, extra, gap, has_stated)
    status = f.status()
    free = np.zeros(n, bool)
    free[:] = f.held[f.top]  # held itself, or hung on a held node
    kind = np.where(f.held, HELD, np.where(free, HUNG, DONE))

    def rows(at: np.ndarray, path: pa.Array | None) -> pa.RecordBatch:
        k = kind[at]
        held, done, hung = k == HELD, k == DONE, k == HUNG
        top_id = own[f.top[at]]
        now = np.where(f.up[at] >= 0, own[np.maximum(f.up[at], 0)], p[at])
        via = [None] * len(at)
        for i in np.flatnonzero(held).tolist():
            u, stop, between = int(at[i]), int(f.up[at[i]]), []
            x = int(f.first_up[u])
            while stop >= 0 and x != stop:
                between.append(int(own[x]))
                x = int(f.first_up[x])
            via[i] = between[::-1]
        cols = [t[c].combine_chunks().take(pa.array(nodes[at])) for c in group]
        lie = f.below[at]
        cols += [
            _longs(own[at]),
            pa.array(k.astype(np.int8)),
            _longs(top_id),
            _longs(f.dist[at]),
            path if path is not None else pa.nulls(len(at), pa.list_(pa.int64())),
            pa.array(_STATUS[status[at]].astype(object), pa.string(), mask=~done),
            _longs(f.total[at]),
            _longs(own[np.maximum(lie, 0)], (lie >= 0) & hung),
            _longs(now, held & (f.up[at] != ROOT)),
            _longs(stated[at], has_stated[at]),
            pa.array(via, pa.list_(pa.int64())),
            _longs(f.size[at]),
            _longs(f.extra[at]),
        ]
        return pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(cols, schema)], schema=schema)

    if want == "cycles":
        at = np.flatnonzero((kind == HELD) | ((kind == HUNG) & (f.below >= 0)) | ((kind == DONE) & (status == 2)))
        if len(at):
            yield rows(at, None)
        return
    pathless = np.ones(n, bool) if want == "depths" else (kind == HELD) | ((kind == DONE) & (status >= 2))
    at = np.flatnonzero(pathless)
    if len(at):
        yield rows(at, None)
    if pathless.all():
        return
    starts = np.flatnonzero(((kind == DONE) & (f.top == np.arange(n)) & (status < 2)) | f.held)
    stack: list[int] = []
    marks = [0]
    places: list[int] = []
    values: list[int] = []
    offsets = [0]
    names = own.tolist()
    is_held = f.held.tolist()

    def flush() -> pa.RecordBatch:
        path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
        return rows(np.array(places), path)

    for u, level in _walk(f.first_up, f.held, starts, ~pathless | f.held):
        if level == 0:
            stack, marks = ([] if is_held[u] else [*(vias[u] if vias else ()), names[u]]), [0]
            marks.append(len(stack))
        elif is_held[u]:
            continue  # it is a start of its own
        else:
            del stack[marks[level] :], marks[level + 1 :]
            if vias:
                stack.extend(vias[u])
            stack.append(names[u])
            marks.append(len(stack))
        if is_held[u]:
            continue
        places.append(u)
        values.extend(stack)
        offsets.append(len(values))
        if len(values) > BATCH_ELEMENTS:
            yield flush()
            places, values, offsets = [], [], [0]
    if places:
        yield flush()


def _by_block(group: list[str], bits: int, want: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t]).combine_chunks()
            codes = _codes(t, group)
            block = np.asarray(t["block"])
            same = (codes == codes[-1]) & (block == block[-1])
            cut = int(np.argmax(same))  # rows come sorted: the last block may go on
            rest = t.slice(cut)
            if cut:
                yield from _solve(t.slice(0, cut), group, bits, want, schema)
        if rest is not None and rest.num_rows:
            yield from _solve(rest, group, bits, want, schema)

    return run


def _in_one(group: list[str], want: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = list(batches)
        if all_:
            yield from _solve(pa.Table.from_batches(all_).combine_chunks(), group, None, want, schema)

    return run


# ---------------------------------------------------------------- all rows


def edges(df: DataFrame, group: list[str], node: str, parent: str, root_value: int | None = -1) -> DataFrame:
    """One row (g0.., id, p, disputed) per node; ``p`` is null for roots.

    Copies count once; of different parents given for one node the smallest
    counts and the row is ``disputed``.  Rows without a node
    id are no nodes.  ``root_value`` and null both mean "no parent".
    """
    p = F.col(parent)
    if root_value is not None:
        p = F.when(p != root_value, p)
    return (
        df.where(F.col(node).isNotNull())
        .select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.col(node).cast("long").alias("id"), p.cast("long").alias("p"))
        .groupBy(*_names(group), "id")
        .agg(F.min("p").alias("p"), (F.min("p") != F.max("p")).alias("disputed"))
    )


def _names(group: list[str]) -> list[str]:
    return [f"g{i}" for i in range(len(group))]


def _schema(e: DataFrame, g: list[str]) -> str:
    own = [f"{c} {e.schema[c].dataType.simpleString()}" for c in g]
    rest = "id bigint, kind tinyint, top bigint, dist bigint, path array<bigint>, status string, total bigint, below bigint, p bigint, stated bigint, via array<bigint>, size bigint, extra bigint"
    return ", ".join([*own, rest])


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


class Solver:
    def __init__(self, e: DataFrame, n_group: int, want: str, bits: int, rest_rows: int) -> None:
        self.e, self.want, self.bits, self.rest_rows = e, want, bits, rest_rows
        self.g = [f"g{i}" for i in range(n_group)]
        self.schema = _schema(e, self.g)
        self.written: list[Materialized] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        m = materialize(df, name)
        self.written.append(m)
        return m.df

    def solve(self) -> DataFrame:
        """(g.., id, root, depth, path, status, total) of every node (of the cycle nodes for "cycles")."""
        g, e = self.g, self.e
        block = F.shiftright("id", self.bits)
        crossing = F.col("p").isNotNull() & (F.shiftright("p", self.bits) != block)
        across = not e.where(crossing).select(F.lit(1)).isEmpty()
        rows = e.select(*g, "id", "p", F.lit(False).alias("stub"), block.alias("block"))
        if across:
            stubs = e.where(crossing).select(*g, F.col("p").alias("id")).distinct()
            rows = rows.unionByName(stubs.select(*g, "id", F.lit(None).cast("long").alias("p"), F.lit(True).alias("stub"), block.alias("block")))
        laid = rows.repartition(*g, "block").sortWithinPartitions(*g, "block", "id")
        out = _arrow_schema(e, self.schema)
        local = laid.mapInArrow(_by_block(g, self.bits, self.want, out), self.schema)
        done = lambda df: df.where(F.col("kind") == DONE).select(*g, "id", F.col("top").alias("root"), F.col("dist").alias("depth"), "path", "status", "total")
        if not across:
            return done(local)
        first = self._keep(local, "blocks")
        held = self._finish(first.where(F.col("kind") == HELD).select(*g, "id", "p", "stated", "via", "size", "extra"))
        hung = first.where(F.col("kind") == HUNG)
        over = held.select(*g, F.col("id").alias("top"), F.col("root"), F.col("depth").alias("down"), F.col("path").alias("above"), F.col("status").alias("held_status"))
        under = held.select(*g, F.col("id").alias("below"), F.col("status").alias("below_status"), F.col("total").alias("more"))
        same = lambda a, b, k: [a[c].eqNullSafe(b[c]) for c in g] + [a[k] == b[k]]
        j = hung.join(under, same(hung, under, "below"), "left")
        j = j.select(*[hung[c] for c in g], "id", hung["top"], "dist", hung["path"], "total", "below_status", "more")
        j = j.join(over, same(j, over, "top")).select(
            *[j[c] for c in g],
            "id",
            "root",
            (F.col("down") + F.col("dist")).alias("depth"),
            F.concat("above", j["path"]).alias("path"),
            _below(F.col("below_status"), F.col("held_status")).alias("status"),
            (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"),
        )
        return done(first).unionByName(held.select(*g, "id", "root", "depth", "path", "status", "total")).unionByName(j)

    def _finish(self, live: DataFrame) -> DataFrame:
        """Root, depth, path, status and total of held nodes."""
        g = self.g
        ids = live.select(*[F.col(c).alias(f"o{c}") for c in g], F.col("id").alias("oid"))
        same = [F.col(c).eqNullSafe(F.col(f"o{c}")) for c in g]
        # A parent that isn't held doesn't exist; the node is a root of its own.
        there = live.join(ids, [*same, F.col("p") == F.col("oid")], "left")
        live = self._keep(there.select(*g, "id", F.col("oid").alias("p"), "stated", "via", "size", "extra"), "held")
        rounds: list[DataFrame] = []
        for r in range(MAX_ROUNDS):
            if live.limit(self.rest_rows + 1).count() <= self.rest_rows:
                break
            step, live = self._round(live, r)
            rounds.append(step)
        else:
            raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
        out = _arrow_schema(self.e, self.schema)
        last = live.coalesce(1).mapInArrow(_in_one(g, self.want if self.want != "cycles" else "depths", out), self.schema)
        known = self._keep(last.select(*g, "id", F.col("top").alias("root"), F.col("dist").alias("depth"), "path", "status", "total"), "known")
        for step in reversed(rounds):
            known = self._replay(step, known)
        return known

    def _match(self, a: DataFrame, b: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
        """Join on the (possibly null) group columns and node columns; ``b`` gives only its other columns."""
        g = self.g
        b = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns])
        cond = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in g] + [F.col(x) == F.col(f"o_{y}") for x, y in on.items()]
        return a.join(b, cond, how).drop(*[f"o_{c}" for c in g])

    def _round(self, live: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
        """(removed nodes with their record, what is left)."""
        g = self.g
        looped = F.col("p") == F.col("id")
        kids = live.where(F.col("p").isNotNull() & ~looped).groupBy(*g, "p").agg(F.count("*").alias("n"), F.max("id").alias("only"), F.max_by("extra", "id").alias("extra"))
        t = self._match(live, kids, {"id": "p"}, "left")
        none, mine = F.col("o_n").isNull(), self._coin("id", r)
        unary = (F.col("o_n") == 1) & F.col("p").isNotNull() & ~looped
        action = (
            F.when(none & F.col("p").isNull(), "root")
            .when(none & looped, "core")
            .when(none, "rake")
            .when(unary & (mine < self._coin("p", r)) & ((mine < self._coin("o_only", r)) | (F.col("p") == F.col("o_only"))), "compress")
            .otherwise("keep")
        )
        t = self._keep(t.withColumn("action", action).drop("o_n", "o_p"), f"round{r}")
        hook = t.where(F.col("action") == "compress").select(
            *g, F.col("o_only").alias("id"), F.col("p").alias("up"), F.concat("via", F.array("id")).alias("above"), (F.col("size") + F.col("extra")).alias("more")
        )
        moved = self._match(t.where(F.col("action") != "compress"), hook, {"id": "id"}, "left")
        there = F.col("o_up").isNotNull()
        moved = moved.select(
            *g,
            "id",
            F.coalesce("o_up", "p").alias("p"),
            "stated",
            F.when(there, F.concat("o_above", "via")).otherwise(F.col("via")).alias("via"),
            "size",
            (F.col("extra") + F.coalesce("o_more", F.lit(0))).alias("extra"),
            "action",
        )
        moved = self._keep(moved, f"moved{r}")
        gain = moved.where(F.col("action") == "rake").groupBy(*g, F.col("p").alias("id")).agg(F.sum(F.col("size") + F.col("extra")).alias("gain"))
        left = self._match(moved.where(F.col("action") == "keep"), gain, {"id": "id"}, "left")
        left = left.select(*g, "id", "p", "stated", "via", (F.col("size") + F.coalesce("o_gain", F.lit(0))).alias("size"), "extra")
        blank = F.lit(None).cast("long")
        gone = t.where(F.col("action") == "compress").select(*g, "id", "p", "stated", "via", "size", F.col("o_only").alias("only"), F.col("o_extra").alias("between"), "action")
        gone = gone.unionByName(moved.where(F.col("action").isin("rake", "root", "core")).select(*g, "id", "p", "stated", "via", "size", blank.alias("only"), blank.alias("between"), "action"))
        return gone, self._keep(left, f"live{r}")

    def _coin(self, node: str, r: int) -> Column:
        return F.xxhash64(*self.g, F.col(node), F.lit(r))

    def _replay(self, step: DataFrame, known: DataFrame) -> DataFrame:
        """``known`` and the nodes that one round removed."""
        g = self.g
        cols = [*g, "id", "root", "depth", "path", "status", "total"]
        no_path = F.lit(None).cast("array<bigint>")
        top = step.where(F.col("action").isin("root", "core"))
        rooted = F.col("action") == "root"
        path = F.when(rooted, F.concat("via", F.array("id"))) if self.want == "paths" else no_path
        status = F.when(~rooted, "cycle").when(F.col("stated").isNull(), "tree").otherwise("orphan")
        known = known.unionByName(top.select(*g, "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), path.alias("path"), status.alias("status"), F.col("size").alias("total")))
        # A raked node is on no cycle; its place follows from the node it hung on, which was left or is known.
        raked = self._match(step.where(F.col("action") == "rake"), known, {"p": "id"})
        down = (F.col("o_depth") + F.size("via") + 1).alias("depth")
        longer = (F.concat("o_path", "via", F.array("id")) if self.want == "paths" else no_path).alias("path")
        known = known.unionByName(raked.select(*g, "id", F.col("o_root").alias("root"), down, longer, _below(F.lit(None), F.col("o_status")).alias("status"), F.col("size").alias("total")))
        known = self._keep(known, "known")
        out = self._match(step.where(F.col("action") == "compress"), known.select(*g, F.col("id").alias("below"), F.col("status").alias("low"), F.col("total").alias("more")), {"only": "below"})
        out = out.withColumnsRenamed({"o_low": "low", "o_more": "more"}).drop("o_below")
        out = self._match(out, known, {"p": "id"})
        out = out.select(*g, "id", F.col("o_root").alias("root"), down, longer, _below(F.col("low"), F.col("o_status")).alias("status"), (F.col("size") + F.col("between") + F.col("more")).alias("total"))
        return self._keep(known.select(*cols).unionByName(out.select(*cols)), "known")


def _below(low: Column, above: Column) -> Column:
    return F.when(low == "cycle", "cycle").when(above == "cycle", "below_cycle").otherwise(above)


def _solved(df, group, node, parent, root_value, want, bits, rest_rows) -> tuple[DataFrame, DataFrame]:
    e = edges(df, group, node, parent, root_value)
    return e, Solver(e, len(group), want, bits, rest_rows).solve()


def find_cycles(df: DataFrame, group: list[str], node: str, parent: str, root_value: int | None = -1, bits: int = BLOCK_BITS, rest_rows: int = REST_ROWS) -> DataFrame:
    """Distinct (group columns, node) of the nodes that lie on a cycle; none for an empty table."""
    _, x = _solved(df, group, node, parent, root_value, "cycles", bits, rest_rows)
    kind = df.schema[node].dataType
    return x.where(F.col("status") == "cycle").select(*[F.col(f"g{i}").alias(n) for i, n in enumerate(group)], F.col("id").cast(kind).alias(node))


def hierarchy(df: DataFrame, group: list[str], node: str, parent: str, root_value: int | None = -1, paths: bool = True, bits: int = BLOCK_BITS, rest_rows: int = REST_ROWS) -> DataFrame:
    """Per distinct node: root, depth, path, number of descendants, and status.

    Columns: the group columns, ``node``, root_id, depth, path (ids from the
    root down, joined by '/'; left out with ``paths`` false), n_descendants,
    status.  status: ``tree`` (its root has no parent), ``orphan`` (the parent
    named at the top of its path doesn't exist), ``cycle`` (it lies on a cycle)
    or ``below_cycle``; for the last two root, depth, path and n_descendants
    are null.
    """
    kind = df.schema[node].dataType
    _, x = _solved(df, group, node, parent, root_value, "paths" if paths else "depths", bits, rest_rows)
    good = F.col("status").isin("tree", "orphan")
    out = [
        *[F.col(f"g{i}").alias(n) for i, n in enumerate(group)],
        F.col("id").cast(kind).alias(node),
        F.when(good, F.col("root")).cast(kind).alias("root_id"),
        F.when(good, F.col("depth")).cast("int").alias("depth"),
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
        F.when(good, F.col("total") - 1).alias("n_descendants"),
        "status",
    ]
    return x.select(*out) if paths else x.select(*out).drop("path")


def disputed_parents(df: DataFrame, group: list[str], node: str, parent: str, root_value: int | None = -1) -> DataFrame:
    """Nodes for which rows give different parents, with each parent given but for the one that counts.

    Columns: the group columns, ``node``, ``parent``.
    """
    e = edges(df, group, node, parent, root_value).where("disputed")
    p = F.col(parent)
    if root_value is not None:
        p = F.when(p != root_value, p)
    own = df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(group)], F.col(node).alias("oid"), p.alias("op")).distinct()
    cond = [F.col(f"g{i}").eqNullSafe(F.col(f"o{i}")) for i in range(len(group))] + [F.col("id") == F.col("oid"), F.col("op") > F.col("p")]
    return e.join(own, cond).select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(group)], F.col("oid").alias(node), F.col("op").alias(parent))


def descendants(df: DataFrame, group: list[str], node: str, parent: str, root_value: int | None = -1, bits: int = BLOCK_BITS, rest_rows: int = REST_ROWS) -> DataFrame:
    """One row per node and descendant, with the distance between them."""
    kind = df.schema[node].dataType
    _, x = _solved(df, group, node, parent, root_value, "paths", bits, rest_rows)
    above = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    g = _names(group)
    return (
        x.where(F.size("path") > 1)
        .select(*g, F.col("id").alias("down"), "depth", F.posexplode(above).alias("at", "up"))
        .select(
            *[F.col(f"g{i}").alias(n) for i, n in enumerate(group)],
            F.col("up").cast(kind).alias(node),
            F.col("down").cast(kind).alias("descendant_id"),
            (F.col("depth") - F.col("at")).cast("int").alias("distance"),
        )
    )
