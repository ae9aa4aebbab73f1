"""Differences between two copies of a keyed table.

Rows of both sides meet in one exchange, by the hash of their key, and are
sorted by key.  Keys get shared ordinals, numbered through the whole partition.
Per side a presence bitmap is built over runs of 65,536 ordinals: a sorted
array of 16-bit offsets where at most 4,096 are set, else packed bits.  AND-NOT
of the bitmaps gives the rows missing on either side; their intersection drives
the comparison of the columns, which are aligned by ordinal.

Copies of one key are no hot spot: before the exchange each Arrow batch keeps
one row per key and side and value, so what moves of a row copied any number of
times is bounded by the number of batches.

Results: null equals null only; strings and numbers are compared exactly, and
a NaN equals a NaN; of several different rows under one key the smallest (nulls
first) stands for it; null key parts are values like any other.  Keys and
fields may be of any type that Arrow can sort.  Empty sides are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Presence:
    """Set of ordinals 0..n-1 in runs of 65,536, each a sorted array while small and packed bits when dense."""

    RUN = 1 << 16
    SMALL = 4096

    def __init__(self, n: int, ordinals: np.ndarray) -> None:
        self.n = n
        self.runs: list[tuple[bool, np.ndarray]] = []
        cuts = np.searchsorted(ordinals, np.arange(0, n + self.RUN, self.RUN))
        for k in range((n + self.RUN - 1) // self.RUN):
            low = (ordinals[cuts[k] : cuts[k + 1]] - k * self.RUN).astype(np.uint16)
            if len(low) <= self.SMALL:
                self.runs.append((True, low))
            else:
                bits = np.zeros(self.RUN, bool)
                bits[low] = True
                self.runs.append((False, np.packbits(bits)))

    @staticmethod
    def _holds(run: tuple[bool, np.ndarray], low: np.ndarray) -> np.ndarray:
        """Which of the offsets the run holds."""
        small, data = run
        if small:
            at = np.searchsorted(data, low)
            return (at < len(data)) & (data[np.minimum(at, len(data) - 1)] == low) if len(data) else np.zeros(len(low), bool)
        return (data[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)

    def _meet(self, other: Presence, inside: bool) -> np.ndarray:
        out = []
        for k, (a, b) in enumerate(zip(self.runs, other.runs)):
            if a[0]:
                low = a[1][self._holds(b, a[1]) == inside]
            elif b[0] and inside:
                low = b[1][self._holds(a, b[1])]
            else:
                bits = a[1].copy()
                if b[0]:  # only AND-NOT comes here
                    np.bitwise_and.at(bits, b[1] >> 3, ~(np.uint8(128) >> (b[1] & 7).astype(np.uint8)))
                else:
                    bits &= b[1] if inside else ~b[1]
                low = np.flatnonzero(np.unpackbits(bits))
            out.append(low.astype(np.int64) + k * self.RUN)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def and_not(self, other: Presence) -> np.ndarray:
        return self._meet(other, False)

    def both(self, other: Presence) -> np.ndarray:
        return self._meet(other, True)


def _unequal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row: differ, where null equals null only."""
    ne = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(a.type):
        ne = pc.and_not(ne, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return np.asarray(pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b))))


def _compare(keys: list[str], fields: list[str], left: str, right: str, out: pa.Schema):
    def chunk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = False
            for k in keys:
                c = t[k].combine_chunks()
                fresh[1:] |= _unequal(c[1:], c[:-1])
        ordinal = np.cumsum(fresh) - 1
        side = np.asarray(t["side_"])
        first = np.ones(n, bool)
        first[1:] = fresh[1:] | (side[1:] != side[:-1])
        size = int(ordinal[-1]) + 1
        row = np.zeros((2, size), np.int64)
        sets = []
        for s in (0, 1):
            at = np.flatnonzero(first & (side == s))
            row[s, ordinal[at]] = at
            sets.append(Presence(size, ordinal[at]))
        parts = [(sets[0].and_not(sets[1]), left, 0), (sets[1].and_not(sets[0]), right, 1)]
        common = sets[0].both(sets[1])
        for f in fields:
            c = t[f].combine_chunks()
            differ = _unequal(c.take(pa.array(row[0, common])), c.take(pa.array(row[1, common])))
            parts.append((common[differ], f, None))
        for members, what, s in parts:
            if not len(members):
                continue
            key_rows = row[0 if s is None else s, members]
            cols = [t[k].combine_chunks().take(pa.array(key_rows)) for k in keys]
            cols.append(pa.array([what] * len(members)))
            for tag, at in (("left", 0), ("right", 1)):
                if s is None:
                    v = t[what].combine_chunks().take(pa.array(row[at, members])).cast(pa.string())
                else:
                    v = pa.nulls(len(members), pa.string())
                cols.append(v)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t]).combine_chunks()
            # Chunks of many ordinals; the last key may go on in the next batch and is held back.
            n = t.num_rows
            if n < CHUNK_ROWS:
                rest = t
                continue
            same = np.ones(n, bool)
            for k in keys:
                c = t[k].combine_chunks()
                same &= ~_unequal(c, c.take(pa.array(np.full(n, n - 1))))
            cut = int(np.argmax(same))
            # Of a key only its first row on each side counts, so what is held back stays small.
            side = np.asarray(t["side_"])[cut:]
            rest = t.take(pa.array(cut + np.unique(side, return_index=True)[1]))
            if cut:
                yield from chunk(t.slice(0, cut).combine_chunks())
        if rest is not None and rest.num_rows:
            yield from chunk(rest.combine_chunks())

    return run


#: Sorted rows that are compared at once; a key's rows are never parted.
CHUNK_ROWS = 1 << 18


def _once(cols: list[str]):
    """One row per batch of those that are alike in every column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(cols).aggregate([])
            yield from t.select(cols).combine_chunks().to_batches()

    return run


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], left: str = "only_left", right: str = "only_right") -> DataFrame:
    """One row per difference: key columns, ``difference``, left_value, right_value.

    ``difference`` is ``left`` or ``right`` for a key that one side lacks, else
    the name of the field whose values differ; the values come as strings.
    """
    cols = [*keys, *fields]
    sides = a.select(*cols, F.lit(0).alias("side_")).unionByName(b.select(*cols, F.lit(1).alias("side_")))
    both = sides.mapInArrow(_once([*cols, "side_"]), sides.schema).repartition(*keys).sortWithinPartitions(*keys, "side_", *fields)
    schema = T.StructType(
        [a.schema[k] for k in keys]
        + [T.StructField("difference", T.StringType()), T.StructField("left_value", T.StringType()), T.StructField("right_value", T.StringType())]
    )
    out = pa.schema([*to_arrow_schema(a.select(*keys).schema), ("difference", pa.string()), ("left_value", pa.string()), ("right_value", pa.string())])
    return both.mapInArrow(_compare(keys, fields, left, right, out), schema)


def difference_summary(d: DataFrame) -> DataFrame:
    """Number of rows per kind of difference."""
    return d.groupBy("difference").agg(F.count("*").alias("n"))
