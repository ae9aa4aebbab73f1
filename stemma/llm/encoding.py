"""Text garbled by decoding with the wrong character encoding: found and restored.

1. Character n-gram counts are taken over all clean records (bigrams
   everywhere, trigrams wherever a character beyond ASCII takes part) and give a
   smoothed model.  Its size is bounded: bigrams by the alphabet (1,800 symbols),
   trigrams by a table of TRIGRAM_CELLS counts that they are hashed into.
2. Every run of characters beyond ASCII is put through all chains of
   encode-with-X, decode-as-UTF-8 (repeated for text garbled more than once;
   character references are resolved first).  Parts of a run may be garbled
   while the rest is right.  A run to which no such chain applies is put through
   encode-with-X, decode-with-Y for all pairs of single-byte encodings.
3. The model scores the run in its place before and after; the likeliest chain
   is accepted if it gains more than a margin validated on all clean runs,
   garbled on purpose.  Since a pair of single-byte encodings applies to right
   text too, its gain must also exceed all that clean runs gain by any pair.

Replacement marks and stray control characters show a wrong decoding too;
control characters are restored, replacement marks are lost.  Null and empty
texts are not affected.  Correct foreign words and signs stay as they are.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import materialize

# Single-byte encodings in which UTF-8 is read by mistake.
ENCODINGS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "iso8859_15", "koi8_r", "cp866"]
MAX_TIMES = 3
MARK = "�"
#: Contexts handed on at a time; the margins are validated on all of them.
VALIDATION_ROWS = 2_000
#: Characters of contexts that a task remembers as handed on; beyond that they are handed on again and drawn together later.
SEEN_CHARS = 1 << 20
WEIGHTS = (0.6, 0.3, 0.09, 0.01)
#: Cells of the trigram table; trigrams that fall into one cell share its count.
TRIGRAM_CELLS = 1 << 22
_SPREAD = 0x9E3779B97F4A7C15

# Blocks of the alphabet; every other character is one symbol.
_BLOCKS = [(0, 0x250), (0x370, 0x530), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2200, 0x2300), (0x2500, 0x2600), (0xFFFD, 0xFFFE)]


@lru_cache(1)
def symbols() -> tuple[np.ndarray, int]:
    """Symbol of every code point of the basic plane, and the number of symbols. Capitals and digits are folded."""
    out = np.zeros(0x10000, np.int32)
    n = 1
    for low, high in _BLOCKS:
        out[low:high] = np.arange(n, n + high - low)
        n += high - low
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    out[ord("0") : ord("9") + 1] = out[ord("0")]
    return out, n


# ---------------------------------------------------------------- chains


@lru_cache(None)
def _byte_of(encoding: str) -> dict[str, int]:
    """Byte that each character beyond ASCII stands for; undefined bytes stand for the control characters."""
    out = {}
    for b in range(128, 256):
        out.setdefault(chr(b) if b < 160 else "", b)
    out.pop("", None)
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    if encoding == "cp1252":
        for b in range(160, 256):
            out[chr(b)] = b
    return out


def undo_once(run: str, encoding: str) -> str | None:
    """The run with every part that is UTF-8 in ``encoding`` decoded; None if there is none."""
    table = _byte_of(encoding)
    out, i, n, hit = [], 0, len(run), False
    while i < n:
        b = table.get(run[i])
        size = 0 if b is None else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if size and i + size <= n:
            rest = [table.get(c) for c in run[i + 1 : i + size]]
            if all(x is not None and 0x80 <= x <= 0xBF for x in rest):
                try:
                    c = bytes([b, *rest]).decode("utf-8")
                except UnicodeDecodeError:
                    c = ""
                if c and not 0xE000 <= ord(c[0]) < 0xF900:
                    out.append(c)
                    i += size
                    hit = True
                    continue
        out.append(run[i])
        i += 1
    return "".join(out) if hit else None


@lru_cache(1 << 16)
def candidates(run: str) -> tuple[tuple[str, str], ...]:
    """(restored run, chain) of every chain that applies to a run."""
    found: dict[str, str] = {}
    front = [(run, "")]
    for _ in range(MAX_TIMES):
        new = []
        for text, chain in front:
            for e in ENCODINGS:
                got = undo_once(text, e)
                if got is not None and got not in found and got != run:
                    found[got] = f"{chain}>{e}" if chain else e
                    new.append((got, found[got]))
        front = new
        if not front:
            break
    out = dict(found)
    for text, chain in [(run, ""), *found.items()]:
        if _CONTROL.search(text):
            fixed = _CONTROL.sub(lambda m: _windows(m[0]), text)
            if fixed != text:
                out.setdefault(fixed, f"{chain}>control" if chain else "control")
    return tuple(out.items())


@lru_cache(None)
def _char_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in _byte_of(encoding).items() if not "\x80" <= c <= "\x9f"}


@lru_cache(1 << 16)
def pair_candidates(run: str) -> tuple[tuple[str, str], ...]:
    """(restored run, chain 'read as X, written in Y') of every pair of single-byte encodings that applies to a run."""
    found: dict[str, str] = {}
    for x in ENCODINGS:
        own = [_byte_of(x).get(c) for c in run]
        if None in own:
            continue
        for y in ENCODINGS:
            chars = [_char_of(y).get(b) for b in own]
            if x != y and None not in chars:
                found.setdefault("".join(chars), f"{x}<{y}")
    found.pop(run, None)
    return tuple(found.items())


@lru_cache(None)
def _read_as(encoding: str) -> dict[int, str]:
    return {b: c for c, b in _byte_of(encoding).items()}


@lru_cache(1 << 14)
def garblings(run: str) -> tuple[str, ...]:
    """The run's UTF-8 read in each encoding from which it can be restored."""
    wrong = [(e, "".join(_read_as(e).get(b, "") for b in run.encode("utf-8"))) for e in ENCODINGS]
    return tuple(w for e, w in wrong if undo_once(w, e) == run != w)


_CONTROL = re.compile("[\x80-\x9f]")


def _windows(c: str) -> str:
    try:
        return bytes([ord(c)]).decode("cp1252")
    except UnicodeDecodeError:
        return c


_REF = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def resolve_references(text: str) -> str:
    """Character references that stand for characters beyond ASCII, resolved."""

    def one(m: re.Match) -> str:
        c = html.unescape(m[0])
        return c if len(c) == 1 and ord(c) > 127 else m[0]

    return _REF.sub(one, text) if "&" in text else text


_RUN = re.compile(r"[^\x00-\x7f]+")
_SURE = re.compile("[\x80-\x9f�]|ï¿½")


def suspicious(text: str) -> bool:
    """A record that is no good for training: marks, control characters, or runs that some chain decodes."""
    text = resolve_references(text)
    return bool(_SURE.search(text)) or any(candidates(r) for r in _RUN.findall(text))


# ---------------------------------------------------------------- model


def _gram_batch(kind: np.ndarray, gram: np.ndarray, n: np.ndarray, context: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(gram), pa.array(n), pa.array(context, pa.string())], names=["kind", "gram", "n", "context"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's bigrams and trigrams (kind 2 and 3), and every run in its place (kind 0)."""
    table, v = symbols()
    two = np.zeros(v * v, np.int64)
    three: dict[int, int] = {}
    seen: set[str] = set()
    held = 0
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t and (t.isascii() and "&" not in t or not suspicious(t))]
        if not texts:
            continue
        joined = "\n\n".join(texts) + "\n\n"
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        s = table[np.where(code < 0x10000, code, 0xE000)].astype(np.int64)
        if len(s) > 1:
            two += np.bincount(s[:-1] * v + s[1:], minlength=v * v)
        beyond = np.flatnonzero(code > 127)
        at = np.unique(np.concatenate([beyond, beyond + 1, beyond + 2])) if len(beyond) else beyond
        at = at[(at >= 2) & (at < len(s))]
        if len(at):
            key, n = np.unique((s[at - 2] * v + s[at - 1]) * v + s[at], return_counts=True)
            cell = key.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(42)
            for k, c in zip(cell.tolist(), n.tolist()):
                three[k] = three.get(k, 0) + c
        padded = "\n\n" + joined  # each text between the same borders, wherever it stands
        new = list({padded[m.start() - 2 : m.end() + 2] for m in _RUN.finditer(padded)} - seen)
        for i in range(0, len(new), VALIDATION_ROWS):
            some = new[i : i + VALIDATION_ROWS]
            yield _gram_batch(np.zeros(len(some), np.int8), np.zeros(len(some), np.int64), np.ones(len(some), np.int64), some)
        held += sum(map(len, new))
        if held > SEEN_CHARS:
            seen, held = set(), 0
        else:
            seen.update(new)
    some = np.flatnonzero(two)
    keys = np.concatenate([some, np.array(list(three), np.int64)])
    counts = np.concatenate([two[some], np.array(list(three.values()), np.int64)])
    kind = np.concatenate([np.full(len(some), 2, np.int8), np.full(len(three), 3, np.int8)])
    yield _gram_batch(kind, keys, counts, [None] * len(keys))


def _cell(gram: int) -> int:
    return (gram * _SPREAD & (1 << 64) - 1) >> 42


class Model:
    """Interpolated trigram model over folded characters, and the margins."""

    def __init__(self, two: dict[int, int], three: dict[int, int], margin: float = 0.0) -> None:
        _, self.v = symbols()
        self.two, self.three, self.margin, self.pair_margin = two, three, margin, math.inf
        self.one: dict[int, int] = {}
        for k, n in two.items():
            a = k // self.v
            self.one[a] = self.one.get(a, 0) + n
        self.total = max(1, sum(self.one.values()))

    def score(self, before: str, text: str, after: str) -> float:
        """Log probability of ``text`` and the start of ``after`` behind ``before``."""
        table, v = symbols()
        s = [int(table[min(ord(c), 0xE000)]) for c in before[-2:] + text + after[:2]]
        skip = min(2, len(before))
        s = [0] * (2 - skip) + s
        w3, w2, w1, w0 = WEIGHTS
        out = 0.0
        for i in range(2, len(s)):
            a, b, c = s[i - 2], s[i - 1], s[i]
            ab, bc = self.two.get(a * v + b, 0), self.two.get(b * v + c, 0)
            p = w0 / v + w1 * self.one.get(c, 0) / self.total
            if self.one.get(b):
                p += w2 * bc / self.one[b]
            if ab:
                p += w3 * self.three.get(_cell((a * v + b) * v + c), 0) / ab
            out += math.log(p)
        return out

    def gains(self, context: str) -> tuple[list[float], float]:
        """What a clean run gains by being restored from each encoding it is garbled in, and the most it gains by any pair."""
        gains, pairs = [], [0.0]
        for at in {_RUN.search(context).start(), 2}:  # the run, and the end of another if that stands before it
            run = _RUN.match(context, at)[0]
            a, z = context[:at], context[at + len(run) :]
            right = self.score(a, run, z)
            gains += [right - self.score(a, wrong, z) for wrong in garblings(run)]
            pairs += [self.score(a, t, z) - right for t, _ in pair_candidates(run)]
        return gains, max(pairs)


def _keys(x: np.ndarray) -> np.ndarray:
    """Bits of floating numbers as integers in the same order; applied to the integers it gives the bits back."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _number(key: int) -> float:
    return float(_keys(np.array([key], np.int64)).view(np.float64)[0])


def _measure(shared):
    """(kind, key) of all gains of clean runs: 1 by being restored, 2 the most by any pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, VALIDATION_ROWS):
                found = [shared.value.gains(c) for c in b.column(0).slice(i, VALIDATION_ROWS).to_pylist()]
                gains, pairs = [g for x, _ in found for g in x], [p for _, p in found]
                kind = np.repeat(np.array([1, 2], np.int8), [len(gains), len(pairs)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(_keys(np.array(gains + pairs, np.float64)))], names=["kind", "key"])

    return run


def _smallest(keys: DataFrame, k: int) -> int:
    """The ``key`` that stands behind k others, found 16 bits at a time: at most 65,536 counts come back each time."""
    top = None
    for shift in (48, 32, 16, 0):
        some = keys if top is None else keys.where(F.shiftright("key", shift + 16) == top)
        for top, n in sorted(tuple(r) for r in some.groupBy(F.shiftright("key", shift).alias("top")).agg(F.count("*").alias("n")).collect()):
            if k < n:
                break
            k -= n
    return top


def _validate(model: Model, contexts: DataFrame) -> None:
    """Sets the margins: half of what all but one in a hundred purposely garbled clean runs gain by being restored."""
    sc = contexts.sparkSession.sparkContext
    shared = sc.broadcast(model)
    spread = contexts.repartition(max(8, sc.defaultParallelism), "context")
    measured = materialize(spread.mapInArrow(_measure(shared), "kind byte, key bigint"), "gains")
    r = measured.df.agg(F.count_if(F.col("kind") == 1).alias("n"), F.max(F.when(F.col("kind") == 2, F.col("key"))).alias("most")).first()
    model.margin = max(1.0, _number(_smallest(measured.df.where("kind = 1"), r["n"] // 100)) / 2) if r["n"] else 1.0
    #: without clean runs nothing tells what right text may gain: no pair is accepted then
    model.pair_margin = max(0.0, _number(r["most"])) + model.margin if r["most"] is not None else math.inf
    measured.drop()
    shared.unpersist()


def train(texts: DataFrame) -> Model:
    """Model of all clean records of a one-column table."""
    parts = texts.mapInArrow(_count, "kind byte, gram bigint, n bigint, context string")
    # Counted once and kept: what comes to the driver is bounded by the alphabet and the trigram table, the contexts stay where they are.
    grams = materialize(parts.groupBy("kind", "gram", "context").agg(F.sum("n").alias("n")), "grams")
    rows = grams.df.where("kind > 0").select("kind", "gram", "n").toArrow()
    kind, key, n = (np.asarray(rows[c]) for c in ("kind", "gram", "n"))
    pick = lambda k: dict(zip(key[kind == k].tolist(), n[kind == k].tolist()))
    model = Model(pick(2), pick(3))
    _validate(model, grams.df.where("kind = 0").select("context"))
    grams.drop()
    return model


# ---------------------------------------------------------------- repair


class Repairer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.best = lru_cache(1 << 16)(self._best)

    def _best(self, before: str, run: str, after: str) -> tuple[str, str] | None:
        """(restored run, chain) if some chain beats the run as it stands by more than the margin."""
        found, margin = candidates(run), self.model.margin
        if not found:
            found, margin = pair_candidates(run), self.model.pair_margin
        if not found or margin == math.inf:
            return None
        own = self.model.score(before, run, after)
        scored = max(((self.model.score(before, t, after), -len(c), t, c) for t, c in found))
        if scored[0] - own <= margin:
            return None
        return scored[2], scored[3]

    def repair(self, text: str) -> tuple[bool, str, str, int]:
        """(affected, restored text, chains, characters lost)."""
        plain = resolve_references(text)
        chains: dict[str, None] = {}
        hit = False
        last = 0
        out = []
        for m in _RUN.finditer(plain):
            a, z = m.span()
            got = self.best(plain[max(0, a - 2) : a], m[0], plain[z : z + 2])
            new = m[0]
            if got:
                new, chain = got
                chains[chain] = None
                hit = True
            if _CONTROL.search(new):
                fixed = _CONTROL.sub(lambda c: _windows(c[0]), new)
                hit = True
                if fixed != new:
                    chains["control"] = None
                    new = fixed
            if "ï¿½" in new:
                new = new.replace("ï¿½", MARK)
            out += [plain[last:a], new]
            last = z
        done = "".join(out) + plain[last:]
        lost = done.count(MARK)
        affected = hit or lost > 0
        return affected, done if affected else text, " ".join(sorted(chains)), lost


def _repair_batches(model: Model, keep: list[str], out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repairer(model)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            rows = [fix.repair(t) if t else (False, t, "", 0) for t in texts]
            at = [i for i, r in enumerate(rows) if r[0]]
            cols = [b.column(b.schema.get_field_index(k)).take(pa.array(at, pa.int64())) for k in keep]
            cols += [pa.array([rows[i][j] for i in at], t) for j, t in ((1, pa.string()), (2, pa.string()), (3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)

    return run


def affected(records: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """Affected records of a table with ``text``: ``keep`` columns, restored, chains, n_lost.

    ``keep`` columns must be strings or integers.
    """
    model = model or train(records.select("text"))
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    names = [records.schema[k].dataType.simpleString() for k in keep]
    out = pa.schema([(k, kinds[n]) for k, n in zip(keep, names)] + [("restored", pa.string()), ("chains", pa.string()), ("n_lost", pa.int32())])
    schema = ", ".join([*[f"`{k}` {n}" for k, n in zip(keep, names)], "restored string, chains string, n_lost int"])
    some = records.where(F.col("text").rlike(r"[^\x00-\x7f]|&#|&[A-Za-z][A-Za-z0-9]{1,31};")).select(*keep, "text")

    def run(batches):
        yield from _repair_batches(shared.value, keep, out)(batches)

    return some.mapInArrow(run, schema)
