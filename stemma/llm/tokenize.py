"""Encoding of texts with a public byte-level BPE vocabulary, vectorised over whole Arrow batches.

Per slice of texts (about a megabyte of UTF-8 at a time):

1. *Pre-tokens.* Every byte gets the class of its character (letter, number,
   white space, other); token starts follow from class changes and the few
   context rules of the splitting pattern.  No text is looped over.
2. *Tier one.* All pre-tokens of the slice are looked up at once in a minimal
   perfect hash over the vocabulary (hash and displace): one probe gives the
   only slot that can hold the pre-token; its bytes are then compared exactly.
3. *Tier two.* The distinct pre-tokens that are no vocabulary entries are
   merged by a heap of candidate pairs over linked bytes.  A bounded memo keeps
   recent ones.

Null and empty texts give an empty list.  Strings that look like special tokens
are ordinary text.  Texts are never cut.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k"
SLICE_BYTES = 1 << 20
MEMO = 1 << 16

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# The white space of Unicode, and the endings split off after an apostrophe.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.zeros(0x110000, np.uint8)
    # Planes 4 to 13 hold no characters; 15 and 16 are private.
    for low, high in ((0, 0x40000), (0xE0000, 0xE1000)):
        out[low:high] = [kinds.get(k[0], OTHER) for k in map(unicodedata.category, map(chr, range(low, high)))]
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(1)
def _byte_classes() -> np.ndarray:
    return np.ascontiguousarray(np.concatenate([char_classes()[:128], np.zeros(128, np.uint8)]))


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character each byte of well-formed UTF-8 belongs to."""
    cls = _byte_classes()[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf[lead].astype(np.int32)
        n = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = np.where(n == 2, b & 0x1F, np.where(n == 3, b & 0x0F, b & 0x07))
        for k in (1, 2, 3):
            on = n > k
            code[on] = code[on] << 6 | (buf[lead[on] + k] & 0x3F)
        c = char_classes()[code]
        cls[lead] = c
        for k in (1, 2, 3):
            on = n > k
            cls[lead[on] + k] = c[on]
    return cls


def token_starts(buf: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start, ascending; empty texts have none.

    The rules of the pattern, as conditions on a position: a run of letters, of
    numbers or of other signs is one token, with one blank before it if there
    is one; an apostrophe with an ending is a token if it isn't inside a run
    of signs; of a run of white space that something follows, the last
    character stands apart.
    """
    n = len(buf)
    cls = byte_classes(buf)
    edge = np.zeros(n + 1, bool)
    edge[text_starts] = True
    edge[n] = True
    first = (buf & 0xC0) != 0x80
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = cls[1:] != cls[:-1]
    start |= edge[:n]
    space = cls == SPACE
    # The last white space character before something else in the same text.
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
    at = ends.copy()
    while True:
        inner = ~first[at]
        if not inner.any():
            break
        at[inner] -= 1
    start[at] = True
    blank = buf[at] == 0x20
    start[at[blank] + 1] = False
    # Apostrophes with an ending.
    quote = np.flatnonzero(buf == 0x27)
    if len(quote):
        fresh = edge[quote] | (quote == 0)
        before = np.maximum(quote - 1, 0)
        fresh |= (cls[before] != OTHER) & (buf[before] != 0x20)
        quote = quote[fresh]
        for e in ENDINGS:
            if not len(quote):
                break
            q = quote[quote + len(e) < n]
            ok = np.ones(len(q), bool)
            for k, ch in enumerate(e, 1):
                ok &= (buf[q + k] == ch) & ~edge[q + k]
            hit = q[ok]
            if len(hit):
                after = hit + 1 + len(e)
                start[hit] = True
                start[hit + 1] = False
                start[after[after < n]] = True
                # A blank that had swallowed what follows doesn't occur here: the ending is letters.
                quote = quote[~np.isin(quote, hit)]
    return np.flatnonzero(start)


def _padded(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 8, np.uint8)
    out[: len(buf)] = buf
    return out


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def words64(padded: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each position, as one little-endian number, zero beyond the length."""
    if len(at) * 16 < len(padded):
        # Few positions: gather just their bytes.
        low = np.minimum(at, len(padded) - 8)
        return padded[low[:, None] + np.arange(8)].view("<u8").ravel() & np.take(_MASK, np.minimum(length, 8))
    view = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    return np.take(view, at, mode="clip") & np.take(_MASK, np.minimum(length, 8))


def hash_spans(padded: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of byte spans, eight bytes at a time."""
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64) * _MIX
        h = (h ^ words64(padded, at, length)) * _MUL
        h ^= h >> _S29
        on = np.flatnonzero(length > 8)
        k = 8
        while len(on):
            x = (h[on] ^ words64(padded, at[on] + k, length[on] - k)) * _MUL
            h[on] = x ^ (x >> _S29)
            k += 8
            on = on[length[on] > k]
        h *= _MIX
        return h ^ (h >> _S32)


class PerfectHash:
    """Minimal perfect hash over byte strings by hash and displace."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        data = _padded(np.frombuffer(b"".join(keys), np.uint8))
        h = hash_spans(data, offsets[:-1], self.lengths)
        if len(np.unique(h)) < self.n:
            raise ValueError("two keys have the same 64-bit hash")
        self.buckets = max(1, self.n // 3)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        begin = np.concatenate([[0], np.cumsum(counts)])
        # Per bucket a shift, so that all its keys fall into free slots; large buckets first, all
        # buckets of a size at once.  Buckets of one key get what is left over, by number.
        taken = np.zeros(self.n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        slots = np.zeros(self.n, np.int64)
        for size in range(int(counts.max(initial=0)), 1, -1):
            todo = np.flatnonzero(counts == size)
            d = 0
            while len(todo):
                members = order[begin[todo][:, None] + np.arange(size)]
                s = self._slot(h[members], np.full(members.shape, d, np.int64))
                ok = ~taken[s].any(axis=1)
                ok &= (np.diff(np.sort(s, axis=1), axis=1) > 0).all(axis=1)
                owner = np.full(self.n, len(todo), np.int64)
                rows = np.flatnonzero(ok)
                np.minimum.at(owner, s[rows].ravel(), np.repeat(rows, size))
                rows = rows[(owner[s[rows]] == rows[:, None]).all(axis=1)]
                taken[s[rows]] = True
                slots[members[rows]] = s[rows]
                self.shift[todo[rows]] = d
                todo = np.delete(todo, rows)
                d += 1
        single = np.flatnonzero(counts == 1)
        free = np.flatnonzero(~taken)
        self.shift[single] = -1 - free
        slots[order[begin[single]]] = free
        self.key_of = np.zeros(self.n, np.int64)
        self.key_of[slots] = np.arange(self.n)
        self.offsets, self.data = offsets, data

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (shift.astype(np.uint64) * _MUL + _MIX)) * _MIX
            x ^= x >> _S32
            s = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(self.n) >> _S32).astype(np.int64)
        return np.where(shift < 0, -1 - shift, s)

    def find(self, padded: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Key number of each byte span, -1 where it is no key. The bytes are compared exactly."""
        h = hash_spans(padded, at, length)
        key = self.key_of[self._slot(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])]
        ok = self.lengths[key] == length
        own = self.offsets[key]
        ok &= words64(self.data, own, length) == words64(padded, at, length)
        on = np.flatnonzero(ok & (length > 8))
        k = 8
        while len(on):
            same = words64(self.data, own[on] + k, length[on] - k) == words64(padded, at[on] + k, length[on] - k)
            ok[on[~same]] = False
            on = on[same]
            k += 8
            on = on[length[on] > k]
        return np.where(ok, key, -1)


class _Memo(dict):
    """Number of each merged pre-token; its ids are kept in one flat list."""

    def __init__(self, merge) -> None:
        super().__init__()
        self._merge, self._flat, self._ends = merge, [], [0]

    def __missing__(self, word: bytes) -> int:
        self._flat += self._merge(word)
        self._ends.append(len(self._flat))
        k = self[word] = len(self._ends) - 2
        return k

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self._flat, np.int32), np.array(self._ends, np.int64)

    def __reduce__(self):
        return _Memo, (self._merge,)


class ByteBPE:
    """A rank file as encoder."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        keys = list(self.ranks)
        self.index = PerfectHash(keys)
        self.ids = np.array([self.ranks[k] for k in keys], np.int32)
        self.memo = _Memo(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """Merge the bytes of one pre-token: always the pair of lowest rank, the leftmost of equals."""
        ranks = self.ranks
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(part[i] + part[i + 1])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if part[i] else n
            if j >= n or not part[i] or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = b""
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                r = ranks.get(part[i] + part[nxt[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[nxt[i]])))
            if prv[i] >= 0:
                p = prv[i]
                r = ranks.get(part[p] + part[i])
                if r is not None:
                    heapq.heappush(heap, (r, p, len(part[p]) + len(part[i])))
        return [ranks[x] for x in part if x]

    def encode(self, buf: np.ndarray, text_starts: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each.

        ``buf`` holds the texts one after another; ``text_starts`` has the start of each and the end.
        """
        n_texts = len(text_starts) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
        filled = text_starts[:-1][text_starts[1:] > text_starts[:-1]]
        at = token_starts(buf, filled)
        length = np.diff(at, append=len(buf))
        padded = _padded(buf)
        key = self.index.find(padded, at, length)
        miss = np.flatnonzero(key < 0)
        count = np.ones(len(at), np.int64)
        if len(miss):
            raw = buf.tobytes()
            a, e = at[miss].tolist(), (at[miss] + length[miss]).tolist()
            if len(self.memo) > MEMO:
                self.memo = _Memo(self.merge)
            which = np.fromiter(map(self.memo.__getitem__, [raw[x:y] for x, y in zip(a, e)]), np.int64, len(miss))
            flat, offsets = self.memo.arrays()
            count[miss] = np.diff(offsets)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        per_text = np.diff(total[np.searchsorted(at, text_starts)])
        if not ids:
            return None, per_text
        out = np.empty(int(count.sum()), np.int32)
        place = total[:-1]
        one = key >= 0
        out[place[one]] = self.ids[key[one]]
        if len(miss):
            sizes = count[miss]
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[np.repeat(place[miss], sizes) + within] = flat[np.repeat(offsets[which], sizes) + within]
        return out, per_text


_LOADED: dict[str, ByteBPE] = {}


def load(name: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> ByteBPE:
    """The encoder of a rank file, built once per process."""
    path = f"{folder}/{name}.tiktoken"
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text starts) of pieces of a string column; nulls are empty texts."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if n == 0:
        return
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:
        valid = np.asarray(col.is_valid())
        if (np.diff(offsets)[~valid] > 0).any():
            col = col.fill_null("")
            yield from text_slices(col, limit)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _ids_of(column: str, keep: list[str], name: str, folder: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, folder)
        for b in batches:
            texts = b.column(b.schema.get_field_index(column))
            rest = [b.column(b.schema.get_field_index(c)) for c in keep]
            for i, j, buf, starts in text_slices(texts):
                got, per = bpe.encode(buf, starts, ids)
                if ids:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(got))
                    name_ = "ids"
                else:
                    out = pa.array(per.astype(np.int32))
                    name_ = "n_tokens"
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in rest], out], names=[*keep, name_])

    return run


def encode_column(df, column: str, keep: list[str], tokenizer: str = BYTE_BPE, folder: str = TOKENIZER_DIR):
    """``keep`` columns and ``ids``, the token ids of ``column``; an empty list for null and empty texts."""
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "ids array<int>"])
    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(_ids_of(column, keep, tokenizer, folder, True), schema)


def count_column(df, column: str, keep: list[str], tokenizer: str = BYTE_BPE, folder: str = TOKENIZER_DIR):
    """``keep`` columns and ``n_tokens``; 0 for null and empty texts."""
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "n_tokens int"])
    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(_ids_of(column, keep, tokenizer, folder, False), schema)


assert sys.byteorder == "little"
