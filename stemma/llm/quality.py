"""Text statistics per document, and what a document mainly is: prose, list, table or junk.

Lines (blank ones left out) are described by a handful of discretised features
and labelled with a hidden Markov model over the four kinds; the document takes
its kind from the shares of its characters in lines of each kind.  The model
starts from the probabilities stated below, and is then fitted to the whole
corpus: one pass labels every line and counts features and transitions, which
are blended with the start values.  All counting works on whole Arrow batches
with array operations; texts are never cut.

Defined results: null, empty and blank texts have no words, null ratios and the
kind ``blank``.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tokenize import LETTER, NUMBER, OTHER, _padded, byte_classes, hash_spans, text_slices, words64
from stemma.session import materialize

KINDS = ["prose", "list", "table", "junk"]
#: A document is prose if at least this share of its characters is in prose lines.
MAINLY = 0.5
#: Weight of the start values against the counts of the corpus.
PRIOR_WEIGHT = 1.0
MAX_COMMON = 10_000
#: Lines before and after in which sentence ends are counted.
AROUND = 3

# Start probabilities of every feature, in the order of KINDS; one row per value of the feature.
START = {
    # ends: with . ! ?; with , ; :; not at all and the next line begins in lower case (or this one did); not at all
    "end": [(0.42, 0.06, 0.02, 0.05), (0.06, 0.16, 0.02, 0.12), (0.36, 0.06, 0.02, 0.23), (0.16, 0.72, 0.94, 0.60)],
    # begins: lower case, upper case, number, bracket, bullet, anything else
    "begin": [(0.36, 0.10, 0.04, 0.34), (0.50, 0.42, 0.60, 0.26), (0.05, 0.14, 0.20, 0.10), (0.05, 0.12, 0.05, 0.04), (0.01, 0.20, 0.01, 0.04), (0.03, 0.02, 0.10, 0.22)],
    # share of common words: none, to .1, to .25, to .4, more
    "common": [(0.25, 0.62, 0.70, 0.70), (0.07, 0.08, 0.10, 0.06), (0.30, 0.14, 0.12, 0.08), (0.27, 0.13, 0.06, 0.09), (0.11, 0.03, 0.02, 0.07)],
    # share of words that are numbers: none, to .15, to .4, more
    "numbers": [(0.62, 0.62, 0.16, 0.74), (0.32, 0.10, 0.05, 0.08), (0.05, 0.22, 0.19, 0.10), (0.01, 0.06, 0.60, 0.08)],
    # share of signs: to .03, to .08, to .2, more
    "signs": [(0.56, 0.32, 0.16, 0.42), (0.38, 0.40, 0.14, 0.08), (0.05, 0.24, 0.30, 0.14), (0.01, 0.04, 0.40, 0.36)],
    # words: one, to 4, to 8, to 14, more
    "words": [(0.03, 0.03, 0.26, 0.24), (0.05, 0.28, 0.30, 0.18), (0.14, 0.36, 0.30, 0.26), (0.40, 0.18, 0.12, 0.17), (0.38, 0.15, 0.02, 0.15)],
    # column separators: none, one, two, more
    "columns": [(0.985, 0.93, 0.30, 0.90), (0.012, 0.06, 0.12, 0.05), (0.002, 0.007, 0.20, 0.03), (0.001, 0.003, 0.38, 0.02)],
    # sentences that end inside: none, one, more
    "inside": [(0.55, 0.93, 0.98, 0.94), (0.27, 0.05, 0.015, 0.04), (0.18, 0.02, 0.005, 0.02)],
    # commas per word: none, to .1, to .25, more
    "commas": [(0.48, 0.48, 0.45, 0.76), (0.40, 0.06, 0.02, 0.06), (0.11, 0.26, 0.03, 0.08), (0.01, 0.20, 0.50, 0.10)],
    # mean word length: under 3, to 7, to 10, more
    "length": [(0.02, 0.03, 0.08, 0.18), (0.88, 0.72, 0.60, 0.46), (0.09, 0.20, 0.16, 0.16), (0.01, 0.05, 0.16, 0.20)],
    # the same line three times or more in the document: no, yes
    "again": [(0.985, 0.93, 0.90, 0.62), (0.015, 0.07, 0.10, 0.38)],
    # share of words of up to three letters: under .12, to .3, more
    "short": [(0.08, 0.36, 0.56, 0.62), (0.36, 0.36, 0.30, 0.22), (0.56, 0.28, 0.14, 0.16)],
    # share of words that begin with a capital: under .35, to .7, more
    "capitals": [(0.70, 0.36, 0.60, 0.70), (0.18, 0.26, 0.28, 0.14), (0.12, 0.38, 0.12, 0.16)],
    # share of words of letters and digits mixed: to .2, more
    "mixed": [(0.995, 0.98, 0.98, 0.80), (0.005, 0.02, 0.02, 0.20)],
    # words per sentence end in the lines around: no end, over 60, to 60, to 25, under 8
    "rate": [(0.004, 0.62, 0.90, 0.76), (0.056, 0.05, 0.03, 0.06), (0.32, 0.06, 0.03, 0.05), (0.58, 0.05, 0.02, 0.05), (0.04, 0.22, 0.02, 0.08)],
    # distinct words of lines of 24 words or more: many, under .4, under .2 of the words
    "distinct": [(0.985, 0.88, 0.985, 0.90), (0.012, 0.08, 0.01, 0.04), (0.003, 0.04, 0.005, 0.06)],
}
STAY = (0.93, 0.93, 0.93, 0.95)
FEATURES = list(START)
AGAIN = FEATURES.index("again")


class Model:
    def __init__(self, tables: list[np.ndarray], start: np.ndarray, moves: np.ndarray) -> None:
        self.tables, self.start, self.moves = tables, start, moves

    @classmethod
    def initial(cls) -> Model:
        tables = [np.array(START[f], float) for f in FEATURES]
        moves = np.array([[s if i == j else (1 - s) / 3 for j in range(4)] for i, s in enumerate(STAY)])
        return cls(tables, np.array([0.7, 0.1, 0.1, 0.1]), moves)

    def fitted(self, counts: list[np.ndarray], start: np.ndarray, moves: np.ndarray) -> Model:
        """Counts blended with this model's probabilities, which weigh as much as the counts do."""
        tables = []
        for t, c in zip(self.tables, counts):
            t = t / t.sum(0)
            n = c.sum(0)
            tables.append((c + PRIOR_WEIGHT * np.maximum(n, 1) * t) / (n + PRIOR_WEIGHT * np.maximum(n, 1)))
        n = moves.sum(1, keepdims=True)
        blend = (moves + PRIOR_WEIGHT * np.maximum(n, 1) * self.moves) / (n + PRIOR_WEIGHT * np.maximum(n, 1))
        s = max(1.0, start.sum())
        return Model(tables, (start + s * self.start) / (2 * s), blend)

    def emissions(self, values: np.ndarray) -> np.ndarray:
        """Log probability of every line in every state.

        What a line looks like that stands three times or more is told by its first copy; of such lines only the
        repetition counts.
        """
        out = np.zeros((values.shape[1], 4))
        copied = values[AGAIN] > 0
        for k, (t, v) in enumerate(zip(self.tables, values)):
            each = np.log(t / t.sum(0))[v]
            out += each if k == AGAIN else np.where(copied[:, None], 0.0, each)
        return out

    def label(self, values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Likeliest kinds of all lines; ``first`` and ``n`` give the lines of each document. All documents go along together."""
        e = self.emissions(values)
        out = np.zeros(len(e), np.int8)
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        m = int(np.count_nonzero(n))
        if not m:
            return out
        first, n = first[:m], n[:m]
        step = np.log(self.moves)
        back = np.zeros((len(e), 4), np.int8)
        best = np.log(self.start) + e[first]
        last = best.copy()
        for t in range(1, int(n[0])):
            k = int(np.searchsorted(-n, -t, "left"))
            reach = best[:k, :, None] + step
            back[first[:k] + t] = reach.argmax(1)
            best = reach.max(1) + e[first[:k] + t]
            last[:k] = best
        state = last.argmax(1)
        for t in range(int(n[0]) - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, "left"))
            out[first[:k] + t] = state[:k]
            if t:
                state[:k] = back[first[:k] + t, state[:k]]
        return out


# ---------------------------------------------------------------- counting

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _set(s: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(s)] = True
    return out


_STOP, _PAUSE, _CLOSE, _BULLET, _COLUMN, _AFTER = _set(b".!?"), _set(b",;:"), _set(b"\"')]"), _set(b"-*+"), _set(b"\t|"), _set(b"%)]\"'")


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


class Counts:
    """Line features and document statistics of a slice of texts."""

    def __init__(self, buf: np.ndarray, text_starts: np.ndarray, common: tuple[np.ndarray, frozenset]) -> None:
        n = len(buf)
        texts = len(text_starts) - 1
        cls = byte_classes(buf)
        pad = _padded(buf)
        white = _WHITE[buf]
        lead = (buf & 0xC0) != 0x80
        newline = buf == 10
        opens = np.zeros(n + 1, bool)
        opens[text_starts] = True
        # Lines, blank ones left out.
        begin = opens[:n].copy()
        begin[1:] |= newline[:-1]
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
        inked = _sums(lead & ~white)
        full = inked[end] > inked[start]
        start, end = start[full], end[full]
        # Trim blanks at both ends.
        dark = np.flatnonzero(~white)
        start = dark[np.searchsorted(dark, start)]
        end = dark[np.searchsorted(dark, end) - 1] + 1
        self.doc = np.searchsorted(text_starts, start, "right") - 1
        self.n_lines = np.bincount(self.doc, minlength=texts)[:texts] if len(start) else np.zeros(texts, np.int64)
        of = lambda sums: (sums[end] - sums[start]).astype(np.float64)
        # Words are runs between white space.
        word = ~white
        word[1:] &= white[:-1] | opens[1:n]
        w0 = np.flatnonzero(word)
        gap = np.flatnonzero(white)
        w1 = np.append(gap, n)[np.searchsorted(gap, w0)]
        if len(w0):
            w1 = np.minimum(w1, np.append(w0[1:], n))
        words = _sums(word)
        letters, digits = _sums(lead & (cls == LETTER)), _sums(lead & (cls == NUMBER))
        signs = _sums(lead & (cls == OTHER) & ~white)
        number_word = np.zeros(n, bool)
        number_word[w0[(letters[w1] == letters[w0]) & (digits[w1] > digits[w0])]] = True
        mixed_word = np.zeros(n, bool)
        mixed_word[w0[(letters[w1] > letters[w0]) & (digits[w1] > digits[w0]) & (signs[w1] == signs[w0])]] = True
        capital = np.zeros(n, bool)
        capital[w0[(buf[w0] >= 65) & (buf[w0] <= 90)]] = True
        # Runs of letters, for common and short words.
        run = cls == LETTER
        edge = run.copy()
        edge[1:] &= ~run[:-1] | opens[1:n]
        r0 = np.flatnonzero(edge)
        stop = np.flatnonzero(~run)
        r1 = np.append(stop, n)[np.searchsorted(stop, r0)]
        if len(r0):
            r1 = np.minimum(r1, np.append(r0[1:], n))
        size = r1 - r0
        key = words64(_LOWER[pad], r0, size)
        table, long = common
        known = np.zeros(len(r0), bool)
        if len(table):
            at = np.minimum(np.searchsorted(table, key), len(table) - 1)
            known = (size <= 8) & (table[at] == key)
        if long:
            for i in np.flatnonzero(size > 8):
                known[i] = bytes(_LOWER[buf[r0[i] : r1[i]]]) in long
        is_common, is_run, is_short = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        is_common[r0[known]] = True
        is_run[r0] = True
        is_short[r0[size <= 3]] = True
        commons, runs, shorts = _sums(is_common), _sums(is_run), _sums(is_short)
        # Separators of columns: tabs, bars, and blanks in a row inside a line.
        blank = buf == 32
        wide = _COLUMN[buf].copy()
        wide[1:] |= blank[1:] & blank[:-1]
        sep = wide.copy()
        sep[1:] &= ~wide[:-1]
        # Sentences that end inside: a stop, a blank, a capital.
        inner = np.zeros(n, bool)
        if n > 2:
            inner[:-2] = _STOP[buf[:-2]] & blank[1:-1] & (((buf[2:] >= 65) & (buf[2:] <= 90)) | (buf[2:] >= 0xC3)) & (cls[:-2] == OTHER)
        nw = np.maximum(of(words), 1)
        chars = of(inked)
        self.chars = chars
        # Ends and beginnings.
        tail = end - 1
        tail = np.where(_CLOSE[buf[tail]] & (tail > start), tail - 1, tail)
        # A closing quote of three bytes (U+2019, U+201D).
        quote = (tail - 2 > start) & (buf[tail] >= 0x99) & (buf[tail] <= 0x9D) & (buf[np.maximum(tail - 1, 0)] == 0x80) & (buf[np.maximum(tail - 2, 0)] == 0xE2)
        tail = np.where(quote, tail - 3, tail)
        stopped, paused = _STOP[buf[tail]], _PAUSE[buf[tail]]
        b0 = buf[start]
        lower = (b0 >= 97) & (b0 <= 122)
        lower |= (b0 >= 0xC3) & (cls[start] == LETTER) & (pad[start + 1] >= 0x9F)
        upper = (cls[start] == LETTER) & ~lower
        follows = np.zeros(len(start), bool)
        if len(start) > 1:
            follows[:-1] = lower[1:] & (self.doc[1:] == self.doc[:-1])
        bullet = (_BULLET[b0] & (pad[start + 1] == 32)) | ((b0 == 0xE2) & (pad[start + 1] == 0x80) & (pad[start + 2] == 0xA2)) | ((b0 == 111) & (pad[start + 1] == 32))
        lower &= ~bullet
        # Lines and words by hash: the same line again in its document; distinct words of long lines.
        hw = hash_spans(_LOWER[pad], w0, w1 - w0)
        line_of = np.searchsorted(start, w0, "right") - 1
        with np.errstate(over="ignore"):
            placed = hw * (np.arange(len(w0), dtype=np.uint64) - words[start].astype(np.uint64)[line_of] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = np.add.reduceat(placed, words[start]) if len(start) else np.zeros(0, np.uint64)
            own = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(own, return_inverse=True, return_counts=True)
        again = times[back] >= 3 if len(own) else np.zeros(0, bool)
        ratio = np.ones(len(start))
        many = of(words) >= 24
        if many.any():
            pick = many[line_of]
            lw = line_of[pick]
            with np.errstate(over="ignore"):
                k = hw[pick] ^ (lw.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            _, one = np.unique(k, return_index=True)
            several = np.bincount(lw[one], minlength=len(start))
            # Long texts repeat their words anyway: many distinct ones are enough.
            ratio = np.where(many & (several < 60), several / nw, 1.0)
        # Sentence ends in the lines around.
        sentence = _STOP[buf]
        sentence[0] = False
        sentence[1:] &= (cls[:-1] == LETTER) | (cls[:-1] == NUMBER) | _AFTER[buf[:-1]]
        sentence[:-1] &= white[1:] | _CLOSE[buf[1:]] | (buf[1:] == 0xE2) | opens[1:n]
        stops_in, words_in = np.concatenate([[0], np.cumsum(of(_sums(sentence)))]), np.concatenate([[0], np.cumsum(of(words))])
        line = np.arange(len(start))
        head = np.cumsum(self.n_lines) - self.n_lines
        low = np.maximum(line - AROUND, head[self.doc]) if len(start) else line
        high = np.minimum(line + AROUND + 1, (head + self.n_lines)[self.doc]) if len(start) else line
        near = stops_in[high] - stops_in[low]
        per = (words_in[high] - words_in[low]) / np.maximum(near, 1)
        rate = np.select([near == 0, per > 60, per > 25, per > 8], [0, 1, 2, 3], 4)
        cut = lambda x, *edges: np.searchsorted(edges, x, "left").astype(np.int8)
        nr = np.maximum(of(runs), 1)
        f = {
            "end": np.where(stopped, 0, np.where(paused, 1, np.where(follows, 2, 3))),
            "begin": np.select([bullet, lower, upper, cls[start] == NUMBER, (b0 == 40) | (b0 == 91)], [4, 0, 1, 2, 3], 5),
            "common": cut(of(commons) / nr, 0, 0.1, 0.25, 0.4),
            "numbers": cut(of(_sums(number_word)) / nw, 0, 0.15, 0.4),
            "signs": cut(of(signs) / np.maximum(chars, 1), 0.03, 0.08, 0.2),
            "words": cut(of(words), 1, 4, 8, 14),
            "columns": np.minimum(of(_sums(sep)), 3),
            "inside": np.minimum(of(_sums(inner)), 2),
            "commas": cut(of(_sums(buf == 44)) / nw, 0, 0.1, 0.25),
            "length": cut(chars / nw, 3, 7, 10),
            "again": again,
            "short": cut(of(shorts) / nr, 0.12, 0.3),
            "capitals": cut(of(_sums(capital)) / nw, 0.35, 0.7),
            "mixed": cut(of(_sums(mixed_word)) / nw, 0.2),
            "rate": rate,
            "distinct": np.where(ratio < 0.2, 2, np.where(ratio < 0.4, 1, 0)),
        }
        self.features = np.array([f[x] for x in FEATURES], np.int8).reshape(len(FEATURES), -1)
        # Statistics per document.
        a, z = text_starts[:-1], text_starts[1:]
        whole = lambda sums: (sums[z] - sums[a]).astype(np.int64)
        self.stats = {
            "n_words": whole(words),
            "n_chars": whole(inked),
            "n_signs": whole(signs),
            "n_runs": whole(runs),
            "n_common": whole(commons),
            "n_lines": self.n_lines.astype(np.int64),
            "n_stopped": np.bincount(self.doc, weights=_STOP[buf[end - 1]] | _PAUSE[buf[end - 1]], minlength=texts)[:texts].astype(np.int64) if len(start) else np.zeros(texts, np.int64),
        }


def common_table(words: list[str]) -> tuple[np.ndarray, frozenset]:
    raw = sorted({w.lower().encode() for w in words if w})
    short = [int.from_bytes(w.ljust(8, b"\0"), "little") for w in raw if len(w) <= 8]
    return np.array(sorted(short), np.uint64), frozenset(w for w in raw if len(w) > 8)


def _batch_counts(col: pa.Array, common) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Features of all lines of a column, characters per line, lines per text, statistics per text."""
    feats, chars, lines, stats = [], [], [], []
    for _, _, buf, starts in text_slices(col):
        if len(buf):
            c = Counts(buf, starts, common)
            feats.append(c.features)
            chars.append(c.chars)
            lines.append(c.n_lines)
            stats.append(c.stats)
        else:
            k = len(starts) - 1
            lines.append(np.zeros(k, np.int64))
            stats.append(dict.fromkeys(RAW, np.zeros(k, np.int64)))
    f = np.concatenate(feats, axis=1) if feats else np.zeros((len(FEATURES), 0), np.int8)
    ch = np.concatenate(chars) if chars else np.zeros(0)
    n = np.concatenate(lines) if lines else np.zeros(0, np.int64)
    return f, ch, n, {k: np.concatenate([s[k] for s in stats]) if stats else np.zeros(0, np.int64) for k in RAW}


def _describe_batches(common, keep: list[str]):
    """Every text's lines as codes (three bits a feature), characters per line, and statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f, chars, n, stats = _batch_counts(b.column(b.schema.get_field_index("text")), common)
            code = np.zeros(f.shape[1], np.int64)
            for k, v in enumerate(f):
                code |= v.astype(np.int64) << 3 * k
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            cols += [pa.array(stats[s]) for s in RAW]
            cols += [pa.ListArray.from_arrays(at, pa.array(code)), pa.ListArray.from_arrays(at, pa.array(chars.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *RAW, "codes", "chars"])

    return run


def _lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines of a column of codes, and lines per text."""
    code = np.asarray(col.flatten())
    n = np.diff(np.asarray(col.offsets)).astype(np.int64)
    return np.array([code >> 3 * k & 7 for k in range(len(FEATURES))], np.int8).reshape(len(FEATURES), -1), n


def _train_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros_like(t) for t in model.tables]
        start, moves = np.zeros(4), np.zeros((4, 4))
        for b in batches:
            f, n = _lines(b.column(0))
            if not f.shape[1]:
                continue
            first = np.cumsum(n) - n
            label = model.label(f, first, n).astype(np.int64)
            own = f[AGAIN] == 0
            for k, (t, v) in enumerate(zip(tables, f)):
                pick = slice(None) if k == AGAIN else own
                t += np.bincount(v[pick] * 4 + label[pick], minlength=t.size).reshape(t.shape)
            start += np.bincount(label[first[n > 0]], minlength=4)
            inner = np.ones(len(label), bool)
            inner[first[n > 0]] = False
            at = np.flatnonzero(inner)
            moves += np.bincount(label[at - 1] * 4 + label[at], minlength=16).reshape(4, 4)
        flat = np.concatenate([*[t.ravel() for t in tables], start, moves.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "n"])

    return run


def train(described: DataFrame) -> Model:
    """Model fitted to all described texts. A few hundred cells come back, however many texts."""
    model = Model.initial()
    parts = described.select("codes").mapInArrow(_train_batches(model), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sizes = [t.size for t in model.tables] + [4, 16]
    flat = np.zeros(sum(sizes))
    for r in parts:
        flat[r["cell"]] = r["n"]
    pieces = np.split(flat, np.cumsum(sizes)[:-1])
    return model.fitted([p.reshape(t.shape) for p, t in zip(pieces, model.tables)], pieces[-2], pieces[-1].reshape(4, 4))


def _label_batches(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols_in = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            f, n = _lines(cols_in["codes"])
            chars = np.asarray(cols_in["chars"].flatten()).astype(np.float64)
            stats = {s: np.asarray(cols_in[s]) for s in RAW}
            label = model.label(f, np.cumsum(n) - n, n) if f.shape[1] else np.zeros(0, np.int8)
            owner = np.repeat(np.arange(len(n)), n)
            total = np.bincount(owner, weights=chars, minlength=len(n))
            share = np.array([np.bincount(owner, weights=chars * (label == k), minlength=len(n)) for k in range(4)]) / np.maximum(total, 1)
            other = 1 + share[1:].argmax(0)
            kind = np.where(share[0] >= MAINLY, 0, other)
            names = np.where(total > 0, np.array(KINDS, object)[kind], "blank")
            none = total == 0
            div = lambda a, c: pa.array(np.floor(a / np.maximum(c, 1) * 1e6 + 0.5) / 1e6, mask=c == 0)
            cols = [cols_in[k] for k in keep]
            cols += [
                pa.array(stats["n_words"]),
                div(stats["n_chars"], stats["n_words"]),
                div(stats["n_signs"], stats["n_chars"]),
                div(stats["n_stopped"], stats["n_lines"]),
                div(stats["n_common"], stats["n_runs"]),
                *[pa.array(np.round(s, 6), mask=none) for s in share],
                pa.array(names.tolist(), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *STATS, *[f"{k}_share" for k in KINDS], "kind"])

    return run


RAW = ["n_words", "n_chars", "n_signs", "n_runs", "n_common", "n_lines", "n_stopped"]
STATS = ["n_words", "mean_word_length", "symbol_ratio", "stopped_line_share", "common_word_share"]


def common_words(words: DataFrame) -> tuple[np.ndarray, frozenset]:
    """The list of common words; it is a fixed list and is refused above ``MAX_COMMON`` rows."""
    rows = [r["word"] for r in words.select("word").limit(MAX_COMMON + 1).collect() if r["word"]]
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return common_table(rows)


def assess(documents: DataFrame, words: DataFrame, keep: list[str]) -> DataFrame:
    """Statistics, shares of line kinds and kind of every document (``keep`` columns and ``text``)."""
    kept = [f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep]
    raw = ", ".join([*kept, *[f"{s} bigint" for s in RAW], "codes array<bigint>", "chars array<int>"])
    # Texts are read and described once; fitting and labelling read the codes.
    described = materialize(documents.select(*keep, "text").mapInArrow(_describe_batches(common_words(words), keep), raw), "lines").df
    schema = ", ".join([*kept, "n_words bigint", *[f"{s} double" for s in STATS[1:]], *[f"{k}_share double" for k in KINDS], "kind string"])
    return described.mapInArrow(_label_batches(train(described), keep), schema)
