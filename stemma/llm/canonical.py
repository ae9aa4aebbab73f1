"""Freely typed labels and titles mapped to the entries of a reference list.

Typed values are reduced to token sets and joined with the token sets of the
list by a prefix-filter set-similarity join: tokens are put in order of their
rarity over all values and entries (tokens of no entry first, they meet none),
only the rare prefix of each set takes part in the join, candidates pass a
length and a positional filter, the Jaccard similarity is then computed
exactly, and the best entry is kept (ties: smallest ref_id).  Each distinct
value is handled once, labels and titles in one pass.

Tokens of a label are its keyword, part, number and letter, read with tolerance
for slips of typing and scanning; a number that the list doesn't hold names
nothing, so labels must reach a similarity of 1.  Tokens of a title are the
character trigrams of its telling words.  Labels and titles may have any length.

The reference list is a fixed list of a few dozen entries; it is read whole and
refused above ``MAX_REFERENCE`` rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.unify import unify_columns
from stemma.session import materialize

MAX_REFERENCE = 10_000
TITLE_SIMILARITY = 0.34
LABEL_SIMILARITY = 1.0
#: Letters and digits of the longest reading: two keywords, two numbers in words, "of", "No", a letter.
#: Leading zeros apart, more can't be a keyword and a number of the list.
LONGEST_READING = 64

# Number words and function words.
WORD_NUMBERS = {w: n for n, w in enumerate("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN TWENTY".split(), 1)}
STOP_WORDS = set("of the and to for in by on with or from a an".split())


# ---------------------------------------------------------------- labels


@lru_cache(1 << 16)
def slip_distance(a: str, b: str) -> int:
    """Edits between two short words; swapping neighbours is one edit."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + 1)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


_SCAN = str.maketrans({"1": "I", "4": "A", "0": "O", "5": "S", "|": "I"})
KEYWORDS = {"item": "ITEM", "part": "PART", "article": "ARTICLE"}
SHORT_KEYWORDS = {"item": {"IT", "ITM"}, "part": {"PT", "PRT"}, "article": {"ART", "ARTCL"}}


@lru_cache(1 << 16)
def keyword_cost(raw: str, kind: str) -> int | None:
    """Edits from a typed keyword to the keyword of the kind; None if it is another word."""
    word = re.sub(r"[^A-Z0-9|]", "", raw.upper())
    if len(word) < 2 or not any(x.isalpha() for x in word):
        return None
    key = KEYWORDS[kind]
    forms = {word, word.translate(_SCAN), word.translate(_SCAN).replace("IVI", "M"), word.translate(_SCAN).replace("L", "I")}
    cost = min(min([slip_distance(f, key)] + [slip_distance(f, s) * 2 for s in SHORT_KEYWORDS[kind]]) for f in forms)
    return cost if cost <= (1 if len(word) <= 2 else 3 if kind == "article" else 2) else None


_ROMAN = re.compile(r"^(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
_VALUE = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def roman(s: str) -> int | None:
    if not s or not _ROMAN.match(s):
        return None
    v = [_VALUE[x] for x in s]
    return sum(-a if b > a else a for a, b in zip(v, v[1:] + [0]))


@lru_cache(1 << 16)
def number_of(raw: str) -> int | None:
    """Value of digits, roman numerals or number words, with l for 1 and O for 0."""
    s = re.sub(r"\s+", "", raw)
    if not s:
        return None
    up = s.upper()
    if up in WORD_NUMBERS:
        return WORD_NUMBERS[up]
    if s.isdigit():
        return int(s)
    if re.fullmatch(r"[0-9lIOo|]+", s) and re.search(r"[0-9Oo]", s):
        return int(re.sub(r"[lI|]", "1", s).replace("O", "0").replace("o", "0"))
    got = roman(up)
    if got is None or "L" in up:
        other = roman(up.replace("L", "I").replace("1", "I").replace("|", "I"))
        got = other if other is not None else got
    if got is None and len(up) > 3 and not re.search(r"\s\S$", raw):
        close = [n for w, n in WORD_NUMBERS.items() if len(w) > 3 and slip_distance(up, w) == 1]
        got = close[0] if len(close) == 1 else None
    return got


_EDGES = " \t.:;,#()[]-–—_*"
_NO = re.compile(r"^(?:[\s.:#(\-–—]*)(?:N\s?[O0]\s?\.)?[\s.:#(\-–—]*", re.I)


@lru_cache(1 << 16)
def item_number(raw: str) -> tuple[int | None, int, str] | None:
    """(part or None, number, letter) of what follows the keyword."""
    s = _NO.sub("", raw).strip(_EDGES).strip()
    if not s:
        return None
    got = number_of(s)
    if got is not None:
        return None, got, ""
    m = re.fullmatch(r"(.*?[^\s.\-–(])\s*[.\-–(\s]+\s*\(?([A-Za-z0-9|][A-Za-z0-9|\s.\-()]*)", s)
    if m:
        a = number_of(m[1])
        tail = m[2].strip(_EDGES).strip()
        if a is not None:
            if re.fullmatch(r"[A-HJKa-hjk]", tail):
                return None, a, tail.upper()
            sub = item_number(tail)
            if sub and sub[0] is None:
                return a, sub[1], sub[2]
            if re.fullmatch(r"[A-Za-z]", tail):
                return None, a, tail.upper()
        # Letter in two steps: 1.A, 9(c), nine - a
        deep = item_number(m[1])
        if deep and not deep[2] and re.fullmatch(r"[A-Za-z]", tail):
            return deep[0], deep[1], tail.upper()
    m = re.fullmatch(r"([0-9lIOo|]*[0-9OoIl|]|[IVXivx]+)\s?([A-Za-z])", s)
    if m:
        a = number_of(m[1])
        if a is not None:
            return None, a, m[2].upper()
    return None


def _plain_number(raw: str) -> int | None:
    return number_of(_NO.sub("", raw).strip(_EDGES).strip())


def _cuts(s: str, longest: int) -> Iterator[tuple[int, float]]:
    """Places at which a keyword may end, with what it costs when it isn't a boundary."""
    seen = 0
    for i, x in enumerate(s):
        if x.isalnum() or x == "|":
            seen += 1
        if seen > longest:
            return
        if seen >= 2:
            nxt = s[i + 1 : i + 2]
            yield i + 1, 0.0 if not (nxt.isalnum() or nxt == "|") else 0.1 if nxt.isdigit() else 0.4


@lru_cache(1 << 16)
def _headed(s: str, kind: str, reader) -> tuple[float, object] | None:
    """Cheapest reading of ``s`` as keyword and number."""
    s = s.strip()
    best = None
    for cut, extra in _cuts(s, len(KEYWORDS[kind]) + 2):
        cost = keyword_cost(s[:cut], kind)
        if cost is None:
            continue
        value = reader(s[cut:])
        if value is None:
            continue
        total = cost + extra
        if best is None or total < best[0]:
            best = (total, value)
    return best


_ZEROS = re.compile(r"(?<![\w|])0+(?=\d)")
_DASHES = re.compile(r"[\s.\-–]{3,}")
_MIXED = re.compile(r"(?:[^\w|]|_){8,}")
_RULES = re.compile(r"([.…·_=*:,;#()—–-])(?:\s*\1)+")


def _tight(s: str) -> str:
    """Leaders, rules and leading zeros drawn together; what is read stays the same."""
    s = _DASHES.sub(lambda m: " - " if m[0].strip() else " ", s)
    s = _MIXED.sub(lambda m: "".join(dict.fromkeys(m[0])), _RULES.sub(r"\1", s))
    return _ZEROS.sub("", s)


_OF_PART = re.compile(r"^(.*\S)\s+[o0]f\s+(.+)$", re.I)
_IN_BRACKETS = re.compile(r"^(.*?)\s*\(([^()]{3,})\)*$")


def read_label(value: str, kind: str) -> tuple | None:
    """(keyword, part or None, number, letter) that a typed label names; None if it names none."""
    s = _tight(re.sub(r"\s+", " ", value).strip())
    if sum(x.isalnum() or x == "|" for x in s) > LONGEST_READING:
        return None
    s = re.sub(r"[.:\-–—)\s]+$", "", s) if kind != "item" else s.strip()
    if kind != "item":
        got = _headed(s, kind, _plain_number)
        return (kind, None, got[1], "") if got else None
    readings = []
    tail = re.sub(r"[.:\-–—\s]+$", "", s)
    got = _headed(tail, "item", item_number)
    if got:
        readings.append((got[0], got[1]))
    for m in filter(None, (_OF_PART.match(tail), _IN_BRACKETS.match(tail))):
        part = _headed(m[2], "part", _plain_number)
        item = _headed(m[1], "item", item_number)
        if part and item and item[1][0] is None:
            readings.append((part[0] + item[0] - 1, (part[1], item[1][1], item[1][2])))
    # Part first: every place where the item's keyword may begin.
    if keyword_prefix(tail):
        for i in range(3, len(tail) - 2):
            if not tail[i].isalnum() and tail[i] != "|":
                continue
            before = tail[i - 1]
            edge = 0.0 if not before.isalnum() else 1.2
            part = _headed(tail[:i], "part", _plain_number)
            if not part:
                continue
            item = _headed(tail[i:], "item", item_number)
            if item and item[1][0] is None:
                readings.append((part[0] + item[0] + edge, (part[1], item[1][1], item[1][2])))
    if not readings:
        return None
    _, (part, number, letter) = min(readings, key=lambda x: x[0])
    return "item", part, number, letter


def keyword_prefix(s: str) -> bool:
    return any(keyword_cost(s[:cut], "part") is not None for cut, _ in _cuts(s, 6))


def label_tokens(value: str, kind: str) -> list[str] | None:
    got = read_label(value, kind)
    if got is None:
        return None
    word, part, number, letter = got
    out = [f"word {word}", f"number {number}"]
    if part is not None:
        out.append(f"part {part}")
    if letter:
        out.append(f"letter {letter}")
    return out


# ---------------------------------------------------------------- titles

_PAGE = re.compile(r"[\s.]*\.{3,}\s*\d*\s*$")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def _title_words(value: str) -> list[str]:
    return _WORD.findall(_PAGE.sub("", value.lower().replace("’", "'")))


class Vocabulary:
    """The words of the reference titles, and what a typed word may be short for.

    A short form begins like its word, keeps the order of its letters, and is a beginning of it, or one but for its
    last letter, or lacks a single letter, or has no vowel behind its first letter.  Of several words a beginning
    goes before the rest, then the shortest counts, then the first by name.
    """

    def __init__(self, titles: Iterable[str]) -> None:
        self.words = {w for t in titles for w in _title_words(t)}
        self.by_letter: dict[str, list[str]] = {}
        for w in sorted(self.words):
            self.by_letter.setdefault(w[0], []).append(w)
        self.written = lru_cache(1 << 16)(self._written)

    def __reduce__(self):
        return Vocabulary, (sorted(self.words),)

    def _written(self, typed: str) -> str:
        """The word written out, or the typed word itself."""
        w = typed.replace("'", "")
        if typed in self.words or typed in STOP_WORDS or len(w) < 2 or w.isdigit():
            return typed
        fits = [r for r in self.by_letter.get(w[0], ()) if len(r) > len(w) and self._short_for(w, r)]
        return min(fits, key=lambda r: (not r.startswith(w), len(r), r), default=typed)

    @staticmethod
    def _short_for(w: str, r: str) -> bool:
        letters = iter(r)
        if not all(x in letters for x in w):
            return False
        return r.startswith(w[:-1]) or len(r) - len(w) == 1 or not set(w[1:]) & set("aeiou")


def title_tokens(value: str, vocabulary: Vocabulary | None = None) -> list[str]:
    """Trigrams of the telling words of a title, short forms of the vocabulary written out."""
    words = [vocabulary.written(w) for w in _title_words(value)] if vocabulary else _title_words(value)
    told = [w for w in words if w not in STOP_WORDS and not w.isdigit()] or words
    grams: dict[str, None] = {}
    for w in told:
        p = f"^{w}$"
        for i in range(len(p) - 2):
            grams[p[i : i + 3]] = None
    return list(grams)


# ---------------------------------------------------------------- the join


def prefix_length(n: int, t: float) -> int:
    """So many of n ordered tokens are enough to meet every set of similarity t or more."""
    return max(0, n - int(-(-t * n // 1)) + 1) if n else 0


def _tokens_batch(vocabulary: Vocabulary | None):
    """Token set of each (side, grp, value, form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides, groups, forms = (b.column(i).to_pylist() for i in (0, 1, 3))
            sets = [None if f is None else label_tokens(f, g) if side == "label" else title_tokens(f, vocabulary) for side, g, f in zip(sides, groups, forms)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([sorted(set(x or [])) for x in sets], pa.list_(pa.string()))], names=["side", "grp", "value", "tokens"])

    return run


def similarity_join(values: DataFrame, reference: list[tuple], limits: dict[str, float], vocabulary: Vocabulary | None = None) -> DataFrame:
    """Best reference entry of each (side, grp, value): those, ref_id, similarity.

    ``values`` has side, grp, value and form (the text that is compared);
    ``reference`` is a list of (ref_id, side, grp, tokens); ``limits`` gives each
    side its similarity.  A null grp, of a value or an entry, meets every grp of
    its side.  Values that reach no entry don't come out.
    """
    spark = values.sparkSession
    schema = "side string, grp string, value string, tokens array<string>"
    # Reading a label is dear and its text is short: few bytes are spread over all cores.
    spread = values.select("side", "grp", "value", "form").repartition(max(8, spark.sparkContext.defaultParallelism), "value")
    sets = materialize(spread.mapInArrow(_tokens_batch(vocabulary), schema), "tokens").df
    # Rarity over everything; only tokens of entries can meet, so the counts are bounded by the list.
    seen = Counter(x for _, _, _, toks in reference for x in set(toks))
    vocabulary = spark.createDataFrame([(x,) for x in seen], "token string")
    for r in sets.select(F.explode("tokens").alias("token")).join(F.broadcast(vocabulary), "token").groupBy("token").count().collect():
        seen[r["token"]] += r["count"]
    rank = {x: i for i, (x, _) in enumerate(sorted(seen.items(), key=lambda p: (p[1], p[0])))}
    rows = []
    for ref_id, side, grp, toks in reference:
        toks = sorted(set(toks), key=lambda x: rank[x])
        for i, x in enumerate(toks[: prefix_length(len(toks), limits[side])]):
            rows.append((x, i, ref_id, side, grp, toks))
    ref = spark.createDataFrame(rows, "token string, ref_at int, ref_id int, ref_side string, ref_grp string, ref_tokens array<string>")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [sorted(x, key=lambda x: (rank.get(x, -1), x)) for x in b.column(3).to_pylist()]
            heads = [x[: prefix_length(len(x), limits[side])] for x, side in zip(sets_, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets_, pa.list_(pa.string())), pa.array(heads, pa.list_(pa.string()))], names=["side", "grp", "value", "tokens", "prefix"])

    t = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("side")]
    n, m = F.size("tokens"), F.size("ref_tokens")
    need = F.ceil(t / (1 + t) * (n + m))
    left = F.lit(1) + F.least(n - F.col("at") - 1, m - F.col("ref_at") - 1) + F.least(F.col("at"), F.col("ref_at"))
    met = (
        sets.mapInArrow(prefixes, f"{schema}, prefix array<string>")
        .select("side", "grp", "value", "tokens", F.posexplode("prefix").alias("at", "token"))
        .join(F.broadcast(ref), "token")
        .where((F.col("ref_side") == F.col("side")) & (F.col("ref_grp").isNull() | F.col("grp").isNull() | (F.col("ref_grp") == F.col("grp"))))
        .where((m >= n * t) & (n >= m * t) & (left >= need))
    )
    common = F.size(F.array_intersect("tokens", "ref_tokens"))
    jaccard = common / (n + m - common)
    return (
        met.withColumn("similarity", jaccard)
        .where(F.col("similarity") >= t)
        .groupBy("side", "grp", "value")
        .agg(F.max(F.struct("similarity", (-F.col("ref_id")).alias("minus"))).alias("best"))
        .select("side", "grp", "value", (-F.col("best.minus")).alias("ref_id"), F.col("best.similarity").alias("similarity"))
    )


def _reference_rows(reference: DataFrame) -> list:
    rows = reference.limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows")
    return sorted(rows, key=lambda r: r["ref_id"])


def plain_label(c):
    """Outer spaces and trailing punctuation removed, in capitals."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[.:\-–— ]+$", "")


def map_values(values: DataFrame, reference: list) -> DataFrame:
    """ref_id of each distinct (side, grp, value) that reaches an entry.

    side is 'label' (grp is its kind) or 'title' (grp is its grammar, null for any).
    """
    entries = [(r["ref_id"], "label", r["level_kind"], label_tokens(r["label_canon"], r["level_kind"])) for r in reference if r["level_kind"] in KEYWORDS]
    entries += [(r["ref_id"], "title", r["grammar"], title_tokens(r["ref_title"])) for r in reference if r["ref_title"]]
    forms = unify_columns(values.where(F.col("value").isNotNull()).distinct().withColumn("form", F.col("value")), ["form"])
    return similarity_join(forms, entries, {"label": LABEL_SIMILARITY, "title": TITLE_SIMILARITY}, Vocabulary(r["ref_title"] for r in reference if r["ref_title"]))


def map_records(candidates: DataFrame, nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct (rec_table, accession_number, sequence, rec_no, ref_id) of both kinds of record.

    Labels that are printed forms of the list are no cases.  A null title means
    no entry; a node without grammar may take an entry of any grammar.
    """
    rows = _reference_rows(reference)
    known = [x for r in rows for x in (r["label_canon"], r["alt_label"]) if x]
    key = ["accession_number", "sequence"]
    label = F.col("label_raw")
    typed = candidates.where(F.col("kind").isin(*KEYWORDS) & label.isNotNull()).where(~plain_label(label).isin(*known))
    lost = nodes.where((F.col("level_kind") == "item") & F.col("label_canon").isNull())
    records = typed.select(F.lit("candidates").alias("rec_table"), *key, F.col("cand_no").alias("rec_no"), F.lit("label").alias("side"), F.col("kind").alias("grp"), label.alias("value")).unionByName(
        lost.select(F.lit("nodes").alias("rec_table"), *key, F.col("node_id").alias("rec_no"), F.lit("title").alias("side"), F.col("grammar").alias("grp"), F.col("title").alias("value"))
    )
    # Written, so that the size of the mapping is known when it is joined: broadcast if small, else by keys.
    mapped = materialize(map_values(records.select("side", "grp", "value"), rows).select(F.col("side").alias("m_side"), F.col("grp").alias("m_grp"), F.col("value").alias("m_value"), "ref_id"), "mapped").df
    same = (F.col("side") == F.col("m_side")) & F.col("grp").eqNullSafe(F.col("m_grp")) & (F.col("value") == F.col("m_value"))
    return records.join(mapped, same, "left").select("rec_table", *key, "rec_no", F.coalesce("ref_id", F.lit(-1)).cast("int").alias("ref_id")).distinct()
