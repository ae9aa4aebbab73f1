"""One consistent form for text that looks the same but consists of other characters.

Values are taken apart into positioned code points.  A broadcast mapping made
from the Unicode database (at most one row per code point, so its size is
bounded by the standard) gives each its decomposition and combining class;
marks are put in order of class within their cluster, clusters are composed
again through a second mapping, and letters that stand in a word of another
script are replaced through the list of look-alikes.  Then the strings are
rebuilt.  Every distinct value is worked on once; plain ASCII isn't touched.

Kept as they are: composed accents, typographic quotes and dashes, the section
sign, words and single signs wholly of another script, superscripts and
fractions.  Null stays null and the empty string empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters of Greek and Cyrillic that look like Latin ones, and what they look like.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ԁ": "D",
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "г": "r", "п": "n", "ѵ": "v", "Ѵ": "V",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "γ": "y", "ω": "w", "η": "n",
}

#: Compatibility forms that mean something else than their plain signs.
KEPT_TAGS = {"<super>", "<sub>", "<fraction>"}

_GRAPHEME_JOINER = 0x34F


def _hangul() -> Iterator[tuple[str, str, str]]:
    """(first, second, composed) of the Korean syllables, by the rule of the standard."""
    for s in range(0xAC00, 0xD7A4):
        at = s - 0xAC00
        tail = at % 28
        if tail:
            yield chr(s - tail), chr(0x11A7 + tail), chr(s)
        else:
            yield chr(0x1100 + at // 588), chr(0x1161 + at % 588 // 28), chr(s)


# Stretches of the code space that hold more than unified ideographs, syllables, private and free places.
STRETCHES = [(0xA0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)]


@lru_cache(1)
def _tables() -> tuple[list, list, int]:
    """(character mapping, composition mapping, longest chain of compositions) from the Unicode database."""
    made: dict[str, dict[str, str]] = {}
    steps = 2
    points = [c for low, high in STRETCHES for c in range(low, high)]
    for c in points:
        tag = unicodedata.decomposition(chr(c))
        if tag and not tag.startswith("<") and " " in tag and unicodedata.normalize("NFC", chr(c)) == chr(c):
            first, second = (chr(int(x, 16)) for x in tag.split())
            made.setdefault(first, {})[second] = chr(c)
            steps = max(steps, len(unicodedata.normalize("NFD", chr(c))) - 1)
    for first, second, whole in _hangul():
        made.setdefault(first, {})[second] = whole
    #: seconds that aren't marks
    joins = {second for m in made.values() for second in m if not unicodedata.combining(second)}
    chars = []
    for c in points:
        ch = chr(c)
        if ch in LOOK_ALIKE:
            continue
        kind = unicodedata.category(ch)
        if kind == "Cf" or c == _GRAPHEME_JOINER or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            chars.append((ch, [], True, False, False))
        elif kind == "Zs":
            chars.append((ch, [(" ", 0)], True, False, False))
        else:
            tag = unicodedata.decomposition(ch)
            mark = unicodedata.combining(ch)
            if tag.startswith("<"):
                full = unicodedata.normalize("NFKD", ch)
                if tag.split()[0] not in KEPT_TAGS and not full.startswith(" "):
                    chars.append((ch, [(x, unicodedata.combining(x)) for x in full], True, False, False))
            elif tag:
                full = unicodedata.normalize("NFD", ch)
                same = unicodedata.normalize("NFC", ch) == ch
                chars.append((ch, [(x, unicodedata.combining(x)) for x in full], not same, bool(mark), False))
            elif mark or ch in joins:
                chars.append((ch, [(ch, mark)], False, True, ch in joins))
    return chars, [(first, m) for first, m in made.items()], steps


def char_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_tables()[0], "ch string, sub array<struct<c: string, ccc: int>>, odd boolean, mark boolean, joins boolean")


def composition_table(spark: SparkSession) -> DataFrame:
    """One row per first character: what it makes with each second."""
    return spark.createDataFrame(_tables()[1], "head string, made map<string, string>")


@lru_cache(1)
def _other_letters() -> list[str]:
    """Letters of alphabets other than Latin, without ideographs and Korean syllables."""
    out = []
    for c in [*range(0x370, 0x2E80), *range(0xA000, 0xAC00), *range(0x10000, 0x1F000)]:
        ch = chr(c)
        if unicodedata.category(ch) in ("Lu", "Ll", "Lo") and not unicodedata.name(ch, "LATIN").startswith("LATIN") and unicodedata.normalize("NFKD", ch) == ch:
            out.append(ch)
    return out


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Every letter that looks like a Latin one: the list above, and the Unicode confusables that Spark's ICU library carries.

    Where several Latin letters look the same, the one of the same case is taken.
    A session from which that library can't be read raises an error: the list
    alone would leave cases out.
    """
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    letters = _other_letters()
    try:
        icu = spark._jvm.com.ibm.icu.text.SpoofChecker
        forms = getattr(icu, "Builder")().build().getSkeleton("\n".join([*plain, *letters])).split("\n")
    except Exception as e:
        raise RuntimeError("the Unicode confusables can't be read from the ICU library of this session (com.ibm.icu.text.SpoofChecker)") from e
    if len(forms) != len(plain) + len(letters):
        raise RuntimeError(f"the ICU library of this session gave {len(forms)} forms for {len(plain) + len(letters)} letters")
    by_form: dict[str, list[str]] = {}
    for ch, form in zip(plain, forms):
        by_form.setdefault(form, []).append(ch)
    out: dict[str, str] = {}
    for ch, form in zip(letters, forms[len(plain) :]):
        like = by_form.get(form)
        if like:
            out[ch] = next((x for x in like if x.isupper() == ch.isupper()), like[0])
    return out | LOOK_ALIKE


def look_alike_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(look_alikes(spark).items()), "c string, looks string")


def beyond_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7f]")


def _ids(c: Column) -> list[Column]:
    """Two independent hashes that stand for a value wherever only its identity is needed."""
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit("value"), c).alias("k2")]


def _forms(values: DataFrame) -> DataFrame:
    """(k1, k2, v, unified, odd) of the distinct non-ASCII values of a one-column table ``v``.

    One exchange: everything after it is keyed by the hashes; the value itself
    travels on its first character only.
    """
    spark = values.sparkSession
    k = ["k1", "k2"]
    v = values.where(beyond_ascii(F.col("v"))).select(*_ids(F.col("v")), "v").groupBy(*k).agg(F.first("v").alias("v"))
    points = v.select(*k, "v", F.posexplode(F.regexp_extract_all("v", F.lit("(?s)."), F.lit(0))).alias("pos", "ch")).withColumn("v", F.when(F.col("pos") == 0, F.col("v")))
    plain = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))
    off = F.lit(False)
    parts = (
        points.join(F.broadcast(char_table(spark)), "ch", "left")
        .select(*k, "v", "pos", "ch", F.coalesce("odd", off).alias("odd"), F.coalesce("mark", off).alias("mark"), F.coalesce("joins", off).alias("joins"), F.posexplode_outer(F.coalesce("sub", plain)).alias("j", "s"))
        .select(*k, "v", "pos", F.coalesce("j", F.lit(0)).alias("j"), "ch", "odd", "mark", "joins", F.col("s.c").alias("c"), F.coalesce(F.col("s.ccc"), F.lit(0)).alias("ccc"))
    )
    # A cluster is a character with what may join it; invisible marks don't end one.
    order = Window.partitionBy(*k).orderBy("pos", "j")
    there = F.col("c").isNotNull()
    before = F.last(F.when(there, F.col("ccc")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (there & (F.col("ccc") == 0) & ~(F.col("joins") & F.coalesce(before == 0, F.lit(False)))).cast("int")
    clusters = (
        parts.withColumn("cluster", F.sum(opens).over(order))
        .groupBy(*k, "cluster")
        .agg(
            F.sort_array(F.collect_list(F.when(there, F.struct("ccc", "pos", "j", "c")))).alias("all"),
            F.sort_array(F.collect_list(F.when(F.col("j") == 0, F.struct("pos", "ch")))).alias("was"),
            F.max("odd").alias("odd"),
            F.max("mark").alias("mark"),
            F.max("v").alias("v"),
        )
        .withColumn("was", F.array_join(F.transform("was", lambda s: s["ch"]), ""))
        .withColumn("starts", F.coalesce(F.get("all", F.lit(0))["ccc"] == 0, F.lit(False)))
        .withColumn("head", F.when(F.col("starts"), F.get("all", F.lit(0))["c"]))
        .withColumn("rest", F.when(F.col("starts"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))).otherwise(F.col("all")))
        .withColumn("from", F.lit(0))
    )
    # Canonical composition: again and again the first mark that isn't blocked and makes something with the head.
    made = F.broadcast(composition_table(spark).withColumnRenamed("head", "first"))
    for _ in range(_tables()[2]):
        clusters = clusters.join(made, F.when(F.size("rest") > 0, F.col("head")) == F.col("first"), "left")

        def fits(i: Column) -> Column:
            mark, last = F.get("rest", i), F.get("rest", i - 1)["ccc"]
            free = (i == 0) | ((F.get("rest", F.lit(0))["ccc"] != 0) & (last < mark["ccc"]))
            return (i >= F.col("from")) & F.col("made")[mark["c"]].isNotNull() & free

        at = F.get(F.filter(F.when(F.col("made").isNotNull(), F.sequence(F.lit(0), F.size("rest") - 1)), fits), F.lit(0))
        clusters = clusters.withColumn("at", at).select(
            *k, "cluster", "v", "was", "odd", "mark",
            F.coalesce(F.col("made")[F.get("rest", F.col("at"))["c"]], "head").alias("head"),
            F.when(F.col("at").isNotNull(), F.concat(F.slice("rest", 1, F.col("at")), F.slice("rest", F.col("at") + 2, F.size("rest")))).otherwise(F.col("rest")).alias("rest"),
            F.coalesce("at", "from").alias("from"),
        )
    text = F.concat(F.coalesce("head", F.lit("")), F.array_join(F.transform("rest", lambda s: s["c"]), ""))
    whole = clusters.select(*k, "cluster", "v", text.alias("c"), (F.col("odd") | (F.col("mark") & (text != F.col("was")))).alias("odd"))
    # Words: runs of letters. A letter of another script in a word with Latin letters only looks Latin.
    along = Window.partitionBy(*k).orderBy("cluster")
    letter = F.col("c").rlike(r"^[\p{L}\p{M}]+$")
    word = Window.partitionBy(*k, "word")
    scripts = (
        whole.withColumn("word", F.sum((~letter).cast("int")).over(along))
        .withColumn("latin", F.max(F.col("c").rlike(r"\p{IsLatin}")).over(word))
        .join(F.broadcast(look_alike_table(spark)), "c", "left")
        .withColumn("foreign", F.col("latin") & (F.col("looks").isNotNull() | F.col("c").rlike(r"[\p{IsGreek}\p{IsCyrillic}]")))
    )
    seen = F.when(F.col("foreign"), F.coalesce("looks", "c")).otherwise(F.col("c"))
    return (
        scripts.select(*k, "cluster", "v", (F.col("odd") | F.col("foreign")).alias("odd"), seen.alias("c"))
        .groupBy(*k)
        .agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("all"), F.max("odd").alias("odd"), F.max("v").alias("v"))
        .select(*k, "v", F.array_join(F.transform("all", lambda s: s["c"]), "").alias("unified"), "odd")
    )


def unify_values(values: DataFrame, column: str = "value") -> DataFrame:
    """Distinct non-ASCII values with their consistent form: (column, unified, odd).

    ``odd`` tells whether the value held a compatibility form, a split accent,
    an invisible mark, an unusual blank, or a letter of another script in a Latin word.
    """
    return _forms(values.select(F.col(column).alias("v"))).select(F.col("v").alias(column), "unified", "odd")


def unify_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns in consistent form; each distinct value is converted once."""
    out = df
    for c in columns:
        forms = _forms(df.select(F.col(c).alias("v"))).select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), F.col("unified").alias("unified_"))
        some = F.coalesce(beyond_ascii(F.col(c)), F.lit(False))
        h1, h2 = (F.when(some, h) for h in _ids(F.col(c)))
        out = out.join(forms, (h1 == F.col("k1_")) & (h2 == F.col("k2_")), "left").withColumn(c, F.coalesce("unified_", c)).select(*df.columns)
    return out


def odd_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Distinct keys and names of the fields whose value isn't in consistent form."""
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x")
    values = df.select(*keys, long).select(*keys, "x.field", "x.v").where(beyond_ascii(F.col("v")))
    odd = _forms(values.select("v")).where("odd").select("k1", "k2")
    return values.select(*keys, "field", *_ids(F.col("v"))).join(odd, ["k1", "k2"], "left_semi").select(*keys, "field").distinct()
