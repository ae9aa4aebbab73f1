"""Reader of the labels that heading lines begin with: keyword, numeral, suffix, separator, title.

A cursor goes over the line once.  What a numeral, a suffix or a separator may
be is given per kind of label; the grammars decide what a label is called.
"""

from __future__ import annotations

from dataclasses import dataclass

from stemma.functions.labels import WORDS

ORNAMENTS = "\"'([*•-"
DASHES = "-–—"


@dataclass
class Head:
    """A label as printed. ``at`` is where its title begins."""

    kind: str
    text: str
    numeral: str
    value: int | None
    how: str = "digits"
    suffix: str = ""
    bracket: str = ""
    plural: bool | None = None
    keyword: bool = True
    after: str = ""
    gap: str = ""
    minor: int | None = None
    sub: str = ""
    at: int = 0

    @property
    def title(self) -> str:
        return self.text[self.at :]


_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def roman(s: str) -> int | None:
    """Value of a well-formed numeral up to 100: the one whose own spelling is ``s``."""
    if not s or any(c not in _ROMAN for c in s):
        return None
    total, top = 0, 0
    for c in reversed(s):
        v = _ROMAN[c]
        total += v if v >= top else -v
        top = max(top, v)
    return total if spelled(total) == s else None


def spelled(n: int) -> str:
    out = ""
    for value, sign in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def numeral(s: str) -> int | None:
    s = s.upper()
    return int(s) if s.isdigit() else WORDS.index(s) + 1 if s in WORDS else roman(s)


class Cursor:
    def __init__(self, text: str, ornaments: str = ORNAMENTS) -> None:
        self.text, self.i = text, 0
        self.skip(ornaments)

    def peek(self, k: int = 0) -> str:
        return self.text[self.i + k : self.i + k + 1]

    def skip(self, signs: str = "") -> int:
        """Pass blanks and the signs; how many characters were passed."""
        start = self.i
        while self.peek() and (self.peek().isspace() or self.peek() in signs):
            self.i += 1
        return self.i - start

    def keyword(self, word: str) -> bool:
        """The word, in any case, its letters set apart by single blanks or not."""
        j = self.i
        for n, c in enumerate(word):
            if n and self.text[j : j + 1].isspace():
                j += 1
            if self.text[j : j + 1].upper() != c:
                return False
            j += 1
        self.i = j
        return True

    def run(self, test) -> str:
        j = self.i
        while j < len(self.text) and test(self.text[j]):
            j += 1
        out, self.i = self.text[self.i : j], j
        return out

    def digits(self, most: int) -> str | None:
        """A number of at most so many digits, all of it."""
        start = self.i
        got = self.run(str.isdecimal)
        if 0 < len(got) <= most:
            return got
        self.i = start
        return None

    def counted(self, most_digits: int, top: int, words: int) -> tuple[str, int, str] | None:
        """Digits, a roman numeral up to ``top``, or a number word up to ``words``: (text, value, how)."""
        got = self.digits(most_digits)
        if got is not None:
            return got, int(got), "digits"
        start = self.i
        got = self.run(lambda c: c.isascii() and c.isalpha()).upper()
        value = roman(got)
        if value is not None and value <= top and not word_sign(self.peek()):
            return got, value, "roman"
        if got in WORDS[:words] and self.text[start - 1 : start].isspace():
            return got, WORDS.index(got) + 1, "word"
        self.i = start
        return None

    def separator(self, signs: str) -> str | None:
        """Signs with blanks around, blanks alone, or the end of the line; None if text goes on."""
        start = self.i
        self.skip()
        if self.peek() and self.peek() in signs:
            self.run(lambda c: c in signs)
            self.skip()
        elif self.i == start and self.peek():
            return None
        return self.text[start : self.i]


def word_sign(c: str) -> bool:
    return c.isalnum() or c == "_"


def _ends(c: Cursor, head: Head, signs: str) -> Head | None:
    after = c.separator(signs)
    if after is None:
        return None
    head.after, head.at = after, c.i
    return head


def _item_start(text: str, plural: bool) -> tuple[Cursor, bool] | None:
    c = Cursor(text)
    if not c.keyword("ITEM"):
        return None
    many = plural and c.peek().upper() == "S"
    c.i += many
    mark = c.i
    c.skip()
    if c.keyword("NO"):
        c.i += c.peek() == "."
    else:
        c.i = mark
    c.skip()
    return c, many


def part(text: str) -> Head | None:
    c = Cursor(text)
    if not c.keyword("PART") or not c.skip():
        return None
    got = c.counted(1, 4, 4)
    if not got or not 1 <= got[1] <= 4 or word_sign(c.peek()):
        return None
    return _ends(c, Head("part", text, got[0], got[1], got[2]), ".:," + DASHES)


def item(text: str) -> Head | None:
    """Items of annual reports: a number up to 99, XVI or SIXTEEN, a letter A to C behind it or in brackets."""
    start = _item_start(text, True)
    got = start and start[0].counted(2, 16, 16)
    if not got:
        return None
    c, many = start
    h = Head("item", text, *got, plural=many)
    mark = c.i
    c.skip()
    if c.peek() == ".":
        c.i += 1
        c.skip()
    if c.peek().upper() in ("A", "B", "C") and not word_sign(c.peek(1)):
        h.suffix = c.peek().upper()
        c.i += 1
    else:
        c.i = mark
        if word_sign(c.peek()):
            return None
    mark = c.i
    c.skip()
    if c.peek() == "(" and c.peek(1).isascii() and c.peek(1).isalpha() and c.peek(2) == ")":
        h.bracket = c.peek(1).upper()
        c.i += 3
    else:
        c.i = mark
    return _ends(c, h, ".:,;)" + DASHES)


def disclosure_item(text: str) -> Head | None:
    """Items 1100 to 1123 of asset-backed filings, with bracketed parts."""
    start = _item_start(text, False)
    got = start and start[0].digits(4)
    if not got or not 1100 <= int(got) <= 1123:
        return None
    c = start[0]
    h = Head("item", text, got, int(got))
    if c.peek() == "(" and c.peek(1).isascii() and c.peek(1).isalpha() and c.peek(2) == ")":
        h.bracket = c.peek(1)
        c.i += 3
        mark = c.i
        if c.peek() == "(":
            c.i += 1
            if not c.run(str.isdecimal) or c.peek() != ")":
                c.i = mark
            else:
                c.i += 1
    return None if word_sign(c.peek()) else _ends(c, h, ".:,;)" + DASHES)


def quarterly_item(text: str) -> Head | None:
    """Items of quarterly reports: one digit, IV or SIX at most; a letter A to C or T, set off or not."""
    start = _item_start(text, True)
    got = start and start[0].counted(1, 4, 6)
    if not got:
        return None
    c, many = start
    h = Head("item", text, *got, plural=many)
    mark = c.i
    c.skip("." + DASHES)
    c.i += c.peek() == "("
    letter = c.peek().upper()
    closed = c.peek(1) == ")"
    if letter in ("A", "B", "C", "T") and not word_sign(c.peek(1 + closed)):
        h.suffix, h.gap = letter, text[mark : c.i]
        c.i += 1 + closed
    else:
        c.i = mark
        if word_sign(c.peek()):
            return None
    return _ends(c, h, ".:)" + DASHES)


def article(text: str) -> Head | None:
    c = Cursor(text)
    if not c.keyword("ARTICLE") or not c.skip():
        return None
    got = c.digits(2) or c.run(lambda x: x.isascii() and x.isalpha())
    if not got or word_sign(c.peek()):
        return None
    return _ends(c, Head("article", text, got, numeral(got)), ".:" + DASHES)


def section(text: str) -> Head | None:
    c = Cursor(text)
    marked = c.peek() == "§"
    if marked:
        c.i += 1
        c.skip()
    elif c.keyword("SECTION"):
        marked = bool(c.skip())
        if not marked:
            return None
    major = c.digits(2)
    if major is None:
        return None
    h = Head("section", text, major, int(major), keyword=marked)
    for _ in range(2):
        mark = c.i
        more = None
        if c.peek() == ".":
            c.i += 1
            more = c.digits(2)
        if more is None:
            c.i = mark
            break
        if h.minor is None:
            h.minor = int(more)
        else:
            h.sub = "." + more
    if c.peek() == "%" or c.peek().isdecimal():
        return None
    if (c.peek().isascii() and c.peek().isalpha()) or c.peek() in ('"', "“"):
        h.at = c.i
        return h
    return _ends(c, h, ".:" + DASHES)


_MARKS = {"letters": 2, "romans": 6, "digits": 2}


def clause(text: str) -> Head | None:
    """A bracketed marker: up to two letters, six signs of a numeral, or two digits."""
    c = Cursor(text, "\"'*•-")
    if c.peek() != "(":
        return None
    c.i += 1
    got = c.run(lambda x: x.isascii() and x.isalnum())
    if c.peek() != ")" or not got:
        return None
    alike = got.islower() or got.isupper()
    numeral_like = alike and all(x in "IVXL" for x in got.upper())
    most = _MARKS["digits"] if got.isdecimal() else _MARKS["romans"] if numeral_like else _MARKS["letters"]
    if len(got) > most or not (got.isdecimal() or (alike and got.isalpha())):
        return None
    c.i += 1
    mark = c.i
    blank = c.skip()
    nxt = c.peek()
    if nxt and not blank and not (nxt.isascii() and nxt.isalpha()) and nxt not in "\"“'$([":
        return None
    return Head("clause", text, got, None, after=text[mark : c.i], at=c.i)
