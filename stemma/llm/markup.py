"""Markup residue converted to clean text that keeps its structure.

A text is first put into one form: wiki, LaTeX and Markdown marks become tree
nodes just as HTML tags do, whole or cut off.  Paragraph-like nodes then score
points for their length and commas and pass them to their ancestors, discounted
by link density; the best container and those of its siblings that belong to
it are kept, menus and link lists beside it are not.  Rendering keeps headings
(``#``), lists (``-``), code (fences), tables (``|``), and formulas (``$``).

Signs used as plain signs (comparison, currency, footnote stars, rules,
numbering, brackets, ampersands) are left alone.  Null stays null, the empty
text empty.  A text that would be left empty keeps all it holds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by what they do.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p page pre section summary table tbody td tfoot th thead tr ul document text sub-heading".split())
INLINE = set("a abbr acronym b big br button cite code del dfn em font i img input ins kbd label link map mark meta object option q ref s samp script select small span strike strong style sub sup textarea title tt u var nobr base area col colgroup".split())
VOID = set("br hr img input meta link base area col page".split())
HIDDEN = set("script style".split())
NAMES = BLOCK | INLINE

_NAMES_ALT = "|".join(sorted(NAMES, key=lambda x: (-len(x), x)))
_ATTR = r"""(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"<>]*"?|'[^'<>]*'?|[^\s<>"']+))?)"""
COMMENT = re.compile(r"<!--.*?(?:-->|$)|<![A-Za-z][^<>]*>?|<\?[^<>]*>?", re.S)
TAG = re.compile(
    rf"<(/?)([A-Za-z][\w:.-]*)({_ATTR}*)\s*/?>"  # whole
    rf"|<(/)([A-Za-z][\w:.-]*)(?:\s*$)?"  # closing, cut
    rf"|<()({_NAMES_ALT}|ix:\w+)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>\"']+))+|\s*$|(?=\s|<))",  # opening, cut
    re.I,
)
HEAD_CUT = re.compile(r"""^\s*(?:[^<>\s][^<>\n]*?["']\s*/?>|[\w-]+\s*[=:]\s*[^\s<>"']+\s*/?>|/?(?:%s)\s*/?>|[^<>\n]*-->)""" % _NAMES_ALT, re.I)
TAIL_CUT = re.compile(r"<(?:/|!-{0,2}|[A-Za-z]{1,10})?$")
ENTITY = re.compile(r"&(?:#\d{2,7};?|#[xX][0-9A-Fa-f]{2,6};?|[A-Za-z][A-Za-z0-9]{1,31};|(?:nbsp|amp|lt|gt|quot|ldquo|rdquo|mdash|ndash)(?![\w=]))")
ENTITY_CUT = re.compile(r"&(?:#\d{1,5}|#[xX][0-9A-Fa-f]{1,5}|nbs?|am?p|quo?t?|[lr][ds]quo?|[mn]das?h?)$")

FENCE = re.compile(r"^\s{0,3}(?:```|~~~)\s*[\w+-]*\s*$", re.M)
MD_HEADING = re.compile(r"^\s{0,3}(#{1,6})[ \t]+(?=\S)(.*?)(?:\s+#+)?\s*$")
MD_QUOTE = re.compile(r"^\s{0,3}(?:>[ \t]?)+")
MD_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{2,}:?\s*\|\s*$")
MD_ROW = re.compile(r"^\s*\|.*\|\s*$")
MD_TASK = re.compile(r"^\s*[-*+]\s+\[[ xX]\]\s")


class _pairs:
    """Opening and closing runs of one sign around text of one line, matched in one pass."""

    def __init__(self, run: str, sign: str, at_words: bool) -> None:
        self.sign, self.at_words = sign, at_words
        self.token = re.compile(rf"(?<!{re.escape(sign)}){run}(?!{re.escape(sign)})|\n")

    def sub(self, one, s: str) -> str:
        if self.sign * 2 not in s:
            return s
        out, last, opened = [], 0, None
        for m in self.token.finditer(s):
            if m[0] == "\n":
                opened = None
                continue
            before, after = s[m.start() - 1 : m.start()], s[m.end() : m.end() + 1]
            word = self.at_words
            if opened is not None and before and not before.isspace() and not (word and (after.isalnum() or after == "_")):
                out += [s[last : opened.start()], one(_Inner(s[opened.end() : m.start()]))]
                last, opened = m.end(), None
            elif opened is None and after and not after.isspace() and not (word and (before.isalnum() or before == "_")):
                opened = m
        return "".join(out) + s[last:] if out else s


class _Inner:
    def __init__(self, text: str) -> None:
        self.text = text

    def groups(self) -> tuple[str]:
        return (self.text,)


INLINE_MARKS = [
    ("link", re.compile(r"!?\[([^\[\]\n]*)\]\(\s*<?[^()\s<>]*[./#][^()\s]*(?:\s+\"[^\"]*\")?\)")),
    ("link", re.compile(r"!?\[([^\[\]\n]*)\]\((?:https?:|#|[\w./-]+\.(?:htm|pdf))[^()\s]*$")),
    ("link", re.compile(r"()\]\([\w./#:-]+\.(?:html?|pdf)[^()\s]*\)")),
    ("note", re.compile(r"\[\^[\w-]+\]:?")),
    ("code", re.compile(r"`+([^`\n]+)`+")),
    ("code", re.compile(r"`()")),
    ("bold", _pairs(r"\*{2,3}", "*", True)),
    ("bold", _pairs(r"__", "_", True)),
    ("bold", re.compile(r"(?<![\w*])\*\*(?=[\w(“\"$§])()")),
    ("bold", re.compile(r"(?<=[\w.,;:)”\"])\*\*(?=[\s,.;:]|$)()(?=.*\w)")),
    ("bold", re.compile(r"(?<![\w_])__(?=[A-Za-z(“\"$§])()")),
    ("italic", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])")),
    ("italic", re.compile(r"(?<![\w_])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w_])")),
    ("strike", re.compile(r"~~([^~\n]+)~~")),
    ("wiki link", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)(?:\]\]|$)")),
    ("wiki link", re.compile(r"\]\]()")),
    ("wiki link", re.compile(r"\[(?:https?|ftp)://\S+\s*([^\]\n]*)(?:\]|$)")),
    ("wiki note", re.compile(r"\{\{[^{}]*(?:\}\}|$)()")),
    ("wiki note", re.compile(r"^[^{}\n]*\}\}()")),
    ("wiki bold", _pairs(r"'{2,5}", "'", False)),
    ("wiki bold", re.compile(r"'{2,5}()(?=\S)|(?<=\S)'{2,5}()")),
]
WIKI_HEADING = re.compile(r"^\s*(={2,6})\s*([^=\s](?:[^\n]*?[^=\s])?)\s*(={1,6})\s*$|^\s*(={2,6})\s+([A-Za-z(][^=\n]*)$|^([A-Za-z(][^=\n]*?)\s*={2,6}\s*$")
WIKI_TABLE = re.compile(r"^\s*(?:\{\|[^\n]*|\|\}|\|-+|\|\+[^\n]*)\s*$")
TEX_MATH = re.compile(r"\$\$?[^$\n]*[\\^_{][^$\n]*\$\$?|\\\(.+?(?:\\\)|$)|\\\[.+?(?:\\\]|$)", re.S)
TEX_ENV = re.compile(r"\\(begin|end)\s*\{?\s*(\w*\*?)\s*\}?(?:\[[^\]]*\])?(?:\{[lcr|p.\d\w{}]*\})?")
TEX_BRACE = re.compile(r"~?\\([A-Za-z]{2,})\*?\s*(?:\[[^\]\n]*\])?\{|[{}]")
TEX_WORD = re.compile(r"\\(item|hline|par|noindent|centering|newline|newpage|clearpage|ldots|dots|quad|qquad|textbf|textit|emph|section|subsection|subsubsection|footnote|label|ref|cite|frac|sum|alpha|beta|times|cdot|leq|geq|infty|S|&|%|\$|#|_)(?![A-Za-z])\*?\s*")
TEX_HEADINGS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
TEX_DROPPED = {"label", "ref", "cite", "vspace", "hspace", "pagestyle", "usepackage", "documentclass", "includegraphics", "footnotemark"}

#: A text without any of these signs holds no markup.
MAY_HOLD = r"[<>&\\{}\[\]`#*_=|~$]|''"


class Node:
    """Element of the tree; a ``mark`` is an empty leaf that stands where a sign of markup stood."""

    __slots__ = ("name", "parts", "parent", "attrs", "closed", "score", "size", "commas", "links", "own", "own_commas", "marks")

    def __init__(self, name: str, parent: Node | None, attrs: str = "") -> None:
        self.name, self.parent, self.attrs, self.parts, self.score, self.closed = name, parent, attrs, [], 0.0, False

    def add(self, name: str, attrs: str = "") -> Node:
        n = Node(name, self, attrs)
        self.parts.append(n)
        return n

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(p for p in reversed(n.parts) if not isinstance(p, str))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p)
            else:
                stack.extend(reversed(p.parts))
        return "".join(out)

    def hidden(self) -> bool:
        """Scripts and styles that are whole; what a cut one hides can't be told."""
        return self.name in HIDDEN and self.closed


def _unescape(s: str) -> tuple[str, bool]:
    """(text with one layer of character references resolved, whether there were any)."""
    met = False

    def one(m: re.Match) -> str:
        nonlocal met
        name = m[0][1:]
        if not name.startswith("#") and (name if name.endswith(";") else name + ";") not in html5:
            return m[0]
        met = True
        return html.unescape(m[0] if m[0].endswith(";") else m[0] + ";")

    if "&" not in s:
        return s, False
    s = ENTITY.sub(one, s)
    cut = ENTITY_CUT.search(s)
    if cut and cut.start() > 0:
        met = True
        s = s[: cut.start()]
    return s, met


class Parser:
    """Builds the tree of one text; nested markup of any depth is kept on explicit stacks."""

    def __init__(self, text: str) -> None:
        self.kinds: set[str] = set()
        self.root = self.at = Node("root", None)
        self.open: Counter[str] = Counter()
        self._html(text)

    def _mark(self, kind: str) -> None:
        self.kinds.add(kind)
        self.at.add("mark", kind)

    # HTML, the outermost layer

    def _html(self, text: str) -> None:
        work: list = [("html", text)]
        while work:
            what, x = work.pop()
            if what == "tag":
                self._tag(x)
            elif what == "html":
                work.extend(reversed(self._pieces(x)))
            elif x:
                # Escaped markup is parsed once its references are resolved.
                s, met = _unescape(x)
                if met:
                    self._mark("entity")
                if met and TAG.search(s):
                    work.append(("html", s))
                elif self.at.name in ("pre", "code", *HIDDEN):
                    self.at.parts.append(s)
                elif s:
                    self._lines(s)

    def _pieces(self, s: str) -> list:
        m = HEAD_CUT.match(s)
        if m and not COMMENT.match(s) and not TAG.match(s):
            self._mark("html")
            s = s[m.end() :]
        s, n = COMMENT.subn("", s)
        if n:
            self._mark("html")
        m = TAIL_CUT.search(s)
        if m and m.start() > 0 and len(m[0]) > 1:
            self._mark("html")
            s = s[: m.start()]
        out, last = [], 0
        for m in TAG.finditer(s):
            out += [("text", s[last : m.start()]), ("tag", m)]
            last = m.end()
        return [*out, ("text", s[last:])]

    def _tag(self, m: re.Match) -> None:
        self._mark("html")
        name = (m[2] or m[5] or m[7]).lower()
        if m[1] or m[4]:
            self._close(name)
            return
        if name in ("p", "li", "td", "th", "tr") and self.at.name in ("p", "li", "td", "th", "tr"):
            self._close_open(name)
        n = self.at.add(name, m[3] or m[8] or "")
        if name not in VOID and not m[0].endswith("/>"):
            self.open[name] += 1
            self.at = n

    def _leave(self) -> None:
        self.open[self.at.name] -= 1
        self.at = self.at.parent

    def _close(self, name: str) -> None:
        if not self.open[name]:
            if name in BLOCK:
                self.at.add("gap")
            return
        while self.at.name != name:
            self._leave()
        self.at.closed = True
        self._leave()

    def _close_open(self, name: str) -> None:
        group = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}[name]
        while self.at.name in group:
            self._leave()

    # Markdown, wiki and LaTeX inside text

    def _lines(self, s: str) -> None:
        lines = s.split("\n")
        code: Node | None = None
        quoted = sum(1 for x in lines if MD_QUOTE.match(x))
        if quoted and (quoted == len(lines) or len(lines) > 1 or re.match(r"\s{0,3}>\s*[^\W\d]", s) or re.match(r"\s{0,3}>\s*[(*_#`\[]", s)):
            self._mark("markdown")
            lines = [MD_QUOTE.sub("", x) for x in lines]
        for k, line in enumerate(lines):
            tail = "\n" if k < len(lines) - 1 else ""
            if FENCE.match(line):
                self._mark("markdown")
                code = self.at.add("pre") if code is None else None
                continue
            if code is not None:
                code.parts.append(line + tail)
                continue
            m = MD_HEADING.match(line)
            if m:
                self._mark("markdown")
                self._inline(self.at.add(f"h{len(m[1])}"), m[2])
                continue
            m = WIKI_HEADING.match(line)
            if m:
                self._mark("wiki")
                self._inline(self.at.add(f"h{min(6, len(m[1] or m[4] or '=='))}"), m[2] or m[5] or m[6])
                continue
            if MD_RULE.match(line):
                self._mark("markdown")
                continue
            if WIKI_TABLE.match(line):
                self._mark("wiki")
                continue
            if MD_ROW.match(line) or ((line.lstrip().startswith("|") or line.lstrip().startswith("!")) and ("||" in line or "!!" in line or "wiki" in self.kinds)):
                self._mark("markdown" if MD_ROW.match(line) else "wiki")
                row = self.at.add("tr")
                for cell in re.split(r"\|\||!!|\|", line.strip().strip("|!")):
                    self._inline(row.add("td"), cell.strip())
                continue
            if MD_TASK.match(line):
                self._mark("markdown")
                line = MD_TASK.sub("- ", line)
            self._inline(self.at, line)
            if tail:
                self.at.parts.append(tail)

    def _inline(self, to: Node, s: str) -> None:
        last = 0
        for m in TEX_MATH.finditer(s):
            if m.start() > last:
                to.parts.append(self._marks(s[last : m.start()]))
            self._mark("latex")
            to.parts.append(m[0])
            last = m.end()
        if last < len(s):
            to.parts.append(self._marks(s[last:]))

    def _marks(self, s: str) -> str:
        if "\\" in s:
            s = self._tex(s)
        for kind, pattern in INLINE_MARKS:

            def one(m, kind: str = kind) -> str:
                self._mark("wiki" if kind.startswith("wiki") else "markdown")
                return next((g for g in m.groups() if g), "")

            s = pattern.sub(one, s)
        return s

    def _tex(self, s: str) -> str:
        def env(m: re.Match) -> str:
            self._mark("latex")
            return "\n"

        def word(m: re.Match) -> str:
            self._mark("latex")
            w = m[1]
            if w == "item":
                return "\n- "
            return {"ldots": "...", "dots": "...", "S": "§"}.get(w, w if len(w) == 1 else " ")

        s = TEX_ENV.sub(env, s)
        # Commands and plain braces, nested to any depth: (command or None, what came before it).
        stack: list[tuple[str | None, list[str]]] = []
        out: list[str] = []
        last = 0
        for m in TEX_BRACE.finditer(s):
            out.append(s[last : m.start()])
            last = m.end()
            if m[0] != "}":
                stack.append((m[1], out))
                out = []
            elif stack:
                name, before = stack.pop()
                inner = "".join(out)
                before.append(self._command(name, inner) if name else "{" + inner + "}")
                out = before
            else:
                out.append("}")
        out.append(s[last:])
        while stack:  # cut off
            name, before = stack.pop()
            out = ["".join(before), self._command(name, "".join(out)) if name else "{" + "".join(out)]
        return TEX_WORD.sub(word, "".join(out))

    def _command(self, name: str, inner: str) -> str:
        self._mark("latex")
        if name in TEX_HEADINGS:
            return f"\n{'#' * TEX_HEADINGS[name]} {inner}\n"
        if name in TEX_DROPPED:
            return ""
        return f" ({inner})" if name == "footnote" else inner


# ---------------------------------------------------------------- scoring

_SCORED = ("p", "pre", "td", "li", "blockquote", "root", "div")
_LISTS = ("ul", "ol", "dl", "table", "tbody", "tr", "thead", "tfoot")


def measure(root: Node) -> None:
    """Length, commas, link text and kinds of markup of every node, in one pass from the leaves up."""
    for n in reversed(list(root.walk())):
        n.size = n.commas = n.links = n.own = n.own_commas = 0
        n.marks = {n.attrs} if n.name == "mark" else set()
        for p in n.parts:
            if isinstance(p, str):
                size, commas, inline = len(p.strip()), p.count(","), True
            else:
                size, commas, inline = p.size, p.commas, p.name not in BLOCK
                n.links += p.links
                if p.marks:
                    n.marks |= p.marks
            n.size += size
            n.commas += commas
            if inline:
                n.own += size
                n.own_commas += commas
        if n.name == "a":
            n.links = n.size


def link_density(n: Node) -> float:
    return min(1.0, n.links / n.size) if n.size else 0.0


def score_tree(root: Node) -> Node:
    """Pass points of paragraphs upwards; the best container is returned."""
    nodes = list(root.walk())
    for n in nodes:
        if n.name not in _SCORED or n.own < 25:
            continue
        points = 1 + n.own_commas + min(n.own // 100, 3)
        up, share = (n if n.name in ("div", "root") else n.parent), 1.0
        for _ in range(4):
            if up is None:
                break
            up.score += points * share
            share /= 2
            up = up.parent
    best, top = root, -1.0
    for n in nodes:
        if n.score:
            n.score *= 1 - link_density(n)
        if n.score > top and n.name not in INLINE and n.name not in _LISTS and n.name != "mark":
            best, top = n, n.score
    return best


def prune(best: Node) -> None:
    """Beside the best container only siblings stay that belong to it: not menus, not lists of links."""
    while best.parent is not None:
        kept = []
        for p in best.parent.parts:
            if isinstance(p, str) or p is best:
                kept.append(p)
                continue
            if p.hidden() or p.name in ("nav", "form", "button"):
                continue
            density = link_density(p)
            if p.name not in BLOCK or density < 0.25 or (p.size < 80 and density == 0) or p.score >= best.score * 0.2:
                kept.append(p)
        best.parent.parts = kept
        best = best.parent


# ---------------------------------------------------------------- rendering


def _flat(s: str) -> str:
    return re.sub(r"[ \t\r\f\v\xa0]+", " ", s)


def render(root: Node) -> str:
    """Text of a tree. Within a table cell everything stands on one line."""
    out: list[str] = []
    cells = 0

    def put(s: str) -> None:
        out.append(re.sub(r"\s*\n\s*", " ", s) if cells else s)

    stack: list = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            put(_flat(n))
            continue
        if isinstance(n, tuple):
            cells += n[1]
            put(n[0])
            continue
        name = n.name
        if name == "mark" or n.hidden():
            continue
        if name == "br":
            put("\n")
        elif name in ("hr", "page", "gap"):
            put("\n\n")
        elif name == "pre":
            put(f"\n\n```\n{n.text().strip(chr(10))}\n```\n\n")
        elif re.fullmatch(r"h[1-6]", name):
            put(f"\n\n{'#' * int(name[1])} {_flat(n.text()).strip()}\n\n")
        elif name == "tr" and any(not isinstance(p, str) and p.name in ("td", "th") for p in n.parts):
            put("\n")
            stack.append(("\n", 0))
            kids = [p for p in n.parts if not isinstance(p, str) and p.name in ("td", "th")]
            for i in reversed(range(len(kids))):
                stack.append((" | " if i < len(kids) - 1 else "", -1))
                stack.extend(reversed(kids[i].parts))
                stack.append(("", 1))
        else:
            before = "\n- " if name == "li" else " " if name in ("td", "th") else "\n\n" if name in BLOCK else ""
            after = "" if name == "li" else " " if name in ("td", "th") else before
            put(before)
            stack.append((after, 0))
            stack.extend(reversed(n.parts))
    s = "".join(out)
    s = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\S) {2,}(?=\| )", " ", s))
    return re.sub(r"\n{3,}", "\n\n", s).strip()


_SIGNS = re.compile(MAY_HOLD)


def clean(text: str | None) -> tuple[str | None, str]:
    """(clean text, kinds of markup found, '' if none).

    The kinds are those of the marks in the measured tree.
    """
    if not text or not _SIGNS.search(text):
        return text, ""
    tree = Parser(text).root
    if len(tree.parts) == 1 and isinstance(tree.parts[0], str):
        return text, ""
    measure(tree)
    if not tree.marks:
        return text, ""
    kinds = " ".join(sorted(tree.marks))
    prune(score_tree(tree))
    done = render(tree)
    if not done:  # nothing scored: all that the text holds
        done = render(Parser(text).root) or Parser(text).root.text().strip()
    return done, kinds


def _clean_batches(keep: list[str], only_marked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            rows = [clean(t) for t in texts]
            at = [i for i, r in enumerate(rows) if r[1] or not only_marked]
            take = pa.array(at, pa.int64())
            cols = [b.column(b.schema.get_field_index(k)).take(take) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([rows[i][0] for i in at], pa.string()), pa.array([rows[i][1] for i in at], pa.string())], names=[*keep, "clean_text", "markup"])

    return run


def clean_texts(df: DataFrame, keep: list[str], only_marked: bool = False) -> DataFrame:
    """``keep`` columns, clean_text and markup (kinds found). With ``only_marked`` just texts with markup."""
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep], "clean_text string", "markup string"])
    some = df.select(*keep, "text")
    if only_marked:
        some = some.where(F.col("text").rlike(MAY_HOLD))
    return some.mapInArrow(_clean_batches(keep, only_marked), schema)
