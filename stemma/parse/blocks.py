"""Payload to blocks: plain text by lines, HTML by a token scan with a style stack."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Marks of plain-text documents and element names of HTML ones.
PAGE_LINE = re.compile(r"^\s*<PAGE>\s*(\d+)?\s*$", re.I)
TABLE_LINE = re.compile(r"^\s*<(/?)TABLE>", re.I)
MARK_LINE = re.compile(r"^\s*<(CAPTION|/?FN|S|C)>\s*$", re.I)
RULE_LINE = re.compile(r"^\s*[-=_]{3,}\s*$")
HEADING_LINE = re.compile(r"^\s{0,40}(?:(?:PART\s+(?:I{1,3}|IV|[1-4])\b|ITEMS?\s*\d{1,2}\s*[A-Ca-c]?\b)(?!\d)|ARTICLE\s+[IVXL\d]+|SECTION\s+\d+\.\d+|\d{1,2}\.\d{1,2}\s)", re.I)
BLOCK_TAGS = set("address article aside blockquote body center dd div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
SKIP_TAGS = {"script", "style", "head", "title", "ix:header", "textarea"}
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "area", "col", "base"}
BACK_LINK = re.compile(r"^\s*(?:back to\s+|return to\s+)?table of contents\s*$", re.I)


@dataclass
class Block:
    idx: int
    text: str
    raw_start: int
    raw_end: int
    norm_start: int = 0
    norm_end: int = 0
    kind: str = "para"
    lines: list[str] = field(default_factory=list)
    line_starts: list[int] = field(default_factory=list)
    line_ends: list[int] = field(default_factory=list)
    bold: bool = False
    underline: bool = False
    italic: bool = False
    center: bool = False
    caps_ratio: float = 0.0
    font_size_rel: float = 1.0
    indent: float = 0.0
    in_table: bool = False
    table_id: int = -1
    cell_col: int = -1
    is_page_break: bool = False
    preceding_comment: str = ""
    blank_before: bool = True
    blank_after: bool = True
    hrefs: list[str] = field(default_factory=list)
    anchors: list[str] = field(default_factory=list)
    row_text: str = ""
    row_bold: bool = False
    row_href: bool = False
    row_raw_end: int = 0
    runin: str = ""
    runin_end: int = -1
    size: float = 0.0


def caps_share(s: str) -> float:
    letters = [c for c in s if c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0.0


def _join(blocks: list[Block]) -> str:
    """Number the blocks, place them in the normalised text, and return that text."""
    at, parts = 0, []
    for i, b in enumerate(blocks):
        b.idx, b.norm_start, b.norm_end = i, at, at + len(b.text)
        parts.append(b.text)
        at = b.norm_end + 2
        b.caps_ratio = caps_share(b.text)
    return "\n\n".join(parts)


def text_blocks(payload: str, base: int) -> tuple[list[Block], str]:
    """Blocks of a plain-text payload: blank lines, tables, pages, rules and heading lines part them."""
    spans = [(m.start() + base, m[0].rstrip("\r")) for m in re.finditer(r"[^\n]+|(?<=\n)(?=\n)|^(?=\n)", payload)]
    long = sorted(len(s.rstrip()) for _, s in spans if len(s.strip()) >= 50)
    width = max(70, long[len(long) // 2] + 2) if long else 80
    out: list[Block] = []
    held: list[tuple[int, str]] = []
    state = {"table": False, "id": -1, "blank": True, "before": True}

    def close(blank_after: bool) -> None:
        if not held:
            return
        first = held[0][1]
        lead = len(first) - len(first.lstrip())
        kept = [s.strip() for _, s in held]
        starts = [p + len(s) - len(s.lstrip()) for p, s in held]
        ends = [p + len(s.rstrip()) for p, s in held]
        out.append(
            Block(
                0, "\n".join(" ".join(k.split()) for k in kept), starts[0], ends[-1], lines=kept, line_starts=starts, line_ends=ends, indent=float(lead),
                center=lead >= 4 and abs(lead - (width - len(kept[0])) / 2) <= 4, in_table=state["table"], table_id=state["id"] if state["table"] else -1,
                blank_before=state["before"], blank_after=blank_after,
            )
        )
        held.clear()

    for at, line in spans:
        page, table = PAGE_LINE.match(line), TABLE_LINE.match(line)
        if page or table or MARK_LINE.match(line) or not line.strip():
            close(True)
            state["blank"] = True
            if page:
                out.append(Block(0, "<PAGE>", at, at + 6, kind="page", is_page_break=True, lines=["<PAGE>"]))
            elif table:
                state["table"] = not table[1]
                state["id"] += not table[1]
            continue
        if RULE_LINE.match(line) and held:
            close(True)
            out[-1].underline = True
            state["blank"] = True
            continue
        if held and HEADING_LINE.match(line):
            close(False)
            state["blank"] = False
        if not held:
            state["before"] = state["blank"]
        held.append((at, line))
        state["blank"] = False
    close(True)
    return out, _join(out)


# ---------------------------------------------------------------- HTML

# A comment that isn't closed, a tag whose quotes aren't, a closing tag without a name: what follows them is text again.
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>"
    r"|<[!?][^<>]*>|</[^A-Za-z<>][^<>]*>|</>"
    r"|(?P<ref>&(?:#\s*\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?)|(?P<text>[^<&]+)|(?P<stray>[<&])",
    re.S,
)
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_SIZE = re.compile(r"font-size\s*:\s*([\d.]+)\s*(pt|px|em|%)", re.I)


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw or "")}


def size_points(value: float, unit: str) -> float:
    return {"pt": value, "px": value * 0.75, "em": value * 10, "%": value / 10}[unit.lower()]


def reference(s: str) -> str:
    """Character of a reference; the codes 128 to 159 mean the Windows characters, broken ones a blank."""
    body = s[1:].rstrip(";")
    if body.startswith("#"):
        digits = body[1:].strip()
        try:
            code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits)
        except ValueError:
            return " "
        if 128 <= code < 160:
            return bytes([code]).decode("cp1252", "replace")
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else " "
    got = html.unescape(s if s.endswith(";") else s + ";")
    return got if not got.startswith("&") or got == "&" else s


@dataclass
class _Style:
    tag: str
    bold: bool = False
    underline: bool = False
    italic: bool = False
    center: bool = False
    hidden: bool = False
    size: float = 0.0
    href: str = ""
    pre: bool = False


def without_back_links(runs: list[tuple]) -> list[tuple]:
    """Runs without a link back to the contents that hangs at the start or the end of other text."""
    told = [i for i, r in enumerate(runs) if r[0].strip()]
    links = [bool(runs[i][3].href) for i in told]
    if all(links) or not any(links):
        return runs
    first, last = links.index(False), len(links) - 1 - links[::-1].index(False)
    gone: set[int] = set()
    for group in (told[:first], told[last + 1 :]):
        if group and BACK_LINK.match(" ".join("".join(runs[i][0] for i in group).split())):
            gone.update(group)
    return [r for i, r in enumerate(runs) if i not in gone]


class _Builder:
    def __init__(self, base: int, image_text: bool) -> None:
        self.base, self.image_text = base, image_text
        self.out: list[Block] = []
        self.runs: list[tuple[str, int, int, _Style]] = []
        self.stack = [_Style("")]
        self.tables: list[dict] = []
        self.comment, self.anchors, self.page_break, self.breaks = "", [], False, 0
        self.next_table = 0

    @property
    def style(self) -> _Style:
        return self.stack[-1]

    def flush(self) -> None:
        runs, self.runs, self.breaks = without_back_links(self.runs), [], 0
        if not any(t.strip() for t, *_ in runs):
            return
        lines, starts, ends = [], [], []
        cur, a, z, space = "", -1, -1, False
        for t, s, e, _ in runs:
            scale = (e - s) / max(1, len(t))
            for piece in re.finditer(r"\n|[^\S\n]+|[^\s]+", t):
                if piece[0] == "\n":
                    if cur:
                        lines.append(cur), starts.append(a), ends.append(z)
                    cur, a, space = "", -1, False
                elif piece[0].isspace():
                    space = bool(cur)
                else:
                    p = s + int(piece.start() * scale)
                    cur += (" " if space else "") + piece[0]
                    a = p if a < 0 else a
                    z = s + int(piece.end() * scale)
                    space = False
        if cur:
            lines.append(cur), starts.append(a), ends.append(z)
        if len(lines) > 1 and BACK_LINK.match(lines[0]) and any(r[3].href for r in runs):
            lines, starts, ends = lines[1:], starts[1:], ends[1:]
        text = "\n".join(lines)
        n = sum(len(t.strip()) for t, *_ in runs) or 1
        share = lambda f: sum(len(t.strip()) for t, _, _, y in runs if f(y)) / n
        first = next(r[3] for r in runs if r[0].strip())
        brief = len(text) <= 120
        sizes: dict[float, int] = {}
        for t, _, _, y in runs:
            sizes[y.size] = sizes.get(y.size, 0) + len(t)
        tb = self.tables[-1] if self.tables else None
        b = Block(
            0, text, starts[0], ends[-1], lines=lines, line_starts=starts, line_ends=ends, bold=share(lambda y: y.bold) >= 0.5 or (first.bold and brief), underline=share(lambda y: y.underline) >= 0.5 or (first.underline and brief),
            italic=share(lambda y: y.italic) >= 0.5, center=first.center, in_table=tb is not None, table_id=tb["id"] if tb else -1, cell_col=tb["col"] if tb else -1, is_page_break=self.page_break, preceding_comment=self.comment[:200],
            anchors=self.anchors, hrefs=[y.href for _, _, _, y in runs if y.href], size=max(sizes, key=lambda k: sizes[k]),
        )
        if all(r[3].href for r in runs if r[0].strip()) and BACK_LINK.match(text):
            b.kind = "nav"
        self._runin(b, runs)
        if tb:
            tb["row"].append(b)
        self.comment, self.anchors, self.page_break = "", [], False
        self.out.append(b)

    def _runin(self, b: Block, runs) -> None:
        """A short bold or underlined lead before a stretch of plain prose."""
        lead, end = "", -1
        for t, _, e, y in runs:
            if not t.strip():
                lead += t
                continue
            if not (y.bold or y.underline):
                break
            lead, end = lead + t, e
        lead = " ".join(lead.split())
        if lead and end >= 0 and len(lead) <= 70 and len(lead.split()) <= 8 and len(b.text) - len(lead) >= 60:
            b.runin, b.runin_end = lead, end

    def finish_row(self) -> None:
        row = self.tables[-1]["row"]
        if len(row) > 1:
            f = row[0]
            f.row_text = " ".join(" ".join(b.text.split()) for b in row)
            f.row_bold, f.row_href, f.row_raw_end = any(b.bold for b in row), any(b.hrefs for b in row), row[-1].raw_end
        self.tables[-1]["row"] = []

    def open(self, name: str, raw: str) -> None:
        at = attributes(raw)
        css = at.get("style", "").lower()
        if name in BLOCK_TAGS:
            self.flush()
        if "page-break-before" in css or (name == "hr" and "page-break" in css):
            self.page_break = True
        for k in ("id", "name"):
            if at.get(k) and (name == "a" or k == "id"):
                self.anchors = [*self.anchors, at[k]]
        if name == "table":
            self.tables.append({"id": self.next_table, "col": -1, "row": []})
            self.next_table += 1
        elif name == "tr" and self.tables:
            self.finish_row()
            self.tables[-1]["col"] = -1
        elif name in ("td", "th") and self.tables:
            self.tables[-1]["col"] += 1
        elif name == "br":
            self.breaks += 1
            self.runs.append(("\n", 0, 0, self.style))
            if self.breaks >= 2:
                self.flush()
        if name in VOID_TAGS or raw.rstrip().endswith("/"):
            return
        s = self.style
        weight = re.search(r"font-weight\s*:\s*(\w+)", css)
        bold = s.bold or name in ("b", "strong", "h1", "h2", "h3", "h4", "h5", "h6")
        if weight:
            bold = weight[1] in ("bold", "bolder") or (weight[1].isdigit() and int(weight[1]) >= 600)
        size = _SIZE.search(css)
        self.stack.append(
            _Style(
                name, bold, s.underline or name == "u" or "underline" in css, s.italic or name in ("i", "em") or "font-style:italic" in css.replace(" ", ""),
                s.center or name == "center" or at.get("align", "").lower() == "center" or "text-align:center" in css.replace(" ", ""), s.hidden or name in SKIP_TAGS or "display:none" in css.replace(" ", ""),
                size_points(float(size[1]), size[2]) if size else s.size, at.get("href", "") if name == "a" and at.get("href", "").startswith("#") else s.href, s.pre or name == "pre",
            )
        )

    def close(self, name: str) -> None:
        if name in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == name:
                del self.stack[i:]
                break
        if name == "tr" and self.tables:
            self.finish_row()
        elif name == "table" and self.tables:
            self.finish_row()
            self.tables.pop()

    def data(self, t: str, a: int, z: int) -> None:
        if self.style.hidden and not self.image_text:
            return
        if t.strip():
            self.breaks = 0
        if self.style.pre or self.image_text:
            self.runs.append((re.sub(r" {2,}", "\n", t) if self.image_text and len(re.sub(r" {2,}", "\n", t)) == len(t) else t, a, z, self.style))
        else:
            self.runs.append((t.replace("\n", " ").replace("\r", " "), a, z, self.style))


def html_blocks(payload: str, base: int, image_text: bool = False) -> tuple[list[Block], str]:
    """Blocks of an HTML payload with exact offsets into the submission."""
    b = _Builder(base, image_text)
    for m in _TOKEN.finditer(payload):
        if m["text"] is not None or m["stray"] is not None:
            b.data(m[0], base + m.start(), base + m.end())
        elif m["ref"] is not None:
            b.data(reference(m[0]), base + m.start(), base + m.end())
        elif m["comment"] is not None:
            b.comment = m["comment"].strip()
        elif m["cdata"] is not None:
            b.data(m["cdata"], base + m.start("cdata"), base + m.end("cdata"))
        elif m["name"]:
            name = m["name"].lower()
            (b.close(name) if m["close"] else b.open(name, m["attrs"]))
    b.flush()
    sizes: dict[float, int] = {}
    for x in b.out:
        sizes[x.size] = sizes.get(x.size, 0) + len(x.text)
    usual = max(sizes, key=lambda k: sizes[k]) if sizes else 0.0
    for x in b.out:
        x.font_size_rel = x.size / usual if usual and x.size else 1.0
    return b.out, _join(b.out)
