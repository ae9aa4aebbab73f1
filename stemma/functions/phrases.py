"""Phrases of filings as plain word lists, and the tests built from them.

A phrase is written as it is printed; ``(s)`` after a word makes its plural
ending optional.  Blanks match any white space.  The patterns are plain enough
for Python, Spark and SQL alike.
"""

from __future__ import annotations

import regex

# The wording of cover pages, captions, signatures and instruments.
STATEMENTS = ["balance sheet(s)", "statement(s) of operations", "statement(s) of income", "statement(s) of cash flows", "statement(s) of cash flow"]
CAPTIONS = [
    "report of independent", "independent auditor report", "independent auditors report", "independent auditors' report", "consolidated balance sheet(s)", "consolidated statement(s) of", "index to financial statements",
    "index to consolidated financial statements", "selected financial data", "selected consolidated financial data", "notes to financial statements", "notes to the financial statements",
    "notes to consolidated financial statements", "notes to the consolidated financial statements", *STATEMENTS,
]
BACK_HEADS = ["signature(s)", "signature page(s)", "power of attorney", "exhibit(s) index", "index to exhibit(s)", "index of exhibit(s)", "list of exhibit(s)"]
WITNESS = ["in witness whereof"]
ATTACHED = ["exhibit", "annex", "schedule", "appendix"]
ACTS = ["section 13", "section 15", "the securities act", "the securities exchange act", "the exchange act"]
UNDER_ACT = ["pursuant to the requirements of", "in accordance with"]
CAUSED = ["duly caused", "has caused", "caused this report", "caused this annual report", "been signed", "signed on its behalf", "signed on our behalf"]
EXECUTED = ["have executed this", "have executed the", "duly executed and delivered"]
EXHIBIT_NOTES = ["incorporated by reference", "incorporated herein by reference", "filed herewith", "furnished herewith", "certification of", "certification pursuant", "certification required", "consent of independent", "rule 13a-14"]
RECITALS = ["whereas", "now therefore", "now, therefore", "in consideration of", "as follows:"]
INSTRUMENTS = "AGREEMENT GUARANTY GUARANTEE MORTGAGE INDENTURE NOTE PLEDGE LEASE WARRANT DEED CONTRACT DEBENTURE SUPPLEMENT AMENDMENT ASSIGNMENT CERTIFICATE INSTRUMENT PLAN".split()
PARTIES = "Borrower Lender Landlord Tenant Guarantor Trustee Issuer Seller Buyer Purchaser Company Executive Employee Agent Pledgor Licensor Licensee".split()
POINTING = [
    "of this report", "of this annual report", "of this quarterly report", "of this form 10-k", "of this form 10-q", "of form 10-k", "of form 10-q", "herein", "hereof", "regulation s-k", "regulation s-x",
    "incorporated by reference", "incorporated herein by reference", "see item", "refer to item", "is applicable", "is not applicable", "above", "below", "as discussed", "as described", "as defined",
]
BEING = ["is", "are", "was", "were", "has been", "have been", "shall be", "will be", "may be", "can be"]
PLACED = "incorporated included contained presented filed found located reported".split()
WHERE = "in on to under from by with herein hereto therein elsewhere as".split()
HEREBY = "hereby herein hereto therein thereto".split()
SUBJECTS = "the a an this these those such its our their his her which that all".split()
CONTENTS_HEADS = ["table of contents", "index", "contents", "form 10-k index", "form 10-k table of contents", "form 10-k annual report index", "form 10-k annual report table of contents"]
NOT_TITLES = ["item", "part", "table of contents", "index", "signature(s)", "exhibit"]
COMPANY_ENDS = "LLP LLC Inc Inc. Ltd Ltd. Corp Corp.".split()
MONTHS = "January February March April May June July August September October November December".split()


def _worded(p: str) -> str:
    words = []
    for w in p.split():
        plural = w.endswith("(s)")
        words.append(regex.escape(w[:-3] if plural else w) + ("s?" if plural else ""))
    return r"\s+".join(words)


def pattern(phrases: list[str]) -> str:
    """Alternatives of the phrases, longest first, between word borders; a border is looked at once for all that need it."""
    groups: dict[tuple[bool, bool], list[str]] = {}
    for p in sorted(phrases, key=lambda x: (-len(x), x)):
        groups.setdefault((p[0].isalnum(), p[-1].isalnum() or p.endswith("(s)")), []).append(_worded(p))
    out = [(r"\b" if begin else "") + "(?:" + "|".join(words) + ")" + (r"\b" if end else "") for (begin, end), words in groups.items()]
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


def holds(*lists: list[str], case: bool = False):
    """Test whether a text holds one of the phrases."""
    return regex.compile(pattern([p for x in lists for p in x]), 0 if case else regex.I)


def opens(*lists: list[str], then: str = ""):
    """Test whether a text opens with one of the phrases, followed by ``then``."""
    return regex.compile(rf"\s*{pattern([p for x in lists for p in x])}{then}", regex.I)


def opening(*lists: list[str]) -> str:
    """The same as a pattern for SQL."""
    return rf"(?i)^\s*{pattern([p for x in lists for p in x])}"


_UNDER = regex.compile(rf"{pattern(UNDER_ACT)}\s+{pattern(ACTS)}", regex.I)
_CAUSED, _EXECUTED = holds(CAUSED), holds(EXECUTED)
_CAUSED_TO = holds(["has caused", "have caused", "has duly caused", "have duly caused", "has hereunto caused", "have hereunto caused", "has hereunto duly caused", "have hereunto duly caused"])
_SIGNING = holds(["executed", "signed"])


def attests(text: str) -> bool:
    """A sentence that says under which act the report was signed."""
    return any(_CAUSED.search(text[m.end() :].split(".", 1)[0]) for m in _UNDER.finditer(text))


def signed(text: str) -> bool:
    """A signature line, a name with a title, or words of execution."""
    for line in text.split("\n"):
        t = line.strip()
        at = t.find("/s/")
        if at >= 0 and t[at + 3 :].strip():
            return True
        if t[:2].lower() == "by":
            rest = t[2:].lstrip().removeprefix(":").lstrip()
            if not rest or rest.startswith(("___", "/s/")):
                return True
    low = text.lower()
    name = low.find("name:")
    if name >= 0 and low.find("title:", name) > name:
        return True
    return bool(_EXECUTED.search(text)) or any(_SIGNING.search(text[m.end() :].split(".", 1)[0]) for m in _CAUSED_TO.finditer(text))


_WORD = regex.compile(r"[^\W_]+(?:['’][^\W_]+)?")


def refers_elsewhere(text: str) -> str | None:
    """What stands before words like "is incorporated in" in the first clause; None without such words."""
    clause = regex.split(r"[.;:!?]", text, maxsplit=1)[0]
    words = [(m[0].lower(), m.start()) for m in _WORD.finditer(clause)]
    low = [w for w, _ in words]
    for i in range(len(low)):
        for size in (2, 1):
            if " ".join(low[i : i + size]) not in BEING:
                continue
            k = i + size
            k += k < len(low) and low[k] in HEREBY
            if low[k : k + 2] == ["set", "forth"]:
                k += 1
            elif k >= len(low) or low[k] not in PLACED:
                continue
            if k + 1 < len(low) and low[k + 1] in WHERE:
                return clause[: words[i][1]]
    return None


def new_subject(gap: str) -> bool:
    """A gap in which another subject begins."""
    return any(m[0].lower() in SUBJECTS for m in _WORD.finditer(gap)) or any(x.lstrip()[:1].isupper() for x in gap.split("\n")[1:]) or bool(regex.search(r"[-_=–—]{3}", gap))


def continued(line: str) -> bool:
    """A heading that says it is carried on from before."""
    low = line.lower().replace("’", "'")
    if any(w in ("continued", "cont'd", "con't") for w in (m[0] for m in _WORD.finditer(low))):
        return True
    return any(x.strip(" .") in ("cont", "contd", "concl", "concluded") for x in regex.findall(r"\(([^()]*)\)", low))


def names_instrument(text: str) -> bool:
    return bool(_INSTRUMENT.search(text))


_INSTRUMENT = holds(INSTRUMENTS, case=True)
_CLAUSE_TURN = regex.compile(r"[a-z]\.\s+[A-Z]")
_DATE = regex.compile(rf"{pattern(MONTHS)}\s+\d{{1,2}},?\s+\d{{4}}")
_NO_TITLE, _LEADS_IN = opens(NOT_TITLES), holds(["as follows", "the following"])


def no_heading(t: str) -> bool:
    """A short line that is set like a heading but is a label, a figure, a date, a signature, or part of a sentence."""
    if _NO_TITLE.match(t) or t[-1:] in tuple(":;,") or _LEADS_IN.search(t) or _CLAUSE_TURN.search(t) or "/s/" in t:
        return True
    if any(t.endswith(x) and not t[: -len(x)][-1:].isalnum() for x in COMPANY_ENDS) or _DATE.search(t) or (t.startswith("(") and t.endswith(")")):
        return True
    return "$" in t or "%" in t or t[:1].isdigit() or all(c in "0123456789 .-–—()ivxIVX" for c in t) or "continued" in t.lower()
