"""Tables of contents: runs of candidates that stand close together and come again in the body."""

from __future__ import annotations

from dataclasses import dataclass

from stemma.functions.phrases import CONTENTS_HEADS, opens
from stemma.parse.blocks import Block
from stemma.parse.headings import BARE_PAGE, LEADER, PAGE_AT_END, PROSE, Candidate

# How close members stand, how long runs are, and what makes a run a contents page.
HEAD = opens(CONTENTS_HEADS)
GAP_BLOCKS, GAP_CHARS, TABLE_TIMES, FURNITURE_TIMES = 4, 600, 4, 6
LEAST, STRONG = 4, 0.55
CONTRACT_LEAST, CONTRACT_SHARE, CONTRACT_SPREAD = 6, 0.6, 2.5


@dataclass
class Region:
    first: int
    last: int
    first_block: int
    last_block: int
    reason: str

    def holds(self, i: int) -> bool:
        return self.first <= i <= self.last


def _furniture(blocks: list[Block], a: int, z: int) -> bool:
    between = blocks[a + 1 : z][:24]
    short = sum(len(b.text) <= 60 or bool(BARE_PAGE.match(b.text) or LEADER.search(b.text) or PAGE_AT_END.search(b.text)) for b in between)
    return bool(between) and short >= 0.6 * len(between)


def _runs(blocks: list[Block], cands: list[Candidate], kinds: tuple[str, ...]) -> list[list[int]]:
    """Candidates in rising order with small gaps; one that falls back ends the run, one odd member doesn't."""
    out: list[list[int]] = []
    run: list[int] = []
    ids = [i for i, c in enumerate(cands) if c.kind in kinds]
    for n, i in enumerate(ids):
        c = cands[i]
        if run:
            p = cands[run[-1]]
            table = blocks[c.block].in_table and blocks[p.block].in_table
            near = c.block - p.block <= GAP_BLOCKS * (TABLE_TIMES if table else 1) and c.start - p.end <= GAP_CHARS * (FURNITURE_TIMES if _furniture(blocks, p.block, c.block) else 1)
            peak = max((cands[j].order for j in run if cands[j].kind == c.kind), default=-1)
            falls = c.order <= peak and c.kind != "clause"
            nxt = cands[ids[n + 1]] if n + 1 < len(ids) else None
            blip = falls and nxt is not None and nxt.kind == c.kind and nxt.order > peak and nxt.block - c.block <= GAP_BLOCKS
            if not near or (falls and not blip):
                out.append(run)
                run = []
        run.append(i)
    return [*out, run] if run else out


def _reason(run: list[int], blocks: list[Block], cands: list[Candidate], norm_len: int) -> str | None:
    own = [cands[i] for i in run]
    later: dict[tuple[str, str], list[Candidate]] = {}
    for c in cands[run[-1] + 1 :]:
        if c.score >= STRONG and not c.has("rej.continued"):
            later.setdefault((c.kind, c.label), []).append(c)
    n = len(own)
    dup = sum((c.kind, c.label) in later for c in own) / n
    leader = sum(c.has("toc.leader_or_pageno") for c in own) / n
    hinted = sum(c.hint for c in own) / n
    word = any(HEAD.match(b.text) for b in blocks[max(0, own[0].block - 8) : own[0].block + 1])
    copies = [later[c.kind, c.label] for c in own if (c.kind, c.label) in later]
    flat = [x for xs in copies for x in xs]
    # Copies that are themselves an index at the back, or weaker than the members, prove nothing.
    tail = bool(flat) and sum(x.norm > 0.7 * norm_len for x in flat) >= 0.6 * len(flat) and sum(x.has("toc.leader_or_pageno") for x in flat) * 2 >= len(flat)
    better = bool(copies) and sum(c.score - max(x.score for x in later[c.kind, c.label]) >= 0.125 for c in own if (c.kind, c.label) in later) >= 0.6 * len(copies)
    if leader >= 0.5:
        return "toc.hints"
    if hinted >= 0.5 and (word or leader >= 0.2 or dup >= 0.6):
        return "toc.hints"
    if dup >= 0.6 and (word or hinted >= 0.2 or n >= 8) and not (tail or better):
        return "toc.duplicated_later"
    if dup >= 0.75 and all(c.kind == "part" for c in own):
        return "toc.parts_only"
    if word and dup >= 0.4:
        return "toc.header_word"
    return None


def _contract_regions(blocks: list[Block], cands: list[Candidate]) -> list[Region]:
    runs: list[list[int]] = []
    run: list[int] = []
    for i, c in enumerate(cands):
        if c.kind not in ("section", "article"):
            continue
        if run:
            p = cands[run[-1]]
            prose = any(len(b.text) > 200 and PROSE.search(b.text) for b in blocks[p.block + 1 : c.block][:40])
            falls = any(cands[j].kind == c.kind and cands[j].order >= c.order for j in run)
            if c.start - p.start > GAP_CHARS or prose or falls:
                runs.append(run)
                run = []
        run.append(i)
    out = []
    for r in [*runs, run]:
        sections = [cands[i] for i in r if cands[i].kind == "section"]
        if len(sections) < CONTRACT_LEAST:
            continue
        again = {c.label: c.start for c in cands[r[-1] + 1 :] if c.kind == "section"}
        hit = [again[c.label] for c in sections if c.label in again]
        spread = (max(hit) - min(hit)) if len(hit) > 1 else 0
        if len(hit) >= CONTRACT_SHARE * len(sections) and spread >= CONTRACT_SPREAD * max(1, sections[-1].start - sections[0].start):
            out.append(Region(r[0], r[-1], cands[r[0]].block, cands[r[-1]].block, "toc.dup_later_contract"))
    return out


def detect(blocks: list[Block], cands: list[Candidate], norm_len: int, contract: bool) -> list[Region]:
    kinds = ("article", "section") if contract else ("part", "item")
    out = _contract_regions(blocks, cands) if contract else []
    for run in _runs(blocks, cands, kinds):
        if len(run) < LEAST or any(r.holds(run[0]) or r.holds(run[-1]) for r in out):
            continue
        reason = _reason(run, blocks, cands, norm_len)
        if reason:
            out.append(Region(run[0], run[-1], cands[run[0]].block, cands[run[-1]].block, reason))
    out.sort(key=lambda r: r.first)
    return _veto(out, cands)


def _veto(regions: list[Region], cands: list[Candidate]) -> list[Region]:
    """A region that holds two strong only copies isn't a contents page; its members are marked."""
    inside = {i for r in regions for i in range(r.first, r.last + 1)}
    outside = {(c.kind, c.label) for i, c in enumerate(cands) if i not in inside}
    kept = []
    for r in regions:
        own = cands[r.first : r.last + 1]
        sole = [c for c in own if c.score >= 0.6 and not c.has("toc.leader_or_pageno") and (c.kind, c.label) not in outside]
        if len(sole) >= 2 and r.reason != "toc.dup_later_contract":
            for c in own:
                c.rules.append("toc.vetoed_region")
        else:
            for c in own:
                c.rules.append(r.reason)
            kept.append(r)
    return kept


INDEX_ITEMS = 4


def _vetoed_stretches(cands: list[Candidate]) -> list[tuple[list[Candidate], list[list[int]]]]:
    """Stretches of neighbours in vetoed regions, each with the keys of its items cut into rising runs."""
    out: list[tuple[list[Candidate], list[list[int]]]] = []
    before = False
    for c in cands:
        now = c.has("toc.vetoed_region")
        if now and not before:
            out.append(([], []))
        if now:
            members, rising = out[-1]
            members.append(c)
            if c.kind == "item":
                if rising and rising[-1][-1] < c.order:
                    rising[-1].append(c.order)
                else:
                    rising.append([c.order])
        before = now
    return [x for x in out if sum(map(len, x[1])) >= INDEX_ITEMS]


def index_members(cands: list[Candidate]) -> set[int]:
    """ids of the candidates in a vetoed stretch whose items rise from end to end: an index after all."""
    return {id(c) for members, rising in _vetoed_stretches(cands) if len(rising) == 1 for c in members}


def vetoed_rows(cands: list[Candidate]) -> None:
    """Rows of a vetoed index that come again later with their printed title.

    The items of the index rise throughout; where parts aren't known yet (10-Q) they may begin anew, each time for
    two items at least.
    """
    later: dict[tuple[str, str], int] = {}
    for c in cands:
        if c.has("gram.item.title_match"):
            later[c.kind, c.label] = max(c.start, later.get((c.kind, c.label), -1))
    for members, rising in _vetoed_stretches(cands):
        open_parts = any(c.kind == "item" and "?." in c.label for c in members)
        if len(rising) == 1 or (open_parts and all(len(r) >= 2 for r in rising)):
            for c in members:
                if later.get((c.kind, c.label), -1) > c.start:
                    c.rules += ["rej.vetoed_index_row", "toc.vetoed_index"]
