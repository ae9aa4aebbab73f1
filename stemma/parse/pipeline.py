"""One document to rows of the three output tables, and the same over a DataFrame of submissions.

``parse_submissions`` is a narrow map: each submission row holds all its text, so
documents are split, profiled and parsed where they are read, without a shuffle;
a large group of filings of one filer needs no salting.  A document that can't be
parsed becomes a row with its error, never a failed task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from stemma.operators import profile as P
from stemma.parse import contents, headings, outline, rows, trees
from stemma.parse.blocks import html_blocks, text_blocks
from stemma.parse.grammars import GRAMMARS
from stemma.sources import sgml as S

PARSER_VERSION, NORMALIZER_VERSION = "0.1.0", "0.1.0"

_S, _I, _L, _B, _F = pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.float32()
NODES = pa.schema(
    [("accession_number", _S), ("cik", _S), ("sequence", _I), ("doc_type", _S), ("grammar", _S), ("node_id", _I), ("parent_id", _I), ("depth", pa.int8()), ("level_kind", _S), ("label_canon", _S), ("label_raw", _S), ("title", _S),
     ("raw_start", _L), ("raw_end", _L), ("head_raw_start", _L), ("head_raw_end", _L), ("norm_start", _L), ("norm_end", _L), ("order_key", _I), ("confidence", _F), ("rule_ids", pa.list_(_S)), ("path", pa.list_(pa.int16())), ("path_str", _S),
     ("meta", pa.int8()), ("segment", pa.int8()), ("item_incorporated_by_reference", _B), ("ibr_target", _S), ("ibr_target_in_submission", _B), ("item_cross_reference", _B), ("satisfies_item", _S), ("covers_items", pa.list_(_S)),
     ("profile_era", _S), ("profile_publisher", _S), ("agent_cik", _S), ("parser_version", _S), ("normalizer_version", _S)]
)
DOCUMENTS = pa.schema(
    [("accession_number", _S), ("cik", _S), ("sequence", _I), ("doc_type", _S), ("grammar", _S), ("filed_year", _I), ("profile_era", _S), ("profile_publisher", _S), ("agent_cik", _S), ("signals", _S), ("n_blocks", _I), ("n_candidates", _I), ("n_nodes", _I),
     ("toc_found", _B), ("items_found", pa.list_(_S)), ("doc_raw_start", _L), ("doc_raw_end", _L), ("front_end", _L), ("back_start", _L), ("n_segments", _I), ("level_profile", _S), ("normalized_text", _S), ("parser_version", _S),
     ("normalizer_version", _S), ("error", _S), ("input_sha256", _S), ("input_bytes", _L), ("manifest_cik", _S)]
)
REJECTED = pa.schema([("accession_number", _S), ("sequence", _I), ("block_idx", _I), ("kind", _S), ("label_canon", _S), ("score", _F), ("reason", _S), ("raw_start", _L), ("text", _S)])
NESTED = pa.schema([("nodes", pa.list_(pa.struct(list(NODES)))), ("rejected", pa.list_(pa.struct(list(REJECTED)))), ("documents", pa.list_(pa.struct(list(DOCUMENTS))))])

_DOC = regex.compile(r"<DOCUMENT>(.*?)</DOCUMENT>", regex.I | regex.S)
_HTML, _IX, _OTHER = (regex.compile(p) for p in (S.HTML_SIGN, S.IX_SIGN, S.OTHER_WRAPPER))
_IX_HEADER = regex.compile(S.IX_HEADER)
_BINARY = regex.compile(S.BINARY_NAME)
_SIGNALS = {k: regex.compile(p, regex.I) for k, p in P.SIGNALS.items()}
_ABS = [regex.compile(p, regex.I) for p in P.ABS_WORDS]
_ABS_NAME = regex.compile(P.ABS_NAME, regex.I)
_AGENT = {a: f for f, members in P.AGENTS.items() for a in members}
_REF, _OWN, _EX13, _INT = (regex.compile(p) for p in (P.BY_REFERENCE, P.OWN_REPORT, P.EXHIBIT_13, P.INTERNAL_POINTER))


def split(text: str) -> list[dict]:
    """Document blocks of a submission, as the column expressions of the sources give them."""
    out = []
    for m in _DOC.finditer(text):
        body, at = m[1], m.start(1)
        tag = lambda n: (lambda x: x[1].strip() or None if x else None)(regex.search(rf"<{n}>\s*([^\r\n<]*)", body, regex.I))  # noqa: B023, E731
        t = regex.search(r"<TEXT>(.*?)</TEXT>", body, regex.I | regex.S)
        seq = tag("SEQUENCE")
        inner = t[1] if t else ""
        head = inner[: S.SNIFF_CHARS]
        out.append({"sequence": int(seq) if seq and seq.isdigit() and len(seq) < 10 else None, "doc_type": tag("TYPE"), "filename": tag("FILENAME"), "payload": inner, "start": at + t.start(1) if t else -1, "is_html": bool(t) and not _OTHER.search(head) and bool(_HTML.search(head) or _IX.search(head))})
    return out


def profile_of(accession: str, cik: str | None, company: str | None, doc: dict) -> dict:
    body = doc["payload"]
    sig = {k: len(p.findall(body)) for k, p in _SIGNALS.items()}
    top = body[: P.ABS_WINDOW]
    sig |= {"reg_ab_specific": sum(len(p.findall(top)) for p in _ABS), "reg_ab_generic": len(regex.findall("Asset[- ]Backed", top, regex.I)), "reg_ab_name": int(bool(company and _ABS_NAME.search(company)))}
    agent = accession[:10]
    own = agent.isdigit() and (cik or "").isdigit() and int(agent) == int(cik)
    family = _AGENT.get(agent, "self" if own else "other")
    for k in ("workiva", "activedisclosure", "toppan_bridge", "compsci"):
        if sig[f"{k}_comment"]:
            family = k
            break
    else:
        if sig["bowne_link2"] and family in ("self", "other"):
            family = "bowne"
    if not doc["is_html"]:
        era = "text"
    elif sig["hidden_white_text"] >= 3 and sig["img_tag"] >= 3:
        era = "image_text"
    elif _IX.search(body[: S.IX_CHARS]):
        era = "ixbrl"
    elif family in ("self", "other"):
        era = "html_early" if sig["font_tag"] > sig["div_tag"] else "html_generic"
    else:
        era = "html_publisher"
    return {"signals": sig, "publisher": family, "era": era, "agent": agent}


def route(doc_type: str | None, header_type: str) -> str:
    t = (doc_type or "").upper()
    if t.startswith("EX-13"):
        return "form10k"
    if t.startswith("EX-"):
        return "contract"
    return "form10q" if t.replace("-", "").startswith("10Q") and not header_type.upper().replace("-", "").startswith("10K") else "form10k"


def stub(text: str) -> dict:
    if len(text) >= P.STUB_CHARS:
        return {}
    ref, ex13 = bool(_REF.search(text)), bool(_EX13.search(text))
    flag = ref and (ex13 or bool(regex.search(r"annual\s+report", _OWN.sub(" ", text), regex.I)))
    return {"item_incorporated_by_reference": flag, "ibr_target": ("ex13" if ex13 else "annual_report") if flag else None, "item_cross_reference": not flag and (ref or bool(_INT.search(text)))}


def parse(doc: dict, grammar_name: str, era: str, synth_root: bool = False) -> dict:
    """Blocks, candidates, regions, nodes and dropped candidates of one document; passes run in a fixed order."""
    base = doc["start"]
    body = _IX_HEADER.sub(lambda m: " " * len(m[0]), doc["payload"]) if era == "ixbrl" else doc["payload"]
    blocks, norm = text_blocks(body, base) if era == "text" else html_blocks(body, base, era == "image_text")
    end = base + len(body)
    g = GRAMMARS[grammar_name]
    contract = grammar_name == "contract"
    cands = headings.find(blocks, g, era)
    if not contract:
        rows.caption_lists(cands, norm)
        rows.status_tables(cands, blocks)
    regions = contents.detect(blocks, cands, len(norm), contract)
    inside = {i for r in regions for i in range(r.first, r.last + 1)}
    headings.page_repeats(cands, blocks, inside)
    borders: list[int] = []
    if contract:
        if era != "image_text":
            rows.contents_rows(cands, blocks, inside)
        headings.section_references(cands, norm)
        cuts, borders = outline.restarts(blocks, cands, regions)
        nodes, dropped = trees.contract_tree(blocks, cands, regions, base, end, cuts)
    else:
        if not synth_root:
            contents.vetoed_rows(cands)
        nodes, dropped = _form(blocks, cands, regions, g, base, end)
        more, banners = outline.sub_headings(blocks, nodes, regions, era)
        nodes += more
        dropped += banners
    if synth_root:
        nodes[0].rules.append("gram.synth_doc_root")
    satisfied = outline.exhibit_kinds(nodes, regions) if synth_root else {}
    outline.number(nodes)
    trees.close_spans(nodes, end)
    if era == "image_text":
        for n in nodes:
            n.score = min(n.score, 0.6)
            n.rules.append("ocr.degraded")
    starts, backs = outline.assign_paths(nodes, blocks, borders, base, end)
    if outline.truncate(nodes, backs):
        starts, backs = outline.assign_paths(nodes, blocks, borders, base, end)
    _norm_ends(nodes, blocks, len(norm))
    return {"blocks": blocks, "norm": norm, "cands": cands, "regions": regions, "nodes": nodes, "dropped": dropped, "segments": starts, "backs": backs, "satisfied": satisfied, "start": base, "end": end}


def _form(blocks, cands, regions, g, base, end):
    """The form's tree; Reg-AB items behind the back matter that the rest shows are vetoed and the tree built anew."""
    import copy

    kept = copy.deepcopy(cands)
    nodes, dropped = trees.form_tree(blocks, cands, regions, g, base, end)
    regab = [n for n in nodes if "gram.item.regab" in n.rules]
    if regab:
        edge, _ = outline.back_start(blocks, [n for n in nodes if n not in regab], base, end)
        late = {n.start for n in regab if n.start >= edge and "gram.item.title_match" not in n.rules}
        if late:
            for c in kept:
                if c.start in late and c.has("gram.item.regab"):
                    c.rules.append("rej.regab_back_matter")
            return trees.form_tree(blocks, kept, regions, g, base, end)
    return nodes, dropped


def _norm_ends(nodes, blocks, size: int) -> None:
    """Normalised end of each span: where the first block at or behind its raw end begins."""
    import bisect

    raw = [b.raw_start for b in blocks]
    for n in nodes:
        i = bisect.bisect_left(raw, n.end)
        n.norm_end = max(n.norm, blocks[i].norm_start if i < len(blocks) else size)


def rows_of(r: dict, head: dict, doc: dict, prof: dict, grammar: str, keep_text: bool) -> tuple[list[dict], list[dict], dict]:
    """Rows of one parsed document for nodes, rejected and documents."""
    seq = doc["sequence"] if doc["sequence"] is not None else 0
    common = {"accession_number": head["accession_number"], "cik": head["cik"], "sequence": seq, "doc_type": doc["doc_type"], "grammar": grammar}
    stamp = {"profile_era": prof["era"], "profile_publisher": prof["publisher"], "agent_cik": prof["agent"], "parser_version": PARSER_VERSION, "normalizer_version": NORMALIZER_VERSION}
    nodes = []
    for n in r["nodes"]:
        flags = stub(r["norm"][n.norm : n.norm_end]) if n.kind == "item" else {}
        nodes.append(
            common | stamp | {
                "node_id": n.id, "parent_id": n.parent, "depth": n.depth, "level_kind": "document" if n.kind == "doc" else n.kind, "label_canon": n.label, "label_raw": n.raw, "title": n.title, "raw_start": n.start, "raw_end": n.end, "head_raw_start": n.head_start, "head_raw_end": n.head_end,
                "norm_start": n.norm, "norm_end": n.norm_end, "order_key": n.order, "confidence": n.score, "rule_ids": n.rules, "path": n.path, "path_str": ".".join(map(str, n.path)), "meta": n.meta, "segment": n.segment,
                "ibr_target_in_submission": None if not flags.get("ibr_target") else head["has_ex13"], "satisfies_item": r["satisfied"].get(id(n)), "covers_items": n.covers or None, **flags,
            }
        )
    rejected = [{"accession_number": head["accession_number"], "sequence": seq, "block_idx": d.candidate.block, "kind": d.candidate.kind, "label_canon": d.candidate.label, "score": d.candidate.score, "reason": d.reason, "raw_start": d.candidate.start, "text": r["blocks"][d.candidate.block].text[:120]} for d in r["dropped"]]
    items = [x for n in r["nodes"] if n.kind == "item" for x in [n.label.split(" ", 1)[1], *n.covers]]
    body = [n.start for n in r["nodes"] if n.kind not in ("doc",)]
    document = common | stamp | {
        "filed_year": head["year"], "signals": json.dumps(prof["signals"], sort_keys=True), "n_blocks": len(r["blocks"]), "n_candidates": len(r["cands"]), "n_nodes": len(nodes), "toc_found": bool(r["regions"]), "items_found": list(dict.fromkeys(items)),
        "doc_raw_start": r["start"], "doc_raw_end": r["end"], "front_end": min(body, default=r["start"]), "back_start": r["backs"][-1], "n_segments": len(r["segments"]), "level_profile": json.dumps(outline.level_profile(r["nodes"]), sort_keys=True),
        "normalized_text": r["norm"] if keep_text else None, "error": None, "input_sha256": head["sha"], "input_bytes": head["size"], "manifest_cik": head["manifest_cik"],
    }
    return nodes, rejected, document


def chosen(docs: list[dict], kind: str | None, sequence: int | None, form: str) -> list[dict]:
    """The documents that a work row asks for: all, one exhibit by its sequence, or the main document of a form."""
    texts = [d for d in docs if d["start"] >= 0]
    if kind is None:
        return texts
    if kind in ("ex10", "ex13") and sequence is not None:
        return [d for d in texts if d["sequence"] == sequence][:1]
    st = form.strip().upper()
    base = st.removesuffix("/A")
    head, dash, tail = base.partition("-")
    ranks = (lambda t: t == st, lambda t: t == base, lambda t: t.startswith(head + dash + tail[:1]), lambda t: True)
    usable = [d for d in texts if not _BINARY.search(d["filename"] or "")]
    return next(([d] for rank in ranks for d in usable if rank((d["doc_type"] or "").upper())), [])


def parse_submission(accession: str, cik: str | None, year: int | None, text: str, keep_text: bool = False, kind: str | None = None, sequence: int | None = None, form: str | None = None) -> tuple[list[dict], list[dict], list[dict]]:
    """The documents of one submission: all that have text, or those that ``kind`` asks for.

    ``text`` as kind means a bare file without envelope: it is one EX-10 document, so its offsets are those of the file.
    """
    raw = text.encode("latin-1", "replace")
    h = regex.search(r"<(SEC-HEADER|IMS-HEADER)>(.*?)</\1>", text, regex.I | regex.S)
    header = h[2] if h else ""
    field = lambda p: (lambda m: m[1].strip() if m else "")(regex.search(p, header, regex.I))
    digits = field(r"CENTRAL\s+INDEX\s+KEY:\s*(\d+)")
    docs = split(text) if kind != "text" else [{"sequence": sequence, "doc_type": "EX-10", "filename": None, "payload": text, "start": 0, "is_html": False}]
    head = {"accession_number": accession, "cik": (digits.lstrip("0") or "0") if digits else cik, "manifest_cik": cik, "year": year, "sha": hashlib.sha256(raw).hexdigest(), "size": len(raw), "has_ex13": any((d["doc_type"] or "").upper().startswith("EX-13") for d in docs)}
    nodes, rejected, documents = [], [], []
    header_type = field(r"CONFORMED\s+SUBMISSION\s+TYPE:\s*([^\r\n<]+)")
    for d in docs if kind == "text" else chosen(docs, kind, sequence, form or header_type or "10-K"):
        grammar = route(d["doc_type"], header_type)
        try:
            prof = profile_of(accession, cik, field(r"COMPANY\s+CONFORMED\s+NAME:\s*([^\r\n<]+)"), d)
            r = parse(d, grammar, prof["era"], (d["doc_type"] or "").upper().startswith("EX-13"))
            a, b, c = rows_of(r, head, d, prof, grammar, keep_text)
            nodes += a
            rejected += b
            documents.append(c)
        except Exception as e:  # noqa: BLE001
            documents.append({"accession_number": accession, "cik": head["cik"], "sequence": d["sequence"] or 0, "doc_type": d["doc_type"], "grammar": grammar, "error": repr(e)[:500], "input_sha256": head["sha"], "input_bytes": head["size"], "manifest_cik": cik, "parser_version": PARSER_VERSION, "normalizer_version": NORMALIZER_VERSION})
    return nodes, rejected, documents


def _fill(rows: list[dict], schema: pa.Schema) -> list[dict]:
    return [{f.name: r.get(f.name) for f in schema} for r in rows]


def _run(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if not row["text"]:
                    continue
                n, r, d = parse_submission(row["accession_number"], row["cik"], row["year"], row["text"], keep_text, row["kind"], row["sequence"], row["submission_type"])
                yield pa.RecordBatch.from_pylist([{"nodes": _fill(n, NODES), "rejected": _fill(r, REJECTED), "documents": _fill(d, DOCUMENTS)}], schema=NESTED)

    return run


def parse_submissions(submissions: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per submission (accession_number, cik, year, text) with its nodes, rejected and documents as arrays.

    Columns kind (10k, 10q, ex10, ex13, text), sequence and submission_type, where present, say which document a row
    asks for.  Write this once and take the three tables from it with ``table_of``.
    """
    asked = [F.col(c).cast(t).alias(c) if c in submissions.columns else F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("sequence", "int"), ("submission_type", "string"))]
    return submissions.select("accession_number", "cik", F.col("year").cast("int").alias("year"), "text", *asked).mapInArrow(_run(keep_text), from_arrow_schema(NESTED))


def table_of(parsed: DataFrame, name: str) -> DataFrame:
    """nodes, rejected or documents."""
    return parsed.select(F.explode(name).alias("r")).select("r.*")


