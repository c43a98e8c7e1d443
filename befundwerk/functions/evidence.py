"""Evidence in report texts as columns: accepted spans, sections, sentence windows, gate and flags."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from befundwerk.functions.clean import SPACE_CHARS, strip
from befundwerk.functions.schema import shorten
from befundwerk.functions.terms import GROUPS, HINTS, MATRIX_TYPES, SECTION_ORDER, SECTIONS, contains_any


@dataclass(frozen=True)
class Limits:
    """Caps of the evidence of one report; per_term and per_prophylaxis count hits of the same term (TXT-14).

    Values below a floor are raised to it. With ``send_short`` texts of at most ``short`` signs go out whole without evidence.
    """

    snippets: int = 12
    chars: int = 400
    bundle: int = 8000
    per_term: int = 3
    per_prophylaxis: int = 2
    sentences: int = 1
    short: int = 1000
    send_short: bool = False

    def __post_init__(self) -> None:
        for name, floor in (("snippets", 1), ("chars", 80), ("bundle", 500), ("per_term", 1), ("per_prophylaxis", 1), ("sentences", 0), ("short", 1)):
            object.__setattr__(self, name, max(floor, getattr(self, name)))


# Fixed values of the text that a model is sent.
HEADER = "Patient report evidence snippets:"
INSTRUCTION = (
    "Instruction:\n"
    "Decide whether the evidence supports documented delirium.\n"
    "Do not classify prophylaxis/risk/screening alone as delirium.\n"
    "Do not classify negated/excluded delirium as delirium.\n"
    "Indirect symptoms require clinical interpretation."
)
SECTION_NAMES = {"diag": "Diagnosen", "jetziges_leiden": "Jetziges Leiden", "epikrise": "Epikrise", "prozedere": "Prozedere"}
NO_EVIDENCE, STRUCTURED, SHORT_WHOLE = "no_evidence_prefilter_skip", "structured_evidence_extraction", "short_report_no_evidence_fulltext"


SPACE_PYTHON = re.escape(SPACE_CHARS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(low: Column, term: str, kind: str) -> Column:
    """All non-overlapping places of one term as (a, z, term, kind), from the lengths of what lies between."""
    n = len(term)
    parts = F.split(low, r"\Q" + term + r"\E", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        zero,
        lambda s, p: F.struct((s["at"] + F.length(p) + n).cast("int").alias("at"), F.concat(s["out"], F.array((s["at"] + F.length(p)).cast("int"))).alias("out")),
    )
    return F.transform(fold["out"], lambda a: F.struct(a.alias("a"), (a + n).cast("int").alias("z"), F.lit(term).alias("term"), F.lit(kind).alias("kind")))


_SPAN = pa.struct([("a", pa.int32()), ("z", pa.int32()), ("term", pa.string()), ("kind", pa.string())])
_SNIPPET = pa.struct([("section", pa.string()), ("kind", pa.string()), ("term", pa.string()), ("text", pa.string()), ("priority", pa.int32())])
_RECORD = pa.struct([("original_len", pa.int32()), ("hits", pa.int32()), ("snippets", pa.list_(_SNIPPET)), ("has_direct", pa.bool_()), ("has_indirect", pa.bool_()), ("has_negation", pa.bool_()), ("prophylaxis_only", pa.bool_()), ("send", pa.bool_()), ("sent_text", pa.string()), ("sent_len", pa.int32()), ("method", pa.string())])
_SNIPPETS_TYPE = "array<struct<section:string,kind:string,term:string,text:string,priority:int>>"


def _ordered(groups: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    return sorted(((t, k) for k, ts in groups.items() for t in ts), key=lambda x: -len(x[0]))


def find_spans(low: str, terms: Sequence[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """The accepted spans of a text in small letters, in order of place; terms in the given order."""
    taken: list[tuple[int, int, str, str]] = []
    for term, kind in terms:
        at = low.find(term)
        while at >= 0:
            end = at + len(term)
            if all(end <= a or at >= z for a, z, _, _ in taken):
                taken.append((at, end, term, kind))
            at = low.find(term, end)
    return sorted(taken)


def spans(text: Column, groups: Mapping[str, Sequence[str]] = GROUPS) -> Column:
    """The accepted term spans of a text in order of place (TXT-4).

    Longer terms go first over the whole text, equal lengths in the groups' order; a span that
    overlaps an accepted one is skipped. Null gives an empty list. Runs on Arrow batches.
    """
    terms = _ordered(groups)

    @F.arrow_udf("array<struct<a:int,z:int,term:string,kind:string>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([find_spans(t.lower(), terms) if t else [] for t in texts.to_pylist()], pa.list_(_SPAN))

    return run(text)


_HEAD_RE = re.compile("|".join(re.escape(h) for h, _ in SECTIONS))
_SECTION_OF = dict(SECTIONS)
_GAP = re.compile(f"(?<=[.!?])[{SPACE_PYTHON}]+")
_WHITE = re.compile(f"[{SPACE_PYTHON}]+")


class Marks:
    """The headings of a text, for the section that a place lies in."""

    def __init__(self, text: str) -> None:
        found = list(_HEAD_RE.finditer(text))
        self.at, self.names = [m.start() for m in found], [_SECTION_OF[m[0]] for m in found]

    def section(self, at: int) -> str:
        """That of the last heading at or before a place, unknown before the first (TXT-5)."""
        i = bisect_right(self.at, at)
        return self.names[i - 1] if i else "unknown"


def cut(text: str, chars: int) -> str:
    return text if len(text) <= chars else text[: chars - 1] + "…"


class Windows:
    """The sentences of a text, for the window around a place (TXT-6)."""

    def __init__(self, text: str) -> None:
        self.sentences, self.starts, at = [], [], 0
        for m in _GAP.finditer(text):
            self.sentences.append(text[at : m.start()])
            self.starts.append(at)
            at = m.end()
        self.sentences.append(text[at:])
        self.starts.append(at)

    def around(self, at: int, neighbours: int, chars: int) -> str:
        """The sentence that holds a place and its neighbours, white space squeezed, cut to ``chars`` with an ellipsis."""
        i = bisect_right(self.starts, at) - 1
        return cut(_WHITE.sub(" ", " ".join(self.sentences[max(0, i - neighbours) : i + neighbours + 1])).strip(" "), chars)


def find_evidence(text: str | None, limits: Limits, terms: Sequence[tuple[str, str]]) -> tuple:
    """The evidence record of one text."""
    if not text:
        return len(text or ""), 0, [], False, False, False, False, False, "", 0, NO_EVIDENCE
    kept, seen = [], Counter()
    for a, z, term, kind in find_spans(text.lower(), terms):
        if seen[term] < (limits.per_prophylaxis if kind == "prophylaxis_or_risk" else limits.per_term):
            seen[term] += 1
            kept.append((a, term, kind))
    if not kept:
        return len(text), 0, [], False, False, False, False, False, "", 0, NO_EVIDENCE
    marks, windows, order = Marks(text), Windows(text), {k: i for i, k in enumerate(GROUPS)}
    once: dict[tuple, str] = {}
    for a, term, kind in kept:
        w = windows.around(a, limits.sentences, limits.chars)
        once.setdefault((marks.section(a), kind, term, w[:200]), w)
    ranked = sorted((SECTION_ORDER[section], order[kind], w, term, section, kind) for (section, kind, term, _), w in once.items())
    snippets = [(section, kind, term, w, i) for i, (_, _, w, term, section, kind) in enumerate(ranked[: limits.snippets], 1)]
    kinds = {s[1] for s in snippets}
    direct, indirect, negation = (k in kinds for k in ("direct_delir", "indirect_symptom", "negation"))
    send = kinds != {"negation"}
    sent = bundle_text(snippets, limits.bundle) if send else ""
    return len(text), len(kept), snippets, direct, indirect, negation, "prophylaxis_or_risk" in kinds and not direct and not indirect, send, sent, len(sent), STRUCTURED if send else NO_EVIDENCE


def evidence(text: Column, limits: Limits = Limits()) -> Column:
    """One struct per text: hits, snippets (section, kind, term, text, priority), flags, gate, and the text that is sent (TXT-13).

    Hits of a term beyond its cap are dropped, then windows with equal section, kind, term and
    beginning are one, then they are sorted and capped; flags are taken after that. Null and empty texts have no
    evidence. Runs on Arrow batches: nested column expressions take some fifty times as long.
    """
    terms = _ordered(GROUPS)

    @F.arrow_udf(f"original_len int, hits int, snippets {_SNIPPETS_TYPE}, has_direct boolean, has_indirect boolean, has_negation boolean, prophylaxis_only boolean, send boolean, sent_text string, sent_len int, method string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([find_evidence(t, limits, terms) for t in texts.to_pylist()], _RECORD)

    return run(text)


def bundle_text(snippets: Sequence[tuple], most: int) -> str:
    """Header, a block per snippet with section, kind and priority, instruction; blocks are dropped from the bottom beyond ``most`` signs."""
    blocks = [f"[{SECTION_NAMES.get(section, section)} | {kind} | priority={n}]\n{text}\n" for section, kind, _, text, n in snippets]
    whole = "\n".join([HEADER, "", *blocks, INSTRUCTION])
    if len(whole) <= most:
        return whole
    room, used, kept = most - len(INSTRUCTION) - len(HEADER) - 4, len(HEADER) + 2, []
    for b in blocks:
        if used + len(b) > room:
            break
        used += len(b) + 1
        kept.append(b)
    return "\n".join([HEADER, "", *kept]) + "\n\n" + INSTRUCTION


def bundle(snippets: Column, limits: Limits = Limits()) -> Column:
    """What a model is sent for a list of snippets (TXT-9)."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else bundle_text([(s["section"], s["kind"], s["term"], s["text"], s["priority"]) for s in x], limits.bundle) for x in lists.to_pylist()], pa.string())

    return run(snippets)


def short_fallback(record: Column, text: Column, kind: Column, limits: Limits = Limits()) -> Column:
    """The record of a short report without evidence, sent whole if the limits say so (TXT-12).

    That holds for the matrix types and texts of at most ``limits.short`` signs; everything else stays as it is.
    """
    body = shorten(F.coalesce(strip(text), F.lit("")), limits.bundle)
    applies = F.lit(limits.send_short) & ~record["send"] & kind.isin(*MATRIX_TYPES) & (record["original_len"] <= limits.short)
    sent = record.withField("sent_text", body).withField("sent_len", F.length(body)).withField("method", F.lit(SHORT_WHOLE)).withField("send", F.lit(True))
    return F.when(applies, sent).otherwise(record)


def merge_intervals(spans_: Column) -> Column:
    """Sorted (a, z) with touching and overlapping ones merged."""
    empty = F.array().cast("array<struct<a:int,z:int>>")
    return F.aggregate(
        F.array_sort(spans_),
        empty,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["z"] >= s["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["z"], s["z"]).alias("z"))))).otherwise(F.concat(acc, F.array(F.struct(s["a"].alias("a"), s["z"].alias("z"))))),
    )


def reduce_text(text: Column, around: int = 1000, total: int = 8000) -> Column:
    """Windows around hint terms, merged and joined by dots; texts without a hint are cut to ``total``."""
    return let(F.lower(text), lambda low: let(F.concat(*(_starts(low, t, "hint") for t in HINTS)), lambda places: _reduced(text, places, around, total)))


def _reduced(text: Column, places: Column, around: int, total: int) -> Column:
    wide = F.transform(places, lambda s: F.struct(F.greatest(s["a"] - around, F.lit(0)).cast("int").alias("a"), F.least(s["z"] + around, F.length(text)).cast("int").alias("z")))
    cut = F.transform(merge_intervals(wide), lambda s: F.substring(text, s["a"] + 1, s["z"] - s["a"]))
    return F.substring(F.when(F.size(places) > 0, F.array_join(cut, " ... ")).otherwise(text), 1, total)


# Fixed values of the reduction: the order of sections and the caps of texts without a hint.
REDUCED = (("diag", "[Diagnosen]", 3000), ("jetziges_leiden", "[Jetziges Leiden]", 2000), ("prozedere", "[Prozedere]", 1000), ("epikrise", "[Epikrise]", 1000))
_HEADING = r"\[(Diagnosen|Jetziges Leiden|Prozedere|Epikrise)\]"


def report_sections(text: Column) -> Column:
    """A stitched report as a map of section to body in the order of the reduction (TXT-17).

    Bodies of a repeated heading are joined; what lies before the first heading belongs to none; a
    text without headings is all diag. Sections that are missing are empty.
    """
    return let(F.struct(F.split(text, _HEADING, -1).alias("parts"), F.regexp_extract_all(text, F.lit(_HEADING), 0).alias("heads")), lambda x: _sections(x["parts"], x["heads"]))


def _sections(parts: Column, heads: Column) -> Column:
    bodies = F.arrays_zip(heads.alias("h"), F.slice(parts, 2, F.size(heads)).alias("b"))
    body = lambda h: F.array_join(F.transform(F.filter(bodies, lambda x: x["h"] == h), lambda x: strip(x["b"])), "\n\n")
    plain = F.when(F.size(heads) == 0, strip(F.element_at(parts, 1))).otherwise(body("[Diagnosen]"))
    return F.create_map(*(x for s, h, _ in REDUCED for x in (F.lit(s), plain if s == "diag" else body(h))))


REDUCED_TYPE = "text string, method string, original_len int, hits int"
_REDUCED_ARROW = pa.struct([("text", pa.string()), ("method", pa.string()), ("original_len", pa.int32()), ("hits", pa.int32())])
_HEADING_RE = re.compile(_HEADING)


def reduce_report(text: Column, around: int = 1000, total: int = 8000) -> Column:
    """A stitched report shortened section by section: text, method, length before, hits (TXT-16, TXT-18).

    Sections with hints give their merged windows, the course text at most its cap; without any hint every
    section is cut to its cap, and a text without headings is dealt out over the caps in turn. Null stays null.
    Runs on Arrow batches: as nested column expressions the same takes some fifty times as long.
    """

    @F.arrow_udf(REDUCED_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _shortened(t.strip(SPACE_CHARS), around, total) for t in texts.to_pylist()], _REDUCED_ARROW)

    return run(text)


def _shortened(text: str, around: int, total: int) -> tuple[str, str, int, int]:
    marks = list(_HEADING_RE.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    body = {h: "\n\n".join(text[m.end() : z].strip(SPACE_CHARS) for m, z in zip(marks, ends) if m[0] == h) for _, h, _ in REDUCED}
    if not marks:
        body[REDUCED[0][1]] = text
    windows = {h: w for _, h, _ in REDUCED if (w := hint_windows(body[h], around))}
    if windows:
        blocks = {h: w[: REDUCED[-1][2]] if h == REDUCED[-1][1] else w for h, w in windows.items()}
    elif marks and any(body.values()):
        blocks = {h: body[h][:cap] for _, h, cap in REDUCED if body[h]}
    else:
        at, blocks = 0, {}
        for _, h, cap in REDUCED:
            blocks[h] = text[at : at + cap]
            at += cap
    out = "\n\n".join(f"{h}\n{b}" for h, b in blocks.items() if b)[:total].strip(SPACE_CHARS)
    low = text.lower()
    return out, "keyword_windows" if windows else "fallback_truncation", len(text), sum(low.count(t) for t in HINTS)


def hint_windows(body: str, around: int) -> str:
    """The merged windows around a section's hints, stripped and joined (TXT-15, TXT-16); empty without a hint."""
    low = body.lower()
    wide = sorted({(max(0, m.start() - around), min(len(body), m.end() + around)) for t in HINTS if t in low for m in re.finditer(t, low)})
    merged: list[list[int]] = []
    for a, z in wide:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    return "\n\n...\n\n".join(c for a, z in merged if (c := body[a:z].strip(SPACE_CHARS)))



def flat_text(text: str | None, chars: int = 250, most: int = 12, separator: str = " || ") -> str:
    """Windows around the hint terms in the list's order as one text, empty without a hit."""
    if not text:
        return ""
    low, marks, taken, out = text.lower(), Marks(text), [], []
    for term in HINTS:
        half = max(20, chars // 2 - len(term) // 2)
        at = low.find(term)
        while at >= 0 and len(out) < most:
            end = at + len(term)
            if all(end <= a or at >= z for a, z in taken):
                taken.append((at, end))
                section = marks.section(at)
                lead = f"[{SECTION_NAMES[section]}] " if section in SECTION_NAMES else ""
                out.append(cut((lead + text[max(0, at - half) : end + half].replace("\n", " ").strip(SPACE_CHARS)).strip(SPACE_CHARS), chars))
            at = low.find(term, end)
    return separator.join(out)


def flat_snippets(text: Column, chars: int = 250, most: int = 12, separator: str = " || ") -> Column:
    """Windows around the hint terms in the list's order as one text, empty without a hit (TXT-19).

    Hits that overlap an earlier one are skipped; a window inside a section is led by the section's name.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([flat_text(t, chars, most, separator) for t in texts.to_pylist()], pa.string())

    return run(text)


def snippet_cell(existing: Column, text: Column, signals: Column, context: Column, chars: int = 250) -> Column:
    """The first that holds something: what is there, windows of the text, signals, a context with a hint; else ``[]`` (TXT-20)."""
    bare = F.trim(existing)
    kept = F.when(~F.lower(bare).isin("", "nan", "[]"), bare)
    parts = F.slice(F.filter(F.transform(F.split(signals, r"\|"), strip), lambda x: x != ""), 1, 5)
    flat = lambda c: strip(F.translate(c, "\n", " "))
    marked = F.array_join(F.transform(parts, lambda x: shorten(flat(F.concat(F.lit("[Treffer] "), x)), min(120, chars))), " || ")
    told = F.when(contains_any(context, HINTS), shorten(flat(F.concat(F.lit("[Kontext] "), context)), chars))
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(kept, filled(flat_snippets(text, chars)), filled(marked), filled(told), F.lit("[]"))


# The marks around a term, by kind.
MARKS = {"direct_delir": ("==", "=="), "indirect_symptom": ("**", "**"), "negation": ("__", "__"), "prophylaxis_or_risk": ("__", "__")}


def highlight_text(text: str, snippets: Sequence[Mapping], marks: Mapping[str, tuple[str, str]] = MARKS) -> str:
    """The text with the first place of each snippet's term marked by its kind, longer terms first."""
    for s in sorted(snippets, key=lambda s: -len(s["term"] or "")):
        at = text.lower().find(s["term"].lower()) if s["term"] and s["kind"] in marks else -1
        if at >= 0:
            left, right = marks[s["kind"]]
            end = at + len(s["term"])
            text = text[:at] + left + text[at:end] + right + text[end:]
    return text


def excerpt_text(text: str, snippets: Sequence[Mapping], chars: int) -> str:
    """``chars`` signs of the text around the first snippet term that it holds, with an ellipsis where it is cut."""
    if not text.strip(SPACE_CHARS):
        return ""
    if not snippets:
        return cut(text.strip(SPACE_CHARS), chars)
    low = text.lower()
    anchor = next((at for s in snippets if s["term"] and (at := low.find(s["term"].lower())) >= 0), 0)
    end = min(len(text), max(0, anchor - chars // 2) + chars)
    start = max(0, end - chars)
    return ("…" * (start > 0) + text[start:end] + "…" * (end < len(text))).strip(SPACE_CHARS)


def terms_text(snippets: Sequence[Mapping]) -> str:
    """One line per kind with its distinct terms in order, or a line that there are none."""
    lines = [f"- {k}: {', '.join(t)}" for k in GROUPS if (t := list(dict.fromkeys(s["term"] for s in snippets if s["kind"] == k and s["term"])))]
    return "\n".join(lines) or "- (none)"


def presentation(text: Column, snippets: Column, chars: int) -> Column:
    """(excerpt, terms): the excerpt around the snippets with their terms marked, and the terms by kind (TXT-21); null and empty texts have empty ones."""

    @F.arrow_udf("excerpt string, terms string")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [(highlight_text(excerpt_text(t or "", s or [], chars), s or []), terms_text(s or [])) for t, s in zip(texts.to_pylist(), lists.to_pylist())]
        return pa.array(rows, pa.struct([("excerpt", pa.string()), ("terms", pa.string())]))

    return run(text, snippets)
