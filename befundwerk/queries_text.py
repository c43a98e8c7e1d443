"""Queries of evidence, text reduction, snippets and JSON in text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from befundwerk.functions.clean import SPACE_RE2
from befundwerk.functions.evidence import HEADER, INSTRUCTION, NO_EVIDENCE, REDUCED, SECTION_NAMES, SHORT_WHOLE, STRUCTURED, Limits, evidence, flat_snippets, presentation, reduce_report, report_sections, short_fallback, snippet_cell, spans
from befundwerk.functions.json_text import NO_CONTEXT, SIGNALS, first_objects, interpretation, lenient, signals, snippets_from_json, snippets_to_json
from befundwerk.functions.terms import GROUPS, HINTS, MATRIX_TYPES, SECTION_ORDER, SECTIONS
from befundwerk.queries_core import sql_strip
from befundwerk.queries_ref import _R, _STITCH, query, reports, stitched
from befundwerk.session import table



def texts(spark: SparkSession, d: str) -> DataFrame:
    """Every report's stitched text, computed once per row."""
    return reports(spark, d).select("report_nr", "typ", stitched().alias("t"))


# ---- SQL building blocks

_NL = "chr(10)"
_TERMS = ", ".join(f"('{t}', '{k}', {i})" for i, (t, k) in enumerate(sorted(((t, k) for k, ts in GROUPS.items() for t in ts), key=lambda x: -len(x[0]))))
_HINTS = ", ".join(f"('{t}', 'hint', {i})" for i, t in enumerate(HINTS))
_T = f"{_R}, t AS (SELECT report_nr, typ, nullif({_STITCH}, '') AS t FROM r)"


def sql_places(text: str, term: str) -> str:
    """The places of a term in a text, from the lengths of what lies between."""
    parts = f"string_split({text}, {term})"
    return f"list_transform(range(1, len({parts})), lambda i: CAST(list_sum(list_transform({parts}[1:i], lambda x: length(x))) + (i - 1) * length({term}) AS INTEGER))"


def sql_picked(source: str, key: str, text: str, terms: str) -> str:
    """CTEs up to ``picked``: per key the accepted places in the order of the terms, none overlapping an earlier one."""
    return f"""k(term, kind, ord) AS (VALUES {terms}), places AS (SELECT {key}, term, kind, ord, unnest({sql_places(f'lower({text})', 'term')}) AS a FROM {source}, k WHERE contains(lower({text}), term)),
lists AS (SELECT {key}, list({{'a': a, 'z': CAST(a + length(term) AS INTEGER), 'term': term, 'kind': kind}} ORDER BY ord, a) AS l FROM places GROUP BY {key}),
picked AS (SELECT {key}, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: x.a < o.z AND o.a < x.z)) > 0 THEN acc ELSE list_append(acc, x) END, [l[1]]) AS s FROM lists)"""


_SPANS = f"{_T}, {sql_picked('t', 'report_nr', 't', _TERMS)}, spans AS (SELECT report_nr, x.a, x.z, x.term, x.kind FROM (SELECT report_nr, unnest(s) AS x FROM picked))"
_MARKS = f"""marks AS (SELECT report_nr, list({{'a': a, 's': s}}) AS m FROM (SELECT report_nr, s, unnest({sql_places('t', 'h')}) AS a FROM t, (VALUES {', '.join(f"('{h}', '{s}')" for h, s in SECTIONS)}) v(h, s) WHERE contains(t, h)) GROUP BY 1)"""
_SECTION = "coalesce(list_sort(list_filter(m, lambda y: y.a <= c.a), 'DESC')[1].s, 'unknown')"
_BREAK = f"'([.!?])[{SPACE_RE2}]+', '\\1' || chr(1), 'g'"
_BEFORE = f"len(string_split(regexp_replace(substring(t, 1, c.a + 1), {_BREAK}), chr(1)))"
_WINDOW = f"trim(regexp_replace(array_to_string(string_split(regexp_replace(t, {_BREAK}), chr(1))[greatest({_BEFORE} - 1, 1):{_BEFORE} + 1], ' '), '[{SPACE_RE2}]+', ' ', 'g'))"


def _cases(column: str, values: dict, other: str = "NULL") -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in values.items()) + f" ELSE {other} END"


_INSTRUCTION = INSTRUCTION.replace("\n", "' || chr(10) || '")
_ROOM = 8000 - len(INSTRUCTION) - 2 - len(HEADER) - 2
_EVIDENCE = f"""{_SPANS}, {_MARKS}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_nr, term ORDER BY a) AS n FROM spans) WHERE n <= CASE kind WHEN 'prophylaxis_or_risk' THEN 2 ELSE 3 END),
hits AS (SELECT report_nr, count(*) AS hits FROM capped GROUP BY 1),
raw AS (SELECT c.report_nr, c.a, c.term, c.kind, {_SECTION} AS section, {_WINDOW} AS w FROM capped c JOIN t USING (report_nr) LEFT JOIN marks USING (report_nr)),
cut AS (SELECT report_nr, a, term, kind, section, CASE WHEN length(w) > 400 THEN substring(w, 1, 399) || '…' ELSE w END AS w FROM raw),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_nr, section, kind, term, substring(w, 1, 200) ORDER BY a) AS n FROM cut) WHERE n = 1),
snip AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_nr ORDER BY {_cases('section', SECTION_ORDER)}, {_cases('kind', {k: i for i, k in enumerate(GROUPS, 1)})}, w, term) AS priority FROM once) WHERE priority <= 12),
blocks AS (SELECT *, '[' || {_cases('section', SECTION_NAMES, 'section')} || ' | ' || kind || ' | priority=' || priority || ']' || {_NL} || w || {_NL} AS b FROM snip),
kept AS (SELECT *, {len(HEADER) + 2} + sum(length(b) + 1) OVER (PARTITION BY report_nr ORDER BY priority) - 1 <= {_ROOM} AS fits FROM blocks),
texts AS (SELECT report_nr, count(*) AS snippets, bool_or(kind <> 'negation') AS send, bool_or(kind = 'direct_delir') AS has_direct, bool_or(kind = 'indirect_symptom') AS has_indirect, bool_or(kind = 'negation') AS has_negation, bool_or(kind = 'prophylaxis_or_risk') AS has_prophylaxis,
  '{HEADER}' || {_NL} || {_NL} || string_agg(b || {_NL}, '' ORDER BY priority) || '{_INSTRUCTION}' AS whole, '{HEADER}' || {_NL} || coalesce(string_agg({_NL} || b, '' ORDER BY priority) FILTER (fits), '') || {_NL} || {_NL} || '{_INSTRUCTION}' AS short FROM kept GROUP BY 1),
e AS (SELECT t.report_nr, t.typ, t.t, length(coalesce(t.t, '')) AS original_len, CAST(coalesce(hits, 0) AS INTEGER) AS hits, CAST(coalesce(snippets, 0) AS INTEGER) AS snippets, coalesce(has_direct, false) AS has_direct, coalesce(has_indirect, false) AS has_indirect, coalesce(has_negation, false) AS has_negation,
  coalesce(has_prophylaxis AND NOT has_direct AND NOT has_indirect, false) AS prophylaxis_only, coalesce(send, false) AS send, CASE WHEN send THEN CASE WHEN length(whole) <= 8000 THEN whole ELSE short END ELSE '' END AS sent, CASE WHEN send THEN '{STRUCTURED}' ELSE '{NO_EVIDENCE}' END AS method
  FROM t LEFT JOIN hits USING (report_nr) LEFT JOIN texts USING (report_nr))"""


@query(f"WITH {_SPANS} SELECT report_nr, a AS von, z AS bis, term AS begriff, kind AS art FROM spans")
def txt4_spannen(spark: SparkSession, d: str) -> DataFrame:
    """Accepted term spans of the whole stitched report, longest terms first (TXT-4)."""
    r = texts(spark, d).select("report_nr", F.explode(spans(F.col("t"))).alias("s"))
    return r.select("report_nr", F.col("s.a").alias("von"), F.col("s.z").alias("bis"), F.col("s.term").alias("begriff"), F.col("s.kind").alias("art"))


_FIELDS = ("original_len", "hits", "has_direct", "has_indirect", "has_negation", "prophylaxis_only", "send", "method")


@query(f"WITH {_EVIDENCE} SELECT report_nr, {', '.join(_FIELDS)}, snippets, length(sent) AS sent_len, md5(sent) AS belege FROM e")
def txt5_txt13_belege(spark: SparkSession, d: str) -> DataFrame:
    """Evidence record of every report: snippets, flags, gate and the text that is sent (TXT-5 to TXT-11, TXT-13, TXT-14, SRT-7)."""
    e = texts(spark, d).select("report_nr", evidence(F.col("t")).alias("e"))
    return e.select("report_nr", *(f"e.{c}" for c in _FIELDS), F.size("e.snippets").alias("snippets"), "e.sent_len", F.md5("e.sent_text").alias("belege"))


@query(f"""WITH {_EVIDENCE}, b AS (SELECT *, NOT send AND typ IN {MATRIX_TYPES} AND original_len <= 1000 AS kurz FROM e)
SELECT report_nr, send OR kurz AS send, CASE WHEN kurz THEN '{SHORT_WHOLE}' ELSE method END AS method, length(CASE WHEN kurz THEN coalesce({sql_strip('t')}, '') ELSE sent END) AS sent_len, md5(CASE WHEN kurz THEN coalesce({sql_strip('t')}, '') ELSE sent END) AS belege FROM b""")
def txt12_kurze(spark: SparkSession, d: str) -> DataFrame:
    """What is sent where short reports without evidence go out whole (TXT-12)."""
    limits = Limits(send_short=True)
    e = texts(spark, d).select("report_nr", short_fallback(evidence(F.col("t"), limits), F.col("t"), F.col("typ"), limits).alias("e"))
    return e.select("report_nr", "e.send", "e.method", "e.sent_len", F.md5("e.sent_text").alias("belege"))


# ---- sections and reduction

_HEAD = r"\[(?:Diagnosen|Jetziges Leiden|Prozedere|Epikrise)\]"
_TRIM = lambda c: f"regexp_replace({c}, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+$', '', 'g')"
_SECS = f"""{_T}, heads AS (SELECT report_nr, {_TRIM('t')} AS t, regexp_extract_all({_TRIM('t')}, '{_HEAD}') AS h, string_split_regex({_TRIM('t')}, '{_HEAD}') AS p FROM t WHERE t IS NOT NULL),
bodies AS (SELECT report_nr, t, list_transform(range(1, len(h) + 1), lambda i: {{'h': h[i], 'b': {_TRIM('p[i + 1]')}}}) AS b FROM heads),
sec AS (SELECT report_nr, t, s, h, cap, ord, array_to_string(list_transform(list_filter(b, lambda x: x.h = h), lambda x: x.b), chr(10) || chr(10)) AS body FROM bodies, (VALUES {', '.join(f"('{s}', '{h}', {c}, {i})" for i, (s, h, c) in enumerate(REDUCED))}) v(s, h, cap, ord))"""


@query(f"WITH {_SECS} SELECT report_nr, {', '.join(f"md5(max(body) FILTER (s = '{s}')) AS {s}" for s, _, _ in REDUCED)} FROM sec GROUP BY 1")
def txt17_abschnitte(spark: SparkSession, d: str) -> DataFrame:
    """The stitched report taken apart into its four sections (TXT-17)."""
    m = texts(spark, d).filter("t IS NOT NULL").select("report_nr", report_sections(F.col("t")).alias("m"))
    return m.select("report_nr", *(F.md5(F.col("m")[s]).alias(s) for s, _, _ in REDUCED))


_REDUCED = f"""{_SECS}, k(term) AS (VALUES {', '.join(f"('{t}')" for t in HINTS)}),
wide AS (SELECT DISTINCT report_nr, s, body, ord, h, greatest(a - 1000, 0) AS a, least(a + n + 1000, length(body)) AS z FROM (SELECT report_nr, s, body, ord, h, length(term) AS n, unnest({sql_places('lower(body)', 'term')}) AS a FROM sec, k WHERE contains(lower(body), term))),
begun AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY report_nr, s ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS neu FROM wide),
island AS (SELECT *, sum(neu) OVER (PARTITION BY report_nr, s ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM begun),
piece AS (SELECT report_nr, s, ord, h, min(a) AS a, {_TRIM('substring(any_value(body), min(a) + 1, max(z) - min(a))')} AS c FROM island GROUP BY report_nr, s, ord, h, g),
win AS (SELECT report_nr, s, ord, h, string_agg(c, chr(10) || chr(10) || '...' || chr(10) || chr(10) ORDER BY a) AS w FROM piece WHERE c <> '' GROUP BY ALL),
hit AS (SELECT report_nr, string_agg(h || chr(10) || CASE s WHEN 'epikrise' THEN substring(w, 1, 1000) ELSE w END, chr(10) || chr(10) ORDER BY ord) AS o FROM win GROUP BY 1),
cap AS (SELECT report_nr, any_value(t) AS t, string_agg(h || chr(10) || substring(body, 1, cap), chr(10) || chr(10) ORDER BY ord) FILTER (body <> '') AS o FROM sec GROUP BY 1),
res AS (SELECT cap.report_nr, t, {_TRIM('substring(coalesce(hit.o, cap.o), 1, 8000)')} AS x, hit.o IS NOT NULL AS getroffen FROM cap LEFT JOIN hit ON cap.report_nr = hit.report_nr)"""


@query(f"""WITH {_REDUCED} SELECT report_nr, length(x) AS zeichen, md5(x) AS inhalt, CASE WHEN getroffen THEN 'keyword_windows' ELSE 'fallback_truncation' END AS verfahren, length(t) AS vorher,
CAST({' + '.join(f"(length(lower(t)) - length(replace(lower(t), '{k}', ''))) // {len(k)}" for k in HINTS)} AS INTEGER) AS treffer FROM res""")
def txt15_txt18_kuerzung(spark: SparkSession, d: str) -> DataFrame:
    """Stitched reports reduced to windows of 1000 signs around hints or to the sections' caps, 8000 in all (TXT-15, TXT-16, TXT-18)."""
    r = texts(spark, d).select("report_nr", reduce_report(F.col("t")).alias("x")).filter("x IS NOT NULL")
    return r.select("report_nr", F.length("x.text").alias("zeichen"), F.md5("x.text").alias("inhalt"), F.col("x.method").alias("verfahren"), F.col("x.original_len").alias("vorher"), F.col("x.hits").alias("treffer"))


# ---- snippets

_HALF = "greatest(20, 125 - length(x.term) // 2)"
_RAW = f"{_TRIM(f'replace(substring(t, greatest(x.a - {_HALF}, 0) + 1, least(x.z + {_HALF}, length(t)) - greatest(x.a - {_HALF}, 0)), chr(10), chr(32))')}"
_NAME = "coalesce('[' || " + _cases("list_sort(list_filter(m, lambda y: y.a <= x.a), 'DESC')[1].s", SECTION_NAMES) + " || '] ', '')"
_FLAT = f"""{sql_picked('t', 'report_nr', 't', _HINTS)}, {_MARKS}, one AS (SELECT report_nr, list_transform(s[1:12], lambda x: {_TRIM(f'{_NAME} || {_RAW}')}) AS l FROM picked JOIN t USING (report_nr) LEFT JOIN marks USING (report_nr)),
flat AS (SELECT report_nr, array_to_string(list_transform(l, lambda x: CASE WHEN length(x) > 250 THEN substring(x, 1, 249) || '…' ELSE x END), ' || ') AS f FROM one)"""


@query(f"WITH {_T}, {_FLAT} SELECT t.report_nr, coalesce(f, '') AS stellen FROM t LEFT JOIN flat USING (report_nr)")
def txt19_fenster(spark: SparkSession, d: str) -> DataFrame:
    """Windows around the hint terms of every report as one text (TXT-19)."""
    return texts(spark, d).select("report_nr", flat_snippets(F.col("t")).alias("stellen"))


def _short(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n - 1}) || '…' ELSE {c} END"


_PARTS = f"list_filter(list_transform(string_split(replace(diag, chr(10), '|'), '|'), lambda x: {_TRIM('x')}), lambda x: x <> '')[1:5]"
_TOLD = _TRIM("replace('[Kontext] ' || prozedere, chr(10), ' ')")


@query(f"""WITH {_R}, t AS (SELECT report_nr, epikrise AS t FROM r), {_FLAT}, c AS (SELECT report_nr, CASE WHEN report_nr % 5 = 0 THEN bername END AS da, flat.f, {_PARTS} AS parts, prozedere FROM r LEFT JOIN flat USING (report_nr))
SELECT report_nr, coalesce(CASE WHEN lower(trim(da)) NOT IN ('', 'nan', '[]') THEN trim(da) END, nullif(f, ''), nullif(array_to_string(list_transform(parts, lambda x: {_short("('[Treffer] ' || x)", 120)}), ' || '), ''),
CASE WHEN {' OR '.join(f"contains(lower(prozedere), '{k}')" for k in HINTS)} THEN {_short(_TOLD, 250)} END, '[]') AS zelle FROM c""")
def txt20_zelle(spark: SparkSession, d: str) -> DataFrame:
    """What is there, else windows of the course text, else the diagnoses as signals, else a telling context (TXT-20)."""
    there = F.when(F.pmod("report_nr", F.lit(5)) == 0, F.col("bername"))
    return reports(spark, d).select("report_nr", snippet_cell(there, F.col("epikrise"), F.translate("diag", "\n", "|"), F.col("prozedere")).alias("zelle"))


@query()
def txt21_auszug(spark: SparkSession, d: str) -> DataFrame:
    """Reports that are sent: an excerpt of 300 signs with its terms marked, and the terms by kind (TXT-21)."""
    e = texts(spark, d).select("report_nr", "t", evidence(F.col("t"))["snippets"].alias("s")).filter(F.size("s") > 0)
    return e.select("report_nr", presentation(F.col("t"), F.col("s"), 300).alias("p")).select("report_nr", F.col("p.excerpt").alias("auszug"), F.col("p.terms").alias("begriffe"))


# ---- JSON in text


@query("SELECT event_id, props AS objekt FROM events")
def jsn1_objekt(spark: SparkSession, d: str) -> DataFrame:
    """The first object of an answer with words and turn marks around it (JSN-1)."""
    said = F.concat(F.lit("<start_of_turn>model\nHier: "), "props", F.lit("<end_of_turn> {rest"))
    return table(spark, d, "events").select("event_id", first_objects(said).alias("objekt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn2_antwort(spark: SparkSession, d: str) -> DataFrame:
    """A field of answers in code fences, with words around them, or bare (JSN-2)."""
    form = F.pmod("event_id", F.lit(3))
    said = F.when(form == 0, F.concat(F.lit("```JSON\n"), "props", F.lit("\n```"))).when(form == 1, F.concat(F.lit("Antwort: "), "props", F.lit(" Ende."))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", lenient(said, "k long")["k"].alias("k"))


_ITEMS = f"list_filter(list_transform(string_split(diag, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_ONCE = f"list_filter({_ITEMS}, lambda x, i: list_position(list_transform({_ITEMS}, lambda y: lower(y)), lower(x)) = i)"


@query(f"WITH {_R} SELECT report_nr, array_to_string(coalesce({_ONCE}[1:10], []), '|') AS delir_explizit, CAST(coalesce(len({_ONCE}[1:10]), 0) AS INTEGER) AS alle FROM r")
def jsn3_signale(spark: SparkSession, d: str) -> DataFrame:
    """The six term lists of answers that give the diagnoses' lines twice and no list under another key (JSN-3)."""
    lines = F.split(F.coalesce("diag", F.lit("")), "\n")
    s = reports(spark, d).select("report_nr", signals(F.to_json(F.struct(F.concat(lines, lines).alias("delir_explizit"), F.lit("x").alias("vigilanz")))).alias("s"))
    return s.select("report_nr", F.array_join("s.delir_explizit", "|").alias("delir_explizit"), sum((F.size(f"s.{k}") for k in SIGNALS), F.lit(0)).alias("alle"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'click' THEN 'hoch' ELSE 'niedrig' END AS signalstaerke, CASE WHEN event_type = 'view' THEN event_type ELSE '{NO_CONTEXT}' END AS kontext, event_type = 'signup' AS alternative_erklaerung, CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS INTEGER) AS gruende FROM events""")
def jsn4_deutung(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose fields are out of range or of another type by turns (JSN-4)."""
    kind = F.col("event_type")
    strength = F.when(kind == "click", '"hoch"').when(kind == "view", '"sehr hoch"').when(kind == "error", "3").otherwise("null")
    context = F.when(kind == "view", F.to_json(F.struct(kind.alias("x"))).substr(F.lit(6), F.length(kind) + 2)).otherwise("[1]")
    said = F.concat(F.lit('{"signalstaerke": '), strength, F.lit(', "kontext": '), context, F.lit(', "alternative_erklaerung": '), F.when(kind == "signup", "true").otherwise('"ja"'), F.lit(', "begruendung": '), F.when(kind == "error", '["a", "b"]').otherwise('"a"'), F.lit("}"))
    i = table(spark, d, "events").select("event_id", interpretation(said).alias("i"))
    return i.select("event_id", "i.signalstaerke", "i.kontext", "i.alternative_erklaerung", F.size("i.begruendung").alias("gruende"))


@query(f"WITH {_EVIDENCE}, n AS (SELECT report_nr, sum(priority) AS p, count(*) AS n, string_agg(term, ',' ORDER BY priority) AS b FROM snip GROUP BY 1) SELECT t.report_nr, CAST(coalesce(n, 0) AS INTEGER) AS anzahl, coalesce(b, '') AS begriffe, n IS NULL AS leer FROM t LEFT JOIN n USING (report_nr)")
def jsn5_belege(spark: SparkSession, d: str) -> DataFrame:
    """Snippets written as JSON text and read back (JSN-5)."""
    j = texts(spark, d).select("report_nr", snippets_to_json(evidence(F.col("t"))["snippets"]).alias("j"))
    s = j.select("report_nr", "j", snippets_from_json(F.col("j")).alias("s"))
    return s.select("report_nr", F.size("s").alias("anzahl"), F.array_join(F.transform("s", lambda x: x["term"]), ",").alias("begriffe"), (F.col("j") == "[]").alias("leer"))
