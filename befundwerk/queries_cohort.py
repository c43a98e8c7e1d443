"""Queries of cohorts, samples, overlaps and checks over whole tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from befundwerk.functions.clean import clean_id, flag, strip
from befundwerk.functions.evidence import evidence, flat_snippets
from befundwerk.functions.terms import EXCLUDED_TYPE, HINTS, MATRIX_TYPES, contains_any
from befundwerk.operators import cohort as c
from befundwerk.operators.baseline import id_sets, long_form
from befundwerk.queries_core import sql_id, sql_strip
from befundwerk.queries_ref import _B, _CMP, _IN, _R, _STITCH, _TXT, FIELD_HINTS, FIELDS, _ANY_PLAIN, _num, base, beside, comparison, error_kinds, _ERR, hints, matrix, query, reports, stitched
from befundwerk.queries_text import _EVIDENCE, _FLAT
from befundwerk.session import cut_lineage, table

# ---- baseline as delivered

REQUIRED = ("has_delir_icd10", "max_icdsc", "baseline_icd10", *(f"baseline_icdsc_ge_{t}" for t in range(1, 6)), "baseline_icdsc_0", "baseline_icdsc_1_to_3", "baseline_icdsc_ge_4_grouped", "baseline_composite")
_SB = f"""sb AS (SELECT * FROM (SELECT *, {sql_id('"PatientenID"')} AS pid, row_number() OVER (PARTITION BY {sql_id('"PatientenID"')} ORDER BY baseline_nr) AS rn FROM structured_baseline) WHERE rn = 1)"""


def delivered(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The first delivered baseline row of each patient (SRC-6)."""
    b = table(spark, d, "structured_baseline").select(clean_id("PatientenID").alias("pid"), "baseline_nr", *columns)
    return c.first_rows(b, ["pid"], "baseline_nr")


@query(f"""WITH {_R}, {_SB} SELECT r.typ, CASE WHEN sb.pid IS NULL THEN 'no_structured_baseline_row' WHEN {' OR '.join(f'sb.{x} IS NULL' for x in REQUIRED)} THEN 'incomplete_baseline_columns' ELSE 'auswertbar' END AS grund, count(*) AS n, count(DISTINCT r.pid) AS patienten
FROM r LEFT JOIN sb ON r.pid = sb.pid WHERE {_IN} GROUP BY ALL""")
def jn3_gruende(spark: SparkSession, d: str) -> DataFrame:
    """Evaluable and excluded reports with both reasons: no baseline row, or one with a required column missing (JN-3)."""
    sb = delivered(spark, d, *REQUIRED)
    sb = sb.select("pid", reduce(lambda a, b: a | b, (F.col(x).isNull() for x in REQUIRED)).alias("luecke"))
    j = beside(reports(spark, d).filter(F.col("typ") != EXCLUDED_TYPE).select("report_nr", "pid", "typ"), sb, "left")
    grund = F.when(F.col("luecke").isNull(), "no_structured_baseline_row").when(F.col("luecke"), "incomplete_baseline_columns").otherwise("auswertbar")
    return j.groupBy("typ", grund.alias("grund")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("patienten"))


# ---- spine beside predictions; a prediction is made of the terms in a report's text

_ID = f"coalesce(nullif({sql_strip('bername')}, ''), CASE WHEN typ = '' THEN 'bericht' ELSE typ END || '_' || pid || '_' || report_nr)"
_HINTED = "(" + " OR ".join(f"contains(lower({_STITCH}), '{k}')" for k in HINTS) + ")"
_SPINE = f"""{_R}, sp AS (SELECT * FROM (SELECT report_nr, pid, {_ID} AS bericht, typ, row_number() OVER (PARTITION BY pid, {_ID}, typ ORDER BY report_nr) AS rn FROM r WHERE pid <> '' AND typ IN {MATRIX_TYPES}) WHERE rn = 1),
pr AS (SELECT * FROM (SELECT pid, {_ID} AS bericht, typ, klasse, NOT {_HINTED} AS stumm, contains({_STITCH}, chr(65533)) AS kaputt, contains(lower({_STITCH}), 'prophylaxe') AS vorbeugung, row_number() OVER (PARTITION BY pid, {_ID}, typ ORDER BY report_nr) AS rn FROM r WHERE {_STITCH} <> '' AND {_IN}) WHERE rn = 1),
co AS (SELECT sp.report_nr, sp.typ, coalesce(pr.klasse, 0) AS klasse, CASE WHEN pr.pid IS NULL THEN 'missing_prediction' WHEN stumm THEN 'skipped' WHEN kaputt THEN 'failed' ELSE 'processed' END AS status, CASE WHEN pr.pid IS NULL OR stumm THEN 0 ELSE 1 END AS llm_called,
  CASE WHEN pr.pid IS NULL THEN 'not_in_prediction_export' WHEN stumm THEN 'no_evidence_prefilter_skip' WHEN kaputt THEN 'pipeline_error' WHEN vorbeugung THEN 'prophylaxis_only_not_positive' ELSE 'llm_classification' END AS skipped_reason
  FROM sp LEFT JOIN pr ON sp.pid = pr.pid AND sp.bericht = pr.bericht AND sp.typ = pr.typ)"""
KEYS = ("pid", "bericht", "typ")


def _identified(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d)
    own = F.concat_ws("_", F.when(F.col("typ") == "", "bericht").otherwise(F.col("typ")), "pid", "report_nr")
    return r.select("report_nr", "pid", F.coalesce(F.nullif(strip("bername"), F.lit("")), own).alias("bericht"), "typ", "klasse", stitched().alias("t"))


def spine(spark: SparkSession, d: str) -> DataFrame:
    return _identified(spark, d).filter((F.col("pid") != "") & F.col("typ").isin(*MATRIX_TYPES)).select(*KEYS, "report_nr")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    p = _identified(spark, d).filter(F.col("t").isNotNull() & (F.col("typ") != EXCLUDED_TYPE))
    silent = ~contains_any(F.col("t"), HINTS)
    return p.select(
        *KEYS,
        "report_nr",
        "klasse",
        F.when(silent, "True").otherwise("False").alias("llm_skipped_by_prefilter"),
        F.when(silent, c.NO_EVIDENCE).otherwise("structured_evidence_extraction").alias("llm_text_reduction_method"),
        F.when(silent, c.NO_EVIDENCE).when(F.lower("t").contains("prophylaxe"), "prophylaxis_only_not_positive").otherwise("llm_classification").alias("decision_rule_applied"),
        F.when(F.col("t").contains("�"), c.FAILED + " Zeichen verloren").otherwise("").alias("kontext"),
    )


def cohort(spark: SparkSession, d: str) -> DataFrame:
    return c.spine_with_predictions(spine(spark, d), predictions(spark, d), KEYS, "report_nr")


@query(f"WITH {_SPINE} SELECT report_nr, klasse, status, llm_called, skipped_reason FROM co")
def jn5_prj20_kohorte(spark: SparkSession, d: str) -> DataFrame:
    """Report spine beside predictions by patient, report and type, with defaults and all four states (JN-5, PRJ-20)."""
    return cohort(spark, d).select("report_nr", "klasse", "status", "llm_called", "skipped_reason")


@query(f"""WITH {_SPINE} SELECT 'nur_prognose' AS bereich, count(*) AS n FROM pr WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.pid = pr.pid AND sp.bericht = pr.bericht AND sp.typ = pr.typ)
UNION ALL SELECT 'nur_bericht', count(*) FROM co WHERE status = 'missing_prediction' UNION ALL SELECT 'beide', count(*) FROM co WHERE status <> 'missing_prediction'""")
def jn6_nur(spark: SparkSession, d: str) -> DataFrame:
    """Reports and predictions without a partner (JN-6)."""
    s, p = spine(spark, d), predictions(spark, d)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("bereich"), "n")
    both = s.select(*KEYS).distinct().join(p.select(*KEYS).distinct(), list(KEYS), "left_semi")
    return n(c.only_in(p, s, KEYS), "nur_prognose").unionByName(n(c.only_in(s, p, KEYS), "nur_bericht")).unionByName(n(both, "beide"))


def _top(where: str, name: str, most: int) -> str:
    return f"(SELECT '{name}' AS bereich, skipped_reason AS wert, count(*) AS n FROM co WHERE {where} GROUP BY ALL ORDER BY n DESC, wert LIMIT {most})"


@query(f"""WITH {_SPINE} SELECT 'total' AS bereich, 'rows' AS wert, count(*) AS n FROM co UNION ALL SELECT 'status', status, count(*) FROM co GROUP BY ALL UNION ALL SELECT 'llm_called', CAST(llm_called AS VARCHAR), count(*) FROM co GROUP BY ALL
UNION ALL {_top("status = 'skipped'", 'skipped_reason', 8)} UNION ALL {_top("status = 'processed' AND klasse = 0", 'processed_negative', 5)}""")
def agg49_uebersicht(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the cohort with its leading reasons (AGG-49)."""
    return c.cohort_summary(cohort(spark, d))


# ---- hints

_FH = f"h AS (SELECT pid, {', '.join(f"max(CASE WHEN regexp_matches(lower(coalesce({x}, '')), '{_ANY_PLAIN}') THEN 1 ELSE 0 END) AS {x}" for x in FIELDS)} FROM r GROUP BY pid)"


@query(f"WITH {_R}, {_FH} SELECT *, greatest({', '.join(FIELDS)}) AS irgend FROM h")
def agg15_hinweise(spark: SparkSession, d: str) -> DataFrame:
    """Every patient's hints per field, of all 23 terms, and in any field (AGG-15)."""
    return hints(spark, d, FIELD_HINTS).withColumn("irgend", F.greatest(*FIELDS))


@query(f"WITH {_CMP}, {_FH} SELECT j.klasse, greatest({', '.join('h.' + x for x in FIELDS)}) AS irgend, j.ge_4, count(*) AS n FROM j JOIN h ON j.pid = h.pid WHERE j.da GROUP BY ALL")
def jn9_vergleich(spark: SparkSession, d: str) -> DataFrame:
    """Evaluable reports beside their patient's hints (JN-9)."""
    h = hints(spark, d, FIELD_HINTS).select("pid", F.greatest(*FIELDS).alias("irgend"))
    j = beside(comparison(spark, d).filter("da").select("report_nr", "pid", "klasse", "ge_4"), h)
    return j.groupBy("klasse", "irgend", "ge_4").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_R}, {_B}, t AS (SELECT lower({_TXT}) AS txt, klasse, code_flag, ge_4 FROM r JOIN b ON r.pid = b.pid), k(begriff) AS (VALUES {', '.join(f"('{k}')" for k in HINTS)}), p AS (SELECT round(avg(klasse), 6) AS alle_klasse, round(avg(code_flag), 6) AS alle_code, round(avg(ge_4), 6) AS alle_ge_4 FROM t)
SELECT begriff, count(*) FILTER (contains(txt, begriff)) AS berichte, round(avg(klasse) FILTER (contains(txt, begriff)), 6) AS p_klasse, round(avg(code_flag) FILTER (contains(txt, begriff)), 6) AS p_code, round(avg(ge_4) FILTER (contains(txt, begriff)), 6) AS p_ge_4, any_value(alle_klasse) AS alle_klasse, any_value(alle_code) AS alle_code, any_value(alle_ge_4) AS alle_ge_4 FROM t, k, p GROUP BY begriff""")
def agg19_bedingt(spark: SparkSession, d: str) -> DataFrame:
    """Shares of positives among reports with each term, beside those of all reports (AGG-19); null where no report has it. One scan, nothing exploded."""
    r = reports(spark, d).select("report_nr", "pid", "klasse", F.lower(F.concat_ws(" ", *FIELDS)).alias("txt"))
    j = beside(r.select("report_nr", "pid", "klasse", *(F.col("txt").contains(k).alias(f"_{i}") for i, k in enumerate(HINTS))), base(spark, d).select("pid", "code_flag", "ge_4"))
    goals = {"klasse": "klasse", "code": "code_flag", "ge_4": "ge_4"}
    mean = lambda x: F.round(F.avg(x), 6)
    per = [F.struct(F.lit(k).alias("begriff"), F.count_if(F.col(f"_{i}")).alias("berichte"), *(mean(F.when(F.col(f"_{i}"), F.col(x))).alias(f"p_{n}") for n, x in goals.items())).alias(f"s{i}") for i, k in enumerate(HINTS)]
    a = j.agg(*per, *(mean(x).alias(f"alle_{n}") for n, x in goals.items()))
    return a.select(F.explode(F.array(*(f"s{i}" for i in range(len(HINTS))))).alias("s"), *(f"alle_{n}" for n in goals)).select("s.*", *(f"alle_{n}" for n in goals))


# ---- labels

_LAB = f"l AS (SELECT icdsc_nr AS id, CAST(trunc({_num('\"ICDSC_Max\"')}) AS INTEGER) AS t, nullif({sql_strip('\"ICDSC_Max\"')}, '') AS k FROM icdsc)"


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    co = reports(spark, d).select(F.col("report_nr").alias("id"), F.when(F.pmod("report_nr", F.lit(2)) == 0, F.col("klasse")).alias("truth"), F.col("bername").alias("comment"))
    return c.merge_labels(co, table(spark, d, "icdsc").select(F.col("icdsc_nr").alias("id"), F.col("ICDSC_Max").alias("truth"), F.col("ICDSC_Max").alias("comment")), "id")


@query(f"WITH {_R}, {_LAB} SELECT report_nr AS id, coalesce(CASE WHEN l.t IN (0, 1) THEN l.t END, CASE WHEN report_nr % 2 = 0 THEN klasse END) AS truth, coalesce(l.k, bername) AS comment FROM r LEFT JOIN l ON l.id = report_nr")
def jn13_urteile(spark: SparkSession, d: str) -> DataFrame:
    """Labels 0 and 1 and comments override a cohort's own; repeated label ids fail (JN-13, PRJ-13)."""
    return _labels(spark, d)[0]


@query("SELECT icdsc_nr AS id FROM icdsc WHERE icdsc_nr NOT IN (SELECT report_nr FROM berichte)")
def jn13_unbekannte(spark: SparkSession, d: str) -> DataFrame:
    """Label ids that the cohort lacks (JN-13)."""
    return _labels(spark, d)[1]


# ---- patients for samples

_EV = f"{_EVIDENCE}, ev AS (SELECT r.pid, bool_or(e.has_direct) AS direkt, bool_or(e.has_indirect) AS indirekt, bool_or(e.has_indirect AND NOT e.has_direct) AS pruefen FROM e JOIN r USING (report_nr) WHERE r.typ <> '{EXCLUDED_TYPE}' AND r.pid <> '' GROUP BY 1)"
_PT = f"""{_EV}, {_B}, m AS (SELECT pid, {', '.join(f"coalesce(max(klasse) FILTER (typ = '{t}'), 0) AS {t.lower()}_max, count(*) FILTER (typ = '{t}') AS {t.lower()}_n" for t in MATRIX_TYPES)} FROM r WHERE {_IN} AND pid <> '' GROUP BY pid),
pt AS MATERIALIZED (SELECT m.pid, greatest({', '.join(f'{t.lower()}_max' for t in MATRIX_TYPES)}) AS modell, {' + '.join(f'CAST({t.lower()}_n > 0 AS INTEGER)' for t in MATRIX_TYPES)} AS typen, coalesce(b.ge_4, 0) AS ge_4, coalesce(b.code_flag, 0) AS code_flag, coalesce(b.composite, 0) AS composite,
  ev.direkt, ev.indirekt, ev.pruefen FROM m JOIN ev ON m.pid = ev.pid LEFT JOIN b ON m.pid = b.pid)"""


def patients(spark: SparkSession, d: str) -> DataFrame:
    """One row per patient with reports: model, number of types, baseline flags, and what the evidence holds."""
    e = reports(spark, d).filter((F.col("typ") != EXCLUDED_TYPE) & (F.col("pid") != "")).select("pid", evidence(stitched()).alias("e"))
    ev = e.groupBy("pid").agg(F.bool_or("e.has_direct").alias("direkt"), F.bool_or("e.has_indirect").alias("indirekt"), F.bool_or(F.col("e.has_indirect") & ~F.col("e.has_direct")).alias("pruefen"))
    m = matrix(spark, d).select("pid", F.greatest(*(F.col(f"{t.lower()}_max") for t in MATRIX_TYPES)).alias("modell"), sum((flag(F.col(f"{t.lower()}_n") > 0) for t in MATRIX_TYPES), F.lit(0)).alias("typen"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return m.join(ev, "pid").join(base(spark, d).select("pid", "ge_4", "code_flag", "composite"), "pid", "left").select("pid", "modell", "typen", zero("ge_4"), zero("code_flag"), zero("composite"), "direkt", "indirekt", "pruefen")


#: The eight overlapping groups of a review cohort, in the order of picking.
GROUPS = {
    "model_positive": "modell = 1",
    "model_negative": "modell = 0",
    "icdsc_reference_positive": "ge_4 = 1",
    "icdsc_reference_negative": "ge_4 = 0",
    "icd10_reference_positive": "code_flag = 1",
    "icd10_reference_negative": "code_flag = 0",
    "manual_review": "pruefen",
    "multi_report_types": "typen >= 2",
}
_CATEGORY = "CASE WHEN pruefen AND NOT direkt AND indirekt THEN 'indirect_symptoms_only' WHEN pruefen THEN 'borderline_manual_review' WHEN modell = 1 AND composite = 1 THEN 'TP_composite' WHEN modell = 1 THEN 'FP_composite' WHEN composite = 1 THEN 'FN_composite' ELSE 'TN_composite' END"
CATEGORIES = ("FP_composite", "FN_composite", "TP_composite", "TN_composite", "borderline_manual_review", "indirect_symptoms_only")


def _chain(source: str, key: str, predicates: dict[str, str], each: int, target: int) -> str:
    """CTEs of a sequential pick, one after the other, up to ``wahl``."""
    parts, before = [], []
    for i, (name, p) in enumerate(predicates.items()):
        out = f" AND {key} NOT IN ({' UNION ALL '.join(f'SELECT {key} FROM w{j}' for j in before)})" if before else ""
        parts.append(f"w{i} AS (SELECT {key}, '{name}' AS gruppe, {i} AS nr FROM {source} WHERE {p}{out} ORDER BY {key} LIMIT {each})")
        before.append(i)
    every = " UNION ALL ".join(f"SELECT * FROM w{j}" for j in before)
    rest = f"wr AS (SELECT {key}, 'rest' AS gruppe, {len(before)} AS nr FROM {source} WHERE {key} NOT IN (SELECT {key} FROM ({every})) ORDER BY {key} LIMIT {target})"
    return f"{', '.join(parts)}, {rest}, wahl AS (SELECT {key}, gruppe FROM (SELECT * FROM ({every}) UNION ALL SELECT * FROM wr) ORDER BY nr, {key} LIMIT {target})"


def _frame(spark: SparkSession, rows: list, key: str) -> DataFrame:
    return spark.createDataFrame(rows, f"{key}, gruppe string")


@query(f"WITH {_PT}, {_chain('pt', 'pid', GROUPS, 12, 100)} SELECT pid, gruppe FROM wahl")
def srt4_auswahl(spark: SparkSession, d: str) -> DataFrame:
    """Sequential stratified pick of 100 patients over eight overlapping groups, without repeats, filled in id order (SRT-4)."""
    return _frame(spark, c.sequential_groups(cut_lineage(patients(spark, d)), "pid", GROUPS, 12, 100), "pid string")


def sample(spark: SparkSession, d: str) -> DataFrame:
    p = cut_lineage(patients(spark, d).withColumn("art", F.expr(_CATEGORY)))
    return _frame(spark, c.sequential_groups(p, "pid", {k: f"art = '{k}'" for k in CATEGORIES}, 10, 60), "pid string")


_CAT = f"{_PT}, pk AS MATERIALIZED (SELECT *, {_CATEGORY} AS art FROM pt), {_chain('pk', 'pid', {k: f"art = '{k}'" for k in CATEGORIES}, 10, 60)}"


@query(f"WITH {_CAT} SELECT pid, gruppe FROM wahl")
def srt5_stichprobe_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Sixty patients over six exclusive categories, ten each, filled in id order (SRT-5)."""
    return sample(spark, d)


@query(f"""WITH {_CAT}, {_FLAT.replace('k(term, kind, ord)', 'kf(term, kind, ord)').replace('FROM t, k WHERE', 'FROM t, kf WHERE').replace('places AS', 'fplaces AS').replace('FROM places GROUP', 'FROM fplaces GROUP').replace('lists AS', 'flists AS').replace('FROM lists)', 'FROM flists)').replace('picked AS', 'fpicked AS').replace('FROM picked JOIN', 'FROM fpicked JOIN').replace('marks AS (SELECT', 'fmarks AS (SELECT').replace('LEFT JOIN marks', 'LEFT JOIN fmarks')}
SELECT wahl.pid, gruppe, count(f) FILTER (f <> '') AS belege, coalesce(md5(string_agg(f, ' || ' ORDER BY report_nr) FILTER (f <> '')), '') AS inhalt FROM wahl JOIN r ON r.pid = wahl.pid LEFT JOIN flat USING (report_nr) GROUP BY ALL""")
def jn16_probe(spark: SparkSession, d: str) -> DataFrame:
    """The sample beside all its evidence, joined per patient in order (JN-16, AGG-48)."""
    s = cut_lineage(sample(spark, d))
    own = reports(spark, d).join(F.broadcast(s.select("pid")), "pid", "left_semi").select("pid", "report_nr", flat_snippets(stitched()).alias("f"))
    n = own.filter("f <> ''").groupBy("pid").agg(F.count(F.lit(1)).alias("belege"))
    text = c.concat_by_key(own, "pid", "report_nr", "f", name="alles")
    return s.join(n, "pid", "left").join(text, "pid", "left").select("pid", "gruppe", F.coalesce("belege", F.lit(0)).alias("belege"), F.coalesce(F.md5("alles"), F.lit("")).alias("inhalt"))


# ---- examples

_EX = f"""{_EVIDENCE}, {_B}, x AS MATERIALIZED (SELECT r.report_nr, r.klasse, b.code_flag, b.max_score, b.ge_4, b.composite, CAST(r.klasse = b.composite AS INTEGER) AS gleich, e.has_direct, e.has_indirect, e.prophylaxis_only, e.method FROM r JOIN e USING (report_nr) LEFT JOIN b ON r.pid = b.pid WHERE r.typ <> '{EXCLUDED_TYPE}')"""
EXAMPLES = {
    "clear_direct_delir": "has_direct AND klasse = 1",
    "indirect_borderline": "NOT has_direct AND has_indirect AND klasse = 1",
    "no_evidence_skip": "method = 'no_evidence_prefilter_skip'",
    "baseline_discrepancy": "gleich = 0",
    "prophylaxis_risk": "prophylaxis_only",
}


def example_rows(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d).filter(F.col("typ") != EXCLUDED_TYPE).select("report_nr", "pid", "klasse", evidence(stitched()).alias("e"))
    j = beside(r.select("report_nr", "pid", "klasse", "e.has_direct", "e.has_indirect", "e.prophylaxis_only", "e.method"), base(spark, d).select("pid", "code_flag", "max_score", "ge_4", "composite"), "left")
    return j.withColumn("gleich", (F.col("klasse") == F.col("composite")).cast("int"))


@query(f"WITH {_EX} SELECT report_nr, klasse, code_flag, max_score, ge_4, composite, gleich FROM x")
def jn15_beispielbasis(spark: SparkSession, d: str) -> DataFrame:
    """Predictions beside baseline and comparison, nulls where there is none (JN-15)."""
    return example_rows(spark, d).select("report_nr", "klasse", "code_flag", "max_score", "ge_4", "composite", "gleich")


@query(f"WITH {_EX}, {_chain('x', 'report_nr', EXAMPLES, 1, 5)} SELECT report_nr, gruppe FROM wahl WHERE gruppe <> 'rest'")
def srt6_beispiele(spark: SparkSession, d: str) -> DataFrame:
    """One report per predicate, without repeats (SRT-6)."""
    return _frame(spark, c.examples(cut_lineage(example_rows(spark, d)), "report_nr", EXAMPLES), "report_nr long")


@query(f"WITH {_ERR} SELECT report_nr, pid, wert AS basis, klasse, art FROM e WHERE feld = 'ge_4' AND art IN ('FN', 'FP')")
def agg45_fehlauszug(spark: SparkSession, d: str) -> DataFrame:
    """The reports whose prediction and score baseline differ (AGG-45)."""
    return error_kinds(spark, d).filter("feld = 'ge_4' AND art IN ('FN', 'FP')").select("report_nr", "pid", F.col("wert").alias("basis"), "klasse", "art")


# ---- coverage and overlap

_BI = f"bi AS (SELECT DISTINCT {sql_id('\"PatientID\"')} AS pid FROM berichte), ii AS (SELECT DISTINCT {sql_id('\"PatientID\"')} AS pid FROM icd), si AS (SELECT DISTINCT {sql_id('\"PatientID\"')} AS pid FROM icdsc), ba AS (SELECT {sql_id('\"PatientenID\"')} AS pid, max(has_delir_icd10) AS h, max(max_icdsc) AS m FROM structured_baseline GROUP BY 1)"


def _ids(spark: SparkSession, d: str, t: str, key: str = "PatientID") -> DataFrame:
    return table(spark, d, t).select(clean_id(key).alias("pid")).filter("pid <> ''").distinct()


@query(f"""WITH {_BI}, z AS (SELECT pid, h, m FROM bi LEFT JOIN ba USING (pid) WHERE pid <> '') SELECT count(*) AS patienten, count(*) FILTER (h = 1) AS mit_code, count(*) FILTER (h IS DISTINCT FROM 1) AS ohne_code, count(*) FILTER (m > 0) AS mit_score, count(*) - count(*) FILTER (m > 0) AS ohne_score FROM z""")
def agg24_merkmale(spark: SparkSession, d: str) -> DataFrame:
    """Patients with reports by the flags of their delivered baseline; those without a row count as without (AGG-24). One join of states, no loop over patients."""
    b = table(spark, d, "structured_baseline").groupBy(clean_id("PatientenID").alias("pid")).agg(F.max("has_delir_icd10").alias("h"), F.max("max_icdsc").alias("m"))
    j = _ids(spark, d, "berichte").join(b, "pid", "left")
    code, score = F.coalesce(F.col("h") == 1, F.lit(False)), F.coalesce(F.col("m") > 0, F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("patienten"), F.count_if(code).alias("mit_code"), F.count_if(~code).alias("ohne_code"), F.count_if(score).alias("mit_score"), F.count_if(~score).alias("ohne_score"))


@query(f"""WITH {_BI}, u AS (SELECT 'berichte_ohne_basis' AS liste, pid FROM bi WHERE pid <> '' AND pid NOT IN (SELECT pid FROM ba) UNION ALL SELECT 'basis_ohne_berichte', pid FROM ba WHERE pid <> '' AND pid NOT IN (SELECT pid FROM bi)) SELECT * FROM u""")
def agg23_ohne_partner(spark: SparkSession, d: str) -> DataFrame:
    """The ids on one side only, whole lists (AGG-23)."""
    a, b = _ids(spark, d, "berichte"), _ids(spark, d, "structured_baseline", "PatientenID")
    return c.only_in(a, b, ["pid"]).select(F.lit("berichte_ohne_basis").alias("liste"), "pid").unionByName(c.only_in(b, a, ["pid"]).select(F.lit("basis_ohne_berichte").alias("liste"), "pid"))


@query(f"""WITH {_BI}, v AS (SELECT pid, CAST(pid IN (SELECT pid FROM ii) AS INTEGER) AS icd, CAST(pid IN (SELECT pid FROM si) AS INTEGER) AS icdsc FROM bi WHERE pid <> '') SELECT pid, icd AS has_icd, icdsc AS has_icdsc, greatest(icd, icdsc) AS has_any_signal, icd * icdsc AS has_both_signals, icd * (1 - icdsc) AS is_icd_only, icdsc * (1 - icd) AS is_icdsc_only FROM v""")
def agg28_merkmale(spark: SparkSession, d: str) -> DataFrame:
    """The six flags of every patient with reports (AGG-28)."""
    v = id_sets({t: _ids(spark, d, t) for t in ("berichte", "icd", "icdsc")}).filter("berichte = 1")
    i, s = F.col("icd"), F.col("icdsc")
    return v.select("pid", i.alias("has_icd"), s.alias("has_icdsc"), F.greatest(i, s).alias("has_any_signal"), (i * s).alias("has_both_signals"), (i * (1 - s)).alias("is_icd_only"), (s * (1 - i)).alias("is_icdsc_only"))


_VENN = {
    "n_patients": "true",
    "icd10_delir": "a",
    "icdsc_delir_ge4": "s",
    "text_delir": "t",
    "icd10_and_icdsc": "a AND s",
    "icd10_and_text": "a AND t",
    "icdsc_and_text": "s AND t",
    "all_three": "a AND s AND t",
    "icd10_only": "a AND NOT s AND NOT t",
    "icdsc_only": "s AND NOT a AND NOT t",
    "text_only": "t AND NOT a AND NOT s",
    "icd10_icdsc_only": "a AND s AND NOT t",
    "icd10_text_only": "a AND t AND NOT s",
    "icdsc_text_only": "s AND t AND NOT a",
    "none_positive": "NOT a AND NOT s AND NOT t",
}
_DELIR = "contains(lower(concat_ws(' ', diag, epikrise, jetziges_leiden, prozedere)), 'delir')"


@query(f"""WITH {_R}, {_B}, x AS (SELECT pid, bool_or({_DELIR}) AS t FROM r GROUP BY 1), v AS (SELECT coalesce(code_flag = 1, false) AS a, coalesce(max_score >= 4, false) AS s, coalesce(t, false) AS t FROM b FULL JOIN x ON b.pid = x.pid) """ + " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({p}) AS n FROM v" for k, p in _VENN.items()))
def agg29_metriken(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen counts of three overlapping sets, in one pass (AGG-29)."""
    x = reports(spark, d).select("pid", F.lower(F.concat_ws(" ", *FIELDS)).contains("delir").alias("t")).groupBy("pid").agg(F.bool_or("t").alias("t"))
    no = F.lit(False)
    v = base(spark, d).select("pid", (F.col("code_flag") == 1).alias("a"), (F.col("max_score") >= 4).alias("s")).join(x, "pid", "outer").select(F.coalesce("a", no).alias("a"), F.coalesce("s", no).alias("s"), F.coalesce("t", no).alias("t"))
    return long_form(v.agg(*(F.count_if(F.expr(p)).alias(k) for k, p in _VENN.items())), [], list(_VENN), "metric", "n")


_TABLES = {"berichte": "PatientID", "icd": "PatientID", "icdsc": "PatientID", "structured_baseline": "PatientenID"}


@query(" UNION ALL ".join(f"""SELECT '{t}' AS dataset, count(*) AS zeilen, (SELECT count(*) FROM (DESCRIBE {t})) AS spalten, count(DISTINCT nullif({sql_id(f'"{k}"')}, '')) AS patienten FROM {t}""" for t, k in _TABLES.items()))
def agg32_tabellen(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and distinct patients of all four tables (AGG-26, AGG-32); empty ids are none."""
    one = lambda t, k: table(spark, d, t).agg(F.count(F.lit(1)).alias("zeilen"), F.lit(len(table(spark, d, t).columns)).cast("bigint").alias("spalten"), F.count_distinct(F.nullif(clean_id(k), F.lit(""))).alias("patienten")).withColumn("dataset", F.lit(t))
    return reduce(DataFrame.unionByName, (one(t, k) for t, k in _TABLES.items()))


# Words that the first tokenizer leaves out.
STOP = ("und", "oder", "bei", "der", "die", "das", "mit", "auf", "von", "ein", "eine", "ist", "im", "in", "zu", "zur", "zum", "den", "des", "dem", "als", "nach", "ohne", "durch", "nicht", "keine", "klinisch", "patient", "patientin", "status")
_WORD3 = "[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß-]{2,}"
_TOP = lambda name, most: f"(SELECT '{name}' AS art, wort, count(*) AS n FROM {name} GROUP BY 2 ORDER BY n DESC, wort LIMIT {most})"


@query(f"""WITH {_R}, t AS (SELECT lower({_STITCH}) AS t FROM r), woerter AS (SELECT * FROM (SELECT unnest(regexp_extract_all(t, '{_WORD3}')) AS wort FROM t) WHERE length(wort) >= 4 AND wort NOT IN {STOP}),
buchstaben AS (SELECT unnest(regexp_extract_all(t, '[A-Za-zÄÖÜäöüß]{{2,}}')) AS wort FROM t), stuecke AS (SELECT * FROM (SELECT unnest(regexp_split_to_array(t, '\\s+')) AS wort FROM t) WHERE wort <> '') {_TOP('woerter', 100)} UNION ALL {_TOP('buchstaben', 200)} UNION ALL {_TOP('stuecke', 20)}""")
def agg33_zerlegungen(spark: SparkSession, d: str) -> DataFrame:
    """The leading tokens of three tokenizers over the whole report: words without stop words, letters, white space (AGG-33); ties by the token."""
    t = reports(spark, d).select(F.lower(stitched()).alias("t"))
    all_of = lambda p: F.explode(F.regexp_extract_all("t", F.lit(f"({p})"), 1)).alias("wort")
    kinds = (
        ("woerter", t.select(all_of(_WORD3)).filter((F.length("wort") >= 4) & ~F.col("wort").isin(*STOP)), 100),
        ("buchstaben", t.select(all_of("[A-Za-zÄÖÜäöüß]{2,}")), 200),
        ("stuecke", t.select(F.explode(F.split("t", r"[ \t\n\f\r]+")).alias("wort")).filter("wort <> ''"), 20),
    )
    return reduce(DataFrame.unionByName, (c.top_terms(w, n).select(F.lit(k).alias("art"), "wort", "n") for k, w, n in kinds))


@query(f"""WITH {_R}, t AS (SELECT {_STITCH} AS t FROM r) SELECT count(*) AS berichte, round(avg(length(t)), 6) AS zeichen, CAST(quantile_cont(length(t), 0.5) AS DOUBLE) AS median, round(avg(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))), 6) AS woerter, CAST(max(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))) AS INTEGER) AS meist FROM t""")
def agg42_laengen(spark: SparkSession, d: str) -> DataFrame:
    """Signs and words of the stitched reports; one without text has none (AGG-42)."""
    t = reports(spark, d).select(F.coalesce(stitched(), F.lit("")).alias("t")).select(F.length("t").alias("z"), F.size(F.filter(F.split("t", r"[ \t\n\f\r]+"), lambda x: x != "")).alias("w"))
    return t.agg(F.count(F.lit(1)).alias("berichte"), F.round(F.avg("z"), 6).alias("zeichen"), F.percentile("z", 0.5).alias("median"), F.round(F.avg("w"), 6).alias("woerter"), F.max("w").alias("meist"))


@query(f"""(SELECT 'wert' AS art, coalesce({sql_strip('icd_code')}, '') AS eintrag, count(*) AS n FROM icd GROUP BY 2 ORDER BY n DESC, eintrag LIMIT 30) UNION ALL SELECT 'parameter', coalesce({sql_strip('icd_hd')}, ''), count(*) FROM icd GROUP BY 2 UNION ALL SELECT 'stunde', CAST(hour(kodiert_am) AS VARCHAR), count(*) FROM icd GROUP BY 2 UNION ALL SELECT 'tag', dayname(kodiert_am), count(*) FROM icd GROUP BY 2""")
def agg40_eintraege(spark: SparkSession, d: str) -> DataFrame:
    """The thirty leading values, all parameters, hours and weekdays of the entries (AGG-40)."""
    i = table(spark, d, "icd")
    n = lambda k, x: i.groupBy(x.alias("eintrag")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("art"), "eintrag", "n")
    top = n("wert", F.coalesce(strip("icd_code"), F.lit(""))).orderBy(F.desc("n"), "eintrag").limit(30)
    return top.unionByName(n("parameter", F.coalesce(strip("icd_hd"), F.lit("")))).unionByName(n("stunde", F.hour("kodiert_am").cast("string"))).unionByName(n("tag", F.date_format("kodiert_am", "EEEE")))


@query(f"WITH {_CMP}, x AS (SELECT j.da, {_DELIR} AS hinweis FROM j JOIN r USING (report_nr)) SELECT count(*) AS prognosen, count(*) FILTER (da) AS zugeordnet, count(*) FILTER (NOT da) AS offen, count(*) FILTER (NOT da AND hinweis) AS offen_mit_hinweis, count(*) FILTER (da AND hinweis) AS zugeordnet_mit_hinweis FROM x")
def agg46_zuordnung(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with and without a baseline row, and those with a hint in the text (AGG-46)."""
    r = reports(spark, d).filter((F.col("pid") != "") & (F.col("typ") != EXCLUDED_TYPE)).select("report_nr", "pid", F.lower(F.concat_ws(" ", *FIELDS)).contains("delir").alias("h"))
    j = beside(r, base(spark, d).select("pid", F.lit(True).alias("da")), "left").withColumn("da", F.coalesce("da", F.lit(False)))
    da, h = F.col("da"), F.col("h")
    return j.agg(F.count(F.lit(1)).alias("prognosen"), F.count_if(da).alias("zugeordnet"), F.count_if(~da).alias("offen"), F.count_if(~da & h).alias("offen_mit_hinweis"), F.count_if(da & h).alias("zugeordnet_mit_hinweis"))


@query(f"WITH {_R} SELECT pid, count(*) AS berichte, md5(string_agg({_STITCH}, chr(10) || chr(10) ORDER BY ts NULLS LAST, report_nr)) AS inhalt FROM r WHERE pid <> '' AND {_STITCH} <> '' GROUP BY 1")
def agg3_patiententext_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Every patient's whole text in order of the reports' dates, undated ones last (AGG-3). Joined in ranges of a patient's positions, so no task sorts a hot patient."""
    from befundwerk.operators.skew import rank_within

    r = reports(spark, d).filter("pid <> ''").select("report_nr", "pid", "ts", stitched().alias("t")).filter("t IS NOT NULL")
    undated = F.when(F.col("ts").isNull(), F.floor(F.col("report_nr") / 4096))
    ranked = rank_within(r, ["pid"], [F.to_date("ts"), undated], [F.col("ts").asc_nulls_last(), F.col("report_nr")])
    n = ranked.groupBy("pid").agg(F.count(F.lit(1)).alias("berichte"))
    return n.join(c.concat_by_key(ranked, "pid", "lfd", "t", "\n\n", "text"), "pid").select("pid", "berichte", F.md5("text").alias("inhalt"))


@query(f"""SELECT {sql_id('"PatientID"')} AS pid, string_agg({sql_strip('icd_code')}, chr(10) ORDER BY kodiert_am NULLS LAST, icd_nr) AS codes FROM icd WHERE {sql_strip('icd_code')} <> '' GROUP BY 1""")
def agg4_verlauf(spark: SparkSession, d: str) -> DataFrame:
    """Every patient's entries in order of time, one a line, blank ones left out (AGG-4)."""
    from befundwerk.operators.skew import rank_within

    i = table(spark, d, "icd").select(clean_id("PatientID").alias("pid"), "icd_nr", "kodiert_am", strip("icd_code").alias("code")).filter("code <> ''")
    ranked = rank_within(i, ["pid"], F.to_date("kodiert_am"), [F.col("kodiert_am").asc_nulls_last(), F.col("icd_nr")])
    return c.concat_by_key(ranked, "pid", "lfd", "code", "\n", "codes")


# ---- checks of the inputs

_SAMPLE = lambda a, b: f"SELECT array_to_string((list(pid ORDER BY pid))[1:20], ',') || CASE WHEN count(*) > 20 THEN '...' ELSE '' END AS d, count(*) AS n FROM (SELECT pid FROM {a} WHERE pid <> '' AND pid NOT IN (SELECT pid FROM {b}))"


@query(f"""WITH {_BI} SELECT 'berichte_row_count' AS pruefung, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warn' END AS status, count(*) AS wert, '' AS beispiele FROM berichte
UNION ALL SELECT 'berichte_missing_patientenid', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'fail' END, count(*), '' FROM berichte WHERE {sql_id('"PatientID"')} = ''
UNION ALL SELECT 'structured_baseline_duplicate_patientenid', CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END, n, '' FROM (SELECT count(*) - count(DISTINCT {sql_id('"PatientenID"')}) AS n FROM structured_baseline)
UNION ALL SELECT 'patient_id_set_size_berichte', 'ok', count(*), '' FROM bi WHERE pid <> '' UNION ALL SELECT 'patient_id_set_size_icd10', 'ok', count(*), '' FROM ii WHERE pid <> '' UNION ALL SELECT 'patient_id_set_size_icdsc', 'ok', count(*), '' FROM si WHERE pid <> ''
UNION ALL SELECT 'patient_ids_berichte_not_in_icd10', CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END, n, coalesce(d, '') FROM ({_SAMPLE('bi', 'ii')}) UNION ALL SELECT 'patient_ids_icd10_not_in_berichte', CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END, n, coalesce(d, '') FROM ({_SAMPLE('ii', 'bi')})
UNION ALL SELECT 'patient_ids_icdsc_not_in_berichte', CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END, n, coalesce(d, '') FROM ({_SAMPLE('si', 'bi')})
UNION ALL SELECT 'patient_ids_in_berichte_icd10_icdsc', 'ok', count(*), '' FROM bi WHERE pid <> '' AND pid IN (SELECT pid FROM ii) AND pid IN (SELECT pid FROM si)
UNION ALL SELECT 'structured_baseline_row_count', 'ok', count(*), '' FROM structured_baseline UNION ALL SELECT 'baseline_icd10_positive', 'ok', count(*), '' FROM structured_baseline WHERE baseline_icd10 = 1 UNION ALL SELECT 'baseline_icdsc_ge_4_positive', 'ok', count(*), '' FROM structured_baseline WHERE baseline_icdsc_ge_4 = 1
UNION ALL SELECT 'reference_class_' || baseline_reference_class, 'ok', count(*), '' FROM structured_baseline WHERE baseline_reference_class IS NOT NULL GROUP BY ALL""")
def agg50_pruefungen_ganz(spark: SparkSession, d: str) -> DataFrame:
    """All checks of the inputs with ok, warn or fail, and the first twenty ids of a difference (AGG-50)."""
    b, sb = table(spark, d, "berichte"), table(spark, d, "structured_baseline")
    ids = {t: _ids(spark, d, t) for t in ("berichte", "icd", "icdsc")}
    v = id_sets(ids)
    n = F.col("n")

    def row(df: DataFrame, name: str, status: object, note: object = "") -> DataFrame:
        return df.select(F.lit(name).alias("pruefung"), (status if not isinstance(status, str) else F.lit(status)).alias("status"), n.cast("bigint").alias("wert"), (note if not isinstance(note, str) else F.lit(note)).alias("beispiele"))

    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    bad = lambda word: F.when(n == 0, "ok").otherwise(word)
    rows = [row(count(b), "berichte_row_count", F.when(n > 0, "ok").otherwise("warn")), row(count(b.filter(clean_id("PatientID") == "")), "berichte_missing_patientenid", bad("fail"))]
    rows.append(row(sb.agg((F.count(F.lit(1)) - F.count_distinct(clean_id("PatientenID"))).alias("n")), "structured_baseline_duplicate_patientenid", bad("fail")))
    sizes = v.agg(*(F.sum(t).alias(t) for t in ids), F.count_if((F.col("berichte") == 1) & (F.col("icd") == 1) & (F.col("icdsc") == 1)).alias("alle"))
    for t, name in (("berichte", "patient_id_set_size_berichte"), ("icd", "patient_id_set_size_icd10"), ("icdsc", "patient_id_set_size_icdsc"), ("alle", "patient_ids_in_berichte_icd10_icdsc")):
        rows.append(row(sizes.select(F.coalesce(t, F.lit(0)).alias("n")), name, "ok"))
    for a, z, name in (("berichte", "icd", "patient_ids_berichte_not_in_icd10"), ("icd", "berichte", "patient_ids_icd10_not_in_berichte"), ("icdsc", "berichte", "patient_ids_icdsc_not_in_berichte")):
        rows.append(row(c.id_sample(v.filter((F.col(a) == 1) & (F.col(z) == 0))), name, bad("warn"), F.col("beispiele")))
    rows += [row(count(sb), "structured_baseline_row_count", "ok"), row(count(sb.filter("baseline_icd10 = 1")), "baseline_icd10_positive", "ok"), row(count(sb.filter("baseline_icdsc_ge_4 = 1")), "baseline_icdsc_ge_4_positive", "ok")]
    classes = sb.filter("baseline_reference_class IS NOT NULL").groupBy("baseline_reference_class").agg(F.count(F.lit(1)).alias("n"))
    rows.append(classes.select(F.concat(F.lit("reference_class_"), F.col("baseline_reference_class").cast("string")).alias("pruefung"), F.lit("ok").alias("status"), n.alias("wert"), F.lit("").alias("beispiele")))
    return reduce(DataFrame.unionByName, rows)
