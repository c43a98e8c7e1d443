"""Queries of the report, baseline, comparison and cohort operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from befundwerk.functions.clean import clean_id, clean_label, flag, number, parse_date, strip, truthy
from befundwerk.functions.schema import fold, require, shorten, with_defaults
from befundwerk.functions.terms import EXCLUDED_TYPE, HINTS, MATRIX_TYPES, SECTIONS, STEMS, WORD_PATTERNS, contains_any, occurrences, word_match
from befundwerk.operators.baseline import baseline, code_flags, confusion, id_sets, long_form, main_diagnosis, max_scores, odds, valid_code
from befundwerk.operators.orphans import HOT_SHARE
from befundwerk.operators.skew import heavy_keys, rank_within, salted_join, states
from befundwerk.queries_core import sql_id, sql_label, sql_strip
from befundwerk.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

FIELDS = ("diag", "epikrise", "jetziges_leiden", "prozedere")
FLAGS = ("code_flag", "ge_1", "ge_2", "ge_3", "ge_4", "ge_5", "composite")


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def text_of(c: str) -> Column:
    """A text field's content: null for null, blank and nan."""
    s = strip(c)
    return F.when((s != "") & (F.lower(s) != "nan"), s)


def big(c: Column, name: str) -> Column:
    return c.cast("bigint").alias(name)


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports with clean id, type and date, their texts, and a prediction from the terms."""
    b = table(spark, d, "berichte")
    hay = F.lower(F.concat_ws(" ", text_of("diag"), text_of("epikrise"), text_of("jetziges_leiden")))
    return b.select("report_nr", clean_id("PatientID").alias("pid"), clean_label("bertyp").alias("typ"), parse_date("berdat").alias("ts"), "bername", "eingang", *(text_of(c).alias(c) for c in FIELDS), flag(hay.contains("delir") & ~hay.contains("kein delir")).alias("klasse"))


def base(spark: SparkSession, d: str) -> DataFrame:
    b = baseline(table(spark, d, "icd"), table(spark, d, "icdsc"))
    return b.withColumn("code_flag", F.col("has_code"))


def beside(rows: DataFrame, keyed: DataFrame, how: str = "inner") -> DataFrame:
    """Report rows joined with one row per patient, the rows of hot patients spread over tasks."""
    hot = heavy_keys(states(rows.select("pid"), ["pid"]), "pid", HOT_SHARE)
    return salted_join(rows, keyed, "pid", hot, F.col("report_nr"), how=how)


# ---- SQL building blocks


def _text(c: str) -> str:
    s = sql_strip(c)
    return f"(CASE WHEN {s} <> '' AND lower({s}) <> 'nan' THEN {s} END)"


def _num(c: str) -> str:
    s = sql_strip(c)
    return f"(CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({s} AS DOUBLE) END)"


_DATE = "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match({sql_strip('berdat')}, '{p}') THEN try_strptime({sql_strip('berdat')}, '{f}') END" for f, p in (("%Y-%m-%d %H:%M:%S", "[0-9]{4}-.*:.*:.*"), ("%Y-%m-%d %H:%M", "[0-9]{4}-.*:.*"), ("%Y-%m-%d", "[0-9]{4}-.*"), ("%d.%m.%Y", ".*[.][0-9]{4}"), ("%d.%m.%y", ".*[.][0-9]{2}"), ("%Y/%m/%d", "[0-9]{4}/.*"))) + ")"
_HAY = f"lower(concat_ws(' ', {_text('diag')}, {_text('epikrise')}, {_text('jetziges_leiden')}))"
_R = f"""r AS (SELECT report_nr, {sql_id('"PatientID"')} AS pid, {sql_label('bertyp')} AS typ, {_DATE} AS ts, bername, eingang, {', '.join(f'{_text(c)} AS {c}' for c in FIELDS)},
  CASE WHEN contains({_HAY}, 'delir') AND NOT contains({_HAY}, 'kein delir') THEN 1 ELSE 0 END AS klasse FROM berichte)"""
_OK = f"coalesce(upper({sql_strip('icd_code')}) IN ('F05.0', 'F05.8', 'F05.9'), false)"
_MAIN = f"(coalesce(CAST(trunc({_num('icd_hd')}) AS INTEGER) = 1, false) OR coalesce({sql_strip('icd_hd')} IN ('1', 'True', 'true', 'JA', 'Ja', 'ja'), false))"
_C = f"""c AS (SELECT {sql_id('"PatientID"')} AS pid, max(CASE WHEN {_OK} AND {_MAIN} THEN 1 ELSE 0 END) AS has_code,
  coalesce(array_to_string(list_sort(list(DISTINCT {sql_strip('icd_code')}) FILTER ({_OK})), ' | '), '') AS codes FROM icd GROUP BY 1)"""
_SC = f"""s AS (SELECT {sql_id('"PatientID"')} AS pid, max(coalesce({_num('"ICDSC_Max"')}, 0.0)) AS max_score, count(*) FILTER ({_num('"ICDSC_Max"')} IS NULL) AS bad FROM icdsc GROUP BY 1)"""
_B = f"""{_C}, {_SC}, b0 AS (SELECT coalesce(c.pid, s.pid) AS pid, coalesce(has_code, 0) AS has_code, coalesce(max_score, 0.0) AS max_score, coalesce(codes, '') AS codes FROM c FULL JOIN s ON c.pid = s.pid),
b AS (SELECT *, has_code AS code_flag, {', '.join(f'CAST(max_score >= {t} AS INTEGER) AS ge_{t}' for t in range(1, 6))}, CAST(max_score = 0 AS INTEGER) AS eq_0,
  CAST(max_score BETWEEN 1 AND 3 AS INTEGER) AS mid_1_3, CAST(has_code = 1 AND max_score >= 4 AS INTEGER) AS composite,
  CASE WHEN has_code = 1 OR max_score >= 6 THEN 2 WHEN max_score >= 4 THEN 1 ELSE 0 END AS class_3 FROM b0)"""
_IN = f"typ <> '{EXCLUDED_TYPE}'"


def _long(src: str, keep: str, cols: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feld, {c} AS wert FROM {src}" for c in cols)


def _metrics(src: str, by: str, truth: str, predicted: str) -> str:
    return f"""m AS (SELECT {by}, count(*) FILTER ({truth} = 1 AND {predicted} = 1) AS tp, count(*) FILTER ({truth} <> 1 AND {predicted} <> 1) AS tn, count(*) FILTER ({truth} <> 1 AND {predicted} = 1) AS fp, count(*) FILTER ({truth} = 1 AND {predicted} <> 1) AS fn FROM {src} GROUP BY ALL)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy FROM m"""


def _odds(src: str, by: str, e: str, o: str) -> str:
    return f"""m AS (SELECT {by}, count(*) FILTER ({e} = 1 AND {o} = 1) AS a, count(*) FILTER ({e} = 1 AND {o} <> 1) AS b, count(*) FILTER ({e} <> 1 AND {o} = 1) AS c, count(*) FILTER ({e} <> 1 AND {o} <> 1) AS d FROM {src} GROUP BY ALL)
SELECT *, round((a + k) * (d + k) / ((b + k) * (c + k)), 6) AS odds_ratio FROM (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS k FROM m)""".replace("SELECT *, round((a", "SELECT * EXCLUDE k, round((a")


def _word(c: str) -> str:
    alt = "|".join([*WORD_PATTERNS, *(s + "[a-zäöüß]*" for s in STEMS)])
    return f"coalesce(regexp_matches(lower({c}), '(^|[^0-9a-z_äöüß])({alt})($|[^0-9a-z_äöüß])'), false)"


# ---- projections (PRJ)


@query(f"""SELECT icd_nr, {sql_id('"PatientID"')} AS pid, {_MAIN} AS haupt, {_OK} AS gueltig, upper({sql_strip('icd_code')}) AS code FROM icd""")
def prj1_prj5_prj6_codes(spark: SparkSession, d: str) -> DataFrame:
    """Clean id, main mark and code list membership of every code row."""
    return table(spark, d, "icd").select("icd_nr", clean_id("PatientID").alias("pid"), main_diagnosis("icd_hd").alias("haupt"), valid_code("icd_code").alias("gueltig"), F.upper(strip("icd_code")).alias("code"))


@query(f"""SELECT typ, count(*) AS berichte, count(*) FILTER ({_IN}) AS ohne_ausschluss, count(*) FILTER (typ IN {MATRIX_TYPES}) AS in_matrix FROM (SELECT CASE WHEN {sql_label('bertyp')} = '' THEN 'unknown' ELSE {sql_label('bertyp')} END AS typ FROM berichte) GROUP BY 1""")
def prj7_prj8_prj9_typen(spark: SparkSession, d: str) -> DataFrame:
    """Report types, empty ones as unknown, with exclusion and matrix counts."""
    t = clean_label("bertyp")
    return table(spark, d, "berichte").select(F.when(t == "", "unknown").otherwise(t).alias("typ")).groupBy("typ").agg(F.count(F.lit(1)).alias("berichte"), F.count_if(F.col("typ") != EXCLUDED_TYPE).alias("ohne_ausschluss"), F.count_if(F.col("typ").isin(*MATRIX_TYPES)).alias("in_matrix"))


@query(f"""SELECT icdsc_nr, {_num('"ICDSC_Max"')} AS zahl, CAST(trunc(coalesce({_num('"ICDSC_Max"')}, 0)) AS INTEGER) AS ganz, CAST(least(greatest(trunc(coalesce({_num('"ICDSC_Max"')}, 0)), 0), 1) AS INTEGER) AS bit,
coalesce(lower({sql_strip('"ICDSC_Max"')}) IN ('1', 'true', 'yes'), false) AS ja, CASE WHEN CAST(trunc({_num('"ICDSC_Max"')}) AS INTEGER) IN (0, 1) THEN CAST(trunc({_num('"ICDSC_Max"')}) AS INTEGER) END AS marke FROM icdsc""")
def prj11_prj12_prj13_zahlen(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, whole numbers, bits, yes marks and 0/1 labels from score cells."""
    n = number("ICDSC_Max")
    whole = F.coalesce(n, F.lit(0.0)).cast("int")
    return table(spark, d, "icdsc").select("icdsc_nr", n.alias("zahl"), whole.alias("ganz"), F.least(F.greatest(whole, F.lit(0)), F.lit(1)).alias("bit"), truthy("ICDSC_Max").alias("ja"), F.when(n.cast("int").isin(0, 1), n.cast("int")).alias("marke"))


@query(f"WITH {_B} SELECT * FROM b")
def jn1_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The patient baseline of both sources with all thresholds (AGG-1, AGG-2, JN-1, PRJ-14, PRJ-15, PRJ-16)."""
    return base(spark, d)


@query(f"WITH {_C} SELECT * FROM c")
def agg1_codes(spark: SparkSession, d: str) -> DataFrame:
    return code_flags(table(spark, d, "icd"))


@query(f"WITH {_SC} SELECT * FROM s")
def agg2_scores(spark: SparkSession, d: str) -> DataFrame:
    return max_scores(table(spark, d, "icdsc"))


@query(f"""SELECT baseline_nr, coalesce(baseline_icdsc_ge_4, CAST(coalesce(max_icdsc, 0) >= 4 AS INTEGER)) AS ge_4 FROM structured_baseline""")
def prj21_fuellen(spark: SparkSession, d: str) -> DataFrame:
    """A missing flag derived from the score."""
    return table(spark, d, "structured_baseline").select("baseline_nr", F.coalesce("baseline_icdsc_ge_4", flag(F.coalesce("max_icdsc", F.lit(0.0)) >= 4)).alias("ge_4"))


_STITCH = "concat_ws(chr(10) || chr(10), " + ", ".join(f"'{h}' || chr(10) || {c}" for h, c in SECTIONS) + ")"


def stitched() -> Column:
    """The report's sections under their headings; null if it has none."""
    t = F.concat_ws("\n\n", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(h + "\n"), F.col(c))) for h, c in SECTIONS))
    return F.when(t != "", t)


@query(f"""WITH {_R} SELECT report_nr, md5({_STITCH}) AS inhalt, length({_STITCH}) AS zeichen, coalesce(nullif({sql_strip('bername')}, ''), CASE WHEN typ = '' THEN 'bericht' ELSE typ END || '_' || pid || '_' || report_nr) AS kennung FROM r WHERE {_STITCH} <> ''""")
def prj17_prj18_text(spark: SparkSession, d: str) -> DataFrame:
    """Stitched text per report, as digest and length, with a fallback identifier."""
    r = reports(spark, d).withColumn("t", stitched()).filter("t IS NOT NULL")
    own = F.concat_ws("_", F.when(F.col("typ") == "", "bericht").otherwise(F.col("typ")), "pid", "report_nr")
    return r.select("report_nr", F.md5("t").alias("inhalt"), big(F.length("t"), "zeichen"), F.coalesce(F.nullif(strip("bername"), F.lit("")), own).alias("kennung"))


# ---- joins (JN)

_CMP = f"{_R}, {_B}, j AS (SELECT r.report_nr, r.pid, r.typ, r.klasse, b.pid IS NOT NULL AS da, {', '.join('b.' + c for c in FLAGS)} FROM r LEFT JOIN b ON r.pid = b.pid WHERE r.pid <> '' AND {_IN})"


def comparison(spark: SparkSession, d: str, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """Reports that count, beside the baseline of their patient (JN-2); few columns of few patients are on the right."""
    r = reports(spark, d).filter((F.col("pid") != "") & (F.col("typ") != EXCLUDED_TYPE)).select("report_nr", "pid", "typ", "klasse")
    return beside(r, base(spark, d).select("pid", *flags, F.lit(True).alias("da")), "left").withColumn("da", F.coalesce("da", F.lit(False)))


@query(f"WITH {_CMP} SELECT report_nr, pid, klasse, da, {', '.join(f'CAST(klasse = {c} AS INTEGER) AS gleich_{c}' for c in FLAGS)} FROM j")
def jn2_prj25_vergleich(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each report with each baseline; null without a baseline row (PRJ-24, PRJ-25)."""
    return comparison(spark, d).select("report_nr", "pid", "klasse", "da", *((F.col("klasse") == F.col(c)).cast("int").alias(f"gleich_{c}") for c in FLAGS))


_MX = f"""{_R}, {_B}, m AS (SELECT pid, {', '.join(f"coalesce(max(klasse) FILTER (typ = '{t}'), 0) AS {t.lower()}_max, count(*) FILTER (typ = '{t}') AS {t.lower()}_n" for t in MATRIX_TYPES)}, max(klasse) AS irgend FROM r WHERE {_IN} AND pid <> '' GROUP BY pid)"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d).filter((F.col("typ") != EXCLUDED_TYPE) & (F.col("pid") != ""))
    per = [x for t in MATRIX_TYPES for x in (F.coalesce(F.max(F.when(F.col("typ") == t, F.col("klasse"))), F.lit(0)).alias(f"{t.lower()}_max"), F.count_if(F.col("typ") == t).alias(f"{t.lower()}_n"))]
    return r.groupBy("pid").agg(*per, F.max("klasse").alias("irgend"))


@query(f"""WITH {_MX} SELECT coalesce(m.pid, b.pid) AS pid, {', '.join(f"coalesce({t.lower()}_max, 0) AS {t.lower()}_max, coalesce({t.lower()}_n, 0) AS {t.lower()}_n" for t in MATRIX_TYPES)}, coalesce(irgend, 0) AS irgend,
coalesce(greatest({', '.join(f'{t.lower()}_max' for t in MATRIX_TYPES)}), 0) AS modell, coalesce(ge_4, 0) AS ge_4, CAST(coalesce(greatest({', '.join(f'{t.lower()}_max' for t in MATRIX_TYPES)}), 0) <> coalesce(ge_4, 0) AS INTEGER) AS abweichung FROM m FULL JOIN b ON m.pid = b.pid""")
def jn4_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Patient by report type: one grouping and one outer join (AGG-5, AGG-6, AGG-7, PRJ-24)."""
    j = matrix(spark, d).join(base(spark, d).select("pid", "ge_4"), "pid", "outer").fillna(0)
    model = F.greatest(*(F.col(f"{t.lower()}_max") for t in MATRIX_TYPES))
    return j.select("pid", *(f"{t.lower()}_{x}" for t in MATRIX_TYPES for x in ("max", "n")), "irgend", model.alias("modell"), "ge_4", flag(model != F.col("ge_4")).alias("abweichung"))


@query(f"""WITH i AS (SELECT {sql_id('"PatientID"')} AS pid FROM icd), s AS (SELECT {sql_id('"PatientID"')} AS pid FROM icdsc) SELECT count(*) AS zeilen, count(DISTINCT pid) AS patienten FROM i WHERE pid NOT IN (SELECT pid FROM s)""")
def jn6_anti(spark: SparkSession, d: str) -> DataFrame:
    """Code rows of patients without scores."""
    s = table(spark, d, "icdsc").select(clean_id("PatientID").alias("pid")).distinct()
    return table(spark, d, "icd").select(clean_id("PatientID").alias("pid")).join(s, "pid", "left_anti").agg(F.count(F.lit(1)).alias("zeilen"), F.count_distinct("pid").alias("patienten"))


_KEY = "pid, typ"


@query(f"""WITH {_R}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY report_nr) AS rn FROM r WHERE ts IS NOT NULL) WHERE rn = 1)
SELECT r.report_nr, f.ts AS datum FROM r JOIN f ON r.pid = f.pid AND r.typ = f.typ WHERE r.ts IS NULL""")
def jn7_win3_datum(spark: SparkSession, d: str) -> DataFrame:
    """A missing date from the first dated report with the same keys; the first row per key by a minimum, not a sort."""
    r = reports(spark, d).select("report_nr", F.concat_ws("\x00", "pid", "typ").alias("pid"), "ts")
    first = r.filter("ts IS NOT NULL").groupBy("pid").agg(F.min_by("ts", "report_nr").alias("datum"))
    return beside(r.filter("ts IS NULL").select("report_nr", "pid"), first).select("report_nr", "datum")


def hints_by_score(spark: SparkSession, d: str, terms: tuple[str, ...]) -> DataFrame:
    h = reports(spark, d).groupBy("pid").agg(F.max(flag(contains_any(F.col("epikrise"), terms))).alias("epikrise_hinweis"))
    return h.join(base(spark, d), "pid").groupBy("epikrise_hinweis", "ge_4").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_B}, sb AS (SELECT {sql_id('"PatientenID"')} AS pid, baseline_nr, max_icdsc, row_number() OVER (PARTITION BY {sql_id('"PatientenID"')} ORDER BY baseline_nr) AS rn FROM structured_baseline)
SELECT coalesce(b.pid, sb.pid) AS pid, coalesce(sb.max_icdsc, b.max_score) AS wert, CASE WHEN b.max_score IS NOT DISTINCT FROM sb.max_icdsc THEN 'gleich' ELSE 'unterschied' END AS befund FROM b FULL JOIN (SELECT * FROM sb WHERE rn = 1) sb ON b.pid = sb.pid""")
def jn13_jn18_abgleich(spark: SparkSession, d: str) -> DataFrame:
    """Derived and delivered baseline: delivered values override, differences are named; of repeated ids the first row counts (JN-18, SRC-6; jn13_urteile checks)."""
    sb = table(spark, d, "structured_baseline").groupBy(clean_id("PatientenID").alias("pid")).agg(F.min_by(F.struct("max_icdsc"), "baseline_nr").alias("x"))
    j = base(spark, d).select("pid", "max_score").join(sb.select("pid", F.col("x.max_icdsc").alias("m")), "pid", "outer")
    return j.select("pid", F.coalesce("m", "max_score").alias("wert"), F.when(F.col("max_score").eqNullSafe(F.col("m")), "gleich").otherwise("unterschied").alias("befund"))


@query(f"""SELECT count(*) AS zeilen FROM icdsc WHERE {sql_id('"PatientID"')} IN (SELECT {sql_id('"PatientID"')} FROM icd)""")
def jn17_semi(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "icd").select(clean_id("PatientID").alias("pid")).distinct()
    return table(spark, d, "icdsc").select(clean_id("PatientID").alias("pid")).join(i, "pid", "left_semi").agg(F.count(F.lit(1)).alias("zeilen"))


# ---- aggregations (AGG)


@query(f"""WITH {_R}, t AS (SELECT pid, (row_number() OVER (PARTITION BY pid ORDER BY eingang NULLS LAST, report_nr) - 1) // 50 AS teil, eingang, report_nr, {_STITCH} AS txt FROM r)
SELECT pid, teil, count(*) AS berichte, md5(string_agg(txt, chr(10) || chr(10) ORDER BY eingang NULLS LAST, report_nr)) AS inhalt FROM t WHERE txt <> '' GROUP BY ALL""")
def agg3_agg4_patiententext(spark: SparkSession, d: str) -> DataFrame:
    """A patient's texts in order of arrival, in parts of 50 reports, so no group grows without bound (AGG-3 in parts; agg3_patiententext_ganz has whole texts)."""
    r = rank_within(reports(spark, d).select("report_nr", "pid", "eingang", stitched().alias("t")), ["pid"], F.to_date("eingang"), [F.col("eingang").asc_nulls_last(), F.col("report_nr")])
    g = r.filter("t IS NOT NULL").groupBy("pid", F.floor((F.col("lfd") - 1) / 50).cast("bigint").alias("teil"))
    rows = F.array_sort(F.collect_list(F.struct("lfd", "t")))
    return g.agg(F.count(F.lit(1)).alias("berichte"), F.md5(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n")).alias("inhalt"))


_GE = tuple(f"ge_{t}" for t in range(1, 6))


@query(f"WITH {_B}, l AS ({_long('b', 'has_code', _GE)}), {_metrics('l', 'feld', 'wert', 'has_code')}")
def agg11_schwellen(spark: SparkSession, d: str) -> DataFrame:
    """The code flag as prediction of each threshold."""
    return confusion(long_form(base(spark, d), ["has_code"], list(_GE)), ["feld"], "wert", "has_code")


def hints(spark: SparkSession, d: str, terms: tuple[str, ...]) -> DataFrame:
    return reports(spark, d).groupBy("pid").agg(*(F.max(flag(contains_any(F.col(c), terms))).alias(c) for c in FIELDS))


def hint_odds(spark: SparkSession, d: str, h: DataFrame) -> DataFrame:
    x = h.join(base(spark, d).select("pid", "ge_4", "has_code", "composite"), "pid")
    one = long_form(x, ["ge_4", "has_code", "composite"], list(FIELDS))
    return odds(long_form(one, ["feld", "wert"], ["ge_4", "has_code", "composite"], "ziel", "ausgang"), ["feld", "ziel"], "wert", "ausgang")


def hint_prevalence(spark: SparkSession, d: str, h: DataFrame) -> DataFrame:
    x = h.join(base(spark, d).select("pid"), "pid")
    return x.agg(*(F.round(F.avg(c), 6).alias(c) for c in FIELDS), F.round(F.avg(F.col("epikrise") * F.col("diag")), 6).alias("beide"))


_TXT = "concat_ws(' ', diag, epikrise, jetziges_leiden, prozedere)"


def counted_terms(spark: SparkSession, d: str, terms: tuple[str, ...]) -> DataFrame:
    """One row per report with the occurrences of all terms as a list, beside the patient's score flag; joined before anything is exploded."""
    r = reports(spark, d).withColumn("txt", F.concat_ws(" ", *FIELDS))
    one = r.select("report_nr", "pid", "klasse", F.array(*(F.struct(F.lit(k).alias("begriff"), big(occurrences(F.col("txt"), k), "n")) for k in terms)).alias("begriffe"))
    return beside(one, base(spark, d).select("pid", "ge_4"))


def keyword_rows(spark: SparkSession, d: str, terms: tuple[str, ...] = HINTS) -> DataFrame:
    """One row per report and term with its occurrences, from one pass over the text."""
    r = reports(spark, d).withColumn("txt", F.concat_ws(" ", *FIELDS))
    return r.select("report_nr", "pid", "typ", "klasse", F.explode(F.array(*(F.struct(F.lit(k).alias("begriff"), big(occurrences(F.col("txt"), k), "n")) for k in terms))).alias("x")).select("report_nr", "pid", "typ", "klasse", "x.begriff", "x.n")


def term_totals(k: DataFrame) -> DataFrame:
    return k.groupBy("begriff").agg(F.sum("n").alias("vorkommen"), F.count_if(F.col("n") > 0).alias("berichte"), F.round(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("klasse"))), F.lit(0.0)), 6).alias("p_klasse"))


def term_sets(k: DataFrame) -> DataFrame:
    q = k.select("report_nr", "pid", "klasse", "ge_4", F.explode("begriffe").alias("x")).select("klasse", "ge_4", "x.begriff", "x.n")
    pos, ref = F.col("klasse") == 1, F.col("ge_4") == 1
    sets = F.array(F.lit("alle"), F.when(pos, "klasse_1"), F.when(ref, "ge_4"), F.when(pos & ref, "TP").when(pos, "FP").when(ref, "FN").otherwise("TN"))
    return q.select("begriff", "n", F.explode(F.array_compact(sets)).alias("menge")).groupBy("menge", "begriff").agg(F.sum("n").alias("vorkommen"), F.count_if(F.col("n") > 0).alias("berichte"))


def terms_wide(k: DataFrame) -> DataFrame:
    w = k.groupBy("begriff").pivot("typ", list(MATRIX_TYPES)).agg(F.sum("n")).fillna(0)
    return w.select("begriff", *(F.col(t).alias(t.lower()) for t in MATRIX_TYPES))


_SETS = f"""v AS (SELECT pid, max(berichte) AS berichte, max(icd) AS icd, max(icdsc) AS icdsc FROM (SELECT {sql_id('"PatientID"')} AS pid, 1 AS berichte, 0 AS icd, 0 AS icdsc FROM berichte
UNION ALL SELECT {sql_id('"PatientID"')}, 0, 1, 0 FROM icd UNION ALL SELECT {sql_id('"PatientID"')}, 0, 0, 1 FROM icdsc) WHERE pid <> '' GROUP BY pid)"""


def venn(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t: table(spark, d, t).select(clean_id("PatientID").alias("pid")).filter("pid <> ''")
    return id_sets({t: ids(t) for t in ("berichte", "icd", "icdsc")})


@query(f"WITH {_SETS} SELECT berichte, icd, icdsc, count(*) AS n FROM v GROUP BY ALL")
def agg29_agg30_venn(spark: SparkSession, d: str) -> DataFrame:
    """All regions of three id sets (AGG-27, AGG-30)."""
    return venn(spark, d).groupBy("berichte", "icd", "icdsc").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SETS} SELECT count(*) FILTER (berichte = 1) AS patienten, count(*) FILTER (icd = 1 OR icdsc = 1) AS mit_basis, count(*) FILTER (berichte = 1 AND (icd = 1 OR icdsc = 1)) AS beides, count(*) FILTER (berichte = 1 AND icd = 0 AND icdsc = 0) AS nur_berichte,
count(*) FILTER (berichte = 0) AS nur_basis, round(100.0 * count(*) FILTER (berichte = 1 AND (icd = 1 OR icdsc = 1)) / nullif(count(*) FILTER (berichte = 1), 0), 6) AS abdeckung FROM v""")
def agg22_agg23_abdeckung(spark: SparkSession, d: str) -> DataFrame:
    """Cohort counts and coverage (AGG-22; lists in agg23_ohne_partner)."""
    b, x = F.col("berichte") == 1, (F.col("icd") == 1) | (F.col("icdsc") == 1)
    c = venn(spark, d).agg(F.count_if(b).alias("patienten"), F.count_if(x).alias("mit_basis"), F.count_if(b & x).alias("beides"), F.count_if(b & ~x).alias("nur_berichte"), F.count_if(~b).alias("nur_basis"))
    return c.withColumn("abdeckung", F.round(100.0 * F.col("beides") / F.when(F.col("patienten") > 0, F.col("patienten")), 6))


@query(f"""WITH g AS (SELECT {sql_id('"PatientID"')} AS pid, count(*) AS n FROM icd GROUP BY 1) SELECT n AS zeilen_je_id, count(*) AS ids FROM g WHERE pid <> '' GROUP BY 1""")
def agg25_haeufigkeit(spark: SparkSession, d: str) -> DataFrame:
    """How many ids have how many rows."""
    return table(spark, d, "icd").groupBy(clean_id("PatientID").alias("pid")).agg(F.count(F.lit(1)).alias("n")).filter("pid <> ''").groupBy(F.col("n").alias("zeilen_je_id")).agg(F.count(F.lit(1)).alias("ids"))


@query(f"""WITH g AS (SELECT {sql_id('"PatientID"')} AS pid, count(*) AS n FROM icd GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS zeilen, count(*) AS ids, max(n) AS meist, round(avg(n), 6) AS mittel, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, count(*) FILTER (n > 1) AS mehrfach FROM g WHERE pid <> ''""")
def agg25_agg26_umfang(spark: SparkSession, d: str) -> DataFrame:
    """Rows, ids, largest, mean, exact median (AGG-25)."""
    g = table(spark, d, "icd").groupBy(clean_id("PatientID").alias("pid")).agg(F.count(F.lit(1)).alias("n")).filter("pid <> ''")
    return g.agg(F.sum("n").alias("zeilen"), F.count(F.lit(1)).alias("ids"), F.max("n").alias("meist"), F.round(F.avg("n"), 6).alias("mittel"), F.percentile("n", 0.5).alias("median"), F.count_if(F.col("n") > 1).alias("mehrfach"))


_MISS = ("PatientID", "bername", "bertyp", "berdat", *FIELDS)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS spalte, count(*) FILTER ("{c}" IS NULL) AS fehlend, round(count(*) FILTER ("{c}" IS NULL) / count(*), 6) AS anteil FROM berichte""" for c in _MISS))
def agg31_fehlend(spark: SparkSession, d: str) -> DataFrame:
    """Nulls per column, one scan."""
    a = table(spark, d, "berichte").agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in _MISS))
    return long_form(a, ["_n"], list(_MISS), "spalte", "fehlend").select("spalte", "fehlend", F.round(F.col("fehlend") / F.col("_n"), 6).alias("anteil"))


_CATS = {"delir": "delir", "wachheit": "vigilanz|schläfrig|somnolent", "unruhe": "unruhig|agitiert|nestelnd", "orientierung": "orientiert|verwirrt"}


@query(f"""WITH {_R}, p AS (SELECT unnest(string_split(diag, chr(10))) AS teil FROM r) SELECT * FROM (""" + " UNION ALL ".join(f"SELECT '{k}' AS gruppe, count(*) AS teile FROM p WHERE regexp_matches(lower(teil), '{v}')" for k, v in _CATS.items()) + ") WHERE teile > 0")
def agg35_gruppen(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the diagnosis text per term group; a part may belong to several."""
    parts = reports(spark, d).select(F.explode(F.split("diag", "\n")).alias("teil")).withColumn("teil", F.lower("teil"))
    hit = F.array_compact(F.array(*(F.when(F.col("teil").rlike(v), F.lit(k)) for k, v in _CATS.items())))
    return parts.select(F.explode(hit).alias("gruppe")).groupBy("gruppe").agg(F.count(F.lit(1)).alias("teile"))


@query(f"WITH {_R} " + " UNION ALL ".join(f"SELECT '{c}' AS abschnitt, count({c}) AS gefuellt, round(avg(length({c})), 6) AS zeichen, max(length({c})) AS laengster FROM r" for c in FIELDS))
def agg37_agg42_abschnitte(spark: SparkSession, d: str) -> DataFrame:
    """Sections filled, and their lengths (AGG-37, AGG-42)."""
    return long_form(reports(spark, d), [], list(FIELDS), "abschnitt", "t").groupBy("abschnitt").agg(F.count("t").alias("gefuellt"), F.round(F.avg(F.length("t")), 6).alias("zeichen"), big(F.max(F.length("t")), "laengster"))


_CODE = f"upper({sql_strip('icd_code')})"


@query(f"SELECT {_CODE} AS code, split_part({_CODE}, '.', 1) AS stamm, count(*) AS n FROM icd WHERE {_CODE} <> '' GROUP BY ALL")
def agg38_codes(spark: SparkSession, d: str) -> DataFrame:
    c = F.upper(strip("icd_code"))
    return table(spark, d, "icd").select(c.alias("code")).filter("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", F.substring_index("code", ".", 1).alias("stamm"), "n")


@query(f"""SELECT count({_num('"ICDSC_Max"')}) AS n, round(avg({_num('"ICDSC_Max"')}), 6) AS mittel, quantile_cont({_num('"ICDSC_Max"')}, 0.5) AS median, max({_num('"ICDSC_Max"')}) AS hoechster FROM icdsc""")
def agg39_score(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "icdsc").select(number("ICDSC_Max").alias("s"))
    return s.agg(F.count("s").alias("n"), F.round(F.avg("s"), 6).alias("mittel"), F.percentile("s", 0.5).alias("median"), F.max("s").alias("hoechster"))


@query("SELECT CAST(hour(eingang) AS INTEGER) AS stunde, dayname(eingang) AS tag, count(*) AS n FROM berichte GROUP BY ALL")
def agg40_dt2_zeiten(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals by hour and weekday."""
    return table(spark, d, "berichte").groupBy(F.hour("eingang").alias("stunde"), F.date_format("eingang", "EEEE").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_R} SELECT typ, count(*) AS n, CAST(sum(klasse) AS BIGINT) AS positiv, round(avg(klasse), 6) AS rate, round(avg(length({_TXT})), 6) AS zeichen FROM r GROUP BY ROLLUP(typ)")
def agg41_agg43_typen(spark: SparkSession, d: str) -> DataFrame:
    """Run counters per type and over all; the row over all has no type (AGG-36, AGG-41, AGG-43)."""
    r = reports(spark, d).select("typ", "klasse", F.length(F.concat_ws(" ", *FIELDS)).alias("z"))
    return r.rollup("typ").agg(F.count(F.lit(1)).alias("n"), F.sum("klasse").alias("positiv"), F.round(F.avg("klasse"), 6).alias("rate"), F.round(F.avg("z"), 6).alias("zeichen"))


_ART = "CASE WHEN klasse = 1 AND wert = 1 THEN 'TP' WHEN klasse = 1 THEN 'FP' WHEN wert = 1 THEN 'FN' ELSE 'TN' END"


def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = long_form(comparison(spark, d).filter("da"), ["report_nr", "pid", "klasse"], ["code_flag", "ge_4"])
    return x.withColumn("art", F.expr(_ART))


_ERR = f"{_CMP}, l AS ({_long('j', 'report_nr, pid, klasse, da', ('code_flag', 'ge_4'))}), e AS (SELECT *, {_ART} AS art FROM l WHERE da)"


@query(f"WITH {_ERR} SELECT feld, art, count(*) AS n FROM e GROUP BY ALL")
def agg44_agg45_fehler(spark: SparkSession, d: str) -> DataFrame:
    """Error kinds per baseline (AGG-44)."""
    return error_kinds(spark, d).groupBy("feld", "art").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ERR} SELECT feld, art, report_nr, lfd, row_number() OVER (ORDER BY feld, art, lfd) AS nr FROM (SELECT *, row_number() OVER (PARTITION BY feld, art ORDER BY report_nr) AS lfd FROM e) WHERE lfd <= 5")
def win4_win5_beispiele(spark: SparkSession, d: str) -> DataFrame:
    """Five examples per baseline and error kind, numbered through; groups are cut by partial minima before any sort."""
    g = error_kinds(spark, d).groupBy("feld", "art", F.pmod("report_nr", F.lit(64)).alias("_s")).agg(F.slice(F.array_sort(F.collect_set("report_nr")), 1, 5).alias("x"))
    top = g.groupBy("feld", "art").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, 5).alias("x"))
    rows = top.select("feld", "art", F.posexplode("x").alias("p", "report_nr")).withColumn("lfd", F.col("p") + 1)
    return rows.select("feld", "art", "report_nr", "lfd", F.row_number().over(Window.orderBy("feld", "art", "lfd")).cast("bigint").alias("nr")).withColumn("lfd", F.col("lfd").cast("bigint"))


@query(f"WITH {_R} SELECT report_nr, max(klasse) OVER (PARTITION BY pid) AS patient, sum(klasse) OVER (PARTITION BY pid) AS positive FROM r WHERE pid <> ''".replace("sum(klasse) OVER (PARTITION BY pid)", "CAST(sum(klasse) OVER (PARTITION BY pid) AS BIGINT)"))
def win1_agg47_patientenlabel(spark: SparkSession, d: str) -> DataFrame:
    """Patient label on every report: a state per patient joined back, not a window over a hot patient."""
    r = reports(spark, d).filter("pid <> ''").select("report_nr", "pid", "klasse")
    s = r.groupBy("pid").agg(F.max("klasse").alias("patient"), F.sum("klasse").alias("positive"))
    return beside(r.select("report_nr", "pid"), s).select("report_nr", "patient", "positive")


@query(f"WITH {_R} SELECT report_nr, row_number() OVER (PARTITION BY pid ORDER BY ts NULLS LAST, typ, report_nr) AS nr FROM r")
def win2_reihenfolge(spark: SparkSession, d: str) -> DataFrame:
    """A report's number within its patient by date, type and number."""
    r = reports(spark, d).select("report_nr", "pid", "typ", "ts")
    undated = F.col("ts").isNull()  # a patient's undated reports are one bucket else
    buckets = [F.to_date("ts"), F.when(undated, F.col("typ")), F.when(undated, F.floor(F.col("report_nr") / 4096))]
    return rank_within(r, ["pid"], buckets, [F.col("ts").asc_nulls_last(), F.col("typ"), F.col("report_nr")], "nr").select("report_nr", "nr")


@query(f"""WITH g AS (SELECT {sql_id('"PatientenID"')} AS pid, count(*) AS n FROM structured_baseline GROUP BY 1) SELECT pid, n FROM g WHERE n > 1""")
def win7_doppelte(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structured_baseline").groupBy(clean_id("PatientenID").alias("pid")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def leading_terms(k: DataFrame, most: int) -> DataFrame:
    """Leading terms per report type; ties by the term."""
    g = k.groupBy("typ", "begriff").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("typ").orderBy(F.desc("n"), "begriff")
    return g.withColumn("rn", F.row_number().over(w).cast("bigint")).filter(F.col("rn") <= most)


@query(f"WITH {_R} SELECT pid, min(report_nr) AS erster FROM r WHERE pid <> '' GROUP BY 1 ORDER BY erster LIMIT 20")
def srt3_erste(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty ids in order of appearance."""
    return reports(spark, d).filter("pid <> ''").groupBy("pid").agg(F.min("report_nr").alias("erster")).orderBy("erster").limit(20)


# ---- text (TXT), JSON (JSN), dates (DT)


@query(f"WITH {_R} SELECT report_nr, {_word(_TXT)} AS wort, ({' OR '.join(f'''contains(lower({_TXT}), '{k}')''' for k in HINTS)}) AS hinweis FROM r")
def txt1_txt3_treffer(spark: SparkSession, d: str) -> DataFrame:
    """Hint terms anywhere, and words of the pattern list."""
    t = F.concat_ws(" ", *FIELDS)
    return reports(spark, d).select("report_nr", word_match(t, WORD_PATTERNS, STEMS).alias("wort"), contains_any(t, HINTS).alias("hinweis"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def jsn2_felder(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON text, null where it doesn't parse (JSN-2, JSN-5)."""
    return table(spark, d, "events").groupBy("event_type", F.from_json("props", "k long")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT report_nr, {_DATE} AS ts FROM berichte")
def dt1_daten(spark: SparkSession, d: str) -> DataFrame:
    """Dates in all spellings, impossible ones null."""
    return table(spark, d, "berichte").select("report_nr", parse_date("berdat").alias("ts"))




# ---- further projections, joins and sets


@query(f"""SELECT baseline_nr, {sql_id('"PatientenID"')} AS "PatientenID", '' AS anmerkung, '' AS bewertung FROM structured_baseline""")
def prj2_prj4_prj26_spalten(spark: SparkSession, d: str) -> DataFrame:
    """Canonical id column, required columns, empty columns for annotation."""
    b = require(fold(table(spark, d, "structured_baseline"), {"PatientenID": ("PatientID",)}), ["PatientenID", "max_icdsc"], "structured_baseline")
    return with_defaults(b.select("baseline_nr", clean_id("PatientenID").alias("PatientenID")), ["anmerkung", "bewertung"])


@query(f"""WITH {_R} SELECT report_nr, CASE WHEN length({_TXT}) > 80 THEN substring(lower({_TXT}), 1, 79) || '…' ELSE lower({_TXT}) END AS blob FROM r""")
def prj19_txt22_blob(spark: SparkSession, d: str) -> DataFrame:
    """All text fields in lower case, shortened with an ellipsis."""
    return reports(spark, d).select("report_nr", shorten(F.lower(F.concat_ws(" ", *FIELDS)), 80).alias("blob"))


@query(f"""WITH {_R}, p AS (SELECT pid, row_number() OVER (ORDER BY pid) AS p FROM (SELECT DISTINCT pid FROM r WHERE pid <> ''))
SELECT report_nr, printf('Patient_%04d', p) AS patient, printf('Patient_%04d_Report_%04d', p, row_number() OVER (PARTITION BY pid ORDER BY eingang NULLS LAST, report_nr)) AS bericht FROM r JOIN p USING (pid)""")
def prj22_kennungen(spark: SparkSession, d: str) -> DataFrame:
    """Neutral identifiers of patients and their reports; numbers run within ranges of ids, so nothing is sorted in one task."""
    r = reports(spark, d).filter("pid <> ''").select("report_nr", "pid", "eingang")
    p = rank_within(r.select("pid").distinct().withColumn("_a", F.lit(1)), ["_a"], F.substring("pid", 1, 5), [F.col("pid")], "p").select("pid", "p")
    n = rank_within(r, ["pid"], F.to_date("eingang"), [F.col("eingang").asc_nulls_last(), F.col("report_nr")], "n")
    n = beside(n.select("report_nr", "pid", "n"), p)
    return n.select("report_nr", F.format_string("Patient_%04d", "p").alias("patient"), F.format_string("Patient_%04d_Report_%04d", "p", "n").alias("bericht"))


@query(f"WITH {_CMP} SELECT j.report_nr, j.klasse, length({_TXT}) AS zeichen FROM j LEFT JOIN r ON j.report_nr = r.report_nr WHERE j.da")
def jn10_text(spark: SparkSession, d: str) -> DataFrame:
    """Evaluable reports beside their text."""
    r = reports(spark, d).filter((F.col("pid") != "") & (F.col("typ") != EXCLUDED_TYPE)).select("report_nr", "pid", "klasse", big(F.length(F.concat_ws(" ", *FIELDS)), "zeichen"))
    return beside(r, base(spark, d).select("pid")).select("report_nr", F.col("klasse").cast("int").alias("klasse"), "zeichen")


@query(f"""WITH {_R}, {_B}, x AS (SELECT pid, bool_or({_word(_TXT)}) AS wort FROM r GROUP BY pid) SELECT coalesce(x.pid, b.pid) AS pid, coalesce(x.wort, false) AS wort, coalesce(b.has_code, 0) AS has_code, coalesce(b.ge_4, 0) AS ge_4 FROM x FULL JOIN b ON x.pid = b.pid""")
def jn11_aussen(spark: SparkSession, d: str) -> DataFrame:
    """Word matches per patient beside the baseline, missing sides false and 0."""
    x = reports(spark, d).select("pid", word_match(F.concat_ws(" ", *FIELDS), WORD_PATTERNS, STEMS).alias("w")).groupBy("pid").agg(F.bool_or("w").alias("wort"))
    return x.join(base(spark, d).select("pid", "has_code", "ge_4"), "pid", "outer").select("pid", F.coalesce("wort", F.lit(False)).alias("wort"), F.coalesce("has_code", F.lit(0)).alias("has_code"), F.coalesce("ge_4", F.lit(0)).alias("ge_4"))


_ZAEHL = {"berichte": "report_nr", "icd": "icd_nr", "icdsc": "icdsc_nr"}


@query(f"""SELECT pid, count(*) FILTER (t = 'berichte') AS berichte, count(*) FILTER (t = 'icd') AS icd, count(*) FILTER (t = 'icdsc') AS icdsc FROM ({' UNION ALL '.join(f'''SELECT {sql_id('"PatientID"')} AS pid, '{t}' AS t FROM {t}''' for t in _ZAEHL)}) GROUP BY pid""")
def jn12_set1_zeilen(spark: SparkSession, d: str) -> DataFrame:
    """Rows per id and table: one union and one grouping for a chain of outer joins."""
    one = [table(spark, d, t).select(clean_id("PatientID").alias("pid"), F.lit(t).alias("t")) for t in _ZAEHL]
    return one[0].unionByName(one[1]).unionByName(one[2]).groupBy("pid").agg(*(F.count_if(F.col("t") == t).alias(t) for t in _ZAEHL))


@query(f"""WITH {_R}, {_B}, a AS (SELECT pid, max(klasse) AS irgend FROM r WHERE {_IN} GROUP BY pid) SELECT r.report_nr, r.klasse, a.irgend, b.ge_4, CAST(a.irgend <> b.ge_4 AS INTEGER) AS abweichung FROM r JOIN a ON r.pid = a.pid LEFT JOIN b ON r.pid = b.pid WHERE {_IN}""")
def jn14_prj24_bogen(spark: SparkSession, d: str) -> DataFrame:
    """Annotation sheet: report, patient state, baseline; a difference is null without a baseline."""
    r = reports(spark, d).filter(F.col("typ") != EXCLUDED_TYPE).select("report_nr", "pid", "klasse")
    a = r.groupBy("pid").agg(F.max("klasse").alias("irgend"))
    j = beside(r, a.join(base(spark, d).select("pid", "ge_4"), "pid", "left"))
    return j.select("report_nr", "klasse", "irgend", "ge_4", (F.col("irgend") != F.col("ge_4")).cast("int").alias("abweichung"))


_IDS = {t: f"SELECT DISTINCT {sql_id('\"PatientID\"')} AS pid FROM {t}" for t in ("icd", "icdsc")}


@query(f"SELECT 'schnitt' AS menge, pid FROM (({_IDS['icd']}) INTERSECT ({_IDS['icdsc']})) UNION ALL SELECT 'nur_icd', pid FROM (({_IDS['icd']}) EXCEPT ({_IDS['icdsc']})) UNION ALL SELECT 'vereinigung', pid FROM (({_IDS['icd']}) UNION ({_IDS['icdsc']}))")
def set2_set3_set4_mengen(spark: SparkSession, d: str) -> DataFrame:
    """Intersection, difference and union of two id sets."""
    a, b = (table(spark, d, t).select(clean_id("PatientID").alias("pid")) for t in ("icd", "icdsc"))
    name = lambda df, n: df.select(F.lit(n).alias("menge"), "pid")
    return name(a.intersect(b), "schnitt").unionByName(name(a.distinct().exceptAll(b.distinct()), "nur_icd")).unionByName(name(a.union(b).distinct(), "vereinigung"))


@query(f"WITH {_R} SELECT report_nr, pid, typ, ts FROM r ORDER BY pid, ts NULLS LAST, report_nr")
def srt1_sortiert(spark: SparkSession, d: str) -> DataFrame:
    """Stable order over several keys, missing dates last; the range sort spreads by all keys."""
    return reports(spark, d).select("report_nr", "pid", "typ", "ts").orderBy("pid", F.col("ts").asc_nulls_last(), "report_nr")


# ---- whole term lists and baselines; their SQL spells the lists out, so that it doesn't follow a cut of the tuples

_ALL = "(VALUES ('delir'), ('delirium'), ('delirant'), ('delirös'), ('verwirrt'), ('verwirrtheit'), ('desorientiert'), ('desorientierung'), ('agitation'), ('agitiert'), ('unruhig'), ('vigilanz'), ('vigilanzminderung'), ('somnolent'), ('soporös'), ('bewusstseinsstörung'), ('bewusstseinstrübung'))"
_KG = f"""{_R}, t AS (SELECT report_nr, pid, typ, klasse, lower({_TXT}) AS txt FROM r), k AS (SELECT report_nr, pid, typ, klasse, begriff, (length(txt) - length(replace(txt, begriff, ''))) // length(begriff) AS n FROM t, {_ALL} v(begriff))"""


@query(f"WITH {_KG} SELECT begriff, CAST(sum(n) AS BIGINT) AS vorkommen, count(*) FILTER (n > 0) AS berichte, round(coalesce(avg(klasse) FILTER (n > 0), 0), 6) AS p_klasse FROM k GROUP BY 1")
def agg17_agg19_begriffe_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Term totals, reports with the term and the share of positives among them (AGG-17, AGG-19, AGG-34, TXT-2)."""
    return term_totals(keyword_rows(spark, d, HINTS))


@query(f"""WITH {_KG}, {_B}, q AS (SELECT k.begriff, k.n, k.klasse, b.ge_4 FROM k JOIN b ON k.pid = b.pid), u AS (SELECT 'alle' AS menge, begriff, n FROM q UNION ALL SELECT 'klasse_1', begriff, n FROM q WHERE klasse = 1 UNION ALL SELECT 'ge_4', begriff, n FROM q WHERE ge_4 = 1
UNION ALL SELECT CASE WHEN klasse = 1 AND ge_4 = 1 THEN 'TP' WHEN klasse = 1 THEN 'FP' WHEN ge_4 = 1 THEN 'FN' ELSE 'TN' END, begriff, n FROM q) SELECT menge, begriff, CAST(sum(n) AS BIGINT) AS vorkommen, count(*) FILTER (n > 0) AS berichte FROM u GROUP BY ALL""")
def agg18_agg20_mengen_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Terms by overlapping subsets and by error kind, from one scan (AGG-18, AGG-20)."""
    return term_sets(counted_terms(spark, d, HINTS))


@query(f"WITH {_KG} SELECT begriff, {', '.join(f'''CAST(coalesce(sum(n) FILTER (typ = '{t}'), 0) AS BIGINT) AS {t.lower()}''' for t in MATRIX_TYPES)} FROM k GROUP BY 1")
def agg21_breit_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Terms by report type as a wide table."""
    return terms_wide(keyword_rows(spark, d, HINTS))


@query(f"WITH {_KG}, g AS (SELECT typ, begriff, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL) SELECT typ, begriff, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY typ ORDER BY n DESC, begriff) AS rn FROM g) WHERE rn <= 15")
def srt2_spitze_ganz(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen leading terms per report type; ties by the term (SRT-2)."""
    return leading_terms(keyword_rows(spark, d, HINTS), 15)


#: The field hints' terms: the list, and the spellings without umlauts that one of the two analyses adds.
FIELD_HINTS = (*HINTS, "hypoaktives delir", "hyperaktives delir", "deliros", "soporos", "bewusstseinsstorung", "bewusstseinstrubung")
_ANY = "delir|verwirrt|desorientiert|desorientierung|agitation|agitiert|unruhig|vigilanz|somnolent|soporös|bewusstseinsstörung|bewusstseinstrübung"
_ANY_PLAIN = _ANY + "|soporos|bewusstseinsstorung|bewusstseinstrubung"


def _field_hints(terms: str) -> str:
    return f"{_R}, {_B}, h AS (SELECT pid, {', '.join(f"max(CASE WHEN regexp_matches(lower(coalesce({c}, '')), '{terms}') THEN 1 ELSE 0 END) AS {c}" for c in FIELDS)} FROM r GROUP BY pid), x AS (SELECT h.*, ge_4, has_code, composite FROM h JOIN b ON h.pid = b.pid)"


@query(f"WITH {_field_hints(_ANY_PLAIN)} SELECT epikrise AS epikrise_hinweis, ge_4, count(*) AS n FROM x GROUP BY ALL")
def jn8_hinweise_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Patient hints joined with the baseline (JN-8)."""
    return hints_by_score(spark, d, FIELD_HINTS)


@query("WITH " + _field_hints(_ANY_PLAIN) + ", f AS (" + " UNION ALL ".join(f"SELECT pid, '{c}' AS feld, {c} AS wert, ge_4, has_code, composite FROM x" for c in FIELDS) + "), l AS (" + " UNION ALL ".join(f"SELECT feld, wert, '{o}' AS ziel, {o} AS ausgang FROM f" for o in ("ge_4", "has_code", "composite")) + "), " + _odds("l", "feld, ziel", "wert", "ausgang"))
def agg13_agg14_odds_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Odds ratios of field hints against outcomes (AGG-13, AGG-14)."""
    return hint_odds(spark, d, hints(spark, d, FIELD_HINTS))


@query(f"WITH {_field_hints(_ANY)} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in FIELDS)}, round(avg(epikrise * diag), 6) AS beide FROM x")
def agg16_praevalenz_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Prevalence of field hints; the reference takes its list without the extra spellings here (AGG-16)."""
    return hint_prevalence(spark, d, hints(spark, d, HINTS))


@query(f"WITH {_R}, {_B}, j AS (SELECT r.klasse, b.* FROM r JOIN b ON r.pid = b.pid WHERE r.pid <> '' AND {_IN}), e AS (" + " UNION ALL ".join(f"SELECT klasse, '{n}' AS feld, {c} AS wert FROM j" for n, c in (("code_flag", "has_code"), ("ge_1", "ge_1"), ("ge_2", "ge_2"), ("ge_3", "ge_3"), ("ge_4", "ge_4"), ("ge_5", "ge_5"), ("composite", "composite"), ("eq_0", "eq_0"), ("mid_1_3", "mid_1_3"), ("ge_4_grouped", "CAST(max_score >= 4 AS INTEGER)"))) + f"), {_metrics('e', 'feld', 'wert', 'klasse')}")
def agg8_agg10_metriken_ganz(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts and rates of the reports against all ten baselines, in one pass (AGG-8, AGG-9, AGG-10, AGG-12)."""
    c = comparison(spark, d, (*FLAGS, "eq_0", "mid_1_3")).filter("da").withColumn("ge_4_grouped", F.col("ge_4"))
    return confusion(long_form(c, ["klasse"], [*FLAGS, "eq_0", "mid_1_3", "ge_4_grouped"]), ["feld"], "wert", "klasse")
