"""Queries of the general operators over the reports' tables, and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from befundwerk.functions.clean import SPACE_RE2, clean_id, clean_label, parse_date, strip
from befundwerk.operators.orphans import orphan_report, orphans, references
from befundwerk.operators.rejects import FIELDS, SCORE, WELL_QUOTED, check_scores, parse_records
from befundwerk.operators.skew import eager_join, heavy_keys, rank_within, states
from befundwerk.session import table

#: A key is heavy above this share of all rows of the reports.
HEAVY = 0.025


# ---- 2 rows that fail to parse


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records and scores that fail, with the first reason that applies."""
    raw = parse_records(table(spark, d, "rohzeilen")).filter(F.col("grund").isin("anfuehrung", "spaltenzahl", "wert")).select(F.lit("rohzeilen").alias("tabelle"), "nr", "grund")
    bad = check_scores(table(spark, d, "icdsc"), "icdsc_nr", "ICDSC_Max").filter(F.col("grund").isNotNull()).select(F.lit("icdsc").alias("tabelle"), "nr", "grund")
    return raw.unionByName(bad)


def _valid(spark: SparkSession, d: str, datei: str) -> DataFrame:
    ok = parse_records(table(spark, d, "rohzeilen").filter(F.col("datei") == datei)).filter(F.col("grund").isNull())
    return ok.select(F.col("nr").alias("roh_nr"), *(F.col("felder")[i].alias(c) for i, c in enumerate(FIELDS[datei])))


def p2_berichte(spark: SparkSession, d: str) -> DataFrame:
    """The valid report records, typed."""
    v = _valid(spark, d, "Berichte.csv")
    return v.withColumn("PatientID", clean_id("PatientID")).withColumn("bertyp", clean_label("bertyp")).withColumn("berdat", parse_date("berdat"))


def p2_werte(spark: SparkSession, d: str) -> DataFrame:
    """The valid score records, typed; a blank score is null."""
    v = _valid(spark, d, "ICDSC.csv")
    return v.select("roh_nr", clean_id("PatientID").alias("PatientID"), strip("ICDSC_Max").try_cast("double").cast("int").alias("ICDSC_Max"))


# ---- 4 a few keys holding most records


def _fields(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "berichte")
    pair = lambda c, v: F.struct(F.lit(c).alias("feld"), v.alias("wert"))
    return b.select("eingang", F.explode(F.array(pair("PatientID", clean_id("PatientID")), pair("bertyp", clean_label("bertyp")))).alias("x")).select("x.feld", "x.wert", "eingang")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with more than HEAVY of all rows, from the join of each field's rows with all rows of the field.

    Both sides are reduced first, to a state per value and a state per field (which reads no column); the join of the
    states multiplies the counts, so a value's share is its pairs of rows by all pairs of the field.
    """
    value = states(_fields(spark, d), ["feld", "wert"])
    rows = table(spark, d, "berichte").select(F.explode(F.array(F.lit("PatientID"), F.lit("bertyp"))).alias("feld"))
    whole = states(rows, ["feld"]).withColumn("alle", F.col("n"))
    pairs = eager_join(value, whole, ["feld"])
    return pairs.filter((F.col("wert") != "") & (F.col("n") > F.col("alle").cast("double") * F.col("alle") * HEAVY)).select("feld", "wert")


def p4_schluessel(spark: SparkSession, d: str) -> DataFrame:
    """Count, first and last arrival of every patient and report type."""
    s = states(_fields(spark, d), ["feld", "wert"], erster=F.min("eingang"), letzter=F.max("eingang"))
    return s.select("feld", "wert", F.col("n").alias("anzahl"), "erster", "letzter")


def p4_verbund(spark: SparkSession, d: str) -> DataFrame:
    """Per patient, rows and score sum of the join of reports, codes and scores, from three states."""
    b = states(table(spark, d, "berichte").select(clean_id("PatientID").alias("PatientID"), "eingang").filter("PatientID <> ''"), ["PatientID"], erster=F.min("eingang"), letzter=F.max("eingang"))
    i = states(table(spark, d, "icd").select(clean_id("PatientID").alias("PatientID")).filter("PatientID <> ''"), ["PatientID"])
    score = F.when(strip("ICDSC_Max").rlike(r"^0*[0-8](\.0+)?$"), strip("ICDSC_Max").try_cast("double")).cast("bigint")
    c = states(table(spark, d, "icdsc").select(clean_id("PatientID").alias("PatientID"), score.alias("s")).filter("PatientID <> ''"), ["PatientID"], summe=F.coalesce(F.sum("s"), F.lit(0)))
    j = eager_join(eager_join(b, i, ["PatientID"]), c, ["PatientID"], {"summe": "right"})
    return j.select("PatientID", F.col("n").cast("bigint").alias("zeilen"), F.col("summe").cast("bigint").alias("summe"), "erster", "letzter")


def p4_folge(spark: SparkSession, d: str) -> DataFrame:
    """Every report's place in its patient's reports by arrival; reports without an id stay apart under the empty id."""
    b = table(spark, d, "berichte").select("report_nr", clean_id("PatientID").alias("PatientID"), "eingang")
    return rank_within(b, ["PatientID"], F.to_date("eingang"), [F.col("eingang").asc_nulls_last(), F.col("report_nr")])


# ---- 5 references to records that do not exist


def _references(spark: SparkSession, d: str) -> DataFrame:
    return (
        references(table(spark, d, "berichte"), "berichte", "report_nr", "PatientID", "eingang")
        .unionByName(references(table(spark, d, "icd"), "icd", "icd_nr", "PatientID", "kodiert_am"))
        .unionByName(references(table(spark, d, "structured_baseline"), "structured_baseline", "baseline_nr", "PatientenID", "stand"))
    )


def p5_faelle(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows with key, time and reason."""
    return orphans(_references(spark, d), table(spark, d, "patienten"), "PatientID", "registriert_am", "geloescht_am")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name a patient whom the register doesn't hold at their time."""
    return p5_faelle(spark, d).select("tabelle", "nr")


def p5_monate(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month."""
    return orphan_report(p5_faelle(spark, d), _references(spark, d))


# ---- SQL

_S = f"[{SPACE_RE2}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def sql_label(c: str) -> str:
    return f"(CASE WHEN lower(coalesce({sql_strip(c)}, '')) IN ('nan', 'none', 'null') THEN '' ELSE coalesce({sql_strip(c)}, '') END)"


def sql_id(c: str) -> str:
    return f"regexp_replace({sql_label(c)}, '^(-?[0-9]+)\\.0$', '\\1')"


_FIELD = '(?:"(?:[^"]|"")*"|(?:[^";][^;]*)?)'
_COUNT = f"(CASE WHEN coalesce(zeile, '') = '' THEN 1 ELSE len(regexp_extract_all(';' || zeile, ';{_FIELD}', 0, 's')) END)"
_SECOND = f"regexp_extract(coalesce(zeile, ''), '^{_FIELD};({_FIELD})$', 1, 's')"
_CELL = f"(CASE WHEN {_SECOND} LIKE '\"%' THEN replace(substring({_SECOND}, 2, length({_SECOND}) - 2), '\"\"', '\"') ELSE {_SECOND} END)"
_REFS = f"""refs AS (
  SELECT 'berichte' AS tabelle, report_nr AS nr, {sql_id('"PatientID"')} AS id, eingang AS zeit FROM berichte
  UNION ALL SELECT 'icd', icd_nr, {sql_id('"PatientID"')}, kodiert_am FROM icd
  UNION ALL SELECT 'structured_baseline', baseline_nr, {sql_id('"PatientenID"')}, stand FROM structured_baseline),
faelle AS (SELECT r.tabelle, r.nr, r.id, r.zeit, CASE WHEN p."PatientID" IS NULL THEN 'fehlt' WHEN p.registriert_am > r.zeit THEN 'spaeter' WHEN p.geloescht_am <= r.zeit THEN 'geloescht' END AS grund
  FROM refs r LEFT JOIN patienten p ON p."PatientID" = r.id WHERE r.id <> '')"""
_PAIRS = f"""felder AS (SELECT 'PatientID' AS feld, {sql_id('"PatientID"')} AS wert, eingang FROM berichte UNION ALL SELECT 'bertyp', {sql_label('bertyp')}, eingang FROM berichte)"""

_CELLS = f"list_transform(regexp_extract_all(';' || zeile, ';{_FIELD}', 0, 's'), lambda x: CASE WHEN starts_with(x, ';\"') THEN replace(substring(x, 3, length(x) - 3), '\"\"', '\"') ELSE substring(x, 2) END)"
_SPELT = tuple((f, p) for f, p in (("%Y-%m-%d %H:%M:%S", "[0-9]{4}-.*:.*:.*"), ("%Y-%m-%d %H:%M", "[0-9]{4}-.*:.*"), ("%Y-%m-%d", "[0-9]{4}-.*"), ("%d.%m.%Y", ".*[.][0-9]{4}"), ("%d.%m.%y", ".*[.][0-9]{2}"), ("%Y/%m/%d", "[0-9]{4}/.*")))


def sql_date(c: str) -> str:
    t = sql_strip(c)
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match({t}, '{p}') THEN try_strptime({t}, '{f}') END" for f, p in _SPELT) + ")"


SQL: dict[str, str] = {
    "p2_berichte": f"""WITH z AS (SELECT roh_nr, {_CELLS} AS f FROM rohzeilen WHERE datei = 'Berichte.csv' AND regexp_full_match(coalesce(zeile, ''), '{_FIELD}(?:;{_FIELD})*', 's') AND zeile <> '' AND {_COUNT} = 8)
SELECT roh_nr, {sql_id('f[1]')} AS "PatientID", f[2] AS bername, {sql_label('f[3]')} AS bertyp, {sql_date('f[4]')} AS berdat, f[5] AS diag, f[6] AS epikrise, f[7] AS jetziges_leiden, f[8] AS prozedere FROM z""",
    "p2_found": f"""WITH r AS (SELECT roh_nr AS nr, CASE
    WHEN NOT regexp_full_match(coalesce(zeile, ''), '{_FIELD}(?:;{_FIELD})*', 's') THEN 'anfuehrung'
    WHEN datei = 'Berichte.csv' AND {_COUNT} <> 8 OR datei = 'ICDSC.csv' AND {_COUNT} <> 2 THEN 'spaltenzahl'
    WHEN datei = 'ICDSC.csv' AND NOT regexp_full_match({sql_strip(_CELL)}, '(?:0*[0-8](?:\\.0+)?)?') THEN 'wert' END AS grund FROM rohzeilen)
SELECT 'rohzeilen' AS tabelle, nr, grund FROM r WHERE grund IS NOT NULL
UNION ALL SELECT 'icdsc', icdsc_nr, 'wert' FROM icdsc WHERE NOT regexp_full_match({sql_strip("coalesce(\"ICDSC_Max\", '')")}, '(?:0*[0-8](?:\\.0+)?)?')""",
    "p2_werte": f"""SELECT roh_nr, {sql_id(f"regexp_replace(regexp_extract(zeile, '^({_FIELD});', 1, 's'), '^\"|\"$', '', 'g')")} AS "PatientID", CAST(TRY_CAST({sql_strip(_CELL)} AS DOUBLE) AS INTEGER) AS "ICDSC_Max"
FROM rohzeilen WHERE datei = 'ICDSC.csv' AND regexp_full_match(coalesce(zeile, ''), '{_FIELD};{_FIELD}', 's') AND regexp_full_match({sql_strip(_CELL)}, '(?:0*[0-8](?:\\.0+)?)?')""",
    "p4_found": f"""WITH {_PAIRS} SELECT feld, wert FROM felder WHERE wert <> '' GROUP BY ALL HAVING count(*) > {HEAVY} * (SELECT count(*) FROM berichte)""",
    "p4_schluessel": f"""WITH {_PAIRS} SELECT feld, wert, count(*) AS anzahl, min(eingang) AS erster, max(eingang) AS letzter FROM felder GROUP BY ALL""",
    "p4_verbund": f"""WITH b AS (SELECT {sql_id('"PatientID"')} AS p, eingang FROM berichte), i AS (SELECT {sql_id('"PatientID"')} AS p FROM icd),
c AS (SELECT {sql_id('"PatientID"')} AS p, CASE WHEN regexp_full_match({sql_strip('"ICDSC_Max"')}, '0*[0-8](\\.0+)?') THEN CAST(TRY_CAST({sql_strip('"ICDSC_Max"')} AS DOUBLE) AS BIGINT) END AS s FROM icdsc)
SELECT b.p AS "PatientID", count(*) AS zeilen, CAST(coalesce(sum(c.s), 0) AS BIGINT) AS summe, min(eingang) AS erster, max(eingang) AS letzter
FROM b JOIN i ON b.p = i.p JOIN c ON b.p = c.p WHERE b.p <> '' GROUP BY b.p""",
    "p4_folge": f"""SELECT report_nr, "PatientID", eingang, row_number() OVER (PARTITION BY "PatientID" ORDER BY eingang NULLS LAST, report_nr) AS lfd
FROM (SELECT report_nr, {sql_id('"PatientID"')} AS "PatientID", eingang FROM berichte)""",
    "p5_faelle": f"WITH {_REFS} SELECT * FROM faelle WHERE grund IS NOT NULL",
    "p5_found": f"WITH {_REFS} SELECT tabelle, nr FROM faelle WHERE grund IS NOT NULL",
    "p5_monate": f"""WITH {_REFS} SELECT tabelle, strftime(zeit, '%Y-%m') AS monat, count(*) AS verweise, count(*) FILTER (grund = 'fehlt') AS fehlt,
count(*) FILTER (grund = 'spaeter') AS spaeter, count(*) FILTER (grund = 'geloescht') AS geloescht FROM faelle GROUP BY ALL""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_berichte, p2_werte, p4_found, p4_schluessel, p4_verbund, p4_folge, p5_found, p5_faelle, p5_monate)}
