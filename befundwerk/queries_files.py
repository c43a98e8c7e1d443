"""Queries of readers and writers: tables are written as files to the shared folder and read back, so that each reader is compared with its table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from befundwerk.functions.clean import clean_id, strip
from befundwerk.functions.schema import assert_binary, fold, require
from befundwerk.queries_core import sql_id, sql_strip
from befundwerk.plans.predict import predict
from befundwerk.queries_ref import _IN, _R, query, reports
from befundwerk.queries_text import _EVIDENCE, texts
from befundwerk.session import shared_folder, table
from befundwerk.sources.delimited import ARTIFACTS, head_in_order, read_artifact, read_delimited, read_entries, read_texts, read_union, unpack_first_column
from befundwerk.sources.sinks import append_log, failures, freeze, frozen_or_live, write_csv


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for one query's files below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, where: str) -> str:
    """One text column as a text file per task."""
    df.write.text(where)
    return where


def _cell(c: str) -> Column:
    """A field in quotes, quotes doubled, as a delimited file holds it; null is nothing."""
    return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.col(c), '"', '""'), F.lit('"')), F.lit(""))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores whose fields hold no line break, as lines of a file, each tenth of them once more with a field too many."""
    both = F.concat(F.coalesce("PatientID", F.lit("")), F.coalesce("ICDSC_Max", F.lit("")))
    t = table(spark, d, "icdsc").filter(~both.rlike("[\r\n]"))
    good = t.select(F.concat_ws(";", F.col("icdsc_nr").cast("string"), _cell("PatientID"), _cell("ICDSC_Max")).alias("value"))
    return good.unionByName(t.filter(F.pmod("icdsc_nr", F.lit(10)) == 0).select(F.lit("1;a;b;").alias("value")))


_PLAIN = "NOT regexp_matches(coalesce(\"PatientID\", '') || coalesce(\"ICDSC_Max\", ''), '[\\r\\n]')"


@query(f"""SELECT CAST(icdsc_nr AS VARCHAR) AS icdsc_nr, nullif("PatientID", '') AS "PatientID", nullif("ICDSC_Max", '') AS "ICDSC_Max" FROM icdsc WHERE {_PLAIN}""")
def src1_src4_lesen(spark: SparkSession, d: str) -> DataFrame:
    """Scores in files of many tasks, rows with a field too many among them, read tolerantly; blanks in the given header are cut, an empty field is null, quoted or not (SRC-1, SRC-2, SRC-4)."""
    return read_delimited(spark, _lines(_scores(spark, d), _folder(spark, "lesen")), names=["icdsc_nr", "PatientID ", "ICDSC_Max"])[0]


@query(f"SELECT count(*) FILTER (icdsc_nr % 10 = 0) AS verworfen, count(*) AS gelesen FROM icdsc WHERE {_PLAIN}")
def src2_verworfen(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of such files are dropped and kept (SRC-2)."""
    rows, rejected = read_delimited(spark, _lines(_scores(spark, d), _folder(spark, "verworfen")), names=["icdsc_nr", "PatientID", "ICDSC_Max"])
    n = lambda df, a, b: df.agg(F.count(F.lit(1)).alias("n")).select(*((F.col("n") if x else F.lit(0).cast("bigint")).alias(name) for name, x in (("verworfen", a), ("gelesen", b))))
    return n(rejected, True, False).unionByName(n(rows, False, True)).agg(F.sum("verworfen").alias("verworfen"), F.sum("gelesen").alias("gelesen"))


@query(f"""SELECT baseline_nr, "PatientenID", max_icdsc, has_delir_icd10 FROM structured_baseline""")
def src5_snk1_artefakt(spark: SparkSession, d: str) -> DataFrame:
    """Baseline written in fixed column order and read with its declared schema: ids stay text (SRC-5, SNK-1)."""
    where = _folder(spark, "artefakt")
    write_csv(table(spark, d, "structured_baseline"), ["baseline_nr", "PatientenID", "max_icdsc", "has_delir_icd10"], where)
    return read_artifact(spark, where, ARTIFACTS["baseline"])


_ENTRY = f"regexp_replace({sql_strip('epikrise')}, '[\\r\\n]+', ' ', 'g')"


@query(f"""SELECT report_nr, {sql_strip(_ENTRY)} AS "Value" FROM (SELECT CAST(report_nr AS VARCHAR) AS report_nr, epikrise FROM berichte WHERE NOT contains(epikrise, ';') AND {sql_strip('epikrise')} <> '')""")
def src7_win6_eintraege(spark: SparkSession, d: str) -> DataFrame:
    """Entries of four fields whose last one runs over several lines, taken apart again (SRC-7, WIN-6)."""
    b = table(spark, d, "berichte").filter(~F.col("epikrise").contains(";") & (strip("epikrise") != ""))
    text = strip(F.regexp_replace(strip("epikrise"), "[\r\n]+", " "))
    e = read_entries(spark, _lines(b.select(F.concat_ws(";", F.col("report_nr").cast("string"), F.lit("d"), F.lit("t"), text).alias("value")), _folder(spark, "eintraege")))
    return e.select(F.col("PatientID").alias("report_nr"), "Value")


@query(f"""SELECT CAST(icd_nr AS VARCHAR) AS "PatientID", coalesce(icd_code, '') || ';rest' AS "Value" FROM icd WHERE NOT contains(coalesce(icd_code, ''), ';') AND trim(coalesce(icd_code, '')) = coalesce(icd_code, '')""")
def src8_gepackt(spark: SparkSession, d: str) -> DataFrame:
    """Four fields packed into the first column, the last one's rest in the second (SRC-8)."""
    code = F.coalesce("icd_code", F.lit(""))
    i = table(spark, d, "icd").filter(~code.contains(";") & (F.trim(code) == code))
    packed = i.select(F.concat_ws(";", F.col("icd_nr").cast("string"), F.lit("d"), F.lit("t"), code).alias("p"), F.lit("rest").alias("r"))
    return unpack_first_column(packed, "p", "r", ("PatientID", "ParameterID", "Time", "Value")).select("PatientID", "Value")


@query("SELECT r_name AS name, 'region' AS quelle, CAST(NULL AS VARCHAR) AS n_regionkey FROM region UNION ALL SELECT n_name, 'nation', CAST(n_regionkey AS VARCHAR) FROM nation")
def src9_set1_vereint(spark: SparkSession, d: str) -> DataFrame:
    """Two files with different columns and one that isn't there, read as one table with the file's name (SRC-9, SET-1)."""
    where = _folder(spark, "vereint")
    for t, cols in (("region", ["r_name"]), ("nation", ["n_name", "n_regionkey"])):
        one = table(spark, d, t).select(F.col(cols[0]).alias("name"), *cols[1:])
        one.coalesce(1).write.option("header", True).option("sep", ";").csv(f"{where}/{t}")
    u = read_union(spark, [f"{where}/{t}" for t in ("region", "nation", "fehlt")])
    return u.select("name", F.regexp_extract("quelle", r".*/vereint-[0-9a-f]+/(\w+)/", 1).alias("quelle"), "n_regionkey")


@query("SELECT n_nationkey, n_name || chr(10) || 'Zeile 2' AS text FROM nation")
def src10_texte(spark: SparkSession, d: str) -> DataFrame:
    """A folder of text files, one row per file (SRC-10)."""
    where = _folder(spark, "texte")
    table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("\nZeile 2")).alias("t")).write.partitionBy("n_nationkey").text(where)
    t = read_texts(spark, f"{where}/*", whole_name=True)
    return t.select(F.regexp_extract("datei", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), F.regexp_replace("text", r"\n$", "").alias("text"))


@query(f"WITH {_R} SELECT report_nr, typ FROM r WHERE {_IN} ORDER BY report_nr LIMIT 100")
def src11_srt8_vorschau(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred reports in the loader's order (SRC-11, SRT-8)."""
    return head_in_order(reports(spark, d).filter("typ <> 'Dokumentationsblatt'").select("report_nr", "typ"), "report_nr", 100)


@query(f"""SELECT icd_nr, {sql_id('"PatientID"')} AS "PatientenID", icd_code FROM icd""")
def src3_prj3_spalten(spark: SparkSession, d: str) -> DataFrame:
    """Columns under other names and with blanks in the header, folded to their own (SRC-3, PRJ-3, PRJ-4)."""
    odd = table(spark, d, "icd").withColumnsRenamed({"PatientID": " PatientID ", "icd_code": "Code"})
    return require(fold(odd), ["PatientenID", "icd_code"], "icd").select("icd_nr", clean_id("PatientenID").alias("PatientenID"), "icd_code")


@query("SELECT baseline_nr, baseline_icd10 AS klasse FROM structured_baseline WHERE baseline_icd10 IS NOT NULL")
def prj23_binaer(spark: SparkSession, d: str) -> DataFrame:
    """A column that must be 0 or 1, checked while it is read (PRJ-23)."""
    return assert_binary(table(spark, d, "structured_baseline").filter("baseline_icd10 IS NOT NULL").select("baseline_nr", F.col("baseline_icd10").alias("klasse")), "klasse")


@query("SELECT r_regionkey, r_name, 2 AS mal FROM region")
def snk2_snk3_protokoll(spark: SparkSession, d: str) -> DataFrame:
    """A tagged copy and a log that is appended to twice, read back (SNK-2, SNK-3)."""
    where = _folder(spark, "protokoll")
    r = table(spark, d, "region")
    write_csv(r, ["r_regionkey", "r_name"], f"{where}/csv", "Lauf 1/ä")
    for _ in range(2):
        append_log(spark.read.option("header", True).csv(f"{where}/csv_Lauf_1_"), f"{where}/log")
    x = F.from_json("zeile", "r_regionkey string, r_name string")
    log = spark.read.parquet(f"{where}/log").select(x.alias("x")).select(F.col("x.r_regionkey").cast("int").alias("r_regionkey"), "x.r_name")
    return log.groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).cast("int").alias("mal"))


@query(f"WITH {_R} SELECT report_nr, 'leer' AS fehler FROM r WHERE coalesce(diag, epikrise, jetziges_leiden, prozedere) IS NULL")
def snk4_fehler(spark: SparkSession, d: str) -> DataFrame:
    """Failed calls set apart with what was asked and said (SNK-4); here a report without text fails."""
    r = texts(spark, d).select("report_nr", F.col("t").alias("frage")).select("report_nr", "frage", F.lit("").alias("roh"), F.when(F.col("frage").isNull(), "leer").alias("fehler"))
    where = _folder(spark, "fehler")
    failures(r, where)
    return spark.read.json(where, schema="report_nr long, frage string, roh string, fehler string").select("report_nr", "fehler")


@query("SELECT n_nationkey, n_name FROM nation")
def snk5_snk6_frieren(spark: SparkSession, d: str) -> DataFrame:
    """A result that is frozen with its digest and then read before the live one (SNK-5, SNK-6)."""
    where = _folder(spark, "gefroren")
    freeze(table(spark, d, "nation").select("n_nationkey", "n_name"), where)
    return frozen_or_live(spark, where, f"{where}-gibt-es-nicht")


def _stub(asked: str) -> str:
    """A client that always says the same of the same evidence."""
    return 'Antwort: {"signalstaerke": "' + ("hoch" if "| direct_delir |" in asked else "mittel") + '", "kontext": "k", "begruendung": ["b"]}<end_of_turn>'


@query(f"""WITH {_EVIDENCE} SELECT report_nr, send AS gesendet, CASE WHEN send THEN CASE WHEN has_direct THEN 'hoch' ELSE 'mittel' END END AS signalstaerke, CASE WHEN send THEN 'processed' ELSE 'skipped' END AS status, CASE WHEN send THEN 'k' ELSE 'no_evidence_prefilter_skip' END AS kontext FROM e""")
def dec6_dec7_prognosen(spark: SparkSession, d: str) -> DataFrame:
    """Every report's prediction by a stand-in client: gate, both calls, answer contracts, rows without evidence (SRC-13, DEC-6, DEC-7, DEC-10)."""
    p = predict(texts(spark, d).select("report_nr", F.col("t").alias("text")), _stub)
    return p.select("report_nr", "gesendet", "antwort.signalstaerke", "status", "kontext")
