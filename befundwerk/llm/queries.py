"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from befundwerk.llm.mojibake import misread
from befundwerk.llm.mix import mix_sources
from befundwerk.llm.pii import ARTS, name_words, personal_data, redacted
from befundwerk.llm.pieces import rule_faults, split_documents
from befundwerk.llm.tokens import encode_texts
from befundwerk.session import table


MISREAD_FIELDS = ("epikrise", "jetziges_leiden", "prozedere")


def p1_texte(spark: SparkSession, d: str) -> DataFrame:
    """Wrongly read field values with the restored text; the report types are the sources."""
    return misread(table(spark, d, "berichte"), "report_nr", MISREAD_FIELDS, source="bertyp").withColumnRenamed("nr", "report_nr")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Field values in which signs were replaced by reading bytes in a wrong code page."""
    return p1_texte(spark, d).select("report_nr", "feld")


PERSONAL_FIELDS = ("epikrise", "jetziges_leiden", "diag")


def _names(spark: SparkSession, d: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return name_words([table(spark, d, "patienten"), table(spark, d, "personal")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of personal data, numbered per kind in its field; account numbers are redacted but no kind here."""
    return personal_data(table(spark, d, "berichte"), "report_nr", PERSONAL_FIELDS, _names(spark, d)).filter(F.col("art").isin(*ARTS)).select(F.col("nr").alias("report_nr"), "feld", "art", "lfd")


def p3_texte(spark: SparkSession, d: str) -> DataFrame:
    """The reports' texts with placeholders."""
    return redacted(table(spark, d, "berichte"), "report_nr", PERSONAL_FIELDS, _names(spark, d)).withColumnRenamed("nr", "report_nr")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of the mix with their number of uses."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_ziele"))[0]


def p7_anteile(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_ziele"))[1]


def p7_erfuellbar(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the mix with the largest total at which every source that has records fills its share."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_ziele"), "feasible")[1]


def p8_regeln(spark: SparkSession, d: str) -> DataFrame:
    """The rules that no pieces can follow, with the reason."""
    return rule_faults(table(spark, d, "teil_grenzen"))


def p8_stuecke(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document above a limit."""
    return split_documents(table(spark, d, "documents"), table(spark, d, "teil_grenzen"))


QUERIES = {f.__name__: f for f in (p1_found, p1_texte, p3_found, p3_texte, p6_ids, p7_mix, p7_anteile, p7_erfuellbar, p8_stuecke, p8_regeln)}

SQL: dict[str, str] = {
    "p8_regeln": """SELECT regel, CASE WHEN tokenizer IS NULL THEN 'tokenizer' WHEN max_tokens IS NULL OR max_tokens < 4 THEN 'max_tokens' WHEN overlap_tokens < 0 OR overlap_tokens >= max_tokens THEN 'overlap_tokens' END AS grund FROM teil_grenzen
WHERE tokenizer IS NULL OR max_tokens IS NULL OR max_tokens < 4 OR overlap_tokens < 0 OR overlap_tokens >= max_tokens""",
}
