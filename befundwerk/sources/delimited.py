"""Tolerant and strict readers of delimited and plain text files."""

from __future__ import annotations

import codecs
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from befundwerk.functions.clean import strip
from befundwerk.session import cut_lineage, exists

#: Encodings that are tried in this order; the last fits any bytes.
ENCODINGS = ("utf-8", "utf-16", "cp1252", "latin-1")
_JVM = {"utf-8": "UTF-8", "utf-16": "UTF-16", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}


def choose_encoding(path: str, candidates: Sequence[str] = ENCODINGS, chunk: int = 1 << 20) -> str:
    """The first encoding that decodes the whole file; read in chunks, so memory doesn't follow its size."""
    for name in candidates:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with open(path, "rb") as f:
                first = f.read(2)
                if name == "utf-16" and first not in (b"\xff\xfe", b"\xfe\xff"):
                    continue
                decoder.decode(first)
                while data := f.read(chunk):
                    decoder.decode(data)
                decoder.decode(b"", True)
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path}: none of {tuple(candidates)} fits")


def _from_cp1252(df: DataFrame) -> DataFrame:
    """Columns read as Latin-1 turned into what the same bytes are in cp1252."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(128, 160)]
    a, z = ("".join(x) for x in zip(*(p for p in pairs if p[1])))
    return df.select(*(F.translate(c, a, z).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def _raw_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every line with its bytes as the signs of the same numbers, from splittable tasks."""
    reader = spark.read.option("sep", "\x1e").option("quote", "").option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.schema("zeile string").csv(list(paths))


def detect_encoding(spark: SparkSession, paths: Sequence[str]) -> str:
    """The encoding of files on any file system, from a look at every line in the tasks; the driver gets three flags.

    UTF-16 shows by its mark; else UTF-8 if all lines are valid, cp1252 if no byte is undefined there, Latin-1 otherwise.
    """
    line = F.coalesce("zeile", F.lit(""))
    flags = _raw_lines(spark, paths).agg(F.bool_or(line.startswith("\xff\xfe") | line.startswith("\xfe\xff")), F.bool_and(F.is_valid_utf8(F.encode(line, "ISO-8859-1"))), F.bool_or(line.rlike("[\x81\x8d\x8f\x90\x9d]"))).first()
    return "utf-16" if flags[0] else "utf-8" if flags[1] in (True, None) else "latin-1" if flags[2] else "cp1252"


def _names(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """The header of a file: its first line, read where the file is."""
    first = spark.read.option("sep", "\x1e").option("quote", "").option("encoding", _JVM[encoding]).schema("zeile string").csv(path).head(1)
    line = (first[0][0] or "") if first else ""
    return [c.strip().strip('"') for c in line.lstrip("\ufeff").lstrip("ï»¿").rstrip("\r").split(sep)]


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ";", encoding: str | None = None, strict: bool = False, names: Sequence[str] | None = None, multi_line: bool | None = None, origin: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected raw records) of files; all columns are strings, header blanks are cut.

    Without ``names`` each file has a header. Rows with too many fields are rejected, also if the extra field
    is empty; short rows are kept and padded with nulls. With ``strict`` the first such row fails the read. A file
    without rows gives none. Records whose quoted fields hold line breaks need a whole file per task (``multi_line``, the default
    with a header); else files are split. ``origin`` names a column for the file's name.
    """
    paths = [path] if isinstance(path, str) else list(path)
    encoding = encoding or detect_encoding(spark, paths)
    header = names is None
    names = [c.strip() for c in names] if names else _names(spark, paths[0], sep, encoding)
    reader = spark.read.option("sep", sep).option("header", header).option("multiLine", header if multi_line is None else multi_line).option("encoding", _JVM[encoding]).option("quote", '"').option("escape", '"')
    fields = [T.StructField(n, T.StringType()) for n in names]
    named = lambda df: df.withColumn(origin, F.input_file_name()) if origin else df
    keep = [*names, *([origin] if origin else [])]
    if strict:
        df = named(reader.option("mode", "FAILFAST").schema(T.StructType(fields)).csv(paths))
        return (_from_cp1252(df) if encoding == "cp1252" else df), df.limit(0).select(F.lit(None).cast("string").alias("zeile"))
    schema = T.StructType([*fields, T.StructField("_roh", T.StringType())])
    df = named(reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_roh").schema(schema).csv(paths))
    df = cut_lineage(_from_cp1252(df) if encoding == "cp1252" else df)  # parsed once; Spark refuses queries of the raw record alone
    bare = F.regexp_replace("_roh", r'"([^"]|"")*"', "")
    long = F.col("_roh").isNotNull() & (F.regexp_count(bare, F.lit("\\Q" + sep + "\\E")) >= len(names))
    return df.filter(~F.coalesce(long, F.lit(False))).select(*keep), df.filter(long).select(F.col("_roh").alias("zeile"))


def read_union(spark: SparkSession, paths: Sequence[str], sep: str = ";") -> DataFrame:
    """All readable files in sorted order as one table with the file's name; columns missing in a file are null (SRC-9).

    Paths that don't exist are skipped. Files with the same header and encoding are one read.
    """
    groups: dict[tuple, list[str]] = {}
    for p in sorted(paths):
        if exists(spark, p):
            encoding = detect_encoding(spark, [p])
            groups.setdefault((encoding, *_names(spark, p, sep, encoding)), []).append(p)
    if not groups:
        raise FileNotFoundError("no readable files given")
    parts = [read_delimited(spark, own, sep, key[0], origin="quelle")[0] for key, own in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Schemas of what the stages write; ids are text.
ARTIFACTS = {
    "baseline": "baseline_nr bigint, PatientenID string, max_icdsc double, has_delir_icd10 int",
    "predictions": "PatientenID string, bericht string, bertyp string, klasse int, llm_skipped_by_prefilter string, llm_text_reduction_method string, decision_rule_applied string, kontext string",
    "comparison": "PatientenID string, bericht string, klasse int, prediction_binary int, agreement_report_vs_baseline_composite int",
}


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stage wrote, by its declared schema: nothing is inferred, a header that differs fails (SRC-5)."""
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema(schema).csv(path)


def read_texts(spark: SparkSession, path: str, whole_name: bool = False) -> DataFrame:
    """One row per text file with its name, or its whole path, and whole content."""
    name = F.input_file_name()
    return spark.read.text(path, wholetext=True).select((name if whole_name else F.element_at(F.split(name, "/"), -1)).alias("datei"), F.col("value").alias("text"))


def read_entries(spark: SparkSession, path: str, names: Sequence[str] = ("PatientID", "ParameterID", "Time", "Value")) -> DataFrame:
    """Entries of four fields split at the first three semicolons; lines without them continue the entry before.

    Each file is split where a line begins a new entry, so no order over rows is needed. Lines before
    the first entry, and the header, are skipped.
    """
    n = len(names) - 1
    head = r"[^;\n]*;" * n
    parts = F.split(F.regexp_replace("value", "\r\n?", "\n"), rf"\n(?={head})")
    one = spark.read.text(path, wholetext=True).select(F.posexplode(parts).alias("nr", "e")).filter(F.col("e").rlike(rf"(?s)^{head}"))
    cells = F.split("e", ";", len(names))
    df = one.select("nr", *(F.trim(cells[i]).alias(c) for i, c in enumerate(names)))
    return df.filter(F.col(names[0]) != names[0]).withColumn(names[-1], strip(F.regexp_replace(names[-1], r"\n\s*\n", "\n")))


def unpack_first_column(df: DataFrame, first: str, rest: str, names: Sequence[str]) -> DataFrame:
    """Rows whose first column holds all fields packed with semicolons, and the last field's remainder in the next column."""
    cells = F.split(first, ";", len(names))
    whole = F.concat_ws(";", cells[len(names) - 1], F.nullif(F.col(rest), F.lit("")))
    return df.filter(F.size(cells) >= len(names)).select(*(F.trim(cells[i]).alias(c) for i, c in enumerate(names[:-1])), F.trim(whole).alias(names[-1]))


def head_in_order(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by an order column; all rows without n."""
    return df if n is None else df.orderBy(order).limit(n)
