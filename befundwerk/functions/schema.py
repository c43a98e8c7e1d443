"""Column names: aliases folded to one name, required columns checked before anything runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted names of each column.
ALIASES = {
    "PatientenID": ("PatientID",),
    "icd_code": ("Code",),
    "icd_hd": ("IsHauptDiagn",),
    "ICDSC_Max": ("ICDSC_Value", "max_icdsc"),
    "bericht": ("bername",),
}


class SchemaError(ValueError):
    """Columns are missing; the message lists those that are there."""


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """``df``, if it has all columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{what} lacks {missing}; it has {df.columns}")
    return df


def fold(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Header blanks cut and aliases renamed; where a column is there under its own name, the alias is dropped."""
    df = df.toDF(*(c.strip() for c in df.columns))
    for name, others in aliases.items():
        for o in others:
            if o in df.columns:
                df = df.drop(o) if name in df.columns else df.withColumnRenamed(o, name)
    return df


def with_defaults(df: DataFrame, columns: Sequence[str], value: str = "") -> DataFrame:
    """Missing optional columns filled with a constant."""
    return df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})


def assert_binary(df: DataFrame, column: str) -> DataFrame:
    """``df``, failing at run time on the first value that isn't 0 or 1."""
    ok = F.coalesce(F.col(column).isin(0, 1), F.lit(False))
    checked: Column = F.when(F.assert_true(ok, F.concat(F.lit(f"{column} is not binary: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).isNull(), F.col(column))
    return df.withColumn(column, checked)


def shorten(c: Column, n: int) -> Column:
    """Text cut to n signs, the last of them an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
