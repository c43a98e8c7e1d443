"""Writers: fixed column order, tagged copies, append log, frozen results."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from befundwerk.session import exists


def slug(tag: str, most: int = 200) -> str:
    """A tag as part of a file name."""
    return re.sub(r"[^0-9A-Za-z_-]+", "_", tag.strip())[:most]


def write_csv(df: DataFrame, columns: Sequence[str], path: str, tag: str | None = None) -> None:
    """CSV in fixed column order; a second copy under the tag if one is given. Booleans become True and False."""
    out = df.select(*(F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if dict(df.dtypes)[c] == "boolean" else F.col(c) for c in columns))
    for p in [path] + ([f"{path}_{slug(tag)}"] if tag else []):
        out.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(p)


def append_log(df: DataFrame, path: str) -> None:
    """Each row as JSON with the time of writing, appended; nothing is rewritten."""
    df.select(F.current_timestamp().alias("zeit"), F.to_json(F.struct("*")).alias("zeile")).write.mode("append").parquet(path)


def failures(df: DataFrame, path: str, error: str = "fehler") -> None:
    """The rows with an error as JSON lines, whole, for a later look; the others aren't written (SNK-4)."""
    df.filter(F.col(error).isNotNull()).write.mode("append").json(path)


def digest(df: DataFrame) -> str:
    """A content digest that doesn't depend on order or partitions; equal rows count as often as they occur."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, s = df.agg(F.count(F.lit(1)), F.sum(h)).first()
    return f"{n}-{s or 0}"


def freeze(df: DataFrame, path: str, note: dict | None = None) -> dict:
    """Write once, with digest and row count; a second freeze fails while the first exists."""
    df.write.mode("errorifexists").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    facts = {"digest": digest(kept), "rows": kept.count(), "columns": kept.columns} | (note or {})
    df.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}_facts")
    return facts


def frozen_or_live(spark: SparkSession, frozen: str, live: str) -> DataFrame:
    """The frozen table if there is one, else the live one."""
    return spark.read.parquet(frozen if exists(spark, frozen) else live)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; refused beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])
