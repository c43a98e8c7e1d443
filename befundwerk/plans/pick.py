"""Stratified picks for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from befundwerk.operators.cohort import sequential_groups
from befundwerk.session import cut_lineage


def sequential_pick(df: DataFrame, key: str, buckets: Sequence[str], n: int) -> DataFrame:
    """About n rows: per bucket predicate in turn the first max(3, n/len) by key not picked before, then the first of the rest.

    The table is computed once; the driver gets the few keys that may be picked, and the picks are joined
    back. Adds ``gruppe``; ties don't occur as keys are unique. Rows with a null key are never picked.
    """
    rows = cut_lineage(df.filter(F.col(key).isNotNull()))
    picks = sequential_groups(rows, key, {b: b for b in buckets}, max(3, n // max(1, len(buckets))), n)
    kind = rows.schema[key].dataType.simpleString()
    chosen = df.sparkSession.createDataFrame(picks, f"`{key}` {kind}, gruppe string")
    return rows.join(F.broadcast(chosen), key).orderBy(F.col("gruppe") == "rest", key)
