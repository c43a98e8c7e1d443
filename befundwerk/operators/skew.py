"""Per-key results without a few tasks doing most of the work.

Nothing here gathers a key's rows in one task: keys are reduced to compact states before anything
is joined (eager aggregation), joins of whole rows spread hot keys by salt, and positions within
a key come from per-bucket counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def states(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """One compact state per key: ``n`` rows and the given aggregates, combined on the map side first.

    Null keys form a key of their own; an empty input has no states.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in aggregates.items()))


def eager_join(left: DataFrame, right: DataFrame, on: Sequence[str], sums: dict[str, str] | None = None, how: str = "inner") -> DataFrame:
    """The aggregate of a join from both sides' states, without joining any two rows.

    Both inputs hold at most one row per key with a row count ``n``. Each pair of rows of the join
    counts once, so the result's ``n`` is the product of the counts, and the sum of a column of one
    side is its own sum times the count of the other; ``sums`` maps such columns to ``left`` or
    ``right``. Columns with clashing names keep the left value. With ``how="left"`` a missing
    partner counts as one row without values. Counts and whole sums come out as decimal(38, 0).
    """
    sums = sums or {}
    other = right.select(*on, F.col("n").alias("_rn"), *(c for c in right.columns if c not in {*on, "n", *left.columns}))
    j = left.join(other, list(on), how)
    rn = F.coalesce(F.col("_rn"), F.lit(1))
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  # products of counts outgrow a long
    whole = {c for c, t in j.dtypes if t in ("tinyint", "smallint", "int", "bigint")}
    out = {c: (wide(F.col(c)) if c in whole else F.col(c)) * (rn if side == "left" else F.col("n")) for c, side in sums.items()}
    keep = [c for c in j.columns if c not in {"n", "_rn", *out}]
    return j.select(*keep, *(v.alias(k) for k, v in out.items()), (wide(F.col("n")) * rn).alias("n"))


def heavy_keys(state: DataFrame, key: str, share: float) -> DataFrame:
    """The keys of ``state`` with more than ``share`` of all rows: fewer than 1/share of them, whatever the input."""
    total = state.agg(F.sum("n").alias("_total"))
    return state.filter(F.col("n") > total.scalar() * share).select(key)


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame, spread: Column, salts: int = 32, how: str = "inner") -> DataFrame:
    """Equi-join of many rows with one row per key, the rows of ``hot`` keys spread over ``salts`` tasks.

    ``hot`` has fewer keys than 1/share (see heavy_keys), so it is broadcast; only its keys are
    repeated on the keyed side. ``spread`` is hashed to pick the salt. Null keys match nothing.
    """
    marked = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    left = rows.join(marked, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    right = keyed.join(marked, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def rank_within(df: DataFrame, by: Sequence[str], bucket: Column | Sequence[Column], order: Sequence[Column], name: str = "lfd") -> DataFrame:
    """Each row's position within its key from 1, hot keys included.

    The buckets, compared one after the other with nulls last, must not decrease along ``order``. Rows are sorted
    within (key, buckets) only; what precedes is added from the counts per bucket. Several buckets
    divide rows that share the first one (rows without a date, say).
    """
    parts = {f"_bucket{i}": c for i, c in enumerate([bucket] if isinstance(bucket, Column) else bucket)}
    b = df.withColumns(parts)
    counts = b.groupBy(*by, *parts).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(*(F.col(p).asc_nulls_last() for p in parts)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, *parts])), (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    inner = b.withColumn("_pos", F.row_number().over(Window.partitionBy(*by, *parts).orderBy(*order)))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*by, *parts])))
    return inner.join(before, same).select(*df.columns, (F.col("_pos") + F.col("_before")).cast("bigint").alias(name))
