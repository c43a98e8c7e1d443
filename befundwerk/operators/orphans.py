"""References to records that don't exist at the time of the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from befundwerk.functions.clean import clean_id
from befundwerk.operators.skew import heavy_keys, salted_join
from befundwerk.session import cut_lineage

#: A key with more than this share of all references is spread; so at most 256 keys are broadcast.
HOT_SHARE = 1 / 256


def references(df: DataFrame, table: str, nr: str, key: str, at: str) -> DataFrame:
    """The references of one table as (tabelle, nr, id, zeit); rows without an id hold none."""
    return df.select(F.lit(table).alias("tabelle"), F.col(nr).alias("nr"), clean_id(key).alias("id"), F.col(at).alias("zeit")).filter(F.col("id") != "")


def orphans(refs: DataFrame, parents: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """The rows of ``refs`` whose parent is missing, arrives after the row's time or was deleted by then.

    The distinct keys, reduced to their first and last time and number of rows, go through a left
    anti-join against the parents' keys; those with a parent stay only if one of their rows may lie
    outside the parent's time. Only these suspects are joined back to the rows, hot ones salted.
    ``grund`` is ``fehlt``, ``spaeter`` or ``geloescht``. Parent keys are compared as they are; a null
    parent key matches nothing; if a key has several parents, the latest registration and the earliest
    deletion count. A row without a time is a case only if the parent is missing. Repeated rows are
    cases of their own. Empty inputs give no rows; further columns are ignored.
    """
    keys = cut_lineage(refs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("zeit").alias("t0"), F.max("zeit").alias("t1")))
    held = parents.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(since).alias("ab"), F.min(until).alias("bis"))
    missing = keys.join(held, "id", "left_anti").select("id", F.lit(None).cast("timestamp_ntz").alias("ab"), F.lit(None).cast("timestamp_ntz").alias("bis"), F.lit(True).alias("fehlt"))
    outside = (F.col("ab") > F.col("t0")) | (F.col("bis") <= F.col("t1"))
    timed = keys.join(held, "id").filter(outside).select("id", "ab", "bis", F.lit(False).alias("fehlt"))
    hot = heavy_keys(keys, "id", HOT_SHARE)
    rows = salted_join(refs, missing.unionByName(timed), "id", hot, F.col("nr"))
    grund = F.when(F.col("fehlt"), "fehlt").when(F.col("ab") > F.col("zeit"), "spaeter").when(F.col("bis") <= F.col("zeit"), "geloescht")
    return rows.select("tabelle", "nr", "id", "zeit", grund.alias("grund")).filter(F.col("grund").isNotNull())


def orphan_report(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans per table and month beside all references of that month."""
    monat = F.date_format("zeit", "yyyy-MM").alias("monat")
    n = lambda g: F.count_if(F.col("grund") == g).alias(g)
    bad = found.groupBy("tabelle", monat).agg(n("fehlt"), n("spaeter"), n("geloescht"))
    every = refs.groupBy("tabelle", monat).agg(F.count(F.lit(1)).alias("verweise"))
    b = bad.select(F.col("tabelle").alias("t"), F.col("monat").alias("m"), "fehlt", "spaeter", "geloescht")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return every.join(b, (F.col("tabelle") == F.col("t")) & F.col("monat").eqNullSafe(F.col("m")), "left").select("tabelle", "monat", "verweise", zero("fehlt"), zero("spaeter"), zero("geloescht"))
