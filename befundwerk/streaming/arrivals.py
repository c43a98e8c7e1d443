"""Reports as a stream: counts per type and window, late ones dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from befundwerk.functions.clean import clean_label


def arrivals(stream: DataFrame, at: str = "eingang", kind: str = "bertyp", every: str = "1 day", late: str = "7 days") -> DataFrame:
    """(von, bis, typ, n) per window; works on a stream and on a table alike."""
    s = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    g = s.groupBy(F.window("_t", every).alias("w"), clean_label(kind).alias("typ")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("von"), F.col("w.end").alias("bis"), "typ", "n")
