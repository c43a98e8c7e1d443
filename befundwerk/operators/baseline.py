"""The patient baseline from two sources, its thresholds, and comparison with predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from befundwerk.functions.clean import clean_id, flag, number, strip
from befundwerk.functions.terms import CODES


def main_diagnosis(c: Column | str) -> Column:
    """Whether a mark's whole part is 1 or it spells yes (fixed spellings)."""
    s = strip(c)
    return F.coalesce(number(c).cast("int") == 1, F.lit(False)) | F.coalesce(s.isin("1", "True", "true", "JA", "Ja", "ja"), F.lit(False))


def valid_code(c: Column | str) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(*CODES), F.lit(False))


def code_flags(icd: DataFrame) -> DataFrame:
    """Per patient, whether a main diagnosis has a listed code, and all listed codes whatever their mark."""
    ok = valid_code("icd_code")
    return icd.groupBy(clean_id("PatientID").alias("pid")).agg(F.max(flag(ok & main_diagnosis("icd_hd"))).alias("has_code"), F.concat_ws(" | ", F.array_sort(F.collect_set(F.when(ok, strip("icd_code"))))).alias("codes"))


def max_scores(icdsc: DataFrame) -> DataFrame:
    """Per patient the highest score; cells that spell no number count as 0."""
    return icdsc.groupBy(clean_id("PatientID").alias("pid")).agg(F.max(F.coalesce(number("ICDSC_Max"), F.lit(0.0))).alias("max_score"), F.count_if(number("ICDSC_Max").isNull()).alias("bad"))


def thresholds(df: DataFrame, code: str = "has_code", score: str = "max_score", mode: str = "AND") -> DataFrame:
    """Threshold flags of code and score. A fraction between 0 and 1 or 3 and 4 falls in no band."""
    if mode not in ("AND", "OR"):
        raise ValueError("mode is AND or OR")
    s, c = F.col(score), F.col(code) == 1
    both = c & (s >= 4) if mode == "AND" else c | (s >= 4)
    cols = {f"ge_{t}": flag(s >= t) for t in range(1, 6)} | {"eq_0": flag(s == 0), "mid_1_3": flag((s >= 1) & (s <= 3)), "composite": flag(both)}
    cls = F.when(c, 2).when(s >= 6, 2).when(s >= 4, 1).otherwise(0).cast("int")
    return df.select("*", *(v.alias(k) for k, v in cols.items()), cls.alias("class_3"))


def baseline(icd: DataFrame, icdsc: DataFrame, mode: str = "AND") -> DataFrame:
    """One row per patient of either source, with thresholds; the empty id is a patient like any other."""
    j = code_flags(icd).join(max_scores(icdsc).drop("bad"), "pid", "outer")
    return thresholds(j.select("pid", F.coalesce("has_code", F.lit(0)).cast("int").alias("has_code"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"), F.coalesce("codes", F.lit("")).alias("codes")), mode=mode)


def long_form(df: DataFrame, keep: list[str], columns: list[str], name: str = "feld", value: str = "wert") -> DataFrame:
    """One row per row and column, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns))
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, f"_x.{name}", f"_x.{value}")


def rate(a: Column, b: Column) -> Column:
    """a/b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def confusion(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """Counts and rates of a binary prediction per group, in one pass, rounded to 6 places."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    r = {"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "f1": rate(2 * tp, 2 * tp + fp + fn), "accuracy": rate(tp + tn, tp + tn + fp + fn)}
    return n.select("*", *(F.round(v, 6).alias(k) for k, v in r.items()))


def odds(df: DataFrame, by: list[str], exposed: str, outcome: str) -> DataFrame:
    """2x2 counts and odds ratio per group; half is added to each cell if one is 0."""
    e, o = F.col(exposed) == 1, F.col(outcome) == 1
    n = df.groupBy(*by).agg(F.count_if(e & o).alias("a"), F.count_if(e & ~o).alias("b"), F.count_if(~e & o).alias("c"), F.count_if(~e & ~o).alias("d"))
    k = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    a, b, c, d = (F.col(x) + k for x in "abcd")
    return n.select("*", F.round(a * d / (b * c), 6).alias("odds_ratio"))


def id_sets(tables: dict[str, DataFrame], key: str = "pid") -> DataFrame:
    """One row per id with a flag per table that holds it: all overlaps of any number of tables in one grouping."""
    names = list(tables)
    every = reduce(DataFrame.unionByName, (df.select(key).distinct().select(key, *(F.lit(int(n == name)).alias(n) for n in names)) for name, df in tables.items()))
    return every.groupBy(key).agg(*(F.max(n).alias(n) for n in names))
