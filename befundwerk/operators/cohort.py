"""Cohorts for review: report spine beside predictions, label overrides, picks, error extracts and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from befundwerk.functions.clean import flag, number, strip, truthy
from befundwerk.functions.schema import require
from befundwerk.operators.skew import heavy_keys, salted_join, states
from befundwerk.session import cut_lineage

#: What a spine row without prediction is filled with (fixed values).
DEFAULTS = {"klasse": 0, "llm_skipped_by_prefilter": "False", "llm_text_reduction_method": "", "decision_rule_applied": "", "kontext": ""}
NO_EVIDENCE = "no_evidence_prefilter_skip"
FAILED = "Pipeline-Fehler:"
#: A key with more rows than this share is spread in joins.
HOT_SHARE = 1 / 256


def first_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, by a minimum that is combined on the map side, not a sort (WIN-3)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def processing_status(df: DataFrame, there: str = "da") -> DataFrame:
    """``df`` with status, llm_called and skipped_reason (PRJ-20): missing_prediction, skipped, failed or processed, in that order."""
    method, rule = strip(F.coalesce("llm_text_reduction_method", F.lit(""))), strip(F.coalesce("decision_rule_applied", F.lit("")))
    missing = ~F.coalesce(F.col(there), F.lit(False))
    skipped = truthy("llm_skipped_by_prefilter") | (method == NO_EVIDENCE) | (rule == NO_EVIDENCE)
    failed = F.coalesce(F.col("kontext").startswith(FAILED), F.lit(False))
    status = F.when(missing, "missing_prediction").when(skipped, "skipped").when(failed, "failed").otherwise("processed")
    reason = F.when(missing, "not_in_prediction_export").when(skipped, F.when(rule == "", NO_EVIDENCE).otherwise(rule)).when(failed, "pipeline_error").otherwise(rule)
    return df.select("*", status.alias("status"), flag(~missing & ~skipped).alias("llm_called"), reason.alias("skipped_reason"))


def spine_with_predictions(spine: DataFrame, predictions: DataFrame, keys: Sequence[str], order: str, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Every report of the spine once, beside its prediction by all keys, with defaults and status (JN-5, PRJ-20).

    Of repeated keys the first row by ``order`` counts on either side. Columns of both sides keep the
    spine's value; null keys have no partner. The keys name one report each, so no join key is hot.
    """
    left = first_rows(spine, keys, order)
    right = first_rows(predictions.select(*keys, order, *(c for c in predictions.columns if c not in {*keys, order, *spine.columns})), keys, order).drop(order)
    j = left.join(right.withColumn("da", F.lit(True)), list(keys), "left").withColumn("da", F.coalesce("da", F.lit(False)))
    j = j.withColumns({c: F.coalesce(c, F.lit(v)) if c in j.columns else F.lit(v) for c, v in defaults.items()})
    return processing_status(j)


def only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of ``left`` that ``right`` lacks (JN-6)."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def cohort_summary(cohort: DataFrame, negative: str = "klasse") -> DataFrame:
    """(bereich, wert, n): rows, status and call counts, the eight leading reasons of skipped and the five of processed negative reports (AGG-49).

    One grouping of the cohort; ties by the reason.
    """
    g = cut_lineage(cohort.groupBy("status", "llm_called", F.when(F.col("skipped_reason") == "", "(empty)").otherwise(F.col("skipped_reason")).alias("r"), (F.col(negative) == 0).alias("neg")).agg(F.count(F.lit(1)).alias("n")))
    part = lambda df, name, value: df.groupBy(value.alias("wert")).agg(F.sum("n").alias("n")).select(F.lit(name).alias("bereich"), "wert", "n")

    def top(df: DataFrame, name: str, most: int) -> DataFrame:
        return part(df, name, F.col("r")).orderBy(F.desc("n"), "wert").limit(most)

    out = part(g, "total", F.lit("rows"))
    for more in (part(g, "status", F.col("status")), part(g, "llm_called", F.col("llm_called").cast("string")), top(g.filter("status = 'skipped'"), "skipped_reason", 8), top(g.filter("status = 'processed' AND neg"), "processed_negative", 5)):
        out = out.unionByName(more)
    return out


def label(c: Column | str) -> Column:
    """A label 0 or 1, null for anything else (PRJ-13)."""
    n = number(c).cast("int")
    return F.when(n.isin(0, 1), n)


def merge_labels(cohort: DataFrame, labels: DataFrame, key: str, truth: str = "truth", comment: str = "comment") -> tuple[DataFrame, DataFrame]:
    """(cohort with overrides, unknown label ids) (JN-13).

    Only labels 0 and 1 and comments with content override what the cohort holds. A repeated id among the
    labels fails the job when the result is read; label ids that the cohort lacks are named, not merged.
    """
    require(cohort, [key], "cohort")
    require(labels, [key], "labels")
    l1 = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(label(truth)).alias("_t"), F.first(F.nullif(strip(comment), F.lit(""))).alias("_c"))
    once = F.assert_true(F.col("_n") == 1, F.concat(F.lit("repeated label id: "), F.col(key).cast("string"))).isNull()
    l1 = l1.filter(once | F.col(key).isNull()).select(key, "_t", "_c")
    old = lambda c: F.col(c) if c in cohort.columns else F.lit(None)
    merged = cohort.join(l1, key, "left").withColumns({truth: F.coalesce("_t", label(old(truth).cast("string"))), comment: F.coalesce("_c", old(comment).cast("string"))}).drop("_t", "_c")
    return merged, only_in(labels, cohort, [key])


def first_matches(df: DataFrame, key: str, predicates: Mapping[str, str], n: Mapping[str, int]) -> dict[str, list]:
    """The first n[name] keys of each predicate, in one pass over ``df`` per predicate that keeps n rows a task."""
    return {name: [r[0] for r in df.filter(p).orderBy(key).limit(n[name]).select(key).collect()] for name, p in predicates.items()}


def sequential_groups(df: DataFrame, key: str, predicates: Mapping[str, str], each: int, target: int) -> list[tuple[object, str]]:
    """(key, group) of a sequential pick: of each group in turn the first ``each`` keys not picked before, then the first of the rest.

    Groups may overlap. A group loses at most the picks of those before it, so the first each * (its place)
    keys of every group, and the first target + picks of all, settle everything: only these reach the driver.
    """
    names = list(predicates)
    lists = first_matches(df, key, {**predicates, "rest": "true"}, {**{name: each * (i + 1) for i, name in enumerate(names)}, "rest": target + each * len(names)})
    picked: dict[object, str] = {}
    for name in names:
        for k in [k for k in lists[name] if k not in picked][:each]:
            picked[k] = name
    for k in lists["rest"]:
        if len(picked) >= target:
            break
        picked.setdefault(k, "rest")
    return list(picked.items())[:target]


def examples(df: DataFrame, key: str, predicates: Mapping[str, str], fallback: int = 5) -> list[tuple[object, str]]:
    """(key, group): one row per predicate in turn without repeats; the first ``fallback`` rows under the first name if nothing matches (SRT-6)."""
    lists = first_matches(df, key, predicates, {name: i + 1 for i, name in enumerate(predicates)})
    picked: dict[object, str] = {}
    for name, keys in lists.items():
        for k in [k for k in keys if k not in picked][:1]:
            picked[k] = name
    if not picked:
        first = next(iter(predicates))
        picked = {r[0]: first for r in df.orderBy(key).limit(fallback).select(key).collect()}
    return list(picked.items())


def beside_hot(rows: DataFrame, keyed: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """Rows joined with one row per key, the rows of hot keys spread over tasks."""
    hot = heavy_keys(states(rows.select(key), [key]), key, HOT_SHARE)
    return salted_join(rows, keyed, key, hot, spread, how=how)


def concat_by_key(df: DataFrame, key: str, order: str, text: str, separator: str = " || ", name: str = "belege") -> DataFrame:
    """A key's texts in order as one text, blank ones left out (AGG-48).

    The rows of a key are joined in ranges of the order first and then the ranges, so a hot key's rows are sorted in
    many tasks; its text is one value all the same, and must fit in one row.
    """
    part = df.filter(F.coalesce(strip(text), F.lit("")) != "").withColumn("_r", F.floor(F.col(order) / 1024))
    rows = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("o"), F.col(text).alias("t"))))
    join = lambda c: F.array_join(F.transform(rows(c), lambda x: x["t"]), separator)
    ranges = part.groupBy(key, "_r").agg(join(order).alias(text))
    return ranges.groupBy(key).agg(join("_r").alias(name))


def top_terms(words: DataFrame, most: int, term: str = "wort") -> DataFrame:
    """The most frequent terms, ties by the term."""
    return words.groupBy(term).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), term).limit(most)


def id_sample(ids: DataFrame, key: str = "pid", most: int = 20) -> DataFrame:
    """(n, beispiele): the number of ids and the first ``most`` of them, an ellipsis behind them if there are more."""
    head = F.array_join(F.array_sort(F.collect_list(key)), ",")
    n = ids.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("h"))
    first = ids.orderBy(key).limit(most).agg(F.lit(None).cast("bigint").alias("n"), head.alias("h"))
    both = n.unionByName(first).agg(F.max("n").alias("n"), F.max("h").alias("h"))
    return both.select("n", F.concat(F.coalesce("h", F.lit("")), F.when(F.col("n") > most, "...").otherwise("")).alias("beispiele"))
