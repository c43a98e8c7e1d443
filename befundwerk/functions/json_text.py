"""JSON inside other text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Marks of a model's turns that may stand around its answer.
TURNS = ("<start_of_turn>user", "<start_of_turn>model", "<start_of_turn>", "<end_of_turn>")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)


def first_object(text: str | None) -> str | None:
    """The first text between matching braces, strings aside, the stripped text if there is none, null for null (JSN-1).

    The marks of a model's turns are cut first. What is between the braces needn't be valid JSON.
    """
    if text is None:
        return None
    bare = text.strip()
    cleaned = bare
    for mark in TURNS:
        cleaned = cleaned.replace(mark, "")
    start, depth = cleaned.find("{"), 0
    if start < 0:
        return bare
    for m in _TOKEN.finditer(cleaned, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return cleaned[start : m.end()]
    return bare


@F.pandas_udf(T.StringType())
def first_objects(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


def lenient(text: Column, schema: str) -> Column:
    """A struct from JSON with code fences or words around it; null where nothing parses."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:(?i:json))?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(bare.startswith("{"), F.from_json(bare, schema)), F.when(inner != "", F.from_json(inner, schema)))


def distinct_terms(xs: Column, most: int = 10) -> Column:
    """Trimmed terms, the first of those that differ in case only, at most ``most``."""
    clean = F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    once = F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda o: F.lower(o) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(once, 1, most)


# The keys of an extraction and the defaults of an interpretation.
SIGNALS = ("desorientierung", "delir_explizit", "hyperaktivitaet_agitation", "vigilanz", "delir_therapie", "delir_prophylaxe")
STRENGTHS = ("hoch", "mittel", "niedrig")
NO_CONTEXT = "keine verwertbare LLM-Interpretation"
INTERPRETATION = "signalstaerke string, kontext string, alternative_erklaerung boolean, alternative_erklaerung_keywords array<string>, begruendung array<string>"


def signals(answer: Column, most: int = 10) -> Column:
    """A struct with the six term lists of an extraction, each cleaned by ``distinct_terms``; what is no list is empty (JSN-3)."""
    doc = F.coalesce(answer, F.lit("{}"))
    one = lambda k: F.from_json(F.get_json_object(doc, f"$.{k}"), "array<string>")
    return F.struct(*(distinct_terms(one(k), most).alias(k) for k in SIGNALS))


def interpretation(answer: Column) -> Column:
    """A struct with the five fields of an interpretation; values out of range or of another type take their defaults (JSN-4)."""
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    v = F.try_parse_json(answer)
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    items = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.array().cast("array<string>"))
    strength = text("signalstaerke")
    return F.struct(
        F.when(strength.isin(*STRENGTHS), strength).otherwise("niedrig").alias("signalstaerke"),
        F.coalesce(text("kontext"), F.lit(NO_CONTEXT)).alias("kontext"),
        F.coalesce(F.when(kind("alternative_erklaerung") == "BOOLEAN", F.try_variant_get(v, "$.alternative_erklaerung", "boolean")), F.lit(False)).alias("alternative_erklaerung"),
        items("alternative_erklaerung_keywords").alias("alternative_erklaerung_keywords"),
        items("begruendung").alias("begruendung"),
    )


SNIPPETS = "array<struct<section:string,kind:string,term:string,text:string,priority:int>>"


def snippets_to_json(snippets: Column) -> Column:
    """Snippets as JSON text, ``[]`` for none (JSN-5)."""
    return F.when(F.size(F.coalesce(snippets, F.array().cast(SNIPPETS))) > 0, F.to_json(snippets)).otherwise("[]")


def snippets_from_json(text: Column) -> Column:
    """Snippets from JSON text; an empty list where it is empty, no list or doesn't parse (JSN-5)."""
    return F.coalesce(F.from_json(text, SNIPPETS), F.array().cast(SNIPPETS))
