"""Term groups of the report scan and predicates over them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The term groups, section headings and limits that results depend on.
DIRECT = ("hyperaktives delir", "hypoaktives delir", "delirium", "delirant", "delirös", "delir")
INDIRECT = ("bewusstseinstrübung", "bewusstseinsstörung", "vigilanzminderung", "desorientierung", "verwirrtheit", "desorientiert", "soporös", "somnolent", "agitation", "agitiert", "unruhig", "vigilanz", "verwirrt")
NEGATION = ("keine delirante symptomatik", "kein hinweis auf delir", "kein delirium", "delir ausgeschlossen", "nicht delirant", "ohne hinweis auf delir", "kein delir")
PROPHYLAXIS = ("delirprophylaxe", "delir-screening", "delirscreening", "delirrisiko", "risiko für delir", "risiko fuer delir", "delirprävention", "delirpraevention", "delir-prävention", "delir monitoring", "delir-monitoring")
GROUPS = {"direct_delir": DIRECT, "indirect_symptom": INDIRECT, "negation": NEGATION, "prophylaxis_or_risk": PROPHYLAXIS}
HINTS = ("delir", "delirium", "delirant", "delirös", "verwirrt", "verwirrtheit", "desorientiert", "desorientierung", "agitiert", "agitation", "unruhig", "vigilanz", "vigilanzminderung", "somnolent", "soporös", "bewusstseinsstörung", "bewusstseinstrübung")
WORD_PATTERNS = ("delir", "delirium", "delirant", "delirös", "hypoaktives delir", "hyperaktives delir")
STEMS = ("desorient", "vigilanz", "agitiert", "verwirr")
SECTIONS = (("[Diagnosen]", "diag"), ("[Jetziges Leiden]", "jetziges_leiden"), ("[Epikrise]", "epikrise"), ("[Prozedere]", "prozedere"))
SECTION_ORDER = {"diag": 1, "jetziges_leiden": 2, "epikrise": 3, "prozedere": 4, "unknown": 5}
CODES = ("F05.0", "F05.8", "F05.9")
EXCLUDED_TYPE = "Dokumentationsblatt"
MATRIX_TYPES = ("Verlaufseintrag", "Verlegungsbericht", "Austrittsbericht")


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds any term, case aside; false for null."""
    low = F.lower(text)
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return F.coalesce(out, F.lit(False))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term, case aside; 0 for null."""
    low = F.lower(text)
    return F.when(low.contains(term), F.regexp_count(low, F.lit(r"\Q" + term + r"\E"))).otherwise(0)


def word_match(text: Column, words: Sequence[str] = WORD_PATTERNS, stems: Sequence[str] = ()) -> Column:
    """Whether a text holds one of the words as a word, or a word that begins with one of the stems."""
    parts = [re.escape(w) for w in words] + [re.escape(s) + r"\w*" for s in stems]
    return F.coalesce(F.lower(text).rlike(r"(?U)\b(?:" + "|".join(parts) + r")\b"), F.lit(False))
