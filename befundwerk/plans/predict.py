"""Report prediction: evidence first, a gate, and a model client for what passes it (SRC-13, DEC-6, DEC-7, DEC-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from befundwerk.functions.evidence import NO_EVIDENCE, Limits, evidence
from befundwerk.functions.json_text import INTERPRETATION, SIGNALS, first_object, first_objects, interpretation, signals
from befundwerk.session import cut_lineage

_SIGNALS_TYPE = "struct<" + ",".join(f"{k}:array<string>" for k in SIGNALS) + ">"
_ANSWER_TYPE = "struct<" + INTERPRETATION.replace(", ", ",").replace(" ", ":") + ">"
_FAILED = "Pipeline-Fehler: "


def predict(reports: DataFrame, client: Callable[[str], str], calls: int = 8, key: str = "report_nr", text: str = "text", timeout: float = 120.0, limits: Limits = Limits()) -> DataFrame:
    """(key, gesendet, signale, antwort, fehler, status, kontext) of every report.

    The client is asked twice for each report that passes the gate: for signals, then for an interpretation of the
    evidence with these signals. The gate filters before the Python node, since nothing is pushed into it. At
    most ``calls`` tasks call at a time, no call is waited for longer than ``timeout`` seconds, and the answers are written before they are
    used, so that no plan asks twice. A failing call gives an error row, not a failed job; reports without
    text or evidence aren't sent and have a row that says so.
    """
    e = reports.select(key, evidence(F.col(text), limits).alias("e"))
    asked = e.filter("e.send").select(key, F.col("e.sent_text").alias("frage")).repartition(calls)
    kind = dict(reports.dtypes)[key]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(1)
        for b in batches:
            out = []
            for q in b["frage"]:
                try:
                    found = pool.submit(client, q).result(timeout)
                    out.append((found, pool.submit(client, f"{q}\n\n{first_object(found)}").result(timeout), None))
                except Exception as x:  # noqa: BLE001
                    out.append((None, None, str(x) or type(x).__name__))
            yield pd.DataFrame({key: b[key], "gefunden": [a for a, _, _ in out], "roh": [a for _, a, _ in out], "fehler": [f for *_, f in out]})
        pool.shutdown(wait=False)

    answers = cut_lineage(asked.mapInPandas(ask, f"`{key}` {kind}, gefunden string, roh string, fehler string"))
    ok = F.col("fehler").isNull()
    answer = interpretation(first_objects(F.col("roh")))
    sent = answers.select(key, F.lit(True).alias("gesendet"), F.when(ok, signals(first_objects(F.col("gefunden")))).alias("signale"), F.when(ok, answer).alias("antwort"), "fehler", F.when(ok, "processed").otherwise("failed").alias("status"), F.when(ok, answer["kontext"]).otherwise(F.concat(F.lit(_FAILED), F.substring("fehler", 1, 500))).alias("kontext"))
    rest = e.filter("NOT e.send").select(key, F.lit(False).alias("gesendet"), F.lit(None).cast(_SIGNALS_TYPE).alias("signale"), F.lit(None).cast(_ANSWER_TYPE).alias("antwort"), F.lit(None).cast("string").alias("fehler"), F.lit("skipped").alias("status"), F.lit(NO_EVIDENCE).alias("kontext"))
    return sent.unionByName(rest)
