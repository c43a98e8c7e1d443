"""Cohort operators, the evidence contract and JSON answers against brute force and awkward cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from befundwerk.functions.evidence import HEADER, INSTRUCTION, SHORT_WHOLE, Limits, evidence, excerpt_text, flat_snippets, highlight_text, presentation, short_fallback, snippet_cell, terms_text
from befundwerk.functions.json_text import NO_CONTEXT, first_object, interpretation, signals, snippets_from_json, snippets_to_json
from befundwerk.operators import cohort as c
from befundwerk.operators.skew import rank_within


def record(spark, text, limits=Limits()):
    return spark.createDataFrame([(text,)], "t string").select(evidence(F.col("t"), limits).alias("e")).first().e


# ---- evidence


def test_repeated_headings_and_flags(spark):
    e = record(spark, "[Diagnosen]\nx\n\n[Epikrise]\ny\n\n[Diagnosen]\nPatient mit Delir.")
    assert [s.section for s in e.snippets] == ["diag"]
    e = record(spark, "Kein Delir. Delirprophylaxe fortgesetzt.")
    assert e.prophylaxis_only and e.has_negation and e.send
    e = record(spark, "vorn verwirrt. [Prozedere] unruhig")
    assert [s.section for s in e.snippets] == ["prozedere", "unknown"]


def test_sent_text_and_budget(spark):
    e = record(spark, "[Epikrise]\nPatient verwirrt.")
    assert e.sent_text == f"{HEADER}\n\n[Epikrise | indirect_symptom | priority=1]\n[Epikrise] Patient verwirrt.\n\n{INSTRUCTION}"
    assert (e.sent_len, e.method) == (len(e.sent_text), "structured_evidence_extraction")
    long = " ".join(f"Der Patient war am {i}. Tag {t} und schlief dann wieder ein, so lang ist dieser Satz." for i, t in enumerate(("verwirrt", "unruhig", "agitiert", "somnolent")))
    cut = record(spark, long, Limits(bundle=1, chars=100))
    assert len(cut.snippets) == 4 and len(cut.sent_text) <= 500 and cut.sent_text.endswith(INSTRUCTION) and cut.sent_text.startswith(HEADER)
    assert cut.sent_text.count("priority=") < 4
    none = record(spark, "Kein Delir.")
    assert (none.send, none.sent_text, none.method) == (False, "", "no_evidence_prefilter_skip")
    assert Limits(snippets=0, chars=1, bundle=1, per_term=0, sentences=-1) == Limits(snippets=1, chars=80, bundle=500, per_term=1, sentences=0)


def test_short_reports(spark):
    rows = [("Routine.", "Verlaufseintrag"), ("Routine.", "Konsilium"), ("x" * 1001, "Austrittsbericht"), ("Patient verwirrt.", "Austrittsbericht"), (None, "Verlaufseintrag")]
    df = spark.createDataFrame(rows, "t string, k string")
    for on in (False, True):
        limits = Limits(send_short=on)
        got = [r.e for r in df.select(short_fallback(evidence(F.col("t"), limits), F.col("t"), F.col("k"), limits).alias("e")).collect()]
        assert [g.send for g in got] == [on, False, False, True, on]
        assert got[0].method == (SHORT_WHOLE if on else "no_evidence_prefilter_skip") and got[0].sent_text == ("Routine." if on else "")


def test_snippets_and_excerpts(spark):
    s = [{"section": "diag", "kind": "direct_delir", "term": "delir", "text": "", "priority": 1}, {"section": "diag", "kind": "direct_delir", "term": "delirium", "text": "", "priority": 2}, {"section": "x", "kind": "negation", "term": "kein delir", "text": "", "priority": 3}]
    assert highlight_text("Ein Delirium, Delir.", s[:2]) == "Ein ====Delir==ium==, Delir."
    assert excerpt_text("a" * 50 + " Delir " + "b" * 50, s[:1], 21) == "…" + "a" * 9 + " Delir " + "b" * 5 + "…" and excerpt_text("  ", s, 9) == "" and excerpt_text("abcdef", [], 4) == "abc…"
    assert terms_text(s) == "- direct_delir: delir, delirium\n- negation: kein delir" and terms_text([]) == "- (none)"
    df = spark.createDataFrame([(None, None), ("", [])], "t string, s array<struct<section:string,kind:string,term:string,text:string,priority:int>>")
    assert [tuple(r.p) for r in df.select(presentation(F.col("t"), F.col("s"), 9).alias("p")).collect()] == [("", "- (none)")] * 2
    t = spark.createDataFrame([("[Diagnosen]\nDelirium. " + "x" * 400,), (None,), ("nichts",)], "t string").select(flat_snippets(F.col("t")).alias("x")).collect()
    assert t[0].x.startswith("[Diagnosen] [Diagnosen] Delirium.") and len(t[0].x) <= 250 and [r.x for r in t[1:]] == ["", ""]
    cells = spark.createDataFrame([(" da ", "verwirrt", None, None), ("[]", None, "a| |b", "Delir"), ("nan", None, " ", "Delir\nheute"), (None, None, None, "nichts")], "e string, t string, s string, k string")
    assert [r.z for r in cells.select(snippet_cell(*(F.col(x) for x in "etsk")).alias("z")).collect()] == ["da", "[Treffer] a || [Treffer] b", "[Kontext] Delir heute", "[]"]


def test_json_answers(spark):
    assert first_object('<start_of_turn>model {"a": "}<end_of_turn>"} x') == '{"a": "}"}' and first_object('{"a": {"b": "\\"}"}} {"c"') == '{"a": {"b": "\\"}"}}'
    assert first_object(" {offen ") == "{offen" and first_object("") == "" and first_object("{'kein': json}") == "{'kein': json}"
    df = spark.createDataFrame([('{"vigilanz": [" A", "a", 1, ""], "delir_explizit": "x"}',), ("kaputt",), (None,), ('{"vigilanz": ' + str([str(i) for i in range(20)]).replace("'", '"') + "}",)], "t string")
    got = [r.s for r in df.select(signals(F.col("t")).alias("s")).collect()]
    assert [g.vigilanz for g in got] == [["A", "1"], [], [], [str(i) for i in range(10)]] and got[0].delir_explizit == []
    df = spark.createDataFrame([('{"signalstaerke": "hoch", "kontext": "k", "alternative_erklaerung": true, "begruendung": ["a"]}',), ('{"signalstaerke": "x", "kontext": 3, "alternative_erklaerung": "ja", "begruendung": "a"}',), ("kaputt",), (None,)], "t string")
    got = [tuple(r.i) for r in df.select(interpretation(F.col("t")).alias("i")).collect()]
    assert got == [("hoch", "k", True, [], ["a"])] + [("niedrig", NO_CONTEXT, False, [], [])] * 3
    e = spark.createDataFrame([("Delir \u00fc.",), ("nichts",)], "t string").select(snippets_to_json(evidence(F.col("t"))["snippets"]).alias("j")).select("j", snippets_from_json(F.col("j")).alias("s")).collect()
    assert e[0].s[0].term == "delir" and "\u00fc" in e[0].j and e[1].j == "[]" and e[1].s == []
    assert spark.createDataFrame([("{",), (None,)], "j string").select(snippets_from_json(F.col("j")).alias("s")).collect()[0].s == []


# ---- cohorts


def test_status_of_all_four_kinds(spark):
    spine = spark.createDataFrame([(1, "a", "r1"), (2, "a", "r2"), (3, "a", "r3"), (4, "b", "r1"), (5, "a", "r1"), (6, None, "r9")], "nr long, pid string, bericht string")
    pred = spark.createDataFrame([(1, "a", "r1", 1, "False", "", "regel", ""), (2, "a", "r2", 0, "yes", "", "", ""), (3, "a", "r3", 0, None, None, None, "Pipeline-Fehler: x"), (9, "z", "r1", 1, None, None, None, None)], "nr long, pid string, bericht string, klasse int, llm_skipped_by_prefilter string, llm_text_reduction_method string, decision_rule_applied string, kontext string")
    got = {r.nr: (r.status, r.llm_called, r.skipped_reason, r.klasse) for r in c.spine_with_predictions(spine, pred, ["pid", "bericht"], "nr").collect()}
    assert got == {1: ("processed", 1, "regel", 1), 2: ("skipped", 0, "no_evidence_prefilter_skip", 0), 3: ("failed", 1, "pipeline_error", 0), 4: ("missing_prediction", 0, "not_in_prediction_export", 0), 6: ("missing_prediction", 0, "not_in_prediction_export", 0)}
    assert [tuple(r) for r in c.only_in(pred, spine, ["pid", "bericht"]).collect()] == [("z", "r1")]
    assert c.spine_with_predictions(spine.limit(0), pred, ["pid", "bericht"], "nr").count() == 0
    assert {r.bereich for r in c.cohort_summary(c.spine_with_predictions(spine, pred, ["pid", "bericht"], "nr")).collect()} == {"total", "status", "llm_called", "skipped_reason"}


def test_label_merge(spark):
    co = spark.createDataFrame([("r1", "0", "alt"), ("r2", None, None), ("r3", "1", "x")], "id string, truth string, comment string")
    labels = spark.createDataFrame([("r1", "1.0", " "), ("r2", "2", "neu"), ("fremd", "1", None)], "id string, truth string, comment string")
    merged, unknown = c.merge_labels(co, labels, "id")
    assert {r.id: (r.truth, r.comment) for r in merged.collect()} == {"r1": (1, "alt"), "r2": (None, "neu"), "r3": (1, "x")}
    assert [r.id for r in unknown.collect()] == ["fremd"]
    with pytest.raises(Exception, match="repeated label id"):
        c.merge_labels(co, labels.unionByName(labels), "id")[0].collect()
    assert c.merge_labels(co.select("id"), labels.limit(0), "id")[0].count() == 3


def test_picks_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"p{i:03d}", rng.randint(0, 1), rng.randint(0, 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "pid string, a int, b int").repartition(7)
    groups = {"x": "a = 1", "y": "b = 0", "z": "a = 1 AND b = 0", "leer": "b > 9"}
    tests = {"x": lambda r: r[1] == 1, "y": lambda r: r[2] == 0, "z": lambda r: r[1] == 1 and r[2] == 0, "leer": lambda r: False}
    for each, target in ((3, 20), (10, 25), (5, 500)):
        want, seen = [], set()
        for g in groups:
            own = [r[0] for r in sorted(rows) if tests[g](r) and r[0] not in seen][:each]
            seen.update(own)
            want += [(p, g) for p in own]
        want += [(r[0], "rest") for r in sorted(rows) if r[0] not in seen]
        assert c.sequential_groups(df, "pid", groups, each, target) == want[:target]
    one = c.examples(df, "pid", groups)
    assert [g for _, g in one] == ["x", "y", "z"] and len({p for p, _ in one}) == 3
    assert [g for _, g in c.examples(df, "pid", {"nie": "b > 9"}, 4)] == ["nie"] * 4 and c.examples(df.limit(0), "pid", groups) == []


def test_texts_by_key_and_samples(spark):
    rows = [("hot", i, f"t{i}") for i in range(3000)] + [("k", 5, " "), ("k", 1, "a"), (None, 2, "n"), ("k", 9, None)]
    got = {r.k: r.belege for r in c.concat_by_key(spark.createDataFrame(rows, "k string, o long, t string").repartition(5), "k", "o", "t").collect()}
    assert got == {"hot": " || ".join(f"t{i}" for i in range(3000)), "k": "a", None: "n"}
    ids = spark.createDataFrame([(f"{i:02d}",) for i in range(25)], "pid string")
    assert tuple(c.id_sample(ids).first()) == (25, ",".join(f"{i:02d}" for i in range(20)) + "...") and tuple(c.id_sample(ids.limit(0)).first()) == (0, "")


def test_hot_and_undated_rows_stay_in_small_groups(spark):
    """Half of the rows on one id, half of them undated: no group that one task sorts holds more than a range of numbers."""
    rng = random.Random(6)
    rows = [(i, "hot" if i % 2 else f"k{i % 97}", None if rng.random() < 0.5 else i % 300) for i in range(20_000)]
    df = spark.createDataFrame(rows, "nr long, k string, t int")
    buckets = [F.col("t"), F.when(F.col("t").isNull(), F.floor(F.col("nr") / 512))]
    sizes = df.groupBy("k", *(b.alias(f"b{i}") for i, b in enumerate(buckets))).count()
    assert sizes.agg(F.max("count")).first()[0] <= 512
    got = {r.nr: r.lfd for r in rank_within(df, ["k"], buckets, [F.col("t").asc_nulls_last(), F.col("nr")]).collect()}
    n, want = Counter(), {}
    for nr, k, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        n[k] += 1
        want[nr] = n[k]
    assert got == want


def test_sources_beyond_the_driver(spark, tmp_path):
    from befundwerk.session import exists
    from befundwerk.sources.delimited import detect_encoding, read_artifact, read_delimited, read_union
    from befundwerk.sources.sinks import failures

    for name, raw, want in (("u", "a;ü\n".encode(), "utf-8"), ("c", "a;ü€\n".encode("cp1252"), "cp1252"), ("l", b"a;\x81\xfc\n", "latin-1"), ("x", "a;ü\n".encode("utf-16"), "utf-16"), ("e", b"", "utf-8")):
        (tmp_path / name).write_bytes(raw)
        assert detect_encoding(spark, [str(tmp_path / name)]) == want, name
    (tmp_path / "k.csv").write_bytes("\ufeffPatientID ;wert\n1;ä\n2;b;zu viel\n".encode())
    rows, bad = read_delimited(spark, str(tmp_path / "k.csv"))
    assert rows.columns == ["PatientID", "wert"] and [tuple(r) for r in rows.collect()] == [("1", "ä")] and bad.count() == 1
    assert read_union(spark, [str(tmp_path / "k.csv"), str(tmp_path / "fehlt.csv")]).count() == 1 and not exists(spark, str(tmp_path / "fehlt.csv"))
    with pytest.raises(FileNotFoundError):
        read_union(spark, [str(tmp_path / "fehlt.csv")])
    with pytest.raises(Exception):  # noqa: B017
        read_artifact(spark, str(tmp_path / "k.csv"), "andere string, spalten int").collect()
    failures(spark.createDataFrame([(1, None), (2, "weg")], "nr int, fehler string"), str(tmp_path / "f"))
    assert [r.nr for r in spark.read.json(str(tmp_path / "f")).collect()] == [2]
