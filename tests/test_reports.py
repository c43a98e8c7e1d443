"""Report operators: readers, writers, evidence, plans and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from befundwerk.functions.evidence import Limits, bundle, evidence, merge_intervals, reduce_text, spans
from befundwerk.functions.json_text import distinct_terms, first_object, lenient
from befundwerk.functions.terms import GROUPS, occurrences, word_match
from befundwerk.operators.baseline import baseline, confusion, odds
from befundwerk.plans.pick import sequential_pick
from befundwerk.plans.predict import predict
from befundwerk.sources.delimited import choose_encoding, head_in_order, read_delimited, read_entries, read_texts, read_union, unpack_first_column
from befundwerk.sources.sinks import append_log, digest, freeze, frozen_or_live, markdown, slug, write_csv
from befundwerk.streaming.arrivals import arrivals


def greedy(text):
    low, taken = text.lower(), []
    for term, kind in sorted(((t, k) for k, ts in GROUPS.items() for t in ts), key=lambda x: -len(x[0])):
        at = low.find(term)
        while at >= 0:
            if all(at >= z or at + len(term) <= a for a, z, _, _ in taken):
                taken.append((at, at + len(term), term, kind))
            at = low.find(term, at + len(term))
    return sorted(taken)


def test_spans_like_brute_force(spark):
    rng = random.Random(1)
    bits = ["delir", "Kein ", "kein delir", "-screening", " ", "ium", "ant", "verwirrt", "heit", "vigilanz", "minderung", "hyperaktives delir", ". ", "ö", "Delirprophylaxe"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["Kein Delir-Screening", "", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", spans(F.col("t")).alias("s")).collect()
    assert {r.i: [tuple(x) for x in r.s] for r in got} == {i: greedy(x or "") for i, x in enumerate(texts)}


def test_evidence_and_reduction(spark):
    texts = ["[Diagnosen]\nPatient mit hyperaktives Delir.", "Kein Delir nach Screening.", "Delirprophylaxe mit Mobilisation.", "Patient stark desorientiert und verwirrt.", "Routinekontrolle.", None, "Delirprophylaxe. " * 5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    e = [r.e for r in df.select("i", evidence(F.col("t")).alias("e")).orderBy("i").collect()]
    assert (e[0].has_direct, e[0].snippets[0].section, e[0].send) == (True, "diag", True)
    assert (e[1].has_negation, e[1].has_direct, e[1].send) == (True, False, False)
    assert e[2].prophylaxis_only and e[2].send and e[3].has_indirect
    assert e[4].hits == 0 and not e[4].send and e[5].original_len == 0
    assert e[6].hits == 2
    two = df.filter("i = 3").select(evidence(F.col("t"), Limits(snippets=1)).alias("e"))
    assert len(two.first().e.snippets) == 1 and "desorientiert" in two.select(bundle(F.col("e.snippets"))).first()[0]
    long = spark.createDataFrame([("a" * 300 + " delir " + "b" * 300,), ("c" * 900,), (None,)], "t string").select(reduce_text(F.col("t"), 20, 400)).collect()
    assert [len(r[0]) if r[0] else None for r in long] == [45, 400, None]
    m = spark.sql("SELECT from_json('[[5,9],[1,3],[3,4],[8,12]]', 'array<array<int>>') AS y").selectExpr("transform(y, v -> named_struct('a', v[0], 'z', v[1])) AS x").select(merge_intervals(F.col("x"))).first()[0]
    assert [tuple(x) for x in m] == [(1, 4), (5, 12)]


def test_terms(spark):
    df = spark.createDataFrame([("Delirium, delir",), ("xödelir",), (None,)], "t string")
    assert [r[0] for r in df.select(occurrences(F.col("t"), "delir")).collect()] == [2, 1, 0]
    assert [r[0] for r in df.select(word_match(F.col("t"))).collect()] == [True, False, False]


def test_json(spark):
    assert first_object('x {"a": "}"} y') == '{"a": "}"}' and first_object(" {kaputt ") == "{kaputt" and first_object(None) is None
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"a": 2} ende',), ("nichts",), (None,)], "t string")
    assert [r[0].a if r[0] else None for r in df.select(lenient(F.col("t"), "a int")).collect()] == [1, 2, None, None]
    terms = spark.createDataFrame([([" A", "a", "b", "", "B "],), (None,)], "x array<string>").select(distinct_terms(F.col("x"))).collect()
    assert [r[0] for r in terms] == [["A", "b"], []]


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('PatientID ;text;typ\n1;ok;A\n2;zu;viel;e\n3;"a;""b""\nc";B\n4;kurz\n5;x;y;\n', encoding="utf-8")
    rows, bad = read_delimited(spark, str(p))
    rows = rows.cache()
    assert [tuple(r) for r in rows.orderBy("PatientID").collect()] == [("1", "ok", "A"), ("3", 'a;"b"\nc', "B"), ("4", "kurz", None)]
    q = tmp_path / "b.csv"
    q.write_bytes("PatientID;wert\n9;Grösse – €\n".encode("cp1252"))
    assert choose_encoding(str(q)) == "cp1252" and read_delimited(spark, str(q))[0].first().wert == "Grösse – €"
    u = read_union(spark, [str(q), str(p)])
    assert u.count() == 4 and {"wert", "typ", "quelle"} <= set(u.columns)
    with pytest.raises(Exception):  # noqa: B017
        read_delimited(spark, str(p), strict=True)[0].collect()
    e = tmp_path / "e.txt"
    e.write_text("PatientID;ParameterID;Time;Value\n1;d;t1;erste\nweiter; mit Strich\n2;d;t2;zweite\n")
    assert [(r.PatientID, r.Value) for r in read_entries(spark, str(e)).orderBy("nr").collect()] == [("1", "erste\nweiter; mit Strich"), ("2", "zweite")]
    packed = spark.createDataFrame([("1;d;t;a", "rest"), ("kaputt", None)], "p string, r string")
    assert [r.Value for r in unpack_first_column(packed, "p", "r", ("PatientID", "ParameterID", "Time", "Value")).collect()] == ["a;rest"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("a\nb")
    assert [tuple(r) for r in read_texts(spark, str(tmp_path / "t")).collect()] == [("x.txt", "a\nb")]
    assert [r.id for r in head_in_order(spark.range(9), "id", 2).collect()] == [0, 1]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None), (2, False, "x")], "a int, b boolean, c string")
    write_csv(df, ["b", "a"], str(tmp_path / "o"), "Lauf 1/ä")
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "o"), header=True).collect()) == ["False", "True"]
    assert slug("Lauf 1/ä") == "Lauf_1_" and (tmp_path / "o_Lauf_1_").exists()
    for _ in range(2):
        append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert digest(df) == digest(df.repartition(3)) != digest(df.union(df.limit(1)))
    facts = freeze(df, str(tmp_path / "f"))
    assert facts["rows"] == 2 and json.loads(spark.read.text(str(tmp_path / "f_facts")).first()[0])["digest"] == digest(df)
    with pytest.raises(Exception):  # noqa: B017
        freeze(df, str(tmp_path / "f"))
    assert frozen_or_live(spark, str(tmp_path / "f"), "none").count() == 2
    assert markdown(df.orderBy("a")).splitlines()[0] == "| a | b | c |"


def test_baseline_and_metrics(spark):
    icd = spark.createDataFrame([("1001", "1", "F05.0"), ("1001", "0", "F05.0"), ("1002", "1", "J44.1"), ("1003.0", "1.9", " f05.8 "), ("1004", "1", "F05.1"), (None, None, None)], "PatientID string, icd_hd string, icd_code string")
    icdsc = spark.createDataFrame([("1001", "2"), ("1001", "5"), ("1002", "n/a"), ("1005", "3.5")], "PatientID string, ICDSC_Max string")
    b = {r.pid: r for r in baseline(icd, icdsc).collect()}
    assert {k: r.has_code for k, r in b.items()} == {"1001": 1, "1002": 0, "1003": 1, "1004": 0, "1005": 0, "": 0}
    assert (b["1001"].max_score, b["1002"].max_score, b["1001"].composite, b["1001"].codes) == (5.0, 0.0, 1, "F05.0")
    x = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "t int, p int").withColumn("g", F.lit("a"))
    m = confusion(x, ["g"], "t", "p").first()
    assert (m.tp, m.tn, m.fp, m.fn, m.accuracy) == (1, 2, 1, 1, 0.6)
    assert odds(x.filter("t = p"), ["g"], "p", "t").first().odds_ratio == 15.0


def test_predict_keeps_every_report(spark):
    df = spark.createDataFrame([(1, "Patient verwirrt."), (2, "Kein Delir."), (3, None), (4, "Delir, BOOM"), (5, "hyperaktives Delir")], "report_nr int, text string")

    def client(q):
        if "BOOM" in q:
            raise RuntimeError("weg")
        return 'Antwort: {"signalstaerke": "hoch"}'

    got = {r.report_nr: r for r in predict(df, client, 2).collect()}
    assert {k: r.gesendet for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    assert got[1].antwort.signalstaerke == "hoch" and got[4].fehler == "weg" and got[4].antwort is None


def test_pick(spark):
    df = spark.range(60).select(F.format_string("p%03d", "id").alias("pid"), (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"))
    rows = sequential_pick(df, "pid", ["a = 1", "b = 0"], 8).collect()
    assert len(rows) == 8 == len({r.pid for r in rows}) and [r.gruppe for r in rows].count("a = 1") == 4
    assert sequential_pick(df.limit(0), "pid", ["a = 1"], 8).count() == 0


def test_stream(spark, tmp_path):
    src = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS eingang, ' A ' AS bertyp UNION ALL SELECT timestamp'2024-01-01 11:00:00', 'A' UNION ALL SELECT timestamp'2024-03-01 11:00:00', null")
    src.write.parquet(str(tmp_path / "in"))
    q = arrivals(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ankunft").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.typ, r.n) for r in spark.table("ankunft").collect()) == [("", 1), ("A", 2)]


def test_schema(spark):
    from befundwerk.functions.schema import SchemaError, assert_binary, fold, require, shorten, with_defaults

    df = spark.createDataFrame([("1", "2", "3", 1)], " PatientID string, Code string, PatientenID string, k int")
    assert fold(df).columns == ["icd_code", "PatientenID", "k"]
    with pytest.raises(SchemaError, match="icd_code"):
        require(df, ["icd_code"], "icd")
    assert with_defaults(df, ["neu"]).first().neu == "" and assert_binary(df, "k").first().k == 1
    with pytest.raises(Exception, match="not binary"):
        assert_binary(df.withColumn("k", F.lit(2)), "k").collect()
    assert [r[0] for r in spark.createDataFrame([("abcd",), ("abc",), (None,)], "t string").select(shorten(F.col("t"), 3)).collect()] == ["ab…", "abc", None]
