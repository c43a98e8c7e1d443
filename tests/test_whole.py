"""Queries that do the whole job where an older one of similar name keeps a part."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
FIELDS = ("diag", "epikrise", "jetziges_leiden", "prozedere")
SEVENTEEN = {"delir", "delirium", "delirant", "delirös", "verwirrt", "verwirrtheit", "desorientiert", "desorientierung", "agitation", "agitiert", "unruhig", "vigilanz", "vigilanzminderung", "somnolent", "soporös", "bewusstseinsstörung", "bewusstseinstrübung"}


def rows(spark, name):
    return entry.queries()[name](spark, str(DATA)).collect()


def texts():
    return [[(x or "").lower() for x in r.values()] for r in pq.read_table(DATA / "berichte.parquet", columns=list(FIELDS)).to_pylist()]


@tables
def test_all_terms(spark):
    got = {r.begriff: r for r in rows(spark, "agg17_agg19_begriffe_ganz")}
    assert set(got) == SEVENTEEN
    assert got["vigilanz"].vorkommen == sum(f.count("vigilanz") for r in texts() for f in r) > 0
    assert {r.begriff for r in rows(spark, "agg18_agg20_mengen_ganz")} == {r.begriff for r in rows(spark, "agg21_breit_ganz")} == SEVENTEEN
    top = rows(spark, "srt2_spitze_ganz")
    assert all(sorted(r.rn for r in top if r.typ == t) == list(range(1, 16)) for t in {r.typ for r in top})


def test_reports_reduced_by_section(spark):
    from befundwerk.functions.evidence import reduce_report

    a, b = "a" * 3500, "b" * 1500
    course = "[Epikrise]\n" + "x" * 1200 + " delir " + "y" * 1200 + " vigilanz."
    texts = [
        f"[Diagnosen]\n{a}\n\n[Epikrise]\n{b}\n\n[Prozedere]\n{b}\n\n[Diagnosen]\nnoch",
        a + "b" * 2500,
        f"vorn [Epikrise]\nohne\n\n[Diagnosen]\n{a} Verwirrt {a}\n\n[Prozedere]\nunruhig",
        course,
        "[Diagnosen] ",
        " ",
        None,
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", reduce_report(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got[0].text == f"[Diagnosen]\n{a[:3000]}\n\n[Prozedere]\n{b[:1000]}\n\n[Epikrise]\n{b[:1000]}" and got[0].method == "fallback_truncation"
    assert got[1].text == f"[Diagnosen]\n{a[:3000]}\n\n[Jetziges Leiden]\n{a[:500]}{'b' * 1500}\n\n[Prozedere]\n{'b' * 1000}"
    assert got[2].text == f"[Diagnosen]\n{a[:999]} Verwirrt {a[:999]}\n\n[Prozedere]\nunruhig" and (got[2].method, got[2].hits) == ("keyword_windows", 2)
    assert got[3].text == "[Epikrise]\n" + "x" * 999 and got[3].hits == 2
    assert got[4].text == "[Diagnosen]\n[Diagnosen]" and got[5].text == "" and got[6] is None


@tables
def test_every_section_is_reduced(spark):
    got = rows(spark, "txt15_txt18_kuerzung")
    assert len(got) == sum(any(x.strip() not in ("", "nan") for x in r) for r in texts()) and max(r.zeichen for r in got) > 400


@tables
def test_field_hints_of_all_terms(spark):
    """Against brute force: every patient's hints per field, by the whole list."""
    terms = SEVENTEEN | {"hypoaktives delir", "hyperaktives delir", "deliros", "soporos", "bewusstseinsstorung", "bewusstseinstrubung"}
    want = {}
    for r in pq.read_table(DATA / "berichte.parquet", columns=["PatientID", *FIELDS]).to_pylist():
        pid = (r["PatientID"] or "").strip()
        pid = "" if pid.lower() in ("nan", "none", "null") else pid.removesuffix(".0")
        own = want.setdefault(pid, dict.fromkeys(FIELDS, 0))
        for f in FIELDS:
            own[f] |= any(t in (r[f] or "").lower() for t in terms)
    got = {r.pid: {f: r[f] for f in FIELDS} for r in rows(spark, "agg15_hinweise")}
    assert got == want
    assert sum(r.n for r in rows(spark, "jn8_hinweise_ganz") if r.epikrise_hinweis == 1) <= sum(v["epikrise"] for v in want.values())


@tables
def test_all_ten_baselines(spark):
    got = {r.feld: r for r in rows(spark, "agg8_agg10_metriken_ganz")}
    assert set(got) == {"code_flag", "ge_1", "ge_2", "ge_3", "ge_4", "ge_5", "composite", "eq_0", "mid_1_3", "ge_4_grouped"}
    assert len({r.tp + r.tn + r.fp + r.fn for r in got.values()}) == 1 and got["eq_0"].tp + got["eq_0"].fn > 0
    assert tuple(got["ge_4_grouped"])[1:] == tuple(got["ge_4"])[1:]
