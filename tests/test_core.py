"""General operators against brute force on small inputs, with the awkward cases in each."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from befundwerk.functions.clean import clean_id, clean_label, number, parse_date
from befundwerk.operators.orphans import orphan_report, orphans, references
from befundwerk.operators.rejects import SCORE, check_scores, parse_records, split_record
from befundwerk.operators.skew import eager_join, heavy_keys, rank_within, salted_join, states

T = dt.datetime


def test_clean(spark):
    given = [None, "", "  ", "nan", " NaN ", "None", "NULL", "12", " 12.0\t", "-7.0", "1.00", "a.0", " 99　", " 99.0\x1f", "0012"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    got = [(r.a, r.b) for r in df.select("i", clean_id("x").alias("a"), clean_label("x").alias("b")).orderBy("i").collect()]
    assert [a for a, _ in got] == ["", "", "", "", "", "", "", "12", "12", "-7", "1.00", "a.0", "99", "99", "0012"]
    assert [b for _, b in got][7:10] == ["12", "12.0", "-7.0"]


def test_number_and_date(spark):
    df = spark.createDataFrame([("1d", "31.02.2023"), (" 2.5 ", "2023/01/02"), ("x", "05.06.21"), (None, None), ("1e2", "2021-03-04 05:06")], "n string, d string")
    got = df.select(number("n"), parse_date("d")).collect()
    assert [r[0] for r in got] == [None, 2.5, None, None, 100.0]
    assert [r[1] for r in got] == [None, T(2023, 1, 2), T(2021, 6, 5), None, T(2021, 3, 4, 5, 6)]


# ---- rows that fail to parse


def brute_record(s):
    """Fields by walking over the signs; None for broken quoting."""
    out, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + s[i], i + 1
            if i < len(s) and s[i] != ";":
                return None
        else:
            j = s.find(";", i)
            j = len(s) if j < 0 else j
            cell, i = s[i:j], j
        out.append(cell)
        if i >= len(s):
            return out
        i += 1


def test_records_like_brute_force(spark):
    rng = random.Random(4)
    signs = ['"', '"', ";", ";", "a", "\n", "\r", "\\", " ", "ä", '""', "", "7", "8.0", "9", "\0"]
    rows = [(i, "ICDSC.csv", "".join(rng.choice(signs) for _ in range(rng.randint(0, 9)))) for i in range(3000)]
    rows += [(3000, "ICDSC.csv", None), (3001, "ICDSC.csv", "x;" + "y" * 300_000), (3002, "fremd.csv", "a"), (3003, "ICDSC.csv", "1;5"), (3003, "ICDSC.csv", "1;5")]
    got = {}
    for r in parse_records(spark.createDataFrame(rows, "roh_nr long, datei string, zeile string").withColumn("grund", F.lit("fremd"))).collect():
        got.setdefault(r.nr, r)
    import re

    for nr, datei, zeile in rows:
        f = brute_record(zeile or "")
        r = got[nr]
        if f is None:
            assert r.grund == "anfuehrung", zeile
        elif datei == "fremd.csv":
            assert r.grund == "datei" and r.felder is None
        elif len(f) != 2:
            assert r.grund == "spaltenzahl", zeile
        else:
            assert r.felder == f, zeile
            assert (r.grund is None) == bool(re.fullmatch(r"(0*[0-8](\.0+)?)?", f[1].strip())), zeile
        assert split_record(zeile or "") == f


def test_scores(spark):
    good = [None, "", " ", "0", "8", "008", " 7.0 ", " 3.000"]
    bad = ["9", "7.5", "x", "-1", "٣", "7.", "1e0", "+3", "8 8"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "nr long, s string")
    assert {r.nr for r in check_scores(df, "nr", "s").collect() if r.grund} == set(range(len(good), len(good + bad)))
    assert check_scores(df.limit(0), "nr", "s").count() == 0 and SCORE


# ---- heavy keys


def test_eager_join_counts_every_pair(spark):
    rng = random.Random(1)
    a = [(rng.choice("xxxxxyz") if rng.random() > 0.1 else None, rng.randint(0, 5)) for _ in range(300)]
    b = [(rng.choice("xxxyw"), rng.randint(0, 5)) for _ in range(200)]
    sa = states(spark.createDataFrame(a, "k string, v int"), ["k"], v=F.sum("v"))
    sb = states(spark.createDataFrame(b, "k string, w int"), ["k"], w=F.sum("w"), v=F.lit(0))
    got = {r.k: (r.n, r.v, r.w) for r in eager_join(sa, sb, ["k"], {"v": "left", "w": "right"}).collect()}
    want = {}
    for k in "xyzw":
        x, y = [v for q, v in a if q == k], [w for q, w in b if q == k]
        if x and y:
            want[k] = (len(x) * len(y), sum(x) * len(y), sum(y) * len(x))
    assert got == want


def test_heavy_salted_and_ranked(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 40)}" if rng.random() > 0.05 else None, rng.choice([None, *range(6)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "nr int, k string, t int").withColumn("n", F.lit("clash"))
    hot = heavy_keys(states(df, ["k"]), "k", 0.1)
    assert [r.k for r in hot.collect()] == ["hot"]
    keyed = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v int")
    got = Counter(r.k for r in salted_join(df, keyed, "k", hot, F.col("nr"), 8).collect())
    assert got == Counter(k for _, k, _ in rows if k in ("hot", "k1"))
    ranked = rank_within(df, ["k"], F.col("t"), [F.col("t").asc_nulls_last(), F.col("nr")]).collect()
    want = {}
    for k in {k for _, k, _ in rows}:
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        want.update({r[0]: i for i, r in enumerate(own, 1)})
    assert {r.nr: r.lfd for r in ranked} == want
    late = rank_within(df, ["k"], [F.col("t"), F.when(F.col("t").isNull(), F.floor(F.col("nr") / 50))], [F.col("t").asc_nulls_last(), F.col("nr")]).collect()
    assert {r.nr: r.lfd for r in late} == want
    assert heavy_keys(states(df.limit(0), ["k"]), "k", 0.1).count() == 0


# ---- orphans


def test_orphans(spark):
    rows = [(1, "a", T(2020, 1, 1)), (2, "a.0", T(2022, 1, 1)), (3, " b ", T(2021, 1, 1)), (4, "b", T(2023, 1, 1)), (5, None, T(2021, 1, 1)), (6, "zz", None), (7, "a", None), (8, "12.0", T(2021, 1, 1)), (8, "12.0", T(2021, 1, 1))]
    refs = references(spark.createDataFrame(rows, "nr long, p string, t timestamp_ntz").withColumn("id", F.lit(0)), "x", "nr", "p", "t")
    parents = spark.createDataFrame([("a", T(2021, 1, 1), None), ("b", T(2020, 1, 1), T(2023, 1, 1)), (None, None, None)], "k string, ab timestamp_ntz, bis timestamp_ntz")
    got = sorted((r.nr, r.grund) for r in orphans(refs, parents, "k", "ab", "bis").collect())
    assert got == [(1, "spaeter"), (2, "fehlt"), (4, "geloescht"), (6, "fehlt"), (8, "fehlt"), (8, "fehlt")]
    found = orphans(refs, parents, "k", "ab", "bis")
    rep = {(r.monat): (r.verweise, r.fehlt, r.spaeter, r.geloescht) for r in orphan_report(found, refs).collect()}
    assert rep[None] == (2, 1, 0, 0) and rep["2020-01"] == (1, 0, 1, 0) and rep["2021-01"] == (3, 2, 0, 0)
    assert orphans(refs.limit(0), parents, "k", "ab", "bis").count() == 0
    assert orphans(refs, parents.limit(0), "k", "ab", "bis").count() == 8


def test_hot_orphan_key_is_whole(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", T(2021, 1, 1)) for i in range(3000)]
    refs = references(spark.createDataFrame(rows, "nr long, p string, t timestamp_ntz"), "x", "nr", "p", "t")
    parents = spark.createDataFrame([("k1", T(2020, 1, 1), None)], "k string, ab timestamp_ntz, bis timestamp_ntz")
    got = Counter(r.nr for r in orphans(refs, parents, "k", "ab", "bis").collect())
    assert got == Counter(i for i, k, _ in rows if k != "k1")


@pytest.mark.parametrize("wrong", ["XOR"])
def test_threshold_mode(spark, wrong):
    from befundwerk.operators.baseline import thresholds

    df = spark.createDataFrame([(0, 0.0), (1, 2.0), (0, 5.0), (1, 3.0), (0, 0.5), (0, 3.5)], "has_code int, max_score double")
    assert [r.composite for r in thresholds(df, mode="OR").collect()] == [0, 1, 1, 1, 0, 0]
    assert [r.composite for r in thresholds(df).collect()] == [0] * 6
    assert [(r.eq_0, r.mid_1_3, r.ge_4) for r in thresholds(df).collect()][-2:] == [(0, 0, 0), (0, 0, 0)]
    with pytest.raises(ValueError, match="AND or OR"):
        thresholds(df, mode=wrong)
