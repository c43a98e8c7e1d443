"""Ciphers that no table lists, sources with a cipher of their own, and texts of the test tables that are misread on purpose."""

import pickle
import random
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from befundwerk.llm import mojibake
from befundwerk.llm.mojibake import LONGEST, compose, learn, learn_in_parts, misread, page_signs, repair, runs, tally

DATA = Path("/root/testdata/sf0.01")
WORDS = "für über müssen Größe schön äußerst Übung ähnlich führen Mühe Fäden täglich nächste Österreich Öl müde früh Röntgen".split()


def planted(written, read, texts=4000, every=20, seed=1):
    rng, rows, want = random.Random(seed), [], {}
    for i in range(texts):
        s = " ".join(rng.choice(WORDS) for _ in range(8))
        if i % every == 0:
            bad = s.encode(written).decode(read, "replace")
            if bad != s:
                want[i] = s
            s = bad
        rows.append(s)
    return rows, want


@pytest.mark.parametrize(("written", "read"), [("cp1252", "cp866"), ("cp1252", "mac_latin2"), ("cp1252", "cp1256"), ("cp1252", "cp855"), ("cp1252", "iso8859_5"), ("cp1252", "cp852"), ("utf-8", "cp866"), ("utf-8", "cp1256"), ("utf-8", "iso8859_13"), ("cp850", "iso8859_4")])
def test_pages_outside_the_lists_are_learned(written, read):
    rows, want = planted(written, read)
    model = learn(Counter(("", *k) for s in rows for k in runs(s)))
    got = {i: r[0] for i, s in enumerate(rows) if (r := repair(s, model))}
    assert set(got) == set(want) and sum(got[i] == w for i, w in want.items()) >= 0.9 * len(want)


def test_each_source_has_its_cipher():
    """A swap of letters that no page makes: the same sign stands for another letter in the other source."""
    swap = {"a": str.maketrans("äöü", "ĸŋŧ"), "b": str.maketrans("äöü", "ŧĸŋ")}
    rng, rows = random.Random(2), []
    for i in range(6000):
        s = " ".join(rng.choice(WORDS) for _ in range(8))
        q = rng.choice("ab")
        rows.append((q, s, s.translate(swap[q]) if i % 10 == 0 else s))
    model = learn(Counter((q, *k) for q, _, t in rows for k in runs(t)))
    bad = [(q, s, t) for q, s, t in rows if s != t]
    assert sum((r := repair(t, model, q)) is not None and r[0] == s for q, s, t in bad) >= 0.9 * len(bad)
    assert not any(repair(s, model, q) for q, s, t in rows if s == t)


def test_long_runs_by_the_learned_cipher():
    rows, _ = planted("cp1252", "cp850")
    plain = [("äöü" * n)[:n] for n in (12, 15, 18, 40)]
    bad = ["x" + s.encode("cp1252").decode("cp850") + "y" for s in plain]
    model = learn(Counter(("", *k) for s in [*rows, *bad] for k in runs(s) if len(k[1]) <= LONGEST))
    for s, t in zip(plain, bad):
        assert repair(t, model) == ("x" + s + "y", False)
    assert compose("abcb", {"ab": "x", "cb": "y", "a": "z"}) == "xy" and compose("abd", {"ab": "x"}) is None


def test_counts_are_bounded(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    df = spark.createDataFrame([(i, w + " f\u00fcr", None) for i, w in enumerate(words)], "nr long, a string, q string")
    assert len(tally(df, ["a"], "q")) == 1 and "\u65e5" not in page_signs()
    assert tally(df, ["a"], None, most=0) == {}
    rows, want = planted("cp1252", "cp850", 2000)
    docs = spark.createDataFrame(list(enumerate(rows)), "nr long, a string")
    monkeypatch.setattr(mojibake, "MOST_KEYS", 40)
    capped = learn(tally(docs, ["a"], None, 40))
    capped.counted = frozenset()
    learned = {i: w for i, w in want.items() if all(len(x) == 1 and x in capped.letters[""] or set(x) <= set(capped.letters[""]) for _, x, _ in runs(rows[i]))}
    assert len(learned) > 50 and all(repair(rows[i], capped) == (w, False) for i, w in learned.items())


def test_no_key_is_left_out(spark):
    """More keys than the driver learns from, and long runs."""
    letters = "".join(map(chr, range(0x430, 0x450)))
    sign = lambda k: F.expr(f"substring('{letters}', cast(1 + (id div {32**k}) % 32 as int), 1)")
    df = spark.range(mojibake.MOST_KEYS + 100).select(F.concat(F.lit("a"), *(sign(k) for k in range(4)), F.lit("b")).alias("a"))
    assert len(tally(df, ["a"])) == mojibake.MOST_KEYS + 100 and mojibake._few(mojibake._counted(df, ["a"], None)) is None
    long = spark.createDataFrame([("a" + "ä" * n + "b",) for n in (1, 17, 300)], "a string")
    assert {len(x) for _, _, x, _ in tally(long, ["a"])} == {1, 17, 300} and mojibake._few(mojibake._counted(long, ["a"], None)) is None


def test_learned_in_parts_like_on_the_driver(spark, monkeypatch):
    """Two sources with different swaps, one that no list holds, words of another script, long runs, lost and control signs, repeated rows, a null source."""
    a, want_a = planted("cp1252", "cp866", 1500, seed=4)
    b, want_b = planted("utf-8", "cp1252", 1500, seed=5)
    rng = random.Random(6)
    rows = [(i, "a", s, None) for i, s in enumerate(a)] + [(5000 + i, "b", s, "слово и дело") for i, s in enumerate(b)]
    rows += [(9000 + i, None, "".join(chr(rng.randint(0x430, 0x44F)) for _ in range(rng.randint(1, 20))), "über") for i in range(300)]
    rows += [(9900, "a", "verlor\ufffdn", "x\x81y"), (9901, "b", None, ""), (9902, "b", "x" + ("äöü" * 7).encode().decode("cp1252") + "y", "ä" * 300), (9902, "b", "x" + ("äöü" * 7).encode().decode("cp1252") + "y", "日\ufffd")]
    df = spark.createDataFrame(rows, "nr long, q string, s string, t string")
    counts = tally(df, ["s", "t"], "q")
    on_driver = learn(counts)
    keys = spark.createDataFrame([(*k, n) for k, n in counts.items()], "q string, a string, x string, z string, n long")
    model, decided = learn_in_parts(keys, 5)
    got = {(r.q, r.a, r.x, r.z): pickle.loads(r.decided) for r in decided.collect()}
    assert got == {k: (k in on_driver.meant, on_driver.meant.get(k), on_driver.swaps.get(k), on_driver.doubtful.get(k)) for k in {*on_driver.meant, *on_driver.doubtful}}
    assert model.letters == on_driver.letters and model.weights == pytest.approx(on_driver.weights)
    monkeypatch.setattr(mojibake, "WIDE", 1000)
    want = sorted(map(tuple, misread(df, "nr", ["s", "t"], source="q").collect()))
    monkeypatch.setattr(mojibake, "MOST_KEYS", 10)
    monkeypatch.setattr(mojibake, "PART_KEYS", 200)
    monkeypatch.setattr(mojibake, "HELD", 50)
    assert sorted(map(tuple, misread(df, "nr", ["s", "t"], source="q").collect())) == want
    found = {i: t for i, _, t, _ in want}
    assert {*want_a, *(5000 + i for i in want_b), 9900, 9902} <= set(found) and sum(i == 9902 and t == "x" + "äöü" * 7 + "y" for i, _, t, _ in want) == 2
    assert sum(found[i] == w for i, w in want_a.items()) >= 0.9 * len(want_a) and all(found[5000 + i] == w for i, w in want_b.items())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_restored_texts_of_the_tables(spark):
    """Correct texts of the reports are misread by eleven swaps, most of them in no list; found and restored are measured."""
    rows = pq.read_table(DATA / "berichte.parquet", columns=["report_nr", "bertyp", "epikrise"]).to_pylist()
    texts = [(r["report_nr"], (r["bertyp"] or "").strip(), r["epikrise"]) for r in rows if r["epikrise"] and not r["epikrise"].isascii()]
    before = learn(Counter((q, *k) for _, q, s in texts for k in runs(s)))
    clean = [(i, q, s) for i, q, s in texts if repair(s, before, q) is None and set(s) & set("äöüÄÖÜß")]
    swaps = [("cp1252", "cp850"), ("cp1252", "mac_roman"), ("utf-8", "cp1252"), ("utf-8", "cp1250"), ("cp1252", "cp866"), ("cp1252", "mac_latin2"), ("cp1252", "cp1256"), ("cp1252", "cp855"), ("utf-8", "cp866"), ("cp1252", "koi8_u"), ("utf-8", "iso8859_13")]
    want, out = {}, []
    for j, (i, q, s) in enumerate(clean):
        if j % 12 == 0:
            written, read = swaps[j // 12 % len(swaps)]
            bad = s.encode(written, "ignore").decode(read, "ignore")
            if bad != s and s.encode(written, "ignore").decode(written) == s and bad.encode(read).decode(written, "replace") == s:
                want[i], s = s, bad
        out.append((i, q, s))
    df = spark.createDataFrame(out, "nr long, q string, t string").withColumn("feld", F.lit("fremd"))
    got = {r.nr: r.text for r in misread(df, "nr", ["t"], source="q").collect()}
    hit = sum(i in got for i in want)
    assert len(want) > 150 and hit >= 0.95 * len(want) and len(got) - hit <= 0.01 * len(want)
    assert sum(got.get(i) == w for i, w in want.items()) >= 0.9 * len(want)
