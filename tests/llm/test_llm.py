"""Text operators against brute force, round trips and planted cases."""

import random

import pytest
from pyspark.sql import functions as F

from befundwerk.llm.mix import fit, mix_sources
from befundwerk.llm.mojibake import RUN, Model, learn, misread, repair, runs, swaps, tally
from befundwerk.llm.pieces import rule_faults, split_documents, split_text
from befundwerk.llm.pii import Finder, check_digit, misread_forms, number_mentions, personal_data, redact, redacted
from befundwerk.llm.tokens import codec, count_tokens, encode_texts, rank_file

SIGNS = ["'s", "'", "é", "ß", " ", "\n", "\t", "\x1c", "　", "1", "٣", "a", "B", "!", "--", "\r\n", "\xa0", "x'll", "日本", "\U0001f600", "_", ".", "<|endoftext|>"]


@pytest.fixture(scope="module")
def bpe():
    return codec(rank_file("byte_bpe_50k"))


# ---- tokens


def test_ids_like_the_library(bpe):
    rng = random.Random(3)
    for _ in range(5000):
        s = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14)))
        assert bpe.ids(s).tolist() == bpe.encoding.encode_ordinary(s), s
        assert bpe.decode(bpe.ids(s)) == s


def test_ids_of_long_texts(bpe):
    rng = random.Random(4)
    for s in ("x" * 30_000, " " * 5000 + "a", "wort " * 20_000, "".join(rng.choice(SIGNS) for _ in range(30_000)), "é" * 4000):
        assert bpe.ids(s).tolist() == bpe.encoding.encode_ordinary(s)
        assert bpe.decode(bpe.ids(s)) == s


def test_encode_texts(spark, bpe):
    rows = [(1, "Hallo Welt"), (2, None), (3, ""), (1, "Hallo Welt"), (None, "x"), (4, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("fremd"))
    got = sorted(((r.doc_id, r.ids) for r in encode_texts(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted(((i, bpe.encoding.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.n_tokens for r in count_tokens(df.select("doc_id", "text"), "text").collect())[:2] == [0, 0]


# ---- pieces


def test_pieces_keep_limit_overlap_and_text(bpe):
    rng = random.Random(5)
    signs = ["def f(x):\n", "    return x\n", "\n", "# größer\n", "a_b = 1;", "日本語", " ", "x" * 50, "\t", "\r\n"]
    for most, overlap in ((8, 0), (8, 4), (40, 10), (200, 0)):
        for _ in range(40):
            s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 120)))
            data, p = s.encode(), split_text(bpe, s, most, overlap)
            if not p:
                assert len(bpe.ids(s)) <= most
                continue
            assert p[0][0] == 0 and p[-1][1] == len(data)
            for (a, z, _), (a2, z2, _) in zip(p, p[1:]):
                assert a < a2 <= z < z2 and (overlap or a2 == z)
            for a, z, n in p:
                assert n == len(bpe.encoding.encode_ordinary(data[a:z].decode())) <= most


def test_pieces_end_at_lines(bpe):
    s = "".join(f"zeile {i} mit worten\n" for i in range(200))
    p = split_text(bpe, s, 100, 0)
    assert all(s[z - 1] == "\n" for _, z, _ in p)
    top = "def a():\n    x\n\n" * 60
    assert all(top[a : a + 3] == "def" for a, _, _ in split_text(bpe, top, 64, 0))
    ids = bpe.ids(s)
    a, b = split_text(bpe, s, 100, 10)[:2]
    assert len(bpe.ids(s[b[0] : a[1]])) == 10 and len(ids) > 100


def test_split_documents(spark):
    long = "größe = 1\n" * 100
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "kurz"), (1, long)], "doc_id long, text string").withColumn("regel", F.lit("fremd"))
    rules = spark.createDataFrame([("k", 50, 0, "byte_bpe_50k"), ("m", 60, 5, "byte_bpe_multi_50k")], "regel string, max_tokens int, overlap_tokens int, tokenizer string")
    rows = split_documents(df, rules).collect()
    assert {r.doc_id for r in rows} == {1} and all(long[r.von : r.bis] == r.text for r in rows)
    k = sorted((r.stueck, r.text) for r in rows if r.regel == "k")
    assert "".join(t for _, t in k[::2]) == long and k[::2] == k[1::2]
    assert split_documents(df.limit(0), rules).count() == 0
    odd = spark.createDataFrame([("leer", None, 0, "byte_bpe_50k"), ("eng", 3, 0, "byte_bpe_50k"), ("gleich", 9, 9, "byte_bpe_50k"), ("ohne", 9, 0, None), ("weit", 9, 8, "byte_bpe_50k"), ("null", 9, None, "byte_bpe_50k")], rules.schema)
    assert {r.regel: r.grund for r in rule_faults(odd).collect()} == {"leer": "max_tokens", "eng": "max_tokens", "gleich": "overlap_tokens", "ohne": "tokenizer"}
    rows = split_documents(df, odd).collect()
    assert {r.regel for r in rows} == {"weit", "null"} and all(r.n_tokens <= 9 for r in rows)


# ---- mix


def test_fit_like_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        left = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        budget = rng.randint(0, 90)
        sums = {0}
        for n, k in left.items():
            sums = {s + i * n for s in sums for i in range(k + 1)}
        got = fit(budget, left, 1)
        assert all(got[n] <= left[n] for n in got)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= budget)


def test_fit_of_long_records():
    rng = random.Random(3)
    left = dict.fromkeys((rng.randint(18_001, 22_367) for _ in range(60)), 1)
    sums = {0}
    for n in left:
        sums |= {s + n for s in sums if s + n <= 62_752}
    got = fit(62_752, left, 1)
    assert sum(n * k for n, k in got.items()) == max(sums) >= 62_735 and all(k == 1 for k in got.values())
    assert sum(n * k for n, k in fit(10**9 + 1, {2: 10**9, 4: 3}, 1).items()) == 10**9


def test_mix_of_long_records_and_feasible_total(spark):
    """A source of long records only is fitted exactly; with the feasible total every source that has records fills its share."""
    docs = [(i, "lang", "wort " * (18_001 + 73 * i)) for i in range(12)] + [(100 + i, "kurz", "wort " * (1 + i % 7)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    goals = spark.createDataFrame([("lang", 0.9, 1), ("kurz", 0.05, 2), ("leer", 0.05, 2)], "source string, ziel_anteil double, max_wiederholung int")
    mix, shares = mix_sources(df, goals, total=62_752)
    lengths = sorted(r.n_tokens for r in mix.filter("source = 'lang'").collect())
    every = sorted({r.n_tokens for r in mix_sources(df, goals, total=10**7)[0].filter("source = 'lang'").collect()})

    def best(budget):
        sums = {0}
        for n in every:
            sums |= {s + n for s in sums if s + n <= budget}
        return max(sums)

    assert sum(lengths) == best(round(0.9 * 62_752))
    s = {r.source: r for r in mix_sources(df, goals, "feasible")[1].collect()}
    assert s["kurz"].tokens == s["kurz"].ziel_tokens and s["kurz"].gesamt == s["lang"].gesamt > 0 and s["leer"].tokens == 0
    assert s["lang"].tokens == best(s["lang"].ziel_tokens) and abs(s["kurz"].anteil_gesamt - 0.05) < 0.001
    assert mix_sources(df.limit(0), goals, "feasible")[0].count() == 0


def test_mix_sources(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, "", "wort " * rng.randint(1, 40)])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("n", F.lit("fremd"))
    goals = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.1, 3), ("leer", 0.1, 2)], "source string, ziel_anteil double, max_wiederholung int")
    mix, shares = mix_sources(df, goals)
    s = {r.source: r for r in shares.collect()}
    for k in ("a", "c"):
        assert s[k].tokens == s[k].ziel_tokens
    assert s["b"].tokens < s["b"].ziel_tokens and s["b"].meist == 2 and s["leer"].tokens == 0
    used = [r for r in mix.collect()]
    cap = {"a": 1, "b": 2, "c": 3}
    assert len({r.doc_id for r in used}) == len(used) and all(0 < r.verwendet <= cap[r.source] for r in used)
    again = mix_sources(df.repartition(5), goals)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, used))
    assert mix_sources(df.limit(0), goals)[0].count() == 0 and mix_sources(df, goals.limit(0))[0].count() == 0


# ---- misread texts

WORDS = "für über müssen Größe schön äußerst Übung ähnlich führen Mühe Fäden täglich nächste Österreich Öl müde früh Röntgen Ernährung 38.2 °C".split(" ")


def clean_text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9)))


def test_misread_found_and_restored(spark):
    rng = random.Random(8)
    rows, want = [], {}
    foreign = ["AVALIAÇÃO INICIAL", "Señales «Âge avancé»", "3÷5 l/min, dm³", "„sehr müde“ – Šarlič"]
    for i in range(4000):
        t = clean_text(rng) + (" " + rng.choice(foreign) if rng.random() < 0.2 else "")
        bad = None
        if i % 40 == 0:
            written, read = rng.choice([("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp850"), ("mac_roman", "latin-1"), ("utf-8", "cp437")])
            plain = clean_text(rng) + " für über"
            try:
                bad = plain.encode(written).decode(read)
            except UnicodeDecodeError:
                bad = plain.replace("Ö", "O").replace("Ü", "U").replace("ß", "s").encode(written, "replace").decode(read, "replace")
            want[i] = plain
            t = bad
        rows.append((i, t, None if i % 3 else ""))
    rows += [(9001, "verlor�n", "nan"), (9002, None, None)]
    want[9001] = None
    df = spark.createDataFrame(rows, "nr long, a string, b string").withColumn("text", F.lit("fremd"))
    got = {r.nr: r for r in misread(df, "nr", ["a", "b"]).collect()}
    assert set(got) == set(want)
    right = sum(got[i].text == w for i, w in want.items() if w)
    assert right > 0.8 * len(want) and got[9001].verloren and got[9001].text == "verlor�n"
    assert misread(df.limit(0), "nr", ["a", "b"]).count() == 0 and not tally(df.limit(0), ["a"])


def test_long_runs_are_decided_alone():
    model = learn({("f", "Ã¼", "r"): 5, ("f", "ü", "r"): 500, (" ", "Ã¤", "h"): 5, (" ", "ä", "h"): 500})
    word = "приветствиепривет"
    assert repair(word, model) is None
    assert repair(word.encode().decode("cp1251"), Model(weights={"utf-8>cp1251": 0.5})) == (word, False)
    assert repair("日" * 20 + "\ufffd", model) == ("日" * 20 + "\ufffd", True)
    assert repair("fÃ¼r", model) == ("für", False)


def test_swaps_restore_what_they_wrote():
    by = {w.name: w for w in swaps()}
    assert by["utf-8>cp1252"].restore("Ã¼") == "ü" and by["utf-8>cp1252 twice"].restore("ÃƒÂ¼") == "ü"
    assert by["cp1252>cp850"].restore("õ") == "ä" and by["utf-8>cp1251"].restore("Г¶") == "ö"
    assert by["utf-8>cp1252"].restore("ÇÃ") is None
    assert runs("ä b€") == [("", "ä", " "), ("b", "€", "")] and RUN.findall("abc") == []
    assert repair("abc", learn({})) is None


# ---- personal data


@pytest.fixture(scope="module")
def finder():
    return Finder(["Anna-Lena", "Urs", "Jörg"], ["Lindegger", "Lang", "Rütwyler", "de la Roseraie"])


def kinds(finder, s):
    return [(m.art, s[m.start : m.end]) for m in finder.find(s)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Frau Anna-Lena B. Lindegger, Mail urs.lang@praxis.example.", [("name", "Anna-Lena B. Lindegger"), ("email", "urs.lang@praxis.example")]),
        ("Mail an Jannis.Lindegger @ Post (punkt) Example", [("email", "Jannis.Lindegger @ Post (punkt) Example")]),
        ("urs [at] a-b.example und x(at)y.example", [("email", "urs [at] a-b.example"), ("email", "x(at)y.example")]),
        ("Infusion 63@Sinus, Version 2.2@Station. Danach", []),
        ("Tel. (083) 608.09.97 oder +41 (0)63 467-98-07, 0679824555, 0041534212943, +49 30 23125 217", [("telefon", "(083) 608.09.97"), ("telefon", "+41 (0)63 467-98-07"), ("telefon", "0679824555"), ("telefon", "0041534212943"), ("telefon", "+49 30 23125 217")]),
        ("Gerät SN 0041 140 879, Puls 078, Urin 054 200 ml, Charge 0045-50-090", []),
        ("AHV 756.6048.1761.98, Pass-Nr. X1234567, Los X1234567, Karte 80756817811416410080", [("idnr", "756.6048.1761.98"), ("idnr", "X1234567"), ("idnr", "80756817811416410080")]),
        ("AHV 756.6048.1761.99", []),
        ("Wohnhaft Hinter Gärten 117b, CH-9824 Seewil am Bach. Bahnstr. 39 in Tannberg.", [("adresse", "Hinter Gärten 117b, CH-9824 Seewil am Bach"), ("adresse", "Bahnstr. 39 in Tannberg")]),
        ("Zugangsweg 14 gespült, Liegeplatz 21, Im Status 67-jährige, im Verlauf 7", []),
        ("Lang unruhig. Laut Lang kein Schmerz. Lang wirkt müde.", [("name", "Lang"), ("name", "Lang")]),
        ("Rütwyler, Jörg und Rütwyler-Lindegger Lindegger", [("name", "Rütwyler, Jörg"), ("name", "Rütwyler-Lindegger"), ("name", "Lindegger")]),
        ("RÃ¼twyler rief an, J├Ârg de la Roseraie auch. R�twyler", [("name", "RÃ¼twyler"), ("name", "J├Ârg de la Roseraie"), ("name", "R�twyler")]),
        ("38 °C. Lindegger schläft", [("name", "Lindegger")]),
        ("Frau Unbekannt kam", [("name", "Unbekannt")]),
        ("Lindeggerweg 3", [("adresse", "Lindeggerweg 3")]),
        ("", []),
    ],
)
def test_mentions(finder, text, want):
    assert kinds(finder, text) == want


def test_redaction_keeps_the_rest(finder):
    s = "Urs Lindegger (Tel. 053 435 05 38) und Lindegger."
    m = finder.find(s)
    assert redact(s, m) == "[NAME] (Tel. [TELEFON]) und [NAME]." and redact("x", []) == "x"
    assert [(x.art, n) for x, n in number_mentions(m)] == [("name", 1), ("telefon", 1), ("name", 2)]
    assert check_digit("7566048176198") and "RÃ¼t" in misread_forms("Rüt") and misread_forms("abc") == set()


def test_personal_data(spark):
    names = (("Urs",), ("Lindegger",))
    df = spark.createDataFrame([(1, "Urs Lindegger", None), (2, None, ""), (1, "Urs Lindegger", "Lindegger, Lindegger"), (3, "x" * 200_000 + " Lindegger", None)], "nr long, a string, b string").withColumn("art", F.lit("fremd"))
    rows = sorted((r.nr, r.feld, r.art, r.lfd) for r in personal_data(df, "nr", ["a", "b"], names).collect())
    assert rows == [(1, "a", "name", 1)] * 2 + [(1, "b", "name", 1), (1, "b", "name", 2), (3, "a", "name", 1)]
    out = sorted(((r.nr, r.a and r.a[-6:], r.b) for r in redacted(df, "nr", ["a", "b"], names).collect()), key=repr)
    assert out == [(1, "[NAME]", "[NAME], [NAME]"), (1, "[NAME]", None), (2, None, ""), (3, "[NAME]", None)]
    assert personal_data(df.limit(0), "nr", ["a", "b"], names).count() == 0
