"""Personal data beyond the register: surnames that no list holds, behind roles and given names that the parsers list; found and redacted."""

import random

import pytest

from befundwerk.llm.pii import Finder, account_digits, redact

#: The finder is told the first two of either; the other given names are in its list, the other surnames nowhere.
FAMILY = ["Zogg", "Ng", "Marti", "Odermatt", "Vonlanthen", "Yildiz", "Petrovic", "Schüpbach", "Aebi", "Camenzind", "Nguyen", "Rüegsegger"]
CALLED = ["Reto", "Bo", "Hans", "Anna", "Peter", "Ursula", "Verena", "Markus"]


@pytest.fixture(scope="module")
def finder():
    return Finder(["Reto", "Bo"], ["Zogg", "Ng", "Li", "Meier", "Lindegger"])


def kinds(finder, s):
    return [(m.art, s[m.start : m.end]) for m in finder.find(s)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Frau Li und Herr Ng kamen. Li-Ion-Akku, NG-Sonde, Ng.", ["Li", "Ng"]),
        ("Bo Ng rief an, B. Li auch.", ["Bo Ng", "B. Li"]),
        ("ANNA MEIER und lindegger, dann MEIER.", ["MEIER", "lindegger", "MEIER"]),
        ("Patientin Odermatt klagt über Schmerzen. Patientin Status stabil. Patient Delir.", ["Odermatt"]),
        ("Hans Camenzind rief an. Hans Spital. Anna wirkt müde.", ["Hans Camenzind"]),
        ("Reto Vonlanthen wünscht Rückruf.", ["Reto Vonlanthen"]),
        ("Tochter Verena Aebi, Hausarzt Rüegsegger.", ["Verena Aebi", "Rüegsegger"]),
        ("reto war da", []),
    ],
)
def test_names_beyond_the_register(finder, text, want):
    assert [x for k, x in kinds(finder, text) if k == "name"] == want


def test_whole_local_parts_and_accounts(finder):
    local = "a" * 300 + ".b"
    s = f"Mail {local}@praxis.example, Konto CH93 0076 2011 6238 5295 7 und DE89370400440532013000, nicht CH93 0076 2011 6238 5295 8."
    assert kinds(finder, s) == [("email", f"{local}@praxis.example"), ("konto", "CH93 0076 2011 6238 5295 7"), ("konto", "DE89370400440532013000")]
    assert redact(s, finder.find(s)) == "Mail [EMAIL], Konto [KONTO] und [KONTO], nicht CH93 0076 2011 6238 5295 8."
    assert account_digits("GB82 WEST 1234 5698 7654 32") and not account_digits("GB82 WEST 1234 5698 7654 33")
    assert kinds(finder, "@" * 2000 + "x" * 2000 + " [at] ") == []


def test_held_out_texts_are_found_and_redacted(finder):
    """Templates that were written after the parsers, by the same hand: recall and precision by mention, and the redacted text itself."""
    rng = random.Random(11)
    name = lambda: rng.choice(FAMILY)
    forms = [
        (lambda: f"Rücksprache mit Herrn {(n := name())} erfolgt.", lambda t: [("name", t.split("Herrn ")[1].split(" erfolgt")[0])]),
        (lambda: f"Die Entlassung besprach Frau Dr. {name()} am Telefon.", lambda t: [("name", t.split("Dr. ")[1].split(" am")[0])]),
        (lambda: f"Patientin {rng.choice(FAMILY[2:])} lehnt die Sonde ab.", lambda t: [("name", t.split()[1])]),
        (lambda: f"Schwester {rng.choice(CALLED[2:])} {rng.choice(FAMILY[2:])}, erreichbar 079 {rng.randint(200, 999)} {rng.randint(10, 99)} {rng.randint(10, 99)}.", lambda t: [("name", " ".join(t.split(",")[0].split()[1:])), ("telefon", t.split("erreichbar ")[1].rstrip("."))]),
        (lambda: f"Befund an {name().lower()}.praxis@hin.example gesendet.", lambda t: [("email", t.split()[2])]),
        (lambda: f"{rng.choice(CALLED[2:])} {rng.choice(FAMILY[2:])} wünscht ein Einzelzimmer.", lambda t: [("name", " ".join(t.split()[:2]))]),
        (lambda: f"Wohnhaft Lerchenweg {rng.randint(1, 99)}, {rng.randint(1000, 9699)} Musterlingen.", lambda t: [("adresse", t.split("Wohnhaft ")[1].rstrip("."))]),
        (lambda: "Im weiteren Verlauf stabil, Kontrolle in 3 Wochen.", lambda t: []),
        (lambda: f"Infusion {rng.randint(10, 99)} ml/h über 078 Minuten, Puls 0{rng.randint(60, 99)}.", lambda t: []),
        (lambda: "Patient schläft, Patientin Verlauf unauffällig, Bruder informiert.", lambda t: []),
    ]
    hit = found = planted = clean = 0
    for _ in range(600):
        make, cases = rng.choice(forms)
        text = make()
        want, got = cases(text), kinds(finder, text)
        hit += sum(x in got for x in want)
        found, planted = found + len(got), planted + len(want)
        out = redact(text, finder.find(text))
        clean += all(x not in out for _, x in want)
    assert hit >= 0.9 * planted and hit >= 0.9 * found and clean >= 0.95 * 600, (hit, planted, found, clean)
