"""Personal data in free text: found by anchors, bounded and checked by local parsers, replaced by typed placeholders.

One Aho-Corasick pass over a text gives all anchors: at-signs, number prefixes, identity cues,
street words, titles, and the words of known names. Each anchor's parser looks at its
surroundings only and either bounds a mention or gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from befundwerk.llm.mojibake import READ, WRITTEN, page

#: Most distinct name words that are handed to all tasks; an automaton of them takes some 0.2 GB.
MOST_NAMES = 300_000

#: Shortest known name that is looked for in capitals, and in small letters.
SHOUTED, WHISPERED = 3, 5
# Cues and shapes.
AT = ("@", "[at]", "(at)", "{at}", "[a]", "(a)", "(ät)", "[ät]", " at ")
PHONE_STARTS = ("+", "(0", " 0", "/0", ":0", "\n0")
ID_CUES = ("Reisepass", "Pass-N", "Passn", "Pass N", "ausweis", "Ausweis", "ID-Karte", "ID-N", "Identit")
TITLES = ("Herr", "Frau", "Dr.", "med.", "Prof.", "gez.", "Sohn", "Tochter", "Ehefrau", "Ehemann", "Nachbarin", "Nachbar", "Pflegefachfrau", "Pflegefachmann", "Kontakt:")
ADDRESSED = frozenset({"Herr", "Frau", "Dr.", "med.", "Prof.", "gez."})
#: Roles after which a name may stand that no register knows; what follows the name must bear it out.
ROLES = ("Patientin", "Patient", "Bewohnerin", "Bewohner", "Hausärztin", "Hausarzt", "Mutter", "Vater", "Schwester", "Bruder", "Partnerin", "Partner", "Beiständin", "Beistand", "Kollegin", "Kollege", "Angehörige", "Angehöriger", "Tante", "Onkel", "Enkelin", "Enkel", "Sozialarbeiterin", "Sozialarbeiter")
#: Given names in use, each of them a hint for a capitalized word behind it only.
GIVEN = ("Adrian", "Agnes", "Albert", "Alexander", "Alfred", "Alice", "Andrea", "Andreas", "Anita", "Anna", "Anton", "Barbara", "Bernhard", "Brigitte", "Bruno", "Christian", "Christina", "Christine", "Claudia", "Daniel", "Daniela", "David", "Doris", "Edith", "Elena", "Elisabeth", "Emil", "Erika", "Ernst", "Esther", "Eva", "Felix", "Florian", "Franz", "Fritz", "Gabriele", "Georg", "Gertrud", "Hanna", "Hannelore", "Hans", "Heidi", "Heinz", "Helga", "Helmut", "Herbert", "Hermann", "Hugo", "Ingrid", "Irene", "Jakob", "Jan", "Johann", "Johanna", "Josef", "Julia", "Jürg", "Jürgen", "Karin", "Karl", "Katharina", "Klaus", "Kurt", "Laura", "Lea", "Leo", "Liselotte", "Luca", "Lukas", "Manfred", "Marco", "Margrit", "Maria", "Marianne", "Marie", "Markus", "Martha", "Martin", "Max", "Michael", "Monika", "Nicole", "Nina", "Otto", "Paul", "Paula", "Peter", "Petra", "Philipp", "Rita", "Robert", "Roland", "Rolf", "Rosa", "Rosmarie", "Rudolf", "Ruth", "Sabine", "Sandra", "Sara", "Silvia", "Simon", "Sonja", "Stefan", "Susanne", "Theo", "Thomas", "Ursula", "Verena", "Walter", "Werner", "Wilhelm", "Willi", "Wolfgang")
#: Countries whose account numbers are looked for; the check digits decide.
ACCOUNTS = ("CH", "LI", "DE", "AT", "FR", "IT")
STREET_ENDS = ("strasse ", "straße ", "str. ", "gasse ", "weg ", "platz ", "rain ", "acker ", "halde ", "steig ", "allee ", "ring ", "matte ", "feld ", "quai ", "Strasse ", "Weg ", "Platz ")
STREET_STARTS = ("Im ", "Am ", "Zum ", "Zur ", "Beim ", "In der ", "An der ", "Auf der ", "Auf dem ", "Unter den ", "Unter der ", "Hinter ", "Ob der ", "Rue ", "Chemin ", "Avenue ", "Route ", "Place ", "Via ", "Viale ", "Piazza ")
#: Words that end like streets or follow a preposition and are none.
NO_STREETS = frozenset("Zugangsweg Liegeplatz Wärmeplatz Arbeitsplatz Schlafplatz Sitzplatz Stehplatz Parkplatz Bettplatz Behandlungsplatz Pflegeplatz Heimplatz Messplatz Atemweg Luftweg Harnweg Gallenweg Infusionsweg Applikationsweg Rettungsweg Fluchtweg Gehweg Operationsfeld Sichtfeld Gesichtsfeld Monitorplatz Dialyseplatz Intensivplatz Überwachungsplatz Kontaktallergiering".split())
NO_PLACES = frozenset("Verlauf Status Alter Zimmer Bett Tag Vortag Jahr Monat Score Mittel Labor Stadium Punkt Gespräch Termin".split())
#: Surnames that are common words as well: at the start of a sentence they need a verb, title or given name beside them.
COMMON = frozenset("Lang Kurz Stark Fröhlich Klein Gross Groß Jung Alt Neu Weiss Weiß Schwarz Braun Roth Rot Grün Blau Frei Kalt Warm Lieb Fromm Wild Still Reich Arm Gut Ernst Winter Sommer Bach Berg Stein Baum Sauer Bitter Heiss Heiß Sauber Schnell Frisch Recht Hell Dunkel Zart Hoch Breit Schmal Spitz Starr Steif Süss Süß".split())
VERB = re.compile(r" (?:wirkt|lehnt|wünsch|wurde|wird|war|ist|hat|hatte|klagt|fragt|rief|ruft|ass|isst|verneint|bericht|äusser|konnte|kann|schläft|schlief|bittet|möchte|sagt|gibt|lebt|wohnt|kommt|kam|nimmt|erhielt|erhält|benötigt|zeigt)")

_ACCOUNT = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![A-Z\d])")
#: What may follow a name that only a role or a given name vouches for.
_AFTER = re.compile(r"\s*(?:$|[.,;:!?()\n]|und\b|" + VERB.pattern[1:] + r")")
#: Endings of nouns that are no surnames.
_NOUN = re.compile(r"(?:ung|ungen|heit|keit|tion|tionen|schaft|ität|ismus|pflege|station|therapie|bericht|gespräch|kontakt|dienst|verfügung|zimmer|status)$", re.I)
_LOCAL = frozenset("_.+%-")
_DOT = r"(?:\.|\s?[(\[{](?:punkt|dot|Punkt|PUNKT|DOT)[)\]}]\s?)"
_RIGHT = re.compile(rf"\s?[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*{_DOT}[^\W\d_]{{2,}}")
_PHONE = re.compile(
    r"\+\d{1,3}(?:[ /.-]?\(0\))?(?:[ /.-]?\d{2,6}){2,5}(?!\d)|00[1-9]\d(?:[ /.-]?\(0\))?(?:[ /.-]?\d{2,6}){2,5}(?!\d)"
    r"|\(0\d{2}\)[ /.-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}(?!\d)|0[1-9]\d[ /.-]\d{3}[ .-]?\d{2}[ .-]?\d{2}(?!\d)|0[1-9]\d{8}(?!\d)"
)
_SOCIAL = re.compile(r"756[. ]?\d{4}[. ]?\d{4}[. ]?\d{2}(?![\d])")
_CARD = re.compile(r"80756\d{15}(?!\d)")
_PAPER = re.compile(r"[\w.:-]*[\s:.]{0,3}(?:(?:Nr|Nummer|nummer|No)\b\.?:?\s?)?([A-Z]\d{7}|[A-Z]\d{4}[A-Z]\d{3}|[A-Z]{2}\d{6,7})(?!\w)")
_NUMBER = re.compile(r"\s?\d{1,3}\s?[a-z]?(?![\w-])(?!\.\d)(?!\s?(?:mg|g|ml|µg|kg|l|h|Tag|Woche|Monat|Punkt|%|°))")
_NAMED = re.compile(r"(?:[a-z]{2,5} (?:la )?)?([A-ZÄÖÜ][^\s,;.()\d]*)(?: [A-ZÄÖÜ][^\s,;.()\d]*)?(?= \d)")
_TOWN = re.compile(r",?\s(?:(?:[A-Z]{1,2}-)?\d{4,5}\s|in\s)[A-ZÄÖÜ][^\s,;.()]*(?:\s(?:am|an der|im|ob|bei)\s[A-ZÄÖÜ][^\s,;.()]*|(?<=\sVal)\s[A-Z][^\s,;.()]*|(?<=\sBad)\s[A-Z][^\s,;.()]*)?")
_SOME_NAME = re.compile(r"(?:[A-ZÄÖÜ]\. )?[A-ZÄÖÜŠÉ][^\s,;.:()\d@]{2,}(?: [A-ZÄÖÜ]\.)?(?: [A-ZÄÖÜŠ][^\s,;.:()\d@]{2,})?")
#: One or two capitalized words behind a role or a given name.
_OWN_SURNAME = re.compile(r" ((?:[A-ZÄÖÜ]\. |von |van |de |di |[A-ZÄÖÜ][a-zäöüßéèà]+ (?=[A-ZÄÖÜ][a-zäöüßéèà]))?[A-ZÄÖÜ][a-zäöüßéèàšç]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?)(?![\w@])")
#: Capitalized words behind roles that are none.
NO_SURNAMES = frozenset("Dr Prof Frau Herr Herrn Delir Sturz Schmerz Schmerzen Fieber Status Verlauf Eintritt Austritt Übertritt Spital Klinik Heim Praxis Telefon Name Wunsch Rollator Bett Tag Nacht Woche Monat Jahr Morgen Abend Parkinson Alzheimer Spitex Arzt Ärztin".split())
_INITIAL = re.compile(r" [^\W\d_]\. ?$")
_GAP = re.compile(r" [^\W\d_]\. ")
_JOINED = re.compile(r"(?:-[^\W\d_][^\s,;.:()\d@]+)+")
_TRAILING = re.compile(r" [A-ZÄÖÜ]\.(?= [A-ZÄÖÜ])")

ARTS = ("email", "telefon", "idnr", "adresse", "name")
PLACEHOLDERS = {"konto": "[KONTO]", "email": "[EMAIL]", "telefon": "[TELEFON]", "idnr": "[IDNR]", "adresse": "[ADRESSE]", "name": "[NAME]"}


def check_digit(digits: str) -> bool:
    """Whether a 13-digit number's last digit is right for the others."""
    return sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(digits)) % 10 == 0


def account_digits(number: str) -> bool:
    """Whether an account number's two check digits are right for the rest."""
    n = number.replace(" ", "")
    return 15 <= len(n) <= 34 and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def misread_forms(word: str) -> set[str]:
    """How a word looks after the usual swaps of code pages, and with its other letters lost."""
    out = set()
    if word.isascii():
        return out
    back = {r: {ord(b): s for s, b in reversed(page(r).items())} for r in READ}
    for written in WRITTEN:
        try:
            raw = word.encode(written)
        except UnicodeEncodeError:
            continue
        as_bytes = raw.decode("latin-1")
        for read in READ:
            if read != written:
                once = as_bytes.translate(back[read])
                out.add(once)
                if written == "utf-8":
                    out.add("".join(once).encode("utf-8").decode("latin-1").translate(back[read]))
    out.add("".join(c if c.isascii() else "�" for c in word))
    out.add("".join(c if c.isascii() else "��" for c in word))
    out.discard(word)
    return out


@dataclass(frozen=True)
class Mention:
    art: str
    start: int
    end: int


class Finder:
    """All mentions of a text. ``given`` and ``family`` are the known names."""

    def __init__(self, given: Sequence[str], family: Sequence[str]) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        keys: dict[str, str] = {}
        for art, words in (("konto", ACCOUNTS), ("role", ROLES), ("given", GIVEN), ("at", AT), ("tel", PHONE_STARTS), ("id", ("756", *ID_CUES)), ("title", TITLES), ("street", STREET_ENDS), ("street_at", STREET_STARTS)):
            for w in words:
                keys[w] = art
        for kind, words in (("G", given), ("S", family)):
            for w in words:
                for form in (w, *misread_forms(w)):
                    keys[form] = kind if keys.get(form) in (None, "given") else keys[form]
                if len(w) >= SHOUTED and w not in COMMON:
                    keys.setdefault(w.upper(), kind)
                if len(w) >= WHISPERED and w not in COMMON and w[:1].isupper():
                    keys.setdefault(w.lower(), kind.lower())
        for w, art in keys.items():
            self.auto.add_word(w, (art, len(w)))
        self.auto.make_automaton()

    def find(self, s: str) -> list[Mention]:
        """The mentions in text order, none overlapping; email goes before number, address and name."""
        hits: dict[str, list[tuple[int, int]]] = {}
        for last, (art, n) in self.auto.iter(s):
            hits.setdefault(art, []).append((last + 1 - n, last + 1))
        if s[:1] == "0":
            hits.setdefault("tel", []).append((0, 1))
        if not hits:
            return []
        out: list[Mention] = []
        for parser in (self._emails, self._accounts, self._ids, self._phones, self._addresses, self._names):
            if parser == self._names:  # names inside other mentions are none
                for k in "GSgs":
                    hits[k] = [(a, z) for a, z in hits.get(k, ()) if all(z <= o.start or a >= o.end for o in out)]
            for m in parser(s, hits):
                if m.end > m.start and all(m.end <= o.start or m.start >= o.end for o in out):
                    out.append(m)
        return sorted(out, key=lambda m: m.start)

    def _emails(self, s: str, hits: dict) -> Iterator[Mention]:
        for a, z in hits.get("at", ()):
            end = a - (s[a - 1 : a].isspace())
            start = end
            while start and (s[start - 1].isalnum() or s[start - 1] in _LOCAL):
                start -= 1
            while start < end and not s[start].isalnum():
                start += 1
            right = _RIGHT.match(s, z) if start < end and s[end - 1] != "." else None
            if right and not (s[a:z] == " at " and "." not in right[0]):
                yield Mention("email", start, right.end())

    def _accounts(self, s: str, hits: dict) -> Iterator[Mention]:
        for a, z in hits.get("konto", ()):
            if s[z : z + 2].isdigit() and not s[a - 1 : a].isalnum() and (m := _ACCOUNT.match(s, a)) and account_digits(m[0]):
                yield Mention("konto", a, m.end())

    def _ids(self, s: str, hits: dict) -> Iterator[Mention]:
        for a, z in hits.get("id", ()):
            if s[a:z] == "756":
                if s[a - 2 : a] == "80" and (m := _CARD.match(s, a - 2)) and not s[a - 3 : a - 2].isdigit():
                    yield Mention("idnr", a - 2, m.end())
                elif (m := _SOCIAL.match(s, a)) and not s[a - 1 : a].isdigit() and check_digit(re.sub(r"\D", "", m[0])):
                    yield Mention("idnr", a, m.end())
            elif m := _PAPER.match(s, z):
                yield Mention("idnr", m.start(1), m.end(1))

    def _phones(self, s: str, hits: dict) -> Iterator[Mention]:
        for a, z in hits.get("tel", ()):
            at = a + (s[a] in " /:\n")
            m = _PHONE.match(s, at)
            digits = sum(c.isdigit() for c in m[0]) if m else 0
            if m and not s[at - 1 : at].isdigit() and (12 if m[0][:2] == "00" else 9) <= digits <= 15:
                yield Mention("telefon", at, m.end())

    def _addresses(self, s: str, hits: dict) -> Iterator[Mention]:
        for a, z in hits.get("street", ()):
            start = max(s.rfind(" ", 0, a), s.rfind("\n", 0, a), s.rfind("(", 0, a)) + 1
            word = s[start : z - 1]
            if not word[:1].isupper() or word in NO_STREETS or start == a and word[:1].islower():
                continue
            if m := _NUMBER.match(s, z):
                yield self._with_town(s, start, m.end())
        for a, z in hits.get("street_at", ()):
            if s[a - 1 : a].isalpha():
                continue
            m = _NAMED.match(s, z)
            if m and m[1] not in NO_PLACES and (n := _NUMBER.match(s, m.end())):
                yield self._with_town(s, a, n.end())

    @staticmethod
    def _with_town(s: str, a: int, z: int) -> Mention:
        t = _TOWN.match(s, z)
        return Mention("adresse", a, t.end() if t else z)

    def _names(self, s: str, hits: dict) -> Iterator[Mention]:
        words = sorted([(a, -z, k) for k in "GSgs" for a, z in hits.get(k, ())])
        parts: list[tuple[int, int, str]] = []
        for a, nz, k in words:
            z = -nz
            if (parts and a < parts[-1][1]) or s[a - 1 : a].isalnum() and a or s[z : z + 1].isalnum() or s[z : z + 1] == "@":
                continue
            parts.append((a, z, k.upper()))
        small = {(a, -nz) for a, nz, k in words if k.islower()}
        titles = {z for a, z in hits.get("title", ()) if not (a and s[a - 1].isalnum())}
        spans: list[list] = []  # start, end, kinds
        for a, z, k in parts:
            if spans:
                p = spans[-1]
                gap = s[p[1] : a]
                if gap == "-" or (k == "S" and p[2][-1] == "G" and "S" not in p[2] and (gap == " " or _GAP.fullmatch(gap))) or (gap == ", " and k == "G" and "G" not in p[2]):
                    p[1] = z
                    p[2] += k
                    continue
            spans.append([a, z, k])
        taken = []
        for a, z, kinds in spans:
            core = s[a:z]
            if i := _INITIAL.search(s, max(0, a - 4), a):
                a0 = i.start() + 1
            elif a >= 3 and s[a - 2 : a] == ". " and s[a - 3].isupper() and (a == 3 or s[a - 4] in " (\n\t"):
                a0 = a - 3
            else:
                a0 = a
            if kinds == "G" and (t := _TRAILING.match(s, z)):
                z = t.end()
            if t := _JOINED.match(s, z):
                z = t.end()
            called = s[a0 - 1 : a0] == " " and a0 - 1 in titles
            if len(core) < 3 and a0 == a and not called:  # so short a word needs a title, an initial or another name
                continue
            if kinds == "G" and (a, z) in small:  # given names in small letters need a surname
                continue
            if kinds == "G" and (t := _OWN_SURNAME.match(s, z)) and self._borne_out(s, t):
                z = t.end(1)
            if kinds == "S" and s[a:z] in COMMON and a0 == a:
                before = s[:a].rstrip(" ")
                start = not before or before[-1] in ".!?;:\n-" and not before.endswith(("Dr.", "med.", "Prof.", "gez.", "Kontakt:"))
                if start and not VERB.match(s, z):
                    continue
            taken.append((a0, z))
            yield Mention("name", a0, z)
        # a title in front of a name that isn't known
        for z in sorted(titles):
            a = z + (s[z : z + 1] == "n") if s[z - 4 : z] == "Herr" else z
            if s[a : a + 1] != " ":
                continue
            m = _SOME_NAME.match(s, a + 1)
            if not m or any(x < m.end() and m.start() < y for x, y in taken):
                continue
            word = next((w for t in TITLES if (w := s[z - len(t) : z]) == t), "")
            odd = not m[0].isascii() and any(not c.isalpha() for c in m[0] if not c.isascii())
            if word in ADDRESSED and m[0].split()[0] not in ("Dr", "Prof", "Doktor", "Professor") or odd and word:
                taken.append(m.span())
                yield Mention("name", m.start(), m.end())
        # a role or a given name in use in front of one
        for kind in ("role", "given"):
            for a, z in hits.get(kind, ()):
                if s[a - 1 : a].isalnum() and a or s[z : z + 1] != " ":
                    continue
                m = _OWN_SURNAME.match(s, z)
                at = z + 1 if kind == "role" else a
                if m and self._borne_out(s, m) and not any(x < m.end(1) and at < y for x, y in taken):
                    taken.append((at, m.end(1)))
                    yield Mention("name", at, m.end(1))

    @staticmethod
    def _borne_out(s: str, m: re.Match) -> bool:
        """Whether a capitalized word behind a role or given name is a surname by its shape and by what follows."""
        word = m[1].split()[-1]
        return not _NOUN.search(word) and word not in NO_SURNAMES and bool(_AFTER.match(s, m.end(1)))


def number_mentions(mentions: Sequence[Mention]) -> list[tuple[Mention, int]]:
    """Each mention with its number among those of its kind."""
    n: dict[str, int] = {}
    out = []
    for m in mentions:
        n[m.art] = n.get(m.art, 0) + 1
        out.append((m, n[m.art]))
    return out


def redact(s: str, mentions: Sequence[Mention]) -> str:
    """The text with each mention replaced by the placeholder of its kind, otherwise unchanged."""
    out, at = [], 0
    for m in mentions:
        out += [s[at : m.start], PLACEHOLDERS[m.art]]
        at = m.end
    return "".join([*out, s[at:]])


_FINDERS: dict[int, Finder] = {}


def _finder(names: tuple[tuple[str, ...], tuple[str, ...]]) -> Finder:
    key = hash(names)
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(*names)
    return _FINDERS[key]


def name_words(tables: Sequence[DataFrame], given: str = "vorname", family: str = "nachname") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The distinct given and family names of the tables; refused beyond MOST_NAMES, which the number of persons doesn't drive."""
    one = [t.select(F.col(c).alias("w"), F.lit(k).alias("k")) for t in tables for c, k in ((given, "G"), (family, "S"))]
    every = one[0]
    for t in one[1:]:
        every = every.unionByName(t)
    rows = every.filter("w IS NOT NULL AND trim(w) <> ''").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} distinct names")
    pick = lambda k: tuple(sorted(r["w"] for r in rows if r["k"] == k))
    return pick("G"), pick("S")


def personal_data(df: DataFrame, nr: str, fields: Sequence[str], names: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    """One row (nr, feld, art, lfd, von, bis) per mention, numbered per kind in text order.

    Null and empty texts have none. Repeated rows are cases of their own, further columns are
    ignored, an empty table gives no rows. Whole texts are read; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(shared.value).find
        for b in batches:
            nrs = b.column(0).to_pylist()
            rows = [(nrs[i], name, m.art, k, m.start, m.end) for name, col in zip(fields, b.columns[1:]) for i, s in enumerate(col.to_pylist()) if s for m, k in number_mentions(find(s))]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["nr", "feld", "art", "lfd", "von", "bis"])

    return df.select(F.col(nr).cast("long"), *fields).mapInArrow(run, "nr long, feld string, art string, lfd int, von int, bis int")


def redacted(df: DataFrame, nr: str, fields: Sequence[str], names: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    """(nr, the fields with placeholders for all mentions); null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(shared.value).find
        for b in batches:
            out = [pa.array([redact(s, m) if s and (m := find(s)) else s for s in col.to_pylist()], pa.string()) for col in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["nr", *fields])

    return df.select(F.col(nr).cast("long"), *fields).mapInArrow(run, "nr long, " + ", ".join(f"`{c}` string" for c in fields))
