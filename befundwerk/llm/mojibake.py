"""Texts that were read in a wrong code page: found and, where nothing is lost, restored.

An unknown swap of code pages is a substitution cipher: each run of signs outside ASCII stands for
a letter. How often each run meets which neighbours is counted over all texts and per source;
expectation maximization then learns which letter each run stands for in its source, or that it is
native, against the language's bigrams, which are learned in the same rounds. Known code pages are a
prior for runs that are too rare to learn from; a page that nobody listed is learned like any other.

All keys are learned from, whatever their number. Up to MOST_KEYS they are learned on the driver, beyond that by the same steps in
parts on the executors; the driver then holds only the swaps' weights and the learned cipher signs.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from encodings.aliases import aliases
from functools import cache
from hashlib import sha256
from itertools import islice
from uuid import uuid4
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from befundwerk.session import shared_folder

#: A run of signs outside ASCII.
RUN = re.compile(r"[^\x00-\x7f]+")
#: Source, sign before, run, sign behind.
Key = tuple[str, str, str, str]
LOST = "\ufffd"
#: Weight of a run outside the alphabet as native before its neighbours are seen; least chance of a restored UTF-8 run.
NATIVE, FLOOR = 0.01, 0.02
#: Letters below this code point are those of Latin alphabets in use. A run is doubtful between neighbours that hold at most RARE of its uses.
#: A sign of which at most CIPHER of its uses are native is a cipher sign.
CIPHER = 0.1
LATIN, RARE = "\u0180", 0.03
#: The letters outside ASCII of the texts' language, which runs start as native; a parameter of ``learn``.
HOME = "äöüÄÖÜß"
#: With a model of other texts, longer runs are read by what it learned from the others.
LONGEST = 16
#: With more keys than that, or with a run of more than WIDE signs, the executors learn, in parts of some PART_KEYS keys.
MOST_KEYS, WIDE, PART_KEYS = 200_000, 256, 20_000
#: Keys that a task holds before it hands them on.
HELD = 100_000
#: Part number of what the parts tell the driver.
DRIVER = -1
#: Longest run that may stand for any letter. A reading that no page knows needs PLACES different neighbours of the sign, or
#: STRONG signs of that kind with two: one sign in one word may be a foreign word, several are a cipher.
FREE_SIGNS, PLACES, STRONG = 4, 3, 2
#: Rounds in which a sign may stand for several letters.
SOFT = 2
#: So many different doubtful runs of a text that all come from one swap prove each other.
AGREE = 2
#: Prior chance that no known page explains a sign, uses that the prior is worth, and uses by which a source is drawn to all sources.
OPEN, PRIOR, PULL = 0.02, 5.0, 20.0
#: Control characters that no text holds natively.
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
#: Code pages in which bytes were written and read; every pair of two is a swap that may have happened.
WRITTEN = ("utf-8", "cp1252", "cp850", "cp437", "mac_roman", "iso8859_15")
READ = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "cp1253", "cp1254", "koi8_r")


def page(name: str) -> dict[str, str]:
    """Sign to byte (as the sign of that number) of a code page; bytes without a sign stand for themselves."""
    out = {}
    for b in range(128, 256):
        out.setdefault(bytes([b]).decode(name, "ignore") or chr(b), chr(b))
        out.setdefault(chr(b), chr(b)) if b < 160 else None
    return out


def page_signs() -> frozenset[str]:
    """Every sign that some single-byte page of Python's codecs has, and the replacement sign: no other sign comes from a wrong page."""
    out = {LOST, *map(chr, range(128, 256))}
    for name in sorted(set(aliases.values())):
        try:
            if len(bytes(range(128)).decode(name)) == 128 and len(bytes([65, 66]).decode(name)) == 2:
                out.update(c for b in range(128, 256) for c in bytes([b]).decode(name, "ignore"))
        except (LookupError, UnicodeError):
            continue
    return frozenset(out)


def runs(s: str) -> list[tuple[str, str, str]]:
    """Each run of a text with the ASCII signs beside it, empty at the text's ends."""
    return [(s[a - 1 : a], s[a:z], s[z : z + 1]) for a, z in (m.span() for m in RUN.finditer(s))]


@dataclass
class Swap:
    """One way of writing and reading; ``signs`` maps a sign back to its byte, ``letters`` the bytes to what was meant."""

    name: str
    signs: dict[int, str]
    letters: dict[int, str] | None = None
    twice: bool = False

    def restore(self, run: str) -> str | None:
        """What ``run`` was, None if it can't come from this swap."""
        if any(ord(c) not in self.signs for c in run):
            return None
        t = run.translate(self.signs)
        if self.letters is not None:
            if any(ord(c) not in self.letters for c in t):
                return None
            return t.translate(self.letters)
        try:
            t = t.encode("latin-1").decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return None
        if self.twice:
            return Swap(self.name, self.signs).restore(t)
        return t


def swaps() -> list[Swap]:
    """All swaps of WRITTEN and READ, and UTF-8 read wrongly twice."""
    out = []
    for read in READ:
        signs = {ord(s): b for s, b in page(read).items()}
        out.append(Swap(f"utf-8>{read}", signs))
        out.append(Swap(f"utf-8>{read} twice", signs, None, True))
        for written in WRITTEN[1:]:
            if written != read:
                letters = {ord(b): s for s, b in page(written).items() if ord(s) > 159}
                out.append(Swap(f"{written}>{read}", signs, letters))
    return out


@cache
def _ways(utf8: bool = False) -> list[Swap]:
    """All swaps, or those of UTF-8 only, which alone make texts shorter."""
    return [w for w in swaps() if not utf8 or w.letters is None]


def _near(c: str) -> str:
    """A neighbour as the bigrams know it: digits are one sign, white space and the text's ends another."""
    return "0" if c.isdigit() else " " if not c or c.isspace() else c


@dataclass
class Model:
    """What was learned. ``meant``: what a run of a source between two neighbours was, for those that some swap wrote; None where that is lost.

    ``swaps`` names what may have been at work there. ``doubtful`` are rare uses that alone prove
    nothing: they are restored in texts where another run comes from the same swap. ``letters`` is each
    source's learned cipher, sign to letter; it reads runs of several letters and those that were not counted.
    """

    meant: dict[Key, str | None] = field(default_factory=dict)
    swaps: dict[Key, frozenset[str]] = field(default_factory=dict)
    doubtful: dict[Key, dict[str, str]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    letters: dict[str, dict[str, str]] = field(default_factory=dict)
    counted: frozenset[Key] | None = None  # only if not all keys were counted
    whole: bool = False  # long runs were counted, too


class _Counts:
    """Counts per source and over all sources, with the neighbours as the bigrams know them."""

    def __init__(self, counts: Mapping[tuple[str, ...], int]) -> None:
        self.per: dict[tuple[str, str, str], Counter[str]] = defaultdict(Counter)
        for key, n in counts.items():
            *source, a, x, z = key
            self.per[_near(a), x, _near(z)]["".join(source)] += n
        self.seen = {k: c.total() for k, c in self.per.items()}
        self.total: Counter[str] = Counter()
        self.places: dict[str, dict[tuple[str, str], int]] = defaultdict(dict)
        for (a, x, z), n in self.seen.items():
            self.total[x] += n
            self.places[x][a, z] = n


def _apart(runs: Iterable[str], parts: int) -> dict[int, list[str]]:
    """Runs by the part that has their keys."""
    out: dict[int, list[str]] = defaultdict(list)
    for x in runs:
        out[crc32(x.encode()) % parts].append(x)
    return out


class _Part:
    """The keys of some runs, all keys of a run together, and what is learned of them round by round.

    A step takes the messages to this part and returns (part, message) for others. What a run of this part may be read as can be a run of
    another part: that one sends its bigrams after each round and gets the uses of the next. DRIVER gets sums, and in ``decide`` the ciphers.
    """

    def __init__(self, counts: Mapping[tuple[str, ...], int], home: str, no: int = 0, parts: int = 1) -> None:
        self.counts, self.home, self.letters, self.no, self.parts = counts, home, set(home), no, parts
        self.own = _Counts(counts)

    def start(self, inbox: list) -> list[tuple[int, object]]:
        """Asks for the runs that own ones may be read as by the known pages."""
        self.made = {x: [(w.name, y) for w in _ways() if (y := w.restore(x)) and y != x and y.isprintable()] for x in self.own.total if LOST not in x}
        asked = _apart({y for o in self.made.values() for _, y in o} | self.letters, self.parts)
        return [(part, (self.no, ys)) for part, ys in asked.items()]

    def answer(self, inbox: list) -> list[tuple[int, object]]:
        """How often those that occur are seen between which neighbours."""
        self.askers = {no: [y for y in ys if y in self.own.total] for no, ys in inbox}
        return [(no, {y: self.own.places[y] for y in ys}) for no, ys in self.askers.items()]

    def begin(self, inbox: list) -> list[tuple[int, object]]:
        """What each run is by each swap of known pages, nothing that is UTF-8 read wrongly itself; how likely it is native."""
        there = {y: seen for m in inbox for y, seen in m.items()}
        own, plainly = self.own, {}

        def plain(y: str) -> bool:
            if y not in plainly:
                shorter = [v for w in _ways(True) if (v := w.restore(y)) and len(v) < len(y)]
                plainly[y] = not (any(v.isprintable() for v in shorter) if y in there and LOST not in y else shorter)
            return plainly[y]

        self.free = {x for x in self.made if len(x) <= FREE_SIGNS and not set(x) <= self.letters}
        self.makes: dict[str, dict[str, list[str]]] = {}
        for x, o in self.made.items():
            for w, y in o:
                if plain(y):
                    self.makes.setdefault(x, {}).setdefault(y, []).append(w)
        del self.made
        self.rho = {x: 1.0 if not self.makes.get(x) and x not in self.free else 1 - NATIVE if set(x) <= self.letters else NATIVE if len(x) == 1 else NATIVE / 5 for x in own.total}
        self.open = {x for x in own.total if self.rho[x] < 1}
        needed = {y for x in self.open for y in self.makes.get(x, ())} | self.letters
        self.theirs = {y: seen for y, seen in there.items() if y in needed}
        self.native = {k: n * self.rho[k[1]] for k, n in own.seen.items()}
        self.written: dict[str, dict[tuple[str, str], float]] = {}
        self.pooled: dict[str, dict[str, float]] = {}
        self.mapping: dict[tuple[str, str], dict[str, float]] = {}
        self.kept: Counter[str] = Counter()
        self.cipher: set[str] = set()  # signs that hardly ever are native; two bigrams are enough for them
        return self._bigrams()

    def _bigrams(self) -> list[tuple[int, object]]:
        """To each part that asked: how often its readings are meant between which neighbours, and whether they are cipher signs."""
        three = {y: defaultdict(float, self.written.get(y, ())) for ys in self.askers.values() for y in ys}
        for (a, x, z), n in self.native.items():
            if x in three:
                three[x][a, z] += n
        return [(no, {y: (three[y], y in self.cipher) for y in ys}) for no, ys in self.askers.items()]

    def expect(self, inbox: list, weight: dict[str, float], last: bool) -> list[tuple[int, object]]:
        """E-step; the readings' uses go to their parts, the swaps' uses and two of the sources with uses to the driver."""
        own, letters, makes, rho, theirs, cipher = self.own, self.letters, self.makes, self.rho, self.theirs, self.cipher
        three, one, left, right, coded = {}, {}, {}, {}, set()
        for m in inbox:
            for y, (n_of, is_cipher) in m.items():
                if y not in theirs:
                    continue
                three[y], one[y], left[y], right[y] = n_of, sum(n_of.values()), defaultdict(float), defaultdict(float)
                for (a, z), n in n_of.items():
                    left[y][a] += n
                    right[y][z] += n
                if is_cipher:
                    coded.add(y)

        def fits(a: str, y: str, z: str) -> float:
            """Chance of these neighbours for a letter: as seen together, and by its two bigrams."""
            n = one.get(y, 0.0)
            if not n:
                return 0.0
            return 0.9 * three[y].get((a, z), 0.0) / n + 0.1 * left[y].get(a, 0.0) * right[y].get(z, 0.0) / n / n

        self.prior = {x: _prior(makes.get(x, {}), weight, self.home if x in self.free else "") for x in self.open}
        pooled, mapping = self.pooled or self.prior, self.mapping
        native: dict[tuple[str, str, str], float] = {}
        written: dict[str, dict[tuple[str, str], float]] = defaultdict(lambda: defaultdict(float))
        self.uses: dict[tuple[str, str], Counter[str]] = defaultdict(Counter)
        self.share: dict[Key, dict[str, float]] = {}
        for (a, x, z), per in own.per.items():
            n = own.seen[a, x, z]
            if x not in self.open:
                native[a, x, z] = n
                continue
            p = rho[x] * self.native[a, x, z] / own.total[x]
            chances: list[tuple[str, float]] = []
            for y in self.prior[x]:
                if y in coded and y not in letters:  # no text means a sign that hardly ever is native
                    continue
                chance = fits(a, y, z)
                if len(x) > len(y) and y in makes.get(x, ()):  # that a native run reads as UTF-8 is rarer than any letter
                    chance = max(chance, FLOOR if y in theirs or y.isalpha() and max(y) < LATIN or len(x) - len(y) > 1 else FLOOR / 100)
                elif theirs.get(y, {}).get((a, z), 0) < n and x not in cipher:  # what was meant is the more common sign between these neighbours
                    continue
                if chance:
                    chances.append((y, (1 - rho[x]) * chance))
            left_native = 0.0
            for q, count in per.items():
                turn = mapping.get((q, x)) or pooled[x]
                by = {y: turn[y] * chance for y, chance in chances}
                whole = p + sum(by.values())
                if not by or whole <= 0:
                    left_native += count
                    continue
                left_native += count * p / whole
                parts = {y: v / whole for y, v in by.items()}
                if last:
                    self.share[q, a, x, z] = parts
                for y, v in parts.items():
                    if y in theirs:
                        written[y][a, z] += count * v
                    self.uses[q, x][y] += count * v
            native[a, x, z] = left_native
        self.kept = Counter()
        for (_, x, _), n in native.items():
            self.kept[x] += n
        self.cipher = {x for x in own.total if own.total[x] >= 10 and self.kept[x] <= own.total[x] * CIPHER}
        self.native, self.pooled = native, pooled
        self.together: dict[str, Counter[str]] = defaultdict(Counter)
        for (_, x), c in self.uses.items():
            self.together[x].update(c)
        worked: Counter[str] = Counter()
        for x, c in self.together.items():
            for y, n in c.items():
                if by_pages := makes.get(x, {}).get(y):
                    top = sum(weight[w] for w in by_pages)
                    for w in by_pages:
                        worked[w] += n * weight[w] / top
        out: list[tuple[int, object]] = [(DRIVER, (worked, sorted({q for q, _ in self.uses})[:2]))]
        return out + [(part, {y: dict(written[y]) for y in ys}) for part, ys in _apart(written, self.parts).items()]

    def settle(self, inbox: list, many: bool, turn_no: int) -> list[tuple[int, object]]:
        """M-step of the mappings, of each source its own if there are ``many``, and of the bigrams."""
        self.written = {}
        for m in inbox:
            for y, uses in m.items():
                into = self.written.setdefault(y, defaultdict(float))
                for k, n in uses.items():
                    into[k] += n
        self.pooled = {x: _smooth(self.together[x], self.prior[x], PRIOR) for x in self.open}
        self.mapping = {(q, x): _smooth(c, self.pooled[x], PULL) for (q, x), c in self.uses.items()} if many else {}
        if turn_no >= SOFT:
            if not many:
                self.pooled = {x: _one_letter(v, self.together[x], self.makes.get(x, {})) for x, v in self.pooled.items()}
            self.mapping = {(q, x): _one_letter(v, self.uses[q, x], self.makes.get(x, {})) for (q, x), v in self.mapping.items()}
        del self.uses, self.together, self.prior
        return self._bigrams()

    def unlisted(self, inbox: list) -> list[tuple[int, object]]:
        """How many signs are most often read as no page reads them."""
        own = self.own
        self.rare = {x for x in own.total if self.kept[x] <= own.total[x] * CIPHER}  # hardly ever native; only then a reading counts that no page knows
        uses: Counter[str] = Counter()
        for (q, a, x, z), parts in self.share.items():
            if x in self.rare and len(own.places[x]) > 1:
                uses[x] += own.per[a, x, z][q] * sum(v for y, v in parts.items() if y not in self.makes.get(x, {}))
        self.strong = {x for x, n in uses.items() if n > 0.5 * own.total[x]}
        return [(DRIVER, len(self.strong))]

    def decide(self, inbox: list, strong: int, weights: dict[str, float]) -> list[tuple[int, object]]:
        """The most likely reading of every counted run; the driver gets each source's cipher of single signs."""
        own, letters = self.own, self.letters
        self.meant, self.swaps, self.doubtful = {}, {}, {}
        votes: dict[tuple[str, str], Counter[str]] = defaultdict(Counter)
        for key, n in self.counts.items():
            *source, a, x, z = key
            q = "".join(source)
            at, k = (q, a, x, z), (_near(a), x, _near(z))
            if LOST in x:
                self.meant[at] = None
                continue
            by_pages = self.makes.get(x, {})
            open_ = x in self.rare and (strong >= STRONG or x in self.strong and len(own.places[x]) >= PLACES)
            parts = {y: v for y, v in self.share.get((q, *k), {}).items() if open_ or y in by_pages}
            if sum(parts.values()) > 0.5:
                y = self.meant[at] = max(sorted(parts), key=parts.get)
                self.swaps[at] = frozenset(by_pages.get(y, ()))
                if x in self.rare and len(y) == 1:
                    votes[q, x][y] += n
                continue
            pages = [(w, y) for y, o in by_pages.items() for w in o if w in weights and set(y) <= letters]
            if CONTROL.search(x):
                self.meant[at] = max(pages, key=lambda o: weights[o[0]])[1] if pages else None
            elif pages and not set(x) <= letters and (own.seen[k] <= RARE * own.total[x] or own.total[x] < 10):
                self.doubtful[at] = dict(pages)
        ciphers: dict[str, dict[str, str]] = {}
        for (q, x), c in votes.items():
            ciphers.setdefault(q, {})[x] = c.most_common(1)[0][0]
        return [(DRIVER, ciphers)]

    def spell(self, inbox: list, ciphers: dict[str, dict[str, str]]) -> list[tuple[int, object]]:
        """Several letters in a row, by the source's cipher."""
        signs: dict[str, tuple[dict[str, str], list[int]]] = {}
        for key in self.counts:
            *source, a, x, z = key
            at = ("".join(source), a, x, z)
            if len(x) > 1 and LOST not in x and not set(self.meant.get(at) or "-") <= self.letters:
                if at[0] not in signs:
                    own = {c: c for c in self.letters} | ciphers.get(at[0], {})
                    signs[at[0]] = own, _widths(own)
                if (y := compose(x, *signs[at[0]], alone=False)) not in (None, x):
                    self.meant[at] = y
        return []


def _rounds(act: Callable[..., list], rounds: int) -> tuple[dict[str, float], dict[str, dict[str, str]]]:
    """The swaps' weights and the sources' ciphers. ``act`` does a step in all parts and returns what they tell the driver."""
    act("start")
    act("answer")
    act("begin")
    names = [w.name for w in _ways()]
    weight, worked = dict.fromkeys(names, 1 / len(names)), Counter()
    for turn_no in range(rounds):
        last = turn_no == rounds - 1
        told = act("expect", weight=weight, last=last)
        worked = Counter()
        for n_of, _ in told:
            worked.update(n_of)
        norm = sum(worked.values()) + 1e-6 * len(names)
        weight = {w: (worked[w] + 1e-6) / norm for w in names}
        if not last:
            act("settle", many=len({q for _, own in told for q in own}) > 1, turn_no=turn_no)
    worked = {w: worked[w] for w in names if worked[w] >= 0.5}
    norm = sum(worked.values()) or 1.0
    weights = {w: n / norm for w, n in worked.items()}
    ciphers: dict[str, dict[str, str]] = {}
    for own in act("decide", strong=sum(act("unlisted")), weights=weights):
        for q, signs in own.items():
            ciphers.setdefault(q, {}).update(signs)
    act("spell", ciphers=ciphers)
    return weights, ciphers


def learn(counts: Mapping[tuple[str, ...], int], rounds: int = 12, home: str = HOME) -> Model:
    """The model from how often each (source, neighbour, run, neighbour) occurs in the whole corpus; the source may be left out.

    Start: letters of the language's own alphabet ``home`` are native, any other run is a cipher sign,
    native with a small weight. What a cipher sign stands for is a mapping that is learned for each
    source: any letter of the alphabet, or what a swap of known pages makes of the sign. The known pages are
    a prior only, worth PRIOR uses, which decides for signs too rare to learn from. E-step: a run's chance as native, or as
    each letter, between its neighbours. M-step: native counts, bigrams of what was meant, the
    mapping of all sources, each source's mapping, drawn to it by PULL uses, and the swaps' weights in the prior.
    """
    part = _Part(counts, home)
    inbox: list = []

    def act(step: str, **told: object) -> list:
        nonlocal inbox
        out = getattr(part, step)(inbox, **told)
        inbox = [m for no, m in out if no != DRIVER]
        return [m for no, m in out if no == DRIVER]

    weights, ciphers = _rounds(act, rounds)
    return Model(part.meant, part.swaps, part.doubtful, weights, ciphers)


def learn_in_parts(keys: DataFrame, parts: int, rounds: int = 12, home: str = HOME) -> tuple[Model, DataFrame]:
    """What ``learn`` returns, by the same steps in ``parts`` parts on the executors: (weights and ciphers, decisions by key).

    ``keys`` has the counts (q, a, x, z, n). After each step parts and messages go to the shared folder and the step before is
    deleted there; the decisions stay, they are read with the result. A part is one task's work, and so is a run with all its keys.
    """
    spark = keys.sparkSession
    folder = f"{shared_folder(spark)}/ciphers-{uuid4().hex}"
    schema = "part int, kind string, data binary"
    at = 0

    def packed(part: _Part, out: list[tuple[int, object]]) -> pa.Table:
        rows = [(part.no, "part", part), *((no, "told" if no == DRIVER else "message", m) for no, m in out)]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([pickle.dumps(r[2]) for r in rows], pa.binary())], names=["part", "kind", "data"])

    def first(t: pa.Table) -> pa.Table:
        q, a, x, z, n, no = (t[c].to_pylist() for c in ("q", "a", "x", "z", "n", "part"))
        part = _Part(dict(zip(zip(q, a, x, z), n)), home, no[0], parts)
        return packed(part, part.start([]))

    def stored(df: DataFrame) -> DataFrame:
        nonlocal at
        at += 1
        df.write.partitionBy("kind").parquet(f"{folder}/{at}")
        if at > 1:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{at - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
        return spark.read.schema(schema).parquet(f"{folder}/{at}")

    def in_parts(df: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return stored(df.repartition(parts, "part").groupBy("part").applyInArrow(f, schema))

    now = keys

    def act(step: str, **told: object) -> list:
        nonlocal now
        if step == "start":
            now = in_parts(keys.withColumn("part", (F.crc32(F.col("x").cast("binary")) % parts).cast("int")), first)
        else:
            shared = spark.sparkContext.broadcast(told)

            def then(t: pa.Table) -> pa.Table:
                part, inbox = None, []
                for kind, data in zip(t["kind"].to_pylist(), t["data"]):
                    if kind == "part":
                        part = pickle.loads(data.as_py())
                    else:
                        inbox.append(pickle.loads(data.as_py()))
                if part is None:  # no run of the corpus falls into this part
                    return t.slice(0, 0).select(["part", "kind", "data"])
                return packed(part, getattr(part, step)(inbox, **shared.value))

            now = in_parts(now.filter(F.col("kind") != "told"), then)
        return [pickle.loads(r["data"]) for r in now.filter(F.col("kind") == "told").select("data").collect()]

    weights, ciphers = _rounds(act, rounds)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                part = pickle.loads(data.as_py())
                rows = [(*k, pickle.dumps((k in part.meant, part.meant.get(k), part.swaps.get(k), part.doubtful.get(k)))) for k in dict.fromkeys((*part.meant, *part.doubtful))]
                if rows:
                    q, a, x, z, d = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(a), pa.array(x), pa.array(z), pa.array(d, pa.binary())], names=["q", "a", "x", "z", "decided"])

    now.filter(F.col("kind") == "part").select("data").mapInArrow(decided, "q string, a string, x string, z string, decided binary").write.parquet(f"{folder}/decided")
    return Model(weights=weights, letters=ciphers, whole=True), spark.read.parquet(f"{folder}/decided")


def _prior(by_pages: dict[str, list[str]], weight: dict[str, float], home: str) -> dict[str, float]:
    """What a run may stand for before it is seen in use: what the known pages make of it by their weights, and evenly any letter."""
    out = dict.fromkeys(home, (OPEN if by_pages else 1.0) / max(1, len(home)))
    top = sum(weight[w] for o in by_pages.values() for w in o)
    for y, o in by_pages.items():
        out[y] = out.get(y, 0.0) + ((1 - OPEN) if home else 1.0) * sum(weight[w] for w in o) / top
    return out


def _smooth(uses: Mapping[str, float], back: dict[str, float], pull: float) -> dict[str, float]:
    n = sum(uses.values()) + pull
    return {y: (uses.get(y, 0.0) + pull * v) / n for y, v in back.items()}


def _one_letter(turn: dict[str, float], uses: Mapping[str, float], by_pages: dict[str, list[str]]) -> dict[str, float]:
    """A cipher sign stands for one letter: of the readings that no page knows only the most used one stays, and none where the pages explain most uses."""
    other = {y: uses.get(y, 0.0) for y in turn if y not in by_pages}
    known = sum(n for y, n in uses.items() if y in by_pages)
    best = max(sorted(other), key=other.get, default=None) if sum(other.values()) > known else None
    return {y: v if y in by_pages or y == best else 0.0 for y, v in turn.items()}


def _widths(letters: Iterable[str]) -> list[int]:
    return sorted({len(k) for k in letters if len(k) > 1}, reverse=True)


def compose(run: str, letters: Mapping[str, str], widths: Sequence[int] | None = None, alone: bool = True) -> str | None:
    """What a run is if it falls apart into learned cipher signs, None if it doesn't; single signs go through ``translate``, longer ones first.

    ``widths`` are those of the longer signs; unless ``alone``, the run as a sign of its own doesn't count.
    """
    if all(c in letters for c in run):
        return run.translate(str.maketrans({c: letters[c] for c in set(run)}))
    widths = _widths(letters) if widths is None else widths
    best: list[str | None] = [""] + [None] * len(run)
    for i in range(len(run)):
        if best[i] is None:
            continue
        for n in (*widths, 1):
            k = run[i : i + n]
            if len(k) == n and k in letters and (alone or k != run) and best[i + n] is None:
                best[i + n] = best[i] + letters[k]
    return best[-1]


def _counted(df: DataFrame, fields: Sequence[str], source: str | None) -> DataFrame:
    """(q, a, x, z, n): counts of runs between their neighbours per source over all rows and fields, added up per task and then by key."""
    signs = page_signs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[tuple[str, str, str, str]] = Counter()

        def counts() -> pa.RecordBatch:
            q, a, x, z = zip(*c)
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(a), pa.array(x), pa.array(z), pa.array(c.values(), pa.int64())], names=["q", "a", "x", "z", "n"])

        for b in batches:
            origin = b.column(0).to_pylist()
            for col in b.columns[1:]:
                for q, s in zip(origin, col.to_pylist()):
                    if s and not s.isascii():
                        c.update((q, *k) for k in runs(s) if signs.issuperset(k[1]))
            if len(c) > HELD:
                yield counts()
                c.clear()
        if c:
            yield counts()

    rows = df.select(_source(source), *fields).mapInArrow(run, "q string, a string, x string, z string, n long")
    return rows.groupBy("q", "a", "x", "z").agg(F.sum("n").alias("n"))


def tally(df: DataFrame, fields: Sequence[str], source: str | None = None, most: int | None = None) -> dict[tuple[str, str, str, str], int]:
    """Counts of runs between their neighbours per source over all rows and fields, on the driver.

    Runs of signs that no single-byte page has aren't counted: no wrong page makes them. ``most`` asks for the most
    frequent keys only; ``misread`` never does.
    """
    g = _counted(df, fields, source)
    if most is not None:
        g = g.orderBy(F.desc("n"), "q", "a", "x", "z").limit(most)
    return {(r["q"], r["a"], r["x"], r["z"]): r["n"] for r in g.collect()}


def _few(g: DataFrame) -> dict[Key, int] | None:
    """The counts if the driver can learn from them, None if there are more than MOST_KEYS or a run is longer than WIDE."""
    rows = g.withColumn("x", F.substring("x", 1, WIDE + 1)).limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS or any(len(r["x"]) > WIDE for r in rows):
        return None
    return {(r["q"], r["a"], r["x"], r["z"]): r["n"] for r in rows}


def _source(source: str | None) -> Column:
    return (F.lit("") if source is None else F.coalesce(F.trim(F.col(source)), F.lit(""))).alias("_quelle")


def uncounted(x: str, model: Model, source: str = "") -> tuple[bool, str | None]:
    """(whether a run that was not counted was misread, what it was): lost signs, UTF-8 by a swap that the corpus knows, or signs that all are ciphers of the source."""
    if LOST in x:
        return True, None
    for w in sorted(_ways(True), key=lambda w: -model.weights.get(w.name, 0)):
        if model.weights.get(w.name, 0) > 0 and (y := w.restore(x)):
            return True, y
    y = compose(x, model.letters.get(source, {}))
    return y is not None, y


def repair(s: str, model: Model, source: str = "") -> tuple[str, bool] | None:
    """(restored text, whether something stays lost), None for a text without a run that a swap wrote."""
    keys = [(source, *k) for k in runs(s)]
    rest = {k[2]: r[1] for k in keys if (len(k[2]) > LONGEST and not model.whole or LOST in k[2] or model.counted is not None and k not in model.counted) and (r := uncounted(k[2], model, source))[0]}
    at_work = set().union(*(model.swaps.get(k, ()) for k in keys))
    if not rest and not any(k in model.meant for k in keys):
        agree = Counter(w for k in set(keys) for w in model.doubtful.get(k, ()))
        at_work = {w for w, n in agree.items() if n >= AGREE}
        if not at_work:
            return None
    lost = False

    def put(m: re.Match) -> str:
        nonlocal lost
        a, z = m.span()
        k = (source, s[a - 1 : a], m[0], s[z : z + 1])
        if k in model.meant or m[0] in rest:
            if (y := model.meant[k] if k in model.meant else rest[m[0]]) is None:
                lost = True
                return m[0]
            return y
        for w, y in model.doubtful.get(k, {}).items():
            if w in at_work:
                return y
        return m[0]

    return RUN.sub(put, s), lost


FOUND = "nr long, feld string, text string, verloren boolean"


def misread(df: DataFrame, nr: str, fields: Sequence[str], model: Model | None = None, source: str | None = None) -> DataFrame:
    """(nr, feld, text, verloren) for each field value with wrongly read signs: the restored text, and whether some are lost.

    ``source`` names the column by which ciphers are learned apart. Two passes: the counts, then the
    texts; nothing but the counts is shuffled, unless they are too many for the driver: then the executors learn from
    them and the texts are joined with the decisions. Null, empty and correct values have no row, a null
    source is one of its own. Repeated rows are cases of their own, further columns are ignored,
    an empty table gives no rows. Replacement signs are cases that can't be restored.
    """
    if model is None:
        counts = _few(_counted(df, fields, source))
        if counts is None:
            return _misread_in_parts(df, nr, fields, source)
        model = learn(counts)
        model.whole = True
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            nrs, origin = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for name, col in zip(fields, b.columns[2:]):
                for i, s in enumerate(col.to_pylist()):
                    if s and not s.isascii() and (r := repair(s, own, origin[i])):
                        rows.append((nrs[i], name, *r))
            if rows:
                yield _found(rows)

    return df.select(F.col(nr).cast("long"), _source(source), *fields).mapInArrow(run, FOUND)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["nr", "feld", "text", "verloren"])


def _misread_in_parts(df: DataFrame, nr: str, fields: Sequence[str], source: str | None) -> DataFrame:
    """``misread`` with the counts and the decisions on the executors. A text is known by the digest of its source and itself."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/keys-{uuid4().hex}"
    _counted(df, fields, source).write.parquet(folder)
    keys = spark.read.parquet(folder)
    model, decided = learn_in_parts(keys, -(-keys.count() // PART_KEYS))
    shared = spark.sparkContext.broadcast(model)
    signs = page_signs()

    def texts(b: pa.RecordBatch) -> Iterator[tuple[int | None, str, str, str, bytes]]:
        nrs, origin = b.column(0).to_pylist(), b.column(1).to_pylist()
        for name, col in zip(fields, b.columns[2:]):
            for i, q, s in zip(nrs, origin, col.to_pylist()):
                if s and not s.isascii():
                    yield i, name, q, s, sha256(f"{len(q)} {q}{s}".encode()).digest()

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((t, q, *k) for _, _, q, s, t in texts(b) for k in set(runs(s)) if signs.issuperset(k[1]))
            while part := list(islice(rows, HELD)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["t", "q", "a", "x", "z"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if rows := list(texts(b)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))], names=["nr", "feld", "q", "text", "t"])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own = Model(weights=known.weights, letters=known.letters, whole=True)
                for h in r["hits"] or ():
                    at = (r["q"], h["a"], h["x"], h["z"])
                    is_meant, meant, by_swaps, doubtful = pickle.loads(h["decided"])
                    if is_meant:
                        own.meant[at] = meant
                    if by_swaps is not None:
                        own.swaps[at] = by_swaps
                    if doubtful is not None:
                        own.doubtful[at] = doubtful
                if out := repair(r["text"], own, r["q"]):
                    rows.append((r["nr"], r["feld"], *out))
            if rows:
                yield _found(rows)

    rows = df.select(F.col(nr).cast("long"), _source(source), *fields)
    hits = rows.mapInArrow(spots, "t binary, q string, a string, x string, z string").join(decided, ["q", "a", "x", "z"]).groupBy("t").agg(F.collect_set(F.struct("a", "x", "z", "decided")).alias("hits"))
    return rows.mapInArrow(whole, "nr long, feld string, q string, text string, t binary").join(hits, "t", "left").select("nr", "feld", "q", "text", "hits").mapInArrow(repaired, FOUND)
