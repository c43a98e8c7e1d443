"""Cutting oversized texts into pieces under a token limit, at natural boundaries where there are any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from befundwerk.llm.tokens import TOKENIZERS, Codec, blocks, codec, rank_file, read_limits

#: Least limit: a character may take so many tokens.
LEAST = 4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = ~_SPACE
_PLAIN[128:] = False


class Document:
    """One text with the byte offsets of its tokens and its sorted boundaries."""

    def __init__(self, c: Codec, text: str, ids: np.ndarray) -> None:
        self.codec, self.data = c, text.encode()
        self.starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(c.lengths[ids], out=self.starts[1:])
        b = np.frombuffer(self.data, np.uint8)
        space = _SPACE[b]
        #: Places where the tokens left and right don't depend on each other.
        self.safe = np.flatnonzero(space[1:] & _PLAIN[b[:-1]]) + 1
        end = (b == 10) | ((b == 13) & np.append(b[1:] != 10, True))
        lines = np.flatnonzero(end) + 1
        lines = lines[lines < len(b)]
        blank = lines[_line_is_blank(b, space, lines)]
        top = blank[~space[blank]]
        #: From the best kind to the least: a blank line before a line that isn't indented, a blank line, a line, a word.
        self.kinds = (top, blank, lines, self.safe)

    def index(self, at: int) -> int:
        """The token that begins at ``at`` or holds it."""
        return int(self.starts.searchsorted(at, "right")) - 1

    def count(self, a: int, z: int) -> int:
        """The tokens of the piece from byte a to byte z when it is encoded alone: a difference of prefix sums, but for the pieces of words at its ends."""
        i, k = self.safe.searchsorted(a), int(self.safe.searchsorted(z, "right")) - 1
        if i > k:
            return self.codec.count(self.data[a:z].decode())
        s, e = int(self.safe[i]), int(self.safe[k])
        inner = int(self.starts.searchsorted(e) - self.starts.searchsorted(s))
        return self.codec.count(self.data[a:s].decode()) + inner + self.codec.count(self.data[e:z].decode())

    def whole(self, at: int) -> int:
        """The last place not after ``at`` where a character begins."""
        while at < len(self.data) and at > 0 and self.data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def cut(self, low: int, half: int, high: int) -> int:
        """The last boundary in (low, high]: kinds that structure a text count only beyond ``half``, lines and words anywhere."""
        for k, places in enumerate(self.kinds):
            j = int(places.searchsorted(high, "right")) - 1
            if j >= 0 and places[j] > (half if k < 2 else low):
                return int(places[j])
        return 0


def _line_is_blank(b: np.ndarray, space: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Whether the line that ends before each place holds white space only."""
    if not len(lines):
        return np.zeros(0, bool)
    marks = np.concatenate(([0], np.cumsum(~space)))
    begin = np.concatenate(([0], lines[:-1]))
    return (marks[lines] - marks[begin] == 0) & (lines > 1)


def split_text(c: Codec, text: str, most: int, overlap: int, ids: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(first byte, last byte + 1, tokens) of each piece; none if the text isn't above ``most`` tokens.

    The next piece begins ``overlap`` tokens of the text before the end of the last, or at the
    character that the token there is part of. Where no boundary of any kind lies beyond the
    overlap, the cut is at the last character under the limit.
    """
    if most < LEAST or not 0 <= overlap < most:
        raise ValueError(f"the limit is at least {LEAST}, the overlap less than the limit")
    ids = c.ids(text) if ids is None else ids
    if len(ids) <= most:
        return []
    d = Document(c, text, ids)
    out: list[tuple[int, int, int]] = []
    a = last = 0
    while last < len(d.data):
        z, n = _piece(d, a, last, most, overlap)
        while z <= last:  # signs of many tokens at the cut: then fewer are shared
            a = _next_char(d.data, a)
            z, n = _piece(d, a, last, most, overlap)
        out.append((a, z, n))
        last = z
        a = max(d.whole(int(d.starts[max(d.index(z) - overlap, 0)])) if overlap else z, _next_char(d.data, a))
    return out


def _piece(d: Document, a: int, last: int, most: int, overlap: int) -> tuple[int, int]:
    """(end, tokens) of the longest piece from byte ``a`` that ends at a boundary behind ``last``, else at a character."""
    i, room, n_ids = d.index(a), most, len(d.starts) - 1
    while True:
        if i + room >= n_ids:
            z = len(d.data)
        else:
            low, half, high = max(last, int(d.starts[min(i + overlap + 1, n_ids)])), int(d.starts[i + room // 2]), int(d.starts[i + room])
            z = d.cut(low, max(low, half), high) or max(d.whole(high), _next_char(d.data, a))
        n = d.count(a, z)
        if n <= most or room <= 4:
            return z, n
        room = max(4, room - max(1, n - most))


def _next_char(data: bytes, at: int) -> int:
    at += 1
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


OUT = "doc_id long, regel string, stueck int, von long, bis long, n_tokens int, text string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("regel", pa.string()), ("stueck", pa.int32()), ("von", pa.int64()), ("bis", pa.int64()), ("n_tokens", pa.int32()), ("text", pa.string())])


def rule_faults(rules: DataFrame) -> DataFrame:
    """(regel, grund) of rules that no pieces can follow: no tokenizer, a limit below LEAST, or an overlap that isn't below the limit."""
    return rules.select("regel", _fault().alias("grund")).filter(F.col("grund").isNotNull())


def _fault() -> Column:
    most, overlap = F.col("max_tokens"), F.col("overlap_tokens")
    return F.when(F.col("tokenizer").isNull(), "tokenizer").when(most.isNull() | (most < LEAST), "max_tokens").when((overlap < 0) | (overlap >= most), "overlap_tokens")


def split_documents(df: DataFrame, rules: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """The pieces of every text above a rule's limit; von and bis count characters.

    ``rules`` is a small table (regel, max_tokens, overlap_tokens, tokenizer); a null overlap is none. A rule that no
    pieces can follow gives none and doesn't stop the others; ``rule_faults`` names it. Null and empty texts
    and texts within the limit have no pieces. Each row is cut by itself, so nothing is shuffled
    and repeated rows come out repeatedly. A text of no more bytes than the limit isn't encoded.
    """
    sound = rules.filter(_fault().isNull()).select("regel", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("o"), "tokenizer")
    limits = sorted(((r["max_tokens"], r["o"], r["regel"], r["tokenizer"]) for r in read_limits(df.sparkSession, sound)), key=repr)
    ranks = df.sparkSession.sparkContext.broadcast({t: rank_file(t, folder) for *_, t in limits})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = {t: codec(r) for t, r in ranks.value.items()}
        rows: list[tuple] = []
        size = 0
        for b in batches:
            texts, size_of = b.column(1).to_pylist(), pc.binary_length(b.column(1)).to_pylist()
            encoded: dict[tuple[str, int], np.ndarray] = {}
            for part in blocks(texts):
                for tokenizer in codecs:
                    least = min(m for m, _, _, t in limits if t == tokenizer)
                    own = [i for i in range(part.start, part.stop) if (size_of[i] or 0) > least]
                    encoded |= {(tokenizer, i): np.frombuffer(r, "<i4") for i, r in zip(own, codecs[tokenizer].raw_batch([texts[i] for i in own]))}
            for i, (nr, s, n_bytes) in enumerate(zip(b.column(0).to_pylist(), texts, size_of)):
                data = None
                for most, overlap, name, tokenizer in limits:
                    if (n_bytes or 0) <= most:
                        continue
                    pieces = split_text(codecs[tokenizer], s, most, overlap, encoded[tokenizer, i])
                    if not pieces:
                        continue
                    data = s.encode() if data is None else data
                    plain = len(data) == len(s)
                    chars = 0
                    seen = 0
                    for k, (a, z, n) in enumerate(pieces, 1):
                        if plain:
                            von, bis, part = a, z, s[a:z]
                        else:
                            part = data[a:z].decode()
                            von = chars + len(data[seen:a].decode()) if a >= seen else chars - len(data[a:seen].decode())
                            chars, seen, bis = von, a, von + len(part)
                        rows.append((nr, name, k, von, bis, n, part))
                        size += len(part)
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    return df.select(F.col(doc_id).cast("long"), text).mapInArrow(run, OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), OUT_ARROW)], schema=OUT_ARROW)
