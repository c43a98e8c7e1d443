"""Encoding whole texts with a public byte-level vocabulary, loaded by tiktoken from a local rank file."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folder of the vocabularies; a parameter of every operator.
TOKENIZERS = os.environ.get("BEFUNDWERK_TOKENIZERS", "/opt/tokenizers")
# The pattern that splits text before the merges, and the white space it knows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c))
#: A text falls apart before white space that follows something else: no piece of PATTERN spans that
#: place, nothing left of it looks beyond it, nothing right of it looks back.
WORDS = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Most words that a worker keeps, and the longest that it keeps; memory only, results don't depend on it.
KEPT, KEPT_CHARS = 300_000, 64


def rank_file(name: str, folder: str = TOKENIZERS) -> bytes:
    """The bytes of a vocabulary; some 0.8 MB whatever the corpus, so they travel with the task."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one vocabulary. Strings of special tokens are ordinary text."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        by_bytes = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self.lengths = np.zeros(max(by_bytes.values()) + 1, np.int64)
        for token, rank in by_bytes.items():
            self.lengths[rank] = len(token)
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<i4").tobytes()

    def raw_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian int32 bytes; none for null and empty texts.

        The texts are split at safe places into words; those not met before are encoded together in
        one run and told apart by the tokens' byte lengths.
        """
        split = [WORDS.findall(t) if t else [] for t in texts]
        words = self.words
        new = {w for w in set().union(*split) if w not in words}
        if len(words) + len(new) > KEPT:
            words.clear()
            new = set().union(*split)
        edge = [w for w in new if w[0] not in _SPACES or w[-1] in _SPACES]  # a text's first word and white space at its end
        got = {w: self._encode(w) for w in edge}
        inner = list(new.difference(edge))
        if inner:
            raw = self._encode("".join(inner))
            ends = np.cumsum(self.lengths[np.frombuffer(raw, "<i4")])
            sizes = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in inner])
            at = ((np.searchsorted(ends, sizes) + 1) * 4).tolist()
            a = 0
            for w, z in zip(inner, at):
                got[w] = raw[a:z]
                a = z
        words.update(got)
        out = [b"".join(map(words.__getitem__, ws)) for ws in split]
        for w in got:
            if len(w) > KEPT_CHARS:
                del words[w]
        return out

    def raw(self, text: str | None) -> bytes:
        return self.raw_batch([text])[0]

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<i4")

    def count(self, text: str) -> int:
        """Tokens of a short text; of a long one, over its words."""
        return len(self.encoding.encode_ordinary(text)) if len(text) < 200 else len(self.raw(text)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text again: the tokens' raw bytes are joined before they are read as UTF-8."""
        return self.encoding.decode_bytes(list(ids)).decode()


def blocks(texts: list, most: int = 4_000_000) -> Iterator[slice]:
    """Slices of ``texts`` with about ``most`` characters each, so that memory follows that and the longest text."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield slice(a, i + 1)
            a, size = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


_CODECS: dict[str, Codec] = {}


def codec(ranks: bytes) -> Codec:
    """This process's codec for a rank file."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks)
    return _CODECS[key]


def encode_texts(df: DataFrame, doc_id: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every row, whole texts, no special tokens.

    Null and empty texts get an empty list. Repeated rows and ids come out as often as they went in,
    further columns are ignored, an empty table gives no rows. Nothing is shuffled.
    """
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(tokenizer, folder))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in blocks(texts):
                raw = c.raw_batch(texts[part])
                offsets = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.ListArray.from_arrays(pa.array(offsets), values)], names=[doc_id, "ids"])

    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, name: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the token count of ``text`` in place of the text; 0 for null and empty texts."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(tokenizer, folder))
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for b in batches:
            texts = b.column(len(rest)).to_pylist()
            n = [len(r) // 4 for part in blocks(texts) for r in c.raw_batch(texts[part])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n, pa.int64())], names=[*rest, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    return df.select(*rest, text).mapInArrow(run, f"{fields}, `{name}` long")


def read_limits(spark: SparkSession, df: DataFrame, most: int = 100) -> list:
    """The rows of a small parameter table; refused beyond ``most`` of them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a parameter table has more than {most} rows")
    return rows
