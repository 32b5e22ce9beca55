"""Byte-level BPE by prefix dynamic programming.

An encoding is the encoding of its text exactly if each pair of neighbouring tokens is: the merges of
the two tokens' joined bytes end in those two tokens again. So each prefix of a piece has one valid
last token, which fits the last token of the prefix before it. ``Prefixes`` stores that token for
every prefix: appending computes the new prefixes only, and an edit keeps those before it.

Null texts count as empty and give no ids; any string round-trips through its UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.frames import sliced

#: Distinct pieces and token pairs that a task remembers; more are computed again.
PIECES, PAIRS = 300_000, 400_000
_SLICE = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Remembered(dict):
    """A dictionary that computes what it lacks and forgets everything when full."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Ranks, the pieces' pattern and what a task has learnt of them so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.pieces = regex.compile(pattern)
        self.halves = _Remembered(self._halves, len(ranks))
        self.fits = _Remembered(lambda pair: self._fits(*pair), PAIRS)
        self.packed = _Remembered(self._packed, PIECES)

    def merged(self, data: bytes, below: int | None = None) -> list[bytes]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none join (or none below a rank)."""
        none = len(self.tokens) if below is None else below
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank >= none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join gives this one; None for a single byte, or if no merges lead to it."""
        parts = self.merged(self.tokens[token], token)
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode as the token alone."""
        return len(self.tokens[token]) == 1 or self.halves[token] is not None

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' joined bytes end in these two.

        Undoes the merges from the last on; a join over the seam that ranks below all undone so far
        would have come first.
        """
        limit = len(self.tokens)
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            first, second = self.halves[left], self.halves[right]
            if first is not None and (second is None or left > right):
                limit, left = left, first[1]
            elif second is not None:
                limit, right = right + 1, second[0]
            else:
                return True

    def _packed(self, piece: str) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None and self.whole(rank) else Prefixes(self, data).ids()
        return np.array(ids, "<u4").tobytes()

    def encoded(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.pieces.findall(text)))

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.of, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        data, last, v = self.data, self.last, self.of
        rank, fits, longest = v.ranks.get, v.fits, v.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = rank(data[start:end])
                if token is not None and (fits[last[start - 1], token] if start else v.whole(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte of the text")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace ``data[start:end]``; prefixes up to ``start`` stay as they are."""
        rest = self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new + rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.of.tokens[out[-1]])
        return out[::-1]


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``ids``, little-endian unsigned 32-bit integers as one binary."""
    source = docs.select(doc_id, text)
    kind = source.schema[0].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in sliced(batches, text, _SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.encoded(t or "") for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return source.mapInArrow(encoded, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``decoded`` (binary) of what ``encode`` gave."""
    source = encoded.select("doc_id", "ids")
    kind = source.schema[0].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in sliced(batches, "ids", _SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decoded(i or b"") for i in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return source.mapInArrow(decoded, f"doc_id {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``doc_id``, ``n_tokens``, the digests of ids and decoded bytes, and the ``ids`` themselves if asked for."""
    source = docs.select(doc_id, text)
    kind = source.schema[0].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in sliced(batches, text, _SLICE):
            ids = [v.encoded(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(v.decoded(i)).hexdigest() for i in ids]),
                    *([pa.array(ids, pa.binary())] if with_ids else []),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])],
            )

    return source.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
