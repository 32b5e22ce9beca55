"""Packing of tokenised documents into windows by minimum bin slack.

A document is its token ids and one closing id. What a document has beyond whole windows is a remainder, and remainders are packed by length
alone: of the multiset of lengths left, the longest opens a window and a subset-sum over bitsets (bit s of an integer: some choice of the lengths
seen so far adds up to s) finds the choice that fills the window closest to its capacity; backtracking through the bitsets gives the counts. A
choice is used as often as the counts allow, so the work follows the number of distinct lengths, less than a window's, and never the number of
documents. Where no choice fills a window, the longest length left is cut to fill it and its rest goes back into the multiset. What the very last
window lacks can't be filled by anything: it is cut into sequences whose sizes are powers of two, which need no padding either.

The plan is a few thousand rows; documents find their windows in it by the rank among documents of their length. Ranks come from counts: each task
numbers its own documents by length while it tokenises, and what earlier tasks counted is added by a join that hashes the counts and sorts no ids.

A null text is empty and has the closing id only. Rows with equal ids or equal texts, and rows with a null id, are documents of their own. An
empty table gives no pieces. Other columns are left aside, whatever their names. A text of any length is cut like all others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import bounded_batches, lean, sliced, written
from plumbline.llm.words import LOWER, SPACE, Words, in_word

#: Ids of a window.
WINDOW = 4096
#: The id that closes each document.
CLOSE = 2
#: Bytes of text that are tokenised at once, and bytes of ids that are dealt out at once.
_SLICE, _DEALT = 1 << 20, 1 << 21
#: Words that a worker remembers the ids of.
_KNOWN = 1 << 21

_BLANK, _LETTERS, _OTHER, _WHOLE = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(SPACE)] = _BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTERS


class Encoder:
    """Ids of whole texts as a ``tokenizers`` file gives them, with each distinct part of a text encoded once.

    White space always parts a text for vocabularies of this kind. Between blanks, a run of letters stands for itself where everything is plain:
    Latin letters, no apostrophe (which may take letters with it) and no ``<`` (a special token may begin there). Other runs between blanks are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # Each byte as the character that stands for it in byte-level vocabularies: itself if it prints, or else the next one from 256 on.
        prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(256, 512))
        self.letters = {b: b if b in prints else next(rest) for b in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bound = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encoded(self, part: bytes, plain: bool) -> list[int]:
        if plain:
            word = part.decode() if part.isascii() else part.decode().lower().encode().decode("latin-1").translate(self.letters)
            return [t.id for t in self.model.tokenize(word)]
        return self.whole.encode(part.decode(), add_special_tokens=False).ids

    def _learn(self, words: Words, kind: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> None:
        found = [self._encoded(words.data[a:b].tobytes(), k == _LETTERS) for a, b, k in zip(words.start[at].tolist(), words.end[at].tolist(), kind[at].tolist(), strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32, int(size.sum()))])
        new = np.arange(len(found)) + len(self.bound) - 1
        self.bound = np.concatenate([self.bound, self.bound[-1] + np.cumsum(size)])
        order = np.argsort(hashes)
        into = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.place = np.insert(self.hashes, into, hashes[order]), np.insert(self.place, into, new[order])

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        unknown = at == len(self.hashes)
        unknown[~unknown] = self.hashes[at[~unknown]] != hashes[~unknown]
        return unknown

    def _places(self, words: Words, kind: np.ndarray) -> np.ndarray:
        """Where the ids of each part lie in ``ids``, by ``bound``."""
        coded = pa.array(words.hashes()).dictionary_encode()
        code, seen = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.empty(len(seen), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        unknown = self._unknown(seen)
        if unknown.any():
            if len(self.hashes) + unknown.sum() > _KNOWN:
                self._forget()
                unknown[:] = True
            self._learn(words, kind, seen[unknown], first[unknown])
        return self.place[np.searchsorted(self.hashes, seen)][code]

    def encode(self, texts: pa.Array, close: int = CLOSE) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each row's begin and end; a row ends with the closing id."""
        words, kind = _parts(texts)
        place = self._places(words, kind) if len(words) else np.zeros(0, np.int64)
        size = self.bound[place + 1] - self.bound[place] if len(words) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        bound = total[words.first] + np.arange(words.rows + 1)
        out = np.full(int(bound[-1]), close, np.uint32)
        inside = np.ones(len(out), bool)
        inside[bound[1:] - 1] = False
        source = np.repeat(self.bound[place] - total[:-1], size) + np.arange(total[-1]) if len(words) else np.zeros(0, np.int64)
        out[inside] = self.ids[source]
        return out, bound


def _parts(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The parts of each text that are encoded apart, and the kind of each."""
    words = Words(texts, in_word(SPACE))
    raw = words.data
    kinds = _CLASS[raw]
    after = np.append(raw[1:], 0)
    # Letters of two bytes from U+00C0 to U+027F are Latin, but for the signs of times and division; a capital I with a dot has two letters in lower case.
    odd = (raw == 0x27) | (raw == 0x3C) | ((raw >= 0xC0) & ((raw < 0xC3) | (raw > 0xC9))) | ((raw == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((raw == 0xC4) & (after == 0xB0))
    if odd.any():
        chunk = np.unique(np.searchsorted(words.start, np.flatnonzero(odd), "right") - 1)
        span = words.end[chunk] - words.start[chunk]
        kinds[np.repeat(words.start[chunk] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())] = _WHOLE
    words.data = np.where(kinds == _WHOLE, raw, LOWER[raw])
    edge = np.zeros(len(raw) + 1, bool)
    edge[words.bound] = True
    edge[1:-1] |= kinds[1:] != kinds[:-1]
    edges = np.flatnonzero(edge) if len(raw) else np.zeros(0, np.int64)
    start, end = edges[:-1], edges[1:]
    kept = kinds[start] != _BLANK if len(start) else np.zeros(0, bool)
    words.start, words.end = start[kept], end[kept]
    words.first = np.searchsorted(words.start, words.bound)
    words.count = np.diff(words.first)
    return words, kinds[words.start] if len(words.start) else np.zeros(0, np.uint8)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that they add up to as near ``room`` as any choice, never beyond."""
    reach, layers, within = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << take * length) & within
            left, step = left - take, step * 2
        if reach >> room:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> best & 1:
            best -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


@dataclass
class Plan:
    """Which ranks of each length go where: ``runs`` has, by length, (first rank, ranks, first sequence, offset, ids taken, rank of the first rest)."""

    window: int = WINDOW
    sequences: int = 0
    runs: dict[int, list[tuple[int, int, int, int, int, int]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._used: dict[int, int] = {}
        self._ranks: dict[int, int] = {}

    def _give(self, counts: dict[int, int], length: int, times: int, offset: int, take: int) -> None:
        first = self._used.get(length, 0)
        self._used[length] = first + times
        counts[length] -= times
        rest, at = length - take, -1
        if rest:
            at = self._ranks.get(rest, 0)
            self._ranks[rest] = at + times
            counts[rest] = counts.get(rest, 0) + times
        self.runs.setdefault(length, []).append((first, times, self.sequences, offset, take, at))

    @classmethod
    def of(cls, counts: dict[int, int], window: int = WINDOW) -> Plan:
        plan = cls(window)
        plan._ranks = dict(counts)
        counts = dict(counts)
        while any(counts.values()):
            longest = max(n for n, c in counts.items() if c)
            counts[longest] -= 1
            taken = fill(counts, window - longest)
            counts[longest] += 1
            taken[longest] = taken.get(longest, 0) + 1
            total = sum(n * c for n, c in taken.items())
            left = {n: c - taken.get(n, 0) for n, c in counts.items() if c > taken.get(n, 0)}
            if total < window and not left:
                plan._last(counts, taken, total)
                break
            cut = max(left) if total < window else 0  # every length left is longer than what is lacking
            need = taken | ({cut: taken.get(cut, 0) + 1} if cut else {})
            times = min(counts[n] // c for n, c in need.items())
            at = 0
            for n in sorted(taken, reverse=True):
                for _ in range(taken[n]):
                    plan._give(counts, n, times, at, n)
                    at += n
            if cut:
                plan._give(counts, cut, times, at, window - total)
            plan.sequences += times
        return plan

    def _last(self, counts: dict[int, int], taken: dict[int, int], total: int) -> None:
        sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        offset = 0
        for n in sorted(taken, reverse=True):
            for _ in range(taken[n]):
                left = n
                while left:
                    take = min(left, sizes[0] - offset)
                    self._give(counts, left, 1, offset, take)
                    left, offset = left - take, offset + take
                    if offset == sizes[0]:
                        sizes.pop(0)
                        self.sequences, offset = self.sequences + 1, 0

    def pieces(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(ids taken, sequence, offset) of the remainder's pieces, in order."""
        while length:
            runs = self.runs[length]
            first, _, sequence, offset, take, rest = runs[bisect_right(runs, rank, key=lambda r: r[0]) - 1]
            yield take, sequence + rank - first, offset
            length, rank = length - take, rest + rank - first


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _stored(path: str, close: int) -> str:
    """Two bytes an id where they hold the whole vocabulary, else four."""
    return "<u2" if max(_encoder(path).whole.get_vocab_size(), close + 1) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, close: int = CLOSE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (in the bytes of ``_stored``), their number, the ``task``, and in it the rank among documents of one ``remainder`` and the whole windows before."""
    kind, store = docs.schema[doc_id].dataType, _stored(path, close)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        seen, whole = np.zeros(window, np.int64), 0
        for batch in sliced(lean(batches), "text", _SLICE):
            ids, bound = encoder.encode(batch.column("text"), close)
            n = np.diff(bound)
            rest, windows = n % window, n // window
            order = np.argsort(rest, kind="stable")
            each, first = np.unique(rest[order], return_index=True)
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n)))) + seen[rest[order]]
            np.add.at(seen, rest, 1)
            before = whole + np.cumsum(windows) - windows
            whole += int(windows.sum())
            stored = ids.astype(store)
            data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bound * stored.itemsize), pa.py_buffer(stored)]).cast(pa.binary())
            columns = [batch.column("doc_id"), data, n, np.full(len(n), task, np.int32), rest.astype(np.int32), rank, before]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["doc_id", "ids", "n", "task", "remainder", "rank", "whole"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary, n long, task int, remainder int, rank long, whole long")


def packed(docs: DataFrame, path: str, window: int = WINDOW, close: int = CLOSE, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``; with ``with_ids`` also the ``ids`` as an array."""
    rows = written(tokenised(docs, path, window, close, doc_id, text), "tokenised")
    counted = rows.where("remainder > 0").groupBy("task", "remainder").agg(F.count(F.lit(1)).alias("n"))
    # One number for each possible length: less than a window's.
    plan = Plan.of({r["remainder"]: r["n"] for r in counted.groupBy("remainder").agg(F.sum("n").alias("n")).collect()}, window)
    runs, sequences, store = plan.runs, plan.sequences, _stored(path, close)
    earlier = Window.partitionBy("remainder").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("task", "remainder", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = rows.join(base.hint("shuffle_hash"), ["task", "remainder"], "left")
    ranked = ranked.select("doc_id", "ids", "n", "task", "remainder", (F.coalesce("base", F.lit(0)) + F.col("rank")).alias("rank"), "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = Plan(window, sequences, runs)
        _encoder.cache_clear()  # what this worker tokenised with isn't needed beside the ids
        for batch in sliced(lean(batches), "ids", _DEALT):
            at, out, taken = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("ids", "n", "task", "remainder", "rank", "whole"))
            for i, (ids, n, task, rest, rank, whole) in enumerate(zip(*columns, strict=True)):
                # Whole windows of a task are numbered in the upper half, behind the plan's.
                found = [(window, sequences + (task << 32) + whole + k, 0) for k in range(n // window)]
                start, all_ids = 0, np.frombuffer(ids, store).astype("<u4")
                for take, sequence, offset in [*found, *dealt.pieces(rest, rank)]:
                    piece = all_ids[start : start + take]
                    at.append(i)
                    out.append((start, take, zlib.crc32(piece), n, sequence, offset))
                    if with_ids:
                        taken.append(piece.astype(np.int32))
                    start += take
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            table = np.array(out, np.int64).reshape(-1, len(names))
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c) for c in table.T.copy())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(taken, pa.list_(pa.int32()))] if with_ids else []), ["doc_id", *names] + (["ids"] if with_ids else []))

    kind = docs.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else ""))
