"""Benchmark passages in training documents, found by an FM-index of each shard of documents.

A-Z are lower-cased; words are runs of digits, a-z and non-ASCII characters. Every 13 consecutive
words of a benchmark item are a window, and so is a whole item of fewer words, but not none. A shard
(rows of one Arrow batch, up to ``SHARD_BYTES`` of text) numbers the words that any window uses.
Only runs of such words, at least as long as the shortest window, can hold an occurrence: those
runs, each ended by a symbol that no window has, are what is indexed. Each window is searched backwards
by wavelet-tree ranks, its occurrences are located by sampled suffix positions, and the words they
cover merge into spans.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text; with several blocks, each
is one more pass over the documents that adds to the spans so far.

Null or wordless texts have no words, no spans and aren't contaminated; null item ids count as the
item named by the empty string, repeated items as one. Empty tables on either side give no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.fm_index import FMIndex
from plumbline.llm.frames import replaced, sliced, written
from plumbline.llm.words import LOWER, NOT_WORD, Words, in_word

WINDOW = 13
SHARD_BYTES = 8 << 20
#: Of benchmark text that the tasks hold at once.
BLOCK_BYTES = 16 << 20
_WORD_BYTE = in_word(NOT_WORD)


class Windows:
    """The distinct windows of some benchmark items, as rows of word numbers (1 and up)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        words = Words(pa.array([t for _, t in items], pa.string()), _WORD_BYTE, LOWER)
        data = words.data.tobytes()
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for i, (item, _) in enumerate(items):
            span = range(words.first[i], words.first[i + 1])
            ids = tuple(self.numbers.setdefault(data[words.start[j] : words.end[j]], len(self.numbers) + 1) for j in span)
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[at : at + window], set()).add(item)
        self.length = np.array([len(w) for w in found], np.int64)
        self.items = [sorted(x) for x in found.values()]
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, ids in zip(self.patterns, found, strict=True):
            row[window - len(ids) :] = ids
        self.shortest = int(self.length.min()) if len(found) else 0


def _runs(number: np.ndarray, row: np.ndarray, shortest: int) -> np.ndarray:
    """Words in runs of at least ``shortest`` known words of one row, as a mask."""
    edge = np.ones(len(number) + 1, bool)
    edge[1:-1] = (row[1:] != row[:-1]) | ((number[1:] == 0) != (number[:-1] == 0))
    bounds = np.flatnonzero(edge)
    size = np.diff(bounds)
    return np.repeat((size >= shortest) & (number[bounds[:-1]] > 0), size)


def occurrences(words: Words, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence among the shard's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not windows.shortest:
        return none
    data, get = words.data.tobytes(), windows.numbers.get
    number = np.fromiter((get(data[a:b], 0) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)), np.int64, len(words))
    row = words.row()
    keep = np.flatnonzero(_runs(number, row, windows.shortest))
    if not len(keep):
        return none
    gap = np.flatnonzero((np.diff(keep) > 1) | (np.diff(row[keep]) > 0)) + 1
    index = FMIndex(np.insert(number[keep], gap, 0), len(windows.numbers) + 1)
    origin = np.insert(keep, gap, -1)
    low, high = index.search(windows.patterns, windows.length)
    times = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(times)), times)
    places = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
    return origin[index.locate(places)], which


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open spans, joined where they touch."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    for k in range(n):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: tuple[str, ...] = ("*",), item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: ``row`` (the columns to ``carry``), ``n_words``, ``spans`` of words (end exclusive) and ``items`` that occur."""
    found = docs.select(
        F.struct(*carry).alias("row"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    windows = table = None
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        if windows is not None:
            # No task holds two blocks of the benchmark, and a block that is done is given back.
            found = written(found, "spans") if table is None else replaced(found, "spans", table)
            table = found
            windows.destroy()
        windows = docs.sparkSession.sparkContext.broadcast(Windows(items, window))

        def search(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text", SHARD_BYTES):
                yield _searched(batch, windows.value)

        found = found.mapInArrow(search, found.schema)
    return found.drop("text")


def _searched(batch: pa.RecordBatch, windows: Windows) -> pa.RecordBatch:
    words = Words(batch.column("text"), _WORD_BYTE, LOWER)
    at, which = occurrences(words, windows)
    rows = np.searchsorted(words.first, at, "right") - 1
    old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
    order = np.argsort(rows, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(rows[order])) + 1) if len(order) else []:
        i = int(rows[mine[0]])
        start = at[mine] - words.first[i]
        end = start + windows.length[which[mine]]
        was = old_spans[i]
        merged = _merge(np.append(start, [s["start"] for s in was]).astype(np.int64), np.append(end, [s["end"] for s in was]).astype(np.int64))
        old_spans[i] = [{"start": a, "end": b} for a, b in merged]
        old_items[i] = sorted({*old_items[i], *(x for w in np.unique(which[mine]).tolist() for x in windows.items[w])})
    schema = batch.schema
    columns = {"n_words": pa.array(words.count, pa.int64()), "spans": pa.array(old_spans, schema.field("spans").type), "items": pa.array(old_items, schema.field("items").type)}
    return pa.RecordBatch.from_arrays([columns.get(f.name, batch.column(i)) for i, f in enumerate(schema)], schema=schema)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    """Whether hits make up a twentieth of the words at least."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns for each document."""
    found = spans(docs, benchmark, text, (doc_id,))
    return found.select(
        F.col(f"row.{doc_id}").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns whatever those are called."""
    return spans(docs, benchmark).where(~contaminated()).select("row.*")
