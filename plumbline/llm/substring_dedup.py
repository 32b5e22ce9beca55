"""Repeated passages by relative Lempel-Ziv factors.

Words are runs of bytes other than ASCII white space, unchanged. The reference is the whole corpus in
its order (smaller id first, then earlier start), indexed in blocks: a block holds every place whose
anchor hashes to it. An anchor is the least of the hashes of the ``GRAM``-word grams of a window of
``WINDOW`` words, so equal windows have equal anchors at equal offsets, and neighbouring windows
mostly share one and travel as one record. Each document meets every block that holds one of its
anchors; there, each of its windows is matched with the earliest equal one. Back at the
document, matches that go on at the next word of the same reference join greedily to factors. A
factor covers at least ``WINDOW`` words, and the windows across a factor boundary were matched on
their own, so the spans are exactly the words that a window with an earlier equal covers.

Within a task's slice of documents, records that equal an earlier one are matched on the spot and not
sent to a block: a passage of a third of all rows reaches its block once for each slice.

Windows count as equal if 64 bits of the anchor and 64 bits of the window agree.
Null texts have no words. Null ids come before all others, and so do ids that aren't numbers, which count as null. Rows of the same id are one document to the
order: at the same start neither is earlier, so repeated rows keep what a single one keeps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import exchange_partitions, sliced
from plumbline.llm.words import SPACE, Words, in_word, mixed, window_hashes

WINDOW = 20
GRAM = 6
_SPAN = WINDOW - GRAM + 1
_SLICE = 8 << 20
#: Records that a block compares at once.
_AT_ONCE = 1 << 21
_WORD_BYTE = in_word(SPACE)
_NO_ID = np.iinfo(np.int64).min
#: A match: first window, number of windows, and the id and start they repeat.
MATCH = np.dtype([("start", "<u4"), ("count", "<u4"), ("ref_id", "<i8"), ("ref_start", "<u4")])
_FOUND = np.dtype([("id", "<i8"), ("check", "<u4"), *((n, MATCH[n]) for n in MATCH.names)])


def _leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each place the index of the leftmost least value among it and the next ``span - 1``."""
    best, have = np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        other = best[np.minimum(np.arange(len(values)) + step, len(values) - 1)]
        best = np.where(values[other] < values[best], other, best)
        have += step
    return best


def _records(words: Words, ids: np.ndarray, checks: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: arrays for each run, and ``bits`` for each window."""
    hashes = words.hashes()
    at = words.windows(WINDOW)
    grams = window_hashes(hashes, np.arange(max(0, len(hashes) - GRAM + 1)), GRAM)
    anchor = _leftmost_least(grams, _SPAN)[at] if len(at) else at
    row = words.row()[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    own = window_hashes(hashes, at, WINDOW)
    offset = (anchor - at).astype(np.uint64)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(mixed(own + offset), first) if len(first) else np.zeros(0, np.uint64)
    row = row[first]
    return {
        "anchor": grams[anchor[first]],
        "id": ids[row],
        "check": checks[row],
        "start": (at[first] - words.first[row]).astype(np.uint32),
        "count": np.diff(np.append(first, len(at))).astype(np.uint8),
        "whole": whole,
        "bits": own,
    }


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the members of runs, and which run each is of."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of], of


# What a record is on the way: fields of one run, then 64 bits of each of its windows. Planes of equal
# bytes compress where whole integers don't.
_FIELDS = (("anchor", "<u8"), ("id", "<i8"), ("check", "<u4"), ("start", "<u4"), ("count", "u1"))


def _planes(values: np.ndarray) -> bytes:
    raw = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return np.ascontiguousarray(raw.T).tobytes()


def _unplaned(data: np.ndarray, n: int, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(np.dtype(dtype).itemsize, n).T).view(dtype).reshape(n)


def _pack(records: dict[str, np.ndarray], which: np.ndarray, first: np.ndarray) -> bytes:
    """Records ``which``, given where the windows of each begin."""
    members, _ = _expand(first[which], records["count"][which].astype(np.int64))
    head = np.array([len(which), len(members)], "<i8").tobytes()
    return head + b"".join(_planes(records[n][which].astype(t)) for n, t in _FIELDS) + records["bits"][members].astype("<u8").tobytes()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    raw, at, out = np.frombuffer(data, np.uint8), 16, {}
    for name, dtype in _FIELDS:
        size = n * np.dtype(dtype).itemsize
        out[name] = _unplaned(raw[at : at + size], n, dtype)
        at += size
    out["bits"] = np.frombuffer(data, "<u8", m, at)
    return out


def _slice_rows(batch: pa.RecordBatch, blocks: int) -> pa.RecordBatch:
    """Rows of ``block``, packed ``records`` for it and ``matches`` already found."""
    words = Words(batch.column("text"), _WORD_BYTE)
    ids = np.array(batch.column("id").fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False), np.int64)
    r = _records(words, ids, batch.column("check").to_numpy(zero_copy_only=False).astype(np.uint32))
    first = np.cumsum(r["count"], dtype=np.int64) - r["count"]
    order = np.lexsort((r["start"], r["id"], r["whole"]))
    same = np.zeros(len(order), bool)
    same[1:] = r["whole"][order][1:] == r["whole"][order][:-1]
    leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
    known = same & ((r["id"][order] != r["id"][leader]) | (r["start"][order] != r["start"][leader]))
    later, earlier = order[known], leader[known]
    found = np.zeros(len(later), _FOUND)
    for name in ("id", "check", "start", "count"):
        found[name] = r[name][later]
    found["ref_id"], found["ref_start"] = r["id"][earlier], r["start"][earlier]
    sent = np.sort(order[~known])
    block = (mixed(r["anchor"][sent]) % np.uint64(blocks)).astype(np.int64)
    by = np.argsort(block, kind="stable")
    bounds = np.searchsorted(block[by], np.arange(blocks + 1))
    use = np.flatnonzero(np.diff(bounds))
    packed = [_pack(r, sent[by[bounds[b] : bounds[b + 1]]], first) for b in use]
    matches = [b""] * len(use)
    if len(found):
        use, packed, matches = np.append(use, int(mixed(found["id"][:1].view(np.uint64))[0] % np.uint64(blocks))), [*packed, b""], [*matches, found.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array(packed, pa.binary()), pa.array(matches, pa.binary())], ["block", "records", "matches"])


def _matched(parts: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Matches of all windows that equal an earlier one."""
    r = {n: np.concatenate([p[n] for p in parts]) for n, _ in (*_FIELDS, ("bits", ""))}
    first = np.cumsum(r["count"], dtype=np.int64) - r["count"]
    out = []
    order = np.argsort(r["anchor"], kind="stable")
    anchors = r["anchor"][order]
    again = np.zeros(len(order) + 1, bool)
    again[1:-1] = anchors[1:] == anchors[:-1]
    shared = order[again[1:] | again[:-1]]
    anchors = r["anchor"][shared]
    at = 0
    while at < len(shared):
        end = min(len(shared), at + _AT_ONCE)
        while end < len(shared) and anchors[end] == anchors[end - 1]:
            end += 1
        out.append(_equal_windows(r, shared[at:end], first))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _FOUND)


def _equal_windows(r: dict[str, np.ndarray], which: np.ndarray, first: np.ndarray) -> np.ndarray:
    counts = r["count"][which].astype(np.int64)
    member, of = _expand(first[which], counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    run = which[of]
    ids, start = r["id"][run], r["start"][run].astype(np.int64) + nth
    bits = r["bits"][member]
    order = np.lexsort((start, ids, bits, r["anchor"][run]))
    anchor, bits = r["anchor"][run][order], bits[order]
    lead = np.ones(len(order), bool)
    lead[1:] = (anchor[1:] != anchor[:-1]) | (bits[1:] != bits[:-1])
    leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    dup = (ids[order] != ids[leader]) | (start[order] != start[leader])
    later, earlier = order[dup], leader[dup]
    back = np.argsort(later)
    later, earlier = later[back], earlier[back]
    go_on = np.zeros(len(later), bool)
    go_on[1:] = (later[1:] == later[:-1] + 1) & (of[later[1:]] == of[later[:-1]]) & (ids[earlier[1:]] == ids[earlier[:-1]]) & (start[earlier[1:]] == start[earlier[:-1]] + 1)
    heads = np.flatnonzero(~go_on)
    found = np.zeros(len(heads), _FOUND)
    found["id"], found["check"], found["start"] = ids[later[heads]], r["check"][run[later[heads]]], start[later[heads]]
    found["count"] = np.diff(np.append(heads, len(later)))
    found["ref_id"], found["ref_start"] = ids[earlier[heads]], start[earlier[heads]]
    return found


def _by_document(found: np.ndarray) -> pa.RecordBatch:
    """One row for each document: ``of_id``, ``of_check`` and its ``matches`` as one binary."""
    found = found[np.lexsort((found["check"], found["id"]))]
    edge = np.ones(len(found) + 1, bool)
    edge[1:-1] = (found["id"][1:] != found["id"][:-1]) | (found["check"][1:] != found["check"][:-1])
    bounds = np.flatnonzero(edge) if len(found) else np.zeros(1, np.int64)
    body = np.zeros(len(found), MATCH)
    for name in MATCH.names:
        body[name] = found[name]
    head = found[bounds[:-1]]
    binary = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((bounds * MATCH.itemsize).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(head["id"], pa.int64()), pa.array(head["check"].astype(np.int64)), binary], ["of_id", "of_check", "matches"])


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document (``of_id``, and ``of_check``, the text's crc32) its ``matches``: arrays of ``MATCH`` in binaries."""
    blocks = exchange_partitions(docs.sparkSession)
    source = docs.select(F.col(doc_id).try_cast("long").alias("id"), F.crc32(F.col(text).cast("binary")).alias("check"), F.col(text).alias("text"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            yield _slice_rows(batch, blocks)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for records, known in zip(batch.column("records").to_pylist(), batch.column("matches").to_pylist(), strict=True):
                if records:
                    parts.append(_unpack(records))
                if known:
                    yield _by_document(np.frombuffer(known, _FOUND))
        if parts:
            yield _by_document(_matched(parts))

    sent = source.where(F.col("check").isNotNull()).mapInArrow(anchored, "block int, records binary, matches binary")
    found = sent.repartitionById(blocks, "block").mapInArrow(compared, "of_id long, of_check long, matches binary")
    return found.groupBy("of_id", "of_check").agg(F.collect_list("matches").alias("matches"))


def factors(matches: list[bytes]) -> np.ndarray:
    """The document's factors: matches in order, joined where the next goes on in the same reference."""
    m = np.frombuffer(b"".join(matches), MATCH)
    m = m[np.argsort(m["start"], kind="stable")]
    if not len(m):
        return m
    end, ref_end = m["start"] + m["count"], m["ref_start"] + m["count"]
    go_on = np.zeros(len(m), bool)
    go_on[1:] = (m["start"][1:] == end[:-1]) & (m["ref_id"][1:] == m["ref_id"][:-1]) & (m["ref_start"][1:] == ref_end[:-1])
    heads = np.flatnonzero(~go_on)
    out = m[heads].copy()
    out["count"] = np.add.reduceat(m["count"], heads)
    return out


def spans(found: np.ndarray) -> list[tuple[int, int]]:
    """Words that the factors cover, as half-open spans."""
    out: list[list[int]] = []
    for start, count in zip(found["start"].tolist(), found["count"].tolist(), strict=True):
        end = start + count + WINDOW - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _with_matches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).try_cast("long"), F.lit(int(_NO_ID))).alias("id"), F.crc32(F.col(text).cast("binary")).alias("check"))
    found = matches(docs, doc_id, text)
    return rows.join(found, (rows["id"] == found["of_id"]) & (rows["check"] == found["of_check"]), "left").select("row", "matches")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, removed ``spans`` of words with their references as ``factors``, and the ``kept`` words joined by one space."""
    rows = _with_matches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").select("row.doc_id", "row.text", "matches")
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            out = {"n_words": [], "spans": [], "factors": [], "kept": []}
            for text, found in zip(batch.column("text").to_pylist(), batch.column("matches").to_pylist(), strict=True):
                words = (text or "").encode().split()
                parsed = factors(found or [])
                gone = spans(parsed)
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                out["n_words"].append(len(words))
                out["spans"].append([{"start": a, "end": b} for a, b in gone])
                out["factors"].append([{"start": s, "words": n + WINDOW - 1, "ref_id": i, "ref_start": r} for s, n, i, r in parsed.tolist()])
                out["kept"].append(b" ".join(kept + words[at:]).decode())
            span, factor = pa.struct([("start", pa.int64()), ("end", pa.int64())]), pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_id", pa.int64()), ("ref_start", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["spans"], pa.list_(span)), pa.array(out["factors"], pa.list_(factor)), pa.array(out["kept"])],
                ["doc_id", "n_words", "spans", "factors", "kept"],
            )

    schema = f"doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, factors array<struct<start:long,words:long,ref_id:long,ref_start:long>>, kept string"
    return rows.mapInArrow(cut, schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduplicated(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
