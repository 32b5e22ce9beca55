"""Shards of near equal bytes by histogram sort.

Rows are ordered by a 63-bit key, the text's crc32 and a hash of the id, then by a tie of 32 bits, drawn for each row and
kept. So equal texts lie together, a hot text splits between ids, and a hot row that repeats splits between its repeats, which
are the same whichever goes where. Rounds of exact counting (bytes and rows below candidate boundaries, summed over all
partitions) subdivide the intervals that hold a splitter or too many rows, until every splitter is within tolerance of its
share. Only then do rows move, once.

Law: ``bytes``. A splitter falls between two texts when such a boundary is within tolerance, and
inside a group of equal texts otherwise; shard sizes then differ from the mean by a row or by the
tolerance. Null texts have size 1. Null ids and repeated rows count as rows like any other. An empty
table gives an empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import exchange_partitions, written

#: Of a shard's fair share of bytes: how far a splitter may lie from its exact place.
TOLERANCE = 0.001
#: Parts that an interval is cut into each round.
FAN_OUT = 16
_ID_BITS, _TIE_BITS = 31, 32
_TOP = 1 << (63 + _TIE_BITS)


def _interval(key: Column, tie: Column, probes: list[int]) -> Column:
    """The number of probes at or below the key and tie."""
    keys = np.array([p >> _TIE_BITS for p in probes], np.int64)
    ties = np.array([p & ((1 << _TIE_BITS) - 1) for p in probes], np.int64)
    distinct = np.unique(keys)

    def joined(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Numbers in the order of keys and ties, as far as the probes tell them apart."""
        at = np.searchsorted(distinct, key)
        same = distinct[np.minimum(at, max(0, len(distinct) - 1))] == key if len(distinct) else np.zeros(len(key), bool)
        return ((2 * at + same) << _TIE_BITS) | np.where(same, tie, 0)

    bounds = joined(keys, ties)

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, joined(key.to_numpy(np.int64), tie.to_numpy(np.int64)), "right").astype(np.int32))

    return place(key, tie)


def _counted(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each of the ``len(probes) + 1`` intervals."""
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in keys.groupBy(_interval(F.col("key"), F.col("tie"), probes).alias("at")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return size, rows


def _cuts(low: int, high: int) -> list[int]:
    """New probes inside (low, high): between texts while the interval holds several, else between ids, else between ties."""
    step = next((1 << bits for bits in (_ID_BITS + _TIE_BITS, _TIE_BITS) if high - low > 1 << bits), 1)
    first, last = low // step + 1, (high - 1) // step
    if last < first:
        return []
    n = min(FAN_OUT - 1, last - first + 1)
    return sorted({(first + (last - first) * i // max(1, n - 1)) * step for i in range(n)})


def splitters(keys: DataFrame, shards: int, tolerance: float, rows_at_once: int) -> tuple[list[int], list[int], np.ndarray]:
    """Probes, the probe that ends each shard but the last, and the rows of each interval."""
    probes: list[int] = []
    while True:
        size, rows = _counted(keys, probes)
        edges = [0, *probes, _TOP]
        below = np.concatenate([[0], np.cumsum(size)])
        total = int(below[-1])
        near, new = total / shards * tolerance, set()
        ends = []
        for j in range(1, shards):
            want = total * j / shards
            i = int(np.argmin(np.abs(below - want)))
            ends.append(i)
            if abs(below[i] - want) > near:
                k = max(0, int(np.searchsorted(below, want, "right")) - 1)
                new.update(_cuts(edges[k], edges[k + 1]) if k < len(rows) and rows[k] > 1 else [])
        for k in np.flatnonzero(rows > rows_at_once):
            new.update(_cuts(edges[k], edges[k + 1]))
        if not new:
            return probes, ends, rows
        probes = sorted({*probes, *new})


def sharded(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null under this law)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    key = F.shiftleft(F.col("text_crc32"), _ID_BITS).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << _ID_BITS) - 1)))
    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    keys = written(rows.withColumn("key", key).withColumn("tie", tie), "shard-keys")
    at_once = max(100, -(-keys.count() // exchange_partitions(docs.sparkSession)))
    probes, ends, counts = splitters(keys, shards, tolerance, at_once)
    before = np.concatenate([[0], np.cumsum(counts)])
    shard_of = np.searchsorted(np.array(ends), np.arange(len(counts)), "right")
    first = np.array([0, *ends])
    places = docs.sparkSession.createDataFrame(
        [(i, int(shard_of[i]), int(before[i] - before[first[shard_of[i]]])) for i in range(len(counts))], "at int, shard int, base long"
    )
    order = Window.partitionBy("at").orderBy("key", "tie")
    placed = keys.withColumn("at", _interval(F.col("key"), F.col("tie"), probes)).withColumn("rank", F.row_number().over(order))
    return placed.join(F.broadcast(places), "at").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
