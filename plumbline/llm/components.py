"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.llm.frames import replaced, written

#: Edges that a task contracts at once.
_AT_ONCE = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node) that connect what these edges connect."""
    node, of = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = of[: len(u)], of[len(u) :]
    root = np.arange(len(node))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (a, b):
            np.minimum.at(root, root[end], least)
            np.minimum.at(root, end, least)
        root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero(root != np.arange(len(node)))
    return node[some], node[root[some]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges of 64-bit numbers that connect the same: each batch of a task as stars."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))

        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            size += batch.num_rows
            if size > _AT_ONCE:
                u, v = stars()
                if len(u) > _AT_ONCE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    held, size = [], 0
                else:
                    held, size = [(u, v)], len(u)
        if held:
            u, v = stars()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(contract, "u long, v long")


def _least(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` with ``m``, the least of ``u`` and all its ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return edges.join(least, "u")


def _written(edges: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, tuple]:
    """The edges, written in place of the old ones, with their number and sums of two hashes of them, whatever their order."""
    seen = Observation()
    a, b = (F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("u", "v"), ("v", "u")))
    observed = edges.observe(seen, F.count(F.lit(1)).alias("n"), a.alias("a"), b.alias("b"))
    edges = written(observed, "edges") if old is None else replaced(observed, "edges", old)
    found = seen.get
    return edges, (found["n"], found["a"], found["b"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is linked with) of every node that has an edge.

    ``edges`` has two columns of 64-bit numbers without nulls. Each task first contracts its edges to stars, so few are left to
    exchange. Each round is written to the shared folder; rounds end when both stars leave the edges as they are, by
    their number and two 64-bit hash sums. Self-loops and repeats are harmless; without edges nothing is returned.
    """
    edges, before = _written(_contracted(edges.toDF("u", "v").where(F.col("u") != F.col("v"))).distinct())
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        large = _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least(down)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        new, after = _written(new, edges)
        if after == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(new.select(F.col("v"), F.col("v"))).distinct()
        edges, before = new, after
