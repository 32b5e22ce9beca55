"""Small helpers that the operators share: Arrow batches in slices, fits on bounded samples, and those of ``tables``."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator
from functools import cache, reduce
from operator import and_
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import replaced, shared_dir, written

__all__ = ["BATCH_ROWS", "PLACES", "SLICE_ROWS", "bounded_batches", "exchange_partitions", "fitted", "fold", "joined", "lean", "one_blas_thread", "place", "replaced", "shared_dir", "sliced", "written"]

#: Rows of an Arrow batch at most, where documents may be long.
BATCH_ROWS = 1000
#: Rows of a slice at most, whatever the session's size of Arrow batches.
SLICE_ROWS = 1 << 15
#: Places that a sample's hash has; a share of them bounds what is sent on.
PLACES = 1 << 40


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` where nulls equal each other; the left side's keys stay."""
    right = right.withColumnsRenamed({k: f"{k} right" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k} right")) for k in keys]
    return left.join(right, reduce(and_, same), how).drop(*[f"{k} right" for k in keys])


def exchange_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column`` (one row at least) and ``SLICE_ROWS`` rows."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(size):
            if (total and total + n > limit) or i - start == SLICE_ROWS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def place(*key: str | Column) -> Column:
    """A hash of the key from 0 to ``PLACES``, by which samples are chosen."""
    return F.pmod(F.xxhash64(*key), F.lit(PLACES))


def fitted(rows: DataFrame, kind: str, most: dict[Any, int], fit: Callable[[pa.Table], Any]) -> Any:
    """What ``fit`` makes, in one task, of a table of the ``most[kind]`` first distinct rows of each kind, by ``place`` and then by text.

    ``rows`` have the columns ``place``, ``text`` and ``kind``. No task holds or sends on more rows than those, however many have one key;
    the driver sees nothing but the pickled result.
    """

    def first(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables)
        order = ["place", "text", kind]
        table = table.group_by(order).aggregate([]).select(order).sort_by([(c, "ascending") for c in order])
        return pa.concat_tables([table.filter(pc.equal(table[kind], pa.scalar(k, table[kind].type))).slice(0, n) for k, n in most.items()])

    def kept(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = first([pa.Table.from_batches([batch.select(["place", "text", kind])]), *([] if held is None else [held])])
        return held

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept(batches)
        if held is not None:
            yield from held.to_batches(max_chunksize=256)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        held = kept(batches)
        if held is not None:
            model = pickle.dumps(fit(held))
            del held
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = rows.select("place", "text", kind)
    found = rows.mapInArrow(local, rows.schema).repartition(1).mapInArrow(last, "model binary").collect() if most else []
    types = {"place": pa.int64(), "text": pa.string(), kind: pa.bool_() if rows.schema[kind].dataType.typeName() == "boolean" else pa.string()}
    return pickle.loads(found[0]["model"]) if found else fit(pa.table({k: pa.array([], t) for k, t in types.items()}))


@cache
def _own_pages() -> ctypes.CDLL | None:
    """This worker's C library, told to give arrays of 1 MB and more pages of their own, which go back as soon as they are freed; None where it isn't glibc's."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        return libc
    except (OSError, AttributeError):
        return None


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches from a worker that keeps no freed memory: not while it runs, nor when it waits for its next task beside others."""
    libc = _own_pages()
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)


@cache
def one_blas_thread() -> None:
    """Keep this worker's matrix products on its own core: Spark runs a task on each, and more threads would only wait for one another."""
    for library in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        setter = getattr(ctypes.CDLL(str(library)), "scipy_openblas_set_num_threads64_", None)
        if setter is not None:
            setter(1)
