"""Records of JSON arrays that a broken transfer has cut off, down to the last whole field.

A text is read from its first bracket on, value by value. The first value that can't be decoded ends the whole ones; if it is an object, its fields are read one by one,
and those that a comma follows are whole: the comma shows that the value before it wasn't cut. Each character is looked at once or twice, whatever the cut.

A large file is read by many tasks (``large_arrays``). A range of a file begins anywhere, so a first pass tells of each range what it does to the two things that matter, whether
a string is open and how many brackets are, for either state of the string at its begin. Composed in order, these give the state at every range's begin, and a second
pass finds the records. A record that goes over ranges is put together from its pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLANK = " \t\r\n"
_DECODER = json.JSONDecoder()


def _skipped(text: str, at: int, over: str = _BLANK) -> int:
    while at < len(text) and text[at] in over:
        at += 1
    return at


def whole_fields(text: str, at: int) -> int | None:
    """Where the comma stands that ends the last whole field of the object at ``at``; none if it isn't an object or no field is whole."""
    if text[at : at + 1] != "{":
        return None
    at, last = at + 1, None
    while True:
        try:
            name, at = _DECODER.raw_decode(text, _skipped(text, at))
            at = _skipped(text, at)
            if not isinstance(name, str) or text[at : at + 1] != ":":
                return last
            _, at = _DECODER.raw_decode(text, _skipped(text, at + 1))
        except (ValueError, RecursionError):
            return last
        at = _skipped(text, at)
        if text[at : at + 1] != ",":
            return last
        last, at = at, at + 1


def salvaged(text: str) -> tuple[list[str], bool]:
    """The texts of an array's values, and whether the last of them is an object that was closed behind its last whole field."""
    at = text.find("[")
    if at < 0:
        return [], False
    found, at = [], at + 1
    while True:
        at = _skipped(text, at, _BLANK + ",")
        if at >= len(text) or text[at] == "]":
            return found, False
        try:
            end = _DECODER.raw_decode(text, at)[1]
        except (ValueError, RecursionError):
            break
        found.append(text[at:end])
        at = end
    comma = whole_fields(text, at)
    return (found, False) if comma is None else ([*found, text[at:comma] + "}"], True)


def salvaged_records(files: DataFrame, schema: str) -> DataFrame:
    """Records of ``files`` (``path``, ``value``: one JSON array each, perhaps cut) with their ``path``, place in the array and whether they are ``partial``.

    A null or empty text has none; fields that a partial record lost are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                records, partial = salvaged(text or "")
                for low in range(0, len(records), 1024):
                    part = records[low : low + 1024]
                    place = range(low, low + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part), pa.string()), pa.array(place, pa.int64()), pa.array([partial and i == len(records) - 1 for i in place]), pa.array(part, pa.string())], ["path", "place", "partial", "text"]
                    )

    found = files.select(F.col("path").cast("string").alias("path"), "value").mapInArrow(run, "path string, place long, partial boolean, text string")
    return found.select("path", "place", "partial", F.from_json("text", schema).alias("r")).select("path", "place", "partial", "r.*")


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _effect(segment: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """What a segment and the brace that ends it do, for a string closed and open at its begin: whether one is open then, and how many more brackets."""
    parts = _ESCAPED.sub("", segment).split('"')
    out = []
    for opened in (0, 1):
        plain = "".join(parts[opened::2])
        depth = plain.count("{") + plain.count("[") - plain.count("]")  # a closing brace outside of strings ends the segment
        end = opened ^ (len(parts) - 1) & 1
        out.append((end, depth - (not end)))
    return out[0], out[1]


def _runs(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """The rows of a task; ``begins`` where a range does."""
    now = None
    for batch in batches:
        for path, block, value, *rest in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value", *more)), strict=True):
            yield (path, block) != now, path, block, value or "", *rest
            now = path, block


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = []
    for begins, path, block, value, size in _runs(batches, "size"):
        if begins:
            out.append([path, block, size, 0, 0, 1, 0, 0])
        row, effect = out[-1], _effect(value)
        row[3] += len(value.encode()) + 1
        for at in (4, 6):  # the open string and the brackets from a closed one at the begin, and from an open one
            end, depth = effect[row[at] if at == 4 else row[5]]
            if at == 4:
                row[4], row[6] = end, row[6] + depth
            else:
                row[5], row[7] = end, row[7] + depth
    names = ["path", "block", "size", "bytes", "open0", "open1", "depth0", "depth1"]
    for low in range(0, len(out), 4096):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[low : low + 4096]], pa.string() if i == 0 else pa.int64()) for i in range(8)], names)


def _states(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the begin of each range of a file, and whether the file ends with the last range's last brace."""
    ranges = ranges.sort_values("block", ignore_index=True)
    opened, depth, out = 0, 0, []
    cut = int(ranges["bytes"].sum()) > int(ranges["size"].iloc[0])  # no brace stands at the end, though one was counted
    for i, r in enumerate(ranges.itertuples()):
        out.append((r.path, r.block, opened, depth, cut and i == len(ranges) - 1))
        opened, depth = (r.open1, depth + r.depth1) if opened else (r.open0, depth + r.depth0)
    return pd.DataFrame(out, columns=["path", "block", "opened", "depth", "unclosed"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of those that go over ranges: ``starts`` and ``ends`` tell whether the text begins and ends one."""
    out: list[tuple] = []
    size = 0
    held: list[str] = []
    starts = False
    now: tuple = ()

    def told(ends: bool) -> None:
        nonlocal size
        text = "".join(held)
        out.append((*now, starts, ends, text))
        size += len(text)
        held.clear()

    def batch() -> pa.RecordBatch:
        nonlocal size
        size = 0
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["path", "block", "starts", "ends", "text"])
        out.clear()
        return made

    opened = depth = 0
    for (begins, path, block, value, first_open, first_depth, no_brace), following in pairwise(chain(_runs(batches, "opened", "depth", "unclosed"), [(True,)])):
        if begins:
            if held:
                told(False)
            now, opened, depth, starts = (path, block), first_open, first_depth, False
            inside = depth >= 2
        brace = "" if no_brace and following[0] else "}"  # the file's very last piece of text may have none behind it
        if not inside:
            at = value.find("{")
            if at >= 0:
                held.append(value[at:] + brace)
                inside = starts = True
        else:
            held.append(value + brace)
        opened, change = _effect(value)[opened]
        depth += change + (not brace and not opened)
        if inside and depth <= 1 and not opened:
            told(True)
            inside, starts = False, True
        if size > 1 << 22:
            yield batch()
    if held:
        told(False)
    if out:
        yield batch()


def large_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON arrays of objects in files of any size: ``path``, whether a record is ``partial``, and its fields. A record that a cut has split is closed behind its last whole field.

    Spark's text reader splits files by bytes at closing braces; a file's ranges are few rows, one for each split, that go to all tasks.
    """
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    ranges = text.mapInArrow(_effects, "path string, block long, size long, bytes long, open0 long, open1 long, depth0 long, depth1 long")
    states = ranges.groupBy("path").applyInPandas(_states, "path string, block long, opened long, depth long, unclosed boolean")
    pieces = text.join(F.broadcast(states), ["path", "block"]).select("path", "block", "value", "opened", "depth", "unclosed").mapInArrow(_pieces, "path string, block long, starts boolean, ends boolean, text string")
    whole = pieces.where("starts AND ends").select("path", "text", F.lit(False).alias("partial"))
    # A piece that starts no record goes on with the one that the last range before it has left open.
    parts = pieces.where("NOT (starts AND ends)")
    owner = F.max(F.when(F.col("starts"), F.col("block"))).over(Window.partitionBy("path").orderBy("block", "starts").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = parts.withColumn("owner", owner).groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max("ends").alias("ends"))
    broken = joined.select("path", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), (~F.col("ends")).alias("partial"))

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, partial in zip(batch.column("text").to_pylist(), batch.column("partial").to_pylist(), strict=True):
                comma = whole_fields(value, 0) if partial else None
                texts.append(value if not partial else None if comma is None else value[:comma] + "}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), batch.column("partial")], ["path", "text", "partial"])

    found = whole.unionByName(broken.mapInArrow(closed, "path string, text string, partial boolean").where("text IS NOT NULL"))
    return found.select("path", "partial", F.from_json("text", schema).alias("r")).select("path", "partial", "r.*")
