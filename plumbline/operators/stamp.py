"""Content hashes of inputs, and tables that refuse to be read for other inputs than their own."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from types import CodeType, ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.commits import Table

_NESTED = ("array", "map", "struct", "variant")


def _row_hashes(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two independent hashes of a row. Each column goes in with its place and with whether it is null, since a hash of several columns passes over nulls; nested values go in as JSON that names theirs."""

    def parts(place: int, name: str) -> list[Column]:
        value = F.col(f"`{name}`")
        if df.schema[name].dataType.typeName() in _NESTED:
            value = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
        return [F.lit(place), F.col(f"`{name}`").isNull(), value]

    told = [x for place, name in enumerate(columns) for x in parts(place, name)]
    return [F.xxhash64(F.lit(field), *told).cast("decimal(38,0)") for field in (1, 2)]


def _digest(df: DataFrame, columns: list[str], *more: Column) -> tuple[str, dict]:
    sums = [F.sum(h).alias(f"_sum{i}") for i, h in enumerate(_row_hashes(df, columns))]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *sums, *more).first().asDict()
    return hashlib.sha256(json.dumps([columns, one["_rows"], str(one["_sum0"]), str(one["_sum1"])]).encode()).hexdigest(), one


def content_hash(df: DataFrame, *keys: str) -> str:
    """A hash of all rows, whatever the order of rows and columns; repeated keys are refused, since then a row has no name."""
    found, one = _digest(df, sorted(df.columns), F.count_distinct(F.struct(*keys)).alias("_keys"))
    if one["_rows"] != one["_keys"]:
        raise ValueError(f"{one['_rows'] - one['_keys']} rows repeat a key of {', '.join(keys)}")
    return found


def ordered_hash(df: DataFrame, *keys: str) -> str:
    """A hash of all rows by the order of their keys, with the columns in theirs: moving a row's values to another key changes it.

    A row is hashed whole, key and values together, so the set of rows stands for the sequence and nothing is sorted.
    """
    found, _ = _digest(df, [*keys, *[c for c in df.columns if c not in keys]])
    return hashlib.sha256(json.dumps([found, df.columns, list(keys)]).encode()).hexdigest()


def code_hash(*modules: ModuleType) -> str:
    """A hash of what modules compile to. Comments, layout and docstrings leave no trace in it, nor do assertions; another Python may compile otherwise."""

    def told(code: CodeType) -> Iterator[str]:
        yield repr((code.co_code.hex(), code.co_names, code.co_varnames, code.co_freevars, code.co_cellvars, code.co_argcount, code.co_kwonlyargcount, code.co_flags, code.co_exceptiontable.hex()))
        for value in code.co_consts:
            if isinstance(value, CodeType):
                yield from told(value)
            else:
                # A set's order may differ from run to run.
                yield repr((type(value).__name__, sorted(map(repr, value)) if isinstance(value, frozenset) else value))

    out = hashlib.sha256()
    for module in modules:
        for part in told(compile(Path(module.__file__).read_text(), "module", "exec", dont_inherit=True, optimize=2)):
            out.update(part.encode())
    return out.hexdigest()[:16]


def write_stamped(df: DataFrame, path: str, stamp: str) -> None:
    """Make ``df`` the table at ``path``, with the stamp of what it was made from."""
    Table(df.sparkSession, path).replace(df, stamp)


def read_stamped(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """The last table, if its inputs had this stamp."""
    table = Table(spark, path)
    last = table.last()
    if last.stamp != stamp:
        raise ValueError(f"{path} was made from other inputs; make it again")
    return table.read(last.number)


def write_provenance(spark: SparkSession, path: str, current: dict[str, str]) -> None:
    """What decides a table's contents (inputs, versions, code), in a commit of its own."""
    Table(spark, path).record(current)


def provenance_changes(spark: SparkSession, path: str, current: dict[str, str]) -> DataFrame:
    """``key``, ``recorded`` and ``now`` where what is recorded differs from ``current``: of keys on both sides, or on one."""
    table = lambda of, name: spark.createDataFrame(list(of.items()), f"key string, {name} string")
    both = table(Table(spark, path).last().provenance or {}, "recorded").join(table(current, "now"), "key", "full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("now")))


def stale(spark: SparkSession, path: str, current: dict[str, str]) -> list[str]:
    """One line for each key whose provenance changed; none for a table that doesn't exist. Provenance that is lacking or can't be read is a change itself."""
    table = Table(spark, path)
    if not table.exists():
        return []
    try:
        known = table.last().provenance is not None
        changes = provenance_changes(spark, path, current).orderBy("key").collect() if known else []
    except Exception as e:  # noqa: BLE001: any failure counts
        return [f"the provenance can't be read ({type(e).__name__})"]
    return [f"{r['key']}: {r['recorded']} -> {r['now']}" for r in changes] if known else ["written before provenance was recorded"]
