"""Data-quality checks: each is a DataFrame of the rows that fail, with a severity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.columns import has_recorded_position


@dataclass(frozen=True)
class Check:
    """Fails if ``failing`` has rows; a warning then is reported and an error stops ``enforce``."""

    name: str
    failing: DataFrame
    severity: str = "error"


#: Registers of a sketch as a power of two: an error of about 1.04 / sqrt(2 ** bits), here 0.8 %.
SKETCH_BITS = 14

CHECKS: dict[str, Callable[..., DataFrame]] = {}


def register_check(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    CHECKS[f.__name__] = f
    return f


@register_check
def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


@register_check
def unique_combination(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


@register_check
def accepted_values(df: DataFrame, column: str, *values: object) -> DataFrame:
    """Null passes."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


@register_check
def relationship(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is set and names no parent."""
    keys = parent.select(F.col(key).alias("_parent")).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_parent"), "left_anti")


@register_check
def not_empty(df: DataFrame) -> DataFrame:
    """One row if ``df`` has none."""
    return df.limit(1).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows = 0")


@register_check
def within(df: DataFrame, columns: list[str], low: float, high: float, eps: float = 1e-9) -> DataFrame:
    """Values of several columns outside a range, one row for each."""
    others = [c for c in df.columns if c not in columns]
    long = df.unpivot(others, columns, "column", "value")
    return long.where((F.col("value") < low - eps) | (F.col("value") > high + eps))


@register_check
def same_grain(fine: DataFrame, mart: DataFrame, *keys: str) -> DataFrame:
    """One row if the mart has other keys than ``fine``, or repeats one."""
    each = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.count_distinct(F.struct(*keys)).alias(f"{n}_keys"))
    both = each(fine, "fine").crossJoin(F.broadcast(each(mart, "mart")))  # one row each
    return both.where("mart_rows <> mart_keys OR mart_keys <> fine_keys")


@register_check
def exactly_one_of_each(facts: DataFrame, key: str, column: str, required: list[object]) -> DataFrame:
    """Keys without exactly one row of each required value, by one aggregation."""
    counts = facts.groupBy(key).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"n{i}") for i, v in enumerate(required)])
    slots = F.array(*[F.struct(F.lit(v).alias(column), F.col(f"n{i}").alias("n_rows")) for i, v in enumerate(required)])
    return counts.select(key, F.inline(slots)).where("n_rows <> 1")


@register_check
def one_value_per(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("n_values")).where("n_values > 1")


@register_check
def only_when(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows where the two conditions differ."""
    return df.where(a != b)


@register_check
def agrees(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.col(column))


@register_check
def minutes_within(mart: DataFrame, lengths: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Players on for longer than the match."""
    return mart.join(lengths, "match_id").where(F.col("minutes_played") > F.col("full_time") + tolerance)


@register_check
def team_minutes_within(mart: DataFrame, lengths: DataFrame, players: int = 11, tolerance: float = 1.0) -> DataFrame:
    """Teams whose players add up to more than a full side for the whole match."""
    total = mart.groupBy("match_id", "team_id").agg(F.sum("minutes_played").alias("team_minutes"))
    return total.join(lengths, "match_id").where(F.col("team_minutes") > players * F.col("full_time") + tolerance)


@register_check
def times_within(events: DataFrame, low: float = 0.0, high: float = 5400.0) -> DataFrame:
    """Periods with an event outside the clock."""
    spans = events.groupBy("match_id", "period_id").agg(F.min("seconds_into_period").alias("first_at"), F.max("seconds_into_period").alias("last_at"))
    return spans.where((F.col("first_at") < low) | (F.col("last_at") > high))


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """Rows, values, approximate distinct values and literal escapes of every column, in one pass."""

    def of(c: str, kind: str) -> list[Column]:
        escapes = F.count(F.when(F.instr(F.col(c), "\\u") > 0, 1)) if kind == "string" else F.lit(0).cast("long")
        return [F.count(c).alias(f"{c}__n"), F.approx_count_distinct(c).alias(f"{c}__d"), escapes.alias(f"{c}__e")]

    flat = [(c, k) for c, k in df.dtypes if not k.startswith(("map", "array", "struct"))]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[x for c, k in flat for x in of(c, k)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("non_null"), F.col(f"{c}__d").alias("distinct_approx"), F.col(f"{c}__e").alias("escaped")) for c, _ in flat])
    return one.select(F.lit(name).alias("model"), "n_rows", F.inline(rows))


def relationship_profile(parent: DataFrame, key: str, child: DataFrame, fk: str) -> DataFrame:
    """How many parents have how many children."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("n"))
    each = parent.select(key).join(counts, F.col(key) == F.col("_fk"), "left").select(F.coalesce("n", F.lit(0)).alias("children"))
    return each.groupBy("children").agg(F.count(F.lit(1)).alias("parents"))


@register_check
def all_null_columns(profile: DataFrame) -> DataFrame:
    """Columns of a profile without a value, in tables that have rows."""
    return profile.where("n_rows > 0 AND non_null = 0")


@register_check
def escaped_columns(profile: DataFrame) -> DataFrame:
    """Columns of a profile where characters are still written as escapes."""
    return profile.where("escaped > 0")


@register_check
def recorded_positions(events: DataFrame) -> DataFrame:
    """Events that lack a place though their kind records one, or have one though it doesn't."""
    return events.where(has_recorded_position(F.col("event_type"), F.col("set_piece_type")) == F.col("start_x").isNull())


def profile_parts(df: DataFrame, name: str, *part: str) -> DataFrame:
    """A profile of each part of a table (a file, a day), with a sketch of the distinct values that can be merged: one row for each part and column.

    A new part costs its own rows only; ``merged_profile`` puts parts together.
    """
    flat = [(c, k) for c, k in df.dtypes if not k.startswith(("map", "array", "struct")) and c not in part]

    def of(c: str, kind: str) -> Column:
        escapes = F.count(F.when(F.instr(F.col(c), "\\u") > 0, 1)) if kind == "string" else F.lit(0).cast("long")
        sketch = F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS)
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), escapes.alias("escaped"), sketch.alias("sketch"))

    one = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n_rows"), F.array(*[of(c, k) for c, k in flat]).alias("columns"))
    return one.select(*part, F.lit(name).alias("model"), "n_rows", F.inline("columns"))


def merged_profile(parts: DataFrame) -> DataFrame:
    """The profile of all parts together; the distinct values are estimated from the union of their sketches."""
    found = parts.groupBy("model", "column").agg(F.sum("n_rows").alias("n_rows"), F.sum("non_null").alias("non_null"), F.sum("escaped").alias("escaped"), F.hll_union_agg("sketch").alias("sketch"))
    return found.select("model", "n_rows", "column", "non_null", F.hll_sketch_estimate("sketch").alias("distinct_approx"), "escaped")


def unreadable(files: DataFrame, schema: str) -> DataFrame:
    """Files (``path``, ``value``) whose text isn't JSON (``broken``; null and empty texts are), or holds literal escapes.

    ``schema`` is one record's; a file holds one or an array of them. A value of another type than the schema's reads as null and isn't reported.
    """
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    records = F.from_json("value", f"array<struct<{_fields(schema)},_corrupt:string>>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    many = F.ltrim("value").startswith("[")
    broken = F.when(many, records.isNull() | F.exists(records, lambda r: r["_corrupt"].isNotNull()) | ~F.rtrim("value").endswith("]")).otherwise(parsed.isNull() | parsed["_corrupt"].isNotNull())
    return files.select("path", F.coalesce(broken, F.lit(True)).alias("broken"), F.coalesce(F.instr("value", "\\u") > 0, F.lit(False)).alias("escaped")).where("broken OR escaped")


def _fields(schema: str) -> str:
    """A record's columns as the fields of a struct."""
    return StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def within_tiers(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0, tiers: tuple[float, float] = (0.01, 0.03), eps: float = 1e-9) -> DataFrame:
    """Values outside a range by more than the first tier, each with the ``severity`` of the tier that it exceeds: a warning, or an error."""
    far = (F.col("value") < low - tiers[1] - eps) | (F.col("value") > high + tiers[1] + eps)
    return within(df, columns, low - tiers[0], high + tiers[0], eps).withColumn("severity", F.when(far, "error").otherwise("warn"))


@register_check
def mirrored_keepers(mart: DataFrame) -> DataFrame:
    """Goalkeepers' matches that were recorded in the other side's frame."""
    return mart.where("has_mirrored_positions").select("match_id", "player_id", "attempts_beyond_halfway", "actions", F.round("mean_action_x", 3).alias("mean_action_x"))


def run(checks: list[Check]) -> DataFrame:
    """``name``, ``severity`` and failing rows of all checks, as one job."""
    parts = [c.failing.agg(F.count(F.lit(1)).alias("failing")).select(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), "failing") for c in checks]
    return reduce(DataFrame.unionByName, parts)


def first_failures(check: Check, n: int = 20) -> DataFrame:
    """The first failing rows in the order of their columns, to look at."""
    return check.failing.orderBy(*check.failing.columns).limit(n)


def enforce(checks: list[Check]) -> DataFrame:
    """The report, computed once; an error check with failing rows stops it."""
    found = run(checks).collect()
    broken = [r["name"] for r in found if r["severity"] == "error" and r["failing"] > 0]
    if broken:
        raise ValueError(f"checks failed: {', '.join(broken)}")
    return checks[0].failing.sparkSession.createDataFrame(found, "name string, severity string, failing long")
