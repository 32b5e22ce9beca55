"""Exact order statistics of many groups at once, whatever a group's size.

Groups of at most ``bound`` rows are sorted where they are. A larger group never meets in one task: its values become integers whose order is theirs (the bits
of a double, with a negative one's turned over), and each wanted rank is narrowed down by rounds of counts. A round counts the next bits of the values
within each rank's interval, for all groups and ranks in one aggregation that combines before its exchange, and moves on to the bits that hold the rank. An interval with at
most ``bound`` rows left is sorted; one whose bits are used up is a single value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.tables import joined, written

#: Rows of a group, or of an interval, that are sorted in one task.
BOUND = 1 << 20
#: Bits that are left to tell apart after each round.
_SHIFTS = (52, 40, 28, 16, 4, 0)
#: Intervals that are sent to all tasks at most; there are fewer of them than rows over ``bound``, times ranks.
_FEW = 100_000


@F.pandas_udf(LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; the two zeros are one, and what is not a number comes last."""
    bits = (x.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def at_ranks(rows: DataFrame, by: list[str], x: str, ranks: dict[str, Callable[[Column], Column]], bound: int = BOUND) -> DataFrame:
    """``by``, ``n`` (values that aren't null) and, by name, the value at each rank, from 1 in ascending order; a rank is a function of ``n``.

    A rank outside 1 to n has no value. Groups are those of the rows with a value.
    """
    values = rows.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"))
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > bound), "large-groups")
    if not large.limit(1).count():
        return _sorted(values, by, ranks)
    if not by:
        return _narrowed(values, large, by, ranks, bound)
    small = joined(values, large.select(*by), by, "left_anti")
    return _sorted(small, by, ranks).unionByName(_narrowed(values, large, by, ranks, bound))


def _sorted(values: DataFrame, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    whole = Window.partitionBy(*by)
    placed = values.withColumns({"n": F.count(F.lit(1)).over(whole), "i": F.row_number().over(whole.orderBy("x"))})
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("i") == rank(F.col("n")), F.col("x"))).alias(name) for name, rank in ranks.items()])


def _narrowed(values: DataFrame, large: DataFrame, by: list[str], ranks: dict[str, Callable[[Column], Column]], bound: int) -> DataFrame:
    few = large.count() * len(ranks) <= _FEW
    sent = F.broadcast if few else (lambda df: df)
    rows = written(joined(values, sent(large.select(*by)), by, "left_semi").withColumn("key", _ordered("x")), "large-values")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("left")) for name, rank in ranks.items()])
    # An interval is named by the bits known so far; at first there are none.
    state = large.select(*by, F.lit(0).cast("long").alias("prefix"), "n", F.inline(wanted)).where((F.col("left") >= 1) & (F.col("left") <= F.col("n")))
    interval, found, known = [*by, "prefix"], [], F.lit(0).cast("long")
    for shift in _SHIFTS:
        within = joined(rows.withColumn("prefix", known), sent(state.select(*interval).distinct()), interval)
        counts = within.groupBy(*interval, F.shiftright("key", shift).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy(*interval).orderBy("bits")) - F.col("n")
        counts = counts.withColumn("before", before)
        narrower = joined(state.drop("n"), counts, interval).where((F.col("left") > F.col("before")) & (F.col("left") <= F.col("before") + F.col("n")))
        state = written(narrower.select(*by, "name", F.col("bits").alias("prefix"), "n", (F.col("left") - F.col("before")).alias("left")), "intervals")
        known = F.shiftright("key", shift)
        done = state.where(F.col("n") <= bound) if shift else state
        if shift:
            held = joined(rows.withColumn("prefix", known), sent(done.select(*interval).distinct()), interval)
            held = held.withColumn("left", F.row_number().over(Window.partitionBy(*interval).orderBy("key")).cast("long"))
            found.append(joined(done, held.select(*interval, "left", "x"), [*interval, "left"]).select(*by, "name", "x"))
            state = state.where(F.col("n") > bound)
            if not state.limit(1).count():
                break
        else:
            held = joined(rows.withColumn("prefix", known), sent(done.select(*interval).distinct()), interval).groupBy(*interval).agg(F.min("x").alias("x"))
            found.append(joined(done, held, interval).select(*by, "name", "x"))
    each = reduce(DataFrame.unionByName, found)
    wide = each.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks])
    return joined(large.select(*by, "n"), wide, by, "left")


def quantiles(rows: DataFrame, by: list[str], x: str, shares: dict[str, float], bound: int = BOUND) -> DataFrame:
    """``by`` and each named quantile of ``x``, between neighbouring values in proportion; null for a group without values."""
    place = lambda share: lambda n: (n - 1) * F.lit(share)
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, share in shares.items():
        ranks[f"{name} lower"] = lambda n, at=place(share): F.floor(at(n)) + 1
        ranks[f"{name} upper"] = lambda n, at=place(share): F.ceil(at(n)) + 1

    def between(name: str, share: float) -> Column:
        low, high, at = F.col(f"{name} lower"), F.col(f"{name} upper"), place(share)(F.col("n"))
        part = at - F.floor(at)
        return F.when(part == 0, low).otherwise((F.ceil(at) - at) * low + part * high)

    found = at_ranks(rows, by, x, ranks, bound).select(*by, *[between(name, share).alias(name) for name, share in shares.items()])
    return joined(rows.select(*by).distinct(), found, by, "left") if by else rows.limit(1).select(F.lit(0).alias("_")).join(found, how="left").drop("_")


def median(rows: DataFrame, by: list[str], x: str, name: str, bound: int = BOUND) -> DataFrame:
    return quantiles(rows, by, x, {name: 0.5}, bound)


def around_middle(rows: DataFrame, by: list[str], x: str, bound: int = BOUND) -> DataFrame:
    """``by``, ``n`` and the values ``before``, at and ``after`` the middle; of an even number the lower middle."""
    middle = lambda n: F.floor((n + 1) / 2)
    return at_ranks(rows, by, x, {"before": lambda n: middle(n) - 1, "middle": middle, "after": lambda n: middle(n) + 1}, bound)


def beside_middle(rows: DataFrame, by: list[str], of: dict[str, Column]) -> DataFrame:
    """The rows, each with ``around_middle`` of its group's values ``of`` as a struct, nulls left out. Groups are sorted where they meet, so they should be bounded."""
    whole = Window.partitionBy(*by)
    places = {f"_x_{k}": v for k, v in of.items()}
    found = rows.withColumns(places).withColumns({f"_i_{k}": F.row_number().over(whole.orderBy(F.asc_nulls_last(f"_x_{k}"))) for k in of})
    found = found.withColumns({f"_n_{k}": F.count(f"_x_{k}").over(whole) for k in of})

    def at(k: str, step: int) -> Column:
        return F.max(F.when((F.col(f"_i_{k}") == F.floor((F.col(f"_n_{k}") + 1) / 2) + step) & (F.col(f"_i_{k}") <= F.col(f"_n_{k}")), F.col(f"_x_{k}"))).over(whole)

    found = found.withColumns({f"_{name}_{k}": at(k, step) for k in of for name, step in (("before", -1), ("middle", 0), ("after", 1))})
    told = {k: F.struct(F.col(f"_n_{k}").alias("n"), *[F.col(f"_{name}_{k}").alias(name) for name in ("before", "middle", "after")]) for k in of}
    return found.withColumns(told).drop(*[f"_{name}_{k}" for k in of for name in ("x", "i", "n", "before", "middle", "after")])


def beside_median(rows: DataFrame, by: list[str], x: str, name: str, bound: int = BOUND) -> DataFrame:
    """The rows, each with the median of its group's values; null for a group without values. Groups of at most ``bound`` rows are moved once."""

    def in_place(rows: DataFrame) -> DataFrame:
        found = beside_middle(rows, by, {"_middle": F.col(x).cast("double")})
        m = F.col("_middle")
        return found.withColumn(name, F.when(m["n"] % 2 == 1, m["middle"]).otherwise((m["middle"] + m["after"]) / 2)).drop("_middle")

    large = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select(*by), "large-groups")
    if not large.limit(1).count():
        return in_place(rows)
    hot = joined(rows, large, by, "left_semi")
    return in_place(joined(rows, large, by, "left_anti")).unionByName(joined(hot, median(hot, by, x, name, bound), by, "left"))
