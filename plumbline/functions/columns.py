"""Column expressions shared by models and the checks on them."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def unknown_to_null(c: Column, sentinel: object = 0) -> Column:
    """Null where the column holds the publisher's stand-in for unknown."""
    return F.nullif(c, F.lit(sentinel))


def decode_unicode_escapes(c: Column) -> Column:
    r"""Replace each literal ``\uXXXX`` by its character; runs decode together, so surrogate pairs do too."""
    runs = F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:\\u[0-9a-fA-F]{4})+)"), F.lit(1)))

    def replaced(text: Column, run: Column) -> Column:
        return F.replace(text, run, F.decode(F.unhex(F.replace(run, F.lit("\\u"), F.lit(""))), "UTF-16BE"))

    # Longest run first: a shorter one may be a part of it.
    ordered = F.array_sort(runs, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, c, replaced)


def round_half_up(x: Column, digits: int) -> Column:
    """Half away from zero on the double's own value."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, null where there is nothing to divide by."""
    return round_half_up(part * F.lit(100.0) / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def count_where(p: Column) -> Column:
    return F.count(F.when(p, F.lit(1)))


def sum_where(p: Column, x: Column) -> Column:
    """Filtered sum, 0 where nothing passes."""
    return F.coalesce(F.sum(F.when(p, x)), F.lit(0))


def count_if_any(flag: Column) -> Column:
    """How many are true; null where none is known."""
    return F.when(F.count(flag) > 0, F.count_if(flag))


def has_recorded_position(event_type: Column, set_piece: Column) -> Column:
    """Whether an event of this kind records where it started; staging and its check both ask here."""
    return ~set_piece.eqNullSafe(F.lit("GOAL_KICK")) & ~event_type.isin("GOALKEEPER", "GENERIC:generic")


def middle(values: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def first_largest(names: list[str], columns: list[Column]) -> Column:
    """The name of the largest column, the first on ties; null if all are null."""
    values = F.array(*columns)
    return F.element_at(F.array(*map(F.lit, names)), F.nullif(F.array_position(values, F.array_max(values)), F.lit(0)).cast("int"))


def nulls_skipped(f, columns: list[Column]) -> Column:  # noqa: ANN001
    """``f`` of the array of those columns that aren't null."""
    return f(F.filter(F.array(*columns), lambda x: x.isNotNull()))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values).cast("double"), F.lit(0.0))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether two numbers are equal but for rounding; two unknown ones (null or not a number) are, one isn't."""
    unknown = lambda x: x.isNull() | F.isnan(x)
    near = F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), F.lit(False))
    return F.when(unknown(a) | unknown(b), unknown(a) & unknown(b)).otherwise(near | (a == b))
