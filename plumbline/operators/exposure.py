"""How long an entity was on: intervals from lineups, substitutions and its own events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import round_half_up


def period_lengths(events: DataFrame, last_period: int = 4) -> DataFrame:
    return events.where(F.col("period_id") <= last_period).groupBy("match_id", "period_id").agg((F.max("seconds_into_period") / 60.0).alias("period_minutes"))


def full_time(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("match_id").agg(round_half_up(F.sum("period_minutes"), 1).alias("full_time"))


def period_starts(lengths: DataFrame) -> DataFrame:
    """The match clock at each period's start: the length of all periods before it."""
    before = Window.partitionBy("match_id").orderBy("period_id").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select("match_id", "period_id", F.coalesce(F.sum("period_minutes").over(before), F.lit(0.0)).alias("starts_at"))


def appearances(events: DataFrame, starts: DataFrame) -> DataFrame:
    """First and last minute of each player's own events."""
    minute = F.col("starts_at") + F.col("seconds_into_period") / 60.0
    seen = events.where(F.col("player_id").isNotNull()).join(starts, ["match_id", "period_id"])
    return seen.groupBy("match_id", "player_id").agg(F.min(minute).alias("first_event_minute"), F.max(minute).alias("last_event_minute"))


def minutes_played(events: DataFrame, lineups: DataFrame, substitutions: DataFrame) -> DataFrame:
    """One row for each player who was on. An unused substitute has none; a missing substitution is inferred from the player's events and marked."""
    lengths = period_lengths(events)
    on = substitutions.select("match_id", F.col("player_in").alias("player_id"), F.col("minute").alias("in_minute"))
    off = substitutions.select("match_id", F.col("player_out").alias("player_id"), F.col("minute").alias("out_minute"))
    keys = ["match_id", "player_id"]
    joined = lineups.join(full_time(lengths), "match_id").join(appearances(events, period_starts(lengths)), keys, "left").join(on, keys, "left").join(off, keys, "left")
    unexplained = ~F.col("started") & F.col("in_minute").isNull()
    spans = joined.select(
        *keys,
        "team_id",
        "started",
        (unexplained & F.col("first_event_minute").isNotNull()).alias("minutes_are_inferred"),
        F.when(F.col("started"), 0.0).otherwise(F.coalesce(F.col("in_minute").cast("double"), "first_event_minute")).alias("came_on"),
        F.when(unexplained, F.col("last_event_minute")).otherwise(F.least(F.col("out_minute").cast("double"), F.col("sent_off_minute").cast("double"), "full_time")).alias("went_off"),
    )
    flagged = spans.withColumn("match_has_missing_substitution", F.bool_or("minutes_are_inferred").over(Window.partitionBy("match_id")))
    flagged = flagged.withColumn("minutes_played", round_half_up(F.greatest(F.col("went_off") - F.col("came_on"), F.lit(0.0)), 1))
    return flagged.where(F.col("came_on").isNotNull() & ~(F.col("minutes_are_inferred") & (F.col("went_off") <= F.col("came_on"))))
