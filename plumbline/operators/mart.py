"""Match results and the fact mart: one row for each player in a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Settings
from plumbline.functions.columns import rate, round_half_up, sum_where

# Kinds of action that count as defensive volume, and those of them whose outcome is scored.
DEFENSIVE_SCORED = ("defensive_duel", "clearance")
DEFENSIVE_VOLUME = (*DEFENSIVE_SCORED, "interception_as_pass", "interception_as_touch", "interception_as_duel")


def match_results(matches: DataFrame, sides: DataFrame) -> DataFrame:
    """Both sides as columns, the winner by the phase that decided, and whether the publisher agrees."""
    decisive = F.when(F.col("duration") == "Regular", F.col("goals")).when(F.col("duration") == "ExtraTime", F.col("goals_extra_time")).otherwise(F.col("goals_penalties"))

    def of(side: str, c: Column | str) -> Column:
        return F.max(F.when(F.col("side") == side, c if isinstance(c, Column) else F.col(c)))

    paired = matches.join(sides, "match_id").groupBy("match_id", "duration", "published_winner_id", "published_is_draw")
    wide = paired.agg(*[of(s, c).alias(f"{s}_{n}") for s in ("home", "away") for n, c in (("team_id", "team_id"), ("decisive", decisive), ("goals", "goals"))])
    home, away = F.col("home_decisive"), F.col("away_decisive")
    winner = F.when(home > away, F.col("home_team_id")).when(away > home, F.col("away_team_id"))
    return wide.select(
        "match_id", "duration", "home_team_id", "away_team_id", "home_goals", "away_goals",
        winner.alias("winning_team_id"), (home == away).alias("is_draw"), "published_winner_id",
        winner.eqNullSafe(F.col("published_winner_id")).alias("agrees_with_publisher"),
    )


def pivoted(counts: DataFrame) -> DataFrame:
    """Counts by kind of action as one row for each player in a match."""
    kind, is_pass = F.col("action_type"), F.col("is_pass")
    volume, scored = kind.isin(*DEFENSIVE_VOLUME), kind.isin(*DEFENSIVE_SCORED)
    attempts, judged, inferred = F.col("attempts"), F.col("attempts_with_recorded_outcome"), F.col("attempts_with_inferred_outcome")
    won, won_inferred, third = F.col("successes_recorded"), F.col("successes_inferred"), F.col("in_defensive_third")
    placed = F.col("attempts_with_position")
    return counts.groupBy("match_id", "player_id", "team_id").agg(
        F.sum(attempts).alias("actions"),
        sum_where(is_pass, attempts).alias("passes"),
        sum_where(is_pass, judged + inferred).alias("passes_with_outcome"),
        sum_where(is_pass, won + won_inferred).alias("passes_completed"),
        sum_where(is_pass, inferred).alias("passes_outcome_inferred"),
        F.sum("crosses").alias("crosses"),
        sum_where(volume, attempts).alias("defensive_actions"),
        sum_where(scored, judged).alias("defensive_actions_with_outcome"),
        sum_where(scored, won).alias("defensive_actions_successful"),
        sum_where(scored, inferred).alias("defensive_actions_outcome_inferred"),
        sum_where(F.col("action_group") == "interception", attempts).alias("interceptions"),
        F.coalesce(F.sum("tackles"), F.lit(0)).alias("tackles"),
        F.coalesce(F.sum("tackles_won"), F.lit(0)).alias("tackles_won"),
        F.sum(third).alias("touches_in_defensive_third"),
        sum_where(volume, third).alias("defensive_actions_in_defensive_third"),
        F.sum("attempts_beyond_halfway").alias("attempts_beyond_halfway"),
        (F.sum(placed * F.col("mean_start_x")) / F.nullif(F.sum(placed).cast("double"), F.lit(0.0))).alias("mean_action_x"),
        F.sum(placed).alias("attempts_with_position"),
        F.coalesce(F.sum("sum_start_x_in_defensive_third"), F.lit(0.0)).alias("sum_start_x_in_defensive_third"),
    )


def regulation_minutes(duration: Column) -> Column:
    return F.when(duration.isin("ExtraTime", "Penalties"), 120).otherwise(90)


def fact_mart(counts: DataFrame, players: DataFrame, minutes: DataFrame, matches: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The mart with its rates, exposure, position and flags; nothing is filtered, doubts are columns."""
    wide = pivoted(counts)
    time = minutes.select("match_id", "player_id", "started", "minutes_played", "minutes_are_inferred", "match_has_missing_substitution")
    who = players.select("player_id", "position", "position_code")
    when = matches.select("match_id", regulation_minutes(F.col("duration")).alias("regulation_minutes"))
    joined = wide.join(who, "player_id", "left").join(time, ["match_id", "player_id"], "left").join(when, "match_id", "left")
    mirrored = (F.col("position_code") == "GK") & (F.col("attempts_beyond_halfway") >= settings.mirrored_event_floor)
    return joined.select(
        "match_id", "player_id", "team_id", "position", "position_code", "started", "minutes_played", "minutes_are_inferred",
        F.coalesce("match_has_missing_substitution", F.lit(False)).alias("match_has_missing_substitution"),
        "regulation_minutes",
        (F.col("minutes_played") >= settings.eligible_minutes).alias("is_eligible"),
        "actions", "passes", "passes_completed", "passes_with_outcome",
        (F.col("passes") - F.col("passes_with_outcome")).alias("passes_unjudged"),
        "passes_outcome_inferred",
        rate(F.col("passes_completed"), F.col("passes_with_outcome")).alias("pass_completion_pct"),
        "crosses", "interceptions", "tackles", "tackles_won", "defensive_actions", "defensive_actions_with_outcome",
        "defensive_actions_successful", "defensive_actions_outcome_inferred",
        rate(F.col("defensive_actions_successful"), F.col("defensive_actions_with_outcome")).alias("defensive_action_success_pct"),
        "touches_in_defensive_third", "defensive_actions_in_defensive_third", "attempts_beyond_halfway",
        round_half_up(F.col("mean_action_x"), 4).alias("mean_action_x"),
        "attempts_with_position", "sum_start_x_in_defensive_third",
        mirrored.alias("has_mirrored_positions"),
    )
