"""Queries over the event log: staging, sequences, kinds of action, exposure, results and the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import exposure, mart, sequence
from plumbline.plans import analogs as A

_ACTION_COLUMNS = ("event_id", "match_id", "action_type", "action_group", "is_pass", "is_duel", "is_synthesized", "retained_possession", "cleared_danger", "recorded_success", "has_recorded_outcome", "has_inferred_outcome")
_COUNTS = (
    "attempts", "successes", "attempts_with_recorded_outcome", "successes_recorded", "attempts_with_inferred_outcome", "successes_inferred", "tackles", "tackles_won",
    "crosses", "in_defensive_third", "attempts_beyond_halfway", "attempts_with_position",
)


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir)
    listed = {c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("tags", "qualifiers")}
    return e.withColumns(listed).withColumns({c: F.round(c, 6) for c in ("start_x", "end_x")})


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sequenced(A.events(spark, sf_dir)).select("event_id", "match_id", "host_event_type", "next_action_team", "next_event_type", "restart_type", "restart_team")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.actions(A.events(spark, sf_dir)).select(*_ACTION_COLUMNS)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.action_counts(sequence.actions(A.events(spark, sf_dir)))


def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.round(c, 6).alias(c) for c in ("sum_start_x_in_defensive_third", "mean_start_x")]
    return _counts(spark, sf_dir).select("match_id", "player_id", "team_id", "action_type", "action_group", *_COUNTS, *means)


def period_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = exposure.period_lengths(A.events(spark, sf_dir))
    both = lengths.join(exposure.period_starts(lengths), ["match_id", "period_id"]).join(exposure.full_time(lengths), "match_id")
    return both.select("match_id", "period_id", F.round("period_minutes", 6).alias("period_minutes"), F.round("starts_at", 6).alias("starts_at"), "full_time")


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.minutes_played(A.events(spark, sf_dir), A.lineups(spark, sf_dir), A.substitutions(spark, sf_dir))


def minutes_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minutes(spark, sf_dir).select("match_id", "player_id", "team_id", "started", "minutes_are_inferred", "match_has_missing_substitution", "minutes_played")


def fact_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart that later queries start from."""
    return mart.fact_mart(_counts(spark, sf_dir), A.players(spark, sf_dir), _minutes(spark, sf_dir), A.matches(spark, sf_dir))


def mart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_mart(spark, sf_dir).withColumn("sum_start_x_in_defensive_third", F.round("sum_start_x_in_defensive_third", 6))


def match_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful shots of the two teams as goals; clearances decide extra time, duels penalties."""
    e = A.events(spark, sf_dir)
    scored = lambda kind: F.count(F.when((F.col("event_type") == kind) & F.col("is_successful"), 1))
    sides = e.groupBy("match_id", F.col("team_id").cast("long").alias("team_id")).agg(
        scored("SHOT").alias("goals"), scored("CLEARANCE").alias("goals_extra_time"), scored("DUEL").alias("goals_penalties")
    )
    sides = sides.withColumn("side", F.when(F.col("team_id") == 0, "home").otherwise("away"))
    day = F.col("match_id").cast("int")
    duration = F.when(day % 5 == 0, "ExtraTime").when(day % 5 == 1, "Penalties").otherwise("Regular")
    days = e.select("match_id").distinct().select("match_id", duration.alias("duration"), F.when(day % 3 < 2, (day % 3).cast("long")).alias("published_winner_id"), (day % 3 == 2).alias("published_is_draw"))
    return mart.match_results(days, sides)


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearances by what became of them; unknown stays apart from no."""
    found = sequence.actions(A.events(spark, sf_dir)).where("action_type = 'clearance'")
    return found.groupBy("cleared_danger").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "stage_events": stage_events,
    "sequenced": sequenced,
    "actions": actions,
    "action_counts": action_counts,
    "outcome_counts": outcome_counts,
    "period_clock": period_clock,
    "minutes_played": minutes_played,
    "match_results": match_results,
    "mart": mart_rows,
}

_MART_SQL = (
    A.ACTIONS_SQL
    + ","
    + A.MINUTES_SQL
    + ","
    + A.PLAYERS_SQL
    + """,
    pv AS (SELECT match_id, player_id, team_id, sum(attempts) AS actions, coalesce(sum(attempts) FILTER (is_pass), 0) AS passes,
        coalesce(sum(attempts_with_recorded_outcome + attempts_with_inferred_outcome) FILTER (is_pass), 0) AS passes_with_outcome,
        coalesce(sum(successes_recorded + successes_inferred) FILTER (is_pass), 0) AS passes_completed,
        coalesce(sum(attempts_with_inferred_outcome) FILTER (is_pass), 0) AS passes_outcome_inferred, sum(crosses) AS crosses,
        coalesce(sum(attempts) FILTER (vol), 0) AS defensive_actions, coalesce(sum(attempts_with_recorded_outcome) FILTER (sco), 0) AS defensive_actions_with_outcome,
        coalesce(sum(successes_recorded) FILTER (sco), 0) AS defensive_actions_successful, coalesce(sum(attempts_with_inferred_outcome) FILTER (sco), 0) AS defensive_actions_outcome_inferred,
        coalesce(sum(attempts) FILTER (action_group = 'interception'), 0) AS interceptions, coalesce(sum(tackles), 0) AS tackles, coalesce(sum(tackles_won), 0) AS tackles_won,
        sum(in_defensive_third) AS touches_in_defensive_third, coalesce(sum(in_defensive_third) FILTER (vol), 0) AS defensive_actions_in_defensive_third,
        sum(attempts_beyond_halfway) AS attempts_beyond_halfway, sum(attempts_with_position * mean_start_x) / nullif(sum(attempts_with_position), 0) AS mean_x,
        sum(attempts_with_position) AS attempts_with_position, coalesce(sum(sum_start_x_in_defensive_third), 0) AS mass
        FROM (SELECT *, action_type IN ('defensive_duel', 'clearance') AS sco,
            action_type IN ('defensive_duel', 'clearance', 'interception_as_pass', 'interception_as_touch', 'interception_as_duel') AS vol FROM cn) GROUP BY ALL),
    fm AS (SELECT pv.match_id, pv.player_id, pv.team_id, lower(position_code) AS position, position_code, started, minutes_played, minutes_are_inferred,
        coalesce(match_has_missing_substitution, false) AS match_has_missing_substitution, CASE WHEN duration = 'Regular' THEN 90 ELSE 120 END AS regulation_minutes,
        minutes_played >= 30 AS is_eligible, CAST(actions AS BIGINT) AS actions, CAST(passes AS BIGINT) AS passes, CAST(passes_completed AS BIGINT) AS passes_completed,
        CAST(passes_with_outcome AS BIGINT) AS passes_with_outcome, CAST(passes - passes_with_outcome AS BIGINT) AS passes_unjudged, CAST(passes_outcome_inferred AS BIGINT) AS passes_outcome_inferred,
        floor(passes_completed * 100.0::DOUBLE / nullif(passes_with_outcome, 0) * 100 + 0.5) / 100 AS pass_completion_pct, CAST(crosses AS BIGINT) AS crosses,
        CAST(interceptions AS BIGINT) AS interceptions, CAST(tackles AS BIGINT) AS tackles, CAST(tackles_won AS BIGINT) AS tackles_won, CAST(defensive_actions AS BIGINT) AS defensive_actions,
        CAST(defensive_actions_with_outcome AS BIGINT) AS defensive_actions_with_outcome, CAST(defensive_actions_successful AS BIGINT) AS defensive_actions_successful,
        CAST(defensive_actions_outcome_inferred AS BIGINT) AS defensive_actions_outcome_inferred,
        floor(defensive_actions_successful * 100.0::DOUBLE / nullif(defensive_actions_with_outcome, 0) * 100 + 0.5) / 100 AS defensive_action_success_pct,
        CAST(touches_in_defensive_third AS BIGINT) AS touches_in_defensive_third, CAST(defensive_actions_in_defensive_third AS BIGINT) AS defensive_actions_in_defensive_third,
        CAST(attempts_beyond_halfway AS BIGINT) AS attempts_beyond_halfway, floor(mean_x * 10000 + 0.5) / 10000 AS mean_action_x, CAST(attempts_with_position AS BIGINT) AS attempts_with_position,
        round(CAST(mass AS DOUBLE), 6) AS sum_start_x_in_defensive_third, position_code = 'GK' AND attempts_beyond_halfway >= 4 AS has_mirrored_positions
        FROM pv LEFT JOIN pr USING (player_id) LEFT JOIN mn USING (match_id, player_id) LEFT JOIN mt ON mt.match_id = pv.match_id)"""
)
#: With ``fm``, the mart, for queries that start from it.
MART_SQL = _MART_SQL

ORACLE_SQL = {
    "stage_events": f"""WITH {A.EVENTS_SQL} SELECT * REPLACE (round(start_x, 6) AS start_x, round(end_x, 6) AS end_x, array_to_string(tags, '|') AS tags, array_to_string(qualifiers, '|') AS qualifiers) FROM ev""",
    "sequenced": f"WITH {A.SEQUENCE_SQL} SELECT event_id, match_id, host_event_type, next_action_team, next_event_type, restart_type, restart_team FROM sq",
    "actions": f"WITH {A.ACTIONS_SQL} SELECT {', '.join(_ACTION_COLUMNS)} FROM ac",
    "action_counts": f"""WITH {A.ACTIONS_SQL} SELECT match_id, player_id, team_id, action_type, action_group, {", ".join(_COUNTS)},
        round(sum_start_x_in_defensive_third, 6) AS sum_start_x_in_defensive_third, round(mean_start_x, 6) AS mean_start_x FROM cn""",
    "outcome_counts": f"WITH {A.ACTIONS_SQL} SELECT cleared_danger, count(*) AS n FROM ac WHERE action_type = 'clearance' GROUP BY ALL",
    "period_clock": f"""WITH {A.EVENTS_SQL}, {A.MINUTES_SQL} SELECT match_id, period_id, round(period_minutes, 6) AS period_minutes, round(starts_at, 6) AS starts_at, full_time
        FROM pl JOIN ps USING (match_id, period_id) JOIN ft USING (match_id)""",
    "minutes_played": f"WITH {A.EVENTS_SQL}, {A.MINUTES_SQL} SELECT match_id, player_id, team_id, started, minutes_are_inferred, match_has_missing_substitution, minutes_played FROM mn",
    "match_results": f"""WITH {A.EVENTS_SQL},
        sd AS (SELECT match_id, CAST(team_id AS BIGINT) AS team_id, count(*) FILTER (event_type = 'SHOT' AND is_successful) AS goals, count(*) FILTER (event_type = 'CLEARANCE' AND is_successful) AS et,
            count(*) FILTER (event_type = 'DUEL' AND is_successful) AS pens FROM ev GROUP BY ALL),
        dy AS (SELECT DISTINCT match_id, CASE CAST(match_id AS INT) % 5 WHEN 0 THEN 'ExtraTime' WHEN 1 THEN 'Penalties' ELSE 'Regular' END AS duration,
            CASE WHEN CAST(match_id AS INT) % 3 < 2 THEN CAST(CAST(match_id AS INT) % 3 AS BIGINT) END AS published_winner_id FROM ev),
        duel AS (SELECT match_id, duration, published_winner_id, h.team_id AS home_team_id, a.team_id AS away_team_id, h.goals AS home_goals, a.goals AS away_goals,
            CASE duration WHEN 'Regular' THEN h.goals WHEN 'ExtraTime' THEN h.et ELSE h.pens END AS hd, CASE duration WHEN 'Regular' THEN a.goals WHEN 'ExtraTime' THEN a.et ELSE a.pens END AS ad
            FROM dy LEFT JOIN sd h USING (match_id) LEFT JOIN sd a USING (match_id) WHERE h.team_id = 0 AND a.team_id = 1),
        won AS (SELECT *, CASE WHEN hd > ad THEN home_team_id WHEN ad > hd THEN away_team_id END AS winning_team_id FROM duel)
        SELECT match_id, duration, home_team_id, away_team_id, home_goals, away_goals, winning_team_id, hd = ad AS is_draw, published_winner_id,
            winning_team_id IS NOT DISTINCT FROM published_winner_id AS agrees_with_publisher FROM won""",
    "mart": f"WITH {_MART_SQL} SELECT * FROM fm",
}
