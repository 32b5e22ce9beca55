"""What follows an event in its period, what kind of action it is, and how it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Settings
from plumbline.functions.columns import count_if_any, count_where

# Action names, tags and sub-events.
DELIBERATE = ("PASS", "SHOT", "CLEARANCE", "DUEL", "RECOVERY")
PASSES = ("pass", "goal_kick_short", "goal_kick_long")
DUELS = ("defensive_duel", "attacking_duel")
DEFENSIVE_SUBEVENT, ATTACKING_SUBEVENT = 12, 11
TAG_LOST, TAG_NEUTRAL, TAG_WON, TAG_INTERCEPTION, TAG_ACCURATE, TAG_INACCURATE = 701, 702, 703, 1401, 1801, 1802


def tagged(tag: int) -> Column:
    return F.array_contains("tags", tag)


def sequenced(events: DataFrame) -> DataFrame:
    """Events with their host's type and, for events of their own, what comes next in the period.

    Children share their host's moment and would hide its successor, so they stay out of the windows and get nulls; only they meet their hosts in a
    join, so the other events aren't moved for it.
    """
    own = F.col("parent_event_id").isNull()
    # From the period's end backwards, where what follows an event is what a running frame has seen; a frame that reaches to the end is read anew for each event.
    w = Window.partitionBy("match_id", "period_id").orderBy(F.desc_nulls_last("seconds_into_period"), F.desc_nulls_last("source_index"))
    after = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = {
        "next_action_team": F.last(F.when(F.col("event_type").isin(*DELIBERATE), F.col("team_id")), ignorenulls=True).over(after),
        "next_event_type": F.lag("event_type").over(w),
        "restart_type": F.lag("set_piece_type", 2).over(w),
        "restart_team": F.lag("team_id", 2).over(w),
    }
    windowed = events.where(own).select("*", *[c.alias(n) for n, c in ahead.items()], F.lit(None).cast("string").alias("host_event_type"))
    kinds = {f.name: f.dataType for f in windowed.schema}
    children = events.where(~own).select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in ahead])
    hosts = events.select(F.col("match_id").alias("host_match"), F.col("event_id").alias("host_id"), F.col("event_type").alias("host_event_type"))
    told = children.join(hosts, (F.col("match_id") == F.col("host_match")) & (F.col("parent_event_id") == F.col("host_id")), "left").drop("host_match", "host_id")
    return windowed.unionByName(told)


def action_type(settings: Settings = DEFAULT) -> Column:
    """The leaf kind of an action; the first rule that fits decides."""
    own, kind, sub = F.col("parent_event_id").isNull(), F.col("event_type"), F.col("subevent_id")
    kick = (kind == "PASS") & (F.col("set_piece_type") == "GOAL_KICK")
    rules = [
        (own & (sub == DEFENSIVE_SUBEVENT), "defensive_duel"),
        (own & (sub == ATTACKING_SUBEVENT) & tagged(TAG_INTERCEPTION), "interception_as_duel"),
        (own & (sub == ATTACKING_SUBEVENT), "attacking_duel"),
        (kick & (F.col("end_x") < settings.short_goal_kick_max_x), "goal_kick_short"),
        (kick, "goal_kick_long"),
        (kind == "PASS", "pass"),
        (kind == "SHOT", "shot"),
        ((kind == "INTERCEPTION") & (F.col("host_event_type") == "PASS"), "interception_as_pass"),
        ((kind == "INTERCEPTION") & (F.col("host_event_type") == "CLEARANCE"), "interception_as_clearance"),
        (kind == "INTERCEPTION", "interception_as_touch"),
        (kind == "CLEARANCE", "clearance"),
        (kind == "DUEL", "duel"),
        (kind == "RECOVERY", "recovery"),
    ]
    out = F.when(*_rule(rules[0]))
    for r in rules[1:]:
        out = out.when(*_rule(r))
    return out.otherwise(F.lower(F.replace(kind, F.lit("GENERIC:generic"), F.lit("other"))))


def _rule(r: tuple[Column, str]) -> tuple[Column, Column]:
    return r[0], F.lit(r[1])


def action_group(kind: Column) -> Column:
    return F.when(kind.like("interception_as_%"), "interception").when(kind.isin(*PASSES), "pass").when(kind.isin(*DUELS), "duel").otherwise(kind)


def cleared_danger() -> Column:
    """Whether a clearance held; three-valued, as an unknown restart leaves it unknown."""
    out_next = F.col("next_event_type") == "BALL_OUT"
    conceded = (F.col("restart_type") == "CORNER_KICK") & ~F.col("restart_team").eqNullSafe(F.col("team_id"))
    return (tagged(TAG_ACCURATE) & ~F.col("next_event_type").eqNullSafe(F.lit("BALL_OUT"))) | (out_next & ~conceded)


def actions(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row for each event of a player, with its kind, group, recorded and inferred outcome."""
    kind = F.col("action_type")
    judged = tagged(TAG_ACCURATE) | tagged(TAG_INACCURATE)
    resolved = tagged(TAG_LOST) | tagged(TAG_NEUTRAL) | tagged(TAG_WON)
    found = sequenced(events).where(F.col("player_id").isNotNull())
    found = found.withColumn("action_type", action_type(settings)).withColumn("retained_possession", F.col("next_action_team") == F.col("team_id")).withColumn("cleared_danger", cleared_danger())
    return found.select(
        "*",
        action_group(kind).alias("action_group"),
        F.col("parent_event_id").isNotNull().alias("is_synthesized"),
        kind.isin(*PASSES).alias("is_pass"),
        kind.isin(*DUELS).alias("is_duel"),
        F.when(kind.isin(*DUELS), tagged(TAG_WON)).when(kind == "clearance", F.col("cleared_danger")).otherwise(tagged(TAG_ACCURATE)).alias("recorded_success"),
        F.when(kind.isin(*DUELS), resolved).when(kind == "clearance", True).otherwise(judged).alias("has_recorded_outcome"),
        ((kind == "goal_kick_short") & ~judged & F.col("retained_possession").isNotNull()).alias("has_inferred_outcome"),
    )


def action_counts(actions: DataFrame) -> DataFrame:
    """Counts by match, player, team and kind of action."""
    own, x = ~F.col("is_synthesized"), F.col("start_x")
    tackle = F.col("is_duel") & F.array_contains("qualifiers", "Duel:SLIDING_TACKLE")
    third = own & (x < 1.0 / 3.0)
    return actions.groupBy("match_id", "player_id", "team_id", "action_type", "action_group", "is_pass").agg(
        F.count(F.lit(1)).alias("attempts"),
        count_if_any(F.col("is_successful")).alias("successes"),
        count_where(F.col("has_recorded_outcome")).alias("attempts_with_recorded_outcome"),
        count_where(F.col("has_recorded_outcome") & F.col("recorded_success")).alias("successes_recorded"),
        count_where(F.col("has_inferred_outcome")).alias("attempts_with_inferred_outcome"),
        count_where(F.col("has_inferred_outcome") & F.col("retained_possession")).alias("successes_inferred"),
        count_where(tackle).alias("tackles"),
        count_where(tackle & F.col("recorded_success")).alias("tackles_won"),
        count_where(F.array_contains("qualifiers", "Pass:CROSS")).alias("crosses"),
        count_where(third).alias("in_defensive_third"),
        F.sum(F.when(third, x)).alias("sum_start_x_in_defensive_third"),
        count_where(own & (x > 0.5)).alias("attempts_beyond_halfway"),
        count_where(own & x.isNotNull()).alias("attempts_with_position"),
        F.avg(F.when(own, x)).alias("mean_start_x"),
    )
