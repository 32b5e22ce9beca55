"""Typed projections of the nested publisher tables, with their stand-ins for unknown made null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import decode_unicode_escapes, unknown_to_null
from plumbline.sources.readers import SUBSTITUTION


def matches(raw: DataFrame) -> DataFrame:
    winner = F.col("winner")
    return raw.select(
        F.col("wyId").alias("match_id"),
        F.col("competitionId").alias("competition_id"),
        F.col("seasonId").alias("season_id"),
        F.col("roundId").alias("round_id"),
        "gameweek",
        F.expr("try_cast(dateutc as timestamp)").alias("kicked_off_at"),
        "label",
        "venue",
        "status",
        "duration",
        unknown_to_null(winner).alias("published_winner_id"),
        (winner == 0).alias("published_is_draw"),
        F.col("groupName").alias("group_name"),
    )


def match_teams(raw: DataFrame) -> DataFrame:
    """One row for each side of a match."""
    sides = raw.select(F.col("wyId").alias("match_id"), F.explode("teamsData").alias("k", "v"))
    return sides.select(
        "match_id",
        unknown_to_null(F.col("v.teamId")).alias("team_id"),
        unknown_to_null(F.col("v.coachId")).alias("coach_id"),
        F.col("v.side").alias("side"),
        F.col("v.score").alias("goals"),
        F.col("v.scoreHT").alias("goals_half_time"),
        F.col("v.scoreET").alias("goals_extra_time"),
        F.col("v.scoreP").alias("goals_penalties"),
        (F.col("v.hasFormation") == 1).alias("has_formation"),
    )


def lineups(raw: DataFrame) -> DataFrame:
    """Starters and bench as one table; card columns hold the minute, or ``'0'`` for none."""
    sides = raw.select(F.col("wyId").alias("match_id"), F.explode("teamsData").alias("k", "v"))

    def squad(column: str, started: bool) -> DataFrame:
        players = sides.select("match_id", F.col("v.teamId").alias("team_id"), F.explode(f"v.formation.{column}").alias("p"))
        minute = lambda c: unknown_to_null(F.col(c), "0").cast("int")
        return players.select(
            "match_id",
            "team_id",
            unknown_to_null(F.col("p.playerId")).alias("player_id"),
            F.lit(started).alias("started"),
            minute("p.redCards").alias("sent_off_minute"),
            minute("p.yellowCards").alias("booked_minute"),
            unknown_to_null(F.col("p.goals"), "null").cast("int").alias("goals"),
        )

    return squad("lineup", True).unionByName(squad("bench", False))


def substitutions(raw: DataFrame) -> DataFrame:
    """Substitutions from JSON text that is a list, or the word null."""
    sides = raw.select(F.col("wyId").alias("match_id"), F.explode("teamsData").alias("k", "v"))
    listed = sides.where(F.json_array_length("v.formation.substitutions").isNotNull())
    subs = listed.select("match_id", F.col("v.teamId").alias("team_id"), F.explode(F.from_json("v.formation.substitutions", SUBSTITUTION)).alias("s"))
    return subs.select(
        "match_id",
        "team_id",
        unknown_to_null(F.col("s.playerIn")).alias("player_in"),
        unknown_to_null(F.col("s.playerOut")).alias("player_out"),
        F.expr("try_cast(s.minute as int)").alias("minute"),
    )


def match_referees(raw: DataFrame) -> DataFrame:
    each = raw.select(F.col("wyId").alias("match_id"), F.explode("referees").alias("r"))
    return each.select("match_id", unknown_to_null(F.col("r.refereeId")).alias("referee_id"), F.col("r.role").alias("role"))


def people(raw: DataFrame, key: str) -> DataFrame:
    """Coaches, referees or the common part of players."""
    names = [decode_unicode_escapes(F.col(c)).alias(a) for c, a in (("shortName", "short_name"), ("firstName", "first_name"), ("lastName", "last_name"))]
    born = [F.expr("try_cast(birthDate as date)").alias("born_on"), F.col("birthArea.name").alias("birth_area")]
    return raw.select(unknown_to_null(F.col("wyId")).alias(key), *names, *born)


def players(raw: DataFrame) -> DataFrame:
    more = raw.select(
        F.col("wyId").alias("player_id"),
        F.col("role.name").alias("position"),
        F.col("role.code2").alias("position_code"),
        "foot",
        unknown_to_null(F.col("height")).alias("height"),
        unknown_to_null(F.col("weight")).alias("weight"),
        F.expr("try_cast(nullif(currentTeamId, 'null') as bigint)").alias("current_team_id"),
    )
    return people(raw, "player_id").join(more, "player_id")


def places(raw: DataFrame, key: str) -> DataFrame:
    """Teams or competitions: names decoded, area flattened, other columns as they are."""
    rest = [c for c in raw.columns if c not in ("wyId", "area", "name", "officialName")]
    names = [decode_unicode_escapes(F.col(c)).alias(c) for c in ("name", "officialName") if c in raw.columns]
    return raw.select(F.col("wyId").alias(key), *names, *rest, F.col("area.name").alias("area"))


def event_keys(events: DataFrame) -> DataFrame:
    """A child's id names its host (``kind-host``); hosts have plain ids."""
    is_child = F.col("event_id").rlike(r"^[a-z_]+-\d+$")
    return events.withColumn("parent_event_id", F.when(is_child, F.regexp_replace("event_id", r"^[a-z_]+-", "")))


def interception_children(events: DataFrame, tag: int = 1401) -> DataFrame:
    """The events with one more row at each tagged pass or clearance, at its moment, that names it as parent."""
    hosts = events.where(F.array_contains("tags", tag) & F.col("event_type").isin("PASS", "CLEARANCE"))
    children = hosts.withColumn("parent_event_id", F.col("event_id")).withColumn("event_id", F.concat(F.lit("interception-"), "event_id")).withColumn("event_type", F.lit("INTERCEPTION"))
    return events.unionByName(children)
