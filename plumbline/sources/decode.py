"""From raw match files to staged events: kinds, outcomes and set pieces by tables that are given, places turned to the acting team's frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import has_recorded_position
from plumbline.sources.readers import acting_frame, raw_events

_AXES = ("start_x", "start_y", "end_x", "end_y")


@dataclass(frozen=True)
class Decoder:
    """What raw names and numbers mean. Publishers document these apart from the files, so each is a parameter; what no table names keeps its raw name as ``GENERIC:name``."""

    kinds: dict[str, str] = field(default_factory=dict)
    set_pieces: dict[int, str] = field(default_factory=dict)
    successes: tuple[int, ...] = ()
    failures: tuple[int, ...] = ()
    qualifiers: dict[int, str] = field(default_factory=dict)


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("string")


def _has_any(tags: tuple[int, ...]) -> Column:
    return F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(False)


def attacking_sides(events: DataFrame, keepers: DataFrame) -> DataFrame:
    """``attacks_left`` for each team in each period of a match, from where its keeper (``match_id``, ``player_id``) acts: a keeper stands at the end that the team doesn't attack.

    A team whose keeper has no place in the period goes by the other team's; where neither has, it isn't told.
    """
    by = ["match_id", "period_id"]
    placed = events.where(F.col("start_x").isNotNull()).select(*by, "team_id", "player_id", "start_x")
    own = placed.join(keepers.select("match_id", "player_id").distinct(), ["match_id", "player_id"], "left_semi").groupBy(*by, "team_id").agg(F.avg("start_x").alias("keeper_x"))
    teams = events.where(F.col("team_id").isNotNull()).select(*by, "team_id").distinct()
    other = own.select(*by, F.col("team_id").alias("other_team"), F.col("keeper_x").alias("other_x"))
    both = teams.join(own, [*by, "team_id"], "left").join(other, by, "left").where(F.col("other_team").isNull() | (F.col("other_team") != F.col("team_id")) | F.col("keeper_x").isNotNull())
    away = F.avg(F.when(F.col("other_team") != F.col("team_id"), F.col("other_x")))
    found = both.groupBy(*by, "team_id").agg(F.first("keeper_x").alias("keeper_x"), away.alias("other_x"))
    return found.select(*by, "team_id", F.coalesce(F.col("keeper_x") > 0.5, F.col("other_x") < 0.5).alias("attacks_left"))


def oriented(events: DataFrame, sides: DataFrame) -> DataFrame:
    """Events in the frame of the team that acts; ``sides`` (``match_id``, ``period_id``, ``team_id``, ``attacks_left``) is found by ``attacking_sides`` or given."""
    told = events.join(sides.select("match_id", "period_id", "team_id", "attacks_left"), ["match_id", "period_id", "team_id"], "left")
    return acting_frame(told, F.col("attacks_left")).select(*events.columns)


def recorded_places(events: DataFrame) -> DataFrame:
    """Places only where an event of its kind records one; what stands in for unknown becomes null."""
    known = has_recorded_position(F.col("event_type"), F.col("set_piece_type"))
    return events.withColumns({c: F.when(known, F.col(c)) for c in _AXES if c in events.columns})


def decoded(matches: DataFrame, decoder: Decoder, keepers: DataFrame | None = None, sides: DataFrame | None = None) -> DataFrame:
    """Staged events of raw match files.

    With ``keepers`` or ``sides`` the places are turned; without either they are taken to be in the acting team's frame already.
    """
    raw = raw_events(matches)
    piece = _looked_up(decoder.set_pieces, F.col("subevent_id"))
    kind = F.coalesce(_looked_up(decoder.kinds, F.col("event_name")), F.concat(F.lit("GENERIC:"), F.lower("event_name")))
    success = F.when(_has_any(decoder.successes), True).when(_has_any(decoder.failures), False)
    named = F.transform("tags", lambda t: _looked_up(decoder.qualifiers, t))
    events = raw.select(
        "event_id", "parent_event_id", "match_id", "team_id", "player_id", "period_id", "seconds_into_period", kind.alias("event_type"), success.alias("is_successful"), *_AXES,
        piece.alias("set_piece_type"), "tags", F.filter(named, lambda q: q.isNotNull()).alias("qualifiers"), "subevent_id", "source_index",
    )
    if sides is None and keepers is not None:
        sides = attacking_sides(events, keepers)
    return recorded_places(events if sides is None else oriented(events, sides))
