"""Readers with explicit schemas, and the registry of named sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The publisher's file layouts.
PERSON = "wyId bigint, shortName string, firstName string, lastName string, birthDate string, birthArea struct<name:string>"
PLAYER = PERSON + ", role struct<name:string,code2:string,code3:string>, foot string, height int, weight int, currentTeamId string"
SQUAD = "array<struct<playerId:bigint,redCards:string,yellowCards:string,goals:string>>"
SIDE = (
    "struct<teamId:bigint,side:string,coachId:bigint,score:int,scoreHT:int,scoreET:int,scoreP:int,hasFormation:int,"
    f"formation:struct<lineup:{SQUAD},bench:{SQUAD},substitutions:string>>"
)
MATCH = (
    "wyId bigint, competitionId bigint, seasonId bigint, roundId bigint, gameweek int, dateutc string, label string, venue string, status string, "
    f"duration string, winner bigint, groupName string, referees array<struct<refereeId:bigint,role:string>>, teamsData map<string,{SIDE}>"
)
TEAM = "wyId bigint, name string, officialName string, city string, type string, area struct<name:string>"
COMPETITION = "wyId bigint, name string, format string, type string, area struct<name:string>"
SUBSTITUTION = "array<struct<playerIn:bigint,playerOut:bigint,minute:string>>"
RAW_EVENT = (
    "struct<id:bigint,eventId:int,eventName:string,subEventId:string,subEventName:string,matchId:bigint,matchPeriod:string,eventSec:double,"
    "playerId:bigint,teamId:bigint,positions:array<struct<x:double,y:double>>,tags:array<struct<id:int>>>"
)
RAW_MATCH = f"events array<{RAW_EVENT}>, players map<string,array<struct<player:string>>>"
PERIODS = {"1H": 1, "2H": 2, "E1": 3, "E2": 4, "P": 5}


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array per file, or many files by a glob; fields that a file lacks are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def event_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files whose column sets may differ."""
    return spark.read.option("mergeSchema", True).parquet(path)


def lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def raw_events(matches: DataFrame) -> DataFrame:
    """Events of raw match files with their place in the file; blank sub-events are null, tags are plain numbers without nulls."""
    placed = matches.select(F.posexplode("events").alias("source_index", "e"))
    period = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])
    first, last = F.get("e.positions", F.lit(0)), F.get("e.positions", F.lit(1))
    return placed.select(
        F.col("e.id").cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("parent_event_id"),
        F.col("e.matchId").cast("string").alias("match_id"),
        F.nullif(F.col("e.teamId"), F.lit(0)).cast("string").alias("team_id"),
        F.nullif(F.col("e.playerId"), F.lit(0)).cast("string").alias("player_id"),
        F.try_element_at(period, F.col("e.matchPeriod")).alias("period_id"),
        F.col("e.eventSec").alias("seconds_into_period"),
        F.col("e.eventName").alias("event_name"),
        F.expr("try_cast(e.subEventId as int)").alias("subevent_id"),
        (first["x"] / 100).alias("start_x"),
        (first["y"] / 100).alias("start_y"),
        (last["x"] / 100).alias("end_x"),
        (last["y"] / 100).alias("end_y"),
        F.filter(F.transform("e.tags", lambda t: t["id"]), lambda t: t.isNotNull()).alias("tags"),
        "source_index",
    )


def acting_frame(events: DataFrame, attacks_left: F.Column) -> DataFrame:
    """Places turned so that the acting team always attacks to the right: where it attacks left, both axes are mirrored. Unknown places stay so."""
    axes = [c for c in ("start_x", "start_y", "end_x", "end_y") if c in events.columns]
    return events.withColumns({c: F.when(F.coalesce(attacks_left, F.lit(False)), 1.0 - F.col(c)).otherwise(F.col(c)) for c in axes})


def qualifiers(**kinds: str) -> F.Column:
    """``Kind:VALUE`` texts of the columns that hold a value."""
    parts = [F.concat(F.lit(f"{kind}:"), F.col(column).cast("string")) for kind, column in kinds.items()]
    return F.filter(F.array(*parts), lambda x: x.isNotNull() & ~x.endswith(":false"))


def roster(matches: DataFrame) -> DataFrame:
    """Entries of the players map, without the null ones that some files hold."""
    teams = matches.select(F.explode("players").alias("team_id", "entries"))
    return teams.select("team_id", F.explode(F.filter("entries", lambda e: e.isNotNull())).alias("entry"))


def repaired_records(files: DataFrame, schema: str) -> DataFrame:
    """Whole records of JSON arrays that may be cut off; ``files`` has ``value``, one text a file.

    A record is an object of the array at the top, whatever it holds; one that the cut has split is left out, and so is a null or empty text.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("value").to_pylist():
                found = list(_top_records(text or ""))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["text"])

    return files.select("value").mapInArrow(whole, "text string").select(F.from_json("text", schema).alias("r")).select("r.*")


def _top_records(text: str) -> Iterator[str]:
    """The texts of an array's objects, as far as each can be decoded."""
    decode, at = json.JSONDecoder().raw_decode, text.find("{")
    while at >= 0:
        try:
            end = decode(text, at)[1]
        except ValueError:
            return
        yield text[at:end]
        at = text.find("{", end)


def payload_report(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``path``, ``content``) against a manifest (``path``, ``bytes``, ``sha256``): altered, missing and extra ones."""
    found = files.select("path", F.length("content").cast("long").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    state = (
        F.when(F.col("sha256").isNull(), "extra")
        .when(F.col("found_sha256").isNull(), "missing")
        .when((F.col("sha256") != F.col("found_sha256")) | (F.col("bytes") != F.col("found_bytes")), "altered")
    )
    return manifest.join(found, "path", "full").select("path", state.alias("state")).where(F.col("state").isNotNull())


def field_docs(pages: DataFrame, column: str = "html") -> DataFrame:
    """Field names and descriptions from lists of ``<b>field</b>: text``."""
    items = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<b>\s*([^<]+?)\s*</b>\s*:\s*([^<]+)"), F.lit(0))
    item = F.explode(items).alias("item")
    return pages.select("*", item).select(
        *[c for c in pages.columns if c != column],
        F.regexp_extract("item", r"<b>\s*([^<]+?)\s*</b>", 1).alias("field"),
        F.trim(F.regexp_extract("item", r"(?s)</b>\s*:\s*([^<]+)", 1)).alias("description"),
    )


@dataclass(frozen=True)
class Source:
    """A named source: how its tables are read."""

    name: str
    tables: dict[str, Callable[[SparkSession, str], DataFrame]]
    default: bool = True


class Registry:
    """Sources by name; ``resolve`` takes names, nothing (the default ones) or ``all``."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def register(self, source: Source) -> Source:
        if source.name in self._sources:
            raise ValueError(f"source {source.name!r} is registered already")
        self._sources[source.name] = source
        return source

    def resolve(self, *names: str) -> list[Source]:
        if names == ("all",):
            return list(self._sources.values())
        if unknown := [n for n in names if n not in self._sources]:
            raise KeyError(f"no source {', '.join(unknown)}; there are {', '.join(self._sources) or 'none'}")
        return [self._sources[n] for n in names] if names else [s for s in self._sources.values() if s.default]


SOURCES = Registry()
register_source = SOURCES.register
