"""Queries over nested and escaped data, made from the orders in the publisher's layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import decode_unicode_escapes
from plumbline.operators import staging
from plumbline.plans import analogs as A

_PLAYER = "struct<playerId:bigint,redCards:string,yellowCards:string,goals:string>"


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a match file: two sides in a map, squads as arrays, substitutions as JSON text or the word null."""
    o = A.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def player(n: int, side: int) -> Column:
        i = (key * 7 + n + side) % 50
        return F.struct(
            i.alias("playerId"),
            F.when((key + n) % 9 == 0, "57").otherwise("0").alias("redCards"),
            F.when((key + n) % 4 == 0, "12").otherwise("0").alias("yellowCards"),
            F.when((key + n) % 3 == 0, "null").otherwise(((key + n) % 3).cast("string")).alias("goals"),
        ).cast(_PLAYER)

    def side(name: str, k: int) -> Column:
        subs = F.concat(F.lit('[{"playerIn":'), (key % 11).cast("string"), F.lit(',"playerOut":'), (key % 13).cast("string"), F.lit(',"minute":"'), (key % 90).cast("string"), F.lit('"}]'))
        formation = F.struct(
            F.array(player(0, k), player(1, k)).alias("lineup"), F.array(player(2, k)).alias("bench"), F.when(key % 2 == k, subs).otherwise("null").alias("substitutions")
        )
        goals = lambda m: ((key + k * 3) % m).cast("int")
        return F.struct(
            (F.col("o_custkey") + k).alias("teamId"), F.lit(name).alias("side"), ((key + k) % 3).alias("coachId"), goals(5).alias("score"), goals(3).alias("scoreHT"),
            goals(7).alias("scoreET"), goals(4).alias("scoreP"), (key % 2).cast("int").alias("hasFormation"), formation.alias("formation"),
        )

    return o.select(
        key.alias("wyId"), (key % 5).alias("competitionId"), (key % 6).alias("seasonId"), (key % 8).alias("roundId"), (key % 38).cast("int").alias("gameweek"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("dateutc"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("venue"), F.lit("Played").alias("status"),
        F.lit("Regular").alias("duration"), (key % 4).alias("winner"), F.lit(None).cast("string").alias("groupName"),
        F.array(*[F.struct(((key + r) % 4).alias("refereeId"), F.lit(name).alias("role")) for r, name in enumerate(("referee", "firstAssistant"))]).alias("referees"),
        F.create_map(F.lit("1"), side("home", 0), F.lit("2"), side("away", 1)).alias("teamsData"),
    )


def staged_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.matches(raw_matches(spark, sf_dir)).withColumn("kicked_off_at", F.date_format("kicked_off_at", "yyyy-MM-dd HH:mm:ss"))


def match_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.match_teams(raw_matches(spark, sf_dir))


def lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.lineups(raw_matches(spark, sf_dir))


def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.substitutions(raw_matches(spark, sf_dir))


def match_referees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.match_referees(raw_matches(spark, sf_dir))


def unicode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with characters as literal escapes."""
    p = A.table(spark, sf_dir, "part")
    escaped = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("M\\u00fcller \\u0160 "), "p_name")).otherwise(F.col("p_name"))
    return p.select("p_partkey", decode_unicode_escapes(escaped).alias("name"))


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of children, which name their host."""
    e = A.table(spark, sf_dir, "events")
    named = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("interception-"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return staging.event_keys(e.select(named.alias("event_id")))


def interception_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each kind there are once tagged ones have a child."""
    return staging.interception_children(A.events(spark, sf_dir)).groupBy("event_type", F.col("parent_event_id").isNotNull().alias("is_child")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "staged_matches": staged_matches,
    "match_teams": match_teams,
    "lineups": lineups,
    "substitutions": substitutions,
    "match_referees": match_referees,
    "unicode_decode": unicode_decode,
    "event_keys": event_keys,
    "interception_children": interception_children,
}

_SIDES = "(SELECT *, unnest([0, 1]) AS k FROM orders)"


def _squad(n: int, started: str) -> str:
    i = f"o_orderkey + {n}"
    return f"""SELECT o_orderkey AS match_id, o_custkey + k AS team_id, nullif((o_orderkey * 7 + {n} + k) % 50, 0) AS player_id, {started} AS started,
        CASE WHEN ({i}) % 9 = 0 THEN 57 END AS sent_off_minute, CASE WHEN ({i}) % 4 = 0 THEN 12 END AS booked_minute, CASE WHEN ({i}) % 3 <> 0 THEN CAST(({i}) % 3 AS INT) END AS goals FROM {_SIDES}"""


ORACLE_SQL = {
    "staged_matches": """SELECT o_orderkey AS match_id, o_orderkey % 5 AS competition_id, o_orderkey % 6 AS season_id, o_orderkey % 8 AS round_id, CAST(o_orderkey % 38 AS INT) AS gameweek,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS kicked_off_at, o_orderpriority AS label, o_orderstatus AS venue, 'Played' AS status, 'Regular' AS duration,
        nullif(o_orderkey % 4, 0) AS published_winner_id, o_orderkey % 4 = 0 AS published_is_draw, CAST(NULL AS VARCHAR) AS group_name FROM orders""",
    "match_teams": f"""SELECT o_orderkey AS match_id, nullif(o_custkey + k, 0) AS team_id, nullif((o_orderkey + k) % 3, 0) AS coach_id, CASE k WHEN 0 THEN 'home' ELSE 'away' END AS side,
        CAST((o_orderkey + k * 3) % 5 AS INT) AS goals, CAST((o_orderkey + k * 3) % 3 AS INT) AS goals_half_time, CAST((o_orderkey + k * 3) % 7 AS INT) AS goals_extra_time,
        CAST((o_orderkey + k * 3) % 4 AS INT) AS goals_penalties, o_orderkey % 2 = 1 AS has_formation FROM {_SIDES}""",
    "lineups": " UNION ALL ".join([_squad(0, "true"), _squad(1, "true"), _squad(2, "false")]),
    "substitutions": f"""SELECT o_orderkey AS match_id, o_custkey + k AS team_id, nullif(o_orderkey % 11, 0) AS player_in, nullif(o_orderkey % 13, 0) AS player_out, CAST(o_orderkey % 90 AS INT) AS minute
        FROM {_SIDES} WHERE o_orderkey % 2 = k""",
    "match_referees": """SELECT o_orderkey AS match_id, nullif((o_orderkey + r) % 4, 0) AS referee_id, CASE r WHEN 0 THEN 'referee' ELSE 'firstAssistant' END AS role
        FROM (SELECT *, unnest([0, 1]) AS r FROM orders)""",
    "unicode_decode": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'M' || chr(252) || 'ller ' || chr(352) || ' ' || p_name ELSE p_name END AS name FROM part",
    "event_keys": """SELECT CASE WHEN event_id % 4 = 0 THEN 'interception-' || event_id ELSE CAST(event_id AS VARCHAR) END AS event_id,
        CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) END AS parent_event_id FROM events""",
    "interception_children": f"""WITH {A.EVENTS_SQL}, kids AS (SELECT event_type, parent_event_id IS NOT NULL AS is_child FROM ev
        UNION ALL SELECT 'INTERCEPTION', true FROM ev WHERE list_contains(tags, 1401) AND event_type IN ('PASS', 'CLEARANCE')) SELECT event_type, is_child, count(*) AS n FROM kids GROUP BY ALL""",
}
