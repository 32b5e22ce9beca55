"""The engine's tables made from the star-schema test tables, and the same as SQL.

``events`` plays the event log (a day is a match of two halves, a user a player), ``orders`` the score sheet
(an order is a match of a customer), ``lineitem`` the exposure by supplier and quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Settings

#: Metrics of the orders' residuals; one is a true proportion in the lineitem analog.
ORDER_SETTINGS = Settings(metrics=("price",), min_matches=3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged events; every eleventh event is a child of the one before it."""
    e, i, k = table(spark, sf_dir, "events"), F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    child = i % 11 == 10
    kinds = {"click": "PASS", "purchase": "SHOT", "view": "DUEL", "signup": "CLEARANCE", "error": "BALL_OUT"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
    tags = {0: [1801], 1: [1802], 2: [701], 3: [703], 4: [1401, 1801]}
    tag = F.array().cast("array<int>")
    for r, values in tags.items():
        tag = F.when(i % 6 == r, F.array(*map(F.lit, values))).otherwise(tag)
    qualifier = F.when(i % 7 == 1, F.array(F.lit("Duel:SLIDING_TACKLE"))).when(i % 7 == 2, F.array(F.lit("Pass:CROSS"))).otherwise(F.array().cast("array<string>"))
    seconds = (F.hour("ts") % 12) * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select(
        i.cast("string").alias("event_id"),
        F.when(child, (i - 1).cast("string")).alias("parent_event_id"),
        F.date_format("ts", "yyyyMMdd").alias("match_id"),
        (F.col("user_id") % 2).cast("string").alias("team_id"),
        F.when(i % 29 != 0, F.col("user_id").cast("string")).alias("player_id"),
        F.when(F.hour("ts") < 12, 1).otherwise(2).alias("period_id"),
        seconds.cast("double").alias("seconds_into_period"),
        F.when(child, "INTERCEPTION").otherwise(kind).alias("event_type"),
        (F.col("value") > 20).alias("is_successful"),
        (k / 99.0).alias("start_x"),
        F.when(i % 19 != 0, ((k * 7) % 100) / 100.0).alias("end_x"),
        F.when(i % 13 == 0, "GOAL_KICK").when(i % 17 == 0, "CORNER_KICK").alias("set_piece_type"),
        tag.alias("tags"),
        qualifier.alias("qualifiers"),
        (10 + i % 4).cast("int").alias("subevent_id"),
        i.cast("int").alias("source_index"),
    )


EVENTS_SQL = """
    ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 11 = 10 THEN CAST(event_id - 1 AS VARCHAR) END AS parent_event_id,
        strftime(ts, '%Y%m%d') AS match_id, CAST(user_id % 2 AS VARCHAR) AS team_id, CASE WHEN event_id % 29 <> 0 THEN CAST(user_id AS VARCHAR) END AS player_id,
        CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS period_id, CAST((hour(ts) % 12) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS seconds_into_period,
        CASE WHEN event_id % 11 = 10 THEN 'INTERCEPTION' ELSE CASE event_type WHEN 'click' THEN 'PASS' WHEN 'purchase' THEN 'SHOT' WHEN 'view' THEN 'DUEL' WHEN 'signup' THEN 'CLEARANCE' ELSE 'BALL_OUT' END END AS event_type,
        value > 20 AS is_successful, CAST(props ->> '$.k' AS INT) / 99.0::DOUBLE AS start_x,
        CASE WHEN event_id % 19 <> 0 THEN ((CAST(props ->> '$.k' AS INT) * 7) % 100) / 100.0::DOUBLE END AS end_x,
        CASE WHEN event_id % 13 = 0 THEN 'GOAL_KICK' WHEN event_id % 17 = 0 THEN 'CORNER_KICK' END AS set_piece_type,
        CASE event_id % 6 WHEN 0 THEN [1801] WHEN 1 THEN [1802] WHEN 2 THEN [701] WHEN 3 THEN [703] WHEN 4 THEN [1401, 1801] ELSE [] END AS tags,
        CASE event_id % 7 WHEN 1 THEN ['Duel:SLIDING_TACKLE'] WHEN 2 THEN ['Pass:CROSS'] ELSE [] END AS qualifiers,
        CAST(10 + event_id % 4 AS INT) AS subevent_id, CAST(event_id AS INT) AS source_index FROM events)"""

SEQUENCE_SQL = (
    EVENTS_SQL
    + """,
    seq AS (SELECT event_id, lead(CASE WHEN event_type IN ('PASS', 'SHOT', 'CLEARANCE', 'DUEL', 'RECOVERY') THEN team_id END IGNORE NULLS) OVER w AS next_action_team,
        lead(event_type) OVER w AS next_event_type, lead(set_piece_type, 2) OVER w AS restart_type, lead(team_id, 2) OVER w AS restart_team
        FROM ev WHERE parent_event_id IS NULL WINDOW w AS (PARTITION BY match_id, period_id ORDER BY seconds_into_period, source_index)),
    sq AS (SELECT ev.*, h.event_type AS host_event_type, next_action_team, next_event_type, restart_type, restart_team
        FROM ev LEFT JOIN ev h ON h.match_id = ev.match_id AND h.event_id = ev.parent_event_id LEFT JOIN seq ON seq.event_id = ev.event_id)"""
)

ACTIONS_SQL = (
    SEQUENCE_SQL
    + """,
    ct AS (SELECT *, CASE WHEN parent_event_id IS NULL AND subevent_id = 12 THEN 'defensive_duel'
            WHEN parent_event_id IS NULL AND subevent_id = 11 AND list_contains(tags, 1401) THEN 'interception_as_duel'
            WHEN parent_event_id IS NULL AND subevent_id = 11 THEN 'attacking_duel'
            WHEN event_type = 'PASS' AND set_piece_type = 'GOAL_KICK' AND end_x < 0.3 THEN 'goal_kick_short'
            WHEN event_type = 'PASS' AND set_piece_type = 'GOAL_KICK' THEN 'goal_kick_long'
            WHEN event_type = 'PASS' THEN 'pass' WHEN event_type = 'SHOT' THEN 'shot'
            WHEN event_type = 'INTERCEPTION' AND host_event_type = 'PASS' THEN 'interception_as_pass'
            WHEN event_type = 'INTERCEPTION' AND host_event_type = 'CLEARANCE' THEN 'interception_as_clearance'
            WHEN event_type = 'INTERCEPTION' THEN 'interception_as_touch' WHEN event_type = 'CLEARANCE' THEN 'clearance'
            WHEN event_type = 'DUEL' THEN 'duel' WHEN event_type = 'RECOVERY' THEN 'recovery' ELSE lower(event_type) END AS action_type,
        next_action_team = team_id AS retained_possession,
        (list_contains(tags, 1801) AND next_event_type IS DISTINCT FROM 'BALL_OUT')
            OR (next_event_type = 'BALL_OUT' AND NOT (restart_type = 'CORNER_KICK' AND restart_team IS DISTINCT FROM team_id)) AS cleared_danger
        FROM sq WHERE player_id IS NOT NULL),
    ac AS (SELECT *, parent_event_id IS NOT NULL AS is_synthesized, action_type IN ('pass', 'goal_kick_short', 'goal_kick_long') AS is_pass,
        action_type IN ('defensive_duel', 'attacking_duel') AS is_duel,
        CASE WHEN starts_with(action_type, 'interception_as_') THEN 'interception' WHEN action_type IN ('pass', 'goal_kick_short', 'goal_kick_long') THEN 'pass'
            WHEN action_type IN ('defensive_duel', 'attacking_duel') THEN 'duel' ELSE action_type END AS action_group,
        CASE WHEN action_type IN ('defensive_duel', 'attacking_duel') THEN list_contains(tags, 703) WHEN action_type = 'clearance' THEN cleared_danger ELSE list_contains(tags, 1801) END AS recorded_success,
        CASE WHEN action_type IN ('defensive_duel', 'attacking_duel') THEN list_has_any(tags, [701, 702, 703]) WHEN action_type = 'clearance' THEN true ELSE list_has_any(tags, [1801, 1802]) END AS has_recorded_outcome,
        action_type = 'goal_kick_short' AND NOT list_has_any(tags, [1801, 1802]) AND retained_possession IS NOT NULL AS has_inferred_outcome FROM ct),
    cn AS (SELECT match_id, player_id, team_id, action_type, action_group, is_pass, count(*) AS attempts,
        CASE WHEN count(is_successful) > 0 THEN count(*) FILTER (is_successful) END AS successes,
        count(*) FILTER (has_recorded_outcome) AS attempts_with_recorded_outcome, count(*) FILTER (has_recorded_outcome AND recorded_success) AS successes_recorded,
        count(*) FILTER (has_inferred_outcome) AS attempts_with_inferred_outcome, count(*) FILTER (has_inferred_outcome AND retained_possession) AS successes_inferred,
        count(*) FILTER (is_duel AND list_contains(qualifiers, 'Duel:SLIDING_TACKLE')) AS tackles,
        count(*) FILTER (is_duel AND list_contains(qualifiers, 'Duel:SLIDING_TACKLE') AND recorded_success) AS tackles_won,
        count(*) FILTER (list_contains(qualifiers, 'Pass:CROSS')) AS crosses, count(*) FILTER (start_x < 1.0 / 3.0 AND NOT is_synthesized) AS in_defensive_third,
        sum(start_x) FILTER (start_x < 1.0 / 3.0 AND NOT is_synthesized) AS sum_start_x_in_defensive_third, count(*) FILTER (start_x > 0.5 AND NOT is_synthesized) AS attempts_beyond_halfway,
        count(start_x) FILTER (NOT is_synthesized) AS attempts_with_position, avg(start_x) FILTER (NOT is_synthesized) AS mean_start_x
        FROM ac GROUP BY ALL)"""
)


def lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone who was seen on a day; two in three started, and every fifth was sent off at minute 600."""
    seen = events(spark, sf_dir).where("player_id IS NOT NULL").select("match_id", "player_id", "team_id").distinct()
    n = F.col("player_id").cast("int")
    return seen.withColumns({"started": n % 3 != 0, "sent_off_minute": F.when(n % 5 == 0, 600)})


def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench players with an even number came on at minute 300 for the next higher number."""
    bench = lineups(spark, sf_dir).where(~F.col("started") & (F.col("player_id").cast("int") % 2 == 0))
    return bench.select("match_id", "team_id", F.col("player_id").alias("player_in"), (F.col("player_id").cast("int") + 1).cast("string").alias("player_out"), F.lit(300).alias("minute"))


LINEUPS_SQL = """
    lu AS (SELECT DISTINCT match_id, player_id, team_id, CAST(player_id AS INT) % 3 <> 0 AS started, CASE WHEN CAST(player_id AS INT) % 5 = 0 THEN 600 END AS sent_off_minute FROM ev WHERE player_id IS NOT NULL),
    sb AS (SELECT match_id, player_id AS player_in, CAST(CAST(player_id AS INT) + 1 AS VARCHAR) AS player_out, 300 AS minute FROM lu WHERE NOT started AND CAST(player_id AS INT) % 2 = 0)"""

MINUTES_SQL = (
    LINEUPS_SQL
    + """,
    pl AS (SELECT match_id, period_id, max(seconds_into_period) / 60.0::DOUBLE AS period_minutes FROM ev WHERE period_id <= 4 GROUP BY ALL),
    ft AS (SELECT match_id, floor(sum(period_minutes) * 10 + 0.5) / 10 AS full_time FROM pl GROUP BY ALL),
    ps AS (SELECT match_id, period_id, coalesce(sum(period_minutes) OVER (PARTITION BY match_id ORDER BY period_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts_at FROM pl),
    ap AS (SELECT match_id, player_id, min(starts_at + seconds_into_period / 60.0::DOUBLE) AS first_event_minute, max(starts_at + seconds_into_period / 60.0::DOUBLE) AS last_event_minute
        FROM ev JOIN ps USING (match_id, period_id) WHERE player_id IS NOT NULL GROUP BY ALL),
    oo AS (SELECT lu.match_id, lu.player_id, lu.team_id, started, NOT started AND i.minute IS NULL AND first_event_minute IS NOT NULL AS minutes_are_inferred,
        CASE WHEN started THEN 0 ELSE coalesce(i.minute, first_event_minute) END AS came_on,
        CASE WHEN NOT started AND i.minute IS NULL THEN last_event_minute ELSE least(o.minute, sent_off_minute, full_time) END AS went_off
        FROM lu JOIN ft USING (match_id) LEFT JOIN ap USING (match_id, player_id)
        LEFT JOIN sb i ON i.match_id = lu.match_id AND i.player_in = lu.player_id LEFT JOIN sb o ON o.match_id = lu.match_id AND o.player_out = lu.player_id),
    mn AS (SELECT *, bool_or(minutes_are_inferred) OVER (PARTITION BY match_id) AS match_has_missing_substitution, floor(greatest(went_off - came_on, 0) * 10 + 0.5) / 10 AS minutes_played
        FROM oo QUALIFY came_on IS NOT NULL AND NOT (minutes_are_inferred AND went_off <= came_on))"""
)


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, ("GK", "DF", "MD", "FW")))
    seen = events(spark, sf_dir).where("player_id IS NOT NULL").select("player_id").distinct()
    code = F.element_at(codes, F.col("player_id").cast("int") % 4 + 1)
    return seen.select("player_id", F.lower(code).alias("position"), code.alias("position_code"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = events(spark, sf_dir).select("match_id").distinct()
    return day.select("match_id", F.when(F.col("match_id").cast("int") % 7 == 0, "ExtraTime").otherwise("Regular").alias("duration"))


PLAYERS_SQL = """
    pr AS (SELECT DISTINCT player_id, ['GK', 'DF', 'MD', 'FW'][CAST(player_id AS INT) % 4 + 1] AS position_code FROM ev WHERE player_id IS NOT NULL),
    mt AS (SELECT DISTINCT match_id, CASE WHEN CAST(match_id AS INT) % 7 = 0 THEN 'ExtraTime' ELSE 'Regular' END AS duration FROM ev)"""


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of customers in market segments, with their price as the metric."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("double")
    return rows.select(
        F.col("o_custkey").cast("string").alias("player_id"), F.col("o_orderkey").cast("string").alias("match_id"), F.col("c_mktsegment").alias("position_code"),
        F.lit("price").alias("metric"), F.col("o_totalprice").alias("x"), none.alias("k"), none.alias("n"),
    )


ORDERS_SQL = """
    ol AS (SELECT CAST(o_custkey AS VARCHAR) AS player_id, CAST(o_orderkey AS VARCHAR) AS match_id, c_mktsegment AS position_code, o_totalprice AS x
        FROM orders JOIN customer ON o_custkey = c_custkey)"""


def supplier_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a supplier in a quarter: attempts with a recorded outcome (flags A and R) and successes (A)."""
    line, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    place = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("s_suppkey", F.col("r_name").alias("position_code"))
    flag = F.col("l_returnflag")
    quarter = line.groupBy("l_suppkey", F.date_format(F.date_trunc("quarter", "l_shipdate"), "yyyyMMdd").alias("match_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(flag.isin("A", "R"), 1)).cast("double").alias("n"), F.count(F.when(flag == "A", 1)).cast("double").alias("k"), F.sum("l_quantity").alias("quantity")
    )
    return quarter.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").cast("string").alias("player_id"), "match_id", "position_code", F.lit("returned").alias("metric"), (F.col("k") / F.nullif(F.col("n"), F.lit(0.0))).alias("x"), "k", "n", "lines", "quantity"
    )


QUARTERS_SQL = """
    sq AS (SELECT CAST(l_suppkey AS VARCHAR) AS player_id, strftime(date_trunc('quarter', l_shipdate), '%Y%m%d') AS match_id, r_name AS position_code, count(*) AS lines,
        CAST(count(*) FILTER (l_returnflag IN ('A', 'R')) AS DOUBLE) AS n, CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS k, sum(l_quantity) AS quantity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
