"""Queries that apply the data-quality checks and profiles to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import exposure, quality
from plumbline.plans import analogs as A
from plumbline.plans import log_queries
from plumbline.plans.log_queries import MART_SQL, _minutes, fact_mart, match_results


def _holed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which some name no customer and some an unknown one."""
    key = F.col("o_orderkey")
    customer = F.when(key % 97 == 0, F.lit(None)).when(key % 101 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", customer.cast("long").alias("o_custkey"), "o_orderstatus")


_HOLED_SQL = "ho AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN -1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders)"


def not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null(_holed_orders(spark, sf_dir), "o_custkey")


def unique_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique_combination(A.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted_values(_holed_orders(spark, sf_dir), "o_orderstatus", "F", "O")


def relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relationship(_holed_orders(spark, sf_dir), "o_custkey", A.table(spark, sf_dir, "customer"), "c_custkey")


def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    return quality.within(lines, ["l_discount", "l_tax"], 0.01, 0.07)


def same_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = A.events(spark, sf_dir).where("player_id IS NOT NULL")
    return quality.same_grain(fine, fact_mart(spark, sf_dir).where("actions > 1"), "match_id", "player_id")


def exactly_one_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exactly_one_of_each(A.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


def one_value_per(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.one_value_per(A.table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


def only_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir).select("event_id", "set_piece_type", "end_x")
    return quality.only_when(e, F.col("set_piece_type").eqNullSafe(F.lit("GOAL_KICK")), F.col("end_x").isNull()).select("event_id")


def agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.agrees(match_results(spark, sf_dir), "agrees_with_publisher").select("match_id")


def within_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose place lies a little or far outside a narrowed pitch."""
    places = A.events(spark, sf_dir).select("event_id", "start_x", "end_x")
    found = quality.within_tiers(places, ["start_x", "end_x"], 0.1, 0.9)
    return found.select("event_id", "column", F.round("value", 6).alias("value"), "severity")


def mirrored_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mirrored_keepers(fact_mart(spark, sf_dir))


def times_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.times_within(A.events(spark, sf_dir), 60.0, 42_900.0)


def minutes_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = exposure.full_time(exposure.period_lengths(A.events(spark, sf_dir)))
    return quality.minutes_within(_minutes(spark, sf_dir), lengths, -100.0).select("match_id", "player_id", "minutes_played", "full_time")


def team_minutes_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = exposure.full_time(exposure.period_lengths(A.events(spark, sf_dir)))
    found = quality.team_minutes_within(_minutes(spark, sf_dir), lengths, 40)
    return found.select("match_id", "team_id", F.round("team_minutes", 3).alias("team_minutes"), "full_time")


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the approximate count, whose sketch other engines don't share."""
    return quality.column_profile(_holed_orders(spark, sf_dir), "orders").drop("distinct_approx")


def relationship_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relationship_profile(A.table(spark, sf_dir, "customer"), "c_custkey", _holed_orders(spark, sf_dir), "o_custkey")


def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the above on orders as one report."""
    orders = _holed_orders(spark, sf_dir)
    return quality.run(
        [
            quality.Check("customer set", quality.not_null(orders, "o_custkey"), "warn"),
            quality.Check("order unique", quality.unique_combination(orders, "o_orderkey")),
            quality.Check("customer known", quality.relationship(orders, "o_custkey", A.table(spark, sf_dir, "customer"), "c_custkey")),
            quality.Check("some orders", quality.not_empty(orders)),
        ]
    )


QUERIES = {
    f"check_{f.__name__.removeprefix('check_')}": f
    for f in (
        not_null, unique_combination, accepted_values, relationship, within, same_grain, exactly_one_of_each, one_value_per, only_when, agrees, within_tiers, mirrored_keepers,
        times_within, minutes_within, team_minutes_within, column_profile, relationship_profile, check_report,
    )
}

ORACLE_SQL = {
    "check_not_null": f"WITH {_HOLED_SQL} SELECT * FROM ho WHERE o_custkey IS NULL",
    "check_unique_combination": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "check_accepted_values": f"WITH {_HOLED_SQL} SELECT * FROM ho WHERE o_orderstatus NOT IN ('F', 'O')",
    "check_relationship": f"WITH {_HOLED_SQL} SELECT * FROM ho WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "check_within": """SELECT l_orderkey, l_linenumber, l_partkey, c AS "column", v AS value FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['l_discount', 'l_tax']) AS c, unnest([l_discount, l_tax]) AS v FROM lineitem)
        WHERE v < 0.01 - 1e-9 OR v > 0.07 + 1e-9""",
    "check_same_grain": f"""WITH {MART_SQL}, f AS (SELECT count(*) AS fine_rows, count(DISTINCT (match_id, player_id)) AS fine_keys FROM ev WHERE player_id IS NOT NULL),
        m AS (SELECT count(*) AS mart_rows, count(DISTINCT (match_id, player_id)) AS mart_keys FROM fm WHERE actions > 1) SELECT * FROM f, m WHERE mart_rows <> mart_keys OR mart_keys <> fine_keys""",
    "check_exactly_one_of_each": """SELECT l_orderkey, flag AS l_returnflag, count(*) FILTER (l_returnflag = flag) AS n_rows FROM lineitem, unnest(['A', 'N', 'R']) AS t(flag)
        GROUP BY ALL HAVING count(*) FILTER (l_returnflag = flag) <> 1""",
    "check_one_value_per": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1",
    "check_only_when": f"WITH {A.EVENTS_SQL} SELECT event_id FROM ev WHERE (set_piece_type IS NOT DISTINCT FROM 'GOAL_KICK') <> (end_x IS NULL)",
    "check_agrees": f"SELECT match_id FROM ({log_queries.ORACLE_SQL['match_results']}) WHERE NOT agrees_with_publisher",
    "check_within_tiers": f"""WITH {A.EVENTS_SQL}, v AS (SELECT event_id, unnest(['start_x', 'end_x']) AS "column", unnest([start_x, end_x]) AS value FROM ev)
        SELECT event_id, "column", round(value, 6) AS value, CASE WHEN value < 0.07 - 1e-9 OR value > 0.93 + 1e-9 THEN 'error' ELSE 'warn' END AS severity FROM v WHERE value < 0.09 - 1e-9 OR value > 0.91 + 1e-9""",
    "check_mirrored_keepers": f"WITH {MART_SQL} SELECT match_id, player_id, attempts_beyond_halfway, actions, round(mean_action_x, 3) AS mean_action_x FROM fm WHERE has_mirrored_positions",
    "check_times_within": f"""WITH {A.EVENTS_SQL} SELECT match_id, period_id, min(seconds_into_period) AS first_at, max(seconds_into_period) AS last_at FROM ev GROUP BY ALL
        HAVING min(seconds_into_period) < 60 OR max(seconds_into_period) > 42900""",
    "check_minutes_within": f"WITH {A.EVENTS_SQL}, {A.MINUTES_SQL} SELECT match_id, player_id, minutes_played, full_time FROM mn JOIN ft USING (match_id) WHERE minutes_played > full_time - 100",
    "check_team_minutes_within": f"""WITH {A.EVENTS_SQL}, {A.MINUTES_SQL} SELECT match_id, team_id, round(sum(minutes_played), 3) AS team_minutes, full_time FROM mn JOIN ft USING (match_id)
        GROUP BY ALL HAVING sum(minutes_played) > 40 * full_time + 1""",
    "check_column_profile": " UNION ALL ".join(
        f"""(WITH {_HOLED_SQL} SELECT 'orders' AS model, count(*) AS n_rows, '{c}' AS "column", count({c}) AS non_null, CAST(0 AS BIGINT) AS escaped FROM ho)""" for c in ("o_orderkey", "o_custkey", "o_orderstatus")
    ),
    "check_relationship_profile": f"""WITH {_HOLED_SQL}, n AS (SELECT c_custkey, count(o_custkey) AS children FROM customer LEFT JOIN ho ON o_custkey = c_custkey GROUP BY ALL)
        SELECT children, count(*) AS parents FROM n GROUP BY ALL""",
    "check_report": f"""WITH {_HOLED_SQL} SELECT 'customer set' AS name, 'warn' AS severity, count(*) AS failing FROM ho WHERE o_custkey IS NULL
        UNION ALL SELECT 'order unique', 'error', count(*) FROM (SELECT o_orderkey FROM ho GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'customer known', 'error', count(*) FROM ho WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'some orders', 'error', CAST(NOT EXISTS (SELECT 1 FROM ho) AS BIGINT)""",
}
