"""Queries over people and places in the publisher's layout, decoded and turned events, salvaged records, sketches by part, patches and bucketed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evaluation, mart, quality, residuals, scenario, staging
from plumbline.plans import analogs as A
from plumbline.plans import log_queries
from plumbline.plans.check_queries import _HOLED_SQL, _holed_orders
from plumbline.plans.log_queries import _counts, _minutes
from plumbline.sources import decode, layout, readers, salvage


def raw_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the publisher's persons: names with escapes, dates as text of which some aren't dates, 0 and the word null for unknown."""
    c, k = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = lambda v: v.cast("string")
    born = F.when(k % 17 == 0, "0000-00-00").otherwise(F.concat(F.lit("199"), text(k % 10), F.lit("-0"), text(k % 9 + 1), F.lit("-1"), text(k % 10)))
    return c.select(
        F.when(k % 41 == 0, 0).otherwise(k).cast("long").alias("wyId"), F.concat(F.lit("\\u00c1. "), "c_name").alias("shortName"), F.lit("\\u00c1d\\u00e1m").alias("firstName"), F.col("c_name").alias("lastName"),
        born.alias("birthDate"), F.struct(F.col("c_mktsegment").alias("name")).alias("birthArea"),
        F.struct(F.lower("c_mktsegment").alias("name"), F.substring("c_mktsegment", 1, 2).alias("code2"), F.substring("c_mktsegment", 1, 3).alias("code3")).alias("role"),
        F.when(k % 2 == 0, "left").otherwise("right").alias("foot"), F.when(k % 7 == 0, 0).otherwise(150 + k % 50).cast("int").alias("height"), (k % 90).cast("int").alias("weight"),
        F.when(k % 5 == 0, "null").otherwise(text(k % 25)).alias("currentTeamId"),
    )


def staged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staging.people(raw_people(spark, sf_dir), "coach_id")
    return found.withColumn("born_on", F.date_format("born_on", "yyyy-MM-dd"))


def staged_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staging.players(raw_people(spark, sf_dir).where("wyId <> 0"))
    return found.withColumn("born_on", F.date_format("born_on", "yyyy-MM-dd"))


def staged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as teams."""
    s, n = A.table(spark, sf_dir, "supplier"), A.table(spark, sf_dir, "nation")
    raw = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("wyId"), F.concat(F.lit("S\\u00e3o "), "s_name").alias("name"), F.concat(F.lit("\\u00c9toile "), "s_name").alias("officialName"), F.lit("club").alias("type"), F.struct(F.col("n_name").alias("name")).alias("area")
    )
    return staging.places(raw, "team_id")


_ESCAPED = "'S' || chr(227) || 'o ' || s_name"


def recorded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.recorded_places(A.events(spark, sf_dir)).select("event_id", F.round("start_x", 6).alias("start_x"), F.round("end_x", 6).alias("end_x"))


def recorded_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in raw files whose place is there against their kind's habit."""
    return quality.recorded_positions(A.events(spark, sf_dir)).select("event_id", "event_type", "set_piece_type")


_KEEPERS = "user_id % 50 = 7"


def _keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").where(_KEEPERS)
    return e.select(F.date_format("ts", "yyyyMMdd").alias("match_id"), F.col("user_id").cast("string").alias("player_id")).distinct()


def attacking_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way each team plays in each half day, by where its keepers act."""
    return decode.attacking_sides(A.events(spark, sf_dir), _keepers(spark, sf_dir))


def oriented_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all events in the frame of the team that acts."""
    e = A.events(spark, sf_dir)
    return decode.oriented(e, decode.attacking_sides(e, _keepers(spark, sf_dir))).select("event_id", F.round("start_x", 6).alias("start_x"), F.round("end_x", 6).alias("end_x"))


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as raw match files, fifty events of one half day each."""
    e, i = A.table(spark, sf_dir, "events"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    half = F.when(F.hour("ts") < 12, "1H").otherwise("2H")
    event = F.struct(
        i.cast("long").alias("id"), (i % 9).cast("int").alias("eventId"), F.col("event_type").alias("eventName"), F.when(i % 4 == 0, " ").otherwise((i % 4 + 10).cast("string")).alias("subEventId"), F.lit("").alias("subEventName"),
        (F.floor(i / 50) % 400).cast("long").alias("matchId"), half.alias("matchPeriod"), (F.minute("ts") * 60.0).alias("eventSec"), (F.col("user_id") % 30).cast("long").alias("playerId"), (F.col("user_id") % 2 + 1).cast("long").alias("teamId"),
        F.when(i % 8 != 0, F.array(F.struct(k.alias("x"), (100 - k).alias("y")), F.struct((k / 2).alias("x"), k.alias("y")))).otherwise(F.array(F.struct(k.alias("x"), (100 - k).alias("y")))).alias("positions"),
        F.transform(F.when(i % 3 == 0, F.array(F.lit(1801), F.lit(801))).when(i % 3 == 1, F.array(F.lit(1802))).otherwise(F.array().cast("array<int>")), lambda t: F.struct(t.alias("id"))).alias("tags"),
    ).cast(readers.RAW_EVENT)
    files = e.select(F.floor(i / 50).alias("file"), event.alias("event")).groupBy("file").agg(F.array_sort(F.collect_list("event")).alias("events"))  # fifty at most
    return files.select("events", F.lit(None).cast("map<string,array<struct<player:string>>>").alias("players"))


_DECODER = decode.Decoder({"click": "PASS", "purchase": "SHOT", "view": "DUEL", "signup": "CLEARANCE"}, {11: "GOAL_KICK", 13: "CORNER_KICK"}, (1801,), (1802,), {801: "Pass:HIGH"})


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files to staged events, with team 2 said to attack to the left in first halves."""
    sides = A.table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 50) % 400).cast("string").alias("match_id")).distinct().select("match_id", F.lit(1).alias("period_id"), F.lit("2").alias("team_id"), F.lit(True).alias("attacks_left"))
    found = decode.decoded(raw_files(spark, sf_dir), _DECODER, sides=sides)
    return found.select("event_id", "match_id", "team_id", "player_id", "period_id", "event_type", "is_successful", *[F.round(c, 6).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")], "set_piece_type", F.array_join("qualifiers", "|").alias("qualifiers"), "subevent_id")


def salvaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of fifty events each, cut within the last event's value."""
    e = A.table(spark, sf_dir, "events")
    record = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.struct("user_id").alias("who"), F.lit(12345).alias("value")))
    files = e.select(F.floor(F.col("event_id") / 50).alias("file"), F.struct("event_id", record.alias("text")).alias("r")).groupBy("file").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # fifty at most
    text = F.concat(F.lit("[ "), F.array_join(F.transform("rs", lambda r: r["text"]), ", "))
    cut = files.select(F.col("file").cast("string").alias("path"), F.left(text, F.length(text) - 3).alias("value"))
    found = salvage.salvaged_records(cut, "event_id long, kind string, who struct<user_id: long>, value int")
    return found.select("event_id", "kind", F.col("who.user_id").alias("user_id"), "value", "partial", "place")


def strongest_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order that lies furthest from its others."""
    sigma = residuals.leave_one_out_sigma(A.orders_long(spark, sf_dir)).select("player_id", F.round("sigma", 4).alias("sigma"), "match_id")
    return evaluation.strongest(sigma, "sigma", "player_id")


def patched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which every seventh is replaced, its price by none."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    changed = o.where(F.col("o_orderkey") % 7 == 0).withColumns({"price": F.lit(None).cast(o.schema["price"].dataType), "o_orderstatus": F.lit("X")})
    return scenario.patched(o, changed, "o_orderkey")


def empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = _holed_orders(spark, sf_dir).withColumns({"never": F.lit(None).cast("string"), "escaped": F.when(F.col("o_orderkey") % 3 == 0, "a\\u0041").otherwise("b")})
    profile = quality.column_profile(holed, "orders").drop("distinct_approx")
    return quality.all_null_columns(profile).withColumn("fault", F.lit("empty")).unionByName(quality.escaped_columns(profile).withColumn("fault", F.lit("escapes")))


def profile_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile merged from those of the orders' statuses; whether its distinct values are within three errors of the exact ones, since sketches differ between engines."""
    orders = _holed_orders(spark, sf_dir)
    merged = quality.merged_profile(quality.profile_parts(orders, "orders", "o_orderstatus"))
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in ("o_orderkey", "o_custkey")])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in exact.columns])))
    near = F.abs(F.col("distinct_approx") - F.col("exact")) <= F.greatest(F.lit(2.0), 3 * 1.04 / 2 ** (quality.SKETCH_BITS / 2) * F.col("exact"))
    return merged.join(exact, "column").select("column", "n_rows", "non_null", "escaped", "exact", near.alias("near"))


def beta_binomial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tails of each supplier's quarter at its group's rate, with a spread of 0.1."""
    long = A.supplier_quarters(spark, sf_dir)
    rows = long.join(F.broadcast(residuals.position_baselines(long).select("position_code", "metric", "pool_rate")), ["position_code", "metric"]).where("n > 0")
    tails = rows.select("player_id", "match_id", residuals.beta_binomial_tails("k", "n", "pool_rate", F.lit(0.1)).alias("t"))
    return tails.select("player_id", "match_id", F.round("t.lower", 5).alias("lower"), F.round("t.below", 5).alias("below"))


def bucketed_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart from tables in buckets of matches: its aggregation and its joins by match and player take no exchange."""
    import uuid

    tag, n = uuid.uuid4().hex, 8
    counts = layout.bucketed(_counts(spark, sf_dir), f"counts_{tag}", "match_id", buckets=n)
    minutes = layout.bucketed(_minutes(spark, sf_dir), f"minutes_{tag}", "match_id", buckets=n)
    days = layout.bucketed(A.matches(spark, sf_dir), f"days_{tag}", "match_id", buckets=n)
    with layout.co_partitioned(spark):
        found = mart.fact_mart(counts, A.players(spark, sf_dir), minutes, days)
        return found.withColumn("sum_start_x_in_defensive_third", F.round("sum_start_x_in_defensive_third", 6))


QUERIES = {
    f.__name__: f
    for f in (
        staged_people, staged_players, staged_places, recorded_places, recorded_positions, attacking_sides, oriented_events, decoded_events, salvaged_records, strongest_deviations, patched_orders, empty_columns,
        profile_by_parts, beta_binomial_tails, bucketed_mart,
    )
}

_PERSON_SQL = """nullif(CASE WHEN c_custkey % 41 = 0 THEN 0 ELSE c_custkey END, 0) AS {key}, chr(193) || '. ' || c_name AS short_name, chr(193) || 'd' || chr(225) || 'm' AS first_name, c_name AS last_name,
    CASE WHEN c_custkey % 17 <> 0 THEN '199' || (c_custkey % 10) || '-0' || (c_custkey % 9 + 1) || '-1' || (c_custkey % 10) END AS born_on, c_mktsegment AS birth_area"""

_RECORDED = "(set_piece_type IS DISTINCT FROM 'GOAL_KICK' AND event_type NOT IN ('GOALKEEPER', 'GENERIC:generic'))"
_SIDES_SQL = """kp AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS match_id, CAST(user_id AS VARCHAR) AS player_id FROM events WHERE user_id % 50 = 7),
    kx AS (SELECT match_id, period_id, team_id, avg(start_x) AS kx FROM ev JOIN kp USING (match_id, player_id) WHERE start_x IS NOT NULL GROUP BY ALL),
    tm AS (SELECT DISTINCT match_id, period_id, team_id FROM ev),
    sd AS (SELECT tm.*, coalesce(a.kx > 0.5, b.kx < 0.5) AS attacks_left FROM tm LEFT JOIN kx a USING (match_id, period_id, team_id)
        LEFT JOIN kx b ON b.match_id = tm.match_id AND b.period_id = tm.period_id AND b.team_id <> tm.team_id)"""

ORACLE_SQL = {
    "bucketed_mart": log_queries.ORACLE_SQL["mart"],
    "staged_people": f"SELECT {_PERSON_SQL.format(key='coach_id')} FROM customer",
    "staged_players": f"""SELECT {_PERSON_SQL.format(key="player_id")}, lower(c_mktsegment) AS position, c_mktsegment[1:2] AS position_code, CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS foot,
        CASE WHEN c_custkey % 7 <> 0 THEN CAST(150 + c_custkey % 50 AS INT) END AS height, nullif(CAST(c_custkey % 90 AS INT), 0) AS weight, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 25 END AS current_team_id FROM customer WHERE c_custkey % 41 <> 0""",
    "staged_places": f"SELECT s_suppkey AS team_id, {_ESCAPED} AS name, chr(201) || 'toile ' || s_name AS officialName, 'club' AS type, n_name AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "recorded_places": f"WITH {A.EVENTS_SQL} SELECT event_id, CASE WHEN {_RECORDED} THEN round(start_x, 6) END AS start_x, CASE WHEN {_RECORDED} THEN round(end_x, 6) END AS end_x FROM ev",
    "recorded_positions": f"WITH {A.EVENTS_SQL} SELECT event_id, event_type, set_piece_type FROM ev WHERE {_RECORDED} = (start_x IS NULL)",
    "attacking_sides": f"WITH {A.EVENTS_SQL}, {_SIDES_SQL} SELECT match_id, period_id, team_id, attacks_left FROM sd",
    "oriented_events": f"""WITH {A.EVENTS_SQL}, {_SIDES_SQL} SELECT event_id, round(CASE WHEN coalesce(attacks_left, false) THEN 1 - start_x ELSE start_x END, 6) AS start_x, round(CASE WHEN coalesce(attacks_left, false) THEN 1 - end_x ELSE end_x END, 6) AS end_x
        FROM ev LEFT JOIN sd USING (match_id, period_id, team_id)""",
    "decoded_events": """WITH r AS (SELECT *, CAST(props ->> '$.k' AS DOUBLE) AS k, user_id % 2 = 1 AND hour(ts) < 12 AS turned, event_id % 4 + 10 AS sub FROM events),
        p AS (SELECT *, k / 100 AS sx, (100 - k) / 100 AS sy, CASE WHEN event_id % 8 <> 0 THEN k / 200 END AS ex, CASE WHEN event_id % 8 <> 0 THEN k / 100 END AS ey, event_id % 4 <> 1 AND event_type <> 'generic' AS ok FROM r)
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST((event_id // 50) % 400 AS VARCHAR) AS match_id, CAST(user_id % 2 + 1 AS VARCHAR) AS team_id, CAST(nullif(user_id % 30, 0) AS VARCHAR) AS player_id, CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS period_id,
            CASE event_type WHEN 'click' THEN 'PASS' WHEN 'purchase' THEN 'SHOT' WHEN 'view' THEN 'DUEL' WHEN 'signup' THEN 'CLEARANCE' ELSE 'GENERIC:' || lower(event_type) END AS event_type,
            CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_successful, CASE WHEN ok THEN round(CASE WHEN turned THEN 1 - sx ELSE sx END, 6) END AS start_x, CASE WHEN ok THEN round(CASE WHEN turned THEN 1 - sy ELSE sy END, 6) END AS start_y,
            CASE WHEN ok THEN round(CASE WHEN turned THEN 1 - ex ELSE ex END, 6) END AS end_x, CASE WHEN ok THEN round(CASE WHEN turned THEN 1 - ey ELSE ey END, 6) END AS end_y,
            CASE event_id % 4 WHEN 1 THEN 'GOAL_KICK' WHEN 3 THEN 'CORNER_KICK' END AS set_piece_type, CASE WHEN event_id % 3 = 0 THEN 'Pass:HIGH' ELSE '' END AS qualifiers, CASE WHEN event_id % 4 <> 0 THEN CAST(sub AS INT) END AS subevent_id FROM p""",
    "salvaged_records": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS place, event_id = max(event_id) OVER (PARTITION BY event_id // 50) AS partial FROM events)
        SELECT event_id, event_type AS kind, user_id, CASE WHEN NOT partial THEN CAST(12345 AS INT) END AS value, partial, place FROM e""",
    "strongest_deviations": f"""WITH {A.ORDERS_SQL}, lo AS (SELECT a.player_id, a.match_id, a.x, count(b.x) AS n, avg(b.x) AS m, stddev_samp(b.x) AS sd FROM ol a JOIN ol b ON a.player_id = b.player_id AND a.match_id <> b.match_id GROUP BY ALL),
        sg AS (SELECT player_id, match_id, round((x - m) / sd, 4) AS sigma FROM lo WHERE n >= 2 AND sd * sd > 1e-12)
        SELECT player_id, sigma, match_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY abs(sigma) DESC, sigma DESC, match_id DESC) AS i FROM sg) WHERE i = 1""",
    "patched_orders": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "empty_columns": """SELECT 'orders' AS model, count(*) AS n_rows, 'never' AS "column", CAST(0 AS BIGINT) AS non_null, CAST(0 AS BIGINT) AS escaped, 'empty' AS fault FROM orders
        UNION ALL SELECT 'orders', count(*), 'escaped', count(*), count(*) FILTER (o_orderkey % 3 = 0), 'escapes' FROM orders""",
    "profile_by_parts": " UNION ALL ".join(
        f"""(WITH {_HOLED_SQL} SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS non_null, CAST(0 AS BIGINT) AS escaped, count(DISTINCT {c}) AS exact, true AS near FROM ho)""" for c in ("o_orderkey", "o_custkey")
    ),
    "beta_binomial_tails": f"""WITH {A.QUARTERS_SQL}, pr AS (SELECT position_code, sum(k) / sum(n) AS p FROM sq GROUP BY ALL), q AS (SELECT player_id, match_id, k, n, p * 9 AS a, (1 - p) * 9 AS b FROM sq JOIN pr USING (position_code) WHERE n > 0),
        m AS (SELECT player_id, match_id, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + lgamma(i + a) + lgamma(n - i + b) - lgamma(n + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b)) AS mass
            FROM q, unnest(range(0, CAST(k AS BIGINT) + 1)) AS t(i))
        SELECT player_id, match_id, round(sum(mass), 5) AS lower, round(coalesce(sum(mass) FILTER (i < k), 0), 5) AS below FROM m GROUP BY ALL""",
}
