"""Salvage of cut texts over every cut, decoding and turning, buckets without exchanges, sketches by part, the layer rule, counters."""

import json
import warnings

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.engine import Engine, LayerWarning
from plumbline.functions.columns import has_recorded_position
from plumbline.operators import campaign, quality, residuals, scenario
from plumbline.sources import decode, layout, readers, salvage

RECORDS = [
    {"wyId": 1, "name": 'a "quoted", [odd] {name} \\', "tags": [{"id": 1}, {"id": 2}], "who": {"x": 1, "y": [1, 2]}, "n": -1.5e3},
    {"wyId": 2, "name": "é 日本 🙂", "tags": [], "who": None, "n": 20},
    {},
    {"wyId": 34, "tags": [[1, "},{"]], "flag": True},
]


def by_trial(text):
    """Whole values, then the longest beginning of the rest that a brace closes to an object, tried at every comma from the end."""
    whole, at = [], text.find("[") + 1
    if not at:
        return [], False
    decoder = json.JSONDecoder()
    while True:
        while at < len(text) and text[at] in " ,\n\r\t":
            at += 1
        if at >= len(text) or text[at] == "]":
            return whole, False
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        whole.append(value)
    rest = text[at:]
    for end in range(len(rest), 0, -1):
        if rest[end - 1] == ",":
            try:
                return [*whole, json.loads(rest[: end - 1] + "}")], True
            except ValueError:
                continue
    return whole, False


@pytest.mark.parametrize("indent", [None, 1])
def test_salvage_over_every_cut(indent):
    text = "\n " + json.dumps(RECORDS, indent=indent, ensure_ascii=False) + " "
    for cut in range(len(text) + 1):
        found, partial = salvage.salvaged(text[:cut])
        assert ([json.loads(r) for r in found], partial) == by_trial(text[:cut]), text[:cut]


@pytest.mark.parametrize("text", ["", "no array", "[", "[,", '[{"a": 1, "b": tru}, {"a": 2}]', '[{"a": 1, 2: 3}]', '[{"a" 1}]', '[1, 2, "x", nul', '[[1, 2', '[{"a": [1, {"b": 2, "c": 3', '[{"a": "x, y', '[{"a": 1, "a": 2, "b": "\\'])
def test_salvage_of_broken_texts(text):
    found, partial = salvage.salvaged(text)
    assert ([json.loads(r) for r in found], partial) == by_trial(text)


def test_salvage_takes_time_in_proportion_to_the_text():
    """A cut record of very many fields, and of very long ones."""
    many = "[{" + ",".join(f'"f{i}": "x,y"' for i in range(100_000)) + ', "last": "'
    long = '[{"a": "' + "x, " * 1_000_000 + '", "b": "' + "y, " * 1_000_000
    assert len(json.loads(salvage.salvaged(many)[0][0])) == 100_000 and set(json.loads(salvage.salvaged(long)[0][0])) == {"a"}


def test_salvaged_records(spark):
    text = json.dumps(RECORDS)
    files = [("whole", text), ("cut", text[: text.index('"n": 20')]), ("null", None), ("empty", ""), ("same", "[]")]
    found = salvage.salvaged_records(spark.createDataFrame(files, "path string, value string").repartition(2), "wyId long, name string, n double, who struct<x: int>").collect()
    got = {(r["path"], r["place"]): (r["partial"], r["wyId"], r["n"], r["who"] and r["who"]["x"]) for r in found}
    assert got == {("whole", 0): (False, 1, -1500.0, 1), ("whole", 1): (False, 2, 20.0, None), ("whole", 2): (False, None, None, None), ("whole", 3): (False, 34, None, None), ("cut", 0): (False, 1, -1500.0, 1), ("cut", 1): (True, 2, None, None)}


def raw(spark, *events):
    rows = [({"id": i, "eventName": n, "subEventId": s, "matchId": 5, "matchPeriod": p, "eventSec": float(i), "playerId": w, "teamId": t, "positions": [{"x": x, "y": y} for x, y in at], "tags": [{"id": g} for g in tags]}) for i, n, s, p, w, t, at, tags in events]
    return spark.createDataFrame([([rows_ for rows_ in rows], None)], readers.RAW_MATCH)


def test_decoded_events_are_turned_by_their_keepers(spark):
    """Keeper 1 of team 1 stands right in the first half and left in the second; team 2's keeper isn't seen in the first, and goes by the other's."""
    at = lambda x, y: [(x, y), (x + 5.0, y)]
    matches = raw(
        spark,
        (1, "Save", "90", "1H", 1, 1, at(95.0, 50.0), [1801]), (2, "Pass", "80", "1H", 7, 1, at(30.0, 10.0), [1801]), (3, "Pass", " ", "1H", 8, 2, at(40.0, 20.0), [1802, 5]),
        (4, "Save", "90", "2H", 1, 1, at(4.0, 50.0), []), (5, "Pass", "34", "2H", 8, 2, at(40.0, 20.0), [5]), (6, "Odd", None, "2H", 7, 1, [(10.0, 10.0)], []), (7, "Pass", "80", "P", 7, 1, at(30.0, 10.0), []),
    )
    decoder = decode.Decoder({"Pass": "PASS", "Save": "GOALKEEPER"}, {34: "GOAL_KICK"}, (1801,), (1802,), {5: "Pass:CROSS"})
    keepers = spark.createDataFrame([("5", "1"), ("5", "99")], "match_id string, player_id string")
    found = {int(r["event_id"]): r for r in decode.decoded(matches, decoder, keepers).collect()}
    x = {i: (None if r["start_x"] is None else round(r["start_x"], 6)) for i, r in found.items()}
    assert x == {1: None, 2: 0.7, 3: 0.4, 4: None, 5: None, 6: 0.1, 7: 0.3}
    assert [found[i]["event_type"] for i in (1, 2, 6)] == ["GOALKEEPER", "PASS", "GENERIC:odd"] and found[5]["set_piece_type"] == "GOAL_KICK"
    assert [found[i]["is_successful"] for i in (2, 3, 5)] == [True, False, None] and found[3]["qualifiers"] == ["Pass:CROSS"] and found[3]["subevent_id"] is None
    assert round(found[2]["start_y"], 6) == 0.9 and round(found[2]["end_x"], 6) == 0.65
    sides = {(r["period_id"], r["team_id"]): r["attacks_left"] for r in decode.attacking_sides(readers.raw_events(matches), keepers).collect()}
    assert sides == {(1, "1"): True, (1, "2"): False, (2, "1"): False, (2, "2"): True, (5, "1"): None}
    still = {r["event_id"]: r["start_x"] for r in decode.decoded(matches, decoder).collect()}
    given = {r["event_id"]: r["start_x"] for r in decode.decoded(matches, decoder, sides=spark.createDataFrame([("5", 1, "2", True)], "match_id string, period_id int, team_id string, attacks_left boolean")).collect()}
    assert still["3"] == pytest.approx(0.4) and given["3"] == pytest.approx(0.6) and given["2"] == still["2"]


def test_recorded_positions(spark):
    rows = [("PASS", None, 0.1), ("PASS", None, None), ("PASS", "GOAL_KICK", 0.0), ("PASS", "GOAL_KICK", None), ("GOALKEEPER", None, 0.0), ("GENERIC:generic", None, None), ("GENERIC:odd", None, 0.3)]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, event_type string, set_piece_type string, start_x double")
    assert {r["i"] for r in quality.recorded_positions(events).collect()} == {1, 2, 4}
    assert quality.recorded_positions(decode.recorded_places(events)).count() == 1  # a pass that lacks its place stays one
    assert events.where(has_recorded_position(F.col("event_type"), F.col("set_piece_type"))).count() == 3
    assert {"recorded_positions", "all_null_columns", "escaped_columns"} <= set(quality.CHECKS)


def test_bucketed_joins_take_no_exchange(spark, tmp_path):
    """Joins on the bucket's key, and on that and more, and an aggregation on both, run where the buckets lie."""
    keys = spark.range(2000).select((F.col("id") % 40).cast("string").alias("match_id"), (F.col("id") % 97).cast("string").alias("player_id"), F.col("id").alias("v"))
    a = layout.bucketed(keys, "a_table", "match_id", buckets=4, path=str(tmp_path / "a"))
    b = layout.bucketed(keys.dropDuplicates(["match_id", "player_id"]).withColumnRenamed("v", "w"), "b_table", "match_id", buckets=4, path=str(tmp_path / "b"))
    c = layout.bucketed(keys.groupBy("match_id").agg(F.min("v").alias("low")), "c_table", "match_id", buckets=4, path=str(tmp_path / "c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = lambda a, b, c: a.groupBy("match_id", "player_id").agg(F.sum("v").alias("s")).join(b, ["match_id", "player_id"], "left").join(c, "match_id")
        with layout.co_partitioned(spark):
            found = joined(a, b, c)
            assert layout.exchanges(found) == []
            got = {tuple(r) for r in found.collect()}
        assert layout.exchanges(joined(*[spark.read.parquet(str(tmp_path / n)) for n in "abc"]))
        assert got == {tuple(r) for r in joined(keys, keys.dropDuplicates(["match_id", "player_id"]).withColumnRenamed("v", "w"), keys.groupBy("match_id").agg(F.min("v").alias("low"))).collect()} or len(got) == 2000
        assert layout.file_rows(a).count() <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in ("a_table", "b_table", "c_table"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    assert [layout.buckets_for(n) for n in (0, 1, 256 << 20, (256 << 20) + 1, 100 << 40)] == [1, 1, 1, 2, 1 << 19]


def test_sketches_merge_to_the_direct_profile(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.hash("id") % 20_000).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("b"), F.lit(None).cast("double").alias("c"))
    parts = quality.profile_parts(rows, "t", "day")
    assert parts.count() == 7 * 3
    merged = {r["column"]: r for r in quality.merged_profile(parts).collect()}
    direct = {r["column"]: r for r in quality.merged_profile(quality.profile_parts(rows.withColumn("day", F.lit(0)), "t", "day")).collect()}
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in "abc"]).first()
    for c in "abc":
        assert merged[c] == direct[c] and abs(merged[c]["distinct_approx"] - exact[c]) <= max(1, 0.03 * exact[c])
    # A day that comes later is merged in, without the others' rows.
    late = quality.profile_parts(rows.where("day = 6"), "t", "day")
    again = {r["column"]: r for r in quality.merged_profile(parts.where("day <> 6").unionByName(late)).collect()}
    assert again == merged
    assert {r["column"] for r in quality.all_null_columns(quality.merged_profile(parts)).collect()} == {"c"}


def test_layer_rule(spark):
    e = Engine(spark, strict=True)
    e.register("staging", "orders", spark.range(5).withColumnRenamed("id", "k"))
    e.register("intermediate", "half", spark.sql("SELECT k / 2 AS k FROM staging_orders"))
    e.register("marts", "totals", spark.sql("SELECT sum(k) AS s FROM intermediate_half"))
    assert e.query("SELECT s FROM totals").first()["s"] == 5.0 and e.query("SELECT 1 AS x").first()["x"] == 1
    spark.sql("SELECT k + 1 AS k FROM staging_orders").createOrReplaceTempView("handy")
    hidden = [
        "SELECT * FROM staging_orders", "SELECT k FROM handy", "SELECT s FROM totals WHERE s > (SELECT max(k) FROM intermediate_half)", "WITH t AS (SELECT k FROM handy) SELECT count(*) FROM t JOIN t u USING (k)",
        "SELECT s FROM totals WHERE EXISTS (SELECT 1 FROM staging_orders WHERE k = s)",
    ]
    for sql in hidden:
        with pytest.raises(PermissionError, match="staging_orders|intermediate_half"):
            e.query(sql)
    lax = Engine(spark)
    lax._models = e._models
    with pytest.warns(LayerWarning, match="reads staging_orders"):
        assert lax.query("SELECT k FROM handy").count() == 5
    with warnings.catch_warnings():
        warnings.simplefilter("error", LayerWarning)
        lax.query("SELECT s FROM totals").collect()


def test_patched_rows_keep_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0)], "k int, v string, w double")
    changed = spark.createDataFrame([(None, 2, 9.0), ("c", 3, None)], "v string, k int, w double")
    assert {tuple(r) for r in scenario.patched(rows, changed, "k").collect()} == {(1, "a", 1.0), (2, None, 9.0), (3, "c", None)}


def small_mart(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(f"p{i:02}", f"m{j}", "t", "MF", 90.0, 90, j != 0, False, False, 40, 7, *map(float, rng.normal(50, 5, 2)), float(rng.integers(15, 20)), 20.0, float(rng.integers(3, 6)), 6.0, 0.4, 10) for i in range(6) for j in range(7 if i else 1)]
    return spark.createDataFrame(
        rows, "player_id string, match_id string, team_id string, position_code string, minutes_played double, regulation_minutes int, is_eligible boolean, match_has_missing_substitution boolean, has_mirrored_positions boolean, passes int, "
        "defensive_actions int, pass_completion_pct double, defensive_action_success_pct double, passes_completed double, passes_with_outcome double, defensive_actions_successful double, defensive_actions_with_outcome double, mean_action_x double, touches_in_defensive_third int",
    )


def test_counters(spark):
    """A player with one match has the position's centre in every metric; all rows count, whether scoreable or not."""
    seen = Observation()
    s = Settings(bootstrap_draws=20)
    residuals.score(small_mart(spark), settings=s, counters=seen).collect()
    told = seen.get
    assert told["own_rows"] == told["baseline_rows"] == 36 and told["values"] == 36 * 6 and told["position_substituted"] == 6 and 0 < told["binomial_rows"] <= 72


def test_only_the_first_players_are_scored(spark):
    s = Settings(bootstrap_draws=20)
    clean = campaign.Clean(small_mart(spark), s, ["passes_per_90", "pass_completion_pct"], players=2)
    assert {r["player_id"] for r in clean.scores.select("player_id").distinct().collect()} <= {"p00", "p01", "p02"} and clean.scores.select("player_id").distinct().count() == 2
    narrow = clean.seeing(["passes_per_90", "mean_action_x"])
    assert narrow.metrics != clean.metrics and narrow.criteria is clean.criteria and narrow.scores.count() == clean.scores.count()
