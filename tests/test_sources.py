"""Readers, staging repairs, checks, stamps and the catalog object on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.engine import Engine
from plumbline.functions.columns import close, decode_unicode_escapes
from plumbline.operators import quality, sequence, staging, stamp
from plumbline.sources import readers
from plumbline.streaming import ingest

EVENT = "event_id string, parent_event_id string, match_id string, period_id int, seconds_into_period double, source_index int, event_type string, set_piece_type string, team_id string"


def log(spark, *events):
    """Events of one match, each (id, host, second, kind, restart, team), in this order."""
    rows = [(i, host, "g", 2, float(second), place, kind, restart, team) for place, (i, host, second, kind, restart, team) in enumerate(events)]
    return {r["event_id"]: r for r in sequence.sequenced(spark.createDataFrame(rows, EVENT)).collect()}


@pytest.mark.parametrize("children", [0, 1, 3])
def test_children_stand_beside_the_sequence(spark, children):
    """A host's successor is the next event of the log, however many children it has; a child knows its host and has no successor."""
    found = log(
        spark,
        ("h", None, 33, "DUEL", None, "x"),
        *((f"c{k}", "h", 33, "INTERCEPTION", None, "y") for k in range(children)),
        ("out", None, 34, "BALL_OUT", None, "x"),
        ("kick", None, 41, "PASS", "GOAL_KICK", "y"),
        ("end", None, 43, "SHOT", None, "y"),
    )
    assert (found["h"]["next_event_type"], found["out"]["next_event_type"], found["kick"]["next_event_type"], found["end"]["next_event_type"]) == ("BALL_OUT", "PASS", "SHOT", None)
    assert found["h"]["restart_type"] == "GOAL_KICK"
    for k in range(children):
        assert found[f"c{k}"]["next_event_type"] is None and found[f"c{k}"]["host_event_type"] == "DUEL"


def test_events_of_one_instant_keep_the_order_of_the_source(spark):
    found = log(spark, ("9", None, 5, "PASS", None, "x"), ("3", None, 5, "DUEL", None, "y"), ("7", None, 5, "CLEARANCE", None, "x"))
    assert [found[i]["next_event_type"] for i in ("9", "3", "7")] == ["DUEL", "CLEARANCE", None]


def test_unicode_escapes(spark):
    df = spark.createDataFrame([("M\\u00fcller",), ("\\u0160\\ud83d\\ude00x",), (None,), ("plain",)], "s string")
    assert [r[0] for r in df.select(decode_unicode_escapes(F.col("s"))).collect()] == ["Müller", "Š😀x", None, "plain"]


def test_raw_events(spark, tmp_path):
    event = {"id": 7, "matchId": 3, "teamId": 1, "playerId": 0, "matchPeriod": "E1", "eventSec": 2.5, "subEventId": "", "eventName": "Pass", "positions": [{"x": 50, "y": 20}], "tags": [{"id": 1801}, None]}
    (tmp_path / "3.json").write_text(json.dumps({"events": [event], "players": {"1": [{"player": "a"}, None]}}))
    raw = readers.json_table(spark, str(tmp_path), readers.RAW_MATCH)
    row = readers.raw_events(raw).first()
    assert (row["event_id"], row["period_id"], row["player_id"], row["subevent_id"], row["tags"], row["start_x"], row["end_x"]) == ("7", 3, None, None, [1801], 0.5, None)
    assert readers.roster(raw).count() == 1


def test_truncated_arrays_give_whole_records(spark):
    """Records hold arrays of objects themselves; a cut may fall inside one."""
    whole = [{"wyId": i, "tags": [{"id": i + k} for k in range(3)], "text": "},{ [ \\" } for i in range(4)]
    text = json.dumps(whole)
    cuts = [text, text[: text.rindex('"text"')], text[:-3], '[{"wyId": 8, "tags": null},', "[", "", None]
    files = spark.createDataFrame([(t,) for t in cuts], "value string")
    found = readers.repaired_records(files, "wyId bigint, tags array<struct<id:bigint>>").collect()
    assert sorted(r["wyId"] for r in found) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 8]
    assert all(r["tags"] is None or [t["id"] for t in r["tags"]] == [r["wyId"] + k for k in range(3)] for r in found)


def test_unreadable_files(spark):
    texts = {"good": '[{"id": 1, "tags": [{"id": 2}]}]', "one": '{"id": 1}', "cut": '[{"id": 1, "tags": [{"id"', "cut one": '{"id": ', "text": "hello", "empty": "", "null": None, "escaped": '{"id": 1, "name": "\\\\u00e9"}'}
    files = spark.createDataFrame(list(texts.items()), "path string, value string")
    found = {r["path"]: (r["broken"], r["escaped"]) for r in quality.unreadable(files, "id long, name string, tags array<struct<id:int>>").collect()}
    assert found == {p: (True, False) for p in ("cut", "cut one", "text", "empty", "null")} | {"escaped": (False, True)}


def test_payload_report(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("x", b"3")], "path string, content binary")
    manifest = spark.createDataFrame([("a", 1, sha(b"1")), ("b", 1, sha(b"9")), ("c", 1, sha(b"3"))], "path string, bytes long, sha256 string")
    assert {(r["path"], r["state"]) for r in readers.payload_report(files, manifest).collect()} == {("b", "altered"), ("c", "missing"), ("x", "extra")}


def test_field_docs(spark):
    pages = spark.createDataFrame([(1, "<ul><li><b>wyId</b>: the id</li><li><b>name</b>: a name</li></ul>"), (2, "none")], "page_id int, html string")
    assert [(r["field"], r["description"]) for r in readers.field_docs(pages).collect()] == [("wyId", "the id"), ("name", "a name")]


def test_registry():
    r = readers.Registry()
    r.register(readers.Source("a", {}))
    r.register(readers.Source("b", {}, default=False))
    assert [s.name for s in r.resolve()] == ["a"] and len(r.resolve("all")) == 2
    with pytest.raises(KeyError, match="no source c"):
        r.resolve("c")


def test_engine_tells_what_is_there(spark, tmp_path):
    e = Engine(spark)
    assert e.publish("m", spark.range(5).withColumnRenamed("id", "k"), str(tmp_path / "m")) == 5
    assert e.mart("m", ["k"]).count() == 5 and e.query("SELECT sum(k) AS s FROM m").first()["s"] == 10
    with pytest.raises(KeyError, match="there are m"):
        e.mart("n")
    with pytest.raises(KeyError, match="no column z"):
        e.mart("m", ["z"])


def test_stamps(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    h = stamp.content_hash(a, "k")
    assert h == stamp.content_hash(a.orderBy(F.desc("k")).repartition(3), "k")
    assert h != stamp.content_hash(a.withColumn("v", F.lit("z")), "k")
    with pytest.raises(ValueError, match="repeat a key"):
        stamp.content_hash(a.union(a), "k")
    stamp.write_stamped(a, str(tmp_path / "t"), h)
    assert stamp.read_stamped(spark, str(tmp_path / "t"), h).count() == 2
    with pytest.raises(ValueError, match="other inputs"):
        stamp.read_stamped(spark, str(tmp_path / "t"), "other")
    # Written again: while the new data are there without their stamp, the old table is read.
    folders = lambda: {p.name for p in (tmp_path / "t").iterdir()}
    before = folders()
    stamp.write_stamped(a.limit(1), str(tmp_path / "t"), "new")
    assert before < folders() and stamp.read_stamped(spark, str(tmp_path / "t"), "new").count() == 1
    with pytest.raises(ValueError, match="other inputs"):
        stamp.read_stamped(spark, str(tmp_path / "t"), h)


def test_ordered_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    h = stamp.ordered_hash(a, "k")
    assert h == stamp.ordered_hash(a.orderBy(F.desc("k")).repartition(3), "k")
    assert h != stamp.ordered_hash(spark.createDataFrame([(1, "y"), (2, "x")], a.schema), "k") and h != stamp.ordered_hash(a.select("v", "k"), "k")


def test_code_hash_takes_no_note_of_prose(tmp_path):
    from types import ModuleType

    def of(text):
        m = ModuleType("m")
        m.__file__ = str(tmp_path / "m.py")
        (tmp_path / "m.py").write_text(text)
        return stamp.code_hash(m)

    assert of("def f(x):\n    return x + 1\n") == of('"""Doc."""\n\ndef f(x):\n    """Other."""\n    # why\n    return x + 1\n') != of("def f(x):\n    return x + 2\n")


def test_provenance_reasons(spark, tmp_path):
    path, now = str(tmp_path / "t"), {"data": "a1", "code": "c1"}
    assert stamp.stale(spark, path, now) == []
    spark.range(1).write.parquet(f"{path}/data")
    assert stamp.stale(spark, path, now) == ["written before provenance was recorded"]
    stamp.write_provenance(spark, path, now)
    assert stamp.stale(spark, path, now) == [] and stamp.stale(spark, path, now | {"code": "c2"}) == ["code: c1 -> c2"]


def test_data_root(monkeypatch):
    from plumbline.config import data_root

    monkeypatch.delenv("PLUMBLINE_DATA", raising=False)
    assert data_root("PLUMBLINE_DATA", None, "/cache/") == "/cache" and data_root("PLUMBLINE_DATA", "/project", "/cache") == "/project"
    monkeypatch.setenv("PLUMBLINE_DATA", "/env")
    assert data_root("PLUMBLINE_DATA", "/project") == "/env"
    monkeypatch.delenv("PLUMBLINE_DATA")
    with pytest.raises(LookupError, match="set PLUMBLINE_DATA"):
        data_root("PLUMBLINE_DATA")


def test_close_numbers(spark):
    rows = [(1.0, 1.0 + 1e-9, True), (1.0, 1.1, False), (None, None, True), (float("nan"), None, True), (None, 1.0, False), (0.0, 1e-9, True), (float("inf"), float("inf"), True)]
    df = spark.createDataFrame(rows, "a double, b double, want boolean")
    assert df.where(close(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_acting_frame(spark):
    df = spark.createDataFrame([(0.25, 0.5, None, True), (0.25, 0.5, 0.9, False), (0.25, 0.5, 0.9, None)], "start_x double, start_y double, end_x double, left boolean")
    assert [tuple(r)[:3] for r in readers.acting_frame(df, F.col("left")).collect()] == [(0.75, 0.5, None), (0.25, 0.5, 0.9), (0.25, 0.5, 0.9)]


def test_tables_of_other_layouts(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(str(tmp_path / "p" / "one.parquet"))
    spark.createDataFrame([(2, 0.5)], "k int, w double").write.parquet(str(tmp_path / "p" / "two.parquet"))
    assert {tuple(r) for r in readers.event_files(spark, str(tmp_path / "p" / "*")).select("k", "v", "w").collect()} == {(1, "a", None), (2, None, 0.5)}
    (tmp_path / "t.csv").write_text("id,name\n7,x\n")
    assert tuple(readers.lookup(spark, str(tmp_path / "t.csv"), "id int, name string").first()) == (7, "x")
    flags = spark.createDataFrame([("CROSS", True), (None, False)], "kind string, late boolean")
    assert [r[0] for r in flags.select(readers.qualifiers(Pass="kind", Late="late")).collect()] == [["Pass:CROSS", "Late:true"], []]


def test_first_failures(spark):
    check = quality.Check("c", spark.range(50).orderBy(F.desc("id")))
    assert [r["id"] for r in quality.first_failures(check, 3).collect()] == [0, 1, 2]


def test_enforce_stops_on_errors_only(spark):
    some, none = spark.range(2), spark.range(0)
    assert quality.enforce([quality.Check("w", some, "warn"), quality.Check("e", none)]).count() == 2
    with pytest.raises(ValueError, match="checks failed: e"):
        quality.enforce([quality.Check("e", some)])


def test_substitutions_guard_text_that_is_no_list(spark, tmp_path):
    side = lambda subs: {"teamId": 1, "side": "home", "formation": {"lineup": [], "bench": [], "substitutions": subs}}
    matches = [{"wyId": 1, "teamsData": {"1": side("null")}}, {"wyId": 2, "teamsData": {"1": side([{"playerIn": 0, "playerOut": 5, "minute": "61"}])}}]
    (tmp_path / "m.json").write_text(json.dumps(matches))
    found = staging.substitutions(readers.json_table(spark, str(tmp_path), readers.MATCH)).collect()
    assert [(r["match_id"], r["player_in"], r["player_out"], r["minute"]) for r in found] == [(2, None, 5, 61)]


def test_each_file_is_ingested_once(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(3).write.parquet(source)
    ingest.append_new_files(spark, source, "id long", table, state)
    spark.range(3, 5).write.mode("append").parquet(source)
    ingest.append_new_files(spark, source, "id long", table, state)
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [0, 1, 2, 3, 4]
