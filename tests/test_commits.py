"""Commits: one winner, exact files, and a cut between any two steps loses nothing."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import stamp
from plumbline.operators.commits import Commit, Conflict, Damaged, Refused, Table


def frame(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")


def test_replace_and_read(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        t.read()
    assert t.replace(frame(spark, "a", None)).number == 1 and t.read().count() == 2
    assert t.replace(frame(spark, "b")).number == 2 and [r["v"] for r in t.read().collect()] == ["b"]
    assert t.read(1).count() == 2  # a reader of the first commit goes on
    assert t.replace(frame(spark)).number == 3 and t.read().count() == 0


def test_exact_keys(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    keys = frame(spark, "x", "y").select("k")
    with pytest.raises(Refused, match="1 keys of k are missing"):
        t.replace(frame(spark, "a"), expected=keys)
    with pytest.raises(Refused, match="1 keys of k are unexpected"):
        t.replace(frame(spark, "a", "b", "c"), expected=keys)
    with pytest.raises(Refused, match="no nulls"):
        t.replace(frame(spark, "a", None), expected=keys, check=lambda df: "no nulls, please" if df.where("v is null").count() else None)
    assert t.last().number == 0 and not [n for n in t._names() if n.startswith("v")]
    assert t.replace(frame(spark, "a", "b"), expected=keys).number == 1


def test_second_writer_is_refused(spark, tmp_path):
    a, b = Table(spark, str(tmp_path / "t")), Table(spark, str(tmp_path / "t"))
    a.replace(frame(spark, "old"))

    def meanwhile(df):
        b.replace(frame(spark, "first"))

    with pytest.raises(Conflict, match="commit 2"):
        a.replace(frame(spark, "second"), check=meanwhile)
    assert [r["v"] for r in a.read().collect()] == ["first"] and a.last().number == 2
    gone = a.clean(keep=1)
    assert len([n for n in gone if n.startswith("v")]) == 2 and [r["v"] for r in a.read().collect()] == ["first"]


STEPS = ["write", "list", "check", "draft", "name"]


@pytest.mark.parametrize("step", STEPS)
def test_cut_between_steps(spark, tmp_path, monkeypatch, step):
    """A run that is cut before a step leaves the old table, the next run goes through, and cleaning removes what was left."""

    class Cut(Exception):
        pass

    def cut(*_, **__):
        raise Cut

    t = Table(spark, str(tmp_path / "t"))
    t.replace(frame(spark, "old"))
    df, check = frame(spark, "new"), None
    with monkeypatch.context() as m:
        if step == "write":
            from pyspark.sql import DataFrameWriter

            m.setattr(DataFrameWriter, "parquet", cut)
        elif step == "list":
            m.setattr(Table, "_read", cut)
        elif step == "check":
            check = cut
        elif step == "draft":
            m.setattr(Table, "_put", cut)
        else:
            m.setattr("plumbline.operators.commits.asdict", cut)  # the draft is there, empty, and has no name
        with pytest.raises(Cut):
            t.replace(df, check=check)
    assert [r["v"] for r in t.read().collect()] == ["old"] and t.last().number == 1
    assert t.replace(df).number == 2 and [r["v"] for r in t.read().collect()] == ["new"]
    t.clean(keep=1)
    assert [n for n in t._names() if n.startswith("v")] == [t.last().folder]


def test_files_that_changed(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    folder = tmp_path / "t" / t.replace(frame(spark, "a", "b").repartition(2)).folder
    (folder / "part-x.parquet").write_bytes(b"?")
    with pytest.raises(Damaged, match="part-x.parquet is unknown"):
        t.read()
    (folder / "part-x.parquet").unlink()
    next(iter(folder.glob("part-*.parquet"))).unlink()
    with pytest.raises(Damaged, match="missing"):
        t.read()


def test_commit_files_are_whole(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.replace(frame(spark, "a"), "s1", {"code": "c"})
    assert Commit(**json.loads((tmp_path / "t" / "commits" / "000000000001.json").read_text())) == t.last()
    assert [p.name for p in (tmp_path / "t" / "commits").iterdir() if not p.name.endswith(".crc")] == ["000000000001.json"]


def test_provenance_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    t = Table(spark, path)
    t.replace(frame(spark, "a"), provenance={"data": "d", "code": "c", "old": "o"})
    found = {r["key"]: (r["recorded"], r["now"]) for r in stamp.provenance_changes(spark, path, {"data": "d", "code": "c2", "new": "n"}).collect()}
    assert found == {"code": ("c", "c2"), "old": ("o", None), "new": (None, "n")}
    (tmp_path / "t" / "commits" / "000000000002.json").write_text("{")
    assert "can't be read" in stamp.stale(spark, path, {"data": "d"})[0]


SCHEMA = "k int, v string, w string, a array<int>"


def both(spark, *rows):
    df = spark.createDataFrame(list(rows), SCHEMA)
    return stamp.content_hash(df, "k"), stamp.ordered_hash(df, "k")


def test_hashes_see_where_nulls_are(spark):
    """Nulls moved between columns, rows, keys and elements change both hashes."""
    base = both(spark, (1, "x", None, [1]), (2, None, "y", None))
    others = [
        ((1, None, "x", [1]), (2, None, "y", None)),
        ((1, "x", None, [1]), (2, "y", None, None)),
        ((1, None, "y", [1]), (2, "x", None, None)),
        ((2, "x", None, [1]), (1, None, "y", None)),
        ((1, "x", None, None), (2, None, "y", [1])),
        ((1, "x", None, [1, None]), (2, None, "y", None)),
        ((1, "x", "", [1]), (2, None, "y", None)),
        ((None, "x", None, [1]), (2, None, "y", None)),
    ]
    for rows in others:
        found = both(spark, *rows)
        assert found[0] != base[0] and found[1] != base[1], rows
    assert both(spark, (1, "x", None, [None, 1]))[0] != both(spark, (1, "x", None, [1, None]))[0]
    assert both(spark, (2, None, "y", None), (1, "x", None, [1])) == base


def test_equal_rows_of_no_column_cancel_nothing(spark):
    df = spark.createDataFrame([(i, None) for i in range(4)], "k int, v string")
    assert stamp.content_hash(df, "k") != stamp.content_hash(df.withColumn("k", F.col("k") + 1), "k")
