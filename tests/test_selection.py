"""Order statistics by rounds of counts against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import selection

SCHEMA = "g string, h long, x double"


def groups(seed=2):
    rng = np.random.default_rng(seed)
    out = {("hot", 1): rng.normal(0, 1, 900), ("ties", None): np.repeat([-2.5, 3.0, 3.0, 1e300], 60), (None, 2): rng.integers(-3, 4, 70).astype(float), ("one", 1): np.array([5.0])}
    out |= {("wide", 3): np.concatenate([-(10.0 ** rng.integers(-300, 300, 90)), [0.0, -0.0, np.inf, -np.inf, 5e-324]]), ("same", 4): np.full(200, -7.25)}
    return out | {(f"s{i}", i): rng.normal(3, 2, int(rng.integers(1, 9))) for i in range(20)}


@pytest.fixture(scope="module")
def rows(spark):
    found = [(*k, float(v)) for k, xs in groups().items() for v in xs] + [("hot", 1, None)] * 5 + [("empty", 9, None)]
    return spark.createDataFrame(found, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("bound", [selection.BOUND, 50, 7, 1])
def test_quantiles(rows, bound):
    got = {(r["g"], r["h"]): (r["m"], r["q"]) for r in selection.quantiles(rows, ["g", "h"], "x", {"m": 0.5, "q": 0.98}, bound).collect()}
    assert got.pop(("empty", 9)) == (None, None)
    for k, xs in groups().items():
        finite = xs[np.isfinite(xs)] if k[0] != "wide" else None
        if finite is None:
            ordered = np.sort(xs)
            assert got[k][0] == ordered[(len(xs) - 1) // 2]
        else:
            assert got[k] == pytest.approx(tuple(np.quantile(xs, [0.5, 0.98])), rel=1e-12)
    assert len(got) == len(groups())


@pytest.mark.parametrize("bound", [selection.BOUND, 20])
def test_around_middle(rows, bound):
    for r in selection.around_middle(rows, ["g", "h"], "x", bound).collect():
        xs = np.sort(groups()[r["g"], r["h"]])
        k = (len(xs) + 1) // 2
        want = [xs[i] if 0 <= i < len(xs) else None for i in (k - 2, k - 1, k)]
        assert r["n"] == len(xs) and [r["before"], r["middle"], r["after"]] == want


@pytest.mark.parametrize("bound", [selection.BOUND, 100])
def test_all_rows_as_one_group(spark, rows, bound):
    xs = np.concatenate([v for k, v in groups().items() if k[0] != "wide"])
    one = rows.where("g is null or g <> 'wide'")
    assert [r["m"] for r in selection.median(one, [], "x", "m", bound).collect()] == [pytest.approx(np.median(xs))]
    assert [r["m"] for r in selection.median(one.where("g = 'empty'"), [], "x", "m", bound).collect()] == [None]


def test_a_large_group_never_meets_in_one_task(spark, monkeypatch):
    """What is sorted of a group of 4,000 at last is an interval of 100 rows at most."""
    tables, write = {}, selection.written
    monkeypatch.setattr(selection, "written", lambda df, name: tables.setdefault(name, []).append(write(df, name)) or tables[name][-1])
    xs = spark.range(4000).select(F.lit("a").alias("g"), F.lit(1).cast("long").alias("h"), F.when(F.col("id") % 4 == 0, 2000.0).otherwise((F.hash("id") % 1000).cast("double")).alias("x"))
    found = selection.quantiles(xs, ["g"], "x", {"m": 0.5, "q": 0.6}, 100).first()
    values = np.array([r["x"] for r in xs.collect()])
    assert [found["m"], found["q"]] == pytest.approx(np.quantile(values, [0.5, 0.6]).tolist())
    assert len(tables["intervals"]) > 1 and tables["intervals"][-1].agg(F.max("n")).first()[0] <= 100 < tables["intervals"][0].agg(F.max("n")).first()[0]
