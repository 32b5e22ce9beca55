"""Bootstrap draws, leave-one-out without arrays, and hot entities."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.operators import census, residuals


def planted(spark, rows):
    return spark.createDataFrame(rows, "player_id string, match_id string, position_code string, metric string, x double, k double, n double")


def test_bootstrap_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (3, 4, 9, 40):
        sample = np.sort(rng.integers(0, 6, n).astype(float))
        values, counts = np.unique(sample, return_counts=True)
        draws = np.arange(7, 60, dtype=np.int64)
        taken = sample[residuals.drawn(12345, draws, n)]
        centre = np.median(taken, axis=1)
        want = np.median(np.abs(taken - centre[:, None]), axis=1)
        assert np.allclose(residuals._bootstrap(values, counts, 12345, draws), want)


def test_draws_are_even_and_apart():
    """Picks of many draws are spread as random ones are, and no two draws or picks go together."""
    n, draws = 50, 4000
    picks = residuals.drawn(777, np.arange(draws, dtype=np.int64), n)
    assert picks.min() == 0 and picks.max() == n - 1
    counts = np.bincount(picks.ravel(), minlength=n)
    assert ((counts - draws) ** 2 / draws).sum() < 100  # chi-squared of 49 degrees
    z = (picks - picks.mean()) / picks.std()
    assert np.abs(np.corrcoef(z.T)[np.triu_indices(n, 1)]).max() < 0.08
    assert np.abs(np.corrcoef(z[:200])[np.triu_indices(200, 1)]).max() < 0.7
    means = picks.mean(1)
    assert means.std() == pytest.approx(np.sqrt((n * n - 1) / 12 / n), rel=0.05)


def hot(spark):
    """One entity holds a third of all rows."""
    rng = np.random.default_rng(6)
    rows = [("hot", f"h{j}", "MD", "v", float(np.round(rng.normal(1, 2), 1)), None, None) for j in range(400)]
    rows += [(f"p{i}", f"m{j}", "MD", "v", float(rng.normal(i % 5, 1)), None, None) for i in range(80) for j in range(10)]
    return rows, planted(spark, rows)


@pytest.mark.parametrize("partitions", [1, 8])
def test_hot_entity_spreads_over_blocks(spark, monkeypatch, partitions):
    rows, long = hot(spark)
    s = Settings(bootstrap_draws=60)
    monkeypatch.setattr(residuals, "DRAWN", 2000)
    found = {r["player_id"]: r for r in residuals.bootstrap_spreads(long.repartition(partitions), s, bound=100).collect()}
    assert len(found) == 81
    for name in ("hot", "p3"):
        x = np.sort([r[4] for r in rows if r[0] == name])
        seed = int(hashlib.md5(f"{name}:v".encode()).hexdigest()[:7], 16)
        taken = x[residuals.drawn(seed, np.arange(60, dtype=np.int64), len(x))]
        mads = np.median(np.abs(taken - np.median(taken, axis=1)[:, None]), axis=1)
        assert found[name]["n"] == len(x) and found[name]["mad"] == pytest.approx(np.median(np.abs(x - np.median(x))))
        assert found[name]["v"] == pytest.approx(mads.var(ddof=1))


@pytest.mark.parametrize("bound", [50, 1 << 20])
def test_leave_one_out_of_a_hot_entity(spark, bound):
    rows, long = hot(spark)
    pool = spark.createDataFrame([("MD", "v", 2.0, 0.1)], "position_code string, metric string, pool_median double, ratio double")
    found = residuals.leave_one_out(long, pool, bound).collect()
    assert len(found) == len(rows)
    of = {}
    for r in rows:
        of.setdefault(r[0], []).append((r[1], r[4]))
    for r in found:
        others = np.array([x for m, x in of[r["player_id"]] if m != r["match_id"]])
        w = 0.1 * len(others) / (0.1 * len(others) + 1)
        centre = w * np.median(others) + (1 - w) * 2.0
        assert r["others"] == len(others) and r["centre"] == pytest.approx(centre)
        assert r["mad"] == pytest.approx(np.median(np.abs(others - centre)))


def test_bars_and_flags_above_the_bound(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.exponential(1, 3000), 2)
    rows = spark.createDataFrame([(f"p{i % 7}", f"m{i}", float(v), None if i % 3 else float(v) * 2) for i, v in enumerate(x)], "player_id string, match_id string, a double, b double")
    b = np.array([v * 2 for i, v in enumerate(x) if not i % 3])
    for bound in (100, 1 << 20):
        bars = census.production_bars(rows, ["a", "b"], 0.02, bound).first()
        assert (bars["a"], bars["b"]) == pytest.approx((np.quantile(x, 0.98), np.quantile(b, 0.98)))
    z = rows.select("player_id", "match_id", F.col("a").alias("z_a"), F.lit(1.0).alias("weight_a"), F.col("a").alias("max_abs_z"))
    flagged = [residuals.flag(z, 0.1, Settings(metrics=("a",)), bound).where("is_flagged").count() for bound in (100, 1 << 20)]
    assert flagged == [int((x >= np.quantile(x, 0.9)).sum())] * 2
