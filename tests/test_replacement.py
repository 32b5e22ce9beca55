"""Persistent campaigns by replacement equal those by copies of whole histories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.operators import campaign, residuals, scenario
from test_scenario import CAMPAIGN, RECIPES, mart  # noqa: F401


@pytest.mark.parametrize("ratio", [np.nan, 0.3])
def test_leave_each_out_by_brute_force(ratio):
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 6, 9):
        v = rng.integers(0, 5, (20, n)).astype(float)
        v[rng.random(v.shape) < 0.2] = np.nan
        centre, spread, _ = residuals.leave_each_out(v, 2.5, ratio)
        for i, j in np.ndindex(*v.shape):
            others = np.delete(v[i], j)
            others = others[~np.isnan(others)]
            if np.isnan(v[i, j]) or not len(others):
                assert np.isnan(centre[i, j])
                continue
            w = 1.0 if np.isnan(ratio) else ratio * len(others) / (ratio * len(others) + 1)
            c = np.median(others) if w == 1 else w * np.median(others) + (1 - w) * 2.5
            assert centre[i, j] == pytest.approx(c) and spread[i, j] == pytest.approx(np.median(np.abs(others - c)))


@pytest.fixture(scope="module")
def both(spark, mart):  # noqa: F811
    # One player holds a third of all rows.
    hot = mart.where("player_id < 'p12'").withColumns({"match_id": F.concat("player_id", "match_id"), "player_id": F.lit("hot"), "position_code": F.lit("DF")})
    rows = mart.unionByName(hot)
    assert rows.where("player_id = 'hot'").count() >= 0.33 * rows.count()
    clean = campaign.Clean(rows, CAMPAIGN)
    targets = clean.targets(("max",)).select("player_id", "match_id")
    changed = scenario.inject(rows, targets, RECIPES, CAMPAIGN, clean.scored).where("bit").cache()
    return rows, clean, changed


def records(df):
    keys = ["player_id", "match_id", "target", "recipe", "severity"]
    scores = ["max", "mahalanobis", "mahalanobis_res", "z_pass_completion_pct", "z_mean_action_x"]
    return df.select(*keys, *scores).toPandas().sort_values(keys, ignore_index=True)


def test_equals_copies_of_whole_histories(both):
    rows, clean, changed = both
    want, got = records(campaign._rescored_copies(clean, rows, changed)), records(campaign._rescored_history(clean, rows, changed))
    assert len(got) == len(want) > 500
    for c in want.columns:
        if want[c].dtype == float:
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-6, atol=1e-8, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all()


def test_histories_are_never_made_long(both):
    """One row leaves the tasks for each row and condition, with its changed values; small entities don't meet in a few tasks because they are few bytes."""
    rows, clean, changed = both
    condition = ["target", "recipe", "severity"]
    named = residuals.derived(changed.withColumn("target", F.col("match_id")), CAMPAIGN)
    found = residuals.replaced(clean.rows, named, clean.fitted, condition, CAMPAIGN)
    each = clean.rows.where("is_scoreable").groupBy("player_id").count()
    assert found.rdd.getNumPartitions() >= 4
    assert found.count() == named.join(each, "player_id").agg(F.sum("count")).first()[0]
    met = found.where("match_id = target").join(named.select("player_id", *condition, F.col("passes_per_90").alias("want")), ["player_id", *condition])
    assert met.count() == named.join(clean.rows.where("is_scoreable"), ["player_id", "match_id"], "left_semi").count() == met.where("passes_per_90 <=> want").count()


def test_large_entities_go_by_copies(both):
    """A player above the bound doesn't meet in one task, and its records are the same."""
    rows, clean, changed = both
    few = changed.where("player_id IN ('hot', 'p01', 'p02')")
    all_, split = records(campaign._rescored_history(clean, rows, few)), records(campaign._rescored_history(clean, rows, few, bound=100))
    assert np.allclose(all_["max"].to_numpy(float), split["max"].to_numpy(float), equal_nan=True) and (all_["player_id"] == split["player_id"]).all()
    assert Settings().metrics == CAMPAIGN.metrics
