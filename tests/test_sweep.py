"""The registered sweep does all of the method: every set, every severity, every scorer."""

import inspect

from plumbline.config import DEFAULT, Settings
from plumbline.operators import campaign
from plumbline.plans import score_queries
from test_scenario import RECIPES, mart  # noqa: F401


def test_the_query_sweeps_everything(monkeypatch):
    seen, real = [], inspect.signature(campaign.sweep)
    monkeypatch.setattr(score_queries, "_written_mart", lambda *a: None)
    monkeypatch.setattr(score_queries, "_rounded", lambda df: df)
    monkeypatch.setattr(campaign, "sweep", lambda *a, **b: seen.append(real.bind(*a, **b)))
    score_queries.feature_sweep(None, "")
    seen[0].apply_defaults()
    given, every = seen[0].arguments, campaign.arms(list(DEFAULT.metrics))
    assert given["forest"] and given["settings"].severities == DEFAULT.severities and given["settings"].metrics == DEFAULT.metrics
    assert (given["chosen"] or every) == every and len(every) == 7


def test_sets_beside_each_other_equal_sets_alone(spark, mart):  # noqa: F811
    few = Settings(min_matches=5, bootstrap_draws=50, severities=(0.0, 3.0), trees=5)
    sets = {"two": ["passes_per_90", "pass_completion_pct"], "three": ["passes_per_90", "pass_completion_pct", "mean_action_x"]}
    recipe = {"pass_completion": RECIPES["pass_completion"]}
    rows = mart.where("player_id < 'p12'").cache()
    order = ["mechanism", "severity", "scorer"]
    found = campaign.sweep(rows, recipe, few, sets).toPandas().round(9)
    assert len(found) == 2 * 2 * len(campaign.SCORERS + campaign.FORESTS)
    alone = campaign.report(rows, recipe, "heldout", few, metrics=sets["three"], forest=True).toPandas().round(9).sort_values(order, ignore_index=True)
    assert found[found["arm"] == "three"].drop(columns=["arm", "metrics"]).sort_values(order, ignore_index=True).equals(alone)
