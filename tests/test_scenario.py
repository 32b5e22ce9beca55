"""Laws of mechanisms, doses and evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.operators import campaign, census, evaluation, scenario


def rows(n=40, seed=5):
    """Consistent random rows."""
    rng = np.random.default_rng(seed)
    have = rng.integers(0, 15, n).astype(float)
    judged = np.array([rng.integers(0, h + 1) for h in have], float)
    won = np.array([rng.integers(0, j + 1) for j in judged], float)
    third = np.array([rng.integers(0, h + 1) for h in have], float)
    touches = third + rng.integers(0, 12, n)
    placed = touches + (have - third) + rng.integers(0, 20, n)
    tried = rng.integers(0, 45, n).astype(float)
    done = np.array([rng.integers(0, t + 1) for t in tried], float)
    mass = touches * rng.uniform(0, 1 / 3, n)
    mean = np.where(placed > 0, (mass + (placed - touches) * rng.uniform(1 / 3, 1, n)) / np.maximum(placed, 1), np.nan)
    percent = lambda a, b: np.where(b > 0, np.floor(100 * a / np.maximum(b, 1) * 100 + 0.5) / 100, np.nan)
    return {
        "actions": placed + 3, "defensive_actions": have, "defensive_actions_with_outcome": judged, "defensive_actions_successful": won, "defensive_actions_in_defensive_third": third,
        "touches_in_defensive_third": touches, "sum_start_x_in_defensive_third": mass, "attempts_with_position": placed, "mean_action_x": mean, "passes_completed": done,
        "passes_with_outcome": tried, "pass_completion_pct": percent(done, tried), "defensive_action_success_pct": percent(won, judged),
    }


def spread(n, **other):
    sizes = {"pass_completion": 0.08, "defensive_success": 0.15, "defensive_actions": 2.5, "touches_in_defensive_third": 4.0, "defensive_actions_successful": 2.0, "passes_completed": 6.0} | other
    return {k: np.full(n, v) for k, v in sizes.items()}


def injected(k, names, seed=9, table=None, **sizes):
    table = table or rows()
    n = len(table["actions"])
    return table, *scenario.compose(table, spread(n, **sizes), np.full(n, k), names, [f"p{i}|m{i}" for i in range(n)], seed)


@pytest.mark.parametrize("seed", range(25))
def test_doses_keep_the_budget(seed):
    rng = np.random.default_rng(seed)
    caps, budget = rng.uniform(-0.5, 3, (50, 4)), rng.uniform(0, 6, 50)
    doses = scenario.allocate(budget, caps)
    usable = np.maximum(caps, 0)
    assert np.allclose((doses**2).sum(1), np.minimum(budget**2, (usable**2).sum(1)))
    assert (doses <= usable + 1e-12).all()


@pytest.mark.parametrize("name", sorted(scenario.MECHANISMS))
def test_no_dose_changes_nothing(name):
    before, after, _ = injected(0.0, (name,))
    assert all(np.allclose(after[c], before[c], equal_nan=True) for c in before)


@pytest.mark.parametrize("name", [*sorted((n,) for n in scenario.MECHANISMS), scenario.ORDER])
@pytest.mark.parametrize("k", [0.5, 1.0, 3.0, 50.0])
def test_counts_stay_consistent(name, k):
    _, after, _ = injected(k, name)
    low, high = lambda c: after[c], after
    assert (low("defensive_actions_successful") >= 0).all() and (high["defensive_actions_successful"] <= high["defensive_actions_with_outcome"]).all()
    assert (high["defensive_actions_with_outcome"] <= high["defensive_actions"]).all() and (high["defensive_actions_in_defensive_third"] >= 0).all()
    assert (high["defensive_actions_in_defensive_third"] <= high["defensive_actions"]).all() and (high["passes_completed"] >= 0).all()
    known = ~np.isnan(after["mean_action_x"])
    assert ((after["mean_action_x"][known] >= 0) & (after["mean_action_x"][known] <= 1)).all()


def test_draws_depend_on_keys_only():
    table = rows()
    _, all_rows, steps = injected(1.5, ("remove_defensive", "relocate_upfield"))
    half = {c: v[20:] for c, v in table.items()}
    part, part_steps = scenario.compose(half, spread(20), np.full(20, 1.5), ("remove_defensive", "relocate_upfield"), [f"p{i}|m{i}" for i in range(20, 40)], 9)
    assert all(np.allclose(part[c], all_rows[c][20:], equal_nan=True) for c in part)
    assert np.allclose(part_steps["relocate_upfield"].achieved, steps["relocate_upfield"].achieved[20:])


def test_draws_have_the_means_of_their_laws():
    d = scenario.Draws(3, [f"k{i}" for i in range(40_000)])
    full = np.full(40_000, 1.0)
    assert d.rounded(2.3 * full).mean() == pytest.approx(2.3, abs=0.02)
    h = d.hypergeometric(6 * full, 20 * full, 7 * full)
    assert h.mean() == pytest.approx(2.1, abs=0.03) and h.var() == pytest.approx(7 * 0.3 * 0.7 * 13 / 19, rel=0.05) and h.max() <= 6
    b = d.binomial(12 * full, 0.25 * full)
    assert b.mean() == pytest.approx(3, abs=0.04) and b.var() == pytest.approx(2.25, rel=0.05)


def test_one_step_takes_what_another_cannot_deliver():
    """Where removal leaves nothing to relabel, the budget goes to the channels after it, by the row as removal left it."""
    few = {c: np.repeat(v[:1], 3) for c, v in rows(1, 2).items()} | {
        "defensive_actions": np.full(3, 4.0), "defensive_actions_with_outcome": np.full(3, 4.0), "defensive_actions_successful": np.full(3, 4.0), "defensive_actions_in_defensive_third": np.full(3, 2.0),
        "passes_completed": np.full(3, 40.0), "passes_with_outcome": np.full(3, 44.0),
    }
    _, after, steps = injected(4.0, ("remove_defensive", "defensive_success", "pass_completion"), table=few, defensive_actions=1.0)
    total = sum(s.allocated**2 for s in steps.values())
    left = after["defensive_actions_with_outcome"]
    assert (steps["defensive_success"].allocated[left == 0] == 0).all()
    assert np.allclose(total, 16.0)


def test_throttling_has_an_axis_of_its_own():
    with pytest.raises(ValueError, match="throttle_defensive can't share"):
        scenario.in_order(("throttle_defensive", "pass_completion"))
    before, after, _ = injected(0.5, ("throttle_defensive",))
    kept = after["defensive_actions_successful"].sum() / before["defensive_actions_successful"].sum()
    assert 0.35 < kept < 0.65 and (after["defensive_actions_with_outcome"] == before["defensive_actions_with_outcome"]).all()


def test_what_is_cut_short_is_told():
    before, _, steps = injected(50.0, ("pass_completion",))
    assert (steps["pass_completion"].clipped == (before["passes_with_outcome"] > 0)).all()


def test_mechanisms_see_what_they_declare():
    @scenario.register_mechanism(("passes_completed",), "passes_completed", "pass_completion_pct")
    def peeking(table, sds, k, draws):
        return {"passes_completed": table["passes_with_outcome"], "_acted": k > 0}, k < 0

    try:
        with pytest.raises(KeyError, match="passes_with_outcome"):
            injected(1.0, ("peeking",))
    finally:
        del scenario.MECHANISMS["peeking"]


def test_targets_break_ties_by_match(spark):
    df = spark.createDataFrame([("p", "m1", 1.0), ("p", "m2", 3.0), ("q", "m9", None)], "player_id string, match_id string, s double")
    assert [(r["player_id"], r["match_id"]) for r in scenario.target_choices(df, ["s"]).collect()] == [("p", "m1")]


def test_auc_laws(spark):
    table = [(1.0, False), (2.0, False), (1.0, True), (2.0, True)]
    df = spark.createDataFrame(table, "s double, hot boolean")
    assert evaluation.auc(df, "s", "hot").first()["auc"] == 0.5
    sunk = spark.createDataFrame([(1.0, False), (None, True)], "s double, hot boolean")
    assert evaluation.auc(sunk, "s", "hot").first()["auc"] == 0.0


def test_rows_flagged_before_are_no_recoveries(spark):
    table = [(6.0, 7.0, True, False), (1.0, 6.0, True, True), (1.0, 2.0, True, False), (1.0, 1.0, True, False)]
    df = spark.createDataFrame([("r", 5.0, c, a, t, True, clip, False, 1.0, 0.5, 0.1) for c, a, t, clip in table], "recipe string, bar double, clean double, after double, is_target boolean, bit boolean, clipped boolean, short boolean, allocated double, achieved double, achieved_z double")
    cell = evaluation.cell_statistics(df, "recipe").first()
    assert (cell["caught"], cell["recovery"], cell["clipped"], cell["n_dosed"], cell["collateral_measurable"]) == (0.5, 0.25, 0.25, 4, False)


@pytest.fixture(scope="module")
def mart(spark):
    """Two positions of players with a dozen matches each."""
    table = rows(12 * 24, 11)
    n = len(table["actions"])
    made = [
        (f"p{i // 12:02}", f"m{i % 12:02}", "t", ("DF", "MF")[i // 12 % 2], 90.0, 90, True, False, False, 40, *(None if np.isnan(table[c][i]) else float(table[c][i]) for c in table)) for i in range(n)
    ]
    schema = "player_id string, match_id string, team_id string, position_code string, minutes_played double, regulation_minutes int, is_eligible boolean, match_has_missing_substitution boolean, has_mirrored_positions boolean, passes int, "
    return spark.createDataFrame(made, schema + ", ".join(f"{c} double" for c in table)).repartition(3)


CAMPAIGN = Settings(min_matches=5, bootstrap_draws=50, severities=(0.0, 3.0))
RECIPES = {"pass_completion": ("pass_completion",), "coordinated": scenario.ORDER}


@pytest.fixture(scope="module")
def clean(mart):
    return campaign.Clean(mart, CAMPAIGN)


@pytest.mark.parametrize("design", campaign.DESIGNS)
def test_campaign_records(spark, mart, clean, design):
    records = campaign.run(mart, RECIPES, design, CAMPAIGN, clean=clean).toPandas()
    still = records[records["severity"] == 0]
    assert (still["clean"].fillna(-1) == still["after"].fillna(-1)).all() and not still["bit"].any()
    targets = records[records["is_target"] & (records["severity"] > 0)]
    assert targets["bit"].mean() > 0.5 and len(targets) == 24 * 3 * 2
    assert (targets[targets["mechanism"] == "coordinated"]["achieved"].dropna() == 0).all() and targets["achieved_pass_completion"].notna().any()
    assert records["is_target"].all() == (design == "heldout")
    if design == "persistent":
        # A changed match moves what its player's other matches are held against.
        others = records[~records["is_target"] & records["bit"]]
        assert (others["after"] - others["clean"]).abs().gt(1e-9).any()


def test_held_out_scores_by_brute_force(spark, mart, clean):
    """A target's raw distance from the other clean rows of its player, blended with the position's."""
    records = campaign.run(mart, {"pass_completion": ("pass_completion",)}, "heldout", CAMPAIGN, scorers=("mahalanobis",), clean=clean).where("severity = 3 AND bit").toPandas()
    scored = clean.scored.toPandas()
    changed = scenario.inject(mart, records_targets(spark, records), {"pass_completion": ("pass_completion",)}, CAMPAIGN, clean.scored).where("severity = 3").toPandas().set_index(["player_id", "match_id"])
    pools = clean.spaces[0].pools
    for r in records.itertuples():
        mine = scored[(scored["player_id"] == r.player_id)]
        row = mine[mine["match_id"] == r.match_id].iloc[0].copy()
        row["pass_completion_pct"] = changed.loc[(r.player_id, r.match_id), "pass_completion_pct"]
        others = mine[mine["match_id"] != r.match_id][clean.metrics].dropna().to_numpy(float)
        x, pool = row[clean.metrics].to_numpy(float), pools[r.position_code]
        centre, cov = pool.centre, pool.covariance
        if len(others) >= 2:
            w = 0.0 if pool.nu is None else len(others) / (len(others) + pool.nu)
            centre, cov = others.mean(0), w * np.cov(others, rowvar=False) + (1 - w) * pool.covariance
        seen = ~np.isnan(x)
        d = (x - centre)[seen]
        want = np.sqrt(max(0.0, d @ np.linalg.pinv(cov[np.ix_(seen, seen)]) @ d))
        assert r.after == pytest.approx(want, rel=1e-6)


def records_targets(spark, records):
    return spark.createDataFrame(records[["player_id", "match_id"]].drop_duplicates())


def test_campaign_refuses_what_it_does_not_know(mart, clean):
    with pytest.raises(ValueError, match="must be one of"):
        campaign.run(mart, RECIPES, "other", CAMPAIGN, clean=clean)
    with pytest.raises(ValueError, match="no such score"):
        campaign.run(mart, RECIPES, "heldout", CAMPAIGN, scorers=("forest",), clean=clean)
    with pytest.raises(ValueError, match="no recipe"):
        campaign.run(mart, {}, "heldout", CAMPAIGN, clean=clean)


def test_forests_and_bars(spark, clean):
    small = clean.scored.where("player_id < 'p03'")
    found = census.score_census(clean.scored, clean.metrics, True, Settings(trees=5, forest_rows=8), asked=small)
    table = found.toPandas()
    assert len(table) == small.count() and table["forest"].between(0, 1).all() and table["forest_own_fraction"].between(0, 1).all()
    with pytest.raises(ValueError, match="only forest are there"):
        census.production_bars(found.select("forest"), ["forest"])


def test_agreement_leaves_inherited_matches_out(spark):
    choices = spark.createDataFrame([("p", "a", "m1", False), ("p", "b", "m1", True), ("q", "a", "m2", False), ("q", "b", "m2", False)], "player_id string, scorer string, match_id string, inherited boolean")
    found = {(r["a"], r["b"]): (r["n_both"], r["share"]) for r in evaluation.target_agreement(choices, choices.select("player_id", F.lit("MF").alias("position_code"))).collect()}
    assert found[("a", "b")] == (1, 1.0) and found[("a", "a")][0] == 2
