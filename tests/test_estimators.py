"""Estimators on planted truth and planted nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.operators import census, residuals


def planted(spark, rows):
    return spark.createDataFrame(rows, "player_id string, match_id string, position_code string, metric string, x double, k double, n double")


def location(spark, spread, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"p{i}", f"m{j}", "MD", "v", float(c + rng.normal()), None, None) for i, c in enumerate(rng.normal(0, spread, 200) if spread else np.zeros(200)) for j in range(15)]
    return planted(spark, rows)


def test_informativeness(spark):
    assert residuals.informativeness(location(spark, 0)).first()["ratio"] < 0.05
    assert 0.5 < residuals.informativeness(location(spark, 1)).first()["ratio"] < 2


@pytest.mark.parametrize("rho", [0.0, 0.2])
def test_overdispersion(spark, rho):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        p = rng.uniform(0.3, 0.7)
        for j in range(20):
            q = rng.beta(p * (1 - rho) / rho, (1 - p) * (1 - rho) / rho) if rho else p
            k = float(rng.binomial(30, q))
            rows.append((f"p{i}", f"m{j}", "MD", "v", k / 30, k, 30.0))
    assert abs(residuals.overdispersion(planted(spark, rows)).first()["rho"] - rho) < 0.03


def test_scale_ratio_ignores_row_order_and_partitions(spark):
    long, s = location(spark, 1), Settings(bootstrap_draws=100)
    a = residuals.scale_ratio(long.repartition(1), s).first()["scale_ratio"]
    b = residuals.scale_ratio(long.orderBy(F.rand(5)).repartition(7), s).first()["scale_ratio"]
    assert a == pytest.approx(b, abs=1e-12)


def test_leave_one_out_by_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{i}", f"m{j}", "MD", "v", float(rng.integers(0, 6)), None, None) for i in range(30) for j in range(int(rng.integers(1, 8)))]
    for r in residuals.leave_one_out(planted(spark, rows)).collect():
        others = np.array([x[4] for x in rows if x[0] == r["player_id"] and x[1] != r["match_id"]])
        if not len(others):
            assert r["centre"] is None
            continue
        assert r["centre"] == pytest.approx(np.median(others))
        assert r["mad"] == pytest.approx(np.median(np.abs(others - np.median(others))))


def test_beta_binomial_tails_by_brute_force(spark):
    from math import comb, lgamma

    beta = lambda a, b: lgamma(a) + lgamma(b) - lgamma(a + b)
    cases = [(3.0, 10.0, 0.4, 0.1), (0.0, 5.0, 0.2, 0.3), (7.0, 7.0, 0.9, 0.05), (None, 7.0, 0.9, 0.05)]
    df = spark.createDataFrame(cases, "k double, n double, p double, rho double")
    for r in df.withColumn("t", residuals.beta_binomial_tails("k", "n", "p", "rho")).collect():
        if r["k"] is None:
            assert r["t"]["lower"] is None or np.isnan(r["t"]["lower"])
            continue
        a, b = r["p"] * (1 - r["rho"]) / r["rho"], (1 - r["p"]) * (1 - r["rho"]) / r["rho"]
        n = int(r["n"])
        mass = [comb(n, i) * np.exp(beta(i + a, n - i + b) - beta(a, b)) for i in range(int(r["k"]) + 1)]
        assert r["t"]["lower"] == pytest.approx(sum(mass), rel=1e-8) and r["t"]["below"] == pytest.approx(sum(mass[:-1]), rel=1e-8)


def test_normal_quantile():
    from statistics import NormalDist

    p = np.concatenate([10.0 ** -np.arange(1, 13), [0.05, 0.25, 0.5, 0.75, 0.95, 1 - 1e-9]])
    assert np.allclose(residuals.normal_quantile(p), [NormalDist().inv_cdf(float(x)) for x in p], rtol=1e-13)


def settled(spark, rows):
    """Hyperparameters that are given, for rows of one position and metric."""
    long = planted(spark, rows)
    given = {"pool_median": 10.0, "pool_mad": 2.0, "pool_rate": 0.5, "ratio": 0.5, "rho": 0.1, "scale_ratio": 0.25}
    fitted = long.select("position_code", "metric").distinct().withColumns({k: F.lit(v) for k, v in given.items()})
    return long, fitted, given


def test_residuals_by_brute_force(spark):
    """Spreads shrink by an entity's rows, centres by its values; the position stands in where nothing is known."""
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", f"m{j}", "MD", "v", None if rng.random() < 0.3 else float(rng.normal(9, 3)), None, None) for i in range(12) for j in range(int(rng.integers(1, 7)))]
    long, fitted, g = settled(spark, rows)
    for r in residuals.residuals(long, fitted).collect():
        mine = [x for x in rows if x[0] == r["player_id"]]
        x = next(y[4] for y in mine if y[1] == r["match_id"])
        others = np.array([y[4] for y in mine if y[1] != r["match_id"] and y[4] is not None])
        if x is None:
            assert r["z"] is None and r["sigma"] is None
            continue
        w, ws = (q * n / (q * n + 1) for q, n in ((g["ratio"], len(others)), (g["scale_ratio"], len(mine) - 1)))
        centre, mad = g["pool_median"], g["pool_mad"]
        if len(others):
            centre = w * np.median(others) + (1 - w) * centre
            mad = ws * np.median(np.abs(others - centre)) + (1 - ws) * mad
        assert r["z"] == pytest.approx((x - centre) / (1.4826 * (mad or g["pool_mad"])), rel=1e-9)
        mean, sd = (others.mean(), others.std(ddof=1)) if len(others) >= 2 else (g["pool_median"], 1.4826 * g["pool_mad"])
        assert r["sigma"] == pytest.approx((x - mean) / sd, rel=1e-6)


def test_only_some_metrics_are_computed_again(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{i}", f"m{j}", "MD", m, float(rng.normal()), None, None) for i in range(6) for j in range(5) for m in ("a", "b")]
    long, fitted, _ = settled(spark, rows)
    whole = residuals.residuals(long, fitted)
    moved = long.withColumn("x", F.when(F.col("metric") == "a", F.col("x") + 1).otherwise(F.col("x")))
    want = {(r["player_id"], r["match_id"], r["metric"]): r["z"] for r in residuals.residuals(moved, fitted).collect()}
    got = {(r["player_id"], r["match_id"], r["metric"]): r["z"] for r in residuals.residuals(moved, fitted, only=["a"], carried=whole).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def scored_table(spark, n=20, each=9, seed=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 2, (n, 3))
    scale = rng.uniform(0.5, 2, (n, 3))
    rows = [(f"p{i:02}", f"m{j}", "MD", *(None if rng.random() < 0.05 else float(v) for v in base[i] + scale[i] * rng.normal(size=3))) for i in range(n) for j in range(each)]
    return spark.createDataFrame(rows, "player_id string, match_id string, position_code string, a double, b double, c double"), rows


def test_covariance_nu_by_brute_force(spark):
    df, rows = scored_table(spark)
    whole = [r for r in rows if None not in r]
    x = np.array([r[3:] for r in whole], float)
    x = x / x.std(0, ddof=1)
    who = np.array([r[0] for r in whole])
    cov, var, size = [], [], []
    for p in sorted(set(who)):
        own = x[who == p]
        if len(own) >= 3:
            d = own - own.mean(0)
            c = d.T @ d / (len(own) - 1)
            cov.append(c)
            var.append(((d**2).T @ (d**2) / len(own) - c**2) / len(own))
            size.append(len(own))
    cov, var, size = np.array(cov), np.array(var), np.array(size)[:, None, None]
    want = 1 / np.median(np.maximum(cov.var(0, ddof=1) - var.mean(0), 0) / (size * var).mean(0))
    assert census.covariance_nu(df, ["a", "b", "c"]).first()["nu"] == pytest.approx(want, rel=1e-9)


def test_covariance_nu_without_evidence(spark):
    df = scored_table(spark, n=1)[0]
    assert census.position_nus(df, ["a", "b"]).first()["nu"] is None
    assert census.position_nus(df.limit(3), ["a", "b"]).count() == 0


def test_thin_histories_take_the_position_fit(spark):
    df, rows = scored_table(spark)
    thin = spark.createDataFrame([("new", "m0", "MD", 1.0, 2.0, 0.5), ("odd", "m0", "XX", 1.0, 2.0, None), ("odd", "m1", "XX", None, None, 1.0)], df.schema)
    found = {(r["player_id"], r["match_id"]): r for r in census.score_census(df.union(thin), ["a", "b", "c"]).collect()}
    x = np.array([r[3:] for r in rows if None not in r] + [(1.0, 2.0, 0.5)], float)
    d = np.array([1.0, 2.0, 0.5]) - x.mean(0)
    assert found[("new", "m0")]["fit_source"] == "position"
    assert found[("new", "m0")]["mahalanobis"] == pytest.approx(np.sqrt(d @ np.linalg.inv(np.cov(x, rowvar=False)) @ d), rel=1e-6)
    assert found[("odd", "m0")]["mahalanobis"] is not None and found[("odd", "m1")]["mahalanobis"] is None


def test_pools_hold_a_bounded_sample(spark):
    df = scored_table(spark, 40, 9)[0]
    pool = census.pools(df, ["a", "b"], Settings(borrow_cap=20))["MD"]
    assert pool.rows.shape == (20, 2)


def test_forest_ranks_the_outlier_first():
    x = np.vstack([np.random.default_rng(0).normal(size=(200, 3)), [[9.0, 9.0, 9.0]]])
    assert int(np.argmax(census.IsolationForest(x, 50, 0).score(x))) == 200


def test_distances_need_two_values():
    x = np.array([[1.0, np.nan, np.nan], [3.0, 4.0, np.nan]])
    found = census.distances(x, np.zeros((2, 3)), np.stack([np.eye(3)] * 2))
    assert np.isnan(found[0]) and found[1] == pytest.approx(5)


def test_flag_rate_must_be_a_rate(spark):
    with pytest.raises(ValueError, match="between 0 and 1"):
        residuals.flag(spark.createDataFrame([(1.0,)], "max_abs_z double"), 1.5)
