"""Rows of small entities are moved once, and order statistics stand beside them."""

import contextlib
import io

import numpy as np
import pytest

from plumbline.operators import census, residuals, scenario, selection

LONG = "player_id string, match_id string, position_code string, metric string, x double, k double, n double"


def long(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", f"m{j}", "MD", "v", None if (i + j) % 9 == 0 else float(np.round(rng.normal(i % 3), 1)), None, None) for i in range(12) for j in range(3 + 5 * i)]
    return rows, spark.createDataFrame(rows, LONG)


def exchanges(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue().count("Exchange hashpartitioning")


def test_both_scores_take_one_exchange(spark):
    found = residuals.leave_one_out_sigma(residuals.leave_one_out(long(spark)[1]).drop("others"))
    assert exchanges(found) == 1


@pytest.mark.parametrize("bound", [10, 1 << 20])
def test_medians_beside_rows(spark, bound):
    rows, df = long(spark)
    found = selection.beside_median(df, ["player_id"], "x", "m", bound).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["m"] == pytest.approx(np.median([q[4] for q in rows if q[0] == r["player_id"] and q[4] is not None]))


def test_choices_take_two_exchanges(spark):
    scores = long(spark)[1].selectExpr("player_id", "match_id", "x AS a", "CAST(NULL AS DOUBLE) AS b")
    found = scenario.target_choices(scores, ["a", "b"])
    assert exchanges(found) <= 2
    of = {(r["player_id"], r["scorer"]): r for r in found.collect()}
    assert len(of) == 24 and all(of[p, "b"]["inherited"] and of[p, "b"]["match_id"] == of[p, "a"]["match_id"] for p, _ in of)


def test_criteria_keep_rows_without_a_value(spark):
    rows, df = long(spark)
    fitted = spark.createDataFrame([("MD", "v", 1.0, 0.5, None, 0.3, None, 0.2)], "position_code string, metric string, pool_median double, pool_mad double, pool_rate double, ratio double, rho double, scale_ratio double")
    found = residuals.criteria(df, fitted).collect()
    assert len(found) == len(rows) and all(r["centre"] == 1.0 for r in found if r["x"] is None)


def test_trees_without_one_row():
    """Trees that are grown again only from where they part equal those grown whole."""
    rng = np.random.default_rng(9)
    for n, digits in ((3, 1), (8, 0), (40, 1)):
        rows, x = np.round(rng.normal(size=(n, 2)), digits), rng.normal(size=(n, 2))
        draws = rng.random((5, 4 * census.SAMPLE, 2))
        own, total = census._one_left_out(x, np.arange(n), rows, draws)
        for g in range(n):
            kept = np.delete(np.arange(n), g)
            whole = census.Trees(rows, np.tile(kept, (5, 1)), draws)
            assert own[g] == pytest.approx(whole.lengths(np.repeat(x[g : g + 1], 5, 0), np.arange(5)))
            for j in kept:
                assert total[g, j] == pytest.approx(whole.lengths(np.repeat(rows[j : j + 1], 5, 0), np.arange(5)).sum())
