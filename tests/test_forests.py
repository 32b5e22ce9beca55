"""Forests grown level by level against the recursive form."""

import numpy as np
import pytest

from plumbline.config import Settings
from plumbline.operators import census


def path(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(rows, depth, most, node, draws):
    """The same tree by recursion."""
    spread = np.flatnonzero(rows.max(0) > rows.min(0))
    if depth >= most or not len(spread):
        return (depth + path(len(rows)),)
    c = spread[int(draws[node, 0] * len(spread))]
    low, high = rows[:, c].min(), rows[:, c].max()
    cut = low + draws[node, 1] * (high - low)
    left = rows[:, c] < cut
    return c, cut, grown(rows[left], depth + 1, most, 2 * node + 1, draws), grown(rows[~left], depth + 1, most, 2 * node + 2, draws)


def length(tree, x):
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree[0]


def recursive(x, left_out, rows, trees, seed):
    order, draws = census._drawn(len(rows), trees, seed)
    out = []
    for xi, gone in zip(x, left_out):
        kept = np.flatnonzero(~gone)
        size = min(census.SAMPLE, len(kept))
        most = max(1, int(np.ceil(np.log2(max(2, size)))))
        forest = [grown(rows[[r for r in order[t] if not gone[r]][:size]], 0, most, 0, draws[t]) for t in range(trees)]
        score = lambda v: 2 ** (-np.mean([length(f, v) for f in forest]) / path(size))  # noqa: E731, B023
        own = np.array([score(rows[r]) for r in kept])
        out.append((score(xi), own.mean(), own.std(ddof=1)))
    return np.array(out).T


@pytest.mark.parametrize(("n", "borrowed", "each"), [(12, 0, 1), (9, 20, 3), (300, 0, 1)])
def test_equals_the_recursive_form(n, borrowed, each):
    rng = np.random.default_rng(n)
    rows = np.round(rng.normal(size=(n + borrowed, 3)), 1)
    match = np.append(np.arange(n) // each, np.full(borrowed, -1))
    asked = np.arange(0, n, max(each, n // 6))
    left_out = match[asked][:, None] == match[None, :]
    found = census.isolated(rows[asked], left_out, rows, 7, 0)
    assert np.allclose(found, recursive(rows[asked], left_out, rows, 7, 0))


@pytest.mark.parametrize(("n", "own", "d", "digits"), [(28, 28, 2, 1), (65, 27, 6, 9), (9, 9, 3, 0)])
def test_groups_are_told_together(n, own, d, digits):
    """Groups of as many rows equal the recursive form one by one, with ties and with rows that were changed."""
    rng, groups = np.random.default_rng(n), []
    for _ in range(3):
        rows = np.round(rng.normal(size=(n, d)), digits)
        asked = rng.integers(0, own, 5)
        x = rows[asked] + np.array([0, 0, 1, 3, -3])[:, None]
        groups.append((x, asked[:, None] == np.arange(n)[None, :], rows))
    for group, found in zip(groups, census.isolated_each(groups, 7, 0), strict=True):
        assert np.allclose(found, recursive(*group, 7, 0))


def test_ranks_of_independent_forests_agree():
    """Forests with draws of their own order rows alike."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(120, 3)) * [1, 2, 3]
    left_out = np.eye(120, dtype=bool)
    a, b = census.isolated(rows, left_out, rows, 100, 0)[0], census.isolated(rows, left_out, rows, 100, 99)[0]
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(a), rank(b))[0, 1] > 0.93
    far = np.vstack([rows, [[12.0, -20.0, 30.0]]])
    assert census.isolated(far, np.eye(121, dtype=bool), far, 50, 0)[0].argmax() == 120


def test_bound_may_be_off(spark):
    """Off, all rows train; a bound at or above an entity's rows changes nothing, a lower one does."""
    rng = np.random.default_rng(2)
    rows = [(f"p{i}", f"m{j:03}", "MD", float(rng.normal(i)), float(rng.normal())) for i in range(3) for j in range(60)]
    df = spark.createDataFrame(rows, "player_id string, match_id string, position_code string, a double, b double")
    found = {}
    for bound in (None, 1000, 20):
        scores = census.score_census(df, ["a", "b"], True, Settings(trees=10, forest_rows=bound)).collect()
        assert len(scores) == len(rows) and all(r["forest"] is not None and r["forest_norm"] is not None for r in scores)
        found[bound] = {(r["player_id"], r["match_id"]): (r["forest"], r["forest_norm"], r["forest_own_fraction"]) for r in scores}
    assert found[None] == found[1000] != found[20]
    own = np.array([r[3:] for r in rows if r[0] == "p1"])
    scores, mean, spread = census.isolated(own, np.eye(60, dtype=bool), own, 10, 0)
    assert found[None]["p1", "m007"] == pytest.approx((scores[7], (scores[7] - mean[7]) / spread[7], 1.0))
