"""Multivariate scores of each row against its own entity's other rows.

An entity's means and products are sums over its complete rows, so each row gets the fit of the others by taking its own
match's part from them: no entity's rows meet in one place. Position-wide fits, few and small, go to all tasks.
Isolation forests, which need rows, train on at most ``forest_rows`` of an entity's own, or on all of them where that is off. Scores depend on keys, not on how rows are dealt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Settings
from plumbline.operators import selection
from plumbline.operators.one_left_out import left_out_each, mean_paths
from plumbline.tables import written

#: What separates an entity's player from what else names it (see ``campaign``); a seed depends on the player alone.
ENTITY = "\x01"
_PLACES = 1 << 40


def covariance_nu(rows: DataFrame, columns: list[str], by: str = "position_code", player: str = "player_id") -> DataFrame:
    """How many rows of its own an entity's covariance is worth: nu, one over the median ratio of between to within.

    Over the entries of the covariance matrix of scaled columns, between is the variance of the entities' entries less the
    mean of the entries' own variances (from fourth moments), and within the mean of rows times that variance. Entities count
    from three complete rows on. Nu is null, for infinite, if two such entities don't exist or don't differ.
    """
    complete = rows.dropna(subset=columns)
    scale = complete.groupBy(by).agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    factor = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    scaled = complete.join(F.broadcast(scale), by).select(by, player, *[(F.col(c) / factor(c)).alias(c) for c in columns])
    means = scaled.groupBy(by, player).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns]).where("n >= 3")
    centred = scaled.join(means, [by, player]).select(by, player, "n", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    products = {f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs}
    each = centred.groupBy(by, player, "n").agg(*[x for k, p in products.items() for x in (F.sum(p).alias(f"c_{k}"), F.avg(p * p).alias(f"q_{k}"))])
    n = F.col("n")
    entries = []
    for a, b in pairs:
        c = F.col(f"`c_{a}*{b}`") / (n - 1)
        v = (F.col(f"`q_{a}*{b}`") - c * c) / n
        entries += [F.struct(F.lit(f"{x}*{y}").alias("entry"), c.alias("c"), v.alias("v")) for x, y in {(a, b), (b, a)}]
    long = each.select(by, "n", F.inline(F.array(*entries)))
    within = F.avg(F.col("n") * F.col("v"))
    between = F.greatest(F.var_samp("c") - F.avg("v"), F.lit(0.0))
    found = long.groupBy(by, "entry").agg(between.alias("between"), within.alias("within"), F.count(F.lit(1)).alias("m"))
    usable = found.groupBy(by).agg(F.median(F.when((F.col("within") > 0) & (F.col("m") >= 2), F.col("between") / F.col("within"))).alias("ratio"))
    return usable.select(by, F.when(F.col("ratio") > 0, 1 / F.col("ratio")).alias("nu"))


def shrinkage_weight(n: np.ndarray, nu: float | None) -> np.ndarray:
    """The share of an entity's own covariance, n / (n + nu); none of it where nu is infinite (null)."""
    return np.zeros(len(n)) if nu is None else np.where(n > 0, n / (np.maximum(n, 1) + nu), 0.0)


def distances(x: np.ndarray, centre: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Mahalanobis distances over the values that are there, one fit for each row; not a number with fewer than two."""
    out, seen = np.full(len(x), np.nan), ~np.isnan(x)
    for mask in np.unique(seen, axis=0):
        at = np.flatnonzero((seen == mask).all(1))
        if mask.sum() < 2 or not len(at):
            continue
        cov = covariance[at][:, mask][:, :, mask]
        good = np.isfinite(cov).all((1, 2)) & np.isfinite(centre[at][:, mask]).all(1)
        at, cov = at[good], cov[good]
        d = (x[at] - centre[at])[:, mask]
        out[at] = np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", d, np.linalg.pinv(cov), d), 0.0))
    return out


class Trees:
    """Isolation trees as flat arrays, all grown together, a level at a time.

    A node's children are 2k + 1 and 2k + 2. ``draws`` holds, for each tree and node, the share of the columns and of the range where it is cut, so
    trees that are given the same draws differ only by their rows.
    """

    def __init__(self, rows: np.ndarray, members: np.ndarray, draws: np.ndarray):
        """``members``: the rows of each tree by number, -1 for none; a tree needs two."""
        count, size = members.shape
        self.depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        nodes = (1 << self.depth + 1) - 1
        self.column = np.full((count, nodes), -1, np.int16)
        self.cut, self.length = np.zeros((count, nodes)), np.zeros((count, nodes))
        tree, at = np.nonzero(members >= 0)
        row, node = members[tree, at], np.zeros(len(tree), np.int64)
        for level in range(self.depth + 1):
            if not len(tree):
                break
            key = tree * nodes + node
            order = np.argsort(key, kind="stable")
            tree, row, node, key = tree[order], row[order], node[order], key[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            held = np.diff(np.append(begin, len(key)))
            values = rows[row]
            t, k = tree[begin], node[begin]
            self.length[t, k] = level + mean_paths(held)
            open_, chosen, cut = _split(np.minimum.reduceat(values, begin), np.maximum.reduceat(values, begin), draws[t, k], level < self.depth)
            self.column[t[open_], k[open_]], self.cut[t[open_], k[open_]] = chosen[open_], cut[open_]
            whose = np.repeat(np.arange(len(begin)), held)
            goes = open_[whose]
            right = values[np.arange(len(row)), chosen[whose]] >= cut[whose]
            node = (2 * node + 1 + right)[goes]
            tree, row = tree[goes], row[goes]

    def lengths(self, x: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """The path of each row of ``x`` in the tree of the same place."""
        node, each = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            column = self.column[tree, node]
            node = np.where(column >= 0, 2 * node + 1 + (x[each, column] >= self.cut[tree, node]), node)
        return self.length[tree, node]


def _split(low: np.ndarray, high: np.ndarray, draws: np.ndarray, deeper: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes with these bounds: which are cut, in which column and where."""
    spread = high > low
    # The share of the columns that vary, counted from the first.
    nth = np.floor(draws[:, 0] * spread.sum(1)).astype(np.int64)
    chosen = np.argmax(np.cumsum(spread, 1) == (nth + 1)[:, None], 1)
    each = np.arange(len(low))
    return spread.any(1) & deeper, chosen, low[each, chosen] + draws[:, 1] * (high - low)[each, chosen]


#: Rows that one group asks about where an entity's training rows aren't bounded.
_ASKED = 1024
#: Rows of a tree, and how many rows of all trees together are grown or followed at once.
SAMPLE, _AT_ONCE = 256, 1 << 20
#: The same where groups of as many rows are told together, few enough for a processor's cache.
_TOGETHER = 3 << 14


def _drawn(count: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which each tree takes rows, and its draws."""
    order = np.argsort(np.random.default_rng([seed, 1]).random((trees, count)), axis=1)
    return order, _shares(trees, seed)


@lru_cache(4)
def _shares(trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 2]).random((trees, 4 * SAMPLE, 2))


def _one_left_out(x: np.ndarray, gone: np.ndarray, rows: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``left_out_each`` of one group."""
    return left_out_each(x, np.zeros(len(x), np.int64), gone, rows[None], draws)


def _sampled(x: np.ndarray, left_out: np.ndarray, rows: np.ndarray, order: np.ndarray, draws: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The path of each row of ``x`` in each of its trees, and all rows' paths in these trees, added up. A tree whose sample holds none of what is left out is not grown again."""
    n, trees = len(x), len(order)
    base = Trees(rows, order[:, :size], draws)
    every = np.arange(trees)
    of_row = base.lengths(np.repeat(rows, trees, 0), np.tile(every, len(rows))).reshape(len(rows), trees)
    of_x = base.lengths(np.repeat(x, trees, 0), np.tile(every, n)).reshape(n, trees)
    own, total = of_x.copy(), np.broadcast_to(of_row.sum(1), (n, len(rows))).copy()
    sampled = np.zeros((trees, len(rows)), bool)
    np.put_along_axis(sampled, order[:, :size], True, 1)
    who, which = np.nonzero(left_out.astype(np.float32) @ sampled.T.astype(np.float32) > 0)
    step = max(1, _AT_ONCE // max(size, len(rows)))
    for at in range(0, len(who), step):
        i, t = who[at : at + step], which[at : at + step]
        allowed = np.take_along_axis(~left_out[i], order[t], 1)
        first = np.argsort(~allowed, axis=1, kind="stable")[:, :size]
        again = Trees(rows, np.take_along_axis(order[t], first, 1), draws[t])
        each = np.arange(len(i))
        own[i, t] = again.lengths(x[i], each)
        paths = again.lengths(np.tile(rows, (len(i), 1)), np.repeat(each, len(rows))).reshape(len(i), len(rows))
        np.add.at(total, i, paths - of_row[:, t].T)
    return own, total


def isolated(x: np.ndarray, left_out: np.ndarray, rows: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` its score among ``rows`` but those that it leaves out, and the mean and spread of these rows' own scores.

    Each row of ``left_out`` marks as many rows. All forests share the order in which trees take rows, and their draws. So a tree is the same for all
    rows of ``x`` that leave out none of its sample; for the others it is grown again with the next rows in order.
    """
    return isolated_each([(x, left_out, rows)], trees, seed)[0]


def isolated_each(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], trees: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``isolated`` of many groups. Those of as many rows, all but one of which train, are told together."""
    out: list = [None] * len(groups)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (x, left_out, rows) in enumerate(groups):
        if len(rows) - 1 <= SAMPLE and len(x) and left_out[0].sum() == 1:
            alike.setdefault(rows.shape, []).append(i)
            continue
        kept = len(rows) - int(left_out[0].sum())
        order, draws = _drawn(len(rows), trees, seed)
        out[i] = _moments(*_sampled(x, left_out, rows, order, draws, min(SAMPLE, kept)), left_out, kept, trees)
    for (n, _), members in alike.items():
        step = max(1, _TOGETHER // (trees * n))
        for low in range(0, len(members), step):
            part = [groups[i] for i in members[low : low + step]]
            sizes = [len(x) for x, _, _ in part]
            left_out = np.concatenate([g[1] for g in part])
            told = left_out_each(np.concatenate([g[0] for g in part]), np.repeat(np.arange(len(part)), sizes), left_out.argmax(1), np.stack([g[2] for g in part]), _shares(trees, seed))
            found = _moments(*told, left_out, n - 1, trees)
            for i, *each in zip(members[low : low + step], *[np.split(f, np.cumsum(sizes)[:-1]) for f in found], strict=True):
                out[i] = tuple(each)
    return out


def _moments(own: np.ndarray, total: np.ndarray, left_out: np.ndarray, kept: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    norm = trees * max(1e-9, float(mean_paths(np.array([min(SAMPLE, kept)]))[0]))
    scores = np.where(left_out, 0.0, 2.0 ** (-total / norm))
    mean = scores.sum(1) / kept
    spread = np.sqrt(np.where(left_out, 0.0, (scores - mean[:, None]) ** 2).sum(1) / max(1, kept - 1))
    return 2.0 ** (-own.sum(1) / norm), mean, spread


class IsolationForest:
    """Random axis-parallel splits; rows that few splits isolate score high (towards 1)."""

    def __init__(self, rows: np.ndarray, trees: int, seed: int):
        self.size = min(SAMPLE, len(rows))
        order, draws = _drawn(len(rows), trees, seed)
        self.trees, self.count = Trees(rows, order[:, : self.size], draws), trees

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of ``x``."""
        paths = self.trees.lengths(np.repeat(x, self.count, 0), np.tile(np.arange(self.count), len(x))).reshape(len(x), self.count)
        return 2.0 ** (-paths.mean(1) / max(1e-9, float(mean_paths(np.array([self.size]))[0])))


@dataclass
class Pool:
    """A position's mean, covariance, nu (none for infinite) and a bounded sample of its rows."""

    centre: np.ndarray
    covariance: np.ndarray
    nu: float | None
    rows: np.ndarray


def pools(rows: DataFrame, columns: list[str], settings: Settings = DEFAULT) -> dict[str | None, Pool]:
    """The pool of each position with at least two complete rows more than columns, and of all rows under None."""
    complete, d = rows.dropna(subset=columns).select("player_id", "match_id", "position_code", *columns), len(columns)
    both = complete.where(F.col("position_code").isNotNull()).union(complete.withColumn("position_code", F.lit(None).cast("string")))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    moments = both.groupBy("position_code").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).where(F.col("n") >= d + 2)
    found = moments.collect()
    nus = {r["position_code"]: r["nu"] for r in covariance_nu(complete, columns).collect()}
    # A share of all places keeps what is ordered small; the cut to ``borrow_cap`` follows.
    place = F.pmod(F.xxhash64("player_id", "match_id"), F.lit(_PLACES))
    shares = F.create_map(*[x for r in found for x in (F.coalesce(F.lit(r["position_code"]), F.lit("")), F.lit(2.0 * settings.borrow_cap / r["n"] + 64.0 / r["n"]))]) if found else None
    held: dict[str | None, list] = {}
    if found:
        near = both.withColumn("place", place).where(F.col("place") <= F.coalesce(shares[F.coalesce("position_code", F.lit(""))], F.lit(0.0)) * _PLACES)
        rank = F.row_number().over(Window.partitionBy("position_code").orderBy("place", "player_id", "match_id"))
        for r in near.withColumn("rank", rank).where(F.col("rank") <= settings.borrow_cap).select("position_code", "rank", *columns).orderBy("position_code", "rank").collect():
            held.setdefault(r[0], []).append(r[2:])
    out = {}
    for r in found:
        cov = np.zeros((d, d))
        for (i, j), v in zip(pairs, r[2 + d :], strict=True):
            cov[i, j] = cov[j, i] = v
        out[r[0]] = Pool(np.array(r[2 : 2 + d], float), cov, nus.get(r[0]), np.array(held.get(r[0], []), float).reshape(-1, d))
    return out


@dataclass
class Space:
    """Columns that are scored together, and their clean pools."""

    name: str
    columns: list[str]
    pools: dict[str | None, Pool]

    @property
    def origin(self) -> np.ndarray:
        """Where sums are taken from, near the rows' mean so that little is lost in differences."""
        return self.pools[None].centre if None in self.pools else np.zeros(len(self.columns))


def _sums(complete: DataFrame, columns: list[Column], *keys: str) -> DataFrame:
    """``n``, sums and sums of products."""
    d = len(columns)
    products = [F.sum(columns[i] * columns[j]).alias(f"_p{i}_{j}") for i in range(d) for j in range(i, d)]
    return complete.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)], *products)


def _others(asked: DataFrame, complete: DataFrame, space: Space) -> DataFrame:
    """``asked`` with the sums over the entity's complete rows of other matches, as one array ``sums`` of the space."""
    keys, names = ["player_id", "match_id"], space.columns
    moved = [F.col(c) - F.lit(float(m)) for c, m in zip(names, space.origin, strict=True)]
    complete = complete.dropna(subset=names)
    whole, own = _sums(complete, moved, "player_id"), _sums(complete, moved, *keys)
    parts = [c for c in whole.columns if c.startswith("_")]
    both = asked.join(whole, "player_id", "left").join(own.select(*keys, *[F.col(c).alias(f"own{c}") for c in parts]), keys, "left")
    left = F.array(*[F.coalesce(c, F.lit(0.0)) - F.coalesce(f"own{c}", F.lit(0.0)) for c in parts])
    return both.select(*asked.columns, left.alias(f"sums{space.name}"))


def _fits(sums: np.ndarray, pool: list[Pool | None], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and covariances of rows, and which are the entity's own blended with its pool's."""
    d = len(origin)
    n, s = sums[:, 0], sums[:, 1 : 1 + d]
    upper = np.triu_indices(d)
    products = np.zeros((len(n), d, d))
    products[:, upper[0], upper[1]] = products[:, upper[1], upper[0]] = sums[:, 1 + d :]
    own = n >= 2
    centre = np.where(own[:, None], s / np.maximum(n, 1)[:, None], np.nan)
    cov = (products - n[:, None, None] * centre[:, :, None] * centre[:, None, :]) / np.maximum(n - 1, 1)[:, None, None]
    centre = centre + origin
    for p in {id(p): p for p in pool}.values():
        at = np.array([q is p for q in pool])
        if p is None:
            cov[at & ~own] = np.nan
            continue
        w = shrinkage_weight(n[at & own], p.nu)[:, None, None]
        cov[at & own] = w * cov[at & own] + (1 - w) * p.covariance
        centre[at & ~own], cov[at & ~own] = p.centre, p.covariance
    return centre, cov, own


def spaces(rows: DataFrame, columns: list[str], settings: Settings = DEFAULT) -> list[Space]:
    """Raw values, and residuals (``z_`` columns of rows complete in the raw ones) where the rows have them."""
    out = [Space("", columns, pools(rows, columns, settings))]
    residual = [f"z_{c}" for c in columns]
    if set(residual) <= set(rows.columns):
        out.append(Space("_res", residual, {k: p for k, p in pools(rows.dropna(subset=columns), residual, settings).items() if k is not None}))
    return out


KEYS = ["player_id", "match_id", "position_code"]
SCORES = ["mahalanobis", "mahalanobis_res", "forest", "forest_norm", "forest_own_fraction", "forest_res", "forest_res_norm", "forest_res_own_fraction"]


def _position_of(space: Space, position: str | None) -> Pool | None:
    return space.pools.get(position) or (space.pools.get(None) if space.name == "" else None)


def score_census(rows: DataFrame, columns: list[str], forest: bool = False, settings: Settings = DEFAULT, asked: DataFrame | None = None, fitted: list[Space] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's distance from its entity's other rows in both spaces, and its isolation among them if asked for: keys, ``fit_source`` and ``SCORES``.

    The covariance is the entity's own, weighted n / (n + nu), and the position's for the rest. With fewer than two other complete
    rows the position's fit stands in, or that of all rows (raw values only); a row without any isn't scored. ``asked`` rows
    are scored in place of ``rows``, against the other matches' ``rows`` of their entity; ``fitted`` gives the pools. ``carry`` are columns of ``asked`` that tell its rows apart.
    """
    if fitted is None:
        # Pools, sums, forests and the rows themselves all read these.
        needed = [*KEYS, *columns, *[f"z_{c}" for c in columns if f"z_{c}" in rows.columns], *(carry if asked is None else ())]
        rows = written(rows.select(*dict.fromkeys(needed)), "census-rows")
    shared = rows.sparkSession.sparkContext.broadcast(fitted if fitted is not None else spaces(rows, columns, settings))
    keys, named = ["player_id", "match_id", *carry], [*KEYS, *carry]
    queries = (asked if asked is not None else rows).select(*named, *[F.col(c).cast("double") for s in shared.value for c in s.columns])
    complete = rows.dropna(subset=columns)
    plain = queries
    for space in shared.value:
        plain = _others(plain, complete, space)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[named].copy()
            usable = np.ones(len(pdf), bool)
            for space in shared.value:
                pool = [_position_of(space, None if pd.isna(p) else p) for p in pdf["position_code"]]
                sums = np.stack(pdf[f"sums{space.name}"].to_numpy()) if len(pdf) else np.zeros((0, 1))
                centre, cov, own = _fits(sums, pool, space.origin) if len(pdf) else (None, None, np.zeros(0, bool))
                out[f"mahalanobis{space.name}"] = distances(pdf[space.columns].to_numpy(float), centre, cov) if len(pdf) else []
                if space.name == "":
                    out["fit_source"] = np.where(own, "shrunk", "position")
                    usable = np.array([p is not None for p in pool], bool)
            if len(shared.value) == 1:
                out["mahalanobis_res"] = np.nan
            yield out[usable][[*named, "fit_source", "mahalanobis", "mahalanobis_res"]]

    types = dict(queries.dtypes)
    plain = plain.mapInPandas(tell, ", ".join(f"{c} {types[c]}" for c in named) + ", fit_source string, mahalanobis double, mahalanobis_res double")
    if forest:
        plain = plain.join(_forests(complete, queries, shared, settings, keys), keys, "left")
    missing = [c for c in SCORES if c not in plain.columns]
    plain = plain.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else plain
    return plain.select(*named, "fit_source", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in SCORES])


def _forests(complete: DataFrame, queries: DataFrame, shared: Broadcast, settings: Settings, keys: list[str]) -> DataFrame:
    """Isolation of the queries among their entity's other rows, borrowed rows included.

    An entity's rows are dealt to groups of about ``forest_rows``; with each group goes the same sample of as many of its rows, or all of them where ``forest_rows`` is off.
    """
    bound, whole = settings.forest_rows or _ASKED, settings.forest_rows is None
    values = [c for s in shared.value for c in s.columns]
    sized = queries.groupBy("player_id").agg(F.ceil(F.count(F.lit(1)) / bound).cast("int").alias("_groups"))
    dealt = queries.join(sized, "player_id").withColumn("_group", F.pmod(F.xxhash64("match_id"), "_groups").cast("int"))
    kept = complete.select("player_id", "match_id", *values)
    if not whole:
        place = F.pmod(F.xxhash64("match_id", F.lit(1)), F.lit(_PLACES))
        kept = kept.join(complete.groupBy("player_id").agg(F.count(F.lit(1)).alias("_all")), "player_id").where(place <= bound / F.col("_all") * _PLACES)
    sample = kept.join(sized, "player_id").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    each, named = ["player_id", "_group"], [*keys, "position_code"]
    lacking = [F.lit(None).cast(k).alias(c) for c, k in queries.dtypes if c in named and c not in ("player_id", "match_id")]
    both = dealt.select(*each, *[c for c in queries.columns if c in named and c != "player_id"], *values, F.lit(False).alias("_trains"))
    both = both.unionByName(sample.select(*each, "match_id", *lacking, *values, F.lit(True).alias("_trains")))
    # Work goes by groups and not by bytes, so tasks aren't put together.
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), queries.sparkSession.sparkContext.defaultParallelism)
    both = both.repartition(tasks, *each).withColumn("_begins", F.row_number().over(Window.partitionBy(*each).orderBy("_trains", "match_id")) == 1)
    names = [f"forest{s.name}{c}" for s in shared.value for c in ("", "_norm", "_own_fraction")]

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        begins = np.flatnonzero(pdf["_begins"].to_numpy(bool))
        trains, matches, players, positions = (pdf[c].to_numpy() for c in ("_trains", "match_id", "player_id", "position_code"))
        trains, columns = trains.astype(bool), {s.name: pdf[s.columns].to_numpy(float) for s in shared.value}
        out, jobs = np.full((len(pdf), len(names)), np.nan), []
        for low, high in zip(begins, np.append(begins[1:], len(pdf)), strict=True):
            mid = low + int((~trains[low:high]).sum())
            seed = zlib.crc32(str(players[low]).split(ENTITY)[0].encode())
            codes = [None if pd.isna(p) else p for p in positions[low:mid]]
            left_out = matches[low:mid, None] == matches[None, mid:high]
            for k, space in enumerate(shared.value):
                train = columns[space.name][mid:high]
                whole = ~np.isnan(train).any(1)
                jobs += _isolations(columns[space.name][low:mid], left_out[:, whole], train[whole], codes, space, seed, settings, out[low:mid, 3 * k : 3 * k + 3])
        for (_, _, _, found, at), (score, mean, spread) in zip(jobs, isolated_each([j[:3] for j in jobs], settings.trees, 0), strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                found[at, 0], found[at, 1] = score, np.where(spread > 0, (score - mean) / spread, np.nan)
        return pdf.loc[~trains, keys].assign(**dict(zip(names, out[~trains].T, strict=True)))

    def of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last group, which the next batch may go on with
        for pdf in batches:
            begins = np.flatnonzero(pdf["_begins"].to_numpy(bool))
            if len(begins):
                if whole := [p for p in (*held, pdf.iloc[: begins[-1]]) if len(p)]:
                    yield told(pd.concat(whole, ignore_index=True))
                held = []
            held.append(pdf.iloc[begins[-1] :] if len(begins) else pdf)
        if held:
            yield told(pd.concat(held, ignore_index=True))

    types = dict(queries.dtypes)
    return both.mapInPandas(of_groups, ", ".join(f"{c} {types[c]}" for c in keys) + ", " + ", ".join(f"{c} double" for c in names))


def _isolations(x: np.ndarray, left_out: np.ndarray, own: np.ndarray, positions: list[str | None], space: Space, seed: int, settings: Settings, found: np.ndarray) -> list[tuple]:
    """What there is to tell of a group: rows asked about, what they leave out, the rows that train, and where in ``found`` the score and the same in standard deviations of the
    training rows' scores belong. The share of these rows that are the entity's own is put there.

    Rows that see the same columns, borrow from the same pool and leave out as many rows have one training set but for what they leave out, and are told together.
    """
    jobs = []
    seen, others = ~np.isnan(x), left_out.shape[1] - left_out.sum(1)
    alike: dict[tuple, list[int]] = {}
    for i, position in enumerate(positions):
        alike.setdefault((seen[i].tobytes(), int(others[i]), position), []).append(i)
    for (_, left, position), rows in alike.items():
        mask, pool, at = seen[rows[0]], _position_of(space, position), np.array(rows)
        if pool is None and (space.name == "" or left < 2):
            continue
        if left >= 2:
            lacking = 0 if pool is None else max(0, min(2 ** int(mask.sum()) - left, settings.borrow_cap - left, len(pool.rows)))
            borrowed = pool.rows[np.random.default_rng(seed).choice(len(pool.rows), lacking, replace=False)] if lacking else own[:0]
            train, out, share = np.vstack([own, borrowed]), np.hstack([left_out[at], np.zeros((len(at), lacking), bool)]), left / (left + lacking)
        else:
            # Of the position's own fit, residuals count all rows as its own, raw values none.
            train, out, share = pool.rows, np.zeros((len(at), len(pool.rows)), bool), 1.0 if space.name else 0.0
        found[at, 2] = share
        if mask.sum() < 2 or len(train) - int(out[0].sum()) < 2:
            continue
        for low in range(0, len(at), _ASKED):
            part = slice(low, low + _ASKED)
            jobs.append((x[at[part]][:, mask], out[part], train[:, mask], found, at[part]))
    return jobs


def production_bars(scores: DataFrame, columns: list[str], rate: float = DEFAULT.flag_rate, bound: int = selection.BOUND) -> DataFrame:
    """The value of each scorer that ``rate`` of all rows reach, in one pass; nulls don't count. Scorers without the others' forests are refused."""
    forests = [c for c in SCORES if c.startswith("forest") and "fraction" not in c]
    given = [c for c in forests if c in scores.columns]
    if any(c in forests for c in columns) and len(given) != len(forests):
        raise ValueError(f"of the forests' scores only {', '.join(given)} are there")
    long = scores.select(F.inline(F.array(*[F.struct(F.lit(c).alias("scorer"), F.col(c).cast("double").alias("score")) for c in columns])))
    bars = selection.quantiles(long, ["scorer"], "score", {"bar": 1 - rate}, bound)
    return bars.agg(*[F.max(F.when(F.col("scorer") == c, F.col("bar"))).alias(c) for c in columns])


def position_nus(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nu of each position with at least two complete rows more than columns."""
    complete = rows.dropna(subset=columns)
    enough = complete.groupBy("position_code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= len(columns) + 2)
    return covariance_nu(complete, columns).join(F.broadcast(enough), "position_code", "left_semi")


def in_covariance_space(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Distances for two columns without Python: each row from its entity's other rows, by sums less its own; nothing is shrunk."""
    w = Window.partitionBy("player_id")
    sums: dict[str, Column] = {"n": F.lit(1.0), "sa": F.col(a), "sb": F.col(b), "saa": F.col(a) * F.col(a), "sbb": F.col(b) * F.col(b), "sab": F.col(a) * F.col(b)}
    rows = rows.dropna(subset=[a, b]).withColumns({f"_{k}": F.sum(v).over(w) - v for k, v in sums.items()}).where("_n >= 3")
    n = F.col("_n")
    ma, mb = F.col("_sa") / n, F.col("_sb") / n
    vaa, vbb, vab = ((F.col(f"_s{p}") - n * x * y) / (n - 1) for p, x, y in (("aa", ma, ma), ("bb", mb, mb), ("ab", ma, mb)))
    det = vaa * vbb - vab * vab
    da, db = F.col(a) - ma, F.col(b) - mb
    square = (vbb * da * da - 2 * vab * da * db + vaa * db * db) / det
    return rows.withColumn("mahalanobis", F.when(det > 1e-12, F.sqrt(F.greatest(square, F.lit(0.0))))).drop(*[f"_{k}" for k in sums])
