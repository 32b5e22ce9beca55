"""What-if perturbations of calibrated size on chosen rows.

A mechanism takes columns of rows, their spreads, doses and random draws, all as arrays over a batch, and returns the columns
that it changes, with NaN for values that become unknown. It sees the columns that it declares and no others. A recipe is one
mechanism, or several that share one dose. A draw depends on the seed, the row, the mechanism and its dose alone, so the same
mechanism at the same dose draws alike in all recipes, however rows are dealt.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Settings
from plumbline.operators import selection
from plumbline.tables import written

Columns = dict[str, np.ndarray]
#: (columns, spreads, doses, draws) -> changed columns, and where the dose was cut short.
Mechanism = Callable[[Columns, Columns, np.ndarray, "Draws"], tuple[Columns, np.ndarray]]

_DEFENCE = "defensive_actions_successful", "defensive_actions_with_outcome"
_PLACED = "touches_in_defensive_third", "defensive_actions_in_defensive_third", "mean_action_x", "attempts_with_position", "sum_start_x_in_defensive_third"
#: Fixed value: where the defensive third ends.
_THIRD = 1.0 / 3.0


@dataclass(frozen=True)
class Declared:
    """A mechanism with the columns it reads, the count that its dose moves, what shows it, and its attempts if it moves a rate."""

    apply: Mechanism
    reads: tuple[str, ...]
    control: str
    observable: str
    attempts: str | None = None


MECHANISMS: dict[str, Declared] = {}


def register_mechanism(reads: tuple[str, ...], control: str, observable: str, attempts: str | None = None) -> Callable[[Mechanism], Mechanism]:
    def add(f: Mechanism) -> Mechanism:
        MECHANISMS[f.__name__] = Declared(f, reads, control, observable, attempts)
        return f

    return add


class Draws:
    """Uniform numbers for each row of a batch: the ``i``-th of a row's stream is the same wherever the row lies."""

    def __init__(self, seed: int, keys: list[str]):
        self.base = np.array([zlib.crc32(k.encode()) << 32 | zlib.crc32(k[::-1].encode()) for k in keys], np.uint64) ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        self.i = 0

    def uniform(self) -> np.ndarray:
        self.i += 1
        with np.errstate(over="ignore"):
            x = self.base + np.uint64(self.i) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)

    def rounded(self, value: np.ndarray) -> np.ndarray:
        """Whole numbers whose means are ``value``; 0 where it is negative or unknown."""
        value = np.where(np.isfinite(value), np.maximum(value, 0.0), 0.0)
        low = np.floor(value)
        return low + (self.uniform() < value - low)

    def _inverted(self, log_mass: Callable[[int], np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        u, found, below = self.uniform(), low.copy(), np.zeros(len(low))
        for x in range(int(low.min(initial=0)), int(high.max(initial=0))):
            inside = (x >= low) & (x < high)
            below += np.where(inside, np.exp(log_mass(x)), 0.0)
            found += inside & (u >= below)
        return found

    def hypergeometric(self, good: np.ndarray, total: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """How many of ``drawn`` of ``total`` are among the ``good``."""
        total = np.maximum(total, 0)
        good, drawn = np.clip(good, 0, total), np.clip(drawn, 0, total)
        low, high = np.maximum(0, drawn - (total - good)), np.minimum(good, drawn)
        return self._inverted(lambda x: _choose(good, x) + _choose(total - good, drawn - x) - _choose(total, drawn), low, high)

    def binomial(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 0.0, 1.0)
        inner = np.clip(p, 1e-300, 1 - 1e-16)
        found = self._inverted(lambda x: _choose(n, x) + x * np.log(inner) + (n - x) * np.log1p(-inner), np.zeros(len(n)), n)
        return np.where(p >= 1, n, np.where(p <= 0, 0, found))


_LOG_FACTORIAL = np.zeros(1)


def _choose(n: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Logarithms of binomial coefficients; minus infinity where there is no way."""
    global _LOG_FACTORIAL
    n, k = np.broadcast_arrays(np.asarray(n, float), np.asarray(k, float))
    most = int(n.max(initial=0))
    if most >= len(_LOG_FACTORIAL):
        _LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * most + 2)))])
    ok = (k >= 0) & (k <= n)
    i, j = np.where(ok, n, 0).astype(int), np.where(ok, k, 0).astype(int)
    return np.where(ok, _LOG_FACTORIAL[i] - _LOG_FACTORIAL[j] - _LOG_FACTORIAL[i - j], -np.inf)


def _half_up(value: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(value * 10**digits + 0.5) / 10**digits


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Percent; unknown without attempts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole > 0, _half_up(100.0 * part / whole, 2), np.nan)


def _only(changes: Columns, where: np.ndarray, rows: Columns) -> Columns:
    return {c: np.where(where, v, rows[c]) if c in rows else np.where(where, v, np.nan) for c, v in changes.items()}


def _usable(sd: np.ndarray) -> np.ndarray:
    return np.isfinite(sd) & (sd > 0)


def _relabelled(rows: Columns, sd: np.ndarray, k: np.ndarray, draws: Draws, done: str, tried: str, pct: str) -> tuple[Columns, np.ndarray]:
    """Successes moved to failures inside a fixed number of attempts."""
    can = (rows[tried] > 0) & _usable(sd)
    moved = draws.rounded(np.where(can, k * sd * rows[tried], 0.0))
    left = rows[done] - moved
    new = np.clip(left, 0, rows[tried])
    return {done: np.where(can, new, rows[done]), pct: np.where(can, _share(new, rows[tried]), np.nan), "_acted": can}, can & ((left < 0) | (left > rows[tried]))


@register_mechanism(_DEFENCE, "defensive_actions_successful", "defensive_action_success_pct", "defensive_actions_with_outcome")
def defensive_success(rows: Columns, sds: Columns, k: np.ndarray, draws: Draws) -> tuple[Columns, np.ndarray]:
    return _relabelled(rows, sds["defensive_success"], k, draws, *_DEFENCE, "defensive_action_success_pct")


@register_mechanism(("passes_completed", "passes_with_outcome"), "passes_completed", "pass_completion_pct", "passes_with_outcome")
def pass_completion(rows: Columns, sds: Columns, k: np.ndarray, draws: Draws) -> tuple[Columns, np.ndarray]:
    return _relabelled(rows, sds["pass_completion"], k, draws, "passes_completed", "passes_with_outcome", "pass_completion_pct")


@register_mechanism(_DEFENCE, "defensive_actions_successful", "defensive_action_success_pct")
def throttle_defensive(rows: Columns, sds: Columns, k: np.ndarray, draws: Draws) -> tuple[Columns, np.ndarray]:
    """Each successful defensive action fails with probability ``k``; no spread is involved."""
    done, tried = (rows[c] for c in _DEFENCE)
    can = (tried > 0) & (done > 0) & (k > 0) & (k <= 1)
    kept = draws.binomial(np.where(can, done, 0), np.where(can, 1.0 - k, 1.0))
    return {_DEFENCE[0]: np.where(can, kept, done), "defensive_action_success_pct": np.where(can, _share(kept, tried), np.nan), "_acted": can}, np.zeros(len(k), bool)


def _places(rows: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of all places, and the mean places inside and outside the defensive third, within 0 and 1 and unknown where nothing is."""
    placed, inside, mass = rows["attempts_with_position"], rows["touches_in_defensive_third"], rows["sum_start_x_in_defensive_third"]
    total = rows["mean_action_x"] * placed
    with np.errstate(divide="ignore", invalid="ignore"):
        of_third = np.where(inside > 0, mass / inside, np.nan)
        of_rest = np.where(placed > inside, (total - mass) / (placed - inside), np.nan)
    return total, np.clip(of_third, 0, 1), np.clip(of_rest, 0, 1)


def _mean_place(total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean within 0 and 1, and where that had to be forced."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, total / n, np.nan)
    return _half_up(np.clip(mean, 0, 1), 4), ~np.isclose(np.clip(mean, 0, 1), mean, equal_nan=True)


@register_mechanism(("defensive_actions", *reversed(_DEFENCE), "actions", *_PLACED), "defensive_actions", "defensive_actions_per_90")
def remove_defensive(rows: Columns, sds: Columns, k: np.ndarray, draws: Draws) -> tuple[Columns, np.ndarray]:
    """Defensive actions that didn't happen, drawn at random, and what follows for the counts that include them."""
    have, sd = rows["defensive_actions"], sds["defensive_actions"]
    can = (have > 0) & _usable(sd)
    wanted = draws.rounded(np.where(can, k * sd, 0.0))
    gone = np.minimum(wanted, have)
    judged, won = rows["defensive_actions_with_outcome"], rows["defensive_actions_successful"]
    third, touches = rows["defensive_actions_in_defensive_third"], rows["touches_in_defensive_third"]
    gone_judged = draws.hypergeometric(judged, have, gone)
    gone_won = draws.hypergeometric(won, judged, gone_judged)
    gone_third = draws.hypergeometric(third, have, gone)
    total, of_third, of_rest = _places(rows)
    x_third, x_rest = (np.where(np.isfinite(x), x, rows["mean_action_x"]) for x in (of_third, of_rest))
    left = rows["attempts_with_position"] - gone
    mean, forced = _mean_place(total - gone_third * x_third - (gone - gone_third) * x_rest, left)
    acted = can & (gone > 0)
    changes = {
        "actions": rows["actions"] - gone,
        "defensive_actions": have - gone,
        "defensive_actions_with_outcome": judged - gone_judged,
        "defensive_actions_successful": won - gone_won,
        "defensive_actions_in_defensive_third": third - gone_third,
        "touches_in_defensive_third": touches - gone_third,
        "sum_start_x_in_defensive_third": np.maximum(rows["sum_start_x_in_defensive_third"] - gone_third * x_third, 0.0),
        "mean_action_x": np.where(left > 0, mean, rows["mean_action_x"]),
        "attempts_with_position": np.where(left > 0, left, rows["attempts_with_position"]),
    }
    out = _only(changes, acted, rows) | {"defensive_action_success_pct": np.where(acted, _share(won - gone_won, judged - gone_judged), np.nan), "_acted": acted}
    return out, acted & ((wanted > have) | (forced & (left > 0)))


@register_mechanism(_PLACED, "touches_in_defensive_third", "touches_in_defensive_third_per_90")
def relocate_upfield(rows: Columns, sds: Columns, k: np.ndarray, draws: Draws) -> tuple[Columns, np.ndarray]:
    """Touches that leave the defensive third for the mean place outside it, or for its edge if there is none."""
    touches, sd = rows["touches_in_defensive_third"], sds["touches_in_defensive_third"]
    can = (touches > 0) & _usable(sd)
    wanted = draws.rounded(np.where(can, k * sd, 0.0))
    moved = np.minimum(wanted, touches)
    gone = draws.hypergeometric(rows["defensive_actions_in_defensive_third"], touches, moved)
    total, of_third, of_rest = _places(rows)
    x_from, x_to = (np.where(np.isfinite(x), x, _THIRD) for x in (of_third, of_rest))
    mean, forced = _mean_place(total + moved * (x_to - x_from), rows["attempts_with_position"])
    placed, acted = rows["attempts_with_position"] > 0, can & (moved > 0)
    changes = {
        "touches_in_defensive_third": touches - moved,
        "defensive_actions_in_defensive_third": rows["defensive_actions_in_defensive_third"] - gone,
        "sum_start_x_in_defensive_third": (touches - moved) * x_from,
        "mean_action_x": np.where(placed, mean, rows["mean_action_x"]),
    }
    return _only(changes, acted, rows) | {"_acted": acted}, acted & ((wanted > touches) | (forced & placed))


# Fixed value: the mechanisms that can share a dose, in the order in which they apply.
ORDER = ("remove_defensive", "relocate_upfield", "defensive_success", "pass_completion")


def capacity(name: str, rows: Columns, sds: Columns) -> np.ndarray:
    """The largest dose that a mechanism can deliver on each row."""
    m = MECHANISMS[name]
    sd = sds[name] if m.attempts else sds[m.control]
    unit = sd * rows[m.attempts] if m.attempts else sd
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(_usable(sd) & (unit > 0), np.maximum(rows[m.control], 0.0) / unit, 0.0)


def allocate(budget: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """For each row doses (one for each column of ``caps``) whose squares add up to the budget's, equal except where a cap binds; all caps if they can't reach it."""
    order = np.argsort(caps, axis=1, kind="stable")
    left, out = np.square(budget).astype(float), np.zeros(caps.shape)
    at = np.arange(len(caps))
    for place in range(caps.shape[1]):
        i = order[:, place]
        out[at, i] = np.minimum(np.maximum(caps[at, i], 0.0), np.sqrt(np.maximum(left, 0.0) / (caps.shape[1] - place)))
        left = left - out[at, i] ** 2
    return out


@dataclass
class Step:
    """What one mechanism did to each row of a batch: its share of the dose, the dose it delivered, and where it was cut short."""

    allocated: np.ndarray
    achieved: np.ndarray
    clipped: np.ndarray


def in_order(names: tuple[str, ...]) -> tuple[str, ...]:
    """The mechanisms of a recipe in the order in which they apply; several must all share the axis of doses."""
    if len(names) > 1 and (strangers := [n for n in names if n not in ORDER]):
        raise ValueError(f"{', '.join(strangers)} can't share a dose with others: its severity isn't in standard deviations")
    return names if len(names) == 1 else tuple(n for n in ORDER if n in names)


def compose(rows: Columns, sds: Columns, k: np.ndarray, names: tuple[str, ...], keys: list[str], seed: int) -> tuple[Columns, dict[str, Step]]:
    """The rows after all mechanisms, each on what the ones before left, and each one's step.

    Before each step what is left of the budget is shared out again, by what the thinned row can still take.
    """
    ordered, now, steps = in_order(names), dict(rows), {}
    budget = np.square(k)
    for place, name in enumerate(ordered):
        m = MECHANISMS[name]
        if len(ordered) == 1:
            dose = k
        else:
            caps = np.stack([capacity(n, {c: now[c] for c in MECHANISMS[n].reads}, sds) for n in ordered[place:]], 1)
            dose = allocate(np.sqrt(np.maximum(budget, 0.0)), caps)[:, 0]
            budget = budget - dose**2
        before = now[m.control]
        tried = now[m.attempts] if m.attempts else None
        draws = Draws(seed, [f"{key}|{name}|{d!r}" for key, d in zip(keys, dose.tolist(), strict=True)])
        changes, clipped = m.apply({c: now[c] for c in m.reads}, sds, dose, draws)
        acted = changes.pop("_acted")
        for c, v in changes.items():
            now[c] = np.where(acted, v, now[c])
        unit = sds[name] * tried if m.attempts else sds[m.control]
        with np.errstate(divide="ignore", invalid="ignore"):
            achieved = np.where(acted & _usable(unit), (now[m.control] - before) / unit, 0.0)
        steps[name] = Step(dose, achieved, clipped)
    return now, steps


#: Counts whose spread sizes a dose, and rates whose does: successes and attempts.
COUNTS = ("defensive_actions", "touches_in_defensive_third", "defensive_actions_successful", "passes_completed")
RATES = {"defensive_success": _DEFENCE, "pass_completion": ("passes_completed", "passes_with_outcome")}


def spreads(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Each player's standard deviations ``sd_``; where it has too few values, the root of the position's mean variance within players.

    Own spreads are taken over rows with all metrics, where ``rows`` has these; the position's over all rows. A player's sums are written once, so
    ``rows`` are made and read once for both.
    """
    whole = F.lit(True)
    for m in settings.metrics:
        whole = whole & F.col(m).isNotNull() if m in rows.columns else whole
    values: dict[str, Column] = {c: F.col(c).cast("double") for c in COUNTS}
    values |= {n: F.when(F.col(tried) > 0, F.col(done) / F.col(tried)) for n, (done, tried) in RATES.items()}
    sums = [x for n, v in values.items() for x in (F.stddev_samp(F.when(whole, v)).alias(n), F.count(F.when(whole, v)).alias(f"n_{n}"), F.var_samp(v).alias(f"v_{n}"))]
    own = written(rows.groupBy("position_code", "player_id").agg(*sums), "own-spreads")
    pooled = own.groupBy("position_code").agg(*[F.sqrt(F.avg(f"v_{n}")).alias(f"pool_{n}") for n in values])
    pick = [F.when(F.col(f"n_{n}") >= settings.min_spread_rows, F.col(n)).otherwise(F.col(f"pool_{n}")).alias(f"sd_{n}") for n in values]
    return own.join(F.broadcast(pooled), "position_code").select("player_id", *pick)


def target_choices(scores: DataFrame, scorers: list[str]) -> DataFrame:
    """For each player and scorer the match whose score is nearest the player's median; the lower match id on ties.

    A scorer that scores none of a player's rows inherits the first scorer's row.
    """
    long = scores.select("player_id", "match_id", F.inline(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).alias("score")) for s in scorers])))
    near = F.when(F.col("score").isNotNull(), F.struct(F.abs(F.col("score") - F.col("middle")), "match_id"))
    chosen = selection.beside_median(long, ["player_id", "scorer"], "score", "middle").groupBy("player_id", "scorer").agg(F.min(near)["match_id"].alias("match_id"))
    first = F.max(F.when(F.col("scorer") == scorers[0], F.col("match_id"))).over(Window.partitionBy("player_id"))
    found = chosen.withColumn("fallback", first).where(F.coalesce("match_id", "fallback").isNotNull())
    return found.select("player_id", "scorer", F.coalesce("match_id", "fallback").alias("match_id"), F.col("match_id").isNull().alias("inherited"))


def ladder(names: tuple[str, ...], settings: Settings = DEFAULT) -> tuple[float, ...]:
    """The severities of a recipe: fractions for throttling, standard deviations for all others."""
    return settings.fractions if names == ("throttle_defensive",) else settings.severities


def conditions(recipes: dict[str, tuple[str, ...]], settings: Settings = DEFAULT) -> list[tuple[str, float]]:
    if not recipes:
        raise ValueError("there is no recipe to inject")
    return [(r, float(k)) for r, names in recipes.items() for k in ladder(in_order(tuple(names)), settings)]


def inject(mart: DataFrame, targets: DataFrame, recipes: dict[str, tuple[str, ...]], settings: Settings = DEFAULT, sized: DataFrame | None = None) -> DataFrame:
    """Every target under every recipe and severity: the row's columns after the change, and what became of the dose.

    ``bit`` says whether anything changed, ``clipped`` whether a step was cut short, ``allocated`` the dose that the steps were
    given together, ``short`` whether that is less than the severity, ``achieved`` what a single mechanism delivered. Of
    recipes of several mechanisms the columns ``allocated_``, ``achieved_`` and ``clipped_`` tell each one's part (null in others).
    ``sized`` (by default the mart) gives the spreads. At severity 0 a change is an error. The mart is read for the targets and for the spreads, so it should be a table.
    """
    grid = mart.sparkSession.createDataFrame(conditions(recipes, settings), "recipe string, severity double")
    numbers = sorted({c for names in recipes.values() for n in names for c in MECHANISMS[n].reads} | {MECHANISMS[n].control for names in recipes.values() for n in names} | {"pass_completion_pct", "defensive_action_success_pct"})
    parts = [n for n in ORDER if any(n in names for names in recipes.values() if len(names) > 1)]
    chosen = mart.join(targets.select("player_id", "match_id").distinct(), ["player_id", "match_id"], "left_semi")
    rows = chosen.join(spreads(mart if sized is None else sized, settings), "player_id", "left").crossJoin(F.broadcast(grid))  # a few conditions
    kinds = {f.name: f.dataType.simpleString() for f in mart.schema}
    told = {"recipe": "string", "severity": "double", "allocated": "double", "achieved": "double", "bit": "boolean", "clipped": "boolean", "short": "boolean"}
    told |= {f"{c}_{n}": k for n in parts for c, k in (("allocated", "double"), ("achieved", "double"), ("clipped", "boolean"))}

    columns = [*mart.columns, *told]

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for recipe, part in pdf.groupby("recipe", sort=False):
                yield _changed(part.reset_index(drop=True), tuple(recipes[recipe]), numbers, parts, settings.seed)[columns]

    schema = ", ".join(f"`{c}` {k}" for c, k in ({c: "double" if c in numbers else k for c, k in kinds.items()} | told).items())
    done = rows.select(*[F.col(c).cast("double") if c in numbers else F.col(c) for c in mart.columns], *[f"sd_{n}" for n in (*COUNTS, *RATES)], "recipe", "severity").mapInPandas(change, schema)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return done.select(*[known(c).cast(kinds[c]).alias(c) if c in numbers else F.col(c) for c in mart.columns], *[known(c).alias(c) if told[c] == "double" else F.col(c) for c in told])


def _changed(pdf: pd.DataFrame, names: tuple[str, ...], numbers: list[str], parts: list[str], seed: int) -> pd.DataFrame:
    rows = {c: pdf[c].to_numpy(float) for c in numbers}
    rows = {c: v if c in ("mean_action_x", "pass_completion_pct", "defensive_action_success_pct") else np.nan_to_num(v) for c, v in rows.items()}
    sds = {n: pdf[f"sd_{n}"].to_numpy(float) for n in (*COUNTS, *RATES)}
    k = pdf["severity"].to_numpy(float)
    keys = (pdf["player_id"].astype(str) + "|" + pdf["match_id"].astype(str)).tolist()
    after, steps = compose(rows, sds, k, names, keys, seed)
    bit = np.zeros(len(pdf), bool)
    for c in numbers:
        bit |= ~np.isclose(after[c], rows[c], equal_nan=True)
    if (bit & (k == 0)).any():
        raise AssertionError(f"no dose of {', '.join(names)} changed {keys[int(np.flatnonzero(bit & (k == 0))[0])]}")
    out = pdf.assign(**{c: np.where(bit, after[c], pdf[c].to_numpy(float)) for c in numbers})
    allocated = np.sqrt(sum(np.square(s.allocated) for s in steps.values()))
    out["allocated"] = np.where(bit, allocated, np.nan)
    out["short"] = bit & (k > 0) & (allocated < k - 1e-9)
    out["bit"], out["clipped"] = bit, bit & np.any([s.clipped for s in steps.values()], axis=0)
    out["achieved"] = np.where(bit, next(iter(steps.values())).achieved if len(steps) == 1 else np.nan, 0.0)
    for n in parts:
        mine = n in steps and len(steps) > 1
        out[f"allocated_{n}"] = np.where(bit, steps[n].allocated, np.nan) if mine else np.nan
        out[f"achieved_{n}"] = np.where(bit, steps[n].achieved, 0.0) if mine else np.nan
        out[f"clipped_{n}"] = bit & steps[n].clipped if mine else None
    return out


def patched(rows: DataFrame, changed: DataFrame, *keys: str) -> DataFrame:
    """The rows with the changed ones in place of those of equal keys, in the columns that both have; a null that a change made stays null."""
    others = [c for c in rows.columns if c not in keys and c in changed.columns]
    patch = changed.select(*keys, F.struct(*others).alias("_patch"))
    found = rows.join(patch, list(keys), "left")
    return found.select(*[c if c not in others else F.when(F.col("_patch").isNotNull(), F.col(f"_patch.{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns])
