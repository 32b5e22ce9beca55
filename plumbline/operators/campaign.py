"""Injection campaigns: changes in chosen rows, the scores before and after, one record for each scorer.

Targets, recipes and severities are columns of one table, so a campaign is one job and not a loop over runs; hyperparameters and pools are those of the clean pass.
``heldout`` joins each changed row to the criteria that the clean pass wrote for it, since these come from the entity's other rows alone. ``persistent``
sends each condition as its changed row to the entity's rows and takes the old row's values out of their sums and order and the new one's in.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Settings
from plumbline.operators import census, evaluation, residuals, scenario
from plumbline.operators.census import ENTITY
from plumbline.tables import written

SCORERS = ("max", "mahalanobis", "mahalanobis_res")
FORESTS = ("forest", "forest_norm", "forest_res", "forest_res_norm")
DESIGNS = ("heldout", "persistent")
_KEYS = ["player_id", "match_id"]


class Clean:
    """The clean pass: prepared rows, hyperparameters, scores of all scoreable rows and the pools that later passes are pinned to."""

    def __init__(self, mart: DataFrame, settings: Settings = DEFAULT, metrics: list[str] | None = None, forest: bool = False, players: int | None = None):
        """With ``players`` only the first so many by id are scored and targeted; fits take all rows."""
        self.settings, self.forest = settings, forest
        self.rows = written(residuals.prepare(mart, settings), "prepared")
        self.long = residuals.long_form(self.rows, settings)
        self.fitted = written(residuals.hyperparameters(self.long, settings), "fitted")
        self.criteria = written(residuals.criteria(self.long, self.fitted, settings), "criteria")
        z = residuals.wide_form(residuals.against(self.criteria), settings).drop("position_code")
        self.scored = written(self.rows.where("is_scoreable").join(z, _KEYS), "scored")
        self._fit_to = self.scored
        if players is not None:
            self.scored = self.scored.join(F.broadcast(first_entities(self.scored, "player_id", players)), "player_id", "left_semi")
        self._see(metrics)

    def _see(self, metrics: list[str] | None) -> None:
        self.metrics = list(metrics if metrics is not None else self.settings.metrics)
        self.spaces = census.spaces(self._fit_to, self.metrics, self.settings)
        self.scores = written(self.scored_as(self.scored, self.scored), "scores")

    def seeing(self, metrics: list[str]) -> Clean:
        """The same pass where multivariate scorers see other metrics: residuals and what they are held against stay, pools and scores are made anew."""
        other = copy(self)
        other._see(metrics)
        return other

    @property
    def scorers(self) -> tuple[str, ...]:
        return SCORERS + (FORESTS if self.forest else ())

    def scored_as(self, asked: DataFrame, history: DataFrame, *carry: str) -> DataFrame:
        """Keys, ``carry``, all scorers' scores and the residuals of rows, against the other matches of ``history``."""
        found = census.score_census(history, self.metrics, self.forest, self.settings, asked, self.spaces, carry)
        return found.join(asked.select(*_KEYS, *carry, F.col("max_abs_z").alias("max"), *[f"z_{m}" for m in self.settings.metrics]), [*_KEYS, *carry])

    def bars(self, rate: float | None = None) -> dict[str, float]:
        """Each scorer's score that ``rate`` of the clean rows reach."""
        rate = self.settings.flag_rate if rate is None else rate
        return census.production_bars(self.scores, list(self.scorers), rate).first().asDict()

    def targets(self, scorers: tuple[str, ...] | None = None) -> DataFrame:
        """Each player's most typical match by each scorer, of players that the first scorer knows."""
        return scenario.target_choices(self.scores, list(scorers or self.scorers))


def first_entities(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` values of a key in its order."""
    return rows.select(key).distinct().orderBy(key).limit(n)


def _entity(*more: str) -> Column:
    return F.concat_ws(ENTITY, "player_id", *[F.col(c).cast("string") for c in more])


def _rescored_alone(clean: Clean, changed: DataFrame) -> DataFrame:
    """Changed rows against the clean criteria. While residuals are found the match's name holds its condition too."""
    settings = clean.settings
    named = residuals.derived(changed.withColumn("match_id", F.concat_ws(ENTITY, "match_id", "recipe", F.col("severity").cast("string"))), settings)
    match = F.split("match_id", ENTITY)[0]
    held = clean.criteria.drop("x", "k", "n", "position_code").withColumnRenamed("match_id", "of_match")
    asked = residuals.long_form(named, settings).withColumn("of_match", match).join(held, ["player_id", "of_match", "metric"])
    z = residuals.wide_form(residuals.against(asked), settings).drop("position_code")
    rows = written(named.join(z, _KEYS).withColumn("match_id", match), "changed-scored")
    return clean.scored_as(rows, clean.scored, "recipe", "severity").withColumn("target", F.col("match_id"))


#: Rows of an entity whose conditions are worked out where the entity's rows meet.
ENTITY_ROWS = 1 << 16


def _rescored_history(clean: Clean, mart: DataFrame, changed: DataFrame, bound: int = ENTITY_ROWS) -> DataFrame:
    """All rows of the targets' players, under each target and condition with the target's row replaced by the changed one.

    Entities of more than ``bound`` rows, which shouldn't meet in one task, go the longer way: each condition as an entity of its own through all estimators.
    """
    large = clean.rows.groupBy("player_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("player_id")
    if not large.limit(1).count():
        return _rescored_by_replacement(clean, changed)
    small = _rescored_by_replacement(clean, changed.join(large, "player_id", "left_anti"))
    return small.unionByName(_rescored_copies(clean, mart, changed.join(large, "player_id", "left_semi")).select(*small.columns))


def _rescored_by_replacement(clean: Clean, changed: DataFrame) -> DataFrame:
    settings, condition = clean.settings, ["target", "recipe", "severity"]
    named = written(residuals.derived(changed.withColumn("target", F.col("match_id")), settings), "changed")
    rows = residuals.replaced(clean.rows, named, clean.fitted, condition, settings)
    # Each condition is an entity by name from here on, since distances are taken among its own rows.
    return _as_conditions(clean, written(rows.withColumn("player_id", _entity(*condition)).drop(*condition), "histories-scored"))


def _as_conditions(clean: Clean, scored: DataFrame) -> DataFrame:
    found = clean.scored_as(scored, scored)
    part = F.split("player_id", ENTITY)
    return found.withColumns({"target": part[1], "recipe": part[2], "severity": part[3].cast("double")}).withColumn("player_id", part[0])


def _rescored_copies(clean: Clean, mart: DataFrame, changed: DataFrame) -> DataFrame:
    settings, condition = clean.settings, ["target", "recipe", "severity"]
    named = changed.withColumn("target", F.col("match_id"))
    whole = mart.join(named.select("player_id", *condition), "player_id").select(*mart.columns, *condition)
    rows = scenario.patched(whole, named, "player_id", "match_id", *condition).withColumn("player_id", _entity(*condition)).drop(*condition)
    prepared = residuals.prepare(rows, settings)
    return _as_conditions(clean, written(residuals.scored_rows(written(prepared, "histories"), clean.fitted, settings), "histories-scored"))


def run(mart: DataFrame, recipes: dict[str, tuple[str, ...]], design: str = "heldout", settings: Settings = DEFAULT, metrics: list[str] | None = None, forest: bool = False, scorers: tuple[str, ...] | None = None, clean: Clean | None = None) -> DataFrame:
    """One record for each scored row of each scorer, recipe and severity.

    Keys and condition; ``is_target``, ``bit``, ``clipped``, ``short``, ``allocated``, ``achieved``; ``achieved_z``, the shift of the z that shows the
    recipe's mechanism; ``clean`` and ``after``, the scorer's scores. For recipes of several mechanisms ``achieved_``, ``clipped_``
    and ``achieved_z_`` of each. ``metrics`` narrows what the multivariate scorers see; injection always uses all.
    At severity 0 nothing is scored again: after is clean.
    """
    if design not in DESIGNS:
        raise ValueError(f"design is {design!r}; it must be one of {', '.join(DESIGNS)}")
    clean = clean or Clean(mart, settings, metrics, forest)
    scorers = tuple(scorers or clean.scorers)
    if unknown := [s for s in scorers if s not in clean.scorers]:
        raise ValueError(f"{', '.join(unknown)}: no such score was computed")
    choices = written(clean.targets(scorers).select("player_id", "scorer", F.col("match_id").alias("target")), "targets")
    injected = written(scenario.inject(mart, choices.select("player_id", F.col("target").alias("match_id")), recipes, settings, clean.scored), "injected")
    bitten = injected.where("bit")
    after = written(_rescored_alone(clean, bitten) if design == "heldout" else _rescored_history(clean, mart, bitten), "rescored")
    told = [c for c in injected.columns if c not in mart.columns and c not in ("recipe", "severity")]
    doses = choices.join(injected.select("player_id", F.col("match_id").alias("target"), "recipe", "severity", *told), ["player_id", "target"])
    # Every clean row of a target's player counts; held out, only the target itself.
    base = clean.scores.withColumnsRenamed({c: f"clean_{c}" for c in [*clean.scorers, *[f"z_{m}" for m in settings.metrics]]}).select(*census.KEYS, *[f"clean_{c}" for c in [*clean.scorers, *[f"z_{m}" for m in settings.metrics]]])
    rows = doses.join(base, "player_id").withColumn("is_target", F.col("match_id") == F.col("target"))
    rows = rows.where("is_target") if design == "heldout" else rows
    condition = ["player_id", "match_id", "target", "recipe", "severity"]
    seen = after.select(*condition, *clean.scorers, *[f"z_{m}" for m in settings.metrics], F.lit(True).alias("scored"))
    # In a history where some row of a condition bit, rows that nothing touched are scored as well, and equal their clean scores.
    rows = rows.join(seen, condition, "left")
    pick = lambda prefix: F.coalesce(*[F.when(F.col("scorer") == s, F.col(f"{prefix}{s}")) for s in scorers])
    now = F.when(F.col("scored"), pick("")).otherwise(pick("clean_"))
    shift = lambda metric: F.when(F.col("is_target") & F.col("scored"), F.col(f"z_{metric}") - F.col(f"clean_z_{metric}")).when(F.col("is_target"), F.lit(0.0) * F.col(f"clean_z_{metric}"))
    shown = {r: scenario.MECHANISMS[names[0]].observable for r, names in recipes.items() if len(names) == 1}
    achieved_z = F.coalesce(*[F.when(F.col("recipe") == r, shift(m)) for r, m in shown.items()]) if shown else F.lit(None).cast("double")
    parts = [n for n in scenario.ORDER if f"achieved_{n}" in told]
    each = [c for n in parts for c in (F.col(f"achieved_{n}"), F.col(f"clipped_{n}"), F.when(F.col(f"achieved_{n}").isNotNull(), shift(scenario.MECHANISMS[n].observable)).alias(f"achieved_z_{n}"))]
    return rows.select(
        "player_id", "match_id", "position_code", "scorer", F.col("recipe").alias("mechanism"), "severity", "is_target", "bit", "clipped", "short", "allocated", "achieved",
        achieved_z.alias("achieved_z"), pick("clean_").alias("clean"), now.alias("after"), *each,
    )


def report(mart: DataFrame, recipes: dict[str, tuple[str, ...]], design: str = "heldout", settings: Settings = DEFAULT, rate: float | None = None, **options: object) -> DataFrame:
    """A campaign's cell statistics, one row for each mechanism, severity and scorer, at the bars that ``rate`` of clean rows reach."""
    clean = options.pop("clean", None)
    if clean is None:
        mart = written(mart, "mart")
        clean = Clean(mart, settings, options.pop("metrics", None), bool(options.pop("forest", False)), options.pop("players", None))
    records = written(run(mart, recipes, design, settings, clean=clean, **options), "records")
    return evaluation.cell_statistics(evaluation.with_bars(records, clean.bars(rate)), "mechanism", "severity", "scorer")


def arms(metrics: list[str]) -> dict[str, list[str]]:
    """The feature sets of a sweep: all metrics, and all but each."""
    return {"all": list(metrics)} | {f"drop:{m}": [x for x in metrics if x != m] for m in metrics}


#: Feature sets that are worked out beside each other.
_BESIDE = 4


def sweep(mart: DataFrame, recipes: dict[str, tuple[str, ...]], settings: Settings = DEFAULT, chosen: dict[str, list[str]] | None = None, rate: float | None = None, forest: bool = True) -> DataFrame:
    """Cell statistics of a held-out campaign under each feature set, as one table with ``arm`` and ``metrics``.

    The clean pass is made once: a set decides what multivariate scorers see, not the residuals. Sets are worked out beside each other, since much of each is
    small jobs. A narrower set halves what forests borrow, so rates compare between scorers of an arm, not between arms.
    """
    sets = list((chosen or arms(list(settings.metrics))).items())
    if not sets:
        raise ValueError("there is no feature set to sweep")
    mart = written(mart, "mart")
    first = Clean(mart, settings, sets[0][1], forest)

    def told(arm: tuple[str, list[str]]) -> DataFrame:
        name, metrics = arm
        clean = first if arm is sets[0] else first.seeing(metrics)
        found = report(mart, recipes, "heldout", settings, rate, clean=clean)
        return written(found.select(F.lit(name).alias("arm"), F.lit(len(metrics)).alias("metrics"), "*"), "arm")

    with ThreadPoolExecutor(_BESIDE) as beside:
        return reduce(DataFrame.unionByName, beside.map(told, sets))
