"""How unusual a row is for its own entity: leave-one-out residuals, shrunk towards the position.

Everything runs in long form, one row for each (player, match, metric), so that all metrics share one
pass. Of an entity's values of a metric a few order statistics (``selection``) go back to its rows: a leave-one-out
median takes at most three values, and so does the deviation around each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.config import DEFAULT, PROPORTIONS, Settings
from plumbline.functions.columns import first_largest, mean_of, nulls_skipped
from plumbline.operators import selection
from plumbline.tables import joined, written

KEYS = ("player_id", "match_id", "position_code")


def derived(mart: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What follows from a row itself: doubtful values taken out, rates per 90 added."""
    mirrored = F.coalesce("has_mirrored_positions", F.lit(False))
    exposure = F.nullif(F.least(F.col("minutes_played").cast("double"), F.col("regulation_minutes").cast("double")), F.lit(0.0))
    hidden = [c for c in ("mean_action_x", "touches_in_defensive_third") if c in mart.columns]
    rows = mart.withColumns({c: F.when(~mirrored, F.col(c)) for c in hidden})
    return rows.withColumns({f"{c}_per_90": F.col(c) * 90.0 / exposure for c in ("passes", "defensive_actions", "touches_in_defensive_third")})


def prepare(mart: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows with enough time, doubtful matches and values taken out, rates per 90 added."""
    long_enough = F.col("minutes_played") >= settings.baseline_minutes
    rows = derived(mart.where(long_enough & ~F.coalesce("match_has_missing_substitution", F.lit(False))), settings)
    rows = rows.withColumn("player_baseline_matches", F.count(F.lit(1)).over(Window.partitionBy("player_id")))
    return rows.withColumn("is_scoreable", F.coalesce("is_eligible", F.lit(False)) & (F.col("player_baseline_matches") >= settings.min_matches))


def long_form(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``metric`` and its value ``x``, with successes ``k`` of attempts ``n`` for true proportions."""

    def of(metric: str) -> Column:
        k, n = (F.col(c).cast("double") for c in PROPORTIONS[metric]) if metric in PROPORTIONS else (F.lit(None).cast("double"),) * 2
        return F.struct(F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("x"), k.alias("k"), n.alias("n"))

    return rows.select(*KEYS, F.inline(F.array(*map(of, settings.metrics))))


def position_baselines(long: DataFrame, bound: int = selection.BOUND) -> DataFrame:
    """Median and median absolute deviation of each metric in each position, and the pooled rate."""
    by = ["position_code", "metric"]
    rates = long.groupBy(*by).agg((F.sum("k") / F.nullif(F.sum("n"), F.lit(0.0))).alias("pool_rate"))
    centres = selection.median(long, by, "x", "pool_median", bound)
    away = joined(long, F.broadcast(centres), by).withColumn("away", F.abs(F.col("x") - F.col("pool_median")))  # a row for each position and metric
    return joined(joined(centres, rates, by), selection.median(away, by, "away", "pool_mad", bound), by)


def informativeness(long: DataFrame) -> DataFrame:
    """How much entities differ against how well each is known: the ratio r of each position and metric."""
    by = ["position_code", "metric"]
    each = long.where(F.col("x").isNotNull()).groupBy(*by, "player_id").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count("x").alias("n")).where("n >= 2")
    within = F.avg("v")
    between = F.greatest(F.var_samp("m") - F.avg(F.col("v") / F.col("n")), F.lit(0.0))
    return each.groupBy(*by).agg((between / F.nullif(within, F.lit(0.0))).alias("ratio"))


def overdispersion(long: DataFrame) -> DataFrame:
    """Extra spread rho of an entity's rates beyond binomial draws."""
    by = ["position_code", "metric"]
    rows = long.where("n > 0").withColumn("rate", F.col("k") / F.col("n"))
    each = rows.groupBy(*by, "player_id").agg(
        F.var_samp("rate").alias("v"), (F.sum("k") / F.sum("n")).alias("p"), F.avg(1 / F.col("n")).alias("inv"), F.count(F.lit(1)).alias("m")
    )
    q = F.col("p") * (1 - F.col("p"))
    part = F.sum(F.col("v") - q * F.col("inv")) / F.nullif(F.sum(q * (1 - F.col("inv"))), F.lit(0.0))
    return each.where("m >= 2").groupBy(*by).agg(F.least(F.greatest(part, F.lit(0.0)), F.lit(0.99)).alias("rho"))


#: The draws' arithmetic is modulo this prime, where a fifth power never repeats a value.
PRIME = (1 << 31) - 1
#: Values of draws that are worked out together, few enough for a processor's cache.
_TOGETHER = 1 << 14
#: Values that a block of draws takes at most, all draws together; a larger entity has more blocks.
DRAWN = 1 << 22


_PRIME, _BITS = np.uint64(PRIME), np.uint64(31)


def _folded(v: np.ndarray, times: int = 2) -> np.ndarray:
    """``v`` modulo the prime but for a rest, in place: the prime is all ones, so the high bits are added to the low ones. Twice leaves at most 2^31 + 8, once of 2^62 less than 2^32."""
    for _ in range(times):
        high = v >> _BITS
        v &= _PRIME
        v += high
    return v


def _fifth(v: np.ndarray) -> np.ndarray:
    """A fifth power of canonical values; its square and fourth power keep what 64 bits hold."""
    square = _folded(v * v, 1)
    square *= square
    power = _folded(square)
    power *= v
    return _canonical(power)


def _canonical(v: np.ndarray) -> np.ndarray:
    v = _folded(v)
    return np.minimum(v, v - _PRIME, out=v)  # what would be negative wraps round and is large


def drawn(seed: int, draws: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` values each draw takes, n times each: one row for each draw.

    A pick is a share of the prime, from the seed, the draw and the pick's number by two fifth powers: whole numbers that any engine works out alike.
    """
    rows = draws.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(seed)
    mixed = _fifth(_canonical(rows[:, None] + np.arange(n, dtype=np.uint64)[None, :] * np.uint64(7_919)))
    mixed *= np.uint64(16_807)
    mixed += np.uint64(seed)
    share = _fifth(_canonical(mixed))
    share *= np.uint64(n)
    share //= _PRIME
    return share.view(np.int64)


def _bootstrap(values: np.ndarray, counts: np.ndarray, seed: int, draws: np.ndarray) -> np.ndarray:
    """The median absolute deviation of each draw from values in ascending order, each as often as its count."""
    values = np.repeat(values, counts)
    taken = drawn(seed, draws, len(values)).astype(np.int16 if len(values) < 1 << 15 else np.int64)
    taken.sort(axis=1)
    return _deviation(values[taken])


def _deviation(taken: np.ndarray) -> np.ndarray:
    """The median absolute deviation of each row of ascending values."""
    low, high = (taken.shape[1] - 1) // 2, taken.shape[1] // 2
    away = np.abs(taken - ((taken[:, low] + taken[:, high]) / 2)[:, None])
    away.sort(axis=1)
    return (away[:, low] + away[:, high]) / 2


def bootstrap_spreads(long: DataFrame, settings: Settings = DEFAULT, bound: int = selection.BOUND) -> DataFrame:
    """For each entity of at least three values: their number ``n``, their median absolute deviation ``mad`` and its variance ``v`` over the draws.

    Equal values travel as one with their number. An entity's draws go in blocks, each with all its values, so a large entity spreads over as many tasks
    as it has blocks; blocks send back the sum and the square sum of their deviations. Many blocks are told from one batch. ``bound`` changes
    nothing, since each block can tell the entity's own deviation.
    """
    by, draws = ["position_code", "metric", "player_id"], settings.bootstrap_draws
    counted = long.where(F.col("x").isNotNull()).groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    sized = counted.groupBy(*by).agg(F.sum("c").alias("n")).where("n >= 3")
    blocks = F.least(F.greatest(F.ceil(F.col("n") * draws / DRAWN), F.lit(1)), F.lit(draws)).cast("int")
    dealt = joined(counted, sized.withColumn("blocks", blocks), by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = [*by, "block"]
    dealt = dealt.repartition(*each).withColumn("begins", F.row_number().over(Window.partitionBy(*each).orderBy("x")) == 1)

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        at = np.flatnonzero(rows["begins"].to_numpy(bool))
        first, ends = rows.iloc[at], np.append(at[1:], len(rows))
        x, c, found = rows["x"].to_numpy(float), rows["c"].to_numpy(np.int64), np.zeros((len(at), 3))
        for i, (low, high, player, metric, block, of, n) in enumerate(zip(at, ends, *[first[k].tolist() for k in ("player_id", "metric", "block", "blocks", "n")], strict=True)):
            mine = np.arange(block, draws, of, dtype=np.int64)
            seed = int(hashlib.md5(f"{player}:{metric}".encode()).hexdigest()[:7], 16)
            step = max(1, _TOGETHER // n)
            for k in range(0, len(mine), step):
                m = _bootstrap(x[low:high], c[low:high], seed, mine[k : k + step])
                found[i, :2] += m.sum(), (m * m).sum()
            found[i, 2] = _deviation(np.repeat(x[low:high], c[low:high])[None, :])[0]
        return first[[*by, "n"]].assign(total=found[:, 0], square=found[:, 1], mad=found[:, 2])

    def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last block, which the next batch may go on with
        for pdf in batches:
            begins = np.flatnonzero(pdf["begins"].to_numpy(bool))
            if len(begins):
                if whole := [p for p in (*held, pdf.iloc[: begins[-1]]) if len(p)]:
                    yield told(pd.concat(whole, ignore_index=True))
                held = []
            held.append(pdf.iloc[begins[-1] :] if len(begins) else pdf)
        if held:
            yield told(pd.concat(held, ignore_index=True))

    kinds = dict(long.dtypes)
    parts = dealt.select(*each, "blocks", "n", "x", "c", "begins").mapInPandas(of_blocks, ", ".join(f"{k} {kinds[k]}" for k in by) + ", n long, total double, square double, mad double")
    mean = F.sum("total") / draws
    return parts.groupBy(*by).agg(F.first("n").alias("n"), ((F.sum("square") / draws - mean * mean) * draws / (draws - 1)).alias("v"), F.max("mad").alias("mad"))


def scale_ratio(long: DataFrame, settings: Settings = DEFAULT, digits: int | None = None) -> DataFrame:
    """The ratio of ``informativeness`` for spreads, with each spread's variance by a bootstrap; rounded if ``digits`` are given.

    Draws depend on the entity and metric alone, not on how rows are dealt.
    """
    between = F.greatest(F.var_samp("mad") - F.avg("v"), F.lit(0.0))
    ratio = between / F.nullif(F.avg(F.col("n") * F.col("v")), F.lit(0.0))
    return bootstrap_spreads(long, settings).groupBy("position_code", "metric").agg((ratio if digits is None else F.round(ratio, digits)).alias("scale_ratio"))


def hyperparameters(long: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One small row for each position and metric; taken from clean rows only and passed on as it is."""
    by = ["position_code", "metric"]
    base = position_baselines(long)
    return base.join(informativeness(long), by, "left").join(overdispersion(long), by, "left").join(scale_ratio(long, settings), by, "left")


def own_weight(n: Column, ratio: Column) -> Column:
    """How far to trust the entity itself; an unknown ratio (infinite) trusts it wholly."""
    return F.when(ratio.isNull(), 1.0).otherwise(ratio * n / (ratio * n + 1.0))


def _without(stats: Column, x: Column) -> Column:
    """The median of the values but for one ``x`` of them."""
    even = stats["n"] % 2 == 0
    lower, upper = (stats["before"] + stats["middle"]) / 2, (stats["middle"] + stats["after"]) / 2
    around = (stats["before"] + stats["after"]) / 2
    odd = F.when(x < stats["middle"], upper).when(x > stats["middle"], lower).otherwise(around)
    return F.when(stats["n"] > 1, F.when(even, F.when(x <= stats["middle"], stats["after"]).otherwise(stats["middle"])).otherwise(odd))


def leave_one_out(long: DataFrame, pool: DataFrame | None = None, bound: int = selection.BOUND) -> DataFrame:
    """Median ``centre`` and deviation ``mad`` of an entity's other values of the metric, the centre shrunk towards the pool.

    ``pool`` has ``position_code``, ``metric``, ``pool_median`` and ``ratio``; without it nothing is shrunk.
    """
    return _left_out(long.where(F.col("x").isNotNull()), pool, bound)


def _left_out(long: DataFrame, pool: DataFrame | None, bound: int = selection.BOUND) -> DataFrame:
    """``leave_one_out`` of all rows, with nulls for those without a value. Entities of at most ``bound`` rows are moved once and sorted where they are."""
    by = ["player_id", "metric"]
    if pool is None:
        pooled = long.withColumns({"pool_median": F.lit(None).cast("double"), "ratio": F.lit(None).cast("double")})
    else:
        pooled = long.join(F.broadcast(pool.select("position_code", "metric", "pool_median", "ratio")), ["position_code", "metric"], "left")
    columns = [*long.columns, "others", "weight", "centre", "mad"]
    large = written(long.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select(*by), "large-entities")
    if not large.limit(1).count():
        return _left_out_in_place(pooled, by).select(*columns)
    small, hot = joined(pooled, large, by, "left_anti"), joined(pooled, large, by, "left_semi")
    unknown = hot.where(F.col("x").isNull()).withColumns({"others": F.lit(None).cast("long"), **{c: F.lit(None).cast("double") for c in ("weight", "centre", "mad")}})
    parts = [_left_out_in_place(small, by), _left_out_by_counts(hot.where(F.col("x").isNotNull()), by, bound), unknown]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


#: Names of an entity's three centres. Whatever its value, a row left out lies below, at or above the middle.
_PROBES = ("low", "at", "high")


def _with_centres(groups: DataFrame) -> DataFrame:
    """The centre of each probe and the ``weight`` of the entity's own, from its order statistics ``s`` and its pool."""
    w = own_weight((F.col("s.n") - 1).cast("double"), F.col("ratio"))
    shrunk = lambda m: F.when(w == 1.0, m).otherwise(w * m + (1 - w) * F.col("pool_median"))
    probes = dict(zip(_PROBES, (F.col("s.middle") - 1, F.col("s.middle"), F.col("s.middle") + 1), strict=True))
    return groups.withColumns({f"c_{k}": shrunk(_without(F.col("s"), v)) for k, v in probes.items()} | {"weight": w})


def _picked(found: DataFrame) -> DataFrame:
    # A value at the middle of an even number counts as one of the lower half.
    x, middle, even = F.col("x"), F.col("s.middle"), F.col("s.n") % 2 == 0
    pick = lambda p: F.when(x > middle, F.col(f"{p}_high")).when((x < middle) | even, F.col(f"{p}_low")).otherwise(F.col(f"{p}_at"))
    known = lambda c: F.when(x.isNotNull(), c)
    found = found.withColumn("centre", known(pick("c"))).withColumn("d", pick("d"))
    return found.withColumns({"others": known(F.col("s.n") - 1), "weight": known(F.col("weight")), "mad": known(_without(F.col("d"), F.abs(x - F.col("centre"))))})


def _left_out_in_place(pooled: DataFrame, by: list[str]) -> DataFrame:
    whole = Window.partitionBy(*by)
    found = selection.beside_middle(pooled.withColumns({c: F.first(c).over(whole) for c in ("pool_median", "ratio")}), by, {"s": F.col("x")})
    found = _with_centres(found)
    return _picked(selection.beside_middle(found, by, {f"d_{k}": F.abs(F.col("x") - F.col(f"c_{k}")) for k in _PROBES}))


def _left_out_by_counts(pooled: DataFrame, by: list[str], bound: int) -> DataFrame:
    rows = pooled.drop("pool_median", "ratio")
    of_group = pooled.groupBy(*by).agg(F.first("pool_median").alias("pool_median"), F.first("ratio").alias("ratio"))
    groups = joined(selection.around_middle(rows, by, "x", bound).select(*by, F.struct("n", "before", "middle", "after").alias("s")), of_group, by)
    groups = _with_centres(groups).drop("pool_median", "ratio")
    each = F.array(*[F.struct(F.lit(k).alias("probe"), F.abs(F.col("x") - F.col(f"c_{k}")).alias("away")) for k in _PROBES])
    away = joined(rows.select(*by, "x"), groups.select(*by, *[f"c_{k}" for k in _PROBES]), by).select(*by, F.inline(each))
    spread = selection.around_middle(away, [*by, "probe"], "away", bound).groupBy(*by)
    spread = spread.agg(*[F.max(F.when(F.col("probe") == k, F.struct("n", "before", "middle", "after"))).alias(f"d_{k}") for k in _PROBES])
    return _picked(joined(rows, joined(groups, spread, by, "left"), by))


def leave_one_out_sigma(long: DataFrame) -> DataFrame:
    """``sigma``: distance from the mean of the entity's other values in their standard deviations."""
    w = Window.partitionBy("player_id", "metric")
    n, s, q = F.count("x").over(w) - 1, F.sum("x").over(w) - F.col("x"), F.sum(F.col("x") * F.col("x")).over(w) - F.col("x") * F.col("x")
    rows = long.where(F.col("x").isNotNull()).withColumns({"others": n, "s": s, "q": q})
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("others")) / (F.col("others") - 1)
    sd = F.when((F.col("others") >= 2) & (variance > 1e-12), F.sqrt(variance))
    return rows.withColumn("sigma", F.when(F.col("others") >= 2, (F.col("x") - F.col("s") / F.col("others")) / sd)).drop("s", "q")


def _tails(k: np.ndarray, n: np.ndarray, p: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rho = np.maximum(rho, 1e-9)
    a, b = p * (1 - rho) / rho, (1 - p) * (1 - rho) / rho
    log = np.zeros(len(k))  # of P(0): the product of (b + j) / (a + b + j)
    for j in range(int(np.nanmax(n, initial=0))):
        log += np.where(j < n, np.log(np.maximum(b + j, 1e-300)) - np.log(a + b + j), 0.0)
    lower, below = np.zeros(len(k)), np.zeros(len(k))
    for i in range(int(np.nanmax(k, initial=-1)) + 1):
        mass = np.exp(log)
        lower += np.where(i <= k, mass, 0.0)
        below += np.where(i < k, mass, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log(np.maximum(n - i, 1e-300)) - np.log(i + 1) + np.log(np.maximum(a + i, 1e-300)) - np.log(np.maximum(b + n - i - 1, 1e-300))
        log += step
    missing = np.isnan(k + n + p + rho)
    return tuple(np.where(missing, np.nan, np.minimum(v, 1.0)) for v in (lower, below))


@F.pandas_udf(StructType([StructField("lower", DoubleType()), StructField("below", DoubleType())]))
def beta_binomial_tails(k: pd.Series, n: pd.Series, p: pd.Series, rho: pd.Series) -> pd.DataFrame:
    """P(K <= k) and P(K < k) of n draws at rate p whose rate spreads by rho; binomial where rho vanishes."""
    return pd.DataFrame(dict(zip(("lower", "below"), _tails(*(x.to_numpy(float) for x in (k, n, p, rho))), strict=True)))


# The rational approximations of the normal quantile in AS 241 (PPND16), numerators and denominators from the constant term up.
_CENTRAL = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    ratio = lambda fraction, x: np.polyval(fraction[0][::-1], x) / np.polyval(fraction[1][::-1], x)
    q = p - 0.5
    with np.errstate(invalid="ignore"):
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        tail = np.copysign(np.where(r <= 5, ratio(_NEAR, r - 1.6), ratio(_FAR, r - 5)), q)
        return np.where(np.abs(q) <= 0.425, q * ratio(_CENTRAL, 0.180625 - q * q), tail)


@F.pandas_udf(DoubleType())
def _quantile(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p.to_numpy(float)))


def criteria(long: DataFrame, fitted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What each row of each metric is held against, all of it from the entity's other rows and ``fitted``: ``centre`` and ``spread`` of the residual,
    ``mean`` and ``sd`` of the corroborating one, the rate ``p`` and ``rho`` of proportions, and the ``weight`` of the entity's own history.

    Order: shrink, put the position's value where nothing is known or the deviation is 0, say nothing if that is 0 too. The shrinkage of
    spreads and of rates counts the entity's rows, values or not; that of centres its values.
    """
    by = ["position_code", "metric"]
    pool = F.broadcast(fitted.select(*by, "pool_median", "pool_mad", "pool_rate", "ratio", "rho", "scale_ratio"))
    own = _left_out(long, fitted).drop("others").withColumnsRenamed({"centre": "own_centre", "mad": "own_mad"})
    w = Window.partitionBy("player_id", "metric")
    n, s, q = F.count("x").over(w) - F.col("x").isNotNull().cast("int"), F.sum("x").over(w) - F.coalesce("x", F.lit(0.0)), F.sum(F.col("x") * F.col("x")).over(w) - F.coalesce(F.col("x") * F.col("x"), F.lit(0.0))
    k_others, n_others = F.sum("k").over(w) - F.coalesce("k", F.lit(0.0)), F.sum("n").over(w) - F.coalesce("n", F.lit(0.0))
    sized = own.withColumns({"rows": F.count(F.lit(1)).over(w) - 1, "others": n, "s": s, "q": q, "k_others": k_others, "n_others": n_others})
    return _held(sized.join(pool, by, "left"), settings)


def _held(rows: DataFrame, settings: Settings) -> DataFrame:
    """What each row is held against, from the number, sums and squares of its entity's other values, their median and deviation, and the position's values."""
    ws = own_weight(F.col("rows").cast("double"), F.col("scale_ratio"))
    mad = F.coalesce(F.when(ws == 1.0, F.col("own_mad")).otherwise(ws * F.col("own_mad") + (1 - ws) * F.col("pool_mad")), "pool_mad")
    mad = F.when(mad == 0, F.col("pool_mad")).otherwise(mad)
    variance = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("others")) / (F.col("others") - 1), F.lit(0.0))
    known = F.col("others") >= 2
    sd = F.when(known, F.when(variance > 1e-12, F.sqrt(variance)).otherwise(0.0)).otherwise(settings.mad_to_sigma * F.col("pool_mad"))
    weight = own_weight(F.col("rows").cast("double"), F.col("ratio"))
    rate = F.col("k_others") / F.nullif(F.col("n_others"), F.lit(0.0))
    p = F.coalesce(F.when(weight == 1.0, rate).otherwise(weight * rate + (1 - weight) * F.col("pool_rate")), "pool_rate")
    return rows.select(
        *KEYS,
        "metric",
        "x",
        "k",
        "n",
        F.coalesce("own_centre", "pool_median").alias("centre"),
        (settings.mad_to_sigma * F.nullif(mad, F.lit(0.0))).alias("spread"),
        F.when(known, F.col("s") / F.col("others")).otherwise(F.col("pool_median")).alias("mean"),
        F.nullif(sd, F.lit(0.0)).alias("sd"),
        p.alias("p"),
        F.coalesce("rho", F.lit(0.0)).alias("rho"),
        "weight",
        (F.col("others") == 0).alias("of_position"),
        ((F.col("n") > 0) & (p > 0) & (p < 1)).alias("binomial"),
        (F.coalesce(F.when(ws == 1.0, F.col("own_mad")).otherwise(ws * F.col("own_mad") + (1 - ws) * F.col("pool_mad")), "pool_mad") == 0).alias("flat"),
    )


def _without_each(stats: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The median of each row's values but for one ``x`` of them; ``stats`` are their number and the values before, at and after the middle."""
    n, before, middle, after = (s[:, None] for s in stats)
    odd = np.where(x < middle, (middle + after) / 2, np.where(x > middle, (before + middle) / 2, (before + after) / 2))
    return np.where(n > 1, np.where(n % 2 == 0, np.where(x <= middle, after, middle), odd), np.nan)


def _around_middle(v: np.ndarray) -> tuple[np.ndarray, ...]:
    s, n, row = np.sort(v, axis=1), (~np.isnan(v)).sum(1), np.arange(len(v))
    k = (n + 1) // 2
    at = lambda i: np.where((i >= 1) & (i <= n), s[row, np.clip(i - 1, 0, v.shape[1] - 1)], np.nan)
    return n, at(k - 1), at(k), at(k + 1)


def leave_each_out(v: np.ndarray, pool: float | np.ndarray, ratio: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``leave_one_out`` for many histories, a row each: centre, deviation and weight of every place. ``pool`` and ``ratio``, of all or of each, may be not a number."""
    stats = _around_middle(v)
    n, middle = stats[0], stats[2]
    others = (n - 1).astype(float)
    ratio = np.broadcast_to(ratio, n.shape)
    w = np.where(np.isnan(ratio), 1.0, ratio * others / (ratio * others + 1.0))
    probes = []
    for probe in (middle - 1, middle, middle + 1):
        m = _without_each(stats, probe[:, None])[:, 0]
        probes.append(np.where(w == 1.0, m, w * m + (1 - w) * pool))
    x, mid, even = v, middle[:, None], (n % 2 == 0)[:, None]
    which = np.where(x > mid, 2, np.where((x < mid) | even, 0, 1))
    centre, spread = np.full(v.shape, np.nan), np.full(v.shape, np.nan)
    for k, c in enumerate(probes):
        mine = (which == k) & ~np.isnan(v)
        if mine.any():
            away = np.abs(v - c[:, None])
            centre = np.where(mine, c[:, None], centre)
            spread = np.where(mine, _without_each(_around_middle(away), away), spread)
    return centre, spread, np.where(np.isnan(v), np.nan, w[:, None])


#: Places of histories that are worked out together.
_PLACES = 1 << 17


def replaced(rows: DataFrame, changed: DataFrame, fitted: DataFrame, condition: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """The scoreable rows of an entity under each condition, which replaces one of its rows, ``target``, by the changed one: keys, ``condition``, metrics and their ``z_``.

    A condition travels as its one changed row. It meets the entity's rows once, in the task that holds them, where the old values go out of the sums and the
    order and the new ones come in. Conditions of many entities are taken together, in blocks of bounded size, and z is told at once, so histories are never made long.
    """
    proportions = [c for pair in PROPORTIONS.values() for c in pair]
    used = list(dict.fromkeys([*settings.metrics, *[c for c in proportions if c in rows.columns]]))
    numbers = [F.col(c).cast("double").alias(c) for c in used]
    kinds = dict(changed.dtypes) | dict(rows.dtypes)
    lacking = [F.lit(None).cast(kinds[c]).alias(c) for c in condition]
    swaps = changed.select("player_id", F.lit(None).cast(kinds["match_id"]).alias("match_id"), F.lit(None).cast(kinds["position_code"]).alias("position_code"), *condition, *numbers, F.lit(False).alias("asked"), F.lit(True).alias("swaps"))
    history = rows.join(changed.select("player_id").distinct(), "player_id", "left_semi")
    both = history.select(*KEYS, *lacking, *numbers, F.coalesce("is_scoreable", F.lit(False)).alias("asked"), F.lit(False).alias("swaps")).unionByName(swaps)
    # Work goes by conditions and not by bytes, so tasks aren't put together.
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    order = Window.partitionBy("player_id").orderBy("swaps", "match_id", *condition)
    both = both.repartition(tasks, "player_id").withColumn("begins", F.row_number().over(order) == 1)
    held = ("pool_median", "pool_mad", "pool_rate", "ratio", "rho", "scale_ratio")
    given = {(r["position_code"], r["metric"]): [np.nan if r[c] is None else r[c] for c in held] for r in fitted.select("position_code", "metric", *held).collect()}
    codes = sorted({c for c, _ in given if c is not None})
    # The last place stands for an unknown position.
    known = {m: np.array([given.get((c, m), [np.nan] * len(held)) for c in codes] + [[np.nan] * len(held)]) for m in settings.metrics}
    first = {m: np.array([given.get((c, m), [np.nan] * len(held)) for c in [*codes, None]]) for m in settings.metrics}
    place_of = {c: i for i, c in enumerate(codes)}

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        begins, swap = np.flatnonzero(pdf["begins"].to_numpy(bool)), pdf["swaps"].to_numpy(bool)
        matches, targets = pdf["match_id"].to_numpy(object), pdf["target"].to_numpy(object)
        position = np.array([place_of.get(c, len(codes)) for c in pdf["position_code"].to_numpy(object)])
        columns, asked = {c: pdf[c].to_numpy(float) for c in used}, pdf["asked"].to_numpy(bool)
        pairs = []
        for low, high in zip(begins, np.append(begins[1:], len(pdf)), strict=True):
            n = int((~swap[low:high]).sum())
            place = {m: i for i, m in enumerate(matches[low : low + n])}
            pairs += [(low, n, i, place[targets[i]]) for i in range(low + n, high) if targets[i] in place]
        pairs = np.array(sorted(pairs, key=lambda p: p[1]), np.int64).reshape(-1, 4)
        out, at = [], 0
        while at < len(pairs):
            # Histories of about as many rows; those with fewer are filled up.
            widths = pairs[at:, 1]
            part = pairs[at : at + max(1, int((np.arange(1, len(widths) + 1) * widths <= _PLACES).sum()))]
            at += len(part)
            low, n, by, target = part.T
            place = np.minimum(low[:, None] + np.arange(n.max()), len(pdf) - 1)
            filled, each = np.arange(n.max()) < n[:, None], np.arange(len(part))

            def values(c: str, place=place, filled=filled, each=each, target=target, by=by) -> np.ndarray:
                v = np.where(filled, columns[c][place], np.nan)
                v[each, target] = columns[c][by]
                return v

            keep = filled & asked[place]
            found = {c: pdf[c].to_numpy(object)[place[keep]] for c in KEYS} | {c: pdf[c].to_numpy()[np.broadcast_to(by[:, None], keep.shape)[keep]] for c in condition}
            for metric in settings.metrics:
                v = values(metric)
                k, m = (values(c) for c in PROPORTIONS[metric]) if metric in PROPORTIONS else (np.full(v.shape, np.nan),) * 2
                z = _replaced_z(v, k, m, n, known[metric][position[place]].transpose(2, 0, 1), first[metric][position[low]].T, settings)
                found |= {metric: v[keep], f"z_{metric}": z[keep]}
            out.append(pd.DataFrame(found))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})

    def of_entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last entity, which the next batch may go on with
        for pdf in batches:
            begins = np.flatnonzero(pdf["begins"].to_numpy(bool))
            if len(begins):
                if whole := [p for p in (*held, pdf.iloc[: begins[-1]]) if len(p)]:
                    yield told(pd.concat(whole, ignore_index=True))
                held = []
            held.append(pdf.iloc[begins[-1] :] if len(begins) else pdf)
        if held:
            yield told(pd.concat(held, ignore_index=True))

    z = [f"z_{m}" for m in settings.metrics]
    schema = {c: kinds[c] for c in [*KEYS, *condition]} | {c: "double" for pair in zip(settings.metrics, z, strict=True) for c in pair}
    names = list(schema)
    found = both.mapInPandas(of_entities, ", ".join(f"{c} {k}" for c, k in schema.items()))
    found = found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (*settings.metrics, *z)})
    return found.withColumn("max_abs_z", nulls_skipped(F.array_max, [F.abs(c) for c in z]))


def _replaced_z(v: np.ndarray, k: np.ndarray, m: np.ndarray, rows: np.ndarray, held: np.ndarray, first: np.ndarray, settings: Settings) -> np.ndarray:
    """``_held`` and ``against`` for many histories, a row each: ``k`` of ``m`` are the counts of a proportion, ``rows`` the numbers of their rows, ``held`` what ``fitted`` says for each place and ``first`` for each history."""
    pool_median, pool_mad, pool_rate, ratio, rho, scale_ratio = held
    centre, mad, _ = leave_each_out(v, first[0], first[3])
    others = (rows - 1.0)[:, None]
    own = lambda r: np.where(np.isnan(r), 1.0, r * others / (r * others + 1.0))
    mixed = lambda w, mine, pool: np.where(w == 1.0, mine, w * mine + (1 - w) * pool)
    or_else = lambda a, b: np.where(np.isnan(a), b, a)
    mad = or_else(mixed(own(scale_ratio), mad, pool_mad), pool_mad)
    mad = np.where(mad == 0, pool_mad, mad)
    rest = lambda a: np.nansum(a, 1)[:, None] - np.nan_to_num(a)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (v - or_else(centre, pool_median)) / (settings.mad_to_sigma * np.where(mad == 0, np.nan, mad))
        tried = rest(m)
        rate = np.where(tried == 0, np.nan, rest(k) / tried)
        p = or_else(mixed(own(ratio), rate, pool_rate), pool_rate)
        usable = (m > 0) & (p > 0) & (p < 1)
    if usable.any():
        lower, below = _tails(k[usable], m[usable], p[usable], np.nan_to_num(np.broadcast_to(rho, v.shape)[usable]))
        upper = np.maximum(1 - below, 0.0)
        size = np.abs(normal_quantile(np.clip(np.minimum(lower, upper), 1e-12, 0.5)))
        z[usable] = np.where(lower <= upper, -size, size)
    return z


def against(rows: DataFrame) -> DataFrame:
    """``z``, ``sigma`` and ``weight`` of values ``x`` (``k`` of ``n`` for proportions) held against their criteria.

    A proportion's z is the smaller tail of its count, with the side it lies on; other values' is the distance in spreads.
    """
    usable = (F.col("n") > 0) & (F.col("p") > 0) & (F.col("p") < 1)
    robust = (F.col("x") - F.col("centre")) / F.col("spread")
    given = lambda c: F.when(usable, F.col(c))
    tails = rows.withColumn("tails", beta_binomial_tails(given("k"), given("n"), given("p"), F.col("rho")))
    upper = F.greatest(1 - F.col("tails.below"), F.lit(0.0))
    size = F.abs(_quantile(F.least(F.greatest(F.least(F.col("tails.lower"), upper), F.lit(1e-12)), F.lit(0.5))))
    z = F.when(usable, F.when(F.col("tails.lower") <= upper, -size).otherwise(size)).otherwise(robust)
    sigma = (F.col("x") - F.col("mean")) / F.col("sd")
    return tails.withColumns({"z": z, "sigma": sigma}).drop("tails")


def beta_binomial(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """``z`` of true proportions: the smaller tail of the row's count given the entity's other rows."""
    lacking = {c: F.lit(None).cast("double") for c in ("pool_median", "pool_mad", "pool_rate", "ratio", "rho", "scale_ratio") if c not in fitted.columns}
    held = criteria(long, fitted.withColumns(lacking) if lacking else fitted).where((F.col("n") > 0) & (F.col("p") > 0) & (F.col("p") < 1))
    return against(held).select(*KEYS, "metric", "z")


def residuals(long: DataFrame, fitted: DataFrame, settings: Settings = DEFAULT, only: list[str] | None = None, carried: DataFrame | None = None) -> DataFrame:
    """``z``, ``sigma`` and ``weight`` of every row and metric.

    ``fitted`` comes from clean rows. With ``only`` just these metrics are computed, and ``carried`` (an
    earlier result) gives the others.
    """
    if only is not None:
        long = long.where(F.col("metric").isin(*only))
    found = against(criteria(long, fitted, settings)).select(*KEYS, "metric", "z", "sigma", "weight", "of_position", "binomial", "flat", F.col("x").isNotNull().alias("valued"))
    return found if only is None or carried is None else found.unionByName(carried.where(~F.col("metric").isin(*only)))


def wide_form(found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``z_``, ``sigma_`` and ``weight_`` columns of all metrics, with their summaries."""
    of = lambda v, m: F.max(F.when(F.col("metric") == m, F.col(v))).alias(f"{v}_{m}")
    rows = found.groupBy(*KEYS).agg(*[of(v, m) for v in ("z", "sigma", "weight") for m in settings.metrics])
    z = [F.abs(f"z_{m}") for m in settings.metrics]
    return rows.withColumns({"max_abs_z": nulls_skipped(F.array_max, z), "mean_abs_z": nulls_skipped(mean_of, z), "metrics_scored": nulls_skipped(F.size, z)})


def flag(rows: DataFrame, rate: float | None = None, settings: Settings = DEFAULT, bound: int = selection.BOUND) -> DataFrame:
    """``is_flagged`` rows at or above the quantile that leaves ``rate`` of rows (``flag_threshold``), with the metric that drives each."""
    rate = settings.flag_rate if rate is None else rate
    if not 0 < rate < 1:
        raise ValueError(f"rate is {rate}; it must lie between 0 and 1")
    bar = selection.quantiles(rows, [], "max_abs_z", {"flag_threshold": 1 - rate}, bound)
    driver = first_largest(list(settings.metrics), [F.abs(f"z_{m}") for m in settings.metrics])
    weights = F.create_map(*[x for m in settings.metrics for x in (F.lit(m), F.col(f"weight_{m}"))])
    rows = rows.crossJoin(F.broadcast(bar))  # one row
    return rows.withColumns({"is_flagged": F.coalesce(F.col("max_abs_z") >= F.col("flag_threshold"), F.lit(False)), "driving_metric": driver, "baseline_weight": F.try_element_at(weights, driver)})


def evidence(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The published columns: keys, which baseline, the evidence of each metric, the verdict."""
    # The published names and their order.
    keys, baseline = ("match_id", "player_id", "team_id", "position_code", "minutes_played"), ("baseline_matches", "baseline_weight", "metrics_scored")
    verdict = ("max_abs_z", "mean_abs_z", "driving_metric", "flag_threshold", "is_flagged")
    return rows.select(*keys, *baseline, *[c for m in settings.metrics for c in (m, f"z_{m}", f"sigma_{m}")], *verdict)


def scored_rows(rows: DataFrame, fitted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The scoreable of the prepared rows with their residuals."""
    found = residuals(long_form(rows, settings), fitted, settings)
    return rows.where("is_scoreable").join(wide_form(found, settings).drop("position_code"), ["player_id", "match_id"])


def score(mart: DataFrame, rate: float | None = None, settings: Settings = DEFAULT, counters: Observation | None = None) -> DataFrame:
    """From the mart to flagged rows with their evidence.

    ``counters`` observes the rows that baselines are made of (``own_rows``, ``baseline_rows``), and of all rows and metrics how many there are, how many had no other value of
    the entity and so the position's centre, how many values a deviation of 0, how many a count's tail for residual, and how many values none.
    The prepared rows feed every estimator, so they are written first, and so are the hyperparameters and the residuals.
    """
    rows = written(prepare(mart, settings), "prepared")
    long = long_form(rows, settings)
    found = residuals(long, written(hyperparameters(long, settings), "fitted"), settings)
    if counters is not None:
        own = F.count(F.lit(1)) / F.lit(len(settings.metrics))
        counts = {"own_rows": own.cast("long"), "baseline_rows": own.cast("long"), "values": F.count(F.lit(1)), "binomial_rows": F.count_if("binomial"), "position_substituted": F.count_if("of_position"), "zero_mad_substituted": F.count_if("flat"), "unusable": F.count_if(F.col("z").isNull() & F.col("valued"))}
        found = found.observe(counters, *[c.alias(n) for n, c in counts.items()])
    found = written(found, "residuals")
    scored = rows.where("is_scoreable").withColumn("baseline_matches", F.col("player_baseline_matches") - 1).join(wide_form(found, settings).drop("position_code"), ["player_id", "match_id"])
    return evidence(flag(scored, rate, settings), settings)
