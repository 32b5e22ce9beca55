"""How well scores find planted changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import selection
from plumbline.tables import joined


def auc(rows: DataFrame, score: str, hot: str, *by: str) -> DataFrame:
    """The chance that a hot row scores above a reference row, ties half; per group of ``by``.

    A null score sinks a hot row below all and leaves a reference row out. Rows of equal score are counted
    before they are ordered, so the window sorts distinct scores only.
    """
    value = F.when(F.col(hot) & F.col(score).isNull(), F.lit(float("-inf"))).otherwise(F.col(score))
    usable = rows.select(*by, value.alias("s"), F.col(hot).alias("h")).where(F.col("s").isNotNull())
    counts = usable.groupBy(*by, "s").agg(F.count(F.when(F.col("h"), 1)).alias("hot"), F.count(F.when(~F.col("h"), 1)).alias("cold"))
    below = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("hot") * (F.coalesce(F.sum("cold").over(below), F.lit(0)) + F.col("cold") / 2)
    done = counts.withColumn("wins", wins).groupBy(*by).agg((F.sum("wins") / F.nullif((F.sum("hot") * F.sum("cold")).cast("double"), F.lit(0.0))).alias("auc"))
    return done


def with_bars(records: DataFrame, bars: dict[str, float], scorer: str = "scorer") -> DataFrame:
    """Records with the ``bar`` of their scorer."""
    return records.withColumn("bar", F.create_map(*[x for s, b in bars.items() for x in (F.lit(s), F.lit(b))])[F.col(scorer)])


def cell_statistics(records: DataFrame, *by: str, bound: int = selection.BOUND) -> DataFrame:
    """Per cell: what was planted, what of it was caught, and what happened to the targets' other rows.

    ``records`` has ``clean`` and ``after`` scores, the ``bar``, ``is_target``, ``bit``, ``clipped``, ``short``, ``allocated``, ``achieved`` and
    ``achieved_z``. A row over the bar before the change is caught after it but not recovered. ``recovery_dosed`` counts rows that the
    change reached only; cells of recipes of several mechanisms (a column ``achieved_`` of one is there) have none, since there some
    step nearly always acts. ``auc`` compares the targets' scores after with those before. ``shift`` is the median change of the other rows
    that changed, ``shift_sd`` the same in standard deviations of their clean scores.
    """
    parts = [c for c in records.columns if c.startswith("achieved_") and not c.startswith("achieved_z")]
    composed = F.coalesce(*[F.col(c).isNotNull() for c in parts], F.lit(False)) if len(parts) < 2 else F.greatest(*[F.col(c).isNotNull() for c in parts])
    target, was, hit = F.col("is_target"), F.coalesce(F.col("clean") >= F.col("bar"), F.lit(False)), F.coalesce(F.col("after") >= F.col("bar"), F.lit(False))
    change = F.col("after") - F.col("clean")
    n, n_other = F.count_if(target), F.count_if(~target)
    stats = records.withColumn("_composed", composed).groupBy(*by).agg(
        F.max("bar").alias("bar"),
        F.max("_composed").alias("_composed"),
        n.alias("n"),
        F.count_if(target & hit).alias("_caught"),
        F.count_if(target & hit & ~was).alias("recovered"),
        F.count_if(target & F.col("short")).alias("n_short"),
        F.avg(F.when(target, F.col("allocated"))).alias("allocated"),
        F.count_if(target & F.col("bit")).alias("_dosed"),
        F.count_if(target & F.col("bit") & hit & ~was).alias("_recovered_dosed"),
        F.avg(F.when(target, F.col("achieved"))).alias("_achieved"),
        F.avg(F.when(target, F.col("achieved_z"))).alias("delivered_z"),
        F.count_if(target & F.col("clipped")).alias("_clipped"),
        F.count_if(~target & F.col("after").isNotNull()).alias("_measured"),
        F.count_if(~target & was).alias("_before"),
        F.count_if(~target & hit).alias("_after"),
        F.count_if(~target & (F.abs(change) > 1e-9)).alias("contaminated"),
        n_other.alias("n_other"),
        F.stddev_samp(F.when(~target, F.col("clean"))).alias("_spread"),
    )
    paired = records.where(target & F.col("clean").isNotNull())
    both = paired.select(*by, F.col("clean").alias("s"), F.lit(False).alias("hot")).union(paired.select(*by, F.col("after").alias("s"), F.lit(True).alias("hot")))
    shift = selection.median(records.where(~target & (F.abs(change) > 1e-9)).select(*by, change.alias("change")), list(by), "change", "shift", bound)
    told = joined(joined(stats, auc(both, "s", "hot", *by), list(by), "left"), shift, list(by), "left")
    share = lambda part, whole: F.col(part) / F.nullif(F.col(whole).cast("double"), F.lit(0.0))
    single, measurable = ~F.col("_composed"), F.col("_measured") > 0
    return told.select(
        *by, "bar", "n", share("_caught", "n").alias("caught"), share("recovered", "n").alias("recovery"), "recovered", "n_short", "allocated",
        F.when(single, F.col("_dosed")).otherwise(0).alias("n_dosed"), F.when(single, share("_recovered_dosed", "_dosed")).alias("recovery_dosed"),
        F.when(single, F.col("_recovered_dosed")).otherwise(0).alias("recovered_dosed"), "auc", F.when(single, F.col("_achieved")).alias("achieved"), "delivered_z", share("_clipped", "n").alias("clipped"),
        measurable.alias("collateral_measurable"), F.when(measurable, share("_before", "n_other")).alias("others_before"), F.when(measurable, share("_after", "n_other")).alias("others_after"),
        "contaminated", "n_other", F.when(measurable, F.col("shift")).alias("shift"), F.when(measurable, F.col("shift") / F.nullif("_spread", F.lit(0.0))).alias("shift_sd"),
    )


def strongest(records: DataFrame, value: str, *by: str) -> DataFrame:
    """The record of each group whose value lies furthest from 0; of equals the one that is last in the order of its columns."""
    held = records.where(F.col(value).isNotNull()).select(*by, F.struct(F.abs(value).alias("size"), F.struct("*").alias("record")).alias("r"))
    return held.groupBy(*by).agg(F.max("r").alias("r")).select("r.record.*")


def census_rates(scores: DataFrame, bars: dict[str, float]) -> DataFrame:
    """The share of rows at or over each scorer's bar."""
    return scores.agg(*[F.avg((F.col(c) >= b).cast("double")).alias(c) for c, b in bars.items()])


def agreement(found: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """For each ordered pair of flags: |A and B| / |A| and |A and B| / |A or B|, from one row for each key."""
    both = [(a, b) for a in names for b in names if a != b]
    one = found.select(*keys, *names).agg(
        *[x for i, (a, b) in enumerate(both) for x in (F.count_if(F.col(a) & F.col(b)).alias(f"i{i}"), F.count_if(F.col(a)).alias(f"a{i}"), F.count_if(F.col(a) | F.col(b)).alias(f"u{i}"))]
    )
    share = lambda i, k: F.col(f"i{i}") / F.nullif(F.col(f"{k}{i}").cast("double"), F.lit(0.0))
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), share(i, "a").alias("share_of_a"), share(i, "u").alias("jaccard")) for i, (a, b) in enumerate(both)])))


def target_agreement(choices: DataFrame, positions: DataFrame, least: int = 10) -> DataFrame:
    """For all players and for each position of at least ``least`` players: how often two scorers chose the same match, and each pair's players.

    ``choices`` has ``player_id``, ``scorer``, ``match_id`` and ``inherited``; a match that a scorer inherited isn't its choice. ``positions`` has a
    player's ``position_code``. The row of a scorer with itself tells its coverage: the share of the cut's players it chose for.
    """
    everyone = choices.select("player_id").distinct().join(positions.groupBy("player_id").agg(F.min("position_code").alias("position_code")), "player_id", "left")
    cut = everyone.select("player_id", F.explode(F.array(F.lit("all"), "position_code")).alias("cut")).where(F.col("cut").isNotNull())
    sizes = cut.groupBy("cut").agg(F.count(F.lit(1)).alias("players")).where((F.col("players") >= least) | (F.col("cut") == "all"))
    own = choices.where(~F.col("inherited")).groupBy("player_id").agg(F.collect_list(F.struct("scorer", "match_id")).alias("picks"))  # one for each scorer
    pairs = own.withColumn("a", F.explode("picks")).withColumn("b", F.explode("picks")).join(cut, "player_id")
    found = pairs.groupBy("cut", F.col("a.scorer").alias("a"), F.col("b.scorer").alias("b")).agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("a.match_id") == F.col("b.match_id")).alias("same"))
    return found.join(F.broadcast(sizes), "cut").select("cut", "a", "b", "players", "n_both", (F.col("same") / F.col("n_both")).alias("share"), (F.col("n_both") / F.col("players")).alias("coverage"))
