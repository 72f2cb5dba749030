"""Paired diagnostics of strategies: by metric, stratum and slice, over repeats, and of rated systems.

Strategies and systems are matched by case, never by position. Values that are
null take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import distributions as P

from . import retrieval, statistics
from .resampling import weight

#: A difference below this is a tie.
TIE = 1e-12


def long(values: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The keys, metric and value of each metric's column; null values go."""
    doubles = values.select(*keys, *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics])
    return doubles.unpivot(keys, metrics, "metric", "value").where("value IS NOT NULL")


def paired(values: DataFrame, arm: str, pairs: list[tuple[str, str]], case: str, metrics: list[str], by: list[str] = ()) -> DataFrame:
    """one, two, the case, `by`, metric, a, b and d = b - a of the stated pairs of arms.

    Each arm holds a case once. `by` are columns of a case that both arms share;
    null is a stratum of its own.
    """
    rows = long(values, [arm, case, *by], metrics)
    asked = values.sparkSession.createDataFrame(pairs, "one string, two string")
    a = rows.join(F.broadcast(asked), F.col(arm) == F.col("one")).select("one", "two", case, *by, "metric", F.col("value").alias("a"))
    b = rows.join(F.broadcast(asked), F.col(arm) == F.col("two")).select("one", "two", case, "metric", F.col("value").alias("b"))
    return a.join(b, ["one", "two", case, "metric"]).withColumn("d", F.col("b") - F.col("a"))


def pair_diagnostics(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, both means, their difference, wins and ties of each of `paired`'s pairs and metrics, and of each stratum."""
    d, n = F.col("d"), F.count(F.lit(1))
    return pairs.groupBy("one", "two", *by, "metric").agg(
        n.alias("n"), F.round(F.avg("a"), 6).alias("mean_one"), F.round(F.avg("b"), 6).alias("mean_two"), F.round(F.avg("d"), 6).alias("delta"),
        F.count_if(d < -TIE).alias("wins_one"), F.count_if(d > TIE).alias("wins_two"), F.count_if(F.abs(d) <= TIE).alias("ties"))


def paired_test(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, test, statistic of differences `d`: the smaller signed-rank sum, if there are three pairs.

    Under three pairs the test is `not_enough_pairs`, without a statistic. Where
    no pair differs it is `sign_count_fallback`, whose statistic is the wins less
    the losses, 0.
    """
    d = pairs.withColumn("d", F.round("d", 9))
    every = d.groupBy(*by).agg(F.count("d").alias("pairs"))
    w = statistics.wilcoxon(d, by).select(*by, F.least("w_plus", "w_minus").alias("w"), "z")
    j = every.join(w, by, "left")
    few, same = F.col("pairs") < 3, F.col("w").isNull()
    test = F.when(few, "not_enough_pairs").when(same, "sign_count_fallback").otherwise("wilcoxon_signed_rank")
    return j.select(*by, F.col("pairs").alias("n"), test.alias("test"), F.when(few, None).when(same, 0.0).otherwise(F.col("w")).alias("statistic"), F.when(~few, F.col("z")).alias("z"))


def paired_p(tests: DataFrame) -> DataFrame:
    """`paired_test` with p of its normal form; a test without a z has none."""
    return tests.withColumn("p", F.round(P.z_two_sided("z"), 9))


def best_arm(values: DataFrame, arm: str, arms: list[str], value: str) -> DataFrame:
    """One row, `arm`: the one of greatest mean, the first by name of equal ones."""
    means = values.where(F.col(arm).isin(arms)).groupBy(arm).agg(F.round(F.avg(value), 9).alias("m"))
    return means.agg(F.min_by(arm, F.struct(-F.col("m"), F.col(arm))).alias("arm"))


def forest(values: DataFrame, arm: str, baselines: list[str], enhanced: list[str], stratum: str, case: str, value: str) -> DataFrame:
    """The best enhanced arm against the best baseline in each stratum: stratum, n, d, se, low, high.

    d is the mean difference by its population spread, and its interval 1.96
    standard errors of the difference to each side. Strata of under two matched
    cases are left out.
    """
    side = lambda arms, name: values.join(F.broadcast(best_arm(values, arm, arms, value).select(F.col("arm").alias(arm))), arm).where(F.col(value).isNotNull()).select(case, stratum, F.col(value).cast("double").alias(name))
    d = side(baselines, "a").join(side(enhanced, "b").drop(stratum), case).withColumn("d", F.col("b") - F.col("a"))
    g = d.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_pop("d").alias("s")).where("n >= 2")
    effect, se = F.col("m") / (F.col("s") + 1e-10), F.col("s") / F.sqrt("n")
    return g.select(stratum, "n", F.round(effect, 3).alias("d"), F.round(se, 4).alias("se"), F.round(effect - 1.96 * se, 3).alias("low"), F.round(effect + 1.96 * se, 3).alias("high"))


def interaction(one: DataFrame, two: DataFrame, arm: str, value: str) -> DataFrame:
    """one, two, the mean of each and the mean of both, for every variant of one experiment and of another.

    A grid of means: a row for each arm of each side, which are few.
    """
    means = lambda d, name: retrieval.within(d.groupBy(F.col(arm).alias(name)).agg(F.avg(value).alias(f"m_{name}")), 1000)
    g = means(one, "one").join(means(two, "two"))
    return g.select("one", "two", F.round("m_one", 4).alias("effect_one"), F.round("m_two", 4).alias("effect_two"), F.round((F.col("m_one") + F.col("m_two")) / 2, 4).alias("combined"))


def slices(values: DataFrame, masks: dict[str, Column], arm: str, full: str, metrics: list[str]) -> DataFrame:
    """slice, variant, metric, both means, what the full arm has above it and its rows, for each variant.

    A row belongs to all slices whose mask holds. A slice without rows of the
    full arm or of the variant has no row for it; one without values has a null
    mean.
    """
    named = F.array_compact(F.array(*[F.when(mask, F.lit(name)) for name, mask in masks.items()]))
    rows = values.withColumn("slice", F.explode(named))
    g = rows.groupBy("slice", F.col(arm).alias("variant")).agg(F.count(F.lit(1)).alias("n_cases"), *[F.avg(f"`{m}`").alias(m) for m in metrics])
    m = g.unpivot(["slice", "variant", "n_cases"], metrics, "metric", "mean")
    whole = m.where(F.col("variant") == full).select("slice", "metric", F.col("mean").alias("full_mean"), "n_cases")
    rest = m.where(F.col("variant") != full).drop("n_cases").join(whole, ["slice", "metric"])
    return rest.select("slice", "variant", "metric", F.round("full_mean", 4).alias("full_mean"), F.round("mean", 4).alias("variant_mean"), F.round(F.col("full_mean") - F.col("mean"), 4).alias("delta"), "n_cases")


def ranking_stability(runs: DataFrame, by: list[str], case: str, repeat: str, item: str) -> DataFrame:
    """cases, and those whose ranked items are the same in every repeat (by, case, repeat, item, rank).

    A run's items are cut to the first ones before. A case with one repeat is stable.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item])
    lists = runs.groupBy(*by, case, repeat).agg(order.alias("items"))
    c = lists.groupBy(*by, case).agg((F.min("items") == F.max("items")).alias("same"))
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if("same").alias("stable_cases"), F.round(F.avg(F.col("same").cast("int")), 6).alias("stable_rate"))


def case_means(rows: DataFrame, case: str, metrics: list[str]) -> DataFrame:
    """metric, rows, cases, and mean, median and sample spread across the cases' means; one case has spread 0."""
    m = long(rows, [case], metrics).groupBy("metric", case).agg(F.count(F.lit(1)).alias("k"), F.avg("value").alias("v"))
    return m.groupBy("metric").agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"))


def system_comparison(ratings: DataFrame, system: str, case: str, one: str, two: str, scores: list[str], least: int = 5) -> DataFrame:
    """metric, n_cases, both means, their difference, the smaller signed-rank sum and its effect, for two rated systems.

    A case's ratings are averaged over raters first. Metrics of fewer than
    `least` cases are left out; where no case differs there is no statistic.
    """
    m = long(ratings.where(F.col(system).isin(one, two)), [system, case], scores).groupBy("metric", system, case).agg(F.avg("value").alias("v"))
    side = lambda name, c: m.where(F.col(system) == name).select("metric", case, F.col("v").alias(c))
    d = side(one, "a").join(side(two, "b"), ["metric", case]).withColumn("d", F.round(F.col("a") - F.col("b"), 9))
    g = d.groupBy("metric").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("a"), 4).alias("mean_one"), F.round(F.avg("b"), 4).alias("mean_two"), F.round(F.avg("d"), 4).alias("delta")).where(F.col("n_cases") >= least)
    w = statistics.wilcoxon(d, ["metric"]).select("metric", F.least("w_plus", "w_minus").alias("w"))
    n = F.col("n_cases")
    return g.join(w, "metric", "left").select("metric", "n_cases", "mean_one", "mean_two", "delta", F.round("w", 2).alias("statistic"), F.round(F.col("w") / F.sqrt(n * (n + 1) / 2), 4).alias("effect_r"))


def review_scores(ratings: DataFrame, system: str, rater: str, scores: list[str]) -> DataFrame:
    """system, dimension, n, mean and population spread of the whole numbers given; rows without a rater go."""
    known = ratings.where(F.trim(F.coalesce(F.col(rater).cast("string"), F.lit(""))) != "")
    whole = known.select(system, *[F.col(s).cast("string").try_cast("int").alias(s) for s in scores])
    g = long(whole, [system], scores).groupBy(system, F.col("metric").alias("dimension"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_pop("value"), 3).alias("std"))


def effect_interval(rows: DataFrame, group: str, key: str, value: str, one: str, two: str, level: float = 0.95, n: int = 1000, seed: int = 42) -> DataFrame:
    """low and high of Cohen's d of two groups: linear percentiles of replicates.

    Replicates weigh rows as in `resampling`. One without spread has d 0; one
    that leaves a group empty, or both with a row, has none.
    """
    d = rows.where(F.col(group).isin(one, two) & F.col(value).isNotNull()).select((F.col(group) == one).alias("_one"), F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    d = d.select("_one", "_v", "_key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate")).withColumn("_w", weight(F.col("_key"), F.col("replicate"), seed).cast("double")).where("_w > 0")
    # sums of a replicate's groups are all that is shuffled; values are taken from the first group's mean to keep digits
    base = rows.where(F.col(group) == one).agg(F.avg(F.col(value).cast("double")).alias("_c"))
    d = d.join(F.broadcast(base)).withColumn("_v", F.col("_v") - F.coalesce("_c", F.lit(0.0)))
    pick = lambda c, first: F.sum(F.when(F.col("_one") == first, c))
    w, v = F.col("_w"), F.col("_v")
    g = d.groupBy("replicate").agg(*[pick(c, first).alias(f"{name}{k}") for k, first in ((1, True), (2, False)) for name, c in (("n", w), ("s", w * v), ("q", w * v * v))])
    inner = lambda k: F.greatest(F.lit(0.0), F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}"))
    pooled = F.sqrt((inner(1) + inner(2)) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0.0)))
    gap = F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")
    e = g.select(F.when(pooled > 0, gap / pooled).when(pooled == 0, 0.0).alias("d"))
    p = F.percentile("d", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return e.agg(p.alias("p")).select(F.round(F.col("p")[0], 5).alias("low"), F.round(F.col("p")[1], 5).alias("high"))
