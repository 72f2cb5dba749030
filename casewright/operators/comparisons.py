"""Descriptions of groups and tests of every pair of them, with p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import distributions as P

from . import statistics


def descriptives(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample spread, least, quartiles by interpolation, and greatest of each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), q.alias("q"), F.max(value).alias("most"))
    return g.select(group, "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", *[F.round(F.get("q", F.lit(k)), 6).alias(n) for k, n in enumerate(("q1", "median", "q3"))], "most")


def pairwise_t(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """one, two, n, paired, t, df of each pair of groups.

    Groups that hold the same keys, once each, are compared by paired
    differences, matched by key; others as independent samples with a pooled
    spread. Null values take no part; where nothing varies, t is null.
    """
    d = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    s = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("keys"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))
    each = lambda n: s.select(*[F.col(c).alias(f"{c}{n}") for c in s.columns])
    pairs = each(1).join(each(2), F.col("g1") < F.col("g2"))
    # matched values meet on the key, which a group holds once if it takes part
    one = s.where("n = keys").select("g")
    u = d.join(F.broadcast(one), "g", "left_semi")
    m = u.select("k", F.col("g").alias("g1"), F.col("v").alias("v1")).join(u.select("k", F.col("g").alias("g2"), F.col("v").alias("v2")), "k").where("g1 < g2")
    diff = m.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("both"), F.avg(F.col("v1") - F.col("v2")).alias("md"), F.var_samp(F.col("v1") - F.col("v2")).alias("sd2"))
    j = pairs.join(diff, ["g1", "g2"], "left").withColumn("paired", F.coalesce((F.col("both") == F.col("n1")) & (F.col("both") == F.col("n2")), F.lit(False)))
    df = F.when(F.col("paired"), F.col("n1") - 1).otherwise(F.col("n1") + F.col("n2") - 2)
    pooled = ((F.col("n1") - 1) * F.coalesce("s21", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("s22", F.lit(0.0))) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0))
    gap = F.when(F.col("paired"), F.col("md")).otherwise(F.col("m1") - F.col("m2"))
    error = F.sqrt(F.when(F.col("paired"), F.col("sd2") / F.col("n1")).otherwise(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    return j.select(F.col("g1").alias("one"), F.col("g2").alias("two"), "n1", "n2", "paired", F.round(gap / F.nullif(error, F.lit(0.0)), 6).alias("t"), df.alias("df"))


def pairwise_p(tests: DataFrame) -> DataFrame:
    """`pairwise_t` with p, 1 where nothing varies, and p_holm over the family."""
    d = tests.withColumn("p", F.round(F.coalesce(P.t_two_sided("t", F.col("df").cast("double")), F.lit(1.0)), 9)).withColumn("test", F.concat_ws("~", "one", "two"))
    return statistics.holm(d).drop("test")


def anova_p(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The one-way test with its p-value."""
    return statistics.anova(rows, group, value).withColumn("p", F.round(P.f_upper("f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")), 9))


def wilcoxon_p(differences: DataFrame, by: list[str]) -> DataFrame:
    """The signed-rank test with the p-value of its normal form; fewer than three pairs give none."""
    return statistics.wilcoxon(differences, by).withColumn("p", F.round(F.when(F.col("n") >= 3, P.z_two_sided("z")), 9))


def paired_groups(values: DataFrame, group: str, case: str, metric: str, reference: str | None = None, least: int = 3) -> DataFrame:
    """one, two, test, n_pairs, n_nonzero, statistic, p, p_holm, d, effect, mean_diff, median_diff, low and high of each pair of groups.

    Groups are matched by case; a case that a group has twice raises an error when
    the result is read. With `reference` it is the first of each pair, and other
    pairs go. Fewer than `least` cases make no pair. Where no case differs by more
    than 1e-8, p is 1. Else the test is of signed ranks: exact for up to 50 cases
    that all differ and don't tie, the normal form with its correction for ties
    otherwise. Tests for a normal distribution are left out, and so is the t-test.
    """
    d = values.groupBy(F.col(group).alias("g"), F.col(case).alias("c")).agg(F.first(metric).alias("v"), F.count(F.lit(1)).alias("k"))
    d = d.select("g", "c", F.when(F.col("k") == 1, F.col("v")).otherwise(F.raise_error(F.lit("a group has a case twice")).cast("double")).alias("v"))
    a, b = (d.select(F.col("g").alias(n), "c", F.col("v").alias(f"v_{n}")) for n in ("one", "two"))
    meant = F.col("one") < F.col("two") if reference is None else (F.col("one") == reference) & (F.col("two") != reference)
    pairs = a.join(b, "c").where(meant).withColumn("d", F.round(F.col("v_one") - F.col("v_two"), 12))
    by = ["one", "two"]
    x = F.col("d")
    every = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.abs(x) > 1e-15).alias("n_nonzero"), F.max(F.abs(x)).alias("_most"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.median(x).alias("median")).where(F.col("n_pairs") >= least)
    ranks = statistics.average_ranks(pairs.where("d <> 0").withColumn("m", F.abs("d")), by, F.col("m"))
    w = ranks.groupBy(*by).agg(F.least(F.sum(F.when(x > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(x < 0, F.col("r")).otherwise(0.0))).alias("w"), F.max("ties").alias("ties"), F.sum(F.col("ties") * F.col("ties") - 1.0).alias("t"))
    j = every.join(w, by, "left").withColumn("same", F.col("_most") <= 1e-8)
    n = F.col("n_nonzero")
    z = (F.col("w") - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("t") / 48.0)
    exact = (n == F.col("n_pairs")) & (F.col("ties") == 1) & (n <= P.EXACT)
    j = j.withColumn("p", F.when(F.col("same"), 1.0).otherwise(F.coalesce(F.when(exact, P.signed_rank_p(n, F.col("w"))), P.z_two_sided(z), F.lit(1.0))))
    effect = F.col("m") / (F.col("s") + 1e-10)
    size = F.when(F.abs(effect) >= 0.8, "large").when(F.abs(effect) >= 0.5, "medium").when(F.abs(effect) >= 0.2, "small").otherwise("negligible")
    test = F.when(F.col("same"), "No difference").when(exact, "Wilcoxon, exact").otherwise("Wilcoxon")
    r = lambda c, name: F.round(c, 6).alias(name)
    half = 1.96 * F.col("s") / F.sqrt("n_pairs")
    out = j.select(*by, test.alias("test"), "n_pairs", "n_nonzero", F.when(F.col("same"), 0.0).otherwise(F.col("w")).alias("statistic"), r(F.col("p"), "p"), r(effect, "d"), size.alias("effect"), r(F.col("m"), "mean_diff"), r(F.col("median"), "median_diff"), r(F.col("m") - half, "low"), r(F.col("m") + half, "high"))
    return statistics.holm(out.withColumn("pair", F.concat_ws(" ", *by)), "p", "pair").drop("pair")
