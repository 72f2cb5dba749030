"""Paired tests, effect sizes and rater agreement as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """Differences b - a of rows with the same key, never by position."""
    return a.select(on, F.col(value).alias("a")).join(b.select(on, F.col(value).alias("b")), on).withColumn("d", F.round(F.col("b") - F.col("a"), 9))


def average_ranks(rows: DataFrame, by: list[str], value) -> DataFrame:
    """`rows` with `r`, the mean rank of equal values in each group."""
    w, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return rows.withColumn("ties", F.count(F.lit(1)).over(same)).withColumn("r", F.rank().over(w) + (F.col("ties") - 1) / 2.0)


def wilcoxon(differences: DataFrame, by: list[str]) -> DataFrame:
    """n, w_plus, w_minus, rank_biserial, z of the non-zero differences `d`, with tie correction."""
    d = average_ranks(differences.where("d <> 0").withColumn("m", F.abs("d")), by, F.col("m"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("ties") * F.col("ties") - 1.0).alias("t"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("t") / 48.0)
    return g.select(*by, "n", "w_plus", "w_minus", F.round((F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")), 6).alias("rank_biserial"), F.round((F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / spread, 6).alias("z"))


def holm(tests: DataFrame, p: str = "p", tie: str = "test") -> DataFrame:
    """Step-down adjusted p-values of one family."""
    w = Window.orderBy(p, tie)
    d = tests.withColumn("k", F.row_number().over(w)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    return d.withColumn("p_holm", F.round(F.least(F.lit(1.0), F.max((F.col("m") - F.col("k") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))), 6)).drop("k", "m")


def effect_sizes(rows: DataFrame, group: str, value: str, one: str, two: str) -> DataFrame:
    """Means, Cohen's d with the pooled sample spread, and Hedges' g of two groups."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    s = rows.agg(*[f(pick(g)).alias(f"{n}{k}") for k, g in (("1", one), ("2", two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    d = (F.col("m1") - F.col("m2")) / pooled
    return s.select("n1", "n2", F.round("m1", 6).alias("mean1"), F.round("m2", 6).alias("mean2"), F.round(d, 6).alias("d"), F.round(d * (1 - 3 / (4.0 * (F.col("n1") + F.col("n2")) - 9)), 6).alias("g"))


def cohen_kappa(rows: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """Agreement of two raters; linear weights count distance. Rows without both ratings go first."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count(F.lit(1)).alias("o"))
    one, two = cells.groupBy("i").agg(F.sum("o").alias("ri")), cells.groupBy(F.col("j").alias("jj")).agg(F.sum("o").alias("cj"))
    total = cells.agg(F.sum("o").alias("n"))
    cost = lambda i, j: F.abs(F.col(i) - F.col(j)) if weighted else (F.col(i) != F.col(j)).cast("int")
    seen = cells.agg(F.sum(cost("i", "j") * F.col("o")).alias("seen"))
    chance = one.join(F.broadcast(two)).agg(F.sum(cost("i", "jj") * F.col("ri") * F.col("cj")).alias("chance"))
    d = seen.join(chance).join(total)
    k = F.when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("n") / F.col("chance"))
    return d.select(F.col("n").cast("bigint").alias("n"), F.round(k, 6).alias("kappa"))


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F and eta squared, from sums of groups."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("n") * F.col("grand") * F.col("grand")
    f = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return s.select("k", F.col("n").cast("bigint").alias("n"), F.round(f, 4).alias("f"), F.round(between / (between + F.col("within")), 6).alias("eta2"))


def js_divergence(rows: DataFrame, group: str, value: str, one: str, two: str, bins: int = 20) -> DataFrame:
    """Kullback-Leibler and Jensen-Shannon divergence of two groups over shared bins, smoothed."""
    r = rows.where(F.col(group).isin(one, two))
    span = r.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    b = r.join(F.broadcast(span)).select(group, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) * bins)).alias("bin"))
    c = b.groupBy("bin").agg(F.count_if(F.col(group) == one).alias("x"), F.count_if(F.col(group) == two).alias("y"))
    every = r.sparkSession.range(bins).withColumnRenamed("id", "bin").join(c, "bin", "left").fillna(0)
    t = every.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    s = every.join(F.broadcast(t)).select(((F.col("x") / F.col("nx") + 1e-10) / (1 + bins * 1e-10)).alias("p"), ((F.col("y") / F.col("ny") + 1e-10) / (1 + bins * 1e-10)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return s.agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 5).alias("kl"), F.round(F.sum(F.col("p") * F.log(F.col("p") / m) / 2 + F.col("q") * F.log(F.col("q") / m) / 2), 5).alias("js"))


def kendall(ranks: DataFrame, by: list[str]) -> DataFrame:
    """tau, concordant and discordant pairs of two rankings (item, ra, rb) of each group.

    Rankings are cut to their first items before, so a group's are one array,
    whose pairs are counted in the row.
    """
    g = ranks.groupBy(*by).agg(F.collect_list(F.struct("ra", "rb")).alias("x")).where(F.size("x") > 1)
    sign = lambda a, b: F.signum(a["ra"] - b["ra"]) * F.signum(a["rb"] - b["rb"])
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: sign(a, b))))
    d = g.select(*by, pairs.alias("s"))
    up, down = F.size(F.filter("s", lambda v: v > 0)), F.size(F.filter("s", lambda v: v < 0))
    return d.select(*by, up.cast("bigint").alias("concordant"), down.cast("bigint").alias("discordant"), F.round((up - down) / F.size("s"), 6).alias("tau"))
