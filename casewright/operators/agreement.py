"""Agreement of many raters and rank tests of matched groups, as aggregates.

Every operator takes one row per rating. Ratings that are null go first.
Distances within a unit come from its counts and moments, never from pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .statistics import average_ranks


def fleiss_kappa(ratings: DataFrame, subject: str, category: str) -> DataFrame:
    """subjects and kappa; subjects with one rating don't count. Chance agreement of 1 gives 1."""
    cells = ratings.where(F.col(category).isNotNull()).groupBy(F.col(subject).alias("s"), F.col(category).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    m = F.sum("n").over(Window.partitionBy("s"))
    cells = cells.withColumn("m", m).where("m > 1")
    seen = cells.groupBy("s").agg(((F.sum(F.col("n") * F.col("n")) - F.first("m")) / (F.first("m") * (F.first("m") - 1))).alias("p")).agg(F.count(F.lit(1)).alias("subjects"), F.avg("p").alias("seen"))
    shares = cells.groupBy("c").agg(F.sum("n").alias("n")).agg((F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("chance"))
    k = F.when(F.col("chance") >= 1, 1.0).otherwise((F.col("seen") - F.col("chance")) / (1 - F.col("chance")))
    return seen.join(shares).select("subjects", F.round(k, 6).alias("kappa"))


def _complete(ratings: DataFrame, subject: str, rater: str, score: str) -> DataFrame:
    """s, r, v of those subjects that every rater has rated; the mean of repeated ratings."""
    d = ratings.where(F.col(score).isNotNull()).groupBy(F.col(subject).alias("s"), F.col(rater).alias("r")).agg(F.avg(score).alias("v"))
    k = d.agg(F.countDistinct("r").alias("k"))
    return d.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("s"))).join(k).where("m = k").select("s", "r", "v", "k")


def icc21(ratings: DataFrame, subject: str, rater: str, score: str, least: int = 10) -> DataFrame:
    """subjects, raters and ICC(2,1): two-way random effects, absolute agreement, one rater; null below `least` subjects."""
    d = _complete(ratings, subject, rater, score)
    rows = d.groupBy("s").agg(F.avg("v").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.var_pop("m").alias("vr"))
    columns = d.groupBy("r").agg(F.avg("v").alias("m")).agg(F.count(F.lit(1)).alias("k"), F.var_pop("m").alias("vc"))
    t = rows.join(columns).join(d.agg(F.var_pop("v").alias("vt")))
    n, k = F.col("n"), F.col("k")
    msr, msc = n * k * F.col("vr") / (n - 1), n * k * F.col("vc") / (k - 1)
    mse = n * k * (F.col("vt") - F.col("vr") - F.col("vc")) / ((n - 1) * (k - 1))
    below = msr + (k - 1) * mse + k * (msc - mse) / n
    return t.select(n.alias("subjects"), k.alias("raters"), F.when((n >= least) & (k > 1), F.round((msr - mse) / F.nullif(below, F.lit(0.0)), 6)).alias("icc"))


def friedman(ratings: DataFrame, subject: str, treatment: str, score: str) -> DataFrame:
    """subjects, treatments and the chi-square of mean ranks with tie correction; null for under three treatments or if all tie."""
    ranks = average_ranks(_complete(ratings, subject, treatment, score).withColumnRenamed("r", "treatment"), ["s"], F.col("v"))
    g = ranks.groupBy("treatment").agg(F.sum("r").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.col("ties") * F.col("ties") - 1.0).alias("t"))
    a = g.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("total") * F.col("total")).alias("q"), F.sum("t").alias("t"))
    n, k = F.col("n"), F.col("k")
    spread = 1 - F.col("t") / (n * k * (k * k - 1))
    chi = (12 * F.col("q") / (n * k * (k + 1)) - 3 * n * (k + 1)) / F.nullif(spread, F.lit(0.0))
    return a.select(n.alias("subjects"), k.alias("treatments"), F.when(k >= 3, F.round(chi, 5)).alias("chi2"))


def krippendorff(ratings: DataFrame, unit: str, value: str, level: str = "ordinal") -> DataFrame:
    """ratings and alpha by the published formula; fewer than two values give 1, no paired unit gives 0.

    `nominal` counts unequal values, `ordinal` squares the distance of the places
    of two values among all values, `interval` squares their difference.
    """
    d = ratings.where(F.col(value).isNotNull()).select(F.col(unit).alias("u"), F.col(value).alias("x"))
    scale = d.groupBy("x").agg(F.count(F.lit(1)).alias("c"))  # as many rows as the scale has values
    if level == "ordinal":
        places = scale.select("x", F.row_number().over(Window.orderBy("x")).cast("double").alias("v"))
        d = d.join(places, "x").select("u", "x", "v")
    else:
        d = d.withColumn("v", F.col("x").cast("double")) if level == "interval" else d.withColumn("v", F.lit(0.0))
    cells = d.groupBy("u", "x", "v").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("m", F.sum("n").over(Window.partitionBy("u"))).where("m > 1")

    def apart(rows: DataFrame, by: list[str]) -> DataFrame:
        """The distances of all ordered pairs of ratings in each group, from its moments."""
        n, v = F.col("n").cast("double"), F.col("v")
        size = F.sum(n)
        pairs = size * size - F.sum(n * n) if level == "nominal" else 2 * (size * F.sum(n * v * v) - F.sum(n * v) * F.sum(n * v))
        return rows.groupBy(*by).agg(size.alias("size"), pairs.alias("apart"))

    seen = apart(cells, ["u"]).agg(F.sum("size").alias("total"), F.sum(F.col("apart") / (F.col("size") - 1)).alias("seen"))
    chance = apart(cells.groupBy("x", "v").agg(F.sum("n").alias("n")), []).select(F.col("apart").alias("chance"))
    t = seen.join(chance).join(scale.agg(F.count(F.lit(1)).alias("values")))
    alpha = F.when(F.col("values") < 2, 1.0).when(F.col("total").isNull(), 0.0).when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") * (F.col("total") - 1) / F.col("chance"))
    return t.select(F.coalesce(F.col("total").cast("bigint"), F.lit(0)).alias("ratings"), F.round(alpha, 6).alias("alpha"))
