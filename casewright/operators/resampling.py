"""Bootstrap intervals and paired comparison, resampled in parallel.

Each replicate weighs each row by a Poisson(1) number that row and replicate
decide. Rows need no numbers and meet no others, so that sums are combined
before the shuffle, however many rows a group has; reruns agree.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chances that a Poisson(1) number is at most 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def weight(key: Column, replicate: Column, seed: int) -> Column:
    """How often the replicate takes the row."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"), F.lit(str(seed)))), 1, 8)
    u = (F.conv(digits, 16, 10).cast("bigint") + 0.5) / 4294967296.0
    return sum(((u > c).cast("int") for c in POISSON[1:]), (u > POISSON[0]).cast("int"))


def replicates(rows: DataFrame, by: list[str], key: str, value: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """The group's columns, `replicate` and `mean`; null values go, replicates without rows have none."""
    d = rows.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    d = d.select(*by, "_v", "_key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate")).withColumn("_w", weight(F.col("_key"), F.col("replicate"), seed)).where("_w > 0")
    return d.groupBy(*by, "replicate").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"))


def percentile_interval(rows: DataFrame, by: list[str], key: str, value: str, level: float = 0.95, n: int = 1000, seed: int = 42) -> DataFrame:
    """low and high of the mean: linear percentiles of the replicates."""
    p = F.percentile("mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return replicates(rows, by, key, value, n, seed).groupBy(*by).agg(p.alias("p")).select(*by, F.round(F.col("p")[0], 5).alias("low"), F.round(F.col("p")[1], 5).alias("high"))


def _cuts(share: float, push: float, level: float) -> tuple[float, float]:
    """The shares of replicates at which the corrected interval ends."""
    normal = NormalDist()
    z0 = normal.inv_cdf(share)
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(normal.cdf(z0 + z / (1 - push * z)))
    return ends[0], ends[1]


def bca_interval(rows: DataFrame, by: list[str], key: str, value: str, level: float = 0.95, n: int = 1000, seed: int = 42) -> DataFrame:
    """n, mean, low and high, corrected for bias and acceleration; under three rows or without spread both ends are the mean.

    Leaving a row out moves the mean by (x - mean) / (n - 1), so the acceleration
    comes from the third and second moment. The `n` replicates of a group are
    one array, whose length the parameter bounds.
    """
    v = F.col(value).cast("double")
    m = rows.where(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.skewness(v), F.lit(0.0)).alias("skew"))
    reps = replicates(rows, by, key, value, n, seed).groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("reps"))
    d = m.join(reps, by) if by else m.join(reps)

    @F.pandas_udf("struct<low double, high double>")
    def ends(count: pd.Series, mean: pd.Series, skew: pd.Series, reps: pd.Series) -> pd.DataFrame:
        out = []
        for c, t, s, r in zip(count, mean, skew, reps):
            if c < 3 or r[0] == r[-1]:
                out.append((t, t))
                continue
            below = (sum(x < t for x in r) + 0.5 * sum(x == t for x in r)) / len(r)
            share = min(max(below, 0.5 / len(r)), 1 - 0.5 / len(r))
            places = [q * (len(r) - 1) for q in _cuts(share, s / (6 * math.sqrt(c)), level)]
            out.append(tuple(r[int(p)] + (p - int(p)) * (r[min(int(p) + 1, len(r) - 1)] - r[int(p)]) for p in places))
        return pd.DataFrame(out, columns=["low", "high"])

    e = d.select(*by, "n", "mean", ends("n", "mean", F.when(F.isnan("skew"), 0.0).otherwise(F.col("skew")), "reps").alias("e"))
    return e.select(*by, "n", F.round("mean", 6).alias("mean"), F.round("e.low", 6).alias("low"), F.round("e.high", 6).alias("high"))


def paired_shares(differences: DataFrame, by: list[str], key: str, value: str = "d", rope: float = 0.01, n: int = 1000, seed: int = 42) -> DataFrame:
    """Shares of replicates whose mean difference is above, within and below the region of equivalence."""
    r = replicates(differences, by, key, value, n, seed)
    m, total = F.col("mean"), F.count(F.lit(1))
    return r.groupBy(*by).agg(F.round(F.count_if(m > rope) / total, 5).alias("better"), F.round(F.count_if(F.abs(m) <= rope) / total, 5).alias("same"), F.round(F.count_if(m < -rope) / total, 5).alias("worse"))
