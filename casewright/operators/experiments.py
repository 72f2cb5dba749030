"""Comparisons of experiment arms: stability, wins, changes of rankings, contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stability(rows: DataFrame, by: list[str], case: str, answer: str, repeats: int) -> DataFrame:
    """cases and the share of them whose answer is the same in all repeats; cases with fewer repeats are left out."""
    c = rows.groupBy(*by, case).agg(F.countDistinct(answer).alias("answers"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= repeats)
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("answers") == 1).cast("int")), 6).alias("stable"))


def paired_arms(rows: DataFrame, arm: str, keys: list[str], value: str) -> DataFrame:
    """one, two, n, wins of one, of two, ties and mean difference of each pair of arms, matched by the keys."""
    a = rows.select(*keys, F.col(arm).alias("one"), F.col(value).alias("a"))
    b = rows.select(*keys, F.col(arm).alias("two"), F.col(value).alias("b"))
    d = a.join(b, keys).where("one < two").withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 1e-12).alias("wins_one"), F.count_if(F.col("d") < -1e-12).alias("wins_two"), F.count_if(F.abs("d") <= 1e-12).alias("ties"), F.round(F.avg("d"), 5).alias("mean_delta"))


def ranking_changes(one: DataFrame, two: DataFrame, case: str, item: str, k: int) -> DataFrame:
    """case, same_set and same_order of the first k items (item, rank) of two arms; an arm may lack a case."""
    top = lambda d, name: d.where(F.col("rank") <= k).groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias(name))
    d = top(one, "x").join(top(two, "y"), case, "full")
    x, y = F.coalesce("x", F.array()), F.coalesce("y", F.array())
    return d.select(case, (F.array_sort(x) == F.array_sort(y)).alias("same_set"), (x == y).alias("same_order"))


def score_distance(one: DataFrame, two: DataFrame, keys: list[str], value: str, least: float = 0.001) -> DataFrame:
    """n, mean, greatest and number of differences above `least` of matched scores."""
    d = one.select(*keys, F.col(value).alias("a")).join(two.select(*keys, F.col(value).alias("b")), keys).select(F.abs(F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.count("d").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("most"), F.count_if(F.col("d") > least).alias("moved"))


def contributions(means: DataFrame, arm: str, value: str, full: str) -> DataFrame:
    """arm and what the full arm has above it."""
    whole = means.where(F.col(arm) == full).agg(F.max(value).alias("whole"))
    return means.where(F.col(arm) != full).join(whole).select(arm, F.round(F.col("whole") - F.col(value), 6).alias("contribution"))


def detector_aggregate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro and macro precision, recall and f1 of rows with tp, fp, fn, f1 and exact."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    out = {"micro_precision": ratio(tp, tp + fp), "micro_recall": ratio(tp, tp + fn), "micro_f1": ratio(2 * tp, 2 * tp + fp + fn), "macro_f1": F.round(F.avg("f1"), 6), "exact_rate": F.round(F.avg(F.col("exact").cast("int")), 6)}
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[c.alias(n) for n, c in out.items()])
