"""Ranking metrics from graded results, and summaries of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(graded: DataFrame, k: int, by: list[str]) -> DataFrame:
    """precision, recall, f1, ndcg at k, ap and rr of each group of (rank, grade, relevant).

    `relevant` is the number of relevant documents there are. Precision divides
    by what was returned up to k; the ideal order is that of what was returned.
    """
    best, order = Window.partitionBy(*by).orderBy(F.col("grade").desc(), "rank"), Window.partitionBy(*by).orderBy("rank")
    d = graded.withColumn("ideal", F.row_number().over(best)).withColumn("hits", F.sum((F.col("grade") > 0).cast("int")).over(order))
    hit, gain = F.col("grade") > 0, F.pow(F.lit(2.0), F.col("grade")) - 1
    at_k = F.col("rank") <= k
    m = d.groupBy(*by).agg(
        F.sum((hit & at_k).cast("int")).alias("tp"), F.sum(at_k.cast("int")).alias("returned"), F.max("relevant").alias("relevant"),
        F.sum(F.when(at_k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0)).otherwise(0.0)).alias("idcg"),
        F.sum(F.when(hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("prec_sum"), F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("returned")), safe(F.col("tp"), F.col("relevant"))
    m = m.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    rounded = {"precision": F.col("precision"), "recall": F.col("recall"), "f1": f1, "ndcg": ndcg, "ap": safe(F.col("prec_sum"), F.col("relevant")), "rr": F.coalesce(1.0 / F.col("first"), F.lit(0.0))}
    return m.select(*by, *[F.round(c, 6).alias(n) for n, c in rounded.items()])


def summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, population spread, median, least, most and count of each group."""
    v = F.col(value)
    parts = {"mean": F.avg(v), "std": F.stddev_pop(v), "median": F.percentile(v, F.lit(0.5)), "low": F.min(v), "high": F.max(v)}
    return values.groupBy(*by).agg(*[F.round(c, 6).alias(n) for n, c in parts.items()], F.count(v).alias("n"))


def set_metrics(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """`rows` with tp, fp, fn, precision, recall, f1, jaccard and exact of two arrays; two empty sets agree."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    d = rows.withColumns({"tp": F.size(F.array_intersect(e, p)), "fp": F.size(F.array_except(p, e)), "fn": F.size(F.array_except(e, p))})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b, empty: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty)), 6)
    return d.withColumns({"precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0), "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0), "jaccard": ratio(tp, tp + fp + fn, 1.0), "exact": (fp == 0) & (fn == 0)})
