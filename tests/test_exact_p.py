"""Exact p of signed ranks against enumeration, and paired groups by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from casewright.functions import distributions as P
from casewright.operators import comparisons


def test_signed_ranks_equal_enumeration(spark):
    rows = []
    for n in range(1, 9):
        sums = [sum(k + 1 for k, on in enumerate(bits) if on) for bits in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            rows.append((n, float(w), min(1.0, 2 * sum(s <= w for s in sums) / 2**n)))
    rows += [(50, 434.0, 0.05), (51, 1.0, None)]
    got = spark.createDataFrame(rows, "n int, w double, want double").select("n", "want", P.signed_rank_p(F.col("n"), F.col("w")).alias("p")).collect()
    for r in got:
        if r.n == 51:
            assert r.p is None
        else:
            assert r.p == pytest.approx(r.want, abs=1e-12 if r.n < 50 else 1e-3)


def test_paired_groups(spark):
    one = [("a", k, float(k)) for k in range(6)]
    rows = one + [("b", k, float(k) + 0.1 * (k + 1)) for k in range(6)] + [("c", k, float(k)) for k in range(6)] + [("d", k, 1.0) for k in range(2)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r.one, r.two): r for r in comparisons.paired_groups(df, "g", "k", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    r = got["a", "b"]
    assert (r.test, r.n_pairs, r.n_nonzero, r.statistic, r.p, r.effect) == ("Wilcoxon, exact", 6, 6, 0.0, 0.03125, "large") and r.mean_diff == -0.35 and r.p_holm == 0.09375
    assert (got["a", "c"].test, got["a", "c"].p, got["a", "c"].statistic) == ("No difference", 1.0, 0.0)
    assert {(r.one, r.two) for r in comparisons.paired_groups(df, "g", "k", "v", reference="c").collect()} == {("c", "a"), ("c", "b")}


def test_a_case_that_a_group_has_twice_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 1.0), ("a", 2, 1.0), ("b", 2, 1.0), ("a", 3, 1.0), ("b", 3, 1.0)], "g string, k int, v double")
    with pytest.raises(Exception, match="twice"):
        comparisons.paired_groups(df, "g", "k", "v").collect()


def test_ties_take_the_normal_form(spark):
    df = spark.createDataFrame([("a", k, 0.0) for k in range(10)] + [("b", k, 1.0 if k < 8 else -1.0) for k in range(10)], "g string, k int, v double")
    r = comparisons.paired_groups(df, "g", "k", "v").first()
    assert r.test == "Wilcoxon" and r.statistic == 11.0 and 0.04 < r.p < 0.08
