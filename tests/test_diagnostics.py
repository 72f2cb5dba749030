"""Paired diagnostics and evidence, by hand and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import diagnostics as D
from casewright.operators import evidence as E

VALUES = [("a", 1, 0.5, "x"), ("a", 2, 0.25, "x"), ("a", 3, 0.0, "y"), ("b", 1, 0.75, "x"), ("b", 2, 0.25, "x"), ("b", 3, 0.5, "y"), ("b", 4, 1.0, "y"), ("c", 1, None, "x"), ("c", 2, 0.9, None)]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(VALUES, "arm string, case_id int, m double, kind string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pairs_are_matched_by_case(values):
    p = D.paired(values, "arm", [("a", "b")], "case_id", ["m"], ["kind"])
    assert rows(D.pair_diagnostics(p), "n", "mean_one", "mean_two", "delta", "wins_one", "wins_two", "ties") == [(3, 0.25, 0.5, 0.25, 0, 2, 1)]
    assert rows(D.pair_diagnostics(p, ["kind"]), "kind", "n", "delta") == [("x", 2, 0.125), ("y", 1, 0.5)]
    assert D.paired(values, "arm", [("a", "none")], "case_id", ["m"]).count() == 0


def test_paired_test_of_few_equal_and_many_pairs(spark):
    d = [("few", 1.0), ("few", -1.0), ("same", 0.0), ("same", 0.0), ("same", 0.0), ("many", 1.0), ("many", 2.0), ("many", -3.0), ("many", 4.0), ("many", 0.0)]
    out = D.paired_p(D.paired_test(spark.createDataFrame(d, "g string, d double"), ["g"]))
    got = {r.g: r for r in out.collect()}
    assert (got["few"].test, got["few"].statistic, got["few"].p) == ("not_enough_pairs", None, None)
    assert (got["same"].test, got["same"].statistic, got["same"].p) == ("sign_count_fallback", 0.0, None)
    assert (got["many"].test, got["many"].n, got["many"].statistic) == ("wilcoxon_signed_rank", 5, 3.0)
    z = (3 - 5) / math.sqrt(4 * 5 * 9 / 24)
    assert got["many"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-5)


def test_forest_slices_and_grid(values):
    f = rows(D.forest(values.where("arm <> 'c'"), "arm", ["a"], ["b"], "kind", "case_id", "m"), "kind", "n", "d", "se", "low", "high")
    s = 0.125  # of 0.25 and 0
    assert f == [("x", 2, 1.0, round(s / math.sqrt(2), 4), round(1 - 1.96 * s / math.sqrt(2), 3), round(1 + 1.96 * s / math.sqrt(2), 3))]
    assert D.best_arm(values.where("case_id = 2"), "arm", ["a", "b"], "m").collect()[0].arm == "a"
    masks = {"early": F.col("case_id") < 3, "x": F.col("kind") == "x", "none": F.col("case_id") > 9}
    assert rows(D.slices(values, masks, "arm", "b", ["m"]), "slice", "variant", "full_mean", "variant_mean", "delta", "n_cases") == [("early", "a", 0.5, 0.375, 0.125, 2), ("early", "c", 0.5, 0.9, -0.4, 2), ("x", "a", 0.5, 0.375, 0.125, 2), ("x", "c", 0.5, None, None, 2)]
    grid = D.interaction(values.where("arm <> 'c'"), values.where("arm = 'c'"), "arm", "m")
    assert rows(grid, "one", "two", "effect_one", "effect_two", "combined") == [("a", "c", 0.25, 0.9, 0.575), ("b", "c", 0.625, 0.9, 0.7625)]


def test_stability_needs_the_same_order(spark):
    runs = [("s", 1, r, d, k) for r in (0, 1) for k, d in enumerate("ab", 1)] + [("s", 2, 0, "a", 1), ("s", 2, 0, "b", 2), ("s", 2, 1, "b", 1), ("s", 2, 1, "a", 2), ("s", 3, 0, "a", 1)]
    df = spark.createDataFrame(runs, "strategy string, case_id int, repeat int, doc string, rank int")
    assert rows(D.ranking_stability(df, ["strategy"], "case_id", "repeat", "doc"), "cases", "stable_cases", "stable_rate") == [(3, 2, 0.666667)]


def test_case_means_and_reviews(spark, values):
    assert rows(D.case_means(values, "case_id", ["m"]), "metric", "n_rows", "n_cases", "mean", "median") == [("m", 8, 4, round((0.625 + 1.4 / 3 + 0.25 + 1.0) / 4, 6), round((0.625 + 1.4 / 3) / 2, 6))]
    r = spark.createDataFrame([("A", "e1", "4"), ("A", "e2", "2"), ("A", " ", "5"), ("A", "e1", "none"), ("B", "e1", None)], "system string, rater string, s string")
    assert rows(D.review_scores(r, "system", "rater", ["s"]), "system", "dimension", "n", "mean", "std") == [("A", "s", 2, 3.0, 1.0)]


def test_effect_interval_against_python(spark):
    data = [(k, "a" if k % 2 else "b", float(k * k % 37)) for k in range(60)]
    df = spark.createDataFrame(data, "k int, g string, v double")
    from casewright.operators.resampling import weight

    w = {(r.k, r.b): r.w for r in df.select("k", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("b")).select("k", "b", weight(F.col("k"), F.col("b"), 42).alias("w")).collect()}
    ds = []
    for b in range(50):
        x, y = ([v for k, g, v in data if g == name for _ in range(w[k, b])] for name in "ab")
        mean = lambda s: sum(s) / len(s)
        inner = sum(sum((v - mean(s)) ** 2 for v in s) for s in (x, y))
        ds.append((mean(x) - mean(y)) / math.sqrt(inner / (len(x) + len(y) - 2)))
    ds.sort()
    at = lambda p: ds[int(p * 49)] + (p * 49 - int(p * 49)) * (ds[min(int(p * 49) + 1, 49)] - ds[int(p * 49)])
    got = D.effect_interval(df, "g", "k", "v", "a", "b", n=50).collect()[0]
    assert (got.low, got.high) == (pytest.approx(at(0.025), abs=1e-4), pytest.approx(at(0.975), abs=1e-4))
    assert D.effect_interval(df.where("k < 0"), "g", "k", "v", "a", "b", n=5).collect()[0].low is None


def plain_scan(text, position, markers, guards, reach=18):
    """The scan, place by place."""
    left, right = 0, len(text)
    for m in markers:
        at = 0
        while (found := text.find(m, at)) >= 0:
            at = found + len(m)
            side, cues = guards.get(m, ("", []))
            part = text[max(0, found - reach) : found] if side == "before" else text[at : at + reach]
            if side and not any(c in part for c in cues):
                continue
            if at <= position:
                left = max(left, at)
            elif found >= position:
                right = min(right, found)
    return left, right


def test_scan_against_python(spark):
    rng = random.Random(7)
    pieces = ["ab", ".", ", ", "und", "dass", "sagt", "weil", "x", " ", "\n", "é", "😀"]
    guards = {"und": ("after", ["weil", "x"]), "dass": ("before", ["sagt"])}
    marks = [".", ", ", "\n", "und", "dass"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "...", "und weil"]
    data = [(k, t, rng.randrange(len(t) + 1)) for k, t in enumerate(texts)]
    out = spark.createDataFrame(data, "k int, t string, p int").select("k", E.scan(F.col("t"), F.col("p"), marks, guards).alias("b")).collect()
    assert {r.k: (r.b.left, r.b.right) for r in out} == {k: plain_scan(t, p, marks, guards) for k, t, p in data}
    none = spark.range(1).select(E.scan(F.lit(None).cast("string"), F.lit(0), marks).alias("b")).first().b
    assert (none.left, none.right) == (0, 0)


def test_records_are_distinct_and_keep_case(spark):
    d = spark.createDataFrame([("No. He lost, WORK and hope. End", [8, 13, 4])], "t string, s array<int>")
    got = [tuple(r) for r in d.select(E.records(F.col("t"), F.col("s"), ["."], [","]).alias("r")).first().r]
    assert got == [("clause", 3, 11, "He lost"), ("sentence", 3, 26, "He lost, WORK and hope"), ("clause", 12, 26, "WORK and hope")]
    assert d.select(E.records(F.col("t"), F.lit(None).cast("array<int>"), ["."], []).alias("r")).first().r == []


def test_spans_past_and_distress(spark):
    span = "array<struct<keyword:string,start:int,end:int>>"
    d = spark.createDataFrame([(1, [("B", 5, 7), ("a", 5, 9), ("c", 0, 3), ("", 2, 4), ("d", 6, 6)]), (2, [("c", 0, 3)]), (3, None)], f"k int, g {span}")
    own = F.array(F.struct(F.lit("own").alias("keyword"), F.lit(1).alias("start"), F.lit(2).alias("end")))
    got = {r.k: [tuple(s) for s in r.c] for r in d.select("k", E.coerced(F.col("g"), own).alias("c")).collect()}
    assert got == {1: [("a", 5, 9), ("b", 5, 7)], 2: [("own", 1, 2)], 3: [("own", 1, 2)]}
    near = lambda gap: "long ago" + "." * gap + "word"
    t = spark.createDataFrame([(near(n), [(8 + n, 12 + n)]) for n in (3, 112, 113, 400)], "t string, s array<struct<start:int,end:int>>")
    assert [r.h for r in t.select(E.historic(F.col("t"), F.col("s"), "long ago").alias("h")).collect()] == [True, True, False, False]
    words = {"core": ["stress"], "impact": ["sleep"], "stressor": ["debt"], "severity": ["very"], "mild": ["a bit"]}
    cases = ["calm", "stress a bit debt", "stress a bit sleep", "very stress debt", "stress debt", "stress a bit very debt"]
    out = spark.createDataFrame([(c,) for c in cases], "t string").select(E.distress(F.array("t"), F.array().cast("array<string>"), words).alias("v")).collect()
    assert [(r.v.valid, r.v.mult) for r in out] == [(False, 0.25), (False, 0.25), (True, 1.0), (True, 0.85), (False, 0.35), (True, 0.85)]
