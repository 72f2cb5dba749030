"""The sweep of the score's parameters, by hand and by what has to hold of any."""

import math

import pytest
from pyspark.sql import functions as F

from casewright.operators import scoring

DDL = "case_id int, code string, name string, severity int, confidence double, keywords array<string>, matched array<string>, text string, denied_share double, gate_len double, gate_sub double"
ROWS = [
    (1, "F32", "low", 4, 0.8, ["sad", "blue"], ["sad"], "a sad day", 0.0, 1.0, 1.0), (1, "0801", "home", 2, 0.5, ["rent"], ["rent"], "rent is due", 1.0, 0.9, 0.85),
    (2, "F32", "low", 3, 1.0, ["sad"], ["sad"], "sad and low", 0.5, 1.0, 1.0), (3, "0801", "home", 5, 0.6, ["rent", "flat"], ["flat"], "a flat", 0.0, 0.7, 1.0),
]


def test_every_configuration_scores_the_same_cases_and_defaults_agree(spark):
    rows = {(r.parameter, r.value): r for r in scoring.swept(spark.createDataFrame(ROWS, DDL)).collect()}
    assert len(rows) == 45 and {r.n_scored for r in rows.values()} == {3}
    first = rows["default", 0.0]
    for name, default in scoring.DEFAULTS.items():
        assert rows[name, default].mean_score == first.mean_score and rows[name, default].change_percent == 0
    assert all(rows["beta", v].change_percent == 0 for v in scoring.SWEEPS["beta"])  # the score doesn't read it
    assert all(rows["margin", v].change_percent == 0 for v in scoring.SWEEPS["margin"])  # nor a margin without vectors
    assert rows["alpha", 2.0].mean_score > first.mean_score > rows["alpha", 0.25].mean_score
    assert rows["neg_lambda", 1.0].mean_phi < first.mean_phi < rows["neg_lambda", 0.3].mean_phi


def test_a_case_of_one_code_by_hand(spark):
    got = {(r.parameter, r.value): r for r in scoring.swept(spark.createDataFrame(ROWS[3:], DDL), {"alpha": [1.0, 2.0], "t_base": [0.5, 1.0]}).collect()}
    terms, idf = 3, math.log(1 + 500 / (1 + max(1.0, math.floor(3 * 8 * (1 - 0.5 * min(4 / 10, 1.0))))))  # rent, flat, home: 4 letters each
    for (name, value), t, a in ((("default", 0.0), 0.5, 1.0), (("alpha", 2.0), 0.5, 2.0), (("t_base", 1.0), 1.0, 1.0)):
        phi = 0.35 * 0.6 ** (1 / t) + 0.3 * (1 / terms) + 0.15 * 1 + 0.1 * min(1, max(0, (min(3.0, max(0.5, idf)) - 0.5) / 2.5)) + 0.1 * 0.7
        eff = 2 * a / (1 + math.exp(-(0.3 + 0.5 * 0.6 - 0.95)))
        boost = math.exp(min(3, eff * phi)) * (0.5 + 0.5 * 0.6)
        r = got[name, value]
        assert (r.mean_phi, r.mean_alpha, r.mean_boost, r.mean_score) == pytest.approx((phi, eff, boost, boost / 2), abs=2e-6) and r.std_score == 0


def test_likeness_counts_where_there_is_one(spark):
    near = spark.createDataFrame(ROWS, DDL).withColumn("near", F.lit(0.35))
    rows = {r.value: r for r in scoring.swept(near, {"margin": [0.1, 0.3, 0.5]}).collect() if r.parameter == "margin"}
    assert rows[0.1].mean_phi > rows[0.3].mean_phi >= rows[0.5].mean_phi


@pytest.mark.parametrize("sweeps", [{"alpha": [0.5, 2.0]}, {"alpha": [1.0, 1.0]}, {"other": [1.0]}])
def test_sweeps_must_be_known_and_hold_the_default_once(sweeps):
    with pytest.raises(ValueError):
        scoring.configuration_rows(sweeps)


def test_cases_without_codes_give_no_rows(spark):
    assert scoring.swept(spark.createDataFrame([], DDL)).collect() == []


def test_specificity_by_the_corpus(spark):
    codes = spark.createDataFrame([("a", "Rent", ["flat", "FLAT"]), ("b", None, ["nowhere"]), ("c", "", []), ("d", None, None)], "code string, name string, keywords array<string>")
    docs = spark.createDataFrame([("a flat",), ("RENT is due",), ("flat rent",), (None,), ("else",)], "text string")
    got = {r.code: (r.df, r.idf) for r in scoring.corpus_specificity(codes, docs, 4).collect()}
    assert got == {"a": (3, round(math.log(1 + 5 / 4), 6)), "b": (0, round(math.log(6), 6)), "c": (0, 1.0), "d": (0, 1.0)}
    assert {r.idf for r in scoring.corpus_specificity(codes, docs).collect()} == {3.0, 1.0}
