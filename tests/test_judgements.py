"""Judgements of kinds of cases, against each pair judged by its own codes."""

import random

from pyspark.sql import functions as F

from casewright.operators import diagnostics, evaluation, service


def test_judgements_by_kind_of_case(spark):
    """Cases of one kind are judged once, and as each pair's own codes judge it."""
    words = [["a", "b", "c"], ["b", "B"], ["x"], ["a", None]]
    rng = random.Random(3)
    judged = spark.createDataFrame([(c, str(j), s, w) for c in range(20) for j, (s, w) in enumerate(rng.choice([[(3, words[0])], [(1, words[1]), (5, words[2])], [(2, words[0]), (4, words[2]), (None, words[3])]]))], "case_id long, code string, severity int, keywords array<string>")
    docs = spark.createDataFrame([(i, "".join(rng.choice("ABCXyz ") for _ in range(4))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    j = evaluation.judgements(judged, docs)
    pairs = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_text")).join(judged)
    want = sorted(map(tuple, service.grades(pairs).where("grade > 0").collect()))
    assert j.cases.select("kind").distinct().count() == 3 and j.grades.count() < len(want)
    assert sorted(map(tuple, evaluation.qrels(judged, docs).collect())) == want
    hits = spark.createDataFrame([(c, i, i + 1) for c in range(22) for i in range(9)], "case_id long, doc_id long, rank int")
    key = lambda df: sorted(map(tuple, df.select("case_id", "doc_id", "rank", "grade", "relevant").collect()))
    assert key(evaluation.graded(hits, j)) == key(evaluation.graded(hits, evaluation.qrels(judged, docs)))


def test_reports_on_evaluated_runs_read_the_judgements_no_more(spark):
    """What a report reads is a row for each strategy and case, however often it reads them."""
    judged = spark.createDataFrame([(c, "f", 3, ["a", "b"][: 1 + c % 2]) for c in range(6)], "case_id long, code string, severity int, keywords array<string>")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a", "b", "none"])], "doc_id long, text string")
    runs = spark.createDataFrame([(s, c, (c * r + k) % 4, r) for k, s in enumerate(["one", "two"]) for c in range(6) for r in (1, 2)], "strategy string, case_id long, doc_id long, rank int")
    values = evaluation.evaluated(runs, evaluation.judgements(judged, docs))
    tests = diagnostics.paired_test(diagnostics.paired(values, "strategy", [("one", "two")], "case_id", ["ap", "rr", "ndcg"]), ["one", "two", "metric"])
    plan = tests._jdf.queryExecution().optimizedPlan().toString()
    assert "grade" not in plan and "doc_id" not in plan and plan.count("Relation [") == 4
    assert [r.n for r in tests.collect()] == [6, 6, 6]
