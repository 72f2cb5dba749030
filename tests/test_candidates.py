"""Denied candidates and told events, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from casewright.operators import candidates as C

D = C.Denials(["not ", "never "], [",", ";", ".", " but "], [",", ";", ".", " because"], [(["10"], ["money"], ["not enough money"])])
#: text, code, category, matched, what is denied
TEXTS = [
    ("he is not sad today", "F32", "mood", ["sad"], ["sad"]), ("he is sad, not glad", "F32", "mood", ["sad"], []), ("not now, but sad", "F32", "mood", ["sad"], []), ("he was not there because sad news came", "F32", "mood", ["sad"], []),
    ("not one of those long days on which he is sad", "F32", "mood", ["sad"], []), ("not twenty eight letters off. not sad and sad", "F32", "mood", ["sad"], ["sad"]), ("there is not enough money left", "1005", "x", ["money"], []), ("there is not enough money left", "12", "about money", ["money"], []),
    ("there is not enough money left", "12", "work", ["money"], ["money"]), ("never sad nor low", "F32", "mood", ["sad", "low"], ["sad", "low"]), ("", "F32", "mood", ["sad"], []), (None, "F32", "mood", ["sad"], []), ("not low mood", "F32", "mood", [], ["low mood"]), ("not sad", "F32", None, None, []),
]


def test_denials_reach_their_clause(spark):
    rows = [(k, t, c, g, m, "Low mood") for k, (t, c, g, m, _) in enumerate(TEXTS)]
    out = C.polarity(spark.createDataFrame(rows, "case_id int, text string, code string, category string, matched array<string>, name string"), D).collect()
    for r in out:
        assert r.negated_terms == TEXTS[r.case_id][4], (TEXTS[r.case_id], r)
        assert (r.gate, r.negated) == ((0.4, True) if r.negated_terms else (1.0, False))


def test_given_spans_go_before_derived_ones(spark):
    rows = [("not sad and sad", [("Sad", 12, 15, "match", False)]), ("not sad and sad", [("sad", 0, 3, "", False), ("sad", 90, 93, "", False)]), ("not sad and sad", None)]
    df = spark.createDataFrame(rows, f"text string, matched_spans array<{C._SPAN}>").select("text", "matched_spans", F.lit("F32").alias("code"), F.lit("").alias("category"), F.array(F.lit("sad")).alias("matched"), F.lit("").alias("name"))
    assert [r.negated_terms for r in C.polarity(df, D).collect()] == [["sad"], ["sad"], ["sad"]]
    spans = df.select(C.match_spans(F.col("text"), F.col("matched"), F.col("matched_spans")).alias("s")).collect()
    assert [[(x.start, x.end) for x in r.s] for r in spans] == [[(12, 15)], [(4, 7), (12, 15)], [(4, 7), (12, 15)]]


def test_the_gate_filters_and_keeps(spark):
    rows = [(1, 0.9, False, 0.4, True), (2, 0.9, False, 1.0, False), (3, 0.5, True, 0.4, True), (4, 0.33333, True, 1.0, False), (5, None, False, 1.0, False)]
    items = spark.createDataFrame(rows, "k int, confidence double, filtered boolean, gate double, negated boolean")
    on = {r.k: (r.before, r.after, r.confidence, r.filtered) for r in C.gated(items).collect()}
    assert on == {1: (0.9, 0.36, 0.36, True), 2: (0.9, 0.9, 0.9, False), 3: (0.5, 0.2, 0.2, True), 4: (0.33333, 0.3333, 0.33333, True), 5: (0.0, 0.0, 0.0, False)}
    assert {r.k: (r.confidence, r.filtered) for r in C.gated(items, False).collect()}[1] == (0.9, False)


def _span(k, a, b, scope="match", adjusted=False):
    return (k, a, b, scope, adjusted)


@pytest.fixture
def events(spark):
    rows = [(1, "e1", 10, 40, "father", "child", "hit", ["hit", "beat"], [(20, 23)]), (1, "e2", 300, 330, "friend", "", "hit", ["hit"], []), (2, "e1", 900, 950, "mother", "child", "hit", None, None), (3, "e1", 5, 9, "a", "b", "sang", ["sang"], None)]
    return spark.createDataFrame(rows, "case_id int, event_id string, start int, end int, agent string, target string, action string, actions array<string>, supports array<struct<start:int,end:int>>")


def test_the_event_that_scores_most_tells_the_relation(spark, events):
    rows = [
        (1, "in", ["was hit"], [_span("was hit", 18, 25)], [_span("", 10, 41, "clause")]),  # the match lies within e1 and meets its support
        (1, "far", ["hit"], [_span("hit", 310, 313)], []),  # within e2, which has no target
        (1, "adjusted", ["hit"], [_span("hit", 330, 333, "match", True)], []),  # touches e2
        (2, "beyond", ["hit"], [_span("hit", 5, 8)], []),  # 892 characters away
        (3, "other", ["hit"], [_span("hit", 5, 8)], []),  # no event of that action
        (4, "none", ["hit"], [_span("hit", 5, 8)], []), (1, "spanless", ["hit"], [], []), (1, "kept out", ["hit"], [_span("hit", 18, 21)], []),
    ]
    items = spark.createDataFrame(rows, f"case_id int, name string, terms array<string>, matches array<{C._SPAN}>, evidences array<{C._SPAN}>")
    got = {r.name: (r.relation, r.event_id, r.score) for r in C.relations(items, events, F.col("name") != "kept out").collect()}
    assert got["in"] == ("father -> hit -> child", "e1", 220 + 240 + 320)
    assert got["far"] == ("friend -> hit", "e2", 220 + 240 + 320)
    assert got["adjusted"] == ("friend -> hit", "e2", 220 + 260 + 320)
    assert all(got[k] == ("unclear", None, None) for k in ("beyond", "other", "none", "spanless", "kept out"))


def test_distance(spark):
    rows = [(0, 5, 5, 9, 0), (0, 5, 3, 9, 0), (0, 5, 8, 9, 3), (8, 9, 0, 5, 3)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want int")
    s = lambda x, y: F.struct(F.col(x).alias("start"), F.col(y).alias("end"))
    assert all(r.got == r.want for r in df.select(C.distance(s("a", "b"), s("c", "d")).alias("got"), "want").collect())


def test_report_counts_all_and_each_slice_once(spark):
    rows = [("long", 5, True, True), ("long", 1, False, True), ("short", 1, False, False), ("short", 5, True, False), (None, 5, False, False)]
    got = {(r.slice, r.value): r for r in C.report(spark.createDataFrame(rows, "length string, severity int, expected boolean, predicted boolean"), ["length", "severity"]).collect()}
    assert len(got) == 6 and (got["all", None].n, got["all", None].accuracy, got["all", None].ndr, got["all", None].fpr) == (5, 0.6, 0.5, 0.3333)
    assert (got["length", "long"].precision, got["length", "long"].f1) == (0.5, 0.6667) and got["length", None].n == 1 and got["severity", "5"].fn == 1


def test_planted_codes(spark):
    cases = spark.createDataFrame([("a", "F32"), ("b", "F32"), ("c", "0102")], "case_id string, false_trigger_code string")
    codes = spark.createDataFrame([("a", "F32", 0.4, 1.0, 0.4), ("b", "F32", 1.0, 1.0, 1.0)], "case_id string, code string, gate_neg double, gate_sub double, gate_total double")
    got = {r.case_id: (r.detected, r.gate_neg_holds, r.gate_sub_holds, r.gate_total_holds) for r in C.planted(cases, codes).collect()}
    assert got == {"a": (True, True, False, True), "b": (True, False, False, False), "c": (False, False, False, False)}
