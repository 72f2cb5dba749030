"""Spans through masks and back, against walking the text in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from casewright.operators import masking

PASSES = [(r"Mr [A-Za-z]+", "[NAME]"), (r"[0-9]+", "#"), (r"\[", "<<")]


def plain(text, passes):
    """The masked text and, of each boundary, where it begins and ends in it."""
    begin = end = list(range(len(text) + 1))
    for pattern, mark in passes:
        a, b, out, at = [0] * (len(text) + 1), [0] * (len(text) + 1), "", 0
        for m in re.finditer(pattern, text):
            for p in range(at, m.start() + 1):
                a[p] = b[p] = len(out) + p - at
            out += text[at : m.start()]
            for p in range(m.start() + 1, m.end()):
                a[p], b[p] = len(out), len(out) + len(mark)
            out, at = out + mark, m.end()
            a[at] = b[at] = len(out)
        for p in range(at, len(text) + 1):
            a[p] = b[p] = len(out) + p - at
        text = out + text[at:]
        begin, end = [a[p] for p in begin], [b[p] for p in end]
    return text, begin, end


def made(n=60, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(["Mr Bond", " ", "12", "7", "x", "[", "é", "abc", "Mr ", "𝄞"]) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_every_boundary_goes_where_plain_python_puts_it(spark):
    rows = [(k, t, list(range(len(t) + 1))) for k, t in enumerate(made())]
    df = spark.createDataFrame(rows, "k int, t string, ps array<int>").select("k", "t", "ps", masking.masked(F.col("t"), PASSES).alias("m"))
    df = df.select("k", "t", "m.text", "m.maps", F.transform("ps", lambda p: masking.remapped(p, F.col("m.maps"), False)).alias("a"), F.transform("ps", lambda p: masking.remapped(p, F.col("m.maps"), True)).alias("b"))
    for r in df.collect():
        text, begin, end = plain(r.t, PASSES)
        assert (r.text, r.a, r.b) == (text, begin, end), r.t


def test_spans_come_back(spark):
    """A span that cuts no mask comes back as it was; one within a mask comes back as all that was masked."""
    rows = [("call Mr Bond at 555 now", [("", 5, 12), ("", 8, 12), ("at", 13, 15), ("", 13, 19)])]
    df = spark.createDataFrame(rows, "t string, s array<struct<keyword:string,start:int,end:int>>").select("t", "s", masking.masked(F.col("t"), PASSES[:2]).alias("m"))
    back = lambda s: F.struct(masking.remapped(s["start"], F.col("m.maps"), False, True).alias("a"), masking.remapped(s["end"], F.col("m.maps"), True, True).alias("b"))
    r = df.select("m.text", masking.remapped_spans(F.col("s"), F.col("t"), F.col("m.text"), F.col("m.maps")).alias("to")).withColumn("x", F.lit(1)).first()
    assert r.text == "call [NAME] at # now" and [(x.keyword, r.text[x.start : x.end]) for x in r.to] == [("bond", "[NAME]"), ("mr bond", "[NAME]"), ("at", "at"), ("at 555", "at #")]
    there = df.select("m", F.explode(masking.remapped_spans(F.col("s"), F.col("t"), F.col("m.text"), F.col("m.maps"))).alias("s")).select("s", back(F.col("s")).alias("b")).collect()
    assert [(x.b.a, x.b.b) for x in there] == [(5, 12), (5, 12), (13, 15), (13, 19)]


@pytest.mark.parametrize(("spans", "want"), [([("k", -1, 3), ("k", 3, 3), ("k", 2, 99)], []), (None, []), ([("A", 0, 1), ("a", 0, 1)], [("a", 0, 1)])])
def test_spans_that_are_not_fit(spark, spans, want):
    df = spark.createDataFrame([("abc", spans)], "t string, s array<struct<keyword:string,start:int,end:int>>").withColumn("m", masking.masked(F.col("t"), []))
    got = df.select(masking.remapped_spans(F.col("s"), F.col("t"), F.col("m.text"), F.col("m.maps")).alias("s")).first().s
    assert [(x.keyword, x.start, x.end) for x in got] == want


def test_what_is_gone_is_sought_by_its_text(spark):
    df = spark.createDataFrame([("42 is 42x, not 42", [("", 6, 8)])], "t string, s array<struct<keyword:string,start:int,end:int>>")
    df = df.withColumn("m", masking.masked(F.col("t"), [("42x", "")]))
    got = df.select("m.text", masking.remapped_spans(F.col("s"), F.col("t"), F.col("m.text"), F.col("m.maps")).alias("s")).first()
    assert got.text == "42 is , not 42" and [(x.start, x.end) for x in got.s] == [(0, 2)]


def test_null_and_empty_texts(spark):
    got = spark.createDataFrame([(None,), ("",)], "t string").select(masking.masked(F.col("t"), PASSES).alias("m")).collect()
    assert [r.m.text for r in got] == ["", ""] and all(not any(r.m.maps) for r in got)


def test_a_text_is_masked_and_searched_once_a_row(spark, sf_dir):
    """No condition on the result is pushed to the texts, and no lambda over spans works on the whole text."""
    from casewright.plans.registry import QUERIES

    plan = QUERIES["masked_spans"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_replace(") == 1
