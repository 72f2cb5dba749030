"""What a service does to one case, done to any number of cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.scoring import confidence

from . import detection, gates, retrieval, rules, scoring


def graded(hits: DataFrame, docs: DataFrame, expected: DataFrame) -> DataFrame:
    """`hits` (case_id, doc_id) with a grade of 0, 1 or 2 by the keywords of the case's expected codes.

    Two keywords of a code count 1, one of a severe code a half. Two counts, or
    three keywords of one code where a severe code counts, grade 2; one count, or
    two keywords of a code, grades 1. Cases without codes, and documents that
    are missing or without text, grade 0.
    """
    d = hits.select("case_id", "doc_id").join(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_text")), "doc_id", "left").join(expected.select("case_id", "severity", "keywords"), "case_id", "left")
    n = F.coalesce(F.size(F.filter(F.array_distinct("keywords"), lambda k: F.contains(F.col("_text"), F.lower(k)))), F.lit(0))
    return grades(d.withColumn("n", F.greatest(n, F.lit(0))))


def _counts(n: Column, severity: Column) -> Column:
    return (n >= 2) | ((n == 1) & (severity >= 3))


def _grade(codes: Column, severe: Column, most: Column) -> Column:
    return F.when((codes >= 2) | ((most >= 3) & (severe >= 3)), 2).when(codes >= 1, 1).otherwise(0)


def _worth(n: Column, severity: Column) -> Column:
    return F.when(n >= 2, 1.0).when(_counts(n, severity), 0.5).otherwise(0.0)


def grades(pairs: DataFrame) -> DataFrame:
    """case_id, doc_id, grade from a row for each code: its severity, and n, its keywords in the text, or these themselves."""
    d = pairs if "n" in pairs.columns else pairs.withColumn("n", F.size(F.filter(F.array_distinct("keywords"), lambda k: F.contains(F.col("_text"), F.lower(k)))))
    n, severity = F.col("n"), F.col("severity")
    g = d.groupBy("case_id", "doc_id").agg(F.sum(_worth(n, severity)).alias("codes"), F.max(F.when(_counts(n, severity), severity)).alias("severe"), F.max(F.when(n >= 2, n)).alias("most"))
    return g.select("case_id", "doc_id", _grade(F.col("codes"), F.col("severe"), F.col("most")).alias("grade"))


def grade_of(codes: Column) -> Column:
    """The same grade from an array of all codes' (severity, n)."""
    worth = F.aggregate(codes, F.lit(0.0), lambda a, c: a + _worth(c["n"], c["severity"]))
    severe, most = (F.array_max(F.transform(codes, f)) for f in (lambda c: F.when(_counts(c["n"], c["severity"]), c["severity"]), lambda c: F.when(c["n"] >= 2, c["n"])))
    return _grade(worth, severe, most)


def analyze(cases: DataFrame, docs: DataFrame, taxonomy: DataFrame, rule_table: DataFrame, markers: gates.Markers, k: int = 15) -> dict[str, DataFrame]:
    """problems, filtered, documents and summary of cases (case_id, text).

    Nothing runs until one of them is asked for, and each reads only what it needs.
    """
    m = gates.polarity(rules.context_validity(detection.keyword_matches(cases, taxonomy), rule_table), markers)
    m = m.withColumn("confidence", confidence(F.col("matched"), F.col("keywords"), F.col("text"), F.col("mult")))
    m = gates.dampened(m)
    found = m.where("valid AND confidence >= 0.25").withColumn("status", detection.review_status(F.col("confidence"), F.col("valid")))
    filtered = m.where("NOT (valid AND confidence >= 0.25)").withColumn("status", F.lit("filtered"))
    hits = retrieval.bm25(docs, cases.select(F.col("case_id").alias("query_id"), "text"), k).select(F.col("query_id").alias("case_id"), "doc_id", "score")
    ranked = retrieval.ranked(scoring.score(hits, found.select("case_id", "code", "name", "severity", "keywords", "matched", "confidence"), docs), ["case_id"], k, "final")
    keep = ["case_id", "code", "severity", "matched", "confidence", "valid", "reason", "gate_total", "status"]
    summary = cases.select("case_id").join(found.groupBy("case_id").agg(F.count(F.lit(1)).alias("problems"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.max("severity").alias("most_severe")), "case_id", "left").fillna(0, ["problems", "confirmed"])
    return {"problems": found.select(*keep), "filtered": filtered.select(*keep), "documents": ranked, "summary": summary}


def finalized(found: DataFrame, decisions: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The codes that a reviewer's decisions (case_id, code, decision) leave, and the unknown decisions.

    `excluded` takes a code away and wins over the others; `accepted` and `review`
    put one in. A code that the taxonomy lacks, or another decision, is unknown.
    """
    known = F.broadcast(taxonomy.select("code", F.lit(True).alias("known")).distinct())
    d = decisions.join(known, "code", "left").withColumn("good", F.col("known").isNotNull() & F.coalesce(F.col("decision").isin("accepted", "review", "excluded"), F.lit(False)))
    out = d.where("good AND decision = 'excluded'").select("case_id", "code")
    into = d.where("good AND decision <> 'excluded'").select("case_id", "code", F.col("decision").alias("state"))
    every = found.select("case_id", "code", F.lit("found").alias("state")).unionByName(into).join(out, ["case_id", "code"], "left_anti")
    return every.groupBy("case_id", "code").agg(F.min("state").alias("state")), d.where("NOT good").select("case_id", "code", "decision")
