"""Mentions of actors in texts, and the actor that a reference means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.windows import SENTENCE_ENDS, quoted

#: What a candidate earns by where it stands, and how far back a sentence may end.
NEAR, SAME_CLAUSE, SAME_SENTENCE, SENTENCE_BEFORE, DEFERRED, SUBJECT, LAST = 220, 160, 95, 70, 35, 55, -35
REACH = 180


def spans(text: Column, term: Column) -> Column:
    """Starts from 0 of all places of a term in a text, without overlap; an empty term has none."""
    parts = F.split(text, quoted(term), -1)
    ends = F.aggregate(F.transform(parts, F.length), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n + F.length(term)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: a["out"])
    return F.when(F.contains(text, term) & (term != ""), F.slice(ends, F.lit(1), F.size(ends) - 1)).otherwise(F.array().cast("array<int>"))


def mentions(cases: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """case_id, term, kind, start, end of the lexicon's terms (term, kind) in the lower-cased texts.

    Where places overlap, the longest term at a place stays and shorter ones
    within it go. The lexicon is a small table of the caller.
    """
    words = lexicon.select(F.lower("term").alias("term"), "kind").where("term <> ''").distinct()
    d = cases.select("case_id", F.lower(F.coalesce(text, F.lit(""))).alias("_t")).join(F.broadcast(words), F.contains(F.col("_t"), F.col("term")))
    d = d.select("case_id", "term", "kind", F.explode(spans(F.col("_t"), F.col("term"))).alias("start")).withColumn("end", F.col("start") + F.length("term"))
    before = Window.partitionBy("case_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_m", F.max("end").over(before)).where(F.col("_m").isNull() | (F.col("end") > F.col("_m"))).drop("_m")


def _last(text: Column, place: Column, marks: str) -> Column:
    """Where the piece around a place begins: after the last of the marks before it."""
    head = F.substring(text, F.lit(1), place)
    return F.length(F.regexp_extract(head, f"(?s)^(.*[{marks}])", 1))


def antecedents(cases: DataFrame, actors: DataFrame, references: DataFrame, clause_marks: str = ",;", reporting: list[str] = (), deferred: list[str] = (), text: str = "text") -> DataFrame:
    """case_id, term, start of each reference and the actor it most likely means.

    `actors` and `references` are `mentions`. An actor that ends at or before the
    reference earns by nearness, and by standing in its clause, its sentence or the
    sentence before. Where the sentence reports speech up to the reference, its first
    actor earns more and its last, if another, less. Ties go to the first actor; no
    actor before it, no row.
    """
    low = cases.select("case_id", F.lower(F.coalesce(text, F.lit(""))).alias("_t"))
    r = references.select("case_id", "term", F.col("start").alias("p")).join(low, "case_id")
    r = r.withColumn("s0", _last(F.col("_t"), F.col("p"), SENTENCE_ENDS)).withColumn("c0", F.greatest("s0", _last(F.col("_t"), F.col("p"), clause_marks)))
    said = F.substring("_t", F.col("s0") + 1, F.col("p") - F.col("s0"))
    told = F.lit(False)
    for cue in reporting:
        told = told | F.contains(said, F.lit(cue))
    r = r.select("case_id", "term", "p", "s0", "c0", told.alias("told"))
    a = actors.select("case_id", F.col("term").alias("actor"), F.col("start").alias("a0"), F.col("end").alias("a1"))
    j = r.join(a, "case_id").where("a1 <= p")
    here = F.col("a0") >= F.col("s0")
    w = Window.partitionBy("case_id", "p", "term")
    j = j.withColumn("first", F.min(F.when(here, F.col("a0"))).over(w)).withColumn("last", F.max(F.when(here, F.col("a0"))).over(w))
    earlier = (F.col("a1") <= F.col("s0")) & (F.col("s0") - F.col("a1") <= REACH)
    score = F.greatest(F.lit(0), NEAR - (F.col("p") - F.col("a1"))) + F.when(F.col("a0") >= F.col("c0"), SAME_CLAUSE).when(here, SAME_SENTENCE).when(earlier, SENTENCE_BEFORE).otherwise(0)
    score += F.when(earlier & F.col("term").isin(list(deferred)), DEFERRED).otherwise(0)
    score += F.when(F.col("told") & (F.col("a0") == F.col("first")), SUBJECT).when(F.col("told") & (F.col("a0") == F.col("last")), LAST).otherwise(0)
    best = j.groupBy("case_id", "term", F.col("p").alias("start")).agg(F.max_by("actor", F.struct(score.alias("s"), (-F.col("a0")).alias("o"))).alias("actor"), F.max(score).alias("score"))
    return best
