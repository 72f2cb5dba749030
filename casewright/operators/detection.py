"""Problem detection by keywords, conflicts and duplicates of codes, and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.scoring import confidence


def keyword_matches(cases: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """case_id, text (lower), code, severity, keywords and the keywords that the text holds.

    The taxonomy is a small table of the caller, sent to the cases.
    """
    c = cases.select("case_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    d = c.join(F.broadcast(taxonomy.select("code", "name", "severity", "keywords")))
    return d.withColumn("matched", F.filter("keywords", lambda k: F.contains(F.col("text"), F.lower(k)))).where(F.size("matched") > 0)


def detections(cases: DataFrame, taxonomy: DataFrame, mult: Column | None = None) -> DataFrame:
    """case_id, code, severity, matched, confidence; below 0.25 nothing is reported."""
    d = keyword_matches(cases, taxonomy)
    d = d.withColumn("confidence", confidence(F.col("matched"), F.col("keywords"), F.col("text"), mult if mult is not None else F.lit(1.0)))
    return d.where("confidence >= 0.25").select("case_id", "code", "name", "severity", "keywords", "matched", "confidence")


def conflicts(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared pairs of codes (code, other) that a case has both of."""
    a = found.select("case_id", "code")
    return a.join(F.broadcast(declared), "code").join(a.withColumnRenamed("code", "other"), ["case_id", "other"]).select("case_id", "code", "other")


def without_duplicates(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Of a group's codes (code, grp, preferred) a case keeps the preferred, else the surest, one."""
    d = found.join(F.broadcast(groups), "code", "left").withColumn("grp", F.coalesce("grp", F.col("code")))
    w = Window.partitionBy("case_id", "grp").orderBy(F.coalesce("preferred", F.lit(0)).desc(), F.col("confidence").desc(), F.col("severity").desc(), F.col("code").desc())
    return d.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "grp", "preferred")


def downgraded(found: DataFrame, prefers: DataFrame) -> DataFrame:
    """A generic code beside a preferred specific one (generic, specific) keeps at most 0.24."""
    have = found.select("case_id", F.col("code").alias("specific"))
    weak = found.select("case_id", F.col("code").alias("generic")).join(F.broadcast(prefers), "generic").join(have, ["case_id", "specific"], "left_semi")
    weak = weak.select("case_id", F.col("generic").alias("code"), F.lit(True).alias("weak")).distinct()
    return found.join(weak, ["case_id", "code"], "left").withColumn("confidence", F.when(F.col("weak"), F.least("confidence", F.lit(0.24))).otherwise(F.col("confidence"))).withColumn("valid", F.col("weak").isNull()).drop("weak")


def review_status(confidence_: Column, valid: Column, level: Column | None = None, filtered: Column | None = None, baseline: Column | None = None, documents: Column | None = None) -> Column:
    """What a reviewer is to do with a code: of a filtered one, of one of a baseline, of one that asks for documents, or of any other."""
    no = F.lit(False)
    filtered, baseline, documents = (no if c is None else c for c in (filtered, baseline, documents))
    known = F.lit(True) if level is None else level.isin("L1", "L2")
    out = F.when(documents, "verify_documents").when(baseline, "baseline_filtered").otherwise("filtered")
    kept = F.when(baseline, "baseline_candidate").when(documents, "verify_documents").when(valid & (confidence_ >= 0.6) & known, "confirmed").otherwise("needs_review")
    return F.when(filtered, out).otherwise(kept)


def review_summary(items: DataFrame) -> DataFrame:
    """For each case the number of its codes (case_id, status, filtered) by status, accepted and filtered ones, and all."""
    each = ("confirmed", "needs_review", "verify_documents", "filtered", "baseline_candidate", "baseline_filtered")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in each]
    return items.groupBy("case_id").agg(*counts, F.count_if(~F.col("filtered")).alias("accepted_total"), F.count_if(F.col("filtered")).alias("filtered_total"), F.count(F.lit(1)).alias("total"))


def ambiguity(found: DataFrame, declared: DataFrame, unsure: DataFrame) -> DataFrame:
    """For each case: review_codes (in a conflict, or in `unsure`: case_id, code), conflict_links, and a level from their numbers."""
    c = conflicts(found, declared)
    links = c.groupBy("case_id").agg(F.count(F.lit(1)).alias("conflict_links"))
    both = c.select("case_id", "code").unionByName(c.select("case_id", F.col("other").alias("code"))).unionByName(unsure.select("case_id", "code")).distinct()
    r = both.groupBy("case_id").agg(F.count(F.lit(1)).alias("review_count"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("review_codes")).join(links, "case_id", "left").fillna(0, ["conflict_links"])
    most = F.greatest("review_count", "conflict_links")
    return r.select("case_id", "review_count", "review_codes", "conflict_links", F.when(most >= 4, "high").when(most >= 2, "medium").otherwise("low").alias("level"))


def tag_coverage(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """documents, tagged ones, their share, and the number of tags of `auto_tags`."""
    t = tags.select("doc_id", F.size(F.split("codes", ",")).alias("n"))
    d = docs.select("doc_id").join(t, "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("documents"), F.count("n").alias("tagged"), F.round(F.count("n") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("share"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tags"))


def tools_by_rule(found: DataFrame, rules: DataFrame, always: DataFrame) -> DataFrame:
    """Tools of the rules (pattern, tool, priority) whose pattern a code of the case begins with, and those for every case (tool, priority), once each."""
    hit = found.join(F.broadcast(rules), F.rlike(F.col("code"), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")")))).select("case_id", "tool", "priority")
    every = found.select("case_id").distinct().join(F.broadcast(always))
    d = hit.unionByName(every.select("case_id", "tool", "priority")).groupBy("case_id", "tool").agg(F.max("priority").alias("priority"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("priority").desc(), "tool")))


def severity_level(codes_crisis: Column, most: Column) -> Column:
    """A case's level from whether it has the crisis code, and its greatest severity."""
    return F.when(most.isNull(), "NOT_ASSESSED").when(codes_crisis, "CRITICAL").when(most >= 4, "HIGH").when(most == 3, "MEDIUM").otherwise("LOW")


def auto_tags(docs: DataFrame, taxonomy: DataFrame, least: int = 2) -> DataFrame:
    """doc_id and the codes of which at least so many keywords are in the text."""
    d = keyword_matches(docs.select(F.col("doc_id").alias("case_id"), "text"), taxonomy).where(F.size("matched") >= least)
    return d.groupBy(F.col("case_id").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def keyword_index(taxonomy: DataFrame) -> DataFrame:
    """Each keyword with the codes that have it."""
    return taxonomy.select(F.explode("keywords").alias("k"), "code").groupBy(F.lower("k").alias("keyword")).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def tools(found: DataFrame, catalogue: DataFrame, most: int = 10) -> DataFrame:
    """Assessment tools (tool, uses) for a case: 10 for a code's name, 8 for a use within a name."""
    uses = catalogue.select("tool", F.explode("uses").alias("use"))
    name, use = F.lower("name"), F.lower("use")
    points = F.when(name == use, 10).when(F.contains(name, use) | F.contains(use, name), 8).otherwise(0)
    hits = F.size(F.filter("matched", lambda k: F.contains(F.lower(F.col("use")), F.lower(k)))) * 3
    d = found.join(F.broadcast(uses)).groupBy("case_id", "tool").agg(F.sum(points + hits).alias("score")).where("score > 0")
    w = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "tool")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
