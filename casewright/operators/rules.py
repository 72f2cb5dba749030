"""Context rules of detected codes, verdicts of a validator, and inferred codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import category_prefix
from casewright.functions.windows import holds, keyword_windows, together


def context_validity(found: DataFrame, rules: DataFrame, radius: int = 28) -> DataFrame:
    """`found` (code, text, matched) with valid, mult and reason of the first rule that applies.

    A rule (prefix, priority, scope, has, also, valid, mult, reason) is for a code
    or a category prefix. It applies if a window around a matched keyword, or the
    whole text where `scope` is 'text', has a term of `has` and, unless `also` is
    empty, one of `also` too; an empty `has` always applies. A code without such
    a rule is valid. The rules are a small table of the caller, sent to the rows.
    """
    by = rules.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("priority", "scope", "has", "also", "valid", "mult", "reason"))).alias("rules"))
    by = F.broadcast(by)
    d = found.withColumn("windows", F.flatten(F.transform("matched", lambda k: keyword_windows(F.col("text"), F.lower(k), radius))))
    d = d.join(by.select(F.col("prefix").alias("code"), F.col("rules").alias("own")), "code", "left").withColumn("prefix", category_prefix(F.col("code"))).join(by, "prefix", "left")

    def applies(r: Column) -> Column:
        where = F.when(r["scope"] == "text", F.array(F.col("text"))).otherwise(F.col("windows"))
        return (F.size(r["has"]) == 0) | F.when(F.size(r["also"]) == 0, holds(where, r["has"])).otherwise(together(where, r["has"], r["also"]))

    none = F.array().cast(dict(by.dtypes)["rules"])
    every = F.when(F.col("code") == F.col("prefix"), F.coalesce("own", none)).otherwise(F.array_sort(F.concat(F.coalesce("own", none), F.coalesce("rules", none))))
    d = d.withColumn("rule", F.get(F.filter(every, applies), F.lit(0)))
    return d.withColumns({"valid": F.coalesce("rule.valid", F.lit(True)), "mult": F.coalesce("rule.mult", F.lit(1.0)), "reason": F.col("rule.reason")}).drop("windows", "own", "rules", "prefix", "rule")


def merged_verdicts(candidates: DataFrame, verdicts: DataFrame, crisis: int = 4) -> DataFrame:
    """case_id, code, confidence and level of candidates that a validator's verdicts leave.

    `candidates` has severity, confidence, valid and `asked`; `verdicts` has
    is_valid by case and code. What wasn't asked or has no verdict stays if its
    context was valid. Null verdicts count as valid.
    """
    v = verdicts.groupBy("case_id", "code").agg(F.min(F.coalesce("is_valid", F.lit(True))).alias("ok"))
    d = candidates.join(v, ["case_id", "code"], "left")
    judged = F.col("asked") & F.col("ok").isNotNull()
    c, valid = F.col("confidence"), F.col("valid")
    safe = (F.col("severity") >= crisis) & valid & (c >= 0.5)
    keep = F.when(~judged, valid).when(F.col("ok"), True).otherwise(safe)
    new = F.when(~judged, c).when(F.col("ok") & valid, F.least(F.lit(0.95), c * 1.2)).when(F.col("ok"), F.least(F.lit(0.4), c)).otherwise(F.greatest(F.lit(0.4), c * 0.6))
    return d.where(keep).select("case_id", "code", F.round(new, 4).alias("confidence"), F.when(judged, "L1-Validated").otherwise("L1").alias("level"))


def admitted(items: DataFrame, found: DataFrame, cases: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """case_id, code, severity, confidence and level of inferred codes that may join the found ones.

    An item (case_id, code, evidence, severity, confidence) goes if it is found
    already, isn't in the taxonomy, or neither its evidence nor the case has a
    keyword of the code. Severity is 3 and confidence 0.75 where none is given;
    of repeated items the surest stays.
    """
    t = F.broadcast(taxonomy.select("code", "keywords"))
    d = items.where(F.trim("code") != "").join(t, "code").join(found.select("case_id", "code"), ["case_id", "code"], "left_anti").join(cases.select("case_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")), "case_id")
    near = F.concat_ws("\n", F.lower(F.coalesce("evidence", F.lit(""))), F.col("text"))
    d = d.where(F.exists("keywords", lambda k: F.contains(near, F.lower(k))))
    best = F.max(F.struct(F.coalesce("confidence", F.lit(0.75)).alias("confidence"), F.coalesce("severity", F.lit(3)).alias("severity")))
    return d.groupBy("case_id", "code").agg(best.alias("b")).select("case_id", "code", "b.severity", "b.confidence", F.lit("L2").alias("level"))


def lenient_json(text: Column) -> Column:
    """The object in a reply: a fenced block, else what outer braces hold, else the text; null if it is none."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, braces, text)
    return F.when(F.try_parse_json(found).isNotNull(), found)
