"""Figures of single cases and of adversarial slices, for any number of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.scoring import clamp, keyword_share


def _rate(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), 6)


def operational(cases: DataFrame, found: DataFrame, filtered: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts, shares, severities and retrieval scores of each of `cases` (case_id).

    `found` and `filtered` hold case_id, severity, confidence and matched; `hits`
    case_id and score. A case without candidates has no accepted share, one
    without finite scores no retrieval score.
    """
    f = found.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("problems_found"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("conf"), F.max(F.coalesce("severity", F.lit(1))).alias("max_severity"), F.sum(F.coalesce("severity", F.lit(1))).alias("sev"),
        F.count_if(F.col("severity") >= 4).alias("high_severity_count"), F.count_if(F.col("severity") == 3).alias("moderate_severity_count"), F.sum(F.greatest(F.size("matched"), F.lit(0))).alias("words"))
    x = filtered.groupBy("case_id").agg(F.count(F.lit(1)).alias("filtered_count"))
    fine = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    h = hits.groupBy("case_id").agg(F.count(F.lit(1)).alias("retrieved_docs_count"), F.avg(fine).alias("avg_s"), F.max(fine).alias("max_s"))
    d = cases.select("case_id").join(f, "case_id", "left").join(x, "case_id", "left").join(h, "case_id", "left")
    d = d.fillna(0, ["problems_found", "conf", "max_severity", "sev", "high_severity_count", "moderate_severity_count", "words", "filtered_count", "retrieved_docs_count"])
    n, out = F.col("problems_found"), F.col("filtered_count")
    share = lambda a, most: F.round(F.when(n > 0, F.least(F.lit(1.0), a / (n * most))).otherwise(0.0), 6)
    return d.select(
        "case_id", n, (n + out).alias("candidate_count"), out, _rate(n, n + out).alias("accepted_ratio"), F.coalesce(_rate(out, n + out), F.lit(0.0)).alias("filtered_ratio"), F.round("conf", 6).alias("avg_confidence"),
        "max_severity", "high_severity_count", "moderate_severity_count", "retrieved_docs_count", F.round("avg_s", 6).alias("avg_retrieval_score"), F.round("max_s", 6).alias("max_retrieval_score"),
        share(F.col("words"), 2).alias("keyword_coverage"), share(F.col("sev"), 5).alias("specificity"), _rate(n, n + out).alias("polarity_gate"), F.round(F.when(F.col("avg_s").isNotNull(), clamp(F.col("avg_s"), 0.0, 1.0)), 6).alias("retrieval_evidence"))


def candidate_trace(found: DataFrame, filtered: DataFrame) -> DataFrame:
    """How many candidates of each case were accepted or filtered, by reason; the same columns in both."""
    d = found.select("case_id", F.lit("accepted").alias("state"), "reason").unionByName(filtered.select("case_id", F.lit("filtered").alias("state"), "reason"))
    return d.groupBy("case_id", "state", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def keyword_analysis(found: DataFrame) -> DataFrame:
    """total and the sorted distinct matched keywords of each case."""
    return found.groupBy("case_id").agg(F.sum(F.greatest(F.size("matched"), F.lit(0))).alias("total_keywords"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("unique_keywords"))


def evidence_terms(matched: Column, name: Column) -> Column:
    """Lower-case search terms of a problem: matched keywords of two characters or more, name words of three or more."""
    low = lambda xs, least: F.transform(F.filter(xs, lambda x: F.length(x) >= least), F.lower)
    return F.concat(low(F.coalesce(matched, F.array().cast("array<string>")), 2), low(F.split(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), " "), 3))


def retrieval_evidence(found: DataFrame, hits: DataFrame, docs: DataFrame, weight: float = 0.2) -> DataFrame:
    """evidence and confidence of each case: how far documents, the first ones most, hold a problem's terms.

    `hits` hold case_id, doc_id and rank from 1. Documents without text don't
    count; a problem without terms, or a case without documents, has evidence 0.
    """
    p = found.select("case_id", "code", "confidence", evidence_terms(F.col("matched"), F.col("name")).alias("terms"))
    h = hits.select("case_id", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id").where("text <> ''").select("case_id", "rank", "text")
    s = p.join(h, "case_id", "left").groupBy("case_id", "code").agg(F.first("confidence").alias("confidence"), F.sum(keyword_share(F.col("text"), F.col("terms")) / F.col("rank")).alias("a"), F.sum(1 / F.col("rank")).alias("b"))
    e = s.select("case_id", "confidence", F.coalesce(F.least(F.lit(1.0), F.col("a") / F.nullif("b", F.lit(0.0))), F.lit(0.0)).alias("e"))
    return e.groupBy("case_id").agg(F.round(F.avg("e"), 6).alias("evidence"), F.round(F.avg("confidence") * (1 - weight) + F.avg("e") * weight, 6).alias("confidence"))


def adversarial(rows: DataFrame, by: list[str]) -> DataFrame:
    """Shares of adversarial cases: targets preserved, planted false triggers suppressed, both at once.

    `rows`: is_negated, target_preserved (null: not evaluated), and the gates of
    the false trigger gate_neg, gate_sub, gate_total (null: not evaluated). A gate
    suppresses below 1. A share of nothing is null.
    """
    target = ~F.col("is_negated") & F.col("target_preserved").isNotNull()
    trigger = F.col("gate_total").isNotNull()
    kept, held = target & F.col("target_preserved"), trigger & (F.col("gate_total") < 1)
    n = F.count_if
    out = {
        "target_preservation_rate": _rate(n(kept), n(target)), "false_suppression_rate": _rate(n(target & ~F.col("target_preserved")), n(target)), "negation_suppression_rate": _rate(n(trigger & (F.col("gate_neg") < 1)), n(trigger)),
        "subject_suppression_rate": _rate(n(trigger & (F.col("gate_sub") < 1)), n(trigger)), "contextual_suppression_rate": _rate(n(held), n(trigger)), "mean_gate_total": F.round(F.avg("gate_total"), 6), "joint_pass_rate": _rate(n(kept & held), n(target & trigger)),
    }
    return rows.groupBy(*by).agg(n(F.lit(True)).alias("cases"), n(target).alias("targets"), n(trigger).alias("triggers"), *[c.alias(k) for k, c in out.items()])


def simple_scores(hits: DataFrame, found: DataFrame, docs: DataFrame, weight: float = 0.2) -> DataFrame:
    """case_id, doc_id, relevance (keyword shares by severity) and the two plain scores that it and any hit give."""
    p = found.select("case_id", "severity", F.array_distinct(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("matched", F.array().cast("array<string>")), F.array("name"))).alias("terms"))
    d = hits.select("case_id", "doc_id", "score").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").join(p, "case_id", "left")
    sev, terms = F.coalesce("severity", F.lit(0)), F.filter("terms", lambda t: t != "")
    g = d.groupBy("case_id", "doc_id").agg(F.first("score").alias("s"), F.sum(sev).alias("all"), F.sum(keyword_share(F.col("text"), terms) * sev).alias("soft"), F.sum(F.coalesce(keyword_share(F.col("text"), terms, False), F.lit(0.0)) * sev).alias("hard"))
    over = lambda c: F.coalesce(F.col(c) / F.nullif("all", F.lit(0)), F.lit(0.0))
    return g.select("case_id", "doc_id", F.round(over("soft"), 6).alias("relevance"), F.round(F.col("s") * (1 + over("soft")), 6).alias("relevance_score"), F.round(F.col("s") * (1 + weight * over("hard")), 6).alias("weighted_score"))
