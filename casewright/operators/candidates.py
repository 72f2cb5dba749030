"""What the words around a candidate code say of it: whether it is denied, and who does what to whom.

Candidates are rows with the spans of their terms in an array, and so are the
events of a case, so that spans and markers, or spans and events, meet within a
row: their number is that of one text's matches, never of two tables' rows.
Positions count characters from 0, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.windows import bound

from . import evidence, profile

#: How far a denial reaches, and what it leaves of a confidence.
REACH, DENIED = 28, 0.4
#: What a span earns an event by its distance, by being within or beside it, by meeting what supports it, and by what it is; and the least sum that tells.
NEAR, INSIDE, OVERLAPS, ADJUSTED, ANCHOR, SUPPORTED, SUPPORT_NEAR, EVIDENCE, TELLING = 220, 240, 180, 260, 180, 320, 120, 30, 200
UNCLEAR = "unclear"
_SPAN = "struct<keyword:string,start:int,end:int,scope:string,adjusted:boolean>"


@dataclass(frozen=True)
class Denials:
    """Lower-case words of the caller: denials, what ends a clause, what ends a denial's reach, and hardships that are told by denying.

    `hardships` are (prefixes of codes, words of categories, phrases). `guards` are those of `evidence.scan`.
    """

    markers: list[str]
    clause: list[str]
    breakers: list[str] = field(default_factory=list)
    hardships: list[tuple[list[str], list[str], list[str]]] = field(default_factory=list)
    guards: dict = field(default_factory=dict)


def _words(ws: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in ws]).cast("array<string>")


def terms_of(matched: Column, name: Column) -> Column:
    """Lower-case, trimmed terms: the matched words that aren't blank, or the name if there are none."""
    clean = lambda ws: F.filter(F.transform(ws, lambda w: F.lower(F.trim(w))), lambda w: F.coalesce(w != "", F.lit(False)))
    given = F.coalesce(matched, F.array().cast("array<string>"))
    return F.when(F.size(given) > 0, clean(given)).otherwise(clean(F.array(name)))


def match_spans(text: Column, terms: Column, given: Column | None = None) -> Column:
    """Spans of all terms in a lower-case text, by start and the longer first; the given ones that are fit (they start after 0) go before."""
    one = lambda k, s, e, scope, adjusted: F.struct(k.alias("keyword"), s.alias("start"), e.alias("end"), scope.alias("scope"), adjusted.alias("adjusted"))
    derived = F.flatten(F.transform(terms, lambda t: F.transform(profile.spans(text, t), lambda s: F.struct(s.alias("s"), (-F.length(t)).alias("n"), t.alias("k")))))
    own = F.transform(F.array_sort(derived), lambda x: one(x["k"], x["s"], x["s"] - x["n"], F.lit("match"), F.lit(False)))
    if given is None:
        return own
    fit = F.filter(F.coalesce(given, F.array().cast(f"array<{_SPAN}>")), lambda s: (s["start"] > 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))
    named = F.transform(fit, lambda s: one(F.lower(F.trim(F.coalesce(F.nullif(s["keyword"], F.lit("")), F.substring(text, s["start"] + 1, s["end"] - s["start"])))), s["start"], s["end"], F.coalesce(s["scope"], F.lit("")), F.coalesce(s["adjusted"], F.lit(False))))
    return bound(named, lambda n: F.when(F.size(n) > 0, n).otherwise(own))


def hardships(code: Column, category: Column, table: list[tuple[list[str], list[str], list[str]]]) -> Column:
    """The phrases of all rows whose prefix the code has, or whose word the category."""
    none = F.array().cast("array<string>")
    meant = lambda prefixes, words: F.exists(_words(prefixes), lambda p: F.startswith(code, p)) | F.exists(_words(words), lambda w: F.contains(category, w))
    return F.flatten(F.array(*[F.when(F.coalesce(meant(p, w), F.lit(False)), _words(phrases)).otherwise(none) for p, w, phrases in table], none))


def denied_terms(text: Column, spans: Column, d: Denials, phrases: Column) -> Column:
    """Distinct keywords of the spans that a denial in their clause reaches.

    A denial ends at most REACH characters before the span, with no breaker
    between, and lies in the span's clause, which holds none of the phrases. Only
    the characters that a denial can reach from are searched for one; the clause
    is sought in the text for the few spans that have one.
    """
    longest = max(map(len, d.markers), default=0)

    def near(s: Column) -> Column:
        """Starts of denials that reach the span."""
        size = F.least(s["start"], F.lit(REACH + longest))

        def found(before: Column) -> Column:
            def of(m: str) -> Column:
                end = lambda p: p + len(m)
                free = lambda p: ~F.exists(_words(d.breakers), lambda b: F.contains(F.substring(before, end(p) + 1, F.length(before)), b))
                return F.transform(F.filter(profile.spans(before, F.lit(m)), lambda p: (F.length(before) - end(p) <= REACH) & free(p)), lambda p: s["start"] - F.length(before) + p)

            return F.flatten(F.array(*[of(m) for m in d.markers if m], F.array().cast("array<int>")))

        return bound(F.substring(text, s["start"] - size + 1, size), found)

    def denied(s: Column) -> Column:
        told = lambda b: F.exists(phrases, lambda p: F.contains(F.substring(text, b["left"] + 1, b["right"] - b["left"]), p))
        inside = lambda starts: bound(evidence.scan(text, s["start"], d.clause, d.guards), lambda b: F.exists(starts, lambda p: p >= b["left"]) & ~told(b))
        return bound(near(s), lambda starts: F.when(F.size(starts) > 0, inside(starts)).otherwise(False))

    return F.array_distinct(F.transform(F.filter(spans, denied), lambda s: s["keyword"]))


def polarity(items: DataFrame, d: Denials) -> DataFrame:
    """`items` (text in lower case, code, category, matched, name, maybe matched_spans) with gate, negated and negated_terms.

    A text, markers or spans that are missing leave the gate open.
    """
    given = F.col("matched_spans") if "matched_spans" in items.columns else None
    text = F.coalesce("text", F.lit(""))
    spans = match_spans(text, terms_of(F.col("matched"), F.col("name")), given)
    out = items.withColumn("negated_terms", denied_terms(text, spans, d, hardships(F.col("code"), F.col("category"), d.hardships)))
    negated = F.size("negated_terms") > 0
    return out.withColumns({"gate": F.when(negated, DENIED).otherwise(1.0), "negated": negated})


def gated(items: DataFrame, enabled: bool = True) -> DataFrame:
    """`polarity` rows (confidence, filtered) with before, after, and the confidence and place that the gate leaves them.

    A denied candidate that wasn't filtered is from then on. A filtered one that
    isn't denied keeps its confidence as it is.
    """
    before = F.coalesce("confidence", F.lit(0.0)).cast("double")
    after = F.round(before * F.col("gate"), 4)
    d = items.withColumns({"before": before, "after": after})
    if not enabled:
        return d.withColumn("confidence", F.col("before"))
    return d.withColumns({"confidence": F.when(F.col("filtered") & ~F.col("negated"), F.col("before")).otherwise(F.col("after")), "filtered": F.col("filtered") | F.col("negated")})


def distance(a: Column, b: Column) -> Column:
    """Characters between two spans; 0 if they meet or touch."""
    return F.greatest(F.lit(0), b["start"] - a["end"], a["start"] - b["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def event_score(span: Column, event: Column, is_evidence: bool) -> Column:
    """What a span of a candidate earns an event (start, end, supports)."""
    fit = F.filter(F.coalesce(event["supports"], F.array().cast("array<struct<start:int,end:int>>")), lambda s: (s["start"] > 0) & (s["end"] > s["start"]))
    supports = F.when(F.size(fit) > 0, F.transform(fit, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array(F.struct(event["start"].alias("start"), event["end"].alias("end"))))
    nearest = F.array_min(F.transform(supports, lambda s: distance(span, s)))
    score = F.greatest(F.lit(0), NEAR - distance(span, event)) + F.when(span["adjusted"], ADJUSTED).otherwise(0) + F.when(span["scope"] == "anchor", ANCHOR).otherwise(0)
    score = score + F.when((event["start"] <= span["start"]) & (span["end"] <= event["end"]), INSIDE).when(overlaps(span, event), OVERLAPS).otherwise(0)
    return score + F.when(nearest == 0, SUPPORTED).otherwise(F.greatest(F.lit(0), SUPPORT_NEAR - nearest)) + (EVIDENCE if is_evidence else 0)


def relations(items: DataFrame, events: DataFrame, allowed: Column) -> DataFrame:
    """`items` (case_id, terms, matches, evidences) with actor, target, action, relation, event_id and score of the event that they tell of.

    `events` are case_id, event_id, start, end, agent, target, action, actions and
    supports; they are gathered by case, whose number of events is that of one
    text. An event counts if one of its actions is part of a term or holds one;
    of equal scores the first by start and id stays, and one below TELLING tells
    nothing. `allowed` says which candidates may have one.
    """
    named = F.filter(F.transform(F.coalesce("actions", F.array("action")), lambda a: F.lower(F.trim(a))), lambda a: F.coalesce((a != "") & (a != UNCLEAR), F.lit(False)))
    kept = F.struct(F.col("start").cast("int").alias("start"), "event_id", F.col("end").cast("int").alias("end"), "agent", "target", "action", named.alias("actions"), F.col("supports").cast("array<struct<start:int,end:int>>").alias("supports"))
    of_case = events.groupBy("case_id").agg(F.array_sort(F.collect_list(kept)).alias("_events"))
    d = items.join(of_case, "case_id", "left")

    def scored(e: Column, k: Column) -> Column:
        every = F.concat(F.transform("evidences", lambda s: event_score(s, e, True)), F.transform("matches", lambda s: event_score(s, e, False)))
        return F.struct(F.array_max(every).alias("score"), (-k).alias("k"), e.alias("e"))

    meets = lambda e: F.exists(e["actions"], lambda a: F.exists("terms", lambda t: F.contains(t, a) | F.contains(a, t)))
    fitting = F.when(F.coalesce(allowed, F.lit(False)) & (F.size("matches") > 0), F.filter(F.col("_events"), meets))
    best = F.array_max(F.transform(fitting, lambda e, k: scored(e, k)))
    d = d.withColumn("_best", best).withColumn("_e", F.when(F.col("_best.score") >= TELLING, F.col("_best.e")))
    said = lambda c: F.coalesce(F.nullif(F.col(f"_e.{c}"), F.lit("")), F.lit(UNCLEAR))
    d = d.withColumns({"actor": said("agent"), "target": said("target"), "action": said("action"), "event_id": F.col("_e.event_id"), "score": F.when(F.col("_e").isNotNull(), F.col("_best.score"))})
    clear = lambda *cs: F.forall(F.array(*[F.col(c) for c in cs]), lambda c: c != UNCLEAR)
    relation = F.when(clear("actor", "target", "action"), F.concat_ws(" -> ", "actor", "action", "target")).when(clear("actor", "action"), F.concat_ws(" -> ", "actor", "action")).otherwise(UNCLEAR)
    return d.withColumn("relation", relation).drop("_events", "_best", "_e")


def report(cases: DataFrame, by: list[str]) -> DataFrame:
    """One pass over judged cases (expected, predicted, and the grouping columns): figures of all, and by each of `by` alone.

    slice, value, n, tp, tn, fp, fn, accuracy, ndr (negatives that are seen), fpr, precision and f1. What is counted as
    positive is a denied case. A ratio without a denominator is 0.
    """
    sets = cases.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by]) if by else cases.groupBy()
    count = lambda e, p, name: F.count_if((F.col("expected") == e) & (F.col("predicted") == p)).alias(name)
    d = sets.agg(F.grouping_id().alias("_g") if by else F.lit(0).alias("_g"), F.count(F.lit(1)).alias("n"), count(True, True, "tp"), count(False, False, "tn"), count(False, True, "fp"), count(True, False, "fn"))
    at = {((1 << len(by)) - 1) ^ (1 << (len(by) - 1 - k)): c for k, c in enumerate(by)}
    slice_, value = F.lit("all"), F.lit(None).cast("string")
    for g, c in at.items():
        slice_, value = F.when(F.col("_g") == g, c).otherwise(slice_), F.when(F.col("_g") == g, F.col(c).cast("string")).otherwise(value)
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return d.select(slice_.alias("slice"), value.alias("value"), "n", "tp", "tn", "fp", "fn", share(tp + tn, F.col("n")).alias("accuracy"), share(tp, tp + fn).alias("ndr"), share(fp, fp + tn).alias("fpr"), share(tp, tp + fp).alias("precision"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def planted(cases: DataFrame, gated_codes: DataFrame) -> DataFrame:
    """case_id, code, detected, gates and whether each holds back the code that a case plants (case_id, false_trigger_code).

    `gated_codes` has a row for each code found in a case, with gate_neg, gate_sub and gate_total. A code that isn't found isn't there to be held back.
    """
    g = gated_codes.select("case_id", "code", "gate_neg", "gate_sub", "gate_total", F.lit(True).alias("_found"))
    d = cases.select("case_id", F.col("false_trigger_code").alias("code")).join(g, ["case_id", "code"], "left")
    held = lambda c: F.coalesce(F.col(c) < 1, F.lit(False)).alias(f"{c}_holds")
    return d.select("case_id", "code", F.col("_found").isNotNull().alias("detected"), "gate_neg", "gate_sub", "gate_total", held("gate_neg"), held("gate_sub"), held("gate_total"))
