"""Where evidence stands in a text, what signals it holds, and what of it a reader is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.windows import bound
from casewright.staging import staged

from . import reports, retrieval, scoring

#: Lengths of what is shown of a document, and how many words a code's evidence names.
SNIPPET, CONTENT, WORDS, NAME_WORDS = 520, 1500, 8, 6


def scan(text: Column, position: Column, markers: list[str], guards: dict[str, tuple[str, list[str]]] | None = None, reach: int = 18) -> Column:
    """left and right: the ends of the last marker before a position and the start of the first after it.

    Without one they are the text's ends. A marker that has a guard (`before` or
    `after`, cues) counts only with a cue whole within `reach` characters on that
    side. A marker's places don't overlap; one with a guard behind it must not
    overlap itself. The work grows with the text times the number of markers.
    """
    text, at = F.coalesce(text, F.lit("")), position.cast("int")

    def bounds(marker: str) -> Column:
        side, cues = (guards or {}).get(marker, ("", []))
        pattern = f"\\Q{marker}\\E"
        if side == "after":
            fits = [c for c in cues if len(c) <= reach]
            pattern += "(?:" + ("|".join(f"(?=(?s:.{{0,{reach - len(c)}}}\\Q{c}\\E))" for c in fits) or "(?!)") + ")"

        def step(a: Column, piece: Column) -> Column:
            start = a["at"] + F.length(piece)
            end, before = start + len(marker), F.right(F.concat(a["before"], piece), F.lit(reach))
            counts = F.exists(F.array(*[F.lit(c) for c in cues]).cast("array<string>"), lambda c: F.contains(before, c)) if side == "before" else F.lit(True)
            left = F.when(counts & (end <= at), end).otherwise(a["left"])
            right = F.when(counts & (start >= at) & (start < a["right"]), start).otherwise(a["right"])
            return F.struct(end.alias("at"), (F.concat(before, F.lit(marker)) if side == "before" else F.lit("")).alias("before"), left.alias("left"), right.alias("right"))

        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.lit(0).alias("left"), F.length(text).alias("right"))
        return bound(F.split(text, pattern, -1), lambda pieces: F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), first, step))

    ends = [F.struct(F.lit(0).alias("left"), F.length(text).alias("right"))] + [F.transform(F.array(bounds(m)), lambda b: F.struct(b["left"].alias("left"), b["right"].alias("right")))[0] for m in markers if m]
    return bound(F.array(*ends), lambda e: F.struct(F.array_max(F.transform(e, lambda x: x["left"])).alias("left"), F.array_min(F.transform(e, lambda x: x["right"])).alias("right")))


def records(text: Column, starts: Column, sentence_marks: list[str], clause_marks: list[str]) -> Column:
    """Distinct structs scope, start, end, text of the clause and the sentence around each start.

    Marks are sought in the lower-cased text, the trimmed text is as it was
    written. The work grows with the text times its starts, which are those of
    one code's words.
    """
    text = F.coalesce(text, F.lit(""))

    def around(s: Column) -> Column:
        part = lambda scope, marks: bound(scan(F.lower(text), s, marks), lambda b: F.struct(F.lit(scope).alias("scope"), b["left"].alias("start"), b["right"].alias("end")))
        return F.array(part("clause", [*sentence_marks, *clause_marks]), part("sentence", sentence_marks))

    places = F.array_distinct(F.flatten(F.transform(F.coalesce(starts, F.array().cast("array<int>")), around)))
    return F.transform(places, lambda p: F.struct(p["scope"].alias("scope"), p["start"].alias("start"), p["end"].alias("end"), F.regexp_replace(F.substring(text, p["start"] + 1, p["end"] - p["start"]), r"^\s+|\s+$", "").alias("text")))


def coerced(given: Column, own: Column) -> Column:
    """The spans (keyword, start, end) that are given, by start and the longer first; `own` if none is fit.

    Fit are spans with a keyword that end after they start; a start of 0 counts
    as not given.
    """
    fit = F.filter(F.coalesce(given, F.array().cast("array<struct<keyword:string,start:int,end:int>>")), lambda s: (F.coalesce(s["keyword"], F.lit("")) != "") & (s["start"] > 0) & (s["end"] > s["start"]))
    keyed = F.transform(fit, lambda s: F.struct(s["start"].alias("o"), (s["start"] - s["end"]).alias("p"), F.lower(s["keyword"]).alias("keyword"), s["start"].alias("start"), s["end"].alias("end")))
    sort = F.transform(F.array_sort(keyed), lambda s: F.struct(s["keyword"].alias("keyword"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(sort) > 0, sort).otherwise(own)


def historic(text: Column, spans: Column, pattern: str, reach: int = 120) -> Column:
    """Whether words of the past stand within `reach` characters of one of the spans (start, end).

    The pattern holds the caller's words. Such a code stays, at 0.4 of its confidence.
    """
    near = lambda s: F.substring(text, F.greatest(F.lit(1), s["start"] - reach + 1), s["end"] + reach - F.greatest(F.lit(0), s["start"] - reach))
    return F.coalesce(F.exists(spans, lambda s: near(s).rlike(pattern)), F.lit(False))


def distress(texts: Column, matched: Column, terms: dict[str, list[str]], least: int = 2) -> Column:
    """valid and mult of a broad code, from which signals its evidence holds.

    `terms` are words of the caller for `core`, `impact`, `stressor`, `severity`
    and `mild`. Without a core word the code goes at 0.25, and so it does where
    it is called mild without impact or severity; impact keeps it whole, enough
    kinds of signals at 0.85, else it goes at 0.35.
    """
    held = lambda kind: F.exists(F.array(*[F.lit(w) for w in terms.get(kind, [])]).cast("array<string>"), lambda w: F.exists(texts, lambda t: F.contains(t, w)))
    core = held("core") | F.arrays_overlap(F.array(*[F.lit(w) for w in terms.get("core", [])]).cast("array<string>"), matched)
    impact, stressor, severity = held("impact"), held("stressor"), held("severity")
    kinds = impact.cast("int") + stressor.cast("int") + severity.cast("int")
    verdict = lambda valid, mult: F.struct(F.lit(valid).alias("valid"), F.lit(mult).alias("mult"))
    return F.when(~core, verdict(False, 0.25)).when(held("mild") & ~impact & ~severity, verdict(False, 0.25)).when(impact, verdict(True, 1.0)).when(kinds >= least, verdict(True, 0.85)).otherwise(verdict(False, 0.35))


def matched_evidence(hits: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, doc_id, code, name, keywords and name_terms that a hit's document holds; codes without any go."""
    few = retrieval.within(staged(hits.select("case_id", "doc_id")))  # few rows a case go to the texts, which stay
    d = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_t")).join(few, "doc_id").join(found.select("case_id", "code", "name", "matched"), "case_id")
    inside = lambda words: F.filter(words, lambda w: (w != "") & F.contains(F.col("_t"), F.lower(w)))
    words = F.filter(F.split(F.trim(F.coalesce("name", F.lit(""))), r"\s+"), lambda w: F.length(w) > 2)
    e = d.select("case_id", "doc_id", "code", "name", inside(F.coalesce("matched", F.array().cast("array<string>"))).alias("k"), inside(words).alias("n"))
    return e.where((F.size("k") > 0) | (F.size("n") > 0)).select("case_id", "doc_id", "code", "name", F.slice("k", 1, WORDS).alias("keywords"), F.slice("n", 1, NAME_WORDS).alias("name_terms"))


def shown(hits: DataFrame, found: DataFrame, docs: DataFrame, sources: list[str] = ()) -> DataFrame:
    """case_id, rank, doc_id, source, snippet, content, score, codes of each hit, as a reader is shown it.

    The source is the first of the documents' columns `sources` that is not
    empty, else `doc-` and the id. `codes` are those the document holds evidence
    of, in order.
    """
    named = F.coalesce(*[F.nullif(F.col(s).cast("string"), F.lit("")) for s in sources], F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", named.alias("source"), F.substring(text, 1, SNIPPET).alias("snippet"), F.substring(text, 1, CONTENT).alias("content"))
    hits = staged(hits.select("case_id", "doc_id", "rank", "score"))
    few = retrieval.within(hits.select("doc_id").distinct())
    codes = matched_evidence(hits, found, docs).groupBy("case_id", "doc_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    j = hits.join(d.join(few, "doc_id"), "doc_id", "left").join(codes, ["case_id", "doc_id"], "left")
    return j.select("case_id", "rank", "doc_id", "source", "snippet", "content", "score", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def score_trace(hits: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, doc_id, rank, base, final, place: the hits in the order of their new score."""
    s = scoring.score(hits, found, docs).join(hits.select("case_id", "doc_id", "rank"), ["case_id", "doc_id"])
    return s.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("final").desc(), "rank")))


def score_versions(hits: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, doc_id, plain, final, difference of the plain weighted score and the probabilistic one."""
    plain = reports.simple_scores(hits, found, docs).select("case_id", "doc_id", F.col("weighted_score").alias("plain"))
    final = scoring.score(hits, found, docs).select("case_id", "doc_id", "final")
    return plain.join(final, ["case_id", "doc_id"]).withColumn("difference", F.round(F.col("final") - F.col("plain"), 4))


def case_result(found: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, problems, detection, evidence, confidence (0.8 and 0.2 of them), and the mean of all and of the three best scores.

    A case without hits has score 0.
    """
    blend = reports.retrieval_evidence(found, hits, docs)
    per = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("problems"), F.round(F.avg("confidence"), 6).alias("detection"))
    best = hits.groupBy("case_id").agg(F.avg("score").alias("a"), F.slice(F.sort_array(F.collect_list("score"), False), 1, 3).alias("t"))
    top = F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.size("t")
    return per.join(blend, "case_id").join(best, "case_id", "left").select("case_id", "problems", "detection", "evidence", "confidence", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("mean_score"), F.round(F.coalesce(top, F.lit(0.0)), 6).alias("top_score"))
