"""Queries of strategies, arms, reviews and checks of case sets, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import scoring as S
from casewright.functions import text as T
from casewright.operators import detection, evaluation, experiments, metrics, preparation, reports, retrieval, rules, scoring
from casewright.staging import staged
from casewright.tables import table

from . import fixtures as X
from .more_queries import _VERDICTS, _ruled
from .queries import _BM25, _COV, _FOUND, _HARD, _ONE, _PRIOR, _SOFT, ORACLES, _asked, _bench, _bench_found, _bench_gated, _case_hits, _found, _top, _ways, _ways_scored_sql, query
from .report_queries import _SPLIT, _hits, _parts

# --- strategies, judged by all relevant documents ---

_XQ = f"xq AS (SELECT case_id AS item_id, expanded AS text FROM ({ORACLES['query_expansion']}))"
_WIDE = _ways_scored_sql(_ONE).replace(_BM25, _BM25.replace("FROM benchmark", "FROM xq"))
_JUDGED = "jd AS (SELECT case_id, code, severity, list_distinct(list_filter(list_transform(list_concat([name], keywords), lambda k: lower(trim(k))), lambda k: length(k) > 1)) AS kw FROM fd)"
_QRELS = f"""{_JUDGED}, jn AS (SELECT case_id, doc_id, severity, len(list_filter(kw, lambda k: contains(lower(coalesce(dd.text, '')), k))) AS n FROM jd, documents dd),
qg AS (SELECT case_id, doc_id, sum(CASE WHEN n >= 2 THEN 1 WHEN n = 1 AND severity >= 3 THEN 0.5 ELSE 0 END) AS c, max(CASE WHEN n >= 2 OR (n = 1 AND severity >= 3) THEN severity END) AS s, max(CASE WHEN n >= 2 THEN n END) AS m FROM jn GROUP BY ALL),
qr AS (SELECT case_id, doc_id, CASE WHEN c >= 2 OR (m >= 3 AND s >= 3) THEN 2 ELSE 1 END AS grade FROM qg WHERE c >= 1 OR (m >= 3 AND s >= 3))"""
_RUNS = f"""ru AS (SELECT 'bm25' AS strategy, query_id AS case_id, doc_id, score, rank FROM (WITH {_BM25} {_top('hits', 15)}) UNION ALL SELECT 'coverage', query_id, doc_id, score, rank FROM (WITH {_COV.strip()} {_top('cov', 15)})
UNION ALL SELECT 'h2l-bm25', case_id, doc_id, final, row_number() OVER (PARTITION BY case_id ORDER BY final DESC, doc_id) FROM sd)"""
_NAMES = ["bm25", "coverage", "h2l-bm25"]


def _expected(spark, d):
    """The codes found in the asked texts, as a labelled case states them."""
    return _bench_found(spark, d).select("case_id", "code", F.concat(F.substring("code", 1, 1), F.lit(" - "), F.col("name")).alias("category"), F.lit(None).cast("string").alias("details"), "severity")


def _judged(spark, d):
    # the letter of a code is a single character, which doesn't count, so the name is left of the category
    return evaluation.relevance_map(_expected(spark, d), X.taxonomy(spark))


def _relevant(spark, d):
    return evaluation.qrels(_judged(spark, d), table(spark, d, "documents"))


def _runs(spark, d):
    return evaluation.run(_NAMES, table(spark, d, "documents"), _asked(spark, d), _bench_gated(spark, d))


@query(f"WITH {_bench(_FOUND)}, {_JUDGED} SELECT case_id, code, severity, array_to_string(list_sort(kw), ',') AS keywords FROM jd")
def relevance_map(spark, d):
    return _judged(spark, d).withColumn("keywords", F.array_join(F.array_sort("keywords"), ","))


@query(f"WITH {_bench(_FOUND)}, {_QRELS} SELECT * FROM qr")
def corpus_qrels(spark, d):
    return _relevant(spark, d)


@query(f"WITH {_XQ}, {_WIDE}, {_RUNS} SELECT * FROM ru")
def strategy_runs(spark, d):
    return _runs(spark, d)


_ARM_VECTORS = "dq AS (SELECT b.item_id AS query_id, e.vec_id AS doc_id, greatest(0.0, least(1.0, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id AND b.item_id % 5 > 0, embeddings e)"
_MADE_TEXT = "xh AS (SELECT item_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 80) ELSE text END AS text FROM benchmark)"


@query(f"""SELECT 'dense' AS strategy, query_id AS case_id, doc_id, score, rank FROM (WITH {_ARM_VECTORS} {_top('dq', 15)})
UNION ALL SELECT 'two-arm', query_id, doc_id, score, rank FROM (WITH {_ARM_VECTORS}, {_BM25}, {_COV}, b25 AS ({_top('hits', 25)}), d25 AS ({_top('dq', 25)}), f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM b25 UNION ALL SELECT query_id, doc_id, rank FROM d25) GROUP BY ALL), pool AS ({_top('f', 30)}), h AS (SELECT pool.query_id, pool.doc_id, coalesce(cov.score, 0) AS score FROM pool LEFT JOIN cov ON pool.query_id = cov.query_id AND pool.doc_id = cov.doc_id) {_top('h', 15)})
UNION ALL SELECT 'made-text', query_id, doc_id, score, rank FROM (WITH {_MADE_TEXT}, {_BM25.replace('FROM benchmark', 'FROM xh')} {_top('hits', 15)})
UNION ALL SELECT 'h2l-dense', case_id, doc_id, final, row_number() OVER (PARTITION BY case_id ORDER BY final DESC, doc_id) FROM (WITH {_ARM_VECTORS}, {_ways_scored_sql(_ONE).replace(f"hs AS ({_top('hits', 15)})", f"hs AS ({_top('dq', 15)})")} SELECT * FROM sd)""")
def strategy_arms(spark, d):
    e = table(spark, d, "embeddings")
    vectors, asked = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), e.where("vec_id % 5 > 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    made = evaluation.generated_strategy(lambda t: F.when(F.length(t) > 200, F.substring(t, 1, 80)))
    more = {"dense": evaluation.dense_strategy(vectors, asked), "two-arm": evaluation.two_arm_strategy(vectors, asked), "made-text": made}
    return evaluation.run([*more, "h2l-dense"], table(spark, d, "documents"), _asked(spark, d), _bench_gated(spark, d), more=more)


_EVAL = f"""{_XQ}, {_WIDE}, {_RUNS}, {_QRELS}, rn AS (SELECT case_id, count(*) AS relevant FROM qr GROUP BY 1), g AS (SELECT ru.strategy, ru.case_id, ru.doc_id, ru.rank, coalesce(qr.grade, 0) AS grade, coalesce(rn.relevant, 0) AS relevant FROM ru LEFT JOIN qr ON qr.case_id = ru.case_id AND qr.doc_id = ru.doc_id LEFT JOIN rn ON rn.case_id = ru.case_id),
g2 AS (SELECT *, row_number() OVER (PARTITION BY strategy, case_id ORDER BY grade DESC, rank) AS ideal, sum((grade > 0)::INT) OVER (PARTITION BY strategy, case_id ORDER BY rank) AS got FROM g),
m AS (SELECT strategy, case_id, sum(((grade > 0) AND rank <= 5)::INT) AS tp, sum((rank <= 5)::INT) AS ret, max(relevant) AS rel, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg, sum(CASE WHEN grade > 0 THEN got / rank ELSE 0 END) AS ps, min(CASE WHEN grade > 0 THEN rank END) AS fr FROM g2 GROUP BY ALL),
mm AS (SELECT strategy, case_id, round(coalesce(tp / nullif(ret, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(rel, 0), 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / ret) * (tp / rel) / (tp / ret + tp / rel) ELSE 0 END, 6) AS f1, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(coalesce(ps / nullif(rel, 0), 0), 6) AS ap, round(coalesce(1.0::DOUBLE / fr, 0), 6) AS rr FROM m)"""


def _evaluated(spark, d):
    return evaluation.evaluated(_runs(spark, d), evaluation.judgements(_judged(spark, d), table(spark, d, "documents")))


@query(f"WITH {_EVAL} SELECT * FROM mm")
def strategy_metrics(spark, d):
    return _evaluated(spark, d)


@query(f"WITH {_EVAL} SELECT strategy, round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS std, round(median(ndcg), 6) AS median, round(min(ndcg), 6) AS low, round(max(ndcg), 6) AS high, count(*) AS n FROM mm GROUP BY 1")
def strategy_batch(spark, d):
    return metrics.summary(_evaluated(spark, d), ["strategy"], "ndcg")


@query(f"WITH {_EVAL}, j AS (SELECT a.recall AS a, b.recall AS b FROM mm a JOIN mm b USING (case_id) WHERE a.strategy = 'bm25' AND b.strategy = 'h2l-bm25') SELECT count(*) AS cases, round(avg(a), 6) AS mean_one, round(avg(b), 6) AS mean_two, round(avg(b - a) / nullif(avg(a), 0) * 100, 4) AS gain_percent, count(*) FILTER (b - a > 1e-12) AS wins, count(*) FILTER (b - a < -1e-12) AS losses FROM j")
def enhanced_gain(spark, d):
    return evaluation.compared(_evaluated(spark, d), "strategy", "bm25", "h2l-bm25", "case_id", "recall")


_CUT = f"""{_ways_scored_sql(_ONE)}, sv AS (SELECT case_id, avg(severity) AS ms FROM fd GROUP BY 1), rr AS (SELECT case_id, doc_id, final, row_number() OVER (PARTITION BY case_id ORDER BY final DESC, doc_id) AS rank FROM sd),
pz AS (SELECT rr.*, final >= 0.5 + (5 - ms) / 5 * 0.2 AS ok FROM rr JOIN sv USING (case_id)), nz AS (SELECT *, sum(ok::INT) OVER (PARTITION BY case_id) AS np, count(*) OVER (PARTITION BY case_id) AS na FROM pz)"""


@query(f"WITH {_CUT} SELECT case_id, doc_id, rank FROM nz WHERE CASE WHEN np < 5 AND na >= 5 THEN rank <= 5 ELSE ok END")
def adaptive_cut(spark, d):
    found = _bench_gated(spark, d)
    s = retrieval.ranked(scoring.score(_case_hits(spark, d), found, table(spark, d, "documents")), ["case_id"], 15, "final")
    return scoring.adaptive_cut(s, found.groupBy("case_id").agg(F.avg("severity").alias("mean_severity"))).select("case_id", "doc_id", "rank")


# --- arms of experiments ---

_PARTS = [("full", {}), ("no_detect", {"w_detect": 0.0}), ("no_semantic", {"w_semantic": 0.0}), ("no_prior", {"w_prior": 0.0}), ("no_specificity", {"w_specificity": 0.0}), ("no_negation", {"w_negation": 0.0}), ("product", {"product": True})]
_CHANGES = """rk AS (SELECT *, row_number() OVER (PARTITION BY variant, case_id ORDER BY final DESC, doc_id) AS rank FROM al2), jj AS (SELECT a.variant, a.case_id, (a.rank <> b.rank AND least(a.rank, b.rank) <= 5) AS moved, abs(a.final - b.final) AS ch FROM rk a JOIN rk b ON a.case_id = b.case_id AND a.doc_id = b.doc_id AND b.variant = 'full' WHERE a.variant <> 'full'),
pc AS (SELECT variant, case_id, bool_or(moved) AS moved, sum(ch) AS s, max(ch) AS m, count(*) AS n FROM jj GROUP BY ALL) SELECT variant, count(*) AS cases, round(avg(moved::INT), 6) AS changed, round(sum(s) / sum(n), 5) AS mean_change, round(max(m), 5) AS most_change FROM pc GROUP BY 1"""


@query(f"WITH {_ways_scored_sql(_PARTS)}, al2 AS (SELECT * FROM sd), {_CHANGES}")
def component_ablation(spark, d):
    return evaluation.order_changes(_ways(spark, d, _PARTS), "full")


def _union(frames: dict):
    out = None
    for name, df in frames.items():
        df = df.withColumn("variant", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


_CV = ", cv AS (SELECT code, embedding FROM (SELECT code, row_number() OVER (ORDER BY code) AS n FROM tx) JOIN embeddings ON vec_id = n)"
_SIM = "(CASE WHEN dvec IS NOT NULL AND cvec IS NOT NULL THEN list_dot_product(dvec::DOUBLE[], cvec::DOUBLE[]) / (sqrt(list_dot_product(dvec::DOUBLE[], dvec::DOUBLE[])) * sqrt(list_dot_product(cvec::DOUBLE[], cvec::DOUBLE[]))) END)"
_SIG = "(1 / (1 + exp(-({}))))"
_FUSED = f"CASE WHEN {_SIM} IS NULL THEN {_SOFT} ELSE greatest({_SIG.format(f'5 * {_SIM} - 1.5')} * {_SIG.format(f'{_SIM} / 0.1')} + (1 - {_SIG.format(f'5 * {_SIM} - 1.5')}) * ({_SOFT}), {_SIG.format(f'({_SIM} - 0.3) / 0.15')}) END"


def _vectors(spark, d):
    """Vectors of the driver's table for codes, by their place, and for documents, by their id."""
    e = table(spark, d, "embeddings")
    places = spark.createDataFrame([(c, k + 1) for k, c in enumerate(sorted(r[0] for r in X.TAXONOMY))], "code string, n bigint")
    return e.join(F.broadcast(places), F.col("vec_id") == F.col("n")).select("code", F.col("embedding").alias("cvec")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dvec"))


@query(f"WITH {_ways_scored_sql(_ONE, share=_FUSED, vectors=_CV)} SELECT case_id, doc_id, base, phi, final FROM sd")
def fused_score(spark, d):
    codes, docs = _vectors(spark, d)
    return _ways(spark, d, _ONE, matching="soft", code_vectors=codes, doc_vectors=docs).drop("variant")


@query(" UNION ALL ".join(f"SELECT '{n}' AS variant, * FROM (WITH {_ways_scored_sql(_ONE, share=s)} SELECT count(*) AS n, round(avg(phi), 5) AS mean_phi, round(avg(final), 4) AS mean_final FROM sd)" for n, s in (("keyword_soft", _SOFT), ("hard", _HARD))))
def matching_modes(spark, d):
    hits = staged(_case_hits(spark, d))
    out = _union({m: _ways(spark, d, _ONE, hits=hits, matching=m) for m in ("keyword_soft", "hard")})
    return out.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("phi"), 5).alias("mean_phi"), F.round(F.avg("final"), 4).alias("mean_final"))


_UNIFORM = _PRIOR.replace("greatest((severity + 2.0::DOUBLE / count(*) OVER w) / (sum(severity) OVER w + 2.0), 0.01) AS raw", "greatest(1.0::DOUBLE / count(*) OVER w, 0.01) AS raw")


@query(f"WITH u AS (SELECT 'uniform' AS variant, * FROM (WITH {_ways_scored_sql(_ONE, prior=_UNIFORM)} SELECT * EXCLUDE (variant) FROM sd) UNION ALL SELECT 'full', * FROM (WITH {_ways_scored_sql(_ONE)} SELECT * EXCLUDE (variant) FROM sd)), al2 AS (SELECT * FROM u), {_CHANGES}")
def prior_modes(spark, d):
    hits = staged(_case_hits(spark, d))
    both = _union({"full": _ways(spark, d, _ONE, hits=hits), "uniform": _ways(spark, d, _ONE, "uniform", hits=hits)})
    return evaluation.order_changes(both, "full")


@query(f"WITH {_VERDICTS} SELECT 'l1' AS arm, count(*) AS codes, count(DISTINCT case_id) AS cases, round(avg(confidence), 5) AS confidence FROM fd UNION ALL SELECT 'l1_l2', count(*), count(DISTINCT case_id), round(avg(round(c, 4)), 5) FROM mg WHERE keep")
def detection_arms(spark, d):
    base = _found(spark, d).select("case_id", "code", "severity", "confidence")
    c = base.join(_ruled(spark, d).select("case_id", "code", "valid"), ["case_id", "code"]).withColumn("asked", F.col("case_id") % 3 == 0)
    v = base.where("case_id % 2 = 0").select("case_id", "code", (F.col("case_id") % 5 > 0).alias("is_valid"))
    keep = ["case_id", "code", "confidence"]
    arms = base.select(F.lit("l1").alias("arm"), *keep).unionByName(rules.merged_verdicts(c, v).select(F.lit("l1_l2").alias("arm"), *keep))
    return arms.groupBy("arm").agg(F.count(F.lit(1)).alias("codes"), F.countDistinct("case_id").alias("cases"), F.round(F.avg("confidence"), 5).alias("confidence"))


@query(f"WITH {_FOUND}{_CV}, co AS (SELECT a.case_id, a.code, 1 + 0.3 * avg(greatest(0.0, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]))) AS w FROM fd a JOIN fd b ON a.case_id = b.case_id AND a.code <> b.code JOIN cv x ON x.code = a.code JOIN cv y ON y.code = b.code GROUP BY ALL) SELECT fd.case_id, fd.code, round(coalesce(w, 1), 4) AS weight FROM fd LEFT JOIN co ON co.case_id = fd.case_id AND co.code = fd.code")
def cooccurrence_weight(spark, d):
    return scoring.cooccurrence(_found(spark, d), _vectors(spark, d)[0]).withColumn("weight", F.round("weight", 4))


@query(f"WITH {_EVAL}, z AS (SELECT strategy, case_id, 'a' AS v, list(doc_id ORDER BY rank)[1:5] AS o, list_sort(list(doc_id ORDER BY rank)[1:5]) AS s FROM ru GROUP BY ALL) SELECT a.case_id, a.s = b.s AS same_set, a.o = b.o AS same_order FROM z a JOIN z b ON a.case_id = b.case_id AND a.strategy = 'bm25' AND b.strategy = 'h2l-bm25'")
def ranking_changes(spark, d):
    r = _runs(spark, d)
    return experiments.ranking_changes(r.where("strategy = 'bm25'"), r.where("strategy = 'h2l-bm25'"), "case_id", "doc_id", 5)


@query(f"WITH {_ways_scored_sql(_PARTS)}, df AS (SELECT abs(a.final - b.final) AS x FROM sd a JOIN sd b USING (case_id, doc_id) WHERE a.variant = 'full' AND b.variant = 'no_semantic') SELECT count(*) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS most, count(*) FILTER (x > 0.001) AS moved FROM df")
def score_distance(spark, d):
    s = _ways(spark, d, _PARTS)
    return experiments.score_distance(s.where("variant = 'full'"), s.where("variant = 'no_semantic'"), ["case_id", "doc_id"], "final")


@query(f"WITH {_ways_scored_sql(_PARTS)}, mn AS (SELECT variant, avg(phi) AS v FROM sd GROUP BY 1) SELECT variant, round((SELECT v FROM mn WHERE variant = 'full') - v, 5) AS contribution FROM mn WHERE variant <> 'full'")
def contributions(spark, d):
    means = _ways(spark, d, _PARTS).groupBy("variant").agg(F.avg("phi").alias("v"))
    return experiments.contributions(means, "variant", "v", "full").withColumn("contribution", F.round("contribution", 5))


# --- reviews of what was found ---

_STATE = "CASE WHEN confidence < 0.7 THEN CASE WHEN code IN ('0102', '0206') THEN 'verify_documents' WHEN case_id % 7 = 0 THEN 'baseline_filtered' ELSE 'filtered' END WHEN case_id % 7 = 0 THEN 'baseline_candidate' WHEN code IN ('0102', '0206') THEN 'verify_documents' WHEN confidence >= 0.6 AND case_id % 5 > 0 THEN 'confirmed' ELSE 'needs_review' END"


def _states(spark, d):
    f, i = _found(spark, d), F.col("case_id")
    state = detection.review_status(F.col("confidence"), F.lit(True), F.when(i % 5 > 0, "L1").otherwise("NeedsValidation"), F.col("confidence") < 0.7, i % 7 == 0, F.col("code").isin("0102", "0206"))
    return f.select("case_id", "code", state.alias("status"), (F.col("confidence") < 0.7).alias("filtered"))


@query(f"WITH {_FOUND} SELECT case_id, code, {_STATE} AS status, confidence < 0.7 AS filtered FROM fd")
def review_states(spark, d):
    return _states(spark, d)


_EACH = ("confirmed", "needs_review", "verify_documents", "filtered", "baseline_candidate", "baseline_filtered")


@query(f"WITH {_FOUND}, s AS (SELECT case_id, {_STATE} AS status, confidence < 0.7 AS f FROM fd) SELECT case_id, " + ", ".join(f"count(*) FILTER (status = '{e}') AS {e}" for e in _EACH) + ", count(*) FILTER (NOT f) AS accepted_total, count(*) FILTER (f) AS filtered_total, count(*) AS total FROM s GROUP BY 1")
def review_summary(spark, d):
    return detection.review_summary(_states(spark, d))


@query(f"""WITH {_FOUND}, cf AS (SELECT a.case_id, c.code, c.other FROM fd a JOIN {X.CONFLICTS_SQL} c ON a.code = c.code JOIN fd b ON b.case_id = a.case_id AND b.code = c.other), u AS (SELECT case_id, code FROM cf UNION SELECT case_id, other FROM cf UNION SELECT case_id, code FROM fd WHERE confidence < 0.7),
r AS (SELECT case_id, count(*) AS review_count, string_agg(code, ',' ORDER BY code) AS review_codes FROM u GROUP BY 1), l AS (SELECT case_id, count(*) AS n FROM cf GROUP BY 1)
SELECT r.case_id, review_count, review_codes, coalesce(l.n, 0) AS conflict_links, CASE WHEN greatest(review_count, coalesce(l.n, 0)) >= 4 THEN 'high' WHEN greatest(review_count, coalesce(l.n, 0)) >= 2 THEN 'medium' ELSE 'low' END AS level FROM r LEFT JOIN l ON l.case_id = r.case_id""")
def review_load(spark, d):
    f = _found(spark, d)
    return detection.ambiguity(f, X.frame(spark, X.CONFLICTS, "code, other"), f.where("confidence < 0.7"))


@query(f"WITH {_FOUND}, t AS (SELECT case_id, count(DISTINCT code) AS n FROM fd WHERE len(matched) >= 2 GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS tagged, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, coalesce(sum(n), 0)::BIGINT AS tags FROM t")
def tag_coverage(spark, d):
    docs = table(spark, d, "documents")
    return detection.tag_coverage(docs, detection.auto_tags(docs, X.taxonomy(spark)))


TOOL_RULES = [("X60-X84", "emergency referral", 5), ("F", "counselling", 4), ("0206|Z59|0102", "family assessment", 4), ("08", "housing office", 3)]
TOOL_ALWAYS = [("social diagnosis", 3), ("home visit", 1)]


@query(f"""WITH {_FOUND}, r AS (SELECT * FROM (VALUES {X._rows(TOOL_RULES)}) t(pattern, tool, priority)), a AS (SELECT * FROM (VALUES {X._rows(TOOL_ALWAYS)}) t(tool, priority)),
h AS (SELECT case_id, tool, priority FROM fd JOIN r ON regexp_matches(code, '^(?:' || pattern || ')') UNION SELECT case_id, tool, priority FROM fd, a), m AS (SELECT case_id, tool, max(priority) AS priority FROM h GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY priority DESC, tool) AS rank FROM m""")
def tools_by_rule(spark, d):
    return detection.tools_by_rule(_found(spark, d), X.frame(spark, TOOL_RULES, "pattern, tool, priority"), X.frame(spark, TOOL_ALWAYS, "tool, priority"))


# --- texts ---

_CLAUSES, _NOT, _OWN, _OTHER = [" and ", " und ", " et ", " que "], ["not ", "nicht ", "pas "], [" i ", " ich ", " je "], [" he ", " er ", " il "]
_HELD = lambda ws: " + ".join(f"contains(t, '{w}')::INT" for w in ws)


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, length(t) - length(translate(t, ',，', '')) + {_HELD(_CLAUSES)} AS c, ({_HELD(_OWN)}) > 0 AS mine, ({_HELD(_OTHER)}) > 0 AS theirs FROM d) SELECT doc_id, CASE WHEN length(t) < 80 THEN 'short' WHEN length(t) > 200 THEN 'long' ELSE 'medium' END AS length, CASE WHEN c <= 2 THEN 'simple' WHEN c >= 6 THEN 'complex' ELSE 'moderate' END AS complexity, ({_HELD(_NOT)}) > 0 AS negated, CASE WHEN mine AND theirs THEN 'mixed' WHEN mine THEN 'self' WHEN theirs THEN 'other' ELSE 'unclear' END AS actor FROM s")
def sentence_classes(spark, d):
    c = T.sentence_class(F.col("text"), _CLAUSES, _NOT, _OWN, _OTHER)
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.*")


@query(r"WITH t AS (SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ')) END AS n FROM documents) SELECT doc_id, n::INT AS words FROM t")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(r"WITH m AS (SELECT doc_id, coalesce(text, '') AS a, regexp_replace(coalesce(text, ''), '(?:Der|Die) ?\S+', '[NAME]', 'g') AS b FROM documents), q AS (SELECT doc_id, a, b, regexp_replace(b, '(?:Den) ?\S+', '[PLACE]', 'g') AS c FROM m) SELECT doc_id, md5(regexp_replace(c, '\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b', '[DATE]', 'g')) AS text_md5, (len(regexp_extract_all(a, '(?:Der|Die) ?\S+')) + len(regexp_extract_all(b, '(?:Den) ?\S+')) + len(regexp_extract_all(c, '\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b')))::INT AS n FROM q")
def masked_texts(spark, d):
    m = T.masked(F.col("text"), ["Der", "Die"], ["Den"])
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.md5("m.text").alias("text_md5"), F.col("m.n").alias("n"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN md5(props) END AS object_md5 FROM (SELECT event_id, regexp_extract('so: ' || props || ' done', '(?s)(\\{.*\\})', 1) AS props FROM events)")
def lenient_json(spark, d):
    text = F.concat(F.lit("so: "), F.col("props"), F.lit(" done"))
    return table(spark, d, "events").select("event_id", F.md5(rules.lenient_json(text)).alias("object_md5"))


# --- sets of cases ---

_CASES = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'C' || (doc_id // 8) || '_PAR_1' ELSE 'C' || (doc_id // 8) END AS case_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, text FROM documents"


def _case_set(spark, d):
    i = F.col("doc_id")
    root = F.concat(F.lit("C"), F.floor(i / 8).cast("string"))
    c = table(spark, d, "documents").select("doc_id", F.when(i % 4 == 0, F.concat(root, F.lit("_PAR_1"))).otherwise(root).alias("case_id"), F.when(i % 11 == 0, None).when(i % 3 == 0, "test").otherwise("train").alias("split"), "text")
    return c.withColumn("family", T.case_family(F.col("case_id")))


_FAMILY = "regexp_replace(regexp_replace(case_id, '_(PAR|ESC|SIM)_?\\d*$', ''), '_(POS|NEG)(_V\\d+)?$', '')"


@query(f"WITH c AS ({_CASES}) SELECT {_FAMILY} AS family, count(DISTINCT split) AS splits FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, d):
    return preparation.leaks(_case_set(spark, d), "family", "split")


@query(f"""WITH c AS ({_CASES}), f AS (SELECT {_FAMILY} AS family FROM c WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1), e AS (SELECT count(*) AS n FROM c GROUP BY md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) HAVING count(*) > 1),
a AS (SELECT 'missing split' AS risk, count(*) AS n FROM c WHERE split IS NULL UNION ALL SELECT 'made cases', count(*) FROM c WHERE contains(case_id, '_PAR_') UNION ALL SELECT 'family in two splits', count(*) FROM f UNION ALL SELECT 'equal texts', coalesce(sum(n - 1), 0)::BIGINT FROM e) SELECT * FROM a WHERE n > 0""")
def case_audit(spark, d):
    return preparation.audit(_case_set(spark, d), "case_id", "family", "split", "text")


@query(f"""WITH {_FOUND}, s AS (SELECT doc_id AS case_id, quality, toxic FROM labels), e AS (SELECT case_id, (CASE WHEN quality = 1 THEN ['0801'] ELSE [] END || CASE WHEN toxic = 1 THEN ['F32'] ELSE [] END) AS e FROM s), p AS (SELECT case_id, list(code) AS p FROM fd GROUP BY 1),
j AS (SELECT e, coalesce(p, []) AS p FROM e LEFT JOIN p USING (case_id)), u AS (SELECT 'missing' AS kind, unnest(list_filter(e, lambda x: NOT list_contains(p, x))) AS code FROM j UNION ALL SELECT 'extra', unnest(list_filter(p, lambda x: NOT list_contains(e, x))) FROM j), c AS (SELECT kind, code, count(*) AS n FROM u GROUP BY ALL)
SELECT kind, code, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, code) AS place FROM c QUALIFY place <= 8""")
def detector_gaps(spark, d):
    one = lambda c, v: F.when(F.col(c) == 1, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    e = table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), F.concat(one("quality", "0801"), one("toxic", "F32")).alias("e"))
    p = _found(spark, d).groupBy("case_id").agg(F.collect_list("code").alias("p"))
    return evaluation.detector_gaps(e.join(p, "case_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>"))), "e", "p")


@query("WITH r AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'correct' WHEN user_id % 3 = 1 THEN 'partial' ELSE 'incorrect' END AS r FROM events) SELECT count(*) AS n, count(*) FILTER (r = 'correct') AS correct, count(*) FILTER (r = 'partial') AS partial, count(*) FILTER (r = 'incorrect') AS incorrect, round(count(*) FILTER (r = 'correct') / count(*) * 100, 6) AS agreement_percent, round((count(*) FILTER (r = 'correct') + 0.5::DOUBLE * count(*) FILTER (r = 'partial')) / count(*), 6) AS weighted FROM r")
def weighted_agreement(spark, d):
    u = F.col("user_id") % 3
    return evaluation.weighted_agreement(table(spark, d, "events").select(F.when(u == 0, "correct").when(u == 1, "partial").otherwise("incorrect").alias("rating")))


@query("SELECT o_orderpriority, count(*) AS count, round(sum(o_totalprice::DOUBLE) / count(*), 6) AS o_totalprice, round(sum(coalesce(try_cast(o_clerk AS DOUBLE), 0)) / count(*), 6) AS o_clerk FROM (SELECT o_orderpriority, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE 'x' END AS o_clerk FROM orders) WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def group_summary(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("string").alias("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("x").alias("o_clerk"))
    return evaluation.group_summary(rows, "o_orderpriority", ["o_totalprice", "o_clerk"])


@query("SELECT vec_id, round(greatest(-1.0, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 5) AS cosine, round(1 / (1 + exp(-((list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) - 0.3) / 0.15))), 5) AS margin FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 1)")
def vector_functions(spark, d):
    e = table(spark, d, "embeddings")
    one = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q")))
    near = S.cosine(F.col("q"), F.col("embedding"))
    return e.join(one).select("vec_id", F.round(near, 5).alias("cosine"), F.round(S.margin(near), 5).alias("margin"))


@query(f"""WITH {_SPLIT}, f AS (SELECT case_id, count(*) AS n, avg(confidence) AS c FROM ok GROUP BY 1) SELECT case_id, round(c, 6) AS confidence, n AS problems FROM f""")
def score_components(spark, d):
    ok, no = _parts(spark, d)
    figures = reports.operational(ok.select("case_id").distinct(), ok, no, _hits(spark, d))
    return figures.select("case_id", F.col("avg_confidence").alias("confidence"), F.col("problems_found").alias("problems"))
