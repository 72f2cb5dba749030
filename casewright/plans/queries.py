"""The engine's queries over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import scoring as S
from casewright.functions import text as T
from casewright.operators import detection, gates, metrics, preparation, retrieval, scoring, statistics
from casewright.tables import table

from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TOK = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""
dt AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), dn AS (SELECT doc_id, len(t) AS dl, t FROM dt WHERE len(t) > 0),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM dn) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dn),
raw AS (SELECT term, count(*) AS df, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, n GROUP BY term, n.n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN qt USING (term) JOIN idf USING (term), n GROUP BY ALL)
"""


def _top(frm: str, k: int, by: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT {by}, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {frm}) WHERE rank <= {k}"


@query(f"WITH {_BM25} {_top('hits', 10)}")
def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _asked(spark, d))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    return retrieval.term_weights(retrieval.corpus(table(spark, d, "documents"))).select("term", "df", F.round("idf", 6).alias("idf"))


_COV = f"""
dd AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), qd AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
qn AS (SELECT query_id, count(*) AS n FROM qd GROUP BY 1), cov AS (SELECT query_id, doc_id, count(*) / max(n) AS score FROM qd JOIN dd USING (term) JOIN qn USING (query_id) GROUP BY ALL)
"""
_RRF = f"{_BM25}, {_COV}, b25 AS ({_top('hits', 25)}), c25 AS ({_top('cov', 25)}), f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM b25 UNION ALL SELECT query_id, doc_id, rank FROM c25) GROUP BY ALL)"


@query(f"WITH {_RRF} {_top('f', 10)}")
def rrf_fusion(spark, d):
    docs, asked = retrieval.corpus(table(spark, d, "documents")), _asked(spark, d)
    return retrieval.rrf([retrieval.bm25(docs, asked, 25), retrieval.covered(docs, asked, 25)])


@query(f"WITH {_RRF}, pool AS ({_top('f', 30)}), h AS (SELECT pool.query_id, pool.doc_id, coalesce(cov.score, 0) AS score FROM pool LEFT JOIN cov ON pool.query_id = cov.query_id AND pool.doc_id = cov.doc_id) {_top('h', 10)}")
def hybrid_topk(spark, d):
    return retrieval.hybrid(table(spark, d, "documents"), _asked(spark, d))


@query(f"""WITH {_BM25}, b AS ({_top('hits', 3)}),
w AS (SELECT query_id, rank, word, min(pos) AS pos FROM (SELECT query_id, rank, unnest(t) AS word, unnest(range(len(t))) AS pos FROM b JOIN dn USING (doc_id)) WHERE length(word) > 3 GROUP BY ALL),
nw AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = w.query_id AND qt.term = w.word)),
f5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY pos) AS n FROM nw) WHERE n <= 5),
o AS (SELECT query_id, word, min(rank * 1000000 + pos) AS place FROM f5 GROUP BY ALL)
SELECT query_id, position, word FROM (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position FROM o) WHERE position <= 5""")
def prf_expand(spark, d):
    return retrieval.feedback_terms(table(spark, d, "documents"), _asked(spark, d))


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return retrieval.dense(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), asked, k)


_DENSE = "ds AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, greatest(0.0, least(1.0, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"


@query(f"WITH {_DENSE} {_top('ds', 10)}")
def dense_topk(spark, d):
    return _dense(spark, d, 10)


def _graded(spark, d):
    label = table(spark, d, "embeddings").select("vec_id", "label")
    per = label.groupBy("label").agg(F.count(F.lit(1)).alias("relevant"))
    q = label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")).join(F.broadcast(per), F.col("ql") == per["label"]).drop("label")
    hit = label.select(F.col("vec_id").alias("doc_id"), "label")
    return _dense(spark, d, 10).join(q, "query_id").join(hit, "doc_id").select("query_id", "doc_id", "rank", "ql", "relevant", (F.col("label") == F.col("ql")).cast("int").alias("grade"))


_GRADED = f"""{_DENSE}, tk AS ({_top('ds', 10)}), g AS (SELECT tk.query_id, tk.doc_id, tk.rank, q.label AS ql, (q.label = e.label)::INT AS grade, (SELECT count(*) FROM embeddings x WHERE x.label = q.label) AS relevant
FROM tk JOIN embeddings q ON q.vec_id = tk.query_id JOIN embeddings e ON e.vec_id = tk.doc_id),
g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal, sum((grade > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM g),
m AS (SELECT query_id, sum(((grade > 0) AND rank <= 5)::INT) AS tp, sum((rank <= 5)::INT) AS ret, max(relevant) AS rel,
sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg,
sum(CASE WHEN grade > 0 THEN hits / rank ELSE 0 END) AS ps, min(CASE WHEN grade > 0 THEN rank END) AS fr FROM g2 GROUP BY query_id),
mm AS (SELECT query_id, round(tp / ret, 6) AS "precision", round(tp / rel, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / ret) * (tp / rel) / (tp / ret + tp / rel) ELSE 0 END, 6) AS f1,
round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(ps / rel, 6) AS ap, round(coalesce(1.0::DOUBLE / fr, 0), 6) AS rr FROM m)"""


@query(f"WITH {_GRADED} SELECT * FROM mm")
def metrics_at_k(spark, d):
    return metrics.metrics(_graded(spark, d), 5, ["query_id"])


@query(f"WITH {_GRADED}, u AS (SELECT 'ndcg' AS metric, ndcg AS v FROM mm UNION ALL SELECT 'ap', ap FROM mm UNION ALL SELECT 'rr', rr FROM mm) SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, round(min(v), 6) AS low, round(max(v), 6) AS high, count(v) AS n FROM u GROUP BY metric")
def strategy_summary(spark, d):
    m = metrics.metrics(_graded(spark, d), 5, ["query_id"]).select("query_id", "ndcg", "ap", "rr")
    return metrics.summary(m.unpivot("query_id", ["ndcg", "ap", "rr"], "metric", "v"), ["metric"], "v")


def _found(spark, d):
    return detection.detections(X.cases(table(spark, d, "documents")), X.taxonomy(spark))


_FOUND = f"""tx AS {X.TAXONOMY_SQL}, mt AS (SELECT doc_id AS case_id, lower(coalesce(text, '')) AS text, code, name, severity, keywords, list_filter(keywords, lambda k: contains(lower(coalesce(text, '')), lower(k))) AS matched FROM documents, tx),
fd AS (SELECT case_id, text, code, name, severity, keywords, matched, round(least(0.95, greatest(0.05, 0.5 + least(0.24, len(matched) * 0.1) + least(0.1, len(matched)::DOUBLE / len(keywords) * 0.18)
+ least(0.12, list_sum(list_transform(matched, lambda k: length(k)))::DOUBLE / len(matched) / 24 * 0.12) + CASE WHEN len(list_filter(matched, lambda k: length(k) >= 10 OR contains(k, ' '))) > 0 THEN 0.04 ELSE 0 END
+ least(0.06, list_sum(list_transform(matched, lambda k: greatest((length(text) - length(replace(text, k, ''))) // length(k) - 1, 0))) * 0.03)))::DOUBLE, 4) AS confidence FROM mt WHERE len(matched) > 0)"""


@query(f"WITH {_FOUND} SELECT case_id, code, array_to_string(matched, ',') AS matched, confidence FROM fd")
def l1_confidence(spark, d):
    return _found(spark, d).select("case_id", "code", F.array_join("matched", ",").alias("matched"), "confidence")


@query(f"WITH {_FOUND} SELECT a.case_id, c.code, c.other FROM fd a JOIN {X.CONFLICTS_SQL} c ON a.code = c.code JOIN fd b ON b.case_id = a.case_id AND b.code = c.other")
def conflict_pairs(spark, d):
    return detection.conflicts(_found(spark, d), X.frame(spark, X.CONFLICTS, "code, other"))


@query(f"WITH {_FOUND} SELECT case_id, code FROM (SELECT f.case_id, f.code, row_number() OVER (PARTITION BY f.case_id, coalesce(grp, f.code) ORDER BY coalesce(preferred, 0) DESC, confidence DESC, severity DESC, f.code DESC) AS n FROM fd f LEFT JOIN {X.GROUPS_SQL} g ON f.code = g.code) WHERE n = 1")
def dedupe_codes(spark, d):
    return detection.without_duplicates(_found(spark, d), X.frame(spark, X.GROUPS, "code, grp, preferred")).select("case_id", "code")


@query(f"""WITH {_FOUND}, wk AS (SELECT DISTINCT f.case_id, f.code FROM fd f JOIN {X.PREFERS_SQL} p ON f.code = p.generic JOIN fd s ON s.case_id = f.case_id AND s.code = p.specific)
SELECT f.case_id, f.code, CASE WHEN wk.code IS NOT NULL THEN least(confidence, 0.24) ELSE confidence END AS confidence, CASE WHEN wk.code IS NULL AND confidence >= 0.6 THEN 'confirmed' ELSE 'needs_review' END AS status FROM fd f LEFT JOIN wk ON f.case_id = wk.case_id AND f.code = wk.code""")
def review_status(spark, d):
    f = detection.downgraded(_found(spark, d), X.frame(spark, X.PREFERS, "generic, specific"))
    return f.select("case_id", "code", "confidence", detection.review_status(F.col("confidence"), F.col("valid")).alias("status"))


@query(f"WITH {_FOUND} SELECT doc_id AS case_id, CASE WHEN max(severity) IS NULL THEN 'NOT_ASSESSED' WHEN bool_or(code = 'X60-X84') THEN 'CRITICAL' WHEN max(severity) >= 4 THEN 'HIGH' WHEN max(severity) = 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM documents LEFT JOIN fd ON doc_id = case_id GROUP BY doc_id")
def severity_level(spark, d):
    g = _found(spark, d).groupBy("case_id").agg(F.max("severity").alias("most"), F.max(F.col("code") == "X60-X84").alias("crisis"))
    return X.cases(table(spark, d, "documents")).select("case_id").distinct().join(g, "case_id", "left").select("case_id", detection.severity_level(F.col("crisis"), F.col("most")).alias("level"))


@query(f"""WITH {_FOUND}, us AS (SELECT tool, unnest(uses) AS u FROM {X.TOOLS_SQL}),
sc AS (SELECT case_id, tool, sum(CASE WHEN lower(name) = lower(u) THEN 10 WHEN contains(lower(name), lower(u)) OR contains(lower(u), lower(name)) THEN 8 ELSE 0 END + 3 * len(list_filter(matched, lambda k: contains(lower(u), lower(k))))) AS score FROM fd, us GROUP BY ALL)
SELECT case_id, tool, score::BIGINT AS score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, tool) AS rank FROM sc WHERE score > 0""")
def tool_recommend(spark, d):
    return detection.tools(_found(spark, d), X.frame(spark, X.TOOLS, "tool, uses"))


@query(f"WITH {_FOUND} SELECT case_id AS doc_id, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM fd WHERE len(matched) >= 2 GROUP BY case_id")
def auto_tag(spark, d):
    return detection.auto_tags(table(spark, d, "documents"), X.taxonomy(spark))


_PRIOR = f"""{_FOUND}, pr0 AS (SELECT *, greatest((severity + 2.0::DOUBLE / count(*) OVER w) / (sum(severity) OVER w + 2.0), 0.01) AS raw FROM fd WINDOW w AS (PARTITION BY case_id)),
pr AS (SELECT *, raw / sum(raw) OVER (PARTITION BY case_id) AS prior FROM pr0),
cl0 AS (SELECT case_id, count(*) AS n, -sum(prior * log2(prior)) AS h, sum(prior * ln(prior)) AS pl, avg(confidence) AS mc, sum(prior * confidence) AS pc, max(severity) AS ms FROM pr GROUP BY case_id),
cl1 AS (SELECT *, CASE WHEN n > 1 THEN least(2.0, greatest(0.0, pl + ln(n))) ELSE 0 END AS kl, greatest(0.01, 2 / (1 + exp(-(0.3 * n + 0.5 * mc - 0.95)))) AS alpha FROM cl0),
cl AS (SELECT *, greatest(0.01, alpha * (1 + 0.5 * h) * (1 - 0.15 * kl)) AS ae, 0.5 + 0.5 * least(pc, 1.0) AS bayes FROM cl1)"""


@query(f"WITH {_PRIOR} SELECT case_id, code, round(prior, 6) AS prior FROM pr")
def problem_prior(spark, d):
    return scoring.priors(_found(spark, d)).select("case_id", "code", F.round("prior", 6).alias("prior"))


@query(f"WITH {_PRIOR} SELECT case_id, n, round(h, 5) AS entropy, round(kl, 5) AS kl, round(ae, 5) AS alpha_eff, round(bayes, 5) AS bayes FROM cl")
def alpha_eff(spark, d):
    c = scoring.case_level(scoring.priors(_found(spark, d)))
    return c.select("case_id", "n", *[F.round(x, 5).alias(x) for x in ("entropy", "kl", "alpha_eff", "bayes")])


_IDFT = "list_concat(list_distinct(list_transform(keywords, lambda k: lower(k))), CASE WHEN name <> '' THEN [lower(name)] ELSE [] END)"
_IDF = f"least(3.0, greatest(0.5, ln(1 + 500 / (1 + greatest(1.0, floor(len({_IDFT}) * 8 * (1 - 0.5 * least(list_sum(list_transform({_IDFT}, lambda k: length(k)))::DOUBLE / len({_IDFT}) / 10, 1.0))))))))"
_CAL = "CASE WHEN confidence <= 0 OR confidence >= 1 THEN confidence ELSE pow(confidence, 1 / greatest(0.1, 0.5 + (1 - severity::DOUBLE / ms) * 1.5)) END"


@query(f"WITH {_PRIOR} SELECT case_id, code, round({_CAL}, 4) AS calibrated, round({_IDF}, 4) AS idf FROM pr JOIN cl USING (case_id)")
def calibration_and_idf(spark, d):
    f = _found(spark, d)
    c = scoring.case_level(scoring.priors(f)).select("case_id", "max_severity")
    return f.join(c, "case_id").select("case_id", "code", F.round(S.calibrated(F.col("confidence"), F.col("severity"), F.col("max_severity")), 4).alias("calibrated"), F.round(S.heuristic_idf(S.idf_terms(F.col("keywords"), F.col("name"))), 4).alias("idf"))


def _bench_cases(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")


def _bench_found(spark, d):
    return detection.detections(_bench_cases(spark, d), X.taxonomy(spark))


def _bench_gated(spark, d):
    """The codes of the asked texts with their polarity gates."""
    g = gates.polarity(detection.keyword_matches(_bench_cases(spark, d), X.taxonomy(spark)), X.MARKERS)
    return _bench_found(spark, d).join(g.select("case_id", "code", "gate_total"), ["case_id", "code"])


def _bench(sql: str) -> str:
    """The same over the asked texts for cases."""
    return sql.replace("FROM documents, tx", "FROM benchmark, tx").replace("doc_id AS case_id", "item_id AS case_id")


_M, _ANY = X.MARKERS, gates.any_of
_GATE_TAIL = f""", wd AS (SELECT *, greatest(20, least(32, floor(length(text) * 0.15)::INT)) AS wd FROM fd), kk AS (SELECT case_id, code, text, wd, unnest(list_concat(list_transform(matched, lambda k: lower(k)), CASE WHEN name <> '' AND contains(text, lower(name)) THEN [lower(name)] ELSE [] END)) AS k FROM wd), pp0 AS (SELECT *, strpos(text, k) AS p FROM kk),
sp AS (SELECT case_id, code, k, regexp_extract(regexp_replace(substring(text, greatest(1, p - wd), least(wd, p - 1)), '(?s)^.*{_ANY(_M.clause)}', ''), '(?s)^.*({_ANY(_M.negation)}.*)$', 1) AS span FROM pp0),
ng AS (SELECT case_id, code, count(*) FILTER (span <> '' AND NOT regexp_matches(span || k, '{_ANY(_M.exceptions)}'))::DOUBLE / count(*) AS share FROM sp GROUP BY ALL),
gt AS (SELECT fd.case_id, fd.code, round(greatest(0.1, least(1.0, 1 - 0.6::DOUBLE * share)), 4) AS gate_neg, round(least(1.0, log10(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) / 10.0::DOUBLE + 1) + 0.5), 4) AS gate_len,
CASE WHEN severity < 3 OR regexp_matches(text, '{_ANY(_M.own)}') THEN 1.0 WHEN regexp_matches(text, '{_ANY(_M.reported)}') THEN 0.7 WHEN regexp_matches(text, '{_ANY(_M.other)}') THEN 0.85 ELSE 1.0 END::DOUBLE AS gate_sub FROM fd JOIN ng USING (case_id, code))"""

_WEIGHTS = scoring.WEIGHTS
_SOFT, _HARD = "len(hit)::DOUBLE / len(terms)", "(len(hit) > 0)::INT::DOUBLE"


def _ways_sql(rows: list[tuple]) -> str:
    full = [(name, *({"alpha": 1.0, "product": False} | {f"w_{k}": v for k, v in _WEIGHTS.items()} | changes).values()) for name, changes in rows]
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{float(v)!r}::DOUBLE" for v in r) + ")" for r in full) + ") v(variant, alpha, product, wd, ws, wp, wi, wn)"


def _features_sql(share: str = _SOFT, prior: str = _PRIOR, vectors: str = "") -> str:
    """CTEs up to `fe`, the features of the first 15 hits, and `cl`, the case level."""
    near = ", dv.embedding AS dvec, cv.embedding AS cvec" if vectors else ""
    more = " LEFT JOIN embeddings dv ON dv.vec_id = hs.doc_id LEFT JOIN cv ON cv.code = pr.code" if vectors else ""
    return f"""{_BM25}, {_bench(prior)}{_GATE_TAIL}{vectors}, hs AS ({_top('hits', 15)}),
pp AS (SELECT hs.query_id AS case_id, hs.doc_id, hs.score, pr.code, pr.name, pr.keywords, pr.severity, pr.confidence, pr.prior, cl.ms, gate_neg, gate_len, gate_sub, list_concat(list_distinct(list_concat(keywords, matched)), CASE WHEN pr.name <> '' THEN [pr.name] ELSE [] END) AS terms, lower(documents.text) AS dtext{near}
FROM hs JOIN documents ON hs.doc_id = documents.doc_id LEFT JOIN pr ON pr.case_id = hs.query_id LEFT JOIN cl ON cl.case_id = hs.query_id LEFT JOIN gt ON gt.case_id = hs.query_id AND gt.code = pr.code{more}),
ph AS (SELECT *, list_filter(terms, lambda k: contains(dtext, lower(k))) AS hit FROM pp),
fe AS (SELECT case_id, doc_id, score, code, {_CAL} AS detect, {share} AS semantic, prior, greatest(0.0, least(1.0, ({_IDF} - 0.5) / 2.5)) AS specificity, round(gate_neg * gate_len * gate_sub, 4) AS negation FROM ph)"""


def _ways_scored_sql(ways: list[tuple], **how) -> str:
    return f"""{_features_sql(**how)}, fi AS (SELECT variant, case_id, doc_id, any_value(score) AS score, any_value(v.alpha) AS va, avg(CASE WHEN product THEN detect * semantic * prior * specificity * negation ELSE wd * detect + ws * semantic + wp * prior + wi * specificity + wn * negation END) AS phi FROM fe, {_ways_sql(ways)} GROUP BY variant, case_id, doc_id),
al AS (SELECT fi.*, cl.bayes, greatest(0.01, greatest(0.01, 2 * va / (1 + exp(-(0.3 * n + 0.5 * mc - 0.95)))) * (1 + 0.5 * h) * (1 - 0.15 * kl)) AS eff FROM fi LEFT JOIN cl ON cl.case_id = fi.case_id),
sd AS (SELECT variant, case_id, doc_id, round(score, 6) AS base, round(phi, 6) AS phi, round(coalesce(score * exp(least(3.0, greatest(-3.0, eff * phi))) * bayes, score), 6) AS final FROM al)"""


def _case_hits(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), 15).select(F.col("query_id").alias("case_id"), "doc_id", "score")


def _ways(spark, d, ways: list[tuple], prior_mode: str = "severity", hits: DataFrame | None = None, **how):
    found = _bench_gated(spark, d)
    parts = scoring.features(hits if hits is not None else _case_hits(spark, d), found, table(spark, d, "documents"), prior_mode, **({"matching": "keyword_soft"} | how))
    return scoring.scored(parts, scoring.case_level(scoring.priors(found, prior_mode)), scoring.variants(spark, ways))


_ONE = [("full", {})]


@query(f"WITH {_ways_scored_sql(_ONE)} SELECT case_id, doc_id, base, final FROM sd")
def final_score(spark, d):
    return scoring.score(_case_hits(spark, d), _bench_gated(spark, d), table(spark, d, "documents"))


@query(f"WITH {_ways_scored_sql(_ONE, share=_HARD)} SELECT case_id, doc_id, base, final FROM sd")
def final_score_hard(spark, d):
    return scoring.score(_case_hits(spark, d), _bench_gated(spark, d), table(spark, d, "documents"), soft=False)


_ALPHAS = [(str(a), {"alpha": a}) for a in (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)]


@query(f"WITH {_ways_scored_sql(_ALPHAS)} SELECT variant::DOUBLE AS alpha, count(*) AS n, round(avg(final), 4) AS mean_final, round(max(final), 4) AS max_final FROM sd GROUP BY 1")
def variant_sweep(spark, d):
    return _ways(spark, d, _ALPHAS).groupBy(F.col("variant").cast("double").alias("alpha")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final"), 4).alias("mean_final"), F.round(F.max("final"), 4).alias("max_final"))


@query(f"""WITH {_PRIOR.replace("FROM documents, tx", "FROM benchmark, tx").replace("doc_id AS case_id", "item_id AS case_id")}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY prior DESC, code) AS n FROM pr) WHERE n <= 3),
tm AS (SELECT case_id, n, unnest(list_concat([name], keywords[1:3])) AS term, unnest(range(1 + len(keywords[1:3]))) AS pos FROM tp),
od AS (SELECT case_id, lower(term) AS low, min(n * 100 + pos) AS place, arg_min(term, n * 100 + pos) AS term FROM tm GROUP BY 1, 2), ad AS (SELECT case_id, string_agg(term, ' ' ORDER BY place) AS added FROM od GROUP BY case_id)
SELECT item_id AS case_id, concat_ws(' ', text, added) AS expanded FROM benchmark LEFT JOIN ad ON item_id = case_id""")
def query_expansion(spark, d):
    return scoring.expansion(_bench_found(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text"))


@query("""SELECT doc_id, round(least(1.0, log10(length(text) / 10.0 + 1) + 0.5), 4) AS gate, greatest(20, least(32, floor(length(text) * 0.15)::INT)) AS balanced, greatest(25, least(35, floor(length(text) * 0.15)::INT)) AS safety,
round((length(text) - length(regexp_replace(text, '[À-ÿ]', '', 'g')))::DOUBLE / length(text), 6) AS accented, 'chunk_' || left(md5(source || ':' || left(text, 100) || ':0'), 12) AS chunk_id FROM documents WHERE length(text) > 0""")
def text_gates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", T.length_gate(t).alias("gate"), T.adaptive_window(t).alias("balanced"), T.adaptive_window(t, "safety").alias("safety"), F.round(T.script_ratio(t, "À", "ÿ"), 6).alias("accented"), T.chunk_id(F.col("source"), t, F.lit(0)).alias("chunk_id"))


@query("SELECT md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    return preparation.exact_duplicates(table(spark, d, "documents"))


@query("""WITH f AS (SELECT DISTINCT lang AS stratum, doc_id AS family FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(family::VARCHAR || ':42')) AS n, count(*) OVER (PARTITION BY stratum) AS m FROM f)
SELECT stratum, family, CASE WHEN n <= greatest(1, floor(m * 0.3)) THEN 'test' ELSE 'train' END AS split FROM r""")
def family_split(spark, d):
    return preparation.stratified_split(table(spark, d, "documents").select(F.col("lang").alias("stratum"), F.col("doc_id").alias("family")), "stratum", "family")


@query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42')) AS place FROM documents) WHERE place <= 10")
def stratified_sample(spark, d):
    return preparation.stratified_sample(table(spark, d, "documents"), "lang", "doc_id")


@query("SELECT role, " + ", ".join(f"count(*) FILTER (turn = {t}) AS turn_{t}" for t in range(8)) + ", count(*) FILTER (turn IS NULL OR turn NOT BETWEEN 0 AND 7) AS turn_other FROM conversations GROUP BY role")
def crosstab(spark, d):
    return preparation.crosstab(table(spark, d, "conversations"), "role", "turn", list(range(8)))




_TYPES = "WITH e AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL), ty AS (SELECT min(event_type) AS one, max(event_type) AS two FROM events), df AS (SELECT a.user_id, round(b.v - a.v, 9) AS d, a.v AS a, b.v AS b FROM e a JOIN e b USING (user_id), ty WHERE a.event_type = one AND b.event_type = two)"


def _differences(spark, d):
    events = table(spark, d, "events")
    e = events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    ends = events.agg(F.min("event_type").alias("one"), F.max("event_type").alias("two"))
    e = e.join(F.broadcast(ends))
    return statistics.paired(e.where("event_type = one"), e.where("event_type = two"), "user_id", "v")


@query(f"{_TYPES} SELECT count(*) AS n, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, round(avg(d), 5) AS mean_delta, round(avg(d) / nullif(stddev_pop(d), 0), 5) AS cohen_d FROM df")
def paired_delta(spark, d):
    x = F.col("d")
    return _differences(spark, d).agg(F.count(x).alias("n"), F.count_if(x > 1e-12).alias("wins"), F.count_if(F.abs(x) <= 1e-12).alias("ties"), F.round(F.avg(x), 5).alias("mean_delta"), F.round(F.avg(x) / F.nullif(F.stddev_pop(x), F.lit(0.0)), 5).alias("cohen_d"))


@query(f"""{_TYPES}, r AS (SELECT d, abs(d) AS m, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM df WHERE d <> 0),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm, sum(t * t - 1.0::DOUBLE) AS t FROM r)
SELECT 'all' AS family, n, wp AS w_plus, wm AS w_minus, round((wp - wm) / (wp + wm), 6) AS rank_biserial, round((least(wp, wm) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - t / 48.0::DOUBLE), 6) AS z FROM s""")
def wilcoxon_w(spark, d):
    return statistics.wilcoxon(_differences(spark, d).withColumn("family", F.lit("all")), ["family"])


@query("""WITH t AS (SELECT o_orderpriority AS test, round(count(*) FILTER (o_totalprice > 400000) / count(*), 6) AS p FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM t)
SELECT test, p, round(least(1.0, max((m - k + 1) * p) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM k""")
def holm(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("test")).agg(F.round(F.count_if(F.col("o_totalprice") > 400000) / F.count(F.lit(1)), 6).alias("p"))
    return statistics.holm(t)


@query("""WITH s AS (SELECT count(*) FILTER (lang = 'en') AS n1, count(*) FILTER (lang = 'de') AS n2, avg(n_chars) FILTER (lang = 'en') AS m1, avg(n_chars) FILTER (lang = 'de') AS m2, var_samp(n_chars) FILTER (lang = 'en') AS v1, var_samp(n_chars) FILTER (lang = 'de') AS v2 FROM documents),
d AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s) SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(d, 6) AS d, round(d * (1 - 3 / (4.0::DOUBLE * (n1 + n2) - 9)), 6) AS g FROM d""")
def effect_sizes(spark, d):
    return statistics.effect_sizes(table(spark, d, "documents"), "lang", "n_chars", "en", "de")


_KAPPA = "WITH c AS (SELECT quality AS i, toxic AS j, count(*) AS o FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), r AS (SELECT i, sum(o) AS ri FROM c GROUP BY 1), k AS (SELECT j, sum(o) AS cj FROM c GROUP BY 1) SELECT (SELECT sum(o) FROM c)::BIGINT AS n, round(CASE WHEN (SELECT sum({0} * ri * cj) FROM r, k) = 0 THEN 1 ELSE 1 - ((SELECT sum({0} * o) FROM c) * (SELECT sum(o) FROM c))::DOUBLE / (SELECT sum({0} * ri * cj) FROM r, k)::DOUBLE END, 6) AS kappa"


@query(_KAPPA.format("(i <> j)::INT"))
def cohen_kappa(spark, d):
    return statistics.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")


@query(_KAPPA.format("abs(i - j)"))
def linear_kappa(spark, d):
    return statistics.cohen_kappa(table(spark, d, "labels"), "quality", "toxic", weighted=True)


@query("""WITH g AS (SELECT lang, count(n_chars) AS n, avg(n_chars) AS m, var_pop(n_chars) AS v FROM documents GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(n * v) AS w, sum(n * m * m) AS q FROM g)
SELECT k, n::BIGINT AS n, round(((q - n * gm * gm) / (k - 1)) / (w / (n - k)), 4) AS f, round((q - n * gm * gm) / (q - n * gm * gm + w), 6) AS eta2 FROM s""")
def anova_f(spark, d):
    return statistics.anova(table(spark, d, "documents"), "lang", "n_chars")


@query("""WITH r AS (SELECT lang, n_chars AS v FROM documents WHERE lang IN ('en', 'de')), sp AS (SELECT min(v) AS lo, max(v) AS hi FROM r), b AS (SELECT lang, least(19, floor((v - lo) / nullif(hi - lo, 0) * 20)) AS bin FROM r, sp),
c AS (SELECT range AS bin, count(*) FILTER (lang = 'en') AS x, count(*) FILTER (lang = 'de') AS y FROM range(20) LEFT JOIN b ON range = bin GROUP BY range), t AS (SELECT sum(x) AS nx, sum(y) AS ny FROM c),
s AS (SELECT (x / nx + 1e-10) / (1 + 20 * 1e-10) AS p, (y / ny + 1e-10) / (1 + 20 * 1e-10) AS q FROM c, t)
SELECT round(sum(p * ln(p / q)), 5) AS kl, round(sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2), 5) AS js FROM s""")
def js_divergence(spark, d):
    return statistics.js_divergence(table(spark, d, "documents"), "lang", "n_chars", "en", "de")


@query(f"""WITH {_BM25}, {_COV}, b AS ({_top('hits', 25)}), c AS ({_top('cov', 25)}), j AS (SELECT query_id, doc_id AS item, b.rank AS ra, c.rank AS rb FROM b JOIN c USING (query_id, doc_id)),
kp AS (SELECT x.query_id, sign(x.ra - y.ra) * sign(x.rb - y.rb) AS s FROM j x JOIN j y ON x.query_id = y.query_id AND x.item < y.item)
SELECT query_id, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant, round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / count(*), 6) AS tau FROM kp GROUP BY 1""")
def kendall_tau(spark, d):
    docs, asked = retrieval.corpus(table(spark, d, "documents")), _asked(spark, d)
    a = retrieval.bm25(docs, asked, 25).select("query_id", F.col("doc_id").alias("item"), F.col("rank").alias("ra"))
    b = retrieval.covered(docs, asked, 25).select("query_id", F.col("doc_id").alias("item"), F.col("rank").alias("rb"))
    return statistics.kendall(a.join(b, ["query_id", "item"]), ["query_id"])


@query("SELECT coalesce(lang, 'all') AS slice, coalesce(source, 'all') AS source, count(*) AS n, round(avg(n_chars), 5) AS mean, round(stddev_samp(n_chars), 5) AS std FROM documents GROUP BY ROLLUP (lang, source)")
def slice_rollup(spark, d):
    g = table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 5).alias("mean"), F.round(F.stddev_samp("n_chars"), 5).alias("std"))
    return g.select(F.coalesce("lang", F.lit("all")).alias("slice"), F.coalesce("source", F.lit("all")).alias("source"), "n", "mean", "std")


@query(f"""WITH {_FOUND}, ex AS (SELECT doc_id, (CASE WHEN quality = 1 THEN ['0801'] ELSE [] END || CASE WHEN toxic = 1 THEN ['F32'] ELSE [] END) AS e FROM labels), pd AS (SELECT case_id, list(code) AS p FROM fd WHERE code IN ('0801', 'F32') GROUP BY 1),
s AS (SELECT doc_id, len(list_intersect(e, coalesce(p, []))) AS tp, len(coalesce(p, [])) AS np, len(e) AS ne FROM ex LEFT JOIN pd ON doc_id = case_id)
SELECT doc_id, tp, np - tp AS fp, ne - tp AS fn, round(coalesce(tp / nullif(np, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(ne, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(np + ne, 0), 0), 6) AS f1, round(coalesce(tp / nullif(np + ne - tp, 0), 1), 6) AS jaccard, np = tp AND ne = tp AS exact FROM s""")
def set_metrics(spark, d):
    e = table(spark, d, "labels").select("doc_id", F.concat(F.when(F.col("quality") == 1, F.array(F.lit("0801"))).otherwise(F.array().cast("array<string>")), F.when(F.col("toxic") == 1, F.array(F.lit("F32"))).otherwise(F.array().cast("array<string>"))).alias("e"))
    p = _found(spark, d).where(F.col("code").isin("0801", "F32")).groupBy(F.col("case_id").alias("doc_id")).agg(F.collect_list("code").alias("p"))
    r = e.join(p, "doc_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    return metrics.set_metrics(r, "e", "p").drop("e", "p")
