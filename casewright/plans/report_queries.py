"""Queries of comparisons, case figures, mentions, hops and case preparation, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import comparisons, preparation, profile, reports, retrieval, scoring
from casewright.sources import files
from casewright.tables import table

from . import fixtures as X
from .queries import _BM25, _FOUND, _asked, _found, _top, query

# --- groups and pairs of groups ---


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS most FROM documents GROUP BY 1")
def descriptives(spark, d):
    return comparisons.descriptives(table(spark, d, "documents"), "lang", "n_chars")


_ARMS = """ar AS (SELECT 'chars' AS g, doc_id AS k, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT 'spread', doc_id, (doc_id % 7)::DOUBLE + n_chars FROM documents UNION ALL SELECT 'english', doc_id, n_chars::DOUBLE FROM documents WHERE lang = 'en')"""


@query(f"""WITH {_ARMS}, s AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s2 FROM ar WHERE v IS NOT NULL GROUP BY 1),
df AS (SELECT a.g AS g1, b.g AS g2, count(*) AS c, avg(a.v - b.v) AS md, var_samp(a.v - b.v) AS sd2 FROM ar a JOIN ar b ON a.k = b.k AND a.g < b.g WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL),
j AS (SELECT x.g AS one, y.g AS two, x.n AS n1, y.n AS n2, coalesce(c = x.n AND c = y.n, false) AS paired, md, sd2, x.m - y.m AS gap, ((x.n - 1) * x.s2 + (y.n - 1) * y.s2) / (x.n + y.n - 2) * (1 / x.n + 1 / y.n) AS e2 FROM s x JOIN s y ON x.g < y.g LEFT JOIN df ON g1 = x.g AND g2 = y.g)
SELECT one, two, n1, n2, paired, round(CASE WHEN paired THEN md / sqrt(sd2 / n1) ELSE gap / sqrt(e2) END, 6) AS t, CASE WHEN paired THEN n1 - 1 ELSE n1 + n2 - 2 END AS df FROM j""")
def pairwise_t(spark, d):
    x = table(spark, d, "documents")
    arm = lambda name, v, rows=x: rows.select(F.lit(name).alias("g"), F.col("doc_id").alias("k"), v.cast("double").alias("v"))
    rows = arm("chars", F.col("n_chars")).unionByName(arm("spread", F.col("doc_id") % 7 + F.col("n_chars"))).unionByName(arm("english", F.col("n_chars"), x.where("lang = 'en'")))
    return comparisons.pairwise_t(rows, "g", "k", "v")


# --- figures of cases ---

_SPLIT = f"{_FOUND}, ok AS (SELECT *, 'kept' AS reason FROM fd WHERE confidence >= 0.7), no AS (SELECT *, 'weak' AS reason FROM fd WHERE confidence < 0.7)"
_HITS = f"hs AS (SELECT query_id AS case_id, doc_id, score, rank FROM ({_top('hits', 10)}))"


def _parts(spark, d):
    found = _found(spark, d)
    return found.where("confidence >= 0.7").withColumn("reason", F.lit("kept")), found.where("confidence < 0.7").withColumn("reason", F.lit("weak"))


def _hits(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), 10).withColumnRenamed("query_id", "case_id")


@query(f"""WITH {_BM25}, {_SPLIT}, {_HITS}, f AS (SELECT case_id, count(*) AS n, avg(confidence) AS c, max(severity) AS ms, sum(severity) AS sv, count(*) FILTER (severity >= 4) AS hi, count(*) FILTER (severity = 3) AS mo, sum(len(matched)) AS w FROM ok GROUP BY 1),
x AS (SELECT case_id, count(*) AS o FROM no GROUP BY 1), h AS (SELECT case_id, count(*) AS k, avg(score) AS a, max(score) AS m FROM hs GROUP BY 1),
j AS (SELECT doc_id AS case_id, coalesce(n, 0) AS n, coalesce(o, 0) AS o, coalesce(c, 0) AS c, coalesce(ms, 0) AS ms, coalesce(sv, 0) AS sv, coalesce(hi, 0) AS hi, coalesce(mo, 0) AS mo, coalesce(w, 0) AS w, coalesce(k, 0) AS k, a, m FROM documents LEFT JOIN f ON f.case_id = doc_id LEFT JOIN x ON x.case_id = doc_id LEFT JOIN h ON h.case_id = doc_id)
SELECT case_id, n AS problems_found, n + o AS candidate_count, o AS filtered_count, round(n / nullif(n + o, 0), 6) AS accepted_ratio, coalesce(round(o / nullif(n + o, 0), 6), 0) AS filtered_ratio, round(c, 6) AS avg_confidence, ms AS max_severity, hi AS high_severity_count, mo AS moderate_severity_count,
k AS retrieved_docs_count, round(a, 6) AS avg_retrieval_score, round(m, 6) AS max_retrieval_score, round(CASE WHEN n > 0 THEN least(1.0, w::DOUBLE / (n * 2)) ELSE 0.0 END, 6) AS keyword_coverage, round(CASE WHEN n > 0 THEN least(1.0, sv::DOUBLE / (n * 5)) ELSE 0.0 END, 6) AS specificity,
round(n / nullif(n + o, 0), 6) AS polarity_gate, round(CASE WHEN a IS NULL THEN NULL ELSE greatest(0.0, least(1.0, a)) END, 6) AS retrieval_evidence FROM j""")
def case_figures(spark, d):
    found, filtered = _parts(spark, d)
    return reports.operational(X.cases(table(spark, d, "documents")), found, filtered, _hits(spark, d))


@query(f"WITH {_SPLIT} SELECT case_id, state, reason, count(*) AS n FROM (SELECT case_id, 'accepted' AS state, reason FROM ok UNION ALL SELECT case_id, 'filtered', reason FROM no) GROUP BY ALL")
def candidate_trace(spark, d):
    return reports.candidate_trace(*_parts(spark, d))


@query(f"WITH {_FOUND} SELECT case_id, sum(len(matched))::BIGINT AS total_keywords, array_to_string(list_sort(list_distinct(flatten(list(matched)))), ',') AS unique_keywords FROM fd GROUP BY 1")
def keyword_analysis(spark, d):
    return reports.keyword_analysis(_found(spark, d)).withColumn("unique_keywords", F.array_join("unique_keywords", ","))


@query(f"""WITH {_BM25}, {_FOUND}, {_HITS}, pt AS (SELECT case_id, code, confidence, list_concat(list_transform(list_filter(matched, lambda x: length(x) >= 2), lambda x: lower(x)), list_transform(list_filter(string_split(name, ' '), lambda x: length(x) >= 3), lambda x: lower(x))) AS terms FROM fd),
h AS (SELECT case_id, rank, lower(text) AS t FROM hs JOIN documents USING (doc_id) WHERE text <> ''),
s AS (SELECT pt.case_id, code, any_value(confidence) AS c, sum(len(list_filter(terms, lambda k: contains(t, k)))::DOUBLE / len(terms) / rank) AS a, sum(1.0::DOUBLE / rank) AS b FROM pt LEFT JOIN h ON h.case_id = pt.case_id GROUP BY ALL)
SELECT case_id, round(avg(coalesce(least(1.0, a / b), 0.0)), 6) AS evidence, round(avg(c) * 0.8 + avg(coalesce(least(1.0, a / b), 0.0)) * 0.2, 6) AS confidence FROM s GROUP BY 1""")
def retrieval_evidence(spark, d):
    return reports.retrieval_evidence(_found(spark, d), _hits(spark, d), table(spark, d, "documents"))


@query(f"""WITH {_BM25}, {_FOUND}, {_HITS}, pt AS (SELECT case_id, severity, list_distinct(list_concat(list_concat(keywords, matched), [name])) AS terms FROM fd),
j AS (SELECT hs.case_id, hs.doc_id, hs.score, coalesce(pt.severity, 0) AS sv, len(list_filter(terms, lambda k: contains(lower(coalesce(text, '')), lower(k)))) AS n, len(terms) AS m FROM hs JOIN documents USING (doc_id) LEFT JOIN pt ON pt.case_id = hs.case_id),
g AS (SELECT case_id, doc_id, any_value(score) AS s, coalesce(sum(n::DOUBLE / m * sv) / nullif(sum(sv), 0), 0) AS soft, coalesce(sum((n > 0)::INT * sv)::DOUBLE / nullif(sum(sv), 0), 0) AS hard FROM j GROUP BY ALL)
SELECT case_id, doc_id, round(soft, 6) AS relevance, round(s * (1 + soft), 6) AS relevance_score, round(s * (1 + 0.2 * hard), 6) AS weighted_score FROM g""")
def simple_scores(spark, d):
    return reports.simple_scores(_hits(spark, d), _found(spark, d), table(spark, d, "documents"))


@query("""WITH r AS (SELECT lang, doc_id % 4 = 0 AS neg, CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 > 0 END AS kept, CASE WHEN doc_id % 6 > 0 THEN 1 - (doc_id % 2) * 0.5 END::DOUBLE AS gn, CASE WHEN doc_id % 6 > 0 THEN 1 - (doc_id % 3) * 0.25 END::DOUBLE AS gs FROM documents)
SELECT lang, count(*) AS cases, count(*) FILTER (NOT neg AND kept IS NOT NULL) AS targets, count(gn) AS triggers, round(count(*) FILTER (NOT neg AND kept) / count(*) FILTER (NOT neg AND kept IS NOT NULL), 6) AS target_preservation_rate, round(count(*) FILTER (NOT neg AND NOT kept) / count(*) FILTER (NOT neg AND kept IS NOT NULL), 6) AS false_suppression_rate,
round(count(*) FILTER (gn < 1) / count(gn), 6) AS negation_suppression_rate, round(count(*) FILTER (gs < 1) / count(gn), 6) AS subject_suppression_rate, round(count(*) FILTER (gn * gs < 1) / count(gn), 6) AS contextual_suppression_rate, round(avg(gn * gs), 6) AS mean_gate_total,
round(count(*) FILTER (NOT neg AND kept AND gn * gs < 1) / count(*) FILTER (NOT neg AND kept IS NOT NULL AND gn IS NOT NULL), 6) AS joint_pass_rate FROM r GROUP BY 1""")
def adversarial_summary(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("lang", (i % 4 == 0).alias("is_negated"), F.when(i % 5 > 0, i % 3 > 0).alias("target_preserved"), F.when(i % 6 > 0, 1 - (i % 2) * 0.5).alias("gate_neg"), F.when(i % 6 > 0, 1 - (i % 3) * 0.25).alias("gate_sub"))
    return reports.adversarial(rows.withColumn("gate_total", F.col("gate_neg") * F.col("gate_sub")), ["lang"])


# --- mentions and hops ---

LEXICON = [("clown", "actor"), ("idiot", "actor"), ("trash", "actor"), ("license", "actor"), ("licensed under", "actor"), ("worthless", "reference"), ("password", "reference"), ("released", "reference")]
_MENTIONS = f"""lx AS (SELECT * FROM (VALUES {X._rows(LEXICON)}) t(term, kind)), lo AS (SELECT doc_id AS case_id, lower(coalesce(text, '')) AS t FROM documents),
pl AS (SELECT case_id, term, kind, string_split(t, term) AS ps FROM lo JOIN lx ON contains(t, term)), st AS (SELECT case_id, term, kind, ps, unnest(range(1, len(ps))) AS i FROM pl),
sp AS (SELECT case_id, term, kind, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * length(term))::INT AS s FROM st), en AS (SELECT *, (s + length(term))::INT AS e FROM sp),
mx AS (SELECT *, max(e) OVER (PARTITION BY case_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM en), me AS (SELECT case_id, term, kind, s, e FROM mx WHERE m IS NULL OR e > m)"""


def _mentions(spark, d):
    return profile.mentions(X.cases(table(spark, d, "documents")), X.frame(spark, LEXICON, "term, kind"))


@query(f'WITH {_MENTIONS} SELECT case_id, term, kind, s AS start, e AS "end" FROM me')
def actor_mentions(spark, d):
    return _mentions(spark, d)


@query(rf"""WITH {_MENTIONS}, rf AS (SELECT me.case_id, term, s AS p, length(regexp_extract(substr(t, 1, s), '(?s)^(.*[.!?;\n。！？；])', 1)) AS s0, length(regexp_extract(substr(t, 1, s), '(?s)^(.*[,;])', 1)) AS cl, t FROM me JOIN lo USING (case_id) WHERE kind = 'reference'),
rr AS (SELECT case_id, term, p, s0, greatest(s0, cl) AS c0, contains(substr(t, s0 + 1, p - s0), ' the ') AS told FROM rf), j AS (SELECT rr.*, me.term AS actor, me.s AS a0, me.e AS a1 FROM rr JOIN me ON me.case_id = rr.case_id AND me.kind = 'actor' AND me.e <= rr.p),
k AS (SELECT *, min(a0) FILTER (a0 >= s0) OVER (PARTITION BY case_id, p, term) AS fi, max(a0) FILTER (a0 >= s0) OVER (PARTITION BY case_id, p, term) AS la FROM j),
sc AS (SELECT case_id, term, p, actor, a0, greatest(0, 220 - (p - a1)) + CASE WHEN a0 >= c0 THEN 160 WHEN a0 >= s0 THEN 95 WHEN a1 <= s0 AND s0 - a1 <= 180 THEN 70 ELSE 0 END + CASE WHEN term = 'password' AND a1 <= s0 AND s0 - a1 <= 180 THEN 35 ELSE 0 END + CASE WHEN told AND a0 = fi THEN 55 WHEN told AND a0 = la THEN -35 ELSE 0 END AS score FROM k)
SELECT case_id, term, p AS start, actor, score::INT AS score FROM sc QUALIFY row_number() OVER (PARTITION BY case_id, p, term ORDER BY score DESC, a0) = 1""")
def antecedents(spark, d):
    m = _mentions(spark, d)
    return profile.antecedents(X.cases(table(spark, d, "documents")), m.where("kind = 'actor'"), m.where("kind = 'reference'"), reporting=[" the "], deferred=["password"])


_HOPS = f"""{_FOUND}, op AS (SELECT case_id, list({{'n': name, 'k': keywords}} ORDER BY severity DESC, confidence DESC, code)[1:3] AS p FROM fd GROUP BY 1), hq1 AS (SELECT item_id, text FROM benchmark),
hq2 AS (SELECT item_id, coalesce(text, '') || ' ' || array_to_string(list_transform(p, lambda x: x.n), ' ') AS text FROM benchmark JOIN op ON case_id = item_id),
hq3 AS (SELECT item_id, coalesce(text, '') || ' ' || array_to_string(flatten(list_transform(p, lambda x: x.k[1:2]))[1:5], ' ') AS text FROM benchmark JOIN op ON case_id = item_id)"""


@query(f"WITH {_HOPS} SELECT 2 AS hop, item_id AS query_id, md5(text) AS text_md5 FROM hq2 UNION ALL SELECT 3, item_id, md5(text) FROM hq3")
def hop_queries(spark, d):
    found, asked = _found(spark, d), _asked(spark, d)
    one, two = (scoring.hop_queries(found, asked, h).select(F.lit(h + 1).alias("hop"), "query_id", F.md5("text").alias("text_md5")) for h in (1, 2))
    return one.unionByName(two)


_EACH_HOP = " UNION ALL ".join(f"SELECT {h} AS hop, * FROM (WITH {_BM25.replace('FROM benchmark', f'FROM hq{h}')} {_top('hits', 10)})" for h in (1, 2, 3))


@query(f"WITH {_HOPS}, al AS ({_EACH_HOP}) SELECT query_id, doc_id, hop, rank FROM al QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hop) = 1")
def multihop_topk(spark, d):
    return scoring.multihop(table(spark, d, "documents"), _asked(spark, d), _found(spark, d))


# --- preparation ---

_MADE = "CASE doc_id % 6 WHEN 0 THEN 'NEG_' || doc_id WHEN 1 THEN 'C' || doc_id || '_PAR_1' WHEN 2 THEN 'C' || doc_id || '_ESC_1' WHEN 3 THEN 'C' || doc_id || '_SIM_1' WHEN 4 THEN 'ADV_' || doc_id ELSE 'C' || doc_id END"


@query(f"WITH c AS (SELECT {_MADE} AS id, lang FROM documents) SELECT CASE WHEN id LIKE 'NEG\\_%' ESCAPE '\\' THEN 'polarity' WHEN contains(id, '_PAR_') THEN 'paraphrase' WHEN contains(id, '_ESC_') THEN 'complexity_escalation' WHEN contains(id, '_SIM_') THEN 'complexity_reduction' WHEN id LIKE 'ADV\\_%' ESCAPE '\\' THEN 'adversarial' ELSE 'original' END AS kind, lang, count(*) AS n FROM c GROUP BY ALL")
def augmentation_counts(spark, d):
    c = table(spark, d, "documents").select(F.expr(_MADE).alias("case_id"), "lang")
    return c.groupBy(preparation.augmentation_type(F.col("case_id")).alias("kind"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT doc_id, (doc_id % 23)::INT AS total FROM documents), b AS (SELECT doc_id, total, unnest(range(1, total + 1, 5)) AS b FROM t) SELECT doc_id, b::INT AS first, least(b + 4, total)::INT AS last FROM b")
def page_ranges(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(files.page_batches((F.col("doc_id") % 23).cast("int"), 5)).alias("p"))
    return t.select("doc_id", F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"))


@query("SELECT source, doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS place FROM documents WHERE source IS NOT NULL")
def numbered_rows(spark, d):
    return files.numbered(table(spark, d, "documents").where("source IS NOT NULL").select("source", "doc_id"), ["source"], "doc_id", "place")
