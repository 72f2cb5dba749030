"""Queries of paired diagnostics, rated systems and evidence, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import comparisons, detection, diagnostics, evidence, retrieval
from casewright.tables import table

from . import fixtures as X
from .evaluation_queries import _EVAL, _evaluated, _runs
from .more_queries import _POISSON
from .queries import _BM25, _FOUND, _ONE, _asked, _bench, _bench_found, _bench_gated, _case_hits, _ways_scored_sql, query

# --- pairs of strategies ---

_PAIRS = [("bm25", "h2l-bm25"), ("coverage", "h2l-bm25")]
_LONG = f"{_EVAL}, lg AS (SELECT strategy, case_id, case_id % 3 AS stratum, unnest(['ap', 'rr', 'ndcg']) AS metric, unnest([ap, rr, ndcg]) AS value FROM mm), prs AS (SELECT a.strategy AS one, b.strategy AS two, a.case_id, a.stratum, a.metric, a.value AS a, b.value AS b, b.value - a.value AS d FROM lg a JOIN lg b ON a.case_id = b.case_id AND a.metric = b.metric AND a.strategy IN ('bm25', 'coverage') AND b.strategy = 'h2l-bm25')"
_FIGURES = "count(*) AS n, round(avg(a), 6) AS mean_one, round(avg(b), 6) AS mean_two, round(avg(d), 6) AS delta, count(*) FILTER (d < -1e-12) AS wins_one, count(*) FILTER (d > 1e-12) AS wins_two, count(*) FILTER (abs(d) <= 1e-12) AS ties"


def _strata(spark, d):
    return _evaluated(spark, d).withColumn("stratum", F.col("case_id") % 3)


def _paired(spark, d):
    return diagnostics.paired(_strata(spark, d), "strategy", _PAIRS, "case_id", ["ap", "rr", "ndcg"], ["stratum"])


@query(f"WITH {_LONG} SELECT one, two, metric, {_FIGURES} FROM prs GROUP BY ALL")
def pair_diagnostics(spark, d):
    return diagnostics.pair_diagnostics(_paired(spark, d))


@query(f"WITH {_LONG} SELECT one, two, stratum, metric, {_FIGURES} FROM prs GROUP BY ALL")
def pair_diagnostics_by_stratum(spark, d):
    return diagnostics.pair_diagnostics(_paired(spark, d), ["stratum"])


_SIGNED = """sg AS (SELECT one, two, metric, round(d, 9) AS d FROM prs), nz AS (SELECT *, abs(d) AS m FROM sg WHERE d <> 0), rk AS (SELECT *, rank() OVER (PARTITION BY one, two, metric ORDER BY m) + (count(*) OVER (PARTITION BY one, two, metric, m) - 1) / 2.0::DOUBLE AS r FROM nz),
sw AS (SELECT one, two, metric, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM rk GROUP BY ALL), ev AS (SELECT one, two, metric, count(d) AS n FROM sg GROUP BY ALL)"""


@query(f"WITH {_LONG}, {_SIGNED} SELECT ev.one, ev.two, ev.metric, n, CASE WHEN n < 3 THEN 'not_enough_pairs' WHEN w IS NULL THEN 'sign_count_fallback' ELSE 'wilcoxon_signed_rank' END AS test, CASE WHEN n >= 3 THEN coalesce(w, 0) END::DOUBLE AS statistic FROM ev LEFT JOIN sw ON ev.one = sw.one AND ev.two = sw.two AND ev.metric = sw.metric")
def paired_tests(spark, d):
    return diagnostics.paired_test(_paired(spark, d), ["one", "two", "metric"]).drop("z")


@query(f"""WITH {_EVAL}, av AS (SELECT strategy, round(avg(ndcg), 9) AS m FROM mm GROUP BY 1), bb AS (SELECT strategy FROM av WHERE strategy IN ('bm25', 'coverage') ORDER BY m DESC, strategy LIMIT 1),
df AS (SELECT a.case_id % 3 AS stratum, b.ndcg - a.ndcg AS d FROM mm a JOIN bb USING (strategy) JOIN mm b ON b.case_id = a.case_id AND b.strategy = 'h2l-bm25'), fs AS (SELECT stratum, count(*) AS n, avg(d) AS m, stddev_pop(d) AS s FROM df GROUP BY 1 HAVING count(*) >= 2)
SELECT stratum, n, round(m / (s + 1e-10), 3) AS d, round(s / sqrt(n), 4) AS se, round(m / (s + 1e-10) - 1.96::DOUBLE * s / sqrt(n), 3) AS low, round(m / (s + 1e-10) + 1.96::DOUBLE * s / sqrt(n), 3) AS high FROM fs""")
def forest_strata(spark, d):
    return diagnostics.forest(_strata(spark, d), "strategy", ["bm25", "coverage"], ["h2l-bm25"], "stratum", "case_id", "ndcg")


@query(f"WITH {_EVAL}, a AS (SELECT strategy, avg(ndcg) AS m FROM mm GROUP BY 1), b AS (SELECT (case_id % 3)::VARCHAR AS s, avg(ndcg) AS m FROM mm GROUP BY 1) SELECT strategy AS one, s AS two, round(a.m, 4) AS effect_one, round(b.m, 4) AS effect_two, round((a.m + b.m) / 2, 4) AS combined FROM a, b")
def interaction_grid(spark, d):
    v = _strata(spark, d)
    return diagnostics.interaction(v.select(F.col("strategy").alias("arm"), "ndcg"), v.select(F.col("stratum").cast("string").alias("arm"), "ndcg"), "arm", "ndcg")


@query(f"""WITH {_LONG}, sl AS (SELECT *, unnest(list_filter([CASE WHEN case_id % 2 = 0 THEN 'even' END, CASE WHEN stratum = 0 THEN 'first' END, CASE WHEN case_id % 5 > 2 THEN 'late' END], lambda x: x IS NOT NULL)) AS slice FROM lg WHERE metric <> 'ap'),
sm AS (SELECT slice, strategy, metric, avg(value) AS m, count(*) AS n FROM sl GROUP BY ALL) SELECT f.slice, v.strategy AS variant, f.metric, round(f.m, 4) AS full_mean, round(v.m, 4) AS variant_mean, round(f.m - v.m, 4) AS delta, f.n AS n_cases FROM sm f JOIN sm v ON f.slice = v.slice AND f.metric = v.metric AND f.strategy = 'h2l-bm25' AND v.strategy <> 'h2l-bm25'""")
def slice_analysis(spark, d):
    masks = {"even": F.col("case_id") % 2 == 0, "first": F.col("stratum") == 0, "late": F.col("case_id") % 5 > 2}
    return diagnostics.slices(_strata(spark, d), masks, "strategy", "h2l-bm25", ["rr", "ndcg"])


@query(f"""WITH {_EVAL}, rp AS (SELECT strategy, case_id, 0 AS r, doc_id, rank FROM ru UNION ALL SELECT strategy, case_id, 1, doc_id, rank FROM ru WHERE case_id % 7 > 0 OR rank > 1), l AS (SELECT strategy, case_id, r, list(doc_id ORDER BY rank) AS items FROM rp GROUP BY ALL),
c AS (SELECT strategy, case_id, min(items) = max(items) AS same FROM l GROUP BY ALL) SELECT strategy, count(*) AS cases, count(*) FILTER (same) AS stable_cases, round(avg(same::INT), 6) AS stable_rate FROM c GROUP BY 1""")
def ranking_stability(spark, d):
    r = _runs(spark, d)
    both = r.withColumn("repeat", F.lit(0)).unionByName(r.where("case_id % 7 > 0 OR rank > 1").withColumn("repeat", F.lit(1)))
    return diagnostics.ranking_stability(both, ["strategy"], "case_id", "repeat", "doc_id")


@query(f"WITH {_LONG}, cm AS (SELECT metric, case_id, count(*) AS k, avg(value) AS v FROM lg GROUP BY ALL) SELECT metric, sum(k)::BIGINT AS n_rows, count(*) AS n_cases, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std FROM cm GROUP BY 1")
def case_means(spark, d):
    return diagnostics.case_means(_evaluated(spark, d), "case_id", ["ap", "rr", "ndcg"])


# --- rated systems, from orders ---

_RATED = "rt AS (SELECT o_custkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS system, CASE WHEN o_orderkey % 4 = 3 THEN ' ' ELSE 'e' || (o_orderkey % 3) END AS rater, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE (o_orderkey % 5 + 1)::VARCHAR END AS relevance, (o_orderkey * 7 % 13)::VARCHAR AS usefulness FROM orders)"


def _rated(spark, d):
    k = F.col("o_orderkey")
    score = F.when(k % 11 == 0, "none").otherwise((k % 5 + 1).cast("string"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.when(k % 2 == 0, "A").otherwise("B").alias("system"), F.when(k % 4 == 3, " ").otherwise(F.concat(F.lit("e"), (k % 3).cast("string"))).alias("rater"), score.alias("relevance"), (k * 7 % 13).cast("string").alias("usefulness"))


@query(f"WITH {_RATED}, l AS (SELECT system, unnest(['relevance', 'usefulness']) AS dimension, try_cast(unnest([relevance, usefulness]) AS INT) AS v FROM rt WHERE trim(rater) <> '') SELECT system, dimension, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std FROM l WHERE v IS NOT NULL GROUP BY ALL")
def review_scores(spark, d):
    return diagnostics.review_scores(_rated(spark, d), "system", "rater", ["relevance", "usefulness"])


@query(f"""WITH {_RATED}, l AS (SELECT system, case_id, unnest(['relevance', 'usefulness']) AS metric, try_cast(unnest([relevance, usefulness]) AS DOUBLE) AS v FROM rt), m AS (SELECT metric, system, case_id, avg(v) AS v FROM l WHERE v IS NOT NULL GROUP BY ALL),
j AS (SELECT metric, a.v AS a, b.v AS b, round(a.v - b.v, 9) AS d FROM m a JOIN m b USING (metric, case_id) WHERE a.system = 'A' AND b.system = 'B'), g AS (SELECT metric, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(d) AS d FROM j GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0::DOUBLE AS r FROM j WHERE d <> 0), w AS (SELECT metric, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY 1)
SELECT metric, n AS n_cases, round(a, 4) AS mean_one, round(b, 4) AS mean_two, round(d, 4) AS delta, round(w, 2) AS statistic, round(w / sqrt(n * (n + 1) / 2), 4) AS effect_r FROM g LEFT JOIN w USING (metric)""")
def system_comparison(spark, d):
    numbers = _rated(spark, d).select("case_id", "system", *[F.col(c).try_cast("double").alias(c) for c in ("relevance", "usefulness")])
    return diagnostics.system_comparison(numbers, "system", "case_id", "A", "B", ["relevance", "usefulness"])


_GROUPS = "SELECT lang = 'en' AS first, doc_id AS k, n_chars::DOUBLE AS v FROM documents WHERE lang IN ('en', 'de') AND n_chars IS NOT NULL"


@query(f"""WITH s AS ({_GROUPS}), c AS (SELECT avg(v) AS c FROM s WHERE first), x AS (SELECT first, v - c AS v, range AS b, (('0x' || substr(md5(k::VARCHAR || ':' || range || ':42'), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u FROM s, c, range(100)), w AS (SELECT first, v, b, {_POISSON} AS w FROM x),
g AS (SELECT b, first, sum(w) AS n, sum(w * v) / sum(w) AS m, sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w) AS q FROM w WHERE w > 0 GROUP BY ALL), e AS (SELECT (x.m - y.m) / sqrt((x.q + y.q) / (x.n + y.n - 2)) AS d FROM g x JOIN g y USING (b) WHERE x.first AND NOT y.first) SELECT round(quantile_cont(d, 0.025), 5) AS low, round(quantile_cont(d, 0.975), 5) AS high FROM e""")
def effect_interval(spark, d):
    return diagnostics.effect_interval(table(spark, d, "documents"), "lang", "doc_id", "n_chars", "en", "de", n=100)


# --- evidence in texts ---

_MARKS, _CLAUSES = [".", "!", "?", "\n"], [",", ";", " and "]


def _sql_scan(marks: list[str]) -> str:
    """The scan by splitting: places of a mark don't overlap, and one across the position counts on neither side."""
    last = "string_split(head, {m})[-1]"
    rest = f"string_split({last} || tail, {{m}})"
    ahead = f"CASE WHEN length({rest}[1]) >= length({last}) THEN CASE WHEN len({rest}) > 1 THEN p - length({last}) + length({rest}[1]) END WHEN len({rest}) > 2 THEN p - length({last}) + length({rest}[1]) + {{n}} + length({rest}[2]) END"
    left = ", ".join(f"CASE WHEN contains(head, {_quoted(m)}) THEN p - length({last.format(m=_quoted(m))}) ELSE 0 END" for m in marks)
    right = ", ".join(f"coalesce({ahead.format(m=_quoted(m), n=len(m))}, length(text))" for m in marks)
    return f"greatest(0, {left})::INT AS l, least(length(text), {right})::INT AS r"


def _quoted(mark: str) -> str:
    return "chr(10)" if mark == "\n" else f"'{mark}'"


_AT = f"{_FOUND}, pp AS (SELECT case_id, code, text, strpos(text, matched[1]) - 1 AS p FROM fd), hd AS (SELECT *, substring(text, 1, p) AS head, substring(text, p + 1) AS tail FROM pp)"


def _matches(spark, d):
    return detection.keyword_matches(X.cases(table(spark, d, "documents")), X.taxonomy(spark))


def _ranked_hits(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), 15).withColumnRenamed("query_id", "case_id")


def _first(spark, d):
    return _matches(spark, d).withColumn("start", F.instr("text", F.col("matched")[0]) - 1)


@query(f"WITH {_AT} SELECT case_id, code, {_sql_scan(_MARKS + _CLAUSES)} FROM hd".replace("AS l,", 'AS "left",').replace("AS r FROM", 'AS "right" FROM'))
def boundary_scan(spark, d):
    b = evidence.scan(F.col("text"), F.col("start"), _MARKS + _CLAUSES)
    return _first(spark, d).select("case_id", "code", b.alias("b")).select("case_id", "code", "b.left", "b.right")


@query(f"WITH {_AT}, u AS (SELECT case_id, code, text, 'clause' AS scope, {_sql_scan(_MARKS + _CLAUSES)} FROM hd UNION ALL SELECT case_id, code, text, 'sentence', {_sql_scan(_MARKS)} FROM hd) SELECT case_id, code, scope, l AS \"start\", r AS \"end\", md5(regexp_replace(substring(text, l + 1, r - l), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM u")
def evidence_records(spark, d):
    r = evidence.records(F.col("text"), F.array("start"), _MARKS, _CLAUSES)
    return _first(spark, d).select("case_id", "code", F.explode(r).alias("r")).select("case_id", "code", "r.scope", "r.start", "r.end", F.md5("r.text").alias("text_md5"))


_SPAN = "array<struct<keyword:string,start:int,end:int>>"


@query(f"WITH {_FOUND}, sp AS (SELECT case_id, code, list_transform(matched, lambda k: {{'k': k, 's': strpos(text, k) - 1, 'e': strpos(text, k) - 1 + length(k)}}) AS g FROM fd), ft AS (SELECT case_id, code, CASE WHEN case_id % 3 = 0 THEN [] ELSE list_filter(g, lambda s: s.s > 0) END AS f FROM sp) SELECT case_id, code, CASE WHEN len(f) = 0 THEN 'own:0:1' ELSE array_to_string(list_transform(list_sort(list_transform(f, lambda s: {{'o': s.s, 'p': s.s - s.e, 'k': s.k, 'e': s.e}})), lambda s: s.k || ':' || s.o || ':' || s.e), ',') END AS spans FROM ft")
def coerced_spans(spark, d):
    place = lambda k: F.instr(F.col("text"), k) - 1
    given = F.transform("matched", lambda k: F.struct(k.alias("keyword"), place(k).alias("start"), (place(k) + F.length(k)).alias("end")))
    own = F.array(F.struct(F.lit("own").alias("keyword"), F.lit(0).alias("start"), F.lit(1).alias("end")))
    c = evidence.coerced(F.when(F.col("case_id") % 3 > 0, given), own)
    return _matches(spark, d).select("case_id", "code", F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["keyword"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


_PAST = "(?:[0-9]+ (?:days|years) ago|released|formerly|previously| war )"


@query(f"WITH {_AT} SELECT case_id, code, regexp_matches(substring(text, greatest(0, p - 120)::BIGINT + 1, (p + 3 + 120 - greatest(0, p - 120))::BIGINT), '{_PAST}') AS historic FROM hd")
def historic_context(spark, d):
    span = F.array(F.struct(F.col("start"), (F.col("start") + 3).alias("end")))
    return _first(spark, d).select("case_id", "code", evidence.historic(F.col("text"), span, _PAST).alias("historic"))


_SIGNALS = {"core": ["worthless", "password", "which", "that the"], "impact": ["clown", "token"], "stressor": ["licensed", " der "], "severity": ["trash", " que "], "mild": [" the ", "license"]}


def _any(kind: str) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in _SIGNALS[kind]) + ")"


@query(f"WITH {_FOUND}, h AS (SELECT case_id, code, {', '.join(f'{_any(k)} AS {k}' for k in _SIGNALS)} FROM fd) SELECT case_id, code, core AND (impact OR (stressor AND severity)) AS valid, CASE WHEN NOT core OR (mild AND NOT impact AND NOT severity) THEN 0.25 WHEN impact THEN 1.0 WHEN stressor AND severity THEN 0.85 ELSE 0.35 END::DOUBLE AS mult FROM h")
def distress_signals(spark, d):
    v = evidence.distress(F.array("text"), F.col("matched"), _SIGNALS)
    return _matches(spark, d).select("case_id", "code", v.alias("v")).select("case_id", "code", "v.valid", "v.mult")


# --- what a reader is shown ---

_ASKED = f"{_bench(_FOUND)}, {_BM25}, ch AS (SELECT query_id AS case_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits) WHERE rank <= 15)"
_EVIDENCE = """ed AS (SELECT ch.case_id, ch.doc_id, code, name, list_filter(matched, lambda k: k <> '' AND contains(lower(coalesce(dd.text, '')), lower(k))) AS k, list_filter(string_split(name, ' '), lambda w: length(w) > 2 AND contains(lower(coalesce(dd.text, '')), lower(w))) AS n FROM ch JOIN documents dd ON dd.doc_id = ch.doc_id JOIN fd ON fd.case_id = ch.case_id), ee AS (SELECT * FROM ed WHERE len(k) > 0 OR len(n) > 0)"""


@query(f"WITH {_ASKED}, {_EVIDENCE} SELECT case_id, doc_id, code, name, array_to_string(k[1:8], ',') AS keywords, array_to_string(n[1:6], ',') AS name_terms FROM ee")
def matched_evidence(spark, d):
    e = evidence.matched_evidence(_case_hits(spark, d), _bench_found(spark, d), table(spark, d, "documents"))
    return e.withColumn("keywords", F.array_join("keywords", ",")).withColumn("name_terms", F.array_join("name_terms", ","))


@query(f"WITH {_ASKED}, {_EVIDENCE}, cs AS (SELECT case_id, doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM ee GROUP BY ALL) SELECT ch.case_id, ch.rank, ch.doc_id, coalesce(nullif(source, ''), 'doc-' || ch.doc_id) AS source, md5(substring(coalesce(text, ''), 1, 520)) AS snippet, md5(substring(coalesce(text, ''), 1, 1500)) AS content, score, coalesce(codes, '') AS codes FROM ch JOIN documents ON documents.doc_id = ch.doc_id LEFT JOIN cs ON cs.case_id = ch.case_id AND cs.doc_id = ch.doc_id")
def shown_documents(spark, d):
    s = evidence.shown(_ranked_hits(spark, d), _bench_found(spark, d), table(spark, d, "documents"), ["source"])
    return s.withColumn("snippet", F.md5("snippet")).withColumn("content", F.md5("content")).withColumn("codes", F.array_join("codes", ","))


@query(f"WITH {_ways_scored_sql(_ONE)}, pt AS (SELECT case_id, severity, list_distinct(list_concat(list_concat(keywords, matched), [name])) AS terms FROM fd), hq AS (SELECT case_id, doc_id, base FROM sd), j AS (SELECT hq.case_id, hq.doc_id, hq.base, coalesce(severity, 0) AS sv, coalesce(len(list_filter(terms, lambda k: contains(lower(coalesce(text, '')), lower(k)))), 0) AS n FROM hq JOIN documents ON documents.doc_id = hq.doc_id LEFT JOIN pt ON pt.case_id = hq.case_id), g AS (SELECT case_id, doc_id, any_value(base) AS s, coalesce(sum((n > 0)::INT * sv)::DOUBLE / nullif(sum(sv), 0), 0) AS hard FROM j GROUP BY ALL) SELECT g.case_id, g.doc_id, round(s * (1 + 0.2::DOUBLE * hard), 6) AS plain, final, round(final - round(s * (1 + 0.2::DOUBLE * hard), 6), 4) AS difference FROM g JOIN sd ON sd.case_id = g.case_id AND sd.doc_id = g.doc_id")
def score_versions(spark, d):
    return evidence.score_versions(_case_hits(spark, d), _bench_gated(spark, d), table(spark, d, "documents"))


@query(f"WITH {_ASKED}, tr AS (SELECT s.case_id, s.doc_id, ch.rank, base, final FROM (WITH {_ways_scored_sql(_ONE)} SELECT case_id, doc_id, base, final FROM sd) s JOIN ch ON ch.case_id = s.case_id AND ch.doc_id = s.doc_id) SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY final DESC, rank) AS place FROM tr")
def score_trace(spark, d):
    return evidence.score_trace(_ranked_hits(spark, d), _bench_gated(spark, d), table(spark, d, "documents"))


@query(f"""WITH {_ASKED}, pt AS (SELECT case_id, code, confidence, list_concat(list_transform(list_filter(matched, lambda x: length(x) >= 2), lambda x: lower(x)), list_transform(list_filter(string_split(name, ' '), lambda x: length(x) >= 3), lambda x: lower(x))) AS terms FROM fd),
h AS (SELECT ch.case_id, ch.rank, lower(dd.text) AS t FROM ch JOIN documents dd ON dd.doc_id = ch.doc_id WHERE dd.text <> ''), s AS (SELECT pt.case_id, code, any_value(confidence) AS c, sum(len(list_filter(terms, lambda k: contains(t, k)))::DOUBLE / len(terms) / rank) AS a, sum(1.0::DOUBLE / rank) AS b FROM pt LEFT JOIN h ON h.case_id = pt.case_id GROUP BY ALL),
e AS (SELECT case_id, count(*) AS problems, round(avg(c), 6) AS detection, round(avg(coalesce(least(1.0, a / b), 0.0)), 6) AS evidence, round(avg(c) * 0.8 + avg(coalesce(least(1.0, a / b), 0.0)) * 0.2, 6) AS confidence FROM s GROUP BY 1), k AS (SELECT case_id, avg(score) AS a, list(score ORDER BY score DESC)[1:3] AS t FROM ch GROUP BY 1)
SELECT e.*, round(coalesce(a, 0), 6) AS mean_score, round(coalesce(list_sum(t) / len(t), 0), 6) AS top_score FROM e LEFT JOIN k ON k.case_id = e.case_id""")
def case_results(spark, d):
    return evidence.case_result(_bench_found(spark, d), _ranked_hits(spark, d), table(spark, d, "documents"))


# --- pairs of groups with exact p of few cases ---

_DP = "dp AS (SELECT 0 AS k, [1.0::DOUBLE] AS c UNION ALL SELECT k + 1, list_transform(range(0, (k + 1) * (k + 2) // 2 + 1), lambda s: coalesce(c[s + 1], 0) + CASE WHEN s >= k + 1 THEN c[s - k] ELSE 0 END) FROM dp WHERE k < 50)"


@query(f"""WITH RECURSIVE {_DP}, {_EVAL}, vl AS (SELECT strategy AS g, case_id AS c, ndcg AS v FROM mm WHERE case_id % 4 < 2 OR strategy <> 'coverage'), pd AS (SELECT a.g AS one, b.g AS two, round(a.v - b.v, 12) AS d FROM vl a JOIN vl b ON a.c = b.c AND a.g < b.g),
ev AS (SELECT one, two, count(*) AS n_pairs, count(*) FILTER (abs(d) > 1e-15) AS n_nonzero, max(abs(d)) AS most, avg(d) AS m, stddev_pop(d) AS s, median(d) AS md FROM pd GROUP BY ALL HAVING count(*) >= 3),
rk AS (SELECT *, rank() OVER (PARTITION BY one, two ORDER BY abs(d)) + (count(*) OVER (PARTITION BY one, two, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY one, two, abs(d)) AS ties FROM pd WHERE d <> 0),
sw AS (SELECT one, two, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, max(ties) AS ties FROM rk GROUP BY ALL),
j AS (SELECT ev.*, w, n_nonzero = n_pairs AND ties = 1 AND n_nonzero <= 50 AS exact, CASE WHEN most <= 1e-8 THEN 1.0 WHEN n_nonzero = n_pairs AND ties = 1 AND n_nonzero <= 50 THEN least(1.0, 2 * list_sum(c[1:floor(w)::INT + 1]) / pow(2, n_nonzero)) END AS p FROM ev LEFT JOIN sw ON sw.one = ev.one AND sw.two = ev.two LEFT JOIN dp ON k = n_nonzero)
SELECT one, two, CASE WHEN most <= 1e-8 THEN 'No difference' WHEN exact THEN 'Wilcoxon, exact' ELSE 'Wilcoxon' END AS test, n_pairs, n_nonzero, CASE WHEN most <= 1e-8 THEN 0 ELSE w END::DOUBLE AS statistic, round(p, 6) AS exact_p, round(m / (s + 1e-10), 6) AS d,
CASE WHEN abs(m / (s + 1e-10)) >= 0.8 THEN 'large' WHEN abs(m / (s + 1e-10)) >= 0.5 THEN 'medium' WHEN abs(m / (s + 1e-10)) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect, round(m, 6) AS mean_diff, round(md, 6) AS median_diff, round(m - 1.96::DOUBLE * s / sqrt(n_pairs), 6) AS low, round(m + 1.96::DOUBLE * s / sqrt(n_pairs), 6) AS high FROM j""")
def paired_groups(spark, d):
    values = _evaluated(spark, d).where("case_id % 4 < 2 OR strategy <> 'coverage'")
    out = comparisons.paired_groups(values, "strategy", "case_id", "ndcg")
    return out.withColumn("exact_p", F.when(F.col("test") != "Wilcoxon", F.col("p"))).drop("p", "p_holm")  # the normal form's p has no SQL
