"""Queries of chunking, context rules, gates, verdicts, agreement, resampling and experiments, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import windows as W
from casewright.operators import agreement, chunking, detection, experiments, gates, resampling, retrieval, rules, service
from casewright.streaming import live
from casewright.tables import table

from . import fixtures as X
from .queries import _BM25, _FOUND, _GATE_TAIL, _asked, _found, _top, query

# --- chunks, windows, evidence ---


@query("""WITH RECURSIVE cl AS (SELECT doc_id, coalesce(source, 'unknown') AS source, regexp_replace(regexp_replace(coalesce(text, ''), '\\n\\s*\\n', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents),
pa AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, E'\\n\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM cl),
pp AS (SELECT doc_id, source, unnest(ps) AS p, generate_subscripts(ps, 1) AS pn FROM pa),
cut AS (SELECT doc_id, source, pn, 0 AS k, p AS rest, length(regexp_extract(substr(p, 1, 2000), '(?s)^(.*) ', 1)) AS sp FROM pp
UNION ALL SELECT doc_id, source, pn, k + 1, r, length(regexp_extract(substr(r, 1, 2000), '(?s)^(.*) ', 1)) FROM (SELECT doc_id, source, pn, k, substr(rest, (CASE WHEN sp > 300 THEN sp ELSE 2000 END) - 300 + 1) AS r FROM cut WHERE length(rest) > 2000)),
ch AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY pn, k) - 1 AS chunk_index, CASE WHEN length(rest) <= 2000 THEN rest WHEN sp > 300 THEN substr(rest, 1, sp) ELSE substr(rest, 1, 2000) END AS content FROM cut)
SELECT doc_id, chunk_index::INT AS chunk_index, 'chunk_' || substr(md5(source || ':' || substr(content, 1, 100) || ':' || chunk_index), 1, 12) AS chunk_id, md5(content) AS content_md5, length(content)::INT AS char_count FROM ch WHERE length(content) BETWEEN 100 AND 2000""")
def chunks(spark, d):
    return chunking.chunks(table(spark, d, "documents")).withColumn("content_md5", F.md5("content")).drop("content")


_WINDOWS = """list_transform(range(1, len(string_split(text, {k}))), lambda i: list_sum(list_transform(string_split(text, {k})[1:i], lambda p: length(p))) + (i - 1) * length({k}))"""
_WINDOW = r"""regexp_replace(substring(text, greatest(s - 28, 0)::BIGINT + 1, least(s, 28)::BIGINT), '(?s)^.*[.!?;\n。！？；]', '') || {k} || regexp_replace(substring(text, s::BIGINT + length({k}) + 1, 28), '(?s)[.!?;\n。！？；].*$', '')"""
_WIN = f"""{_FOUND}, kw AS (SELECT case_id, code, text, severity, confidence, lower(unnest(matched)) AS k FROM fd), st AS (SELECT *, unnest({_WINDOWS.format(k="k")}) AS s FROM kw),
wn AS (SELECT case_id, code, k, s, {_WINDOW.format(k="k")} AS w FROM st)"""


@query(f"WITH {_WIN} SELECT case_id, code, k AS keyword, count(*) AS n, md5(string_agg(w, '|' ORDER BY s)) AS windows_md5 FROM wn GROUP BY ALL")
def keyword_windows(spark, d):
    m = detection.keyword_matches(X.cases(table(spark, d, "documents")), X.taxonomy(spark)).select("case_id", "code", "text", F.explode("matched").alias("keyword"))
    m = m.withColumn("keyword", F.lower("keyword")).withColumn("w", W.keyword_windows(F.col("text"), F.col("keyword")))
    return m.select("case_id", "code", "keyword", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", "|")).alias("windows_md5"))


@query(rf"""WITH {_FOUND}, se AS (SELECT case_id, code, matched, list_filter(list_transform(string_split_regex(text, '[.!?;\n。！？；]'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM fd),
ev AS (SELECT case_id, code, list_filter(ss, lambda x: len(list_filter(matched, lambda k: contains(x, k))) > 0) AS ev FROM se) SELECT case_id, code, len(list_distinct(ev)) AS n, CASE WHEN len(ev) > 0 THEN md5(ev[1]) END AS first_md5 FROM ev""")
def evidence_sentences(spark, d):
    m = detection.keyword_matches(X.cases(table(spark, d, "documents")), X.taxonomy(spark)).withColumn("ev", W.evidence(F.col("text"), F.col("matched")))
    return m.select("case_id", "code", F.size("ev").cast("bigint").alias("n"), F.md5(F.get("ev", F.lit(0))).alias("first_md5"))


# --- context rules and verdicts ---

_RULES = f"""{_WIN}, ru AS {X.RULES_SQL}, ws AS (SELECT case_id, code, list(w) AS ws FROM wn GROUP BY ALL),
px AS (SELECT fd.*, ws.ws, CASE WHEN regexp_matches(code, '^[FZ]') THEN code[1:1] WHEN regexp_matches(code, '^[XTCIG]') THEN code ELSE code[1:2] END AS px FROM fd JOIN ws USING (case_id, code)),
hr AS (SELECT px.case_id, px.code, ru.valid, ru.mult, ru.reason, row_number() OVER (PARTITION BY px.case_id, px.code ORDER BY ru.priority) AS n FROM px JOIN ru ON ru.prefix = px.code OR ru.prefix = px.px
WHERE len(ru.has) = 0 OR len(list_filter(CASE WHEN ru.scope = 'text' THEN [px.text] ELSE px.ws END, lambda t: len(list_filter(ru.has, lambda h: contains(t, h))) > 0 AND (len(ru.also) = 0 OR len(list_filter(ru.also, lambda h: contains(t, h))) > 0))) > 0),
cv AS (SELECT px.case_id, px.code, px.severity, px.confidence AS base, coalesce(hr.valid, true) AS valid, coalesce(hr.mult, 1.0)::DOUBLE AS mult, hr.reason FROM px LEFT JOIN hr ON px.case_id = hr.case_id AND px.code = hr.code AND hr.n = 1)"""


def _ruled(spark, d):
    m = detection.keyword_matches(X.cases(table(spark, d, "documents")), X.taxonomy(spark))
    return rules.context_validity(m, X.rules(spark))


@query(f"WITH {_RULES} SELECT case_id, code, valid, mult, reason FROM cv")
def context_validity(spark, d):
    return _ruled(spark, d).select("case_id", "code", "valid", "mult", "reason")


_VERDICTS = f"""{_RULES}, jd AS (SELECT cv.*, case_id % 3 = 0 AND case_id % 2 = 0 AS said, case_id % 5 > 0 AS ok FROM cv),
mg AS (SELECT case_id, code, CASE WHEN NOT said THEN valid WHEN ok THEN true ELSE severity >= 4 AND valid AND base >= 0.5 END AS keep,
CASE WHEN NOT said THEN base WHEN ok AND valid THEN least(0.95, base * 1.2) WHEN ok THEN least(0.4, base) ELSE greatest(0.4, base * 0.6) END AS c, CASE WHEN said THEN 'L1-Validated' ELSE 'L1' END AS level FROM jd)"""


@query(f"WITH {_VERDICTS} SELECT case_id, code, round(c, 4) AS confidence, level FROM mg WHERE keep")
def merged_verdicts(spark, d):
    """A made validator: it answers for even cases, and calls every fifth case invalid; a third of the cases is asked."""
    base = _found(spark, d).select("case_id", "code", "severity", "confidence")
    c = base.join(_ruled(spark, d).select("case_id", "code", "valid"), ["case_id", "code"]).withColumn("asked", F.col("case_id") % 3 == 0)
    v = base.where("case_id % 2 = 0").select("case_id", "code", (F.col("case_id") % 5 > 0).alias("is_valid"))
    return rules.merged_verdicts(c, v)


@query(f"""WITH {_FOUND}, it AS (SELECT item_id AS case_id, code, text FROM benchmark, (VALUES ('0801'), ('F32'), ('none')) v(code)), tx2 AS {X.TAXONOMY_SQL}
SELECT it.case_id, it.code, 3 AS severity, 0.75::DOUBLE AS confidence, 'L2' AS level FROM it JOIN tx2 ON it.code = tx2.code JOIN documents dd ON dd.doc_id = it.case_id LEFT JOIN fd ON fd.case_id = it.case_id AND fd.code = it.code
WHERE fd.code IS NULL AND len(list_filter(tx2.keywords, lambda k: contains(lower(coalesce(it.text, '')) || E'\\n' || lower(coalesce(dd.text, '')), lower(k)))) > 0""")
def admitted_codes(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.explode(F.array(F.lit("0801"), F.lit("F32"), F.lit("none"))).alias("code"), F.col("text").alias("evidence"), F.lit(None).cast("int").alias("severity"), F.lit(None).cast("double").alias("confidence"))
    return rules.admitted(items, _found(spark, d), X.cases(table(spark, d, "documents")), X.taxonomy(spark))


# --- agreement and rank tests ---


@query("""WITH c AS (SELECT user_id AS s, event_type AS c, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY s) AS m FROM c), k AS (SELECT * FROM m WHERE m > 1),
p AS (SELECT s, (sum(n * n) - max(m))::DOUBLE / (max(m) * (max(m) - 1)) AS p FROM k GROUP BY s), e AS (SELECT sum(n::DOUBLE * n) / (sum(n::DOUBLE) * sum(n)) AS e FROM (SELECT c, sum(n) AS n FROM k GROUP BY c))
SELECT (SELECT count(*) FROM p) AS subjects, round(((SELECT avg(p) FROM p) - e) / (1 - e), 6) AS kappa FROM e""")
def fleiss_kappa(spark, d):
    return agreement.fleiss_kappa(table(spark, d, "events"), "user_id", "event_type")


def _raters(spark, d):
    return table(spark, d, "labels").select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array("quality", "toxic"))).alias("rater", "score"))


_PAIR = "r AS (SELECT doc_id AS s, quality::DOUBLE AS a, toxic::DOUBLE AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@query(f"""WITH {_PAIR}, g AS (SELECT count(*) AS n, avg((a + b) / 2) AS g, avg(a) AS ma, avg(b) AS mb FROM r), q AS (SELECT n, 2 * sum(((a + b) / 2 - g) ** 2) / (n - 1) AS msr, n * ((max(ma) - max(g)) ** 2 + (max(mb) - max(g)) ** 2) AS msc,
sum((a - g) ** 2 + (b - g) ** 2) AS sst FROM r, g GROUP BY n), z AS (SELECT *, (sst - msr * (n - 1) - msc) / (n - 1) AS mse FROM q) SELECT n AS subjects, 2::BIGINT AS raters, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc FROM z""")
def icc21(spark, d):
    return agreement.icc21(_raters(spark, d), "doc_id", "rater", "score")


@query("""WITH u AS (SELECT user_id AS s, event_type AS r, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL), k AS (SELECT count(DISTINCT r) AS k FROM u), f AS (SELECT u.* FROM u JOIN (SELECT s FROM u GROUP BY s HAVING count(*) = (SELECT k FROM k)) USING (s)),
t AS (SELECT r AS tr, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY s, v) AS ties FROM f),
a AS (SELECT tr, sum(rk) AS total, count(*) AS n, sum(ties * ties - 1) AS t FROM t GROUP BY tr), b AS (SELECT max(n) AS n, count(*) AS k, sum(total * total) AS q, sum(t) AS t FROM a)
SELECT n AS subjects, k AS treatments, round((12 * q / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))), 5) AS chi2 FROM b""")
def friedman(spark, d):
    return agreement.friedman(table(spark, d, "events"), "user_id", "event_type", "value")


_ALPHA = """WITH v AS (SELECT o_custkey AS u, o_orderpriority AS x FROM orders WHERE o_orderpriority IS NOT NULL), s AS (SELECT x, row_number() OVER (ORDER BY x)::DOUBLE AS p FROM (SELECT DISTINCT x FROM v)),
c AS (SELECT u, x, p, count(*) AS n FROM v JOIN s USING (x) GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY u) AS m FROM c), k AS (SELECT * FROM m WHERE m > 1),
o AS (SELECT sum(a.n * b.n * {0} / (a.m - 1)) AS o FROM k a JOIN k b ON a.u = b.u), f AS (SELECT x, p, sum(n) AS n FROM k GROUP BY ALL), e AS (SELECT sum(a.n * b.n * {0}) AS e FROM f a, f b), t AS (SELECT sum(n) AS t FROM k)
SELECT t::BIGINT AS ratings, round(1 - o * (t - 1) / e, 6) AS alpha FROM o, e, t"""


@query(_ALPHA.format("(a.p - b.p) ** 2"))
def krippendorff_ordinal(spark, d):
    return agreement.krippendorff(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query(_ALPHA.format("(a.p <> b.p)::INT"))
def krippendorff_nominal(spark, d):
    return agreement.krippendorff(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "nominal")


# --- resampling ---

_POISSON = " + ".join(f"(u > {c!r})::INT" for c in resampling.POISSON)


def _replicates(rows: str) -> str:
    return f"""WITH v AS ({rows}), x AS (SELECT g, v, range AS b, (('0x' || substr(md5(k::VARCHAR || ':' || range || ':42'), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u FROM v, range(100)),
w AS (SELECT g, v, b, {_POISSON} AS w FROM x), r AS (SELECT g, b, sum(w * v) / sum(w) AS m FROM w WHERE w > 0 GROUP BY ALL)"""


@query(f"{_replicates('SELECT lang AS g, doc_id AS k, n_chars::DOUBLE AS v FROM documents WHERE n_chars IS NOT NULL')} SELECT g AS lang, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high FROM r GROUP BY g")
def bootstrap_interval(spark, d):
    return resampling.percentile_interval(table(spark, d, "documents"), ["lang"], "doc_id", "n_chars", n=100)


@query(f"{_replicates('SELECT 1 AS g, doc_id AS k, (quality - toxic)::DOUBLE AS v FROM labels WHERE quality - toxic IS NOT NULL')} SELECT round(count(*) FILTER (m > 0.01) / count(*), 5) AS better, round(count(*) FILTER (abs(m) <= 0.01) / count(*), 5) AS same, round(count(*) FILTER (m < -0.01) / count(*), 5) AS worse FROM r")
def bayes_paired(spark, d):
    return resampling.paired_shares(table(spark, d, "labels").withColumn("d", (F.col("quality") - F.col("toxic")).cast("double")), [], "doc_id", n=100)


def bca_interval(spark, d):
    return resampling.bca_interval(table(spark, d, "documents"), ["lang"], "doc_id", "n_chars", n=200)


# --- experiments ---


@query("""WITH a AS (SELECT o_custkey AS c, o_orderstatus AS arm, avg(o_totalprice) AS v FROM orders GROUP BY ALL), d AS (SELECT x.arm AS one, y.arm AS two, x.v - y.v AS d FROM a x JOIN a y ON x.c = y.c AND x.arm < y.arm)
SELECT one, two, count(*) AS n, count(*) FILTER (d > 1e-12) AS wins_one, count(*) FILTER (d < -1e-12) AS wins_two, count(*) FILTER (abs(d) <= 1e-12) AS ties, round(avg(d), 5) AS mean_delta FROM d GROUP BY ALL""")
def paired_arms(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return experiments.paired_arms(a, "o_orderstatus", ["o_custkey"], "v")


@query("""WITH c AS (SELECT event_type, user_id, count(DISTINCT value > 50) AS a, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2) SELECT event_type, count(*) AS cases, round(avg((a = 1)::INT), 6) AS stable FROM c GROUP BY 1""")
def repeat_stability(spark, d):
    return experiments.stability(table(spark, d, "events").withColumn("answer", F.col("value") > 50), ["event_type"], "user_id", "answer", 2)


# --- gates, relevance, service ---

_GATES = f"{_FOUND}{_GATE_TAIL}"


@query(f"WITH {_GATES} SELECT *, round(gate_neg * gate_len * gate_sub, 4) AS gate_total FROM gt")
def polarity_gates(spark, d):
    m = detection.keyword_matches(X.cases(table(spark, d, "documents")), X.taxonomy(spark))
    return gates.polarity(m, X.MARKERS).select("case_id", "code", "gate_neg", "gate_len", "gate_sub", "gate_total")


@query(f"""WITH {_BM25}, tk AS ({_top('hits', 10)}), tg AS {X.TAXONOMY_SQL}, nn AS (SELECT tk.query_id, tk.doc_id, tg.severity, len(list_filter(tg.keywords, lambda k: contains(lower(coalesce(dd.text, '')), lower(k)))) AS n FROM tk JOIN documents dd ON dd.doc_id = tk.doc_id, tg),
g AS (SELECT query_id, doc_id, sum(CASE WHEN n >= 2 THEN 1 WHEN n = 1 AND severity >= 3 THEN 0.5 ELSE 0 END) AS c, max(CASE WHEN n >= 2 OR (n = 1 AND severity >= 3) THEN severity END) AS s, max(CASE WHEN n >= 2 THEN n END) AS m FROM nn GROUP BY ALL)
SELECT query_id AS case_id, doc_id, CASE WHEN c >= 2 OR (m >= 3 AND s >= 3) THEN 2 WHEN c >= 1 THEN 1 ELSE 0 END AS grade FROM g""")
def graded_relevance(spark, d):
    docs, asked = table(spark, d, "documents"), _asked(spark, d)
    hits = retrieval.bm25(docs, asked, 10).select(F.col("query_id").alias("case_id"), "doc_id")
    expected = asked.select(F.col("query_id").alias("case_id")).join(F.broadcast(X.taxonomy(spark).select("severity", "keywords")))
    return service.graded(hits, docs, expected)


@query(f"""WITH {_FOUND}, dc AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN '0801' ELSE 'F32' END AS code, CASE WHEN doc_id % 3 = 0 THEN 'excluded' WHEN doc_id % 3 = 1 THEN 'accepted' ELSE 'review' END AS decision FROM labels),
u AS (SELECT case_id, code, 'found' AS state FROM fd UNION ALL SELECT case_id, code, decision FROM dc WHERE decision <> 'excluded') SELECT case_id, code, min(state) AS state FROM u ANTI JOIN (SELECT case_id, code FROM dc WHERE decision = 'excluded') x USING (case_id, code) GROUP BY ALL""")
def finalized_codes(spark, d):
    i = F.col("doc_id")
    made = table(spark, d, "labels").select(i.alias("case_id"), F.when(i % 2 == 0, "0801").otherwise("F32").alias("code"), F.when(i % 3 == 0, "excluded").when(i % 3 == 1, "accepted").otherwise("review").alias("decision"))
    return service.finalized(_found(spark, d), made, X.taxonomy(spark))[0]


# --- streaming ---


@query(f"WITH {_FOUND} SELECT case_id, code, confidence FROM fd WHERE confidence >= 0.25")
def stream_detections(spark, d):
    cases = X.cases(live.table_stream(spark, d, "documents"))
    return live.drained(live.detected(cases, X.taxonomy(spark)).select("case_id", "code", "confidence"))
