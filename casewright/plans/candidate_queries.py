"""Queries of denied candidates, their gate, told events, and how denials are judged, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import candidates
from casewright.tables import table

from . import fixtures as X
from .queries import _FOUND, _found, query
from .report_queries import _MENTIONS, _mentions

_DENIALS = candidates.Denials(X.MARKERS.negation, [",", ";", "."], [",", ";", "\n", " because "], [(["12"], [], ["que", "der "]), (["zz"], ["0"], ["that the"])])
_LONGEST = max(map(len, _DENIALS.markers))
_SPANS = """pr AS (SELECT case_id, code, category, text, confidence, severity, k, string_split(text, k) AS ps FROM (SELECT fd.*, tx.category, unnest(list_transform(matched, lambda m: lower(trim(m)))) AS k FROM fd JOIN tx USING (code))),
kp AS (SELECT case_id, code, category, text, k, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * length(k))::INT AS s FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM pr WHERE k <> ''))"""
_DENIED = rf"""{_FOUND}, {_SPANS}, wn AS (SELECT *, substr(text, greatest(1, s + 1 - {28 + _LONGEST}), least(s, {28 + _LONGEST})) AS w FROM kp), mk AS (SELECT unnest({X._q(_DENIALS.markers)}) AS m),
nr AS (SELECT *, s - length(w) + p AS ms FROM (SELECT wn.*, m, unnest(range(0, length(w) - length(m) + 1)) AS p FROM wn, mk WHERE length(w) >= length(m)) WHERE substr(w, p + 1, length(m)) = m AND length(w) - p - length(m) <= 28 AND NOT regexp_matches(substr(w, p + length(m) + 1), '[,;\n]| because ')),
dn AS (SELECT DISTINCT case_id, code, k FROM (SELECT *, regexp_extract(substr(text, 1, s), '[^,;.]*$') || regexp_extract(substr(text, s + 1), '^[^,;.]*') AS cl FROM nr WHERE NOT regexp_matches(substr(text, ms + 1, s - ms), '[,;.]')) WHERE NOT (code LIKE '12%' AND (contains(cl, 'que') OR contains(cl, 'der '))) AND NOT (contains(category, '0') AND contains(cl, 'that the'))),
po AS (SELECT fd.case_id, fd.code, severity, confidence, length(text) AS chars, contains(text, 'not ') OR contains(text, 'nicht ') AS told, coalesce(t, '') AS terms, CASE WHEN t IS NULL THEN 1.0 ELSE 0.4 END::DOUBLE AS gate FROM fd LEFT JOIN (SELECT case_id, code, array_to_string(list_sort(list(k)), ',') AS t FROM dn GROUP BY ALL) d ON d.case_id = fd.case_id AND d.code = fd.code)"""


def _polarity(spark, d):
    text = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    items = _found(spark, d).join(text, "case_id").join(F.broadcast(X.taxonomy(spark).select("code", "category")), "code")
    return candidates.polarity(items, _DENIALS)


@query(f"WITH {_DENIED} SELECT case_id, code, gate, terms FROM po")
def candidate_polarity(spark, d):
    return _polarity(spark, d).select("case_id", "code", "gate", F.array_join(F.array_sort("negated_terms"), ",").alias("terms"))


@query(f"WITH {_DENIED} SELECT case_id, code, round(confidence * gate, 4) AS after, CASE WHEN confidence < 0.7 AND gate = 1 THEN confidence ELSE round(confidence * gate, 4) END AS confidence, confidence < 0.7 OR gate < 1 AS filtered FROM po")
def polarity_gate(spark, d):
    out = candidates.gated(_polarity(spark, d).withColumn("filtered", F.col("confidence") < 0.7))
    return out.select("case_id", "code", "after", "confidence", "filtered")


_SHARE = "round(coalesce({} / nullif({}, 0), 0), 4)"


@query(f"""WITH {_DENIED}, cs AS (SELECT case_id, CASE WHEN max(chars) < 400 THEN 'short' ELSE 'long' END AS length, max(severity)::VARCHAR AS severity, bool_or(told) AS e, bool_or(gate < 1) AS p FROM po GROUP BY 1),
g AS (SELECT 'all' AS slice, NULL AS value, e, p FROM cs UNION ALL SELECT 'length', length, e, p FROM cs UNION ALL SELECT 'severity', severity, e, p FROM cs),
c AS (SELECT slice, value, count(*) AS n, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM g GROUP BY ALL)
SELECT *, {_SHARE.format('(tp + tn)', 'n')} AS accuracy, {_SHARE.format('tp', 'tp + fn')} AS ndr, {_SHARE.format('fp', 'fp + tn')} AS fpr, {_SHARE.format('tp', 'tp + fp')} AS "precision", {_SHARE.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c""")
def polarity_report(spark, d):
    chars, told = F.length("text"), F.contains("text", F.lit("not ")) | F.contains("text", F.lit("nicht "))
    cases = _polarity(spark, d).groupBy("case_id").agg(F.when(F.max(chars) < 400, "short").otherwise("long").alias("length"), F.max("severity").cast("string").alias("severity"), F.max(told).alias("expected"), F.max("negated").alias("predicted"))
    return candidates.report(cases, ["length", "severity"])


@query(f"""WITH {_DENIED}, pl AS (SELECT DISTINCT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'F32' ELSE '1205' END AS code FROM documents)
SELECT pl.case_id, pl.code, po.code IS NOT NULL AS detected, gate AS gate_neg, CASE WHEN po.code IS NOT NULL THEN 1.0::DOUBLE END AS gate_sub, gate AS gate_total, coalesce(gate < 1, false) AS gate_neg_holds, false AS gate_sub_holds, coalesce(gate < 1, false) AS gate_total_holds FROM pl LEFT JOIN po ON po.case_id = pl.case_id AND po.code = pl.code""")
def planted_codes(spark, d):
    cases = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 2 == 0, "F32").otherwise("1205").alias("false_trigger_code")).distinct()
    codes = _polarity(spark, d).select("case_id", "code", F.col("gate").alias("gate_neg"), F.lit(1.0).alias("gate_sub"), F.col("gate").alias("gate_total"))
    return candidates.planted(cases, codes)


@query(f"""WITH {_FOUND}, {_SPANS}, {_MENTIONS}, ev AS (SELECT case_id, s AS es, e + 15 AS ee, s AS ps, e AS pe, term AS action, CASE WHEN s % 2 = 0 THEN 'x' ELSE '' END AS target, term || ':' || s AS event_id FROM me),
sn AS (SELECT case_id, code, s, s + length(k) AS e, row_number() OVER (PARTITION BY case_id, code ORDER BY s, length(k) DESC, k) AS n FROM kp), s3 AS (SELECT * FROM sn WHERE n <= 3),
te AS (SELECT DISTINCT case_id, code, k FROM pr), ok AS (SELECT DISTINCT ev.*, te.code FROM ev JOIN te ON te.case_id = ev.case_id AND (contains(te.k, ev.action) OR contains(ev.action, te.k)) WHERE te.code IN ('0102', 'F32', 'X60-X84', '0206')),
sc AS (SELECT ok.case_id, ok.code, event_id, es, action, target, max(greatest(0, 220 - greatest(0, es - e, s - ee)) + CASE WHEN es <= s AND e <= ee THEN 240 WHEN s < ee AND es < e THEN 180 ELSE 0 END + CASE WHEN ps > 0 THEN CASE WHEN greatest(0, ps - e, s - pe) = 0 THEN 320 ELSE greatest(0, 120 - greatest(0, ps - e, s - pe)) END
  ELSE CASE WHEN greatest(0, es - e, s - ee) = 0 THEN 320 ELSE greatest(0, 120 - greatest(0, es - e, s - ee)) END END + CASE WHEN n = 1 THEN 30 ELSE 0 END) AS score FROM ok JOIN s3 ON s3.case_id = ok.case_id AND s3.code = ok.code GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY case_id, code ORDER BY score DESC, es, event_id) AS n FROM sc)
SELECT fd.case_id, fd.code, coalesce(event_id, '') AS event_id, score::INT AS score, CASE WHEN score IS NULL THEN 'unclear' WHEN target = '' THEN 'someone -> ' || action ELSE 'someone -> ' || action || ' -> x' END AS relation FROM fd LEFT JOIN bs ON bs.case_id = fd.case_id AND bs.code = fd.code AND bs.n = 1 AND score >= 200""")
def actor_relations(spark, d):
    text = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    items = _found(spark, d).join(text, "case_id").withColumn("terms", candidates.terms_of(F.col("matched"), F.col("name")))
    items = items.withColumn("matches", F.slice(candidates.match_spans(F.col("text"), F.col("terms")), 1, 3)).withColumn("evidences", F.slice("matches", 1, 1)).drop("text")
    m = _mentions(spark, d)
    events = m.select("case_id", F.concat_ws(":", "term", F.col("start").cast("string")).alias("event_id"), "start", (F.col("end") + 15).alias("end"), F.lit("someone").alias("agent"), F.when(F.col("start") % 2 == 0, "x").otherwise("").alias("target"), F.col("term").alias("action"), F.array("term").alias("actions"), F.array(F.struct("start", "end")).alias("supports"))
    out = candidates.relations(items, events, F.col("code").isin("0102", "F32", "X60-X84", "0206"))
    return out.select("case_id", "code", F.coalesce("event_id", F.lit("")).alias("event_id"), "score", "relation")
