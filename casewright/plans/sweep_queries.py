"""The sweep of the score's parameters over the codes that documents hold, beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import detection, gates, scoring
from casewright.tables import table

from . import fixtures as X
from .queries import _FOUND, _GATE_TAIL, _IDF, _found, query

_W = scoring.WEIGHTS
_WAYS = ", ".join("(" + ", ".join(X._q(v) for v in r) + ")" for r in scoring.configuration_rows(scoring.SWEEPS))


@query(f"""WITH {_FOUND}{_GATE_TAIL}, cf AS (SELECT * FROM (VALUES {_WAYS}) t(parameter, value, {', '.join(scoring.DEFAULTS)})),
fl AS (SELECT fd.case_id, fd.code, fd.name, fd.keywords, severity, confidence, list_concat(list_distinct(list_concat(keywords, matched)), CASE WHEN name <> '' THEN [name] ELSE [] END) AS terms, text, share, gate_len, gate_sub, count(*) OVER w AS n, sum(severity) OVER w AS total, max(severity) OVER w AS ms FROM fd JOIN gt ON gt.case_id = fd.case_id AND gt.code = fd.code JOIN ng ON ng.case_id = fd.case_id AND ng.code = fd.code WINDOW w AS (PARTITION BY fd.case_id)),
fw AS (SELECT case_id, code, severity, confidence, n, total, ms, share, gate_len, gate_sub, len(list_filter(terms, lambda k: contains(text, lower(k))))::DOUBLE / len(terms) AS word, greatest(0.0, least(1.0, ({_IDF} - 0.5) / 2.5)) AS rare FROM fl),
rw AS (SELECT fw.*, cf.*, greatest(0.01, (severity + mu / n) / (total + mu)) AS raw FROM fw, cf), pw AS (SELECT *, raw / sum(raw) OVER (PARTITION BY case_id, parameter, value) AS p FROM rw),
ph AS (SELECT *, {_W['detect']}::DOUBLE * CASE WHEN confidence <= 0 OR confidence >= 1 THEN least(1.0, greatest(0.0, confidence)) ELSE pow(confidence, 1 / greatest(0.1, t_base + (1 - severity::DOUBLE / ms) * t_range)) END + {_W['semantic']}::DOUBLE * word + {_W['prior']}::DOUBLE * p + {_W['specificity']}::DOUBLE * rare
  + {_W['negation']}::DOUBLE * round(round(greatest(0.1, least(1.0, 1 - neg_lambda * share)), 4) * gate_len * gate_sub, 4) AS phi FROM pw),
cs AS (SELECT parameter, value, case_id, any_value(alpha) AS alpha, any_value(kl_kappa) AS kappa, avg(phi) AS phi, count(*) AS n, avg(confidence) AS mc, sum(p * confidence) AS pc, -sum(p * log2(p)) AS h, sum(p * ln(p)) AS pl FROM ph GROUP BY ALL),
ef AS (SELECT *, greatest(0.01, greatest(0.01, 2 * alpha / (1 + exp(-(0.3 * n + 0.5 * mc - 0.95)))) * (1 + 0.5 * h) * (1 - kappa * CASE WHEN n > 1 THEN least(2.0, greatest(0.0, pl + ln(n))) ELSE 0 END)) AS eff FROM cs),
bo AS (SELECT *, exp(least(3.0, greatest(-3.0, eff * phi))) * (0.5 + 0.5 * least(pc, 1.0)) AS boost FROM ef),
ag AS (SELECT parameter, value, count(*) AS n_scored, avg(boost) AS b, avg(phi) AS f, avg(eff) AS a, avg(boost * 0.5) AS s, stddev_pop(boost * 0.5) AS d FROM bo GROUP BY ALL)
SELECT parameter, value, n_scored, round(b, 6) AS mean_boost, round(f, 6) AS mean_phi, round(a, 6) AS mean_alpha, round(s, 6) AS mean_score, round(d, 6) AS std_score, round((s / (SELECT s FROM ag WHERE parameter = 'default') - 1) * 100, 4) AS change_percent FROM ag""")
def sensitivity_sweep(spark, d):
    gate = gates.polarity(detection.keyword_matches(X.cases(table(spark, d, "documents")), X.taxonomy(spark)), X.MARKERS)
    found = _found(spark, d).join(gate.select("case_id", "code", "text", "denied_share", "gate_len", F.col("gate_sub").cast("double").alias("gate_sub")), ["case_id", "code"])
    return scoring.swept(found)


@query(f"""WITH tx AS {X.TAXONOMY_SQL}, tm AS (SELECT code, list_concat(list_distinct(list_transform(keywords, lambda k: lower(k))), [lower(name)]) AS terms FROM tx), df AS (SELECT tm.code, count(*) FILTER (len(list_filter(terms, lambda k: contains(lower(coalesce(text, '')), k))) > 0) AS df, greatest(count(*), 500) AS n FROM tm, documents GROUP BY 1)
SELECT code, df, round(least(3.0, greatest(0.5, ln(1 + n / (1 + df)))), 6) AS idf, round((least(3.0, greatest(0.5, ln(1 + n / (1 + df)))) - 0.5) / 2.5, 6) AS specificity FROM df""")
def corpus_specificity(spark, d):
    return scoring.corpus_specificity(X.taxonomy(spark), table(spark, d, "documents"))
