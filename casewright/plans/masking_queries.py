"""Queries of spans in masked texts, and of words that the given tables name, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions.windows import bound
from casewright.operators import candidates, detection, masking, preparation
from casewright.tables import table

from .candidate_queries import _SPANS
from .queries import _FOUND, _found, query


@query(rf"""WITH {_FOUND}, {_SPANS}, sn AS (SELECT case_id, code, text, s, least(s + length(k) + 8, length(text)) AS e FROM kp), mt2 AS (SELECT DISTINCT case_id, text FROM sn), ed0 AS (SELECT case_id, regexp_split_to_array(text, '[0-9][0-9]+') AS gaps, regexp_extract_all(text, '[0-9][0-9]+') AS ms FROM mt2),
ed AS (SELECT case_id, i, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::INT AS st, length(ms[i]) AS n, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + (i - 1) * 3)::INT AS t FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ed0)),
ps AS (SELECT DISTINCT case_id, unnest([s, e]) AS p FROM sn), lk AS (SELECT ps.case_id, p, st, n, t FROM ps ASOF LEFT JOIN ed ON ed.case_id = ps.case_id AND ed.st < ps.p),
mp AS (SELECT case_id, p, CASE WHEN st IS NULL THEN p WHEN p < st + n THEN t ELSE p - st - n + t + 3 END AS a, CASE WHEN st IS NULL THEN p WHEN p < st + n THEN t + 3 ELSE p - st - n + t + 3 END AS b FROM lk)
SELECT sn.case_id, sn.code, count(DISTINCT (x.a, y.b)) AS spans, sum(DISTINCT x.a * 1000003 + y.b)::BIGINT AS places FROM sn JOIN mp x ON x.case_id = sn.case_id AND x.p = sn.s JOIN mp y ON y.case_id = sn.case_id AND y.p = sn.e GROUP BY ALL""")
def masked_spans(spark, d):
    text = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    f = _found(spark, d).join(text, "case_id")
    found = candidates.match_spans(F.col("text"), F.transform("matched", lambda m: F.lower(F.trim(m))))
    longer = bound(F.length("text"), lambda n: F.transform(found, lambda s: F.struct(F.lit("x").alias("keyword"), s["start"].alias("start"), F.least(s["end"] + 8, n).alias("end"))))
    f = f.select("case_id", "code", "text", longer.alias("spans"), masking.masked(F.col("text"), [("[0-9][0-9]+", "[N]")]).alias("m"))
    s = masking.remapped_spans(F.col("spans"), F.col("text"), F.col("m.text"), F.col("m.maps"))
    # a condition on rows would be pushed to the texts, where all of this is worked out once more
    f = f.select("case_id", "code", F.explode(F.filter(F.array(s), lambda s: F.size(s) > 0)).alias("s"))
    return f.select("case_id", "code", F.size("s").cast("bigint").alias("spans"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["start"].cast("bigint") * 1000003 + x["end"]).alias("places"))



_GOODS = "gd AS (SELECT p_brand AS code, list_sort(list_distinct(list(p_name))) AS keywords FROM part WHERE p_name <> '' GROUP BY 1)"


def _goods(spark, d):
    """Brands with the names of their parts: a taxonomy that the given tables hold."""
    return table(spark, d, "part").where("p_name <> ''").groupBy(F.col("p_brand").alias("code")).agg(F.array_sort(F.collect_set("p_name")).alias("keywords"))


@query(f"WITH {_GOODS} SELECT lower(k) AS keyword, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM (SELECT code, unnest(keywords) AS k FROM gd) GROUP BY 1")
def keyword_index(spark, d):
    return detection.keyword_index(_goods(spark, d))


@query(f"WITH {_GOODS}, t AS (SELECT code, keywords[1] AS word, row_number() OVER (ORDER BY code) AS n, lead(code) OVER (ORDER BY code) AS c2, lead(keywords[1]) OVER (ORDER BY code) AS w2 FROM gd WHERE len(keywords) > 0) SELECT 'ADV_' || lpad(n::VARCHAR, 3, '0') AS case_id, word || ' ' || w2 AS case_description, code, c2 AS false_trigger_code, w2 AS trigger_word FROM t WHERE c2 IS NOT NULL AND n <= 20")
def adversarial_cases(spark, d):
    return preparation.adversarial_cases(_goods(spark, d))
