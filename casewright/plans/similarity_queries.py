"""Queries of alike texts and of splits repaired by them, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import similarity
from casewright.tables import table

from .queries import query

_ALIKE = r"""lw AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS t FROM documents), rp AS (SELECT t, min(doc_id) AS k FROM lw WHERE t <> '' GROUP BY t), ws AS (SELECT k, string_split(t, ' ') AS w FROM rp),
gr AS (SELECT DISTINCT k, g FROM (SELECT k, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: w[i:i + 4])) AS g FROM ws)), gn AS (SELECT k, count(*) AS n FROM gr GROUP BY k),
sh AS (SELECT a.k AS one, b.k AS two, count(*) AS c FROM gr a JOIN gr b ON a.g = b.g AND a.k < b.k GROUP BY ALL), np AS (SELECT one, two, c / (a.n + b.n - c) AS j FROM sh JOIN gn a ON a.k = one JOIN gn b ON b.k = two WHERE c / (a.n + b.n - c) >= 0.8 - 1e-9)"""
_SETS = "cs AS (SELECT lw.doc_id, doc_id // 3 AS family, CASE WHEN doc_id // 3 % 3 = 0 THEN 'test' ELSE 'train' END AS split, doc_id % 2 = 0 AS made, k FROM lw LEFT JOIN rp ON rp.t = lw.t)"


def _split_cases(spark, d):
    families = F.floor(F.col("doc_id") / 3)
    return table(spark, d, "documents").select("doc_id", families.alias("family"), F.when(families % 3 == 0, "test").otherwise("train").alias("split"), "text")


@query(f"WITH {_ALIKE} SELECT one, two, round(j, 6) AS similarity FROM np")
def near_duplicates(spark, d):
    return similarity.near_duplicates(table(spark, d, "documents"))


@query(f"WITH {_ALIKE} SELECT doc_id AS key, k AS representative FROM lw JOIN rp ON rp.t = lw.t")
def text_copies(spark, d):
    return similarity.copies(table(spark, d, "documents"))


@query(f"""WITH {_ALIKE}, {_SETS}, ln AS (SELECT one AS a, two AS b FROM np UNION ALL SELECT two, one FROM np UNION ALL SELECT k, k FROM rp),
mv AS (SELECT DISTINCT x.family FROM cs x JOIN ln ON ln.a = x.k JOIN cs y ON y.k = ln.b WHERE x.split = 'test' AND x.made AND y.split = 'train' AND y.family <> x.family)
SELECT doc_id, family, CASE WHEN family IN (SELECT family FROM mv) THEN 'train' ELSE split END AS split FROM cs""")
def split_repair(spark, d):
    cases = _split_cases(spark, d)
    members = similarity.copies(cases)
    made = F.col("doc_id") % 2 == 0
    pairs = similarity.near_duplicates(cases, members=members, between=((F.col("split") == "test") & made, F.col("split") == "train"))
    return similarity.repaired(cases, pairs, members, "doc_id", "family", "split", made).drop("text")
