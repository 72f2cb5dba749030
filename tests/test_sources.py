"""Readers, writers, comparisons and case preparation on small inputs."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from casewright.functions import distributions as P
from casewright.operators import comparisons, preparation, profile, reports
from casewright.plans import report_queries
from casewright.plans.registry import ORACLES, QUERIES
from casewright.sources import files, sinks

from test_engine import TABLES, plain

NEW = [n for n in vars(report_queries) if n in QUERIES and QUERIES[n].__module__ == report_queries.__name__]


def put(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    assert sorted(repr(plain(r)) for r in df.select(*cols).collect()) == sorted(repr(plain([r[i] for i in at])) for r in cur.fetchall())


def test_corpus_strips_labels_and_numbers_files_in_order(spark, tmp_path):
    d = tmp_path / "c"
    put(d, "b.json", {"chunks": [{"content": "  later  ", "title": "T"}]})
    put(d, "a.json", [{"text": "one two", "expected_diagnosis": {"x": 1}, "chunk_id": "k"}, {"content": " "}, {"case_description": "three"}])
    rows = files.corpus(spark, str(d)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.content, r.source) for r in rows] == [(0, "one two", "a.json"), (1, "three", "a.json"), (2, "later", "b.json")]
    assert rows[0].chunk_id == "k" and rows[1].chunk_id == "chunk_1" and rows[0].word_count == 2 and rows[2].title == "T"
    assert set(rows[0].asDict()) == {"doc_id", "content", "text", "data_source", *files.SAFE_FIELDS}


def test_merged_chunks_take_lists_and_objects(spark, tmp_path):
    d = tmp_path / "m"
    put(d, "a.json", [{"content": "x", "id": "i1"}, {"content_snippet": "s"}])
    put(d, "b.json", {"key": {"text": "t", "source_document": "report_done.txt"}})
    rows = {r.text: r for r in files.with_source(files.merged_chunks(spark, str(d)), ["_done"]).collect()}
    assert rows["x"].chunk_id == "i1" and rows["t"].chunk_id == "key" and rows["s"].chunk_id.startswith("chunk_")
    assert rows["t"].source == "report" and rows["x"].source == "general" and rows["x"].content_snippet == "x"


def test_cases_refuse_missing_splits_and_hide_labels(spark, tmp_path):
    one = {"case_id": "a", "split": "test", "case_description": "text", "category": "c", "expected_diagnosis": {"problem_list": [{"code": "F32", "severity": 3}]}}
    d = put(tmp_path / "g", "g.json", {"cases": [one, one | {"case_id": "b", "split": "train"}]})
    found = files.cases(spark, d)
    assert [r.case_id for r in files.in_split(found).collect()] == ["a"]
    assert files.cases_as_corpus(found).columns == ["chunk_id", "content"]
    assert files.cases_as_corpus(found, True).first().codes == ["F32"]
    bad = put(tmp_path / "h", "g.json", {"cases": [one, {"case_id": "z"}]})
    with pytest.raises(ValueError, match="z"):
        files.in_split(files.cases(spark, bad))


def test_both_taxonomy_forms(spark, tmp_path):
    flat = put(tmp_path / "f", "t.json", {"F32": {"name": "n", "category": "F", "severity": 4, "keywords": ["k"]}})
    nested = put(tmp_path / "n", "t.json", {"categories": [{"id": "F", "name": "mood", "problems": [{"code": "F32", "name": "n", "severity": 4, "keywords": ["k"]}]}]})
    assert tuple(files.taxonomy(spark, flat).first()) == ("F32", "n", "F", 4, ["k"])
    assert tuple(files.taxonomy(spark, nested).first()) == ("F32", "n", "mood", 4, ["k"])


def test_cached_detections_are_checked(spark):
    cases = spark.createDataFrame([("a", (["x"],)), ("b", (["y"],))], "case_id string, e struct<codes:array<string>>").select("case_id", F.struct(F.transform("e.codes", lambda c: F.struct(c.alias("code"))).alias("problem_list")).alias("expected_diagnosis"))
    make = lambda *rows: spark.createDataFrame(list(rows), "model string, repeat int, case_id string, expected_codes array<string>")
    good = make(("m", 1, "a", ["x"]), ("m", None, "b", []), ("m", 2, "a", ["x"]))
    assert files.detections(good, cases, "m").count() == 2
    for rows, what in (([("m", 1, "a", ["x"])], "without a row"), ([("m", 1, "a", ["x"])] * 2, "more than one"), ([("m", 1, "a", ["q"]), ("m", 1, "b", [])], "changed"), ([("o", 1, "a", ["x"])], "no rows"), ([("m", 1, "a", []), ("m", 1, "b", []), ("m", 1, "c", [])], "without a case")):
        with pytest.raises(ValueError, match=what):
            files.detections(make(*rows), cases, "m")


def test_rating_form(spark, tmp_path):
    d = put(tmp_path / "r", "r.csv", "﻿evaluator_id, case_id ,score\nr1,c1,4\n ,c2,3\nr2,c1,bad\n")
    assert [tuple(r) for r in files.rating_form(spark, d, ["score"]).orderBy("evaluator_id").collect()] == [("r1", "c1", 4.0), ("r2", "c1", None)]


def test_index_checkpoint_and_forms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, "s")], "doc_id long, text string, source string")
    path = str(tmp_path / "index")
    sinks.dense_index(docs, lambda t: F.array(F.lit(3.0), F.lit(4.0)), path)
    assert [round(x, 4) for x in sinks.open_index(spark, path).first().embedding] == [0.6, 0.8]
    assert sinks.fingerprint(docs) == sinks.fingerprint(docs.repartition(3)) != sinks.fingerprint(docs.limit(1))
    made = []
    arm = lambda n: lambda: made.append(n) or spark.createDataFrame([(n, 1.0)], "case_id string, score double")
    where = str(tmp_path / "run")
    assert sinks.Checkpoint(spark, where, "g", "t", 15, "gold").load() is None
    for _ in range(2):
        assert sinks.Checkpoint(spark, where, "g", "t", 15, "gold").run({"one": arm("one"), "two": arm("two")}).count() == 2
    assert made == ["one", "two"]
    assert sinks.Checkpoint(spark, where, "changed", "t", 15, "gold").completed() == []
    for name in ("r_2024", "r_2025", "r_2026"):
        put(tmp_path / "h", name, "x")
    assert sinks.prune(spark, str(tmp_path / "h"), 2) == ["r_2024"]
    labels = sinks.blind_labels(spark.createDataFrame([("x",), ("y",)], "strategy string"))
    assert {r.system_label for r in labels.collect()} == {"System_A", "System_B"}
    form = sinks.blind_form(spark.createDataFrame([("c", "t")], "case_id string, case_description string"), spark.createDataFrame([("c", "x", 1, "d")], "case_id string, strategy string, rank int, content string"), labels)
    assert form.count() == 2 and "strategy" not in form.columns and sorted(r.doc_1 for r in form.collect()) == ["", "d"]


def test_tail_probabilities(spark):
    r = spark.range(1).select(P.t_two_sided(F.lit(2.228), F.lit(10.0)).alias("t"), P.f_upper(F.lit(4.256), F.lit(2.0), F.lit(9.0)).alias("f"), P.chi2_upper(F.lit(5.991), F.lit(2.0)).alias("c"), P.z_two_sided(F.lit(1.959964)).alias("z"), P.t_two_sided(F.lit(None).cast("double"), F.lit(1.0)).alias("n")).first()
    assert all(abs(r[k] - 0.05) < 1e-4 for k in "tfcz") and r.n is None
    # against integration of the density
    for t, n in ((0.3, 3), (1.7, 7), (4.0, 30)):
        front = math.gamma((n + 1) / 2) / math.sqrt(n * math.pi) / math.gamma(n / 2)
        steps = 20000
        inside = sum(front * (1 + (t * (k + 0.5) / steps) ** 2 / n) ** (-(n + 1) / 2) for k in range(steps)) * t / steps
        assert P.beta_share(n / 2, 0.5, n / (n + t * t)) == pytest.approx(1 - 2 * inside, abs=1e-7)


def test_pairwise_p_by_hand(spark):
    rows = [(g, k, v) for g, vs in (("a", [1.0, 2.0, 3.0, 4.0]), ("b", [2.0, 2.5, 4.5, 5.0]), ("c", [1.0, 2.0, 3.0, 4.0])) for k, v in enumerate(vs)]
    out = {(r.one, r.two): r for r in comparisons.pairwise_p(comparisons.pairwise_t(spark.createDataFrame(rows, "g string, k int, v double"), "g", "k", "v")).collect()}
    assert out["a", "b"].t == pytest.approx(-4.898979, abs=1e-5) and out["a", "b"].p == pytest.approx(0.01628, abs=1e-4)
    assert out["a", "c"].p == 1.0 and out["a", "b"].p_holm == pytest.approx(3 * out["a", "b"].p, abs=1e-5)


def test_case_preparation(spark):
    c = spark.createDataFrame([("a", "simple", "one two", [("F", 5)]), ("b", "complex", "p q r s", [("G", 1), ("H", 3), ("I", 2)]), ("b", "complex", "", None)], "case_id string, complexity string, case_description string, problems array<struct<code:string,severity:int>>")
    v = {r.case_id: r for r in preparation.complexity_variants(c.where("case_description <> ''"), F.struct(F.lit("F32").alias("code"), F.lit(3).alias("severity")), " more").collect()}
    assert [tuple(p) for p in v["a_ESC_1"].problems] == [("F", 5), ("F32", 3)] and v["a_ESC_1"].case_description == "one two more"
    assert [tuple(p) for p in v["b_SIM_1"].problems] == [("G", 1), ("H", 2)] and v["b_SIM_1"].case_description == "p q r"
    faults = {r.fault: r.n for r in preparation.case_faults(c, least=5).collect()}
    assert faults == {"missing case_description": 1, "empty problem_list": 1, "duplicate case_id": 1, "too few cases": 2}
    p = preparation.paraphrased(c.where("case_id = 'a'"), spark.createDataFrame([("one", ["uno"]), ("zzz", ["y"])], "word string, others array<string>")).first()
    assert p.case_description == "uno two"


def test_mentions_and_empty_tables(spark):
    cases = spark.createDataFrame([(1, "The mother-in-law left. Mother said she cried."), (2, None)], "case_id long, text string")
    m = profile.mentions(cases, spark.createDataFrame([("mother", "actor"), ("mother-in-law", "actor"), ("she", "reference")], "term string, kind string"))
    assert [(r.term, r.start) for r in m.orderBy("start").collect()] == [("mother-in-law", 4), ("mother", 24), ("she", 36)]
    best = profile.antecedents(cases, m.where("kind = 'actor'"), m.where("kind = 'reference'"), reporting=["said"]).first()
    assert (best.actor, best.score) == ("mother", 220 - 6 + 160 + 55)
    empty = spark.createDataFrame([], "case_id long, code string, name string, severity int, confidence double, matched array<string>, keywords array<string>, reason string")
    hits = spark.createDataFrame([], "case_id long, doc_id long, score double, rank int")
    r = reports.operational(cases, empty, empty, hits).first()
    assert r.problems_found == 0 and r.accepted_ratio is None and r.retrieval_evidence is None
