"""The engine's queries against DuckDB, and values worked out by hand."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from casewright.functions import scoring as S
from casewright.functions import text as T
from casewright.functions import windows as W
from casewright.operators import agreement, chunking, evaluation, experiments, gates, metrics, preparation, resampling, retrieval, rules, scoring, service, statistics
from casewright.plans import fixtures as X
from casewright.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion", "metrics_at_k", "l1_confidence", "dedupe_codes", "problem_prior", "final_score", "query_expansion", "wilcoxon_w", "holm", "family_split", "set_metrics", "chunks", "keyword_windows", "evidence_sentences", "context_validity", "merged_verdicts", "friedman", "krippendorff_ordinal", "bootstrap_interval", "polarity_gates", "graded_relevance", "finalized_codes", "stream_detections", "strategy_metrics", "corpus_qrels", "component_ablation", "fused_score", "cooccurrence_weight", "review_load", "tools_by_rule", "sentence_classes", "masked_texts", "case_audit", "detector_gaps", "kendall_tau", "crosstab", "boundary_scan", "evidence_records", "coerced_spans", "historic_context", "distress_signals", "effect_interval", "system_comparison", "review_scores", "shown_documents", "paired_tests"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(repr(plain(r)) for r in df.select(*cols).collect())
    cur = duck.execute(ORACLES[name])
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    assert mine == sorted(repr(plain([r[i] for i in at])) for r in cur.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"bca_interval"}


def test_metrics_by_hand(spark):
    rows = [(q, r + 1, g, sum(x > 0 for x in gs)) for q, gs in (("a", [2, 1, 0, 0, 1]), ("b", [1, 0, 1, 0, 0])) for r, g in enumerate(gs)]
    df = spark.createDataFrame(rows, "q string, rank int, grade int, relevant int")
    m = {r.q: r for r in metrics.metrics(df, 5, ["q"]).collect()}
    assert m["a"].precision == 0.6 and m["b"].rr == 1.0
    assert m["b"].ap == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert m["a"].ndcg == pytest.approx((3 + 1 / math.log2(3) + 1 / math.log2(6)) / (3 + 1 / math.log2(3) + 0.5), abs=1e-6)


def test_prior_and_gates_by_hand(spark):
    df = spark.createDataFrame([("c", "a", 5, 0.8), ("c", "b", 4, 0.8), ("c", "d", 2, 0.8)], "case_id string, code string, severity int, confidence double")
    p = {r.code: r.prior for r in scoring.priors(df).collect()}
    assert p["a"] == pytest.approx((5 + 2 / 3) / 13) and p["d"] == pytest.approx((2 + 2 / 3) / 13)
    one = spark.range(1).select(S.calibrated(F.lit(0.8), F.lit(5), F.lit(5)).alias("c"), S.margin(F.lit(0.3)).alias("m"), T.adaptive_window(F.lit("x" * 180)).alias("w"), T.case_family(F.lit("A1_NEG_V2_PAR_3")).alias("f")).first()
    assert one.c == pytest.approx(0.64) and one.m == 0.5 and one.w == 27 and one.f == "A1"


def test_statistics_by_hand(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    assert {r.test: r.p_holm for r in statistics.holm(tests).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    d = spark.createDataFrame([(1.0,), (2.0,), (-3.0,), (0.0,)], "d double").withColumn("g", F.lit(1))
    assert statistics.wilcoxon(d, ["g"]).first().rank_biserial == 0.0


def test_empty_sets_agree(spark):
    sets = spark.createDataFrame([([], [])], "e array<string>, p array<string>")
    r = metrics.set_metrics(sets, "e", "p").first()
    assert (r.precision, r.f1, r.jaccard, r.exact) == (0.0, 0.0, 1.0, True)


def test_cuts_get_on_without_spaces():
    assert chunking.overlapping("ab", 4, 1) == ["ab"]
    assert chunking.overlapping("aa bb cc", 5, 1) == ["aa", "a bb", "b cc"]
    out = chunking.overlapping("x " + "y" * 5000, 100, 30)
    assert max(map(len, out)) <= 100 and out[0] + "".join(c[30:] for c in out[1:]) == "x " + "y" * 5000
    with pytest.raises(ValueError):
        chunking.cuts(F.lit("a"), 10, 10)


def test_windows_by_hand(spark):
    rows = [("aXbX. cX", "X"), ("", "X"), ("no", "X"), ("abc", ""), ("q.q", "."), ("a\\Eb", "\\E"), ("X" * 50, "X")]
    out = [r.w for r in spark.createDataFrame(rows, "t string, k string").select(W.keyword_windows(F.col("t"), F.col("k"), 3).alias("w")).collect()]
    assert out[:4] == [["aXbX", "aXbX", " cX"], [], [], []]
    assert out[4] == ["q.q"] and out[5] == ["a\\Eb"] and len(out[6]) == 50 and out[6][10] == "X" * 7
    e = spark.createDataFrame([("one a. two b! three a. one a", ["a"])], "t string, k array<string>").select(W.evidence(F.col("t"), F.col("k")).alias("e")).first().e
    assert e == ["one a", "three a"]


def test_agreement_by_hand(spark):
    same = spark.createDataFrame([(u, r, u % 3) for u in range(12) for r in range(3)], "u int, r int, v int")
    assert agreement.fleiss_kappa(same, "u", "v").first().kappa == 1.0
    assert agreement.icc21(same, "u", "r", "v").first().icc == 1.0
    assert agreement.icc21(same.where("u < 9"), "u", "r", "v").first().icc is None
    assert agreement.krippendorff(same, "u", "v").first().alpha == 1.0
    assert agreement.krippendorff(same.where("v = 1"), "u", "v", "interval").first().alpha == 1.0
    assert tuple(agreement.krippendorff(same.where("r = 0"), "u", "v").first()) == (0, 0.0)
    order = spark.createDataFrame([(s, t, float(t + s)) for s in range(4) for t in range(3)], "s int, t int, v double")
    assert agreement.friedman(order, "s", "t", "v").first().chi2 == 8.0
    assert agreement.friedman(order.withColumn("v", F.lit(1.0)), "s", "t", "v").first().chi2 is None


def test_bca_equals_plain_python(spark):
    xs = [(k, float((k * 37) % 23) ** 2) for k in range(40)]
    df = spark.createDataFrame(xs, "k int, v double").withColumn("g", F.lit("a"))
    got = resampling.bca_interval(df, ["g"], "k", "v", n=200).first()
    reps = sorted(r.mean for r in resampling.replicates(df, ["g"], "k", "v", 200).collect())
    mean = sum(v for _, v in xs) / 40
    left_out = [(sum(v for _, v in xs) - v) / 39 for _, v in xs]
    off = [sum(left_out) / 40 - x for x in left_out]
    push = sum(o**3 for o in off) / (6 * sum(o * o for o in off) ** 1.5)
    ends = []
    for q in resampling._cuts(sum(r < mean for r in reps) / 200, push, 0.95):
        at = q * 199
        ends.append(reps[int(at)] + (at - int(at)) * (reps[int(at) + 1] - reps[int(at)]))
    assert (got.low, got.high) == pytest.approx(ends, abs=1e-5) and got.low < mean < got.high
    two = resampling.bca_interval(df.where("k < 2"), ["g"], "k", "v", n=50).first()
    assert two.low == two.high == two.mean


def test_lenient_json(spark):
    texts = ['{"a": 1}', 'so: ```json\n{"a": 2}\n``` done', 'x {"a": {"b": 3}} y', "none", None, ""]
    got = [r.j for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rules.lenient_json(F.col("t")).alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": {"b": 3}}', None, None, None]


def test_ranking_changes(spark):
    one = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("d", "a", 1)], "case string, item string, rank int")
    two = spark.createDataFrame([("c", "b", 1), ("c", "a", 2)], "case string, item string, rank int")
    got = {r.case: (r.same_set, r.same_order) for r in experiments.ranking_changes(one, two, "case", "item", 2).collect()}
    assert got == {"c": (True, False), "d": (False, False)}


def test_gates_by_hand(spark):
    m = gates.Markers(clause=[", "], negation=["not "], exceptions=["not only"], own=["i "], other=["he "], reported=["said"])
    rows = [("i am not sad", 5), ("not here, he is sad", 5), ("he was not only sad", 2), ("it said sad", 3), ("", 5)]
    df = spark.createDataFrame([(k, t, s, ["sad"] if t else []) for k, (t, s) in enumerate(rows)], "k int, text string, severity int, matched array<string>")
    got = [(r.gate_neg, r.gate_sub) for r in gates.polarity(df, m).orderBy("k").collect()]
    assert got == [(0.4, 1.0), (1.0, 0.85), (1.0, 1.0), (1.0, 0.7), (1.0, 1.0)]


def test_analyze_whole_batch(spark):
    cases = spark.createDataFrame([(1, "so i lost my password: token and not the idiot"), (2, None), (3, "nothing")], "case_id bigint, text string")
    docs = spark.createDataFrame([(10, "password token rules"), (11, "other words here"), (12, None), (13, "more text"), (14, "yet more")], "doc_id bigint, text string")
    out = service.analyze(cases, docs, X.taxonomy(spark), X.rules(spark), X.MARKERS)
    assert {(r.case_id, r.code) for r in out["problems"].collect()} == {(1, "0206")}
    assert {(r.case_id, r.code) for r in out["filtered"].collect()} == {(1, "F32")}
    assert out["documents"].where("case_id = 1").orderBy("rank").first().doc_id == 10
    assert {r.case_id: r.problems for r in out["summary"].collect()} == {1: 1, 2: 0, 3: 0}


def test_unknown_decisions(spark):
    found = spark.createDataFrame([(1, "F32"), (1, "0801")], "case_id int, code string")
    made = spark.createDataFrame([(1, "F32", "excluded"), (1, "F32", "accepted"), (1, "0206", "review"), (1, "nope", "accepted"), (1, "0801", None)], "case_id int, code string, decision string")
    left, unknown = service.finalized(found, made, X.taxonomy(spark))
    assert {tuple(r) for r in left.collect()} == {(1, "0801", "found"), (1, "0206", "review")}
    assert {r.code for r in unknown.collect()} == {"nope", "0801"}


def test_experiments_by_hand(spark):
    means = spark.createDataFrame([("full", 0.9), ("less", 0.7)], "arm string, v double")
    assert tuple(experiments.contributions(means, "arm", "v", "full").first()) == ("less", 0.2)
    one = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "k int, v double")
    two = spark.createDataFrame([(1, 0.7), (2, 0.5), (3, 1.0)], "k int, v double")
    assert tuple(experiments.score_distance(one, two, ["k"], "v").first()) == (2, 0.1, 0.2, 1)
    rows = spark.createDataFrame([("m", 1, 1, 0, 0.6667, False), ("m", 1, 0, 0, 1.0, True)], "arm string, tp int, fp int, fn int, f1 double, exact boolean")
    r = experiments.detector_aggregate(rows, ["arm"]).first()
    assert (r.cases, r.micro_precision, r.micro_recall, r.micro_f1, r.exact_rate) == (2, 0.666667, 1.0, 0.8, 0.5)


def test_score_by_hand(spark):
    """Worked out from the published formulas, not from a query of ours."""
    found = spark.createDataFrame([("c", "a", "beta", 4, ["alpha", "gamma"], ["alpha"], 0.8, 0.5), ("c", "b", "delta words here", 2, ["omega", "epsilon zeta eta theta"], ["omega"], 0.6, 1.0)], "case_id string, code string, name string, severity int, keywords array<string>, matched array<string>, confidence double, gate_total double")
    docs = spark.createDataFrame([(1, "ALPHA and beta"), (2, "nothing"), (3, "Omega")], "doc_id bigint, text string")
    hits = spark.createDataFrame([("c", 1, 2.0), ("c", 2, 1.0), ("x", 3, 0.7)], "case_id string, doc_id bigint, score double")
    p = [(4 + 1) / 8, (2 + 1) / 8]
    detect = [0.8**2, 0.6 ** (1 / (0.5 + 0.5 * 1.5))]

    def idf(terms):
        df = max(1, int(len(terms) * 8 * (1 - 0.5 * min(sum(map(len, terms)) / len(terms) / 10, 1))))
        return min(max((min(3.0, max(0.5, math.log(1 + 500 / (1 + df)))) - 0.5) / 2.5, 0), 1)

    rare = [idf(["alpha", "gamma", "beta"]), idf(["omega", "epsilon zeta eta theta", "delta words here"])]
    share = {1: [2 / 3, 0.0], 2: [0.0, 0.0]}  # the code's name is one of its terms
    gate = [0.5, 1.0]
    entropy, kl = -sum(x * math.log2(x) for x in p), sum(x * math.log(x * 2) for x in p)
    alpha = 2 / (1 + math.exp(-(0.3 * 2 + 0.5 * 0.7 - 0.95))) * (1 + 0.5 * entropy) * (1 - 0.15 * kl)
    bayes = 0.5 + 0.5 * (p[0] * 0.8 + p[1] * 0.6)
    got = {(r.case_id, r.doc_id): r.final for r in scoring.score(hits, found, docs).collect()}
    for doc, base in ((1, 2.0), (2, 1.0)):
        phi = sum(0.35 * detect[i] + 0.3 * share[doc][i] + 0.15 * p[i] + 0.1 * rare[i] + 0.1 * gate[i] for i in (0, 1)) / 2
        assert got["c", doc] == pytest.approx(base * math.exp(min(3, alpha * phi)) * bayes, abs=1e-5)
    assert got["x", 3] == 0.7  # a case without codes keeps its score
    hard = {(r.case_id, r.doc_id): r.final for r in scoring.score(hits, found, docs, soft=False).collect()}
    assert hard["c", 1] > got["c", 1] and hard["c", 2] == got["c", 2]
    uniform = {(r.case_id, r.doc_id): r.final for r in scoring.score(hits, found, docs, prior_mode="uniform").collect()}
    assert uniform["c", 1] != got["c", 1] and (uniform["c", 1] > uniform["c", 2]) == (got["c", 1] > got["c", 2])
    for wrong in (lambda: scoring.priors(found, "flat"), lambda: scoring.features(hits, found, docs, matching="exact")):
        with pytest.raises(ValueError):
            wrong()


def test_gates_of_names_and_exceptions(spark):
    m = gates.Markers(negation=["not "], exceptions=["only a"])
    rows = [(0, "it is not only a debt", ["only a debt"], ""), (1, "it is not a debt", ["debt"], ""), (2, "not a debt, but a loan", ["debt"], "Loan"), (3, "a debt and no loan", ["debt"], "house")]
    df = spark.createDataFrame([(k, t, 1, w, n) for k, t, w, n in rows], "k int, text string, severity int, matched array<string>, name string")
    assert [r.gate_neg for r in gates.polarity(df, m).orderBy("k").collect()] == [1.0, 0.4, 0.4, 1.0]
    assert gates.polarity(df.where("k = 2").withColumn("text", F.lit("a loan, and that is not a debt")), m).first().gate_neg == 0.7


def test_fusion_by_hand(spark):
    one = spark.range(1).select(S.gated(F.lit(0.4), F.lit(0.25)).alias("g"), S.gated(F.lit(None).cast("double"), F.lit(0.25)).alias("none"))
    g = 1 / (1 + math.exp(-(5 * 0.4 - 1.5)))
    assert one.first().g == pytest.approx(g / (1 + math.exp(-4)) + (1 - g) * 0.25) and one.first().none == 0.25


def test_strategies_by_name(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta delta"), (3, "omega"), (4, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([("q", "alpha beta")], "query_id string, text string")
    none = spark.createDataFrame([], "case_id string, code string, name string, severity int, keywords array<string>, matched array<string>, confidence double")
    got = evaluation.run(["bm25", "hybrid", "h2l-bm25", "mine"], docs, asked, none, 2, {"mine": lambda d, q, k: retrieval.bm25(d, q, k, padded=True)}).collect()
    assert {r.strategy for r in got} == {"bm25", "hybrid", "h2l-bm25", "mine"} and all(r.doc_id == 1 for r in got if r.rank == 1)
    with pytest.raises(ValueError):
        evaluation.run(["bm52"], docs, asked, none)
    made = retrieval.hypothetical(docs, asked, retrieval.bm25, lambda t: F.when(t == "alpha beta", "omega")).collect()
    assert [(r.doc_id, r.fallback) for r in made] == [(3, False)]
    assert {r.fallback for r in retrieval.hypothetical(docs, asked, retrieval.bm25).collect()} == {True}
    assert retrieval.feedback(docs, asked, 2).where("rank = 1").first().doc_id == 1


def test_chunks_of_equal_keys_stay_apart(spark):
    rows = [(1, "s", "a" * 120 + "\n\n" + "c" * 120), (1, "s", "b" * 120), (2, None, None), (3, "s", "d " * 1500)]
    got = chunking.chunks(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    assert sorted((r.doc_id, r.chunk_index, r.content[0]) for r in got if r.doc_id == 1) == [(1, 0, "a"), (1, 0, "b"), (1, 1, "c")]
    assert [r.chunk_index for r in got if r.doc_id == 3] == [0, 1] and all(len(r.content) <= 2000 for r in got)


def test_masked_by_hand(spark):
    one = spark.range(1).select(T.masked(F.lit("Mr Bond met Mr clown1 at school North on 12/03/1987"), ["Mr"], ["school"], ["clown"]).alias("m")).first().m
    assert (one.text, one.n) == ("[NAME] met Mr clown1 at [PLACE] on [DATE]", 3)
