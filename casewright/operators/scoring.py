"""The problem-aware score, by the grain case-code, case, and case-document-code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.scoring import calibrated, clamp, cosine, gated, heuristic_idf, idf_terms, keyword_share, margin, sigmoid, specificity, with_name
from casewright.staging import staged

from . import retrieval

MU, FLOOR = 2.0, 0.01
WEIGHTS = {"detect": 0.35, "semantic": 0.30, "prior": 0.15, "specificity": 0.10, "negation": 0.10}


def priors(found: DataFrame, mode: str = "severity") -> DataFrame:
    """`found` with the prior of each code in its case: smoothed severity, floored, adding up to 1."""
    if mode not in ("severity", "uniform"):
        raise ValueError(f"unknown prior mode {mode!r}")
    w = Window.partitionBy("case_id")
    n, total = F.count(F.lit(1)).over(w), F.sum("severity").over(w)
    raw = 1.0 / n if mode == "uniform" else F.when(total > 0, (F.col("severity") + MU / n) / (total + MU)).otherwise(1.0 / n)
    d = found.withColumn("raw", F.greatest(raw, F.lit(FLOOR)))
    return d.withColumn("prior", F.col("raw") / F.sum("raw").over(w)).drop("raw")


def case_level(with_prior: DataFrame, alpha: float = 1.0) -> DataFrame:
    """For each case: n, entropy, kl, alpha, alpha_eff, bayes, max_severity."""
    p = F.col("prior")
    d = with_prior.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), (-F.sum(p * F.log2(p))).alias("entropy"), F.sum(p * F.log(p)).alias("plogp"), F.avg("confidence").alias("mean_conf"), F.sum(p * F.col("confidence")).alias("pconf"), F.max("severity").alias("max_severity"))
    d = d.withColumn("kl", F.when(F.col("n") > 1, clamp(F.col("plogp") + F.log(F.col("n")), 0.0, 2.0)).otherwise(0.0))
    d = d.withColumn("alpha", F.greatest(F.lit(FLOOR), 2 * alpha * sigmoid(0.3 * F.col("n") + 0.5 * F.col("mean_conf") - 0.95)))
    eff = F.greatest(F.lit(FLOOR), F.col("alpha") * (1 + 0.5 * F.col("entropy")) * (1 - 0.15 * F.col("kl")))
    return d.select("case_id", "n", "mean_conf", "entropy", "kl", "alpha", eff.alias("alpha_eff"), (0.5 + 0.5 * F.least(F.col("pconf"), F.lit(1.0))).alias("bayes"), "max_severity")


def corpus_specificity(taxonomy: DataFrame, docs: DataFrame, least: int = 500) -> DataFrame:
    """code, df, idf and specificity of codes (code, name, keywords) by how many documents hold one of their terms.

    The exact form of `heuristic_idf`: the codes, a small table, travel to the
    texts, and a count a code and task is shuffled. A corpus of fewer documents
    counts as `least`; a code without terms weighs 1.
    """
    terms = F.transform(idf_terms(F.col("keywords"), F.coalesce("name", F.lit(""))), F.lower)
    codes = taxonomy.select("code", F.filter(terms, lambda t: F.coalesce(t != "", F.lit(False))).alias("_terms"))
    texts = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    hits = texts.join(F.broadcast(codes)).where(F.exists("_terms", lambda t: F.contains(F.col("_text"), t))).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(least)).alias("_n"))
    d = codes.join(hits, "code", "left").fillna(0, ["df"]).join(F.broadcast(n))
    idf = F.when(F.size("_terms") > 0, clamp(F.log(1 + F.col("_n") / (1 + F.col("df"))), 0.5, 3.0)).otherwise(1.0)
    return d.select("code", "df", F.round(idf, 6).alias("idf"), F.round(specificity(idf), 6).alias("specificity"))


def cooccurrence(found: DataFrame, vectors: DataFrame, gamma: float = 0.3) -> DataFrame:
    """case_id, code, weight: 1 and a share of the mean positive likeness of a code to the case's other codes.

    `vectors` (code, cvec) are unit vectors of few codes; a case with fewer than
    two of them weighs 1.
    """
    a = found.select("case_id", "code").distinct().join(F.broadcast(vectors), "code")
    b = a.select("case_id", F.col("code").alias("other"), F.col("cvec").alias("ovec"))
    near = a.join(b, "case_id").where("code <> other").groupBy("case_id", "code").agg(F.avg(F.greatest(F.lit(0.0), cosine(F.col("cvec"), F.col("ovec")))).alias("near"))
    return found.select("case_id", "code").distinct().join(near, ["case_id", "code"], "left").select("case_id", "code", (1 + gamma * F.coalesce("near", F.lit(0.0))).alias("weight"))


def features(hits: DataFrame, found: DataFrame, docs: DataFrame, prior_mode: str = "severity", matching: str = "keyword_soft", code_vectors: DataFrame | None = None, doc_vectors: DataFrame | None = None) -> DataFrame:
    """The five features and the weight of each code of a hit's case: case_id, doc_id, score, code, detect, semantic, prior, specificity, negation, weight.

    `hits` are case_id, doc_id, score, cut to the best few; a case without codes
    has one row without a code. `matching`: `hard` and `keyword_soft` look for
    words, `soft` mixes them with the likeness of vectors (code, cvec) and
    (doc_id, dvec), or takes the margin if that is more. Where `found` has
    gate_total, it is the negation feature, else 1; so it is with `weight`.
    """
    if matching not in ("soft", "keyword_soft", "hard"):
        raise ValueError(f"unknown matching mode {matching!r}")
    a = priors(found, prior_mode)
    detail = a.withColumn("most", F.max("severity").over(Window.partitionBy("case_id")))
    optional = lambda c: F.col(c) if c in found.columns else F.lit(1.0)
    detail = detail.select("case_id", "code", "prior", with_name(F.col("keywords"), F.col("matched"), F.col("name")).alias("terms"), calibrated(F.col("confidence"), F.col("severity"), F.col("most")).alias("detect"), specificity(heuristic_idf(idf_terms(F.col("keywords"), F.col("name")))).alias("specificity"), optional("gate_total").cast("double").alias("negation"), optional("weight").cast("double").alias("weight"))
    few = retrieval.within(staged(hits.select("case_id", "doc_id", "score")))  # few rows a case go to the texts, which stay
    pairs = docs.select("doc_id", "text").join(few, "doc_id").join(detail, "case_id", "left")
    word = keyword_share(F.col("text"), F.col("terms"), matching != "hard")
    if matching == "soft" and code_vectors is not None and doc_vectors is not None:
        pairs = pairs.join(F.broadcast(code_vectors), "code", "left").join(doc_vectors, "doc_id", "left")
        near = F.when(F.col("cvec").isNotNull() & F.col("dvec").isNotNull(), cosine(F.col("dvec"), F.col("cvec")))
        word = F.coalesce(F.greatest(gated(near, word), margin(near)), word)
    return pairs.select("case_id", "doc_id", "score", "code", "detect", word.alias("semantic"), "prior", "specificity", "negation", "weight")


def variants(spark, rows: list[tuple]) -> DataFrame:
    """One row (variant, alpha, product, and a weight for each feature) for each way to score, of (name, changes)."""
    default = {"alpha": 1.0, "product": False} | {f"w_{k}": v for k, v in WEIGHTS.items()}
    full = [(name, *(default | changes).values()) for name, changes in rows]
    return spark.createDataFrame(full, "variant string, alpha double, product boolean, " + ", ".join(f"w_{k} double" for k in WEIGHTS))


def scored(parts: DataFrame, level: DataFrame, ways: DataFrame) -> DataFrame:
    """variant, case_id, doc_id, base, phi, final of `features` and `case_level` for each of the few `variants`.

    All ways are worked out in one pass over the features. Adding up with the
    weights drops a feature of weight 0; multiplying takes each as it is.
    """
    d = parts.join(F.broadcast(ways))
    added = sum(F.col(f"w_{k}") * F.col(k) for k in WEIGHTS)
    times = F.col("detect")
    for k in list(WEIGHTS)[1:]:
        times = times * F.col(k)
    e = d.groupBy("variant", "alpha", "case_id", "doc_id", "score").agg(F.avg(F.col("weight") * F.when(F.col("product"), times).otherwise(added)).alias("phi"))
    g = e.join(level.drop("alpha", "alpha_eff"), "case_id", "left")
    alpha = F.greatest(F.lit(FLOOR), 2 * F.col("alpha") * sigmoid(0.3 * F.col("n") + 0.5 * F.col("mean_conf") - 0.95))
    eff = F.greatest(F.lit(FLOOR), alpha * (1 + 0.5 * F.col("entropy")) * (1 - 0.15 * F.col("kl")))
    final = F.col("score") * F.exp(clamp(eff * F.col("phi"), -3.0, 3.0)) * F.col("bayes")
    return g.select("variant", "case_id", "doc_id", F.round("score", 6).alias("base"), F.round("phi", 6).alias("phi"), F.round(F.coalesce(final, F.col("score")), 6).alias("final"))


#: The parameters of the score that a sweep changes, with their defaults. The score doesn't read `beta`.
DEFAULTS = {"t_base": 0.5, "t_range": 1.5, "neg_lambda": 0.6, "kl_kappa": 0.15, "margin": 0.3, "mu": 2.0, "alpha": 1.0, "beta": 0.3}
#: What each is changed to.
SWEEPS = {
    "t_base": [0.2, 0.35, 0.5, 0.65, 0.8, 1.0], "t_range": [0.5, 1.0, 1.5, 2.0, 2.5], "neg_lambda": [0.3, 0.45, 0.6, 0.8, 1.0], "kl_kappa": [0.0, 0.05, 0.1, 0.15, 0.25, 0.3],
    "margin": [0.1, 0.2, 0.3, 0.4, 0.5], "mu": [0.5, 1.0, 2.0, 3.0, 4.0], "alpha": [0.25, 0.5, 0.75, 1.0, 1.5, 2.0], "beta": [0.0, 0.1, 0.3, 0.5, 0.7, 1.0],
}


def configuration_rows(sweeps: dict[str, list[float]]) -> list[tuple]:
    """(parameter, value, each of DEFAULTS with that one changed): a row for each value of each parameter, and one of all defaults.

    Parameters must be known, and their values hold the default once, as a sweep is compared with it.
    """
    rows = [("default", 0.0, *DEFAULTS.values())]
    for name, values in sweeps.items():
        if name not in DEFAULTS or values.count(DEFAULTS[name]) != 1:
            raise ValueError(f"{name!r} must be one of {sorted(DEFAULTS)}, and its values must hold the default once")
        rows += [(name, float(v), *(DEFAULTS | {name: float(v)}).values()) for v in values]
    return rows


def swept(found: DataFrame, sweeps: dict[str, list[float]] | None = None, base: float = 0.5) -> DataFrame:
    """parameter, value, n_scored, mean_boost, mean_phi, mean_alpha, mean_score, std_score and the change of the mean score from the default's, in percent.

    `found` (case_id, code, name, severity, confidence, keywords, matched, text,
    denied_share, gate_len, gate_sub, maybe near, the likeness of code and text)
    is read once: texts are left behind before the few configurations are put
    beside each code as columns, and cases stay where their codes are, so what is
    shuffled doesn't grow with the configurations. Each must score the same
    cases as the default; if one doesn't, reading the result raises an error.
    """
    ways = found.sparkSession.createDataFrame(configuration_rows(sweeps or SWEEPS), "parameter string, value double, " + ", ".join(f"{k} double" for k in DEFAULTS))
    near = F.col("near").cast("double") if "near" in found.columns else F.lit(None).cast("double")
    word = keyword_share(F.col("text"), with_name(F.col("keywords"), F.col("matched"), F.col("name")))
    rare = specificity(heuristic_idf(idf_terms(F.col("keywords"), F.col("name"))))
    flat = found.select("case_id", "code", F.col("severity").cast("double").alias("severity"), "confidence", word.alias("word"), near.alias("near"), rare.alias("rare"), "denied_share", "gate_len", "gate_sub")
    case = Window.partitionBy("case_id")
    flat = flat.withColumns({"n": F.count(F.lit(1)).over(case), "total": F.sum("severity").over(case), "most": F.max("severity").over(case)})
    d = flat.join(F.broadcast(ways))
    way = ["parameter", "value", *DEFAULTS]
    raw = F.greatest(F.lit(FLOOR), F.when(F.col("total") > 0, (F.col("severity") + F.col("mu") / F.col("n")) / (F.col("total") + F.col("mu"))).otherwise(1.0 / F.col("n")))
    d = d.withColumn("raw", raw).withColumn("prior", F.col("raw") / F.sum("raw").over(Window.partitionBy("case_id", "parameter", "value")))
    c, p = F.col("confidence"), F.col("prior")
    t = F.greatest(F.lit(0.1), F.col("t_base") + (1 - F.col("severity") / F.col("most")) * F.col("t_range"))
    detect = F.when((c <= 0) | (c >= 1), clamp(c, 0.0, 1.0)).otherwise(F.pow(c, 1 / t))
    semantic = F.coalesce(F.greatest(gated(F.col("near"), F.col("word")), sigmoid((F.col("near") - F.col("margin")) / 0.15)), F.col("word"))
    denied = F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - F.col("neg_lambda") * F.col("denied_share"))), 4)
    parts = {"detect": detect, "semantic": semantic, "prior": p, "specificity": F.col("rare"), "negation": F.round(denied * F.col("gate_len") * F.col("gate_sub"), 4)}
    phi = sum(F.lit(WEIGHTS[k]) * x for k, x in parts.items())
    g = d.groupBy("case_id", *way).agg(F.avg(phi).alias("phi"), F.count(F.lit(1)).alias("n"), F.avg(c).alias("conf"), F.sum(p * c).alias("pconf"), (-F.sum(p * F.log2(p))).alias("entropy"), F.sum(p * F.log(p)).alias("plogp"))
    kl = F.when(F.col("n") > 1, clamp(F.col("plogp") + F.log("n"), 0.0, 2.0)).otherwise(0.0)
    alpha = F.greatest(F.lit(FLOOR), 2 * F.col("alpha") * sigmoid(0.3 * F.col("n") + 0.5 * F.col("conf") - 0.95))
    g = g.withColumn("eff", F.greatest(F.lit(FLOOR), alpha * (1 + 0.5 * F.col("entropy")) * (1 - F.col("kl_kappa") * kl)))
    g = g.withColumn("boost", F.exp(clamp(F.col("eff") * F.col("phi"), -3.0, 3.0)) * (0.5 + 0.5 * F.least(F.col("pconf"), F.lit(1.0))))
    x = F.col("boost") * base
    out = g.groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("n_scored"), F.avg("boost").alias("mean_boost"), F.avg("phi").alias("mean_phi"), F.avg("eff").alias("mean_alpha"), F.avg(x).alias("mean_score"), F.stddev_pop(x).alias("std_score"), F.bit_xor(F.xxhash64("case_id")).alias("_cases"))
    first = F.max_by(F.struct("mean_score", "_cases", "n_scored"), F.col("parameter") == "default").over(Window.partitionBy(F.lit(1)))  # a row for each configuration
    d = out.withColumn("_first", first)
    same = F.when((F.col("_cases") == F.col("_first._cases")) & (F.col("n_scored") == F.col("_first.n_scored")), F.col("n_scored")).otherwise(F.raise_error(F.lit("configurations scored different cases")).cast("bigint"))
    r = lambda c: F.round(c, 6).alias(c)
    return d.select("parameter", "value", same.alias("n_scored"), r("mean_boost"), r("mean_phi"), r("mean_alpha"), r("mean_score"), r("std_score"), F.round((F.col("mean_score") / F.nullif(F.col("_first.mean_score"), F.lit(0.0)) - 1) * 100, 4).alias("change_percent"))


def score(hits: DataFrame, found: DataFrame, docs: DataFrame, alpha: float = 1.0, prior_mode: str = "severity", soft: bool = True, **how) -> DataFrame:
    """case_id, doc_id, base, final of hits (case_id, doc_id, score); words alone unless `how` asks otherwise.

    Hits are already cut to the best few, so texts are joined to few rows; what
    belongs to a case is worked out once and joined last.
    """
    parts = features(hits, found, docs, prior_mode, **({"matching": "keyword_soft" if soft else "hard"} | how))
    ways = variants(hits.sparkSession, [("", {"alpha": float(alpha)})])
    return scored(parts, case_level(priors(found, prior_mode)), ways).select("case_id", "doc_id", "base", "final")


def expansion(found: DataFrame, queries: DataFrame, codes: int = 3, words: int = 3) -> DataFrame:
    """The queries (case_id, text) with names and first keywords of the likeliest codes put behind."""
    w = Window.partitionBy("case_id").orderBy(F.col("prior").desc(), "code")
    top = priors(found).withColumn("n", F.row_number().over(w)).where(F.col("n") <= codes)
    terms = top.select("case_id", "n", F.posexplode(F.concat(F.array("name"), F.slice("keywords", 1, words))).alias("pos", "term"))
    once = terms.groupBy("case_id", F.lower("term").alias("low")).agg(F.min(F.struct("n", "pos", "term")).alias("t"))
    added = once.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["term"]), " ").alias("added"))
    return queries.join(added, "case_id", "left").select("case_id", F.concat_ws(" ", "text", "added").alias("expanded"))


def adaptive_cut(scored: DataFrame, level: DataFrame, least: int = 5) -> DataFrame:
    """Rows (case_id, rank, final) above a bar that falls with mean severity; the first few if too few pass."""
    bar = 0.5 + (5 - F.col("mean_severity")) / 5 * 0.2
    w = Window.partitionBy("case_id")
    d = scored.join(level, "case_id").withColumn("passes", F.col("final") >= bar)
    d = d.withColumn("n_pass", F.sum(F.col("passes").cast("int")).over(w)).withColumn("n_all", F.count(F.lit(1)).over(w))
    few = (F.col("n_pass") < least) & (F.col("n_all") >= least)
    return d.where(F.when(few, F.col("rank") <= least).otherwise(F.col("passes"))).drop("passes", "n_pass", "n_all")


def hop_queries(found: DataFrame, queries: DataFrame, hop: int, problems: int = 3, each: int = 2, most: int = 5) -> DataFrame:
    """query_id and text of the query after a hop: names of the first problems after hop 1, keywords after hop 2.

    Problems come by severity, then confidence. A query without problems, or
    without what is to be added, has no next hop.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), (-F.col("confidence")).alias("c"), "code", "name", "keywords")))
    top = found.groupBy("case_id").agg(F.slice(order, 1, problems).alias("p")).withColumnRenamed("case_id", "query_id")
    names = F.filter(F.transform("p", lambda x: x["name"]), lambda n: F.coalesce(n != "", F.lit(False)))
    words = F.slice(F.flatten(F.transform("p", lambda x: F.slice(F.coalesce(x["keywords"], F.array().cast("array<string>")), 1, each))), 1, most)
    more = names if hop == 1 else words
    return queries.join(top, "query_id").where(F.size(more) > 0).select("query_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.array_join(more, " ")).alias("text"))


def multihop(docs: DataFrame, queries: DataFrame, found: DataFrame, k: int = 10, hops: int = 3) -> DataFrame:
    """query_id, doc_id, hop, rank: what each hop finds first; a document stays at its first hop."""
    asked = queries.select("query_id", "text", F.lit(1).alias("hop"))
    for h in range(2, hops + 1):
        asked = asked.unionByName(hop_queries(found, queries, h - 1).withColumn("hop", F.lit(h)))
    asked = asked.select(F.struct("query_id", "hop").alias("query_id"), "text")  # the queries of all hops are asked at once
    d = retrieval.bm25(docs, asked, k).select("query_id.query_id", "query_id.hop", "doc_id", "rank")
    return d.groupBy("query_id", "doc_id").agg(F.min(F.struct("hop", "rank")).alias("m")).select("query_id", "doc_id", "m.hop", "m.rank")
