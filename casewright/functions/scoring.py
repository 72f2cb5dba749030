"""The scalar formulas of the problem-aware score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def sigmoid(x: Column) -> Column:
    """The logistic function, without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null or tiny vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 1e-16, dot(a, b) / norms), F.lit(0.0))


def calibrated(p: Column, severity: Column, most: Column) -> Column:
    """p to the power 1/T, where T falls from 2 to 0.5 as severity nears the case's most."""
    t = F.greatest(F.lit(0.1), 0.5 + (1 - severity / most) * 1.5)
    return F.when((p <= 0) | (p >= 1), clamp(p, 0.0, 1.0)).otherwise(F.pow(p, 1 / t))


def margin(similarity: Column) -> Column:
    return sigmoid((similarity - 0.3) / 0.15)


def gated(similarity: Column, keyword: Column) -> Column:
    """Meaning and keywords, mixed by how sure the meaning is; keywords alone without vectors."""
    g = sigmoid(similarity * 5 - 1.5)
    return F.coalesce(g * sigmoid(similarity / 0.1) + (1 - g) * keyword, keyword)


def idf_terms(keywords: Column, name: Column) -> Column:
    """What the specificity of a code is told from: its distinct keywords in lower case, and its name."""
    return F.concat(F.array_distinct(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), F.lower)), F.when(name != "", F.array(F.lower(name))).otherwise(F.array().cast("array<string>")))


def heuristic_idf(keywords: Column, most: int = 500) -> Column:
    """Specificity guessed from the number and length of keywords."""
    n = F.size(keywords)
    mean = F.coalesce(F.aggregate(keywords, F.lit(0.0), lambda s, k: s + F.length(k)) / F.nullif(n, F.lit(0)), F.lit(0.0))
    df = F.greatest(F.lit(1.0), F.floor(n * 8 * (1 - 0.5 * F.least(mean / 10, F.lit(1.0)))).cast("double"))
    return clamp(F.log(1 + most / (1 + df)), 0.5, 3.0)


def keyword_share(text: Column, terms: Column, soft: bool = True) -> Column:
    """The share of terms that the text holds, or whether it holds any."""
    low = F.lower(text)
    hits = F.size(F.filter(terms, lambda k: F.contains(low, F.lower(k))))
    return F.coalesce(hits / F.nullif(F.size(terms), F.lit(0)), F.lit(0.0)) if soft else (hits > 0).cast("double")


def with_name(keywords: Column, matched: Column, name: Column) -> Column:
    """The terms of a code: its distinct keywords and matched ones, and its name, if it has one."""
    none = F.array().cast("array<string>")
    return F.concat(F.array_union(F.coalesce(keywords, none), F.coalesce(matched, none)), F.when(name != "", F.array(name)).otherwise(none))


def specificity(idf: Column, low: float = 0.5, high: float = 3.0) -> Column:
    """The inverse document frequency scaled to 0 to 1."""
    return clamp((idf - low) / (high - low), 0.0, 1.0)


def confidence(matched: Column, keywords: Column, text: Column, mult: Column) -> Column:
    """Level-1 confidence from the number, coverage, length and repetition of matches."""
    from .text import occurrences

    n = F.nullif(F.size(matched), F.lit(0))  # no match, no confidence
    mean = F.aggregate(matched, F.lit(0.0), lambda s, k: s + F.length(k)) / n
    extra = F.aggregate(matched, F.lit(0), lambda s, k: s + F.greatest(occurrences(text, k) - 1, F.lit(0)))
    long = F.exists(matched, lambda k: (F.length(k) >= 10) | F.contains(k, F.lit(" ")))
    raw = 0.5 + F.least(F.lit(0.24), n * 0.1) + F.least(F.lit(0.1), n / F.nullif(F.size(keywords), F.lit(0)) * 0.18) + F.least(F.lit(0.12), mean / 24 * 0.12) + F.when(long, 0.04).otherwise(0.0) + F.least(F.lit(0.06), extra * 0.03)
    return F.round(clamp(raw * mult, 0.05, 0.95), 4)
