"""Quality rules by host: failures are added up by domain, rates are shrunk with
an empirical beta prior, and the hosts' verdicts return to their documents.

1. Each document gets counts (words, symbols, repeated lines, words in repeated
   five-word windows) and from them rule failures. Row by row, no shuffle.
2. Failures are summed by host: partial sums first, so a host with a third of
   all rows sends a row a task.
3. All hosts' f of n give a rule a beta prior by the method of moments. Hosts
   weigh by their documents, and the spread that so few draws have by chance
   alone is taken out (Kleinman, 1973), so one-document hosts don't set it. A
   host's rate becomes (f + a) / (n + a + b): the prior weighs a + b documents,
   which the hosts alone decide. Hosts that differ by no more than chance give a
   prior of endless weight (every host has the mean), hosts that hold only
   failures or only none give one of no weight.
4. A host is `trusted`, `suspect` (a shrunken rate above SUSPECT) or `blocked`
   (above BLOCKED). Of a suspect host, documents must fail no rule at all; of a
   blocked host none stay. Base failures always go.

Defined cases: null texts are empty texts, which fail the base rule; a null
host is a host of its own; repeated rows count and return each; an empty table
gives no rows; input columns with an output's name are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, staged, words


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; the first two are the base rules."""

    least_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    symbol_percent: int = 10
    dup_line_percent: int = 30
    least_word_chars: int = 3
    most_word_chars: int = 12
    suspect: float = 0.5
    blocked: float = 0.9


RULES = ("short", "repeats", "symbols", "lines", "lengths")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "[#*$%&|<>]"


def _covered(w: Column, window: int) -> Column:
    """Words of `w` in windows that are found twice or more, the first included."""

    def repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: let(F.sort_array(again(p)), reach))

    def again(p: Column) -> Column:
        last = F.size(p) - 1
        same = lambda x, k: x["h"] == F.get(p, k)["h"]
        found = F.transform(p, lambda x, k: F.when(((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(x, F.least(k + 1, last))), x["i"]))
        return F.array_compact(found)

    def reach(s: Column) -> Column:
        ends = F.transform(s, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - i, F.lit(window))))
        return F.aggregate(ends, F.lit(0), lambda acc, x: acc + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    # most texts repeat no window, which the distinct hashes show without sorting
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(0))
    return F.when(F.size(w) > window, counted).otherwise(0)


def document_counts(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """`docs` as the struct `row`, with COUNTS and n_lines, the lines with a word."""

    def counts(t: Column) -> Column:
        lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
        by_word = let(words(t), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.concat_ws("", w)).alias("c"), _covered(w, window).alias("r")))
        symbols = F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))
        return F.struct(by_word.alias("w"), lines.alias("l"), symbols.alias("s"))

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), let(F.coalesce(F.col(text), F.lit("")), counts).alias("c"))
    found = dict(zip((*COUNTS, "n_lines"), ("c.w.n", "c.w.c", "c.s", "c.l.d", "c.w.r", "c.l.n"), strict=True))
    return d.select("row", *[F.col(v).cast("bigint").alias(k) for k, v in found.items()])


def failures(rules: QualityRules) -> dict[str, Column]:
    """A condition on the counts for each of RULES."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": n < rules.least_words,
        "repeats": F.col("n_repeat_words") * 100 > n * rules.repeat_percent,
        "symbols": F.col("n_symbols") * 100 > n * rules.symbol_percent,
        "lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * rules.dup_line_percent,
        "lengths": (chars < n * rules.least_word_chars) | (chars > n * rules.most_word_chars),
    }


def _host(host: Column) -> Column:
    """A host's key, never null."""
    return F.coalesce(F.concat(F.lit("="), host), F.lit(""))


def host_verdicts(counted: DataFrame, host: Column, rules: QualityRules = QualityRules()) -> DataFrame:
    """A row for each host: host_key, n, the shrunken rate of each rule, verdict."""
    fail = failures(rules)
    sums = [F.sum(fail[r].cast("bigint")).alias(r) for r in RULES]
    hosts = staged(counted.groupBy(_host(host).alias("host_key")).agg(F.count(F.lit(1)).alias("n"), *sums))
    n = F.col("n").cast("double")
    sums = [f.alias(k) for r in RULES for k, f in ((f"f_{r}", F.sum(F.col(r).cast("double"))), (f"q_{r}", F.sum(F.col(r) * F.col(r) / n)))]
    got = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), *sums).first()
    shrunk = {}
    for r in RULES:
        mean, weight = beta_prior(got.hosts, got.n or 0.0, got.n2 or 0.0, got[f"f_{r}"] or 0.0, got[f"q_{r}"] or 0.0)
        shrunk[r] = F.lit(mean) if math.isinf(weight) else (F.col(r) + mean * weight) / (F.col("n") + weight)
    worst = F.greatest(*shrunk.values())
    verdict = F.when(worst > rules.blocked, "blocked").when(worst > rules.suspect, "suspect").otherwise("trusted")
    return hosts.select("host_key", "n", *[c.alias(f"rate_{r}") for r, c in shrunk.items()], verdict.alias("verdict"))


def beta_prior(hosts: int, n: float, n2: float, f: float, q: float) -> tuple[float, float]:
    """The mean, and the weight a + b, of the beta prior by moments of the hosts.

    hosts: their number; n, n2: the sums of their documents and of the squares;
    f: the sum of failures; q: the sum of failures squared by documents. The
    weight is 1 / r - 1, where r is the share of the spread that chance doesn't
    explain; it is endless where r is 0 or less, or can't be told.
    """
    mean = f / n if n else 0.0
    chance = mean * (1 - mean)
    room = chance * (n - n2 / n - (hosts - 1)) if n else 0.0
    r = (q - f * mean - chance * (hosts - 1)) / room if room > 1e-12 else 0.0
    return (mean, math.inf) if r <= 1e-12 else (mean, max(1 / r - 1, 0.0))


def judged(counted: DataFrame, verdicts: DataFrame, host: Column, rules: QualityRules = QualityRules()) -> DataFrame:
    """`counted` with base_failed, verdict and kept.

    Only hosts that aren't trusted take part in the join. They are broadcast if
    their count is within BROADCAST_ROWS; else both sides are dealt by the host
    and a salt, so a host with a third of all rows meets in many tasks.
    """
    fail = failures(rules)
    odd = staged(verdicts.where("verdict <> 'trusted'").select("host_key", "verdict"))
    d = counted.withColumn("host_key", _host(host))
    if odd.count() <= BROADCAST_ROWS:
        d = d.join(F.broadcast(odd), "host_key", "left")
    else:
        salts = 32
        d = d.withColumn("salt", F.pmod(F.xxhash64(*COUNTS), F.lit(salts)).cast("int"))
        d = d.join(odd.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host_key", "salt"], "left").drop("salt")
    d = d.withColumn("verdict", F.coalesce("verdict", F.lit("trusted"))).withColumn("base_failed", fail["short"] | fail["repeats"])
    soft = fail["symbols"] | fail["lines"] | fail["lengths"]
    kept = ~F.col("base_failed") & (F.col("verdict") != "blocked") & ~((F.col("verdict") == "suspect") & soft)
    return d.withColumn("kept", kept)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and the host's verdict of every document.

    The counts are staged (a few dozen bytes a document), so texts are read once.
    """
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    counted = document_counts(part, "text", rules.window)
    counted = staged(counted.select(F.col("row.doc_id").alias("doc_id"), F.col("row.host").alias("host"), *COUNTS, "n_lines"))
    verdicts = host_verdicts(counted, F.col("host"), rules)
    return judged(counted, verdicts, F.col("host"), rules).select(F.col("doc_id").alias(doc_id), *COUNTS, "base_failed", "kept", "verdict")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that are kept, with the columns of `docs`.

    Counts are made twice, for the hosts and for the verdict; that costs less
    than moving or storing all texts. The verdict is filtered by as one value:
    split into its parts, some would go below the join and count anew there.
    """
    counted = document_counts(docs, text, rules.window)
    at = F.col(f"row.`{host}`")
    verdicts = host_verdicts(counted, at, rules)
    return judged(counted, verdicts, at, rules).where(let(F.col("kept"), lambda kept: kept)).select("row.*")


_RX = r"'[^\x20\x09-\x0D]+'"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, {_RX}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_RX})) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 AS f1, n_repeat_words * 100 > n_words * 20 AS f2, n_symbols * 100 > n_words * 10 AS f3,
  n_dup_lines * 100 > n_lines * 30 AS f4, (word_chars < n_words * 3 OR word_chars > n_words * 12) AS f5 FROM s),
h AS (SELECT source, k, count(*) AS n, count(*) FILTER (f) AS f FROM (SELECT source, unnest(range(1, 6)) AS k, unnest([f1, f2, f3, f4, f5]) AS f FROM f) GROUP BY ALL),
a AS (SELECT k, count(*)::DOUBLE AS hosts, sum(n::DOUBLE) AS n, sum(n::DOUBLE * n) AS n2, sum(f::DOUBLE) AS f, sum(f::DOUBLE * f / n) AS q FROM h GROUP BY k),
m AS (SELECT *, f / n AS m, (f / n) * (1 - f / n) * (n - n2 / n - (hosts - 1)) AS room FROM a),
p AS (SELECT k, m, CASE WHEN room > 1e-12 THEN (q - f * m - m * (1 - m) * (hosts - 1)) / room ELSE 0 END AS r FROM m),
v AS (SELECT source, max(CASE WHEN r <= 1e-12 THEN m ELSE (f + m * greatest(1 / r - 1, 0)) / (n + greatest(1 / r - 1, 0)) END) AS worst FROM h JOIN p USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND worst <= 0.9 AND NOT (worst > 0.5 AND (f3 OR f4 OR f5)) AS kept,
  CASE WHEN worst > 0.9 THEN 'blocked' WHEN worst > 0.5 THEN 'suspect' ELSE 'trusted' END AS verdict
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
