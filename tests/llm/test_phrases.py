"""Phrase collocations, held against counting in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from casewright.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, frequent, best=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= frequent}
        inside = {}
        for p, c in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(c, inside.get(p[i:j], 0))
        found = []
        for p, a in often.items():
            if inside.get(p, 0) < a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(seed=3, n=240):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "日本", "x y", "a<b", "Ä", "\0"] + [f"w{k}" for k in range(12)]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "!?"]) for _ in range(rng.randrange(0, 60)))
    rows = [(rng.choice(["en", "en", "fr", None]), text()) for _ in range(n)]
    return rows + rows[:20] + [("en", None), (None, None), ("de", ""), ("de", " .. \t"), ("en", "the same passage is here again. " * 50)]


@pytest.mark.parametrize("per_bucket", [1 << 20, 300])
def test_counts_equal_plain_python_however_they_are_dealt(spark, per_bucket):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    out = phrases.mine(docs.withColumn("phrase", F.lit(1)).withColumn("times", F.lit("clash")), frequent=6, per_bucket=per_bucket)
    assert got(out) == brute(rows, 6)
    assert len(got(out)) > 20


def test_hot_pairs_and_long_pieces_in_parts(monkeypatch):
    """A word pair that a third of all places has, in pieces of very many words, coded in parts, with bitmaps that let much through."""
    monkeypatch.setattr(phrases, "AT_ONCE", 500)
    monkeypatch.setattr(phrases, "CHUNK", 2000)
    monkeypatch.setattr(phrases, "_WIDE", 10)  # numbers of a part, as of a piece with very many words
    rng = random.Random(1)
    rows = [("en", " ".join(f"hot pair {rng.choice('ab')} {rng.randrange(40)}" for _ in range(400))) for _ in range(6)]
    rows += [("en", " ".join(f"u{k}" for k in range(3000))), ("fr", "hot pair a 1")]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "piece": [r[1] for r in rows], "times": pa.array([1] * (len(rows) - 1) + [30], pa.int64())})
    every = phrases.Bitmap(64, np.full(1, 2**64 - 1, np.uint64))
    parts = [*phrases._single(iter([batch])), *phrases._phrases(every, every)(iter([batch]))]
    found = Counter()
    for part in phrases._counter(20, "64MB")(iter(parts)):
        for lang, p, k, t in zip(*(x.to_pylist() for x in part.columns), strict=True):
            assert k == len(p.split(" "))
            found[lang, p] += t
    true = Counter()
    for (lang, text), times in zip(rows, [1] * (len(rows) - 1) + [30], strict=True):
        w = text.split(" ")
        for k in range(1, 6):
            for i in range(len(w) - k + 1):
                true[lang, " ".join(w[i : i + k])] += times
    assert found == {p: c for p, c in true.items() if c >= 20}


def test_bitmaps_hold_every_name(spark):
    names = [xxhash.xxh64_intdigest(f"en\0w{k}".encode(), seed=42) for k in range(5000)]
    rows = spark.range(5000).select(phrases._name_hash(F.lit("en"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("hash"))
    made = phrases.bitmap(rows)
    others = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    assert made.holds(np.array(names, np.uint64)).all() and made.holds(others).mean() < 0.1
    assert not phrases.bitmap(rows.limit(0)).holds(others).any()


def test_ties_and_the_number_of_phrases(spark):
    rows = [("en", "b a. " * 5 + "c a. " * 5 + "a c. " * 5 + "Z é. " * 5)]
    out = got(phrases.mine(spark.createDataFrame(rows, "lang string, text string"), frequent=5, best=3))
    assert out == brute(rows, 5, 3) and len(out) == 3


def test_large_products_are_exact(spark):
    row = spark.sql("SELECT 100000000000001L AS a, 99999999999999999L AS n, 100000000000003L AS l, 1000000000000007L AS r")
    c = [F.col(x) for x in "anlr"]
    assert row.select(phrases._score(*c)).first()[0] == 1000 * 100000000000001 * 99999999999999999 // (100000000000003 * 1000000000000007)


def test_empty_table(spark):
    assert got(phrases.mine(spark.createDataFrame([], "lang string, text string"))) == []
