"""Alike texts and repaired splits, held against all pairs in plain Python."""

import glob
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright import staging
from casewright.operators import similarity


def grams(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute(rows, limit, n):
    first = {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        if t and t.split():
            first.setdefault(" ".join(t.lower().split()), k)
    sets = sorted((k, grams(t, n)) for t, k in first.items())
    out = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            j = len(x & y) / len(x | y)
            if j >= limit - 1e-9:
                out.append((a, b, round(j, 6)))
    return out


def clusters(seed, count, size, words=80, change=0.02):
    """Clusters of texts alike to another; the least id of each is less alike to the rest."""
    rng, rows = random.Random(seed), []
    for c in range(count):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(words // 2, words * 2))]
        for m in range(size):
            t = [f"x{rng.randrange(3000)}" if rng.random() < (change * 3 if m == 0 else change) else w for w in base]
            rows.append((c * size + m, " ".join(t)))
    return rows


@pytest.mark.parametrize(("limit", "n"), [(0.8, 5), (0.9, 3), (0.5, 5)])
def test_all_pairs_are_found(spark, monkeypatch, limit, n):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "HEAVY", 5)
    rows = clusters(1, 80, 4, change=0.003)
    rows += [(k + 1000, t) for k, t in clusters(3, 1, 40, 60, 0.0015)]  # a large group of texts that are nearly the same
    rows += [(5000 + k, f"text {k} " + "the common line that all of these texts hold") for k in range(30)]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "short"), (6004, "SHORT "), (6005, "two words"), (6006, rows[7][1].upper())]
    random.Random(4).shuffle(rows)
    found = similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")), similarity=limit, n=n)
    got, want = sorted(map(tuple, found.collect())), brute(rows, limit, n)
    assert got == want and len(want) > 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.near_duplicates(none).collect() == [] and similarity.copies(none).collect() == []


def test_splits_are_repaired_through_copies_and_pairs(spark):
    base = " ".join(f"word{k}" for k in range(200))
    rows = [("a", base, "train", "A"), ("b_PAR_1", base + " more", "test", "B"), ("b2", "of the same family", "test", "B"), ("c", "quite another text", "test", "C"), ("d", base, "train", "D"), ("e", None, "test", "E"), ("f", "", None, "F")]
    rows += [("g_PAR_1", "equal texts  here", "test", "G"), ("h", "equal texts here", "train", "H"), ("i_PAR_1", "of one family", "test", "I"), ("j", "of one family", "train", "I"), ("k", "not made but equal", "test", "K"), ("l", "not made but equal", "train", "L"), ("m_PAR_1", base + " more", "test", "M")]
    cases = spark.createDataFrame(rows, "case_id string, text string, split string, family string")
    pairs, members = similarity.near_duplicates(cases, "case_id"), similarity.copies(cases, "case_id")
    assert [(r.one, r.two) for r in pairs.collect()] == [("a", "b_PAR_1")]
    left = similarity.repaired(cases, pairs, members, "case_id", "family", "split", F.col("case_id").contains("_PAR_"))
    assert left.columns == cases.columns
    moved = {r.case_id for r in left.collect()} & {r.case_id for r in left.collect() if r.split == "train"} - {"a", "d", "h", "j", "l"}
    assert moved == {"b_PAR_1", "b2", "g_PAR_1", "m_PAR_1"} and left.count() == len(rows)


def written(spark):
    """Bytes that the session's tasks have shuffled and staged."""
    ran = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    shuffled = sum(ran.apply(k).totalShuffleWrite() for k in range(ran.size()))
    return shuffled + sum(os.path.getsize(f) for _, path in staging._staged for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet"))


def test_few_runs_of_a_text_are_shuffled(spark, monkeypatch):
    """Texts and all their runs once were shuffled, the runs more than once."""
    monkeypatch.setattr(similarity, "BUCKET", 12, raising=False)
    rows = clusters(5, 1000, 1, 400) + [(k + 5000, t) for k, t in clusters(6, 25, 4, 400, 0.003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = written(spark)
    found = similarity.near_duplicates(docs).collect()
    wrote, given = written(spark) - before, sum(len(t) for _, t in rows)
    assert found and wrote < 1.5 * given


def test_a_group_is_compared_in_cells(spark, monkeypatch):
    """Sets were moved once a pair."""
    monkeypatch.setattr(similarity, "CELL", 8)
    monkeypatch.setattr(similarity, "HEAVY", 50)
    rows = clusters(9, 1, 60, 500, 0.005) + [(k + 100, t) for k, t in clusters(10, 20, 3, change=0.003)]
    pairs = brute(rows, 0.8, 5)
    cells = similarity._in_cells(staging.staged(spark.createDataFrame(pairs, "one long, two long, similarity double").select("one", "two"))).collect()
    assert sorted((r.one, r.two) for r in cells) == [p[:2] for p in pairs] and len(pairs) > 800
    texts = {}
    for r in cells:
        texts.setdefault((r.low, r.i, r.j), set()).update((r.one, r.two))
    assert max(map(len, texts.values())) < 40 and sum(map(len, texts.values())) < len(pairs)
    docs = spark.createDataFrame([(str(k), t) for k, t in rows], "doc_id string, text string")
    assert sorted(tuple(sorted((int(r.one), int(r.two)))) for r in similarity.near_duplicates(docs).collect()) == [p[:2] for p in pairs]


def test_pairs_between_two_kinds_of_rows(spark):
    rows = clusters(7, 30, 5, change=0.003)
    rows += [(k + 1000, t.upper()) for k, t in rows[::4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some, other = F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 1
    first = {k: min(j for j, u in rows if u.lower() == t.lower()) for k, t in rows}
    a, b = ({first[k] for k, _ in rows if k % m == r} for m, r in ((5, 0), (2, 1)))
    want = [p for p in brute(rows, 0.8, 5) if (p[0] in a and p[1] in b) or (p[1] in a and p[0] in b)]
    assert sorted(map(tuple, similarity.near_duplicates(docs, between=(some, other)).collect())) == want and 20 < len(want) < len(brute(rows, 0.8, 5))


def test_runs_are_those_of_the_text_whatever_the_batch(monkeypatch):
    """Equal runs have equal hashes and others don't, in slices of any size; null-free rows of one word and more."""
    rng = random.Random(8)
    texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))] for _ in range(200)]
    words = pa.array(texts, pa.list_(pa.int64()))
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(similarity, "SLICE", size)
        for part, own in ((words, texts), (words.slice(17, 40), texts[17:57])):
            seen = [(int(r), int(h)) for _, _, row, runs in similarity._runs(part, 5) for r, h in zip(row, runs, strict=True)]
            want = [(r, tuple(t[i : i + 5])) for r, t in enumerate(own) for i in range(max(1, len(t) - 4))]
            assert [r for r, _ in seen] == [r for r, _ in want]
            assert len({(h, g) for (_, h), (_, g) in zip(seen, want, strict=True)}) == len({h for _, h in seen}) == len({g for _, g in want})
