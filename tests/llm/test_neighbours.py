"""Nearest neighbours by permutations, held against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import neighbours

DDL = "vec_id long, embedding array<float>"


def true(rows, queries, k=20):
    width = max(len(v) for _, v in rows)
    rows = sorted({(i, tuple(np.float32([*v, *[0] * (width - len(v))]).astype(float).tolist())) for i, v in rows})
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for q, v in rows:
        if q in queries:
            s = x @ np.array(v)
            order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
            out[q] = [(int(i), -float(a)) for a, i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, want):
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, v in got.items():
        np.testing.assert_allclose([s for _, s in v], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def test_small_tables_are_exact_with_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(1).tolist()) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(100, 160)]  # copies of one vector, three of them queries
    rows += [rows[7], rows[7], (200, [1.0]), (220, [0.5, 0.25])]  # repeated rows and shorter vectors
    odd = [(300, None), (320, []), (340, [0.0] * 5), (360, [None, 1.0]), (380, [float("nan"), 1.0]), (400, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows + odd, DDL).withColumn("score", F.lit(9)).withColumn("k1", F.lit("clash"))
    queries = {i for i, _ in rows if i % 20 == 0}
    same(found(neighbours.nearest(table)), true(rows, queries))


def test_fewer_rows_than_neighbours(spark):
    assert found(neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0])], DDL))) == {}
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [-1.0, 0.0])]
    same(found(neighbours.nearest(spark.createDataFrame(rows, DDL))), true(rows, {0, 20}))


@pytest.mark.parametrize("rows", [[], [(0, None)], [(20, [0.0])]])
def test_tables_without_vectors(spark, rows):
    out = neighbours.nearest(spark.createDataFrame(rows, DDL))
    assert out.collect() == [] and out.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("kind", ["sphere", "norms", "clusters"])
def test_recall_over_shards(spark, kind):
    """Vectors on a sphere, of norms that differ widely, and of which a third lie so close together that other rows hardly tell them apart."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "norms":
        x *= np.exp(rng.normal(0, 0.4, len(x)))[:, None]
    if kind == "clusters":
        x[:2000] = x[0] + 0.01 * x[:2000]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want = true(rows, set(range(0, 6000, 20)))
    got = found(neighbours.nearest(spark.createDataFrame(rows, DDL)))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want))
    assert hit >= (0.9 if kind == "clusters" else 0.97), hit


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert neighbours.recall(table, list(range(0, 2000, 40))) >= 0.95


def test_footrule_and_places_by_hand():
    pivots = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]])
    assert neighbours.places(np.array([[0.9, 0.1], [-1.0, 0.5]]), pivots, 2.0, True).tolist() == [[0, 1, 2], [2, 1, 0]]
    assert neighbours.footrule(np.array([[0, 2], [1, 1], [2, 0]], np.int16), np.array([[0, 1, 2]], np.int16)).tolist() == [[0, 4]]
