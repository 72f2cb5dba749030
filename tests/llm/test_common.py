"""Joins without a hot task, with and without broadcasting the whole small table."""

import pytest

from casewright.llm import common


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("most", [100_000, 3, 0])
def test_every_row_meets_its_key_once(spark, monkeypatch, whole, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    sizes = {0: 300, 1: 200, 2: 5, 3: 1, 4: 90}
    rows = spark.createDataFrame([(k, n) for k, size in sizes.items() for n in range(size)] + [(9, 0), (None, 1)], "k int, n int")
    small = spark.createDataFrame([(k, size, f"v{k}") for k, size in sizes.items()], "k int, size bigint, v string")
    got = common.skew_join(rows, small, "k", "size", whole=whole).select("k", "n", "v").collect()
    assert sorted(map(tuple, got)) == sorted((k, n, f"v{k}") for k, size in sizes.items() for n in range(size))


def test_an_empty_small_table(spark):
    rows, none = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([], "k bigint, size bigint, v string")
    assert all(common.skew_join(rows, none, "k", "size", whole=w).collect() == [] for w in (True, False))
