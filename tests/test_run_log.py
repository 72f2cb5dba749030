"""A matrix of runs that ends half-way goes on where it ended."""

import pytest
from pyspark.sql import functions as F

from casewright.sources.sinks import RunLog

KEYS = ["model", "repeat", "strategy", "case_id"]


@pytest.fixture
def wanted(spark):
    return spark.range(60).select(F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("model"), (F.col("id") % 3).cast("int").alias("repeat"), F.lit("bm25").alias("strategy"), F.col("id").alias("case_id"))


def value(df):
    return df.withColumn("score", F.col("case_id") * 2 + F.col("repeat"))


def test_an_ended_run_redoes_nothing_and_gives_equal_rows(spark, wanted, tmp_path):
    log, handed = RunLog(spark, str(tmp_path / "log"), "sig", KEYS), []

    def make(todo):
        rows = {r.case_id for r in todo.collect()}
        if len(handed) == 3:
            raise RuntimeError("ended")
        handed.append(rows)
        return value(todo)

    with pytest.raises(RuntimeError):
        log.run(wanted, make)
    done = set().union(*handed)
    assert log.progress() == (len(done), 60) and 0 < len(done) < 60
    again = []

    def go_on(todo):
        again.append({r.case_id for r in todo.collect()})
        return value(todo)

    got = RunLog(spark, str(tmp_path / "log"), "sig", KEYS).run(wanted, go_on)
    assert not done & set().union(*again) and done | set().union(*again) == set(range(60))
    assert sorted(map(tuple, got.select(*KEYS, "score").collect())) == sorted(map(tuple, value(wanted).collect()))
    assert log.progress() == (60, 60) and log.missing(wanted).count() == 0


def test_another_signature_begins_anew(spark, wanted, tmp_path):
    RunLog(spark, str(tmp_path / "log"), "one", KEYS).run(wanted.limit(5), value, 2)
    other = RunLog(spark, str(tmp_path / "log"), "two", KEYS)
    assert other.missing(wanted).count() == 60 and other.progress() == (0, 0)


def test_failed_rows_are_tried_again(spark, wanted, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), "sig", KEYS, failed=F.col("score").isNull())
    log.run(wanted, lambda d: value(d).withColumn("score", F.when(F.col("case_id") % 4 > 0, F.col("score"))), 3)
    assert {r.case_id % 4 for r in log.missing(wanted).collect()} == {0} and log.progress() == (45, 60)
    got = log.run(wanted, value, 3)
    assert got.where("score IS NULL").count() == 0 and got.count() == 60


def test_nothing_wanted(spark, wanted, tmp_path):
    assert RunLog(spark, str(tmp_path / "log"), "sig", KEYS).run(wanted.limit(0), value).collect() == []
