"""Tables that are written once and read by several parts of a plan."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used by local sessions, as in tests on one machine, where `spark.checkpoint.dir` is unset.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/casewright"
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session may do without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def staged(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again, so that what follows doesn't make it anew.

    It also survives a lost executor. The files go when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(drop_staged)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Delete what `staged` has written."""
    while _staged:
        spark, path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
