"""Detection on cases as they come in, by the same operators as on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casewright.operators import detection
from casewright.staging import shared_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """The table as a stream of its files, with the schema that it has now."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    pattern = f"{path[:-1]}[{path[-1]}]"  # a file by its own name isn't taken for a source, a pattern is
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def detected(cases: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The codes of a stream of cases; no state is kept, since a case is judged by itself."""
    return detection.detections(cases, taxonomy)


def drained(stream: DataFrame) -> DataFrame:
    """What the stream gives for all input there is, written once each, and read again.

    Output and progress lie in the shared folder, so that a run that is ended
    goes on where it was; no batch is written twice.
    """
    spark = stream.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")
