"""The corpus pipeline: documents to packed windows of tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. All but the last return
the columns of `documents`. Each takes its operator from `casewright.llm` when it
is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    from casewright.llm import quality

    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays."""
    from casewright.llm import near_join

    return near_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is redacted; n_chars follows the text, if the table has it."""
    from pyspark.sql import functions as F

    from casewright.llm import pii

    out = pii.redact(docs)
    return out.select(*[F.char_length("text").cast(dict(out.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in out.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    from casewright.llm import mixing

    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, by window."""
    from casewright.llm import packing

    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources", mixture), ("packing", packed)]

#: Token ids, minima of hashes and hash-driven draws have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table `documents`."""
    from casewright.llm.common import staged

    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
