"""Readers of chunk files, labelled cases, taxonomies, detections and rating forms.

JSON files are read whole, so one file must fit a task; folders may hold any
number of files. What must hold of an input is checked by aggregates, and a
breach raises ValueError with a few examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions.text import cleaned_source, collapsed

#: The fields of a chunk that may reach an index. Labels are not among them.
SAFE_FIELDS = ["chunk_id", "source_document", "source", "title", "chunk_type", "chunk_index", "char_count", "word_count", "thai_ratio"]
RECORD = "id string, chunk_id string, case_id string, content string, text string, content_snippet string, case_description string, source_document string, source string, title string, chunk_type string, chunk_index bigint, char_count bigint, word_count bigint, thai_ratio double"
PROBLEM = "code string, name string, category string, severity int, details string, keywords array<string>"
CASE = f"case_id string, split string, complexity string, category string, case_description string, is_negated boolean, evaluation_slice string, augmentation struct<type:string,false_trigger_code:string,trigger_word:string>, expected_diagnosis struct<problem_list:array<struct<{PROBLEM.replace(' ', ':').replace(',:', ',')}>>>"


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{part.split(' ', 1)[0]}:{part.split(' ', 1)[1]}" for part in ddl.split(", ") if part) + ">"


def _first(*names: str) -> Column:
    """The first of the columns that isn't blank."""
    return F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names])


def page_batches(total: Column, size: int, start: int = 1) -> Column:
    """Arrays of page numbers from `start` to `total`, `size` in each; none beyond the end."""
    begins = F.when(total >= start, F.sequence(F.lit(start), total, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda b: F.sequence(b, F.least(b + size - 1, total)))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each file of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, at, key and the RECORD fields of JSON files: a list, an object of records, or an object with `chunks`."""
    item = _struct(RECORD)
    d = whole_texts(spark, path).withColumn("text", F.trim("text"))
    is_list = F.col("text").startswith("[")
    rows = F.from_json("text", f"array<{item}>")
    inner = F.get_json_object("text", "$.chunks")
    listed = F.transform(F.when(is_list, rows).when(inner.isNotNull(), F.from_json(inner, f"array<{item}>")), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    keyed = F.map_entries(F.from_json("text", f"map<string,{item}>"))
    return d.select("file", F.posexplode(F.coalesce(listed, keyed)).alias("at", "entry")).where("entry.value IS NOT NULL").select("file", "at", "entry.key", "entry.value.*")


def numbered(rows: DataFrame, by: list[str], at: str, name: str = "doc_id") -> DataFrame:
    """`rows` with a number from 0 in the order of `by`, then `at`.

    Only a row for each group passes through one task; the rows themselves are
    numbered within their group.
    """
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return rows.join(offsets, by).withColumn(name, F.col("_before") + place - 1).drop("_before")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, content, text and SAFE_FIELDS of the chunks of a folder, without empty ones; labels never pass."""
    d = _records(spark, path).withColumn("_content", _first("content", "text", "case_description")).where("_content IS NOT NULL")
    d = numbered(d, ["file"], "at")
    fill = {
        "chunk_id": F.coalesce("chunk_id", "case_id", F.concat(F.lit("chunk_"), F.col("doc_id"))), "source_document": F.coalesce("source_document", "file"), "source": F.coalesce("source", "file"),
        "title": F.coalesce("title", F.concat(F.lit("Document chunk "), F.col("doc_id"))), "chunk_type": F.coalesce("chunk_type", F.lit("production_document")), "chunk_index": F.coalesce("chunk_index", "doc_id"),
        "char_count": F.coalesce("char_count", F.length("_content").cast("bigint")), "word_count": F.coalesce("word_count", F.size(F.split(collapsed(F.col("_content")), " ")).cast("bigint")), "thai_ratio": F.col("thai_ratio"),
    }
    return d.select("doc_id", F.col("_content").alias("content"), F.col("_content").alias("text"), *[fill[c].alias(c) for c in SAFE_FIELDS], F.lit("production_docs").alias("data_source"))


def merged_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of a folder: RECORD with text, snippet and id filled; an id that is made follows file and place."""
    made = F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws(":", "file", "at")), 1, 12))
    d = _records(spark, path).withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.nullif("content", F.lit("")), "content_snippet", F.lit("")))
    return d.withColumn("chunk_id", F.coalesce("chunk_id", "key", "id", made)).withColumn("content_snippet", F.coalesce("content_snippet", F.substring("text", 1, 400))).drop("key", "at", "file")


def with_source(chunks: DataFrame, suffixes: list[str], general: str = "general") -> DataFrame:
    """`chunks` with `source` from the name of their document; `general` where there is none."""
    name = F.trim("source_document")
    return chunks.withColumn("source", F.when(name != "", cleaned_source(name, suffixes)).otherwise(general))


def cases(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    """The labelled cases of files with a list `cases`."""
    return whole_texts(spark, path).select(F.explode(F.from_json("text", f"cases array<struct<{_inner(schema)}>>")["cases"]).alias("c")).select("c.*")


def _inner(ddl: str) -> str:
    return _struct(ddl)[len("struct<") : -1]


def _few(rows: DataFrame, column: str, n: int = 10) -> list[str]:
    return [str(r[0]) for r in rows.select(column).orderBy(column).limit(n).collect()]


def in_split(found: DataFrame, split: str = "test") -> DataFrame:
    """The cases of one split; refused if any case has none."""
    missing = _few(found.where("split IS NULL"), "case_id")
    if missing:
        raise ValueError(f"cases without a split: {missing}")
    return found.where(F.col("split") == split)


def cases_as_corpus(found: DataFrame, include_labels: bool = False) -> DataFrame:
    """case_id and content of cases with text; category and codes only if asked for."""
    extra = [F.col("category"), F.transform("expected_diagnosis.problem_list", lambda p: p["code"]).alias("codes")] if include_labels else []
    return found.where(F.trim("case_description") != "").select(F.col("case_id").alias("chunk_id"), F.trim("case_description").alias("content"), *extra)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """code, name, category, severity, keywords: from an object by code, or from categories that list problems."""
    body = "name:string,category:string,severity:int,keywords:array<string>"
    nested = F.from_json("text", f"categories array<struct<id:string,name:string,problems:array<struct<code:string,{body}>>>>")["categories"]
    inside = F.flatten(F.transform(nested, lambda c: F.transform(c["problems"], lambda p: F.struct(p["code"].alias("code"), p["name"].alias("name"), F.coalesce(p["category"], c["name"], c["id"]).alias("category"), p["severity"].alias("severity"), p["keywords"].alias("keywords")))))
    by_code = F.transform(F.map_entries(F.from_json("text", f"map<string,struct<{body}>>")), lambda e: F.struct(e["key"].alias("code"), e["value"]["name"].alias("name"), e["value"]["category"].alias("category"), e["value"]["severity"].alias("severity"), e["value"]["keywords"].alias("keywords")))
    return whole_texts(spark, path).select(F.explode(F.coalesce(inside, by_code)).alias("p")).select("p.*")


def detections(rows: DataFrame, found: DataFrame, model: str, repeat: int = 1, exact: bool = True) -> DataFrame:
    """Cached rows (model, repeat, case_id, expected_codes, ...) of one model and repeat, checked against the cases.

    Refused: no row; a case twice; a case without a row; a row without a case, if
    `exact`; expected codes that aren't the case's.
    """
    mine = rows.where((F.col("model") == model) & (F.coalesce("repeat", F.lit(1)) == repeat))
    want = found.select("case_id", F.transform("expected_diagnosis.problem_list", lambda p: p["code"]).alias("_codes"))
    checks = {
        "cases with more than one row": mine.groupBy("case_id").count().where("count > 1"),
        "cases without a row": want.join(mine, "case_id", "left_anti"),
        "rows without a case": mine.join(want, "case_id", "left_anti") if exact else mine.limit(0),
        "changed expected codes": mine.where(F.size("expected_codes") > 0).join(want, "case_id").where(~F.col("expected_codes").eqNullSafe(F.coalesce("_codes", F.array().cast("array<string>")))),
    }
    if mine.isEmpty():
        raise ValueError(f"no rows of model {model!r}, repeat {repeat}")
    for what, bad in checks.items():
        some = _few(bad, "case_id")
        if some:
            raise ValueError(f"{what}: {some}")
    return mine


def rating_form(spark: SparkSession, path: str, scores: list[str], rater: str = "evaluator_id") -> DataFrame:
    """Rows of CSV forms that a rater has filled; headers are trimmed, scores that aren't numbers are null."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    d = d.toDF(*[c.lstrip("﻿").strip() for c in d.columns]).where(F.trim(rater) != "")
    return d.select(*[F.expr(f"try_cast(trim(`{c}`) AS double)").alias(c) if c in scores else F.col(f"`{c}`") for c in d.columns])
