"""Writers: the vector index, checkpoints of experiments with a manifest, blind forms, pruned histories."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.preparation import draw

MANIFEST = "strategy string, ground_truth_sha string, taxonomy_sha string, top_k int, problem_source string, at bigint"


def unit(vector: Column) -> Column:
    """The vector at length 1; one of no length stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 1e-12, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def dense_index(docs: DataFrame, embed: Callable[[Column], Column], path: str, key: str = "doc_id", text: str = "text") -> None:
    """Replace the index at `path`: doc_id, text, a unit vector and the other columns as JSON."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), unit(embed(F.col(text))).alias("vector"), meta.alias("metadata_json")).write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """vec_id and embedding of an index, as the vector search takes them; a missing index raises."""
    return spark.read.parquet(path).select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding"))


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table's rows, whatever their order; made by partial sums."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(rows.columns)])
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s"))
    return s.select(F.sha2(F.concat_ws(":", "n", "x", "s", F.lit(",".join(sorted(rows.columns)))), 256)).first()[0]


class Checkpoint:
    """Results by strategy, of which only whole ones with the same inputs are used again.

    A strategy's rows are written first and its line in the manifest last, so
    that a run that ends between them leaves nothing that counts.
    """

    def __init__(self, spark: SparkSession, path: str, ground_truth_sha: str, taxonomy_sha: str, top_k: int, problem_source: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.key = (ground_truth_sha, taxonomy_sha, top_k, problem_source)

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def save(self, strategy: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/results/strategy={strategy}")
        self.spark.createDataFrame([(strategy, *self.key, time.time_ns())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def completed(self) -> list[str]:
        """Strategies whose latest inputs were these."""
        if not self._exists(f"{self.path}/manifest"):
            return []
        m = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        last = m.groupBy("strategy").agg(F.max_by(F.struct("ground_truth_sha", "taxonomy_sha", "top_k", "problem_source"), "at").alias("k"))
        return sorted(r.strategy for r in last.collect() if tuple(r.k) == self.key)

    def load(self) -> DataFrame | None:
        """The rows of completed strategies, or None."""
        done = self.completed()
        return self.spark.read.parquet(f"{self.path}/results").where(F.col("strategy").isin(done)) if done else None

    def run(self, strategies: dict[str, Callable[[], DataFrame]]) -> DataFrame:
        """The rows of all strategies; those that aren't completed are made and saved."""
        done = self.completed()
        for name, make in strategies.items():
            if name not in done:
                self.save(name, make())
        return self.spark.read.parquet(f"{self.path}/results").where(F.col("strategy").isin(list(strategies)))


class RunLog:
    """Results of a matrix of runs (such as model, repeat, strategy, case), kept row by row, so that a run that was ended goes on.

    Work is dealt to slices by a hash of its keys; a slice's rows are appended to
    the log in one commit, with the signature of what they were made from. What
    the log holds of the same signature isn't made anew, nor are rows that
    `failed` says are to be tried again counted as made. After each slice the
    progress (signature, done, wanted, at) is written beside the log.
    """

    def __init__(self, spark: SparkSession, path: str, signature: str, keys: list[str], failed: Column | None = None) -> None:
        self.spark, self.path, self.signature, self.keys = spark, path.rstrip("/"), signature, keys
        self.failed = F.lit(False) if failed is None else failed

    def _read(self, name: str) -> DataFrame | None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("signature") == self.signature) if there else None

    def rows(self) -> DataFrame | None:
        """A row for each key that was made, the last one that didn't fail, else the last; None if there is no log."""
        log = self._read("rows")
        if log is None:
            return None
        names = [c for c in log.columns if c not in ("signature", "at")]
        kept = log.withColumn("_good", ~F.coalesce(self.failed, F.lit(False))).groupBy(*self.keys).agg(F.max_by(F.struct(*names), F.struct("_good", "at")).alias("r"))
        return kept.select("r.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The wanted keys of which the log has no row that counts."""
        log = self._read("rows")
        return wanted if log is None else wanted.join(log.where(~F.coalesce(self.failed, F.lit(False))).select(*self.keys).distinct(), self.keys, "left_anti")

    def progress(self) -> tuple[int, int]:
        """done and wanted after the last slice; nothing was done if there is no log."""
        told = self._read("progress")
        last = told.agg(F.max_by(F.struct("done", "wanted"), "at")).first()[0] if told is not None else None
        return (last.done, last.wanted) if last else (0, 0)

    def run(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], slices: int = 8) -> DataFrame:
        """The rows of all wanted keys; `make` gives them for those that it is handed, a slice at a time."""
        all_of = wanted.select(*self.keys).distinct().count()
        part = F.pmod(F.xxhash64(*self.keys), F.lit(slices))
        for k in range(slices):
            todo = self.missing(wanted.where(part == k))
            if todo.isEmpty():
                continue
            made = make(todo).withColumns({"signature": F.lit(self.signature), "at": F.lit(time.time_ns())})
            made.write.mode("append").parquet(f"{self.path}/rows")
            done = all_of - self.missing(wanted).select(*self.keys).distinct().count()
            self.spark.createDataFrame([(self.signature, done, all_of, time.time_ns())], "signature string, done bigint, wanted bigint, at bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/progress")
        found = self.rows()
        return found.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi") if found is not None else make(wanted)


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete all but the newest `keep` bundles (by name, as they end in a time) of a folder; their names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = sorted((s.getPath().getName() for s in fs.listStatus(where)), reverse=True)[keep:]
    for name in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(where, name), True)
    return sorted(old)


def blind_labels(systems: DataFrame, seed: int = 42) -> DataFrame:
    """strategy and its label System_A, System_B, ... in shuffled order; a few rows."""
    shuffled = F.array_sort(F.collect_set(F.struct(draw(F.col("strategy"), F.lit(str(seed))).alias("d"), F.col("strategy").alias("s"))))
    d = systems.agg(shuffled.alias("a")).select(F.posexplode("a").alias("k", "x"))
    return d.select(F.col("x.s").alias("strategy"), F.concat(F.lit("System_"), F.char(F.col("k") + 65)).alias("system_label"))


def blind_form(cases: DataFrame, results: DataFrame, labels: DataFrame, documents: int = 5) -> DataFrame:
    """A row for each case and system with its first documents and empty scores; the strategy isn't told."""
    top = results.where(F.col("rank") <= documents).groupBy("case_id", "strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("docs"))
    d = cases.select("case_id", "case_description").join(F.broadcast(labels)).join(top, ["case_id", "strategy"], "left")
    shown = [F.coalesce(F.get("docs", F.lit(k)), F.lit("")).alias(f"doc_{k + 1}") for k in range(documents)]
    empty = [F.lit("").alias(c) for c in ("evaluator_id", "relevance_score", "completeness_score", "clinical_usefulness_score", "comments")]
    return d.select(empty[0], "case_id", "system_label", "case_description", *shown, *empty[1:])
