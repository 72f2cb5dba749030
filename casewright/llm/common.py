"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used by local sessions, as in tests on one machine, where `spark.checkpoint.dir` is unset.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/casewright"
#: ASCII white space: the characters between words.
SPACES = " \t\n\x0b\x0c\r"
#: Rows up to which a table whose count is known may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows that one row is made into at once; more are dealt to many tasks first.
REPEATED = 4096
#: A key of at most 2**LIGHT rows is never a heavy one.
LIGHT = 6
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session may do without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def staged(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again.

    It cuts the lineage, so that what follows reads the rows instead of making
    them anew, also after an executor is lost. The files go when Python ends.
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


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once however often `body` uses it.

    A column that a lambda uses may be put in its place by the optimizer, and
    then be worked out for each element; a lambda's own variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text without nulls: runs of anything but ASCII white space."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))

    def cut(t: Column) -> Column:
        parts = F.split(t, " ")
        return F.when(t == "", F.array().cast("array<string>")).when(F.contains(t, F.lit("  ")), F.array_remove(parts, "")).otherwise(parts)

    return let(F.btrim(text), cut)


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0)).cast("bigint")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that the keys decide."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """Sums of the elements before each element, and the whole sum at the end.

    Appending to an array copies it, so sums are made in blocks: the work is
    n * block + (n / block) ** 2 element copies.
    """
    zero = F.lit(0).cast("bigint")

    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def joined(inner: Column, outer: Column) -> Column:
        shifted = F.transform(inner, lambda a, k: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda v: v + F.get(outer, k)))
        return F.concat(F.flatten(shifted), F.array(F.element_at(outer, -1)))

    def summed(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(block))).otherwise(F.array().cast("array<int>"))
        inner = F.transform(starts, lambda s: running(F.slice(xs, s, F.lit(block))))
        return let(inner, lambda a: let(running(F.transform(a, lambda x: F.element_at(x, -1))), lambda b: joined(a, b)))

    return let(lengths, summed)


def skew_join(rows: DataFrame, small: DataFrame, key: str | list[str], size: str, how: str = "inner", whole: bool = True) -> DataFrame:
    """`rows` with the columns of `small`, whose keys are unique and never null, without a hot task.

    `size` of `small` says how many of `rows` have its key. If all of `small` is
    within BROADCAST_ROWS it is broadcast, unless `whole` is false, by which rows
    meet in the same way at every size of the input. Else a size is found above which at
    most BROADCAST_ROWS keys lie: these are broadcast, and rows of the others
    meet by a shuffle, in which no key is large. `rows` is read twice then.
    """
    key = [key] if isinstance(key, str) else key
    power = F.ceil(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int")
    at = {r[0]: r[1] for r in small.groupBy(power).count().collect()}  # a row for each power of two
    if whole and sum(at.values()) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    least = LIGHT
    while sum(n for p, n in at.items() if p > least) > BROADCAST_ROWS:
        least += 1
    if max(at, default=0) <= least:
        return rows.join(small, key, how)
    heavy = F.broadcast(small.where(power > least))
    rest = rows.join(F.broadcast(small.where(power > least).select(*key)), key, "left_anti").join(small.where(power <= least), key, how)
    return rows.join(heavy, key).unionByName(rest)


def row_mark(df: DataFrame) -> Column:
    """A hash of all columns of a row; nulls count by their place."""
    column = lambda c, kind: F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`")
    return F.xxhash64(*[column(c, kind) for c, kind in df.dtypes], F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in df.columns]))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """`df`, staged, with numbers from 0 without gaps in the given order.

    Rows are dealt by ranges of the order and counted within each; only a count
    for each range passes through one task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as there are ranges
    before = parts.select("_part", F.expr("sum(_n) over (order by _part) - _n").alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def repeated(df: DataFrame, times: str, name: str = "n", most: int | None = None) -> DataFrame:
    """Each row of `df` `times` times, with a number from 0 in `name`; a row without times goes.

    A row of many times is dealt by REPEATED to many tasks before it is repeated;
    `most`, the greatest of the times if it is known, may show that there is none.
    """
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    t = F.col(times).cast("bigint")
    few = df.where((t > 0) & (t <= REPEATED)).withColumn(name, F.explode(upto(t)))
    if most is not None and most <= REPEATED:
        return few
    parts = df.where(t > REPEATED).withColumn("_part", F.explode(upto(F.ceil(t / REPEATED))))
    parts = parts.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], "_part"))
    many = parts.withColumn(name, F.explode(upto(F.least(F.lit(REPEATED).cast("bigint"), t - F.col("_part") * REPEATED)))).withColumn(name, F.col(name) + F.col("_part") * REPEATED)
    return few.unionByName(many.drop("_part"))


def swept(xs: Column, start: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column], out: str, block: int = 64) -> Column:
    """What `step` gives for the elements from left to right, as an array of `out`.

    `step` takes the state and an element and returns a struct of the next
    `state` and of `out`, an array of what is settled; `last` gives what the last
    state holds. Appending copies an array, so results are gathered in blocks.
    """
    none, kind = F.array().cast(f"array<{out}>"), f"array<array<{out}>>"

    def inner(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], s["out"]).alias("out")))

    def outer(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), none.alias("out"))
        return let(F.aggregate(part, begin, inner), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], F.array(s["out"])).alias("out")))

    def all_of(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(block))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda s: F.slice(a, s, F.lit(block)))
        begin = F.struct(start.alias("state"), F.array().cast(kind).alias("out"))
        return F.aggregate(parts, begin, outer, lambda acc: F.concat(F.flatten(acc["out"]), last(acc["state"])))

    return let(xs, all_of)
