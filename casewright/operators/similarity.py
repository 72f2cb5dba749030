"""Pairs of alike texts by an exact set similarity join, and what follows for splits.

Two sets whose Jaccard similarity is t or more share an element among the first
n - ceil(t n) + 1 of each, if both are put in one order. Any order will do; this one
is by how many words' runs fall into an element's bucket of hashes, the fewest first,
so that what many texts hold comes last. The buckets are few, so only the first
elements of a text are ever shuffled, once, and sets go only to texts that have a
candidate. Every pair at or above the limit is found: the recall is 1, not a matter
of chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import collapsed
from casewright.staging import staged

#: Words of a shingle and the least similarity.
WORDS, LIMIT = 5, 0.8
#: Rows of a block: the rows of a shared shingle meet block by block.
BLOCK = 512
#: Rows that are broadcast at most; keys that more than HEAVY rows have may be.
SENT, HEAVY = 50_000, 1000
#: Bits of a shingle's bucket, whose counts (2 MB) go to every task, and of the bitmap (4 MB) of the texts that have a candidate.
BUCKET, NAMES = 18, 25
#: Words that a task works on at once, and places that the rows of a full bucket are dealt to.
SLICE, DEALT = 1 << 20, 64
#: Sets of a cell: those of a group of alike texts are compared cell by cell.
CELL = 128


def matched(rows: DataFrame, small: DataFrame, key: list[str], size: str) -> DataFrame:
    """`rows` joined with `small`, whose keys are unique and whose column `size` says how many rows have the key.

    Keys that more than HEAVY rows have are broadcast, if they are at most SENT,
    so that no task gets all rows of one; the others meet by a shuffle. If more
    keys are heavy, no one key holds a large share, and all meet by a shuffle.
    Both tables are read twice, so they should be staged.
    """
    heavy = small.where(F.col(size) > HEAVY)
    many = heavy.limit(SENT + 1).count()
    if not 0 < many <= SENT:
        return rows.join(small, key)
    names = F.broadcast(heavy.select(*key))
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(names, key, "left_anti").join(small.where(F.col(size) <= HEAVY), key))


def _words(text: str) -> Column:
    """Hashes of the words of a text, in lower case."""
    return F.transform(F.split(F.lower(collapsed(F.col(text))), " "), lambda w: F.xxhash64(w))


def _runs(words: pa.ListArray, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """From and to which row, and of those the row and hash of each run of n words; shorter texts have one run."""
    ends = words.offsets.to_numpy().astype(np.int64)
    values = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        w, size = values[ends[at] : ends[to]], np.diff(ends[at : to + 1])
        row = np.repeat(np.arange(at, to), size)
        place = np.arange(len(w)) - np.repeat(ends[at:to] - ends[at], size)
        left = np.repeat(size, size) - place
        h = np.minimum(left, n).astype(np.uint64)
        for k in range(n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            m = max(0, len(w) - k)
            h[:m] += np.where(left[:m] > k, w[k:], np.uint64(0))
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        whole = (left >= n) | (place == 0)
        yield at, to, row[whole], h[whole]
        at = to


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes in order, each hash once a row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _tallied(n: int) -> Callable:
    """How many runs of a task's texts fall into each bucket."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET, np.int64)
        for batch in batches:
            for _, _, _, h in _runs(batch["w"], n):
                total += np.bincount((h & np.uint64((1 << BUCKET) - 1)).view(np.int64), minlength=1 << BUCKET)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": held.astype(np.int32), "runs": total[held]})

    return tally


def _first(n: int, similarity: float, tally) -> Callable:
    """The first runs of each text, in the order of their buckets' counts; `salt` deals those of full buckets."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = tally.value
        rank = np.empty(1 << BUCKET, np.uint64)
        order = np.argsort(runs, kind="stable")
        rank[order] = np.arange(1 << BUCKET, dtype=np.uint64)
        full = (runs > HEAVY + 4 * runs.mean())[order]
        for batch in batches:
            for at, to, row, h in _runs(batch["w"], n):
                # the bucket's rank takes the place of its bits, so the hash stays as unique as it was
                row, h = _distinct(row, rank[(h & np.uint64((1 << BUCKET) - 1)).view(np.int64)] << np.uint64(64 - BUCKET) | h >> np.uint64(BUCKET))
                size = np.bincount(row - at, minlength=to - at)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
                size = np.repeat(size, size)
                keep = place <= size - np.ceil(size * similarity - 1e-9) + 1
                row, h, place, size = row[keep], h[keep], place[keep], size[keep]
                salt = np.where(full[(h >> np.uint64(64 - BUCKET)).view(np.int64)], row % DEALT + 1, 0)
                yield pa.record_batch({"gram": h.view(np.int64), "k": batch["k"].take(pa.array(row)), "n": size.astype(np.int32), "place": place.astype(np.int32), "salt": salt.astype(np.int32)})

    return first


def _named(bits) -> Callable:
    """Rows whose bit `x` is set."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].to_numpy()
            yield batch.filter(pa.array((bits.value[x >> 3] >> (x & 7) & 1).astype(bool))).select(["k", "t"])

    return named


def _sets(n: int) -> Callable:
    """The distinct runs of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, row, h in _runs(batch["w"], n):
                row, h = _distinct(row, h)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row - at, minlength=to - at))])
                yield pa.record_batch({"k": batch["k"].slice(at, to - at), "g": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))})

    return sets


def _compared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """How many runs the texts of each pair share, and have."""
    at = {k: i for i, k in enumerate(sets["k"].to_pylist())}
    own = [r for part in sets["g"].chunks for r in np.split(part.values.to_numpy()[part.offsets[0].as_py() : part.offsets[-1].as_py()], part.offsets.to_numpy()[1:-1] - part.offsets[0].as_py())]
    one, two = ([own[at[k]] for k in pairs[name].to_pylist()] for name in ("one", "two"))
    common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)]
    ints = lambda xs: pa.array(xs, pa.int32())
    return pa.table({"one": pairs["one"], "two": pairs["two"], "common": ints(common), "n_one": ints([len(x) for x in one]), "n_two": ints([len(y) for y in two])})


def _in_cells(pairs: DataFrame) -> DataFrame:
    """`pairs` with low, i and j: pairs of the same three hold at most about 2 CELL texts.

    The group of a pair is the least text that its first one is paired with, so
    texts that are all alike make one group, to which each comes once a cell row.
    """
    ends = lambda: F.explode(F.array("one", "two")).alias("k")
    low = pairs.select("one", ends()).groupBy(F.col("k").alias("one")).agg(F.min("one").alias("low"))
    named = staged(pairs.join(low, "one"))
    texts = named.select("low", ends()).distinct().groupBy("low").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    groups = staged(named.groupBy("low").agg(F.count(F.lit(1)).alias("pairs")).join(texts, "low"))
    cell = lambda k: F.pmod(F.xxhash64(k), F.col("cells"))
    return matched(named, groups, ["low"], "pairs").select("one", "two", "low", F.least(cell("one"), cell("two")).alias("i"), F.greatest(cell("one"), cell("two")).alias("j"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and representative (the least key) of texts that are equal but for case and white space; blank texts go."""
    d = staged(docs.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("key"), F.unhex(F.md5(F.lower(collapsed(F.col(text))))).alias("digest")))
    first = staged(d.groupBy("digest").agg(F.min("key").alias("representative"), F.count(F.lit(1)).alias("n")))
    return matched(d, first, ["digest"], "n").select("key", "representative")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = LIMIT, n: int = WORDS, members: DataFrame | None = None, between: tuple[Column, Column] | None = None) -> DataFrame:
    """one, two, similarity of all pairs of texts whose sets of n words are alike; equal texts are one, with the least key.

    `members`, by default `copies`, tells which rows a representative stands for.
    `between`, two conditions on rows, leaves the pairs where one text stands for a
    row that meets the first and the other text for one that meets the second.
    Blank and null texts have no pairs; keys are unique. The rows of a shared
    shingle meet in blocks, so a shingle that many texts hold is dealt to many
    tasks; of texts that are all alike every pair is a result.
    """
    spark = docs.sparkSession
    members = copies(docs, key, text) if members is None else members
    able = [F.coalesce(c, F.lit(False)).alias(a) for c, a in zip(between or (F.lit(True),) * 2, ("from", "to"), strict=True)]
    sides = docs.select(F.col(key).alias("key"), *able).where(F.col("from") | F.col("to")).join(members, "key").groupBy(F.col("representative").alias("k")).agg(F.max("from").alias("from"), F.max("to").alias("to"))
    whole = docs.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = whole.schema["k"].dataType.simpleString()
    d = whole.select("k", _words("t").alias("w"))
    counts, total = d.select("w").mapInArrow(_tallied(n), "bucket int, runs long").groupBy("bucket").agg(F.sum("runs").alias("runs")).toArrow(), np.zeros(1 << BUCKET, np.int64)
    total[counts["bucket"].to_numpy()] = counts["runs"].to_numpy()
    posts = d.mapInArrow(_first(n, similarity, spark.sparkContext.broadcast(total)), f"gram long, k {kind}, n int, place int, salt int")
    posts = posts.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("gram", "salt"))).where("held > 1 OR salt > 0")
    posts = staged(posts.select("gram", "k", "n", "place").join(sides, "k"))  # a representative's text has its copies' runs
    counted = staged(posts.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("posts")).where("posts > 1"))
    dealt = matched(posts, counted, ["gram"], "posts").withColumn("b", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    left = dealt.select("gram", F.col("k").alias("k1"), F.struct("n", "place", "from", "to").alias("p1"), F.col("b").alias("i"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("gram", F.col("k").alias("k2"), F.struct("n", "place", "from", "to").alias("p2"), F.col("b").alias("j"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"))
    fits = (F.least("p1.n", "p2.n") >= F.greatest("p1.n", "p2.n") * similarity - 1e-9) & ((F.col("i") < F.col("j")) | (F.col("k1") < F.col("k2"))) & (F.col("k1") != F.col("k2"))
    shared = F.least("p1.place", "p2.place") + F.least(F.col("p1.n") - F.col("p1.place"), F.col("p2.n") - F.col("p2.place"))
    enough = lambda most, both: most >= both * (similarity / (1 + similarity)) - 1e-4
    met = left.join(right, ["gram", "i", "j"]).where(fits & enough(shared, F.col("p1.n") + F.col("p2.n"))).where((F.col("p1.from") & F.col("p2.to")) | (F.col("p1.to") & F.col("p2.from")))
    # what two texts share up to the last place where they met was counted; behind it they share no more than the shorter rest
    rest = lambda p: F.min(p["n"] - p["place"])
    p1, p2 = (F.when(F.col("k1") < F.col("k2"), F.col(a)).otherwise(F.col(b)) for a, b in (("p1", "p2"), ("p2", "p1")))
    pairs = met.groupBy(F.least("k1", "k2").alias("one"), F.greatest("k1", "k2").alias("two")).agg((F.count(F.lit(1)) + F.least(rest(p1), rest(p2))).alias("most"), F.min(F.col("p1.n") + F.col("p2.n")).alias("both"))
    pairs = staged(pairs.where(enough(F.col("most"), F.col("both"))).select("one", "two"))
    bit = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << NAMES))
    name = pairs.select(F.explode(F.array("one", "two")).alias("k")).select((bit("k") + 1).alias("x"))
    bits = np.zeros((1 << (NAMES - 15), 1 << 12), np.uint8)
    for r in name.groupBy(F.bitmap_bucket_number("x").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("part")).collect():
        bits[r.at - 1] = np.frombuffer(r.part, np.uint8)
    alike = whole.withColumn("x", bit("k")).mapInArrow(_named(spark.sparkContext.broadcast(bits.ravel())), f"k {kind}, t string")
    sets = alike.select("k", _words("t").alias("w")).mapInArrow(_sets(n), f"k {kind}, g array<long>")
    cells, where = _in_cells(pairs), ["low", "i", "j"]
    moved = cells.select(*(F.col(c).alias(f"{c}_") for c in where), F.explode(F.array("one", "two")).alias("k")).distinct().join(sets, "k")
    both = cells.groupBy(*where).cogroup(moved.groupBy(*(f"{c}_" for c in where))).applyInArrow(_compared, f"one {kind}, two {kind}, common int, n_one int, n_two int")
    like = F.col("common") / (F.col("n_one") + F.col("n_two") - F.col("common"))
    return both.select("one", "two", like.alias("exact")).where(F.col("exact") >= similarity - 1e-9).select("one", "two", F.round("exact", 6).alias("similarity"))


def repaired(cases: DataFrame, pairs: DataFrame, members: DataFrame, case_id: str, family: str, split: str, made: Column) -> DataFrame:
    """`cases`, where the families of made test cases that are alike to a training case of another family go to `train`.

    `pairs` are of representatives and `members` are `copies`; neither is
    expanded into pairs of cases. Of the training families alike to a case the
    least and the greatest say whether one is another than its own.
    """
    d = cases.select(F.col(case_id).alias("key"), F.col(family).alias("family"), F.col(split).alias("split"), F.coalesce(made, F.lit(False)).alias("made")).join(members, "key")
    trained = d.where("split = 'train'").groupBy("representative").agg(F.min("family").alias("low"), F.max("family").alias("high"))
    pairs = staged(pairs.select("one", "two"))
    links = pairs.unionByName(pairs.select(F.col("two").alias("one"), F.col("one").alias("two"))).unionByName(trained.select(F.col("representative").alias("one"), F.col("representative").alias("two")))
    near = links.join(trained, links["two"] == trained["representative"]).groupBy(F.col("one").alias("representative")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    moved = d.where("split = 'test' AND made").join(near, "representative").where((F.col("low") != F.col("family")) | (F.col("high") != F.col("family"))).select(F.col("family").alias(family)).distinct()
    moved = moved.withColumn("_moved", F.lit(True))
    return cases.join(moved, family, "left").withColumn(split, F.when(F.col("_moved"), "train").otherwise(F.col(split))).select(*cases.columns)
