"""Approximate nearest neighbours by a permutation index: vectors are stood for by the order of their nearest pivots.

Nearness is the inner product. Rows get one more component, so that all have the
same norm and the order by distance to a row is the order by inner product with
the query, whose further component is 0. Pivots are PIVOTS of the SAMPLE rows of
least hash, half of them far from each other; only these pass the driver, and every
row is indexed. A row's permutation is the list of the pivots from the
nearest to the farthest. Rows are dealt by hash to shards; in a shard, each pivot
has an inverted file that holds its place in the permutations of the shard's rows.
A query goes to every shard in blocks, adds up over the pivots' files how far its
own places are from the rows' (the footrule distance), and reranks by the exact
product the SHARE of the rows that are least apart, ties at the end included. With
the defaults that finds more than 0.95 of the true neighbours, also of vectors that
have no structure to prune by; `recall` measures it. No row is out of reach: what is
below the share is a matter of the measure, and shards of up to LEAST rows and
queries of fewer than `k` rows see them all.

Equal vectors are searched and found as one class, which carries its `k + 1` least
ids; its queries share its result. These least ids are found in steps that each
pass at most `k + 1` ids a key and task.

Defined cases. Vectors that are null, zero or hold null or non-finite components
take no part, nor do rows with a null id. Shorter vectors count as filled with
zeros. Equal rows (id and vector) count once; an id on several vectors is searched
for each, and no row of the query's id is found. Ties go to the smaller id. An
empty table gives an empty result. Columns besides id and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import skew_join, staged

PIVOTS, SAMPLE, SHARE = 192, 2048, 0.2
#: Rows of a shard that are reranked at least.
LEAST = 256
#: Shards hold about FEW rows while there are up to WIDE of them, and then grow up to MANY rows or BYTES.
FEW, WIDE, MANY, BYTES = 4096, 64, 65_536, 1 << 25
#: Rows and queries that are held against each other at once.
ROWS, QUERIES = 4096, 32
#: Keys that the ids of a vector are dealt to in the steps by which its least ids are found.
SALTS = (64, 8)
_KEY = ["k1", "k2"]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    rows = table.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})


def _least_ids(rows: DataFrame, keep: int) -> DataFrame:
    """The `keep` least ids of each vector. Each step's limit takes effect before its shuffle too."""
    ids = rows.select(*_KEY, "vec_id")
    for salts in (*SALTS, 1):
        ids = ids.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
        if salts == SALTS[0]:
            ids = ids.dropDuplicates([*_KEY, "salt", "vec_id"])
        place = F.row_number().over(Window.partitionBy(*_KEY, "salt").orderBy("vec_id"))
        ids = ids.withColumn("place", place).where(F.col("place") <= keep).drop("place", "salt")
    return ids.groupBy(*_KEY).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # `keep` ids at most


def choose_pivots(sample: np.ndarray, most: float, count: int) -> np.ndarray:
    """Rows of the sample, with their further component: half of them each as far as can be from the ones before, half as they come.

    The far ones cover all directions; the others tell rows apart where many lie close together.
    """
    lifted = np.hstack([sample, np.sqrt(np.maximum(0.0, most * most - (sample**2).sum(1)))[:, None]])
    picked, nearest = [0], lifted @ lifted[0]
    while len(picked) < min(count // 2, len(lifted)):
        nearest[picked] = np.inf
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, lifted @ lifted[picked[-1]])
    others = np.setdiff1d(np.arange(len(lifted)), picked)[: count - len(picked)]
    return lifted[[*picked, *others]]


def places(vectors: np.ndarray, pivots: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Each pivot's place in each vector's permutation."""
    norms = np.sqrt((vectors**2).sum(1))
    if query:  # only its direction matters
        near = (vectors * (most / norms)[:, None]) @ pivots[:, :-1].T
    else:
        near = vectors @ pivots[:, :-1].T + np.sqrt(np.maximum(0.0, most * most - norms**2))[:, None] * pivots[:, -1]
    order = np.argsort(-near, axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int16), order.shape), axis=1)
    return out


def footrule(files: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Distances of queries (rows) to the rows of the files (columns); `files[p]` holds pivot p's places."""
    out = np.zeros((len(asked), files.shape[1]), np.int32)
    apart = np.empty(out.shape, np.int16)
    for p, file in enumerate(files):
        np.subtract(file[None, :], asked[:, p, None], out=apart)
        np.abs(apart, out=apart)
        out += apart
    return out


class Shard:
    """The inverted files of a shard's rows, and its vectors for the reranking."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], pivots: np.ndarray, most: float, share: float, keep: int):
        self.vectors, self.ids, self.pivots, self.most, self.keep = vectors, ids, pivots, most, keep
        self.files = np.ascontiguousarray(np.concatenate([places(vectors[k : k + ROWS], pivots, most, False) for k in range(0, len(vectors), ROWS)]).T)
        self.count = min(len(vectors), max(LEAST, keep, int(np.ceil(share * len(vectors)))))

    def search(self, queries: np.ndarray) -> list[tuple[list[float], list[int]]]:
        """For each query, scores and ids of the nearest rows found, the nearest first."""
        asked = places(queries, self.pivots, self.most, True)
        apart = np.concatenate([footrule(self.files[:, k : k + ROWS], asked) for k in range(0, len(self.vectors), ROWS)], axis=1)
        limits = np.partition(apart, self.count - 1, axis=1)[:, self.count - 1]
        found = []
        for query, far, limit in zip(queries, apart, limits, strict=True):
            near = np.flatnonzero(far <= limit)
            score = np.einsum("ij,j->i", self.vectors[near], query)
            if len(near) > self.keep:
                good = score >= np.partition(score, len(score) - self.keep)[len(score) - self.keep]
                near, score = near[good], score[good]
            hits = sorted((-s, i) for s, m in zip(score.tolist(), near.tolist(), strict=True) for i in self.ids[m])[: self.keep]
            found.append(([-s for s, _ in hits], [i for _, i in hits]))
        return found


_FOUND = "k1 bigint, k2 bigint, scores array<double>, ids array<bigint>"
_FOUND_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])


def _searcher(pivots: np.ndarray, most: float, share: float, keep: int):
    """Rows (shard, asks, k1, k2, vector, ids), each shard's own rows before its queries."""
    width = pivots.shape[1] - 1

    def matrix(column: pa.Array) -> np.ndarray:
        return np.array([(*v, *[0.0] * (width - len(v))) for v in column.to_pylist()], np.float64).reshape(-1, width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, shard = None, [], [], None
        for batch in batches:
            numbers, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            bounds = np.flatnonzero(np.diff(numbers.astype(np.int64) * 2 + asks)) + 1
            for at, to in zip((0, *bounds), (*bounds, batch.num_rows), strict=True):
                if at == to:
                    continue
                part = batch.slice(at, to - at)
                if numbers[at] != number:
                    number, held, ids, shard = numbers[at], [], [], None
                if not asks[at]:
                    held.append(matrix(part.column(4)))
                    ids += part.column(5).to_pylist()
                    continue
                if not held:
                    continue  # a shard without rows
                if shard is None:
                    shard = Shard(np.concatenate(held), ids, pivots, most, share, keep)
                for k in range(0, part.num_rows, QUERIES):
                    block = part.slice(k, QUERIES)
                    found = shard.search(matrix(block.column(4)))
                    yield pa.RecordBatch.from_arrays([block.column(2), block.column(3), pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([i for _, i in found], pa.list_(pa.int64()))], schema=_FOUND_SCHEMA)

    return search


def nearest(table: DataFrame, k: int = 20, is_query: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found of each query.

    `is_query` says of the column `vec_id` which rows are queries; by default every twentieth.
    """
    asked = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    keep = k + 1  # a query's own row is among them
    rows = _hashed(_rows(table, vec_id, vector))
    one = rows.groupBy(*_KEY).agg(F.first("vector").alias("vector"), F.max(asked.cast("int")).alias("asks"))
    classes = staged(one.join(_least_ids(rows, keep), _KEY))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    count, most, width = classes.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vector"))).first()
    if not count:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = [r[0] for r in classes.orderBy("k1", "k2").select("vector").limit(SAMPLE).collect()]
    chosen = choose_pivots(np.array([(*v, *[0.0] * (width - len(v))) for v in sample], np.float64), most, pivots)
    shards = max(min(WIDE, -(-count // FEW)), -(-count // max(FEW, min(MANY, BYTES // (8 * width)))))
    own = classes.select(F.pmod(F.xxhash64(*_KEY), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), *_KEY, "vector", "ids")
    ask = classes.where(F.col("asks") == 1).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), *_KEY, "vector", F.array().cast("array<bigint>").alias("ids"))
    dealt = own.unionByName(ask).repartition(shards, "shard").sortWithinPartitions("shard", "asks", *_KEY)
    found = dealt.mapInArrow(_searcher(chosen, most, share, keep), _FOUND).repartition(*_KEY)
    pair = F.explode(F.arrays_zip("scores", "ids")).alias("pair")
    hits = found.select(*_KEY, pair).select(*_KEY, F.col("pair.scores").alias("score"), F.col("pair.ids").alias("vec_id"))
    order = [F.desc("score"), F.asc("vec_id")]
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy(*_KEY).orderBy(*order))).where(F.col("place") <= keep)
    best = best.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    queries = rows.where(asked).select(*_KEY, F.col("vec_id").alias("query_id")).dropDuplicates()
    best = best.join(queries.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("times")), _KEY)
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = skew_join(queries, staged(best), _KEY, "times").select("query_id", F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def exact(table: DataFrame, ids: list[int], k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The true result of the stated queries, by holding them against every row."""
    rows = _rows(table, vec_id, vector).dropDuplicates()
    ask = F.broadcast(rows.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")))
    score = F.aggregate(F.zip_with("query", "vector", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.join(ask, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(table: DataFrame, ids: list[int], k: int = 20, **how: object) -> float:
    """The share of the true neighbours of the stated queries (a few; the broadcast of `exact`) that are found."""
    found = nearest(table, k, is_query=F.col("vec_id").isin(ids), **how).select("query_id", "vec_id")
    true = exact(table, ids, k, how.get("vec_id", "vec_id"), how.get("vector", "embedding")).select("query_id", "vec_id")
    all_of = true.count()
    return true.join(found, ["query_id", "vec_id"]).count() / all_of if all_of else 1.0
