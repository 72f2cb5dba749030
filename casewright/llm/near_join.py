"""Similarity join of texts on word n-grams: MinHash bands, then exact Jaccard.

1. Texts that are equal are one node. Each node gets a key for each band: the
   minima of `rows` hash functions over its n-grams. Bands and rows are chosen
   from the recall that pairs at the limit shall have (`band_plan`): 31 bands of
   6 rows find two texts of similarity 0.8 with a probability of 0.9999.
2. Keys are shuffled. Nodes that share a key are tied to the least node of the
   key: a star, not all pairs. Components of the stars hold every candidate pair.
3. Candidates are compared in units of two blocks of nodes, which count exact
   intersections of whole n-gram sets as a product of incidence matrices, and
   return a row a node: its links there, and which node it hangs together with
   there. So no pair is ever a row. A component is cut into blocks of its own
   (about PARTS, of LEAST to MOST nodes and GRAMS n-grams at most), every two of
   which meet; or, where that would move more n-gram sets, its keys' nodes meet
   key by key, and a pair counts at the first key that it shares. A component
   of m nodes moves each set m / MOST times, or as often as its keys ask for;
   its comparisons are those of all its candidate pairs, as all are counted.
4. Links are added up, and the components of verified links are the classes.

Tables whose keys may be large (a band's key, a component, a class, an equal
text) are joined by `skew_join`, which broadcasts the heavy keys, so that no
task gets one key's rows.

Defined cases: a null text is empty; a text of fewer words than N has one n-gram
of all its words; a text without words has no links, and its copies are one
class; repeated rows and equal texts are copies, which share class and links;
an empty table gives no rows; the named columns alone are read. Nodes are known
by 64 bits: of n texts, about n**2 / 2**65 pairs are taken for copies by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, skew_join, staged

N, SIMILARITY = 5, 0.8
#: The share of pairs at the limit that bands shall find, and the most bands.
RECALL, MOST_BANDS = 0.9999, 32
#: Blocks that a component is cut into, nodes of a block, and n-grams of a block.
PARTS, LEAST, MOST, GRAMS = 32, 128, 2048, 2_000_000
#: Characters of text that a worker takes up at once, if not of one text.
_CHARS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_recall(similarity: float, bands: int, rows: int) -> float:
    """The probability that two texts share a band's key."""
    return 1 - (1 - similarity**rows) ** bands


def band_plan(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """bands and rows: the most rows, which give the fewest false candidates, with which `most` bands reach `recall`."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity))) if similarity < 1 else 1, 1)
    for rows in range(2, 65):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 1 - 1e-9) ** rows))
        if bands > most:
            break
        best = (max(1, bands), rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts in a row, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    flat, counts = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and pc.any(pc.equal(flat, "")).as_py():
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        flat, counts = flat.filter(pa.array(full)), np.bincount(owner, minlength=len(counts)).astype(np.int64)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    grams = np.maximum(counts - n + 1, np.minimum(counts, 1))
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(grams)))[:-1], grams) + np.arange(grams.sum())
    length = np.repeat(np.minimum(counts, n), grams)
    h = np.zeros(len(first), np.uint64)
    padded = np.concatenate((w, np.zeros(n, np.uint64)))
    for k in range(n):
        h = np.where(k < length, _mixed(h * _MIX + padded[first + k]), h)
    return h, grams


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about _CHARS characters."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(sizes))) // _CHARS
    cuts = [0, *(np.flatnonzero(np.diff(at[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _banding(n: int, bands: int, rows: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        odd, plus = rng.integers(0, 2**63, (2, bands * rows), dtype=np.uint64)
        odd = odd * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for part in _parts(batch, 2):
                h, grams = shingles(part.column(2), n)
                full = np.flatnonzero(grams)
                out = np.zeros((len(full), bands), np.uint64)
                starts = (np.cumsum(grams) - grams)[full]
                for band in range(bands) if len(full) else ():
                    key = np.full(len(full), band, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        key = _mixed(key * _MIX + np.minimum.reduceat(h * odd[k] + plus[k], starts))
                    out[:, band] = key
                offsets = np.concatenate(([0], np.cumsum(np.where(grams > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(grams.astype(np.int64)), lists], names=["id", "node", "size", "keys"])

    return keys


def _sets(n: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                h, grams = shingles(part.column(1), n)
                own = [np.unique(x) for x in np.split(h, np.cumsum(grams)[:-1])]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "grams"])

    return of


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `one` shares with each of `two`; sets hold distinct elements."""
    flat = np.concatenate([*one, *two])
    owner = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))) - 1 if len(flat) else np.zeros(0, np.int64)
    shared = np.bincount(column, minlength=1) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    both = np.zeros((len(one), len(two)), np.float32)
    width = 2048
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(edges) - 1):  # shared elements in columns of at most `width`
        o, c = owner[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * width
        left = o < len(one)
        a, b = np.zeros((len(one), width), np.float32), np.zeros((len(two), width), np.float32)
        a[o[left], c[left]] = 1
        b[o[~left] - len(one), c[~left]] = 1
        both += a @ b.T
    return both


def _roots(pairs: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """For each of n places the least place that it hangs together with by the pairs."""
    root = np.arange(n)
    a, b = pairs
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        if not open_.any():
            break
        # join the roots themselves, so that the next round carries on from them
        a, b = root[a[open_]], root[b[open_]]
    return root


def _verified(sets: list[np.ndarray], sides: np.ndarray, within: bool, least: float, band: int = -1, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set its links in a unit, and the first set that it hangs together with.

    sides: False for a set of the one block, True for one of the other; pairs
    are of unlike sides, or all pairs where `within`. With `keys` (a row of band
    keys for each set) a pair only counts if `band` is the first that it shares.
    """
    one = np.arange(len(sets)) if within else np.flatnonzero(~sides)
    two = one if within else np.flatnonzero(sides)
    links = np.zeros(len(sets), np.int64)
    if not len(one) or not len(two):
        return links, np.arange(len(sets))
    sizes = np.array([len(x) for x in sets], np.int64)
    both = _overlaps([sets[i] for i in one], [sets[i] for i in two])
    linked = both >= least * (sizes[one][:, None] + sizes[two][None, :] - both) - 1e-6
    if within:
        linked = np.triu(linked, 1)
    a, b = np.nonzero(linked)
    a, b = one[a], two[b]
    if keys is not None and len(a):
        first = np.concatenate([np.argmax(keys[a[k : k + 65536]] == keys[b[k : k + 65536]], axis=1) for k in range(0, len(a), 65536)])
        a, b = a[first == band], b[first == band]
    links += np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
    return links, _roots((a, b), len(sets))


def _verifying(least: float):
    """Units of rows (unit, band, one, other, node, block, keys, grams), in order."""
    names = ["node", "links", "root"]

    def settle(rows: list[tuple], unit: tuple) -> pa.RecordBatch:
        keys = np.array([r[3] for r in rows]) if unit[1] >= 0 else None
        links, root = _verified([r[1] for r in rows], np.array([r[2] for r in rows]), unit[2] == unit[3], least, unit[1], keys)
        nodes = np.array([r[0] for r in rows], np.int64)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[root[some]])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            grams, keys = batch.column(7), batch.column(6)
            offsets, values = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
            k_offsets, k_values = keys.offsets.to_numpy(), keys.values.to_numpy()
            for k, (unit, band, one, other, node, block) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)):
                if (unit, band, one, other) != at:
                    if len(held) > 1:
                        yield settle(held, at)
                    held, at = [], (unit, band, one, other)
                held.append((node, values[offsets[k] : offsets[k + 1]].copy(), block == other, k_values[k_offsets[k] : k_offsets[k + 1]].copy()))
        if len(held) > 1:
            yield settle(held, at)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node it hangs together with) from edges (a, b).

    Labels go to the neighbours' least and then jump along labels; each round is
    staged. Rounds grow with the logarithm of a chain's length; stars need two.
    A node of many neighbours, and a label of many nodes, are heavy keys of the
    joins, which `skew_join` deals with.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both)
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"), F.count(F.lit(1)).alias("degree")))
    while True:
        near = skew_join(both.withColumnRenamed("b", "node"), label, "node", "degree").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = staged(label.join(near, "node").select("node", "degree", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        held = moved.groupBy("root").agg(F.count(F.lit(1)).alias("held"))
        jump = staged(moved.select(F.col("node").alias("root"), F.col("root").alias("next")).join(held, "root"))
        fresh = staged(skew_join(moved, jump, "root", "held").select("node", "degree", "was", F.col("next").alias("root")))
        label = fresh.select("node", "root", "degree")
        if fresh.where("was <> root").isEmpty():
            return label.select("node", "root")


def _blocks(nodes: Column, grams: Column, least: int, most: int) -> Column:
    """How many blocks so many nodes with so many n-grams are cut into."""
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(nodes / PARTS)))
    return F.greatest(F.ceil(nodes / size), F.ceil(grams / GRAMS), F.lit(1)).cast("int")


def _meeting(rows: DataFrame) -> DataFrame:
    """Rows (unit, band, node, blocks, ...) once for each other block of their unit that their own meets."""
    d = rows.withColumn("block", F.pmod(F.xxhash64("node", "unit"), F.col("blocks")).cast("int")).withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select("unit", "band", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("other"), "node", "block")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, most_bands: int = MOST_BANDS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """id, node, copy_id, root, class_id and n_links of every row of `docs`.

    copy_id: the least id of an equal text; root, class_id: the least node, and
    the least id, of the texts that hang together by links; n_links: other texts
    of at least this similarity. `least` and `most` bound a block's nodes.
    """
    bands, rows = band_plan(similarity, recall, most_bands)
    d = docs.select(F.col(doc_id).cast("bigint").alias("id"), node_of(F.col(text)).alias("node"), F.col(text).cast("string").alias("text"))
    keyed = staged(d.mapInArrow(_banding(n, bands, rows), "id bigint, node bigint, size bigint, keys array<bigint>"))
    nodes = staged(keyed.groupBy("node").agg(F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.first("keys").alias("keys")))
    at_key = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = staged(at_key.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    stars = staged(skew_join(at_key.select("node", "key"), shared, "key", "m").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    found = components(stars)
    member = staged(found.join(nodes.select("node", "copy_id", "size"), "node"))
    whole = member.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("grams")).withColumn("blocks", _blocks(F.col("nodes"), F.col("grams"), least, most))
    # what a component moves by blocks of its own, and what it would move key by key
    each = _blocks(F.col("m"), F.col("m") * F.col("grams") / F.col("nodes"), least, most)
    apart = shared.join(found, shared["a"] == found["node"]).join(whole.where("blocks > 1"), "root").withColumn("key_blocks", each)
    cost = apart.groupBy("root").agg(F.sum(F.col("m") * F.col("key_blocks")).alias("moved"))
    whole = staged(whole.join(cost, "root", "left").withColumn("by_key", F.coalesce(F.col("moved") < F.col("nodes") * F.col("blocks"), F.lit(False))).drop("moved"))
    split = skew_join(member.select("node", "root"), whole, "root", "nodes")
    units = _meeting(split.where("not by_key").select(F.col("root").alias("unit"), F.lit(-1).alias("band"), "node", "blocks")).withColumn("keys", F.array().cast("array<bigint>"))
    if not whole.where("by_key").isEmpty():
        keys = staged(apart.join(whole.where("by_key").select("root"), "root", "left_semi").select("key", "m", F.col("key_blocks").alias("blocks")))
        met = _meeting(skew_join(at_key, keys, "key", "m").select(F.col("key").alias("unit"), "band", "node", "blocks"))
        units = units.unionByName(met.join(nodes.select("node", "keys"), "node"))
    texts = d.select(F.col("id").alias("copy_id"), "node", "text")
    wanted = member.select("node", "copy_id")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    ours = texts.join(wanted, [texts["node"] == wanted["node"], texts["copy_id"].eqNullSafe(wanted["copy_id"])], "left_semi")
    grams = staged(ours.select("node", "text").mapInArrow(_sets(n), "node bigint, grams array<bigint>").groupBy("node").agg(F.first("grams").alias("grams")))
    meets = units.join(grams, "node").select("unit", "band", "one", "other", "node", "block", "keys", "grams")
    at = ["unit", "band", "one", "other"]
    dealt = meets.repartition(*at).sortWithinPartitions(*at)
    verified = staged(dealt.mapInArrow(_verifying(similarity), "node bigint, links bigint, root bigint"))
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(verified.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    placed = staged(roots.join(member.select("node", "copy_id"), "node").join(links, "node"))
    classes = staged(placed.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("nodes")))
    linked = skew_join(placed.select("node", "root", "n_links"), classes, "root", "nodes").select("node", "root", "class_id", "n_links")
    about = nodes.select("node", "copy_id", "copies").join(linked, "node", "left")
    alone = F.col("root").isNull()
    about = about.select("node", "copies", "copy_id", F.coalesce("root", "node").alias("root"), F.when(alone, F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return skew_join(keyed.select("id", "node"), staged(about), "node", "copies").select("id", "node", "copy_id", "root", "class_id", "n_links")


def node_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, copy_id, class_id, n_links of every row."""
    return similar(docs, doc_id, text, **how).select(F.col("id").alias(doc_id), "copy_id", "class_id", "n_links")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class, that with the least id, with the columns of `docs`.

    What goes is found by (id, text): the few keys are broadcast if their count
    is within BROADCAST_ROWS, else both sides are dealt by the key, the heavy
    keys being broadcast.
    """
    mark = lambda i, node: F.xxhash64(i, node)
    about = staged(similar(docs, doc_id, text, **how))
    first = F.struct(F.col("id").isNull().alias("late"), "id", "node")
    best = staged(about.groupBy("root").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = skew_join(about.select("id", "node", "root"), best, "root", "n")
    stays = (F.col("best.id").eqNullSafe(F.col("id"))) & (F.col("best.node") == F.col("node"))
    keys = staged(rows.groupBy(mark(F.col("id"), F.col("node")).alias("mark")).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("times")).where("not stays or times > 1"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark(F.col(doc_id).cast("bigint"), node_of(F.col(text))).alias("mark"))
    d = skew_join(keyed, keys, "mark", "times", "left")
    once = d.where("stays is null").select("row")
    twice = d.where("stays").groupBy("mark").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(twice).select("row.*")
