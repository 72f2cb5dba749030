"""Phrase collocations: which runs of two to five words stand together far more often than chance, per language.

Texts are split into pieces, and equal pieces are one row with the number of
times they occur. Phrases are then counted three times over, each time in fewer
places, as no phrase is more frequent than its parts: first single words, then
pairs of words that may be frequent, by a hash, and at last all phrases in which
every pair may be. What may be frequent is told by a bitmap of a bounded number of
bits, which lets some rare ones through and no frequent one out; so it changes how
much is counted, never a count. Tasks add up equal phrases of a part of their
rows before they send them. The phrases of a hash bucket are added up by duckdb in
the task of that bucket; it holds MEMORY at most and spills to scratch files, which
only that task reads and which go with it. The counts of a phrase's parts are asked
for by shuffled requests, of which a heavy part's are met by a broadcast of bounded
size.

Scores are exact while 1000 * a * n has at most 38 digits, that is for any corpus
of fewer than 10**17 words. Defined cases. Null texts and texts without words
have no phrases, a null language is `und`, and repeated rows count as often as they occur.
An empty table gives an empty result. Columns besides the two aren't read,
whatever their names. Equal scores and counts are ordered by the phrase's bytes.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, skew_join, staged

LONGEST, FREQUENT, BEST = 5, 100, 2000
#: Bytes of pieces that a task codes at once, and words that it adds up at once.
CHUNK, AT_ONCE = 1 << 24, 1 << 20
#: Words of all pieces for a bucket, and the memory of its database.
PER_BUCKET, MEMORY = 1 << 22, "256MB"
#: Bits of a bitmap for each name in it, and at most.
BITS, MOST_BITS = 16, 1 << 27
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = ",;:!?\n\x0b\x0c\r"
_WIDE = 21  # bits of a word's number in a packed key: a part has fewer than 2**21 words


def pieces(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, piece (its words, one space between them), times and words (how many), a row for each piece."""
    plain = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _UPPER + _ENDS + "\t", _LOWER + "." * len(_ENDS) + " ")
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(plain, r"\.")).alias("piece"))
    rows = rows.withColumn("piece", F.btrim("piece")).where(F.col("piece") != "")
    rows = rows.withColumn("piece", F.when(F.contains("piece", F.lit("  ")), F.regexp_replace("piece", " +", " ")).otherwise(F.col("piece")))
    rows = rows.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))
    return rows.withColumn("words", F.char_length("piece") - F.char_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)


def _name_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\0"), word))


class Part:
    """Words in a row: their numbers, how many of a piece are left at each, and how often the piece occurs.

    A number stands for a word of a language, so phrases of two languages differ.
    """

    def __init__(self, number: np.ndarray, left: np.ndarray, times: np.ndarray, langs: np.ndarray, words: np.ndarray):
        self.number, self.left, self.times, self.langs, self.words = number, left, times, langs, words
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(f"{a}\0{w}".encode(), seed=42) for a, w in zip(langs, words, strict=True)), np.uint64, len(words))

    def pairs(self, allowed: Bitmap) -> tuple[np.ndarray, np.ndarray]:
        """Places at which a pair of words starts that may both be frequent, and the pairs' hashes."""
        fine = allowed.holds(self.hashes)[self.number]
        at = np.flatnonzero((self.left[:-1] > 1) & fine[:-1] & fine[1:])
        h = self.hashes[self.number[at]] * np.uint64(0x9E3779B97F4A7C15) ^ self.hashes[self.number[at + 1]]
        return at, h ^ (h >> np.uint64(31))

    def phrases(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct phrases of so many words that start at the places, as rows of numbers, and how often they occur."""
        columns = [self.number[at + k].astype(np.uint64) for k in range(size)]
        keys = [sum(c << np.uint64(_WIDE * j) for j, c in enumerate(columns[k : k + 3])) for k in range(0, size, 3)]
        order = np.lexsort(keys)
        first = np.concatenate(([True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))[: len(at)]
        start = np.flatnonzero(first)
        return np.array([c[order[start]] for c in columns]).astype(np.int64), _sums(self.times[at[order]], start)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0, np.int64)


class Bitmap:
    """Bits by hash: every name that was put in is held, and few others."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(self.bits - 1)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bitmap(names: DataFrame) -> Bitmap:
    """The bitmap of a column `hash`, which has MOST_BITS at most however many names there are."""
    count = names.count()
    bits = min(MOST_BITS, 1 << max(6, (BITS * count - 1).bit_length() if count else 6))
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = names.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    words, found = np.zeros(bits // 64, np.uint64), rows.toPandas()  # bits / 64 rows at most
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Bitmap(bits, words)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """The words of pieces (lang, piece, times), AT_ONCE of them at once; the last ones of a part are those that begin the next."""

    def coded(held: list[pa.RecordBatch]) -> Iterator[Part]:
        table = pa.Table.from_batches(held)
        split = pc.split_pattern(table.column(1).combine_chunks(), " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, lang = split.flatten().dictionary_encode(), table.column(0).combine_chunks().dictionary_encode()
        words, langs = (x.dictionary.to_numpy(zero_copy_only=False) for x in (flat, lang))
        piece = np.repeat(np.arange(len(counts)), counts)
        names, number = np.unique(lang.indices.to_numpy().astype(np.int64)[piece] << 32 | flat.indices.to_numpy(), return_inverse=True)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(piece))
        times = table.column(2).to_numpy()[piece]
        for at in range(0, len(number), AT_ONCE):
            to = min(at + AT_ONCE, len(number))
            upto = min(to + LONGEST - 1, len(number))
            used, here = (np.arange(len(names)), number[at:upto]) if len(names) < 1 << _WIDE else np.unique(number[at:upto], return_inverse=True)
            part = Part(here, left[at:upto], times[at:upto], langs[names[used] >> 32], words[names[used] & 0xFFFFFFFF])
            part.own = to - at
            yield part

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size >= CHUNK:
            yield from coded(held)
            held, size = [], 0
    if held:
        yield from coded(held)


_COUNTS = "lang string, phrase string, size int, times bigint"


def _rows(part: Part, numbers: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    phrases = [" ".join(p) for p in zip(*part.words[numbers].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part.langs[numbers[0]], pa.string()), pa.array(phrases, pa.string()), pa.array(np.full(len(phrases), len(numbers), np.int32)), pa.array(times)], names=["lang", "phrase", "size", "times"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        totals = np.bincount(part.number[: part.own], weights=None, minlength=len(part.words))
        sums = np.zeros(len(part.words), np.int64)
        np.add.at(sums, part.number[: part.own], part.times[: part.own])
        numbers = np.flatnonzero(totals)
        yield _rows(part, numbers[None, :], sums[numbers])


def _pairs(allowed: Bitmap):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            at, h = part.pairs(allowed)
            at, h = at[at < part.own], h[at < part.own]
            order = np.argsort(h)
            start = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(h)])
            yield pa.RecordBatch.from_arrays([pa.array(h[order[start]].view(np.int64)), pa.array(_sums(part.times[at[order]], start))], names=["hash", "times"])

    return pairs


def _phrases(allowed: Bitmap, allowed_pairs: Bitmap):
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            at, h = part.pairs(allowed)
            pair = np.zeros(len(part.number) + LONGEST, bool)  # whether one that may be frequent starts there
            pair[at[allowed_pairs.holds(h)]] = True
            run = np.flatnonzero(pair[: part.own])
            for size in range(2, LONGEST + 1):
                run = run[pair[run + size - 2]]
                if len(run):
                    yield _rows(part, *part.phrases(run, size))

    return phrases


def _counter(frequent: int, memory: str):
    """Phrases with counts (lang, phrase, size, times) of whole buckets to the frequent ones, added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(f"{scratch}/counts.duckdb", config={"threads": 1, "memory_limit": memory, "temp_directory": f"{scratch}/spill", "preserve_insertion_order": False}) as db:
            db.execute("CREATE TABLE counts (lang VARCHAR, phrase VARCHAR, size INTEGER, times BIGINT)")
            for batch in itertools.chain([first], batches):
                rows = pa.Table.from_batches([batch])  # noqa: F841  the database reads it by its name
                db.execute("INSERT INTO counts SELECT * FROM rows")
            found = db.sql(f"SELECT lang, phrase, size, sum(times)::BIGINT AS times FROM counts GROUP BY ALL HAVING sum(times) >= {frequent}")
            yield from found.to_arrow_reader(1 << 16)

    return count


def frequent_phrases(rows: DataFrame, frequent: int = FREQUENT, per_bucket: int = PER_BUCKET) -> DataFrame:
    """lang, phrase, size (words) and times of all phrases of one to five words that occur `frequent` times or more.

    `rows` are `pieces`; they are read three times, so they should be staged.
    """
    buckets = max(1, -(-(rows.agg(F.sum("words")).first()[0] or 0) // per_bucket))
    given = rows.select("lang", "piece", "times")
    counted = lambda part: given.mapInArrow(part, _COUNTS).repartition(buckets, "lang", "phrase").mapInArrow(_counter(frequent, MEMORY), _COUNTS)
    single = staged(counted(_single))
    words = bitmap(single.select(_name_hash(F.col("lang"), F.col("phrase")).alias("hash")))
    pairs = given.mapInArrow(_pairs(words), "hash bigint, times bigint").groupBy("hash").agg(F.sum("times").alias("times"))
    pairs = bitmap(staged(pairs.where(F.col("times") >= frequent).select("hash")))
    return single.unionByName(counted(_phrases(words, pairs)))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(1000), 4) * wide(a, 17) * wide(n, 17), wide(left, 17) * wide(right, 17))


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", frequent: int = FREQUENT, best: int = BEST, per_bucket: int = PER_BUCKET) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    rows = staged(pieces(docs, lang, text))
    totals = rows.groupBy("lang").agg(F.sum(F.col("times") * F.col("words")).alias("n"))
    counts = staged(frequent_phrases(rows, frequent, per_bucket))
    several = counts.where("size > 1")
    word = F.split("phrase", " ")
    run = lambda at, size: F.array_join(F.slice(F.col("word"), at, size), " ")
    # a phrase goes if one that is a word longer occurs as often: longer ones show in the steps between
    longer = several.where("size > 2").withColumn("word", word)
    longer = longer.select("lang", F.explode(F.array(run(F.lit(1), F.col("size") - 1), run(F.lit(2), F.col("size") - 1))).alias("phrase"), "times")
    longer = longer.groupBy("lang", "phrase").agg(F.max("times").alias("longer"))
    kept = staged(several.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("times"), F.lit(True))).drop("longer"))
    # the parts of each cut are asked for by lang and part
    cut = kept.withColumn("word", word).select("lang", "phrase", F.col("times").alias("a"), "size", "word", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = F.array(F.struct(F.lit(True).alias("left"), run(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    requests = cut.select("lang", "phrase", "a", "k", F.explode(parts).alias("asked")).select("lang", F.col("asked.part").alias("part"), "phrase", "a", "k", F.col("asked.left").alias("left"))
    asked = requests.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("requests"))
    answers = staged(counts.select("lang", F.col("phrase").alias("part"), "times").join(asked, ["lang", "part"]))
    met = skew_join(requests, answers, ["lang", "part"], "requests")
    side = lambda is_left: F.max(F.when(F.col("left") == is_left, F.col("times")))
    cuts = met.groupBy("lang", "phrase", "a", "k").agg(side(True).alias("l"), side(False).alias("r"))
    cuts = skew_join(cuts, staged(totals.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang").withColumn("cuts", F.col("kept") * (LONGEST - 1))), "lang", "cuts")
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    placed = numbered(scored, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")])
    first = staged(placed.groupBy("lang").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("phrases")))
    ranked = skew_join(placed, first, "lang", "phrases").withColumn("rank", F.col("number") - F.col("first") + 1).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
u AS (SELECT lang, w, count(*) AS m FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0 GROUP BY lang, w),
t AS (SELECT lang, sum(m * len(w))::HUGEINT AS n FROM u GROUP BY lang),
s AS (SELECT lang, w, m, unnest(generate_series(1, len(w))) AS i FROM u),
g AS (SELECT lang, w[i:i + k - 1] AS g, sum(m)::HUGEINT AS f FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY lang, w[i:i + k - 1] HAVING sum(m) >= 100),
c AS (SELECT * FROM g WHERE len(g) > 1),
x AS (SELECT lang, g[i:j] AS g, max(f) AS f FROM (SELECT lang, g, f, unnest(generate_series(1, len(g))) AS i FROM c), (SELECT unnest([2, 3, 4, 5]) AS j) WHERE j > i AND j <= len(g) AND j - i + 1 < len(g) GROUP BY lang, g[i:j]),
d AS (SELECT c.* FROM c LEFT JOIN x ON c.lang = x.lang AND c.g = x.g WHERE x.f IS NULL OR 100 * x.f < 100 * c.f),
k AS (SELECT lang, g, f, unnest(generate_series(1, len(g) - 1)) AS k FROM d),
v AS (SELECT k.lang, k.g, k.f AS a, k.k, l.f AS l, r.f AS r, t.n, (1000 * k.f * t.n) // (l.f * r.f) AS score FROM k JOIN g l ON l.lang = k.lang AND l.g = k.g[1:k.k] JOIN g r ON r.lang = k.lang AND r.g = k.g[k.k + 1:] JOIN t ON t.lang = k.lang),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS pick FROM v),
e AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM o WHERE pick = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM e)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000"""
