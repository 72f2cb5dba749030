"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Documents are tokenized where they lie. Full windows are cut off a document's
front; what is left, in pieces of at most PIECE tokens by then, is dealt by a
hash to groups of about GROUP pieces, whatever files or tasks they come from, so
the same documents always give the same windows. Only the pieces' numbers are
moved, not their tokens, unless these are asked for; pieces that are alike are
one row with a count until they are dealt, so no document makes a group large.

A group is dealt to k windows by largest differencing (Karmarkar and Karp,
1982): partial partitions are tuples of k sums, the two with the largest spread
are merged with opposing imbalances, until one is left with near-equal sums. k
begins at the least number of windows that could hold the group and rises
whenever a window would exceed its capacity.

Defined cases: a null text is an empty text, which is the closing id alone;
repeated rows are documents of their own; a document of any length is cut; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import repeated, staged

WINDOW = 1024
#: Longest piece of what is left of a document, and pieces that are packed together.
PIECE, GROUP = 256, 2048
#: Words, numbers and signs of the vocabulary's own rule; white space runs of
#: more than one character need the whole rule, which is far slower.
_SIMPLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_DOUBLE = re.compile(r"\s\s|\s\Z")
# Fixed value: the special token that byte_bpe_50k.json adds to the ranks.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class Encoder:
    """Ids of the byte-level vocabulary `byte_bpe_50k`; the special string is one id.

    The same vocabulary as ranks, in the faster of the two libraries; the tests
    hold its ids against those of the other. That one cuts a text at the special
    string first and splits each part by itself.
    """

    def __init__(self) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        make = lambda name, rule: tiktoken.Encoding(name, pat_str=rule, mergeable_ranks=ranks, special_tokens={})
        self.whole, self.simple = make("whole", public_tokenizers.PATTERN), make("simple", _SIMPLE)

    def _plain(self, text: str) -> list[int]:
        return (self.whole if _DOUBLE.search(text) else self.simple).encode_ordinary(text)

    def __call__(self, text: str) -> np.ndarray:
        first, *others = text.split(SPECIAL)
        ids = self._plain(first)
        for part in others:
            ids += [SPECIAL_ID, *self._plain(part)]
        return np.array([*ids, 0], "<u4")


@functools.lru_cache(maxsize=1)
def encoder() -> Encoder:
    """The encoder of this process, which its tasks share."""
    return Encoder()


def differencing(sizes: list[int], k: int) -> tuple[list[list[int]], int]:
    """Indices of `sizes` in k parts with near-equal sums, and the largest sum.

    A tuple holds its sums from the largest down, and for each a node: an item,
    or a pair of nodes, or none.
    """
    heap, tuples, pairs, n = [], {}, [], len(sizes)
    for i, size in enumerate(sizes):
        heap.append((-size if k > 1 else 0, i))
        tuples[i] = (np.array([size], np.int64), np.array([i], np.int64))
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = tuples.pop(a), tuples.pop(b)
        over = len(sa) + len(sb) - k
        if over <= 0:
            sums, nodes = np.concatenate((sa, sb)), np.concatenate((na, nb))
        else:  # the smallest of one part meet the largest of the other, in opposite order
            x, y = len(sa) - over, len(sb) - over
            joined = sa[x:] + sb[y:][::-1]
            ids = np.arange(over) + (n + len(pairs))
            pairs += zip(na[x:].tolist(), nb[y:][::-1].tolist(), strict=True)
            sums, nodes = np.concatenate((sa[:x], sb[:y], joined)), np.concatenate((na[:x], nb[:y], ids))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        tuples[number] = (sums, nodes)
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), number))
        number += 1
    sums, nodes = tuples[heap[0][1]]
    parts = []
    for node in nodes.tolist():
        items, open_ = [], [node]
        while open_:
            x = open_.pop()
            if x < n:
                items.append(x)
            else:
                open_ += pairs[x - n]
        parts.append(sorted(items))
    return parts, int(sums[0])


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Indices of `sizes` by window; no window holds more than `capacity`."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts, most = differencing(sizes, k)
        if most <= capacity:
            return parts
        k += 1


_PIECE_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_DDL = _PIECE_DDL + ", sequence_id bigint, offset bigint"
_IDS = ", ids array<int>"
#: Sequences of a group have numbers of their own up to this.
_OF_GROUP = 1 << 24


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = pa.schema([(c.split()[0], pa.list_(pa.int32()) if "array" in c else pa.int64()) for c in ddl.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _cutter(capacity: int, piece: int, ddl: str):
    with_ids = ddl.endswith(_IDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                n, at = len(ids), 0
                while at < n:
                    size = capacity if n - at >= capacity else min(piece, n - at)
                    part = ids[at : at + size]
                    rows.append((doc_id, at, size, zlib.crc32(part.tobytes()), n, *((part.astype(np.int32),) if with_ids else ())))
                    at += size
            if rows:
                yield _table(rows, ddl)

    return cut


def _packer(capacity: int, ddl: str):
    """Rows (group, piece...) in the order of groups, to pieces with their sequence and offset."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def settle() -> pa.RecordBatch:
            out, number = [], group * _OF_GROUP
            full = [x for x in held if x[2] == capacity]
            loose = [x for x in held if x[2] < capacity]
            for x in full:
                out.append((*x[:5], number, 0, *x[5:]))
                number += 1
            for part in windows([x[2] for x in loose], capacity):
                at = 0
                for i in part:
                    out.append((*loose[i][:5], number, at, *loose[i][5:]))
                    at += loose[i][2]
                number += 1
            return _table(out, ddl)

        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group and held:
                    yield settle()
                    held = []
                group = g
                held.append(tuple(row))
        if held:
            yield settle()

    return pack


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = WINDOW, piece: int = PIECE, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: where it lies in it, and in which window.

    `with_ids` adds the ids themselves.
    """
    part = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    more = _IDS if with_ids else ""
    pieces = part.mapInArrow(_cutter(capacity, piece, _PIECE_DDL + more), _PIECE_DDL + more)
    key = [c.split()[0] for c in _PIECE_DDL.split(", ")]
    alike = staged(pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *([F.first("ids").alias("ids")] if with_ids else [])))
    total, most = alike.agg(F.sum("rows"), F.max("rows")).first()
    groups = max(1, -(-(total or 0) // group))
    rows = repeated(alike, "rows", most=most or 0).withColumn("group", F.pmod(F.xxhash64(*key, "n"), F.lit(groups)))
    dealt = rows.repartition("group").sortWithinPartitions("group", F.desc("length"), *key, "n")
    return dealt.select("group", *key, *(["ids"] if with_ids else [])).mapInArrow(_packer(capacity, _DDL + more), _DDL + more)
