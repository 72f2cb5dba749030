"""Fill-in-the-middle: texts are cut at token bounds into prefix, middle and suffix, and these are put in another order.

A token is a run of white space with the run of other characters behind it; what
white space ends a text is a token too. The cuts of all rows are found together:
the bytes of an Arrow column are looked up in a table of classes, a token starts
where a white byte follows another one or where a text starts, running sums of
the starts that begin anew with each text number the tokens, and a binary search
in them finds the bytes at which prefix and middle end. No text is looked at by
itself, and the outputs are gathered from the bytes of all.

Defined cases. Null texts are empty; an empty text and one that holds a mark are
`plain`, that is they stay as they are. A null id draws as the empty string.
Repeated rows are worked on each for itself and give equal rows. Columns besides
id and text aren't read, whatever their names. A text may hold any code points and
be of any length that a row can hold; tokens number by white space of ASCII only.
Work takes place on at most SLICE bytes at once, or on one text if it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the three parts, each of three bytes.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows of a hundred that are cut, and cut rows of a hundred whose suffix comes first.
CUT, SUFFIX_FIRST = 50, 80
SEED = "42"
#: Bytes of text that are worked on at once.
SLICE = 1 << 22
#: The class of each byte: 1 for the white space of ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_FORMS = ("plain", "spm", "psm")


def draws(doc_id: Column, seed: str = SEED) -> Column:
    """Four whole numbers below 2**32, which seed and id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def cut_bytes(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The kernel: tokens, form, characters of prefix and middle, and the outputs' bytes and offsets, of all rows.

    Row r's text is `data[offsets[r] : offsets[r + 1]]`, and `h[r]` its four draws. The first array tells which rows hold a mark.
    """
    begin, end = offsets[:-1], offsets[1:]
    white = CLASS[data]
    starts = np.empty(len(data), bool)
    starts[1:] = (white[1:] > white[:-1])  # white after another byte
    starts[begin[begin < end]] = True
    running = np.concatenate(([0], np.cumsum(starts, dtype=np.int64)))  # tokens that start before each byte
    before = running[begin]
    n = running[end] - before
    # a mark: its three bytes in one text
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.empty(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
    owner = np.searchsorted(offsets, at, "right") - 1
    marked = np.zeros(len(begin), bool)
    marked[owner[at + 3 <= end[owner]]] = True
    form = np.where((n == 0) | marked | (h[:, 2] % 100 >= CUT), 0, np.where(h[:, 3] % 100 < SUFFIX_FIRST, 1, 2))
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    byte = lambda k: np.where(k >= n, end, np.searchsorted(running[1:], before + k + 1))  # noqa: E731  where token k starts
    one, two = byte(np.minimum(a, b)), byte(np.maximum(a, b))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    # the outputs are gathered from the texts with the marks behind them
    whole = np.concatenate((data, np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)))
    p, s, m = len(data), len(data) + 3, len(data) + 6
    cut = form > 0
    spm = form == 1
    place = np.empty((len(begin), 6), np.int64)
    size = np.full((len(begin), 6), 3, np.int64)
    place[:, 0], place[:, 2], place[:, 4] = np.where(spm, s, p), np.where(spm, p, s), m
    place[:, 1], size[:, 1] = np.where(spm, two, begin), np.where(spm, end - two, one - begin)
    place[:, 3], size[:, 3] = np.where(spm, begin, two), np.where(spm, one - begin, end - two)
    place[:, 5], size[:, 5] = one, two - one
    place[~cut, 1], size[~cut, 1] = begin[~cut], (end - begin)[~cut]
    size[np.ix_(~cut, [0, 2, 3, 4, 5])] = 0
    out = whole[_ranges(place.ravel(), size.ravel())]
    out_offsets = np.concatenate(([0], np.cumsum(size.sum(1))))
    return marked, n, form, chars[one] - chars[begin], chars[two] - chars[one], out, out_offsets


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings; nulls are empty."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return ends, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, data = _texts(batch.column(1))
        draws_of = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        for at, to in _slices(ends, SLICE):
            offsets = ends[at : to + 1]
            _, n, form, prefix, middle, out, out_ends = cut_bytes(data[offsets[0] : offsets[-1]], offsets - offsets[0], draws_of[at:to])
            texts = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(out_ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
            plain = form == 0
            columns = [batch.column(0).slice(at, to - at), pa.array(n), pa.DictionaryArray.from_arrays(pa.array(form.astype(np.int8)), pa.array(_FORMS)).cast(pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), texts.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DDL.split(", ")])


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output: the text, cut and put in another order."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.withColumn("draws", draws(F.col("doc_id"), seed)).mapInArrow(_cutter, _DDL)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: no part holds a mark, so the marks are where it is split."""
    part = lambda k: F.element_at(parts, k)
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(F.concat(part(2), part(4), part(3)))


def digests(made: DataFrame) -> DataFrame:
    """Outputs and texts rebuilt from them, as digests."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS h FROM t),
c AS (SELECT *, len(tokens)::BIGINT AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
