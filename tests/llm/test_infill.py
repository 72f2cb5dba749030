"""Fill-in-the-middle, held against a plain Python version of its definition."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.llm import infill

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = ["", None, " ", "a", " a", "a ", "\x0b\x0c\r\n\t ", "a b  c", "x<P>y z", "x <S> y", "<M", "<P", "< P> <", "a <X> <p>", "é ü\n\n日本 語 𝄞 𝄞𝄞 ", "<", "<<P", "a\0b \0", "ends with <", "tab\tnew\nline  two", "nul"]


def plain(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(seed=5, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(-9, 10**12), "".join(rng.choices(" \t\n\x0b\r ab<éß日𝄞PSM>", k=rng.randrange(0, 60)))) for _ in range(n)]


def test_rows_equal_the_definition(spark):
    rows = [(k, t) for t in ODD for k in range(9)] + made() + [(None, "null id here"), (7, "twice"), (7, "twice"), (8, "long " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = infill.fill_in_middle(docs.withColumn("draws", F.lit(1)).withColumn("output", F.lit("clash")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((d, *plain(d, t)) for d, t in rows), key=repr)
    back = out.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((d, t or "")) for d, t in rows)
    assert {r["form"] for r in out.collect()} == {"plain", "spm", "psm"}


def test_slices_and_offsets_of_a_batch(monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 50)
    rows = made(9, 200)
    draws = [[int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for d, _ in rows]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "draws": pa.array(draws, pa.list_(pa.int64()))}).slice(3, 150)
    got = [tuple(r.values()) for b in infill._cutter(iter([batch])) for r in b.to_pylist()]
    assert got == [(d, *plain(d, t)) for d, t in rows[3:153]]


def test_marks_over_the_end_of_a_text_are_none():
    data = np.frombuffer(b"a <P> b", np.uint8)
    marked, *_ = infill.cut_bytes(data, np.array([0, 4, 7]), np.zeros((2, 4), np.int64))
    assert marked.tolist() == [False, False]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")]])
def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = infill.digests(infill.fill_in_middle(docs)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n, r.form, r.output_sha256, r.restored_sha256) for r in got] == [(0, "plain", empty, empty)] * len(rows)
