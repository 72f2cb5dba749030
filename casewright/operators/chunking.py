"""Documents cut to overlapping chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import chunk_id, script_ratio


def overlapping(text: str, longest: int, overlap: int) -> list[str]:
    """Cuts of at most `longest` characters, at the last space, each going back by `overlap`.

    Where the last space lies within the overlap the cut is made at `longest`, so
    that every step gets on, also in scripts without spaces.
    """
    out, at = [], 0
    while len(text) - at > longest:
        end = text.rfind(" ", at, at + longest)
        if end - at <= overlap:
            end = at + longest
        out.append(text[at:end])
        at = end - overlap
    return [*out, text[at:]]


def cuts(text: Column, longest: int = 2000, overlap: int = 300) -> Column:
    """`overlapping` of a column, in Arrow batches: where a cut lies depends on the cut before it."""
    if not 0 <= overlap < longest:
        raise ValueError("overlap must be from 0 to below longest")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else overlapping(t, longest, overlap))

    return F.when(F.length(text) <= longest, F.array(text)).otherwise(cut(text))


def all_cuts(paragraphs: Column, longest: int = 2000, overlap: int = 300) -> Column:
    """The cuts of all paragraphs of a document in order, in its row; only rows with a long paragraph go through Python."""
    if not 0 <= overlap < longest:
        raise ValueError("overlap must be from 0 to below longest")

    @F.pandas_udf("array<string>")
    def cut(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ps: None if ps is None else [c for p in ps for c in overlapping(p, longest, overlap)])

    short = F.forall(paragraphs, lambda p: F.length(p) <= longest)
    return F.coalesce(F.when(short, paragraphs), cut(F.when(~short, paragraphs)))


def cleaned(text: Column, deletions: list[str] = ()) -> Column:
    """The text without what the patterns match, runs of blank lines as one, trimmed; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern in deletions:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"\n\s*\n", "\n\n"), r"^\s+|\s+$", "")


def chunks(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", longest: int = 2000, overlap: int = 300, least: int = 100, ratio: float = 0.0, script: tuple[str, str] = ("฀", "๿"), deletions: list[str] = ()) -> DataFrame:
    """key, chunk_index, chunk_id, content and char_count of the valid chunks of each document.

    Paragraphs end at blank lines. Chunks are numbered before those are left out
    that are too short or long or have too few characters of the script.
    """
    paragraphs = F.filter(F.transform(F.split(cleaned(F.col(text), deletions), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    d = docs.select(F.col(key), F.coalesce(F.col(source), F.lit("unknown")).alias("_source"), paragraphs.alias("_p"))
    c = d.select(key, "_source", F.posexplode(all_cuts(F.col("_p"), longest, overlap)).alias("chunk_index", "content"))
    n = F.length("content")
    return c.where(n.between(least, longest) & (script_ratio(F.col("content"), *script) >= ratio)).select(key, "chunk_index", chunk_id(F.col("_source"), F.col("content"), F.col("chunk_index")).alias("chunk_id"), "content", n.alias("char_count"))
