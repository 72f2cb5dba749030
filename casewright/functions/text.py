"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, the tokenizer used where none is injected."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def script_ratio(text: Column, first: str = "฀", last: str = "๿") -> Column:
    """The share of characters between two code points; 0 for an empty text."""
    other = F.length(F.regexp_replace(text, f"[{first}-{last}]", ""))
    return F.when(F.length(text) > 0, (F.length(text) - other) / F.length(text)).otherwise(0.0)


def chunk_id(source: Column, content: Column, index: Column) -> Column:
    """A stable id of a chunk: 12 hex digits of a digest of where and what it is."""
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws(":", source, F.substring(content, 1, 100), index.cast("string"))), 1, 12))


def cleaned_source(name: Column, suffixes: list[str]) -> Column:
    """A file name without the given suffixes, removed in their order; never empty."""
    out = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    for suffix in suffixes:
        out = F.regexp_replace(out, f"{suffix}$", "")
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), F.lit("unknown"))


def category_prefix(code: Column) -> Column:
    """F and Z codes by letter, other lettered codes whole, numbers by two digits."""
    return F.when(code.rlike("^[FZ]"), F.substring(code, 1, 1)).when(code.rlike("^[XTCIG]"), code).otherwise(F.substring(code, 1, 2))


def case_family(case_id: Column) -> Column:
    """A case's id without the marks of derived cases."""
    return F.regexp_replace(F.regexp_replace(case_id, r"_(PAR|ESC|SIM)_?\d*$", ""), r"_(POS|NEG)(_V\d+)?$", "")


def occurrences(text: Column, word: Column) -> Column:
    """How often a word occurs without overlap; an empty word never does."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")).otherwise(0)


def word_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    t = collapsed(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def sentence_class(text: Column, clauses: list[str], negations: list[str], own: list[str], other: list[str]) -> Column:
    """length, complexity, negated and actor of a text, from its size, commas and the caller's markers."""
    t = F.coalesce(text, F.lit(""))
    held = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = F.length(t) - F.length(F.translate(t, ",，", "")) + held(clauses)
    mine, theirs = held(own) > 0, held(other) > 0
    return F.struct(
        F.when(F.length(t) < 80, "short").when(F.length(t) > 200, "long").otherwise("medium").alias("length"), F.when(score <= 2, "simple").when(score >= 6, "complex").otherwise("moderate").alias("complexity"),
        (held(negations) > 0).alias("negated"), F.when(mine & theirs, "mixed").when(mine, "self").when(theirs, "other").otherwise("unclear").alias("actor"),
    )


def masked(text: Column, titles: list[str], places: list[str], spare: list[str] = ()) -> Column:
    """text and n: names behind titles, words behind place words, and dates put as marks, and how many there were.

    A name that holds one of the words to spare, as those of actors, stays.
    """
    quoted = lambda ws: "|".join(f"\\Q{w}\\E" for w in ws) or "[^\\s\\S]"
    keep = f"(?!\\S*(?:{quoted(spare)}))" if spare else ""
    marks = ((f"(?:{quoted(titles)}) ?{keep}\\S+", "[NAME]"), (f"(?:{quoted(places)}) ?{keep}\\S+", "[PLACE]"), (r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b", "[DATE]"))
    out, n = F.coalesce(text, F.lit("")), F.lit(0)
    for pattern, mark in marks:
        n = n + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, mark)
    return F.struct(out.alias("text"), n.alias("n"))


def length_gate(text: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.log10(F.length(text) / 10.0 + 1) + 0.5), 4)


def adaptive_window(text: Column, mode: str = "balanced") -> Column:
    """How far a gate looks back, in characters."""
    if mode == "fixed":
        return F.lit(30)
    low, high = {"balanced": (20, 32), "safety": (25, 35)}[mode]
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.length(text) * 0.15).cast("int")))


def masked_dates(text: Column) -> Column:
    """Numeric and ISO dates put as a mark."""
    return F.regexp_replace(text, r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b", "[DATE]")
