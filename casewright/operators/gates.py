"""Polarity, length and subject gates of detected codes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import adaptive_window, length_gate


@dataclass(frozen=True)
class Markers:
    """Lower-case words of the caller's language."""

    clause: list[str] = field(default_factory=list)
    negation: list[str] = field(default_factory=list)
    exceptions: list[str] = field(default_factory=list)
    own: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)
    reported: list[str] = field(default_factory=list)


def any_of(words: list[str]) -> str:
    """A pattern of the words as they are; one that never matches if there are none."""
    return "(?:" + "|".join(f"\\Q{w}\\E" for w in words) + ")" if words else "(?:[^\\s\\S])"


def _has(text: Column, words: list[str]) -> Column:
    return text.rlike(any_of(words)) if words else F.lit(False)


def negated(text: Column, word: Column, m: Markers, window: Column) -> Column:
    """Whether a negation lies before the word's first occurrence, within the window and its clause.

    An exception from the last negation to the end of the word undoes it.
    """
    at = F.instr(text, word)
    before = F.substring(text, F.greatest(F.lit(1), at - window), F.least(window, at - 1))
    clause = F.regexp_replace(before, f"(?s)^.*{any_of(m.clause)}", "")
    span = F.regexp_extract(clause, f"(?s)^.*({any_of(m.negation)}.*)$", 1)
    return (at > 0) & (span != "") & ~_has(F.concat(span, word), m.exceptions)


def polarity(found: DataFrame, m: Markers, mode: str = "balanced", least_severity: int = 3, other: float = 0.85, reported: float = 0.70) -> DataFrame:
    """`found` (text in lower case, matched, severity, maybe name) with gate_neg, gate_len, gate_sub, gate_total, and the share of its terms that is denied.

    A code's terms are its matched words and, where the text holds it, its name.
    Texts without the teller's own words are weaker, reported ones most so; that
    is only asked of severe codes. A code without matched words isn't negated.
    """
    text, window = F.col("text"), adaptive_window(F.col("text"), mode)
    terms = F.transform("matched", F.lower)
    if "name" in found.columns:
        named = (F.col("name") != "") & F.contains(text, F.lower("name"))
        terms = F.concat(terms, F.when(named, F.array(F.lower("name"))).otherwise(F.array().cast("array<string>")))
    hits, n = F.size(F.filter(terms, lambda k: negated(text, k, m, window))), F.size(terms)
    neg = F.when(n > 0, F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - 0.6 * hits / n))).otherwise(1.0)
    sub = F.when((F.col("severity") < least_severity) | _has(text, m.own), 1.0).when(_has(text, m.reported), reported).when(_has(text, m.other), other).otherwise(1.0)
    d = found.withColumns({"denied_share": F.when(n > 0, hits / n).otherwise(0.0), "gate_neg": F.round(neg, 4), "gate_len": length_gate(F.regexp_replace(text, r"^\s+|\s+$", "")), "gate_sub": sub})
    return d.withColumn("gate_total", F.round(F.col("gate_neg") * F.col("gate_len") * F.col("gate_sub"), 4))


def dampened(found: DataFrame) -> DataFrame:
    """`found` with gates: a negated code or another's case keeps at most 0.4 of its confidence."""
    weak = (F.col("gate_neg") < 0.8) | (F.col("gate_sub") < 1)
    return found.withColumn("confidence", F.when(weak, F.round(F.col("confidence") * F.least(F.lit(0.4), F.round(F.col("gate_neg") * F.col("gate_sub"), 2)), 4)).otherwise(F.col("confidence")))
