"""Texts with marks in the place of what a pattern finds, and where spans of one text lie in the other.

Each pass over a text leaves its edits: where it replaced what, and where that
lies afterwards, by running sums. A position is taken through a pass by a binary
search among its edits, and through several passes one after the other.
Positions count characters from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.windows import bound

from . import profile

_EDIT = "struct<start:int,end:int,to:int,size:int>"


def edits(text: Column, pattern: str, mark: str) -> Column:
    """start and end of each match, where it lies when matches are marks, and the mark's length, in order."""

    def placed(gaps: Column, found: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start, to = a["at"] + F.length(x["gap"]), a["to"] + F.length(x["gap"])
            end = start + F.length(x["m"])
            one = F.struct(start.alias("start"), end.alias("end"), to.alias("to"), F.lit(len(mark)).alias("size"))
            return F.struct(end.alias("at"), (to + len(mark)).alias("to"), F.concat(a["out"], F.array(one)).alias("out"))

        pairs = F.transform(found, lambda m, k: F.struct(F.get(gaps, k).alias("gap"), m.alias("m")))
        first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"), F.array().cast(f"array<{_EDIT}>").alias("out"))
        return F.aggregate(pairs, first, step, lambda a: a["out"])

    return bound(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), lambda s: placed(s["gaps"], s["found"]))


def masked(text: Column, passes: list[tuple[str, str]]) -> Column:
    """text, masked by each (pattern, mark) in turn, and `maps`, the edits of each pass. Null is empty."""

    def once(before: Column, pattern: str, mark: str) -> Column:
        put = F.lit(mark.replace("\\", "\\\\").replace("$", "\\$"))
        return bound(before, lambda s: F.struct(F.regexp_replace(s["text"], F.lit(pattern), put).alias("text"), F.concat(s["maps"], F.array(edits(s["text"], pattern, mark))).alias("maps")))

    out = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.array().cast(f"array<array<{_EDIT}>>").alias("maps"))
    for pattern, mark in passes:
        out = once(out, pattern, mark)
    return out


def _before(found: Column, position: Column, key: str) -> Column:
    """How many edits begin before the position: a binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found) + 1)).cast("int"))

    def half(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        less = F.get(found, middle)[key] < position
        settled = a["low"] >= a["high"]
        return F.struct(F.when(settled | ~less, a["low"]).otherwise(middle + 1).alias("low"), F.when(settled | less, a["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(found).alias("high")), half, lambda a: a["low"])


def _moved(position: Column, found: Column, back: bool, at_end: Column) -> Column:
    """A position after a pass (or before it, `back`); within what was replaced, that's begin or its end."""

    def by(e: Column) -> Column:
        here, there = (e["to"], e["start"]) if back else (e["start"], e["to"])
        size, other = (e["size"], e["end"] - e["start"]) if back else (e["end"] - e["start"], e["size"])
        within = F.when(at_end, there + other).otherwise(there)
        return F.when(e.isNull(), position).when(position < here + size, within).otherwise(position - here - size + there + other)

    return bound(_before(found, position, "to" if back else "start"), lambda k: by(F.when(k > 0, F.get(found, F.greatest(k - 1, F.lit(0))))))


def remapped(position: Column, maps: Column, at_end: bool, back: bool = False) -> Column:
    """Where a position of the text lies in the masked one, or the other way, `back`."""
    order = F.reverse(maps) if back else maps
    return F.aggregate(order, position.cast("int"), lambda p, found: _moved(p, found, back, F.lit(at_end)))


def remapped_spans(spans: Column, text: Column, after: Column, maps: Column) -> Column:
    """keyword, start, end, original_start, original_end of spans (keyword, start, end) in the masked text, by start and end, each once.

    Spans that don't lie in the text, or are empty, go. A span of which nothing
    is left is sought by its text, the nearest place to where it was, the first
    of two; if there is none it goes. A span without a keyword is known by its
    text, in lower case. The first character may begin a span.
    """
    none = F.array().cast("array<struct<keyword:string,start:int,end:int>>")
    given = F.struct(F.coalesce(spans, none).alias("spans"), text.alias("text"), F.length(text).alias("size"), after.alias("after"), maps.alias("maps"))
    return bound(given, lambda g: _all_remapped(g["spans"], g["text"], g["size"], g["after"], g["maps"]))


def _all_remapped(spans: Column, text: Column, size: Column, after: Column, maps: Column) -> Column:
    """`remapped_spans` of what is worked out once a row; a lambda would work it out anew for each span."""
    fit = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= size))

    def one(s: Column) -> Column:
        said = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        keyword = F.lower(F.trim(F.coalesce(F.nullif(s["keyword"], F.lit("")), said)))
        span = lambda a, b: F.struct(a.alias("start"), b.alias("end"), keyword.alias("keyword"), s["start"].alias("original_start"), s["end"].alias("original_end"))
        needle = F.lower(F.trim(said))

        def sought(a: Column) -> Column:
            places = F.array_sort(F.transform(profile.spans(F.lower(after), needle), lambda p: F.struct(F.abs(p - a).alias("far"), p.alias("p"))))
            return F.when(F.size(places) > 0, span(F.get(places, F.lit(0))["p"], F.get(places, F.lit(0))["p"] + F.length(needle)))

        both = F.struct(remapped(s["start"], maps, False).alias("a"), remapped(s["end"], maps, True).alias("b"))
        return bound(both, lambda x: F.when(x["b"] > x["a"], span(x["a"], x["b"])).otherwise(sought(x["a"])))

    order = F.array_sort(F.filter(F.transform(fit, one), lambda s: s.isNotNull()))

    def first(a: Column) -> Column:  # equal ones stand side by side
        same = lambda s, t: (t["start"] == s["start"]) & (t["end"] == s["end"]) & (t["keyword"] == s["keyword"])
        return F.filter(a, lambda s, k: (k == 0) | ~same(s, F.get(a, F.greatest(k - 1, F.lit(0)))))

    return F.transform(bound(order, first), lambda s: F.struct(s["keyword"].alias("keyword"), s["start"].alias("start"), s["end"].alias("end"), s["original_start"].alias("original_start"), s["original_end"].alias("original_end")))
