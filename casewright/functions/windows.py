"""Windows, sentences and clauses around keywords, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a sentence.
SENTENCE_ENDS = ".!?;\n。！？；"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(word: Column) -> Column:
    """A pattern that matches the word as it is."""
    return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def keyword_windows(text: Column, word: Column, radius: int = 28, ends: str = SENTENCE_ENDS) -> Column:
    """The text around each occurrence, `radius` characters to each side, cut at the ends of its sentence.

    Occurrences don't overlap; an empty word has none. Each window is made from
    the pieces between occurrences, cut to what a window can reach, so the work
    grows with the text and not with its square.
    """
    left_cut, right_cut = f"(?s)^.*[{ends}]", f"(?s)[{ends}].*$"
    joined = lambda parts: F.call_function("concat_ws", word, parts)

    def around(pieces: Column) -> Column:
        def window(i: Column) -> Column:
            first = F.greatest(F.lit(1), i - radius)
            before = F.right(joined(F.slice(pieces, first, i - first + 1)), F.lit(radius))
            after = F.left(joined(F.slice(pieces, i + 1, F.lit(radius + 1))), F.lit(radius))
            return F.concat(F.regexp_replace(before, left_cut, ""), word, F.regexp_replace(after, right_cut, ""))

        return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), window)).otherwise(F.array().cast("array<string>"))

    reach = lambda p: F.when(F.length(p) > 2 * radius, F.concat(F.left(p, F.lit(radius)), F.right(p, F.lit(radius)))).otherwise(p)
    pieces = F.transform(F.split(text, quoted(word)), reach)
    return F.when(F.length(word) > 0, bound(pieces, around)).otherwise(F.array().cast("array<string>"))


def sentences(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    """The text's sentences without their ends, trimmed; blank ones go."""
    return F.filter(F.transform(F.split(text, f"[{ends}]"), lambda s: F.trim(s)), lambda s: s != "")


def evidence(text: Column, words: Column, ends: str = SENTENCE_ENDS) -> Column:
    """Distinct sentences that hold one of the words, in order."""
    return F.array_distinct(F.filter(sentences(text, ends), lambda s: F.exists(words, lambda w: F.contains(s, w))))


def holds(texts: Column, terms: Column) -> Column:
    """Whether one of the texts has one of the terms."""
    return F.exists(texts, lambda t: F.exists(terms, lambda w: F.contains(t, w)))


def together(texts: Column, one: Column, two: Column) -> Column:
    """Whether one of the texts has a term of each list."""
    return F.exists(texts, lambda t: F.exists(one, lambda w: F.contains(t, w)) & F.exists(two, lambda w: F.contains(t, w)))
