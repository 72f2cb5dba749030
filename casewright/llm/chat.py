"""Chat formatting: turns to text with a loss mask, in built-in functions only.

Turns are collected as structs and sorted; neighbours of the same role become
one turn; arrays are joined to one string. The template is

    <|start|>ROLE<|message|>TEXT<|next|>TEXT<|end|>

where <|next|> parts the texts of merged turns. In roles and texts a backslash
is doubled and a backslash put behind the first character of every control
string (CONTROLS), so none of them is left and the escape can be undone.

Defined cases: null texts and roles are empty; a null turn sorts first; turns
with equal numbers go by role and text; repeated rows are turns of their own; a
null conv_id is a conversation; an empty table gives no rows; other columns are
not read. A conversation is a row of the result, so it must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
#: Prefixes of control strings of this and of other public templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The first character of a control string, where the rest follows.
_CONTROL = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]))"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """`text` without control strings; `unescape` undoes it."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """What `escape` was given."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and loss_spans (start, end) of each conversation.

    Spans count code points of `formatted`, end exclusive, and hold the escaped
    texts of the assistant.
    """
    part = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(part)).alias("turns"))

    def merged(turns: Column) -> Column:
        """One struct for each run of a role: the role and its texts, escaped."""
        starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, F.greatest(i - 1, F.lit(0)))["role"] != F.get(turns, i)["role"]))
        run = lambda f: F.transform(f, lambda i, k: F.struct(F.get(turns, i)["role"].alias("role"), F.transform(F.slice(turns, i + 1, F.coalesce(F.get(f, k + 1), F.size(turns)) - i), lambda t: escape(t["text"])).alias("texts")))
        return let(starts, run)

    def piece(m: Column, t: Column, j: Column) -> Column:
        before = F.when(j == 0, F.concat(F.lit(START), escape(m["role"]), F.lit(MESSAGE))).otherwise(F.lit(NEXT))
        after = F.when(j == F.size(m["texts"]) - 1, F.lit(END)).otherwise(F.lit(""))
        return F.struct(F.concat(before, t, after).alias("all"), F.char_length(before).alias("before"), F.char_length(after).alias("after"), (m["role"] == LOSS_ROLE).alias("loss"))

    def written(pieces: Column) -> Column:
        span = lambda starts: lambda p, k: F.when(p["loss"], F.struct((F.get(starts, k) + p["before"]).alias("start"), (F.get(starts, k + 1) - p["after"]).alias("end")))
        spans = let(prefix_sums(F.transform(pieces, lambda p: F.char_length(p["all"]).cast("bigint"))), lambda starts: F.array_compact(F.transform(pieces, span(starts))))
        return F.struct(F.array_join(F.transform(pieces, lambda p: p["all"]), "").alias("formatted"), spans.alias("loss_spans"))

    d = d.select(F.col("conv_id").alias(conv_id), let(F.col("turns"), lambda turns: let(F.flatten(F.transform(merged(turns), lambda m: F.transform(m["texts"], lambda t, j: piece(m, t, j)))), written)).alias("out"))
    return d.select(conv_id, "out.formatted", "out.loss_spans")


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) in a formatted string, as they were before merging."""
    blocks = F.filter(F.split(formatted, r"<\|start\|>"), lambda b: b != "")
    turn = lambda b: F.split(F.regexp_replace(b, r"<\|end\|>$", ""), r"<\|message\|>", 2)
    texts = lambda t: F.transform(F.split(t[1], r"<\|next\|>", -1), lambda x: F.struct(unescape(t[0]).alias("role"), unescape(x).alias("text")))
    return F.flatten(F.transform(F.transform(blocks, turn), texts))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    # four bytes a code point, so that a slice costs no more than its own length
    cut = lambda wide: lambda s: unescape(F.decode(F.substring(wide, s["start"].cast("int") * 4 + 1, (s["end"] - s["start"]).cast("int") * 4), "UTF-32"))
    return let(F.encode(formatted, "UTF-32"), lambda wide: F.array_join(F.transform(spans, cut(wide)), ""))


def digests(chats: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What formatted strings hold, read back from them."""
    lines = lambda back: F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = let(read_chats(F.col("formatted")), lambda back: F.struct(F.size(back).cast("bigint").alias("n"), F.sha2(lines(back), 256).alias("sha")))
    loss = let(loss_text(F.col("formatted"), F.col("loss_spans")), lambda t: F.struct(F.char_length(t).cast("bigint").alias("n"), F.sha2(t, 256).alias("sha")))
    d = chats.select(conv_id, turns.alias("t"), loss.alias("l"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return d.select(conv_id, F.col("t.n").alias("n_turns"), F.col("t.sha").alias("turns_sha256"), F.col("l.n").alias("loss_chars"), F.col("l.sha").alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
  length(regexp_replace(replace(text, chr(92), 'zz'), '<\||</?s>|<<SYS>>|<</SYS>>|\[/?INST\]', '\0z', 'g')) AS n,
  length(regexp_replace(replace(role, chr(92), 'zz'), '<\||</?s>|<<SYS>>|<</SYS>>|\[/?INST\]', '\0z', 'g')) AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN before = role THEN 8 ELSE 27 + r END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
