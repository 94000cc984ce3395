"""Chat formatting with Spark expressions only.

The turn structs of a conversation are collected and sorted, adjacent turns of one role are merged
into one block by array functions, and the blocks are concatenated:

    <turn:ROLE>text<part>text</turn><turn:ROLE>text</turn>

Escaping is reversible and local: a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` inside roles and
texts (and ``>`` becomes ``\\g`` in roles), so ``<`` occurs in the output only where a mark begins, and reading back is a split and replacements.

``format_chats`` also returns ``segments``: the formatted string cut into pieces with a loss flag; their
concatenation is the formatted string, and the flag is set on assistant texts alone, never on marks.

Defined cases: null text and null role are empty strings; ties in ``turn`` are ordered by role, then
text; repeated rows are turns of their own; null ``turn`` sorts first; a null conv_id is a conversation;
an empty table gives an empty result; extra columns are ignored. Work for a conversation is linear in
its turns; a formatted conversation is one value, so it must fit a task, as its turns do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, CLOSE = "<part>", "</turn>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(c: Column) -> Column:
    """A role stands inside a mark, so its ``>`` is escaped too."""
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, formatted string, segments array<struct<text, loss>>."""
    own = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.withColumn("starts", F.expr("filter(sequence(1, size(ts)), i -> i = 1 or ts[i - 1].role <> ts[i - 2].role)"))
    convs = convs.withColumn("blocks", F.expr("transform(starts, (s, k) -> struct(ts[s - 1].role as role, transform(slice(ts, s, coalesce(get(starts, k + 1), size(ts) + 1) - s), t -> t.text) as texts))"))

    def segments(b: Column) -> Column:
        loss = b["role"] == loss_role
        head = F.struct(F.concat(F.lit("<turn:"), escape_role(b["role"]), F.lit(">")).alias("text"), F.lit(False).alias("loss"))
        parts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(F.struct(F.when(i > 0, F.lit(PART)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")), F.struct(escape(t).alias("text"), loss.alias("loss")))))
        return F.concat(F.array(head), parts, F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))))

    convs = convs.select("conv_id", F.filter(F.flatten(F.transform("blocks", segments)), lambda s: s["text"] != "").alias("segments"))
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""

    def block(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring(b, 7, 2_000_000_000), ">", 1))
        body = b.substr(F.instr(b, ">") + 1, F.length(b))
        return F.transform(F.split(body, PART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.flatten(F.transform(blocks, block))
