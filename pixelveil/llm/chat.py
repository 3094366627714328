"""Chat formatting with a grammar round trip, in DataFrame functions alone.

The grammar: a conversation is a row of turns, each ``<|im_start|>`` role newline text ``<|im_end|>`` newline. The
deterministic parser cuts at the control strings, and a turn ends at the first ``<|im_end|>``. A conversation is first
rendered as it is and parsed; if a text holds a control-like string, or the turns that come back differ from the source,
control-like strings are escaped and it is parsed again.
Escaping puts one more ``%`` after the ``<`` of any ``<%...%|``, so that no ``<|`` is left, and reading takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
END = STOP + "\n"
#: Role whose texts are under the loss mask.
LOSS_ROLE = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(%*)\|", "<%$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<%(%*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role also has its line feeds replaced, which end it."""
    return F.replace(F.regexp_replace(role, r"<(%*n?)\|", "<%$1|"), F.lit("\n"), F.lit("<%n|"))


def unescaped_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<%n|"), F.lit("\n")), r"<%(%*n?)\|", "<$1|")


def render(turns: Column) -> Column:
    """The text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds, unescaped; what stands after the first end string of a turn is in no text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    stop = lambda p: F.when(F.contains(p, F.lit(STOP)), F.instr(p, STOP)).otherwise(F.length(p) + 1)
    cut = lambda p: F.instr(p, "\n")
    one = lambda p: F.struct(unescaped_role(F.substring(p, F.lit(1), F.greatest(F.least(cut(p), stop(p)) - 1, F.lit(0)))).alias("role"), unescaped(F.substring(p, cut(p) + 1, F.greatest(stop(p) - cut(p) - 1, F.lit(0)))).alias("text"))
    return F.transform(parts, one)


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns, formatted, parsed, loss_spans, loss_texts`` per conversation.

    ``turns`` are the source's (role, text) in order of turn, ties by role and text; null roles, texts and turns count
    as empty, and null turns come first. Rows with a null id are one conversation. ``parsed`` is read back from
    ``formatted`` and always equals ``turns``, else the query fails. ``loss_spans`` are the places in ``formatted``
    (start from 0, length) of the assistant's texts as escaped there, ``loss_texts`` these unescaped. An empty table
    gives no rows. Other columns play no part. All turns of one conversation meet in one row, as its output does.
    """
    blank = F.lit("")
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # array_sort puts null turns inside structs first.
    out = out.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    out = out.withColumn("plain", render(F.col("turns")))
    control = F.exists("turns", lambda t: t["text"].rlike(r"<%*\|"))
    out = out.withColumn("kept", ~control & (parse(F.col("plain")) == F.col("turns")))
    safe = F.transform("turns", lambda t: F.struct(escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    out = out.withColumn("written", F.when(F.col("kept"), F.col("turns")).otherwise(safe))
    out = out.withColumn("formatted", F.when(F.col("kept"), F.col("plain")).otherwise(render(F.col("written"))))
    out = out.withColumn("parsed", parse(F.col("formatted")))
    same = F.assert_true(F.col("parsed") == F.col("turns"), F.concat(F.lit("the round trip failed for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    out = out.withColumn("formatted", F.when(same.isNull(), F.col("formatted")))
    size = lambda t: len(START) + F.length(t["role"]) + 1 + F.length(t["text"]) + len(END)
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    text_at = lambda acc, t: acc["at"] + len(START) + F.length(t["role"]) + 1
    step = lambda acc, t: F.struct((acc["at"] + size(t)).cast("bigint").alias("at"), F.when(t["role"] == LOSS_ROLE, F.array_append(acc["out"], F.struct(text_at(acc, t).cast("bigint").alias("start"), F.length(t["text"]).cast("bigint").alias("length")))).otherwise(acc["out"]).alias("out"))
    out = out.withColumn("loss_spans", F.aggregate("written", first, step, lambda acc: acc["out"]))
    cut = lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return out.withColumn("loss_texts", F.transform("loss_spans", cut)).select("conv_id", "turns", "formatted", "parsed", "loss_spans", "loss_texts")
