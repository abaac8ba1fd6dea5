"""Chat formatting from an event log: fold, order, render, mask.

An event is (conv_id, seq, msg_id, role, op, text). Events of a message fold in the order of
``seq``: ``message``, ``edit`` and ``regenerate`` set the text, ``delta`` appends to it. A
regeneration also discards the messages that began after the regenerated one and before the
regeneration. Messages are then ordered by their first event and rendered as::

    <|turn:ROLE|>TEXT<|end|>

Inside roles and texts a backslash becomes ``\\b``, ``<``, ``>`` and ``[`` become ``\\l``,
``\\g`` and ``\\s``, so no control string of this template or of bracket templates survives, and the
mapping is undone by replacing in the opposite order. The loss mask is a list of [start, end)
spans of code points of the rendered text, one for each assistant text.

Everything is DataFrame code. Folding is dealt out by message; only the rendering, whose
output is one value a conversation, brings the turns of a conversation together.

Edge cases: null texts and roles are empty; null conversation ids form one conversation; ties
of ``seq`` within a message fold in the order message, regenerate, edit, delta (then by text),
messages that began together go by role and text; an unknown operation appends; repeated rows are turns of their own if they have
their own ``msg_id``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings and escapes of the template (fixed values, in the order of escaping).
OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>"
#: Operations that set the text, in the order in which ties of ``seq`` are folded; deltas follow (fixed values).
SETTERS = ("message", "regenerate", "edit")
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("[", "\\s"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def events_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as an event log: one ``message`` event a row."""
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("seq"), F.monotonically_increasing_id().alias("msg_id"),
        F.col(role).alias("role"), F.lit("message").alias("op"), F.col(text).alias("text"),
    )


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages. seq is that of the first event.

    A message is gone if an earlier one was regenerated after it began: a running maximum over
    the messages of the conversation, in the order in which they began.
    """
    rank = F.array_position(F.array(*[F.lit(o) for o in SETTERS]), F.coalesce("op", F.lit("")))
    step = F.struct("seq", F.when(rank > 0, rank).otherwise(len(SETTERS) + 1).alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "role")
    lists = events.groupBy("conv_id", "msg_id").agg(
        F.array_sort(F.collect_list(step)).alias("steps"), F.min("seq").alias("began"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("began").rangeBetween(Window.unboundedPreceding, -1)
    lists = lists.withColumn("redone", F.max("again").over(earlier)).where(F.col("redone").isNull() | (F.col("redone") <= F.col("began")))
    text = F.aggregate(
        "steps", F.lit(""), lambda acc, e: F.when(e["rank"] > len(SETTERS), F.concat(acc, e["text"])).otherwise(e["text"])
    )
    roles = F.filter(F.transform("steps", lambda e: e["role"]), lambda r: r.isNotNull())
    return lists.select(
        "conv_id", F.element_at("steps", 1)["seq"].alias("seq"), F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), text.alias("text")
    )


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans); one shuffle, by conversation.

    Offsets come from a running sum in the order of the turns, so the work is linear.
    """
    body, name = escaped(F.col("text")), escaped(F.col("role"))
    parts = messages.select(
        "conv_id", "seq", "role", "text",
        F.concat(F.lit(OPEN), name, F.lit(CLOSE)).alias("_head"), body.alias("_body"),
    ).withColumn("_size", F.char_length("_head") + F.char_length("_body") + F.lit(len(END)))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    parts = parts.withColumn("_n", F.row_number().over(order)).withColumn(
        "_at", (F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).cast("long")
    )
    start = F.col("_at") + F.char_length("_head")
    span = F.when(F.col("role") == learned, F.struct(start.alias("start"), (start + F.char_length("_body")).alias("end")))
    piece = F.struct(F.col("_n"), F.concat("_head", "_body", F.lit(END)).alias("piece"))
    grouped = parts.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(piece)).alias("_pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans")
    )
    formatted = F.array_join(F.transform("_pieces", lambda p: p["piece"]), "")
    return grouped.select("conv_id", "n_turns", formatted.alias("formatted"), "loss_spans")


def format_conversations(events: DataFrame, learned: str = "assistant") -> DataFrame:
    return render(fold_messages(events), learned)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse rendered text: conv_id, turns (role, text) and the unescaped text under the mask."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), CLOSE, 1)
        text = F.substr(piece, F.char_length(role) + F.lit(len(OPEN) + len(CLOSE) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    masked = F.transform(
        "loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))
    )
    return formatted.select(
        "conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text")
    )
