"""Chat formatting: final messages folded from an event log, then rendered with a template that can be read back.

Events have conv_id, seq, turn, op, role, text. By op: ``message`` sets the text of its turn, ``delta`` appends to it, ``edit``
replaces it, ``regenerate`` replaces it and discards the later turns that were logged before. A null or unknown op counts as
message; a null text is empty, a null role too. Null conversation ids form a conversation, null turns a turn before all others.

A log may deliver an event more than once, and seq tells events of a turn apart: of several with one turn and seq a single one
applies, the strongest op (regenerate, edit, message, delta), then the greatest text, then the greatest role. So a replayed delta
is appended once, and the result does not depend on the order of rows. A null seq counts as earlier than every other. Deltas before
the last message, edit or regeneration of their turn are overwritten by it; deltas without one begin from an empty text. The role of a turn
is that of its last event that has one. An empty log gives no rows; long conversations and texts are taken whole.

Everything is a window, an aggregate or a string function: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: No control string can survive in a text: all begin with one of these. Each escape begins with a backslash and every
#: backslash is escaped, so undoing them in the opposite order gives back the text.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
#: Ops, the strongest last.
STRENGTH = ("delta", "message", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages."""
    op = F.when(F.col("op").isin(*STRENGTH), F.col("op")).otherwise("message")
    strength = F.array_position(F.array(*map(F.lit, STRENGTH)), op)
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(-(2**63)))
    e = events.select("conv_id", "turn", seq.alias("seq"), F.struct(strength.alias("strength"), F.coalesce("text", F.lit("")).alias("text"), "role", op.alias("op")).alias("event"))
    e = e.groupBy("conv_id", "turn", "seq").agg(F.max("event").alias("event")).select("conv_id", "turn", "seq", "event.op", "event.role", "event.text")
    turn = Window.partitionBy("conv_id", "turn")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("gone", F.when(F.col("turn").isNotNull(), F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).over(earlier)))
    e = e.withColumn("begin", F.max(F.when(F.col("op") != "delta", F.col("seq"))).over(turn))
    kept = e.where("(gone is null or seq > gone) and (begin is null or seq >= begin)")
    turns = kept.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): each turn between marks; the spans, in characters, hold the texts to learn from."""
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    m = messages.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    m = m.withColumn("span", F.when(F.col("role") == loss_role, F.struct(at.cast("int").alias("start"), F.char_length("body").alias("length"))))
    one = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece", "span"))).alias("m"))
    return one.select("conv_id", F.array_join(F.col("m.piece"), "").alias("formatted"), F.filter(F.col("m.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> from what ``render`` has written."""
    pieces = F.split(formatted, r"<\|end\|>")
    whole = F.filter(pieces, lambda p: p.startswith(START))
    parts = F.transform(whole, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|sep\|>", 2))
    return F.transform(parts, lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, escapes undone, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all taken from the rendered text."""
    back = rendered.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """A plain table of turns as an event log: every row is a message; rows of the same turn follow each other."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("turn", F.row_number().over(order).cast("bigint"))
    return c.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("op"), "role", "text")
