"""Chat formatting from an event log: fold each conversation's events into messages, then render them.

Events are rows ``conversation, seq, kind, message, role, text``. A ``message`` event sets a message's
role and whole text, ``delta`` appends to its text, ``edit`` replaces the text, ``regenerate`` empties
it for the deltas that follow, and ``delete`` takes the message away. All of it is DataFrame functions.

Template: a turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Roles and texts are escaped
reversibly: a backslash is doubled, and one is put after the first character of each control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meldframe.llm.shared import require

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common templates, by what follows their first character.
_CONTROLS = (r"<(?=\||/?s>|<?/?SYS>>)", r"\[(?=/?INST\])")
TRAINED_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate", "delete")
EVENT_COLUMNS = ("seq", "kind", "message", "role", "text")


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for control in _CONTROLS:
        out = F.regexp_replace(out, f"({control})", r"$1\\")
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame, conversation: str) -> DataFrame:
    """``conversation, seq, role, text``: each message left at the end, with the seq of its first event.

    The log is dealt out by conversation and sorted by message and seq; nothing is shuffled again up to the rendered
    conversation. An event without a message identifier is a message of its own, if it brings text; without a kind
    it is a ``message``. A message's text is what its last reset (message, edit, regenerate) gave it and the deltas
    after that, in order of seq and, where that ties, deltas first, then by kind and text; the last role given stays. A
    NULL text is empty, a NULL role is ``''``. Events of unknown kind are ignored. Repeated rows count as often as
    they occur. Events of a NULL conversation are one conversation; an empty log gives an empty table.
    """
    require(events, conversation, *EVENT_COLUMNS)
    known = events.select(
        F.col(f"`{conversation}`").alias("conversation"),
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("message").cast("string").alias("owner"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("kind").isin(*KINDS) & (F.col("owner").isNotNull() | F.col("kind").isin("message", "delta", "edit")))
    own = F.coalesce(F.concat(F.lit("m"), "owner"), F.concat(F.lit("a"), F.monotonically_increasing_id().cast("string")))
    dealt = known.withColumn("message", own).drop("owner").repartition("conversation").withColumn("sets", (F.col("kind") != "delta").cast("int"))
    message = Window.partitionBy("conversation", "message")
    so_far = message.orderBy("seq", "sets", "kind", "text").rowsBetween(Window.unboundedPreceding, 0)
    live = dealt.withColumn("epoch", F.sum("sets").over(so_far)).withColumn("last", F.max("epoch").over(message))
    live = live.withColumn("first", F.min("seq").over(message)).withColumn("who", F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(message))
    folded = live.where("epoch = last").groupBy("conversation", "message").agg(
        F.min("first").alias("seq"),
        F.max("who.role").alias("role"),
        F.max(F.col("kind") == "delete").alias("gone"),
        F.array_sort(F.collect_list(F.struct("seq", "sets", "kind", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))).alias("steps"),
    )
    # The reset comes first whatever its kind: later events of its epoch are deltas of a greater seq.
    return folded.where("not gone").select(F.col("conversation").alias(conversation), "seq", F.coalesce("role", F.lit("")).alias("role"), F.array_join("steps.text", "").alias("text"))


def render(messages: DataFrame, conversation: str) -> DataFrame:
    """``conversation, formatted, loss``: a row a conversation, its turns by seq and, where that ties, by role
    and text. ``loss`` holds the spans, in characters with the end exclusive, of each assistant text.

    A conversation's text is one value of one row, so a conversation must fit in a row (2 GB).
    """
    key = F.col(f"`{conversation}`")
    turns = messages.select(key.alias("conversation"), "seq", "role", "text", escape(F.col("role")).alias("who"), escape(F.col("text")).alias("said"))
    turns = turns.withColumn("piece", F.concat(F.lit(TURN), F.col("who"), F.lit(TEXT), F.col("said"), F.lit(END)))
    so_far = Window.partitionBy("conversation").orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("stop", (F.sum(F.length("piece")).over(so_far) - len(END)).cast("int"))
    turn = F.struct("stop", (F.col("stop") - F.length("said")).alias("start"), (F.col("role") == TRAINED_ROLE).alias("trained"), "piece")
    gathered = turns.groupBy("conversation").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")))
    return gathered.select(F.col("conversation").alias(conversation), F.concat_ws("", "turns.piece").alias("formatted"), loss.alias("loss"))


def parse(formatted: DataFrame, text: str = "formatted", *, turns: str = "turns") -> DataFrame:
    """``formatted`` with the array ``turns`` of ``role, text``, read back from the rendered text alone."""
    pieces = F.filter(F.split(F.col(text), r"<\|end\|>"), lambda p: p != "")
    read = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), TEXT, 1)).alias("role"),
        unescape(F.substring_index(p, TEXT, -1)).alias("text"),
    )
    return formatted.withColumn(turns, F.transform(pieces, read))


def loss_text(text: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.concat_ws("", F.transform(loss, lambda x: unescape(F.substring(text, x["start"] + 1, x["stop"] - x["start"]))))


def from_turns(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """An event log that folds into one message for each row, as a streaming front end would have written it.

    What the trained role says is begun, streamed, thrown away by a regeneration and streamed again in two
    deltas; what others say is sent with its second half missing and put right by an edit. ``seq`` is the turn and
    the event's number in it: rows that share a turn are told apart by their message only. A NULL turn comes first.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = rows.select(F.col(f"`{conversation}`"), F.col(f"`{turn}`").alias("_turn"), F.col(f"`{role}`").cast("string").alias("_role"), whole.alias("_whole"), F.monotonically_increasing_id().cast("string").alias("message"))
    half = F.floor(F.length("_whole") / 2).cast("int")
    begin, rest = F.substring("_whole", F.lit(1), half), F.substring("_whole", half + 1, F.length("_whole"))
    nothing = F.lit(None).cast("string")
    event = lambda step, kind, who, said: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), who.alias("role"), said.alias("text"))
    streamed = F.array(
        event(0, "message", F.col("_role"), F.lit("")), event(1, "delta", nothing, rest), event(2, "regenerate", nothing, nothing), event(3, "delta", nothing, begin), event(4, "delta", nothing, rest)
    )
    sent = F.array(event(0, "message", F.col("_role"), begin), event(1, "edit", nothing, F.col("_whole")))
    log = own.withColumn("_event", F.explode(F.when(F.col("_role") == TRAINED_ROLE, streamed).otherwise(sent)))
    return log.select(conversation, F.struct(F.col("_turn").alias("turn"), F.col("_event.step").alias("step")).alias("seq"), "_event.kind", "message", "_event.role", "_event.text")
