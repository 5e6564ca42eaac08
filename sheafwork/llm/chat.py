"""Chat formatting from an event log (DataFrame functions only).

Events of a conversation are sorted by their sequence and folded into final messages: a message opens, deltas are added to it,
an edit replaces its text, a regeneration empties it, a deletion drops it.  Messages are rendered to a template whose control
strings are escaped inside texts, and the rendered text can be read back exactly.

Events are grouped by (conversation, message), so that the events of one message meet in a row as its final text does, never by conversation alone, and rendered messages join their conversation by way of
blocks of messages; so a conversation that holds a third of all events is folded by many tasks and only its finished text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Messages in a block: rendered messages join block by block.
BLOCK = 512


def escape(text: Column) -> Column:
    """No control string is left in a text: a backslash is doubled, and one parts "<" from "|"."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As escape(), and a role stays on its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    line = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(line)


def fold(events: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: conv, message, nth, role, text.

    Kinds: open, delta, edit, regenerate, delete.  Events of a message count in the order of seq, then kind, role and text.  Every "open"
    starts a message of its own, so that repeated rows stay; nth numbers them.  Null texts are empty.  Events before the first open
    belong to a message with the first role given.  Unknown kinds count as deltas.  A message whose last event other than a delta is a deletion is dropped.
    """
    rank = F.when(F.col(kind) == "open", 0).when(F.col(kind) == "edit", 2).when(F.col(kind) == "regenerate", 1).when(F.col(kind) == "delete", 4).otherwise(3)
    event = F.struct(F.col(seq).alias("s"), rank.alias("k"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    grouped = events.groupBy(F.col(conv).alias("conv"), F.col(message).alias("message")).agg(F.array_sort(F.collect_list(event)).alias("ev"))
    opens = F.expr("filter(sequence(1, size(ev)), i -> i = 1 or ev[i - 1].k = 0)")
    spans = F.expr("transform(opens, (o, i) -> slice(ev, o, coalesce(get(opens, i + 1), size(ev) + 1) - o))")
    parts = grouped.withColumn("opens", opens).select("conv", "message", F.posexplode(spans).alias("nth", "ev"))
    at = F.expr("array_max(transform(ev, (e, i) -> if(e.k = 3, 0, i + 1)))")  # the last event that isn't a delta
    parts = parts.withColumn("at", at)
    last = F.expr("ev[greatest(at, 1) - 1]")
    rest = F.expr("array_join(transform(slice(ev, greatest(at, 1) + 1, size(ev)), e -> e.t), '')")
    first = F.when(last["k"] == 1, F.lit("")).otherwise(last["t"])
    who = F.expr("coalesce(get(filter(transform(ev, e -> e.r), r -> r is not null), 0), '')")
    return parts.where(last["k"] != 4).select("conv", "message", "nth", who.alias("role"), F.concat(first, rest).alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, segments (array of (text, loss)), formatted.

    ``messages`` has conv, message (its order), nth, role and text.  The segments make up ``formatted``; those with loss are what a model
    learns from: each text of ``learn_role``, escaped, without its marks.
    """
    lead = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body, tail = escape(F.col("text")), F.lit(f"{END}\n")
    seg = lambda t, on: F.struct(t.alias("text"), on.alias("loss"))
    learn = F.col("role") == learn_role
    one = F.array(seg(lead, F.lit(False)), seg(body, learn), seg(tail, F.lit(False)))
    block = F.floor(F.col("message") / BLOCK)
    pieces = messages.select("conv", block.alias("block"), F.struct("message", "nth", "role", "text", one.alias("seg")).alias("m"))
    join = lambda c: F.flatten(F.transform(F.array_sort(c), lambda x: x["seg"]))
    blocks = pieces.groupBy("conv", "block").agg(join(F.collect_list("m")).alias("seg"))
    convs = blocks.groupBy("conv").agg(join(F.collect_list(F.struct("block", "seg"))).alias("segments"))
    return convs.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), exactly as they went in."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    turn = lambda t: F.substr(t, F.lit(len(START) + 1))
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape_role(F.substring_index(turn(t), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(turn(t), r"^[^\n]*\n", "")).alias("text"),
        ),
    )


def table_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that could have led to it.

    By their number and role, turns come about in three ways: streamed in deltas; drafted, regenerated and streamed again; drafted, edited and
    continued by a delta. Folding the log gives every turn its own text back. Repeated turns are messages of their own, in the order of role and text; null roles and texts are empty.
    """
    rows = conversations.select("conv_id", F.col("turn").alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "message").orderBy("role", "text"))
    rows = rows.withColumns({"nth": nth.cast("long"), "half": F.ceil(F.length("text") / 2).cast("int")})
    head, tail = F.expr("substring(text, 1, half)"), F.expr("substring(text, half + 1)")
    event = lambda step, kind, text: F.struct((F.col("nth") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    nothing, draft = F.lit(""), F.concat(F.lit("draft: "), F.reverse(head))
    streamed = F.array(event(0, "open", nothing), event(1, "delta", head), event(2, "delta", tail))
    regenerated = F.array(event(0, "open", nothing), event(1, "delta", draft), event(2, "regenerate", nothing), event(3, "delta", head), event(4, "delta", tail))
    edited = F.array(event(0, "open", draft), event(1, "delta", tail), event(2, "edit", head), event(3, "delta", tail))
    way = F.pmod(F.coalesce(F.col("message"), F.lit(0)) + F.length("role"), F.lit(3))
    log = F.when(way == 0, streamed).when(way == 1, regenerated).otherwise(edited)
    return rows.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "message", "role", "e.seq", "e.kind", "e.text")


def format_conversations(events: DataFrame, **columns) -> DataFrame:
    """From log to rendered conversations: conv, segments, formatted."""
    return render(fold(events, **columns))
