r"""Chat formatting from an event log (operator 10), in DataFrame functions only.

``fold_events`` reconstructs conversations from a log of events ``conv_id, seq, message_id,
kind, role, text``:

* ``message`` starts a message, ``delta`` streams more text onto it, ``edit`` replaces its
  text, ``regenerate`` empties it and discards the later messages that the conversation
  had by then; deltas that follow build the new text.

A message's text is what its last ``message``, ``edit`` or ``regenerate`` event and the
deltas after it say; folding is thus a filter on a sorted list and needs no accumulator.
``render`` turns each message into ``[INST]role[/INST]text</s>`` behind one ``<s>``.

Control strings inside roles and texts are escaped by one backslash after their opening
sign (``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), which is undone exactly.
The loss mask lists, in code points of the formatted text, the span of each assistant text.

A conversation is the unit of output, hence of the last shuffle: each is assembled in one
task, and must fit into a string.  Everything else runs before that.

Defined results: null texts and roles are empty; a null conv_id is a conversation of its
own; rows that share a turn are all kept, by role and text; repeated rows are kept; an
empty log gives no rows; other columns than those named are not read.  An event for a message without a ``message`` event opens it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, cut, pieces_of

START, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"
RESETS = ("message", "edit", "regenerate")
_CONTROL = r"(<<?|\[)(\\*)(/?(?:s>|INST\]|SYS>>))"
_ESCAPED = r"(<<?|\[)\\(\\*)(/?(?:s>|INST\]|SYS>>))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log that leads to finished turns ``conv_id, turn, role, text``, as a chat service would write it.

    An assistant's message opens empty, is streamed in part, regenerated, and streamed in two
    deltas.  Any other message starts with the first half of its text and is edited to the whole.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text") - half)

    def step(kind: str, text: Column, role: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("role") if role is None else role.alias("role"), text.alias("text"))

    nothing = F.lit("")
    streamed = F.array(step("message", nothing, F.col("role")), step("delta", first), step("regenerate", nothing), step("delta", first), step("delta", rest))
    edited = F.array(step("message", first, F.col("role")), step("edit", F.col("text")))
    steps = F.when(F.col("role") == LEARNED_ROLE, streamed).otherwise(edited)
    numbered = rows.select("conv_id", number.alias("message_id"), steps.alias("steps"))
    logged = numbered.select("conv_id", "message_id", F.posexplode("steps").alias("at", "step"))
    return logged.select("conv_id", (F.col("message_id") * 8 + F.col("at")).alias("seq"), "message_id", "step.kind", "step.role", "step.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, place, role, text``; ``place`` orders a conversation's messages."""
    log = events.select(
        "conv_id",
        "message_id",
        "seq",
        F.coalesce(F.col("kind"), F.lit("delta")).alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    step = F.struct("seq", "kind", "role", "text")
    grouped = log.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("place"),
        F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.array_sort(F.collect_list(step)).alias("steps"),
    )
    live = F.filter("steps", lambda e: e["seq"] >= F.coalesce(F.col("reset"), F.col("place")))
    spoken = F.filter(F.transform("steps", lambda e: e["role"]), lambda r: r != "")
    cut = F.max("regenerated").over(
        Window.partitionBy("conv_id").orderBy("place", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        grouped.withColumn("cut", cut)
        .filter(F.col("cut").isNull() | (F.col("cut") < F.col("place")))
        .select(
            "conv_id",
            "place",
            "message_id",
            F.coalesce(F.get(spoken, F.lit(0)), F.lit("")).alias("role"),
            F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans array<struct<turn, start, length>>``, one row a conversation."""
    text = escape(F.col("text"))
    marked = messages.select(
        "conv_id",
        "place",
        "message_id",
        (F.col("role") == LEARNED_ROLE).alias("learned"),
        F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(BODY)).alias("head"),
        text.alias("body"),
    )
    inside = Window.partitionBy("conv_id").orderBy("place", "message_id")
    piece = F.concat("head", "body", F.lit(END))
    placed = marked.select(
        "conv_id",
        "learned",
        piece.alias("piece"),
        F.row_number().over(inside).alias("turn"),
        (F.sum(F.length(piece)).over(inside) + len(START) - F.length("body") - len(END)).alias("start"),
        F.length("body").alias("length"),
    )
    turn = F.struct("turn", "piece", "learned", "start", "length")
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    span = F.transform(
        F.filter("turns", lambda t: t["learned"]),
        lambda t: F.struct(t["turn"].alias("turn"), t["start"].alias("start"), t["length"].alias("length")),
    )
    formatted = F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    return turns.select("conv_id", formatted.alias("formatted"), span.alias("loss_spans"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Event log to training text: fold, then render."""
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns array<struct<role, text>>, loss_texts``: the template undone.

    Loss texts are cut out of the formatted text at the mask's start and length.
    """
    whole = F.substring("formatted", len(START) + 1, 2**31 - 1)
    pieces = F.split(whole, END)
    body = lambda p: F.substring_index(p, BODY, 1)  # noqa: E731  head and role
    split = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            body(p).substr(F.lit(len(HEAD) + 1), F.lit(2**31 - 1)).alias("role"),
            p.substr(F.length(body(p)) + len(BODY) + 1, F.lit(2**31 - 1)).alias("text"),
        ),
    )
    parted = formatted.select("conv_id", "formatted", "loss_spans", split.alias("raw"))
    return parted.select(
        "conv_id",
        "formatted",
        F.transform("raw", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        bound(
            F.struct(pieces_of(F.col("formatted")).alias("pieces"), "loss_spans"),
            lambda x: F.transform(x["loss_spans"], lambda s: unescape(cut(x["pieces"], s["start"], s["start"] + s["length"]))),
        ).alias("loss_texts"),
    )
