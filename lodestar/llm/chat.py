"""Chat formatting by event-sourced reconstruction, with built-in functions only.

A log holds events of conversations: a message grows by streamed deltas, an edit replaces what it said so far, a
regeneration empties it before new deltas come, and a removal takes it out. The events of each message are folded
in the order of their sequence numbers: what counts is the last edit or regeneration and the deltas after it.
The final messages of a conversation are then rendered in order into one text with marked turns.

Template, a turn: `### role: text</turn>` and a line feed. Control strings inside texts and roles are escaped, so
that neither marker can occur there: a backslash becomes two, `### ` becomes `\\h## ` and `</turn>` becomes
`\\l/turn>`; in a role a colon becomes `\\c` too. Reading back undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
DELTA, EDIT, REGENERATE, REMOVE = "delta", "edit", "regenerate", "remove"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("### "), F.lit("\\h## ")), F.lit("</turn>"), F.lit("\\l/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    """Doubled backslashes are paired from the left; between them only escapes are left."""
    plain = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":")))
    return F.array_join(plain, "\\")


def fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """Final messages: one row of keys, role, text per message that is not removed.

    events has the key columns, seq, kind, role and text. Among events of one seq the order is by kind, then text
    (ties and repeated rows count as often as they occur). A null text is empty, an unknown or null kind is a
    delta. The role is that of the first event of the message that names one. Only one message's events meet in a
    task's row; a long conversation is spread over its messages.
    """
    kind = F.when(F.col("kind").isin(EDIT, REGENERATE, REMOVE), F.col("kind")).otherwise(DELTA)
    one = F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != DELTA, i).otherwise(-1))
    log = log.withColumn("reset", F.array_max(resets))
    kept = F.filter("log", lambda e, i: (i > F.col("reset")) | ((i == F.col("reset")) & (e["kind"] == EDIT)))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    last = F.when(F.col("reset") >= 0, F.element_at("log", F.col("reset") + 1)["kind"])
    log = log.where(F.coalesce(last, F.lit(DELTA)) != REMOVE)
    return log.select(*keys, F.try_element_at(roles, F.lit(1)).alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, conv: str, order: list[str], loss_role: str = "assistant") -> DataFrame:
    """conv, formatted, loss_spans: one text per conversation, its messages sorted by the order columns.

    loss_spans are the parts of formatted (start, end in code points, end exclusive) that hold what loss_role
    says, markers excluded. A null role is rendered as an empty one, a null text as an empty one. A null
    conversation id is a conversation of its own. The result of a conversation is one text, so its messages meet
    in one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(HEAD), escape_role(role), F.lit(": ")), escape(text)
    turn = F.struct(*order, head.alias("head"), body.alias("body"), (role == loss_role).alias("loss"))
    turns = messages.groupBy(conv).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        stop = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("end")))
        return F.struct((stop + F.lit(len(END))).alias("at"), F.when(t["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return turns.select(conv, formatted.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered text."""
    parts = F.split(formatted, END, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    cut = lambda t: F.instr(t, ": ")
    return F.transform(turns, lambda t: F.struct(unescape(F.substring(t, F.lit(len(HEAD) + 1), cut(t) - len(HEAD) - 1)).alias("role"), unescape(F.substring(t, cut(t) + 2, F.length(t))).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def events_of(rows: DataFrame) -> DataFrame:
    """Event log (conv_id, message, seq, kind, role, text) of (conv_id, turn, role, text), in no order.

    A table of turns has only what was said in the end, so the log is that of a client that streams: every message
    begins with a draft that is regenerated, then a first delta comes that an edit replaces, then the rest. The
    sequence numbers run through the conversation; messages are ordered by turn, role and text.
    """
    message = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    draft = F.concat(F.reverse(F.substring("text", 1, 8)), F.lit(" ..."))
    steps = [
        (4, DELTA, F.substring(F.col("text"), half + 1, F.length("text"))),
        (1, REGENERATE, F.lit("")),
        (3, EDIT, F.substring(F.col("text"), F.lit(1), half)),
        (0, DELTA, draft),
        (2, DELTA, F.upper(F.substring("text", 1, 8))),
    ]
    first = F.col("message").cast("long") * len(steps)
    each = F.array(*(F.struct((first + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for k, kind, text in steps))
    return rows.withColumn("message", message).withColumn("event", F.explode(each)).select("conv_id", "message", "role", "event.seq", "event.kind", "event.text")


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans of a table with one row per turn, by way of its event log.

    Rows of one turn number (ties, repeated rows) are messages of their own, ordered by role and text; null turns
    come first. Other columns are not looked at.
    """
    slim = rows.select(*(F.col(f"`{c}`").alias(a) for c, a in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    events = events_of(slim.withColumn("text", F.coalesce("text", F.lit(""))))
    return render(fold(events, ["conv_id", "message"]), "conv_id", ["message"])
