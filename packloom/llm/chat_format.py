"""Chat formatting: event logs folded into final messages, rendered with a loss mask, and read back.

Only DataFrame functions. A log is partitioned by conversation and sorted by sequence number; streamed
deltas, edits and regenerations fold into the messages they concern. Turns are rendered as

    ### role: text</turn>

and the characters the template needs are spelled ``\\b`` (backslash), ``\\l`` (<), ``\\h`` (#) and, in
roles, ``\\c`` (:) inside of texts, so no text can look like a mark and every text can be read back.

Defined cases: null texts and roles count as empty, a null conversation id is a conversation like any
other. Equal sequence numbers are ordered by message id, kind, role and text; a repeated 'message'
event is a message of its own. Events that concern a message nobody opened open it. An empty log gives
an empty result. Other columns are left out. A conversation is one string in the result, so it has to
fit one row; its size is the only thing that is not spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
_TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (":", "\\c"))


def _escape(value: Column, escapes: tuple = _TEXT_ESCAPES) -> Column:
    for plain, spelled in escapes:
        value = F.replace(value, F.lit(plain), F.lit(spelled))
    return value


def _unescape(value: Column, escapes: tuple = _TEXT_ESCAPES) -> Column:
    for plain, spelled in reversed(escapes):
        value = F.replace(value, F.lit(spelled), F.lit(plain))
    return value


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, place, role, text`` of ``conv_id, seq, message, kind, role, text`` events.

    Kinds: 'message' opens a message, 'delta' appends to it, 'edit' replaces its text, 'regenerate'
    empties it (or starts it over with a text) for the deltas that follow. ``place`` orders the
    messages of a conversation.
    """
    event = F.struct("seq", "message", F.expr("kind <> 'message'").alias("later"), "kind", "role", "text")
    logs = (
        events.select(
            "conv_id",
            "seq",
            "message",
            "kind",
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .groupBy("conv_id", "message")
        .agg(F.sort_array(F.collect_list(event)).alias("log"))
    )
    # Each opening starts a message; it lasts to the next opening of the same message id.
    begins = F.filter(
        F.sequence(F.lit(0), F.size("log") - 1),
        lambda i: (i == 0) | (F.get(F.col("log"), i)["kind"] == "message"),
    )
    spans = logs.select("conv_id", "log", F.posexplode(begins).alias("nth", "begin"), begins.alias("begins"))
    until = F.coalesce(F.get("begins", F.col("nth") + 1), F.size("log"))
    spans = spans.select("conv_id", F.slice("log", F.col("begin") + 1, until - F.col("begin")).alias("log"), "nth")
    resets = F.filter(
        F.sequence(F.lit(1), F.size("log")), lambda i: F.get(F.col("log"), i - 1)["kind"] != "delta"
    )
    last = F.coalesce(F.array_max(resets), F.lit(1))
    kept = F.slice("log", last, F.size("log") - last + 1)
    first = F.col("log")[0]
    return spans.select(
        "conv_id",
        F.struct(first["seq"].alias("seq"), first["message"].alias("message"), "nth").alias("place"),
        first["role"].alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` has, for each turn, the code points [start, end) of ``formatted`` that are under the
    loss mask, or null: the texts of ``loss_roles``.
    """
    order = ["place", "role", "text"]
    head = F.concat(F.lit("### "), _escape(F.col("role"), _ROLE_ESCAPES), F.lit(": "))
    turns = messages.select("conv_id", *order, head.alias("head"), _escape(F.col("text")).alias("body"))
    turns = turns.withColumn("block", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start)
    span = F.when(
        F.col("role").isin(*loss_roles),
        F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")),
    )
    rows = turns.select("conv_id", F.struct("start", "block", span.alias("span")).alias("turn"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame, *keep: Column) -> DataFrame:
    """Turns ``conv_id, turn, role, text, loss_text`` and ``keep`` from ``conv_id, formatted, loss_spans`` alone.

    ``loss_text`` is what the span cuts out of the formatted string, unescaped; null without a span.
    """
    blocks = F.split(F.col("formatted"), F.lit(END), F.lit(-1))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    both = F.arrays_zip(blocks.alias("block"), F.col("loss_spans").alias("span"))
    turns = formatted.select("conv_id", *keep, F.posexplode(both).alias("turn", "x"))
    kept = turns.columns[1:-2]
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("x.block") + len(END)).over(before), F.lit(0))
    span = F.col("x.span")
    colon = F.locate(":", F.col("x.block"))
    cut = F.substring(F.col("x.block"), (span["start"] - offset + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
    return turns.select(
        "conv_id",
        "turn",
        _unescape(F.substring(F.col("x.block"), F.lit(5), colon - 5), _ROLE_ESCAPES).alias("role"),
        _unescape(F.substring(F.col("x.block"), colon + 2, F.length("x.block"))).alias("text"),
        _unescape(cut).alias("loss_text"),
        *kept,
    )


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Training strings with their loss spans from an event log."""
    return render(fold_events(events), loss_roles)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` finds in each formatted conversation."""
    turns = read_back(formatted, F.length("formatted").cast("long").alias("formatted_chars"))
    listed = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "loss_text"))).alias("turns"),
        F.max("formatted_chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["loss_text"], F.lit(""))), "")
    return listed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
