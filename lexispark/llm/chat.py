"""Chat formatting: conversations are rebuilt from their event logs, rendered, and given a loss mask.

All of it is DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm._spark import exact

#: A turn is ``<turn:ROLE>\nTEXT</turn>\n``. Only control strings hold a bare ``<``.
OPEN, MID, CLOSE = "<turn:", ">\n", "</turn>\n"
#: Kinds that replace what a message held; a delta appends to it.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<`` becomes ``\l``: no control string can occur inside a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    r"""As :func:`escape`, with ``>`` as ``\g`` since that ends the header."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column, role: bool = False) -> Column:
    r"""Inverse of the escapes: split at ``\\`` from the left, so that what remains are single escapes."""

    def plain(x: Column) -> Column:
        x = F.replace(x, F.lit("\\l"), F.lit("<"))
        return F.replace(x, F.lit("\\g"), F.lit(">")) if role else x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages: (conv_id, msg_id, role, text, seq).

    ``events`` has conv_id, msg_id, seq, kind, role and text. By sequence within a message, ``message``,
    ``edit`` and ``regenerate`` set its text, ``delta`` appends to it and ``delete`` removes the message
    (a later reset brings it back). The role is that of the last event that names one; a message stands
    where its first event stood.

    Null texts count as empty, unknown or null kinds as ``message``; null conversations, messages and
    sequence numbers are values like others (null sequence numbers come first). Events of one message
    with equal sequence numbers are taken in the order message, edit, regenerate, delta, delete, then by
    text and role; repeated rows are separate events. Empty logs give empty tables; further columns are
    ignored.

    Conversations are the partitioning key of every step, so one shuffle serves all; a window sorts, with
    spill, and texts that a later reset replaced are gone before anything is gathered.
    """
    df = exact(events, "conv_id", "msg_id", "seq", "kind", "role", "text")
    kinds = [*RESETS, "delta", "delete"]
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.lit("message"))
    df = df.select(
        "conv_id", "msg_id", "seq", "role", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
        F.array_position(F.array(*map(F.lit, kinds)), kind).cast("int").alias("k"),
    ).repartition("conv_id")
    message = Window.partitionBy("conv_id", "msg_id")
    order = message.orderBy("seq", "k", "text", "role")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select(
        "*",
        F.row_number().over(order).alias("n"),
        F.min("seq").over(message).alias("at"),
        F.last("role", ignorenulls=True).over(whole).alias("final_role"),
    )
    df = df.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(message))
    df = df.where((F.col("n") >= F.coalesce("reset", F.lit(0))) & (F.col("kind") != "delete"))
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return df.groupBy("conv_id", "msg_id").agg(
        F.first("final_role").alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.first("at").alias("seq")
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments, loss_spans.

    ``segments`` are the pieces that ``formatted`` consists of, each with its loss flag: that is the mask,
    linear in the conversation's length. ``loss_spans`` has the same mask as code point spans (end
    exclusive) of ``formatted``. Messages stand by seq, then msg_id, role and text; null roles and texts
    count as empty; a conversation without messages has no row.
    """
    df = exact(messages, "conv_id", "msg_id", "seq", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    df = df.select("conv_id", "msg_id", "seq", role.alias("role"), text.alias("text"), role.isin(*loss_roles).alias("loss"))
    df = df.withColumns({"head": F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MID)), "body": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy("seq", "msg_id", "role", "text")
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    df = df.withColumns(
        {
            "n": F.row_number().over(order),
            "start": F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) + F.length("head"),
        }
    )
    df = df.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "head", "body", "loss", "start"))).alias("t"),
    )
    flags = lambda t, text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform("t", lambda t: F.array(flags(t, t["head"], F.lit(False)), flags(t, t["body"], t["loss"]), flags(t, F.lit(CLOSE), F.lit(False))))
    )
    spans = F.transform(
        F.filter("t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("end"))
    )
    return df.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        segments.alias("segments"),
        spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), the inverse of :func:`render`."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    head = lambda x: F.instr(x, MID)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring(x, F.lit(len(OPEN) + 1), head(x) - F.lit(len(OPEN) + 1)), role=True).alias("role"),
            unescape(F.substring(x, head(x) + F.lit(len(MID)), F.length(x))).alias("text"),
        ),
    )


def masked(segments: Column) -> Column:
    """The text under the loss mask, unescaped, read from the rendered segments."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


# ---------------------------------------------------------------------------------------------- query

_ODD = "\\### Assistant: </turn> ok"


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted, and read back from what was formatted."""
    rows = exact(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    extra = spark.range(1, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(_ODD).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x"),
    ).select("conv_id", "x.*")
    rows = rows.unionByName(extra)
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.select("conv_id", F.row_number().over(place).alias("msg_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    done = render(reconstruct(events))
    turns, loss = parse(F.col("formatted")), masked(F.col("segments"))
    done = done.withColumns({"turns": turns, "loss": loss})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'))
                   + length(replace(replace(text, '\', '\\'), '<', '\l'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
