"""Multi-party chat formatting by perspective rotation, with DataFrame and SQL functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, all others as named users, and system turns as they are. The mask marks the messages
(and the spans the characters) to train on: those of the speaker.

A rendering is one text. It is delivered in parts, each of the turns of one range of turn numbers,
so that a conversation with a large share of all rows is no single row; the parts tell where in the
whole they begin, and their spans count from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import Workspace

#: Turns of a part of a rendering.
SEGMENT = 256
SYSTEM, ASSISTANT = "system", "assistant"


def _safe(text: Column) -> Column:
    """Text in which the message markers do not occur."""
    return F.replace(text, F.lit("<|im_"), F.lit("<|_im_"))


def _safe_name(role: Column) -> Column:
    """A role as a name in a message's head: no markers, no line breaks."""
    return _safe(F.translate(role, "\r\n", "  "))


def _name_to_others(role: Column) -> Column:
    """What the head of a message says where its role isn't the speaker."""
    return F.when(role == SYSTEM, SYSTEM).otherwise(F.coalesce(F.concat(F.lit("user name="), _safe_name(role)), F.lit("user")))


def _starts(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(s_conv_id, s_speaker, s_segment, s_piece, start): the characters of a speaker's rendering before each part.

    A part has one length to those who don't speak in it; the names in the heads change that of others.
    The window is over a row per part, some hundred times fewer than turns.
    """
    part = ["conv_id", "segment", "piece"]
    fixed = len("<|im_start|>\n<|im_end|>\n")
    length = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["text"]) + F.length(_name_to_others(m["role"])) + fixed)
    lengths = segments.select(*part, length.alias("size"))
    spoken = segments.select(*[F.col(c).alias(f"o_{c}") for c in part], F.explode("messages.role").alias("o_role"))
    spoken = spoken.groupBy(*spoken.columns).agg(F.sum(F.lit(len(ASSISTANT)) - F.length(_name_to_others(F.col("o_role")))).alias("more"))
    every = lengths.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv")))
    every = every.join(spoken, [*[F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in part], F.col("speaker").eqNullSafe(F.col("o_role"))], "left")
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("segment", "piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + F.coalesce("more", F.lit(0))).over(earlier), F.lit(0)).cast("long")
    return every.select(*[F.col(c).alias(f"s_{c}") for c in ("conv_id", "speaker", "segment", "piece")], start.alias("start"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv_id, speaker, segment, piece, start, n_messages, rendered, mask, spans), a row per participant and part.

    The parts of a participant, in the order of ``segment`` and ``piece``, joined give the whole
    rendering; a part begins at character ``start`` of it. ``mask`` has a 1 for each message of the
    speaker and a 0 for others; ``spans`` lists the characters of the whole rendering to train on as
    start-end pairs joined by commas (end not included, end marker included). A message is
    ``<|im_start|>assistant``, ``<|im_start|>user name=ROLE`` or ``<|im_start|>system``, a line feed,
    the text, ``<|im_end|>`` and a line feed; markers in texts and roles are broken, and line breaks in
    roles become blanks.

    Turns are ordered by turn (nulls first), role (nulls first), text. A segment holds the turns of
    one multiple of ``segment``; if turn numbers repeat so that more rows fall into it, pieces of
    ``segment`` rows. A null role is a participant of its own, the null speaker, and to others a user without a name.
    Null texts are empty; null conversations form one. A conversation of system turns alone has no
    participant and gives no row. Repeated rows are repeated messages. Very long texts are
    rendered whole, in the part of their turn. Other columns are ignored. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("segment", F.floor(F.coalesce("turn", F.lit(0)) / segment))
    order = Window.partitionBy("conv_id", "segment").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("piece", F.floor((F.col("at") - 1) / segment))
    segments = rows.groupBy("conv_id", "segment", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "role", _safe(F.col("text")).alias("text")))).alias("messages"))
    # written, so that a part's length is found without rendering it
    ws = Workspace(turns.sparkSession, "chat")
    segments = ws.save(segments, "segments")
    speakers = turns.select(F.col(conv_col).alias("conv"), F.col(role_col).cast("string").alias("speaker")).filter(F.coalesce(F.col("speaker") != SYSTEM, F.lit(True))).distinct()
    rows = segments.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")

    own = lambda m: m["role"].eqNullSafe(F.col("speaker"))
    name = F.transform("messages", lambda m: F.when(own(m), ASSISTANT).otherwise(_name_to_others(m["role"])))
    rows = rows.withColumn("heads", F.transform(name, lambda x: F.concat(F.lit("<|im_start|>"), x, F.lit("\n"))))
    rows = rows.withColumn("bodies", F.transform("messages", lambda m: F.concat(m["text"], F.lit("<|im_end|>"))))
    parts = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit("\n")))
    rows = rows.withColumn("rendered", F.array_join(parts, ""))
    rows = rows.withColumn("mask", F.array_join(F.transform("messages", lambda m: F.when(own(m), "1").otherwise("0")), ""))
    rows = rows.join(ws.save(_starts(segments, speakers), "starts"), [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ("conv_id", "speaker", "segment", "piece")])
    # running start of every message, then the spans of the speaker's
    lengths = F.arrays_zip(F.transform("heads", F.length).alias("h"), F.transform("bodies", F.length).alias("b"), F.transform("messages", own).alias("own"))
    start = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))
    step = lambda acc, s: F.struct(
        (acc["at"] + s["h"] + s["b"] + 1).alias("at"),
        F.when(s["own"], F.array_append(acc["spans"], F.concat_ws("-", (acc["at"] + s["h"]).cast("string"), (acc["at"] + s["h"] + s["b"]).cast("string")))).otherwise(acc["spans"]).alias("spans"),
    )
    rows = rows.withColumn("lengths", lengths)
    rows = rows.withColumn("spans", F.array_join(F.aggregate("lengths", start, step)["spans"], ","))
    return rows.select("conv_id", "speaker", "segment", "piece", "start", F.size("messages").alias("n_messages"), "rendered", "mask", "spans")
