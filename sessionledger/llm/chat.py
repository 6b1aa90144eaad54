"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply
is trainable. A conversation of n turns has up to n examples of up to n turns, so texts written out grow
with the square of a conversation. The operator therefore renders each turn once (``segments``) and gives
an example as a span of that rendering (``examples``): its text is the rendering from 0 to ``text_end``,
and the loss mask is ``reply_start`` to ``reply_end``. ``render`` writes the texts out for a trainer.

Template, per turn: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. Inside texts
and roles every ``<``, any number of backslashes, ``|`` gains one backslash, so a text never holds a control
string and the change is undone exactly. ``%`` and line feeds in a role are written as %25 and %0A.

Nulls: a null text or role is empty; null ids make one conversation; null turns come first. Rows with
the same turn are ordered by role and text and all kept. Turns behind the last assistant turn belong to
a last example without a reply, so that every turn can be read back. An empty table gives empty tables.

A long conversation is not gathered: offsets are sums inside blocks of turns plus the sums of the blocks
before. Only the digests read a conversation in order, as a stream that holds no more than a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_BLOCK = 1024


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, seq, segment, seg_start, seg_end, trainable`` with offsets in code points."""
    r = F.coalesce(F.col(role).cast("string"), F.lit(""))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.floor(F.col(turn) / TURNS_PER_BLOCK).alias("block"), (r == "assistant").alias("trainable"),
        F.concat(F.lit(OPEN), escape_role(r), F.lit("\n"), escape(t), F.lit(CLOSE + "\n")).alias("segment"))
    rows = rows.withColumn("chars", F.length("segment").cast("long"))
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "segment")
    rows = rows.select("*", F.row_number().over(own).alias("k"), F.sum("chars").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    sums = rows.groupBy("conv_id", "block").agg(F.count("*").alias("m"), F.sum("chars").alias("w"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c2"), F.col("block").alias("b2"), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("m0"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    out = rows.join(sums, rows.conv_id.eqNullSafe(sums.c2) & rows.block.eqNullSafe(sums.b2))
    return out.select("conv_id", (F.col("m0") + F.col("k") - 1).cast("long").alias("seq"), "segment", (F.col("w0") + F.col("upto") - F.col("chars")).alias("seg_start"), (F.col("w0") + F.col("upto")).alias("seg_end"), "trainable")


def with_loss(segs: DataFrame) -> DataFrame:
    """Segments with ``reply_start`` and ``reply_end`` (of the conversation's rendering; null without a reply)."""
    head = F.instr("segment", "\n")  # code points up to and with the header's line feed
    return segs.withColumns({
        "reply_start": F.when(F.col("trainable"), F.col("seg_start") + head),
        "reply_end": F.when(F.col("trainable"), F.col("seg_end") - F.lit(len(CLOSE) + 1))})


def examples(segs: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, target_seq, text_end, reply_start, reply_end``.

    Turns behind the last reply give one row more, with null ``target_seq`` and no loss.
    """
    marked = with_loss(segs)
    own = marked.filter("trainable").select("conv_id", F.col("seq").alias("target_seq"), F.col("seg_end").alias("text_end"), "reply_start", "reply_end")
    ends = marked.groupBy("conv_id").agg(F.max("seg_end").alias("text_end"), F.max(F.when(F.col("trainable"), F.col("seg_end"))).alias("covered"))
    rest = ends.filter("covered is null or covered < text_end")
    null = F.lit(None).cast("long")
    return own.unionByName(rest.select("conv_id", null.alias("target_seq"), "text_end", null.alias("reply_start"), null.alias("reply_end")))


def render(segs: DataFrame, exs: DataFrame) -> DataFrame:
    """Examples with their ``text`` written out. The output is as large as the method makes it."""
    e = exs.select(F.col("conv_id").alias("c"), F.col("target_seq").alias("t"), "text_end", "reply_start", "reply_end")
    both = e.join(segs, e.c.eqNullSafe(segs.conv_id) & (segs.seg_end <= e.text_end))
    parts = both.groupBy("conv_id", "t", "text_end", "reply_start", "reply_end").agg(F.sort_array(F.collect_list(F.struct("seq", "segment"))).alias("p"))
    return parts.select("conv_id", F.col("t").alias("target_seq"), F.array_join(F.col("p.segment"), "").alias("text"), "reply_start", "reply_end")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole conversations in order; holds two running hashes, never a conversation."""
    now: list | None = None

    def done(s):
        return (s["id"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"])

    for pdf in batches:
        out = []
        for conv, role, text, reply, formatted in zip(pdf["conv_id"], pdf["role"], pdf["text"], pdf["reply"], pdf["formatted_chars"]):
            conv = None if pd.isna(conv) else int(conv)
            if now is None or now["id"] != conv:
                if now is not None:
                    out.append(done(now))
                now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": int(formatted)}
            now["n"] += 1
            now["turns"].update(f"{role}\n{text}\n".encode())
            if reply is not None:
                now["loss"].update(reply.encode())
                now["chars"] += len(reply)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([done(now)], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def digests(segs: DataFrame, exs: DataFrame | None = None) -> DataFrame:
    """What the examples say, read back from their spans of the rendering: turns and replies by their hashes, per conversation.

    Turns are those of the longest example, replies what the loss masks cover, and ``formatted_chars`` counts the
    characters of all examples. ``exs`` are :func:`examples` of ``segs`` unless given. Both are read more than once.
    """
    exs = examples(segs) if exs is None else exs
    head = F.instr("segment", "\n")
    body = F.length("segment") - len(CLOSE) - 1
    whole = exs.groupBy(F.col("conv_id").alias("c1")).agg(F.max("text_end").alias("covered"), F.sum("text_end").alias("formatted_chars"))
    masks = exs.filter("target_seq is not null").select(F.col("conv_id").alias("c2"), "target_seq", "reply_start", "reply_end")
    d = segs.join(masks, segs.conv_id.eqNullSafe(F.col("c2")) & (segs.seq == F.col("target_seq")), "left")
    d = d.join(whole, segs.conv_id.eqNullSafe(F.col("c1"))).filter("seg_end <= covered")
    # instr and length count code points, as substring does
    back = d.select(
        segs.conv_id, "seq", "formatted_chars",
        unescape_role(F.substring(F.col("segment"), F.lit(len(OPEN) + 1), head - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(F.col("segment"), head + 1, body - head)).alias("text"),
        F.when(F.col("reply_start").isNotNull(), unescape(F.substring(F.col("segment"), F.col("reply_start") - F.col("seg_start") + 1, F.col("reply_end") - F.col("reply_start")))).alias("reply"))
    return back.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInPandas(_digest, DIGEST)
