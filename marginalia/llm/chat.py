"""Conversations as training text: typed parts flattened into marked turns, with attachments, token counts and a loss mask.

A turn's content is a list of parts (kind, text, ref, size). Text parts are escaped and stand as they are; image, audio and document parts
become placeholders numbered within the conversation, recorded with their reference and the tokens they expand to.
Control strings inside texts are escaped so that a template mark never comes from content, and unescaping gives the text back.

Null texts are empty, null roles are empty; turns with equal numbers are ordered by role and text, null numbers come first;
repeated rows are turns of their own; a null conv_id is one conversation. A part of unknown kind is written as its text.
Empty tables give empty results. A conversation is one text, so its turns meet in one row, and nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import saved

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: Control strings of this and of other templates; none contains the escape sign.
CONTROLS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
SIGN = "~"
#: Tokens a part expands to: a base, and one per so many units of its size (pixels, milliseconds, bytes).
EXPANSION = {"image": (85, 1024), "audio": (1, 40), "document": (1, 4)}


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(SIGN), F.lit(SIGN + "0"))
    for i, control in enumerate(CONTROLS):
        c = F.replace(c, F.lit(control), F.lit(SIGN + chr(97 + i)))
    return c


def unescape(c: Column) -> Column:
    for i, control in reversed(list(enumerate(CONTROLS))):
        c = F.replace(c, F.lit(SIGN + chr(97 + i)), F.lit(control))
    return F.replace(c, F.lit(SIGN + "0"), F.lit(SIGN))


def text_parts(c: Column) -> Column:
    """Plain texts as content of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(c, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size")))


def _visit(part: Column, number: Column) -> Column:
    """What a part is written as."""
    mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.when(part["kind"].isin(*EXPANSION), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _expanded(part: Column) -> Column:
    tokens = F.lit(0)
    for kind, (base, per) in EXPANSION.items():
        tokens = F.when(part["kind"] == kind, base + F.ceil(F.coalesce(part["size"], F.lit(0)) / per)).otherwise(tokens)
    return tokens.cast("bigint")


def format_turns(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, loss (spans: turn, start, length, by code points of the turn) and attachments.

    `turns` has conv_id, turn, role, parts.
    """
    attached = lambda p: p["kind"].isin(*EXPANSION)
    df = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(turns.schema["parts"].dataType)).alias("parts")
    )
    df = df.withColumn("_order", F.struct("turn", "role", F.transform("parts", lambda p: F.concat_ws("\n", p["kind"], p["text"], p["ref"]))))
    w = Window.partitionBy("conv_id").orderBy("_order")
    df = df.withColumn("_n", F.size(F.filter("parts", attached)))
    df = df.withColumn("_at", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    df = df.withColumn("ordinal", F.row_number().over(w) - 1)
    # attachments are numbered in order: those before the part in its turn, after those of earlier turns
    number = lambda i: F.col("_at") + F.size(F.filter(F.slice("parts", 1, i), attached))
    shown = F.transform("parts", lambda p, i: _visit(p, number(i)))
    seen = F.transform(
        "parts",
        lambda p, i: F.struct(number(i).cast("bigint").alias("number"), F.col("ordinal").cast("bigint").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens"), attached(p).alias("ok")),
    )
    df = df.withColumn("content", F.array_join(shown, "")).withColumn("seen", F.filter(seen, lambda s: s["ok"]))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    piece = F.struct(
        F.col("ordinal"),
        F.concat(head, F.col("content")).alias("piece"),
        (F.length(head) + 1).alias("start"),
        F.length("content").alias("length"),
        (F.col("role") == "assistant").alias("learn"),
        "seen",
    )
    grouped = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    loss = F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct(x["ordinal"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return grouped.select(
        "conv_id",
        F.concat(F.array_join(F.col("p.piece"), DONE), F.lit(DONE)).alias("formatted"),
        loss.alias("loss"),
        F.transform(F.flatten(F.col("p.seen")), lambda s: F.struct(s["number"].alias("number"), s["turn"].alias("turn"), s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens"))).alias("attachments"),
    )


def saved_format(turns: DataFrame) -> DataFrame:
    """The formatted conversations as a written table."""
    return saved(format_turns(turns), "chat")


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted text and mask alone: conv_id, turns (role, text), learnt (all text under the mask), formatted_chars."""
    raw = F.split("formatted", F.lit(DONE.replace("|", r"\|")))
    df = formatted.select("conv_id", "formatted", "loss", raw.alias("_all"))
    df = df.withColumn("_p", F.slice("_all", F.lit(1), F.size("_all") - 1))
    body = lambda p: F.substr(p, F.lit(len(TURN) + 1))
    role = lambda p: F.substring_index(body(p), SAYS, 1)
    turns = F.transform(
        "_p",
        lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + len(TURN) + len(SAYS) + 1)).alias("text")),
    )
    learnt = F.transform("loss", lambda s: unescape(F.substr(F.get(F.col("_p"), s["turn"]), s["start"], s["length"])))
    return df.select("conv_id", turns.alias("turns"), F.array_join(learnt, "").alias("learnt"), F.length("formatted").cast("bigint").alias("formatted_chars"))
