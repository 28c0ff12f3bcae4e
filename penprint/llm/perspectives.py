"""Dialogues rendered once from every participant's point of view.

For each speaker of a conversation the whole dialogue is rendered with that speaker as the
assistant and all others as named users; the mask marks what that speaker says. A rendering
comes in parts, each of a bounded stretch of turns, with the character where it starts, so
the longest conversation is no single row. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

PART_TURNS = 256
NOBODY = "unknown"
SYSTEM = "system"


def clean(text: Column) -> Column:
    """A text with control markers broken by a blank; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _messages(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct messages with the part they belong to.

    Parts follow turn numbers. Of many different messages with one turn number, each part
    takes those of one range of hashes, so no group grows without bound.
    """
    role = F.trim(clean(F.col(role_col)))
    rows = (
        turns.select(
            F.col(conv_col).alias("conv"),
            F.col(turn_col).cast("bigint").alias("turn"),
            F.when(role == "", NOBODY).otherwise(role).alias("speaker"),
            clean(F.col(text_col)).alias("text"),
        )
        .distinct()
        .withColumn("hash", F.xxhash64("speaker", "text"))
    )
    crowded = (
        rows.groupBy("conv", "turn")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > PART_TURNS)
        .select(
            F.col("conv").alias("_conv"),
            F.col("turn").alias("_turn"),
            F.ceil(F.col("n") / PART_TURNS).alias("_parts"),
        )
    )
    share = (F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("_parts")
    joined = rows.join(
        crowded, F.col("conv").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")), "left"
    )
    return joined.select(
        "conv",
        "turn",
        "speaker",
        "text",
        F.floor(F.col("turn") / PART_TURNS).alias("stretch"),
        F.when(F.col("_parts").isNotNull(), F.col("turn")).alias("crowded"),
        F.when(F.col("_parts").isNotNull(), F.floor(share)).alias("crowd_part"),
    )


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation, perspective and part.

    ``(conv_col, perspective, part, char_start, n_turns, rendered, mask)``: ``rendered`` is
    the part's text, ``char_start`` the code point where it begins in the whole rendering, and
    ``mask`` the spans of the perspective's own messages with their end marker, as
    ``start:end`` in the whole rendering, comma-joined, end exclusive.

    Messages are ordered by turn, then speaker and text; null turns come first. Equal rows
    count once. A null text is an empty message, a null or blank role the speaker "unknown".
    The role "system" is rendered as such and takes no perspective, so a conversation of
    system messages alone gives no row. A null conversation id is a conversation of its own.
    An empty table gives no rows; other columns are ignored.
    """
    rows = _messages(turns, conv_col, turn_col, role_col, text_col)
    people = (
        rows.where(F.col("speaker") != SYSTEM)
        .select(F.col("conv").alias("_conv"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    header = (
        F.when(F.col("speaker") == SYSTEM, "<|im_start|>system\n")
        .when(F.col("speaker") == F.col("perspective"), "<|im_start|>assistant\n")
        .otherwise(F.concat(F.lit("<|im_start|>user name="), "speaker", F.lit("\n")))
    )
    views = rows.join(people, F.col("conv").eqNullSafe(F.col("_conv"))).select(
        "conv", "perspective", "stretch", "crowded", "crowd_part",
        F.struct(
            "turn",
            "speaker",
            "text",
            F.concat(header, "text", F.lit("<|im_end|>\n")).alias("piece"),
            F.length(header).alias("lead"),
            (F.col("speaker") == F.col("perspective")).alias("own"),
        ).alias("m"),
    )
    parts = (
        views.groupBy("conv", "perspective", "stretch", "crowded", "crowd_part")
        .agg(F.min("m.turn").alias("first_turn"), F.sort_array(F.collect_list("m")).alias("ms"))
        .withColumn("chars", F.length(F.array_join("ms.piece", "")))
    )
    order = Window.partitionBy("conv", "perspective").orderBy("first_turn", "crowded", "crowd_part")
    placed = parts.withColumns(
        {
            "part": F.row_number().over(order) - 1,
            "char_start": F.coalesce(
                F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    )
    start = F.struct(F.col("char_start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + F.length(m["piece"])
        # The mask covers the message and its end marker, not the line break behind it.
        span = F.concat_ws(":", (acc["at"] + m["lead"]).cast("string"), (end - 1).cast("string"))
        spans = F.when(m["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return placed.select(
        F.col("conv").alias(conv_col),
        "perspective",
        "part",
        "char_start",
        F.size("ms").alias("n_turns"),
        F.array_join("ms.piece", "").alias("rendered"),
        F.array_join(F.aggregate("ms", start, step, lambda acc: acc["spans"]), ",").alias("mask"),
    )
