"""Dialogues seen from every participant: one is the assistant, the others are named users.

A rendered dialogue is a row of turns `<|assistant|>` text `<|end|>` or `<|user name=NAME|>` text `<|end|>`, each followed
by a line break. The mask covers the text and end mark of the participant's own turns, which are what a model learns to
write. A long dialogue is rendered in parts, so that no task holds it whole; parts joined in order are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turn numbers that share a part, and rows above which such a block is cut turn by turn.
PART, CROWDED = 256, 4096
ASSISTANT, USER, CLOSE, END = "<|assistant|>", "<|user name=", "|>", "<|end|>\n"
#: Turns without a number come last.
_LAST = (1 << 62) - 1


def _turns(conversations: DataFrame, part: int, crowded: int) -> DataFrame:
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(_LAST))
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint").cast("string"), F.lit("")).alias("conv"),
        turn.alias("turn"), F.floor(turn / F.lit(part)).cast("bigint").alias("block"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # A block with very many rows is cut by turn, and a turn by the digests of its rows.
    sizes = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded)
    cuts = sizes.select("conv", "block", F.ceil(F.col("_n") / F.lit(part)).alias("_cuts"))
    digest = F.shiftrightunsigned(F.xxhash64("speaker", "text"), 33)
    step = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.floor(digest * F.col("_cuts") / F.lit(1 << 31)))
    return turns.join(cuts, ["conv", "block"], "left").select(
        "conv", "block", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.col("turn")).cast("bigint").alias("cut"),
        step.cast("bigint").alias("step"), "turn", "speaker", "text",
    )


def _spans() -> Column:
    """start:end of own turns by a running offset over pieces of head and body."""
    return F.aggregate(
        "pieces",
        F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("found")),
        lambda state, piece: F.struct(
            (state["at"] + F.length(piece["head"]) + F.length(piece["body"])).alias("at"),
            F.when(piece["own"], F.concat(state["found"], F.array(F.concat_ws(
                ":", (state["at"] + F.length(piece["head"])).cast("string"),
                # The line break after the end mark is not learnt.
                (state["at"] + F.length(piece["head"]) + F.length(piece["body"]) - 1).cast("string"),
            )))).otherwise(state["found"]).alias("found"),
        ),
        lambda state: state["found"],
    )


def rotate(conversations: DataFrame, part: int = PART, crowded: int = CROWDED) -> DataFrame:
    """Rows (conv_id, perspective, part, start, text, n_turns, n_own, mask), one per dialogue, participant and part.

    part counts from 0 in the order of turns and start is the number of characters in earlier parts. mask lists start:end of
    the participant's own texts with their end marks, comma-joined, in characters of the whole rendered dialogue. A
    participant has a row for each part, also for those in which it says nothing.

    Participants are the distinct roles of a dialogue; a null role is the participant `unknown`. Null texts are empty
    turns. Turns are ordered by turn (nulls last), then role and text; in blocks of over `crowded` rows equal turn numbers
    are ordered by a digest of role and text first. Repeated rows are turns of their own. Rows with a null conv_id form
    one dialogue. Other columns are not read. Empty table: no rows.

    Only built-in functions are used. Texts are grouped by dialogue and block of `part` turn numbers, and offsets come from
    counts per block, so a dialogue that holds a large share of all rows is spread over its blocks.
    """
    key = ["conv", "block", "cut", "step"]
    turns = _turns(conversations, part, crowded)
    people = turns.groupBy("conv", "speaker").agg(F.count(F.lit(1)).alias("_n")).select("conv", F.col("speaker").alias("perspective"))
    # Characters of a block seen by someone who says nothing in it, and what changes for each speaker of it.
    user_head = F.length("speaker") + F.lit(len(USER) + len(CLOSE))
    spoken = turns.groupBy(*key, "speaker").agg(
        F.sum((user_head + F.length("text") + F.lit(len(END))).cast("bigint")).alias("chars"),
        F.sum((F.lit(len(ASSISTANT)) - user_head).cast("bigint")).alias("change"),
    )
    totals = spoken.groupBy(*key).agg(F.sum("chars").alias("chars"))
    sizes = totals.join(people, "conv").join(
        spoken.select(*key, F.col("speaker").alias("perspective"), "change"), [*key, "perspective"], "left"
    ).withColumn("size", F.col("chars") + F.coalesce("change", F.lit(0)))
    order = Window.partitionBy("conv", "perspective").orderBy("block", "cut", "step")
    places = sizes.select(
        *key, "perspective", (F.row_number().over(order) - 1).cast("int").alias("part"),
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("start"),
    )
    blocks = turns.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    own = F.col("perspective")
    pieces = F.transform("turns", lambda t: F.struct(
        F.when(t["speaker"] == own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), t["speaker"], F.lit(CLOSE))).alias("head"),
        F.concat(t["text"], F.lit(END)).alias("body"), (t["speaker"] == own).alias("own"),
    ))
    return blocks.join(places, key).withColumn("pieces", pieces).select(
        F.nullif("conv", F.lit("")).cast("bigint").alias("conv_id"), "perspective", "part", "start",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.size("pieces").cast("bigint").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("bigint").alias("n_own"),
        F.array_join(_spans(), ",").alias("mask"),
    )
