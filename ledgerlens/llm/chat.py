"""Chat formatting: the dialogue seen by every participant in turn.

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant and the
others as named users; the mask holds the spans of the text that the model learns, the assistant's own messages with
their end mark. A conversation is rendered in pieces of `TURNS` turn numbers, so that none is gathered whole in one
row; the pieces of one perspective, in order, are its text. A turn that is tied is ordered by role, then text.

Defined results: a null text is an empty message; a null or empty role is the speaker "unknown"; roles in
`SYSTEM_ROLES` speak as the system and have no perspective, and a conversation of such roles alone gives one row with
a null perspective and an empty mask; repeated rows are rendered each; null turns come first, in piece null; rows with a
null conv_id are one conversation with a null id; control marks inside texts are broken up; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = 256
SYSTEM_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>"


def speaker(role: Column) -> Column:
    return F.when(F.coalesce(role, F.lit("")) == "", "unknown").otherwise(role)


def message(name: Column, text: Column, perspective: Column) -> tuple[Column, Column]:
    """The head and the body of one rendered message."""
    head = (F.when(name.isin(*SYSTEM_ROLES), "system").when(name == perspective, "assistant")
            .otherwise(F.concat(F.lit("user name="), name)))
    return F.concat(F.lit(START), head, F.lit("\n")), F.concat(text, F.lit(END))


def perspectives(turns: DataFrame) -> DataFrame:
    """One row per conversation, participant and piece: text, mask, messages, characters to learn."""
    said = turns.select("conv_id", F.floor(F.col("turn") / TURNS).cast("long").alias("piece"),
                        F.struct("turn", speaker(F.col("role")).alias("name"),
                                 F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")
                                 ).alias("m"))
    pieces = said.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    name = F.col("m.name")
    speakers = (said.where(~name.isin(*SYSTEM_ROLES))
                .select(F.col("conv_id").alias("of"), name.alias("perspective")).distinct())
    both = pieces.join(speakers, pieces.conv_id.eqNullSafe(speakers.of), "left").drop("of")
    seen = F.col("perspective")

    def part(m):
        head, body = message(m["name"], m["text"], seen)
        return F.struct(head.alias("head"), body.alias("body"), F.coalesce(m["name"] == seen, F.lit(False)).alias("own"))

    parts = both.withColumn("parts", F.transform("messages", part))
    # Running end of each message, so that each span follows from its neighbours in one pass.
    zero = F.struct(F.lit(0).alias("end"), F.lit("").alias("mask"), F.lit(0).alias("chars"))

    def step(acc, p):
        start = acc["end"] + F.length(p["head"])
        size = F.length(p["body"])
        return F.struct((start + size + 1).alias("end"),
                        F.when(p["own"], F.concat(acc["mask"], F.when(acc["mask"] == "", "").otherwise(","),
                                                  start.cast("string"), F.lit(":"), (start + size).cast("string")))
                        .otherwise(acc["mask"]).alias("mask"),
                        (acc["chars"] + F.when(p["own"], size).otherwise(0)).alias("chars"))

    return (parts.withColumn("done", F.aggregate("parts", zero, step))
            .select("conv_id", "perspective", "piece", F.size("messages").cast("long").alias("n_messages"),
                    F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))))
                    .alias("text"),
                    F.col("done.mask").alias("mask"), F.col("done.chars").cast("long").alias("n_learned")))
