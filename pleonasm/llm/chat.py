"""Conversations as training text, once from the view of each participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _heading(own: Column, speaker: Column, is_system: Column) -> Column:
    # A name stands inside the mark, so what could end the mark is taken out of it.
    name = F.regexp_replace(speaker, r"[<>|\s]+", "_")
    return F.when(is_system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n")))


def rotate_perspectives(
    messages: DataFrame,
    conversation: str = "conversation_id",
    turn: str = "turn",
    speaker: str = "role",
    content: str = "content",
    system: str = "system",
    end: str = "<|end|>\n",
) -> DataFrame:
    """Renders each dialogue once per participant: that speaker is the assistant, the others are named users.

    A participant is a speaker of the conversation other than `system`, whose turns stand in every rendering. A turn is
    a heading (`<|system|>`, `<|assistant|>` or `<|user:name|>`) and a line feed, the content, and `end`. The mask holds
    the spans to be learned: content and end mark of the participant's own turns, in code points, end exclusive.

    A rendering is one training text and so one row: its size is that of the conversation. Turns are gathered once per
    conversation, and the participants are told apart inside the row, without a join.

    Returns one row per conversation and participant: `conversation`, participant, n_turns, n_own, text, mask (array of
    start and end). Turns are ordered by `turn` (null first), then speaker and content, so ties and repeated rows have
    one order. Null content is empty; a null speaker speaks as `unknown`; turns of a null conversation form one
    conversation. A conversation of system turns alone has no participant and no row, nor has an empty table. Other
    columns are not read.
    """
    own = F.coalesce(F.col(speaker), F.lit("unknown"))
    body = F.coalesce(F.col(content), F.lit(""))
    rows = messages.select(F.col(conversation).alias("c"), F.struct(F.col(turn).alias("turn"), own.alias("speaker"), body.alias("content")).alias("t"))
    gathered = rows.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    speakers = F.array_distinct(F.transform("turns", lambda t: t["speaker"]))
    each = gathered.select("c", "turns", F.explode(F.array_sort(F.filter(speakers, lambda s: s != system))).alias("participant"))
    rendered = each.select(
        "c",
        "participant",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["speaker"] == F.col("participant")).alias("own"),
                _heading(t["speaker"] == F.col("participant"), t["speaker"], t["speaker"] == system).alias("heading"),
                F.concat(t["content"], F.lit(end)).alias("body"),
            ),
        ).alias("parts"),
    )

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["heading"])
        stop = start + F.length(part["body"])
        span = F.struct(start.alias("start"), stop.alias("end"))
        return F.struct(stop.alias("at"), F.when(part["own"], F.concat(state["mask"], F.array(span))).otherwise(state["mask"]).alias("mask"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    mask = F.aggregate("parts", F.struct(F.lit(0).alias("at"), none.alias("mask")), step)["mask"]
    return rendered.select(
        F.col("c").alias(conversation),
        "participant",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["heading"], p["body"])), "").alias("text"),
        mask.alias("mask"),
    )
