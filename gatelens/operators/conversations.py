"""Turns to ordered message histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_conversations(turns: DataFrame, part_turns: int | None = None) -> DataFrame:
    """(conv_id, messages) with the messages in turn order, one row per conversation.

    With ``part_turns`` the rows are (conv_id, part, messages): every conversation is
    cut at multiples of that turn number, so that no array grows without bound.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    if part_turns is None:
        return turns.groupBy("conv_id").agg(ordered)
    part = F.floor(F.col("turn") / part_turns).cast("long").alias("part")
    return turns.groupBy("conv_id", part).agg(ordered)
