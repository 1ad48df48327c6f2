"""Streaming forms of the turn operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from turnwise.operators.normalize import normal_speaker


def windowed_activity(turns: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Turns by speaker in tumbling windows of ``ingested_at``; rows later than ``late`` are dropped.

    Rows delivered twice within the watermark count once (state is kept by key until then).
    """
    once = turns.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["transcript_id", "turn_idx"])
    return once.groupBy(F.window("ingested_at", width), normal_speaker(F.col("speaker")).alias("speaker")).agg(F.count("*").alias("turns"))


def touched_transcripts(all_turns: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None]):
    """A foreachBatch function that hands on the full turns of the transcripts a micro-batch touches."""

    def batch(df: DataFrame, epoch: int) -> None:
        ids = df.select("transcript_id").where("transcript_id IS NOT NULL").distinct()
        handle(all_turns().join(ids, "transcript_id", "left_semi"), epoch)

    return batch
