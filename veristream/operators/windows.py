"""The frame axis: numbering, keep windows around triggers, their brackets and gaps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(events: DataFrame, session: str, *order: str) -> DataFrame:
    """Add ``session`` and ``frame_id``, from 0 in each session."""
    w = Window.partitionBy(session).orderBy(*order)
    return events.withColumn("session", F.col(session)).withColumn("frame_id", (F.row_number().over(w) - 1).cast("long"))


def keep_extending(frames: DataFrame, trigger: Column, pre: int, post: int) -> DataFrame:
    """Frames that a window keeps, where a trigger inside an open window extends it."""
    if pre + post <= 0:
        return frames.withColumn("kept", F.lit(False))
    around = Window.partitionBy("session").orderBy("frame_id").rowsBetween(1 - post, pre)
    return frames.withColumn("kept", F.coalesce(F.max(trigger).over(around), F.lit(False)))


def window_frames(pre: int, post: int) -> Column:
    """The frames around ``trigger``, from ``pre`` before it to the last of ``post`` from it on; none if both are 0."""
    if pre + post <= 0:
        return F.array().cast("array<bigint>")
    return F.sequence(F.col("trigger") - pre, F.col("trigger") + post - 1)


def accepted(triggers: DataFrame, post: int) -> DataFrame:
    """Triggers ``session, trigger`` that a latched window accepts, of ``session, frame_id``: those inside an open window are
    ignored.  Which are depends on all before, so a session's triggers (not its frames) go through one task in order, batch after
    batch; only the last accepted one is carried on."""

    def fold(batches):
        session, last = object(), None
        for batch in batches:
            taken = []
            for name, frame in zip(batch.column("session").to_pylist(), batch.column("frame_id").to_pylist(), strict=True):
                taken.append(name != session or frame >= last + post)
                if taken[-1]:
                    session, last = name, frame
            yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("frame_id")], names=["session", "trigger"]).filter(pa.array(taken, pa.bool_()))

    rows = triggers.select("session", F.col("frame_id").cast("long").alias("frame_id"))
    dealt = rows.repartition("session").sortWithinPartitions("session", "frame_id")
    return dealt.mapInArrow(fold, f"session {dict(rows.dtypes)['session']}, trigger long")


def keep_latched(frames: DataFrame, trigger: Column, pre: int, post: int) -> DataFrame:
    """Frames that a window keeps, where a trigger inside an open window is ignored."""
    taken = accepted(frames.where(trigger).select("session", "frame_id"), post)
    inside = taken.select("session", F.explode(window_frames(pre, post)).alias("frame_id")).distinct()
    return frames.join(inside.withColumn("kept", F.lit(True)), ["session", "frame_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def keep_by_triggers(frames: DataFrame, triggers: DataFrame, pre: int, post: int) -> DataFrame:
    """Frames that some trigger ``session, trigger`` of a table keeps.  Triggers beyond the last frame count."""
    inside = triggers.select("session", F.explode(window_frames(pre, post)).alias("frame_id")).distinct()
    return frames.join(inside, ["session", "frame_id"], "left_semi")


def trigger_windows(frames: DataFrame, triggers: DataFrame, pre: int, post: int) -> DataFrame:
    """``session, trigger, first_frame, last_frame, frames`` of each trigger's window, whether or not it touches another."""
    inside = triggers.select("session", "trigger", F.explode(window_frames(pre, post)).alias("frame_id"))
    met = frames.select("session", "frame_id").join(inside, ["session", "frame_id"])
    return met.groupBy("session", "trigger").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("frames"))


def brackets(kept: DataFrame) -> DataFrame:
    """``session, first_frame, last_frame, frames`` of each run of kept frames."""
    w = Window.partitionBy("session").orderBy("frame_id")
    runs = kept.withColumn("run", F.col("frame_id") - F.row_number().over(w))
    return runs.groupBy("session", "run").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("frames")).drop("run")


def gaps(windows: DataFrame) -> DataFrame:
    """``session, after_frame, missing`` between neighbouring runs."""
    w = Window.partitionBy("session").orderBy("first_frame")
    missing = F.lead("first_frame").over(w) - F.col("last_frame") - 1
    return windows.select("session", F.col("last_frame").alias("after_frame"), missing.alias("missing")).where("missing IS NOT NULL")


def summary(frames: DataFrame, trigger: Column) -> DataFrame:
    """``session, observed, kept, triggers, triggered`` from frames with ``kept``."""
    return frames.groupBy("session").agg(F.count("*").alias("observed"), F.count_if("kept").alias("kept"), F.count_if(trigger).alias("triggers"), F.bool_or(trigger).alias("triggered"))
