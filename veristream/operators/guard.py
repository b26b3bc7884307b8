"""The guard: every frame against its action's bound, and the latch after the first breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristream.functions import exprs as X

#: Envelopes of at most this many actions are broadcast.
SMALL = 100_000


def breach_reason(norm: Column, bound: Column) -> Column:
    """The first check that fails, or null: a finite bound exists, the norm is a finite number, the norm is not above the bound.  What
    can't be judged is a breach."""
    return F.when(~X.is_finite(bound), "no bound").when(~X.is_finite(norm), "non-finite norm").when(norm > bound, "norm exceeds bound")


def with_bounds(frames: DataFrame, envelope: DataFrame) -> DataFrame:
    bounds = envelope.select("action", "bound")
    # At most one row more than would be broadcast reaches the driver; the envelope is computed once.
    rows = bounds.take(SMALL + 1)
    if len(rows) <= SMALL:
        bounds = F.broadcast(frames.sparkSession.createDataFrame(rows, bounds.schema))
    return frames.join(bounds, "action", "left")


def decide(frames: DataFrame, envelope: DataFrame) -> DataFrame:
    """``session, frame_id, verdict, acted, norm, bound, reason, breach`` for each of ``session, frame_id, action, norm``."""
    ruled = with_bounds(frames, envelope).withColumn("why", breach_reason(F.col("norm"), F.col("bound")))
    before = Window.partitionBy("session").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    ruled = ruled.withColumn("prior", F.coalesce(F.max(F.col("why").isNotNull()).over(before), F.lit(False)))
    stop = F.col("prior") | F.col("why").isNotNull()
    return ruled.select(
        "session", "frame_id", F.when(stop, "ESTOP").otherwise("PERMIT").alias("verdict"), F.when(stop, "emergency_stop").otherwise(F.col("action")).alias("acted"),
        "norm", "bound", F.when(F.col("prior"), "prior breach").otherwise(F.coalesce("why", F.lit("within envelope"))).alias("reason"),
        (~F.col("prior") & F.col("why").isNotNull()).alias("breach"),
    )


def breach_events(frames: DataFrame, decisions: DataFrame, shard_id: str) -> DataFrame:
    """One event for each session with a breach, as the log takes it: ``session, frame_id, evt, action, l_inf, bound,
    envelope_shard_id, reason``; a norm that isn't finite is "inf", an absent bound "none".  Where frames have a map ``event``, their own
    keys stay under the breach's: ``event`` holds both."""
    text = lambda c, otherwise: F.when(X.is_finite(c), X.fixed6(c)).otherwise(otherwise)
    own = ["event"] if "event" in frames.columns else []
    rows = decisions.where("breach").join(frames.select("session", "frame_id", "action", *own), ["session", "frame_id"])
    events = rows.select(
        "session", "frame_id", F.lit("envelope_breach").alias("evt"), "action", text(F.col("norm"), "inf").alias("l_inf"), text(F.col("bound"), "none").alias("bound"),
        F.lit(shard_id).alias("envelope_shard_id"), "reason", *own,
    )
    said = [c for c in events.columns if c not in ("session", "frame_id", "event")]
    return events.withColumn("event", X.merged(F.coalesce("event", F.create_map().cast("map<string,string>")), F.create_map(*(x for c in said for x in (F.lit(c), F.col(c)))))) if own else events


def first_breach(decisions: DataFrame) -> DataFrame:
    """``session, breach_frame``, null for a clean session."""
    return decisions.groupBy("session").agg(F.min(F.when(F.col("breach"), F.col("frame_id"))).alias("breach_frame"))


def permitted(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("session").agg(F.count_if(F.col("verdict") == "PERMIT").alias("permitted"), F.count_if(F.col("verdict") != "PERMIT").alias("stopped"))
