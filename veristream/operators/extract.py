"""Events to claims: one event gives none, one or several rows ``subject, predicate, object, object_type, tier``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristream.functions import exprs as X

ENTITY, TEXT, DECIMAL = "entity", "literal:string", "literal:decimal"


def _claim(when: Column, subject, predicate: str, obj, kind: str, tier: int) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(c(subject).alias("subject"), F.lit(predicate).alias("predicate"), c(obj).cast("string").alias("object"), F.lit(kind).alias("object_type"), F.lit(tier).alias("tier")))


def _exploded(events: DataFrame, keep: list[str], claims: list[Column]) -> DataFrame:
    return events.select(*keep, F.explode(F.array_compact(F.array(*claims))).alias("c")).select(*keep, "c.*")


def event_claims(events: DataFrame, *keep: str) -> DataFrame:
    """From ``evt, robot, surface, action, value, frame_id, l_inf, bound, selected_action, has_distribution``; absent keys are null, and
    so are norms and bounds that aren't numbers.  A robot without name is robot-001."""
    e, robot = F.col("evt"), F.coalesce("robot", F.lit("robot-001"))
    slip, recovery, breach = e == "wheel_slip", e == "recovery_action", e == "envelope_breach"
    frame = F.concat(F.lit("breach/frame-"), F.col("frame_id").cast("string"))
    return _exploded(events, list(keep), [
        _claim(slip, robot, "observed", "wheel_slip", ENTITY, 2),
        _claim(slip & F.col("surface").isNotNull(), "wheel_slip", "on_surface", F.col("surface"), TEXT, 2),
        _claim(recovery, "wheel_slip", "resolved_by", F.col("action"), ENTITY, 1),
        _claim(recovery, F.col("action"), "applied_value", F.col("value"), TEXT, 2),
        _claim(e == "emergency_stop", robot, "triggered", "emergency_stop", ENTITY, 1),
        _claim(breach, robot, "breached_envelope", F.coalesce("action", F.lit("")), TEXT, 1),
        _claim(breach & F.col("l_inf").isNotNull(), frame, "observed_l_inf", X.fixed6(F.col("l_inf")), DECIMAL, 1),
        _claim(breach & F.col("bound").isNotNull(), frame, "envelope_bound", X.fixed6(F.col("bound")), DECIMAL, 1),
        _claim(F.col("selected_action").isNotNull() & F.col("has_distribution"), robot, "selected_action", F.col("selected_action"), ENTITY, 1),
    ])


def considered(events: DataFrame, distribution: Column, *keep: str) -> DataFrame:
    """``action, confidence`` of each entry of a map column."""
    return events.select(*keep, F.explode(distribution).alias("action", "confidence"))


def capture_claims(events: DataFrame, *keep: str) -> DataFrame:
    """From ``evt, sensor, frame_id, reason, source, first_kept, content_sha256``; a sensor without name is sensor-unknown."""
    e, sensor = F.col("evt"), F.coalesce("sensor", F.lit("sensor-unknown"))
    at = lambda kind, n: F.concat(F.lit(f"{kind}-"), n.cast("string"))
    own = at("frame", F.col("frame_id"))
    return _exploded(events, list(keep), [
        _claim(e == "capture_trigger", sensor, "declared_trigger", F.col("reason"), TEXT, 1),
        _claim(e == "capture_trigger", at("trigger/frame", F.col("frame_id")), "trigger_source", F.col("source"), TEXT, 1),
        _claim(e == "capture_window_opened", sensor, "opened_capture_window", at("frame", F.coalesce("first_kept", "frame_id")), TEXT, 1),
        _claim(e == "capture_window_closed", sensor, "closed_capture_window", own, TEXT, 1),
        _claim(e == "frame_kept", own, "content_sha256", F.col("content_sha256"), TEXT, 1),
    ])


def distinct_claims(claims: DataFrame, evidence: str = "evidence") -> DataFrame:
    """One of each (subject, predicate, object, object_type, evidence)."""
    return claims.dropDuplicates(["subject", "predicate", "object", "object_type", evidence])


def valid_triggers(triggers: DataFrame) -> DataFrame:
    """Triggers that state a reason and a source."""
    said = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return triggers.withColumn("valid", said("reason") & said("source"))
