"""Governance: trust store, policy, and the decision whether an envelope may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrol(store: DataFrame, new: DataFrame) -> DataFrame:
    """The trust store with new fingerprints; those it has are not added again."""
    return store.select("fingerprint").union(new.select("fingerprint")).dropDuplicates(["fingerprint"])


def policy_tier(policy: DataFrame) -> int:
    """The most tier that a policy table of one row allows: 0 where it is empty or doesn't say."""
    row = policy.select("max_actuation_tier").first()
    return int(row[0]) if row and row[0] is not None else 0


def authorise(shards: DataFrame, store: DataFrame, max_tier: int = 0) -> DataFrame:
    """``shard_id, decision, reason`` of ``shard_id, publisher, has_key, verified, tier``.  The first check that fails is the reason; a
    null is a check that fails.  A shard without tier has no claims, so it is refused."""
    trusted = store.select(F.col("fingerprint").alias("publisher")).distinct().withColumn("trusted", F.lit(True))
    # "No anchors at all" is one row, not a scan: limit(1).
    some = store.limit(1).select(F.lit(True).alias("some_anchor"))
    rows = shards.join(trusted, "publisher", "left").join(F.broadcast(some), F.lit(True), "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = (
        F.when(~said("has_key"), "no publisher key").when(F.col("some_anchor").isNull(), "no trust anchors").when(F.col("trusted").isNull(), "publisher not enrolled")
        .when(~said("verified"), "verification failed").when(F.col("tier").isNull(), "no claims").when(F.col("tier") > max_tier, "tier above policy")
    )
    return rows.select("shard_id", F.when(why.isNull(), "AUTHORISED").otherwise("REFUSED").alias("decision"), F.coalesce(why, F.lit("granted")).alias("reason"))


def actuation(frames: DataFrame, law: DataFrame, max_tier: int = 0) -> DataFrame:
    """``frame_id, verdict``: permitted by a matching, trusted, verified, proven claim of a tier within policy; else the safe state."""
    valid = law.where((F.col("tier") <= max_tier) & F.col("trusted") & F.col("verified") & F.col("proven")).select("action", F.lit("PERMIT").alias("verdict")).distinct()
    return frames.join(valid, "action", "left").select("frame_id", F.coalesce("verdict", F.lit("SAFE_STATE")).alias("verdict"))


def guarded_claims(claims: DataFrame, namespace: str, tiers: list[str]) -> DataFrame:
    """Add ``finding``: the first of namespace, evidence tier and object type that is wrong."""
    wrong = F.when(F.col("namespace") != namespace, "wrong namespace").when(~F.col("evidence_tier").isin(tiers), "wrong evidence tier").when((F.col("predicate") == "bound") & (F.col("object_type") != "literal:decimal"), "wrong object type")
    return claims.withColumn("finding", F.coalesce(wrong, F.lit("ok")))
