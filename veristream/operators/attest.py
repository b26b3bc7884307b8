"""Attestation: the queue of digests to anchor in time, its consistency, and the rows that an anchored entry gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators.graph import citation

DEFAULT_AUTHORITY = "https://authority.invalid/tsr"


def listing(files: DataFrame) -> DataFrame:
    """``entry, has_record, anchored`` of ``entry, name``; entries without record.json aren't listed."""
    has = lambda name: F.bool_or(F.col("name") == name)
    return files.groupBy("entry").agg(has("record.json").alias("has_record"), has("manifest.tsr").alias("anchored")).where("has_record")


def consistent(entries: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Add ``consistent``: the record's digest, its query and, where given, the live copy agree with the manifest."""
    digest = F.sha2("manifest", 256)
    ok = (F.col("record_sha256") == digest) & (F.col("query") == X.timestamp_query(digest))
    if live is not None:
        entries = entries.join(live.select("shard_id", F.col("manifest").alias("live_manifest")), "shard_id", "left")
        ok = ok & F.coalesce(F.col("live_manifest") == F.col("manifest"), F.lit(False))
    return entries.withColumn("consistent", F.coalesce(ok, F.lit(False)))


def status(entries: DataFrame) -> DataFrame:
    """Counts of ``anchored`` and ``failed`` entries."""
    return entries.agg(F.count_if("anchored").alias("n_anchored"), F.count_if(~F.col("anchored") & ~F.col("failed")).alias("n_pending"), F.count_if("failed").alias("n_failed"))


def with_anchor(entries: DataFrame) -> DataFrame:
    """Add ``authority, anchored_at`` of the first rfc3161 anchor: the response's time goes before the local clock's."""
    first = F.get(F.filter("anchors", lambda a: a["kind"] == "rfc3161"), F.lit(0))
    return entries.withColumn("authority", F.coalesce(first["tsa"], F.lit(DEFAULT_AUTHORITY))).withColumn("anchored_at", F.coalesce(F.col("gen_time"), first["anchored_at_local_clock"], F.lit("")))


#: Fixed value: what an attestation's reference says.
ATTESTS = "external timestamp over the target's manifest"


def references(entries: DataFrame) -> DataFrame:
    """For each entry the reference of its first claim to the shard that is attested: ``subject, predicate`` and a citation's columns."""
    return entries.select(F.concat(F.lit("anchor/"), "shard_id").alias("subject"), F.lit("target_shard_id").alias("predicate"), *citation(F.col("shard_id"), "attests", ATTESTS))


def claims(entries: DataFrame) -> DataFrame:
    """Five claims of tier 1 for each ``shard_id, digest, authority, anchored_at``; the first cites the shard."""
    rows = [("target_shard_id", "shard_id", True), ("digest_sha256", "digest", False), ("anchor_kind", None, False), ("anchor_authority", "authority", False), ("anchored_at", "anchored_at", False)]
    made = F.array(*(F.struct(F.lit(p).alias("predicate"), (F.col(c) if c else F.lit("rfc3161")).alias("object"), F.lit(cites).alias("cites_target")) for p, c, cites in rows))
    return entries.select(F.concat(F.lit("anchor/"), "shard_id").alias("subject"), F.explode(made).alias("c")).select("subject", "c.*", F.lit(1).alias("tier"))
