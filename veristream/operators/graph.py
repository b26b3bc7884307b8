"""The claim graph: labels, evidence, lineage, and the view of mounted law."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators.shared import checkpointed


def last_wins(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias(value))


def first_wins(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, position).alias(value))


def evidence(provenance: DataFrame, spans: DataFrame) -> DataFrame:
    """``claim_id, evidence``: the text of each claim's first span, by ``position``."""
    met = provenance.join(spans, ["source_hash", "byte_start", "byte_end"])
    return met.groupBy("claim_id").agg(F.min_by("text", "position").alias("evidence"))


def described(claims: DataFrame, entities: DataFrame, proof: DataFrame, predicate: str | None = None) -> DataFrame:
    """Claims with labels (the id where there is none) and shortened evidence."""
    if predicate is not None:
        claims = claims.where(F.col("predicate") == predicate)
    label = lambda side: entities.select(F.col("entity_id").alias(side), F.col("label").alias(f"{side}_label"))
    rows = claims.join(label("subject"), "subject", "left").join(label("object"), "object", "left").join(proof, "claim_id", "left")
    return rows.select("claim_id", F.coalesce("subject_label", "subject").alias("subject_label"), "predicate", F.coalesce("object_label", "object").alias("object_label"), "tier", X.shortened(F.col("evidence")).alias("evidence"))


def first_claims(claims: DataFrame, n: int = 25) -> tuple[DataFrame, DataFrame]:
    """The first n claims by id, and one row ``remaining``: how many more there are.  Either runs only when it is read."""
    remaining = F.greatest(F.lit(0), F.count("*") - n)
    return claims.orderBy("claim_id").limit(n), claims.agg(remaining.cast("long").alias("remaining"))


def entities(claims: DataFrame, namespace: str) -> DataFrame:
    """``entity_id, namespace, label, type`` of all subjects, and of objects that are entities."""
    named = claims.select(F.col("subject").alias("label")).union(claims.where("object_type = 'entity'").select("object")).distinct()
    return named.select(X.deterministic_id("e_", F.lit(namespace), F.col("label")).alias("entity_id"), F.lit(namespace).alias("namespace"), "label", F.lit("entity").alias("type"))


def mounted_law(claims: DataFrame, tier: int = 1) -> DataFrame:
    """Claims strong enough to act on."""
    return claims.where(F.col("tier") <= tier)


def lineage(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``start, node, hop`` along ``src, dst`` edges, up to a number of hops; cycles end there too.

    Each hop is one join, and its frontier one row per start and node."""
    frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop"))
    every = frontier
    for hop in range(1, hops + 1):
        frontier = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(hop).alias("hop")).distinct()
        every = every.union(frontier)
    return every.groupBy("start", "node").agg(F.min("hop").alias("hop"))


def lineage_closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``start, node, hop`` of all that is reached along ``src, dst`` edges, to any depth; cycles are safe.

    Each round follows the edges of what the round before found first, and leaves out what was reached already; it ends when
    nothing is new.  Rounds are cut off by checkpoints, and are as many as the longest of the shortest paths.  Both joins are merges:
    broadcasts would go through the driver anew in each round, while either side is small enough."""
    step = checkpointed(edges.select("src", "dst").distinct()).hint("merge")
    frontier = checkpointed(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct())
    reached, hop = frontier, 0
    while frontier.head(1):
        hop += 1
        new = frontier.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(new.join(reached.hint("merge"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.union(frontier)
    return reached


def lineage_recursive(spark, starts: DataFrame, edges: DataFrame, levels: int = 1000) -> DataFrame:
    """The same in SQL, to any depth within ``levels``; edges must not form a cycle.  LIMIT ALL lifts Spark's limit of a million rows."""
    return spark.sql(
        f"""WITH RECURSIVE reached(start, node, hop) MAX RECURSION LEVEL {int(levels)} AS (
              SELECT node, node, 0 FROM {{starts}}
              UNION ALL SELECT r.start, e.dst, r.hop + 1 FROM reached r JOIN {{edges}} e ON e.src = r.node)
            SELECT start, node, min(hop) AS hop FROM (SELECT * FROM reached LIMIT ALL) GROUP BY start, node""",
        starts=starts, edges=edges,
    )


def citation(shard, relation: str, note: str) -> list:
    """The columns of a reference to a whole shard."""
    return [
        shard.alias("dst_shard_id"), F.lit(relation).alias("relation_type"), F.lit("shard").alias("dst_object_type"), F.lit("").alias("dst_object_id"),
        F.lit("1.0").alias("confidence"), F.lit(note).alias("note"),
    ]
