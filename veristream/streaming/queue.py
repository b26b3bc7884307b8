"""The attestation queue: what is to be anchored in time, kept in two tables that only ever grow by whole batches.

``entries/batch=N`` holds what batch N put in, ``attempts/flush=K`` what flush K tried and what came of it.  Nothing is updated in
place: an entry is the first that was put in under its shard_id, its state is what all attempts say together.  So a batch or a flush
that is repeated after a failure replaces its own folder and changes nothing else, and the order in which batches and flushes are
written doesn't matter.  No network: responses come as a table, from whoever asked the authority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristream.functions import exprs as X

ENTRY = "shard_id string, manifest_sha256 string, query binary, record string, batch long"
ATTEMPT = "shard_id string, anchored boolean, authority string, anchored_at string, error string, flush long"


def entries(shards: DataFrame) -> DataFrame:
    """``shard_id, manifest_sha256, query, record`` of sealed shards ``manifest, publisher_id, created_at, queued_at, note``: the digest of
    the manifest's bytes, the timestamp query over it, and the record as JSON.  A null manifest gives no entry."""
    digest = F.sha2("manifest", 256)
    rows = shards.where("manifest IS NOT NULL").select(F.concat(F.lit("sh1_"), digest).alias("shard_id"), digest.alias("manifest_sha256"), X.timestamp_query(digest).alias("query"), "publisher_id", "created_at", "queued_at", "note")
    record = F.to_json(F.struct("shard_id", "manifest_sha256", "publisher_id", F.col("created_at").alias("created_at_claimed"), F.col("queued_at").alias("queued_at_local_clock"), "note"))
    return rows.select("shard_id", "manifest_sha256", "query", record.alias("record"))


class Queue:
    """A queue in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def put(self, new: DataFrame, batch: int) -> None:
        """Put in entries as batch ``batch``; what is in the queue already keeps its first entry and its state."""
        new.dropDuplicates(["shard_id"]).write.mode("overwrite").parquet(f"{self.folder}/entries/batch={batch}")

    def fed_by(self, stream: DataFrame, checkpoint: str):
        """Gives the writer that puts in each batch of a stream of :func:`entries`; its ``start()`` runs it."""
        return stream.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint)

    def listing(self, before: int | None = None) -> DataFrame:
        """``shard_id, manifest_sha256, query, record, state, attempts, authority, anchored_at, error`` of all entries, after all flushes or
        those ``before`` one.  ANCHORED is for good: the first good response counts."""
        tried = self._table("attempts", ATTEMPT)
        if before is not None:
            tried = tried.where(F.col("flush") < before)
        good = F.when(F.col("anchored"), F.col("flush"))
        tried = tried.groupBy("shard_id").agg(
            F.count("*").alias("attempts"), F.min(good).alias("good"), F.min_by("authority", good).alias("authority"), F.min_by("anchored_at", good).alias("anchored_at"), F.max_by("error", "flush").alias("error"),
        )
        first = self._table("entries", ENTRY).groupBy("shard_id").agg(F.min_by(F.struct("manifest_sha256", "query", "record"), "batch").alias("e"))
        rows = first.join(tried, "shard_id", "left")
        state = F.when(F.col("good").isNotNull(), "ANCHORED").otherwise("PENDING")
        return rows.select("shard_id", "e.*", state.alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "authority", "anchored_at", F.when(state == "PENDING", F.col("error")).alias("error"))

    def flush(self, responses: DataFrame, flush: int) -> DataFrame:
        """Try all entries that are pending before flush ``flush`` with ``shard_id, authority, response`` (one row a shard).  A response that
        holds no time, or none at all, leaves the entry PENDING for the next flush.  Gives the attempts."""
        waiting = self.listing(before=flush).where("state = 'PENDING'").select("shard_id")
        said = responses.select("shard_id", "authority", "response", X.generalized_time(F.col("response")).alias("at"))
        tried = waiting.join(said, "shard_id", "left")
        error = F.when(F.col("response").isNull(), "no response").when(F.col("at").isNull(), "response without time")
        rows = tried.select("shard_id", F.col("at").isNotNull().alias("anchored"), F.when(F.col("at").isNotNull(), F.col("authority")).alias("authority"), F.col("at").alias("anchored_at"), error.alias("error"))
        path = f"{self.folder}/attempts/flush={flush}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
