"""Verification of records: offsets, headers, hashes, chains, continuity, and the log against the disk."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators.shared import placed

#: The record layout (bytes).
FILE_HEADER, RECORD_HEADER, PAYLOAD = 4, 13, 256
RECORD = RECORD_HEADER + PAYLOAD
#: Bytes of a frame record before its payload: the header and two hashes.
FRAME_FIXED = RECORD_HEADER + 64
VERSION = 1


def record_offset(frame_id: Column) -> Column:
    return frame_id * RECORD + FILE_HEADER


def record_verdict(offset: Column, length: Column, frame_id: Column, header: Column, magic_ok: Column, version: Column, found_id: Column, found_size: Column, payload: Column) -> Column:
    """The first check that a fixed-length record fails, in reading order; ``header`` and ``payload`` are bytes present."""
    return (
        F.when(offset != record_offset(frame_id), "OFFSET_MISMATCH").when(length != RECORD, "LEN_MISMATCH").when(header < RECORD_HEADER, "EOF").when(~magic_ok, "BAD_MAGIC")
        .when(version != VERSION, "BAD_VERSION").when(found_id != frame_id, "DRIFT").when(found_size != PAYLOAD, "BAD_DIM").when(payload != found_size, "TORN_WRITE").otherwise("VERIFIED")
    )


def require(df: DataFrame, status: str = "status", good: str = "VERIFIED") -> DataFrame:
    """Strict mode: the job fails on the first row that isn't good."""
    ok = F.col(status) == good
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("verification failed: "), F.coalesce(status, F.lit("null")))).cast("boolean")))


def continuity(records: DataFrame, session: str, number: str) -> DataFrame:
    """``session, n_gaps, n_duplicates, first_gap_after`` of the numbers of each session."""
    w = Window.partitionBy(session).orderBy(number)
    step = F.col(number) - F.lag(number).over(w)
    rows = records.withColumn("step", step).withColumn("before", F.lag(number).over(w))
    return rows.groupBy(F.col(session).alias("session")).agg(F.count_if(F.col("step") > 1).alias("n_gaps"), F.count_if(F.col("step") == 0).alias("n_duplicates"), F.min(F.when(F.col("step") > 1, F.col("before"))).cast("long").alias("first_gap_after"))


def monotonic(records: DataFrame, session: str, number: str, *disk_order: str) -> DataFrame:
    """``session, n_backward``: records whose number doesn't exceed the one before in disk order."""
    w = Window.partitionBy(session).orderBy(*disk_order)
    rows = records.withColumn("bad", F.coalesce(F.col(number) <= F.lag(number).over(w), F.lit(False)))
    return rows.groupBy(F.col(session).alias("session")).agg(F.count_if("bad").alias("n_backward"))


def running_offsets(records: DataFrame, session: str, order: str, size: Column, header: int = 0) -> DataFrame:
    """Add ``offset``: where each record begins, if records stand one after the other behind ``header`` bytes."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)) + header)


def chained(records: DataFrame, session: str, number: str, payload_sha256: Column) -> DataFrame:
    """``session, frame_id, payload_sha256, chain``: the chain written record by record.  A chain is sequential by definition, so a
    session's records go through one task in order, batch after batch; only the last link is carried on.  A record without
    a hash has no link, which breaks the chain there."""
    rows = records.select(F.col(session).cast("string").alias("name"), F.col(session).alias("session"), F.col(number).cast("long").alias("frame_id"), payload_sha256.alias("payload_sha256"))
    start = F.lower(F.hex(F.unhex(X.chain_start(F.col("session")))))
    rows = rows.withColumn("start", start).repartition("session").sortWithinPartitions("session", "frame_id")
    kind = dict(rows.dtypes)["session"]
    return rows.mapInArrow(_links, f"session {kind}, frame_id long, payload_sha256 string, chain string")


def _links(batches):
    session, link = object(), b""
    for batch in batches:
        names, starts, frames, payloads = (batch.column(c).to_pylist() for c in ("name", "start", "frame_id", "payload_sha256"))
        out = []
        for name, start, frame, payload in zip(names, starts, frames, payloads, strict=True):
            if name != session:
                session, link = name, bytes.fromhex(start)
            link = hashlib.sha256(link + bytes.fromhex(payload or "") + frame.to_bytes(4, "little")).digest()
            out.append(link.hex() if payload is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("frame_id"), batch.column("payload_sha256"), pa.array(out, pa.string())], names=["session", "frame_id", "payload_sha256", "chain"])


def last_links(chain: DataFrame) -> DataFrame:
    return chain.groupBy("session").agg(F.count("*").alias("records"), F.max_by("chain", "frame_id").alias("chain"))


def chain_breaks(chain: DataFrame) -> DataFrame:
    """``session, records, first_break``: every link recomputed from the claimed link before it, all rows at once.  If all agree
    the whole chain holds, by induction; else the first that differs is where a sequential reader would stop."""
    w = Window.partitionBy("session").orderBy("frame_id")
    again = X.chain_next(F.coalesce(F.lag("chain").over(w), X.chain_start(F.col("session"))), F.col("payload_sha256"), F.col("frame_id"))
    rows = chain.withColumn("ok", F.coalesce(again == F.col("chain"), F.lit(False)))
    return rows.groupBy("session").agg(F.count("*").alias("records"), F.min(F.when(~F.col("ok"), F.col("frame_id"))).alias("first_break"))


def judge_frames(records: DataFrame, domain: str = "frames@1:") -> DataFrame:
    """``session, frame_id, offset, length, status, content_sha256, chain`` of scanned frame records: a record that the scan found whole
    is judged for its order and its link too.  Every link is recomputed from the claimed link before it, all rows at once; the first of
    a session that isn't VERIFIED is where a sequential reader would stop."""
    w = Window.partitionBy("session").orderBy("offset")
    rows = records.select("session", "frame_id", "offset", "dlen", F.col("status").alias("found"), F.col("payload_sha256").alias("content_sha256"), "chain")
    rows = rows.withColumns({"prior": F.lag("frame_id").over(w), "link": F.coalesce(F.lag("chain").over(w), X.chain_start(F.col("session"), domain))})
    expected = X.chain_next(F.col("link"), F.col("content_sha256"), F.col("frame_id"))
    status = F.when(F.col("found") != "VERIFIED", F.col("found")).when(F.col("frame_id") <= F.col("prior"), "NOT_INCREASING").when(F.col("chain").eqNullSafe(expected), "VERIFIED").otherwise("CHAIN_BROKEN")
    return rows.select("session", "frame_id", "offset", (F.col("dlen") + FRAME_FIXED).alias("length"), status.alias("status"), "content_sha256", "chain")


#: What a log says of a record, in the order in which it is compared with the disk, and the finding where they differ.
COMPARED = {"offset": "reference mismatch", "length": "reference mismatch", "content_sha256": "hash mismatch", "chain": "chain mismatch"}


def cross_check(log: DataFrame, disk: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """``keys, finding`` for a log and a disk: the first of those columns of ``COMPARED`` that both have which differs."""
    both = [c for c in COMPARED if c in log.columns and c in disk.columns]
    a = log.select(*keys, *(F.col(c).alias(f"claimed_{c}") for c in both), F.lit(True).alias("in_log"))
    b = disk.select(*keys, *(F.col(c).alias(f"found_{c}") for c in both), F.lit(True).alias("on_disk"))
    finding = F.when(F.col("on_disk").isNull(), "claimed, not on disk").when(F.col("in_log").isNull(), "on disk, not claimed")
    for c in both:
        finding = finding.when(~F.col(f"claimed_{c}").eqNullSafe(F.col(f"found_{c}")), COMPARED[c])
    return a.join(b, list(keys), "full_outer").select(*keys, finding.otherwise("VERIFIED").alias("finding"))


def span_matches(spans: DataFrame, content: Column, start: Column, end: Column, claimed: Column) -> DataFrame:
    """Add ``matches``: whether the claimed text is, byte for byte, what the content holds from ``start`` to ``end``.  A span
    that isn't inside the content, or a null, doesn't match."""
    inside = (start >= 0) & (end >= start) & (end <= F.octet_length(content))
    same = F.substring(content, start.cast("int") + 1, (end - start).cast("int")) == claimed.cast("binary")
    return spans.withColumn("matches", F.coalesce(inside & same, F.lit(False)))


def missing_by_block(ids: DataFrame, present: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """``block, missing, n_missing``: the ids that aren't present, as one text for each block of ids; a block's list is bounded."""
    gone = ids.select(key).join(present.select(key), key, "left_anti").distinct()
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ", "), F.lit("]"))
    return gone.groupBy(F.floor(F.col(key) / block).alias("block")).agg(listed.alias("missing"), F.count("*").alias("n_missing"))


def merkle_roots(leaves: DataFrame, group: str, path: str, content_sha256: str) -> DataFrame:
    """``group, leaves, root`` with SHA-256: leaf = H(00 | path | 00 | content hash), node = H(01 | left | right), an odd leaf goes
    up.  Leaves are numbered by ranges and each level is one grouped aggregation, so a group may be larger than a task."""
    nodes = placed(leaves, group, [F.col(path)], "place")
    leaf = F.sha2(F.concat(F.unhex(F.lit("00")), F.col(path).cast("string").cast("binary"), F.unhex(F.lit("00")), F.unhex(content_sha256)), 256)
    nodes = nodes.select(F.col(group).alias("g"), "place", leaf.alias("node"))
    sizes = leaves.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("leaves"))
    most = sizes.agg(F.max("leaves")).first()[0] or 0
    for _ in range(max(0, most - 1).bit_length()):
        left, right = F.max(F.when(F.col("place") % 2 == 0, F.col("node"))), F.max(F.when(F.col("place") % 2 == 1, F.col("node")))
        pair = F.when(right.isNull(), left).otherwise(F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256))
        nodes = nodes.groupBy("g", F.floor(F.col("place") / 2).alias("p")).agg(pair.alias("node")).withColumnRenamed("p", "place")
    return nodes.join(sizes, "g").select(F.col("g").alias(group), "leaves", F.col("node").alias("root"))
