"""Whole flows: record missions, compile capsules into graph tables, train an envelope, fly under it.

A capsule is a folder of one session with ``events.jsonl``, ``cam_latents.bin`` and ``cam_residuals.bin``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators import envelope as E
from veristream.operators import extract as C
from veristream.operators import govern as G
from veristream.operators import graph as H
from veristream.operators import guard as D
from veristream.operators import verify as V
from veristream.operators import windows as W
from veristream.sources import framed, generate

#: The declared superset of an event's keys.
EVENT = (
    "frame_id long, robot_id string, evt string, surface string, action string, value string, selected_action string, action_distribution map<string,double>, "
    "envelope_shard_id string, reason string, source string, sensor_id string, first_kept_frame_id long, content_sha256 string, chain string, "
    "stream_refs struct<latents: struct<file: string, offset: long, length: long>, frames: struct<file: string, offset: long, length: long>>"
)


def record(spark, folder: str, missions: DataFrame, pre: int = 20, post: int = 20, robot: str = "robot-001") -> DataFrame:
    """Write missions (see :mod:`veristream.sources.generate`) as capsules: the hot stream whole, of the cold stream only what the windows around
    events keep.  Gives ``session, frames, kept, triggers, triggered``."""
    framed.write_hot(missions.select("session", "frame_id", F.col("latents").alias("payload")), folder).collect()  # one row a session
    trigger = F.col("evt").isNotNull()
    kept = W.keep_latched(missions, trigger, pre, post)
    framed.write_cold(kept.where("kept").select("session", "frame_id", F.col("residual").alias("payload")), folder).collect()
    ref = F.struct(F.struct(F.lit("cam_latents.bin").alias("file"), V.record_offset(F.col("frame_id")).alias("offset"), F.lit(V.RECORD).alias("length")).alias("latents"))
    base = F.to_json(F.struct("frame_id", F.lit(robot).alias("robot_id"), F.col("action").alias("selected_action"), F.col("distribution").alias("action_distribution"), ref.alias("stream_refs")))
    extra = F.when(trigger, F.to_json(F.struct("evt", F.lit("ice").alias("surface"))))
    framed.write_event_log(missions.select("session", "frame_id", base.alias("base"), extra.alias("extra")), folder).collect()
    summary = W.summary(kept, trigger)
    framed.write_summaries(summary.select("session", F.struct(F.col("session").alias("session_id"), F.lit(robot).alias("robot_id"), F.col("observed").alias("frames"), "triggered").alias("summary")), folder).collect()
    return summary


def capture(spark, folder: str, frames: DataFrame, pre: int = 10, post: int = 10) -> DataFrame:
    """Write the frames ``session, frame_id, payload, trigger`` that the windows around triggers keep, and a log that claims each by its
    place, hash and link, and states triggers and windows' ends.  Gives ``session, observed, kept, triggers, triggered``."""
    judged = W.keep_extending(frames, F.col("trigger"), pre, post)
    kept = judged.where("kept")
    framed.write_frames(kept.select("session", "frame_id", "payload"), folder).collect()  # one row a session
    size = F.octet_length("payload") + V.FRAME_FIXED
    placed = V.running_offsets(kept, "session", "frame_id", size, V.FILE_HEADER).select("session", "frame_id", "offset", size.cast("long").alias("length"))
    rows = placed.join(V.chained(kept, "session", "frame_id", F.sha2("payload", 256)), ["session", "frame_id"])
    ref = F.struct(F.struct(F.lit("frames.bin").alias("file"), "offset", "length").alias("frames"))
    line = F.to_json(F.struct("frame_id", F.lit("frame_kept").alias("evt"), ref.alias("stream_refs"), F.col("payload_sha256").alias("content_sha256"), "chain"))
    lines = rows.select("session", "frame_id", line.alias("base"))
    said = F.to_json(F.struct("frame_id", F.lit("capture_trigger").alias("evt"), F.lit("trigger").alias("reason"), F.lit("caller").alias("source")))
    lines = lines.union(frames.where("trigger").select("session", "frame_id", said.alias("base")))
    closed = F.to_json(F.struct(F.col("last_frame").alias("frame_id"), F.lit("capture_window_closed").alias("evt")))
    lines = lines.union(W.brackets(kept.select("session", "frame_id")).select("session", F.col("last_frame").alias("frame_id"), closed.alias("base")))
    framed.write_event_log(lines.withColumn("extra", F.lit(None).cast("string")), folder).collect()
    return W.summary(judged, F.col("trigger"))


def capture_findings(spark, folder: str) -> DataFrame:
    """``session, frame_id, finding`` of captures: records that the scan or the judge refuses, and where log and disk disagree.  With
    :func:`veristream.operators.verify.require` on ``finding`` the first is fatal."""
    records = V.judge_frames(framed.scan(spark, "frames", folder))
    ref = F.col("stream_refs.frames")
    kept = events(event_lines(spark, folder)).where("evt = 'frame_kept'")
    log = kept.select("session", "frame_id", ref["offset"].alias("offset"), ref["length"].alias("length"), "content_sha256", "chain")
    damaged = records.where("status <> 'VERIFIED'").select("session", "frame_id", F.col("status").alias("finding"))
    return V.cross_check(log, records.where("status = 'VERIFIED'"), ("session", "frame_id")).unionByName(damaged)


def event_lines(spark, folder: str) -> DataFrame:
    """``session, source_hash, position, line, byte_start, byte_end``: the lines of all event logs, with their bytes' places and
    the hash of the log's bytes.

    A capsule's log is read whole by one task, as its lines are numbered; capsules are spread over tasks."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "events.jsonl").text(folder, wholetext=True)
    lines = whole.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("session"), F.sha2("value", 256).alias("source_hash"), F.posexplode(F.split("value", "\n")).alias("position", "line"))
    placed = V.running_offsets(lines, "session", "position", F.octet_length("line") + 1).withColumnRenamed("offset", "byte_start")
    return placed.where("line <> ''").withColumn("byte_end", F.col("byte_start") + F.octet_length("line"))


def _number(key: str):
    """A key's value where the JSON holds a number, else null (texts such as "inf", and booleans)."""
    v = F.try_variant_get(F.parse_json("line"), f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "BIGINT", "FLOAT"), F.try_variant_get(v, "$", "double"))


def events(lines: DataFrame) -> DataFrame:
    parsed = lines.withColumn("e", F.from_json("line", EVENT)).withColumn("l_inf", _number("l_inf")).withColumn("bound", _number("bound"))
    e = parsed.select("session", "source_hash", "position", "line", "byte_start", "byte_end", "l_inf", "bound", "e.*")
    return e.withColumn("robot", F.col("robot_id")).withColumn("has_distribution", F.col("action_distribution").isNotNull())


#: Namespace of a graph's entities, unless another is given.
NAMESPACE = "telemetry"
#: Fixed value: what a breach's reference says.
IN_FORCE = "safety envelope in force at the moment of the breach"


def graph_tables(spark, folder: str, namespace: str = NAMESPACE) -> dict[str, DataFrame]:
    """``claims``, ``entities``, ``spans``, ``provenance``, ``references`` and ``streams`` of all capsules below a folder.  A source is known by the hash of
    its log's bytes, so a log that is changed has other spans."""
    log = events(event_lines(spark, folder))
    where = ["session", "source_hash", "line", "byte_start", "byte_end"]
    plain = C.event_claims(log, *where, "envelope_shard_id")
    literal = X.decision_literal(F.col("action"), F.col("confidence"))
    weighed = C.considered(log.where("selected_action IS NOT NULL"), F.col("action_distribution"), *where, "robot")
    weighed = weighed.select(
        *where, F.lit(None).cast("string").alias("envelope_shard_id"), F.coalesce("robot", F.lit("robot-001")).alias("subject"), F.lit("considered_action").alias("predicate"),
        literal.alias("object"), F.lit(C.TEXT).alias("object_type"), F.lit(2).alias("tier"),
    )
    every = _cited(plain.unionByName(weighed))
    # A breach cites the envelope that was in force.
    cites = every.where("predicate = 'breached_envelope' AND envelope_shard_id IS NOT NULL")
    return _graph(every, namespace) | {
        "references": cites.select("claim_id", *H.citation(F.col("envelope_shard_id"), "cites", IN_FORCE)).distinct(),
        "streams": stream_index(spark, folder),
    }


def capture_tables(spark, folder: str, namespace: str = NAMESPACE) -> dict[str, DataFrame]:
    """``claims``, ``entities``, ``spans``, ``provenance`` and ``streams`` of all captures below a folder.  Their records are judged first: a capture
    that was tampered with, cut or reordered, or whose log and disk disagree, fails before anything is built."""
    V.require(capture_findings(spark, folder), "finding").write.format("noop").mode("overwrite").save()
    log = events(event_lines(spark, folder)).withColumnsRenamed({"sensor_id": "sensor", "first_kept_frame_id": "first_kept"})
    every = _cited(C.capture_claims(log, "session", "source_hash", "line", "byte_start", "byte_end"))
    records = V.judge_frames(framed.scan(spark, "frames", folder))
    streams = records.select("session", "frame_id", F.lit("frames").alias("stream"), F.lit("frames.bin").alias("file"), "offset", "length", "status", F.col("content_sha256").alias("content_hash"))
    return _graph(every, namespace) | {"streams": streams}


def _cited(claims: DataFrame) -> DataFrame:
    """Distinct claims with their ids and those of the lines that they cite."""
    every = C.distinct_claims(claims.withColumn("evidence", F.concat("session", F.lit("\0"), "line")))
    every = every.withColumn("claim_id", X.deterministic_id("c_", F.col("subject"), F.col("predicate"), F.col("object"), F.col("object_type")))
    return every.withColumn("span_id", X.deterministic_id("s_", F.col("source_hash"), F.col("byte_start").cast("string"), F.col("byte_end").cast("string"), F.col("line")))


def _graph(every: DataFrame, namespace: str) -> dict[str, DataFrame]:
    claims = every.select("claim_id", "subject", "predicate", "object", "object_type", "tier").dropDuplicates(["claim_id"])
    return {
        "claims": claims,
        "entities": H.entities(claims, namespace),
        "spans": every.select("span_id", "source_hash", "byte_start", "byte_end", F.col("line").alias("text")).distinct(),
        "provenance": every.select(X.deterministic_id("p_", F.col("claim_id"), F.col("span_id")).alias("provenance_id"), "claim_id", "span_id", "source_hash", "byte_start", "byte_end").distinct(),
    }


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the tables of a graph as Parquet, sorted by all of their columns, so that equal graphs give equal rows in equal order.  Without
    claims nothing is written: the job fails."""
    for name in ["claims", *(n for n in tables if n != "claims")]:
        rows = E.require_rows(tables[name], "claims") if name == "claims" else tables[name]
        rows.orderBy(*rows.columns).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream_index(spark, folder: str, strict: bool = False) -> DataFrame:
    """``session, frame_id, stream, file, offset, length, status, content_hash``: what each event claims of the hot stream, judged, and the cold
    records of frames that have an event.  ``strict`` fails on the first claim that isn't verified, and on a cold record of
    another version or over the size limit; damage that a cold scan can pass over is none."""
    framed.register(spark)
    claimed = events(event_lines(spark, folder)).select("session", "frame_id", F.col("stream_refs.latents.offset").alias("claimed"), F.col("stream_refs.latents.length").alias("length"))
    scan = lambda kind: spark.read.format("framed").option("kind", kind).load(folder)
    hot = scan("hot").select(F.col("session").alias("s"), "offset", F.col("status").alias("found"), F.col("payload_sha256").alias("content_hash"))
    met = claimed.join(hot, (F.col("session") == F.col("s")) & (F.col("claimed") == F.col("offset")), "left")
    status = F.when(F.col("claimed") != V.record_offset(F.col("frame_id")), "OFFSET_MISMATCH").when(F.col("length") != V.RECORD, "LEN_MISMATCH").otherwise(F.coalesce("found", F.lit("EOF")))
    hot = met.select("session", "frame_id", F.lit("latents").alias("stream"), F.lit("cam_latents.bin").alias("file"), F.col("claimed").alias("offset"), F.col("length").cast("long").alias("length"), status.alias("status"), F.when(status == "VERIFIED", F.col("content_hash")).alias("content_hash"))
    if strict:
        hot = V.require(hot)
    last = Window.partitionBy("session", "frame_id").orderBy(F.col("offset").desc())
    whole = F.col("status") == "VERIFIED"
    if strict:
        # One condition: as two filters the second could see only what the first leaves.
        fatal = F.raise_error(F.concat(F.lit("verification failed: "), "status")).cast("boolean")
        whole = F.when(F.col("status").isin("BAD_VERSION", "TOO_LARGE"), fatal).otherwise(whole)
    cold = framed.scan(spark, "cold", folder).where(whole).withColumn("n", F.row_number().over(last)).where("n = 1")
    cold = cold.join(claimed.select("session", "frame_id").distinct(), ["session", "frame_id"], "left_semi")
    cold = cold.select("session", "frame_id", F.lit("residuals").alias("stream"), F.lit("cam_residuals.bin").alias("file"), "offset", (F.col("dlen") + framed.HEADER_BYTES).alias("length"), "status", F.col("payload_sha256").alias("content_hash"))
    return hot.unionByName(cold)


def capsule_frames(spark, folder: str) -> DataFrame:
    """``session, frame_id, action, norm`` of all capsules: events that name an action, with the norm of the record they refer to."""
    framed.register(spark)
    named = E.complete(events(event_lines(spark, folder)).select("session", "frame_id", F.col("selected_action").alias("action"), F.col("stream_refs.latents.offset").alias("ref")))
    hot = generate.vectors(spark.read.format("framed").option("kind", "hot").load(folder).select("session", "offset", "payload"))
    return named.join(hot.withColumnRenamed("offset", "ref"), ["session", "ref"], "left").select("session", "frame_id", "action", X.linf(F.col("vector")).alias("norm"))


def train(spark, folder: str) -> DataFrame:
    """The envelope of all training capsules below a folder, those that have both a log and a hot stream; the job fails if no frame gives a
    norm."""
    capsules = framed.discover(framed.listed(spark, folder, "cam_latents.bin"), framed.listed(spark, folder, "events.jsonl"))
    return E.require_rows(E.learn(capsule_frames(spark, folder).join(capsules, "session", "left_semi")), "frames to learn from")


def fly(frames: DataFrame, envelope: DataFrame, shard: DataFrame, store: DataFrame, max_tier: int = 0) -> tuple[DataFrame, DataFrame]:
    """Authorise one shard, then guard frames by its envelope.  Gives decisions and, for each session with a breach, an incident that cites the
    shard.  Without authorisation nothing is permitted: the envelope is empty."""
    granted = G.authorise(shard, store, max_tier).where("decision = 'AUTHORISED'").limit(1)
    law = envelope.join(F.broadcast(granted.select(F.col("shard_id").alias("law"))), F.lit(True), "inner")
    decisions = D.decide(frames, law)
    incidents = D.first_breach(decisions).where("breach_frame IS NOT NULL").join(F.broadcast(shard.limit(1).select(F.col("shard_id").alias("cites"))), F.lit(True), "inner")
    return decisions, incidents


def trusted_keys(spark, folder: str, store: DataFrame) -> DataFrame:
    """``path, fingerprint`` of the public keys in a folder that the trust store holds."""
    keys = spark.read.format("binaryFile").option("pathGlobFilter", "*.pub").load(folder).select("path", F.sha2("content", 256).alias("fingerprint"))
    return keys.join(store.select("fingerprint").distinct(), "fingerprint", "left_semi").orderBy("path")
