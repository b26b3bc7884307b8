"""Verification and attestation over payloads, record streams and chained sessions."""

from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators import attest as T
from veristream.operators import extract as C
from veristream.operators import govern as G
from veristream.operators import verify as V
from veristream.sources import framed

from .catalog import query, table


@query("payload_hashes", "SELECT doc_id, sha256(text) AS content_sha256, strlen(text)::bigint AS bytes, strlen(text) BETWEEN 1 AND 10000 AS valid FROM documents")
def payload_hashes(spark, d):
    size = F.octet_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"), size.alias("bytes"), size.between(1, 10000).alias("valid"))


@query("payload_digest_check", "SELECT doc_id, doc_id % 9 <> 0 AS ok FROM documents")
def payload_digest_check(spark, d):
    claimed = table(spark, d, "documents").withColumn("claimed", F.when(F.col("doc_id") % 9 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)))
    return claimed.select("doc_id", (F.sha2("text", 256) == F.col("claimed")).alias("ok"))


@query("continuity_gaps", """WITH s AS (SELECT l_orderkey AS session, l_linenumber AS n, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM lineitem)
SELECT session, count(*) FILTER (n - p > 1) AS n_gaps, count(*) FILTER (n = p) AS n_duplicates, min(CASE WHEN n - p > 1 THEN p END)::bigint AS first_gap_after FROM s GROUP BY session""")
def continuity_gaps(spark, d):
    return V.continuity(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("monotonic_check", "WITH s AS (SELECT user_id AS session, ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) SELECT session, count(*) FILTER (bad) AS n_backward FROM s GROUP BY session")
def monotonic_check(spark, d):
    return V.monotonic(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("running_offsets", "SELECT conv_id, turn, 4 + coalesce(sum(77 + strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS \"offset\" FROM conversations")
def running_offsets(spark, d):
    return V.running_offsets(table(spark, d, "conversations"), "conv_id", "turn", F.octet_length("text") + 77, 4).select("conv_id", "turn", "offset")


LE32 = "unhex(substr(printf('%08x', {n}), 7, 2) || substr(printf('%08x', {n}), 5, 2) || substr(printf('%08x', {n}), 3, 2) || substr(printf('%08x', {n}), 1, 2))"
CHAIN = f"""p AS (SELECT conv_id AS session, turn AS frame_id, sha256(text) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
c(session, frame_id, h, k, chain) AS (
SELECT session, frame_id, h, k, sha256(unhex(sha256('frames@1:' || session)) || unhex(h) || {LE32.format(n="frame_id")}) FROM p WHERE k = 1
UNION ALL SELECT p.session, p.frame_id, p.h, p.k, sha256(unhex(c.chain) || unhex(p.h) || {LE32.format(n="p.frame_id")}) FROM c JOIN p ON p.session = c.session AND p.k = c.k + 1)"""
BREAKS = f"""v AS (SELECT session, frame_id, chain, h, coalesce(lag(chain) OVER (PARTITION BY session ORDER BY frame_id), sha256('frames@1:' || session)) AS before FROM {{rows}}),
w AS (SELECT session, frame_id, sha256(unhex(before) || unhex(h) || {LE32.format(n="frame_id")}) = chain AS ok FROM v)
SELECT session, count(*) AS records, min(CASE WHEN NOT ok THEN frame_id END) AS first_break FROM w GROUP BY session"""


def chain(spark, d):
    return V.chained(table(spark, d, "conversations"), "conv_id", "turn", F.sha2("text", 256))


@query("hash_chain_fold", f"WITH RECURSIVE {CHAIN} SELECT session, count(*) AS records, arg_max(chain, frame_id) AS chain FROM c GROUP BY session")
def hash_chain_fold(spark, d):
    return V.last_links(chain(spark, d))


@query("hash_chain_verify", f"WITH RECURSIVE {CHAIN}, " + BREAKS.format(rows="c"))
def hash_chain_verify(spark, d):
    return V.chain_breaks(chain(spark, d))


@query("hash_chain_excised", f"WITH RECURSIVE {CHAIN}, " + BREAKS.format(rows="(SELECT * FROM c WHERE NOT (session % 3 = 0 AND frame_id = 1))"))
def hash_chain_excised(spark, d):
    return V.chain_breaks(chain(spark, d).where("NOT (session % 3 = 0 AND frame_id = 1)"))


@query("frame_judge", f"""WITH RECURSIVE {CHAIN},
f AS (SELECT session, frame_id, 4 + sum(77 + strlen(t.text)) OVER (PARTITION BY session ORDER BY frame_id) - 77 - strlen(t.text) AS "offset", 77 + strlen(t.text) AS length, h, chain FROM c JOIN conversations t ON t.conv_id = session AND t.turn = frame_id),
g AS (SELECT session, CASE WHEN session % 5 = 2 AND frame_id = 2 THEN 1 ELSE frame_id END AS frame_id, "offset", length, h, CASE WHEN session % 7 = 4 AND frame_id = 0 THEN h ELSE chain END AS chain FROM f WHERE NOT (session % 3 = 0 AND frame_id = 1)),
w AS (SELECT *, lag(frame_id) OVER o AS prior, coalesce(lag(chain) OVER o, sha256('frames@1:' || session)) AS link FROM g WINDOW o AS (PARTITION BY session ORDER BY "offset"))
SELECT session, frame_id, "offset"::bigint AS "offset", length::bigint AS length, h AS content_sha256, chain,
CASE WHEN frame_id <= prior THEN 'NOT_INCREASING' WHEN chain = sha256(unhex(link) || unhex(h) || {LE32.format(n="frame_id")}) THEN 'VERIFIED' ELSE 'CHAIN_BROKEN' END AS status FROM w""")
def frame_judge(spark, d):
    """Records of which some are cut out, numbered again or linked wrongly."""
    session, turn = F.col("session"), F.col("frame_id")
    kept = frame_records(spark, d).where("NOT (session % 3 = 0 AND frame_id = 1)")
    wrong = F.when((session % 7 == 4) & (turn == 0), F.col("payload_sha256")).otherwise(F.col("chain"))
    again = F.when((session % 5 == 2) & (turn == 2), 1).otherwise(turn).cast("long")
    return V.judge_frames(kept.withColumns({"chain": wrong, "frame_id": again}))


def frame_records(spark, d):
    """Conversations as whole frame records, one after the other on disk."""
    size = F.octet_length("text")
    rows = V.running_offsets(table(spark, d, "conversations"), "conv_id", "turn", size + V.FRAME_FIXED, 4)
    rows = rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("frame_id"), "offset", size.cast("long").alias("dlen"), F.lit("VERIFIED").alias("status"))
    return rows.join(chain(spark, d), ["session", "frame_id"])


@query("frame_log_crosscheck", f"""WITH RECURSIVE {CHAIN},
f AS (SELECT session, frame_id, 4 + sum(77 + strlen(t.text)) OVER (PARTITION BY session ORDER BY frame_id) - 77 - strlen(t.text) AS "offset", h, chain FROM c JOIN conversations t ON t.conv_id = session AND t.turn = frame_id),
l AS (SELECT session, frame_id, CASE WHEN frame_id % 7 = 3 THEN "offset" + 1 ELSE "offset" END AS "offset", CASE WHEN frame_id % 5 = 2 THEN chain ELSE h END AS h, CASE WHEN session % 4 = 1 THEN h ELSE chain END AS chain FROM f WHERE session % 6 <> 5 OR frame_id > 0),
k AS (SELECT * FROM f WHERE session % 9 <> 0 OR frame_id <> 1)
SELECT session, frame_id, CASE WHEN k.h IS NULL THEN 'claimed, not on disk' WHEN l.h IS NULL THEN 'on disk, not claimed' WHEN l."offset" <> k."offset" THEN 'reference mismatch' WHEN l.h <> k.h THEN 'hash mismatch' WHEN l.chain <> k.chain THEN 'chain mismatch' ELSE 'VERIFIED' END AS finding
FROM l FULL JOIN k USING (session, frame_id)""")
def frame_log_crosscheck(spark, d):
    """A log whose references, hashes and links lie here and there, against the judged records."""
    disk = V.judge_frames(frame_records(spark, d))
    turn, session = F.col("frame_id"), F.col("session")
    lies = {
        "offset": F.when(turn % 7 == 3, F.col("offset") + 1).otherwise(F.col("offset")),
        "content_sha256": F.when(turn % 5 == 2, F.col("chain")).otherwise(F.col("content_sha256")),
        "chain": F.when(session % 4 == 1, F.col("content_sha256")).otherwise(F.col("chain")),
    }
    log = disk.withColumns(lies).where("session % 6 <> 5 OR frame_id > 0")
    return V.cross_check(log, disk.where("session % 9 <> 0 OR frame_id <> 1"), ("session", "frame_id"))


LOG = "log AS (SELECT doc_id AS frame_id, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS content_sha256 FROM labels JOIN documents USING (doc_id))"


def log_and_disk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    log = table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("frame_id"), F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_sha256"))
    return log, docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("frame_id"), F.sha2("text", 256).alias("content_sha256"))


@query("log_disk_crosscheck", f"""WITH {LOG}, disk AS (SELECT doc_id AS frame_id, sha256(text) AS content_sha256 FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(l.frame_id, k.frame_id) AS frame_id, CASE WHEN k.frame_id IS NULL THEN 'claimed, not on disk' WHEN l.frame_id IS NULL THEN 'on disk, not claimed' WHEN l.content_sha256 <> k.content_sha256 THEN 'hash mismatch' ELSE 'VERIFIED' END AS finding
FROM log l FULL JOIN disk k ON k.frame_id = l.frame_id""")
def log_disk_crosscheck(spark, d):
    return V.cross_check(*log_and_disk(spark, d))


@query("unclaimed_frames", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unclaimed_frames(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("missing_ids", """SELECT floor(doc_id / 1000)::bigint AS block, list(doc_id ORDER BY doc_id)::varchar AS missing, count(*) AS n_missing
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1""")
def missing_ids(spark, d):
    return V.missing_by_block(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("discovery_semi", "SELECT doc_id::varchar AS session FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def discovery_semi(spark, d):
    session = F.col("doc_id").cast("string").alias("session")
    return framed.discover(table(spark, d, "documents").select(session), table(spark, d, "labels").where("quality = 1").select(session))


def verdict_input(spark, d):
    n, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        n.alias("frame_id"), line.alias("line"), (V.record_offset(n) + F.when(line == 2, 13).otherwise(0)).alias("offset"), F.when(line == 3, 268).otherwise(269).alias("length"),
        F.when(n % 97 == 0, 5).otherwise(13).alias("header"), (n % 89 != 0).alias("magic_ok"), F.when(n % 83 == 0, 2).otherwise(1).alias("version"),
        (n + F.when(line == 4, 1).otherwise(0)).alias("found_id"), F.when(line == 5, 128).otherwise(256).alias("found_size"), F.when(line == 6, 100).otherwise(256).alias("payload"),
    )


VERDICT = """SELECT l_orderkey AS frame_id, l_linenumber AS line, CASE WHEN l_linenumber = 2 THEN 'OFFSET_MISMATCH' WHEN l_linenumber = 3 THEN 'LEN_MISMATCH' WHEN l_orderkey % 97 = 0 THEN 'EOF' WHEN l_orderkey % 89 = 0 THEN 'BAD_MAGIC'
 WHEN l_orderkey % 83 = 0 THEN 'BAD_VERSION' WHEN l_linenumber = 4 THEN 'DRIFT' WHEN l_linenumber = 5 THEN 'BAD_DIM' WHEN l_linenumber = 6 THEN 'TORN_WRITE' ELSE 'VERIFIED' END AS status FROM lineitem"""


@query("record_verdicts", VERDICT)
def record_verdicts(spark, d):
    c = F.col
    return verdict_input(spark, d).select("frame_id", "line", V.record_verdict(c("offset"), c("length"), c("frame_id"), c("header"), c("magic_ok"), c("version"), c("found_id"), c("found_size"), c("payload")).alias("status"))


@query("scan_stats", f"SELECT count(*) FILTER (status = 'VERIFIED') AS records, count(*) FILTER (status = 'BAD_MAGIC') AS corrupt_headers, 0 AS resyncs, (269 * count(*) FILTER (status = 'BAD_MAGIC'))::bigint AS garbage_bytes FROM ({VERDICT})")
def scan_stats(spark, d):
    garbage = F.when(F.col("status") == "BAD_MAGIC", V.RECORD).otherwise(0).cast("long")
    return framed.scan_stats(record_verdicts(spark, d).withColumn("garbage", garbage))


@query("claimed_offset_join", """WITH disk AS (SELECT DISTINCT 4 + l_orderkey * 269 AS "offset", l_orderkey AS found_id FROM lineitem WHERE l_orderkey % 10 <> 0),
log AS (SELECT o_orderkey AS frame_id, 4 + o_orderkey * 269 AS "offset" FROM orders) SELECT frame_id, log."offset", found_id FROM log JOIN disk ON disk."offset" = log."offset" """)
def claimed_offset_join(spark, d):
    disk = table(spark, d, "lineitem").where("l_orderkey % 10 <> 0").select(V.record_offset(F.col("l_orderkey")).alias("offset"), X.from_le32(X.le32(F.col("l_orderkey"))).alias("found_id")).distinct()
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), V.record_offset(F.col("o_orderkey")).alias("offset"))
    return log.join(disk, "offset").select("frame_id", "offset", "found_id")


DAMAGE = """CASE WHEN doc_id % 23 = 0 THEN 'OFFSET_MISMATCH' WHEN doc_id % 13 = 0 THEN 'EOF' WHEN doc_id % 17 = 0 THEN 'DRIFT' WHEN doc_id % 19 = 0 THEN 'TORN_WRITE' ELSE 'VERIFIED' END"""


def streams_on_disk(docs):
    """Records as they are found: every thirteenth is cut out, others hold another frame's id or lack the end of their payload."""
    n = F.col("doc_id")
    return docs.where(n % 13 != 0).select(
        V.record_offset(n).alias("offset"), (n + F.when(n % 17 == 0, 1).otherwise(0)).alias("found_id"), F.when(n % 19 == 0, 100).otherwise(V.PAYLOAD).alias("present"),
        F.sha2("text", 256).alias("found_hash"),
    )


@query("streams_index", f"""SELECT doc_id AS frame_id, 'latents' AS stream, 'cam_latents.bin' AS file, 4 + doc_id * 269 + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS "offset", 269::bigint AS length, {DAMAGE} AS status,
 CASE WHEN {DAMAGE} = 'VERIFIED' THEN sha256(text) END AS content_hash FROM documents
UNION ALL SELECT doc_id, 'residuals', 'cam_residuals.bin', doc_id * 13, 13 + n_chars, 'VERIFIED', sha256(text) FROM documents JOIN labels USING (doc_id)""")
def streams_index(spark, d):
    """What a log claims of the hot stream, judged against the records found at the claimed places, and cold records of logged frames."""
    docs, n = table(spark, d, "documents"), F.col("frame_id")
    claimed = docs.select(F.col("doc_id").alias("frame_id"), (V.record_offset(F.col("doc_id")) + F.when(F.col("doc_id") % 23 == 0, 1).otherwise(0)).alias("offset"), F.lit(V.RECORD).cast("long").alias("length"))
    met = claimed.join(streams_on_disk(docs), "offset", "left")
    header = F.when(F.col("found_id").isNull(), 0).otherwise(V.RECORD_HEADER)
    status = V.record_verdict(F.col("offset"), F.col("length"), n, header, F.lit(True), F.lit(V.VERSION), F.col("found_id"), F.lit(V.PAYLOAD), F.col("present"))
    hot = met.withColumn("status", status).select("frame_id", F.lit("latents").alias("stream"), F.lit("cam_latents.bin").alias("file"), "offset", "length", "status", F.when(F.col("status") == "VERIFIED", F.col("found_hash")).alias("content_hash"))
    found = docs.select(F.col("doc_id").alias("frame_id"), F.lit("residuals").alias("stream"), F.lit("cam_residuals.bin").alias("file"), (F.col("doc_id") * 13).alias("offset"), (F.col("n_chars") + 13).alias("length"), F.sha2("text", 256).alias("content_hash"))
    verdict = V.cross_check(table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("frame_id"), F.sha2("text", 256).alias("content_sha256")), found.select("frame_id", F.col("content_hash").alias("content_sha256")))
    cold = found.join(verdict.where("finding = 'VERIFIED'").withColumnRenamed("finding", "status"), "frame_id")
    return hot.unionByName(cold.select(hot.columns))


def span_matches(docs):
    """Whether the claimed texts of a document are the bytes of their spans.  The spans are three that together hold every byte
    of its text, empty ones for an empty text; one of them in every sixth document is tampered with."""
    n = F.col("doc_id")
    content = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("content"))
    edge = lambda k: (F.octet_length("content").cast("long") * k / 3).cast("long")
    spans = content.select("doc_id", "content", F.posexplode(F.array(*(F.struct(edge(k).alias("start"), edge(k + 1).alias("end")) for k in range(3)))).alias("k", "span")).select("*", "span.*")
    said = F.substring(F.col("content"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    here = (n % 6 == 0) & (F.col("k") == F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    # A claim that is tampered with is a byte longer: it never equals the span.
    claimed = spans.withColumn("said", F.when(here, F.concat(said, F.lit("!").cast("binary"))).otherwise(said))
    judged = V.span_matches(claimed, F.col("content"), F.col("start"), F.col("end"), F.col("said"))
    return judged.groupBy("doc_id").agg(F.bool_and("matches").alias("matches"))


@query("span_text_matches", "SELECT doc_id, doc_id % 6 <> 0 AS matches FROM documents")
def span_text_matches(spark, d):
    return span_matches(table(spark, d, "documents"))


@query("tsq_encode", f"SELECT doc_id, lower('{X.QUERY_HEAD}' || sha256(text) || '{X.QUERY_TAIL}') AS query FROM documents")
def tsq_encode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(X.timestamp_query(F.sha2("text", 256)))).alias("query"))


@query("gentime_extract", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN '2024-0' || (doc_id % 9 + 1) || '-11T10:09:08Z' END AS gen_time FROM documents")
def gentime_extract(spark, d):
    mark = lambda *t: F.concat(F.unhex(F.lit("180F")), F.concat(*t).cast("binary"))
    good = mark(F.lit("20240"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("11100908Z"))
    blob = F.concat(F.encode("text", "UTF-8"), mark(F.lit("2024x101000000Z")), F.when(F.col("doc_id") % 3 != 0, good).otherwise(F.lit("").cast("binary")))
    return table(spark, d, "documents").select("doc_id", X.generalized_time(blob).alias("gen_time"))


ID24 = " || ".join(f"substr('{X.BASE32}', (((('0x' || substr(h, {at}, 10))::bigint >> {35 - 5 * k}) & 31) + 1)::bigint, 1)" for at in (1, 11, 21) for k in range(8))


@query("deterministic_ids", f"WITH s AS (SELECT doc_id, sha256(source || chr(0) || doc_id || chr(0) || n_chars || chr(0) || lang) AS h FROM documents) SELECT doc_id, 's_' || {ID24} AS span_id FROM s")
def deterministic_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.deterministic_id("s_", F.col("source"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.col("lang")).alias("span_id"))


def queue(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("manifest"), F.concat(F.lit("sh1_"), F.sha2("text", 256)).alias("shard_id"), F.sha2("text", 256).alias("digest"))
    return docs.withColumn("record_sha256", F.when(n % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("digest"))).withColumn("query", X.timestamp_query(F.when(n % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("digest"))))


@query("queue_consistency", "SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS consistent FROM documents")
def queue_consistency(spark, d):
    return T.consistent(queue(spark, d)).select("doc_id", "consistent")


@query("queue_live_consistency", "SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND d.text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS consistent FROM documents d")
def queue_live_consistency(spark, d):
    live = queue(spark, d).where("doc_id % 2 = 0").dropDuplicates(["shard_id"])
    return T.consistent(queue(spark, d), live).select("doc_id", "consistent")


@query("queue_status", "SELECT count(*) FILTER (doc_id % 3 = 0) AS n_anchored, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0) AS n_pending, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 = 0) AS n_failed FROM documents")
def queue_status(spark, d):
    n = F.col("doc_id")
    return T.status(table(spark, d, "documents").select((n % 3 == 0).alias("anchored"), ((n % 3 != 0) & (n % 7 == 0)).alias("failed")))


@query("queue_listing", "SELECT doc_id AS entry, true AS has_record, doc_id % 3 = 0 AS anchored FROM documents WHERE doc_id % 4 <> 0")
def queue_listing(spark, d):
    names = F.array_compact(F.array(F.lit("manifest.json"), F.when(F.col("doc_id") % 4 != 0, "record.json"), F.when(F.col("doc_id") % 3 == 0, "manifest.tsr")))
    return T.listing(table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.explode(names).alias("name")))


def anchored(spark, d):
    n = F.col("event_id")
    anchor = lambda kind, tsa, at: F.struct(kind.alias("kind"), tsa.alias("tsa"), at.alias("anchored_at_local_clock"))
    anchors = F.array(anchor(F.when(n % 3 == 0, "manual").otherwise("rfc3161"), F.when(n % 4 != 0, "tsa-a"), F.lit("2024-01-01T00:00:00Z")), anchor(F.when(n % 5 == 0, "manual").otherwise("rfc3161"), F.lit("tsa-b"), F.lit("2024-02-02T00:00:00Z")))
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("sh1_"), F.col("event_id").cast("string")).alias("shard_id"), F.sha2("props", 256).alias("digest"), anchors.alias("anchors"), F.when(n % 2 == 0, "2024-03-03T00:00:00Z").alias("gen_time"))
    return T.with_anchor(e)


ANCHORED = f"""anchored AS (SELECT event_id, 'sh1_' || event_id AS shard_id, sha256(props) AS digest, coalesce(CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 4 <> 0 THEN 'tsa-a' END WHEN event_id % 5 <> 0 THEN 'tsa-b' END, '{T.DEFAULT_AUTHORITY}') AS authority,
 CASE WHEN event_id % 2 = 0 THEN '2024-03-03T00:00:00Z' WHEN event_id % 3 <> 0 THEN '2024-01-01T00:00:00Z' WHEN event_id % 5 <> 0 THEN '2024-02-02T00:00:00Z' ELSE '' END AS anchored_at FROM events)"""


@query("anchor_first", f"WITH {ANCHORED} SELECT event_id, authority, anchored_at FROM anchored")
def anchor_first(spark, d):
    return anchored(spark, d).select("event_id", "authority", "anchored_at")


@query("attestation_rows", f"WITH {ANCHORED} " + " UNION ALL ".join(f"SELECT 'anchor/' || shard_id AS subject, '{p}' AS predicate, {o} AS object, {str(c).lower()} AS cites_target, 1 AS tier FROM anchored" for p, o, c in (("target_shard_id", "shard_id", True), ("digest_sha256", "digest", False), ("anchor_kind", "'rfc3161'", False), ("anchor_authority", "authority", False), ("anchored_at", "anchored_at", False))))
def attestation_rows(spark, d):
    return T.claims(anchored(spark, d))


@query("attestation_references", f"""WITH {ANCHORED} SELECT 'anchor/' || shard_id AS subject, 'target_shard_id' AS predicate, shard_id AS dst_shard_id, 'attests' AS relation_type, 'shard' AS dst_object_type,
 '' AS dst_object_id, '1.0' AS confidence, '{T.ATTESTS.replace("'", "''")}' AS note FROM anchored""")
def attestation_references(spark, d):
    return T.references(anchored(spark, d))


@query("trigger_validation", "SELECT event_id, event_id % 4 NOT IN (1, 2) AND event_id % 9 <> 0 AS valid FROM events")
def trigger_validation(spark, d):
    n = F.col("event_id")
    t = table(spark, d, "events").select("event_id", F.when(n % 4 == 1, None).when(n % 4 == 2, "  ").otherwise(F.col("event_type")).alias("reason"), F.when(n % 9 == 0, "").otherwise("bench").alias("source"))
    return C.valid_triggers(t).select("event_id", "valid")


GUARDED = "CASE WHEN event_id % 3 = 0 THEN 'wrong namespace' WHEN event_id % 5 = 0 THEN 'wrong evidence tier' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'wrong object type' ELSE 'ok' END"


def guarded(spark, d):
    n = F.col("event_id")
    claims = table(spark, d, "events").select("event_id", F.when(n % 3 == 0, "other").otherwise("bounds").alias("namespace"), F.when(n % 5 == 0, "derived").otherwise("physical_capture").alias("evidence_tier"), F.when(F.col("event_type") == "view", "bound").otherwise("sample_count").alias("predicate"), F.when(n % 7 == 0, "literal:string").otherwise("literal:decimal").alias("object_type"))
    return G.guarded_claims(claims, "bounds", ["physical_capture"])


@query("object_type_guard", f"SELECT event_id, {GUARDED} AS finding FROM events")
def object_type_guard(spark, d):
    return guarded(spark, d).select("event_id", "finding")


@query("namespace_tier_guard", f"SELECT {GUARDED} AS finding, count(*) AS n FROM events GROUP BY 1")
def namespace_tier_guard(spark, d):
    return guarded(spark, d).groupBy("finding").agg(F.count("*").alias("n"))


# Levels of the tree by recursion: a level's nodes are pairs of the level below, until one is left.
MERKLE = """WITH RECURSIVE leaf AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS leaves,
 sha256(unhex('00') || encode(doc_id::varchar) || unhex('00') || unhex(sha256(text))) AS node FROM documents),
t AS (SELECT source, leaves, leaves AS width, place, node FROM leaf
 UNION ALL SELECT source, leaves, (width + 1) // 2, place // 2, CASE WHEN count(*) = 1 THEN max(node) ELSE sha256(unhex('01') || unhex(max(node) FILTER (place % 2 = 0)) || unhex(max(node) FILTER (place % 2 = 1))) END
 FROM t WHERE width > 1 GROUP BY source, leaves, width, place // 2)
SELECT source, leaves, node AS root FROM t WHERE width = 1"""


@query("merkle_root_sha256", MERKLE)
def merkle_root_sha256(spark, d):
    leaves = table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return V.merkle_roots(leaves, "source", "doc_id", "h")
