"""Envelopes, the guard and keep windows over events and embeddings."""

from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators import envelope as E
from veristream.operators import guard as G
from veristream.operators import manifest as M
from veristream.operators import windows as W

from .catalog import query, table

PRE, POST = 2, 3

FRAMES = "frames AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id, event_type AS action, value AS norm, event_id, props FROM events)"
ENV = "env AS (SELECT action, count(*) AS sample_count, round(quantile_cont(norm, 0.99) * 1.1, 6) AS bound FROM frames WHERE session % 2 = 0 AND isfinite(norm) GROUP BY action)"
DECIDED = """j AS (SELECT f.session, f.frame_id, f.action, f.norm, e.bound, CASE WHEN e.bound IS NULL THEN 'no bound' WHEN f.norm IS NULL OR NOT isfinite(f.norm) THEN 'non-finite norm' WHEN f.norm > e.bound THEN 'norm exceeds bound' END AS why
  FROM frames f LEFT JOIN {env} e ON e.action = f.action WHERE f.session % 2 = 1),
l AS (SELECT *, coalesce(bool_or(why IS NOT NULL) OVER (PARTITION BY session ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prior FROM j),
decided AS (SELECT session, frame_id, CASE WHEN prior OR why IS NOT NULL THEN 'ESTOP' ELSE 'PERMIT' END AS verdict, CASE WHEN prior OR why IS NOT NULL THEN 'emergency_stop' ELSE action END AS acted,
  norm, bound, CASE WHEN prior THEN 'prior breach' ELSE coalesce(why, 'within envelope') END AS reason, NOT prior AND why IS NOT NULL AS breach FROM l)"""
D = f"WITH {FRAMES}, {ENV}, " + DECIDED.format(env="env")


def frames(spark, d):
    return W.numbered(table(spark, d, "events"), "user_id", "ts", "event_id").withColumnRenamed("event_type", "action").withColumnRenamed("value", "norm")


def flight(spark, d):
    """An envelope from even sessions and the frames of odd ones."""
    f = frames(spark, d).select("session", "frame_id", "action", "norm")
    return E.learn(f.where("session % 2 = 0")), f.where("session % 2 = 1")


def vector_envelope(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("action"), X.linf(F.col("embedding")).alias("norm"))
    return E.learn(v)


VECTORS = "SELECT label::varchar AS action, count(*) AS sample_count, round(quantile_cont(n, 0.99) * 1.1, 6) AS bound FROM (SELECT label, list_max(list_transform(embedding, lambda x: abs(x::double))) AS n FROM embeddings) WHERE isfinite(n) GROUP BY label"


@query("envelope_by_action", VECTORS)
def envelope_by_action(spark, d):
    return vector_envelope(spark, d)


@query("envelope_from_frames", f"WITH {FRAMES}, {ENV} SELECT * FROM env")
def envelope_from_frames(spark, d):
    return flight(spark, d)[0]


CLAIMS = f"""v AS ({VECTORS}), envelope_claims AS (
SELECT 'bounds/' || action AS subject, 'bound' AS predicate, printf('%.6f', bound) AS object, 'literal:decimal' AS object_type, 0 AS tier FROM v
UNION ALL SELECT 'bounds/' || action, 'sample_count', sample_count::varchar, 'literal:integer', 0 FROM v
UNION ALL SELECT 'bounds/' || action, 'percentile', '99', 'literal:integer', 0 FROM v
UNION ALL SELECT 'bounds/' || action, 'safety_margin', '1.100000', 'literal:decimal', 0 FROM v)"""


@query("envelope_claims_unpivot", f"WITH {CLAIMS} SELECT * FROM envelope_claims")
def envelope_claims_unpivot(spark, d):
    return E.as_claims(vector_envelope(spark, d))


@query("envelope_pivot", f"""WITH {CLAIMS} SELECT substr(subject, 8) AS action, max(CASE WHEN predicate = 'bound' THEN object::double END) AS bound,
 max(CASE WHEN predicate = 'sample_count' THEN object::bigint END) AS sample_count, greatest(0, max(tier)) AS max_tier FROM envelope_claims GROUP BY subject""")
def envelope_pivot(spark, d):
    return E.from_claims(E.as_claims(vector_envelope(spark, d)))


@query("manifest_lines", f"WITH v AS ({VECTORS}) SELECT string_agg('action: ' || action || ' samples: ' || sample_count || ' bound: ' || printf('%.6f', bound), chr(10) ORDER BY action) AS manifest FROM v")
def manifest_lines(spark, d):
    return E.manifest_lines(vector_envelope(spark, d))


#: The training document of the embeddings' envelope, with documents as its capsules: lines, their bytes, and what is cited.
DOCUMENT = """e99 AS (SELECT label::varchar AS action, count(*) AS n, quantile_cont(x, 0.99) AS p FROM (SELECT label, list_max(list_transform(embedding, lambda x: abs(x::double))) AS x FROM embeddings) WHERE isfinite(x) GROUP BY label),
l AS (
  SELECT 0 AS section, '' AS key, 'BOUNDS COMPILER: TRAINING MANIFEST' AS line UNION ALL SELECT 1, '', repeat('=', 35) UNION ALL SELECT 2, '', 'Generated: 2024-01-01T00:00:00Z' UNION ALL SELECT 3, '', 'Capsules: ' || count(*) FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 4, '', 'Percentile: 99' UNION ALL SELECT 5, '', 'Safety margin: 1.1' UNION ALL SELECT 6, '', '---' UNION ALL SELECT 8, '', '---'
  UNION ALL SELECT 7, 'doc-' || doc_id, 'capsule: doc-' || doc_id || ' sha256: ' || sha256(text) FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 9, action, 'action: ' || action || ' frames: ' || n || ' p99_linf: ' || printf('%.6f', round(p, 6)) || ' bound: ' || printf('%.6f', round(p * 1.1, 6)) FROM e99
),
o AS (SELECT *, (sum(octet_length(encode(line)) + 1) OVER (ORDER BY section, key, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::bigint - 1 AS byte_end FROM l),
doc AS (SELECT section, key, line, byte_end - octet_length(encode(line)) AS byte_start, byte_end FROM o)"""


def training(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("action"), X.linf(F.col("embedding")).alias("norm"))
    bounds = E.percentiles(v).withColumn("bound", F.round(F.col("value") * E.MARGIN, 6))
    capsules = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return M.placed(M.lines(capsules, bounds, "2024-01-01T00:00:00Z")), bounds


@query("training_document", f"WITH {DOCUMENT} SELECT * FROM doc")
def training_document(spark, d):
    """All lines of the document with their bytes' places."""
    return training(spark, d)[0]


@query("envelope_evidence", f"""WITH {DOCUMENT}, {CLAIMS}
SELECT c.subject, c.predicate, c.object, doc.byte_start, doc.byte_end, doc.line AS text FROM envelope_claims c JOIN doc ON doc.section = 9 AND c.subject = 'bounds/' || doc.key""")
def envelope_evidence(spark, d):
    """Each bound claim with the bytes of the document that it cites."""
    document, bounds = training(spark, d)
    g = M.graph(document, bounds)
    rows = g["claims"].join(g["provenance"], "claim_id").join(g["spans"].select("span_id", "text"), "span_id")
    return rows.select("subject", "predicate", "object", "byte_start", "byte_end", "text")


@query("vector_linf_distance", """SELECT a.vec_id, list_max(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1] - p[2])))::double AS distance
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_linf_distance(spark, d):
    v = table(spark, d, "embeddings")
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(following, "vec_id").select("vec_id", X.linf_distance(F.col("embedding"), F.col("other")).alias("distance"))


@query("frame_numbering", f"WITH {FRAMES} SELECT event_id, session, frame_id FROM frames")
def frame_numbering(spark, d):
    return frames(spark, d).select("event_id", "session", "frame_id")


@query("guard_decisions", f"{D} SELECT * FROM decided")
def guard_decisions(spark, d):
    envelope, flown = flight(spark, d)
    return G.decide(flown, envelope)


@query("guard_uncovered_action", f"WITH {FRAMES}, {ENV}, part AS (SELECT * FROM env WHERE action <> 'purchase'), " + DECIDED.format(env="part") + " SELECT session, frame_id, verdict, reason FROM decided")
def guard_uncovered_action(spark, d):
    envelope, flown = flight(spark, d)
    return G.decide(flown, envelope.where("action <> 'purchase'")).select("session", "frame_id", "verdict", "reason")


#: Norms as a sensor may fail to give them.
ODD = "odd AS (SELECT session, frame_id, action, event_id, props, CASE event_id % 20 WHEN 0 THEN 'nan'::double WHEN 5 THEN 'inf'::double WHEN 10 THEN NULL WHEN 15 THEN '-inf'::double ELSE norm END AS norm FROM frames)"


def odd_flight(spark, d, *more):
    envelope, _ = flight(spark, d)
    n = F.col("event_id") % 20
    norm = F.when(n == 0, float("nan")).when(n == 5, float("inf")).when(n == 15, float("-inf")).when(n != 10, F.col("norm"))
    return envelope, frames(spark, d).where("session % 2 = 1").select("session", "frame_id", "action", norm.alias("norm"), *more)


NULL_NORMS = f"WITH {FRAMES}, {ENV}, {ODD}, " + DECIDED.format(env="env").replace("FROM frames f", "FROM odd f") + " SELECT session, frame_id, verdict, acted, bound, reason, breach FROM decided"


@query("guard_null_norms", NULL_NORMS)
def guard_null_norms(spark, d):
    """What can't be judged is a breach: null, NaN and infinite norms."""
    envelope, flown = odd_flight(spark, d)
    return G.decide(flown, envelope).drop("norm")


@query("breach_events", f"""WITH {FRAMES}, {ENV}, {ODD}, part AS (SELECT * FROM env WHERE action <> 'purchase'), {DECIDED.format(env="part").replace("FROM frames f", "FROM odd f")}
SELECT b.session, b.frame_id, 'envelope_breach' AS evt, o.action, CASE WHEN b.norm IS NULL OR NOT isfinite(b.norm) THEN 'inf' ELSE printf('%.6f', round(b.norm, 6)) END AS l_inf,
 CASE WHEN b.bound IS NULL THEN 'none' ELSE printf('%.6f', b.bound) END AS bound, 'sh1_law' AS envelope_shard_id, b.reason FROM decided b JOIN odd o USING (session, frame_id) WHERE b.breach""")
def breach_events(spark, d):
    envelope, flown = odd_flight(spark, d)
    return G.breach_events(flown, G.decide(flown, envelope.where("action <> 'purchase'")), "sh1_law")


@query("breach_event_keys", f"""WITH {FRAMES}, {ENV}, {ODD}, {DECIDED.format(env="env").replace("FROM frames f", "FROM odd f")}
SELECT b.session, b.frame_id, o.props->>'$.k' AS k, b.reason, 8 AS n_keys FROM decided b JOIN odd o USING (session, frame_id) WHERE b.breach""")
def breach_event_keys(spark, d):
    """A breach's event keeps the frame's own keys, under those of the breach."""
    envelope, flown = odd_flight(spark, d, "props")
    own = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("reason"), F.lit("the frame's own"), F.lit("surface"), F.lit("ice"))
    flown = flown.withColumn("event", own)
    e = G.breach_events(flown, G.decide(flown, envelope), "sh1_law")
    return e.select("session", "frame_id", F.col("event")["k"].alias("k"), F.col("event")["reason"].alias("reason"), F.size("event").alias("n_keys"))


@query("first_breach", f"{D} SELECT session, min(CASE WHEN breach THEN frame_id END) AS breach_frame FROM decided GROUP BY session")
def first_breach(spark, d):
    return G.first_breach(guard_decisions(spark, d))


@query("permitted_counts", f"{D} SELECT session, count(*) FILTER (verdict = 'PERMIT') AS permitted, count(*) FILTER (verdict <> 'PERMIT') AS stopped FROM decided GROUP BY session")
def permitted_counts(spark, d):
    return G.permitted(guard_decisions(spark, d))


KEPT = f"WITH {FRAMES}, k AS (SELECT session, frame_id, action, coalesce(bool_or(action = 'error') OVER (PARTITION BY session ORDER BY frame_id ROWS BETWEEN {POST - 1} PRECEDING AND {PRE} FOLLOWING), false) AS kept FROM frames)"
RUNS = f"{KEPT}, r AS (SELECT session, frame_id, frame_id - row_number() OVER (PARTITION BY session ORDER BY frame_id) AS run FROM k WHERE kept), b AS (SELECT session, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS frames FROM r GROUP BY session, run)"


def kept(spark, d):
    return W.keep_extending(frames(spark, d).select("session", "frame_id", "action"), F.col("action") == "error", PRE, POST)


@query("keep_window_extend", f"{KEPT} SELECT session, frame_id, kept FROM k")
def keep_window_extend(spark, d):
    return kept(spark, d).select("session", "frame_id", "kept")


@query("keep_window_latched", f"""WITH RECURSIVE {FRAMES}, t AS (SELECT session, frame_id FROM frames WHERE action = 'error'),
a(session, trigger) AS (SELECT session, min(frame_id) FROM t GROUP BY session UNION ALL SELECT a.session, min(t.frame_id) FROM a JOIN t ON t.session = a.session AND t.frame_id >= a.trigger + {POST} GROUP BY a.session, a.trigger)
SELECT f.session, f.frame_id, EXISTS (SELECT 1 FROM a WHERE a.session = f.session AND f.frame_id BETWEEN a.trigger - {PRE} AND a.trigger + {POST - 1}) AS kept FROM frames f""")
def keep_window_latched(spark, d):
    f = frames(spark, d).select("session", "frame_id", "action")
    return W.keep_latched(f, F.col("action") == "error", PRE, POST).select("session", "frame_id", "kept")


@query("keep_window_range_join", f"""WITH {FRAMES}, t AS (SELECT session, frame_id AS trigger FROM frames WHERE action = 'error' UNION ALL SELECT session, max(frame_id) + 1 FROM frames GROUP BY session)
SELECT DISTINCT f.session, f.frame_id FROM frames f JOIN t ON t.session = f.session AND f.frame_id BETWEEN t.trigger - {PRE} AND t.trigger + {POST - 1}""")
def keep_window_range_join(spark, d):
    f = frames(spark, d).select("session", "frame_id", "action")
    after_end = f.groupBy("session").agg((F.max("frame_id") + 1).alias("trigger"))
    return W.keep_by_triggers(f, f.where("action = 'error'").select("session", F.col("frame_id").alias("trigger")).union(after_end), PRE, POST).select("session", "frame_id")


@query("window_brackets", f"{RUNS} SELECT * FROM b")
def window_brackets(spark, d):
    return W.brackets(kept(spark, d).where("kept"))


@query("window_gaps", f"{RUNS} SELECT session, last_frame AS after_frame, nxt - last_frame - 1 AS missing FROM (SELECT *, lead(first_frame) OVER (PARTITION BY session ORDER BY first_frame) AS nxt FROM b) WHERE nxt IS NOT NULL")
def window_gaps(spark, d):
    return W.gaps(window_brackets(spark, d))


@query("session_summary", f"{KEPT} SELECT session, count(*) AS observed, count(*) FILTER (kept) AS kept, count(*) FILTER (action = 'error') AS triggers, bool_or(action = 'error') AS triggered FROM k GROUP BY session")
def session_summary(spark, d):
    return W.summary(kept(spark, d), F.col("action") == "error")


@query("rows_per_session", "SELECT user_id AS session, count(*) AS frames, count(DISTINCT event_type) AS actions FROM events GROUP BY user_id")
def rows_per_session(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("frames"), F.countDistinct("event_type").alias("actions"))


@query("nonfinite_dropped", "SELECT event_type AS action, count(*) FILTER (event_id % 10 <> 0) AS kept, count(*) FILTER (event_id % 10 = 0) AS dropped FROM events GROUP BY event_type")
def nonfinite_dropped(spark, d):
    bad = F.when(F.col("event_id") % 20 == 0, float("nan")).when(F.col("event_id") % 10 == 0, float("inf")).otherwise(F.col("value"))
    return E.finite_counts(table(spark, d, "events").select(F.col("event_type").alias("action"), bad.alias("norm")))


@query("incomplete_events_filtered", "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN 'robot-' || user_id END, 'robot-001') AS robot FROM events WHERE event_id % 5 NOT IN (1, 2) AND event_id % 7 <> 0")
def incomplete_events_filtered(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(n % 5 == 1, None).when(n % 5 == 2, "").otherwise(F.col("event_type")).alias("action"), F.when(n % 7 != 0, F.col("props")).alias("ref"), F.when(n % 3 != 0, F.concat(F.lit("robot-"), F.col("user_id"))).alias("robot"))
    return E.complete(e).select("event_id", F.coalesce("robot", F.lit("robot-001")).alias("robot"))
