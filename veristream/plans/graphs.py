"""Claims, the claim graph, lineage and governance."""

from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators import extract as C
from veristream.operators import govern as G
from veristream.operators import graph as H

from .catalog import query, table

EVENT_KINDS = {"view": "wheel_slip", "click": "recovery_action", "purchase": "emergency_stop", "error": "envelope_breach"}
KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_KINDS.items()) + " END"
LOGGED = f"""logged AS (SELECT event_id, event_id AS frame_id, {KIND} AS evt, CASE WHEN event_id % 4 <> 0 THEN 'robot-' || user_id ELSE 'robot-001' END AS robot, CASE WHEN event_id % 2 = 0 THEN 'ice' END AS surface,
 event_type AS action, props AS value, CASE WHEN event_id % 5 <> 0 THEN round(value, 6) END AS l_inf, CASE WHEN event_id % 6 <> 0 THEN 100.0::double END AS bound, CASE WHEN event_id % 10 = 0 THEN event_type END AS selected_action FROM events)"""


def logged(spark, d):
    n = F.col("event_id")
    kind = F.create_map(*(F.lit(x) for pair in EVENT_KINDS.items() for x in pair))
    return table(spark, d, "events").select(
        "event_id", n.alias("frame_id"), F.try_element_at(kind, "event_type").alias("evt"), F.when(n % 4 != 0, F.concat(F.lit("robot-"), F.col("user_id").cast("string"))).alias("robot"), F.when(n % 2 == 0, "ice").alias("surface"),
        F.col("event_type").alias("action"), F.col("props").alias("value"), F.when(n % 5 != 0, F.round("value", 6)).alias("l_inf"), F.when(n % 6 != 0, 100.0).alias("bound"),
        F.when(n % 10 == 0, F.col("event_type")).alias("selected_action"), F.lit(True).alias("has_distribution"),
    )


def _branches(rows):
    return " UNION ALL ".join(f"SELECT event_id, {s} AS subject, '{p}' AS predicate, {o} AS object, '{k}' AS object_type, {t} AS tier FROM logged WHERE {w}" for w, s, p, o, k, t in rows)


EVENT_CLAIMS = f"WITH {LOGGED} " + _branches([
    ("evt = 'wheel_slip'", "robot", "observed", "'wheel_slip'", "entity", 2), ("evt = 'wheel_slip' AND surface IS NOT NULL", "'wheel_slip'", "on_surface", "surface", "literal:string", 2),
    ("evt = 'recovery_action'", "'wheel_slip'", "resolved_by", "action", "entity", 1), ("evt = 'recovery_action'", "action", "applied_value", "value", "literal:string", 2),
    ("evt = 'emergency_stop'", "robot", "triggered", "'emergency_stop'", "entity", 1), ("evt = 'envelope_breach'", "robot", "breached_envelope", "action", "literal:string", 1),
    ("evt = 'envelope_breach' AND l_inf IS NOT NULL", "'breach/frame-' || frame_id", "observed_l_inf", "printf('%.6f', l_inf)", "literal:decimal", 1),
    ("evt = 'envelope_breach' AND bound IS NOT NULL", "'breach/frame-' || frame_id", "envelope_bound", "printf('%.6f', bound)", "literal:decimal", 1),
    ("selected_action IS NOT NULL", "robot", "selected_action", "selected_action", "entity", 1),
])


@query("event_claims", EVENT_CLAIMS)
def event_claims(spark, d):
    return C.event_claims(logged(spark, d), "event_id")


@query("max_tier", f"SELECT predicate, greatest(0, max(tier)) AS max_tier, count(*) AS n FROM ({EVENT_CLAIMS}) GROUP BY predicate")
def max_tier(spark, d):
    return event_claims(spark, d).groupBy("predicate").agg(F.greatest(F.lit(0), F.max("tier")).alias("max_tier"), F.count("*").alias("n"))


@query("mounted_law", f"SELECT event_id, subject, predicate, object FROM ({EVENT_CLAIMS}) WHERE tier <= 1")
def mounted_law(spark, d):
    return H.mounted_law(event_claims(spark, d)).select("event_id", "subject", "predicate", "object")


@query("considered_actions", "SELECT event_id, k AS action, json_extract(props, '$.' || k)::double AS confidence FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def considered_actions(spark, d):
    return C.considered(table(spark, d, "events"), F.from_json("props", "map<string,double>"), "event_id")


@query("event_merge", "SELECT event_id, json_extract(props, '$.k')::double AS k, value AS norm, 'envelope_breach' AS evt FROM events")
def event_merge(spark, d):
    base = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("evt"), F.lit("wheel_slip")))
    over = F.create_map(F.lit("evt"), F.lit("envelope_breach"), F.lit("l_inf"), F.lit("inf"))
    e = table(spark, d, "events").select("event_id", X.merged(base, over).alias("m"), "value")
    return e.select("event_id", F.col("m")["k"].cast("double").alias("k"), F.col("value").alias("norm"), F.col("m")["evt"].alias("evt"))


CAPTURE_KINDS = {"error": "capture_trigger", "view": "capture_window_opened", "click": "capture_window_closed", "purchase": "frame_kept"}
CAPTURED = "captured AS (SELECT event_id, event_id AS frame_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CAPTURE_KINDS.items()) + " END AS evt, CASE WHEN event_id % 4 <> 0 THEN 'sensor-' || user_id ELSE 'sensor-unknown' END AS sensor, props AS reason, CASE WHEN event_id % 2 = 0 THEN event_id - 3 END AS first_kept, sha256(props) AS h FROM events)"
CAPTURE_CLAIMS = f"WITH {CAPTURED} " + _branches([
    ("evt = 'capture_trigger'", "sensor", "declared_trigger", "reason", "literal:string", 1), ("evt = 'capture_trigger'", "'trigger/frame-' || frame_id", "trigger_source", "'bench'", "literal:string", 1),
    ("evt = 'capture_window_opened'", "sensor", "opened_capture_window", "'frame-' || coalesce(first_kept, frame_id)", "literal:string", 1), ("evt = 'capture_window_closed'", "sensor", "closed_capture_window", "'frame-' || frame_id", "literal:string", 1),
    ("evt = 'frame_kept'", "'frame-' || frame_id", "content_sha256", "h", "literal:string", 1),
]).replace("FROM logged", "FROM captured")


@query("capture_claims", CAPTURE_CLAIMS)
def capture_claims(spark, d):
    n = F.col("event_id")
    kind = F.create_map(*(F.lit(x) for pair in CAPTURE_KINDS.items() for x in pair))
    e = table(spark, d, "events").select("event_id", n.alias("frame_id"), F.try_element_at(kind, "event_type").alias("evt"), F.when(n % 4 != 0, F.concat(F.lit("sensor-"), F.col("user_id").cast("string"))).alias("sensor"), F.col("props").alias("reason"), F.lit("bench").alias("source"), F.when(n % 2 == 0, n - 3).alias("first_kept"), F.sha2("props", 256).alias("content_sha256"))
    return C.capture_claims(e, "event_id")


@query("claims_dedupe", "SELECT DISTINCT 'order/' || l_orderkey AS subject, 'shipped_by' AS predicate, 'supplier/' || l_suppkey AS object, 'entity' AS object_type, l_returnflag AS evidence FROM lineitem")
def claims_dedupe(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("subject"), F.lit("shipped_by").alias("predicate"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("object"), F.lit("entity").alias("object_type"), F.col("l_returnflag").alias("evidence"))
    return C.distinct_claims(li)


GRAPH = """entities AS (SELECT 'customer/' || c_custkey AS entity_id, c_name AS label FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'nation/' || n_nationkey, n_name FROM nation),
claims AS (SELECT 'o' || o_orderkey AS claim_id, 'customer/' || o_custkey AS subject, 'ordered' AS predicate, 'order/' || o_orderkey AS object, (o_orderkey % 3)::int AS tier FROM orders
 UNION ALL SELECT 'c' || c_custkey, 'customer/' || c_custkey, 'lives_in', 'nation/' || c_nationkey, 0 FROM customer),
proof AS (SELECT 'o' || o_orderkey AS claim_id, repeat(o_orderpriority || ' ', 12) AS t FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer),
described AS (SELECT c.claim_id, coalesce(s.label, c.subject) AS subject_label, c.predicate, coalesce(o.label, c.object) AS object_label, c.tier, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS evidence
 FROM claims c LEFT JOIN entities s ON s.entity_id = c.subject LEFT JOIN entities o ON o.entity_id = c.object LEFT JOIN proof p ON p.claim_id = c.claim_id)"""


def graph(spark, d):
    """Claims, entities, provenance and spans made from orders and customers."""
    cust, orders, nation = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    entities = cust.where("c_custkey % 7 <> 0").select(key("customer/", "c_custkey").alias("entity_id"), F.col("c_name").alias("label")).union(nation.select(key("nation/", "n_nationkey"), "n_name"))
    ordered = orders.select(key("o", "o_orderkey").alias("claim_id"), key("customer/", "o_custkey").alias("subject"), F.lit("ordered").alias("predicate"), key("order/", "o_orderkey").alias("object"), (F.col("o_orderkey") % 3).cast("int").alias("tier"))
    lives = cust.select(key("c", "c_custkey"), key("customer/", "c_custkey"), F.lit("lives_in"), key("nation/", "c_nationkey"), F.lit(0))
    n = F.col("o_orderkey")
    one = orders.where("o_orderkey % 4 <> 0").select(key("o", "o_orderkey").alias("claim_id"), F.lit("orders").alias("source_hash"), (n * 100).alias("byte_start"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(12)).alias("text"))
    other = cust.select(key("c", "c_custkey"), F.lit("customer"), F.col("c_custkey") * 100, "c_mktsegment")
    spans = one.union(other).withColumn("byte_end", F.col("byte_start") + F.octet_length("text"))
    # A second, later span for each claim: the first one has to win.
    later = spans.withColumns({"byte_start": F.col("byte_start") + 50, "byte_end": F.col("byte_end") + 50, "text": F.lit("a later span")})
    both = spans.withColumn("position", F.lit(0)).unionByName(later.withColumn("position", F.lit(1)))
    where = ["source_hash", "byte_start", "byte_end"]
    return ordered.union(lives), entities, both.select("claim_id", *where, "position"), both.select(*where, "text").distinct()


def described(spark, d, predicate=None):
    claims, entities, provenance, spans = graph(spark, d)
    return H.described(claims, entities, H.evidence(provenance, spans), predicate)


@query("claims_graph_flagship", f"WITH {GRAPH} SELECT * FROM described")
def claims_graph_flagship(spark, d):
    return described(spark, d)


@query("claims_by_predicate", f"WITH {GRAPH} SELECT * FROM described WHERE predicate = 'lives_in'")
def claims_by_predicate(spark, d):
    return described(spark, d, "lives_in")


@query("top_claims", f"WITH {GRAPH} SELECT claim_id, subject_label, predicate, object_label FROM described ORDER BY claim_id LIMIT 25")
def top_claims(spark, d):
    claims, entities, provenance, spans = graph(spark, d)
    first, _ = H.first_claims(claims)
    return H.described(first, entities, H.evidence(provenance, spans)).select("claim_id", "subject_label", "predicate", "object_label")


@query("claims_remaining", f"WITH {GRAPH} SELECT greatest(0, count(*) - 25) AS remaining FROM claims")
def claims_remaining(spark, d):
    return H.first_claims(graph(spark, d)[0])[1]


EDGES = "edges(src, dst) AS (SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
LINEAGE = f"WITH RECURSIVE {EDGES}, reached(start, node, hop) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders UNION ALL SELECT r.start, e.dst, r.hop + 1 FROM reached r JOIN edges e ON e.src = r.node) SELECT start, node, min(hop) AS hop FROM reached GROUP BY start, node"


def edges(spark, d):
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    a = table(spark, d, "orders").select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"))
    b = table(spark, d, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"))
    c = table(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))
    starts = table(spark, d, "orders").select(key("o", "o_orderkey").alias("node"))
    return starts, a.union(b).union(c)


@query("lineage_hops", LINEAGE)
def lineage_hops(spark, d):
    starts, all_edges = edges(spark, d)
    return H.lineage(starts, all_edges, 3)


@query("lineage_recursive", LINEAGE)
def lineage_recursive(spark, d):
    starts, all_edges = edges(spark, d)
    return H.lineage_recursive(spark, starts, all_edges)


#: Customers refer to the one with a third of their key, the last one is referred to by the first: a cycle.
REFERRED = """WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer UNION SELECT 0, max(c_custkey) FROM customer),
r AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS hop FROM customer UNION ALL SELECT start, dst, hop + 1 FROM r JOIN e ON e.src = r.node WHERE hop < 40)
SELECT start, node, min(hop) AS hop FROM r GROUP BY start, node"""


@query("lineage_closure", REFERRED)
def lineage_closure(spark, d):
    """All that each customer's reference leads to, over a cycle."""
    c = table(spark, d, "customer")
    edges = c.select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).alias("dst")).union(c.select(F.lit(0).cast("long"), F.max("c_custkey")))
    return H.lineage_closure(c.select(F.col("c_custkey").alias("node")), edges)


@query("last_wins_index", "SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def last_wins_index(spark, d):
    return H.last_wins(table(spark, d, "events"), ["user_id", "event_type"], "props", "event_id")


@query("first_wins_evidence", "SELECT user_id, arg_min(props, event_id) AS props FROM events GROUP BY user_id")
def first_wins_evidence(spark, d):
    return H.first_wins(table(spark, d, "events"), ["user_id"], "props", "event_id")


STORE = "store AS (SELECT n_name AS fingerprint FROM nation WHERE n_regionkey IN (0, 1))"


def shards(spark, d):
    n = F.col("s_suppkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("publisher"))
    return table(spark, d, "supplier").join(nation, "s_nationkey").select(n.alias("shard_id"), "publisher", (n % 17 != 0).alias("has_key"), (F.col("s_acctbal") > 0).alias("verified"), (n % 3).cast("int").alias("tier"))


def store(spark, d):
    return table(spark, d, "nation").where("n_regionkey IN (0, 1)").select(F.col("n_name").alias("fingerprint"))


WHY = "CASE WHEN s_suppkey % 17 = 0 THEN 'no publisher key' WHEN {none} THEN 'no trust anchors' WHEN n_name NOT IN (SELECT fingerprint FROM store) THEN 'publisher not enrolled' WHEN NOT s_acctbal > 0 THEN 'verification failed' WHEN s_suppkey % 3 > 1 THEN 'tier above policy' END"
GATE = "SELECT shard_id, CASE WHEN why IS NULL THEN 'AUTHORISED' ELSE 'REFUSED' END AS decision, coalesce(why, 'granted') AS reason FROM (SELECT s_suppkey AS shard_id, {why} AS why FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@query("gate_decisions", f"WITH {STORE} " + GATE.format(why=WHY.format(none="false")))
def gate_decisions(spark, d):
    return G.authorise(shards(spark, d), store(spark, d), max_tier=1)


@query("gate_empty_store", f"WITH {STORE} " + GATE.format(why=WHY.format(none="true")))
def gate_empty_store(spark, d):
    return G.authorise(shards(spark, d), store(spark, d).where("false"), max_tier=1)


@query("trust_store_upsert", "SELECT n_name AS fingerprint FROM nation WHERE n_regionkey IN (0, 1) UNION SELECT n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0")
def trust_store_upsert(spark, d):
    return G.enrol(store(spark, d), shards(spark, d).where("shard_id % 2 = 0").select(F.col("publisher").alias("fingerprint")))


@query("actuation_rule", "SELECT event_id AS frame_id, CASE WHEN event_type IN ('view', 'click') THEN 'PERMIT' ELSE 'SAFE_STATE' END AS verdict FROM events")
def actuation_rule(spark, d):
    law = spark.createDataFrame([("view", 0, True, True, True), ("click", 0, True, True, True), ("error", 2, True, True, True), ("signup", 0, True, False, True)], "action string, tier int, trusted boolean, verified boolean, proven boolean")
    return G.actuation(table(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.col("event_type").alias("action")), law)
