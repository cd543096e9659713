"""Registered queries of the engine's operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom import graph_sql
from pathloom.functions import columns
from pathloom.operators import joins, leases, paths, replay, routing
from pathloom.operators.folds import spread
from pathloom.plans import checks, gates, graphs
from pathloom.plans.examples import GATE, PICKING, PICKING_BROKEN, PICKING_OLD
from pathloom.sources import tables
from pathloom.sources.derived import EVENT_JOURNEY_SQL, LINE_OFFERS_SQL, event_journey, line_offers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


@query(f"""WITH {EVENT_JOURNEY_SQL}, q AS (SELECT unit_id, queue_id, bool_or(kind = 'turn_settled' OR terminal) AS closed FROM journey GROUP BY ALL),
o AS (SELECT unit_id, count(*) FILTER (NOT closed) AS open FROM q GROUP BY ALL)
SELECT unit_id, count(*) AS records, count(DISTINCT node_id) AS nodes, count(*) FILTER (kind = 'turn_settled') AS settled, count(*) FILTER (kind <> 'turn_settled') AS failures,
  max_by(outcome, sequence) FILTER (kind = 'turn_settled') AS last_outcome, CAST(sum(coalesce(receipts, 0)) AS BIGINT) AS receipts,
  CAST(sum(coalesce(charged_tokens, 0)) AS BIGINT) AS charged_tokens, CAST(sum(coalesce(charged_micro_usd, 0)) AS BIGINT) AS charged_micro_usd, any_value(open) AS open, any_value(open) = 0 AS concluded
FROM journey JOIN o USING (unit_id) GROUP BY unit_id""")
def unit_path_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each unit."""
    return paths.unit_paths(event_journey(spark, sf_dir))


NODE_PATHS_SQL = """SELECT unit_id, node_id, count(*) AS attempts, count(*) FILTER (kind = 'turn_failed') AS failures,
  max_by(CASE WHEN kind = 'turn_settled' THEN 'settled' WHEN terminal THEN 'dead' ELSE 'failed' END, sequence) AS state,
  max_by(error_code, sequence) FILTER (kind = 'turn_failed') AS last_error, coalesce(list(outcome ORDER BY sequence) FILTER (outcome IS NOT NULL), []) AS outcomes,
  CAST(sum(coalesce(receipts, 0)) AS BIGINT) AS receipts, CAST(sum(coalesce(charged_tokens, 0)) AS BIGINT) AS charged_tokens, CAST(sum(coalesce(charged_micro_usd, 0)) AS BIGINT) AS charged_micro_usd
FROM journey GROUP BY unit_id, node_id"""


@query(f"""WITH {EVENT_JOURNEY_SQL}, n AS ({NODE_PATHS_SQL})
SELECT * EXCLUDE (outcomes), array_to_string(outcomes, ',') AS outcomes FROM n""")
def node_path_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node that a unit turned on."""
    return paths.node_paths(event_journey(spark, sf_dir)).withColumn("outcomes", F.array_join("outcomes", ","))


@query(f"""WITH {EVENT_JOURNEY_SQL} SELECT node_id, outcome, count(*) AS receipts, CAST(sum(charged_tokens) AS BIGINT) AS charged_tokens, CAST(sum(charged_micro_usd) AS BIGINT) AS charged_micro_usd
FROM journey WHERE kind = 'turn_settled' GROUP BY ALL""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by node and outcome."""
    j = event_journey(spark, sf_dir).where("kind = 'turn_settled'")
    return j.groupBy("node_id", "outcome").agg(F.count("*").alias("receipts"), F.sum("charged_tokens").alias("charged_tokens"), F.sum("charged_micro_usd").alias("charged_micro_usd"))


@query(f"""WITH {EVENT_JOURNEY_SQL}, kept AS (SELECT unit_id, sequence FROM journey WHERE queue_id % 97 <> 0 OR unit_id % 3 = 0)
SELECT unit_id FROM kept GROUP BY unit_id HAVING NOT (min(sequence) = 1 AND max(sequence) = count(*) AND count(DISTINCT sequence) = count(*))""")
def sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a gap in their sequence, of journeys that had records taken out."""
    return paths.sequence_faults(event_journey(spark, sf_dir).where("queue_id % 97 <> 0 or unit_id % 3 = 0"))


#: Edges over events: all three arms of the predicate language.
EVENT_EDGES = [
    {"edgeId": "to-cart", "from": "site", "when": {"outcome": "click"}, "to": ["cart", "audit"]},
    {"edgeId": "to-done", "from": "site", "when": {"anyOf": ["purchase", "signup"]}, "to": ["done"]},
    {"edgeId": "to-audit", "from": "site", "when": {"outcome": "click", "where": [{"pointer": "/payload/k", "equals": 69}]}, "to": ["audit"]},
    {"edgeId": "to-text", "from": "site", "when": {"outcome": "view", "where": [{"pointer": "/payload/k", "equals": "7"}]}, "to": ["audit"]},
    {"edgeId": "to-null", "from": "site", "when": {"outcome": "view", "where": [{"pointer": "/payload/none", "equals": None}]}, "to": ["audit"]},
    {"edgeId": "to-none", "from": "elsewhere", "when": {"outcome": "click"}, "to": ["cart"]},
]


def _event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.lit("site").alias("node_id"), F.col("event_type").alias("outcome"), routing.envelope(F.lit("event.v1"), F.col("props")).alias("document"))


MATCHED_SQL = """m AS (
  SELECT event_id, 0 AS edge_ord, 'to-cart' AS edge_id, ['cart', 'audit'] AS targets FROM events WHERE event_type = 'click' UNION ALL
  SELECT event_id, 1, 'to-done', ['done'] FROM events WHERE event_type IN ('purchase', 'signup') UNION ALL
  SELECT event_id, 2, 'to-audit', ['audit'] FROM events WHERE event_type = 'click' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(props ->> '$.k' AS DOUBLE) = 69 UNION ALL
  SELECT event_id, 3, 'to-text', ['audit'] FROM events WHERE event_type = 'view' AND json_type(props, '$.k') = 'VARCHAR' AND props ->> '$.k' = '7' UNION ALL
  SELECT event_id, 4, 'to-null', ['audit'] FROM events WHERE event_type = 'view' AND json_type(props, '$.none') = 'NULL'
)"""


@query(f"WITH {MATCHED_SQL} SELECT event_id, edge_ord, edge_id FROM m")
def route_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that each turn matches."""
    return routing.matching_edges(_event_turns(spark, sf_dir), EVENT_EDGES).select("event_id", "edge_ord", "edge_id")


@query(f"WITH {MATCHED_SQL} SELECT event_id, target, string_agg(edge_id, ',' ORDER BY edge_ord) AS edge_ids FROM (SELECT event_id, edge_ord, edge_id, unnest(targets) AS target FROM m) GROUP BY ALL")
def enqueued_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occurrences that each turn enqueues, one a target."""
    rows = routing.enqueued(routing.matching_edges(_event_turns(spark, sf_dir), EVENT_EDGES), ["event_id"])
    return rows.select("event_id", "target", F.array_join("edge_ids", ",").alias("edge_ids"))


@query(f"""WITH {LINE_OFFERS_SQL}, inbound AS (SELECT unnest(range(1, 8)) AS edge_ord), s AS (
  SELECT o_orderkey AS unit_id, i.edge_ord, CASE WHEN EXISTS (SELECT 1 FROM offers f WHERE f.unit_id = o_orderkey AND f.edge_ord = i.edge_ord) THEN 'offered' WHEN o_orderstatus = 'F' THEN 'impossible' ELSE 'pending' END AS state
  FROM orders, inbound i
), c AS (SELECT unit_id, count(*) AS inbound, count(*) FILTER (state = 'offered') AS offered, count(*) FILTER (state = 'impossible') AS impossible, count(*) FILTER (state = 'pending') AS pending FROM s GROUP BY ALL)
SELECT *, CAST(3 AS BIGINT) AS need, CASE WHEN offered >= 3 THEN 'satisfied' WHEN inbound - impossible < 3 THEN 'unsatisfiable' ELSE 'pending' END AS status FROM c""")
def join_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of three of seven edges, one an order; edges of a finished order can't offer any more."""
    lines = line_offers(spark, sf_dir).where("edge_ord between 1 and 7").select("unit_id", "edge_ord")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_orderstatus") == "F").alias("ended"))
    n = spread(lines, 4)  # of both sides, so that they meet where they are
    bits = lines.repartition(*n, "unit_id").groupBy("unit_id").agg(F.bit_or(F.expr("shiftleft(1L, edge_ord - 1)")).alias("offered"))
    return joins.thresholds_of_bits(orders.repartition(*n, "unit_id").join(bits, "unit_id", "left"), ["unit_id"], 7, 3)


FIRED_SQL = f"""{LINE_OFFERS_SQL}, firsts AS (SELECT unit_id, edge_ord, min(sequence) AS sequence FROM offers GROUP BY ALL),
running AS (SELECT unit_id, sequence, count(*) OVER (PARTITION BY unit_id ORDER BY sequence RANGE UNBOUNDED PRECEDING) AS n FROM firsts),
fired AS (SELECT unit_id, min(sequence) AS fired_at FROM running WHERE n >= 3 GROUP BY ALL)"""


@query(f"""WITH {FIRED_SQL}, k AS (SELECT o.unit_id, o.sequence, o.edge_ord, f.fired_at, row_number() OVER (PARTITION BY o.unit_id, o.edge_ord ORDER BY o.sequence) AS r FROM offers o LEFT JOIN fired f USING (unit_id))
SELECT unit_id, CASE WHEN fired_at IS NOT NULL AND sequence > fired_at THEN 'join_already_resolved_noop' WHEN r > 1 THEN 'edge_already_resolved_noop' ELSE 'accepted' END AS disposition, count(*) AS offers FROM k GROUP BY ALL""")
def offer_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, repeated and late offers of each order's join of three edges."""
    rows = joins.dispositions(line_offers(spark, sf_dir), ["unit_id"], F.lit(3))
    return rows.groupBy("unit_id", "disposition").agg(F.count("*").alias("offers"))


@query(f"""WITH {FIRED_SQL} SELECT unit_id, any_value(fired_at) AS fired_at, min(edge_ord) AS first_edge, string_agg('line-' || edge_ord, ',' ORDER BY edge_ord) AS accepted_edges
FROM firsts JOIN fired USING (unit_id) WHERE sequence <= fired_at GROUP BY unit_id""")
def join_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each order's join of three edges fired, and with which edges."""
    rows = joins.selected(joins.dispositions(line_offers(spark, sf_dir), ["unit_id"], F.lit(3)), ["unit_id"], "edge_ord")
    return rows.select("unit_id", "fired_at", F.col("selected").alias("first_edge"), F.array_join("accepted_edges", ",").alias("accepted_edges"))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("queue_id"), F.col("o_orderpriority").alias("node_id"), F.col("o_orderkey").alias("enqueue_sequence"), F.concat(F.lit("p-"), (F.col("o_custkey") % 3).cast("string")).alias("principal_id"), F.col("o_orderstatus").alias("status"), "o_totalprice")


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _occurrences(spark, sf_dir)
    return paths.open_occurrences(rows, rows.where("status = 'F'").select("queue_id"), rows.where("status = 'P' and o_totalprice >= 300000").select("queue_id")).drop("status", "o_totalprice")


OPEN_SQL = "open AS (SELECT o_orderkey AS queue_id, o_orderpriority AS node_id, o_orderkey AS enqueue_sequence, 'p-' || (o_custkey % 3) AS principal_id FROM orders WHERE o_orderstatus <> 'F' AND NOT (o_orderstatus = 'P' AND o_totalprice >= 300000))"


@query(f"WITH {OPEN_SQL} SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY enqueue_sequence) AS queue_position FROM open")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open occurrences and their places."""
    return paths.queue_positions(_open(spark, sf_dir))


@query(f"WITH {OPEN_SQL} SELECT * FROM open WHERE principal_id = 'p-1' AND node_id = '5-LOW' AND queue_id % 5 <> 0 ORDER BY enqueue_sequence LIMIT 100")
def queued_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of one principal's queue that nobody holds."""
    leased = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("queue_id"))
    return paths.queued(_open(spark, sf_dir), "p-1", "5-LOW", leased=leased)


@query(f"""WITH {OPEN_SQL}, h AS (SELECT node_id, principal_id, min(enqueue_sequence) AS lane_head FROM open GROUP BY ALL), n AS (SELECT *, min(lane_head) OVER (PARTITION BY node_id) AS node_head FROM h),
c AS (SELECT node_id, principal_id FROM n ORDER BY node_head, principal_id <= 'p-1', principal_id LIMIT 1)
SELECT queue_id, node_id, principal_id AS lane, enqueue_sequence FROM open SEMI JOIN c USING (node_id, principal_id) ORDER BY enqueue_sequence LIMIT 8""")
def claimed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a claim of eight takes when the last one took lane p-1."""
    rows = _open(spark, sf_dir).select("queue_id", "node_id", F.col("principal_id").alias("lane"), "enqueue_sequence", F.col("node_id").alias("ref_id"))
    return paths.claim(rows, 8, "p-1").drop("ref_id")


@query("""WITH w AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000 AS wait_ms FROM events)
SELECT event_type, count(*) AS n, quantile_disc(wait_ms, 0.5) AS p50, quantile_disc(wait_ms, 0.95) AS p95 FROM w WHERE wait_ms IS NOT NULL GROUP BY ALL""")
def queue_wait_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of the wait before each kind of event."""
    return paths.percentiles(paths.waits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id"), "event_type", "wait_ms", {"p50": 0.5, "p95": 0.95})


@query("""WITH d AS (SELECT d.lang, CASE WHEN d.n_chars BETWEEN 400 AND 800 THEN NULL ELSE d.n_chars > 800 END AS predicted, l.quality = 1 AS actual FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND NOT actual) AS tn, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (predicted IS NULL) AS abstained FROM d GROUP BY ALL)
SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN n > 0 THEN CAST(abstained AS DOUBLE) / CAST(n AS DOUBLE) END AS abstention,
  CASE WHEN n - abstained > 0 THEN CAST(tp + tn AS DOUBLE) / CAST(n - abstained AS DOUBLE) END AS accuracy FROM c""")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a rule on length, with a band where it abstains, agrees with the quality labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    rule = F.when(~F.col("n_chars").between(400, 800), F.col("n_chars") > 800)
    return paths.decision_metrics(d.select("lang", rule.alias("predicted"), (F.col("quality") == 1).alias("actual")), "lang")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def raw_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", columns.raw_body_digest(F.col("text")).alias("digest"))


@query("""SELECT event_id, sha256('{"k":' || (props ->> '$.k') || '}') AS digest FROM events""")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each event's canonical properties."""
    return table(spark, sf_dir, "events").select("event_id", columns.canonical_digest("props").alias("digest"))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Request timed out, 503' WHEN turn % 3 = 1 THEN 'schema of ' || role ELSE 'odd' END AS message FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(message), 'schema|contract') THEN 'immutable_configuration_rejected' WHEN regexp_matches(lower(message), 'timed out|503') THEN 'dependency_unavailable' ELSE 'stage_execution_failed' END AS code,
  NOT regexp_matches(lower(message), 'schema|contract') AS retryable FROM m""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by the words of their messages."""
    c = table(spark, sf_dir, "conversations")
    message = F.when(F.col("turn") % 3 == 0, "Request timed out, 503").when(F.col("turn") % 3 == 1, F.concat(F.lit("schema of "), "role")).otherwise("odd")
    return c.select("conv_id", "turn", columns.failure_class(message).alias("f")).select("conv_id", "turn", "f.code", "f.retryable")


@query("""WITH t AS (SELECT conv_id, count(*) AS turns, max(turn) AS last, max_by(role, turn) AS last_role FROM conversations GROUP BY ALL)
SELECT conv_id AS unit_id, turns, last_role AS final_node_id, CASE WHEN last_role = 'user' THEN 'awaiting_human' ELSE 'completed' END AS status FROM t""")
def unit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as units: one whose last turn is the user's waits, others are complete."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("final_node_id"))
    return t.select(F.col("conv_id").alias("unit_id"), "turns", "final_node_id", F.when(F.col("final_node_id") == "user", "awaiting_human").otherwise("completed").alias("status"))


@query("""SELECT o.o_orderkey AS unit_id, c.c_name AS name, l.l_linenumber AS attempt, l.l_returnflag AS error_code FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'F' AND l.l_returnflag = 'R'""")
def failed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed units with what they were and who ran them."""
    units = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("principal_id"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("principal_id"), F.col("c_name").alias("name"))
    failures = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("attempt"), F.col("l_returnflag").alias("error_code"))
    return paths.failed_units(units, names, failures)


@query("""WITH RECURSIVE arcs(a, b) AS (VALUES ('received', 'pick-1'), ('received', 'pick-2'), ('received', 'pick-3'), ('pick-1', 'pack'), ('pick-2', 'pack'), ('pick-3', 'pack'), ('pack', 'ask'), ('ask', 'received')),
r(node_id) AS (SELECT 'received' UNION SELECT b FROM r JOIN arcs ON a = node_id) SELECT node_id FROM r""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the picking graph that its entry reaches."""
    return spark.createDataFrame([(n,) for n in graphs.distances(PICKING)], "node_id string")


@query(graph_sql.TURN_BUDGET)
def turn_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst-case occurrences and turns of the older, acyclic picking graph."""
    found = graphs.turn_budget(PICKING_OLD)["nodes"]
    return spark.createDataFrame([(n, x["depth"], x["occurrences"], x["turns"]) for n, x in found.items()], "node_id string, depth int, occurrences bigint, turns bigint")


@query(graph_sql.GRAPH_VIOLATIONS)
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with picking graphs that have something wrong each."""
    return checks.violations(spark, PICKING_BROKEN)


@query(graph_sql.GRAPH_DIFF)
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from the older picking graph."""
    return checks.diff(spark, PICKING_OLD, PICKING)


@query(graph_sql.GATE_BOUNDS)
def gate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst case of a gate flow."""
    return spark.createDataFrame(list(gates.compile_flow(GATE)["bounds"].items()), "bound string, most bigint")


def picking_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each order on the older picking graph: three picks, of which those whose place and customer add up to a
    multiple of five are out of stock."""
    pick = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), "o_custkey", pick)
    outcome = F.when(F.col("ord") == 0, "ready").when((F.col("o_custkey") + F.col("ord")) % 5 == 0, "out").otherwise("done")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("output_json", "error_code")]
    return t.select("unit_id", "ord", F.when(F.col("ord") == 0, "received").otherwise(F.concat(F.lit("pick-"), F.col("ord").cast("string"))).alias("node_id"), outcome.alias("outcome"), *nothing, F.lit(None).cast("boolean").alias("retryable"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS unit_id, CAST(5 + CAST(d < 3 AS INTEGER) AS BIGINT) AS records, d >= 3 AS fired, d < 3 AS unsatisfiable
FROM (SELECT o_orderkey, CAST((o_custkey + 1) % 5 <> 0 AS INTEGER) + CAST((o_custkey + 2) % 5 <> 0 AS INTEGER) + CAST((o_custkey + 3) % 5 <> 0 AS INTEGER) AS d FROM orders)""")
def replay_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order replayed: whether its join of all picks fired or became unsatisfiable."""
    def told(records: list[dict]) -> list[dict]:
        kinds = {x["kind"] for r in records for x in (r, *r["effects"])}
        return [{"records": len(records), "fired": "join_queued" in kinds, "unsatisfiable": any(r["kind"] == "join_unsatisfiable" for r in records)}]

    return replay.projected(picking_turns(spark, sf_dir), PICKING_OLD, told, "records bigint, fired boolean, unsatisfiable boolean")


@query("""SELECT conv_id AS unit_id, turn AS queue_id, role AS node_id, CASE WHEN role = 'user' THEN 'human' ELSE 'model' END AS kind, strlen(text) AS bytes, sha256(text) AS output_digest,
  count(*) OVER (PARTITION BY conv_id, role ORDER BY turn) AS visit FROM conversations""")
def unit_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with its output's size and digest, and which visit to its node it is."""
    c = table(spark, sf_dir, "conversations")
    visit = F.count("*").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    kind = F.when(F.col("role") == "user", "human").otherwise("model")
    return c.select(F.col("conv_id").alias("unit_id"), F.col("turn").alias("queue_id"), F.col("role").alias("node_id"), kind.alias("kind"), F.octet_length("text").cast("bigint").alias("bytes"), columns.raw_body_digest(F.col("text")).alias("output_digest"), visit.alias("visit"))


@query("SELECT conv_id AS unit_id, turn, role AS actor_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS decision FROM conversations WHERE role = 'user'")
def human_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people's turns of each conversation, in order."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.col("conv_id").alias("unit_id"), "turn", F.col("role").alias("actor_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("decision"))


@query("""WITH s AS (SELECT c_custkey AS unit_id, CASE WHEN c_nationkey < 5 THEN 'b' ELSE 'a' END AS seal FROM customer), k AS (SELECT c_custkey AS unit_id, 'a' AS was FROM customer WHERE c_acctbal < 2000)
SELECT CASE WHEN was IS NULL THEN 'new' WHEN was = seal THEN 'replay' ELSE 'conflict' END AS result, count(*) AS units FROM s LEFT JOIN k USING (unit_id) GROUP BY ALL""")
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers admitted to a store that knows some of them: new, replayed, or in conflict."""
    c = table(spark, sf_dir, "customer")
    seeds = c.select(F.col("c_custkey").alias("unit_id"), F.when(F.col("c_nationkey") < 5, "b").otherwise("a").alias("admission_digest"))
    known = c.where("c_acctbal < 2000").select(F.col("c_custkey").alias("unit_id"), F.lit("a").alias("admission_digest"))
    new, conflicts = tables.admit(seeds, known)
    named = new.select("unit_id", F.lit("new").alias("r")).union(conflicts.select("unit_id", F.lit("conflict")))
    return seeds.join(named, "unit_id", "left").groupBy(F.coalesce("r", F.lit("replay")).alias("result")).agg(F.count("*").alias("units"))


#: By turn modulo 4, the commands to an occurrence and what they come to: node, command, ms, token, actor, evidence, extension,
#: disposition, attempt index.
LEASE_SCRIPTS = [
    (0, "received", "claim", 0, "a", None, None, None, "claimed", None), (0, "received", "prepare", 10, "a", None, None, None, "reserved", 1), (0, "received", "heartbeat", 9000, "a", None, None, 30000, "extended", 1),
    (0, "received", "complete", 38999, "a", None, "e", None, "completed", 1), (0, "received", "prepare", 38999, "a", None, None, None, "cached", 1), (0, "received", "settle", 38999, "a", None, "e", None, "settled", 1),
    (0, "received", "settle", 40000, "a", None, "e", None, "replayed", 1), (0, "received", "settle", 40000, "a", None, "f", None, "conflict", 1), (0, "received", "claim", 90000, "b", None, None, None, "closed", 1),
    (1, "received", "claim", 0, "a", None, None, None, "claimed", None), (1, "received", "claim", 29999, "b", None, None, None, "held", None), (1, "received", "claim", 30000, "b", None, None, None, "claimed", None),
    (1, "received", "prepare", 30001, "a", None, None, None, "lease_lost", None), (1, "received", "prepare", 30001, "b", None, None, None, "reserved", 1), (1, "received", "fail", 30002, "b", None, "e", None, "failed", 1),
    (1, "received", "prepare", 30003, "b", None, None, None, "reserved", 2), (1, "received", "fail", 30004, "b", None, "g", None, "dead", 2), (1, "received", "claim", 99999, "c", None, None, None, "closed", 2),
    (2, "ask", "claim", 0, "a", None, None, None, "refused", None), (2, "ask", "claim_external", 0, "a", "x", "e", None, "claimed", None), (2, "ask", "claim_external", 5, "b", "x", "e", None, "claimed", None),
    (2, "ask", "claim_external", 5, "b", "x", "f", None, "held", None), (2, "ask", "prepare", 6, "a", None, None, None, "reserved", 1), (2, "ask", "settle", 7, "a", "x", "f", None, "conflict", 1),
    (2, "ask", "settle", 7, "a", "x", "e", None, "settled", 1), (2, "ask", "claim_external", 8, "d", "x", "e", None, "settled", 1), (2, "ask", "claim_external", 8, "d", "y", "e", None, "conflict", 1),
    (3, "received", "claim", 0, "a", None, None, None, "claimed", None), (3, "received", "complete", 1, "a", None, "e", None, "conflict", None), (3, "received", "heartbeat", 1, "a", None, None, 30001, "refused", None),
    (3, "received", "prepare", 2, "a", None, None, None, "reserved", 1), (3, "received", "fail", 3, "a", None, "e", None, "failed", 1), (3, "received", "fail", 4, "a", None, "e", None, "replayed", 1), (3, "received", "complete", 5, "a", None, "f", None, "conflict", 1),
]


@query(f"""WITH {graph_sql.literal("script(kind, step, node_id, command, disposition, attempt_index)", [(s[0], k, s[1], s[2], s[8], s[9]) for k, s in enumerate(LEASE_SCRIPTS)])},
used AS (SELECT kind, node_id, coalesce(max(attempt_index), 0) AS used FROM script GROUP BY ALL),
t AS (SELECT conv_id, turn, kind, node_id, sum(used) OVER (PARTITION BY conv_id, node_id ORDER BY turn) - used AS before FROM conversations JOIN used ON kind = turn % 4)
SELECT CAST(conv_id AS VARCHAR) AS unit_id, CAST(turn AS VARCHAR) AS queue_id, turn * 100 + step AS ord, command, disposition, CAST(coalesce(before + attempt_index, 0) AS BIGINT) AS attempt_number, coalesce(attempt_index, 0) AS attempt_index
FROM t JOIN script USING (kind, node_id)""")
def lease_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scripted commands to each conversation's turns come to."""
    head = "kind int, step bigint, node_id string, command string, ms bigint, token string, actor string, evidence string, extend_ms bigint"
    script = spark.createDataFrame([(s[0], k, *s[1:8]) for k, s in enumerate(LEASE_SCRIPTS)], head)
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("unit_id"), F.col("turn").cast("string").alias("queue_id"), "turn", (F.col("turn") % 4).cast("int").alias("kind"))
    met = c.join(F.broadcast(script), "kind")  # a few dozen rows
    numbered = met.select("*", (F.col("turn") * 100 + F.col("step")).alias("ord"), (F.col("turn") * 1_000_000 + F.col("ms")).alias("at_ms"), F.lit(None).cast("string").alias("principal"), F.lit(True).alias("retryable"))
    return leases.decisions(numbered, PICKING).select("unit_id", "queue_id", "ord", "command", "disposition", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("attempt_number", "attempt_index")))


@query(f"""WITH {EVENT_JOURNEY_SQL} SELECT node_id, count(*) AS turns, count(*) FILTER (kind = 'turn_failed' AND NOT terminal) AS retries, count(*) FILTER (kind = 'turn_failed' AND terminal) AS dead_letters, count(DISTINCT unit_id) AS units
FROM journey GROUP BY ALL""")
def node_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, retries and dead letters of each node."""
    return paths.node_measures(event_journey(spark, sf_dir))


@query("""WITH d AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY ALL)
SELECT 'all' AS units, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM d""")
def unit_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of the time from a unit's first event to its last."""
    d = paths.durations(table(spark, sf_dir, "events"), "user_id", "ts")
    return paths.percentiles(d.withColumn("units", F.lit("all")), "units", "duration_ms", {"p50": 0.5, "p95": 0.95})
