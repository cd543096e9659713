"""Registered queries of stores, scalar functions, turn execution and sinks over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import columns
from pathloom.journey_queries import _folder
from pathloom.operators import execution, joins, paths
from pathloom.plans import documents, graphs
from pathloom.plans.examples import DEPOT, PICKING, PICKING_OLD
from pathloom.sources import graph_store, tables
from pathloom.sources.derived import ARRIVAL, EVENT_JOURNEY_SQL, LINE_OFFERS_SQL, event_journey, line_offers, table
from pathloom.streaming import journeys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return keep


# ---- scalar functions ------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'part-' || p_partkey WHEN 1 THEN 'Part-' || p_partkey WHEN 2 THEN 'part ' || p_partkey ELSE 'part.' || p_partkey || '.v' || p_partkey % 12 END AS word FROM part)
SELECT p_partkey, regexp_full_match(word, '[a-z0-9][a-z0-9._:-]{0,159}') AS is_identifier, regexp_full_match(word, '[a-z0-9][a-z0-9._:-]*\\.v[1-9][0-9]*') AS is_contract,
  CASE WHEN regexp_full_match(word, '.*\\.v[1-9][0-9]*') THEN regexp_replace(word, '\\.v[0-9]*$', '') ELSE '' END AS name, CASE WHEN regexp_full_match(word, '.*\\.v[1-9][0-9]*') THEN CAST(regexp_extract(word, '([0-9]*)$', 1) AS BIGINT) ELSE 0 END AS version FROM t""")
def names_and_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words are identifiers and contracts, and the contracts' names and versions."""
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    word = F.when(k == 0, F.concat(F.lit("part-"), key)).when(k == 1, F.concat(F.lit("Part-"), key)).when(k == 2, F.concat(F.lit("part "), key)).otherwise(F.concat(F.lit("part."), key, F.lit(".v"), (F.col("p_partkey") % 12).cast("string")))
    t = table(spark, sf_dir, "part").select("p_partkey", word.alias("word"))
    w = F.col("word")
    return t.select("p_partkey", columns.is_identifier(w).alias("is_identifier"), columns.is_contract_id(w).alias("is_contract"), columns.contract_name(w).alias("name"), F.coalesce(columns.contract_version(w), F.lit(0)).alias("version"))


@query("""SELECT event_id, event_id % 3 = 0 AS canonical, epoch_us(ts) // 1000 + 30000 AS expires_ms FROM events""")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts of times are canonical (one in three has its milliseconds and its Z), and when a lease of 30 seconds taken then expires."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("event_id") % 3 == 1, text).otherwise(F.concat(F.substring(text, 1, 19), F.lit("Z")))
    expires = columns.lease_expiry(F.col("ts"), F.lit(30_000))
    return e.select("event_id", columns.is_canonical_timestamp(said).alias("canonical"), F.unix_millis(expires.cast("timestamp")).alias("expires_ms"))


@query("""WITH r AS (SELECT event_id, event_id % 6 AS kind, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)
SELECT event_id, CASE kind WHEN 0 THEN TRUE WHEN 1 THEN k % 2 = 0 WHEN 2 THEN k >= 1 WHEN 3 THEN FALSE WHEN 4 THEN TRUE ELSE FALSE END AS valid FROM r""")
def receipt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which receipts keep the rules: 0 reported; 1 reported with a charge below what was observed for odd keys; 2 unavailable with the key as charge;
    3 signed without a signature; 4 signed; 5 of another version."""
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id") % 6
    none = F.lit(None)
    seen = kind != 2
    receipt = F.struct(
        F.when(kind == 5, "usage-receipt.v2").otherwise("usage-receipt.v1").alias("schema_version"),
        F.when(kind == 2, "unavailable").when(kind.isin(3, 4), "provider_signed").otherwise("provider_reported").alias("trust"),
        F.when(seen, k).alias("observed_input_tokens"), F.when(seen, F.lit(5)).cast("bigint").alias("observed_output_tokens"),
        F.when(kind == 2, k).when(kind == 1, k + 5 - k % 2).otherwise(k + 5).alias("charged_tokens"), none.cast("bigint").alias("observed_cost_micro_usd"), F.lit(1).cast("bigint").alias("charged_cost_micro_usd"),
        F.lit(9).cast("bigint").alias("duration_ms"), none.cast("string").alias("route_alias"), F.when(kind == 4, "s").alias("signature"),
    )
    return table(spark, sf_dir, "events").select("event_id", receipt.alias("r")).select("event_id", columns.receipt_is_valid("r").alias("valid"))


# ---- stores ----------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id, unnest(range(0, event_id % 3)) AS receipt_index FROM events)
SELECT event_id, receipt_index, sha256('{"eventType":"node_turn_usage","idempotencyKey":"key-' || event_id || '","receiptIndex":' || receipt_index || '}') AS dedupe_key FROM t""")
def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox event of each receipt: turns have none, one or two."""
    key = F.concat(F.lit("key-"), F.col("event_id").cast("string"))
    n = (F.col("event_id") % 3).cast("int")
    usage = F.slice(F.array(F.struct(F.lit("a").alias("trust")), F.struct(F.lit("b").alias("trust"))), F.lit(1), n)
    turns = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit_id"), F.col("event_id").alias("queue_id"), F.lit("n").alias("node_id"), key.alias("idempotency_key"), usage.alias("usage"))
    # the operator keeps the turn's own columns, of which the event's id is the occurrence
    return tables.usage_events(turns).select(F.col("queue_id").alias("event_id"), F.col("receipt_index").cast("bigint").alias("receipt_index"), "dedupe_key")


@query(f"WITH {EVENT_JOURNEY_SQL} SELECT unit_id, sequence, queue_id, node_id, error_code FROM journey WHERE kind = 'turn_failed' AND terminal")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that failed for good."""
    j = event_journey(spark, sf_dir).withColumns({"attempt_number": F.lit(1), "attempt_index": F.lit(1)})
    return tables.dead_letters(j).drop("attempt_number", "attempt_index")


@query(f"WITH {EVENT_JOURNEY_SQL} SELECT unit_id, sequence, kind, node_id, queue_id FROM journey WHERE unit_id = 7 ORDER BY sequence LIMIT 20")
def unit_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of one unit, in order."""
    return tables.listed(event_journey(spark, sf_dir), "sequence", 7, 20).select("unit_id", "sequence", "kind", "node_id", "queue_id")


_DEPOT = graphs.seal(DEPOT)


@query(f"""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS unit_id, CASE WHEN c_custkey % 11 = 0 THEN 'other.v1' ELSE 'order.v1' END AS contract_id, sha256(c_name) AS digest, strlen(c_name) AS bytes FROM customer),
a AS (SELECT unit_id, sha256('{{"admittedAt":"2024-05-01T00:00:00.000Z","graph":{{"digest":"{_DEPOT['digest']}","id":"example.depot","version":1}},"principalId":"host","schemaVersion":"unit.v1","seedArtifact":{{"bytes":' || bytes || ',"contractId":"order.v1","digest":"' || digest || '"}},"unitId":"' || unit_id || '"}}') AS admission_digest
  FROM s WHERE contract_id = 'order.v1')
SELECT unit_id, CASE WHEN CAST(unit_id AS BIGINT) % 4 = 0 THEN 'conflict' ELSE 'admitted' END AS result, admission_digest, CASE WHEN CAST(unit_id AS BIGINT) % 4 <> 0 THEN 'intake ' || unit_id || '/1' END AS entry FROM a WHERE CAST(unit_id AS BIGINT) % 4 <> 1
UNION ALL SELECT unit_id, 'refused', NULL, NULL FROM s WHERE contract_id <> 'order.v1'""")
def admitted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers admitted to the depot graph, which knows some of them (one in four with the same seal, one in four with another); seeds of another
    contract are refused."""
    c = table(spark, sf_dir, "customer")
    seeds = c.select(
        F.col("c_custkey").cast("string").alias("unit_id"), F.when(F.col("c_custkey") % 11 == 0, "other.v1").otherwise("order.v1").alias("contract_id"), columns.raw_body_digest(F.col("c_name")).alias("digest"),
        F.octet_length("c_name").alias("bytes"), F.lit("2024-05-01T00:00:00.000Z").alias("admitted_at"), F.lit("host").alias("principal_id"),
    )
    nobody = spark.createDataFrame([], "unit_id string, admission_digest string")
    before, _, _ = tables.admissions(seeds, _DEPOT, nobody)
    key = F.col("unit_id").cast("bigint") % 4
    known = before.where(key.isin(0, 1)).select("unit_id", F.when(key == 0, "0" * 64).otherwise(F.col("admission_digest")).alias("admission_digest"))
    new, refused, conflicts = tables.admissions(seeds, _DEPOT, known)
    entry, none = F.concat_ws(" ", "entry_node_id", "entry_queue_id"), F.lit(None).cast("string")
    told = new.select("unit_id", F.lit("admitted").alias("result"), "admission_digest", entry.alias("entry"))
    return told.union(conflicts.select("unit_id", F.lit("conflict"), "admission_digest", none)).union(refused.select("unit_id", F.lit("refused"), none, none))


@query("""WITH a AS (SELECT DISTINCT sha256(text) AS digest, strlen(text) AS bytes FROM conversations), wanted AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN repeat('0', 64) ELSE sha256(text) END AS digest FROM conversations WHERE turn % 3 = 0)
SELECT conv_id, turn, digest, coalesce(bytes, 0) AS bytes FROM wanted LEFT JOIN a USING (digest)""")
def artifact_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts by contract and digest, kept once whatever repeats them; an unknown digest finds nothing."""
    c = table(spark, sf_dir, "conversations")
    digest = columns.raw_body_digest(F.col("text"))
    known = tables.artifacts(c.select(F.lit("text.v1").alias("contract_id"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"), F.col("text").alias("payload_json")))
    wanted = c.where("turn % 3 = 0").select("conv_id", "turn", F.lit("text.v1").alias("contract_id"), F.when(F.col("conv_id") % 7 == 0, "0" * 64).otherwise(digest).alias("digest"))
    return tables.lookup(wanted, known).select("conv_id", "turn", "digest", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"))


@query("""WITH u AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0), l AS (SELECT l_orderkey, l_orderkey || '/' || l_linenumber AS q FROM lineitem)
SELECT 'occurrence_without_unit' AS rule, q AS subject FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM u) UNION SELECT 'record_without_unit', CAST(l_orderkey AS VARCHAR) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM u)
UNION SELECT 'unit_without_record', CAST(o_orderkey AS VARCHAR) FROM u WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l) UNION SELECT 'seed_without_artifact', CAST(o_orderkey AS VARCHAR) FROM u WHERE o_orderkey % 30 = 1
UNION SELECT 'turn_without_occurrence', l_orderkey || '/x' FROM l WHERE l_orderkey % 41 = 0""")
def store_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a store that had units, artifacts and occurrences taken out."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    unit = F.col("o_orderkey").alias("unit_id")
    units = o.where("o_orderkey % 50 <> 0").select(unit, F.lit("seed.v1").alias("seed_contract"), F.col("o_orderkey").cast("string").alias("seed_digest"))
    known = o.where("o_orderkey % 30 <> 1").select(F.lit("seed.v1").alias("contract_id"), F.col("o_orderkey").cast("string").alias("digest"))
    queue = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    lines = l.select(F.col("l_orderkey").alias("unit_id"), queue.alias("queue_id"))
    lost = F.concat(F.col("unit_id").cast("string"), F.lit("/x"))
    journey = lines.withColumn("queue_id", F.when(F.col("unit_id") % 41 == 0, lost).otherwise(F.col("queue_id")))
    return tables.integrity(units, lines, journey, known)


@query("""SELECT o_orderkey AS queue_id, o_custkey % 3 = 2 AS withheld FROM orders""")
def claimable_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open occurrences of a worker's graphs, and those withheld from it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("queue_id"), F.concat(F.lit("graph-"), (F.col("o_custkey") % 3).cast("string")).alias("graph_digest"))
    mine, others = paths.claimable(o, spark.createDataFrame([("graph-0",), ("graph-1",)], "graph_digest string"))
    return mine.select("queue_id", F.lit(False).alias("withheld")).union(others.select("queue_id", F.lit(True)))


@query("""SELECT 'example.depot' AS graph_id, 1 AS version, 7 AS nodes, 7 AS edges, TRUE AS new, FALSE AS again UNION ALL SELECT 'example.picking', 1, 5, 4, TRUE, FALSE UNION ALL SELECT 'example.picking', 2, 6, 6, TRUE, FALSE""")
def published_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs published and published again (which changes nothing), one of them loaded by its reference."""
    at = f"{_folder(spark)}/graphs-{uuid.uuid4().hex}"
    sealed = [graphs.seal(g) for g in (DEPOT, PICKING_OLD, PICKING)]
    new, again = ({r["digest"] for r in graph_store.publish(spark, at, sealed)} for _ in range(2))
    loaded = [graph_store.load(spark, at, graphs.ref(sealed[0])), *sealed[1:]]
    return spark.createDataFrame([(g["graphId"], g["version"], len(g["nodes"]), len(g["edges"]), g["digest"] in new, g["digest"] in again) for g in loaded], "graph_id string, version int, nodes int, edges int, new boolean, again boolean")


@query("SELECT DISTINCT user_id AS unit_id, event_type AS kind FROM events")
def outbox_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox that batches with repeats, and a batch that runs again, reach once."""
    at = f"{_folder(spark)}/outbox-{uuid.uuid4().hex}"
    sink = journeys.append_once(at, ["unit_id", "kind"], seal="seal", buckets=8)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), F.col("event_type").alias("kind"), F.sha2(F.concat_ws("/", "user_id", "event_type"), 256).alias("seal"), (F.col("event_id") % 3).alias("batch"))
    for k in (0, 1, 1, 2):
        sink(events.where(F.col("batch") == k).drop("batch"), k)
    return spark.read.parquet(at).select("unit_id", "kind")


# ---- joins and windows -------------------------------------------------------------------------------------------


@query(f"""WITH {LINE_OFFERS_SQL}, firsts AS (SELECT unit_id, edge_ord, edge_id, min(sequence) AS sequence, arg_min(artifact, sequence) AS artifact FROM offers GROUP BY ALL),
running AS (SELECT unit_id, sequence, count(*) OVER (PARTITION BY unit_id ORDER BY sequence RANGE UNBOUNDED PRECEDING) AS n FROM firsts), fired AS (SELECT unit_id, min(sequence) AS fired_at FROM running WHERE n >= 3 GROUP BY ALL),
j AS (SELECT unit_id, '{{"accepted":[' || string_agg('{{"artifact":{{"part":' || artifact || '}},"edgeId":"' || edge_id || '"}}', ',' ORDER BY edge_ord) || '],"schemaVersion":"join-input.v1","unitId":"' || unit_id || '"}}' AS t
  FROM firsts JOIN fired USING (unit_id) WHERE sequence <= fired_at GROUP BY unit_id)
SELECT unit_id, sha256(t) AS input_digest FROM j""")
def join_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the composed inputs of each order's join of three edges, whatever order the offers came in."""
    part = F.concat(F.lit('{"part":'), F.col("artifact").cast("string"), F.lit("}"))
    found = joins.dispositions(line_offers(spark, sf_dir, arrival=True), ["unit_id"], F.lit(3), ARRIVAL)
    head = {"schemaVersion": joins.quoted(F.lit("join-input.v1")), "unitId": joins.quoted(F.col("unit_id").cast("string"))}
    return joins.canonical_inputs(found, ["unit_id"], head, {"edgeId": joins.quoted(F.col("edge_id")), "artifact": part}).select("unit_id", "input_digest")


@query("""SELECT date_trunc('day', ts) AS day, 'node-' || (CAST(props ->> '$.k' AS BIGINT) % 5) AS node_id, count(*) AS turns, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(props ->> '$.k' AS BIGINT) END) AS BIGINT) AS charged_tokens
FROM events GROUP BY ALL""")
def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, failures and charges of each node by day, as the stream's windows make them."""
    j = event_journey(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("queue_id"), F.col("ts").cast("timestamp").alias("at")), "queue_id")
    found = journeys.usage_by_window(j, "at", "1 day", "1 day")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "node_id", "turns", "failures", "charged_tokens")


# ---- turn execution ------------------------------------------------------------------------------------------------


def _event_bodies() -> dict[str, execution.Body]:
    node = lambda name, kind, *outcomes, **more: {"nodeId": name, "kind": kind, "outcomes": {"outcomes": list(outcomes)}, "turn": {"maxAttempts": 2}} | more

    def click(given: dict, c: execution.Context) -> tuple:
        return ("even" if given["k"] % 2 == 0 else "odd"), None

    def purchase(given: dict, binding: dict, c: execution.Context) -> tuple:
        receipt = documents.reported_receipt(given["k"], 1, 1)
        if given["k"] % 5 == 0:
            raise TimeoutError("timed out")
        if given["k"] % 5 == 1:
            raise execution.BodyFailure("busy", True, "", (receipt,), c.node_id, c.attempt_key)
        return ("unknown" if given["k"] % 5 == 2 else "done"), None, [receipt]

    def wrong(given: dict, c: execution.Context) -> tuple:
        raise ValueError("bad schema")

    def submit(given: dict, c: execution.Context) -> None:
        raise execution.LostTransport

    def wait(c: execution.Context) -> tuple:
        return "done", {"key": c.attempt_key}, [documents.unavailable_receipt()] * 2

    return {
        "click": execution.Body(node("click", "code", "even", "odd"), click), "purchase": execution.Body(node("purchase", "model", "done", "later", binding={}), purchase, declared={"busy": "later"}),
        "error": execution.Body(node("error", "code", "done"), wrong), "signup": execution.Body(node("signup", "agent", "done", outputs={"done": "key.v1"}), submit=submit, wait=wait),
    }


def _event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = lambda c: F.col(c).cast("string")
    return e.select(text("user_id").alias("unit_id"), F.col("event_type").alias("node_id"), text("event_id").alias("queue_id"), F.col("props").alias("input_json"), F.concat(F.lit("key-"), text("event_id")).alias("attempt_key"), F.lit(1).alias("attempt_index"), F.concat(F.lit("graph-"), text("user_id").substr(-1, 1)).alias("graph_digest"))


ATTEMPTS_SQL = """e AS (SELECT CAST(event_id AS VARCHAR) AS queue_id, event_type, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(user_id AS VARCHAR) AS u FROM events),
a AS (SELECT *, unnest(range(1, CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN 3 ELSE 2 END)) AS attempt_index FROM e),
made AS (SELECT queue_id, u, event_type AS node_id, CAST(attempt_index AS INTEGER) AS attempt_index, CASE WHEN event_type IN ('click', 'signup') OR (event_type = 'purchase' AND k % 5 IN (1, 3, 4)) THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END WHEN event_type = 'signup' THEN 'done' WHEN event_type = 'purchase' AND k % 5 = 1 THEN 'later' WHEN event_type = 'purchase' AND k % 5 > 2 THEN 'done' END AS outcome,
  CASE WHEN event_type = 'signup' THEN '{"key":"key-' || queue_id || '#1"}' END AS output_json, CASE WHEN event_type = 'signup' THEN 2 WHEN event_type = 'purchase' AND k % 5 > 0 THEN k + 1 ELSE 0 END AS charged,
  CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'dependency_unavailable' WHEN event_type IN ('error', 'view') OR (event_type = 'purchase' AND k % 5 = 2) THEN 'immutable_configuration_rejected' END AS error_code,
  CASE WHEN event_type IN ('error', 'view') OR (event_type = 'purchase' AND k % 5 = 2) THEN TRUE WHEN event_type = 'purchase' AND k % 5 = 0 THEN attempt_index = 2 END AS terminal FROM a)"""


@query(f"WITH {ATTEMPTS_SQL} SELECT * EXCLUDE (u) FROM made")
def turn_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a turn run by its body: code, a model that times out, is busy (declared), answers oddly or well, code that fails for
    good, an agent whose submission is lost, and a node without a body."""
    made = execution.execute(_event_turns(spark, sf_dir), _event_bodies())
    charged = F.aggregate("usage", F.lit(0).cast("bigint"), lambda total, r: total + r["charged_tokens"])
    return made.select("queue_id", "node_id", "attempt_index", "status", "outcome", "output_json", charged.alias("charged"), "error_code", "terminal")


@query(f"""WITH {ATTEMPTS_SQL}, ran AS (SELECT node_id, count(DISTINCT queue_id) AS turns, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status = 'failed' AND NOT terminal) AS retried, count(*) FILTER (status = 'failed' AND terminal) AS terminal FROM made WHERE u NOT LIKE '%9' GROUP BY ALL),
skipped AS (SELECT event_type AS node_id, count(*) AS skipped FROM e WHERE u LIKE '%9' GROUP BY ALL)
SELECT node_id, coalesce(turns, 0) AS turns, coalesce(succeeded, 0) AS succeeded, coalesce(retried, 0) AS retried, coalesce(terminal, 0) AS terminal, coalesce(skipped, 0) AS skipped FROM ran FULL JOIN skipped USING (node_id)""")
def worker_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a worker that has nine of ten graphs did, by node."""
    mine, others = execution.claimed(_event_turns(spark, sf_dir), [f"graph-{k}" for k in range(9)])
    return execution.tallies(execution.execute(mine, _event_bodies()), others)


# ---- graphs ------------------------------------------------------------------------------------------------------------


def _graph_rows(head: str, rows: list[tuple]) -> str:
    from pathloom.graph_sql import literal

    return f"WITH {literal('t' + head, rows)} SELECT * FROM t"


@query(_graph_rows("(source, target, outcomes, edges, depth)", [
    ("intake", "scan-a", "ok", "start", 1), ("intake", "scan-b", "ok", "start", 1), ("intake", "scan-c", "ok", "start", 1), ("scan-a", "gate", "done,again", "a-done,a-again", 2), ("scan-a", "ledger", "done", "a-done", 2),
    ("scan-a", "scan-a", "again", "a-again", 1), ("scan-b", "gate", "done", "b-done", 2), ("scan-b", "ledger", "done", "b-done", 2), ("scan-c", "gate", "done", "c-done", 2), ("gate", "ask", "join_unsatisfiable", "too-few", 3), ("ask", "intake", "again", "retry", 0),
]))
def graph_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrows of the depot graph merged by their ends, and how deep their targets are."""
    shown = graphs.display(DEPOT)
    rows = [(a["from"], a["to"], ",".join(a["outcomes"]), ",".join(a["edges"]), shown["depth"][a["to"]]) for a in shown["arrows"]]
    return spark.createDataFrame(rows, "source string, target string, outcomes string, edges string, depth int")


@query(_graph_rows("(graph_id, version, cycle_edges, principals, most_turns)", [("example.depot", 1, "retry,a-again", "picker", -1), ("example.picking", 1, "", "picker", 10), ("example.picking", 2, "retry", "picker", -1)]))
def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that close cycles, principals of workers, and the most turns a unit can take (-1 where a cycle has no bound)."""
    rows = []
    for g in (DEPOT, PICKING_OLD, PICKING):
        rows.append((g["graphId"], g["version"], ",".join(graphs.cycle_edges(g)), ",".join(graphs.principals([g])), -1 if (most := graphs.turn_budget(g)["max_turns"]) is None else most))
    return spark.createDataFrame(rows, "graph_id string, version int, cycle_edges string, principals string, most_turns int")
