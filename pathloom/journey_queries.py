"""Registered queries on replayed journeys of orders, whose results are worked out by hand for each kind of unit.

An order is a unit on the depot graph; its key modulo 6 says which of the scripted kinds it is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.graph_sql import literal
from pathloom.operators import paths, replay, unit_paths
from pathloom.plans import examples
from pathloom.sources.derived import table
from pathloom.streaming import journeys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KINDS = len(examples.DEPOT_TURNS)


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return keep


def depot_turns(spark: SparkSession, sf_dir: str, name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """Turns of each order (or row of another table), from a literal of the plan."""
    turn = "struct<node_id:string,outcome:string,error_code:string,retryable:boolean>"

    def one(parts: tuple) -> Column:
        node, outcome, error, retry = parts + (None,) * (4 - len(parts))
        return F.struct(*(F.lit(x).cast(kind).alias(name) for x, kind, name in ((node, "string", "node_id"), (outcome, "string", "outcome"), (error, "string", "error_code"), (retry, "boolean", "retryable"))))

    scripts = F.array(*(F.array(*map(one, examples.DEPOT_TURNS[k])).cast(f"array<{turn}>") for k in range(KINDS)))
    units = table(spark, sf_dir, name).select(F.col(key).cast("string").alias("unit_id"), F.posexplode(F.get(scripts, (F.col(key) % KINDS).cast("int"))).alias("ord", "t"))
    return units.select("unit_id", "ord", "t.*", F.lit(None).cast("string").alias("output_json"))


def depot_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(depot_turns(spark, sf_dir), examples.DEPOT, digests=False)


def depot_projection(spark: SparkSession, sf_dir: str, project, schema: str) -> DataFrame:
    return replay.projected(depot_turns(spark, sf_dir), examples.DEPOT, project, schema)


def by_kind(head: str, rows: dict[int, list[tuple]]) -> str:
    """SQL: a literal of rows by kind, joined to the orders of the kind as ``unit_id``."""
    names = head.split("(")[1].rstrip(")")
    told = literal(f"told(kind, {names})", [(k, *r) for k, rs in rows.items() for r in rs])
    return f"WITH {told} SELECT CAST(o_orderkey AS VARCHAR) AS unit_id, {names} FROM orders JOIN told ON kind = o_orderkey % {KINDS}"


REFUSED = {3: 1, 5: 1}


@query(by_kind("(kinds, refused)", {k: [(kinds, REFUSED.get(k, 0))] for k, kinds in examples.DEPOT_RECORDS.items()}))
def replay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of each unit's records in order, and how many turns its state refused."""
    return depot_projection(spark, sf_dir, lambda records: [unit_paths.kinds(records)], "kinds string, refused int")


def _records(journey: DataFrame) -> DataFrame:
    sound, pair = F.col("kind") != "turn_rejected", F.struct("sequence", "kind")
    kinds = F.transform(F.sort_array(F.collect_list(F.when(sound, pair))), lambda x: x["kind"])
    return journey.groupBy("unit_id").agg(F.array_join(kinds, " ").alias("kinds"), F.count_if(~sound).cast("int").alias("refused"))


@query(ORACLE_SQL["replay_records"].replace("o_orderkey", "c_custkey").replace("FROM orders", "FROM customer"))
def replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records of customers as units, from a stream of their turns that is started three times, appended once."""
    at = f"{_folder(spark)}/stream-{uuid.uuid4().hex}"
    turns = depot_turns(spark, sf_dir, "customer", "c_custkey")
    sink = journeys.append_once(f"{at}/journeys", ["unit_id", "sequence", "kind", "node_id", "outcome"], buckets=8)
    for low in (0, 2, 4):  # each start finds what came since the last one
        turns.where(F.col("ord").between(low, low + 1 + 10 * (low == 4))).write.mode("append").parquet(f"{at}/turns")
        stream = spark.readStream.schema(turns.schema).parquet(f"{at}/turns")
        made = journeys.replay_stream(_in_order(stream), examples.DEPOT).writeStream.foreachBatch(sink)
        made.option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start().awaitTermination()
    return _records(spark.read.parquet(f"{at}/journeys"))


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.withColumn("ord", F.col("ord").cast("bigint"))


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, a temporary one where all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="pathloom-")).rstrip("/")


@query(by_kind("(number, node_id, queued_by, state, attempts, failures, outcome, error_code)", examples.DEPOT_OCCURRENCES))
def unit_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence of each unit."""
    return depot_projection(spark, sf_dir, unit_paths.occurrences, "number int, node_id string, queued_by int, state string, attempts int, failures int, outcome string, error_code string")


@query(by_kind("(node_id, status, offered, impossible, late_offers, number, selected)", {k: [(*j[:5], j[5] or 0, j[6]) for j in rows] for k, rows in examples.DEPOT_JOINS.items()}))
def unit_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's joins as its routing effects tell of them."""
    listed = lambda j: j | {"offered": ",".join(j["offered"]), "impossible": ",".join(j["impossible"])}
    return depot_projection(spark, sf_dir, lambda records: map(listed, unit_paths.join_states(records)), "node_id string, status string, offered string, impossible string, late_offers int, number int, selected string")


@query(by_kind("(edge_id, taken)", examples.DEPOT_TAKEN))
def edge_traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each unit took each edge: ordinary targets and accepted offers."""
    return depot_projection(spark, sf_dir, unit_paths.edge_counts, "edge_id string, taken int")


@query(by_kind("(goal_id, status, resolution, open_members, dead_members, turns)", examples.DEPOT_CLOSURES))
def goal_closure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The goals of each unit, from its occurrences and joins."""
    closures = lambda records: unit_paths.goal_closures(unit_paths.occurrences(records), unit_paths.join_states(records), examples.DEPOT_GOALS)
    return depot_projection(spark, sf_dir, closures, "goal_id string, status string, resolution string, open_members string, dead_members string, turns int")


def _summary(rows: list[tuple]) -> tuple:
    open_ = [r[0] for r in rows if r[3] == "open"]
    return (",".join(map(str, open_)), not open_, sum(r[3] == "dead" for r in rows), sum(r[4] for r in rows), sum(r[5] for r in rows))


@query(by_kind("(open_numbers, concluded, dead, turns, failures)", {k: [_summary(rows)] for k, rows in examples.DEPOT_OCCURRENCES.items()}))
def unit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's open occurrences in order, and whether it is concluded."""
    return depot_projection(spark, sf_dir, lambda records: [unit_paths.summary(unit_paths.occurrences(records))], "open_numbers string, concluded boolean, dead int, turns int, failures int")


def _latest(rows: list[tuple]) -> list[tuple]:
    out = {}
    for n, node, _, state, _, failures, _, _ in sorted(rows):
        out[node] = (node, state if state != "open" else "failed" if failures else "pending", sum(r[1] == node for r in rows))
    return list(out.values())


@query(by_kind("(node_id, state, occurrences)", {k: _latest(rows) for k, rows in examples.DEPOT_OCCURRENCES.items()}))
def unit_node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each node that a unit came to: that of its latest occurrence."""
    return depot_projection(spark, sf_dir, lambda records: unit_paths.node_states(unit_paths.occurrences(records)), "node_id string, state string, occurrences int")


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS unit_id, CASE o_orderkey % 4 WHEN 1 THEN 'sequence' WHEN 2 THEN 'never_queued' ELSE 'other_node' END AS rule,
  CASE o_orderkey % 4 WHEN 2 THEN o_orderkey || '/99' WHEN 3 THEN o_orderkey || '/1' END AS subject FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'enqueue_order', o_orderkey || '/3' FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey % {KINDS} NOT IN (4)""")
def journey_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of journeys that were tampered with, by the order's key: a number left out, a turn on what nobody queued, a turn on
    another node, and an occurrence queued out of order."""
    made, key = depot_journeys(spark, sf_dir), F.col("unit_id").cast("bigint")
    second = F.col("sequence") == 2
    out_of_order = F.transform("effects", lambda e: F.when(e["queue_id"].endswith("/3") & (e["node_id"] == "scan-b"), e.withField("enqueue_sequence", F.lit(1).cast("bigint"))).otherwise(e))
    tampered = made.withColumns({
        "sequence": F.when((key % 4 == 1) & (F.col("sequence") > 3), F.col("sequence") + 1).otherwise(F.col("sequence")),
        "queue_id": F.when((key % 4 == 2) & second, F.concat("unit_id", F.lit("/99"))).otherwise(F.col("queue_id")),
        "node_id": F.when((key % 4 == 3) & second, F.lit("ask")).otherwise(F.col("node_id")),
        "effects": F.when(key % 20 == 0, out_of_order).otherwise(F.col("effects")),
    })
    return paths.journey_faults(tampered)


@query("""WITH o AS (SELECT o_orderkey, 5 - o_custkey % 5 AS first_out FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS unit_id, 'pick-' || k || '-done' AS edge_id, CASE WHEN k < first_out THEN 'offered' WHEN k = first_out THEN 'impossible' ELSE 'pending' END AS state,
  CASE WHEN first_out > 3 THEN 'queued' ELSE 'unsatisfiable' END AS status FROM o, (VALUES (1), (2), (3)) p(k)""")
def join_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's join has from each pick, and what it came to, from one pass of the kernel."""
    from pathloom.queries import picking_turns

    return replay.join_states(picking_turns(spark, sf_dir), examples.PICKING_OLD).select("unit_id", "edge_id", "state", "status")
