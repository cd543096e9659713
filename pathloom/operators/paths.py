"""Projections of journeys: paths, usage, goals, queues and measures.

A journey table has ``unit_id, sequence, kind, node_id, queue_id, outcome, error_code, terminal, charged_tokens,
charged_micro_usd, receipts`` and one row a record; kinds are turn_settled and turn_failed here, other kinds pass unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.folds import spread

TURNS = ("turn_settled", "turn_failed")


def _turns(journey: DataFrame) -> DataFrame:
    return journey.where(F.col("kind").isin(*TURNS))


def _usage() -> list[Column]:
    return [F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("receipts", "charged_tokens", "charged_micro_usd")]


def ordered(value: str, by: str = "sequence") -> Column:
    """A list of the non-null values in order."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(by, value))))
    return F.transform(pairs, lambda x: x[value])


def node_paths(journey: DataFrame) -> DataFrame:
    """Each node that a unit turned on: attempts, failures, outcomes in order, last error, usage, and its state: that of the
    last record (settled, dead after a terminal failure, failed after another)."""
    state = F.when(F.col("kind") == "turn_settled", "settled").when(F.col("terminal"), "dead").otherwise("failed")
    failed = F.col("kind") == "turn_failed"
    return _turns(journey).groupBy("unit_id", "node_id").agg(
        F.count("*").alias("attempts"), F.count_if(failed).alias("failures"), F.max_by(state, "sequence").alias("state"),
        F.max_by("error_code", F.when(failed, F.col("sequence"))).alias("last_error"), ordered("outcome").alias("outcomes"), *_usage(),
    )


def unit_paths(journey: DataFrame) -> DataFrame:
    """Each unit: records, nodes, settled and failed turns, last outcome, usage, and whether nothing is left open. Occurrences are
    aggregated first and then units, both within one exchange by unit."""
    settled, sequence = F.col("kind") == "turn_settled", F.col("sequence")
    queues = _turns(journey).groupBy("unit_id", "queue_id").agg(
        F.count("*").alias("records"), F.max("node_id").alias("node_id"), F.count_if(settled).alias("settled"), F.bool_or(settled | F.col("terminal")).alias("closed"),
        F.max(F.when(settled, F.struct(sequence, "outcome"))).alias("last"), *_usage(),
    )
    return queues.groupBy("unit_id").agg(
        F.sum("records").alias("records"), F.size(F.collect_set("node_id")).cast("bigint").alias("nodes"), F.sum("settled").alias("settled"), F.sum(F.col("records") - F.col("settled")).alias("failures"),
        F.max("last")["outcome"].alias("last_outcome"), *_usage(), F.count_if(~F.col("closed")).alias("open"),
    ).withColumn("concluded", F.col("open") == 0)


def sequence_faults(journey: DataFrame) -> DataFrame:
    """Units whose sequences aren't 1, 2, 3 and so on (as many, from 1, none twice)."""
    rows = journey.where("kind <> 'turn_rejected'").groupBy("unit_id").agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("different"), F.min("sequence").alias("least"), F.max("sequence").alias("most"))
    return rows.where("not (least = 1 and most = n and different = n)").select("unit_id")


def _member(journey: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in journey.columns else F.lit(None).cast(kind)


def occurrences(journey: DataFrame) -> DataFrame:
    """Each occurrence that replayed journeys queue: ``unit_id, queue_id, node_id, enqueue_sequence, queued_by, inbound_edge_ids, state, attempts,
    failures, outcome, error_code, settled_sequence, receipts, charged_tokens, charged_micro_usd``.

    State is open, settled, or dead after a terminal failure. Rows meet by unit once; what follows by unit or by unit and
    node needs no further exchange. Turns on an occurrence that nothing queued have no ``enqueue_sequence``.
    """
    nothing = {"enqueue_sequence": "bigint", "inbound": "array<string>", "settled": "boolean", "dead": "boolean", "outcome": "string", "error_code": "string", "receipts": "bigint", "charged_tokens": "bigint", "charged_micro_usd": "bigint"}

    def event(queue: Column, node: Column, turn: bool, **parts: Column) -> Column:
        members = [parts.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in nothing.items()]
        return F.struct(queue.alias("queue_id"), node.alias("node_id"), F.lit(turn).alias("turn"), *members)

    queued = F.transform(
        F.filter(F.coalesce("effects", F.array()), lambda e: e["kind"].isin("queue_enqueued", "join_queued")),
        lambda e: event(e["queue_id"], e["node_id"], False, enqueue_sequence=e["enqueue_sequence"], inbound=e["edge_ids"]),
    )
    usage = {c: _member(journey, c, "bigint") for c in ("receipts", "charged_tokens", "charged_micro_usd")}
    is_turn = F.col("kind").isin(*TURNS)
    turn = event(F.col("queue_id"), F.col("node_id"), True, settled=F.col("kind") == "turn_settled", dead=F.coalesce("terminal", F.lit(False)), outcome=F.col("outcome"), error_code=F.col("error_code"), **usage)
    rows = journey.where("kind <> 'turn_rejected'").select("unit_id", "sequence", F.explode(F.concat(F.when(is_turn, F.array(turn)).otherwise(F.filter(F.array(turn), lambda _: F.lit(False))), queued)).alias("e"))
    rows = rows.select("unit_id", "sequence", "e.*").repartition("unit_id")
    state = F.when(F.bool_or("settled"), "settled").when(F.bool_or("dead"), "dead").otherwise("open")
    return rows.groupBy("unit_id", "queue_id").agg(
        F.max("node_id").alias("node_id"), F.min("enqueue_sequence").alias("enqueue_sequence"), F.min(F.when(~F.col("turn"), F.col("sequence"))).alias("queued_by"), F.max("inbound").alias("inbound_edge_ids"), state.alias("state"),
        F.count_if("turn").alias("attempts"), F.count_if(F.col("turn") & ~F.col("settled")).alias("failures"), F.max(F.when(F.col("settled"), F.col("outcome"))).alias("outcome"),
        F.max_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("sequence"))).alias("error_code"), F.max(F.when(F.col("settled"), F.col("sequence"))).alias("settled_sequence"), *_usage(),
    )


def node_states(found: DataFrame) -> DataFrame:
    """Each node of a unit from its ``occurrences``: the state of the latest (settled, dead, failed after failures that may run again, else
    pending), their number, outcomes in order, the last error, and usage."""
    latest = F.when(F.col("state") != "open", F.col("state")).when(F.col("failures") > 0, "failed").otherwise("pending")
    return found.groupBy("unit_id", "node_id").agg(
        F.max_by(latest, "enqueue_sequence").alias("state"), F.count("*").alias("occurrences"), F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"), ordered("outcome", "settled_sequence").alias("outcomes"), *_usage(),
    )


def unit_summaries(found: DataFrame) -> DataFrame:
    """Each unit from its ``occurrences``: the open ones in order, whether it is concluded, turns, and usage."""
    return found.groupBy("unit_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("state") == "open", F.struct("enqueue_sequence", "queue_id")))), lambda x: x["queue_id"]).alias("open_queue_ids"),
        F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "dead").alias("dead"), F.count("*").alias("occurrences"), F.sum("attempts").alias("turns"), F.sum("failures").alias("failures"), *_usage(),
    ).withColumn("concluded", F.col("open") == 0)


def journey_faults(journey: DataFrame) -> DataFrame:
    """``unit_id, rule, subject`` of journeys that can't have happened: sequences with gaps, no admission first, occurrences queued
    twice or out of order, turns on what was never queued, on another node, or on a closed occurrence. One exchange by unit: records and what
    they queue stand in one order there."""
    turn, placed = F.col("kind").isin(*TURNS), F.lit(-1)
    closes = F.when(turn, (F.col("kind") == "turn_settled") | F.coalesce("terminal", F.lit(False)))
    none = lambda kind: F.lit(None).cast(kind)
    record = F.struct(placed.alias("place"), F.col("kind").alias("kind"), turn.alias("turn"), F.col("queue_id").alias("queue_id"), F.col("node_id").alias("node_id"), closes.alias("closes"), none("bigint").alias("enqueue_sequence"))
    effects = F.transform(F.coalesce("effects", F.array()), lambda e, k: F.struct(
        k.alias("place"), e["kind"].alias("kind"), F.lit(False).alias("turn"), e["queue_id"].alias("queue_id"), e["node_id"].alias("node_id"), none("boolean").alias("closes"), e["enqueue_sequence"].alias("enqueue_sequence"),
    ))
    queued = F.filter(effects, lambda e: e["kind"].isin("queue_enqueued", "join_queued"))
    rows = journey.where("kind <> 'turn_rejected'").select("unit_id", "sequence", F.inline(F.concat(F.array(record), queued)))
    rows = rows.repartition(*spread(journey, 0.5), "unit_id")

    is_record, sequence = F.col("place") == -1, F.col("sequence")
    occurrence = Window.partitionBy("unit_id", "queue_id").orderBy("sequence")
    whole, before = (Window.unboundedPreceding, Window.unboundedFollowing), (Window.unboundedPreceding, -1)
    queues = ~is_record & F.col("queue_id").isNotNull() & F.col("unit_id").isNotNull()
    rows = rows.select(
        "*", F.coalesce(F.bool_or("closes").over(occurrence.rowsBetween(*before)), F.lit(False)).alias("closed"),
        *(F.min(F.when(queues, c)).over(occurrence.rowsBetween(*whole)).alias(name) for c, name in ((F.col("node_id"), "on_node"), (sequence, "since"))),
    )
    unit = Window.partitionBy("unit_id").orderBy("sequence", "place")
    own = unit.rowsBetween(*whole)
    again = is_record & (F.lag("place").over(unit) == -1) & (F.lag("sequence").over(unit) == sequence)
    rows = rows.select(
        "*", F.max("enqueue_sequence").over(unit.rowsBetween(*before)).alias("before"), again.alias("again"), F.row_number().over(unit).alias("nth"),
        F.count_if(is_record).over(own).alias("n"), F.count(F.when(is_record, sequence)).over(own).alias("numbered"), F.min(F.when(is_record, sequence)).over(own).alias("least"), F.max(F.when(is_record, sequence)).over(own).alias("most"),
        F.first(F.when(is_record & sequence.isNotNull(), F.col("kind")), ignorenulls=True).over(own).alias("first"), F.count_if(is_record & (F.col("kind") == "unit_admitted")).over(own).alias("admitted"),
    ).withColumn("repeats", F.count_if("again").over(own))
    rule = F.when(F.col("on_node").isNull() | (F.col("since") >= sequence), "never_queued").when(F.col("on_node") != F.col("node_id"), "other_node").when(F.col("closed"), "closed")
    fault = lambda cond, rule, subject: F.when(cond, F.struct(rule.alias("rule"), subject.alias("subject")))
    first_row, subject, nothing = F.col("nth") == 1, F.col("queue_id"), none("string")
    found = F.array(
        fault(first_row & F.expr("not (least = 1 and most = n and numbered - repeats = n)"), F.lit("sequence"), nothing), fault(first_row & F.expr("first <> 'unit_admitted' or admitted <> 1"), F.lit("admission"), nothing),
        fault(~is_record & F.expr("enqueue_sequence <= before"), F.lit("enqueue_order"), subject), fault(F.col("turn") & rule.isNotNull(), rule, subject),
    )
    return rows.select("unit_id", F.inline(F.filter(found, lambda x: x.isNotNull()))).distinct()


def edge_counts(effects: DataFrame) -> DataFrame:
    """How often each edge of a unit was taken: ordinary targets and accepted offers."""
    taken = effects.where("kind = 'queue_enqueued' or (kind = 'join_offer' and disposition = 'accepted')")
    return taken.select("unit_id", F.explode("edge_ids").alias("edge_id")).groupBy("unit_id", "edge_id").agg(F.count("*").alias("taken"))


def open_occurrences(occurrences: DataFrame, settled: DataFrame, dead: DataFrame) -> DataFrame:
    """Occurrences that are neither settled nor failed for good."""
    return occurrences.join(settled, "queue_id", "left_anti").join(dead, "queue_id", "left_anti")


def queue_positions(open_: DataFrame, node: str = "node_id", by: str = "enqueue_sequence", bits: int = 12) -> DataFrame:
    """Places in each node's queue, 1 is next. A place is the rank within a run of 2^bits numbers and the sizes of the
    runs before it, so a node that holds most of the queue isn't sorted by one task."""
    rows = open_.withColumn("run", F.shiftright(by, bits))
    sizes = rows.groupBy(node, "run").agg(F.count("*").alias("n"))
    sizes = sizes.select(node, "run", (F.sum("n").over(Window.partitionBy(node).orderBy("run")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("within", F.row_number().over(Window.partitionBy(node, "run").orderBy(by)))
    return ranked.join(sizes, [node, "run"]).withColumn("queue_position", F.col("before") + F.col("within")).select(*open_.columns, "queue_position")


def queued(open_: DataFrame, principal: str, node: str, limit: int = 100, leased: DataFrame | None = None) -> DataFrame:
    """The first open occurrences of a principal's node, without those under a lease (``queue_id``)."""
    rows = open_.where((F.col("principal_id") == principal) & (F.col("node_id") == node))
    rows = rows if leased is None else rows.join(leased.select("queue_id"), "queue_id", "left_anti")
    return rows.orderBy("enqueue_sequence").limit(limit)


def failed_units(units: DataFrame, principals: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed units with who ran them: ``unit_id, principal_id`` of units, ``principal_id, name``, and ``unit_id, attempt, error_code`` of failures."""
    return failures.join(units, "unit_id").join(principals, "principal_id").select("unit_id", "name", "attempt", "error_code")


def claim(open_: DataFrame, batch: int, cursor: str | None = None) -> DataFrame:
    """What a claim takes: of the node with the oldest head, the lane after the cursor (wrapping; without a cursor the lane of
    the oldest head), first in first out."""
    heads = open_.groupBy("node_id", "ref_id", "lane").agg(F.min("enqueue_sequence").alias("lane_head"))  # a row a lane
    heads = heads.withColumn("node_head", F.min("lane_head").over(Window.partitionBy("node_id", "ref_id")))
    turn = [F.col("lane_head")] if cursor is None else [F.col("lane") <= cursor, F.col("lane")]
    chosen = heads.orderBy("node_head", *turn).limit(1).select("node_id", "ref_id", "lane")
    return open_.join(chosen, ["node_id", "ref_id", "lane"], "left_semi").orderBy("enqueue_sequence").limit(batch)


def claimable(open_: DataFrame, graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open occurrences of a worker's graphs, those withheld from it), by ``graph_digest``."""
    return open_.join(graphs, "graph_digest", "left_semi"), open_.join(graphs, "graph_digest", "left_anti")


def goal_closures(found: DataFrame, joined: DataFrame, manifest: dict) -> DataFrame:
    """Each unit's goals from its ``occurrences`` and the ``joins.states`` of its joins: closed by their one resolution (a settled outcome, or a join
    that became unsatisfiable), else unentered, else dead when a member has a dead occurrence and none an open one, else open.

    The manifest's goals (members, and resolutions of node, outcome and kind) are literals of the plan, so nothing is joined.
    """
    goals = [
        F.struct(
            F.lit(g["goalId"]).alias("goal_id"), F.array(*map(F.lit, g["members"])).alias("members"),
            F.create_map(*(F.lit(x) for r in g["resolutions"] for x in (f"{r['nodeId']} {r['outcome']}", f"{r['nodeId']}:{r['outcome']}/{r['kind']}"))).alias("ends"),
        )
        for g in manifest["goals"]
    ]
    usage = ["receipts", "charged_tokens", "charged_micro_usd"]
    own = found.select("unit_id", "node_id", "state", "attempts", F.when(F.col("state") == "settled", F.col("outcome")).alias("outcome"), *usage, (F.col("queued_by") == 1).alias("entry"))
    lost = joined.where("status = 'unsatisfiable'").select("unit_id", "node_id", F.lit("settled"), F.lit(0).cast("bigint"), F.lit("join_unsatisfiable"), *(F.lit(0).cast("bigint") for _ in usage), F.lit(False))
    # a unit's entry stands for the unit in goals that it hasn't entered
    spread = own.union(lost).select("*", F.explode(F.array(*goals)).alias("g")).withColumn("member", F.array_contains("g.members", F.col("node_id"))).where("member or entry")
    spread = spread.withColumn("closing", F.when(F.col("member"), F.element_at("g.ends", F.concat_ws(" ", "node_id", "outcome"))))
    members = lambda state: F.array_join(F.sort_array(F.collect_set(F.when(F.col("member") & (F.col("state") == state), F.col("node_id")))), ",")
    out = spread.groupBy("unit_id", F.col("g.goal_id").alias("goal_id")).agg(
        F.bool_or("member").alias("entered"), members("open").alias("open_members"), members("dead").alias("dead_members"), F.count("closing").alias("closures"), F.min("closing").alias("closing"),
        *(F.sum(F.when(F.col("member"), F.col(c)).otherwise(0)).cast("bigint").alias("turns" if c == "attempts" else c) for c in ("attempts", *usage)),
    )
    word = (
        F.when(F.col("closures") == 1, "closed").when(F.col("closures") > 1, "ambiguous").when(~F.col("entered"), "unentered")
        .when((F.col("dead_members") != "") & (F.col("open_members") == ""), "dead").otherwise("open")
    )
    return out.select("unit_id", "goal_id", word.alias("status"), F.when(F.col("closures") == 1, F.col("closing")).alias("resolution"), "open_members", "dead_members", "turns", *usage)


def waits(events: DataFrame, unit: str, at: str, tie: str) -> DataFrame:
    """Milliseconds from each record of a unit to the next."""
    before = F.lag(at).over(Window.partitionBy(unit).orderBy(at, tie))
    return events.withColumn("wait_ms", F.timestamp_diff("MILLISECOND", before, F.col(at))).where("wait_ms is not null")


def durations(events: DataFrame, unit: str, at: str) -> DataFrame:
    """Milliseconds from each unit's first record to its last."""
    return events.groupBy(unit).agg(F.timestamp_diff("MILLISECOND", F.min(at), F.max(at)).alias("duration_ms"))


def node_measures(journey: DataFrame) -> DataFrame:
    """Each node's turns, retries (failures that may run again), dead letters, and units that came."""
    failed = F.col("kind") == "turn_failed"
    dead = failed & F.coalesce(F.col("terminal"), F.lit(False))
    return _turns(journey).groupBy("node_id").agg(F.count("*").alias("turns"), F.count_if(failed & ~dead).alias("retries"), F.count_if(dead).alias("dead_letters"), F.countDistinct("unit_id").alias("units"))


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float], bits: int = 8) -> DataFrame:
    """Discrete percentiles of a column of integers, exact. Values are counted by runs of 2^bits first, which combine before the
    shuffle; only the run that holds a rank is counted value by value, so a hot key sends no task all its values."""
    runs = df.groupBy(by, F.shiftright(value, bits).alias("run")).agg(F.count("*").alias("c"))
    over = Window.partitionBy(by)
    runs = runs.withColumn("n", F.sum("c").over(over)).withColumn("upto", F.sum("c").over(over.orderBy("run")))
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).alias("rank")) for name, p in shares.items()))
    held = F.filter(ranks, lambda r: (r["rank"] > F.col("upto") - F.col("c")) & (r["rank"] <= F.col("upto")))
    wanted = runs.withColumn("held", held).where(F.size("held") > 0).select(by, "run", "n", (F.col("upto") - F.col("c")).alias("before"), "held")
    values = df.select(by, value, F.shiftright(value, bits).alias("run")).join(wanted.select(by, "run"), [by, "run"], "left_semi").groupBy(by, "run", value).agg(F.count("*").alias("c"))
    within = values.join(wanted, [by, "run"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(by, "run").orderBy(value)))
    met = within.select(by, "n", F.col(value).alias("v"), F.explode("held").alias("r"), "upto").where("upto >= r.rank")
    return met.groupBy(by, "n").agg(*(F.min(F.when(F.col("r.name") == name, F.col("v"))).cast("bigint").alias(name) for name in shares))


def decision_metrics(decided: DataFrame, by: str) -> DataFrame:
    """Precision, recall, abstention and accuracy of ``predicted`` (null: abstained) against ``actual``, as counts and shares."""
    p, a = F.col("predicted"), F.col("actual")
    counts = decided.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"), F.count_if(p.isNull()).alias("abstained"),
    )
    share = lambda x, y: F.when(y > 0, x.cast("double") / y.cast("double"))
    c = F.col
    return counts.select("*", share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("tp") + c("fn")).alias("recall"), share(c("abstained"), c("n")).alias("abstention"), share(c("tp") + c("tn"), c("n") - c("abstained")).alias("accuracy"))
