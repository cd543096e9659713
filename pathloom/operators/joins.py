"""Barrier joins in set form: thresholds, fire points, selection, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.folds import spread


def status(offered: Column, impossible: Column, inbound: Column, need: Column) -> Column:
    """Of counts: satisfied, else unsatisfiable when too few edges can still offer, else pending."""
    return F.when(offered >= need, "satisfied").when(inbound - impossible < need, "unsatisfiable").otherwise("pending")


def thresholds(states: DataFrame, join: list[str], n_of: int | None = None) -> DataFrame:
    """Counts and status of each join; ``states`` has one row an inbound edge with ``state`` offered, impossible or pending."""
    counts = states.groupBy(*join).agg(
        F.count("*").alias("inbound"), *(F.count_if(F.col("state") == s).alias(s) for s in ("offered", "impossible", "pending"))
    )
    need = F.col("inbound") if n_of is None else F.lit(n_of).cast("bigint")
    return counts.withColumn("need", need).withColumn("status", status(F.col("offered"), F.col("impossible"), F.col("inbound"), need))


def thresholds_of_bits(joined: DataFrame, join: list[str], inbound: int, n_of: int) -> DataFrame:
    """``thresholds`` of joins whose edges aren't spread to rows: a row of ``joined`` has ``inbound`` edges, the bits in ``offered`` (bigint, null:
    none) of those that have offered, and ``ended``, whether the others can't offer any more."""
    have = F.bit_count(F.coalesce("offered", F.lit(0).cast("bigint"))).cast("bigint")
    ended = F.coalesce("ended", F.lit(False))
    left = F.lit(inbound).cast("bigint") - have
    counts = joined.groupBy(*join).agg(
        F.sum(F.lit(inbound).cast("bigint")).alias("inbound"), F.sum(have).alias("offered"), F.sum(F.when(ended, left).otherwise(0)).alias("impossible"), F.sum(F.when(ended, 0).otherwise(left)).alias("pending"),
    )
    need = F.lit(n_of).cast("bigint")
    return counts.withColumn("need", need).withColumn("status", status(F.col("offered"), F.col("impossible"), F.col("inbound"), need))


def dispositions(offers: DataFrame, join: list[str], need: Column, arrival: list[str] | None = None) -> DataFrame:
    """Each offer as accepted, a repeat of an edge, or late for a join that has fired, with ``fired_at``, the sequence at which its
    join fires (null: never). All offers of one settlement count together; of an edge only the first can be accepted: of several in
    one settlement that which came first by the columns ``arrival``.

    One exchange by the join: the first offers of edges are found after a sort within it, and the fire point is the least
    sequence at which enough of them have come.
    """
    rows = offers.repartition(*spread(offers, 4), *join)
    first = F.row_number().over(Window.partitionBy(*join, "edge_id").orderBy("sequence", "edge_ord", *(arrival or ())))
    rows = rows.withColumn("again", first > 1)
    running = F.count_if(~F.col("again")).over(Window.partitionBy(*join).orderBy("sequence").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("running", running)
    rows = rows.withColumn("fired_at", F.min(F.when(F.col("running") >= need, F.col("sequence"))).over(Window.partitionBy(*join)))
    late = F.coalesce(F.col("sequence") > F.col("fired_at"), F.lit(False))
    word = F.when(late, "join_already_resolved_noop").when(F.col("again"), "edge_already_resolved_noop").otherwise("accepted")
    return rows.withColumn("disposition", word).drop("again", "running")


def selected(disposed: DataFrame, join: list[str], value: str) -> DataFrame:
    """Of joins that fired: the first accepted offer in authored order, and all of them in that order."""
    taken = disposed.where("disposition = 'accepted' and fired_at is not null")
    edges = F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", "edge_id"))), lambda x: x["edge_id"])
    return taken.groupBy(*join).agg(F.min("fired_at").alias("fired_at"), F.min_by(value, "edge_ord").alias("selected"), edges.alias("accepted_edges"))


def canonical_inputs(disposed: DataFrame, join: list[str], head: dict[str, Column], offer: dict[str, Column]) -> DataFrame:
    """The composed input of joins that fired, as canonical text (``input_json``) with its digest: accepted offers in authored
    order, whatever order they came in.

    ``head``: members of the document beside ``accepted``, ``offer``: members of an accepted offer, all as canonical JSON text.
    """
    object_of = lambda members: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(members.items()))), F.lit("}"))
    taken = disposed.where("disposition = 'accepted' and fired_at is not null")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", object_of(offer).alias("o")))), lambda x: x["o"])
    listed = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    rows = taken.groupBy(*join).agg(listed.alias("accepted_json"))
    text = object_of(head | {"accepted": F.col("accepted_json")})
    return rows.select(*join, text.alias("input_json")).withColumn("input_digest", F.sha2("input_json", 256))


def quoted(value: Column) -> Column:
    """A text of plain characters as JSON."""
    return F.concat(F.lit('"'), value, F.lit('"'))


def states(journey: DataFrame) -> DataFrame:
    """``unit_id, node_id, status, offered_edges, impossible_edges, late_offers, queue_id, selected_edge_id, synthetic_digest`` of the joins
    that the routing effects of journeys tell of; edges in the order in which they were resolved."""
    effects = journey.where("kind <> 'turn_rejected'").select("unit_id", "sequence", F.posexplode("effects").alias("place", "e")).where("e.kind in ('join_offer', 'join_impossible', 'join_queued', 'join_unsatisfiable')")
    kind = F.col("e.kind")
    accepted, gone = (kind == "join_offer") & (F.col("e.disposition") == "accepted"), (kind == "join_impossible") & (F.col("e.disposition") == "resolved")
    ordered = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("sequence", "place", F.get(F.col("e.edge_ids"), F.lit(0)).alias("edge"))))), lambda x: x["edge"])
    only = lambda cond, value: F.max(F.when(cond, F.col(value)))
    told = "digest" in journey.schema["effects"].dataType.elementType.names  # journeys can be made without
    synthetic = only(kind == "join_unsatisfiable", "e.digest") if told else F.lit(None).cast("string")
    status = F.when(F.bool_or(kind == "join_queued"), "queued").when(F.bool_or(kind == "join_unsatisfiable"), "unsatisfiable").otherwise("pending")
    return effects.groupBy("unit_id", F.col("e.node_id").alias("node_id")).agg(
        status.alias("status"), ordered(accepted).alias("offered_edges"), ordered(gone).alias("impossible_edges"), F.count_if((kind == "join_offer") & (F.col("e.disposition") != "accepted")).alias("late_offers"),
        only(kind == "join_queued", "e.queue_id").alias("queue_id"), only(kind == "join_queued", "e.selected_edge_id").alias("selected_edge_id"), synthetic.alias("synthetic_digest"),
    )
