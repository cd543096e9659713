"""Publishing and loading graphs, lists of a journey store, measures of nodes, progress of joins, diagrams."""

import pytest

from graphs import build
from pathloom.operators import execution, leases, paths, replay
from pathloom.plans import diagram, graphs
from pathloom.plans.examples import DEPOT, DEPOT_TURNS, PICKING, PICKING_OLD
from pathloom.sources import graph_store, snapshots, tables


def test_publication(spark, tmp_path):
    path = str(tmp_path / "graphs")
    old, new = graphs.seal(PICKING_OLD), graphs.seal(PICKING)
    assert graph_store.publish(spark, path, []) == []
    assert graph_store.publish(spark, path, [old, old]) == [graphs.ref(old)]
    assert graph_store.publish(spark, path, [old, new]) == [graphs.ref(new)] and graph_store.publish(spark, path, [old, new]) == []
    assert graph_store.load(spark, path, graphs.ref(new)) == new
    for ref in (graphs.ref(new) | {"digest": "0" * 64}, graphs.ref(new) | {"version": 9}):
        with pytest.raises(graph_store.PublicationError):
            graph_store.load(spark, path, ref)
    other = graphs.seal(PICKING | {"description": "other"})
    node = PICKING["nodes"][0] | {"kind": "agent"}
    signed = graphs.seal(PICKING | {"version": 3, "nodes": [node, *PICKING["nodes"][1:]]})
    broken = graphs.seal(PICKING | {"version": 4, "terminals": PICKING["terminals"][1:]})
    for wrong, word in ((other, "graph_digest"), (signed, "node_signature"), (broken, "uncovered_outcome")):
        with pytest.raises(graph_store.PublicationError, match=word):
            graph_store.publish(spark, path, [wrong])
    assert graph_store.stored(spark, path).count() == 2


def test_lists_and_measures(spark):
    schema = "unit_id string, sequence bigint, kind string, node_id string, queue_id string, attempt_number bigint, attempt_index int, error_code string, terminal boolean, graph_digest string"
    rows = [("u", 1, "turn_settled", "a", "q1", 1, 1, None, None, "x"), ("u", 2, "turn_failed", "b", "q2", 1, 1, "e", False, "x"), ("u", 3, "turn_failed", "b", "q2", 2, 2, "f", True, "x"), ("v", 1, "turn_failed", "b", "q3", 1, 1, "e", None, "y"), ("v", 2, "unit_admitted", "b", None, None, None, None, None, "y")]
    j = spark.createDataFrame(rows, schema)
    assert [(r.unit_id, r.sequence, r.error_code) for r in tables.dead_letters(j).collect()] == [("u", 3, "f")]
    assert [r.sequence for r in tables.listed(j, "sequence", "u", 2).collect()] == [1, 2] and tables.listed(j, "sequence").count() == 5
    assert sorted(tuple(r) for r in paths.node_measures(j).collect()) == [("a", 1, 0, 0, 1), ("b", 3, 2, 1, 2)]
    mine, others = paths.claimable(j, spark.createDataFrame([("x",)], "graph_digest string"))
    assert mine.count() == 3 and {r.unit_id for r in others.collect()} == {"v"}


def test_progress_is_the_kernels(spark):
    turns = [("u", 0, "received", "ready"), ("u", 1, "pick-2", "done"), ("u", 2, "pick-1", "out"), ("v", 0, "received", "ready"), ("v", 1, "pick-3", "done"), ("v", 2, "pick-1", "done"), ("v", 3, "pick-2", "done")]
    rows = spark.createDataFrame([(*t, None, None, None) for t in turns], "unit_id string, ord int, node_id string, outcome string, output_json string, error_code string, retryable boolean")
    for graph in (PICKING_OLD, PICKING):
        got = {(r.unit_id, r.edge_id): r.state for r in replay.join_states(rows, graph).collect()}
        for name in "uv":
            unit = replay.Unit(name, replay.Plan(graph))
            unit.admit()
            for _, _, node, outcome in (t for t in turns if t[0] == name):
                unit.turn(node, outcome)
            assert {e: got[name, e] for e in unit.joins["pack"].inbound} == unit.joins["pack"].state
        assert len(got) == 6


def test_diagrams():
    words = {"title": "Picking", "nodes": {n["nodeId"]: {"name": n["nodeId"].title()} for n in PICKING["nodes"]}, "sinks": [{"id": "out", "name": "Out of stock", "ends": [[f"pick-{k}", "out"] for k in (1, 2, 3)]}], "waits": {"out": ["ask"]}}
    assert diagram.faults(PICKING, words) == ["unclaimed terminal pack:packed", "unclaimed terminal ask:enough"]
    d = diagram.build(PICKING, words)
    kinds = [e["type"] for e in d["edges"]]
    assert kinds.count("join") == 3 and kinds.count("exit") == 6 and len({e["id"] for e in d["edges"]}) == len(kinds)
    assert {n["type"] for n in d["nodes"]} == {"code", "human", "sink"} and sum(n["type"] == "sink" for n in d["nodes"]) == 3
    assert next(n for n in d["nodes"] if n["id"] == "pack")["badge"] == "2 of 3"
    wrong = words | {"nodes": words["nodes"] | {"odd": {"name": "?"}}, "arrows": {"received->pick-1": [["ready"], ["ready"]], "a->b": []}, "waits": {"out": ["pack"], "in": []}, "sinks": [*words["sinks"], words["sinks"][0], {"id": "x", "name": "x", "ends": [["pack", "lost"]]}]}
    del wrong["nodes"]["pack"]
    found = diagram.faults(PICKING, wrong)
    for word in ("node without words pack", "words for unknown node odd", "words for unknown arrow a->b", "outcomes of received->pick-1", "unknown terminal pack:lost", "pick-1:out is claimed twice", "sink out twice", "waits for pack", "waits of unknown sink in"):
        assert any(word in f for f in found), word
    with pytest.raises(diagram.DiagramError):
        diagram.build(PICKING, wrong)
    for g in build().values():
        shown = diagram.build(g, {"title": "t", "nodes": {n["nodeId"]: {"name": n["nodeId"]} for n in g["nodes"]}})
        assert sum(n["type"] == "sink" for n in shown["nodes"]) == len(g["terminals"])


def test_snapshots(spark, tmp_path):
    """A store is restored as it was written; tables that were changed, or that don't fit together, are refused."""
    turns = [(f"u{k}", n, *(t + (None,) * (4 - len(t)))) for k, own in DEPOT_TURNS.items() for n, t in enumerate(own)]
    rows = spark.createDataFrame(turns, "unit_id string, ord bigint, node_id string, outcome string, error_code string, retryable boolean").selectExpr("*", "CAST(NULL AS STRING) AS output_json")
    journey = replay.replay(rows, DEPOT).where("kind <> 'turn_rejected'").cache()
    units = journey.select("unit_id").distinct().selectExpr("unit_id", "'order.v1' AS seed_contract", "unit_id AS seed_digest")
    found = {
        "unit": units, "artifact": units.selectExpr("seed_contract AS contract_id", "seed_digest AS digest"), "occurrence": paths.occurrences(journey).select("unit_id", "queue_id", "node_id", "state"), "journey": journey,
        "dead_letter": tables.dead_letters(journey).select("unit_id", "queue_id", "error_code"),
    }
    snapshots.write(found, str(tmp_path / "a"))
    back = snapshots.restore(spark, str(tmp_path / "a"))
    assert {k: sorted(map(str, v.collect())) for k, v in back.items()} == {k: sorted(map(str, v.collect())) for k, v in found.items()}
    back["unit"].limit(1).write.mode("append").parquet(str(tmp_path / "a" / "unit"))
    with pytest.raises(snapshots.SnapshotError, match="unit: other rows"):
        snapshots.restore(spark, str(tmp_path / "a"))
    for name, change, rule in (
        ("unit", found["unit"].where("unit_id <> 'u2'"), "occurrence_without_unit"), ("journey", journey.where("unit_id <> 'u0' or sequence <> 3"), "journey_sequence"), ("dead_letter", found["dead_letter"].limit(1), "failure_without_dead_letter"),
        ("artifact", found["artifact"].union(found["artifact"]), "artifact_twice"),
    ):
        at = str(tmp_path / name)
        snapshots.write(found | {name: change}, at)
        with pytest.raises(snapshots.SnapshotError, match=rule):
            snapshots.restore(spark, at)


def test_external_turns(spark):
    nodes = [{"nodeId": "ask", "kind": "human"}, {"nodeId": "work", "kind": "code"}]
    open_ = spark.createDataFrame([("u", "q1", "ask"), ("u", "q2", "ask"), ("u", "q3", "ask"), ("u", "q4", "work")], "unit_id string, queue_id string, node_id string")
    decided = spark.createDataFrame([("u", "q1", 1, "claimed"), ("u", "q1", 2, "held"), ("u", "q2", 1, "claimed"), ("u", "q2", 3, "settled"), ("u", "q2", 4, "replayed"), ("u", "q4", 1, "claimed")], "unit_id string, queue_id string, ord int, disposition string")
    assert sorted((r.queue_id, r.state) for r in leases.inspected(open_, decided, nodes).collect()) == [("q1", "claimed"), ("q2", "settled"), ("q3", "waiting")]


def test_host_events(spark):
    made = spark.createDataFrame([("u", "n", "q1", "k1", "completed", "done", None, None), ("u", "n", "q2", "k2", "failed", None, "busy", False), ("u", "n", "q3", "k3", "failed", None, "busy", True), ("u", "n", "q4", "k4", "completed", "odd", None, None)],
                                 "unit_id string, node_id string, queue_id string, attempt_key string, status string, outcome string, error_code string, terminal boolean")
    got = execution.outbox(made, {"done": "finished"}, {"busy": "gave_up"}).collect()
    assert sorted((r.queue_id, r.event_type) for r in got) == [("q1", "finished"), ("q3", "gave_up")] and len({r.dedupe_key for r in got}) == 2
    assert execution.outbox(made).count() == 0


def test_legend():
    words = {"title": "t", "nodes": {n["nodeId"]: {"name": n["nodeId"]} for n in PICKING["nodes"]}}
    shown = diagram.build(PICKING, words)
    kinds = [k for k, _ in diagram.legend(shown)]
    assert kinds[:2] == ["code", "human"] and {"sink", "join"} <= set(kinds) and "model" not in kinds
