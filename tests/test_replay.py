import pytest
from graphs import GRAPHS, edge, graph, node
from pyspark.sql import functions as F

from pathloom.operators import joins, paths, replay
from pathloom.plans import examples
from pathloom.streaming import journeys


def _fold(name, turns, graphs=GRAPHS):
    rows = [dict(zip(("node_id", "outcome", "error_code", "retryable", "output_json"), t + (None,) * (5 - len(t)), strict=True)) for t in turns]
    return list(replay.fold("u", replay.Plan(graphs[name]), rows))


def _effects(records, kind):
    return [(e["node_id"], e["edge_ids"], e["disposition"]) for r in records for e in r["effects"] if e["kind"] == kind]


def test_linear():
    r = _fold("filter-chain", [("filter", "pass"), ("normalize", "ok"), ("sink", "done")])
    assert [x["sequence"] for x in r] == [1, 2, 3, 4] and [e[0] for e in _effects(r, "queue_enqueued")] == ["filter", "normalize", "sink"]
    assert len(_fold("filter-chain", [("filter", "drop")])[-1]["effects"]) == 0
    with pytest.raises(replay.ReplayError):
        replay.Unit("u", replay.Plan(GRAPHS["filter-chain"])).turn("sink", "done")


def test_refused_turns_change_nothing():
    """They are records outside the sequence, use up no attempt, and stop no other turn."""
    r = _fold("filter-chain", [("sink", "done"), ("filter", "mystery"), ("nowhere", "x"), ("filter", "pass", None, None, "{broken"), ("filter", "pass")])
    assert [(x["kind"], x["sequence"], x["attempt_number"]) for x in r] == [("unit_admitted", 1, None), *[("turn_rejected", None, None)] * 4, ("turn_settled", 2, 1)]


@pytest.mark.parametrize("first", ["a", "b"])
def test_all_join_is_the_same_in_any_order(first):
    second = "b" if first == "a" else "a"
    r = _fold("join", [("start", "ready"), (f"branch-{first}", "done"), (f"branch-{second}", "done"), ("join", "joined")])
    assert _effects(r, "join_queued") == [("join", ["branch-a-to-join", "branch-b-to-join"], None)]


def test_n_of_and_late_offers():
    r = _fold("escalation-ladder", [("triage", "escalate"), ("tier-1-timer", "elapsed"), ("review-tier-1", "resolved"), ("tier-1-race", "escalate"), ("review-tier-2", "rejected")])
    assert [d for _, _, d in _effects(r, "join_offer")] == ["accepted", "join_already_resolved_noop"]
    assert _effects(r, "join_queued") == [("tier-1-race", ["tier-1-timeout"], None)]


def test_retry_then_terminal_failure_makes_a_join_unsatisfiable():
    r = _fold("join", [("start", "ready"), ("branch-a", None, "x", True), ("branch-a", None, "x", True), ("branch-b", "done")])
    assert [x["terminal"] for x in r if x["kind"] == "turn_failed"] == [False, True] and [x["attempt_index"] for x in r if x["kind"] == "turn_failed"] == [1, 2]
    assert _effects(r, "join_impossible") == [("join", ["branch-a-to-join"], "resolved")] and [x["kind"] for x in r][4] == "join_unsatisfiable"
    assert _effects(r, "join_offer") == [("join", ["branch-b-to-join"], "join_already_resolved_noop")]


def test_unsatisfiable_join_recovers_and_feeds_another():
    lost = "join_unsatisfiable"
    g = graph(
        "chain", "c",
        [node("s", "go"), node("a", "x", "y"), node("j", "k", lost, join={"inbound": ["a-j", "s-j"], "require": "all"}), node("r", "z"), node("l", "w", lost, join={"inbound": ["j-l", "r-l"], "require": {"nOf": 1}})],
        [edge("s-a", "s", "go", "a"), edge("s-j", "s", "go", "j"), edge("a-j", "a", "x", "j"), edge("j-r", "j", lost, "r"), edge("j-l", "j", "k", "l"), edge("r-l", "r", "z", "l")], [("a", "y"), ("l", "w"), ("l", lost)],
    )
    r = _fold("chain", [("s", "go"), ("a", "y"), ("r", "z"), ("l", "w")], {"chain": g})
    assert [x["kind"] for x in r] == ["unit_admitted", "turn_settled", "turn_settled", "join_unsatisfiable", "turn_settled", "turn_settled"]
    assert _effects(r, "queue_enqueued")[-1][0] == "r" and _effects(r, "join_impossible") == [("j", ["a-j"], "resolved"), ("l", ["j-l"], "resolved")]


def test_where_needs_an_output():
    on = lambda text: _effects(_fold("shadow-lane", [("classify", "routed", None, None, text)]), "queue_enqueued")[1:]
    assert [e[0] for e in on('{"risk":"high"}')] == ["primary", "shadow"] and [e[0] for e in on('{"risk":1}')] == ["primary"] and [e[0] for e in on(None)] == ["primary"]


TURNS = [(u, k, *t, None, None) for u in ("u1", "u2", "u3") for k, t in enumerate([("start", "ready"), ("branch-b", "done"), ("branch-a", "done"), ("join", "joined")][: 4 if u != "u3" else 2])]


def test_grouped_replay_and_paths(spark):
    turns = spark.createDataFrame([(u, k, n, o, None, e, r) for u, k, n, o, e, r in TURNS], "unit_id string, ord int, node_id string, outcome string, output_json string, error_code string, retryable boolean")
    made = replay.replay(turns, GRAPHS["join"]).cache()
    want = [str({k: v for k, v in x.items() if k != "unit_id"}) for x in _fold("join", [t[2:4] for t in TURNS[:4]])]
    got = [r.asDict(True) for r in made.where("unit_id = 'u1'").orderBy("sequence").collect()]
    assert [str({k: v for k, v in x.items() if k != "unit_id"}).replace("u1/", "u/") for x in got] == want
    assert paths.sequence_faults(made).count() == 0 and paths.sequence_faults(made.where("sequence <> 2")).count() == 3
    effects = made.selectExpr("unit_id", "inline(effects)")
    taken = {(r.unit_id, r.edge_id): r.taken for r in paths.edge_counts(effects.select("unit_id", "kind", "disposition", "edge_ids")).collect()}
    assert taken["u1", "branch-a-to-join"] == 1 and ("u3", "branch-a-to-join") not in taken and taken["u3", "fan-out"] == 2


def test_stream_restarts_and_ignores_replays(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = "unit_id string, ord bigint, node_id string, outcome string, output_json string, error_code string, retryable boolean"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)

    def run():
        stream = journeys.replay_stream(spark.readStream.schema(schema).json(src), GRAPHS["join"])
        q = stream.writeStream.foreachBatch(journeys.append_once(out, ["unit_id", "sequence", "kind"])).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()

    rows = [(t[0], t[1], t[2], t[3], None, None, None) for t in TURNS]
    write([r for r in rows if r[1] < 2])
    run()
    write(rows)  # the first turns again, then the rest
    run()
    want = replay.replay(spark.createDataFrame([(u, k, n, o, None, None, None) for u, k, n, o, *_ in rows], "unit_id string, ord int, node_id string, outcome string, output_json string, error_code string, retryable boolean"), GRAPHS["join"])
    key = lambda df: sorted((r.unit_id, r.sequence, r.kind, r.node_id, str(r.outcome)) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(want)


def _depot(spark):
    rows = [(f"u{k}", n, *(t + (None,) * (4 - len(t)))) for k, turns in examples.DEPOT_TURNS.items() for n, t in enumerate(turns)]
    return spark.createDataFrame(rows, "unit_id string, ord bigint, node_id string, outcome string, error_code string, retryable boolean").withColumn("output_json", F.lit(None).cast("string"))


def test_depot_journeys_as_worked_out_by_hand(spark):
    """Late, duplicate and impossible offers, dead legs, recovery and cycles: records, occurrences, joins, edges, goals, faults."""
    made = replay.replay(_depot(spark), examples.DEPOT).cache()
    number = lambda q: q and int(q.split("/")[1])
    kinds = {r.unit_id: r.kinds for r in made.where("sequence is not null").groupBy("unit_id").agg(F.expr("array_join(transform(sort_array(collect_list(struct(sequence, kind))), x -> x.kind), ' ')").alias("kinds")).collect()}
    assert kinds == {f"u{k}": v for k, v in examples.DEPOT_RECORDS.items()}
    found = paths.occurrences(made).cache()
    got = sorted((r.unit_id, number(r.queue_id), r.node_id, r.queued_by, r.state, r.attempts, r.failures, r.outcome, r.error_code) for r in found.collect())
    assert got == sorted((f"u{k}", *x) for k, v in examples.DEPOT_OCCURRENCES.items() for x in v)
    joined = joins.states(made).cache()
    got = sorted((r.unit_id, r.node_id, r.status, ",".join(r.offered_edges), ",".join(r.impossible_edges), r.late_offers, number(r.queue_id), r.selected_edge_id) for r in joined.collect())
    assert got == sorted((f"u{k}", *x) for k, v in examples.DEPOT_JOINS.items() for x in v)
    assert all((r.synthetic_digest is not None) == (r.status == "unsatisfiable") for r in joined.collect())
    taken = sorted((r.unit_id, r.edge_id, r.taken) for r in paths.edge_counts(made.selectExpr("unit_id", "inline(effects)")).collect())
    assert taken == sorted((f"u{k}", *x) for k, v in examples.DEPOT_TAKEN.items() for x in v)
    goals = sorted((r.unit_id, r.goal_id, r.status, str(r.resolution), r.open_members, r.dead_members, r.turns) for r in paths.goal_closures(found, joined, examples.DEPOT_GOALS).collect())
    assert goals == sorted((f"u{k}", g, s, str(e), *rest) for k, v in examples.DEPOT_CLOSURES.items() for g, s, e, *rest in v)
    units = {r.unit_id: (r.concluded, [number(q) for q in r.open_queue_ids]) for r in paths.unit_summaries(found).collect()}
    assert units == {f"u{k}": (not (o := [x[0] for x in v if x[3] == "open"]), o) for k, v in examples.DEPOT_OCCURRENCES.items()}
    assert {(r.unit_id, r.node_id): r.state for r in paths.node_states(found).collect()}["u5", "scan-a"] == "settled"
    states = replay.join_states(_depot(spark), examples.DEPOT)
    assert sorted({(r.unit_id, r.node_id, r.status) for r in states.collect()}) == sorted((f"u{k}", x[0], x[1]) for k, v in examples.DEPOT_JOINS.items() for x in v)
    assert paths.journey_faults(made).count() == 0


def test_faults_of_tampered_journeys(spark):
    made = replay.replay(_depot(spark), examples.DEPOT).cache()
    faults = lambda df, unit: {(r.rule, r.subject) for r in paths.journey_faults(df.where(f"unit_id = '{unit}'")).collect()}
    assert faults(made.where("sequence <> 3"), "u0") == {("sequence", None)}
    assert ("admission", None) in faults(made.where("sequence <> 1"), "u0") and ("never_queued", "u0/1") in faults(made.where("sequence <> 1"), "u0")
    swapped = made.withColumn("sequence", F.expr("case sequence when 2 then 3 when 3 then 2 else sequence end"))
    assert ("never_queued", "u0/2") in faults(swapped, "u0")
    assert faults(made.withColumn("node_id", F.expr("if(sequence = 3, 'scan-b', node_id)")), "u0") == {("other_node", "u0/2")}
    assert faults(made.withColumn("queue_id", F.expr("if(sequence = 4, 'u0/2', queue_id)")), "u0") >= {("closed", "u0/2"), ("other_node", "u0/2")} - {("closed", "u0/2")}
    late = made.withColumn("effects", F.expr("transform(effects, e -> if(e.queue_id = 'u0/6', named_struct('kind', e.kind, 'node_id', e.node_id, 'queue_id', e.queue_id, 'edge_ids', e.edge_ids, 'disposition', e.disposition, 'enqueue_sequence', 2L, 'selected_edge_id', e.selected_edge_id, 'digest', e.digest), e))"))
    assert ("enqueue_order", "u0/6") in faults(late, "u0")


@pytest.mark.parametrize("cut", [1, 3, 100])
def test_stream_and_batch_agree(spark, tmp_path, cut):
    """The same journeys whatever the batches, with outputs, refused turns and concluded units; state is JSON without the graph."""
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    risky = [("u9", k, "classify", "routed", None, None, '{"risk":"high"}') for k in range(1)]
    for name, df, graph in (("depot", _depot(spark), examples.DEPOT), ("lane", spark.createDataFrame(risky, "unit_id string, ord bigint, node_id string, outcome string, error_code string, retryable boolean, output_json string"), GRAPHS["shadow-lane"])):
        schema, at = "unit_id string, ord bigint, node_id string, outcome string, error_code string, retryable boolean, output_json string", f"{src}-{name}"
        for part in range(0, 8, cut):
            df.where(f"ord between {max(0, part - 1)} and {part + cut - 1}").select(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").json(at)
        stream = journeys.replay_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(at), graph)
        q = stream.writeStream.foreachBatch(journeys.append_once(f"{out}-{name}", ["unit_id", "sequence", "kind", "node_id", "outcome"])).option("checkpointLocation", f"{mark}-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        key = lambda d: sorted(str([r[c] for c in ("unit_id", "sequence", "kind", "node_id", "queue_id", "outcome", "attempt_number", "effects")]) for r in d.collect())
        assert key(spark.read.parquet(f"{out}-{name}")) == key(replay.replay(df, graph)), name
    unit = replay.Unit("u", plan := replay.Plan(examples.DEPOT))
    unit.admit()
    for t in examples.DEPOT_TURNS[2][:-1]:
        replay.take(unit, dict(zip(("node_id", "outcome", "error_code", "retryable"), t + (None,) * (4 - len(t)), strict=True)))
    again = replay.Unit.load("u", plan, unit.dump())
    assert "example.depot" not in unit.dump().replace('"id":"example.depot"', "") and again.dump() == unit.dump()
    assert replay.take(again, {"node_id": "ask", "outcome": "enough"}) == replay.take(unit, {"node_id": "ask", "outcome": "enough"}) and len(unit.dump()) < 60


def test_join_inputs():
    """Composed inputs don't depend on arrival, say where they come from, and are checked against their own offers."""
    plan = replay.Plan(examples.DEPOT)
    made = []
    for order in (("scan-a", "scan-b"), ("scan-b", "scan-a")):
        unit = replay.Unit("u", plan)
        unit.admit()
        unit.turn("intake", "ok", evidence="0" * 64)
        for n in order:
            unit.turn(n, "done", replay.canon.artifact("order.v1", {"from": n}), evidence=("a" if n == "scan-a" else "b") * 64, at="2024-05-01T00:00:00.000Z")
        made.append(next(x for n, x in unit.open.values() if n == "ledger"))
    first, payload = made[0], made[0]["payload"]
    assert made[0] == made[1] and first["contractId"] == "join-input.v1" and [o["edgeId"] for o in payload["accepted"]] == ["a-done", "b-done"]
    assert payload["accepted"][0]["sourceNodeRef"] == {"id": "depot.scan-a", "version": 1} and payload["accepted"][1]["sourceEvidenceDigest"] == "b" * 64 and payload["graph"] == plan.ref
    assert replay.check_join_input(plan, first) == first
    for broken in (payload | {"accepted": payload["accepted"][::-1]}, payload | {"nodeRef": {"id": "other", "version": 1}}, payload | {"accepted": payload["accepted"][:1]}, payload | {"unitId": "v"} | {"graph": {}}):
        with pytest.raises(replay.ReplayError):
            replay.check_join_input(plan, replay.canon.artifact("join-input.v1", broken))


def test_unsatisfiable_joins_carry_their_cause():
    unit = replay.Unit("u", plan := replay.Plan(examples.DEPOT))
    unit.admit()
    records = unit.turn("intake", "bad", evidence="c" * 64, at="2024-05-01T00:00:00.000Z")
    artifact = next(x for n, x in unit.open.values() if n == "ask")
    p = artifact["payload"]
    assert artifact["contractId"] == p["schemaVersion"] == "join-unsatisfiable.v1" and p["causeEvidenceDigest"] == "c" * 64 and p["require"] == {"nOf": 2} and p["graph"] == plan.ref
    assert [x["edgeId"] for x in p["impossible"]] == ["a-done", "a-again", "b-done"] and p["impossible"][0] == {"edgeId": "a-done", "sourceNodeId": "scan-a", "causeEvidenceDigest": "c" * 64, "resolvedAt": "2024-05-01T00:00:00.000Z", "reason": "source_unreachable"}
    told = {"unitId": "u", "graphDigest": plan.ref["digest"], "nodeId": "gate", "outcome": "join_unsatisfiable", "accepted": [], "impossible": ["a-done", "a-again", "b-done"], "causeEvidenceDigest": "c" * 64, "resolvedAt": "2024-05-01T00:00:00.000Z", "artifactDigest": artifact["digest"]}
    assert [e["digest"] for e in records[0]["effects"] if e["kind"] == "join_unsatisfiable"] == [replay.canon.digest(told)]


def test_a_clash_refuses_the_whole_batch(spark, tmp_path):
    sink, out = journeys.append_once(str(tmp_path / "out"), ["k"], seal="d"), str(tmp_path / "out")
    batch = lambda *rows: sink(spark.createDataFrame(rows, "k int, d string"), 0)
    batch((1, "x"), (2, "y"), (2, "y"))
    for rows in (((1, "x"), (3, "z"), (2, "other")), ((4, "a"), (4, "b"))):
        with pytest.raises(journeys.AppendError):
            batch(*rows)
    batch((1, "x"), (3, "z"))
    assert sorted((r.k, r.d) for r in spark.read.parquet(out).collect()) == [(1, "x"), (2, "y"), (3, "z")]
