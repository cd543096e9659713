import copy

import pytest
from graphs import DIGESTS, GRAPHS, broken, edge, graph, node

from pathloom.plans import checks, expand, gates, graphs


@pytest.mark.parametrize("name", GRAPHS)
def test_digests(name):
    assert graphs.seal(GRAPHS[name])["digest"] == DIGESTS[name]
    graphs.unseal(graphs.seal(GRAPHS[name]))
    with pytest.raises(graphs.GraphError):
        graphs.unseal(graphs.seal(GRAPHS[name]) | {"description": "changed"})


def test_sound_graphs_have_no_violations(spark):
    assert checks.violations(spark, list(GRAPHS.values())).collect() == []


def test_broken_graphs(spark):
    for k, (g, rule) in enumerate(broken()):
        g["graphId"] += f"-{k}"
    cases = broken()
    for k, (g, _) in enumerate(cases):
        g["graphId"] += f"-{k}"
    found = {}
    for r in checks.violations(spark, [g for g, _ in cases]).collect():
        found.setdefault(r.graph_id, set()).add(r.rule)
    for g, rule in cases:
        assert rule in found[g["graphId"]]


def test_grammar():
    for change in ({"entry": 1, "graphId": "Upper"}, {"version": 0}, {"terminals": []}):
        with pytest.raises(graphs.GraphError):
            graphs.seal(GRAPHS["join"] | change)
    for when in ({}, {"outcome": "a", "anyOf": ["b"]}, {"anyOf": []}, {"anyOf": ["a", "a"]}, {"outcome": "a", "where": []}, {"outcome": "a", "where": [{"pointer": "x", "equals": 1}]}, {"outcome": "a", "where": [{"pointer": "/x", "equals": []}]}):
        with pytest.raises(ValueError):
            graphs.validate_predicate(when)


def test_budget_and_cycles():
    found = graphs.turn_budget(GRAPHS["escalation-ladder"])
    assert found["acyclic"] and found["max_depth"] == 3 and found["nodes"]["tier-1-race"] == {"depth": 2, "occurrences": 1, "turns": 2}
    assert found["max_turns"] == 10 and found["by_kind"] == {"code": 4, "model": 0, "agent": 0, "human": 4, "callback": 2}
    diamond = graph("diamond", "d", [node("a", "x"), node("b", "x"), node("c", "x"), node("d", "x")], [edge("e1", "a", "x", "b", "c"), edge("e2", "b", "x", "d"), edge("e3", "c", "x", "d")], [("d", "x")])
    assert graphs.turn_budget(diamond)["nodes"]["d"]["occurrences"] == 2
    loop = copy.deepcopy(diamond)
    loop["terminals"], loop["edges"] = [], [*loop["edges"], edge("back", "d", "x", "a")]
    assert graphs.turn_budget(loop)["max_turns"] is None and graphs.cycle_edges(loop) == ["back"] and graphs.distances(loop) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graphs.display(loop)["depth"] == {"a": 0, "b": 1, "c": 1, "d": 2} and graphs.topological(diamond) == ["a", "b", "c", "d"]


def test_display_and_principals():
    shown = graphs.display(GRAPHS["escalation-ladder"])
    assert [(a["from"], a["to"], a["outcomes"]) for a in shown["arrows"]][2] == ("review-tier-1", "tier-1-race", ["resolved", "escalate"])
    assert shown["marks"] == ["review-tier-1", "tier-1-timer"] and shown["fan_out"] == [{"edge": "triage-escalate", "to": ["review-tier-1", "tier-1-timer"]}]
    assert graphs.principals(list(GRAPHS.values())) == ["v2_worker", "v2_model", "v2_agent"]


def test_diff(spark):
    new = copy.deepcopy(GRAPHS["join"])
    new["nodes"][1]["turn"]["maxAttempts"] = 5
    new["nodes"][2]["outcomes"]["outcomes"] = ["done"]
    new["edges"] = new["edges"][1:] + [edge("other", "start", "ready", "branch-a")]
    new["terminals"].reverse()
    got = {(r.part, r.id, r.change, r.field) for r in checks.diff(spark, GRAPHS["join"], new).collect()}
    assert got == {("node", "branch-a", "changed", "turn.maxAttempts"), ("edge", "fan-out", "removed", None), ("edge", "other", "added", None)}
    assert checks.diff(spark, new, new).count() == 0


def test_goals():
    g = GRAPHS["human-in-the-middle"]
    goal = {"goalId": "publish", "entry": "draft", "members": ["draft", "approve"], "resolutions": [{"nodeId": "approve", "outcome": "approved", "kind": "resolved"}, {"nodeId": "approve", "outcome": "rejected", "kind": "escalated"}]}
    assert checks.goal_violations(g, {"goals": [goal]}) == []
    assert checks.goal_violations(g, {"goals": [goal | {"members": ["draft", "approve", "publish"]}]})
    assert checks.goal_violations(g, {"goals": [goal | {"resolutions": goal["resolutions"][:1]}]})
    assert checks.goal_violations(g, {"goals": [goal | {"entry": "approve"}]})


FLOW = {
    "entry": "rule", "levels": {"low": 1, "high": 2},
    "tiers": {"free": {"max_attempts": 2, "timeout_ms": 100, "max_tokens_per_attempt": 0, "max_cost_micro_usd_per_attempt": 0}, "paid": {"max_attempts": 3, "timeout_ms": 1000, "max_tokens_per_attempt": 50, "max_cost_micro_usd_per_attempt": 7}},
    "steps": [
        {"step_id": "rule", "level_id": "low", "kind": "deterministic", "budget_tier_id": "free", "outcomes": [{"code": "ok", "kind": "success"}, {"code": "bad", "kind": "failure"}]},
        {"step_id": "check", "level_id": "low", "kind": "validator", "budget_tier_id": "free", "outcomes": [{"code": "valid", "kind": "success"}, {"code": "odd", "kind": "failure"}]},
        {"step_id": "model", "level_id": "high", "kind": "model", "budget_tier_id": "paid", "outcomes": [{"code": "done", "kind": "success"}, {"code": "bad", "kind": "failure"}]},
    ],
    "transitions": [
        {"kind": "advance", "source_step_id": "rule", "outcome_code": "ok", "target_step_id": "check"}, {"kind": "internal_escalation", "source_step_id": "rule", "outcome_code": "bad", "target_step_id": "model"},
        {"kind": "decision", "source_step_id": "check", "outcome_code": "valid"}, {"kind": "human", "source_step_id": "check", "outcome_code": "odd"},
        {"kind": "human", "source_step_id": "model", "outcome_code": "done"}, {"kind": "human", "source_step_id": "model", "outcome_code": "bad"},
    ],
}


def test_gates():
    found = gates.compile_flow(FLOW)
    assert found["order"] == ["rule", "check", "model"] and found["bounds"] == {"steps": 2, "model_calls": 3, "attempts": 5, "tokens": 150, "cost_micro_usd": 21, "elapsed_ms": 3200}
    for at, change in ((0, {"kind": "internal_escalation"}), (1, {"kind": "advance"}), (3, {"kind": "decision"}), (4, {"kind": "decision"}), (1, {"target_step_id": "check"})):
        flow = copy.deepcopy(FLOW)
        flow["transitions"][at] |= change
        with pytest.raises(gates.GateError):
            gates.compile_flow(flow)
    for flow in (FLOW | {"transitions": FLOW["transitions"][1:]}, FLOW | {"limits": {"tokens": 149}}, FLOW | {"entry": "check"}):
        with pytest.raises(gates.GateError):
            gates.compile_flow(flow)


def test_publication(spark):
    digests = lambda gs: spark.createDataFrame([(g["graphId"], g["version"], graphs.seal(g)["digest"]) for g in gs], "graph_id string, version bigint, digest string")
    old, again = [GRAPHS["join"], GRAPHS["filter-chain"]], [GRAPHS["join"]]
    found = lambda a, b: {tuple(r) for r in checks.publication_conflicts(graphs.tables(spark, a), digests(a), graphs.tables(spark, b), digests(b)).collect()}
    assert found(old, again) == set()
    assert found(old, [GRAPHS["join"] | {"description": "other"}]) == {("graph_digest", "fixture.join@1")}
    assert found([GRAPHS["outcome-router"]], [GRAPHS["shadow-lane"]]) == {("node_signature", "fixture.classify@1")}


def _reviewed(**review):
    g = copy.deepcopy(GRAPHS["filter-chain"])
    g["nodes"][1] |= {"approval": {"by": {"kind": "human", "principal": {"id": "boss"}}, "onDeny": {"to": "sink"}}, "review": {"by": {"kind": "human", "principal": {"id": "boss"}}, "onReject": "terminal"} | review}
    return g


def test_expansion(spark):
    g = expand.expand(_reviewed(maxRounds=3))
    assert [n["nodeId"] for n in g["nodes"]] == ["filter", "normalize::approval", "normalize", "normalize::review", "normalize::rework", "sink"]
    assert {(e["edgeId"], e["from"], *e["to"]) for e in g["edges"]} == {
        ("filter-pass", "filter", "normalize::approval"), ("normalize-ok", "normalize::review", "sink"), ("normalize::approval.approved", "normalize::approval", "normalize"), ("normalize::approval.denied", "normalize::approval", "sink"),
        ("normalize::review.in", "normalize", "normalize::review"), ("normalize::review.rework", "normalize::review", "normalize::rework"), ("normalize::rework.out", "normalize::rework", "normalize::review"),
    }
    assert {"nodeId": "normalize::review", "outcome": "rejected"} in g["terminals"] and expand.expand(g) == g
    for n in g["nodes"]:
        n["input"] = "unit-artifact.v1"
        n.pop("outputs", None)
    assert {r.rule for r in checks.violations(spark, [g]).collect()} <= {"other_expansion"}
    budget = graphs.turn_budget(g)
    assert budget["acyclic"] and budget["nodes"]["normalize::review"]["occurrences"] == 3 and budget["nodes"]["normalize::rework"]["occurrences"] == 2 and budget["nodes"]["sink"]["occurrences"] == 2
    assert expand.expand(GRAPHS["join"])["nodes"] == GRAPHS["join"]["nodes"]
    assert not any("rework" in n["nodeId"] for n in expand.expand(_reviewed(maxRounds=1))["nodes"])
    assert graphs.turn_budget(expand.expand(_reviewed(onReject={"retry": True})))["max_turns"] is None
    for bad in ({"maxRounds": 11}, {"onReject": {"to": "normalize"}}, {"onReject": {"to": "gone"}}, {"onReject": {"retry": True}, "maxRounds": 2}):
        with pytest.raises(graphs.GraphError):
            expand.expand(_reviewed(**bad))


def test_review_records():
    request = {"round": 1, "input": "i", "outcome": "ok", "output": "o", "history": []}
    assert expand.review_record("human", request, {"outcome": "accepted"}, 2) == {"outcome": "accepted:ok", "output": "o"}
    again = expand.review_record("human", request, {"outcome": "rejected", "feedback": "f"}, 2)
    assert again["outcome"] == "rework" and again["output"]["round"] == 2 and again["output"]["history"][0]["feedback"] == "f"
    last = expand.review_record("human", request | {"round": 2, "history": again["output"]["history"]}, {"outcome": "rejected"}, 2)
    assert last["outcome"] == "rejected" and len(last["output"]["history"]) == 2
    with pytest.raises(graphs.GraphError):
        expand.review_record("human", request | {"round": 2}, {"outcome": "accepted"}, 2)


def test_binary_question(spark):
    shared = {k: v for k, v in node("q", "x").items() if k not in ("nodeId", "outcomes", "ref")}
    part = expand.binary_question("q", shared, [{"ref": {"id": "q.a", "version": 1}}, {"ref": {"id": "q.b", "version": 1}, "kind": "human"}], "sink", "sink")
    g = graph("q", "q", [*part["nodes"], node("sink", "done")], part["edges"], [(t["nodeId"], t["outcome"]) for t in part["terminals"]] + [("sink", "done")])
    assert checks.violations(spark, [g]).collect() == [] and graphs.distances(g) == {"q": 0, "sink": 1, "q:tier-1": 1}


def test_expansions_are_checked_against_their_settings():
    for draft in (_reviewed(maxRounds=3), _reviewed(maxRounds=1), _reviewed(onReject={"retry": True})):
        made = expand.create(draft)
        assert expand.rederived(made) == made and graphs.unseal(made) == made
        back = expand.unexpand(made)
        assert expand._parts(back) == expand._parts(draft) and expand.expand(back)["nodes"] == made["nodes"]
        for k, e in enumerate(made["edges"]):
            if "::" in e["edgeId"]:
                with pytest.raises(graphs.GraphError):
                    expand.expand(made | {"edges": [*made["edges"][:k], e | {"to": ["filter"]}, *made["edges"][k + 1 :]]})
        role = next(n for n in made["nodes"] if n["nodeId"].endswith("::review"))
        with pytest.raises(graphs.GraphError):
            expand.expand(made | {"nodes": [n | {"principal": {"id": "someone"}} if n is role else n for n in made["nodes"]]})


def test_diff_tells_values_and_outcomes_in_order(spark):
    old, new = copy.deepcopy(GRAPHS["outcome-router"]), copy.deepcopy(GRAPHS["outcome-router"])
    new["nodes"][0]["outcomes"]["outcomes"] = ["other", "noise", "jobs", "a-first"]
    new["nodes"][1]["turn"]["maxAttempts"] = 3
    new["nodes"][0]["binding"]["version"] = 2
    new["edges"][0]["when"] = {"anyOf": ["jobs"]}
    got = {(r.part, r.id, r.field): (r.was, r.now) for r in checks.diff(spark, old, new).collect()}
    assert got == {
        ("node", "classify", "outcomes"): ("receipts", "other,a-first"), ("node", "jobs", "turn.maxAttempts"): ("2", "3"), ("node", "classify", "binding.version"): ("1", "2"),
        ("edge", "route-jobs", "when"): ('{"outcome":"jobs"}', '{"anyOf":["jobs"]}'),
    }
    new["nodes"] = new["nodes"][::-1]
    assert [(r.part, r.id, r.field) for r in checks.diff(spark, old, new).collect()] == sorted(got)


def _with(**parts):
    g = copy.deepcopy(GRAPHS["outcome-router"])
    g["nodes"][0] |= parts
    return g


@pytest.mark.parametrize("parts", [
    {"extra": 1}, {"ref": {"id": "x"}}, {"principal": {"id": "No"}}, {"principal": "x"}, {"binding": {"kind": "code", "bindingId": "b", "version": 1, "bindingDigest": "a" * 64}}, {"binding": {"kind": "model", "bindingId": "b", "version": 1, "bindingDigest": "a"}},
    {"configuration": {"id": "c", "version": 0, "digest": "a" * 64}}, {"join": {"inbound": ["a"], "require": {"nOf": True}}}, {"join": {"inbound": ["a"], "require": "all", "compose": "merge"}}, {"turn": {"leaseMs": 1, "maxAttempts": 11}},
    {"approval": {"by": {"kind": "code", "principal": {"id": "x"}}, "onDeny": "terminal"}}, {"approval": {"by": {"kind": "human", "principal": {"id": "x"}, "binding": {}}, "onDeny": "terminal"}}, {"approval": {"by": {"kind": "human", "principal": {"id": "x"}}, "onDeny": {"to": "x", "retry": True}}},
    {"nodeId": "abc\n"}, {"input": "a.v1\n"},
])
def test_grammar_of_nodes(parts):
    graphs.validate(_with())
    with pytest.raises(graphs.GraphError):
        graphs.validate(_with(**parts))


def test_grammar_of_the_rest():
    for change in ({"edges": [edge("e", "classify", "jobs", "jobs") | {"more": 1}]}, {"edges": [edge("e", "Classify", "jobs", "jobs")]}, {"terminals": [{"nodeId": "a", "outcome": "b", "c": 1}]}, {"more": 1}, {"version": True}):
        with pytest.raises(graphs.GraphError):
            graphs.validate(copy.deepcopy(GRAPHS["outcome-router"]) | change)
    deep = []
    for _ in range(40):
        deep = [deep]
    for odd in (deep, {"a": object()}, {1: 2}, ["x" * 9_000_000], [0] * 300_000):
        with pytest.raises(graphs.GraphError):
            graphs.within_bounds(odd)


def test_sealed_manifests():
    node_ = lambda name, *outcomes: node(name, *outcomes)
    g = graphs.seal(graph("shop", "s", [node_("draft", "ok"), node_("approve", "yes", "no"), node_("publish", "done")], [edge("a", "draft", "ok", "approve"), edge("b", "approve", "yes", "publish")], [("approve", "no"), ("publish", "done")]))
    goal = {"goalId": "decide", "entry": "draft", "members": ["draft", "approve"], "resolutions": [{"nodeId": "approve", "outcome": "yes", "kind": "resolved"}, {"nodeId": "approve", "outcome": "no", "kind": "escalated"}]}
    made = checks.create_manifest(g, [goal])
    assert checks.check_manifest(made, g) == made and made["graph"] == graphs.ref(g)
    other = graphs.seal({k: v for k, v in g.items() if k != "digest"} | {"version": 2})
    for broken, of in ((made | {"manifestDigest": "0" * 64}, g), (made | {"goals": []}, None), (made, other), (made | {"extra": 1}, None)):
        with pytest.raises(graphs.GraphError):
            checks.check_manifest(broken, of)
    for goals in ([goal | {"members": ["draft"]}], [goal, goal], [goal | {"resolutions": goal["resolutions"][:1]}], []):
        with pytest.raises(graphs.GraphError):
            checks.create_manifest(g, goals)
