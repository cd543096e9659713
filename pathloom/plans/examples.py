"""Example documents for the registered queries: picking an order's parts, and a gate."""

from __future__ import annotations


def _node(name: str, *outcomes: str, **more) -> dict:
    return {
        "nodeId": name, "ref": {"id": f"picking.{name}", "version": 1}, "kind": "code", "input": "order.v1", "outcomes": {"version": 1, "outcomes": list(outcomes)},
        "principal": {"id": "picker"}, "turn": {"idempotency": "per (unitId, nodeId, attemptNumber)", "leaseMs": 30000, "maxAttempts": 2, "retryTaxonomy": "retryable vs terminal, as v1 durable-stage"}, **more,
    }


def _edge(name: str, source: str, outcome: str, *to: str) -> dict:
    return {"edgeId": name, "from": source, "when": {"outcome": outcome}, "to": list(to)}


_PICKS = [f"pick-{k}" for k in (1, 2, 3)]


def _picking(version: int, require: object, nodes: list[dict], edges: list[dict], ends: list[tuple[str, str]]) -> dict:
    join = {"inbound": [f"{p}-done" for p in _PICKS], "require": require}
    return {
        "graphId": "example.picking", "version": version, "description": "Picks three parts of an order and packs them.", "entry": "received",
        "nodes": [_node("received", "ready"), *(_node(p, "done", "out") for p in _PICKS), _node("pack", "packed", "join_unsatisfiable", join=join), *nodes],
        "edges": [_edge("start", "received", "ready", *_PICKS), *(_edge(f"{p}-done", p, "done", "pack") for p in _PICKS), *edges],
        "terminals": [{"nodeId": n, "outcome": o} for n, o in [*((p, "out") for p in _PICKS), *ends]],
    }


PICKING_OLD = _picking(1, "all", [], [], [("pack", "packed"), ("pack", "join_unsatisfiable")])
#: Two parts are enough, and a customer who gets too few can order again.
PICKING = _picking(
    2, {"nOf": 2}, [_node("ask", "again", "enough", kind="human", input="join-unsatisfiable.v1", outputs={"again": "order.v1"})],
    [_edge("too-few", "pack", "join_unsatisfiable", "ask"), _edge("retry", "ask", "again", "received")], [("pack", "packed"), ("ask", "enough")],
)


def _broken(k: int, **parts) -> dict:
    return PICKING | {"version": 100 + k} | parts


_N, _E, _T = PICKING["nodes"], PICKING["edges"], PICKING["terminals"]
#: The picking graph with one thing wrong each.
PICKING_BROKEN = [
    _broken(0, terminals=_T[1:]), _broken(1, entry="nowhere"), _broken(2, edges=[*_E, _edge("lost", "pick-9", "done", "pack")]), _broken(3, edges=[_edge("start", "received", "ready", *_PICKS, "pick-9"), *_E[1:]]),
    _broken(4, terminals=[*_T, {"nodeId": "pack", "outcome": "dropped"}]), _broken(5, edges=[*_E, _edge("odd", "pick-1", "odd", "ask")]), _broken(6, nodes=[*_N[:-1], _N[-1] | {"input": "order.v2"}]),
    _broken(7, nodes=[*_N[:-1], _N[-1] | {"kind": "model"}]), _broken(8, nodes=[_N[0], _node("pick-1", "done", "out", "join_unsatisfiable"), *_N[2:]]), _broken(9, entry="pack"),
    _broken(10, nodes=[*_N[:2], _N[2] | {"ref": _N[1]["ref"], "kind": "agent"}, *_N[3:]]), _broken(11, nodes=[n | {"join": {"inbound": ["pick-1-done"], "require": {"nOf": 2}}} if "join" in n else n for n in _N]),
    _broken(12, terminals=[*_T, {"nodeId": "received", "outcome": "ready"}]), _broken(13, nodes=[*_N, _node("alone", "done")]), _broken(14, nodes=[_node("pack", "packed", join=n["join"]) if "join" in n else n for n in _N]),
    _broken(16, nodes=[_N[0] | {"binding": {"kind": "model", "bindingId": "b", "version": 1, "bindingDigest": "a" * 64}}, *_N[1:]]), _broken(17, nodes=[_N[0] | {"principal": {"id": "engine"}}, *_N[1:]]),
    _broken(18, nodes=[n | {"join": n["join"] | {"compose": "envelope"}} if "join" in n else n for n in _N]),
    _broken(19, description="edited by hand after its approval was written out", entry="received::approval", nodes=[
        _node("received::approval", "approved", "denied") | {"ref": {"id": "picking.received::approval.human", "version": 1}, "kind": "human"}, _N[0] | {"approval": {"by": {"kind": "human", "principal": {"id": "boss"}}, "onDeny": "terminal"}}, *_N[1:]],
        edges=[_edge("received::approval.approved", "received::approval", "approved", "received"), *_E], terminals=[*_T, {"nodeId": "received::approval", "outcome": "denied"}]),
    _broken(15, edges=[_edge("start", "received", "ready", *_PICKS) | {"when": {"outcome": "ready", "where": [{"pointer": "/payload/open", "equals": True}]}}, *_E[1:]]),
]

GATE = {
    "entry": "rules", "levels": {"rules": 1, "model": 2},
    "tiers": {
        "none": {"max_attempts": 1, "timeout_ms": 1000, "max_tokens_per_attempt": 0, "max_cost_micro_usd_per_attempt": 0},
        "small": {"max_attempts": 2, "timeout_ms": 20000, "max_tokens_per_attempt": 800, "max_cost_micro_usd_per_attempt": 400},
    },
    "steps": [
        {"step_id": "rules", "level_id": "rules", "kind": "validator", "budget_tier_id": "none", "outcomes": [{"code": "clear", "kind": "success"}, {"code": "unclear", "kind": "failure"}]},
        {"step_id": "judge", "level_id": "model", "kind": "model", "budget_tier_id": "small", "outcomes": [{"code": "judged", "kind": "success"}, {"code": "failed", "kind": "failure"}]},
        {"step_id": "verify", "level_id": "model", "kind": "validator", "budget_tier_id": "none", "outcomes": [{"code": "valid", "kind": "success"}, {"code": "invalid", "kind": "failure"}]},
    ],
    "transitions": [
        {"kind": "decision", "source_step_id": "rules", "outcome_code": "clear"}, {"kind": "internal_escalation", "source_step_id": "rules", "outcome_code": "unclear", "target_step_id": "judge"},
        {"kind": "advance", "source_step_id": "judge", "outcome_code": "judged", "target_step_id": "verify"}, {"kind": "human", "source_step_id": "judge", "outcome_code": "failed"},
        {"kind": "decision", "source_step_id": "verify", "outcome_code": "valid"}, {"kind": "human", "source_step_id": "verify", "outcome_code": "invalid"},
    ],
}


def _depot() -> dict:
    node = lambda name, *outcomes, **more: _node(name, *outcomes, **more) | {"ref": {"id": f"depot.{name}", "version": 1}}
    lost = "join_unsatisfiable"
    return {
        "graphId": "example.depot", "version": 1, "description": "Scans parcels at three places, passes two scans and books two of them.", "entry": "intake",
        "nodes": [
            node("intake", "ok", "bad"), node("scan-a", "done", "again"), node("scan-b", "done", "out"), node("scan-c", "done", "out"),
            node("gate", "packed", lost, join={"inbound": ["a-done", "a-again", "b-done", "c-done"], "require": {"nOf": 2}}),
            node("ledger", "booked", lost, input="join-input.v1", join={"inbound": ["a-done", "b-done"], "require": "all", "compose": "envelope"}),
            node("ask", "again", "enough", kind="human", input="join-unsatisfiable.v1", outputs={"again": "order.v1"}),
        ],
        "edges": [
            _edge("start", "intake", "ok", "scan-a", "scan-b", "scan-c"), _edge("a-done", "scan-a", "done", "gate", "ledger"), _edge("a-again", "scan-a", "again", "scan-a", "gate"),
            _edge("b-done", "scan-b", "done", "gate", "ledger"), _edge("c-done", "scan-c", "done", "gate"), _edge("too-few", "gate", lost, "ask"), _edge("retry", "ask", "again", "intake"),
        ],
        "terminals": [{"nodeId": n, "outcome": o} for n, o in [("intake", "bad"), ("scan-b", "out"), ("scan-c", "out"), ("gate", "packed"), ("ledger", "booked"), ("ledger", lost), ("ask", "enough")]],
    }


#: Joins of any two and of all, a cycle that offers twice, a leg that dies, a recovery that starts again.
DEPOT = _depot()
#: Turns of six kinds of units on it: node, outcome, or error and whether it may run again. 0: a late offer; 1: the same edge offered
#: twice through the cycle, a join that can't be met once the other has fired; 2: failures for good, recovery, the end; 3: a retry, a
#: refused turn; 4: recovery that starts again, late offers; 5: an unknown outcome, two offers of one source.
DEPOT_TURNS = {
    0: [("intake", "ok"), ("scan-a", "done"), ("scan-b", "done"), ("scan-c", "done"), ("gate", "packed"), ("ledger", "booked")],
    1: [("intake", "ok"), ("scan-a", "again"), ("scan-a", "again"), ("scan-b", "out"), ("scan-c", "out"), ("scan-a", "done"), ("gate", "packed")],
    2: [("intake", "ok"), ("scan-b", None, "timeout", True), ("scan-b", None, "timeout", True), ("scan-c", "out"), ("scan-a", None, "broken", False), ("ask", "enough")],
    3: [("intake", "ok"), ("scan-a", None, "timeout", True), ("gate", "packed"), ("scan-a", "done")],
    4: [("intake", "bad"), ("ask", "again"), ("intake", "ok"), ("scan-a", "done"), ("scan-b", "done"), ("ledger", "booked")],
    5: [("intake", "ok"), ("scan-a", "mystery"), ("scan-a", "again"), ("scan-a", "done"), ("scan-b", "done")],
}
DEPOT_GOALS = {
    "goals": [
        {"goalId": "pick", "entry": "intake", "members": ["intake", "scan-a", "scan-b", "scan-c"], "resolutions": [{"nodeId": "scan-a", "outcome": "done", "kind": "resolved"}, {"nodeId": "intake", "outcome": "bad", "kind": "escalated"}]},
        {"goalId": "settle", "entry": "gate", "members": ["gate", "ask"], "resolutions": [{"nodeId": "gate", "outcome": "packed", "kind": "resolved"}, {"nodeId": "ask", "outcome": "enough", "kind": "escalated"}]},
        {"goalId": "book", "entry": "ledger", "members": ["ledger"], "resolutions": [{"nodeId": "ledger", "outcome": "booked", "kind": "resolved"}, {"nodeId": "ledger", "outcome": "join_unsatisfiable", "kind": "escalated"}]},
    ]
}
#: What each kind of unit comes to, worked out by hand. Occurrences: number, node, record that queued it, state, attempts, failures,
#: outcome, error.
DEPOT_OCCURRENCES = {
    0: [(1, "intake", 1, "settled", 1, 0, "ok", None), (2, "scan-a", 2, "settled", 1, 0, "done", None), (3, "scan-b", 2, "settled", 1, 0, "done", None), (4, "scan-c", 2, "settled", 1, 0, "done", None), (5, "gate", 4, "settled", 1, 0, "packed", None), (6, "ledger", 4, "settled", 1, 0, "booked", None)],
    1: [(1, "intake", 1, "settled", 1, 0, "ok", None), (2, "scan-a", 2, "settled", 1, 0, "again", None), (3, "scan-b", 2, "settled", 1, 0, "out", None), (4, "scan-c", 2, "settled", 1, 0, "out", None), (5, "scan-a", 3, "settled", 1, 0, "again", None), (6, "scan-a", 4, "settled", 1, 0, "done", None), (7, "gate", 7, "settled", 1, 0, "packed", None)],
    2: [(1, "intake", 1, "settled", 1, 0, "ok", None), (2, "scan-a", 2, "dead", 1, 1, None, "broken"), (3, "scan-b", 2, "dead", 2, 2, None, "timeout"), (4, "scan-c", 2, "settled", 1, 0, "out", None), (5, "ask", 7, "settled", 1, 0, "enough", None)],
    3: [(1, "intake", 1, "settled", 1, 0, "ok", None), (2, "scan-a", 2, "settled", 2, 1, "done", "timeout"), (3, "scan-b", 2, "open", 0, 0, None, None), (4, "scan-c", 2, "open", 0, 0, None, None)],
    4: [(1, "intake", 1, "settled", 1, 0, "bad", None), (2, "ask", 3, "settled", 1, 0, "again", None), (3, "intake", 4, "settled", 1, 0, "ok", None), (4, "scan-a", 5, "settled", 1, 0, "done", None), (5, "scan-b", 5, "settled", 1, 0, "done", None), (6, "scan-c", 5, "open", 0, 0, None, None), (7, "ledger", 7, "settled", 1, 0, "booked", None)],
    5: [(1, "intake", 1, "settled", 1, 0, "ok", None), (2, "scan-a", 2, "settled", 1, 0, "again", None), (3, "scan-b", 2, "settled", 1, 0, "done", None), (4, "scan-c", 2, "open", 0, 0, None, None), (5, "scan-a", 3, "settled", 1, 0, "done", None), (6, "gate", 4, "open", 0, 0, None, None), (7, "ledger", 5, "open", 0, 0, None, None)],
}
#: Joins: node, status, edges offered and impossible in the order in which they were resolved, late offers, number of the occurrence, selected edge.
DEPOT_JOINS = {
    0: [("gate", "queued", "a-done,b-done", "", 1, 5, "a-done"), ("ledger", "queued", "a-done,b-done", "", 0, 6, "a-done")],
    1: [("gate", "queued", "a-again,a-done", "", 1, 7, "a-done"), ("ledger", "unsatisfiable", "a-done", "b-done", 0, None, None)],
    2: [("gate", "unsatisfiable", "", "a-done,a-again,b-done", 0, None, None), ("ledger", "unsatisfiable", "", "a-done", 0, None, None)],
    3: [("gate", "pending", "a-done", "", 0, None, None), ("ledger", "pending", "a-done", "", 0, None, None)],
    4: [("gate", "unsatisfiable", "", "a-done,a-again,b-done", 2, None, None), ("ledger", "queued", "a-done,b-done", "", 0, 7, "a-done")],
    5: [("gate", "queued", "a-again,a-done", "", 1, 6, "a-done"), ("ledger", "queued", "a-done,b-done", "", 0, 7, "a-done")],
}
#: How often each edge was taken.
DEPOT_TAKEN = {
    0: [("start", 3), ("a-done", 2), ("b-done", 2)], 1: [("start", 3), ("a-again", 3), ("a-done", 2)], 2: [("start", 3), ("too-few", 1)], 3: [("start", 3), ("a-done", 2)],
    4: [("too-few", 1), ("retry", 1), ("start", 3), ("a-done", 1), ("b-done", 1)], 5: [("start", 3), ("a-again", 2), ("a-done", 2), ("b-done", 1)],
}
#: Goals: goal, status, resolution, open and dead members, turns.
DEPOT_CLOSURES = {
    0: [("pick", "closed", "scan-a:done/resolved", "", "", 4), ("settle", "closed", "gate:packed/resolved", "", "", 1), ("book", "closed", "ledger:booked/resolved", "", "", 1)],
    1: [("pick", "closed", "scan-a:done/resolved", "", "", 6), ("settle", "closed", "gate:packed/resolved", "", "", 1), ("book", "closed", "ledger:join_unsatisfiable/escalated", "", "", 0)],
    2: [("pick", "dead", None, "", "scan-a,scan-b", 5), ("settle", "closed", "ask:enough/escalated", "", "", 1), ("book", "closed", "ledger:join_unsatisfiable/escalated", "", "", 0)],
    3: [("pick", "closed", "scan-a:done/resolved", "scan-b,scan-c", "", 3), ("settle", "unentered", None, "", "", 0), ("book", "unentered", None, "", "", 0)],
    4: [("pick", "ambiguous", None, "scan-c", "", 4), ("settle", "open", None, "", "", 1), ("book", "closed", "ledger:booked/resolved", "", "", 1)],
    5: [("pick", "closed", "scan-a:done/resolved", "scan-c", "", 4), ("settle", "open", None, "gate", "", 0), ("book", "open", None, "ledger", "", 0)],
}
#: Kinds of the records, in order; refused turns stand outside the sequence.
DEPOT_RECORDS = {
    0: "unit_admitted turn_settled turn_settled turn_settled turn_settled turn_settled turn_settled", 1: "unit_admitted turn_settled turn_settled turn_settled turn_settled turn_settled turn_settled turn_settled join_unsatisfiable",
    2: "unit_admitted turn_settled turn_failed turn_failed turn_settled turn_failed join_unsatisfiable turn_settled join_unsatisfiable", 3: "unit_admitted turn_settled turn_failed turn_settled",
    4: "unit_admitted turn_settled join_unsatisfiable turn_settled turn_settled turn_settled turn_settled turn_settled", 5: "unit_admitted turn_settled turn_settled turn_settled turn_settled",
}
