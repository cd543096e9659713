"""Graphs for tests. Names, descriptions and turn policies are fixed values: known digests are taken over them."""

import copy

CONSOLES = {"human": "v2_console", "callback": "v2_callback", "agent": "v2_agent", "model": "v2_model", "code": "v2_worker"}
POLICY = {"idempotency": "per (unitId, nodeId, attemptNumber)", "leaseMs": 30000, "maxAttempts": 2, "retryTaxonomy": "retryable vs terminal, as v1 durable-stage"}


def node(name, *outcomes, kind="code", **more):
    return {"nodeId": name, "ref": {"id": f"fixture.{name}", "version": 1}, "kind": kind, "input": "unit-artifact.v1", "outcomes": {"version": 1, "outcomes": list(outcomes)}, "principal": {"id": CONSOLES[kind]}, "turn": dict(POLICY), **more}


def edge(name, source, when, *to):
    return {"edgeId": name, "from": source, "when": {"outcome": when} if isinstance(when, str) else when, "to": list(to)}


def graph(name, description, nodes, edges, ends):
    return {"graphId": f"fixture.{name}", "version": 1, "description": description, "entry": nodes[0]["nodeId"], "nodes": nodes, "edges": edges, "terminals": [{"nodeId": n, "outcome": o} for n, o in ends]}


def build():
    lost = "join_unsatisfiable"
    any_of = lambda *o: {"anyOf": list(o)}
    binding = {"kind": "model", "bindingId": "fixture.model.binding", "version": 1, "bindingDigest": "a" * 64}
    return {
        "filter-chain": graph(
            "filter-chain", "A linear filter chain with an early terminal rejection.",
            [node("filter", "pass", "drop"), node("normalize", "ok"), node("sink", "done")],
            [edge("filter-pass", "filter", "pass", "normalize"), edge("normalize-ok", "normalize", "ok", "sink")], [("filter", "drop"), ("sink", "done")],
        ),
        "outcome-router": graph(
            "outcome-router", "A model outcome router with two branches and one terminal outcome.",
            [node("classify", "jobs", "receipts", "noise", kind="model", binding=binding), node("jobs", "accepted"), node("receipts", "accepted")],
            [edge("route-jobs", "classify", "jobs", "jobs"), edge("route-receipts", "classify", "receipts", "receipts")], [("classify", "noise"), ("jobs", "accepted"), ("receipts", "accepted")],
        ),
        "escalation-ladder": graph(
            "escalation-ladder", "An explicit two-tier human escalation ladder.",
            [
                node("triage", "resolved", "escalate"), node("review-tier-1", "resolved", "escalate", kind="human"), node("tier-1-timer", "elapsed", "operator-fired", kind="callback"),
                node("tier-1-race", "resolved", "escalate", lost, join={"inbound": ["tier-1-decision", "tier-1-timeout"], "require": {"nOf": 1}}), node("review-tier-2", "resolved", "rejected", kind="human"),
            ],
            [
                edge("triage-escalate", "triage", "escalate", "review-tier-1", "tier-1-timer"), edge("tier-1-decision", "review-tier-1", any_of("resolved", "escalate"), "tier-1-race"),
                edge("tier-1-timeout", "tier-1-timer", any_of("elapsed", "operator-fired"), "tier-1-race"), edge("race-escalates", "tier-1-race", "escalate", "review-tier-2"),
            ],
            [("triage", "resolved"), ("tier-1-race", "resolved"), ("tier-1-race", lost), ("review-tier-2", "resolved"), ("review-tier-2", "rejected")],
        ),
        "human-in-the-middle": graph(
            "human-in-the-middle", "A human decision routes an approved unit onward instead of terminating by kind.",
            [node("draft", "proposed"), node("approve", "approved", "rejected", kind="human"), node("publish", "published")],
            [edge("draft-proposed", "draft", "proposed", "approve"), edge("approval-granted", "approve", "approved", "publish")], [("approve", "rejected"), ("publish", "published")],
        ),
        "join": graph(
            "join", "A fan-out followed by an all-of join over stable inbound edge IDs.",
            [node("start", "ready"), node("branch-a", "done"), node("branch-b", "done"), node("join", "joined", lost, join={"inbound": ["branch-a-to-join", "branch-b-to-join"], "require": "all"})],
            [edge("fan-out", "start", "ready", "branch-a", "branch-b"), edge("branch-a-to-join", "branch-a", "done", "join"), edge("branch-b-to-join", "branch-b", "done", "join")], [("join", "joined"), ("join", lost)],
        ),
        "shadow-lane": graph(
            "shadow-lane", "An unconditional primary route plus an additive conditional shadow lane.",
            [node("classify", "routed"), node("primary", "done"), node("shadow", "observed", kind="agent")],
            [edge("primary-route", "classify", "routed", "primary"), edge("shadow-high-risk", "classify", {"outcome": "routed", "where": [{"pointer": "/payload/risk", "equals": "high"}]}, "shadow")],
            [("primary", "done"), ("shadow", "observed")],
        ),
    }


DIGESTS = {
    "filter-chain": "cb9b863ed7fad5edf9e5c9a5eb408c441b367f08dcfb7be95ab143b00fa9e55a", "outcome-router": "7e8eacc9dbcc86f480e0b1439ed819ee64c8f18c18335c65b1393d7e71b108b3",
    "escalation-ladder": "12ee176f3a36576476b9701469c280bad19fafa2c4aa104ca8c7fbb8f22f7769", "human-in-the-middle": "39903b7b158ed546c3c8b7bebce099155828a3986f7d4a3cf210ed3f27f11020",
    "join": "ff7483988a6add97126155a3f324de37dd10d008031b7614e3a0696ea2e2a3f6", "shadow-lane": "2b453a8a80b5b0357b2dfc7d1db1cffa05221e6021262af0ff3d59d1860e0a1e",
}
GRAPHS = build()


def broken():
    """(graph, rule it breaks)."""
    out = []
    g = copy.deepcopy(GRAPHS["filter-chain"])
    g["nodes"].append(node("orphan", "done"))
    g["terminals"].append({"nodeId": "orphan", "outcome": "done"})
    out.append((g, "unreachable"))
    g = copy.deepcopy(GRAPHS["filter-chain"])
    g["terminals"] = g["terminals"][1:]
    out.append((g, "uncovered_outcome"))
    g = copy.deepcopy(GRAPHS["join"])
    g["nodes"][3]["join"]["inbound"] = ["fan-out", "branch-b-to-join"]
    out.append((g, "join_inbound"))
    g = copy.deepcopy(GRAPHS["filter-chain"])
    g["edges"][0]["when"] = {"outcome": "mystery"}
    out.append((g, "undeclared_outcome"))
    g = copy.deepcopy(GRAPHS["filter-chain"])
    g["edges"][1]["to"] = ["nowhere"]
    out.append((g, "unknown_target"))
    g = copy.deepcopy(GRAPHS["filter-chain"])
    g["nodes"][1]["input"] = "other.v1"
    out.append((g, "contract_mismatch"))
    g = copy.deepcopy(GRAPHS["outcome-router"])
    del g["nodes"][0]["binding"]
    out.append((g, "model_without_binding"))
    g = copy.deepcopy(GRAPHS["filter-chain"])
    g["terminals"].append({"nodeId": "filter", "outcome": "pass"})
    out.append((g, "terminal_and_routed"))
    return out
