"""Graph definitions: shape, seal, tables, and the kernels that walk a graph.

A definition is at most 256 nodes and 2,048 edges, so it is validated and walked on the driver; its tables are
DataFrames that big facts join with.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession

from pathloom.functions import canon

KINDS = ("code", "model", "agent", "human", "callback")
MAX_NODES, MAX_EDGES, MAX_TERMINALS, MAX_INBOUND, MAX_ATTEMPTS, MAX_LEASE_MS = 256, 2048, 1024, 256, 10, 86_400_000
UNSATISFIABLE = "join_unsatisfiable"
#: Contracts and the principal that the engine itself uses; fixed values.
UNSATISFIABLE_CONTRACT = "join-unsatisfiable.v1"
JOIN_INPUT_CONTRACT = "join-input.v1"
ENGINE_PRINCIPAL = "engine"


class GraphError(ValueError):
    """A definition that breaks a rule."""


def _need(ok: object, what: str) -> None:
    if not ok:
        raise GraphError(what)


def outcomes_of(when: dict) -> list[str]:
    """The outcomes that a predicate names, in order."""
    return list(when["anyOf"]) if "anyOf" in when else [when["outcome"]]


def is_unconditional(when: dict) -> bool:
    return "where" not in when


def validate_predicate(when: dict) -> None:
    _need(set(when) in ({"outcome"}, {"anyOf"}, {"outcome", "where"}), "a predicate is an outcome, any of some, or an outcome with matches")
    names = outcomes_of(when)
    _need(1 <= len(names) <= 64 and len(set(names)) == len(names), "a predicate names 1 to 64 different outcomes")
    for match in when.get("where", ()):
        _need(set(match) == {"pointer", "equals"}, "a match is a pointer and a value")
        canon.pointer_tokens(match["pointer"])
        value = match["equals"]
        _need(value is None or isinstance(value, bool | int | float | str), "a match compares with a scalar")
        canon.canonical_json(value)
    _need(1 <= len(when.get("where", [0])) <= 32, "a predicate has 1 to 32 matches")


#: Fields of a definition's parts, those that have to be there and those that may; fixed values.
FIELDS: dict[str, tuple[set[str], set[str]]] = {
    "graph": ({"graphId", "version", "description", "entry", "nodes", "edges", "terminals"}, {"schemaVersion", "digest"}),
    "node": ({"nodeId", "ref", "kind", "input", "outcomes", "principal", "turn"}, {"outputs", "binding", "configuration", "join", "approval", "review"}),
    "edge": ({"edgeId", "from", "when", "to"}, set()), "terminal": ({"nodeId", "outcome"}, set()), "ref": ({"id", "version"}, set()), "principal": ({"id"}, set()), "configuration": ({"id", "version", "digest"}, set()),
    "binding": ({"kind", "bindingId", "version", "bindingDigest"}, set()), "turn": ({"leaseMs", "maxAttempts"}, {"idempotency", "retryTaxonomy"}), "outcomes": ({"version", "outcomes"}, set()),
    "join": ({"inbound", "require"}, {"compose"}), "approval": ({"by", "onDeny"}, set()), "review": ({"by", "onReject"}, {"maxRounds"}), "actor": ({"kind", "principal"}, {"binding"}),
}
#: What a definition may hold in all, so that no document takes a validator to its knees.
MAX_DEPTH, MAX_VALUES, MAX_TEXT = 32, 200_000, 8_000_000


def _shaped(x: object, part: str, what: str) -> None:
    must, may = FIELDS[part]
    _need(isinstance(x, dict), f"{what} is no object")
    _need(must <= set(x) and set(x) <= must | may, f"{what}: fields {sorted(must - set(x)) or sorted(set(x) - must - may)}")


def within_bounds(document: object, depth: int = MAX_DEPTH, values: int = MAX_VALUES, text: int = MAX_TEXT) -> None:
    """Refuses documents that are too deep, hold too many values or too much text, or anything but JSON."""
    todo: list[tuple[object, int]] = [(document, 1)]
    while todo:
        x, at = todo.pop()
        values -= 1
        _need(at <= depth and values >= 0, "a document of bounded depth and size")
        if isinstance(x, dict):
            _need(all(isinstance(k, str) for k in x), "names are texts")
            text -= sum(map(len, x))
            todo += [(v, at + 1) for v in x.values()]
        elif isinstance(x, list | tuple):
            todo += [(v, at + 1) for v in x]
        elif isinstance(x, str):
            text -= len(x)
        else:
            _need(x is None or isinstance(x, bool | int | float), f"{type(x).__name__} is not JSON")
        _need(text >= 0, "a document of bounded text")


def _identifier(x: object, what: str) -> None:
    _need(isinstance(x, str) and re.match(canon.IDENTIFIER, x), f"{what}: {x!r} is no identifier")


def _whole(x: object, least: int, most: int, what: str) -> None:
    _need(isinstance(x, int) and not isinstance(x, bool) and least <= x <= most, f"{what}: an integer from {least} to {most}")


def _named(x: dict, part: str, what: str, name: str = "id", seal: str | None = None) -> None:
    """A reference by name and version, and by digest if it has one."""
    _shaped(x, part, what)
    _identifier(x[name], what)
    _whole(x["version"], 1, canon.MAX_SAFE, f"{what} version")
    if seal:
        _need(isinstance(x[seal], str) and re.match(canon.DIGEST, x[seal]), f"{what}: no digest")


def validate_actor(x: dict, what: str = "actor") -> None:
    """Who approves or reviews: a person, or a model with its binding."""
    _shaped(x, "actor", what)
    _need(x["kind"] in ("human", "model") and ("binding" in x) == (x["kind"] == "model"), f"{what} is a person, or a model with a binding")
    _shaped(x["principal"], "principal", what)
    _identifier(x["principal"]["id"], f"{what} principal")
    if "binding" in x:
        validate_binding(x["binding"], what)


def validate_binding(x: dict, what: str = "binding") -> None:
    _named(x, "binding", what, "bindingId", "bindingDigest")
    _need(x["kind"] == "model", f"{what}: only models are bound")


def validate_route(x: object, what: str = "route") -> None:
    """Where a denial or rejection goes: the end, a node, or back to be asked again."""
    if x != "terminal":
        _need(isinstance(x, dict) and set(x) in ({"to"}, {"retry"}) and (x.get("retry", True) is True), f"{what}: the end, a node or a retry")
        if "to" in x:
            _identifier(x["to"], what)


def validate_node(node: dict) -> None:
    """A node's own grammar."""
    _shaped(node, "node", f"node {node.get('nodeId')!r}" if isinstance(node, dict) else "node")
    x = node["nodeId"]
    _identifier(x, "node")
    _named(node["ref"], "ref", f"{x} ref")
    _need(node["kind"] in KINDS, f"{x}: no kind {node['kind']!r}")
    _need(isinstance(node["input"], str) and re.match(canon.CONTRACT_ID, node["input"]), f"{x}: no contract {node['input']!r}")
    _shaped(node["principal"], "principal", f"{x} principal")
    _identifier(node["principal"]["id"], f"{x} principal")
    vocabulary = node["outcomes"]
    _shaped(vocabulary, "outcomes", f"{x} outcomes")
    _need(vocabulary["version"] == node["ref"]["version"], f"{x}: the vocabulary has the version of the node")
    names = vocabulary["outcomes"]
    _need(1 <= len(names) <= 64 and len(set(names)) == len(names), f"{x}: 1 to 64 different outcomes")
    for o in names:
        _identifier(o, f"{x} outcome")
    _shaped(node["turn"], "turn", f"{x} turn")
    _whole(node["turn"]["leaseMs"], 1, MAX_LEASE_MS, f"{x} lease")
    _whole(node["turn"]["maxAttempts"], 1, MAX_ATTEMPTS, f"{x} attempts")
    for outcome, contract in node.get("outputs", {}).items():
        _need(outcome in names and re.match(canon.CONTRACT_ID, contract), f"{x}: outputs are contracts of declared outcomes")
    if "binding" in node:
        validate_binding(node["binding"], f"{x} binding")
    if "configuration" in node:
        _named(node["configuration"], "configuration", f"{x} configuration", "id", "digest")
    if "join" in node:
        _shaped(node["join"], "join", f"{x} join")
        inbound, require = node["join"]["inbound"], node["join"]["require"]
        _need(1 <= len(inbound) <= MAX_INBOUND and len(set(inbound)) == len(inbound), f"{x}: 1 to 256 different inbound edges")
        _need(require == "all" or (isinstance(require, dict) and set(require) == {"nOf"}), f"{x}: a join requires all or n of its edges")
        if require != "all":
            _whole(require["nOf"], 1, MAX_INBOUND, f"{x} join")
        _need(node["join"].get("compose", "select") in ("select", "envelope"), f"{x}: a join selects or composes")
    for part, route in (("approval", "onDeny"), ("review", "onReject")):
        if part in node:
            _shaped(node[part], part, f"{x} {part}")
            validate_actor(node[part]["by"], f"{x} {part}")
            validate_route(node[part][route], f"{x} {part}")


def validate(draft: dict) -> None:
    """The grammar of a definition; what its parts say of each other is for ``checks``."""
    within_bounds(draft)
    _shaped(draft, "graph", "graph")
    _identifier(draft["graphId"], "graph")
    _identifier(draft["entry"], "entry")
    _whole(draft["version"], 1, canon.MAX_SAFE, "version")
    for part, least, most in (("nodes", 1, MAX_NODES), ("edges", 0, MAX_EDGES), ("terminals", 1, MAX_TERMINALS)):
        _need(least <= len(draft[part]) <= most, f"{least} to {most} {part}")
    for part, key in (("nodes", "nodeId"), ("edges", "edgeId")):
        names = [x[key] for x in draft[part]]
        _need(len(set(names)) == len(names), f"{part} have different ids")
    for t in draft["terminals"]:
        _shaped(t, "terminal", "terminal")
    pairs = [(t["nodeId"], t["outcome"]) for t in draft["terminals"]]
    _need(len(set(pairs)) == len(pairs), "terminals are different")
    for node in draft["nodes"]:
        validate_node(node)
    for edge in draft["edges"]:
        _shaped(edge, "edge", f"edge {edge.get('edgeId')!r}")
        _identifier(edge["edgeId"], "edge")
        _identifier(edge["from"], f"{edge['edgeId']} source")
        _need(1 <= len(edge["to"]) <= 64 and len(set(edge["to"])) == len(edge["to"]), f"{edge['edgeId']}: 1 to 64 different targets")
        for t in edge["to"]:
            _identifier(t, f"{edge['edgeId']} target")
        validate_predicate(edge["when"])


def seal(draft: dict) -> dict:
    """A validated definition with its digest."""
    validate(draft)
    body = {k: v for k, v in draft.items() if k != "digest"}
    return body | {"digest": canon.digest(body)}


def unseal(graph: dict) -> dict:
    """A sealed definition whose digest is its own; anything else raises."""
    _need(seal(graph)["digest"] == graph.get("digest"), "the digest is not the definition's")
    return graph


def ref(graph: dict) -> dict:
    return {"id": graph["graphId"], "version": graph["version"], "digest": graph["digest"]}


def tables(spark: SparkSession, graphs: list[dict]) -> dict[str, DataFrame]:
    """``node, edge, arc, terminal, outcome`` tables of definitions."""
    rows: dict[str, list] = defaultdict(list)
    for g in graphs:
        at = (g["graphId"], g["version"])
        for k, n in enumerate(g["nodes"]):
            join = n.get("join")
            n_of = None if not join or join["require"] == "all" else join["require"]["nOf"]
            signature = canon.digest({"kind": n["kind"], "input": n["input"], "outcomes": sorted(n["outcomes"]["outcomes"]), "outputs": n.get("outputs", {})})
            rows["node"].append((*at, k, n["nodeId"], n["ref"]["id"], n["ref"]["version"], n["kind"], n["input"], n.get("outputs", {}), n["principal"]["id"], n.get("binding", {}).get("bindingDigest"), n["turn"]["maxAttempts"], join and join["inbound"], n_of, join and join.get("compose", "select"), signature, n["nodeId"] == g["entry"]))
            rows["outcome"] += [(*at, n["nodeId"], j, o) for j, o in enumerate(n["outcomes"]["outcomes"])]
        for k, e in enumerate(g["edges"]):
            where = [(m["pointer"], canon.canonical_json(m["equals"])) for m in e["when"].get("where", [])]
            rows["edge"].append((*at, k, e["edgeId"], e["from"], outcomes_of(e["when"]), where, is_unconditional(e["when"])))
            rows["arc"] += [(*at, k, e["edgeId"], e["from"], j, t) for j, t in enumerate(e["to"])]
        rows["terminal"] += [(*at, t["nodeId"], t["outcome"]) for t in g["terminals"]]
    head = "graph_id string, version bigint, "
    schemas = {
        "node": "node_ord int, node_id string, ref_id string, ref_version bigint, kind string, input string, outputs map<string,string>, principal_id string, binding_digest string, max_attempts int, inbound array<string>, n_of int, compose string, signature string, entry boolean",
        "outcome": "node_id string, outcome_ord int, outcome string",
        "edge": "edge_ord int, edge_id string, source string, outcomes array<string>, where array<struct<pointer:string,equals_json:string>>, unconditional boolean",
        "arc": "edge_ord int, edge_id string, source string, target_ord int, target string",
        "terminal": "node_id string, outcome string",
    }
    return {name: spark.createDataFrame(rows[name], head + schema) for name, schema in schemas.items()}


# ---- walks over one definition -------------------------------------------------------------------------


def arcs(graph: dict, without: frozenset[str] = frozenset()) -> list[tuple[str, str, str]]:
    """(edge, source, target) in authored order."""
    return [(e["edgeId"], e["from"], t) for e in graph["edges"] if e["edgeId"] not in without for t in e["to"]]


def successors(graph: dict, without: frozenset[str] = frozenset()) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {n["nodeId"]: [] for n in graph["nodes"]}
    for edge, source, target in arcs(graph, without):
        out[source].append((edge, target))
    return out


def distances(graph: dict) -> dict[str, int]:
    """Steps from the entry to each node that can be reached."""
    found, queue, out = {graph["entry"]: 0}, deque([graph["entry"]]), successors(graph)
    while queue:
        at = queue.popleft()
        for _, target in out[at]:
            if target not in found:
                found[target] = found[at] + 1
                queue.append(target)
    return found


def cycle_edges(graph: dict, without: frozenset[str] = frozenset()) -> list[str]:
    """Edges that close a cycle in a depth-first walk in authored order."""
    out, state, found = successors(graph, without), {}, []
    for root in [graph["entry"], *out]:
        if root in state:
            continue
        state[root], path = 1, [(root, iter(out[root]))]
        while path:
            at, rest = path[-1]
            step = next(rest, None)
            if step is None:
                state[at] = 2
                path.pop()
            elif state.get(step[1]) == 1:
                found.append(step[0])
            elif step[1] not in state:
                state[step[1]] = 1
                path.append((step[1], iter(out[step[1]])))
    return list(dict.fromkeys(found))


def topological(graph: dict, without: frozenset[str] = frozenset()) -> list[str]:
    """Nodes after all their sources, ties in authored order; only for acyclic graphs."""
    out = successors(graph, without)
    waiting = dict.fromkeys(out, 0)
    for steps in out.values():
        for t in {t for _, t in steps}:
            waiting[t] += 1
    order, ready = [], [n for n in out if not waiting[n]]
    while ready:
        at = ready.pop(0)
        order.append(at)
        freed = {t for _, t in out[at]}
        for t in freed:
            waiting[t] -= 1
        ready += [n for n in out if n in freed and not waiting[n]]
    _need(len(order) == len(out), "the graph has a cycle")
    return order


def review_loops(graph: dict) -> dict[str, tuple[str, str, str, int]]:
    """By review node: (back edge, subject, rework node, rounds) of bounded reviews."""
    out = {}
    for n in graph["nodes"]:
        rounds = n.get("review", {}).get("maxRounds", 2)
        route = n.get("review", {}).get("onReject")
        if "review" in n and not (isinstance(route, dict) and route.get("retry")) and rounds >= 2:
            x = n["nodeId"]
            out[f"{x}::review"] = (f"{x}::rework.out", x, f"{x}::rework", rounds)
    return out


def turn_budget(graph: dict) -> dict:
    """Worst-case occurrences, turns and depth; None where a cycle has no bound."""
    nodes = {n["nodeId"]: n for n in graph["nodes"]}
    loops = {k: v for k, v in review_loops(graph).items() if k in nodes}
    skip = frozenset(v[0] for v in loops.values())
    reworks = {v[2]: (k, v) for k, v in loops.items()}
    cycles = cycle_edges(graph, skip)
    if cycles:
        return {"acyclic": False, "cycle_edges": cycles, "max_depth": None, "max_turns": None, "nodes": {n: None for n in nodes}, "by_kind": dict.fromkeys(KINDS)}
    sources: dict[str, dict[str, None]] = defaultdict(dict)
    for _, source, target in arcs(graph, skip):
        sources[target][source] = None
    depth, times, passes = {}, {}, {}
    for at in topological(graph, skip):
        if at in reworks:
            _, (_, subject, _, rounds) = reworks[at]
            depth[at], times[at] = depth[subject] + 2 * (rounds - 1), times[subject] * (rounds - 1)
        elif at == graph["entry"]:
            depth[at], times[at] = 0, 1
        else:
            arrivals = sum(passes[s] for s in sources[at])
            rounds = loops[at][3] if at in loops else 1
            depth[at] = 1 + max((depth[s] for s in sources[at]), default=-1) + 2 * (rounds - 1)
            times[at] = arrivals * rounds if at in loops else 1 if "join" in nodes[at] else arrivals
            passes[at] = arrivals if at in loops else times[at]
        passes.setdefault(at, times[at])
    turns = {n: times[n] * nodes[n]["turn"]["maxAttempts"] for n in nodes}
    by_kind = {k: sum(turns[n] for n in nodes if nodes[n]["kind"] == k) for k in KINDS}
    return {"acyclic": True, "cycle_edges": [], "max_depth": max(depth.values()), "max_turns": sum(turns.values()), "nodes": {n: {"depth": depth[n], "occurrences": times[n], "turns": turns[n]} for n in nodes}, "by_kind": by_kind}


def display(graph: dict) -> dict:
    """Arrows merged by their ends, fan-outs, joins, depths and nodes that only mark."""
    merged: dict[tuple[str, str], dict] = {}
    for e in graph["edges"]:
        for t in e["to"]:
            arrow = merged.setdefault((e["from"], t), {"outcomes": [], "edges": [], "conditional": False})
            arrow["outcomes"] += [o for o in outcomes_of(e["when"]) if o not in arrow["outcomes"]]
            arrow["edges"].append(e["edgeId"])
            arrow["conditional"] |= not is_unconditional(e["when"])
    if cycle_edges(graph):
        depth = distances(graph)
    else:
        depth = {}
        for at in topological(graph):
            depth[at] = max((depth[s] + 1 for _, s, t in arcs(graph) if t == at), default=0)
    ends = {t["nodeId"] for t in graph["terminals"]}
    marks = []
    for n in graph["nodes"]:
        own = [e for e in graph["edges"] if e["from"] == n["nodeId"]]
        possible = {t for e in own for t in e["to"]}
        sure = [{t for e in own if is_unconditional(e["when"]) and o in outcomes_of(e["when"]) for t in e["to"]} for o in n["outcomes"]["outcomes"]]
        if len(sure) > 1 and possible and n["nodeId"] not in ends and all(s == possible for s in sure):
            marks.append(n["nodeId"])
    return {
        "arrows": [{"from": a, "to": b} | x for (a, b), x in merged.items()], "depth": depth, "marks": marks,
        "fan_out": [{"edge": e["edgeId"], "to": e["to"]} for e in graph["edges"] if len(e["to"]) > 1],
        "joins": {n["nodeId"]: n["join"] for n in graph["nodes"] if "join" in n},
    }


def principals(graphs: list[dict]) -> list[str]:
    """Principals that workers act for, in order of first appearance."""
    return list(dict.fromkeys(n["principal"]["id"] for g in graphs for n in g["nodes"] if n["kind"] in ("code", "model", "agent")))


def to_json(graph: dict) -> str:
    return json.dumps(graph, ensure_ascii=False)
