"""Rewrites of drafts before they are sealed: approvals and reviews as nodes and edges, and yes/no questions."""

from __future__ import annotations

from pathloom.functions import canon
from pathloom.plans.graphs import UNSATISFIABLE, GraphError, outcomes_of, seal

REVIEW_REQUEST, REWORK, REJECTED = "review-request.v1", "rework.v1", "review-rejected.v1"
MAX_ROUNDS, DEFAULT_ROUNDS = 10, 2


def accepted(outcome: str) -> str:
    return f"accepted:{outcome}"


def reviewed_outcomes(node: dict) -> list[str]:
    return [o for o in node["outcomes"]["outcomes"] if o != UNSATISFIABLE]


def _is_retry(route: object) -> bool:
    return isinstance(route, dict) and route.get("retry") is True


def rounds(review: dict) -> int | None:
    """How often a review can happen; None: as often as it is rejected."""
    return None if _is_retry(review["onReject"]) else review.get("maxRounds", DEFAULT_ROUNDS)


def _actor(by: dict) -> dict:
    return {"kind": by["kind"], "principal": by["principal"]} | ({"binding": by["binding"]} if "binding" in by else {})


def expand(draft: dict) -> dict:
    """The draft with each node's approval before it and review after it written out. Without such settings, and
    when they are written out already, it is the draft itself.

    An approval takes the node's place for all that leads to it. A review takes over what the node's outcomes led to, as
    accepted outcomes, and sends rejected work to a rework node until its rounds are used up.
    """
    nodes = {n["nodeId"]: n for n in draft["nodes"]}
    gated = {x for x in nodes if "approval" in nodes[x]}
    reviewed = {x for x in nodes if "review" in nodes[x]}
    made = {f"{x}::approval" for x in gated} | {f"{x}::review" for x in reviewed}
    if made and made <= set(nodes):
        return rederived(draft)
    reserved = made | {f"{x}::rework" for x in reviewed}
    if reserved & set(nodes):
        raise GraphError(f"reserved node ids: {sorted(reserved & set(nodes))}")
    front = lambda x: f"{x}::approval" if x in gated else x

    def route(owner: str, to: object) -> str | None:
        """The node that a route leads to, None where it ends."""
        target = to.get("to") if isinstance(to, dict) else None
        if target is None:
            return None
        if target == owner or target in reserved or target not in nodes:
            raise GraphError(f"{owner}: no route to {target!r}")
        return front(target)

    edges, terminals = [], []
    for e in draft["edges"]:
        source, when, names = e["from"], e["when"], outcomes_of(e["when"])
        if source in reviewed and names != [UNSATISFIABLE]:
            if UNSATISFIABLE in names:
                raise GraphError(f"{e['edgeId']} mixes {UNSATISFIABLE} with reviewed outcomes")
            source = f"{source}::review"
            when = {"anyOf": [accepted(o) for o in names]} if "anyOf" in when else when | {"outcome": accepted(when["outcome"])}
        edges.append({"edgeId": e["edgeId"], "from": source, "when": when, "to": [front(t) for t in e["to"]]})
    for t in draft["terminals"]:
        moved = t["nodeId"] in reviewed and t["outcome"] != UNSATISFIABLE
        terminals.append({"nodeId": f"{t['nodeId']}::review", "outcome": accepted(t["outcome"])} if moved else t)

    out: list[dict] = []

    def leave(edge: str, source: str, outcome: str, target: str | None) -> None:
        if target is None:
            terminals.append({"nodeId": source, "outcome": outcome})
        else:
            edges.append({"edgeId": edge, "from": source, "when": {"outcome": outcome}, "to": [target]})

    for x, n in nodes.items():
        version, turn = n["ref"]["version"], n["turn"]
        if x in gated:
            rule, at = n["approval"], f"{x}::approval"
            if _is_retry(rule["onDeny"]) and rule["by"]["kind"] != "human":
                raise GraphError(f"{x}: only people are asked again")
            if "join" in n:
                raise GraphError(f"{x}: a join has no approval")
            out.append({"nodeId": at, "ref": {"id": f"{n['ref']['id']}::approval.{rule['by']['kind']}", "version": version}, **_actor(rule["by"]), "input": n["input"], "outcomes": {"version": version, "outcomes": ["approved", "denied"]}, "outputs": {"approved": n["input"], "denied": n["input"]}, "turn": turn})
            leave(f"{at}.approved", at, "approved", x)
            leave(f"{at}.denied", at, "denied", at if _is_retry(rule["onDeny"]) else route(x, rule["onDeny"]))
        out.append(n)
        if x not in reviewed:
            continue
        rule, at, again = n["review"], f"{x}::review", f"{x}::rework"
        names, most, retry = reviewed_outcomes(n), rounds(n["review"]), _is_retry(n["review"]["onReject"])
        if not names or n["kind"] == "agent" or (retry and "maxRounds" in rule) or not (most is None or 1 <= most <= MAX_ROUNDS):
            raise GraphError(f"{x}: no such review")
        reworks = retry or most >= 2
        outputs = {accepted(o): n["outputs"][o] for o in names if o in n.get("outputs", {})} | ({"rework": REWORK} if reworks and not retry else {}) | {"rejected": REWORK if retry else REJECTED}
        suffix = f"{rule['by']['kind']}.{'retry' if retry else most}"
        words = [*map(accepted, names), *(["rework"] if reworks and not retry else []), "rejected"]
        out.append({"nodeId": at, "ref": {"id": f"{n['ref']['id']}::review.{suffix}", "version": version}, **_actor(rule["by"]), "input": REVIEW_REQUEST, "outcomes": {"version": version, "outcomes": words}, "outputs": outputs, "turn": turn})
        edges.append({"edgeId": f"{at}.in", "from": x, "when": {"anyOf": names}, "to": [at]})
        if reworks:
            kept = {k: n[k] for k in ("binding", "configuration") if k in n}
            out.append({"nodeId": again, "ref": {"id": f"{n['ref']['id']}::rework", "version": version}, "kind": n["kind"], "input": REWORK, "outcomes": {"version": version, "outcomes": names}, "outputs": dict.fromkeys(names, REVIEW_REQUEST), "principal": n["principal"], **kept, "turn": turn})
        if reworks and not retry:
            leave(f"{at}.rework", at, "rework", again)
        leave(f"{at}.rejected", at, "rejected", again if retry else route(x, rule["onReject"]))
        if reworks:
            edges.append({"edgeId": f"{again}.out", "from": again, "when": {"anyOf": names}, "to": [at]})
    return draft | {"entry": front(draft["entry"]), "nodes": out, "edges": edges, "terminals": terminals}


def unexpand(graph: dict) -> dict:
    """The draft that an expanded graph was made from: without the made nodes and what only they need, with what reviews took over back at
    their subjects."""
    nodes = {n["nodeId"]: n for n in graph["nodes"]}
    subject = {f"{x}::{role}": x for x, n in nodes.items() for role in (("approval",) if "approval" in n else ()) + (("review", "rework") if "review" in n else ())}
    own = {f"{m}.{end}" for m in subject for end in ("approved", "denied", "in", "rework", "rejected", "out")}
    back = lambda x: subject.get(x, x)
    plain = lambda o: o.removeprefix("accepted:")
    edges = []
    for e in graph["edges"]:
        if e["edgeId"] in own and e["from"] in {*subject, *subject.values()}:
            continue
        when = e["when"]
        if e["from"] in subject:
            when = {"anyOf": [plain(o) for o in when["anyOf"]]} if "anyOf" in when else when | {"outcome": plain(when["outcome"])}
        edges.append(e | {"from": back(e["from"]), "when": when, "to": [back(t) for t in e["to"]]})
    kept = lambda t: t["nodeId"] not in subject or t["outcome"].startswith("accepted:")
    terminals = [t | {"nodeId": back(t["nodeId"]), "outcome": plain(t["outcome"]) if t["nodeId"] in subject else t["outcome"]} for t in graph["terminals"] if kept(t)]
    return {k: v for k, v in graph.items() if k != "digest"} | {"entry": back(graph["entry"]), "nodes": [n for x, n in nodes.items() if x not in subject], "edges": edges, "terminals": terminals}


def rederived(graph: dict) -> dict:
    """An expanded graph that is the expansion of its own settings; anything else raises."""
    made = expand(unexpand(graph))
    if _parts(made) != _parts(graph):
        raise GraphError("the graph is not the expansion of its own settings")
    return graph


def _parts(graph: dict) -> tuple:
    """A graph's parts, whatever order they stand in."""
    return graph["entry"], *(sorted(map(canon.canonical_json, graph[k])) for k in ("nodes", "edges", "terminals"))


def create(draft: dict) -> dict:
    """A draft expanded, validated and sealed."""
    return seal(expand(draft))


def review_record(kind: str, request: dict, answer: dict, most: int | None) -> dict:
    """What a review's answer makes of its request: ``accepted:<outcome>`` with the reviewed output, the next rework with the
    history so far, or the final rejection. ``answer``: accepted or rejected, with feedback."""
    if [h["round"] for h in request["history"]] != list(range(1, request["round"])):
        raise GraphError("a request of round n has the rounds 1 to n - 1 behind it, in order")
    if answer["outcome"] == "accepted":
        return {"outcome": accepted(request["outcome"]), "output": request["output"]}
    history = [*request["history"], {"round": request["round"], "outcome": request["outcome"], "output": request["output"], "feedback": answer.get("feedback")}]
    if most is None or request["round"] < most:
        return {"outcome": "rejected" if most is None else "rework", "output": {"round": request["round"] + 1, "input": request["input"], "history": history}}
    return {"outcome": "rejected", "output": {"history": history}}


def binary_question(name: str, source: dict, tiers: list[dict], yes: str, no: str, unsure: str | None = None) -> dict:
    """Nodes, edges and terminals of a yes/no question: each tier answers yes, no or unsure, and unsure asks the next; the last
    tier's unsure goes to ``unsure`` or ends. ``source`` holds what all tiers share."""
    if not 1 <= len(tiers) <= 5:
        raise GraphError("a question has one to five tiers")
    ids = [name] + [f"{name}:tier-{k}" for k in range(1, len(tiers))]
    nodes = [source | tier | {"nodeId": i, "outcomes": {"version": tier["ref"]["version"], "outcomes": ["yes", "no", "unsure"]}} for i, tier in zip(ids, tiers, strict=True)]
    edges, ends = [], []
    for k, i in enumerate(ids):
        edges += [{"edgeId": f"{i}.yes", "from": i, "when": {"outcome": "yes"}, "to": [yes]}, {"edgeId": f"{i}.no", "from": i, "when": {"outcome": "no"}, "to": [no]}]
        after = ids[k + 1] if k + 1 < len(ids) else unsure
        if after:
            edges.append({"edgeId": f"{i}.unsure", "from": i, "when": {"outcome": "unsure"}, "to": [after]})
        else:
            ends.append({"nodeId": i, "outcome": "unsure"})
    return {"nodes": nodes, "edges": edges, "terminals": ends}
