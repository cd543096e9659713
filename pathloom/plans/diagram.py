"""Diagrams of graphs as data for a viewer: nodes and arrows in a presentation's words, and what the words leave out.

A presentation has a title; nodes: id to words (name, summary, question); and optionally arrows: ``from->to`` to groups of
outcomes, each drawn as an arrow; sinks: id, name and the ends (node, outcome) that they claim; waits: a sink's id to
the human nodes that wait there. A terminal that no sink claims gets one of its own.
"""

from __future__ import annotations

from collections import Counter

from pathloom.plans import graphs


class DiagramError(ValueError):
    """Words that don't fit the graph."""


def _ends(words: dict) -> list[tuple[str, str]]:
    return [tuple(e) for s in words.get("sinks", []) for e in s["ends"]]


def _unclaimed(graph: dict, words: dict) -> list[tuple[str, str]]:
    claimed = set(_ends(words))
    return [(t["nodeId"], t["outcome"]) for t in graph["terminals"] if (t["nodeId"], t["outcome"]) not in claimed]


def _misfits(graph: dict, words: dict) -> list[str]:
    kinds = {n["nodeId"]: n["kind"] for n in graph["nodes"]}
    found = [f"node without words {n}" for n in kinds if n not in words["nodes"]] + [f"words for unknown node {n}" for n in words["nodes"] if n not in kinds]
    arrows = {f"{a['from']}->{a['to']}": a["outcomes"] for a in graphs.display(graph)["arrows"]}
    for name, groups in words.get("arrows", {}).items():
        if name not in arrows:
            found.append(f"words for unknown arrow {name}")
        elif sorted(o for g in groups for o in g) != sorted(arrows[name]):
            found.append(f"outcomes of {name} aren't each in one group")
    terminals = {(t["nodeId"], t["outcome"]) for t in graph["terminals"]}
    sinks = Counter(s["id"] for s in words.get("sinks", []))
    found += [f"sink {s} twice" for s, k in sinks.items() if k > 1]
    for (node, outcome), k in Counter(_ends(words)).items():
        if (node, outcome) not in terminals:
            found.append(f"unknown terminal {node}:{outcome}")
        if k > 1:
            found.append(f"{node}:{outcome} is claimed twice")
    for sink, waiting in words.get("waits", {}).items():
        if sink not in sinks:
            found.append(f"waits of unknown sink {sink}")
        found += [f"sink {sink} waits for {n}, which is no person" for n in waiting if kinds.get(n) != "human"]
    return found


def faults(graph: dict, words: dict) -> list[str]:
    """What keeps the words from covering the graph; unclaimed terminals come last and can be drawn all the same."""
    return _misfits(graph, words) + [f"unclaimed terminal {n}:{o}" for n, o in _unclaimed(graph, words)]


def build(graph: dict, words: dict) -> dict:
    """Nodes with their depth, join badge and marks; edges of type outcome, join (into a barrier) and exit (into a sink)."""
    if wrong := _misfits(graph, words):
        raise DiagramError("; ".join(wrong))
    shown, names = graphs.display(graph), {n: w["name"] for n, w in words["nodes"].items()}
    nodes = []
    for n in graph["nodes"]:
        x, join = n["nodeId"], n.get("join")
        badge = None if not join else "all" if join["require"] == "all" else f"{join['require']['nOf']} of {len(join['inbound'])}"
        nodes.append({"id": x, "type": n["kind"], "depth": shown["depth"].get(x, 0) + 1, "badge": badge, "marks": x in shown["marks"], "outcomes": n["outcomes"]["outcomes"], "ref": f"{n['ref']['id']}@{n['ref']['version']}", **words["nodes"][x]})
    edges, used = [], Counter()

    def draw(source: str, target: str, kind: str, outcomes: list[str], conditional: bool = False) -> None:
        name = f"{source}->{target}:{outcomes[0] if outcomes else 'waits'}"
        used[name] += 1
        edges.append({"id": name if used[name] == 1 else f"{name}#{used[name]}", "from": source, "to": target, "type": kind, "label": " or ".join(outcomes) or "waits for a person", "conditional": conditional})

    inbound = {e for j in shown["joins"].values() for e in j["inbound"]}
    for a in shown["arrows"]:
        kind = "join" if a["to"] in shown["joins"] and inbound & set(a["edges"]) else "outcome"
        for group in words.get("arrows", {}).get(f"{a['from']}->{a['to']}", [a["outcomes"]]):
            draw(a["from"], a["to"], kind, list(group), a["conditional"])
    own = [{"id": f"{n}:{o}", "name": f"{names[n]}: {o}", "ends": [(n, o)], "unclaimed": True} for n, o in _unclaimed(graph, words)]
    for s in [*words.get("sinks", []), *own]:
        at = f"sink:{s['id']}"
        nodes.append({"id": at, "type": "sink", "name": s["name"], "unclaimed": s.get("unclaimed", False)})
        for n, o in s["ends"]:
            draw(n, at, "exit", [o])
        for n in words.get("waits", {}).get(s["id"], []):
            if n not in {e[0] for e in s["ends"]}:
                draw(n, at, "exit", [])
    return {"title": words["title"], "graph": {"id": graph["graphId"], "version": graph["version"], "digest": graph.get("digest")}, "nodes": nodes, "edges": edges}


#: What a kind of node or arrow means, in the order of a legend.
LEGEND = (("code", "code"), ("model", "a model's judgement"), ("agent", "an agent's work"), ("human", "a person's decision"), ("callback", "an event from outside"), ("sink", "an end"), ("join", "waits for others"), ("exit", "leads to an end"), ("flow", "leads on"))


def legend(diagram: dict) -> list[tuple[str, str]]:
    """What the kinds of nodes and arrows that a diagram has mean."""
    used = {n["type"] for n in diagram["nodes"]} | {e["type"] for e in diagram["edges"]}
    return [(kind, words) for kind, words in LEGEND if kind in used]
