"""What one unit's journey comes to, from its records as the kernel makes them: the same rows as the set forms in ``paths`` and
``joins`` make of tables of journeys. ``replay.projected`` runs these in the task that replays the unit, so its records meet once."""

from __future__ import annotations

from collections import Counter

from pathloom.operators.paths import TURNS


def _sound(records: list[dict]) -> list[dict]:
    return [r for r in records if r["kind"] != "turn_rejected"]


def number(queue_id: str) -> int:
    """The number of an occurrence in its unit."""
    return int(queue_id.rsplit("/", 1)[1])


def kinds(records: list[dict]) -> dict:
    """The kinds of the records in order, and how many turns were refused."""
    sound = _sound(records)
    return {"kinds": " ".join(r["kind"] for r in sound), "refused": len(records) - len(sound)}


def occurrences(records: list[dict]) -> list[dict]:
    """Each occurrence that the journey queues, in order: see ``paths.occurrences``."""
    found: dict[str, dict] = {}
    for r in _sound(records):
        if r["kind"] in TURNS:  # the kernel takes turns on what is queued only
            o, settled = found[r["queue_id"]], r["kind"] == "turn_settled"
            o["attempts"] += 1
            o["failures"] += not settled
            if settled:
                o["state"], o["outcome"] = "settled", r["outcome"]
            elif r["terminal"] and o["state"] == "open":
                o["state"] = "dead"
            if r["error_code"] is not None:
                o["error_code"] = r["error_code"]
        for e in r["effects"]:
            if e["kind"] in ("queue_enqueued", "join_queued"):
                found[e["queue_id"]] = {
                    "queue_id": e["queue_id"], "number": number(e["queue_id"]), "node_id": e["node_id"], "enqueue_sequence": e["enqueue_sequence"], "queued_by": r["sequence"], "state": "open",
                    "attempts": 0, "failures": 0, "outcome": None, "error_code": None,
                }
    return list(found.values())


def node_states(found: list[dict]) -> list[dict]:
    """Each node from the unit's ``occurrences``: the state of the latest, and their number."""
    nodes: dict[str, dict] = {}
    for o in sorted(found, key=lambda o: o["enqueue_sequence"]):
        state = o["state"] if o["state"] != "open" else "failed" if o["failures"] else "pending"
        nodes[o["node_id"]] = {"node_id": o["node_id"], "state": state, "occurrences": nodes.get(o["node_id"], {}).get("occurrences", 0) + 1}
    return list(nodes.values())


def summary(found: list[dict]) -> dict:
    """The unit from its ``occurrences``: numbers of the open ones in order, whether it is concluded, and turns."""
    opened = [str(o["number"]) for o in sorted(found, key=lambda o: o["enqueue_sequence"]) if o["state"] == "open"]
    return {"open_numbers": ",".join(opened), "concluded": not opened, "dead": sum(o["state"] == "dead" for o in found), "turns": sum(o["attempts"] for o in found), "failures": sum(o["failures"] for o in found)}


def join_states(records: list[dict]) -> list[dict]:
    """The unit's joins as its routing effects tell of them: see ``joins.states``."""
    found: dict[str, dict] = {}
    for e in (e for r in _sound(records) for e in r["effects"]):
        if e["kind"] not in ("join_offer", "join_impossible", "join_queued", "join_unsatisfiable"):
            continue
        j = found.setdefault(e["node_id"], {"node_id": e["node_id"], "status": "pending", "offered": [], "impossible": [], "late_offers": 0, "number": 0, "selected": None})
        if e["kind"] == "join_queued":
            j |= {"status": "queued", "number": number(e["queue_id"]), "selected": e["selected_edge_id"]}
        elif e["kind"] == "join_unsatisfiable":
            j["status"] = "queued" if j["status"] == "queued" else "unsatisfiable"
        elif e["kind"] == "join_impossible":
            j["impossible"] += e["edge_ids"][:1] if e["disposition"] == "resolved" else []
        elif e["disposition"] == "accepted":
            j["offered"] += e["edge_ids"][:1]
        else:
            j["late_offers"] += 1
    return list(found.values())


def edge_counts(records: list[dict]) -> list[dict]:
    """How often each edge was taken: ordinary targets and accepted offers."""
    taken = Counter(x for r in records for e in r["effects"] if e["kind"] == "queue_enqueued" or (e["kind"] == "join_offer" and e["disposition"] == "accepted") for x in e["edge_ids"])
    return [{"edge_id": k, "taken": n} for k, n in taken.items()]


def goal_closures(found: list[dict], joined: list[dict], manifest: dict) -> list[dict]:
    """The unit's goals from its ``occurrences`` and ``join_states``: see ``paths.goal_closures``."""
    lost = [{"node_id": j["node_id"], "state": "settled", "attempts": 0, "outcome": "join_unsatisfiable"} for j in joined if j["status"] == "unsatisfiable"]
    rows = []
    for g in manifest["goals"]:
        own = [o for o in (*found, *lost) if o["node_id"] in g["members"]]
        ends = {(r["nodeId"], r["outcome"]): f"{r['nodeId']}:{r['outcome']}/{r['kind']}" for r in g["resolutions"]}
        closing = [ends[k] for o in own if o["state"] == "settled" and (k := (o["node_id"], o["outcome"])) in ends]
        opened, dead = ({o["node_id"] for o in own if o["state"] == state} for state in ("open", "dead"))
        status = "closed" if len(closing) == 1 else "ambiguous" if closing else "unentered" if not own else "dead" if dead and not opened else "open"
        rows.append({
            "goal_id": g["goalId"], "status": status, "resolution": closing[0] if len(closing) == 1 else None, "open_members": ",".join(sorted(opened)), "dead_members": ",".join(sorted(dead)),
            "turns": sum(o["attempts"] for o in own),
        })
    return rows
