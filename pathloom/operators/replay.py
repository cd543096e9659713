"""Replay: from settled turns to journeys, unit by unit.

Routing, barrier joins and liveness depend on the order of a unit's turns, and the marking of impossible
legs is a fixpoint, so one kernel folds a unit. It needs only that unit's turns and its graph, so units are
independent: ``replay`` groups by unit, the streaming form keeps a ``Unit`` in keyed state.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pathloom.functions import canon
from pathloom.operators import scripts
from pathloom.operators.folds import spread
from pathloom.operators.routing import matches
from pathloom.plans.graphs import JOIN_INPUT_CONTRACT, UNSATISFIABLE, UNSATISFIABLE_CONTRACT

TERMINAL_FAILURE = "engine_terminal_failure"
EFFECT = "struct<kind:string,node_id:string,queue_id:string,edge_ids:array<string>,disposition:string,enqueue_sequence:bigint,selected_edge_id:string,digest:string>"
JOURNEY = f"unit_id string, sequence bigint, kind string, node_id string, queue_id string, outcome string, error_code string, terminal boolean, attempt_index int, attempt_number bigint, effects array<{EFFECT}>"
PROGRESS = "unit_id string, node_id string, status string, edge_id string, edge_ord int, need bigint, state string"
#: The time of a turn that tells none.
NO_TIME = "1970-01-01T00:00:00.000Z"


class ReplayError(ValueError):
    """A turn that the unit's state doesn't allow."""


@dataclass
class Join:
    """Progress of one join: each inbound edge is pending, offered or impossible."""

    inbound: list[str]
    need: int
    state: dict[str, str]
    offers: dict[str, dict] = field(default_factory=dict)
    impossible: dict[str, dict] = field(default_factory=dict)
    status: str = "pending"

    def count(self, state: str) -> int:
        return sum(s == state for s in self.state.values())


class Plan:
    """A graph as the kernel reads it, made once for all its units."""

    def __init__(self, graph: dict) -> None:
        self.graph = graph
        body = {k: v for k, v in graph.items() if k != "digest"}
        self.ref = {"id": graph["graphId"], "version": graph["version"], "digest": graph.get("digest") or canon.digest(body)}
        self.nodes = {n["nodeId"]: n for n in graph["nodes"]}
        self.out: dict[str, list[dict]] = {n: [] for n in self.nodes}
        for e in graph["edges"]:
            self.out[e["from"]].append(e)
        self.source = {e["edgeId"]: e["from"] for e in graph["edges"]}
        self.joins: dict[str, tuple[list[str], int]] = {}
        for n in graph["nodes"]:
            if "join" in n:
                edges, require = n["join"]["inbound"], n["join"]["require"]
                self.joins[n["nodeId"]] = (edges, len(edges) if require == "all" else require["nOf"])
        # what each node leads to if no join or leg stands in the way
        self.reach = {n: self._reached(n) for n in self.nodes}

    def _reached(self, start: str) -> frozenset[str]:
        seen, todo = {start}, [start]
        while todo:
            for e in self.out[todo.pop()]:
                new = set(e["to"]) - seen
                seen |= new
                todo += new
        return frozenset(seen)


class Unit:
    """A unit's state, and the records that its turns make."""

    def __init__(self, unit_id: str, plan: Plan, seed: dict | None = None, seals=canon) -> None:
        self.seals = seals  # what makes digests and artifacts
        self.unit_id, self.plan, self.graph, self.sequence = unit_id, plan, plan.graph, 0
        self.nodes, self.out, self.source = plan.nodes, plan.out, plan.source
        self.joins = {n: Join(edges, need, dict.fromkeys(edges, "pending")) for n, (edges, need) in plan.joins.items()}
        self.open: dict[str, tuple[str, dict | None]] = {}  # queue id: node, input; in order of queueing
        self.failures: dict[str, int] = defaultdict(int)
        self.attempts: dict[str, int] = defaultdict(int)
        self.queued = 0
        self.seed = seed
        self.cause: dict = {}  # what the effects being made come from: evidence, queue_id, at

    def dump(self) -> str:
        """The state as JSON, without the graph; a concluded unit is only its counters."""
        joins = {n: [j.status, j.state, j.offers, j.impossible] for n, j in self.joins.items()} if self.open else None
        counters = [self.sequence, self.queued, dict(self.attempts) if self.open else {}, {q: n for q, n in self.failures.items() if q in self.open}]
        return json.dumps([counters, self.open, joins], separators=(",", ":"))

    @classmethod
    def load(cls, unit_id: str, plan: Plan, text: str) -> Unit:
        unit = cls(unit_id, plan)
        (unit.sequence, unit.queued, attempts, failures), held, joins = json.loads(text)
        unit.attempts.update(attempts)
        unit.failures.update(failures)
        unit.open = {q: (n, artifact) for q, (n, artifact) in held.items()}
        for n, (status, state, offers, impossible) in (joins or {}).items():
            j = unit.joins[n]
            j.status, j.state, j.offers, j.impossible = status, state, offers, impossible
        return unit

    def admit(self) -> list[dict]:
        effects: list[dict] = []
        self._queue(self.graph["entry"], [], self.seed, effects)
        return self._numbered([self._record("unit_admitted", self.graph["entry"], effects[0]["queue_id"], effects=effects)])

    def refuse(self, turn: dict) -> dict:
        """The record of a turn that the state refuses: it has no place in the sequence and changes nothing."""
        return self._record("turn_rejected", turn["node_id"], outcome=turn.get("outcome"), error_code=turn.get("error_code"))

    def turn(
        self, node_id: str, outcome: str | None = None, output: dict | None = None, error_code: str | None = None, retryable: bool = True, queue_id: str | None = None,
        evidence: str | None = None, at: str | None = None,
    ) -> list[dict]:
        """The records of one turn on the node's oldest open occurrence: settled, or failed when it has an error. ``output`` is an
        artifact; ``evidence`` is the digest of the turn's settlement or failure (made from the turn where it is unknown)."""
        queue_id = queue_id or next((q for q, (n, _) in self.open.items() if n == node_id), None)
        if queue_id not in self.open or self.open[queue_id][0] != node_id:
            raise ReplayError(f"{self.unit_id}: {node_id} has no open occurrence")
        node = self.nodes[node_id]
        if error_code is None and (outcome not in node["outcomes"]["outcomes"] or outcome == UNSATISFIABLE):
            raise ReplayError(f"{self.unit_id}: {node_id} has no outcome {outcome!r}")
        self.attempts[node_id] += 1
        index = self.failures[queue_id] + 1
        numbers = {"attempt_index": index, "attempt_number": self.attempts[node_id]}
        self.cause = {"evidence": evidence, "queue_id": queue_id, "at": at or NO_TIME, "of": {"unitId": self.unit_id, "queueId": queue_id, "attemptNumber": numbers["attempt_number"], "outcome": outcome, "errorCode": error_code}}
        if error_code is not None:
            self.failures[queue_id] += 1
            terminal = not retryable or index >= node["turn"]["maxAttempts"]
            effects: list[dict] = []
            extra: list[dict] = []
            if terminal:
                carried = self.open.pop(queue_id)[1]
                extra = self._settle(node_id, TERMINAL_FAILURE, None, carried, effects)
            return self._numbered([self._record("turn_failed", node_id, queue_id, None, error_code, terminal, effects, **numbers), *extra])
        carried = self.open.pop(queue_id)[1]
        effects = []
        extra = self._settle(node_id, outcome, output, output or carried, effects)
        return self._numbered([self._record("turn_settled", node_id, queue_id, outcome, None, None, effects, **numbers), *extra])

    def _record(self, kind, node_id, queue_id=None, outcome=None, error_code=None, terminal=None, effects=(), **numbers) -> dict:
        return {"unit_id": self.unit_id, "sequence": None, "kind": kind, "node_id": node_id, "queue_id": queue_id, "outcome": outcome, "error_code": error_code, "terminal": terminal, "attempt_index": None, "attempt_number": None, "effects": list(effects)} | numbers

    def _numbered(self, records: list[dict]) -> list[dict]:
        for r in records:
            self.sequence += 1
            r["sequence"] = self.sequence
        return records

    def _evidence(self) -> str:
        if self.cause["evidence"] is None:
            self.cause["evidence"] = self.seals.digest(self.cause["of"])
        return self.cause["evidence"]

    @staticmethod
    def _effect(kind: str, node_id: str, edge_ids: list[str], queue_id=None, disposition=None, enqueue_sequence=None, selected=None, digest=None) -> dict:
        return {"kind": kind, "node_id": node_id, "queue_id": queue_id, "edge_ids": edge_ids, "disposition": disposition, "enqueue_sequence": enqueue_sequence, "selected_edge_id": selected, "digest": digest}

    def _queue(self, node_id: str, edges: list[str], artifact: dict | None, effects: list[dict], kind: str = "queue_enqueued", selected: str | None = None) -> None:
        self.queued += 1
        queue_id = f"{self.unit_id}/{self.queued}"
        self.open[queue_id] = (node_id, artifact)
        effects.append(self._effect(kind, node_id, edges, queue_id, None, self.queued, selected, artifact and artifact.get("digest")))

    def _settle(self, node_id: str, outcome: str, output: dict | None, carried: dict | None, effects: list[dict]) -> list[dict]:
        """Routes an outcome, then marks legs that nothing can reach; returns the records of synthetic outcomes."""
        self._route(node_id, outcome, output, carried, effects)
        return self._liveness(effects)

    def _route(self, node_id: str, outcome: str, output: dict | None, carried: dict | None, effects: list[dict]) -> None:
        matched = [e for e in self.out[node_id] if matches(e["when"], outcome, output)]
        plain: dict[str, list[str]] = {}
        for e in matched:
            for target in e["to"]:
                if target not in self.joins:
                    plain.setdefault(target, []).append(e["edgeId"])
        for target, edges in plain.items():
            self._queue(target, edges, carried, effects)
        taken = {e["edgeId"] for e in matched}
        for name, join in self.joins.items():
            offered = [x for x in join.inbound if x in taken and any(e["edgeId"] == x and name in e["to"] for e in matched)]
            for edge in offered:
                if join.status != "pending":
                    word = "join_already_resolved_noop"
                elif join.state[edge] != "pending":
                    word = "edge_already_resolved_noop"
                else:
                    word = "accepted"
                    join.state[edge] = "offered"
                    join.offers[edge] = {"edgeId": edge, "sourceNodeId": node_id, "sourceEvidenceDigest": self._evidence(), "offeredAt": self.cause["at"], "artifact": carried} | ({"sourceQueueId": q} if (q := self.cause["queue_id"]) else {})
                effects.append(self._effect("join_offer", name, [edge], disposition=word))
            if offered and join.status == "pending" and join.count("offered") >= join.need:
                accepted = [x for x in join.inbound if join.state[x] == "offered"]
                join.status = "queued"
                artifact = join.offers[accepted[0]]["artifact"]
                if self.nodes[name]["join"].get("compose") == "envelope":
                    artifact = join_input(self.plan, self.unit_id, name, [join.offers[x] for x in accepted], self.seals)
                self._queue(name, accepted, artifact, effects, "join_queued", accepted[0])

    def _reaches(self, source: str) -> bool:
        """Whether an open occurrence can lead to a turn on ``source``. Resolved joins and legs stop the way."""
        starts = {n for n, _ in self.open.values()}
        if not any(source in self.plan.reach[n] for n in starts):
            return False
        if all(j.status == "pending" and set(j.state.values()) <= {"pending"} for j in self.joins.values()):
            return True
        todo = deque(starts)
        seen = set(todo)
        while todo:
            at = todo.popleft()
            if at == source:
                return True
            for e in self.out[at]:
                for target in e["to"]:
                    join = self.joins.get(target)
                    if target not in seen and not (join and (join.status != "pending" or join.state.get(e["edgeId"]) != "pending")):
                        seen.add(target)
                        todo.append(target)
        return False

    def _liveness(self, effects: list[dict]) -> list[dict]:
        records: list[dict] = []
        root = dict(self.cause)
        while found := next(((n, j, x) for n, j in self.joins.items() if j.status == "pending" for x in j.inbound if j.state[x] == "pending" and not self._reaches(self.source[x])), None):
            name, join, edge = found
            self.cause = root
            evidence, at = self._evidence(), root["at"]
            join.state[edge] = "impossible"
            join.impossible[edge] = {"edgeId": edge, "sourceNodeId": self.source[edge], "causeEvidenceDigest": evidence, "resolvedAt": at, "reason": "source_unreachable"}
            effects.append(self._effect("join_impossible", name, [edge], disposition="resolved"))
            if len(join.inbound) - join.count("impossible") < join.need:
                join.status = "unsatisfiable"
                offers = [join.offers[x] for x in join.inbound if join.state[x] == "offered"]
                legs = [join.impossible[x] for x in join.inbound if join.state[x] == "impossible"]
                payload = {
                    "schemaVersion": UNSATISFIABLE_CONTRACT, "unitId": self.unit_id, "graph": self.plan.ref, "nodeId": name, "require": self.nodes[name]["join"]["require"],
                    "accepted": [o | {"artifact": o["artifact"] and canon.artifact_ref(o["artifact"])} for o in offers], "impossible": legs, "causeEvidenceDigest": evidence, "resolvedAt": at,
                }
                artifact = self.seals.artifact(UNSATISFIABLE_CONTRACT, payload)
                synthetic = self.seals.digest({
                    "unitId": self.unit_id, "graphDigest": self.plan.ref["digest"], "nodeId": name, "outcome": UNSATISFIABLE, "accepted": [o["edgeId"] for o in offers], "impossible": [x["edgeId"] for x in legs],
                    "causeEvidenceDigest": evidence, "resolvedAt": at, "artifactDigest": artifact["digest"],
                })
                effects.append(self._effect("join_unsatisfiable", name, [], digest=synthetic))
                own: list[dict] = []
                self.cause = {"evidence": synthetic, "queue_id": None, "at": at}
                self._route(name, UNSATISFIABLE, artifact, artifact, own)
                records.append(self._record("join_unsatisfiable", name, None, UNSATISFIABLE, effects=own))
        return records


def join_input(plan: Plan, unit_id: str, node_id: str, offers: list[dict], seals=canon) -> dict:
    """The composed input of an envelope join: what was accepted with where it came from, in authored order whatever
    order it came in, so its digest doesn't depend on arrival."""
    node = plan.nodes[node_id]
    edges, need = plan.joins[node_id]
    by_edge = {o["edgeId"]: o for o in offers}
    if len(by_edge) != len(offers) or not need <= len(offers) <= len(edges) or not set(by_edge) <= set(edges):
        raise ReplayError(f"{unit_id}: {node_id} has other offers than its join asks for")
    accepted = []
    for edge in edges:
        if edge not in by_edge:
            continue
        offer, source = by_edge[edge], plan.nodes[plan.source[edge]]
        if offer["sourceNodeId"] != plan.source[edge]:
            raise ReplayError(f"{unit_id}: {edge} doesn't come from {offer['sourceNodeId']}")
        known = {k: offer[k] for k in ("edgeId", "sourceNodeId", "sourceQueueId", "sourceEvidenceDigest", "offeredAt", "artifact") if k in offer}
        accepted.append(known | {"sourceNodeRef": source["ref"]} | ({"sourceConfiguration": source["configuration"]} if "configuration" in source else {}))
    payload = {"schemaVersion": JOIN_INPUT_CONTRACT, "unitId": unit_id, "graph": plan.ref, "nodeId": node_id, "nodeRef": node["ref"], "require": node["join"]["require"], "accepted": accepted}
    return seals.artifact(JOIN_INPUT_CONTRACT, payload | ({"configuration": node["configuration"]} if "configuration" in node else {}))


def check_join_input(plan: Plan, artifact: dict) -> dict:
    """A composed input whose payload is what its own offers make, in order; anything else raises."""
    p = artifact["payload"]
    made = join_input(plan, p["unitId"], p["nodeId"], [{k: v for k, v in o.items() if k not in ("sourceNodeRef", "sourceConfiguration")} for o in p["accepted"]])
    if artifact["contractId"] != JOIN_INPUT_CONTRACT or made["digest"] != artifact["digest"] or canon.digest(p) != artifact["digest"]:
        raise ReplayError("a join's input has another identity, provenance or order")
    return artifact


def take(unit: Unit, turn: dict) -> list[dict]:
    """The records of a turn's row; a turn that the state refuses is a record by itself and stops nothing."""
    node, output = unit.nodes.get(turn["node_id"]), None
    try:
        if turn.get("output_json") and node:
            output = unit.seals.artifact(node.get("outputs", {}).get(turn.get("outcome"), node["input"]), json.loads(turn["output_json"]))
        return unit.turn(turn["node_id"], turn.get("outcome"), output, turn.get("error_code"), turn.get("retryable") is not False, None, turn.get("evidence"), turn.get("at"))
    except ValueError:  # what isn't JSON, or what the unit's state doesn't allow
        return [unit.refuse(turn)]


class Journey:
    """The fold of one unit into the records of its journey."""

    def __init__(self, unit_id: str, plan: Plan, seals=canon) -> None:
        self.unit = Unit(unit_id, plan, seals=seals)

    def take(self, turn: dict | None) -> list[dict]:
        """The records of a turn: node_id and outcome, output_json, error_code, retryable, and if known evidence and at. None is the
        unit's admission."""
        return self.unit.admit() if turn is None else take(self.unit, turn)

    def end(self) -> Iterable[dict]:
        return ()


class JoinStates(Journey):
    """The fold of one unit into what its joins have come to after its turns: a row an inbound edge."""

    def take(self, turn: dict | None) -> list[dict]:
        super().take(turn)
        return []

    def end(self) -> Iterable[dict]:
        for name, join in self.unit.joins.items():
            for k, edge in enumerate(join.inbound):
                yield {"unit_id": self.unit.unit_id, "node_id": name, "status": join.status, "edge_id": edge, "edge_ord": k, "need": join.need, "state": join.state[edge]}


class Projection(Journey):
    """The fold of one unit into what ``project`` makes of its journey's records."""

    def __init__(self, unit_id: str, plan: Plan, seals, project: Callable[[list[dict]], Iterable[dict]]) -> None:
        super().__init__(unit_id, plan, seals)
        self.records: list[dict] = []
        self.project = project

    def take(self, turn: dict | None) -> list[dict]:
        self.records += super().take(turn)
        return []

    def end(self) -> Iterable[dict]:
        return [{"unit_id": self.unit.unit_id} | row for row in self.project(self.records)]


def fold(unit_id: str, plan: Plan, turns: Iterable[dict]) -> Iterator[dict]:
    """The journey of one unit, of its ``turns`` in order."""
    unit = Journey(unit_id, plan)
    for t in (None, *turns):
        yield from unit.take(t)


TURN = ("node_id", "outcome", "output_json", "error_code", "retryable", "evidence", "at")


def _folded(turns: DataFrame, graph: dict, work: Callable[..., Journey], schema: str) -> DataFrame:
    """The records of every unit. Units meet by a hash of their names and are folded one after the other as their sorted turns
    stream by."""
    kind = T._parse_datatype_string(schema)
    arrow, marked = to_arrow_schema(kind), scripts.MARK in json.dumps(graph, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(graph)
        return scripts.run(batches, TURN, arrow, lambda unit_id, seals: work(unit_id, plan, seals), marked)

    for name in ("evidence", "at"):
        if name not in turns.columns:
            turns = turns.withColumn(name, F.lit(None).cast("string"))
    return turns.repartition(*spread(turns, 2), "unit_id").sortWithinPartitions("unit_id", "ord").select("unit_id", *TURN).mapInArrow(run, kind)


def replay(turns: DataFrame, graph: dict, digests: bool = True) -> DataFrame:
    """Journeys of ``unit_id, ord, node_id, outcome, output_json, error_code, retryable`` rows over one graph, with ``evidence`` and
    ``at`` where they are known. Turns that a unit's state refuses are records of kind turn_rejected, outside the sequence. Without
    ``digests`` the effects lack these: a kernel's columns aren't pruned by what reads them."""
    return _folded(turns, graph, Journey, JOURNEY if digests else JOURNEY.replace(",digest:string>", ">"))


def join_states(turns: DataFrame, graph: dict) -> DataFrame:
    """``unit_id, node_id, status, edge_id, edge_ord, need, state`` of every join's inbound edges after each unit's turns, from one
    pass of the kernel."""
    return _folded(turns, graph, JoinStates, PROGRESS)


def projected(turns: DataFrame, graph: dict, project: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``unit_id`` and what ``project`` makes of each unit's records (``unit_paths``), in the task that replays the unit: no record
    leaves it. ``project`` reads names of units and occurrences only to tell them apart and to return them, or the number of an
    occurrence; ``schema`` has its members beside ``unit_id``."""
    return _folded(turns, graph, lambda unit_id, plan, seals: Projection(unit_id, plan, seals, project), f"unit_id string, {schema}")
