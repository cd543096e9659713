"""Leases and attempts: what each command to an occurrence does, decided in the order of a unit's commands at a node.

A command has ``unit_id, node_id, queue_id, ord, at_ms, command, principal, actor, token, evidence, retryable, extend_ms``.
Commands are claim, claim_external, heartbeat, prepare, complete, fail and settle; evidence is the digest of a completion
or failure. Attempts are numbered through a unit's turns at a node, so these two are the key and commands to different
keys are independent.

Every command gets a record with its disposition: claimed, reserved, cached, extended, completed, failed, dead (failed
for good), settled; replayed (the same evidence again changes nothing); held (another holds the lease), lease_lost,
closed (nothing left to claim), conflict (other evidence), refused (not this node's kind, principal or bounds).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.folds import folded

WORKERS, EXTERNAL = ("code", "model", "agent"), ("human", "callback")
COMMAND = ("unit_id", "node_id", "queue_id", "ord", "at_ms", "command", "principal", "actor", "token", "evidence", "retryable", "extend_ms")
DECISION = "unit_id string, node_id string, queue_id string, ord bigint, command string, disposition string, attempt_number bigint, attempt_index int, expires_ms bigint"


@dataclass
class Lease:
    token: str
    expires: int
    beat: int
    external: tuple[str | None, str | None] | None = None  # actor and evidence of an external claim


@dataclass
class Occurrence:
    lease: Lease | None = None
    attempt: tuple[int, int] | None = None  # number and index of the latest
    completion: str | None = None  # evidence of the latest attempt
    failure: str | None = None
    settled: tuple[str | None, str | None] | None = None  # actor and evidence
    dead: bool = False

    def holds(self, token: str | None, at: int) -> bool:
        return self.lease is not None and at < self.lease.expires and self.lease.token == token


@dataclass
class Turns:
    """A unit's turns at one node."""

    node: dict | None
    numbered: int = 0
    occurrences: dict[str, Occurrence] = field(default_factory=dict)

    def dump(self) -> str:
        """The state as JSON, without the node."""
        return json.dumps([self.numbered, {q: asdict(o) for q, o in self.occurrences.items()}], separators=(",", ":"))

    @classmethod
    def load(cls, node: dict | None, text: str) -> Turns:
        numbered, held = json.loads(text)
        pair = lambda x: x if x is None else tuple(x)

        def occurrence(o: dict) -> Occurrence:
            lease = Lease(**(o["lease"] | {"external": pair(o["lease"]["external"])})) if o["lease"] else None
            return Occurrence(lease, pair(o["attempt"]), o["completion"], o["failure"], pair(o["settled"]), o["dead"])

        return cls(node, numbered, {q: occurrence(o) for q, o in held.items()})

    def decide(self, c: dict) -> dict:
        """The record of a command."""
        o = self.occurrences.setdefault(c["queue_id"], Occurrence())
        rule = getattr(self, f"_{c['command']}", None) if c["command"] in RULES else None
        if rule is None or self.node is None or (c["principal"] is not None and c["principal"] != self.node["principal"]["id"]):
            word = "refused"
        else:
            word = rule(o, c)
        number, index = o.attempt or (None, None)
        return {k: c[k] for k in ("unit_id", "node_id", "queue_id", "ord", "command")} | {"disposition": word, "attempt_number": number, "attempt_index": index, "expires_ms": o.lease.expires if o.lease else None}

    def _claim(self, o: Occurrence, c: dict) -> str:
        if self.node["kind"] not in WORKERS:
            return "refused"
        if o.settled or o.dead:
            return "closed"
        return self._lease(o, c, None)

    def _claim_external(self, o: Occurrence, c: dict) -> str:
        who = (c["actor"], c["evidence"])
        if self.node["kind"] not in EXTERNAL or None in who:
            return "refused"
        if o.settled:
            return "settled" if o.settled == who else "conflict"
        if o.lease and c["at_ms"] < o.lease.expires and o.lease.external == who:
            return "claimed"
        return "closed" if o.dead else self._lease(o, c, who)

    def _lease(self, o: Occurrence, c: dict, external: tuple | None) -> str:
        if o.lease and c["at_ms"] < o.lease.expires:
            return "held"
        o.lease = Lease(c["token"], c["at_ms"] + self.node["turn"]["leaseMs"], c["at_ms"], external)
        return "claimed"

    def _heartbeat(self, o: Occurrence, c: dict) -> str:
        if not o.holds(c["token"], c["at_ms"]) or o.lease.external:
            return "lease_lost"
        if not 1 <= (c["extend_ms"] or 0) <= self.node["turn"]["leaseMs"] or c["at_ms"] < o.lease.beat:
            return "refused"
        o.lease.beat, o.lease.expires = c["at_ms"], c["at_ms"] + c["extend_ms"]
        return "extended"

    def _prepare(self, o: Occurrence, c: dict) -> str:
        if not o.holds(c["token"], c["at_ms"]):
            return "lease_lost"
        if o.attempt and o.failure is None:
            return "reserved" if o.completion is None else "cached"
        self.numbered += 1
        o.attempt, o.completion, o.failure = (self.numbered, o.attempt[1] + 1 if o.attempt else 1), None, None
        return "reserved"

    def _complete(self, o: Occurrence, c: dict) -> str:
        if self.node["kind"] not in WORKERS:
            return "refused"
        if o.completion is not None:
            return "replayed" if o.completion == c["evidence"] else "conflict"
        if o.attempt is None or o.failure is not None or c["evidence"] is None:
            return "conflict"
        if not o.holds(c["token"], c["at_ms"]):
            return "lease_lost"
        o.completion = c["evidence"]
        return "completed"

    def _fail(self, o: Occurrence, c: dict) -> str:
        if self.node["kind"] not in WORKERS:
            return "refused"
        if o.failure is not None:
            return "replayed" if o.failure == c["evidence"] else "conflict"
        if o.attempt is None or o.completion is not None or c["evidence"] is None:
            return "conflict"
        if not o.holds(c["token"], c["at_ms"]):
            return "lease_lost"
        o.failure = c["evidence"]
        o.dead = c["retryable"] is False or o.attempt[1] >= self.node["turn"]["maxAttempts"]
        if o.dead:
            o.lease = None
        return "dead" if o.dead else "failed"

    def _settle(self, o: Occurrence, c: dict) -> str:
        who = (c["actor"], c["evidence"])
        if o.settled:
            return "replayed" if o.settled == who else "conflict"
        if o.attempt is None or o.failure is not None:
            return "conflict"
        if not o.holds(c["token"], c["at_ms"]):
            return "lease_lost"
        if o.lease.external != who if self.node["kind"] in EXTERNAL else (c["actor"] is not None or o.completion is None or o.completion != c["evidence"]):
            return "conflict"
        o.settled, o.lease = who, None
        return "settled"


RULES = ("claim", "claim_external", "heartbeat", "prepare", "complete", "fail", "settle")


def decisions(commands: DataFrame, graph: dict) -> DataFrame:
    """The record of every command. Null ids are a key of their own; the lease of a record is the one after it."""
    nodes = {n["nodeId"]: n for n in graph["nodes"]}

    def fold(key: tuple, own: Iterable[dict]) -> Iterator[dict]:
        turns = Turns(nodes.get(key[1]))
        return (turns.decide(c) for c in own)

    return folded(commands, ("unit_id", "node_id"), COMMAND, DECISION, lambda: fold)


def inspected(open_: DataFrame, decided: DataFrame, nodes: list[dict]) -> DataFrame:
    """``unit_id, queue_id, node_id, state`` of occurrences that are completed from outside (people and callbacks): settled, dead, claimed or waiting, by
    the last decision on each that changed anything."""
    outside = [n["nodeId"] for n in nodes if n["kind"] in EXTERNAL]
    state = F.when(F.col("disposition") == "settled", "settled").when(F.col("disposition") == "dead", "dead").when(F.col("disposition").isin("claimed", "reserved", "cached"), "claimed")
    last = decided.withColumn("state", state).where("state is not null").groupBy("unit_id", "queue_id").agg(F.max_by("state", "ord").alias("state"))
    rows = open_.where(F.col("node_id").isin(outside)).select("unit_id", "queue_id", "node_id")
    return rows.join(last, ["unit_id", "queue_id"], "left").withColumn("state", F.coalesce("state", F.lit("waiting")))
