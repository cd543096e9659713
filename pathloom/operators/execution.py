"""Turns run by bodies of their node's kind: attempts, identity, receipts that outlive a bad completion, retries, tallies.

A turn has ``unit_id, node_id, queue_id, input_json, attempt_key, graph_digest`` (text each) and ``attempt_index``, the number of failures so far plus
one. A body is a function of the host for a node: code takes the input, a model also its binding and returns one receipt, an agent is a pair
of functions, of submission and of awaiting what was submitted. Turns are independent, so bodies run in Arrow batches wherever the rows are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pathloom.functions import columns
from pathloom.plans.documents import DocumentError, check_receipt
from pathloom.plans.graphs import UNSATISFIABLE
from pathloom.sources.tables import RECEIPT

TURN = ("unit_id", "node_id", "queue_id", "input_json", "attempt_key", "attempt_index")
ATTEMPT = f"unit_id string, node_id string, queue_id string, attempt_key string, attempt_index int, status string, outcome string, output_json string, usage array<{RECEIPT}>, error_code string, error_message string, retryable boolean, terminal boolean"
#: Receipts that a completion may have, by kind: least and most.
RECEIPTS = {"code": (0, 0), "model": (1, 1), "agent": (0, 256)}


class BodyFailure(Exception):
    """A failure with a code of its own, whether it may run again, and the receipts of what was spent before it. Receipts count only for
    the node and attempt that they name."""

    def __init__(self, code: str, retryable: bool = True, message: str = "", receipts: tuple = (), node_id: str | None = None, attempt_key: str | None = None) -> None:
        super().__init__(message or code)
        self.code, self.retryable, self.receipts, self.node_id, self.attempt_key = code, retryable, list(receipts), node_id, attempt_key


class LostTransport(Exception):
    """Nobody knows whether a submission arrived; it is awaited under the same key and never submitted under another."""


@dataclass
class Context:
    """What a body may know of its turn."""

    unit_id: str
    node_id: str
    queue_id: str
    attempt_key: str
    attempt_index: int


@dataclass
class Body:
    """How a node's turns run. ``run``: (input, context) for code, (input, binding, context) for models; agents have ``submit`` (input,
    context) and ``wait`` (context). All return (outcome, output, receipts) but code, which returns (outcome, output)."""

    node: dict
    run: Callable | None = None
    submit: Callable | None = None
    wait: Callable | None = None
    declared: dict[str, str] = field(default_factory=dict)  # failure code: outcome

    def complete(self, given: object, c: Context) -> tuple:
        kind = self.node["kind"]
        if kind == "code":
            return (*self.run(given, c), [])
        if kind == "model":
            return self.run(given, self.node["binding"], c)
        if kind == "agent":
            try:
                self.submit(given, c)
            except LostTransport:
                pass
            return self.wait(c)
        raise BodyFailure("immutable_configuration_rejected", False, f"{c.node_id}: a {kind} turn is completed from outside")


def _sound(receipts: list, body: Body) -> list[dict]:
    least, most = RECEIPTS.get(body.node["kind"], (0, 0))
    for r in receipts:
        check_receipt(r)
    if not least <= len(receipts) <= most:
        raise DocumentError(f"{body.node['nodeId']}: {len(receipts)} receipts where {least} to {most} are due")
    return receipts


def attempt(body: Body | None, turn: dict) -> dict:
    """The record of one attempt. Receipts are checked before the outcome, so what was spent stays on the record of an attempt whose
    completion is refused, and receipts of a failure stay if they name this node and attempt."""
    c = Context(*(turn[k] for k in ("unit_id", "node_id", "queue_id", "attempt_key", "attempt_index")))
    record = {k: turn[k] for k in ("unit_id", "node_id", "queue_id", "attempt_key", "attempt_index")} | dict.fromkeys(("outcome", "output_json", "error_code", "error_message", "retryable", "terminal")) | {"usage": []}
    try:
        if body is None:
            raise BodyFailure("immutable_configuration_rejected", False, f"no body for {c.node_id}")
        outcome, output, receipts = body.complete(None if turn["input_json"] is None else json.loads(turn["input_json"]), c)
        try:
            record["usage"] = _sound(list(receipts), body)
        except DocumentError as e:
            raise BodyFailure("immutable_configuration_rejected", False, str(e)) from e
        if outcome not in body.node["outcomes"]["outcomes"] or outcome == UNSATISFIABLE:
            raise BodyFailure("immutable_configuration_rejected", False, f"{c.node_id} has no outcome {outcome!r}")
        contract = body.node.get("outputs", {}).get(outcome)
        if output is not None and contract is None:
            raise BodyFailure("immutable_configuration_rejected", False, f"{c.node_id} declares no output of {outcome}")
        if output is None and contract is not None:
            raise BodyFailure("immutable_configuration_rejected", False, f"{c.node_id} owes an output of {outcome}")
        return record | {"status": "completed", "outcome": outcome, "output_json": None if output is None else json.dumps(output, separators=(",", ":"))}
    except BodyFailure as e:
        kept = [r for r in e.receipts if _is_sound(r)] if (e.node_id, e.attempt_key) == (c.node_id, c.attempt_key) else []
        usage = record["usage"] or kept
        if body is not None and e.code in body.declared:
            return record | {"status": "completed", "outcome": body.declared[e.code], "usage": usage}
        code, retry, message = e.code, e.retryable, str(e)
    except Exception as e:  # noqa: BLE001  whatever a host's body raises is the turn's failure
        usage, message = record["usage"], f"{type(e).__name__}: {e}"
        code, retry = columns.classify(message)
    last = not retry or turn["attempt_index"] >= (body.node["turn"]["maxAttempts"] if body else 1)
    return record | {"status": "failed", "usage": usage, "error_code": code, "error_message": "".join(" " if x < " " or x == "\x7f" else x for x in message)[:2000], "retryable": retry, "terminal": last}


def _is_sound(receipt: dict) -> bool:
    try:
        check_receipt(receipt)
    except DocumentError:
        return False
    return True


def attempts(body: Body | None, turn: dict) -> Iterator[dict]:
    """The records of a turn until it completes or has failed for good. Each attempt's key is the turn's with its index."""
    while True:
        made = attempt(body, turn | {"attempt_key": f"{turn['attempt_key']}#{turn['attempt_index']}"})
        yield made
        if made["status"] == "completed" or made["terminal"]:
            return
        turn = turn | {"attempt_index": turn["attempt_index"] + 1}


def execute(turns: DataFrame, bodies: dict[str, Body], retries: bool = True) -> DataFrame:
    """The attempts of all turns, ``ATTEMPT`` rows; one each without ``retries``."""
    kind = T._parse_datatype_string(ATTEMPT)
    arrow = to_arrow_schema(kind)
    names = [f.name for f in T._parse_datatype_string(f"x {RECEIPT}")[0].dataType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for turn in batch.to_pylist():
                body = bodies.get(turn["node_id"])
                for record in attempts(body, turn) if retries else [attempt(body, turn)]:
                    made.append(record | {"usage": [{n: _field(r, n) for n in names} for r in record["usage"]]})
            yield pa.RecordBatch.from_pylist(made, arrow)

    return turns.select(*TURN).mapInArrow(run, kind)


def _field(receipt: dict, name: str) -> object:
    head, *rest = name.split("_")
    return receipt.get(head + "".join(w.title() for w in rest))


def outbox(made: DataFrame, on_success: dict[str, str] | None = None, on_failure: dict[str, str] | None = None) -> DataFrame:
    """The host's own events of attempts: ``on_success`` by outcome, ``on_failure`` by error code, each an event type. A key of the type and the
    attempt makes each event one."""
    named = lambda column, names: F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in (names or {}).items()), F.lit(None).cast("string"))
    kind = F.when(F.col("status") == "completed", named("outcome", on_success)).when(F.col("terminal"), named("error_code", on_failure))
    rows = made.withColumn("event_type", kind).where("event_type is not null")
    return rows.select("unit_id", "node_id", "queue_id", "event_type", F.sha2(F.concat(F.lit('{"eventType":"'), "event_type", F.lit('","idempotencyKey":"'), "attempt_key", F.lit('"}')), 256).alias("dedupe_key"))


def claimed(turns: DataFrame, graph_digests: list[str]) -> tuple[DataFrame, DataFrame]:
    """(turns of a worker's graphs, those withheld from it)."""
    mine = F.col("graph_digest").isin(graph_digests)
    return turns.where(mine), turns.where(~F.coalesce(mine, F.lit(False)))


def tallies(made: DataFrame, withheld: DataFrame, by: str = "node_id") -> DataFrame:
    """By node: turns, those that succeeded, failed and may run again, failed for good, and were skipped because their graph is not the
    worker's."""
    ran = made.groupBy(by).agg(
        F.countDistinct("queue_id").alias("turns"), F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if((F.col("status") == "failed") & ~F.col("terminal")).alias("retried"),
        F.count_if((F.col("status") == "failed") & F.col("terminal")).alias("terminal"),
    )
    skipped = withheld.groupBy(by).agg(F.count("*").alias("skipped"))
    return ran.join(skipped, by, "full_outer").select(by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("turns", "succeeded", "retried", "terminal", "skipped")))


def worker(turns: DataFrame, bodies: dict[str, Body], graph_digests: list[str], sink: Callable[[DataFrame, int], None]):
    """A worker over a stream of turns: each micro-batch runs the turns of its graphs and hands their records to ``sink``; the stream's
    trigger takes the place of polling, and stopping the query stops the worker."""

    def run(batch: DataFrame, number: int) -> None:
        sink(execute(claimed(batch, graph_digests)[0], bodies), number)

    return turns.writeStream.foreachBatch(run)
