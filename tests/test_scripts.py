"""Replay by scripts gives the kernel's records, and runs the kernel once or twice for a script, not for each unit."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pathloom.operators import joins, paths, replay, scripts, unit_paths
from pathloom.plans import examples

TURN = pa.schema([("unit_id", pa.string()), *[(c, pa.bool_() if c == "retryable" else pa.string()) for c in replay.TURN]])


def _units(n, odd):
    r, out = random.Random(n), []
    for i in range(n):
        turns = [dict(zip(("node_id", "outcome", "error_code", "retryable"), t + (None,) * (4 - len(t)), strict=True)) for t in examples.DEPOT_TURNS[r.randrange(6)]]
        if r.random() < odd:
            r.shuffle(turns)
            turns[0]["output_json"] = r.choice(['{"a":1}', "{broken", '{"r":"%s u"}', None])
            turns[-1]["evidence"], turns[-1]["at"] = r.choice([("e" * 64, "2024-05-01T00:00:00.000Z"), (None, None)])
        out.append((f'{i}%s"é\n' if r.random() < odd else f"u{i}", turns))
    return sorted(out, key=lambda x: x[0])


def _both(units, work, schema, rows):
    plan, arrow = replay.Plan(examples.DEPOT), to_arrow_schema(T._parse_datatype_string(schema))
    began, want = [], []
    for u, turns in units:
        fold = work(u, plan, replay.canon)
        want += [x for t in (None, *turns) for x in fold.take(t)] + list(fold.end())
    turns = [{"unit_id": u, **dict.fromkeys(replay.TURN), **t} for u, ts in units for t in ts]
    batches = [pa.RecordBatch.from_pylist(turns[k : k + rows], TURN) for k in range(0, len(turns), rows)]
    got = list(scripts.run(batches, replay.TURN, arrow, lambda u, seals: began.append(u) or work(u, plan, seals), False))
    key = lambda rs: sorted(json.dumps(x, sort_keys=True) for x in rs)
    assert key(x for b in got for x in b.to_pylist()) == key(want)
    return began


@pytest.mark.parametrize("rows", [1, 7, 1000])
@pytest.mark.parametrize(("work", "schema"), [(replay.Journey, replay.JOURNEY), (replay.JoinStates, replay.PROGRESS)])
def test_records_are_the_kernels(spark, rows, work, schema):
    """Digests, ids and sizes within digests among them, whatever the units are called and the turns hold, and wherever batches end."""
    assert len(_both(_units(300, 0), work, schema, rows)) <= 12
    _both(_units(300, 0.5), work, schema, rows)


def test_long_units_and_what_is_forgotten(spark, monkeypatch):
    loop = [{"node_id": "intake", "outcome": "ok"}, *[{"node_id": "scan-a", "outcome": "again"}] * 600]
    _both([("a", loop), *((u, loop[:200]) for u in "bcd"), ("e", loop)], replay.Journey, replay.JOURNEY, 50)
    monkeypatch.setattr(scripts, "TURNS", 3)
    _both(_units(200, 0.3), replay.Journey, replay.JOURNEY, 10)


def test_projections_in_the_kernel_are_the_set_forms(spark):
    """Of scripted and shuffled units: occurrences, joins, edges, goals, summaries and nodes."""
    units = [(u, [t | {"output_json": None, "evidence": None, "at": None} for t in ts]) for u, ts in _units(120, 0) + [(f"s{u}", random.Random(u).sample(ts, len(ts))) for u, ts in _units(100, 0)]]
    rows = [(u, k, *(t[c] for c in replay.TURN)) for u, ts in units for k, t in enumerate(ts)]
    turns = spark.createDataFrame(rows, "unit_id string, ord int, node_id string, outcome string, output_json string, error_code string, retryable boolean, evidence string, at string")
    made = replay.replay(turns, examples.DEPOT).cache()
    found, joined = paths.occurrences(made).cache(), joins.states(made).cache()
    same = lambda project, schema, want: [sorted(map(str, x.collect())) for x in (replay.projected(turns, examples.DEPOT, project, schema), want)]
    number = lambda q: F.substring_index(q, "/", -1).cast("int")
    of = unit_paths.occurrences
    names = ("queue_id", "node_id", "enqueue_sequence", "queued_by", "state", "attempts", "failures", "outcome", "error_code")
    for got, want in (
        same(of, "queue_id string, node_id string, enqueue_sequence bigint, queued_by bigint, state string, attempts bigint, failures bigint, outcome string, error_code string", found.select("unit_id", *names)),
        same(lambda r: unit_paths.node_states(of(r)), "node_id string, state string, occurrences bigint", paths.node_states(found).select("unit_id", "node_id", "state", "occurrences")),
        same(unit_paths.edge_counts, "edge_id string, taken bigint", paths.edge_counts(made.select("unit_id", F.inline("effects")))),
        same(unit_paths.join_states, "node_id string, status string, offered array<string>, impossible array<string>, late_offers bigint, number int, selected string", joined.select(
            "unit_id", "node_id", "status", F.col("offered_edges").alias("offered"), F.col("impossible_edges").alias("impossible"), "late_offers", F.coalesce(number("queue_id"), F.lit(0)).alias("number"), F.col("selected_edge_id").alias("selected"))),
        same(lambda r: unit_paths.goal_closures(of(r), unit_paths.join_states(r), examples.DEPOT_GOALS), "goal_id string, status string, resolution string, open_members string, dead_members string, turns bigint",
            paths.goal_closures(found, joined, examples.DEPOT_GOALS).select("unit_id", "goal_id", "status", "resolution", "open_members", "dead_members", "turns")),
        same(lambda r: [unit_paths.summary(of(r))], "open_numbers string, concluded boolean, dead bigint, turns bigint, failures bigint", paths.unit_summaries(found).select(
            "unit_id", F.array_join(F.transform("open_queue_ids", lambda q: F.substring_index(q, "/", -1)), ",").alias("open_numbers"), "concluded", "dead", "turns", "failures")),
    ):
        assert got == want and got
