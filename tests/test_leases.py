"""Leases and attempts, in batch and as a stream."""

import random

from pathloom.operators import leases
from pathloom.plans.examples import PICKING
from pathloom.streaming import journeys

SCHEMA = "unit_id string, node_id string, queue_id string, ord bigint, at_ms bigint, command string, principal string, actor string, token string, evidence string, retryable boolean, extend_ms bigint"


def commands(n=3000, seed=3):
    rng, at, rows = random.Random(seed), 0, []
    for k in range(n):
        at += rng.choice((0, 10, 900, 5000) if k % 5 == 0 else (0, 50))
        external = rng.random() < 0.3
        command = rng.choice(("claim_external" if external else "claim", "prepare", "prepare", "complete", "fail", "settle", "settle", "heartbeat", "odd"))
        node = rng.choice(("ask", "nowhere")) if rng.random() < 0.05 else "ask" if external else "received"
        actor = "x" if external and command in ("claim_external", "settle") else None
        rows.append((rng.choice(("u", "v", None)), node, str(rng.randrange(6)), k, at, command, rng.choice((None, None, "picker", "other")), actor, rng.choice("ab"), rng.choice((*"eeef", None)), rng.choice((True, False, None)), 20_000))
    return rows


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[3])


def test_laws(spark):
    """Whatever the commands: one settlement, never after death; attempts are numbered 1, 2, 3; a live lease isn't given away."""
    rows = commands()
    made = {r.ord: r for r in leases.decisions(spark.createDataFrame(rows, SCHEMA), PICKING).collect()}
    assert len(made) == len(rows)
    numbers, ended, live, seen = {}, set(), {}, set()
    for c in rows:
        r, queue = made[c[3]], (c[0], c[1], c[2])
        seen.add(r.disposition)
        if c[1] == "nowhere" or c[6] == "other" or c[5] == "odd":
            assert r.disposition == "refused"
            continue
        if r.disposition in ("settled", "dead") and c[5] in ("settle", "fail"):
            assert queue not in ended
            ended.add(queue)
            live.pop(queue, None)
        if r.disposition in ("reserved", "extended", "completed", "failed"):
            assert queue not in ended and c[4] < live[queue][1] and live[queue][0] == c[8]
        if r.disposition == "reserved":
            known = numbers.setdefault(queue[:2], [])
            if r.attempt_number not in known:
                known.append(r.attempt_number)
        if r.disposition == "claimed":
            assert queue not in live or c[4] >= live[queue][1] or c[5] == "claim_external"
            if queue not in live or c[4] >= live[queue][1]:
                live[queue] = (c[8], r.expires_ms)
        if r.disposition == "extended":
            live[queue] = (c[8], r.expires_ms)
    assert all(n == list(range(1, len(n) + 1)) for n in numbers.values())
    assert seen >= {"claimed", "held", "reserved", "completed", "failed", "settled", "conflict", "lease_lost", "refused", "closed", "extended"}


def test_stream_decides_as_the_batch_does(spark, tmp_path):
    rows, at = [r for r in commands(200) if r[0]], str(tmp_path / "in")
    for k in range(0, len(rows), 70):
        spark.createDataFrame(rows[max(0, k - 10) : k + 70], SCHEMA).coalesce(1).write.mode("append").parquet(at)  # some again
    stream = journeys.lease_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at), PICKING)
    q = stream.writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert order(spark.table("leases").collect()) == order(leases.decisions(spark.createDataFrame(rows, SCHEMA), PICKING).collect())


def test_no_commands(spark):
    assert leases.decisions(spark.createDataFrame([], SCHEMA), PICKING).collect() == []
