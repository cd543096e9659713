"""Streams of turns: incremental usage, stateful replay, and an idempotent sink."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.operators.folds import BATCH
from pathloom.operators.leases import COMMAND, DECISION, Turns
from pathloom.operators.replay import JOURNEY, Plan, Unit, take


def usage_by_window(records: DataFrame, at: str, late: str, width: str) -> DataFrame:
    """Turns, failures and charges of each node in tumbling windows of event time; records later than ``late`` are left out."""
    failed = F.count_if(F.col("kind") == "turn_failed").alias("failures")
    return records.withWatermark(at, late).groupBy(F.window(at, width), "node_id").agg(F.count("*").alias("turns"), failed, F.sum("charged_tokens").alias("charged_tokens"))


def first_of(records: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once: a replayed record changes nothing."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def replay_stream(turns: DataFrame, graph: dict, remembered_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """The journeys of a stream of turns, as ``replay`` makes them of a table. A unit's state is JSON without the graph, kept with those of
    the units in its bucket (a hash of its name), so that a batch calls the kernel once a bucket and not once a unit; the state of an
    untouched bucket isn't read. ``ord`` orders turns of one batch, and a turn at or below the last one seen is a replay and changes
    nothing. Of a concluded unit only counters are kept, so that replays of its turns change nothing; with ``remembered_ms`` these go
    after that time (only for triggers by processing time: a stream with such timeouts never runs out of batches)."""
    plan, columns = Plan(graph), [f.split(" ")[0] for f in JOURNEY.split(", ")]

    def run(_: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {unit_id: own for unit_id, *own in json.loads(state.get[0])} if state.exists else {}  # last, state, when to forget
        now = state.getCurrentProcessingTimeMs() if remembered_ms else 0
        of: dict[str, list[dict]] = defaultdict(list)
        if not state.hasTimedOut:
            for t in _rows(batches):
                of[t["unit_id"]].append(t)
        made: list[dict] = []
        for unit_id, own in of.items():
            last, text, _ = held.get(unit_id, (-1, None, None))
            if text is None:
                unit = Unit(unit_id, plan)
                made += unit.admit()
            else:
                unit = Unit.load(unit_id, plan, text)
            for t in own:
                if t["ord"] > last:
                    last = t["ord"]
                    made += take(unit, t)
            held[unit_id] = [int(last), unit.dump(), now + remembered_ms if remembered_ms and not unit.open else None]
            if len(made) >= BATCH:
                yield _frame(made, columns)
                made = []
        if made:
            yield _frame(made, columns)
        if remembered_ms:
            held = {u: own for u, own in held.items() if own[2] is None or own[2] > now}
        if not held:
            state.remove()
            return
        state.update((json.dumps([[u, *own] for u, own in held.items()], separators=(",", ":")),))
        if due := [own[2] for own in held.values() if own[2] is not None]:
            state.setTimeoutDuration(max(min(due) - now, 1))

    keyed = turns.withColumn("unit_bucket", F.pmod(F.xxhash64("unit_id"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("unit_bucket").applyInPandasWithState(run, JOURNEY, "units string", "append", GroupStateTimeout.ProcessingTimeTimeout if remembered_ms else GroupStateTimeout.NoTimeout)


def _frame(made: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: [m[c] for m in made] for c in columns}, dtype=object)


def _rows(batches: Iterable[pd.DataFrame]) -> list[dict]:
    """A group's rows in their order, nulls as None."""
    rows: list[dict] = []
    for batch in batches:
        names = list(batch.columns)
        rows += [dict(zip(names, (None if x is None or x != x else x for x in values), strict=True)) for values in zip(*(batch[c].tolist() for c in names), strict=True)]
    return sorted(rows, key=lambda r: r["ord"])


def lease_stream(commands: DataFrame, graph: dict) -> DataFrame:
    """The decisions on a stream of commands, with the state of a unit's turns at a node kept by their key; ``ord`` orders the
    commands of one batch, and a command at or below the last one seen has its decision already."""
    nodes = {n["nodeId"]: n for n in graph["nodes"]}

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, turns = -1, Turns(nodes.get(key[1]))
        if state.exists:
            last, blob = state.get
            turns = Turns.load(nodes.get(key[1]), blob)
        rows = pd.concat(list(batches)).sort_values("ord").astype(object)
        new = [c for c in rows.where(rows.notna(), None).to_dict("records") if c["ord"] > last]
        made = [turns.decide(c) for c in new]
        state.update((int(new[-1]["ord"]) if new else last, turns.dump()))
        if made:
            yield pd.DataFrame(made)[[f.split(" ")[0] for f in DECISION.split(", ")]]

    return commands.select(*COMMAND).groupBy("unit_id", "node_id").applyInPandasWithState(run, DECISION, "last bigint, turns string", "append", GroupStateTimeout.NoTimeout)


class AppendError(ValueError):
    """Rows of a batch whose keys the table holds with other content."""


def append_once(path: str, keys: list[str], seal: str | None = None, buckets: int = 64):
    """A ``foreachBatch`` function that appends rows whose keys the table at ``path`` lacks, so a batch that runs again
    adds nothing. A batch is computed once and kept while it is appended. With ``seal``, a column of the content's digest, a key that the table or the batch has with another seal refuses
    the whole batch. The table is partitioned by a hash of the keys, and a batch reads only the partitions that it touches."""

    def sink(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            append(kept)
        finally:
            kept.unpersist()

    def append(batch: DataFrame) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.withColumn("key_bucket", part)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        touched = [r[0] for r in rows.select("key_bucket").distinct().collect()]  # at most ``buckets``
        met = [F.col(f"was.{k}").eqNullSafe(F.col(f"now.{k}")) for k in ["key_bucket", *keys]]
        columns = ["key_bucket", *keys, *([seal] if seal else [])]
        known = spark.read.parquet(path).where(F.col("key_bucket").isin(touched)).select(*columns).alias("was") if exists and touched else None
        if seal:
            twice = rows.groupBy(*keys).agg(F.countDistinct(F.coalesce(F.col(seal), F.lit(""))).alias("seals")).where("seals > 1")
            other = rows.alias("now").join(known, met).where(~F.col(f"was.{seal}").eqNullSafe(F.col(f"now.{seal}"))) if known is not None else None
            if not twice.isEmpty() or (other is not None and not other.isEmpty()):
                raise AppendError(f"keys of the batch are known with other content: {path}")
        new = rows.dropDuplicates(keys)
        if known is not None:
            new = new.alias("now").join(known, met, "left_anti").select("now.*")
        new.repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(path)

    return sink
