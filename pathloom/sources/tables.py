"""Tables of a journey store on Parquet: append-only, checked for integrity by queries that return what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = "contract_id string, digest string, bytes bigint, payload_json string"
RECEIPT = "struct<schema_version:string,trust:string,observed_input_tokens:bigint,observed_output_tokens:bigint,charged_tokens:bigint,observed_cost_micro_usd:bigint,charged_cost_micro_usd:bigint,duration_ms:bigint,route_alias:string,signature:string>"
OUTBOX = "outbox_event_id string, unit_id string, queue_id string, node_id string, event_type string, payload_json string, dedupe_key string, event_digest string, recorded_at string"
UNIT = "unit_id string, graph_id string, version bigint, graph_digest string, seed_contract string, seed_digest string, admitted_at string, principal_id string, admission_digest string"


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def one(rows: DataFrame, unit: object, by: str | None = None) -> DataFrame:
    """The rows of one unit, in the order ``by``."""
    found = rows.where(F.col("unit_id") == unit)
    return found.orderBy(by) if by else found


def admit(seeds: DataFrame, known: DataFrame, key: str = "unit_id", seal: str = "admission_digest") -> tuple[DataFrame, DataFrame]:
    """(new units, conflicts): a unit that is known with the same seal is a replay and neither."""
    fresh = seeds.dropDuplicates([key, seal])
    clash = fresh.groupBy(key).agg(F.countDistinct(seal).alias("n")).where("n > 1").select(key)
    was = known.select(key, F.col(seal).alias("was"))
    conflicts = fresh.join(was, key).where(F.col("was") != F.col(seal)).select(*fresh.columns).unionByName(fresh.join(clash, key, "left_semi"))
    return fresh.join(was, key, "left_anti").join(clash, key, "left_anti"), conflicts.distinct()


def admissions(seeds: DataFrame, graph: dict, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted units, refused seeds, conflicts) of ``unit_id, contract_id, digest, bytes, admitted_at, principal_id`` rows on a sealed graph.

    A seed of another contract than the entry takes is refused. An admitted unit has its seal, its entry's occurrence and what its first
    journey record says. Admitting the same again changes nothing; another seal for a known unit is a conflict.
    """
    entry = next(n for n in graph["nodes"] if n["nodeId"] == graph["entry"])
    fits = F.col("contract_id") == entry["input"]
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    named = F.lit(f'"graph":{{"digest":"{graph["digest"]}","id":"{graph["graphId"]}","version":{graph["version"]}}}')
    seed = F.concat(F.lit('"seedArtifact":{"bytes":'), F.col("bytes").cast("string"), F.lit(',"contractId":'), text("contract_id"), F.lit(',"digest":'), text("digest"), F.lit("}"))
    body = F.concat(F.lit('{"admittedAt":'), text("admitted_at"), F.lit(","), named, F.lit(',"principalId":'), text("principal_id"), F.lit(',"schemaVersion":"unit.v1",'), seed, F.lit(',"unitId":'), text("unit_id"), F.lit("}"))
    sealed = seeds.where(fits).withColumn("admission_digest", F.sha2(body, 256))
    new, conflicts = admit(sealed, known)
    queue = F.concat("unit_id", F.lit("/1"))
    return new.withColumns({"entry_node_id": F.lit(graph["entry"]), "entry_queue_id": queue, "sequence": F.lit(1).cast("bigint")}), seeds.where(~F.coalesce(fits, F.lit(False))), conflicts


def artifacts(df: DataFrame) -> DataFrame:
    """Each artifact once: content decides identity."""
    return df.dropDuplicates(["contract_id", "digest"])


def lookup(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The artifacts that references (``contract_id, digest``) name; null where there is none."""
    return wanted.join(known, ["contract_id", "digest"], "left")


def usage_events(turns: DataFrame) -> DataFrame:
    """One outbox event for each receipt of a turn; its key is the digest of event type, attempt key and place."""
    rows = turns.select("unit_id", "queue_id", "node_id", "idempotency_key", F.posexplode("usage").alias("receipt_index", "receipt"))
    body = F.concat(F.lit('{"eventType":"node_turn_usage","idempotencyKey":"'), "idempotency_key", F.lit('","receiptIndex":'), F.col("receipt_index").cast("string"), F.lit("}"))
    return rows.select("*", F.sha2(body, 256).alias("dedupe_key"))


def dead_letters(journey: DataFrame) -> DataFrame:
    """One row for each failure for good."""
    return journey.where("kind = 'turn_failed' and terminal").select("unit_id", "sequence", "queue_id", "node_id", "attempt_number", "attempt_index", "error_code")


def listed(rows: DataFrame, by: str, unit: str | None = None, limit: int = 100) -> DataFrame:
    """The first rows of an append-only table in its order ``by``, of one unit or of all."""
    return (rows if unit is None else rows.where(F.col("unit_id") == unit)).orderBy(by).limit(limit)


def integrity(units: DataFrame, occurrences: DataFrame, journey: DataFrame, known: DataFrame) -> DataFrame:
    """``rule, subject`` of rows whose other half is missing; empty for a sound store."""
    checks = [
        ("occurrence_without_unit", occurrences.join(units, "unit_id", "left_anti"), "queue_id"), ("record_without_unit", journey.join(units, "unit_id", "left_anti"), "unit_id"),
        ("unit_without_record", units.join(journey, "unit_id", "left_anti"), "unit_id"),
        ("seed_without_artifact", units.join(known, (units.seed_contract == known.contract_id) & (units.seed_digest == known.digest), "left_anti"), "unit_id"),
        ("turn_without_occurrence", journey.where("queue_id is not null").join(occurrences, "queue_id", "left_anti"), "queue_id"),
    ]
    return reduce(DataFrame.union, (df.select(F.lit(rule).alias("rule"), F.col(at).cast("string").alias("subject")) for rule, df, at in checks)).distinct()
