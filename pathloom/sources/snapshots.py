"""Snapshots of a store's tables and their restoration, which accepts nothing that doesn't fit together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import paths
from pathloom.sources import tables

#: The tables of a store that a snapshot has, with what identifies a row.
KEYS = {"unit": ["unit_id"], "artifact": ["contract_id", "digest"], "occurrence": ["queue_id"], "journey": ["unit_id", "sequence"], "outbox": ["dedupe_key"], "dead_letter": ["unit_id", "queue_id"]}
MANIFEST = "name string, n bigint, seal string"


class SnapshotError(ValueError):
    """A snapshot whose tables aren't those that were written, or don't fit together."""


def _seal(df: DataFrame) -> DataFrame:
    """Number of rows and a digest of them that doesn't depend on their order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", F.hex(F.coalesce(F.bit_xor(row), F.lit(0))), F.hex(F.coalesce(F.sum(F.shiftright(row, 20)), F.lit(0)))).alias("seal"))


def write(found: dict[str, DataFrame], path: str) -> None:
    """Writes a store's tables, and last the manifest that says what they hold."""
    spark = next(iter(found.values())).sparkSession
    for name, df in found.items():
        df.write.parquet(f"{path}/{name}")
    rows = [(name, *_seal(spark.read.parquet(f"{path}/{name}")).first()) for name in found]  # one row a table
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def faults(found: dict[str, DataFrame]) -> DataFrame:
    """``rule, subject`` of what doesn't fit: rows that repeat an identity, rows whose other half is missing, journeys that can't have
    happened, and dead letters that no journey tells of."""
    out = [tables.integrity(found["unit"], found["occurrence"], found["journey"], found["artifact"])]
    for name, keys in KEYS.items():
        if name in found:
            out.append(found[name].groupBy(*keys).count().where("count > 1").select(F.lit(f"{name}_twice").alias("rule"), F.concat_ws(":", *keys).alias("subject")))
    out.append(paths.journey_faults(found["journey"]).select(F.concat(F.lit("journey_"), "rule").alias("rule"), F.concat_ws(":", "unit_id", "subject").alias("subject")))
    if "dead_letter" in found:
        told = found["journey"].where("kind = 'turn_failed' and terminal").select("unit_id", "queue_id")
        for name, a, b in (("dead_letter_without_failure", found["dead_letter"], told), ("failure_without_dead_letter", told, found["dead_letter"])):
            out.append(a.join(b, ["unit_id", "queue_id"], "left_anti").select(F.lit(name).alias("rule"), F.col("queue_id").alias("subject")))
    return reduce(DataFrame.union, out).distinct()


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot. Rows that are missing, more or others than were written, or that don't fit together, raise."""
    wrong, found = [], {}
    for row in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect():  # a row a table
        found[row.name] = spark.read.parquet(f"{path}/{row.name}")
        if tuple(_seal(found[row.name]).first()) != (row.n, row.seal):
            wrong.append(f"{row.name}: other rows than were written")
    if wrong:
        raise SnapshotError("; ".join(wrong))
    some = faults(found).limit(20).collect()
    if some:
        more = "" if len(some) < 20 else f" (of {faults(found).count()})"
        raise SnapshotError("; ".join(f"{r.rule} {r.subject}" for r in some) + more)
    return found
