"""A store of published graphs: one append publishes a graph with its node signatures, and a graph is checked as it is read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.plans import checks, graphs

DEFINITION = "graph_id string, version bigint, digest string, body string, signatures array<struct<ref_id:string,ref_version:bigint,signature:string>>"


class PublicationError(ValueError):
    """A graph that can't be published, or isn't what a reader asked for."""


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The published graphs; none where nothing is published yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(DEFINITION).parquet(path) if known else spark.createDataFrame([], DEFINITION)


def publish(spark: SparkSession, path: str, sealed: list[dict]) -> list[dict]:
    """Publishes sealed graphs and returns the refs of those that are new. The same graph again changes nothing; a version
    with another digest, a node version with another signature or a violation raises, and nothing is written."""
    sealed = list({graphs.unseal(g)["digest"]: g for g in sealed}.values())
    if not sealed:
        return []
    faults = checks.violations(spark, sealed).union(spark.createDataFrame([], "graph_id string, version bigint, rule string, subject string"))
    wrong = [f"{r.graph_id}@{r.version}: {r.rule} {r.subject}" for r in faults.collect()]  # a few rows a graph at most
    signed = graphs.tables(spark, sealed)["node"].groupBy("graph_id", "version").agg(F.collect_list(F.struct("ref_id", "ref_version", "signature")).alias("signatures"))
    bodies = spark.createDataFrame([(g["graphId"], g["version"], g["digest"], graphs.to_json(g)) for g in sealed], "graph_id string, version bigint, digest string, body string")
    new, known = bodies.join(signed, checks.KEY), stored(spark, path)
    every = known.unionByName(new)
    versions = every.groupBy(*checks.KEY).agg(F.countDistinct("digest").alias("n")).where("n > 1")
    nodes = every.select(F.inline("signatures")).groupBy("ref_id", "ref_version").agg(F.countDistinct("signature").alias("n")).where("n > 1")
    wrong += [f"{r.graph_id}@{r.version}: graph_digest" for r in versions.collect()] + [f"{r.ref_id}@{r.ref_version}: node_signature" for r in nodes.collect()]
    if wrong:
        raise PublicationError("; ".join(wrong))
    fresh = {r.digest for r in new.join(known.select("digest"), "digest", "left_anti").select("digest").collect()}
    if fresh:
        new.where(F.col("digest").isin(sorted(fresh))).select(*known.columns).coalesce(1).write.mode("append").parquet(path)
    return [graphs.ref(g) for g in sealed if g["digest"] in fresh]


def load(spark: SparkSession, path: str, ref: dict) -> dict:
    """The graph of a ref, its seal and rules checked again."""
    rows = stored(spark, path).where((F.col("graph_id") == ref["id"]) & (F.col("version") == ref["version"])).select("digest", "body").distinct().collect()
    if not rows:
        raise PublicationError(f"{ref['id']}@{ref['version']} isn't published")
    if {r.digest for r in rows} != {ref["digest"]}:
        raise PublicationError(f"{ref['id']}@{ref['version']} has another digest")
    graph = graphs.unseal(json.loads(rows[0].body))
    if not checks.violations(spark, [graph]).isEmpty():
        raise PublicationError(f"{ref['id']}@{ref['version']} breaks a rule")
    return graph
