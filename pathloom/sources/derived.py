"""Journeys derived from the supplied tables, which have none of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit for each user: an event is a turn on the node of its key modulo 5; errors are failures, terminal from
    a value of 100; an event of a settled turn has one receipt of its value in millionths."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "unit_id")  # so that what follows by unit needs no other exchange
    k = F.get_json_object("props", "$.k").cast("bigint")
    failed = F.col("event_type") == "error"
    micro = F.round(F.col("value") * 1_000_000).cast("bigint")
    return e.select(
        "unit_id", F.row_number().over(Window.partitionBy("unit_id").orderBy("ts", "event_id")).cast("bigint").alias("sequence"),
        F.when(failed, "turn_failed").otherwise("turn_settled").alias("kind"), F.concat(F.lit("node-"), (k % 5).cast("string")).alias("node_id"), F.col("event_id").alias("queue_id"),
        F.when(~failed, F.col("event_type")).alias("outcome"), F.when(failed, F.concat(F.lit("code-"), (k % 3).cast("string"))).alias("error_code"),
        (failed & (F.col("value") >= 100)).alias("terminal"), F.when(~failed, F.lit(1)).cast("bigint").alias("receipts"), F.when(~failed, k).alias("charged_tokens"), F.when(~failed, micro).alias("charged_micro_usd"),
    )


#: The same in SQL, as a common table expression.
EVENT_JOURNEY_SQL = """journey AS (
  SELECT user_id AS unit_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
    CASE WHEN event_type = 'error' THEN 'turn_failed' ELSE 'turn_settled' END AS kind,
    'node-' || (CAST(props ->> '$.k' AS BIGINT) % 5) AS node_id, event_id AS queue_id,
    CASE WHEN event_type <> 'error' THEN event_type END AS outcome,
    CASE WHEN event_type = 'error' THEN 'code-' || (CAST(props ->> '$.k' AS BIGINT) % 3) END AS error_code,
    event_type = 'error' AND value >= 100 AS terminal,
    CASE WHEN event_type <> 'error' THEN 1 END AS receipts,
    CASE WHEN event_type <> 'error' THEN CAST(props ->> '$.k' AS BIGINT) END AS charged_tokens,
    CASE WHEN event_type <> 'error' THEN CAST(round(value * 1000000) AS BIGINT) END AS charged_micro_usd
  FROM events
)"""


#: Where an offer stands in the table, which tells the first of several in one settlement.
ARRIVAL = ["file", "row"]


def line_offers(spark: SparkSession, sf_dir: str, arrival: bool = False) -> DataFrame:
    """Offers to a join of each order: a line offers the edge of its number, ships with its settlement's date. With ``arrival`` they have
    ARRIVAL, their file (null where there is one only) and their row in it."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    place = []
    if arrival:
        file = F.col("_metadata.file_name") if len(l.inputFiles()) > 1 else F.lit(None).cast("string")
        place = [file.alias("file"), F.col("_metadata.row_index").alias("row")]
    return l.select(F.col("l_orderkey").alias("unit_id"), F.datediff("l_shipdate", F.lit("1990-01-01").cast("timestamp_ntz")).cast("bigint").alias("sequence"), F.col("l_linenumber").alias("edge_ord"), F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("edge_id"), F.col("l_partkey").alias("artifact"), *place)


LINE_OFFERS_SQL = """offers AS (
  SELECT l_orderkey AS unit_id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS sequence, l_linenumber AS edge_ord,
    'line-' || l_linenumber AS edge_id, l_partkey AS artifact
  FROM lineitem
)"""
