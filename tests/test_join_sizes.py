"""Joins over tables: the first of several offers of one settlement, and exchanges whose tasks' shares don't grow with the input."""

import pytest
from pyspark.sql import functions as F

from pathloom import queries
from pathloom.operators import joins
from pathloom.operators.folds import spread
from pathloom.sources.derived import ARRIVAL, line_offers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files", [1, 3])
def test_of_offers_of_one_settlement_the_first_in_the_table_counts(spark, tmp_path, files):
    lines = spark.createDataFrame([(1, n, p, "2020-01-01") for n in (1, 2, 3) for p in (9, 1, 5)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, d string")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.to_timestamp_ntz("d").alias("l_shipdate"))
    for n in range(files):
        lines.coalesce(1).withColumn("l_partkey", F.col("l_partkey") + 100 * n).write.parquet(f"{tmp_path}/lineitem.parquet/part={n}")
    offers = line_offers(spark, str(tmp_path), arrival=True)
    first = {r.file for r in offers.collect()}
    assert len(first) == files and (files > 1 or first == {None})
    for order in ("artifact", F.desc("artifact")):  # whatever order the rows come in
        got = joins.dispositions(offers.repartition(1).sortWithinPartitions(order), ["unit_id"], F.lit(3), ARRIVAL)
        taken = got.where("disposition = 'accepted'").select("edge_ord", "artifact", "file", "row").collect()
        least = {r.edge_ord: min(((o.file or "", o.row), o.artifact) for o in offers.collect() if o.edge_ord == r.edge_ord)[1] for r in taken}
        assert {r.edge_ord: r.artifact for r in taken} == least and len(taken) == 3


def test_thresholds_of_bits_are_those_of_rows(spark):
    edges = [(u, k, s) for u, states in ((1, "oop"), (2, "oii"), (3, "ooo"), (4, "pppppp")) for k, s in enumerate(states)]
    word = {"o": "offered", "i": "impossible", "p": "pending"}
    rows = joins.thresholds(spark.createDataFrame([(u, word[s]) for u, _, s in edges], "u int, state string"), ["u"], 2)
    bits = spark.createDataFrame([(1, 3, None), (2, 1, True), (3, 7, True), (4, None, False), (4, None, None)], "u int, offered bigint, ended boolean")
    assert sorted(joins.thresholds_of_bits(bits, ["u"], 3, 2).collect()) == sorted(rows.collect())


def test_join_threshold_spreads_no_edges(spark):
    plan = queries.join_threshold(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_partitions_follow_the_files_read(spark):
    big = spark.read.parquet(f"{SF}/lineitem.parquet")
    at = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        sizes = big._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        assert spread(big, 1) in ([], [-(-int(sizes) // (1 << 20))]) and spread(big.union(big), 1) == ([n] if (n := -(-2 * int(sizes) // (1 << 20))) > 1 else [])
        assert spread(spark.range(10).toDF("k"), 1) == [] and spread(spark.createDataFrame([(1,)], "k int"), 1) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", at)


def test_faults_replay_each_journey_once(spark):
    from pathloom import journey_queries

    plan = journey_queries.journey_faults(spark, SF)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("MapInArrow") == 1 and plan.executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_a_batch_is_computed_once(spark, tmp_path):
    """The sink reads a batch several times; what makes it runs once."""
    from pathloom.streaming import journeys

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    journeys.append_once(str(tmp_path / "out"), ["id"])(spark.range(100).mapInArrow(count, "id bigint"), 0)
    assert seen.value == 100 and spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_states_of_a_stream_are_kept_by_buckets(spark, tmp_path):
    from pyspark.sql.streaming.state import GroupStateTimeout  # noqa: F401

    from pathloom.plans import examples
    from pathloom.streaming import journeys

    schema = "unit_id string, ord bigint, node_id string, outcome string, output_json string, error_code string, retryable boolean"
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    for part in (0, 1):
        spark.createDataFrame([(f"u{k}", part, "intake" if part == 0 else "scan-b", "ok" if part == 0 else "done", None, None, None) for k in range(40)], schema).coalesce(1).write.mode("append").json(src)
        stream = journeys.replay_stream(spark.readStream.schema(schema).json(src), examples.DEPOT, buckets=5).writeStream.foreachBatch(journeys.append_once(str(tmp_path / "out"), ["unit_id", "sequence"]))
        stream.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("unit_id").count().collect()
    assert len(rows) == 40 and {r["count"] for r in rows} == {3}
    assert spark.read.format("statestore").load(mark).count() <= 5
