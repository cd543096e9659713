import hashlib

from pyspark.sql import functions as F

from pathloom.operators import bodies
from pathloom.sources import tables
from pathloom.streaming import journeys


def test_admission(spark):
    schema = "unit_id string, admission_digest string"
    known = spark.createDataFrame([("a", "1"), ("b", "2")], schema)
    new, conflicts = tables.admit(spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("c", "3"), ("d", "4"), ("d", "5")], schema), known)
    assert [tuple(r) for r in new.collect()] == [("c", "3")] and sorted(r.unit_id for r in conflicts.collect()) == ["b", "d", "d"]


def test_usage_events(spark):
    turns = spark.createDataFrame([("u", "q", "n", "k", [("r1",), ("r2",)])], "unit_id string, queue_id string, node_id string, idempotency_key string, usage array<struct<trust:string>>")
    got = [(r.receipt_index, r.dedupe_key) for r in tables.usage_events(turns).orderBy("receipt_index").collect()]
    assert got == [(k, hashlib.sha256(f'{{"eventType":"node_turn_usage","idempotencyKey":"k","receiptIndex":{k}}}'.encode()).hexdigest()) for k in (0, 1)]


def test_integrity(spark):
    units = spark.createDataFrame([("u", "c.v1", "d")], "unit_id string, seed_contract string, seed_digest string")
    queue = spark.createDataFrame([("q", "u"), ("r", "gone")], "queue_id string, unit_id string")
    journey = spark.createDataFrame([("u", "q"), ("u", "lost"), ("u", None)], "unit_id string, queue_id string")
    known = spark.createDataFrame([("c.v1", "other")], "contract_id string, digest string")
    assert {tuple(r) for r in tables.integrity(units, queue, journey, known).collect()} == {("occurrence_without_unit", "r"), ("seed_without_artifact", "u"), ("turn_without_occurrence", "lost")}


def test_windows_and_sink(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("2024-01-01 00:00:10", "n", "turn_settled", 5), ("2024-01-01 00:00:50", "n", "turn_failed", 0), ("2024-01-01 00:01:10", "n", "turn_settled", 7)]
    spark.createDataFrame(rows, "at string, node_id string, kind string, charged_tokens int").selectExpr("CAST(at AS TIMESTAMP) AS at", "node_id", "kind", "charged_tokens").write.parquet(src)
    stream = journeys.usage_by_window(spark.readStream.schema("at timestamp, node_id string, kind string, charged_tokens int").parquet(src), "at", "1 minute", "1 minute")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.turns, r.failures, r.charged_tokens) for r in spark.table("windows").orderBy("window").collect()] == [(2, 1, 5), (1, 0, 7)]
    sink, out = journeys.append_once(str(tmp_path / "out"), ["k"]), str(tmp_path / "out")
    for batch in ([(1,), (2,), (2,)], [(2,), (3,)], [(3,)]):
        sink(spark.createDataFrame(batch, "k int"), 0)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_bodies(spark):
    def fail(_):
        raise TimeoutError("timed out\x00 now")

    turns = spark.createDataFrame([(1, "ok", "in"), (2, "bad", "in")], "q int, node_id string, input_json string")
    done = bodies.run_code(turns, {"ok": lambda x: ("done", f'"{x}"'), "bad": fail})
    got = {r.q: r for r in done.collect()}
    assert (got[1].outcome, got[1].output_json, got[1].failure) == ("done", '"in"', None)
    assert got[2].failure.code == "dependency_unavailable" and got[2].failure.retryable and got[2].error_message == "TimeoutError: timed out  now"
    named = {r.q: r for r in bodies.declared_failures(done, {"dependency_unavailable": "later"}).collect()}
    assert (named[2].outcome, named[2].failure, named[1].outcome) == ("later", None, "done")
    declared = spark.createDataFrame([("ok", "code", ["done"]), ("bad", "model", ["later"])], "node_id string, kind string, outcomes array<string>")
    faults = bodies.completion_faults(bodies.declared_failures(done, {"dependency_unavailable": "later"}).withColumn("receipts", F.lit(0)), declared)
    assert [r.q for r in faults.collect()] == [2]
