"""Turns run by bodies: attempts, receipts, retries, agents, withheld graphs, a worker over a stream."""

import pytest

from pathloom.operators import execution as x
from pathloom.plans import documents as d
from pathloom.plans.documents import DocumentError

TURN = {"unit_id": "u", "node_id": "n", "queue_id": "q", "input_json": '{"a":1}', "attempt_key": "k", "attempt_index": 1}
SPENT = d.reported_receipt(3, 4, 5)


def _node(kind, **more):
    return {"nodeId": "n", "kind": kind, "outcomes": {"outcomes": ["done", "later"]}, "turn": {"maxAttempts": 2}} | more


def _body(kind, run=None, **more):
    parts = {k: more.pop(k) for k in ("submit", "wait", "declared") if k in more}
    return x.Body(_node(kind, **more), run, **parts)


def _raise(e):
    raise e


def test_code_returns_no_receipts():
    assert x.attempt(_body("code", lambda given, c: ("done", None)), TURN)["status"] == "completed"
    made = x.attempt(_body("code", lambda given, c: ("done", {"twice": given["a"] * 2}), outputs={"done": "o.v1"}), TURN)
    assert made["output_json"] == '{"twice":2}' and made["usage"] == []
    for run, more in ((lambda g, c: ("mystery", None), {}), (lambda g, c: ("join_unsatisfiable", None), {}), (lambda g, c: ("done", {"odd": 1}), {}), (lambda g, c: ("done", None), {"outputs": {"done": "o.v1"}})):
        made = x.attempt(_body("code", run, **more), TURN)
        assert (made["status"], made["error_code"], made["retryable"], made["terminal"]) == ("failed", "immutable_configuration_rejected", False, True)


def test_models_owe_one_receipt_which_outlives_a_bad_outcome():
    model = lambda outcome, receipts: _body("model", lambda given, binding, c: (outcome, None, receipts), binding={"bindingId": "b"})
    assert x.attempt(model("done", [SPENT]), TURN)["usage"] == [SPENT]
    for receipts in ([], [SPENT, SPENT], [SPENT | {"chargedTokens": 1}]):
        assert x.attempt(model("done", receipts), TURN)["status"] == "failed"
    made = x.attempt(model("mystery", [SPENT]), TURN)
    assert made["status"] == "failed" and made["usage"] == [SPENT]


def test_receipts_of_failures_belong_to_their_attempt():
    fail = lambda **to: _body("model", lambda g, b, c: _raise(x.BodyFailure("dependency_unavailable", True, "x", (SPENT, {"odd": 1}), **to)), binding={})
    assert x.attempt(fail(node_id="n", attempt_key="k"), TURN)["usage"] == [SPENT]
    assert x.attempt(fail(node_id="n", attempt_key="other"), TURN)["usage"] == [] == x.attempt(fail(), TURN)["usage"]
    declared = _body("model", lambda g, b, c: _raise(x.BodyFailure("busy", True, "x", (SPENT,), "n", "k")), binding={}, declared={"busy": "later"})
    made = x.attempt(declared, TURN)
    assert (made["status"], made["outcome"], made["usage"]) == ("completed", "later", [SPENT])


def test_agents_are_awaited_under_their_key_even_if_submission_is_lost():
    keys = []
    agent = _body("agent", submit=lambda g, c: (keys.append(c.attempt_key), _raise(x.LostTransport())), wait=lambda c: (keys.append(c.attempt_key), ("done", None, [SPENT] * 3))[1])
    made = x.attempt(agent, TURN)
    assert made["status"] == "completed" and len(made["usage"]) == 3 and keys == ["k", "k"]


def test_retries_end_with_success_or_for_good():
    run = lambda g, c: _raise(TimeoutError("timed out\x00")) if c.attempt_index < 2 else ("done", None)
    made = list(x.attempts(_body("code", run), TURN))
    assert [(m["status"], m["attempt_index"], m["attempt_key"], m["terminal"]) for m in made] == [("failed", 1, "k#1", False), ("completed", 2, "k#2", None)]
    assert made[0]["error_message"] == "TimeoutError: timed out " and made[0]["error_code"] == "dependency_unavailable"
    always = list(x.attempts(_body("code", lambda g, c: _raise(TimeoutError("timed out"))), TURN))
    assert [m["terminal"] for m in always] == [False, True]
    assert [m["terminal"] for m in x.attempts(_body("code", lambda g, c: _raise(ValueError("bad schema"))), TURN)] == [True]
    assert [m["error_code"] for m in x.attempts(None, TURN)] == ["immutable_configuration_rejected"] == [m["error_code"] for m in x.attempts(_body("human"), TURN)]


def test_tables_and_streams(spark, tmp_path):
    def ask(given, binding, context):
        if not given:
            raise TimeoutError("timed out")
        return "done", None, [d.unavailable_receipt()]

    bodies = {"a": x.Body(_node("code", nodeId="a"), lambda g, c: ("done", None)), "b": x.Body(_node("model", nodeId="b", binding={}), ask)}
    rows = [(f"u{k}", n, f"q{k}{n}", "1" if k % 2 else "0", f"k{k}{n}", 1, f"g{k % 3}") for k in range(6) for n in "ab"]
    turns = spark.createDataFrame(rows, "unit_id string, node_id string, queue_id string, input_json string, attempt_key string, attempt_index int, graph_digest string")
    mine, others = x.claimed(turns, ["g0", "g1"])
    made = x.execute(mine, bodies).cache()
    assert made.count() == 4 + 2 + 2 * 2 and {r.usage[0].trust for r in made.where("status = 'completed' and node_id = 'b'").collect()} == {"unavailable"}
    assert sorted(map(tuple, x.tallies(made, others).collect())) == [("a", 4, 4, 0, 0, 2), ("b", 4, 2, 2, 2, 2)]
    src, got = str(tmp_path / "src"), []
    turns.write.parquet(src)
    query = x.worker(spark.readStream.schema(turns.schema).parquet(src), bodies, ["g0", "g1"], lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.queue_id, r.attempt_index) for r in got) == sorted((r.queue_id, r.attempt_index) for r in made.collect())


def test_receipts_are_closed_documents():
    assert d.check_receipt(SPENT) == SPENT and d.check_receipt(SPENT | {"routeAlias": "eu-west"})
    for bad in ({"schemaVersion": "usage-receipt.v2"}, {"routeAlias": "EU"}, {"chargedTokens": 10_000_001}, {"extra": 1}, {"signature": "s"}, {"observedInputTokens": True}):
        with pytest.raises(DocumentError):
            d.check_receipt(SPENT | bad)
    with pytest.raises(DocumentError):
        d.check_receipt({k: v for k, v in SPENT.items() if k != "durationMs"})
