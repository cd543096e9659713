import json
import re

from pyspark.sql import functions as F

from pathloom.functions import canon
from pathloom.operators import joins, routing

DOCS = ['{"payload":{"a":1,"b.c":"1","d":null,"e":true,"f":[5,{"g":"x"}]}}', '{"payload":{"a":1.0,"b.c":1,"e":"true"}}', '{"payload":{"a":"1","d":0,"f":[]}}', "{}", None, "broken"]
CASES = [("/payload/a", 1), ("/payload/a", "1"), ("/payload/a", True), ("/payload/b.c", "1"), ("/payload/d", None), ("/payload/e", True), ("/payload/e", "true"), ("/payload/f/1/g", "x"), ("/payload/f/0", 5), ("/payload/a", 1.0)]


def test_columns_agree_with_the_kernel(spark):
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(DOCS)], "k int, d string").withColumn("doc", F.try_parse_json("d"))
    whens = [{"outcome": "o", "where": [{"pointer": p, "equals": v}]} for p, v in CASES]
    got = rows.orderBy("k").select(*[routing.predicate(w, F.lit("o"), F.col("doc")).alias(f"c{k}") for k, w in enumerate(whens)]).collect()
    for d, r in zip(DOCS, got, strict=True):
        doc = json.loads(d) if d and d != "broken" else None
        assert [bool(x) for x in r] == [routing.matches(w, "o", doc) for w in whens], d


def test_arms(spark):
    assert routing.matches({"anyOf": ["a", "b"]}, "b") and not routing.matches({"anyOf": ["a", "b"]}, "c")
    assert not routing.matches({"outcome": "a", "where": [{"pointer": "/x", "equals": None}]}, "a", {})
    edges = [{"edgeId": "e1", "from": "n", "when": {"outcome": "o"}, "to": ["t", "u"]}, {"edgeId": "e2", "from": "n", "when": {"anyOf": ["o", "p"]}, "to": ["t"]}]
    turns = spark.createDataFrame([(1, "n", "o"), (2, "n", "p"), (3, "m", "o"), (4, None, None)], "q int, node_id string, outcome string")
    rows = routing.enqueued(routing.matching_edges(turns, edges, document=None), ["q"]).collect()
    assert {(r.q, r.target): r.edge_ids for r in rows} == {(1, "t"): ["e1", "e2"], (1, "u"): ["e1"], (2, "t"): ["e2"]}


def test_dispositions_and_fire_points(spark):
    offers = spark.createDataFrame(
        [(1, 10, 3, "c", "ac"), (1, 5, 2, "b", "ab"), (1, 10, 1, "a", "aa"), (1, 7, 2, "b", "ab2"), (1, 12, 4, "d", "ad"), (2, 1, 1, "a", "x")], "u int, sequence int, edge_ord int, edge_id string, artifact string"
    )
    got = joins.dispositions(offers, ["u"], F.lit(2))
    assert sorted((r.u, r.sequence, r.edge_id, r.disposition) for r in got.collect()) == [
        (1, 5, "b", "accepted"), (1, 7, "b", "edge_already_resolved_noop"), (1, 10, "a", "accepted"), (1, 10, "c", "accepted"), (1, 12, "d", "join_already_resolved_noop"), (2, 1, "a", "accepted"),
    ]
    # both offers of the settlement that fires count; the first by authored order is selected
    assert [(r.u, r.fired_at, r.selected, r.accepted_edges) for r in joins.selected(got, ["u"], "artifact").collect()] == [(1, 10, "aa", ["a", "b", "c"])]
    parts = joins.canonical_inputs(got, ["u"], {"unitId": joins.quoted(F.col("u").cast("string"))}, {"edgeId": joins.quoted(F.col("edge_id")), "artifact": joins.quoted(F.col("artifact"))}).first()
    assert parts.input_json == canon.canonical_json(json.loads(parts.input_json)) and parts.input_digest == canon.raw_digest(parts.input_json)
    assert [x["edgeId"] for x in json.loads(parts.input_json)["accepted"]] == ["a", "b", "c"]


def test_digit_tokens_are_keys_or_indexes(spark):
    rows = spark.createDataFrame([('{"payload":{"0":"x"}}',), ('{"payload":["x"]}',), ('{"payload":{"01":"x"}}',), ('{"payload":"x"}',)], "t string").select(F.try_parse_json("t").alias("d"), "t")
    for pointer in ("/payload/0", "/payload/01"):
        want = [canon.pointer_get(json.loads(r.t), pointer) == "x" for r in rows.collect()]
        assert [r.hit for r in rows.select(routing.field_equals(F.col("d"), pointer, "x").alias("hit")).collect()] == want


def test_grammars_end_where_the_text_ends(spark):
    texts = ["abc", "abc\n", "a.v1", "a.v1\n", "0" * 64, "0" * 64 + "\n", "2024-05-01T00:00:00.000Z", "2024-05-01T00:00:00.000Z\n", "\u0662024-05-01T00:00:00.000Z"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for pattern in (canon.IDENTIFIER, canon.CONTRACT_ID, canon.DIGEST, canon.TIMESTAMP):
        here = [bool(re.match(pattern, x)) for x in texts]
        assert here == [r.hit for r in df.select(F.col("t").rlike(pattern).alias("hit")).collect()] and not any(h for h, x in zip(here, texts, strict=True) if x.endswith("\n"))
