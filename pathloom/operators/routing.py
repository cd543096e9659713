"""Routing: which edges an outcome and its artifact match, and what they enqueue."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import canon
from pathloom.plans.graphs import outcomes_of


def variant_paths(pointer: str) -> list[str]:
    """The variant paths that a JSON Pointer can mean: a token of digits is an index of an array or a key of an object, as its
    parent is. Only one of them finds anything."""
    paths = ["$"]
    for t in canon.pointer_tokens(pointer):
        key = "['" + t.replace("\\", "\\\\").replace("'", "\\'") + "']"
        forms = [f"[{t}]", key] if t.isascii() and t.isdigit() and (t == "0" or t[0] != "0") and len(t) < 10 else [key]
        paths = [p + f for p in paths for f in forms]
    return paths


def field_equals(document: Column, pointer: str, value: object) -> Column:
    """Whether a pointer finds ``value`` in a variant document, without coercion; what is missing equals nothing."""
    found = F.coalesce(*(F.try_variant_get(document, p, "variant") for p in variant_paths(pointer)))
    kind = F.schema_of_variant(found)
    if value is None:
        same = F.is_variant_null(found)
    elif isinstance(value, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == value)
    elif isinstance(value, int | float):
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        same = numeric & (F.try_variant_get(found, "$", "double") == float(value))
    else:
        same = (kind == "STRING") & (F.try_variant_get(found, "$", "string") == value)
    return found.isNotNull() & F.coalesce(same, F.lit(False))


def predicate(when: dict, outcome: Column, document: Column | None) -> Column:
    """One of the three arms of the predicate language. Without an output no match holds."""
    named = outcome.isin(*outcomes_of(when))
    if "where" not in when:
        return named
    if document is None:
        return F.lit(False)
    return reduce(Column.__and__, (field_equals(document, m["pointer"], m["equals"]) for m in when["where"]), named & document.isNotNull())


def envelope(contract: Column, payload_json: Column) -> Column:
    """The document that pointers address: the payload stands under ``payload``."""
    return F.try_parse_json(F.concat(F.lit('{"contractId":"'), contract, F.lit('","payload":'), payload_json, F.lit("}")))


def matching_edges(turns: DataFrame, edges: list[dict], node: str = "node_id", outcome: str = "outcome", document: str | None = "document") -> DataFrame:
    """One row for each turn and edge that it matches, with ``edge_id, edge_ord, to``.

    The edges are the plan: a turn evaluates those of its node in one expression, so nothing is joined.
    """
    doc = F.col(document) if document else None
    hits = [
        F.when((F.col(node) == e["from"]) & predicate(e["when"], F.col(outcome), doc), F.struct(F.lit(k).alias("edge_ord"), F.lit(e["edgeId"]).alias("edge_id"), F.array(*map(F.lit, e["to"])).alias("to")))
        for k, e in enumerate(edges)
    ]
    return turns.withColumn("edge", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select("*", "edge.*").drop("edge")


def enqueued(matched: DataFrame, turn: list[str]) -> DataFrame:
    """One occurrence for each turn and target, with all edges that contribute to it in authored order."""
    spread = matched.select(*turn, "edge_ord", "edge_id", F.posexplode("to").alias("target_ord", "target"))
    edges = F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", "edge_id"))), lambda x: x["edge_id"])
    return spread.groupBy(*turn, "target").agg(edges.alias("edge_ids"), F.min(F.struct("edge_ord", "target_ord")).alias("first"))


def matches(when: dict, outcome: str, document: object = None) -> bool:
    """The predicate of one turn, for kernels and as the check of the column form."""
    if outcome not in outcomes_of(when):
        return False
    if "where" not in when:
        return True
    if document is None:
        return False
    return all((found := canon.pointer_get(document, m["pointer"])) is not canon.MISSING and canon.same_scalar(found, m["equals"]) for m in when["where"])


def parse(text: str | None) -> object:
    return None if text is None else json.loads(text)
