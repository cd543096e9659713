"""Checks of a definition's parts against each other, each a query that returns the violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import canon
from pathloom.plans import expand, graphs

KEY = ["graph_id", "version"]


def violations(spark: SparkSession, definitions: list[dict]) -> DataFrame:
    """``graph_id, version, rule, subject`` of everything that keeps the definitions from running."""
    t = graphs.tables(spark, definitions)
    node, outcome, edge, arc, terminal = (t[k] for k in ("node", "outcome", "edge", "arc", "terminal"))
    found: list[DataFrame] = []

    def say(df: DataFrame, rule: str, subject) -> None:
        found.append(df.select(*KEY, F.lit(rule).alias("rule"), F.col(subject).alias("subject") if isinstance(subject, str) else subject.alias("subject")))

    entries = spark.createDataFrame([(g["graphId"], g["version"], g["entry"]) for g in definitions], "graph_id string, version bigint, node_id string")
    say(entries.join(node, [*KEY, "node_id"], "left_anti"), "unknown_entry", "node_id")
    sources = edge.withColumn("node_id", F.col("source"))
    say(sources.join(node, [*KEY, "node_id"], "left_anti"), "unknown_source", "edge_id")
    targets = arc.withColumn("node_id", F.col("target"))
    say(targets.join(node, [*KEY, "node_id"], "left_anti"), "unknown_target", "edge_id")
    say(terminal.join(outcome, [*KEY, "node_id", "outcome"], "left_anti"), "unknown_terminal", F.concat_ws(":", "node_id", "outcome"))
    named = sources.withColumn("outcome", F.explode("outcomes"))
    say(named.join(outcome, [*KEY, "node_id", "outcome"], "left_anti"), "undeclared_outcome", "edge_id")

    # what an edge carries is what its target takes, unless the target composes an envelope
    producing = node.select(*KEY, "node_id", F.col("input").alias("carried"), "outputs")
    taking = node.select(*KEY, F.col("node_id").alias("target"), F.col("input").alias("wanted"), F.coalesce(F.col("compose") == "envelope", F.lit(False)).alias("envelope"))
    carried = named.join(producing, [*KEY, "node_id"]).join(arc.select(*KEY, "edge_id", "target"), [*KEY, "edge_id"]).join(taking, [*KEY, "target"])
    made = F.when(F.col("outcome") == graphs.UNSATISFIABLE, F.lit(graphs.UNSATISFIABLE_CONTRACT)).otherwise(F.coalesce(F.col("outputs")[F.col("outcome")], F.col("carried")))
    say(carried.where(~F.col("envelope") & (made != F.col("wanted"))), "contract_mismatch", "edge_id")
    say(node.where((F.col("kind") == "model") & F.col("binding_digest").isNull()), "model_without_binding", "node_id")
    say(node.where((F.col("kind") != "model") & F.col("binding_digest").isNotNull()), "binding_on_other_kind", "node_id")
    say(node.where(F.col("principal_id") == graphs.ENGINE_PRINCIPAL), "engine_principal", "node_id")
    say(node.where((F.col("compose") == "envelope") & (F.col("input") != graphs.JOIN_INPUT_CONTRACT)), "envelope_input", "node_id")
    others = [(g["graphId"], g["version"], g["graphId"]) for g in definitions if not _is_expansion(g)]
    say(spark.createDataFrame(others, "graph_id string, version bigint, subject string"), "other_expansion", "subject")
    say(outcome.where(F.col("outcome") == graphs.UNSATISFIABLE).join(node.where("inbound is not null"), [*KEY, "node_id"], "left_anti"), "reserved_outcome", "node_id")
    say(node.where("inbound is not null").join(outcome.where(F.col("outcome") == graphs.UNSATISFIABLE), [*KEY, "node_id"], "left_anti"), "join_without_unsatisfiable", "node_id")
    say(node.where("entry and inbound is not null"), "entry_is_join", "node_id")
    signatures = node.groupBy(*KEY, "ref_id", "ref_version").agg(F.countDistinct("signature").alias("n")).where("n > 1")
    say(node.join(signatures, [*KEY, "ref_id", "ref_version"], "left_semi"), "signature_conflict", "node_id")

    wanted = node.where("inbound is not null").select(*KEY, "node_id", F.explode("inbound").alias("edge_id"), F.lit(1).alias("wanted"))
    actual = targets.join(node.where("inbound is not null"), [*KEY, "node_id"], "left_semi").select(*KEY, "node_id", "edge_id", F.lit(1).alias("actual"))
    say(wanted.join(actual, [*KEY, "node_id", "edge_id"], "full_outer").where("wanted is null or actual is null"), "join_inbound", "node_id")
    say(node.where("n_of > size(inbound)"), "join_bound", "node_id")
    ended = terminal.join(named, [*KEY, "node_id", "outcome"], "left_semi")
    say(ended, "terminal_and_routed", F.concat_ws(":", "node_id", "outcome"))
    covered = named.where("unconditional").select(*KEY, "node_id", "outcome").union(terminal.select(*KEY, "node_id", "outcome"))
    say(outcome.join(covered, [*KEY, "node_id", "outcome"], "left_anti"), "uncovered_outcome", F.concat_ws(":", "node_id", "outcome"))
    reached = spark.createDataFrame([(g["graphId"], g["version"], n) for g in definitions for n in graphs.distances(_known(g))], "graph_id string, version bigint, node_id string")
    say(node.join(reached, [*KEY, "node_id"], "left_anti"), "unreachable", "node_id")
    return reduce(DataFrame.union, found).distinct()


def _is_expansion(graph: dict) -> bool:
    """Whether a graph with approvals or reviews is what its settings expand to."""
    if not any("approval" in n or "review" in n for n in graph["nodes"]):
        return True
    try:
        return bool(expand.rederived(graph))
    except (graphs.GraphError, KeyError):
        return False


def _known(graph: dict) -> dict:
    """The graph with its known entry and what edges there are between known nodes, as a walk needs it."""
    known = {n["nodeId"] for n in graph["nodes"]}
    edges = [e | {"to": [t for t in e["to"] if t in known]} for e in graph["edges"] if e["from"] in known]
    nodes = graph["nodes"] if graph["entry"] in known else [{"nodeId": graph["entry"]}, *graph["nodes"]]
    return graph | {"nodes": nodes, "edges": edges}


def publication_conflicts(published: dict[str, DataFrame], digests: DataFrame, new: dict[str, DataFrame], new_digests: DataFrame) -> DataFrame:
    """``rule, subject`` of what keeps new graphs from being published beside others: the same graph version with another
    digest, or a node version with another signature. The same graph again is no conflict. Digests: KEY, digest."""
    other = new_digests.withColumnRenamed("digest", "now").join(digests, KEY).where("digest <> now")
    signed = ["ref_id", "ref_version"]
    nodes = published["node"].select(*signed, "signature").union(new["node"].select(*signed, "signature")).groupBy(*signed).agg(F.countDistinct("signature").alias("n")).where("n > 1")
    return other.select(F.lit("graph_digest").alias("rule"), F.concat_ws("@", *KEY).alias("subject")).union(nodes.select(F.lit("node_signature"), F.concat_ws("@", *signed))).distinct()


def _node_fields(n: dict) -> dict[str, object]:
    """What a node's comparison looks at, by the name that a change is told by; outcomes stand apart."""
    fields = {k: n.get(k) for k in ("ref", "kind", "input", "outputs", "configuration", "join")} | {"principal.id": n["principal"]["id"], "outcomes.version": n["outcomes"]["version"]}
    fields |= {f"binding.{k}": n.get("binding", {}).get(k) for k in ("bindingId", "version", "bindingDigest")}
    return fields | {f"turn.{k}": n["turn"].get(k) for k in ("leaseMs", "maxAttempts", "idempotency", "retryTaxonomy")}


def diff(spark: SparkSession, old: dict, new: dict) -> DataFrame:
    """``part, id, change, field, was, now`` between two definitions, by part and id: parts added and removed; of kept ones the fields that differ,
    as canonical JSON, and the outcomes added and removed, in their authored order. The order of parts, and of a node's outcomes, is no change."""

    def fields(g: dict) -> list[tuple]:
        rows = [("graph", "graph", k, canon.canonical_json(g[k]), None) for k in ("entry", "description") if k in g]
        for n in g["nodes"]:
            rows += [("node", n["nodeId"], k, canon.canonical_json(v), None) for k, v in _node_fields(n).items() if v is not None]
            rows.append(("node", n["nodeId"], "outcomes", None, list(n["outcomes"]["outcomes"])))
        for e in g["edges"]:
            rows += [("edge", e["edgeId"], k, canon.canonical_json(e[k]), None) for k in ("from", "to", "when")]
            rows.append(("edge", e["edgeId"], "outcomes", None, outcomes(e)))
        return rows + [("terminal", f"{t['nodeId']}:{t['outcome']}", "is", "true", None) for t in g["terminals"]]

    schema = "part string, id string, field string, value string, outcomes array<string>"
    a, b = spark.createDataFrame(fields(old), schema), spark.createDataFrame(fields(new), schema)
    ids = a.select("part", "id").distinct().withColumn("was", F.lit(1)).join(b.select("part", "id").distinct().withColumn("now", F.lit(1)), ["part", "id"], "full_outer")
    nothing = F.lit(None).cast("string")
    whole = ids.where("was is null or now is null").select("part", "id", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"), nothing.alias("field"), nothing.alias("was"), nothing.alias("now"))
    kept = ids.where("was is not null and now is not null").select("part", "id")
    left, right = a.select("part", "id", "field", F.col("value").alias("was"), F.col("outcomes").alias("had")), b.select("part", "id", "field", F.col("value").alias("now"), F.col("outcomes").alias("has"))
    both = left.join(right, ["part", "id", "field"], "full_outer").join(kept, ["part", "id"], "left_semi")
    changed = both.where("field <> 'outcomes'").where(~F.col("was").eqNullSafe(F.col("now"))).select("part", "id", F.lit("changed").alias("change"), "field", "was", "now")
    # array_except keeps the order of its first list
    words = both.where("field = 'outcomes'").select("part", "id", F.array_except("had", "has").alias("gone"), F.array_except("has", "had").alias("come")).where("size(gone) > 0 or size(come) > 0")
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    named = words.select("part", "id", F.lit("changed"), F.lit("outcomes"), listed(F.col("gone")), listed(F.col("come")))
    return whole.union(changed).union(named).orderBy("part", "id", "field")


def goal_violations(graph: dict, manifest: dict) -> list[str]:
    """What keeps a manifest of goals from describing single-entry regions that close once."""
    found: list[str] = []
    nodes = {n["nodeId"]: n for n in graph["nodes"]}
    owner: dict[str, str] = {}
    for goal in manifest["goals"]:
        name, members = goal["goalId"], set(goal["members"])
        found += [f"{name}: unknown member {m}" for m in members - set(nodes)]
        found += [f"{name}: member {m} belongs to {owner[m]}" for m in members & set(owner)]
        owner |= dict.fromkeys(members, name)
        if goal["entry"] not in members:
            found.append(f"{name}: the entry is no member")
        if graph["entry"] in members and graph["entry"] != goal["entry"]:
            found.append(f"{name}: the graph's entry is another member")
        ends = {(r["nodeId"], r["outcome"]): r["kind"] for r in goal["resolutions"]}
        if set(ends.values()) != {"resolved", "escalated"}:
            found.append(f"{name}: both kinds of resolution")
        terminal = {(t["nodeId"], t["outcome"]) for t in graph["terminals"]}
        inner: dict[str, set[str]] = {m: set() for m in members}
        exits: set[str] = set()
        for m in members & set(nodes):
            for o in nodes[m]["outcomes"]["outcomes"]:
                to = [t for e in graph["edges"] if e["from"] == m and o in outcomes(e) for t in e["to"]]
                inside = {t for t in to if t in members}
                if (m, o) in ends:
                    exits |= set(to)
                    if inside:
                        found.append(f"{name}: {m}:{o} resolves and continues inside")
                elif (m, o) in terminal or len(set(to)) != 1 or not inside:
                    found.append(f"{name}: {m}:{o} has to stay inside, at one member")
                inner[m] |= inside
        for e in graph["edges"]:
            for t in e["to"]:
                if t in members and e["from"] not in members and t != goal["entry"]:
                    found.append(f"{name}: {e['edgeId']} enters at {t}")
        reached, todo = set(), [goal["entry"]]
        while todo:
            at = todo.pop()
            if at not in reached and at in inner:
                reached.add(at)
                todo += inner[at]
        found += [f"{name}: {m} isn't reached from the entry" for m in sorted(members - reached)]
        left = dict(inner)
        while free := [m for m in left if not left[m] & set(left)]:
            for m in free:
                del left[m]
        if left:
            found.append(f"{name}: members form a cycle")
        after, todo = set(), list(exits)
        out = {n: [t for _, t in s] for n, s in graphs.successors(graph).items()}
        while todo:
            at = todo.pop()
            if at not in after:
                after.add(at)
                todo += out.get(at, [])
        if after & members:
            found.append(f"{name}: what follows an exit comes back")
    return found


def outcomes(edge: dict) -> list[str]:
    return graphs.outcomes_of(edge["when"])


GOALS = "goal-manifest.v1"


def create_manifest(graph: dict, goals: list[dict]) -> dict:
    """A manifest of goals that hold for a sealed graph, with its seal; goals that don't hold raise."""
    graphs.unseal(graph)
    body = {"schemaVersion": GOALS, "graph": graphs.ref(graph), "goals": goals}
    _goal_shapes(goals)
    if faults := goal_violations(graph, body):
        raise graphs.GraphError("; ".join(faults))
    return body | {"manifestDigest": canon.digest(body)}


def check_manifest(manifest: dict, graph: dict | None = None) -> dict:
    """A sealed manifest whose seal is its own and, with ``graph``, which describes exactly that graph; anything else raises."""
    body = {k: v for k, v in manifest.items() if k != "manifestDigest"}
    if set(body) != {"schemaVersion", "graph", "goals"} or body["schemaVersion"] != GOALS or canon.digest(body) != manifest.get("manifestDigest"):
        raise graphs.GraphError("no goal manifest with its own digest")
    _goal_shapes(body["goals"])
    if graph is not None:
        if graphs.ref(graphs.unseal(graph)) != body["graph"]:
            raise graphs.GraphError("the manifest describes another graph")
        if faults := goal_violations(graph, body):
            raise graphs.GraphError("; ".join(faults))
    return manifest


def _goal_shapes(goals: list[dict]) -> None:
    for g in goals:
        if set(g) - {"description"} != {"goalId", "entry", "members", "resolutions"} or not 1 <= len(g["members"]) <= graphs.MAX_NODES or len(set(g["members"])) != len(g["members"]):
            raise graphs.GraphError("a goal has an id, an entry, different members and resolutions")
        if any(set(r) != {"nodeId", "outcome", "kind"} or r["kind"] not in ("resolved", "escalated") for r in g["resolutions"]):
            raise graphs.GraphError("a resolution is an outcome of a node, resolved or escalated")
    if len({g["goalId"] for g in goals}) != len(goals) or not goals:
        raise graphs.GraphError("goals have different ids")
