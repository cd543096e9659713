"""DuckDB SQL of the queries on graphs: the example definitions as literal tables, rules and walks over them in SQL."""

from __future__ import annotations

import json

from pathloom.functions import canon
from pathloom.plans.examples import GATE, PICKING, PICKING_BROKEN, PICKING_OLD


def _value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool | int):
        return str(x).upper()
    return "'" + str(x).replace("'", "''") + "'"


def literal(head: str, rows: list[tuple]) -> str:
    return f"{head} AS (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)})"


def _named(edge: dict) -> list[str]:
    return edge["when"].get("anyOf") or [edge["when"]["outcome"]]


def _arcs(graphs: list[dict]) -> str:
    return literal("arc(v, edge_id, source, target)", [(g["version"], e["edgeId"], e["from"], t) for g in graphs for e in g["edges"] for t in e["to"]])


def _violations(graphs: list[dict]) -> str:
    nodes = [(g["version"], n) for g in graphs for n in g["nodes"]]
    joins = [(v, n, n["join"]) for v, n in nodes if "join" in n]
    sign = lambda n: json.dumps([n["kind"], n["input"], sorted(n["outcomes"]["outcomes"]), n.get("outputs", {})], sort_keys=True)
    tables = [
        literal("graph(v, name, entry)", [(g["version"], g["graphId"], g["entry"]) for g in graphs]),
        literal("node(v, node_id, ref, kind, input, bound, signature, principal)", [(v, n["nodeId"], f"{n['ref']['id']}@{n['ref']['version']}", n["kind"], n["input"], "binding" in n, sign(n), n["principal"]["id"]) for v, n in nodes]),
        literal("edited(v)", [(g["version"],) for g in graphs if "edited" in g.get("description", "")] or [(-1,)]),
        literal("joining(v, node_id, n_of, envelope)", [(v, n["nodeId"], None if j["require"] == "all" else j["require"]["nOf"], j.get("compose") == "envelope") for v, n, j in joins]),
        literal("inbound(v, node_id, edge_id)", [(v, n["nodeId"], e) for v, n, j in joins for e in j["inbound"]]),
        literal("outcome(v, node_id, outcome, made)", [(v, n["nodeId"], o, n.get("outputs", {}).get(o)) for v, n in nodes for o in n["outcomes"]["outcomes"]]),
        literal("named(v, edge_id, source, outcome, always)", [(g["version"], e["edgeId"], e["from"], o, "where" not in e["when"]) for g in graphs for e in g["edges"] for o in _named(e)]),
        _arcs(graphs),
        literal("terminal(v, node_id, outcome)", [(g["version"], t["nodeId"], t["outcome"]) for g in graphs for t in g["terminals"]]),
    ]
    return f"""WITH RECURSIVE {', '.join(tables)},
reached(v, node_id) AS (SELECT v, entry FROM graph UNION SELECT a.v, a.target FROM reached r JOIN arc a ON a.v = r.v AND a.source = r.node_id JOIN node n ON n.v = a.v AND n.node_id = a.target),
covered AS (SELECT v, source AS node_id, outcome FROM named WHERE always UNION SELECT * FROM terminal),
signed AS (SELECT v, ref FROM node GROUP BY ALL HAVING count(DISTINCT signature) > 1),
entering AS (SELECT a.v, a.target AS node_id, a.edge_id FROM arc a JOIN joining USING (v) WHERE joining.node_id = a.target),
found(v, rule, subject) AS (
SELECT v, 'unknown_entry', entry FROM graph g WHERE NOT EXISTS (FROM node n WHERE n.v = g.v AND node_id = entry)
UNION SELECT v, 'unknown_source', edge_id FROM named e WHERE NOT EXISTS (FROM node n WHERE n.v = e.v AND node_id = source)
UNION SELECT v, 'unknown_target', edge_id FROM arc a WHERE NOT EXISTS (FROM node n WHERE n.v = a.v AND node_id = target)
UNION SELECT v, 'unknown_terminal', node_id || ':' || outcome FROM terminal t WHERE NOT EXISTS (FROM outcome o WHERE o.v = t.v AND o.node_id = t.node_id AND o.outcome = t.outcome)
UNION SELECT v, 'undeclared_outcome', edge_id FROM named e WHERE NOT EXISTS (FROM outcome o WHERE o.v = e.v AND o.node_id = source AND o.outcome = e.outcome)
UNION SELECT e.v, 'contract_mismatch', e.edge_id FROM named e JOIN node s ON s.v = e.v AND s.node_id = e.source LEFT JOIN outcome o ON o.v = e.v AND o.node_id = e.source AND o.outcome = e.outcome
  JOIN arc a ON a.v = e.v AND a.edge_id = e.edge_id JOIN node t ON t.v = a.v AND t.node_id = a.target LEFT JOIN joining j ON j.v = a.v AND j.node_id = a.target
  WHERE NOT coalesce(j.envelope, FALSE) AND t.input <> CASE WHEN e.outcome = 'join_unsatisfiable' THEN 'join-unsatisfiable.v1' ELSE coalesce(CAST(o.made AS VARCHAR), s.input) END
UNION SELECT v, 'model_without_binding', node_id FROM node WHERE kind = 'model' AND NOT bound
UNION SELECT v, 'binding_on_other_kind', node_id FROM node WHERE kind <> 'model' AND bound
UNION SELECT v, 'engine_principal', node_id FROM node WHERE principal = 'engine'
UNION SELECT v, 'envelope_input', node_id FROM node JOIN joining USING (v, node_id) WHERE envelope AND input <> 'join-input.v1'
UNION SELECT v, 'other_expansion', name FROM graph JOIN edited USING (v)
UNION SELECT v, 'reserved_outcome', node_id FROM outcome WHERE outcome = 'join_unsatisfiable' AND (v, node_id) NOT IN (SELECT (v, node_id) FROM joining)
UNION SELECT v, 'join_without_unsatisfiable', node_id FROM joining WHERE (v, node_id) NOT IN (SELECT (v, node_id) FROM outcome WHERE outcome = 'join_unsatisfiable')
UNION SELECT v, 'entry_is_join', node_id FROM joining JOIN graph USING (v) WHERE node_id = entry
UNION SELECT v, 'signature_conflict', node_id FROM node JOIN signed USING (v, ref)
UNION SELECT v, 'join_inbound', node_id FROM inbound FULL JOIN entering USING (v, node_id, edge_id) WHERE inbound.v IS NULL OR entering.v IS NULL
UNION SELECT v, 'join_bound', node_id FROM joining j WHERE n_of > (SELECT count(*) FROM inbound i WHERE i.v = j.v AND i.node_id = j.node_id)
UNION SELECT t.v, 'terminal_and_routed', t.node_id || ':' || t.outcome FROM terminal t JOIN named e ON e.v = t.v AND e.source = t.node_id AND e.outcome = t.outcome
UNION SELECT v, 'uncovered_outcome', node_id || ':' || outcome FROM outcome WHERE (v, node_id, outcome) NOT IN (SELECT (v, node_id, outcome) FROM covered)
UNION SELECT v, 'unreachable', node_id FROM node WHERE (v, node_id) NOT IN (SELECT (v, node_id) FROM reached))
SELECT name AS graph_id, CAST(v AS BIGINT) AS version, rule, subject FROM found JOIN graph USING (v)"""


def _budget(graph: dict) -> str:
    return f"""WITH RECURSIVE {literal("node(node_id, is_join, attempts)", [(n["nodeId"], "join" in n, n["turn"]["maxAttempts"]) for n in graph["nodes"]])}, {_arcs([graph])},
step AS (SELECT DISTINCT source, target, is_join FROM arc JOIN node ON node_id = target),
walk(node_id, depth) AS (SELECT '{graph["entry"]}', 0 UNION SELECT target, depth + 1 FROM walk JOIN step ON source = node_id),
pass(node_id, way) AS (SELECT node_id, node_id FROM node WHERE is_join OR node_id = '{graph["entry"]}' UNION ALL SELECT target, way || '>' || target FROM pass JOIN step ON source = node_id WHERE NOT is_join)
SELECT node_id, (SELECT max(depth) FROM walk w WHERE w.node_id = n.node_id) AS depth, (SELECT count(*) FROM pass p WHERE p.node_id = n.node_id) AS occurrences,
  attempts * (SELECT count(*) FROM pass p WHERE p.node_id = n.node_id) AS turns FROM node n"""


def _parts(head: str, graph: dict) -> str:
    rows = [("graph", "graph", k, canon.canonical_json(graph[k])) for k in ("entry", "description")] + [("terminal", f"{t['nodeId']}:{t['outcome']}", "is", "true") for t in graph["terminals"]]
    for n in graph["nodes"]:
        flat = {k: n[k] for k in ("ref", "kind", "input", "outputs", "configuration", "join") if k in n} | {f"turn.{k}": v for k, v in n["turn"].items()} | {f"binding.{k}": n["binding"][k] for k in ("bindingId", "version", "bindingDigest") if "binding" in n}
        flat |= {"principal.id": n["principal"]["id"], "outcomes.version": n["outcomes"]["version"]}
        rows += [("node", n["nodeId"], k, canon.canonical_json(v)) for k, v in flat.items()]
    for e in graph["edges"]:
        rows += [("edge", e["edgeId"], k, canon.canonical_json(e[k])) for k in ("from", "to", "when")]
    return literal(f"{head}(part, id, field, value)", rows)


def _words(head: str, graph: dict) -> str:
    rows = [("node", n["nodeId"], k, o) for n in graph["nodes"] for k, o in enumerate(n["outcomes"]["outcomes"])]
    return literal(f"{head}(part, id, place, word)", rows + [("edge", e["edgeId"], k, o) for e in graph["edges"] for k, o in enumerate(_named(e))])


def _diff(old: dict, new: dict) -> str:
    return f"""WITH {_parts("a", old)}, {_parts("b", new)}, {_words("v", old)}, {_words("w", new)}, was AS (SELECT DISTINCT part, id FROM a), now AS (SELECT DISTINCT part, id FROM b),
lost AS (SELECT part, id, string_agg(word, ',' ORDER BY place) AS words FROM v ANTI JOIN w USING (part, id, word) SEMI JOIN now USING (part, id) GROUP BY ALL),
come AS (SELECT part, id, string_agg(word, ',' ORDER BY place) AS words FROM w ANTI JOIN v USING (part, id, word) SEMI JOIN was USING (part, id) GROUP BY ALL)
SELECT part, id, 'removed' AS change, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS VARCHAR) AS now FROM was ANTI JOIN now USING (part, id)
UNION ALL SELECT part, id, 'added', NULL, NULL, NULL FROM now ANTI JOIN was USING (part, id)
UNION ALL SELECT part, id, 'changed', field, a.value, b.value FROM a FULL JOIN b USING (part, id, field) SEMI JOIN was USING (part, id) SEMI JOIN now USING (part, id) WHERE a.value IS DISTINCT FROM b.value
UNION ALL SELECT part, id, 'changed', 'outcomes', lost.words, come.words FROM lost FULL JOIN come USING (part, id)"""


def _bounds(flow: dict) -> str:
    tiers = [(s["step_id"], s["kind"] == "model", *(flow["tiers"][s["budget_tier_id"]][k] for k in ("max_attempts", "timeout_ms", "max_tokens_per_attempt", "max_cost_micro_usd_per_attempt"))) for s in flow["steps"]]
    return f"""WITH RECURSIVE {literal("tier(step_id, model, n, ms, tokens, usd)", tiers)}, {literal("move(source, kind, target)", [(t["source_step_id"], t["kind"], t.get("target_step_id")) for t in flow["transitions"]])},
cost AS (SELECT step_id, 1 AS steps, CAST(model AS INT) * n AS model_calls, n AS attempts, CAST(model AS INT) * n * tokens AS tokens, CAST(model AS INT) * n * usd AS cost_micro_usd, n * ms AS elapsed_ms FROM tier),
way AS (SELECT * FROM cost WHERE step_id = '{flow["entry"]}' UNION ALL SELECT c.step_id, w.steps + c.steps, w.model_calls + c.model_calls, w.attempts + c.attempts, w.tokens + c.tokens, w.cost_micro_usd + c.cost_micro_usd, w.elapsed_ms + c.elapsed_ms
  FROM way w JOIN move m ON m.source = w.step_id JOIN cost c ON c.step_id = m.target),
most AS (SELECT max(steps) AS steps, max(model_calls) AS model_calls, max(attempts) AS attempts, max(tokens) AS tokens, max(cost_micro_usd) AS cost_micro_usd, max(elapsed_ms) AS elapsed_ms
  FROM way JOIN move ON source = step_id WHERE kind IN ('decision', 'human'))
SELECT bound, CAST(most AS BIGINT) AS most FROM (UNPIVOT most ON COLUMNS(*) INTO NAME bound VALUE most)"""


TURN_BUDGET = _budget(PICKING_OLD)
GRAPH_VIOLATIONS = _violations(PICKING_BROKEN)
GRAPH_DIFF = _diff(PICKING_OLD, PICKING)
GATE_BOUNDS = _bounds(GATE)
