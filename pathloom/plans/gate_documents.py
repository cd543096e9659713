"""Gates as sealed documents: goals, objectives, validity and budget policies, flows; the flow compiled with the certificate that it ends.

A document's fields are declared in ``KINDS``; what fields say of each other stands in ``RULES``. Bounds and words are fixed values of the
document language.
"""

from __future__ import annotations

from collections.abc import Callable

from pathloom.functions import canon
from pathloom.plans import gates
from pathloom.plans.documents import Check, DocumentError, _passes, contract, identifier, is_ref, one_of, text, version, whole

METRICS = {"false_negative_rate": "minimize", "false_positive_rate": "minimize", "recall": "maximize", "precision": "maximize", "specificity": "maximize", "accuracy": "maximize", "human_escalation_rate": "minimize"}
CHECKS = ("output_contract", "decision_code", "evidence_authority", "source_freshness", "objective_guardrails")
STEP_KINDS, OUTCOME_KINDS = ("deterministic", "model", "validator"), ("success", "failure", "uncertain")
#: What a flow may cost at most, by the names of documents and of ``gates.COSTS``.
BOUNDS = {"maximumPathSteps": (1, 100), "maximumModelCalls": (0, 100), "maximumAttempts": (1, 1000), "maximumTokens": (0, 1_000_000), "maximumCostMicroUsd": (0, canon.MAX_SAFE), "maximumElapsedMs": (1000, 86_400_000)}
TIER = {"maxAttempts": (1, 20), "timeoutMs": (100, 3_600_000), "maxTokensPerAttempt": (0, 2_000_000), "maxCostMicroUsdPerAttempt": (0, 1_000_000_000_000)}
FLAGS = ("acyclic", "exhaustiveOutcomes", "humanFallbackForFailureOutcomes", "escalationStrictlyIncreasesLevel", "validDecisionRequiresValidator")
COMPILER, COMPILED, CERTIFICATE = "gate-flow-compiler.v1", "compiled-gate-flow.v1", "gate-termination-certificate.v1"


def share(least: float = 0.0, most: float = 1.0) -> Check:
    return lambda x: isinstance(x, int | float) and not isinstance(x, bool) and least <= x <= most


def record(required: dict[str, Check], optional: dict[str, Check] | None = None) -> Check:
    return lambda x: _passes(x, required, optional or {})


def listed(least: int, most: int, each: Check, by: Callable[[object], object] | None = None) -> Check:
    """A list of so many members, each sound, different by ``by``."""
    return lambda x: isinstance(x, list) and least <= len(x) <= most and all(map(each, x)) and (by is None or len({canon.digest(by(m)) for m in x}) == len(x))


def trimmed(most: int) -> Check:
    return lambda x: text(1, most)(x) and x == x.strip()


def _numbers(bounds: dict[str, tuple[int, int]]) -> dict[str, Check]:
    return {k: whole(*b) for k, b in bounds.items()}


bounds_of = record(_numbers(BOUNDS))
_outcome = record({"code": identifier, "kind": one_of(*OUTCOME_KINDS), "description": trimmed(500)})
_step = {
    "kind": one_of(*STEP_KINDS), "stepId": identifier, "levelId": identifier, "implementation": is_ref, "budgetTierId": identifier, "inputContract": contract, "outputContract": contract,
    "outcomes": listed(2, 32, _outcome, lambda o: o["code"]),
}
_common = {"sourceStepId": identifier, "outcomeCode": identifier}
_ends = {"advance": {"targetStepId": identifier}, "internal_escalation": {"targetStepId": identifier}, "valid_decision": {"decisionContract": contract}, "human_escalation": {"reasonCode": identifier}}


def is_step(x: object) -> bool:
    """A step; a model's has its binding, and every step can fail."""
    more = {"binding": lambda b: isinstance(b, dict) and "bindingDigest" in b} if isinstance(x, dict) and x.get("kind") == "model" else {}
    return _passes(x, _step | more, {}) and any(o["kind"] == "failure" for o in x["outcomes"])


def is_transition(x: object) -> bool:
    return isinstance(x, dict) and x.get("kind") in _ends and _passes(x, {"kind": one_of(*_ends)} | _common | _ends[x["kind"]], {})


_head = {"id": identifier, "version": version, "description": trimmed(1000)}
_metric = {"metric": one_of(*METRICS), "direction": one_of("minimize", "maximize")}
#: Of each kind: its seal and its fields.
KINDS: dict[str, tuple[str, dict[str, Check]]] = {
    "gate-goal-definition.v1": ("goalDigest", _head | {"question": trimmed(1000), "inputContract": contract, "decisionContract": contract, "decisionCodes": listed(1, 64, identifier, lambda c: c)}),
    "gate-objective-definition.v1": ("objectiveDigest", _head | {
        "goal": is_ref, "targetDecisionCode": identifier, "primary": record(_metric, {"threshold": share()}), "guardrails": listed(1, 16, record(_metric | {"threshold": share()}), lambda g: g["metric"]),
        "evidenceGate": record({"minimumPositiveLabels": whole(1, 1_000_000), "minimumNegativeLabels": whole(1, 1_000_000), "minimumTotalLabels": whole(2, 2_000_000), "confidenceLevel": share(0.5, 0.9999)}),
        "abstention": record({"disposition": one_of("human_escalation"), "reasonCode": identifier}),
    }),
    "gate-validity-policy.v1": ("policyDigest", _head | {"goal": is_ref, "validatorImplementation": is_ref, "requiredChecks": listed(1, len(CHECKS), one_of(*CHECKS), lambda c: c), "failureReasonCode": identifier}),
    "gate-budget-policy.v1": ("policyDigest", _head | {"tiers": listed(1, 64, record({"tierId": identifier} | _numbers(TIER)), lambda t: t["tierId"]), "limits": bounds_of}),
    "gate-flow-definition.v1": ("flowDigest", _head | {
        "goal": is_ref, "objectives": listed(1, 32, is_ref, lambda r: r), "validityPolicy": is_ref, "budgetPolicy": is_ref, "entryStepId": identifier,
        "levels": listed(1, 32, record({"levelId": identifier, "ordinal": whole(0, 255), "description": trimmed(500)}), lambda v: v["levelId"]),
        "steps": listed(1, 128, is_step, lambda s: s["stepId"]), "transitions": listed(2, 4096, is_transition),
    }),
}


def _objective(o: dict) -> str | None:
    if any(METRICS[m["metric"]] != m["direction"] for m in (o["primary"], *o["guardrails"])):
        return "a metric has its own direction"
    if o["primary"]["metric"] in {g["metric"] for g in o["guardrails"]}:
        return "the primary metric is no guardrail"
    e = o["evidenceGate"]
    return "labels in total cover both kinds" if e["minimumTotalLabels"] < e["minimumPositiveLabels"] + e["minimumNegativeLabels"] else None


RULES: dict[str, Callable[[dict], str | None]] = {
    "gate-objective-definition.v1": _objective,
    "gate-flow-definition.v1": lambda f: "levels have different ordinals" if len({v["ordinal"] for v in f["levels"]}) < len(f["levels"]) else None,
}


def create(kind: str, body: dict) -> dict:
    """A document of a kind with its seal."""
    at, fields = KINDS[kind]
    if missing := [f for f in fields if f not in body]:
        raise DocumentError(f"{kind} lacks {missing}")
    if odd := [f for f in body if f not in fields]:
        raise DocumentError(f"{kind} has unknown fields {odd}")
    if wrong := [f for f, ok in fields.items() if not ok(body[f])]:
        raise DocumentError(f"{kind}: {wrong} not allowed")
    if fault := RULES.get(kind, lambda _: None)(body):
        raise DocumentError(f"{kind}: {fault}")
    sealed = {"schemaVersion": kind} | body
    return sealed | {at: canon.digest(sealed)}


def check(document: dict, kind: str | None = None) -> dict:
    """A sealed document whose seal is its own; anything else raises."""
    found = document.get("schemaVersion")
    if found not in KINDS or (kind and found != kind):
        raise DocumentError(f"no {kind or 'gate document'}: {found!r}")
    at = KINDS[found][0]
    if create(found, {k: v for k, v in document.items() if k not in ("schemaVersion", at)})[at] != document.get(at):
        raise DocumentError(f"{found}: digest mismatch")
    return document


def ref(document: dict) -> dict:
    return {"id": document["id"], "version": document["version"], "digest": document[KINDS[document["schemaVersion"]][0]]}


def _plain(flow: dict, budget: dict) -> dict:
    """The flow as ``gates.compile_flow`` reads it."""
    words = {"valid_decision": "decision", "human_escalation": "human"}
    step = lambda s: {"step_id": s["stepId"], "level_id": s["levelId"], "kind": s["kind"], "budget_tier_id": s["budgetTierId"], "outcomes": s["outcomes"]}
    move = lambda t: {"kind": words.get(t["kind"], t["kind"]), "source_step_id": t["sourceStepId"], "outcome_code": t["outcomeCode"]} | ({"target_step_id": t["targetStepId"]} if "targetStepId" in t else {})
    tier = lambda t: {"max_attempts": t["maxAttempts"], "timeout_ms": t["timeoutMs"], "max_tokens_per_attempt": t["maxTokensPerAttempt"], "max_cost_micro_usd_per_attempt": t["maxCostMicroUsdPerAttempt"]}
    limits = dict(zip(gates.COSTS, (budget["limits"][k] for k in BOUNDS), strict=True))
    return {
        "entry": flow["entryStepId"], "levels": {v["levelId"]: v["ordinal"] for v in flow["levels"]}, "tiers": {t["tierId"]: tier(t) for t in budget["tiers"]}, "limits": limits,
        "steps": [step(s) for s in flow["steps"]], "transitions": [move(t) for t in flow["transitions"]],
    }


def compile_documents(flow: dict, goal: dict, objectives: list[dict], validity: dict, budget: dict) -> dict:
    """A flow compiled against the very documents that it names: steps in topological order, transitions by step and outcome, worst-case
    bounds within the budget, the certificate that it ends, all sealed."""
    check(flow, "gate-flow-definition.v1"), check(goal, "gate-goal-definition.v1"), check(validity, "gate-validity-policy.v1"), check(budget, "gate-budget-policy.v1")
    refs = {canon.digest(ref(check(o, "gate-objective-definition.v1"))): o for o in objectives}
    need = lambda ok, what: None if ok else _refuse(what)
    need(flow["goal"] == ref(goal) == validity["goal"], "flow and validity policy name the goal")
    need(flow["validityPolicy"] == ref(validity) and flow["budgetPolicy"] == ref(budget), "the flow names its policies")
    need(len(refs) == len(objectives) and set(refs) == {canon.digest(r) for r in flow["objectives"]}, "exactly the flow's objectives")
    for o in objectives:
        need(o["goal"] == ref(goal) and o["targetDecisionCode"] in goal["decisionCodes"], f"objective {o['id']} is of the goal")
    steps, levels, tiers = ({x[k]: x for x in xs} for xs, k in ((flow["steps"], "stepId"), (flow["levels"], "levelId"), (budget["tiers"], "tierId")))
    need(flow["entryStepId"] in steps and steps[flow["entryStepId"]]["inputContract"] == goal["inputContract"], "the entry takes the goal's input")
    for s in steps.values():
        need(s["levelId"] in levels and s["budgetTierId"] in tiers, f"{s['stepId']}: its level and tier are known")
    for t in flow["transitions"]:
        source = steps.get(t["sourceStepId"])
        need(source is not None and t["outcomeCode"] in {o["code"] for o in source["outcomes"]}, f"{t['sourceStepId']}.{t['outcomeCode']} is an outcome")
        if "targetStepId" in t:
            need(t["targetStepId"] in steps and steps[t["targetStepId"]]["inputContract"] == source["outputContract"], f"{t['sourceStepId']}: its target takes its output")
        elif t["kind"] == "valid_decision":
            need(source["implementation"] == validity["validatorImplementation"], f"{t['sourceStepId']} is the policy's validator")
            need(source["outputContract"] == t["decisionContract"] == goal["decisionContract"], f"{t['sourceStepId']} emits the goal's decision")
    found = gates.compile_flow(_plain(flow, budget))
    place = {s: k for k, s in enumerate(found["order"])}
    outcome = {(s, o["code"]): k for s in steps for k, o in enumerate(steps[s]["outcomes"])}
    moves = sorted(flow["transitions"], key=lambda t: (place[t["sourceStepId"]], outcome[t["sourceStepId"], t["outcomeCode"]]))
    named = {"flow": ref(flow), "goal": ref(goal), "objectives": flow["objectives"], "validityPolicy": ref(validity), "budgetPolicy": ref(budget)}
    proof = {
        "entryStepId": flow["entryStepId"], "stepCount": len(steps), "transitionCount": len(moves), "terminalTransitionCount": sum("targetStepId" not in t for t in moves), "reachableStepCount": len(steps),
        **dict.fromkeys(FLAGS, True), "bounds": dict(zip(BOUNDS, (found["bounds"][c] for c in gates.COSTS), strict=True)),
    }
    certificate = {"schemaVersion": CERTIFICATE, "compilerVersion": COMPILER} | named | {"proof": proof}
    certificate["certificateDigest"] = canon.digest(certificate)
    compiled = {"schemaVersion": COMPILED, "compilerVersion": COMPILER} | named | {k: goal[k] for k in ("inputContract", "decisionContract", "decisionCodes")} | {
        "entryStepId": flow["entryStepId"], "steps": [steps[s] | {"level": {k: levels[steps[s]["levelId"]][k] for k in ("levelId", "ordinal")}, "tier": tiers[steps[s]["budgetTierId"]]} for s in found["order"]],
        "transitions": moves, "terminationCertificate": check_certificate(certificate),
    }
    return compiled | {"compiledDigest": canon.digest(compiled)}


def _refuse(what: str) -> None:
    raise gates.GateError(f"not so: {what}")


def check_certificate(certificate: dict) -> dict:
    """A certificate with every flag literally true, counts and bounds in range, and its own digest; anything else raises."""
    counts = ("stepCount", "transitionCount", "terminalTransitionCount", "reachableStepCount")
    proof = {"entryStepId": identifier, **dict.fromkeys(counts, whole(1, canon.MAX_SAFE)), "bounds": bounds_of, **dict.fromkeys(FLAGS, lambda x: x is True)}
    refs = dict.fromkeys(("flow", "goal", "validityPolicy", "budgetPolicy"), is_ref) | {"objectives": listed(1, 32, is_ref)}
    fields = {"schemaVersion": one_of(CERTIFICATE), "compilerVersion": one_of(COMPILER), **refs, "proof": record(proof), "certificateDigest": lambda _: True}
    if not _passes(certificate, fields, {}) or certificate["proof"]["terminalTransitionCount"] < 2:
        raise DocumentError("a certificate proves every flag, with at least a decision and a person at the end")
    if canon.digest({k: v for k, v in certificate.items() if k != "certificateDigest"}) != certificate["certificateDigest"]:
        raise DocumentError("the certificate's digest mismatch")
    return certificate


def check_compiled(compiled: dict) -> dict:
    """A compiled flow whose steps, transitions, certificate and digest are sound; anything else raises."""
    refs = dict.fromkeys(("flow", "goal", "validityPolicy", "budgetPolicy"), is_ref) | {"objectives": listed(1, 32, is_ref)}
    step = lambda s: isinstance(s, dict) and is_step({k: v for k, v in s.items() if k not in ("level", "tier")}) and {"level", "tier"} <= set(s)
    fields = {
        "schemaVersion": one_of(COMPILED), "compilerVersion": one_of(COMPILER), **refs, "inputContract": contract, "decisionContract": contract, "decisionCodes": listed(1, 64, identifier), "entryStepId": identifier,
        "steps": listed(1, 128, step), "transitions": listed(2, 4096, is_transition), "terminationCertificate": lambda c: bool(check_certificate(c)), "compiledDigest": lambda _: True,
    }
    if not _passes(compiled, fields, {}):
        raise DocumentError("no compiled gate flow")
    if canon.digest({k: v for k, v in compiled.items() if k != "compiledDigest"}) != compiled["compiledDigest"]:
        raise DocumentError("the compiled flow's digest mismatch")
    return compiled
