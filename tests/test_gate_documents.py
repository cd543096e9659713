"""Gate documents, compiled flows and their certificates."""

import pytest

from pathloom.functions import canon
from pathloom.plans import gate_documents as g
from pathloom.plans import gates
from pathloom.plans.documents import DocumentError

HERE = {"id": "impl", "version": 1, "digest": "a" * 64}
CHECKER = {"id": "checker", "version": 1, "digest": "b" * 64}


def documents():
    goal = g.create("gate-goal-definition.v1", {"id": "refund", "version": 1, "description": "Refunds.", "question": "Is it due?", "inputContract": "case.v1", "decisionContract": "decision.v1", "decisionCodes": ["due", "not-due"]})
    objective = g.create("gate-objective-definition.v1", {
        "id": "few-misses", "version": 1, "description": "Few misses.", "goal": g.ref(goal), "targetDecisionCode": "due", "primary": {"metric": "recall", "direction": "maximize", "threshold": 0.9},
        "guardrails": [{"metric": "precision", "direction": "maximize", "threshold": 0.5}], "evidenceGate": {"minimumPositiveLabels": 5, "minimumNegativeLabels": 5, "minimumTotalLabels": 10, "confidenceLevel": 0.95},
        "abstention": {"disposition": "human_escalation", "reasonCode": "unsure"},
    })
    validity = g.create("gate-validity-policy.v1", {"id": "valid", "version": 1, "description": "What counts.", "goal": g.ref(goal), "validatorImplementation": CHECKER, "requiredChecks": ["output_contract", "decision_code"], "failureReasonCode": "invalid"})
    tier = lambda name, n, ms, tokens, cost: {"tierId": name, "maxAttempts": n, "timeoutMs": ms, "maxTokensPerAttempt": tokens, "maxCostMicroUsdPerAttempt": cost}
    limits = dict(zip(g.BOUNDS, (10, 10, 10, 10_000, 10_000, 600_000), strict=True))
    budget = g.create("gate-budget-policy.v1", {"id": "cheap", "version": 1, "description": "Little.", "tiers": [tier("free", 1, 1000, 0, 0), tier("small", 2, 20_000, 800, 400)], "limits": limits})
    word = lambda code, kind: {"code": code, "kind": kind, "description": code}
    step = lambda name, kind, level, tier, takes, gives, impl, *codes: {"kind": kind, "stepId": name, "levelId": level, "implementation": impl, "budgetTierId": tier, "inputContract": takes, "outputContract": gives, "outcomes": list(codes)}
    flow = g.create("gate-flow-definition.v1", {
        "id": "refunds", "version": 1, "description": "Rules first.", "goal": g.ref(goal), "objectives": [g.ref(objective)], "validityPolicy": g.ref(validity), "budgetPolicy": g.ref(budget), "entryStepId": "rules",
        "levels": [{"levelId": "low", "ordinal": 0, "description": "rules"}, {"levelId": "high", "ordinal": 3, "description": "models"}],
        "steps": [
            step("verify", "validator", "high", "free", "draft.v1", "decision.v1", CHECKER, word("valid", "success"), word("invalid", "failure")),
            step("rules", "deterministic", "low", "free", "case.v1", "draft.v1", HERE, word("clear", "success"), word("broken", "failure")),
            step("judge", "model", "high", "small", "draft.v1", "draft.v1", HERE, word("judged", "success"), word("failed", "failure")) | {"binding": {"bindingDigest": "c" * 64}},
            step("check", "validator", "low", "free", "draft.v1", "decision.v1", CHECKER, word("fine", "success"), word("doubt", "uncertain"), word("odd", "failure")),
        ],
        "transitions": [
            {"kind": "human_escalation", "sourceStepId": "verify", "outcomeCode": "invalid", "reasonCode": "invalid"}, {"kind": "valid_decision", "sourceStepId": "verify", "outcomeCode": "valid", "decisionContract": "decision.v1"},
            {"kind": "advance", "sourceStepId": "rules", "outcomeCode": "clear", "targetStepId": "check"}, {"kind": "internal_escalation", "sourceStepId": "rules", "outcomeCode": "broken", "targetStepId": "judge"},
            {"kind": "valid_decision", "sourceStepId": "check", "outcomeCode": "fine", "decisionContract": "decision.v1"}, {"kind": "human_escalation", "sourceStepId": "check", "outcomeCode": "doubt", "reasonCode": "doubt"},
            {"kind": "human_escalation", "sourceStepId": "check", "outcomeCode": "odd", "reasonCode": "odd"}, {"kind": "advance", "sourceStepId": "judge", "outcomeCode": "judged", "targetStepId": "verify"},
            {"kind": "human_escalation", "sourceStepId": "judge", "outcomeCode": "failed", "reasonCode": "failed"},
        ],
    })
    return flow, goal, [objective], validity, budget


def test_compiled_flow():
    flow, goal, objectives, validity, budget = documents()
    made = g.compile_documents(flow, goal, objectives, validity, budget)
    assert g.check_compiled(made) == made
    assert [s["stepId"] for s in made["steps"]][0] == "rules" and made["terminationCertificate"]["proof"]["terminalTransitionCount"] == 6
    bounds = made["terminationCertificate"]["proof"]["bounds"]
    assert bounds == {"maximumPathSteps": 3, "maximumModelCalls": 2, "maximumAttempts": 4, "maximumTokens": 1600, "maximumCostMicroUsd": 800, "maximumElapsedMs": 42_000}
    place = {s["stepId"]: k for k, s in enumerate(made["steps"])}
    assert [place[t["sourceStepId"]] for t in made["transitions"]] == sorted(place[t["sourceStepId"]] for t in made["transitions"])
    assert [t["outcomeCode"] for t in made["transitions"] if t["sourceStepId"] == "check"] == ["fine", "doubt", "odd"]
    for path, value in ((("compiledDigest",), "0" * 64), (("entryStepId",), "judge"), (("terminationCertificate", "proof", "acyclic"), False), (("terminationCertificate", "proof", "stepCount"), 9), (("decisionCodes",), [])):
        broken = canon.json.loads(canon.json.dumps(made))
        at = broken
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(DocumentError):
            g.check_compiled(broken)


def test_documents_are_closed_and_sealed():
    for doc in (lambda d: [*d[:2], *d[2], *d[3:]])(documents()):
        kind, seal = doc["schemaVersion"], g.KINDS[doc["schemaVersion"]][0]
        assert g.check(doc, kind) == doc and g.ref(doc)["digest"] == doc[seal]
        with pytest.raises(DocumentError):
            g.check(doc | {"description": "other"})
        body = {k: v for k, v in doc.items() if k not in ("schemaVersion", seal)}
        for bad in (body | {"extra": 1}, {k: v for k, v in body.items() if k != "version"}, body | {"id": "Not An Id"}, body | {"description": " "}):
            with pytest.raises(DocumentError):
                g.create(kind, bad)


@pytest.mark.parametrize("change", [{"primary": {"metric": "recall", "direction": "minimize"}}, {"guardrails": []}, {"guardrails": [{"metric": "recall", "direction": "maximize", "threshold": 0.5}]}, {"evidenceGate": {"minimumPositiveLabels": 9, "minimumNegativeLabels": 9, "minimumTotalLabels": 10, "confidenceLevel": 0.95}}, {"abstention": {"disposition": "guess", "reasonCode": "x"}}])
def test_objectives_cant_be_gamed(change):
    body = {k: v for k, v in documents()[2][0].items() if k not in ("schemaVersion", "objectiveDigest")}
    with pytest.raises(DocumentError):
        g.create("gate-objective-definition.v1", body | change)


def test_what_keeps_a_flow_from_compiling():
    flow, goal, objectives, validity, budget = documents()
    again = lambda **parts: g.create("gate-flow-definition.v1", {k: v for k, v in flow.items() if k not in ("schemaVersion", "flowDigest")} | parts)
    move = lambda k, **parts: again(transitions=[t | parts if n == k else t for n, t in enumerate(flow["transitions"])])
    step = lambda k, **parts: again(steps=[s | parts if n == k else s for n, s in enumerate(flow["steps"])])
    flows = [
        move(2, targetStepId="judge"), move(3, targetStepId="check"), move(3, targetStepId="nowhere"), move(1, decisionContract="other.v1"), again(entryStepId="judge"), again(transitions=flow["transitions"][1:]), again(transitions=[*flow["transitions"], flow["transitions"][0]]),
        step(0, implementation=HERE), step(0, inputContract="other.v1"), step(1, budgetTierId="small"), step(1, levelId="nowhere"), step(3, outputContract="draft.v1"), again(goal=HERE), again(objectives=[HERE]), move(7, targetStepId="judge"),
    ]
    for k, broken in enumerate(flows):
        with pytest.raises(gates.GateError):
            g.compile_documents(broken, goal, objectives, validity, budget)
            raise AssertionError(k)
    tight = g.create("gate-budget-policy.v1", {k: v for k, v in budget.items() if k not in ("schemaVersion", "policyDigest")} | {"limits": budget["limits"] | {"maximumTokens": 1599}})
    with pytest.raises(gates.GateError):
        g.compile_documents(again(budgetPolicy=g.ref(tight)), goal, objectives, validity, tight)
