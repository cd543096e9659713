"""Bodies of nodes as vectorized functions, with what their completions have to be."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import columns

COMPLETION = "outcome string, output_json string, error_message string"


def run_code(turns: DataFrame, bodies: dict[str, Callable[[str | None], tuple[str, str | None]]]) -> DataFrame:
    """Runs each turn's body by its node in Arrow batches. A body that raises fails the turn with its class of failure."""

    def run(nodes: pd.Series, inputs: pd.Series) -> pd.DataFrame:
        out = []
        for node, given in zip(nodes, inputs, strict=True):
            try:
                out.append((*bodies[node](given), None))
            except Exception as e:  # noqa: BLE001  whatever a host's body raises is the turn's failure
                out.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["outcome", "output_json", "error_message"])

    run.__annotations__ = {"nodes": pd.Series, "inputs": pd.Series, "return": pd.DataFrame}
    done = turns.withColumn("done", F.pandas_udf(run, COMPLETION)("node_id", "input_json")).select("*", "done.*").drop("done")
    message = columns.failure_message(F.col("error_message"))
    return done.withColumn("error_message", message).withColumn("failure", F.when(F.col("error_message").isNotNull(), columns.failure_class(message)))


def declared_failures(done: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    """Turns failures of declared codes into their outcomes."""
    pairs = [F.when(F.col("failure.code") == code, F.lit(outcome)) for code, outcome in outcomes.items()]
    named = F.coalesce(*pairs, F.lit(None).cast("string"))
    return done.withColumn("outcome", F.coalesce("outcome", named)).withColumn("failure", F.when(named.isNull(), F.col("failure")))


def fake_model(outcome: Column, rules: dict[str, str], otherwise: str) -> Column:
    """A deterministic stand-in for a model: outcome by exact input."""
    return F.coalesce(*(F.when(outcome == k, F.lit(v)) for k, v in rules.items()), F.lit(otherwise))


def completion_faults(done: DataFrame, declared: DataFrame) -> DataFrame:
    """Completions with an outcome that their node doesn't declare, the reserved one, or a number of receipts that the
    node's kind doesn't allow: one for models, up to 256 for agents, none for others."""
    met = done.join(declared.select("node_id", "kind", "outcomes"), "node_id")
    named = F.array_contains("outcomes", F.col("outcome")) & (F.col("outcome") != "join_unsatisfiable")
    n = F.coalesce(F.col("receipts"), F.lit(0))
    counted = F.when(F.col("kind") == "model", n == 1).when(F.col("kind") == "agent", n <= 256).otherwise(n == 0)
    return met.where(~(F.coalesce(named, F.lit(False)) & counted)).drop("kind", "outcomes")
