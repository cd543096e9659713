"""Column forms of the scalar functions, for use in DataFrame plans."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import canon


def raw_body_digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def canonical_digest(json_text: str) -> Column:
    """SHA-256 of the canonical form of JSON text; null where the text isn't JSON."""

    def one(text: str) -> str | None:
        try:
            return canon.digest(json.loads(text))
        except ValueError:
            return None

    def run(column: pd.Series) -> pd.Series:
        known = {t: one(t) for t in column.dropna().unique()}  # texts that repeat are read once a batch
        return pd.Series([known.get(t) for t in column], dtype=object)

    return F.pandas_udf(run, "string")(json_text)


def is_identifier(text: Column) -> Column:
    return text.rlike(canon.IDENTIFIER)


def is_contract_id(text: Column) -> Column:
    return text.rlike(canon.CONTRACT_ID)


def contract_name(text: Column) -> Column:
    return F.regexp_extract(text, r"^(.*)\.v[1-9][0-9]*$", 1)


def contract_version(text: Column) -> Column:
    return F.regexp_extract(text, r"\.v([1-9][0-9]*)$", 1).try_cast("bigint")


def is_canonical_timestamp(text: Column) -> Column:
    """UTC text with exactly milliseconds that reads back as itself."""
    read = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return text.rlike(canon.TIMESTAMP) & F.coalesce(F.date_format(read, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == text, F.lit(False))


def failure_message(text: Column) -> Column:
    """Control characters to spaces, at most 2,000 characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), 1, 2000)


#: Words of a failure's message that decide its class, in order; fixed values.
FAILURE_CLASSES = (
    (r"schema|contract|identity|digest|binding|pipeline node|executable|topolog", "immutable_configuration_rejected", False),
    (r"timeout|timed out|fetch|connect|econn|socket|model|503|502|429", "dependency_unavailable", True),
)


def failure_class(message: Column) -> Column:
    """``struct<code, retryable>`` of an untyped failure."""
    first, second = ((F.lower(message).rlike(words), F.struct(F.lit(code).alias("code"), F.lit(retry).alias("retryable"))) for words, code, retry in FAILURE_CLASSES)
    return F.when(*first).when(*second).otherwise(F.struct(F.lit("stage_execution_failed").alias("code"), F.lit(True).alias("retryable")))


def classify(message: str) -> tuple[str, bool]:
    """The same of one message: code, and whether it may run again."""
    for words, code, retry in FAILURE_CLASSES:
        if re.search(words, message.lower()):
            return code, retry
    return "stage_execution_failed", True


def lease_expiry(now: Column, lease_ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", lease_ms, now)


def receipt_is_valid(receipt: str) -> Column:
    """The rules of a usage receipt: observation by tier, a charge of at least 1 without observation, charges that
    cover what was observed, a signature exactly on signed receipts."""
    c = lambda name: F.col(f"{receipt}.{name}")
    observed = [c("observed_input_tokens"), c("observed_output_tokens"), c("observed_cost_micro_usd")]
    seen = observed[0].isNotNull() | observed[1].isNotNull() | observed[2].isNotNull()
    blind, told = c("trust").isin("estimated_tier_ceiling", "unavailable"), c("trust").isin("provider_reported", "provider_signed")
    counts = [*(F.coalesce(x, F.lit(0)) for x in observed), c("charged_tokens"), c("charged_cost_micro_usd"), c("duration_ms")]
    whole = F.lit(True)
    for x in counts:
        whole = whole & (x >= 0)
    by_tier = F.when(blind, ~seen & (c("charged_tokens") >= 1) & (c("charged_cost_micro_usd") >= 1)).when(told, seen).otherwise(False)
    covers = F.coalesce(c("charged_tokens") >= observed[0] + observed[1], F.lit(True))
    for name, most in (("charged_tokens", 10_000_000), ("charged_cost_micro_usd", 100_000_000_000), ("duration_ms", 86_400_000), ("observed_input_tokens", 10_000_000), ("observed_output_tokens", 10_000_000), ("observed_cost_micro_usd", 100_000_000_000)):
        whole = whole & F.coalesce(c(name) <= most, F.lit(True))
    whole = whole & (c("schema_version") == "usage-receipt.v1") & F.coalesce(c("route_alias").rlike(r"^[a-z][a-z0-9-]{0,99}(?![\s\S])"), F.lit(True))
    signed = (c("trust") == "provider_signed") == F.coalesce(F.length(c("signature")).between(1, 4096), F.lit(False))
    return F.coalesce(whole & by_tier & covers & signed, F.lit(False))
