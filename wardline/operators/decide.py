"""From scanner verdicts to one decision, its labels, and what the caller may see of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.patterns import BLOCK, CATEGORIES, DEFAULT_CATEGORY, REVIEW
from wardline.functions.scan import RESULT, result
from wardline.functions.text import ENGINE_ERROR

ERROR_CODE = -32001
#: What the caller reads of a denial (fixed value).
DENIED = "denied by {phase} policy (ref {ref})"


def results(*verdicts: Column) -> Column:
    """The verdicts in order as an array, nulls dropped; arrays among them are laid out in place."""
    return F.filter(F.flatten(F.array(*verdicts)), lambda r: r.isNotNull())


def as_array(verdict: Column) -> Column:
    return F.when(verdict.isNull(), F.array().cast(f"array<{RESULT}>")).otherwise(F.array(verdict))


def first_block(found: Column) -> Column:
    return F.get(F.filter(found, lambda r: r.outcome == BLOCK), 0)


def decision(found: Column, review_mode: str = "pass") -> Column:
    """struct<deny, reason, human_review>: the first block denies; reviews escalate or are noted by mode."""
    block, reviews = first_block(found), F.filter(found, lambda r: r.outcome == REVIEW)
    nothing = F.lit("")
    of = lambda deny, reason, review: F.struct(F.lit(deny).alias("deny"), reason.alias("reason"), F.lit(review).alias("human_review"))
    reason = F.concat(block["scanner"], F.lit(":block"), F.when(block["reason"] != "", F.concat(F.lit(":"), block["reason"])).otherwise(nothing))
    some = F.size(reviews) > 0
    first = F.get(reviews, 0)
    escalated = F.concat(first["scanner"], F.lit(":human_review_escalated"), F.when(first["reason"] != "", F.concat(F.lit(":"), first["reason"])).otherwise(nothing))
    noted = F.array_join(F.transform(reviews, lambda r: F.concat(r.scanner, F.lit(":review"))), ",")
    pending = of(True, escalated, False) if review_mode == "deny" else of(False, noted, True)
    return F.when(block.isNotNull(), of(True, reason, False)).when(some, pending).otherwise(of(False, nothing, False))


def wire_outcome(deny: Column, mutated: Column) -> Column:
    return F.when(deny, "deny").when(mutated, "mutated").otherwise("allow")


def audit_outcome(deny: Column, review: Column, mutated: Column) -> Column:
    """As on the wire, but a pending review outranks a mutation."""
    return F.when(deny, "deny").when(review, "human_review").when(mutated, "mutated").otherwise("allow")


def deny_category(found: Column) -> Column:
    """struct<category, remedy> by the class of the first blocking scanner; escalated reviews get the default."""
    name = F.substring_index(first_block(found)["scanner"], ":", 1)
    pair = lambda p: F.struct(F.lit(p[0]).alias("category"), F.lit(p[1]).alias("remedy"))
    branch = F
    for k, p in CATEGORIES.items():
        branch = branch.when(name == k, pair(p))
    return branch.otherwise(pair(DEFAULT_CATEGORY))


def public_reason(phase: Column, ref: Column) -> Column:
    """What the caller reads of a denial: no scanner, no pattern, only a reference for the operator."""
    shown = F.replace(F.lit(DENIED), F.lit("{phase}"), F.when(phase == "request", "content").otherwise(phase))
    return F.replace(shown, F.lit("{ref}"), ref)


def error_body(found: Column, phase: Column, ref: Column) -> Column:
    """The JSON-RPC error of a denial."""
    kind = deny_category(found)
    data = F.struct(ref.alias("ref"), phase.alias("phase"), kind["category"].alias("category"), kind["remedy"].alias("remedy"))
    error = F.struct(F.lit(ERROR_CODE).alias("code"), public_reason(phase, ref).alias("message"), data.alias("data"))
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit(None).cast("string").alias("id"), error.alias("error")), {"ignoreNullFields": "false"})


def metadata(found: Column, redactions: Column, exchange: Column, outcome: Column) -> Column:
    """The request side's result metadata."""
    rules = F.transform(F.filter(found, lambda r: r.scanner.startswith("invariant:") & (r.outcome == BLOCK)), lambda r: F.substring(r.scanner, 11, 10_000))
    score = F.coalesce(F.array_max(F.transform(found, lambda r: r.score)), F.lit(0.0))
    return F.struct(score.alias("scan_score"), rules.alias("rules_hit"), redactions.alias("redactions"), exchange.alias("exchange_id"), outcome.alias("outcome"))


def wire_result(error: Column, deny: Column, mutated: Column, public: Column, body: Column) -> Column:
    """struct<kind, code, reason, mutated, mcp_error>: a parse error, a failure of the engine, a denial, a changed
    payload or a pass. Of a failure the caller learns nothing but that it happened."""
    none = F.lit(None).cast("string")
    of = lambda kind, code, reason, value, extra: F.struct(F.lit(kind).alias("kind"), F.lit(code).cast("string").alias("code"), reason.alias("reason"), value.alias("mutated"), extra.alias("mcp_error"))
    broken = F.when(error == ENGINE_ERROR, of("error", "PERMISSION_DENIED", F.lit(ENGINE_ERROR), none, none)).when(error.isNotNull(), of("error", "INVALID", error, none, none))
    return broken.when(deny, of("error", "PERMISSION_DENIED", public, none, body)).when(mutated.isNotNull(), of("mutated", None, none, mutated, none)).otherwise(of("pass", None, none, none, none))


def scanner_failure(name: str, error: Column, fail_open: bool = False) -> Column:
    """The verdict that stands in for a scanner that failed: a block, or a review where failures may pass."""
    if fail_open:
        return result(name, REVIEW, F.concat(F.lit("failopen:"), error), 0.0)
    return result(name, BLOCK, error, 1.0)
