"""The whole dataflow over a table of exchanges: parse, flatten, scan, trace, decide, mask, answer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import identity, text
from wardline.functions.patterns import ALLOW, BLOCK
from wardline.functions.redact import payload_masker, redaction_gate, tagged
from wardline.functions.scan import RESULT, fence, result, scan, scan_chunks
from wardline.operators import audit
from wardline.operators import decide as d
from wardline.operators import trace
from wardline.operators.classify import classify, scorer, second_stage, windowed
from wardline.operators.fold import fold_keys
from wardline.operators.rules import DEFAULT_PACK, Rule
from wardline.plans.config import Config


def prepare(exchanges: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Exchanges (see sources.exchanges.SCHEMA) with identity, text, windows and coverage.

    Each payload is read once, by one Python pass, for its text, its error, the tool it calls, and `__masked`, what masking
    would make of it (null without redaction)."""
    meta, headers = F.col("metadata"), F.col("headers")
    mask = payload_masker(cfg.redact_request_params, cfg.redaction_max_bytes) if cfg.enable_redaction else None
    df = exchanges.withColumn("parsed", fence(text.read(F.col("phase"), F.col("method"), F.col("payload"), mask=mask)))
    df = df.withColumns(
        {
            "error": F.col("parsed.error"),
            "text": F.coalesce("parsed.text", F.lit("")),
            "tool": F.coalesce("parsed.tool", F.lit("")),
            "__masked": F.col("parsed.masked") if mask else F.lit(None).cast(text.MASKED),
            "upstream_transport": identity.metadata_value(meta, "upstream_transport"),
            "route_name": identity.metadata_value(meta, "route_name"),
            "caller": identity.caller(headers, cfg.audit_caller_headers),
            "exchange_id": identity.exchange_id(meta, headers, F.col("exchange_key")),
            "ref": F.substring(F.sha2(F.concat_ws("|", "exchange_key", "phase", "seq"), 256), 1, 8),
        }
    )
    df = text.scan_windows(df, "text", "chunks", cfg.max_content_bytes, cfg.scan_tail_bytes)
    df = df.withColumns(text.coverage(F.col("text"), F.col("chunks"), cfg.max_content_bytes))
    return df.withColumn("payload_sha256", text.payload_digest(F.col("text"))).drop("parsed")


#: So many trace verdicts, of so many bytes each, are broadcast at most.
BROADCAST_ROWS, ROW_BYTES = 50_000, 1024
#: What says which exchange a row is.
IDENTITY = ("exchange_key", "phase", "seq")


def traced(exchanges: DataFrame, cfg: Config = Config(), pack: Sequence[Rule] = DEFAULT_PACK, responses: bool = False, parked: bool = False) -> DataFrame:
    """IDENTITY, invariant, summary of the requests (and responses): the first rule that fires, and the last calls before.

    With `parked` flows go on after the window has left their first steps behind, for as long as the settings
    say; the calls of a key are then folded in order instead of seen through windows (without summaries).

    Only ids, tools and arguments are shuffled by trace key and sorted by time; payloads and texts stay
    where they are. Responses look at their route's trace and never enter it."""
    request = F.col("phase") == "request"
    call = exchanges if responses else exchanges.where(request)
    key = identity.trace_key(identity.metadata_value(F.col("metadata"), "route_name"), F.col("service_names"), F.col("headers"), cfg.invariant_trace_key_headers)
    route = identity.trace_key(identity.metadata_value(F.col("metadata"), "route_name"), F.col("service_names"))
    read = fence(text.read(F.col("phase"), F.col("method"), F.col("payload"), cfg.invariant_args_max_bytes, flat=False))
    call = call.select(*IDENTITY, F.when(request, key).otherwise(route).alias("__key"), "ts", read.alias("__read"))
    tool, args = F.coalesce("__read.tool", F.lit("")), F.coalesce("__read.args", F.lit("{}"))
    calls = trace.record(call, F.col("__key"), F.col("seq"), F.col("ts"), tool, args, fp=F.col("__read.fp")).drop("__read", "__key")
    if parked:
        folded = fold_keys(calls, pack, cfg.invariant_window, cfg.invariant_sticky_ttl_s, carry=IDENTITY[:2]).where("rule is not null")
        return folded.select(*IDENTITY, rule_verdict(F.col("rule"), pack).alias("invariant"), F.lit(None).cast("string").alias("summary"))
    calls = trace.blocks(calls, max(cfg.invariant_window, trace.SUMMARY))
    calls = trace.apply_pack(calls, pack, window=cfg.invariant_window)
    calls = trace.judged(trace.summary(calls) if responses else calls.withColumn("summary", F.lit(None).cast("string")))
    return calls.select(*IDENTITY, "invariant", "summary").where(F.col("invariant").isNotNull() | (F.col("summary") != ""))


def _beside(found: DataFrame) -> DataFrame:
    """Trace verdicts as the right side of a join with whole payloads: sent to where the payloads are if there are at
    most BROADCAST_ROWS of them, none of over ROW_BYTES (no more are ever fetched); else both sides are shuffled."""
    found = found.withColumn("invariant", F.col("invariant").cast(RESULT))  # whose members may be null, as Arrow wants it
    row = F.struct(*found.columns)
    few = found.select(F.when(F.octet_length(F.to_json(row)) <= ROW_BYTES, row).alias("r")).limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows > BROADCAST_ROWS or few["r"].null_count:
        return found
    schema = T.StructType([T.StructField("r", found.schema)])
    return F.broadcast(found.sparkSession.createDataFrame(few, schema).select("r.*"))


def scanned(df: DataFrame, chunks: str, out: str, cfg: Config, classifier=None, once: bool = False) -> DataFrame:
    """`df` with an array of verdicts for each chunk: patterns, then the classifier, as far as they are enabled."""
    c = F.col
    if cfg.dry_run:
        stub = F.concat(F.lit("stub."), c("phase"))
        return df.withColumn(out, F.transform(chunks, lambda _: F.array(result(stub, ALLOW, "", 0.0))))
    parts = []
    if cfg.enable_regex_scanner:
        df = scan_chunks(df, chunks, "__regex", key=cfg.audit_hmac_key or None)
        parts.append("__regex")
    if cfg.enable_promptguard and classifier is not None:
        df = classify(df, chunks, classifier, "__model", cfg.lf_promptguard_block_threshold, cfg.pg_review_threshold, cfg.failure_mode == "failOpen", once=once)
        parts.append("__model")
    each = lambda k: F.filter(F.array(*(F.get(c(p), k) for p in parts)), lambda r: r.isNotNull())
    verdicts = F.transform(chunks, lambda _, k: each(k)) if parts else F.transform(chunks, lambda _: F.array().cast(f"array<{RESULT}>"))
    return df.withColumn(out, fence(verdicts)).drop(*parts)


def rule_verdict(name: Column, pack: Sequence[Rule], said: Column | None = None) -> Column:
    """The blocking verdict of a rule by its name, null for none, in the wording of the pack unless that is given."""
    said = F.coalesce(*([] if said is None else [said]), *(F.when(name == r.name, F.lit(r.description or r.name)) for r in pack), name)
    return F.when(name.isNotNull(), result(F.concat(F.lit("invariant:"), name), BLOCK, said, 0.0)).cast(RESULT)


def decide(exchanges: DataFrame, cfg: Config = Config(), pack: Sequence[Rule] = DEFAULT_PACK, classifier=None, judge=None, parked: bool = False, once: bool = False) -> DataFrame:
    """Every exchange with results, decision, reason, mutated, outcome and the wire result.

    `classifier` is a `classify.scorer`, `judge` a `classify.aligner`; both also need their settings. With `once` equal
    texts are given to them once, at the price of writing the rows. `parked` is as in `traced`. A tool call that the access list denies isn't scanned but stays in the trace. A payload that can't
    be read is refused: its error is all there is on the wire, and decision, reason and outcome are null.

    The trace is that of the table alone, seen through windows; verdicts are found at once, when this is called,
    and joined back by IDENTITY; only those that say something, so that payloads need not move. Exchanges that
    come with a column `rule`, as `streaming.traces.traced_stream` gives them, bring their trace's verdict along.
    """
    df = prepare(exchanges, cfg)
    request, none = F.col("phase") == "request", F.array().cast(f"array<{RESULT}>")
    df = df.withColumn("acl", F.when(request, identity.acl_verdict(F.col("tool"), cfg.allow_tools, cfg.deny_tools)))
    df = df.withColumn("__scanned", fence(F.when(F.col("acl").isNull() & F.col("error").isNull(), F.col("chunks")).otherwise(F.array().cast("array<string>"))))
    df = scanned(df, "__scanned", "content", cfg, classifier, once)
    df = df.withColumn("size", text.payload_size(F.col("total_bytes"), F.col("scanned_bytes"), cfg.scan_max_payload_bytes))

    aligned = judge is not None and cfg.enable_agent_alignment
    brought, silent = "rule" in exchanges.columns, False
    if brought:
        df = df.withColumn("invariant", fence(rule_verdict(F.col("rule"), pack, F.col("said") if "said" in df.columns else None)))
        df = df if "summary" in df.columns else df.withColumn("summary", F.lit(None).cast("string"))
    elif silent := not pack and not aligned:  # nothing looks at traces
        df = df.withColumn("invariant", F.lit(None).cast(RESULT))
    else:
        found = traced(exchanges, cfg, pack, aligned)
    joined = not brought and not silent
    if parked and joined:
        found = found.drop("invariant").unionByName(traced(exchanges, cfg, pack, parked=True), allowMissingColumns=True) if aligned else traced(exchanges, cfg, pack, parked=True)
        found = found.groupBy(*IDENTITY).agg(F.first("invariant", ignorenulls=True).alias("invariant"), F.max("summary").alias("summary"))
    if joined:
        found = _beside(found.dropDuplicates(list(IDENTITY)).withColumnsRenamed({c: f"__{c}" for c in IDENTITY}))
        df = df.join(found, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in IDENTITY]), "left").drop(*(f"__{c}" for c in IDENTITY))
    if aligned:
        df = df.withColumn("__answers", F.when(~request, F.col("__scanned")).otherwise(F.array().cast("array<string>")))
        df = second_stage(df, "__answers", "content", F.col("summary"), judge, once=once).drop("__answers")
    else:
        df = df.withColumn("second", none)

    rule = F.when(request, F.array(F.coalesce("invariant", result("invariant", ALLOW, "", 0.0)))).otherwise(none)
    df = df.withColumn("results", fence(d.results(d.as_array(F.col("size")), d.as_array(F.col("acl")), F.flatten("content"), F.col("second"), rule)))
    df = df.withColumn("decision", fence(F.when(F.col("error").isNull(), d.decision(F.col("results"), cfg.human_review_mode))))

    gate = redaction_gate(F.col("decision.deny"), F.col("decision.human_review"), cfg.redact_on_review)
    wanted = F.lit(cfg.enable_redaction) & gate.isNull() & F.col("error").isNull()
    df = df.withColumn("__m", F.when(wanted & (request.isNotNull() if cfg.redact_request_params else ~request), F.col("__masked"))).drop("__masked")
    n = F.coalesce(F.col("__m.redactions"), F.lit(0))
    df = df.withColumns({"redactions": n, "mutated": F.when(n > 0, F.col("__m.value")), "redaction_skipped": F.coalesce(F.col("__m.skipped"), F.lit(False)), "reason": F.when(F.col("error").isNull(), tagged(F.col("decision.reason"), n))}).drop("__m")
    outcome = F.when(F.col("error").isNull(), d.wire_outcome(F.col("decision.deny"), F.col("mutated").isNotNull()))
    public = d.public_reason(F.col("phase"), F.col("ref"))
    wire = d.wire_result(F.col("error"), F.col("decision.deny"), F.col("mutated"), public, d.error_body(F.col("results"), F.col("phase"), F.col("ref")))
    meta = F.when(request & F.col("error").isNull(), d.metadata(F.col("results"), F.col("redactions"), F.col("exchange_id"), outcome))
    return df.withColumns({"outcome": outcome, "wire": wire, "result_metadata": meta}).drop("acl", "size", "content", "second", "invariant", "summary", "rule", "said", "__scanned")


def scan_texts(df: DataFrame, column: str) -> DataFrame:
    """A lone text column scanned and decided: scan, decision, outcome."""
    df = scan(df, column).withColumn("results", fence(F.array("scan")))
    df = df.withColumn("decision", fence(d.decision(F.col("results"))))
    return df.withColumn("outcome", d.audit_outcome(F.col("decision.deny"), F.col("decision.human_review"), F.lit(False)))


def health(samples: DataFrame, key: str, ok: Column, cfg: Config = Config()) -> DataFrame:
    """`audit.health` with the settings' window, least number of samples and worst ratio."""
    return audit.health(samples, key, ok, cfg.unhealthy_scanner_window, cfg.unhealthy_scanner_min_samples, cfg.unhealthy_scanner_error_rate)


def scorer_of(encode, logits, labels: Sequence[str], cfg: Config = Config()):
    """A scorer for `decide` from functions that make a tokenizer and a model in a worker, over the settings' number of windows."""
    return scorer(lambda: windowed(encode(), logits(), labels, most=cfg.pg_max_windows))
