"""Audit records, their hash chain, and analytics over them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.scan import fence
from wardline.operators.decide import audit_outcome
from wardline.sources.ranges import carried, ranged

#: The hash before a chain's first line (fixed value).
GENESIS = "0" * 16
VERSION = "0.1.0"

_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
_VERDICT = T.StructType([T.StructField(n, _TYPES[k]) for n, k in (("scanner", "string"), ("outcome", "string"), ("reason", "string"), ("score", "double"))])


def fields(text: str) -> list[T.StructField]:
    """Fields of simple types from "name type, name type"; usable before there is a session."""
    return [T.StructField(n, _TYPES[k]) for n, k in (f.split() for f in text.split(","))]


DECISION = T.StructType(
    [
        *fields("ts long, ts_ms double, phase string, method string, tool string, outcome string, reason string, ref string, exchange_id string, caller string"),
        *fields("payload_sha256 string, rules_version string, sidecar_version string, duration_ms double, truncated boolean, scanned_bytes long, total_bytes long"),
        *fields("upstream_transport string, route string"),
        T.StructField("scanners", T.ArrayType(_VERDICT)),
    ]
)
CHAINED = T.StructType([*DECISION.fields, *fields("prev_hash string, line_hash string, event string, ok boolean, rule_count long, error string")])


def record(df: DataFrame, rules_version: str | Column = "1", version: str = VERSION, duration: Column | None = None) -> DataFrame:
    """The decision record of every decided exchange (columns of `plans.engine.decide`). Payloads that were refused
    have no decision and so no record."""
    df = df.where(F.col("error").isNull()) if "error" in df.columns else df
    d, ms = F.col("decision"), F.unix_micros("ts") / 1000
    outcome = audit_outcome(d.deny, d.human_review, F.col("mutated").isNotNull())
    cols = {
        "ts": F.floor(ms / 1000).cast("long"), "ts_ms": ms, "phase": F.col("phase"), "method": F.col("method"), "tool": F.when(F.col("phase") == "request", F.col("tool")).otherwise(""),
        "outcome": outcome, "reason": F.col("reason"), "ref": F.col("ref"), "exchange_id": F.col("exchange_id"), "caller": F.col("caller"), "payload_sha256": F.col("payload_sha256"),
        "rules_version": rules_version if isinstance(rules_version, Column) else F.lit(rules_version), "sidecar_version": F.lit(version), "duration_ms": F.lit(0.0) if duration is None else duration, "truncated": F.col("truncated"),
        "scanned_bytes": F.col("scanned_bytes"), "total_bytes": F.col("total_bytes"), "upstream_transport": F.col("upstream_transport"), "route": F.col("route_name"), "scanners": F.col("results"),
    }
    return df.select(*(c.cast(DECISION[n].dataType).alias(n) for n, c in cols.items()))


def hashed(line: Column) -> Column:
    return F.substring(F.sha2(line, 256), 1, 16)


def _line_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:16]


def chain(records: DataFrame, stream: str, order: str, body: str = "record") -> DataFrame:
    """stream, seq, line: each stream's JSON records as chained lines, in order.

    A chain is sequential by nature, so one task writes one stream at a time, a line at a time, with nothing
    in memory but the hash before it; streams are independent chains, and a writer that opens a new stream
    begins a new one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, before = object(), GENESIS
        for rows in batches:
            lines = []
            for stream_, value in zip(rows["stream"], rows["record"], strict=True):
                if stream_ != of:
                    of, before = stream_, GENESIS
                entry = {**json.loads(value), "prev_hash": before}
                entry["line_hash"] = _line_hash(json.dumps(entry, sort_keys=True, default=str))
                lines.append(json.dumps(entry, sort_keys=True, default=str))
                before = _line_hash(lines[-1])
            yield rows.assign(line=lines)[["stream", "seq", "line"]]

    lean = records.select(F.col(stream).cast("string").alias("stream"), F.col(order).cast("long").alias("seq"), F.col(body).alias("record"))
    return lean.repartition("stream").sortWithinPartitions("stream", "seq").mapInPandas(run, "stream string, seq long, line string")


@F.pandas_udf(T.StringType())
def _expected(lines: pd.Series) -> pd.Series:
    """The hash a line should carry: of its members but that hash, in sorted JSON."""
    def one(line: str) -> str | None:
        try:
            entry = json.loads(line)
        except (TypeError, ValueError):
            return None
        return _line_hash(json.dumps({k: v for k, v in entry.items() if k != "line_hash"}, sort_keys=True, default=str)) if isinstance(entry, dict) else None

    return lines.map(one)


def verify(lines: DataFrame, stream: str = "stream", order: str = "seq", line: str = "line") -> DataFrame:
    """stream, checked, unchained, broken_at, problem of every stream.

    Each line is held against its predecessor among the chained lines, all in parallel; the first problem by
    order is reported. Lines without a chain are passed over; malformed JSON is a break. Lines stay where they are
    read: only their hashes are put in order, by ranges, and a range takes over the hash of the stream's last chained line
    before it. So one long stream is the work of many tasks."""
    rows = lines.where(F.trim(line) != "").select(F.col(stream).alias("stream"), F.col(order).alias("seq"), F.rtrim(F.col(line), F.lit("\n")).alias("line"))
    rows = rows.withColumn("json", fence(F.try_parse_json("line")))
    prev, own = F.try_variant_get("json", "$.prev_hash", "string"), F.try_variant_get("json", "$.line_hash", "string")
    rows = rows.withColumns({"bad": F.col("json").isNull(), "prev": prev, "own": own}).withColumn("chained", ~F.col("bad") & F.col("prev").isNotNull() & F.col("own").isNotNull())
    rows = rows.withColumns({"is": hashed(F.col("line")), "hash": _expected("line")}).drop("line", "json")
    rows = ranged(rows, "stream", "seq")
    chained = F.when(F.col("chained"), F.struct("seq", "is"))
    carry = carried(rows, "stream", F.max(chained), F.max("value"))
    before = F.lag("is").over(Window.partitionBy("stream", "range", "chained").orderBy("seq"))
    rows = rows.withColumn("inside", before)
    rows = rows.join(F.broadcast(carry), F.col("stream").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")), "left")
    rows = rows.withColumn("want", F.coalesce("inside", "before.is", F.lit(GENESIS)))
    problem = F.when(F.col("bad"), "malformed JSON").when(F.col("chained") & (F.col("prev") != F.col("want")), "prev_hash mismatch").when(F.col("chained") & (F.col("own") != F.col("hash")), "line_hash mismatch")
    rows = rows.withColumn("problem", problem)
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("seq", "problem")))
    out = rows.groupBy("stream").agg(F.count_if("chained").alias("checked"), F.count_if(~F.col("chained") & ~F.col("bad")).alias("unchained"), first.alias("first"))
    return out.select("stream", "checked", "unchained", F.col("first.seq").alias("broken_at"), F.col("first.problem").alias("problem"))


def decisions(audit: DataFrame) -> DataFrame:
    """The lines that record a decision."""
    return audit.where(F.col("outcome").isNotNull() & F.col("phase").isNotNull())


def time_span(audit: DataFrame) -> DataFrame:
    """span_ms and the number of decisions, by the finer time where there is one."""
    t = F.coalesce("ts_ms", F.col("ts") * 1000.0)
    return decisions(audit).agg((F.max(t) - F.min(t)).alias("span_ms"), F.count("*").alias("n"))


def distribution(audit: DataFrame, by: str) -> DataFrame:
    """Counts and percent of a column's values; the counts are few, so the total is taken over them."""
    counts = decisions(audit).groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.desc("n"), by)


def scanner_outcomes(audit: DataFrame) -> DataFrame:
    each = decisions(audit).select(F.explode("scanners").alias("s")).select("s.scanner", "s.outcome")
    return each.groupBy("scanner", "outcome").agg(F.count("*").alias("n")).orderBy("scanner", "outcome")


def rule_hits(audit: DataFrame) -> DataFrame:
    each = decisions(audit).select(F.explode("scanners").alias("s")).where(F.col("s.scanner").startswith("invariant:") & (F.col("s.outcome") == "block"))
    return each.groupBy(F.substring("s.scanner", 11, 10_000).alias("rule")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def pairs(audit: DataFrame) -> DataFrame:
    """How many exchanges there are, and how many have both sides, a request only, a response only."""
    each = decisions(audit).where(F.col("exchange_id") != "").groupBy("exchange_id").agg(F.count("*").alias("n"), F.min("phase").alias("phase"))
    return each.agg(F.count("*").alias("exchanges"), F.count_if(F.expr("n >= 2")).alias("pairs"), F.count_if(F.expr("n = 1 AND phase = 'request'")).alias("request_only"), F.count_if(F.expr("n = 1 AND phase = 'response'")).alias("response_only"))


def deny_detail(audit: DataFrame) -> DataFrame:
    return decisions(audit).where(F.col("outcome").isin("deny", "human_review")).select("exchange_id", "phase", "outcome", "tool", "reason", "ref")


def counters(audit: DataFrame) -> DataFrame:
    """metric, label1, label2, label3, n: decisions, scanner results and rule hits in one pass over the records."""
    one = lambda metric, *labels: F.struct(F.lit(metric).alias("metric"), *(x.alias(f"label{k}") for k, x in enumerate((*labels, *[F.lit("")] * (3 - len(labels))), 1)))
    own = F.array(one("decisions", F.col("phase"), F.col("outcome"), F.coalesce("method", F.lit(""))))
    scans = F.transform("scanners", lambda s: one("scanner_results", F.substring_index(s.scanner, ":", 1), s.outcome))
    rules = F.transform(F.filter("scanners", lambda s: s.scanner.startswith("invariant:") & (s.outcome == "block")), lambda s: one("invariant_hits", F.substring(s.scanner, 11, 10_000)))
    return decisions(audit).select(F.inline(F.concat(own, scans, rules))).groupBy("metric", "label1", "label2", "label3").agg(F.count("*").alias("n"))


def latency(audit: DataFrame) -> DataFrame:
    return decisions(audit).groupBy("phase", "outcome").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def histogram(audit: DataFrame, bounds: Sequence[float] = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)) -> DataFrame:
    """phase, outcome, up_to, n: how many decisions took more than the bound before and at most this one (null: more than all)."""
    up_to = F
    for b in sorted(bounds):
        up_to = up_to.when(F.col("duration_ms") <= b, float(b))
    return decisions(audit).groupBy("phase", "outcome", up_to.otherwise(None).alias("up_to")).agg(F.count("*").alias("n"))


def redactions(audit: DataFrame) -> DataFrame:
    """phase, redactions: the substitutions that the records tell of."""
    n = F.coalesce(F.try_to_number(F.regexp_extract("reason", r"redaction:(\d+) substitution", 1), F.lit("999999999")), F.lit(0)).cast("long")
    return decisions(audit).groupBy("phase").agg(F.sum(n).alias("redactions"))


def reloads(audit: DataFrame) -> DataFrame:
    """result, n: reloads of rules, by success and error."""
    return audit.where("event = 'rules_reload'").groupBy(F.when(F.col("ok"), "success").otherwise("error").alias("result")).agg(F.count("*").alias("n"))


def health(samples: DataFrame, key: str, ok: Column, last: int = 100, least: int = 20, worst: float = 0.5) -> DataFrame:
    """`samples` with failure_ratio and healthy: over the key's last samples, once there are enough."""
    recent = Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(-(last - 1), 0)
    df = samples.withColumns({"failure_ratio": F.avg((~ok).cast("double")).over(recent), "__n": F.count("*").over(recent)})
    return df.withColumn("healthy", (F.col("__n") < least) | (F.col("failure_ratio") <= worst)).drop("__n")
