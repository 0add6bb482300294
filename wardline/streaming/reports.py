"""Reports over streams of audit records and samples: pairing, counters and durations, scanner health."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from wardline.operators import audit


def pairs_stream(records: DataFrame, late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """exchange_id, asked, answered of a stream of audit records: each request with its answers, and what stays alone once.

    The sides of an exchange find each other if they are at most `within` apart, in either order. A side that is
    alone is given out when the watermark has passed all that could still come for it, and its state goes."""
    at = F.timestamp_millis(F.coalesce("ts_ms", F.col("ts") * 1000.0).cast("long"))
    rows = audit.decisions(records).where(F.col("exchange_id") != "").select("phase", "exchange_id", at.alias("at")).withWatermark("at", late)
    side = lambda phase, p: rows.where(F.col("phase") == phase).select(F.col("exchange_id").alias(f"{p}_id"), F.col("at").alias(f"{p}_at"))
    met = f"q_id = r_id AND r_at >= q_at - INTERVAL {within} AND r_at <= q_at + INTERVAL {within}"
    both = side("request", "q").join(side("response", "r"), F.expr(met), "full_outer")
    return both.select(F.coalesce("q_id", "r_id").alias("exchange_id"), F.col("q_id").isNotNull().alias("asked"), F.col("r_id").isNotNull().alias("answered"))


def paired(found: DataFrame) -> DataFrame:
    """The numbers of `audit.pairs` from what `pairs_stream` gave out."""
    each = found.groupBy("exchange_id").agg(F.sum(F.col("asked").cast("int") + F.col("answered").cast("int")).alias("n"), F.max("asked").alias("asked"))
    return each.agg(F.count("*").alias("exchanges"), F.count_if(F.expr("n >= 2")).alias("pairs"), F.count_if(F.expr("n = 1 AND asked")).alias("request_only"), F.count_if(F.expr("n = 1 AND NOT asked")).alias("response_only"))


#: Entries of a duration sketch's levels; the rank of a quantile is then off by less than 1.7 percent.
SKETCH_K = 200


def durations(records: DataFrame, *by: str) -> DataFrame:
    """A mergeable sketch of duration_ms, and the number of decisions, by phase, outcome and other columns."""
    return audit.decisions(records).groupBy("phase", "outcome", *by).agg(F.kll_sketch_agg_double("duration_ms", SKETCH_K).alias("sketch"), F.count("duration_ms").alias("n"))


def quantiles(sketches: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """phase, outcome, n, share, duration_ms from the sketches of any number of batches."""
    merged = sketches.groupBy("phase", "outcome").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("duration_ms")) for q in shares)))
    return merged.select("phase", "outcome", "n", each.alias("q")).select("phase", "outcome", "n", "q.share", "q.duration_ms")


def metrics_sink(folder: str, record: Callable[[DataFrame], DataFrame] = audit.record) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch's counters and duration sketches; a batch that is repeated replaces its own."""

    def run(decided: DataFrame, number: int) -> None:
        rows = record(decided)
        audit.counters(rows).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")
        durations(rows).write.mode("overwrite").parquet(f"{folder}/durations/batch={number}")

    return run


def observed(records: DataFrame, name: str, phases: Sequence[str] = ("request", "response"), outcomes: Sequence[str] = ("allow", "deny", "human_review", "mutated")) -> DataFrame:
    """The records, with their decisions counted as they flow by; a `Live` listener sums the counts up."""
    one = lambda p, o: F.count_if((F.col("phase") == p) & (F.col("outcome") == o)).alias(f"{p}:{o}")
    return records.observe(name, F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("duration_ms"), *(one(p, o) for p in phases for o in outcomes))


class Live(StreamingQueryListener):
    """Totals of what `observed` counts, as batches of running queries end."""

    def __init__(self, name: str) -> None:
        self.name, self.totals, self.batches = name, Counter(), 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if (row := event.progress.observedMetrics.get(self.name)) is not None:
            self.totals.update({k: v for k, v in row.asDict().items() if v})
            self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


#: Shards that scanners are dealt to.
SHARDS = 256


class HealthProcessor(StatefulProcessor):
    """Keeps the last samples of a shard's scanners; a timer tells of those that have been silent.

    The state of a shard is one JSON text: for each key its last samples as 0 and 1, and when it will have been silent
    for too long. All keys of a batch are worked on at once."""

    def __init__(self, last: int, least: int, worst: float, silent_ms: int) -> None:
        self.last, self.least, self.worst, self.silent_ms = last, max(1, least), worst, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "kept string, timer long")

    def _load(self) -> tuple[dict[str | None, tuple[str, int | None]], int | None]:
        kept, timer = self.kept.get() if self.kept.exists() else ("[]", None)
        return {k: (ring, due) for k, ring, due in json.loads(kept)}, timer

    def _store(self, known: dict[str | None, tuple[str, int | None]], timer: int | None, pending: bool = True) -> None:
        """`known` in the state, with a timer for the key that is due first instead of the one before, if that is pending."""
        first = min((due for _, due in known.values() if due is not None), default=None)
        if first != timer or not pending:
            if timer is not None and pending:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.kept.update((json.dumps([(k, *v) for k, v in known.items()]), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        table = pd.concat(list(rows), ignore_index=True)
        codes, keys = pd.factorize(table["key"], use_na_sentinel=False)
        names = [None if pd.isna(k) else k for k in keys]
        table = table.assign(code=codes).sort_values(["code", "t", "seq"])
        rings = [known.get(k, ("", None))[0] for k in names]
        before, come = np.array([len(r) for r in rings]), np.bincount(codes, minlength=len(names))
        # each key's earlier samples, then those that came; failures are counted up over all of them
        start = np.cumsum(before + come) - (before + come)
        at = start[table["code"]] + before[table["code"]] + np.arange(len(table)) - (np.cumsum(come) - come)[table["code"]]
        ok = np.zeros(int((before + come).sum()), dtype=bool)
        ok[at] = table["ok"].to_numpy(dtype=bool)
        for s, ring in zip(start, rings, strict=True):
            ok[s : s + len(ring)] = np.frombuffer(ring.encode(), np.uint8) == ord("1")
        failed = np.concatenate([[0], np.cumsum(~ok)])
        first = np.maximum(start[table["code"]], at - self.last + 1)
        n = at + 1 - first
        ratio = (failed[at + 1] - failed[first]) / n
        due = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms if self.silent_ms else None
        text = np.where(ok, b"1", b"0").tobytes().decode()
        for k, s, e in zip(names, start, start + before + come, strict=True):
            known[k] = (text[max(s, e - self.last) : e], due)
        self._store(known, timer)
        yield pd.DataFrame({"key": table["key"], "seq": table["seq"], "failure_ratio": ratio, "healthy": (n < self.least) | (ratio <= self.worst), "silent": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone = [k for k, (_, due) in known.items() if due is not None and due <= now]
        self._store(known | {k: (known[k][0], None) for k in gone}, timer, pending=timer != expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame([(k, None, None, None, True) for k in gone], columns=["key", "seq", "failure_ratio", "healthy", "silent"])

    def close(self) -> None:
        pass


def health_stream(samples: DataFrame, key: str, ok: Column, last: int = 100, least: int = 20, worst: float = 0.5, silent_ms: int = 0, shards: int = SHARDS) -> DataFrame:
    """key, seq, failure_ratio, healthy, silent of a stream of samples (ts, seq): `audit.health` over the batches so far.

    With `silent_ms` a key that has sent nothing for so long gives one row that says so, without numbers. Keys are dealt
    to shards, and a shard's rows of a micro-batch are worked on together, so that many keys cost no more than few."""
    name = F.col(key).cast("string")
    lean = samples.select(F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("shard"), name.alias("key"), F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.coalesce(ok, F.lit(False)).alias("ok"))
    schema = "key string, seq long, failure_ratio double, healthy boolean, silent boolean"
    return lean.groupBy("shard").transformWithStateInPandas(HealthProcessor(last, least, worst, silent_ms), schema, "Append", "ProcessingTime")
