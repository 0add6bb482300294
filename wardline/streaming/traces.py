"""Trace rules over streams of calls: keyed state in front of decisions, and whole decisions by micro-batch.

The traces of all keys live in state, dealt to shards by key. A shard takes its calls in order of time, gives every
row the rule that fires for it, and hands the row on; decisions are then made of rows that bring their verdict
along, so a rule sees the calls of earlier micro-batches as it sees those of its own, and a restart goes on
from the checkpoint. Rules are data: a stream of versioned packs reaches every shard and acts without a restart.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wardline.functions import identity, text
from wardline.operators import audit, rules
from wardline.operators.fold import TraceFold
from wardline.operators.rules import DEFAULT_PACK, Rule
from wardline.operators.trace import SUMMARY
from wardline.plans.config import Config
from wardline.plans.engine import decide
from wardline.sources import audit_log
from wardline.sources.packs import Reloader

#: What a shard says of each of its rows.
SAID = "key string, seq long, rule string, said string, version long, summary string, evicted string"
#: The state store that processors with state need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Shards that keys are dealt to, and traces that one of them keeps at most.
SHARDS, MOST_TRACES = 256, 10_000
#: Rows of a frame that leaves a shard at most; `replay.settings` gives it to the batches that come in, too, as a batch is in memory as
#: Arrow, as frames and as tuples at once.
BATCH_ROWS = 1000


class TraceProcessor(StatefulProcessor):
    """Keeps the bounded traces of a shard's keys in the state store; each batch's calls are taken in order of time.

    A row with a `pack` isn't a call: its rules, if they are good and of a higher version, act from its batch on; parked
    progress goes by rule name and is kept. A call that says `reset` clears its key's trace before it is recorded.
    Traces of keys that stay silent for `idle_ms` expire; a null key and an empty one are one. Beyond `most` traces the key that recorded a call the
    longest ago loses its own when a new key comes; rows that only look don't count as use.
    """

    def __init__(self, pack: Sequence[Rule], version: int, window: int, ttl_s: float, args_most: int, idle_ms: int, most: int, carry: Sequence[str]) -> None:
        self.pack, self.start = tuple(pack), (version, rules.to_json(pack))
        self.window, self.ttl_s, self.args_most = window, ttl_s, args_most
        self.idle_ms, self.most, self.carry, self.functions = idle_ms, most, list(carry), dict(rules.FUNCTIONS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        rules.FUNCTIONS.update(self.functions)  # those that were named when the stream began
        self.traces = handle.getMapState("traces", "key string", "state string", ttlDurationMs=self.idle_ms)
        self.used = handle.getMapState("used", "key string", "tick long", ttlDurationMs=self.idle_ms)
        self.rules = handle.getValueState("rules", "version long, pack string")
        self.clock = handle.getValueState("clock", "tick long")

    def _rules(self, offers: pd.DataFrame) -> tuple[int, tuple[Rule, ...]]:
        """The rules in force: the best of those in state, those the query began with, and those offered."""
        best = max(self.start, self.rules.get()) if self.rules.exists() else self.start
        pack = self.pack if tuple(best) == self.start else rules.from_json(best[1])
        for version, offer in sorted(zip(offers["version"], offers["pack"], strict=True)):
            if version > best[0]:
                try:
                    best, pack = (int(version), offer), rules.from_json(offer)
                except (ValueError, TypeError, AttributeError):  # a bad pack never replaces a good one
                    continue
        self.rules.update((int(best[0]), best[1]))
        return best[0], pack

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        offered = table["pack"].notna()
        version, pack = self._rules(table[offered])
        fresh = lambda: TraceFold(pack, self.window, self.ttl_s, args_most=self.args_most)
        tick = self.clock.get()[0] if self.clock.exists() else 0
        ticks = {k[0]: v[0] for k, v in self.used.iterator()}
        order = sorted(ticks, key=ticks.__getitem__)
        ticks = {k: ticks[k] for k in order}  # in order of use: the next to go is the first
        folds: dict[str, TraceFold] = {}
        changed, gone, out = set(), set(), []

        def of(name: str) -> TraceFold:
            if name not in folds:
                known = name not in gone and self.traces.containsKey((name,))
                folds[name] = fresh().load(self.traces.getValue((name,))[0]) if known else fresh()
            return folds[name]

        calls = table[~offered].sort_values(["t", "seq"], kind="stable")
        for row in calls.itertuples(index=False):
            name, evicted = row.key or "", None
            if row.reset:
                folds[name] = fresh()
                changed.add(name)
            fold = of(name)
            if row.recorded:
                if name not in ticks and len(ticks) >= self.most:
                    evicted = next(iter(ticks))
                    del ticks[evicted]
                    folds.pop(evicted, None)
                    gone.add(evicted)
                    changed.discard(evicted)
                ticks.pop(name, None)
                tick += 1
                ticks[name] = tick
                fold.record(row.tool, row.args, row.t, row.fp)
                changed.add(name)
            before = dict(fold.parked)
            hit = fold.evaluate(row.t)
            if fold.parked != before:
                changed.add(name)
            last = ", ".join(c["tool"] for c in list(fold.calls)[-SUMMARY:])
            out.append((row.key, row.seq, hit.name if hit else None, (hit.description or hit.name) if hit else None, version, last, evicted, *(getattr(row, c) for c in self.carry)))
        for name in gone - set(ticks):
            self.traces.removeKey((name,))
            self.used.removeKey((name,))
        for name in changed:
            self.traces.updateValue((name,), (folds[name].state(),))
            if name in ticks:
                self.used.updateValue((name,), (ticks[name],))
        self.clock.update((tick,))
        for k in range(0, max(1, len(out)), BATCH_ROWS):
            yield pd.DataFrame(out[k : k + BATCH_ROWS], columns=["key", "seq", "rule", "said", "version", "summary", "evicted", *self.carry])

    def close(self) -> None:
        pass


def trace_stream(calls: DataFrame, pack: Sequence[Rule] = DEFAULT_PACK, window: int = 256, ttl_s: float = 600.0, idle_ms: int = 86_400_000, args_most: int = 4096, packs: DataFrame | None = None, version: int = 1, shards: int = SHARDS, most: int = MOST_TRACES, carry: Sequence[str] = ()) -> DataFrame:
    """key, seq, rule, said, version, summary, evicted of a stream of calls (key, seq, ts, tool, args, recorded, and fp and reset if they are there).

    rule is the first that fires, or null; said its wording, version that of the rules in force, summary the
    key's last calls, evicted the key whose trace went for this one's. Columns to `carry` come along as text. `packs`
    is a stream of (version, pack), see `packs_stream`. Needs the state store PROVIDER. A micro-batch's rows of a shard are
    one task's work, and the rows of one key are in any case, as parked progress follows their order."""
    optional = lambda name, other: F.col(name) if name in calls.columns else other
    none = F.lit(None).cast("string")
    extra = [F.col(c).cast("string").alias(c) for c in carry]
    key = F.col("key").cast("string")
    lean = calls.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), key.alias("key"), F.col("seq").cast("long").alias("seq"), (F.unix_micros("ts") / 1_000_000).alias("t"), "tool", "args", optional("fp", none).alias("fp"), F.coalesce("recorded", F.lit(False)).alias("recorded"), F.coalesce(optional("reset", F.lit(False)), F.lit(False)).alias("reset"), F.lit(None).cast("long").alias("version"), none.alias("pack"), *extra)
    if packs is not None:
        offer = packs.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), none.alias("key"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("t"), none.alias("tool"), none.alias("args"), none.alias("fp"), F.lit(False).alias("recorded"), F.lit(False).alias("reset"), F.col("version").cast("long").alias("version"), "pack", *(none.alias(c) for c in carry))
        lean = lean.unionByName(offer)
    schema = SAID + "".join(f", {c} string" for c in carry)
    return lean.groupBy("shard").transformWithStateInPandas(TraceProcessor(pack, version, window, ttl_s, args_most, idle_ms, most, carry), schema, "Append", "ProcessingTime")


def packs_stream(spark: SparkSession, folder: str) -> DataFrame:
    """version, pack of the rule files that come into a folder: JSON as `rules.to_json` writes it, one pack a file, the
    version being the number in its name."""
    files = spark.readStream.text(folder, wholetext=True).select(F.col("value").alias("pack"), F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).alias("n"))
    return files.where("n <> ''").select(F.col("n").cast("long").alias("version"), "pack")


def trace_stream_of(calls: DataFrame, cfg: Config, pack: Sequence[Rule] = DEFAULT_PACK, **more) -> DataFrame:
    """`trace_stream` with the window, bounds and time to live of the settings."""
    return trace_stream(calls, pack, cfg.invariant_window, cfg.invariant_sticky_ttl_s, args_most=cfg.invariant_args_max_bytes, **more)


#: Columns of exchanges that travel through the state as one JSON text.
_REST = ("service_names", "metadata", "headers")


def traced_stream(exchanges: DataFrame, cfg: Config = Config(), pack: Sequence[Rule] = DEFAULT_PACK, **more) -> DataFrame:
    """A stream of exchanges (sources.exchanges.SCHEMA) with rule, said, version and summary of their traces, for `decide`.

    Requests are recorded under their trace key; responses look at their route's trace and never enter it. More
    arguments are those of `trace_stream`."""
    request, route = F.col("phase") == "request", identity.metadata_value(F.col("metadata"), "route_name")
    key = F.when(request, identity.trace_key(route, F.col("service_names"), F.col("headers"), cfg.invariant_trace_key_headers)).otherwise(identity.trace_key(route, F.col("service_names")))
    read = text.read(F.col("phase"), F.col("method"), F.col("payload"), cfg.invariant_args_max_bytes, flat=False)
    rows = exchanges.select("exchange_key", "phase", "method", "payload", F.to_json(F.struct(*_REST)).alias("rest"), F.col("ts").alias("ts"), F.unix_micros("ts").alias("at"), "seq", key.alias("key"), read.alias("read"))
    tool, args = F.coalesce("read.tool", F.lit("")), F.coalesce("read.args", F.lit("{}"))
    calls = rows.withColumns({"tool": tool, "args": args, "fp": F.col("read.fp"), "recorded": request & (tool != "")}).drop("read")
    said = trace_stream_of(calls, cfg, pack, carry=("exchange_key", "phase", "method", "payload", "rest", "at"), **more)
    rest = F.from_json("rest", exchanges.select(*_REST).schema)
    said = said.withColumn("rest", rest)
    return said.select("exchange_key", "phase", "method", *(F.col(f"rest.{c}").alias(c) for c in _REST), "payload", F.timestamp_micros(F.col("at").cast("long")).alias("ts"), "seq", "rule", "said", "version", F.when(F.col("phase") == "response", F.col("summary")).alias("summary"))


def decide_stream(exchanges: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], cfg: Config = Config(), pack: Sequence[Rule] = DEFAULT_PACK, classifier=None, judge=None, **more) -> DataStreamWriter:
    """A stream writer that decides exchanges with the traces of all their keys so far, and gives each batch to all
    sinks; set its checkpoint and trigger and start it."""
    return traced_stream(exchanges, cfg, pack, **more).writeStream.foreachBatch(decide_batches(None, sinks, cfg, classifier, judge))


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, tools (oldest first), parked (rule to stages passed) of all traces in a stream's checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "traces").load(checkpoint)
    kept = F.from_json(F.col("user_map_value.value.state"), "calls array<struct<tool:string>>, parked map<string,array<double>>")
    return rows.select(F.col("user_map_key.key").alias("key"), kept.alias("kept")).select("key", F.col("kept.calls.tool").alias("tools"), F.transform_values("kept.parked", lambda _, v: v[0].cast("int")).alias("parked"))


def rate_windows(calls: DataFrame, late: str = "10 minutes", span: str = "1 minute", most: int = 30) -> DataFrame:
    """Event-time counterpart of the rate rule for dashboards: tools over the limit in a tumbling window."""
    counts = calls.withWatermark("ts", late).groupBy(F.window("ts", span), "key", "tool").agg(F.count("*").alias("calls"))
    return counts.where(F.col("calls") > most)


def decide_batches(reloader: Reloader | None, sinks: Sequence[Callable[[DataFrame, int], None]], cfg: Config = Config(), classifier=None, judge=None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch is decided once and given to all sinks.

    Exchanges of `traced_stream` bring their trace's verdicts along. For plain exchanges the rule file is read anew
    for each batch, and rules see the batch alone: no call of an earlier one."""

    def run(batch: DataFrame, number: int) -> None:
        if reloader:
            reloader.reload()
        decided = decide(batch, cfg, reloader.pack if reloader else (), classifier, judge).persist()
        try:
            for sink in sinks:
                sink(decided, number)
        finally:
            decided.unpersist()

    return run


def audit_sink(cfg: Config, reloader: Reloader | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends decision records, and the log of reloads, as JSON lines under `audit_log_path`.

    Each batch begins chains of its own, one a route; without `audit_hash_chain` lines are written as they are."""

    def run(decided: DataFrame, number: int) -> None:
        version: str | Column = F.col("version").cast("string") if "version" in decided.columns else str(reloader.version) if reloader else "1"
        rows = audit.record(decided, version, cfg.guardrail_version or audit.VERSION)
        lines = rows.select(F.concat_ws("-", F.lit(str(number)), "route").alias("stream"), F.floor("ts_ms").cast("long").alias("seq"), F.to_json(F.struct(*rows.columns)).alias("record"))
        if reloader and reloader.log:
            lines = lines.unionByName(reloader.lines().withColumn("stream", F.concat_ws("-", F.lit(str(number)), "stream")))
        audit_log.write(audit.chain(lines, "stream", "seq") if cfg.audit_hash_chain else lines.withColumnRenamed("record", "line"), cfg.audit_log_path)

    return run


def spans(query: StreamingQuery) -> list[dict]:
    """One record for each step of each batch that a query still remembers: name, batch and duration in ms."""
    return [{"event": "span", "name": step, "batch": p["batchId"], "duration_ms": float(ms)} for p in query.recentProgress for step, ms in p["durationMs"].items()]


def shut_down(queries: Sequence[StreamingQuery], drain_s: float = 5.0) -> None:
    """Let batches that are at work end, for so many seconds together, then stop; what is stopped begins anew from its checkpoint."""
    until = time.monotonic() + drain_s
    for query in queries:
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.05)
        query.stop()
