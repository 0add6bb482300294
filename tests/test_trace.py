"""Window functions for trace rules against the fold, the fold against cases, chains, packs and the stream."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators import audit, rules, trace
from wardline.functions import text
from wardline.functions.text import shortened
from wardline.operators.fold import TraceFold, fold_keys
from wardline.plans.config import from_env
from wardline.sources import packs
from wardline.sources.packs import Reloader
from wardline.sources.ranges import cut, ranged

START = datetime(2026, 1, 1)
WINDOW = 12
PACK = [
    rules.Loop("loop", 3),
    rules.Rate("rate", "*", 60.0, 3),
    rules.Budget("sum", "n", 12, "(a|b)", 90.0),
    rules.Flow("flow", (rules.Step("a"), rules.Step("b", {"s": "^x"}), rules.Step("c"))),
    rules.Flow("typed", (rules.Step("a", {"n": "^[49]$"}), rules.Step("b"))),
    rules.Flow("numbers", (rules.Step("a", {"n": 9}), rules.Step("b", {"m.0": True}))),
    rules.Flow("from-the-end", (rules.Step("a", {"m.-1": None}), rules.Step("b", {"m": [True, "z"]}), rules.Step("d", {"none": None}))),
    rules.Flow("guarded-start", (rules.Step("a", {"n": 4}, guard=True), rules.Step("a"), rules.Step("b"))),
    rules.Flow("guarded", (rules.Step("a"), rules.Step("d", guard=True), rules.Step("b"), rules.Step("c", guard=True))),
]


def random_calls(n=500, seed=4):
    rnd = random.Random(seed)
    rows, t = [], 0
    for k in range(n):
        t += rnd.choice([0, 1, 5, 30])
        args = json.dumps({"n": rnd.choice([4, 9, 9.0, -3]), "s": rnd.choice(["x1", "y"]), "m": rnd.choice([[True, "z"], [False, None]])}, sort_keys=True)
        rows.append((rnd.choice("pqr"), k, START + timedelta(seconds=t), rnd.choice(["a", "b", "c", "d", ""]), args))
    return rows


@pytest.mark.parametrize("size", [13, trace.BLOCK_CALLS])
@pytest.mark.parametrize("rule", PACK, ids=lambda r: r.name)
def test_windows_agree_with_the_fold(spark, monkeypatch, rule, size):
    monkeypatch.setattr(trace, "BUSY_CALLS", 160 if size == 13 else 10**6)  # two of the three keys are busy
    calls = spark.createDataFrame(random_calls(), "k string, s long, t timestamp, tool string, args string")
    df = trace.record(calls, F.col("k"), F.col("s"), F.col("t"), F.col("tool"), F.col("args"))
    judged = trace.judged(trace.apply_rule(trace.blocks(df, WINDOW, size), rule, WINDOW)).select("seq", rule.name).collect()
    windows = {r.seq: r[rule.name] for r in judged}
    assert len(judged) == len(windows) == 500
    folded = {r.seq: r.rule is not None for r in fold_keys(df, [rule], WINDOW, sticky=False).collect()}
    assert windows == folded
    assert 5 < sum(folded.values()) < 480 or rule.name == "typed"
    assert rule.name != "typed" or not any(folded.values())  # a pattern finds no numbers


FIRST = rules.named("first tools", lambda tool: tool < "c")
BY_FUNCTION = [rules.Flow("named", (rules.Step(FIRST, {"n": rules.named("odd", lambda v: v % 2 == 1)}), rules.Step("c", {"none": rules.named("absent", lambda v: v is None)}))), rules.Budget("named-sum", "n", 12, FIRST, 90.0), rules.Rate("named-rate", FIRST, 60.0, 2)]


@pytest.mark.parametrize("rule", BY_FUNCTION, ids=lambda r: r.name)
def test_matchers_by_function(spark, rule):
    calls = spark.createDataFrame(random_calls(300), "k string, s long, t timestamp, tool string, args string")
    df = trace.record(calls, F.col("k"), F.col("s"), F.col("t"), F.col("tool"), F.col("args"))
    windows = {r.seq: r[rule.name] for r in trace.apply_rule(df, rule, WINDOW).select("seq", rule.name).collect()}
    assert windows == {r.seq: r.rule is not None for r in fold_keys(df, [rule], WINDOW, sticky=False).collect()}
    assert 5 < sum(windows.values()) < 295
    assert rules.from_json(rules.to_json([rule])) == (rule,)
    with pytest.raises(ValueError, match="no such function"):
        rules.from_json(rules.to_json([rules.Rate("r", rules.Named("unknown", bool))]))


def test_one_busy_key_is_the_work_of_many_tasks(spark, monkeypatch):
    """A key's calls lie in several ranges and many blocks, and are judged as by the fold."""
    monkeypatch.setattr(trace, "BUSY_CALLS", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        calls = spark.range(6000, numPartitions=4).select(F.lit("hot").alias("k"), F.col("id").alias("s"), F.timestamp_seconds(F.col("id") * 7).alias("t"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tool"), F.concat(F.lit('{"n": '), F.pmod(F.xxhash64("id"), F.lit(9)).cast("string"), F.lit("}")).alias("args"))
        df = trace.record(calls, F.col("k"), F.col("s"), F.col("t"), F.col("tool"), F.col("args"))
        numbered = trace.numbered(df)
        assert {r.s: r.rn for r in numbered.collect()} == {k: k + 1 for k in range(6000)}
        blocks = trace.blocks(df, 32, 64)
        assert blocks.groupBy("block").count().agg(F.max("count"), F.count("*")).first()[:] == (95, 95)  # 64 and a halo of 31; the last has nothing but a halo
        judged = trace.apply_pack(blocks, PACK[:3], window=32)
        assert judged.rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).sum() == 4
        got = {r.seq: r.invariant and r.invariant.scanner[10:] for r in trace.judged(judged).collect()}
        assert got == {r.seq: r.rule for r in fold_keys(df, PACK[:3], 32, sticky=False).collect()}
        assert len(set(got.values())) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_go_down_and_up_without_arrays(spark):
    rnd = random.Random(6)
    rows = [("k", k, START + timedelta(seconds=k // 3 * 10), "a", json.dumps({"n": rnd.choice([5, -4, 0.25, float("inf"), float("nan"), "2", True, None, [1]]) if k % 50 else 1e30})) for k in range(400)]
    df = trace.record(spark.createDataFrame(rows, "k string, s long, t timestamp, tool string, args string").withColumn("args", text.shortened_json("args", F.lit(0))), F.col("k"), F.col("s"), F.col("t"), F.col("tool"), F.col("args"))
    for rule in (rules.Budget("sum", "n", 11, "*", 45.0), rules.Budget("sum", "n", 9.25, "*", 1000.0)):
        out = trace.apply_rule(df, rule, 7)
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.seq: r["sum"] for r in out.collect()}
        assert got == {r.seq: r.rule is not None for r in fold_keys(df, [rule], 7, sticky=False).collect()}
        assert 20 < sum(got.values()) < 380


def run(pack, calls, window=256, ttl=600.0):
    fold, out = TraceFold(pack, window, ttl), []
    for k, (tool, args) in enumerate(calls):
        fold.record(tool, json.dumps(args), float(k))
        hit = fold.evaluate(float(k))
        out.append(hit.name if hit else None)
        fold = TraceFold(pack, window, ttl).load(fold.state())
    return out


def test_bundled_pack():
    last = lambda calls: run(rules.DEFAULT_PACK, calls)[-1]
    assert last([("inbox_read", {}), ("email_send", {"to": "a@evil.example"})]) == "inbox-to-external-email"
    assert last([("vault_read", {}), ("http_post", {"url": "https://out.example"})]) == "secret-read-then-exfil"
    assert last([("vault_read", {}), ("http_post", {"url": "http://localhost/x"})]) is None
    assert last([("shell_exec", {}), ("k8s_apply", {"manifest": "kind: cluster-admin"})]) == "shell-read-then-k8s-apply"
    assert last([("fs_write", {"p": 1})] * 3) == "denied-tool-retry-loop"
    assert last([("fs_read", {"p": k}) for k in range(31)]) == "per-tool-rate-limit"
    assert last([("fs_read", {"p": k}) for k in range(9)]) is None


def test_parked_progress_and_guards():
    flow = [rules.Flow("f", (rules.Step("a"), rules.Step("b")))]
    assert run(flow, [("a", {}), *[("n", {})] * 3, ("b", {})], window=3)[-1] == "f"
    assert run(flow, [("a", {}), ("n", {}), ("b", {})], window=1, ttl=0.0) == [None] * 3
    assert run(flow, [("b", {}), ("a", {}), ("n", {})])[-1] == "f"  # resuming looks at the whole window
    assert run(flow, [("a", {}), ("b", {}), ("n", {})])[1:] == ["f", "f"]  # a flow in the window goes on firing
    guarded = [rules.Flow("g", (rules.Step("read"), rules.Step("approve", guard=True), rules.Step("send")))]
    assert run(guarded, [("read", {}), ("approve", {}), ("send", {})])[-1] is None
    assert run(guarded, [("approve", {}), ("read", {}), ("send", {})])[-1] == "g"
    assert run(guarded, [("read", {}), ("approve", {}), ("send", {}), ("read", {}), ("send", {})])[-1] == "g"


def test_long_arguments_are_shortened():
    args = {"a": "x" * 9000, "b": ["y" * 10, 5]}
    got = shortened(args)
    assert got["a"].endswith("…[truncated]")
    assert len(got["a"]) < 4200
    assert got["b"] == args["b"]
    assert shortened(args, 0) == args
    assert shortened({"n": list(range(9000))}) == {"n": list(range(9000))}


def test_chain(spark):
    rows = [(s, k, json.dumps({"k": k, "t": "é"})) for s in "xy" for k in range(20)]
    lines = audit.chain(spark.createDataFrame(rows, "stream string, seq long, record string"), "stream", "seq").cache()
    state = lambda df: {r.stream: (r.broken_at, r.problem) for r in audit.verify(df).collect()}
    assert state(lines) == {"x": (None, None), "y": (None, None)}
    tampered = lines.withColumn("line", F.when((F.col("stream") == "x") & (F.col("seq") == 7), F.replace("line", F.lit('"k": 7'), F.lit('"k": 8'))).otherwise(F.col("line")))
    assert state(tampered) == {"x": (7, "line_hash mismatch"), "y": (None, None)}
    assert state(lines.where("not (stream = 'y' and seq = 4)"))["y"] == (5, "prev_hash mismatch")
    legacy = lines.unionByName(spark.createDataFrame([("x", -1, '{"old": 1}')], "stream string, seq long, line string"))
    assert state(legacy)["x"] == (None, None)
    lines.unpersist()


def test_a_line_lost_between_ranges_is_found(spark):
    """One stream of many lines is checked over several ranges; what is missing at any place breaks the next line."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = cut(audit.chain(spark.range(3000).select(F.lit("x").alias("stream"), F.col("id").alias("seq"), F.concat(F.lit('{"k": '), F.col("id").cast("string"), F.lit("}")).alias("record")), "stream", "seq"), "lines")
        places = ranged(lines, "stream", "seq").groupBy("range").agg(F.min("seq").alias("a"), F.count("*").alias("n"))
        assert places.count() == 4
        assert audit.verify(lines).first()[1:] == (3000, 0, None, None)
        for first in [r.a for r in places.orderBy("range").collect()][1:]:
            assert audit.verify(lines.where(F.col("seq") != first - 1)).first()[1:] == (2999, 0, first, "prev_hash mismatch")
            assert audit.verify(lines.where(F.col("seq") != first)).first()[3] == first + 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packs(spark, tmp_path):
    pack = [r for r in PACK if r.name != "guarded-start"]
    assert rules.from_json(rules.to_json(pack)) == tuple(pack)
    assert rules.lint(rules.DEFAULT_PACK) == []
    assert rules.lint([rules.Loop("l", 1), rules.Loop("l"), rules.Flow("f", (rules.Step("a", guard=True),)), rules.Loop("", 2), rules.Flow("e", ()), rules.Rate("r", "(", 0, 0), rules.Budget("b", "", 0)]) == [
        "2 rules are called 'l'", "rule 'l': a call can't repeat 1 times", "rule 'f': a flow of guards alone never completes", "rule 'f': a guard has nothing to void before the first step", "rule '': a rule needs a name", "rule 'e': a flow needs steps",
        "rule 'r': a limit of less than one call forbids every call", "rule 'r': the time window is empty", "rule 'r': '(' is no regular expression", "rule 'b': a budget needs the path of a number", "rule 'b': a budget needs a total above 0",
    ]
    path = tmp_path / "pack.json"
    path.write_text(rules.to_json(pack))
    reloader = Reloader(spark, str(path))
    assert reloader.reload()
    path.write_text("[{]")
    assert not reloader.reload()
    assert (reloader.pack, reloader.version, [e["ok"] for e in reloader.log]) == (tuple(pack), 1, [True, False])
    assert [json.loads(r.record)["ok"] for r in reloader.lines().orderBy("seq").collect()] == [True, False]
    assert reloader.log == []


def test_module_packs_and_samples(spark, tmp_path, monkeypatch):
    (tmp_path / "own_pack.py").write_text("from wardline.operators.rules import Loop\nRULES = [Loop('twice', 2)]")
    (tmp_path / "bad_pack.py").write_text("RULES = [Loop]\nLoop = 1")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert packs.load(spark, module="own_pack") == (rules.Loop("twice", 2),)
    monkeypatch.setenv("WARDLINE_RULES_MODULE", "own_pack")
    assert packs.load(spark) == (rules.Loop("twice", 2),)
    assert not Reloader(spark, module="bad_pack").reload()
    hits = packs.tried(rules.DEFAULT_PACK)
    assert {k: v for k, v in hits.items() if v} == {
        "inbox-to-external-email": ["inbox-to-external-email"], "secret-read-then-exfil": ["secret-read-then-exfil"], "shell-then-k8s-apply": ["shell-read-then-k8s-apply"], "retry-loop": ["denied-tool-retry-loop"], "rate-spray": ["per-tool-rate-limit"],
    }
    assert len(hits) == 7


def test_external_recipients():
    hit = lambda to: run(rules.DEFAULT_PACK, [("inbox_read", {}), ("email_send", {"to": to})])[-1] is not None
    assert [hit(x) for x in ("a@evil.example", "x@mail.local", "a@example.org", "a@internal.local", "a@corp.local", "no address", 7, ["a@evil.example"])] == [True, True, False, False, False, False, False, False]


def test_config():
    cfg = from_env({"FAILURE_MODE": "nonsense", "HUMAN_REVIEW_MODE": "DENY", "ENABLE_REDACTION": "no", "MAX_CONTENT_BYTES": "12", "PG_MAX_WINDOWS": "x", "DENY_TOOLS": "a, b/*", "GUARDRAIL_DRY_RUN": "1", "PG_REVIEW_THRESHOLD": "0.95"})
    assert (cfg.failure_mode, cfg.human_review_mode, cfg.enable_redaction, cfg.max_content_bytes, cfg.pg_max_windows, cfg.deny_tools) == ("failClosed", "deny", False, 12, 16, ("a", "b/*"))
    assert (cfg.dry_run, cfg.pg_review_threshold) == (True, 0.9)


def test_stream_agrees_with_batch(spark, tmp_path):
    from wardline.streaming.traces import snapshot, trace_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else state clean-up goes on for ever
    rows = random_calls(200, 8)
    calls = spark.createDataFrame(rows, "key string, seq long, ts timestamp, tool string, args string").withColumn("recorded", F.col("tool") != "")
    for k in range(2):
        calls.where((F.col("seq") >= k * 100) & (F.col("seq") < k * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = trace_stream(source, PACK, WINDOW).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = {r.seq: r.rule for r in spark.table("fired").collect()}
    want = {r.seq: r.rule for r in fold_keys(calls, PACK, WINDOW).collect()}
    assert got == want
    kept = {r.key: r for r in snapshot(spark, str(tmp_path / "cp")).collect()}
    assert set(kept) == set("pqr")
    for key in "pqr":
        assert list(kept[key].tools) == [r[3] for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[0] == key and r[3]][-WINDOW:]


def test_a_stream_is_reset_drained_and_stopped(spark, tmp_path):
    from wardline.streaming.traces import shut_down, spans, trace_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("k", s, START + timedelta(seconds=s), "w", "{}", True, s == 3) for s in range(6)]
    calls = spark.createDataFrame(rows, "key string, seq long, ts timestamp, tool string, args string, recorded boolean, reset boolean")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = trace_stream(source, [rules.Loop("loop", 3)], WINDOW).writeStream.format("memory").queryName("after_reset").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    shut_down([q], 20.0)
    assert not q.isActive
    assert {r.seq: r.rule for r in spark.table("after_reset").collect()} == {0: None, 1: None, 2: "loop", 3: None, 4: None, 5: "loop"}
    assert {"addBatch", "triggerExecution"} <= {s["name"] for s in spans(q)}


def drained(stream, out, checkpoint):
    """Run a stream over what is there, as after a restart."""
    from wardline.streaming.replay import settings

    with settings(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        assert q.awaitTermination(200)


CALLS = "key string, seq long, ts timestamp, tool string, args string, recorded boolean"


def test_traces_beyond_the_bound_go_by_use(spark, tmp_path):
    """The key that recorded a call the longest ago loses its trace; a call that isn't recorded is no use."""
    from wardline.streaming.traces import snapshot, trace_stream

    keys = [("a", True), ("b", True), ("c", True), ("a", True), ("b", False), ("d", True), ("b", True), ("d", True), ("c", True)]
    rows = [(k, s, START + timedelta(seconds=s), "w", "{}", r) for s, (k, r) in enumerate(keys)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = trace_stream(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")), [rules.Loop("loop", 2)], WINDOW, shards=1, most=3)
        drained(stream, tmp_path / "out", tmp_path / "cp")
    got = {r.seq: (r.rule, r.evicted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # d comes when b is the oldest, b when c is, c when a is: all but a and d begin anew
    assert got == {0: (None, None), 1: (None, None), 2: (None, None), 3: ("loop", None), 4: (None, None), 5: (None, "b"), 6: (None, "c"), 7: ("loop", None), 8: (None, "a")}
    assert {r.key: list(r.tools) for r in snapshot(spark, str(tmp_path / "cp")).collect()} == {"b": ["w"], "c": ["w"], "d": ["w", "w"]}


def test_rules_are_data_of_a_running_stream(spark, tmp_path):
    """A new pack acts from the batch on in which it comes; what flows have passed is kept by rule name; a bad pack changes nothing."""
    from wardline.streaming.traces import packs_stream, trace_stream

    flow = lambda last: rules.Flow("flow", (rules.Step("a"), rules.Step(last)))
    tools = ["a", "n", "n", "n", "b", "c", "c", "c"]
    (tmp_path / "packs").mkdir()
    for s, tool in enumerate(tools):
        spark.createDataFrame([("k", s, START + timedelta(seconds=s), tool, "{}", True)], CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if s == 5:
            (tmp_path / "packs" / "pack-7.json").write_text(rules.to_json([flow("c")]))
        if s == 6:
            (tmp_path / "packs" / "pack-9.json").write_text('[{"kind": "flow"}]')
            (tmp_path / "packs" / "pack-3.json").write_text(rules.to_json([rules.Loop("old", 2)]))
        if s == 7:
            (tmp_path / "packs" / "pack-8.json").write_text(rules.to_json([rules.Loop("three", 3, "said so")]))
        if s >= 3:
            calls = spark.readStream.schema(CALLS).parquet(str(tmp_path / "in"))
            drained(trace_stream(calls, [flow("z")], 2, packs=packs_stream(spark, str(tmp_path / "packs")), shards=2), tmp_path / "out", tmp_path / "cp")
    got = {r.seq: (r.rule, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (None, 1), 1: (None, 1), 2: (None, 1), 3: (None, 1), 4: (None, 1), 5: ("flow", 7), 6: (None, 7), 7: (None, 8)}


def test_rows_leave_a_shard_some_at_a_time(spark):
    """A shard with many rows of one micro-batch gives frames of BATCH_ROWS at most, all rows once and in order; Arrow batches of a replayed stream have the same bound."""
    import pandas as pd

    from wardline.streaming.replay import settings
    from wardline.streaming.traces import BATCH_ROWS, TraceProcessor

    class State(dict):
        removeKey = dict.pop
        containsKey, getValue, updateValue, iterator = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.items
        exists, get, update = (lambda self: None in self), (lambda self: self[None]), (lambda self, value: self.__setitem__(None, value))

    class Handle:
        def getMapState(self, *_, **__):
            return State()

        getValueState = getMapState

    n = 2 * BATCH_ROWS + 5
    rows = pd.DataFrame({"key": [f"k{k % 7}" for k in range(n)], "seq": range(n), "t": [float(k) for k in range(n)], "tool": "look", "args": "{}", "fp": None, "recorded": True, "reset": False, "version": None, "pack": None, "payload": [f"p{k}" for k in range(n)]})
    of = TraceProcessor((), 1, 256, 600.0, 4096, 0, 100, ("payload",))
    of.init(Handle())
    frames = list(of.handleInputRows((0,), iter([rows[BATCH_ROWS:], rows[:BATCH_ROWS]]), None))
    assert [len(f) for f in frames] == [BATCH_ROWS, BATCH_ROWS, 5]
    assert [tuple(r) for f in frames for r in f[["seq", "key", "payload"]].itertuples(index=False)] == [(k, f"k{k % 7}", f"p{k}") for k in range(n)]
    assert [len(f) for f in of.handleInputRows((0,), iter([rows[:0]]), None)] == [0]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    with settings(spark):
        assert spark.conf.get(size) == str(BATCH_ROWS)
    assert spark.conf.get(size) == before
