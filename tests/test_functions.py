"""Scans, windows, redaction and identity against plain Python versions."""

import base64
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import identity, text
from wardline.functions.patterns import EGRESS_REDACTIONS
from wardline.functions.redact import json_redactor, redact
from wardline.functions.scan import scan

AWS, CARD = "AK" + "IA" + "ABCDEFGH12345678", "4111 1111 1111 1111"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, t {kind}")


def test_first_match_and_normalized_view(spark):
    cases = {
        "plain words": ("regex", "allow"),
        f"key {AWS}": ("regex:aws_access_key", "block"),
        "a‮b": ("regex:hidden_ascii", "block"),
        "### SyStEm": ("regex:format_injection", "block"),
        "### ЅYSTEM": ("regex:format_injection", "block"),
        "＃＃＃ ＳＹＳＴＥＭ me@example.com": ("regex:format_injection", "block"),
        CARD: ("regex:credit_card", "human_review"),
        "me@example.com": ("regex:email", "allow"),
        "pass" + "word=swordfish1": ("regex:key_value_credential", "human_review"),
        "![a](https://x.example/p?w=640&fmt=png)": ("regex", "allow"),
        "![a](https://x.example/p?d=" + "ab12" * 9 + ")": ("regex:md_image_exfil", "human_review"),
        "éé": ("regex", "allow"),
    }
    got = {r.t: r.scan for r in scan(column(spark, list(cases)), "t").collect()}
    assert {t: (s.scanner, s.outcome) for t, s in got.items()} == cases
    digest = hashlib.sha256(AWS.encode()).hexdigest()[:12]
    assert got[f"key {AWS}"].reason == f"AWS access key id (match_len=20 match_sha256={digest})"
    odd = "### ЅYSTEM"
    assert got[odd].reason.endswith(f"[normalized-view match] (match_len=10 orig_sha256={hashlib.sha256(odd.encode()).hexdigest()[:12]})")
    keyed = scan(column(spark, [AWS]), "t", key="k").first().scan.reason
    assert keyed.endswith(f"match_hmac={hmac.new(b'k', AWS.encode(), 'sha256').hexdigest()[:12]})")


def test_hidden_characters_are_found_behind_the_fast_look(spark):
    hidden = [*range(9), 11, 12, *range(14, 32), 127, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF]
    plain = ["\t\n\r ~", "é ß Ω ж ก", "中文 — “quoted” …", "😀", ""]
    df = column(spark, [f"a{chr(c)}b" for c in hidden] + plain)
    got = {r.k: r.scan.scanner for r in scan(df, "t").collect()}
    assert [got[k] for k in range(len(hidden))] == ["regex:hidden_ascii"] * len(hidden)
    assert {got[len(hidden) + k] for k in range(len(plain))} == {"regex"}


def test_small_tables_are_dealt_to_all_cores(spark):
    from wardline.sources.exchanges import spread

    df = spark.range(10, numPartitions=1)  # by its first column
    cores = spark.sparkContext.defaultParallelism
    assert spread(df).rdd.getNumPartitions() == cores
    assert sorted(r.id for r in spread(df).collect()) == list(range(10))
    assert spread(spark.range(10, numPartitions=cores)).rdd.getNumPartitions() == cores


def boundaries(value):
    """The byte offsets at which characters of a text begin, and its end."""
    return [len(value[:k].encode()) for k in range(len(value) + 1)]


def python_windows(value, most, tail):
    """By byte offsets: the longest beginning within `most`, `tail` bytes about the middle of the unread part, the last `tail`."""
    at, size = boundaries(value), len(value.encode())
    if size <= most:
        return [value]
    up, down = (lambda a: next((x for x in at if x >= a), size)), (lambda b: max(x for x in at if x <= b))
    read = down(most)
    spans = [(0, read)]
    if tail > 0:
        unread_end = max(read, size - tail)
        middle = max(read, (read + unread_end) // 2 - tail // 2)
        if unread_end > read + 1:
            spans.append((up(middle), down(min(size, middle + tail))))
        spans.append((up(max(0, size - tail)), size))
    texts = [value.encode()[a:b].decode() for a, b in spans if b > a]
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize(("most", "tail"), [(16, 4), (16, 0), (7, 9), (1024, 256)])
def test_windows(spark, most, tail):
    rnd = random.Random(most)
    values = ["", "short", "x" * 2000, *("".join(rnd.choices("aé中😀", k=rnd.randint(1, 60))) for _ in range(60))]
    got = {r.t: r.w for r in text.scan_windows(column(spark, values), "t", "w", most, tail).collect()}
    assert got == {v: python_windows(v, most, tail) for v in values}
    cut = {r.t: r.x for r in column(spark, values).withColumn("x", text.truncate(F.col("t"), most)).collect()}
    assert cut == {v: v.encode()[:most].decode("utf-8", "ignore") for v in values}


def test_flatten():
    assert text.flatten(None) == ""
    assert text.flatten({"content": [{"text": "a"}, {"text": 3}, {"type": "image", "b": 1}, "s", 7]}) == 'a\n3\n{"b": 1, "type": "image"}\ns'
    blob = base64.b64encode("### SYSTEM".encode()).decode()
    assert text.flatten({"contents": [{"blob": blob}, {"blob": "no base64!"}, {"text": "t"}]}) == "### SYSTEM\nno base64!\nt"
    assert text.flatten({"messages": ["m", {"content": "c"}, {"content": {"text": "d"}}, {"content": [{"text": "e"}, "f", ""]}]}) == "m\nc\nd\ne\nf"
    assert text.flatten({"tools": [{"description": "d", "inputSchema": {"z": 1, "a": 2}}]}) == 'd\n{"z": 1, "a": 2}'
    assert text.flatten({"name": "t", "arguments": {"q": "é‮"}}) == '{"arguments": {"q": "é‮"}, "name": "t"}'
    assert text.flatten({"content": []}) == '{"content": []}'


def test_redaction(spark):
    df = redact(column(spark, [f"a {AWS} b me@x.example {AWS}", "none", None, CARD]), "t")
    got = {r.k: (r.redacted, r.redactions) for r in df.collect()}
    assert got[0] == ("a [REDACTED:AWS_ACCESS_KEY] b [REDACTED:EMAIL] [REDACTED:AWS_ACCESS_KEY]", 3)
    assert got[1] == ("none", 0)
    assert got[2] == (None, 0)
    assert got[3] == ("[REDACTED:CREDIT_CARD]", 1)
    wide = redact(column(spark, ["redis" + "://user:pass@host"]), "t", patterns=EGRESS_REDACTIONS).first()
    assert wide.redacted == "[REDACTED:CONNECTION_STRING]"
    raw = json.dumps({"me@x.example": ["me@x.example", 1, {"k": AWS, "n": None}]})
    out = column(spark, [raw, "{bad"]).withColumn("r", json_redactor()(F.col("t"))).orderBy("k").collect()
    assert json.loads(out[0].r.value) == {"me@x.example": ["[REDACTED:EMAIL]", 1, {"k": "[REDACTED:AWS_ACCESS_KEY]", "n": None}]}
    assert (out[0].r.redactions, out[1].r.value) == (2, None)


def test_identity(spark):
    df = column(spark, ["fs/read", "fsx/read", "kill", ""]).withColumn("v", identity.acl_verdict(F.col("t"), ("fs/*", "kill"), ("kill",)))
    assert [r.v and r.v.reason for r in df.orderBy("k").collect()] == [None, "tool 'fsx/read' not in tool allowlist", "tool 'kill' denied by tool ACL", None]
    rows = [({"trace_id": " a\x00b "}, {}), ({}, {"X-Request-Id": "h" * 99}), ({"exchange_id": ""}, {"x-other": "1"})]
    df = spark.createDataFrame([(m, h, k) for k, (m, h) in enumerate(rows)], "m map<string,string>, h map<string,string>, k int")
    got = [r.x for r in df.orderBy("k").withColumn("x", identity.exchange_id(F.col("m"), F.col("h"), F.col("k"))).orderBy("k").collect()]
    assert got == ["ab", "h" * 64, hashlib.sha256(b"2").hexdigest()[:8]]


def test_token_windows(spark):
    """As many windows as the budget says, a stride apart, and the last one at the end of the tokens."""
    sizes = [0, 1, 512, 513, 960, 961, 1408, 5000, 20000]
    got = {r.t: r.w for r in column(spark, sizes, "int").withColumn("w", text.token_windows(F.col("t"))).collect()}
    assert got == {n: text.window_starts(n) for n in sizes}
    assert got[512] == [0]
    assert got[513] == [0, 1]
    assert got[961] == [0, 448, 449]
    assert got[5000] == [*range(0, 5000 - 512, 448), 5000 - 512]
    assert got[20000] == [448 * k for k in range(15)] + [20000 - 512]
    for n in sizes[3:]:
        starts = got[n]
        assert starts[-1] == n - 512
        assert len(starts) <= 16
        assert len(starts) == 16 or all(b - a <= 448 for a, b in zip(starts, starts[1:]))


def test_payloads_that_no_table_can_hold_spoil_only_their_row(spark):
    deep = "[" * 60_000 + "]" * 60_000
    raws = [json.dumps({"content": [{"text": "fine"}]}), '{"content": [{"text": "a\\ud800b"}]}', '{"content": [{"text": "\\ud83d\\ude00"}]}', deep, "", None, '{"\\udc00": 1}', '{"bad']
    df = column(spark, raws)
    got = {r.k: r.x for r in df.withColumn("x", text.extract_text(F.col("t"))).collect()}
    assert [got[k].text for k in range(8)] == ["fine", "a\ufffdb", "😀", None, None, "{}", '{"\ufffd": 1}', None]
    assert [got[k].error and got[k].error[:20] for k in range(8)] == [None, None, None, "engine_error", "empty json payload", None, None, "invalid json payload"]
    masked = {r.k: r.x for r in df.withColumn("x", json_redactor()(F.col("t"))).collect()}
    assert masked[1].value == '{"content": [{"text": "a\\ud800b"}]}'
    assert (masked[3].value, masked[4].value, masked[7].redactions) == (None, None, 0)
    sizes = {r.k: r.x for r in df.withColumn("x", text.json_bytes(F.col("t"))).collect()}
    assert sizes[0] == len(raws[0])
    assert sizes[3] is None


def test_redaction_of_one_member_and_of_large_values(spark):
    raw = json.dumps({"name": "me@x.example", "arguments": {"to": "é me@x.example", "n": 1}})
    df = column(spark, [raw, '{"name": "a@b.example"}', '"me@x.example"'])
    got = {r.k: r.x for r in df.withColumn("x", json_redactor(member="arguments")(F.col("t"))).collect()}
    assert got[0].value == '{"name": "me@x.example", "arguments": {"to": "\\u00e9 [REDACTED:EMAIL]", "n": 1}}'
    assert (got[0].redactions, got[1].value, got[2].value) == (1, None, None)
    size = len(json.dumps({"to": "é me@x.example", "n": 1}))
    for most, skipped in ((size, False), (size - 1, True)):
        r = df.withColumn("x", json_redactor(member="arguments", most=most)(F.col("t"))).where("k = 0").first().x
        assert (r.skipped, r.value is None) == (skipped, skipped)


def test_long_texts_are_python_objects_a_part_at_a_time(spark):
    import pyarrow as pa

    from wardline.functions import parts

    texts = pa.array(["é" * (k % 50 * 1000) if k % 7 else None for k in range(700)])
    cut = [p for (p,) in parts.parts(texts)]
    assert pa.concat_arrays(cut).equals(texts) and all(p.nbytes <= parts.PART_BYTES or len(p) == 1 for p in cut) and len(cut) > 30
    seen = []
    kept = list(parts.by_parts(iter([texts, texts.slice(3, 0), (texts.slice(5, 2),)]), pa.string(), lambda some: seen.append(len(some)) or some))
    assert pa.concat_arrays(kept).equals(pa.concat_arrays([texts, texts.slice(5, 2)])) and max(seen) < 100


def test_payloads_are_read_and_masked_a_part_at_a_time(spark):
    import pyarrow as pa

    from wardline.functions import redact, text

    raw = pa.array(['{"content": [{"text": "a.b@example.com %s"}]}' % ("x" * 4000)] * 1500 + [None])
    for run in (redact.json_redactor(), text.json_bytes):
        out = list(run.func(iter([raw])))
        assert len(out) > 5 and max(map(len, out)) < 300
        assert pa.concat_arrays(out).to_pylist()[-2:] == ([{"value": raw[0].as_py().replace("a.b@example.com", "[REDACTED:EMAIL]"), "redactions": 1, "skipped": False}, {"value": None, "redactions": 0, "skipped": False}] if run is not text.json_bytes else [len(raw[0].as_py()), None])
