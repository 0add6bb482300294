"""Content scans as Column expressions: first match by priority, fingerprints, the normalized second pass."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.parts import by_parts
from wardline.functions.patterns import ALLOW, BLOCK, LOOK_LIKE, LOOKALIKES, PATTERNS, SEVERITY, Pattern

RESULT = "struct<scanner:string,outcome:string,reason:string,score:double>"


def result(scanner: Column | str, outcome: Column | str, reason: Column | str, score: Column | float) -> Column:
    """One scanner's verdict as a struct."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(scanner).alias("scanner"), col(outcome).alias("outcome"), col(reason).alias("reason"), col(score).cast("double").alias("score"))


def has(text: Column, pattern: Pattern) -> Column:
    """Whether the pattern occurs; its literals are looked for first, or texts passed by that look harmless, which is far cheaper."""
    found = text.rlike(pattern.java)
    if pattern.harmless:
        found = ~text.rlike(pattern.harmless) & found
    return reduce(Column.__or__, [text.contains(n) for n in pattern.needs]) & found if pattern.needs else found


def first_index(text: Column, patterns: Sequence[Pattern] = PATTERNS) -> Column:
    """The number of the first pattern in order that occurs, null if none does; later ones aren't tried."""
    branch = F
    for k, p in enumerate(patterns):
        branch = branch.when(has(text, p), k)
    return branch if patterns else F.lit(None).cast("int")


def fence(value: Column) -> Column:
    """The value, marked so that the optimizer computes it once where it stands.

    Filters and projections above would otherwise be rewritten over copies of its whole expression, and
    verdicts over verdicts grow without bound. The row number is never below 0."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def digest12(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entry(index: Column, patterns: Sequence[Pattern]) -> Column:
    """What is known of the pattern at an index, from one literal table, so that plans stay small; null for none."""
    row = "named_struct('scanner', {}, 'outcome', {}, 'reason', {}, 'score', {}D, 'secret', {}, 'regex', {})"
    rows = (row.format(_sql_text(f"regex:{p.name}"), _sql_text(p.outcome), _sql_text(p.reason), float(p.score), str(p.high_entropy).lower(), _sql_text(p.java)) for p in patterns)
    return F.get(F.expr(f"array({', '.join(rows)})"), index)


def _severity(index: Column, patterns: Sequence[Pattern]) -> Column:
    """The severity of the pattern at an index, -1 for none."""
    return F.coalesce(F.get(F.expr(f"array({', '.join(str(SEVERITY[p.outcome]) for p in patterns)})"), index), F.lit(-1))


def _found(text: Column, entry: Column) -> Column:
    """The first match of an entry's pattern."""
    return F.call_function("regexp_extract", text, entry["regex"], F.lit(0))


def hmac12(value: Column, key: str) -> Column:
    """Twelve hex digits of HMAC-SHA256, from the hash function alone: two nested hashes over padded keys."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), value.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 12)


def hit(text: Column, index: Column, patterns: Sequence[Pattern] = PATTERNS, key: str | None = None) -> Column:
    """The verdict of the pattern at `index` on the text, null for none: with the match's length and, unless the
    match could be guessed, twelve hex digits of its (keyed) digest."""
    p = _entry(index, patterns)
    match = _found(text, p)
    digest = F.concat(F.lit(" match_hmac="), hmac12(match, key)) if key else F.concat(F.lit(" match_sha256="), digest12(match))
    shown = F.concat(p["reason"], F.lit(" (match_len="), F.char_length(match).cast("string"), F.when(p["secret"], digest).otherwise(""), F.lit(")"))
    return F.when(index.isNotNull(), result(p["scanner"], p["outcome"], shown, p["score"]))


def hit_in_view(text: Column, view: Column, index: Column, patterns: Sequence[Pattern] = PATTERNS, key: str | None = None) -> Column:
    """As `hit`, for a match in the normalized view: its length there and a digest of the original text."""
    p = _entry(index, patterns)
    tag = F.concat(F.lit("orig_hmac="), hmac12(text, key)) if key else F.concat(F.lit("orig_sha256="), digest12(text))
    shown = F.concat(p["reason"], F.lit(" [normalized-view match] (match_len="), F.char_length(_found(view, p)).cast("string"), F.lit(" "), tag, F.lit(")"))
    return F.when(index.isNotNull(), result(p["scanner"], p["outcome"], shown, p["score"]))


def clean() -> Column:
    return result("regex", ALLOW, "", 0.0)


@F.arrow_udf(T.StringType())
def nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility composition; there is no built-in for it."""
    yield from by_parts(texts, pa.string(), lambda some: [None if t is None else unicodedata.normalize("NFKC", t) for t in some])


def normalized_view(text: Column) -> Column:
    """NFKC, without format characters, lookalike letters as ASCII; only for matching, never for output."""
    return F.translate(F.regexp_replace(nfkc(text), r"\p{Cf}", ""), LOOKALIKES, LOOK_LIKE)


def scan(df: DataFrame, text: str, out: str = "scan", patterns: Sequence[Pattern] = PATTERNS, normalize: bool = True, key: str | None = None) -> DataFrame:
    """`df` with one verdict more: that of the first matching pattern, else plain allow.

    Unless the text blocks already or is ASCII, its normalized view is searched too, and the hit there
    wins if it is more severe. Only such texts travel to Python for the view; for the others it is null.
    """
    spare = ["__first", "__view", "__second"]
    df = df.withColumn("__first", fence(first_index(F.col(text), patterns)))
    own = hit(F.col(text), F.col("__first"), patterns, key)
    if not normalize:
        return df.withColumn(out, fence(F.coalesce(own, clean()))).drop(*spare)
    severity = lambda i: _severity(i, patterns)
    open_ = (F.octet_length(text) != F.char_length(text)) & (severity(F.col("__first")) < SEVERITY[BLOCK])
    df = df.withColumn("__view", F.when(open_, F.col(text))).withColumn("__view", normalized_view(F.col("__view")))
    df = df.withColumn("__second", fence(F.when(F.col("__view") != F.col(text), first_index(F.col("__view"), patterns))))
    better = F.col("__second").isNotNull() & (severity(F.col("__second")) > severity(F.col("__first")))
    seen = hit_in_view(F.col(text), F.col("__view"), F.col("__second"), patterns, key)
    return df.withColumn(out, fence(F.when(better, seen).otherwise(F.coalesce(own, clean())))).drop(*spare)


@F.arrow_udf(T.ArrayType(T.StringType()))
def views(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The normalized view of each chunk; null for ASCII chunks and where the view is the chunk itself."""
    table = str.maketrans(LOOKALIKES, LOOK_LIKE)

    def one(text: str) -> str | None:
        if text.isascii():
            return None
        view = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").translate(table)
        return None if view == text else view

    yield from by_parts(chunks, pa.list_(pa.string()), lambda some: [None if xs is None else [one(x) for x in xs] for xs in some])


def scan_chunks(df: DataFrame, chunks: str, out: str, patterns: Sequence[Pattern] = PATTERNS, key: str | None = None) -> DataFrame:
    """As `scan`, over an array of texts: one verdict for each of them, in order, without exploding rows.

    Rows whose chunks are all ASCII don't travel to Python."""
    severity = lambda i: _severity(i, patterns)
    odd = F.exists(chunks, lambda c: F.octet_length(c) != F.char_length(c))
    df = df.withColumn("__v", F.when(odd, F.col(chunks))).withColumn("__v", views("__v"))
    seen = lambda x: F.when(x.v.isNotNull() & (severity(x.i) < SEVERITY[BLOCK]), first_index(x.v, patterns))
    df = df.withColumn("__f", fence(F.transform(chunks, lambda c, k: F.struct(c.alias("c"), F.get("__v", k).alias("v"), first_index(c, patterns).alias("i")))))
    df = df.withColumn("__f", fence(F.transform("__f", lambda x: F.struct(x.c.alias("c"), x.v.alias("v"), x.i.alias("i"), seen(x).alias("j")))))
    better = lambda x: x.j.isNotNull() & (severity(x.j) > severity(x.i))
    verdict = lambda x: F.when(better(x), hit_in_view(x.c, x.v, x.j, patterns, key)).otherwise(F.coalesce(hit(x.c, x.i, patterns, key), clean()))
    return df.withColumn(out, fence(F.transform("__f", verdict))).drop("__v", "__f")
