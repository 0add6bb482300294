"""Masking of secrets and personal data in text and in JSON values."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardline.functions.parts import by_parts
from wardline.functions.patterns import REDACTION_NEEDS, REDACTIONS
from wardline.functions.text import MASKED, value_bytes


def placeholder(name: str) -> str:
    return f"[REDACTED:{name.upper()}]"


def redact(df: DataFrame, text: str, out: str = "redacted", count: str = "redactions", patterns: Sequence[tuple[str, str]] = REDACTIONS) -> DataFrame:
    """`df` with the masked text and the number of substitutions, in order of the patterns.

    Each pattern sees what the ones before it left. Texts without its literals are passed by; a text that
    no pattern touches flows through unchanged."""
    df = df.withColumns({out: F.col(text), count: F.lit(0).cast("long")})
    for name, regex in patterns:
        needs, java = REDACTION_NEEDS.get(name, ()), "(?U)" + regex
        may = reduce(Column.__or__, [F.col(out).contains(n) for n in needs]) if needs else F.lit(True)
        found = F.when(may, F.regexp_count(out, F.lit(java))).otherwise(0)
        df = df.withColumn("__n", found)
        df = df.withColumns({count: F.col(count) + F.coalesce("__n", F.lit(0)), out: F.when(F.col("__n") > 0, F.regexp_replace(out, java, placeholder(name))).otherwise(F.col(out))})
    return df.drop("__n")


def _python(regex: str) -> re.Pattern[str]:
    return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), regex))


def masker(patterns: Sequence[tuple[str, str]] = REDACTIONS) -> Callable[[str], tuple[str, int]]:
    """A function from text to the masked text and the number of substitutions, for use in workers."""
    compiled = [(placeholder(n), _python(r)) for n, r in patterns]

    def mask(text: str) -> tuple[str, int]:
        total = 0
        for mark, regex in compiled:
            text, n = regex.subn(mark, text)
            total += n
        return text, total

    return mask


def json_masker(patterns: Sequence[tuple[str, str]] = REDACTIONS, member: str | None = None, most: int = 0) -> Callable[[str | None], tuple[str | None, int, bool]]:
    """A function from JSON text to MASKED: strings at any depth are masked, keys, numbers and shape stay, and the value
    is ASCII JSON. With `member` only that member of an object is masked; what is larger than `most` bytes (0: no bound)
    is left alone and marked as skipped. Invalid JSON, nesting without end, a missing member and null give null and 0."""
    mask = masker(patterns)

    def walk(value: Any) -> tuple[Any, int]:
        if isinstance(value, str):
            return mask(value)
        if isinstance(value, dict):
            done = {k: walk(v) for k, v in value.items()}
            return {k: v for k, (v, _) in done.items()}, sum(n for _, n in done.values())
        if isinstance(value, list):
            done = [walk(v) for v in value]
            return [v for v, _ in done], sum(n for _, n in done)
        return value, 0

    def one(raw: str | None) -> tuple[str | None, int, bool]:
        try:
            whole = json.loads(raw)
            part = whole if member is None else whole[member]
            if part is None or 0 < most < value_bytes(part):
                return None, 0, part is not None
            part, n = walk(part)
            return json.dumps(part if member is None else {**whole, member: part}), n, False
        except (TypeError, ValueError, KeyError, RecursionError):
            return None, 0, False

    return one


def json_redactor(patterns: Sequence[tuple[str, str]] = REDACTIONS, member: str | None = None, most: int = 0):
    """`json_masker` as an Arrow UDF."""
    one, kind = json_masker(patterns, member, most), to_arrow_type(MASKED)

    @F.arrow_udf(MASKED)
    def run(raw: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_parts(raw, kind, lambda some: [dict(zip(MASKED.names, one(r), strict=True)) for r in some])

    return run


def payload_masker(requests: bool = False, most: int = 0) -> Callable[[bool, str | None], tuple[str | None, int, bool]]:
    """For `text.read`: a function from whether a payload is a request, and the payload, to MASKED. Answers are masked whole,
    arguments of requests only if `requests`; there is a value only where something was masked."""
    whole, arguments = json_masker(most=most), json_masker(member="arguments", most=most)

    def one(request: bool, raw: str | None) -> tuple[str | None, int, bool]:
        value, n, skipped = (arguments if request else whole)(raw if requests or not request else None)
        return (value if n else None), n, skipped

    return one


def redaction_gate(deny: Column, review: Column, on_review: bool = True) -> Column:
    """Null where a payload is to be masked, else why not: denied or review. Size is judged by the redactor."""
    gate = F.when(deny, F.lit("denied"))
    return gate if on_review else gate.when(review, F.lit("review"))


def tagged(reason: Column, n: Column) -> Column:
    """The reason with the number of substitutions behind it."""
    tag = F.when(n > 0, F.concat(F.lit("redaction:"), n.cast("string"), F.lit(" substitution(s)")))
    return F.concat_ws(";", F.nullif(reason, F.lit("")), tag)
