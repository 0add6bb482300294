"""Who calls what: access lists, correlation ids, callers, trace keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.patterns import BLOCK
from wardline.functions.scan import result

#: Metadata members that can hold the correlation id, in order (fixed value).
ID_KEYS = ("exchange_id", "request_id", "x_request_id", "trace_id")


def lowered(headers: Column) -> Column:
    """A header map by lower-case names; of names that differ in case alone the last counts."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x.key == e.key))
    return F.map_from_entries(last)


def header(headers: Column, name: str) -> Column:
    """A header's value by any case of its name."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e.key) == name.lower())
    return F.try_element_at(F.transform(hits, lambda e: e.value), F.lit(-1))


def acl_match(tool: Column, patterns: Sequence[str]) -> Column:
    """Whether a tool is on a list of names and `prefix/*` wildcards."""
    if not patterns:
        return F.lit(False)
    return reduce(Column.__or__, [tool.startswith(p[:-1]) if p.endswith("/*") else tool == p for p in patterns])


def acl_verdict(tool: Column, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """A blocking verdict for tools on the deny list, or off a non-empty allow list; else null."""
    said = lambda what: result("tool_acl", BLOCK, F.concat(F.lit("tool '"), tool, F.lit(f"' {what}")), 1.0)
    verdict = F.when(acl_match(tool, deny), said("denied by tool ACL"))
    if allow:
        verdict = verdict.when(~acl_match(tool, allow), said("not in tool allowlist"))
    return F.when(tool != "", verdict)


def sanitize_id(value: Column) -> Column:
    """Without outer white space and control characters, 64 characters at most."""
    inner = F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"[\x00-\x1f\x7f-\x9f]", "")
    return F.substring(inner, 1, 64)


def exchange_id(metadata: Column, headers: Column, fallback: Column) -> Column:
    """The first usable id of the metadata, then the x-request-id header, then a digest of `fallback`."""
    given = [F.nullif(sanitize_id(metadata[k]), F.lit("")) for k in ID_KEYS]
    return F.coalesce(*given, F.nullif(sanitize_id(header(headers, "x-request-id")), F.lit("")), F.substring(F.sha2(fallback.cast("string"), 256), 1, 8))


def caller(headers: Column, names: Sequence[str] = ("x-forwarded-user",)) -> Column:
    """The first listed header that has a value, 256 characters at most."""
    values = [F.nullif(header(headers, n), F.lit("")) for n in names]
    return F.substring(F.coalesce(*values, F.lit("")), 1, 256)


def trace_key(route: Column, services: Column, headers: Column | None = None, names: Sequence[str] = ()) -> Column:
    """The route or else the first service; the first listed header that has a value is added."""
    base = F.coalesce(F.nullif(route, F.lit("")), F.get(services, 0), F.lit(""))
    parts = [F.when(header(headers, n) != "", F.concat(F.lit(f"|{n}="), F.substring(header(headers, n), 1, 128))) for n in names]
    return F.concat(base, F.coalesce(*parts, F.lit(""))) if parts else base


def metadata_value(metadata: Column, name: str) -> Column:
    return F.coalesce(metadata[name], F.lit(""))
