"""Payload text: JSON parsing and flattening, byte windows, coverage, digests."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardline.functions.parts import by_parts
from wardline.functions.scan import digest12, fence, result

#: Decoded bytes of one embedded blob at most.
BLOB_BYTES = 256 * 1024


def dumped(value: Any) -> str:
    """JSON with sorted keys and raw Unicode, so that hidden characters stay visible to the scans."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def decoded_blob(blob: str) -> str:
    """Base64 text as characters; what isn't base64 stays as it is, cut to the same bound."""
    most = BLOB_BYTES // 3 * 4
    blob = blob[:most] if len(blob) > most else blob
    try:
        return base64.b64decode(blob, validate=True)[:BLOB_BYTES].decode("utf-8", "ignore")
    except ValueError:
        return blob


def _item(item: Any, field: str = "text") -> str | None:
    """A list item's own text: strings as they are, objects by their text or else dumped, others dropped."""
    if isinstance(item, dict):
        own = item.get(field)
        return dumped(item) if own is None else own if isinstance(own, str) else str(own)
    return item if isinstance(item, str) else None


def _resource(item: Any) -> str | None:
    if isinstance(item, dict) and not isinstance(item.get("text"), str):
        blob = item.get("blob")
        return decoded_blob(blob) if isinstance(blob, str) else dumped(item)
    return _item(item)


def _strict(item: Any) -> str | None:
    """As `_item`, but a text that isn't a string leaves the whole object to be dumped."""
    return dumped(item) if isinstance(item, dict) and not isinstance(item.get("text"), str) else _item(item)


def _message(message: Any) -> Iterator[str]:
    content = message.get("content") if isinstance(message, dict) else message
    for part in content if isinstance(content, list) and isinstance(message, dict) else [content]:
        text = _strict(part)
        if text:
            yield text


def _tool(tool: Any) -> Iterator[str]:
    if isinstance(tool, dict):
        yield str(tool.get("description", ""))
        if tool.get("inputSchema") is not None:
            yield json.dumps(tool["inputSchema"], ensure_ascii=False)


#: What each list member of a payload contributes, in the order in which they are looked for.
_LISTS = (
    ("content", lambda xs: [t for x in xs if (t := _item(x)) is not None]),
    ("contents", lambda xs: [t for x in xs if (t := _resource(x)) is not None]),
    ("messages", lambda xs: [t for x in xs for t in _message(x)]),
    ("tools", lambda xs: [t for x in xs for t in _tool(x) if t]),
)


def flatten(payload: Any) -> str:
    """The text of a payload that scans read: known list members first, else all of it as JSON."""
    if payload is None or isinstance(payload, str):
        return payload or ""
    for name, texts in _LISTS if isinstance(payload, dict) else ():
        if isinstance(items := payload.get(name), list) and (found := texts(items)):
            return "\n".join(found)
    return dumped(payload)


def storable(text: str) -> str:
    """The text with lone surrogates, which no table can hold, as U+FFFD; pairs of them become their character."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


#: What is said of payloads that can't be handled for another reason than bad JSON, like nesting without end.
ENGINE_ERROR = "engine_error"
#: The one method whose params name a tool, and the member that stands for params that are no object (fixed values).
TOOL_CALL, RAW = "tools/call", "_raw"
READ = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "error", "tool", "args", "fp")])
#: What masking makes of a payload.
MASKED = T.StructType([T.StructField("value", T.StringType()), T.StructField("redactions", T.LongType()), T.StructField("skipped", T.BooleanType())])
MARK = "…[truncated]"


def with_strings(value: Any, change: Callable[[str], Any]) -> Any:
    """A JSON value with every string in it, but for names, replaced by what `change` makes of it."""
    match value:
        case str():
            return change(value)
        case dict():
            return dict(zip(value, map(lambda v: with_strings(v, change), value.values()), strict=True))
        case list():
            return [with_strings(v, change) for v in value]
    return value


def shortened(args: Any, most: int = 4096) -> Any:
    """Arguments as a trace keeps them: if their JSON is longer than `most` (0: no bound), the strings share
    that length equally, 64 characters each at least, and what goes beyond its share is cut off."""
    if not 0 < most < len(json.dumps(args)):
        return args
    lengths: list[int] = []
    with_strings(args, lambda text: lengths.append(len(text)))
    share = max(64, most // len(lengths)) if lengths else most
    return with_strings(args, lambda text: text[:share] + MARK * (len(text) > share))


def finite(value: Any) -> Any:
    """A JSON value whose numbers every parser reads: infinities as the largest number, NaN as null."""
    match value:
        case float() if not math.isfinite(value):
            return None if math.isnan(value) else math.copysign(sys.float_info.max, value)
        case dict():
            return {k: finite(v) for k, v in value.items()}
        case list():
            return [finite(v) for v in value]
    return value


def sorted_json(value: Any) -> str:
    return storable(json.dumps(value, sort_keys=True, ensure_ascii=False))


def fingerprint(tool: str, args: Any) -> str:
    """What two calls have in common that are one: a digest of the tool and all arguments by sorted names. 1 is not 1.0."""
    return hashlib.sha256(f"{tool}:{json.dumps(args, sort_keys=True)}".encode("utf-8", "ignore")).hexdigest()[:32]


def parsed_args(args: str | None) -> Any:
    """Arguments from their JSON text; an empty object for text that is none or nests without end."""
    try:
        return json.loads(args) if args else {}
    except (ValueError, RecursionError):
        return {}


def _loaded(raw: str | bytes | None, request: bool) -> tuple[Any, str | None]:
    """The value of a raw payload and its error. A null request is an empty object, and one that is no object the
    member RAW of one; an empty payload is an error."""
    if raw is None and request:
        return {}, None
    if raw is None or len(raw) == 0:
        return None, "empty json payload"
    try:
        value = json.loads(raw)
    except RecursionError:
        return None, ENGINE_ERROR
    except ValueError as e:
        return None, storable(f"invalid json payload: {e}")
    return ({RAW: value} if request and not isinstance(value, dict) else value), None


def read_payload(raw: str | bytes | None, request: bool = True, method: str | None = TOOL_CALL, most: int = 0, flat: bool = True) -> tuple[str | None, ...]:
    """Text, error, tool, args and fingerprint of one payload, all from one parse; only the error where there is one.

    The tool is "" for all but calls of a tool by name; a name that is no string counts by its text. args are by
    sorted names, shortened to `most`; a call whose arguments are no object can't be told and is an error.
    Whatever one payload holds, only its own row has the error."""
    value, error = _loaded(raw, request)
    if error:
        return None, error, None, None, None
    try:
        text, tool, args = storable(flatten(value)) if flat else None, "", {}
        if request and method == TOOL_CALL:
            tool = storable(str(value.get("name", "")))
            args = dict(value.get("arguments") or {}) if tool else {}
        return text, None, tool, sorted_json(finite(shortened(args, most))), fingerprint(tool, args)
    except (RecursionError, TypeError, ValueError):
        return None, ENGINE_ERROR, None, None, None


def read(phase: Column, method: Column, payload: Column, most: int = 0, flat: bool = True, mask: Callable[[bool, str | None], tuple[str | None, int, bool]] | None = None) -> Column:
    """struct<text, error, tool, args, fp> of exchanges; see `read_payload`. Without `flat` the text is left out. With `mask`
    (see `redact.payload_masker`) there is a member `masked`, made in the same pass, so that masking needs no worker of its own."""

    names = READ.names
    schema = T.StructType([*READ, T.StructField("masked", MASKED)]) if mask else READ
    kind = to_arrow_type(schema)

    def one(p: str | None, m: str | None, r: str | bytes | None) -> dict[str, Any]:
        got = dict(zip(names, read_payload(r, p == "request", m, most, flat), strict=True))
        return got | {"masked": dict(zip(MASKED.names, mask(p == "request", r), strict=True))} if mask else got

    @F.arrow_udf(schema)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from by_parts(batches, kind, lambda *columns: list(map(one, *columns)))

    return run(phase, method, payload)


def extract_text(raw: Column, request: bool = True) -> Column:
    """struct<text, error> of a raw JSON payload. A null request is an empty object; an empty one is an error."""
    got = read(F.lit("request" if request else "response"), F.lit(""), raw)
    return F.struct(got["text"].alias("text"), got["error"].alias("error"))


@F.arrow_udf(T.StringType())
def call_print(calls: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The fingerprint of calls whose arguments are JSON text."""
    yield from by_parts(calls, pa.string(), lambda tool, args: [None if t is None else fingerprint(t, parsed_args(a)) for t, a in zip(tool, args, strict=True)])


@F.arrow_udf(T.StringType())
def shortened_json(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """`shortened` on JSON text, by sorted names; null for null."""
    yield from by_parts(rows, pa.string(), lambda args, most: [None if a is None else sorted_json(finite(shortened(parsed_args(a), int(n)))) for a, n in zip(args, most, strict=True)])


def _byte(data: Column, at: Column) -> Column:
    """The byte after the first `at` ones."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def _inside(data: Column, at: Column) -> Column:
    """Whether a cut after `at` bytes falls into a character."""
    return _byte(data, at).between(0x80, 0xBF)


def cut_back(data: Column, at: Column) -> Column:
    """The last character boundary at or before `at`: at most three steps."""
    step = lambda k: _inside(data, at - k)
    return F.when(~F.coalesce(step(0), F.lit(False)), at).when(~step(1), at - 1).when(~step(2), at - 2).otherwise(at - 3)


def cut_forward(data: Column, at: Column) -> Column:
    step = lambda k: F.coalesce(_inside(data, at + k), F.lit(False))
    return F.when(~step(0), at).when(~step(1), at + 1).when(~step(2), at + 2).otherwise(at + 3)


def truncate(text: Column, most: int) -> Column:
    """At most so many bytes, cut at a character; no bound for 0 and less."""
    data = F.encode(text, "UTF-8")
    if most <= 0:
        return text
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), cut_back(data, F.lit(most))), "UTF-8"))


def scan_windows(df: DataFrame, text: str, out: str, most: int, tail: int) -> DataFrame:
    """`df` with the parts of a text that scans read: its beginning and, where it is longer, a middle and an end.

    The middle lies around the centre of what the beginning and the end leave; parts that are empty or
    repeat an earlier one are dropped. The bounds are columns of their own, so that each is computed once."""
    whole = F.array(text)
    if most <= 0:
        return df.withColumn(out, whole)
    long, c = F.octet_length(text) > most, F.col
    part = lambda a, b: F.when(b > a, F.decode(F.substring(c("__d"), a + 1, b - a), "UTF-8"))
    df = df.withColumns({"__d": F.when(long, F.encode(c(text), "UTF-8")), "__t": F.octet_length(text)})
    df = df.withColumn("__h", fence(cut_back(c("__d"), F.lit(most))))
    parts = [part(F.lit(0), c("__h"))]
    if tail > 0:
        df = df.withColumn("__s", F.greatest(c("__h"), c("__t") - tail))
        df = df.withColumn("__m", F.greatest(c("__h"), F.floor((c("__h") + c("__s")) / 2).cast("int") - tail // 2))
        df = df.withColumns({"__a": fence(cut_forward(c("__d"), c("__m"))), "__b": fence(cut_back(c("__d"), F.least(c("__m") + tail, c("__t")))), "__e": fence(cut_forward(c("__d"), F.greatest(F.lit(0), c("__t") - tail)))})
        parts += [F.when(c("__s") - c("__h") > 1, part(c("__a"), c("__b"))), part(c("__e"), c("__t"))]
    found = F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))
    return df.withColumn(out, fence(F.when(long, found).otherwise(whole))).drop("__d", "__t", "__h", "__s", "__m", "__a", "__b", "__e")


def coverage(text: Column, chunks: Column, most: int) -> dict[str, Column]:
    """total_bytes, scanned_bytes (overlaps count twice up to the total), truncated (the text was over the budget)."""
    total = F.octet_length(text).cast("long")
    read = F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + F.octet_length(c))
    return {"total_bytes": total, "scanned_bytes": F.least(read, total), "truncated": (total > most) if most > 0 else F.lit(False)}


def payload_size(total: Column, scanned: Column, most: int = 1048576) -> Column:
    """A review verdict for payloads over the cap, else null; no cap for 0 and less."""
    if most <= 0:
        return F.lit(None).cast("struct<scanner:string,outcome:string,reason:string,score:double>")
    reason = F.concat(F.lit("payload exceeds scan hard limit: scanned "), scanned.cast("string"), F.lit(" of "), total.cast("string"), F.lit(f" bytes (limit {most})"))
    return F.when(total > most, result("payload_size", "human_review", reason, 1.0))


def payload_digest(text: Column) -> Column:
    return digest12(text)


def payload_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def value_bytes(value: Any) -> int:
    """The size of a JSON value: of a string its own bytes, of others those of their JSON text, 0 if it has none."""
    try:
        return len((value if isinstance(value, str) else json.dumps(value, default=str)).encode("utf-8", "ignore"))
    except (TypeError, ValueError, RecursionError):
        return 0


@F.arrow_udf(T.LongType())
def json_bytes(raw: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`value_bytes` of JSON text, null for null and for text that is none."""

    def one(text: str | None) -> int | None:
        try:
            return value_bytes(json.loads(text))
        except (TypeError, ValueError, RecursionError):
            return None

    yield from by_parts(raw, pa.int64(), lambda some: [one(r) for r in some])


def softmax_last(logits: Column) -> Column:
    """The last entry of the softmax, computed against the largest entry."""
    top = F.array_max(logits)
    return F.exp(F.element_at(logits, -1) - top) / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))


def token_windows(n: Column, win: int = 512, stride: int = 64, most: int = 16) -> Column:
    """Starts of the classifier's windows over n tokens: evenly spaced, and always one at the end."""
    win = max(8, win)
    step = max(1, win - max(0, stride))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - win), F.lit(step))
    needed = F.floor((n - win + step) / step) + 1
    budget = F.least(F.greatest(F.lit(4), needed), F.lit(max(1, most))).cast("int")
    some = F.slice(starts, 1, F.greatest(F.lit(0), budget - 1))
    last = (n - win).cast("int")
    full = F.when(F.coalesce(F.try_element_at(some, F.lit(-1)), F.lit(-1)) == last, some).otherwise(F.concat(some, F.array(last)))
    return F.when(n <= win, F.array(F.lit(0))).otherwise(full)


def window_starts(n: int, win: int = 512, stride: int = 64, most: int = 16) -> list[int]:
    """As `token_windows`, of one number."""
    win = max(8, win)
    step, end = max(1, win - max(0, stride)), n - win
    if end <= 0:
        return [0]
    budget = min(max(4, (end + step) // step + 1), max(1, most))
    return sorted({*range(0, end + 1, step)[: budget - 1], end})
