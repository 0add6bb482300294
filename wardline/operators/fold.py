"""Trace rules as a fold over one key's calls, with parked progress: for batch by key and for streams.

The window functions of `trace` give the same verdicts for everything but parked progress: a flow whose
first steps have left the window goes on from the steps it had reached, for a limited time. Resuming
looks at the whole window again, and the first rule that fires ends the evaluation of a call.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import finite, fingerprint, parsed_args, shortened
from wardline.operators.rules import Budget, Flow, Loop, Named, Rate, Rule, is_regex, python_step, resolve

class FlowFold:
    """A flow as a list of stages, each a positive step with the guards before it; guards behind the last don't matter."""

    def __init__(self, rule: Flow) -> None:
        self.stages: list[tuple[list[Callable], Callable]] = []
        guards: list[Callable] = []
        for step in rule.steps:
            if step.guard:
                guards.append(python_step(step))
            else:
                self.stages.append((guards, python_step(step)))
                guards = []

    def run(self, calls: Iterable[dict], passed: int = 0) -> int:
        """How many stages have been passed after these calls; all of them: the flow is complete."""
        for call in calls:
            if passed == len(self.stages):
                break
            (guards, wanted), seen = self.stages[passed], (call["tool"], call["args"])
            passed = 0 if any(guard(*seen) for guard in guards) else passed + wanted(*seen)
        return passed


class TraceFold:
    """One key's trace and parked progress. `state` and `load` carry it through a state store."""

    def __init__(self, pack: Sequence[Rule], window: int = 256, ttl_s: float = 600.0, sticky: bool = True, args_most: int = 4096) -> None:
        self.pack, self.ttl, self.sticky, self.args_most = pack, ttl_s, sticky, args_most
        self.calls: deque[dict] = deque(maxlen=window)
        self.parked: dict[str, tuple[int, float]] = {}
        self.flows = {r.name: FlowFold(r) for r in pack if isinstance(r, Flow)}

    def state(self) -> str:
        return json.dumps({"calls": list(self.calls), "parked": self.parked})

    def load(self, state: str) -> TraceFold:
        kept = json.loads(state)
        self.calls.extend(kept["calls"])
        self.parked = {k: tuple(v) for k, v in kept["parked"].items()}
        return self

    def record(self, tool: str, args: str, ts: float, fp: str | None = None) -> None:
        """fp is the call's `text.fingerprint`, made of the arguments if it isn't given."""
        value = parsed_args(args)
        self.calls.append({"tool": tool, "args": finite(shortened(value, self.args_most)), "fp": fp or fingerprint(tool, value), "ts": ts})

    def _flow(self, rule: Flow, now: float) -> bool:
        """A complete flow and one that a guard has sent back leave nothing parked; further progress is parked anew."""
        before, since = self.parked.get(rule.name, (0, now))
        if now - since > self.ttl:
            del self.parked[rule.name]
            before = 0
        flow = self.flows[rule.name]
        passed = flow.run(self.calls, before)
        complete = 0 < len(flow.stages) == passed
        if complete or passed < before:
            self.parked.pop(rule.name, None)
        elif passed > before and self.sticky:
            self.parked[rule.name] = (passed, now)
        return complete

    def _holds(self, rule: Rule, now: float) -> bool:
        match rule:
            case Flow():
                return self._flow(rule, now)
            case Loop():
                return max(Counter(c["fp"] for c in self.calls).values(), default=0) >= rule.threshold
            case Rate():
                mine = Counter(c["tool"] for c in self.calls if _is(rule.tool, c["tool"]) and c["ts"] >= now - rule.window_s)
                return max(mine.values(), default=0) > rule.max_calls
            case Budget():
                total, most = Decimal(0), _exact(rule.max_total)
                for c in self.calls:
                    if _is(rule.tool, c["tool"]) and c["ts"] >= now - rule.window_s:
                        try:
                            total += _exact(float(resolve(c["args"], rule.field)))
                        except (TypeError, ValueError):
                            continue
                        if total > most:
                            return True
                return False

    def evaluate(self, now: float) -> Rule | None:
        """The first rule in order that holds; later ones aren't tried and park nothing."""
        return next((r for r in self.pack if self._holds(r, now)), None)


def _exact(value: float) -> Decimal:
    """The number to nine digits behind the point, as `trace.budget` sums it up; NaN is 0."""
    return Decimal(0) if math.isnan(value) else Decimal(repr(min(max(value, -1e24), 1e24))).quantize(Decimal("1e-9"), ROUND_HALF_UP, Context(prec=40))


def _is(matcher: str | Named, tool: str) -> bool:
    if isinstance(matcher, Named):
        return matcher(tool)
    return matcher == "*" or (bool(re.search(matcher, tool)) if is_regex(matcher) else matcher == tool)


def fold_keys(calls: DataFrame, pack: Sequence[Rule], window: int = 256, ttl_s: float = 600.0, sticky: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """key, seq, rule of every call of a recorded table (see `trace.record`): the name of the rule that fires, or null.

    Calls are dealt by key and sorted by time; a task runs through them with the state of one key at a time,
    which the window bounds, however long a key's history is. Columns to `carry` come along as text."""
    pack = tuple(pack)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, of = None, None
        for rows in batches:
            out = []
            for known, key, seq, t, tool, args, fp, recorded, *more in rows.itertuples(index=False):
                if fold is None or (known, key) != of:
                    fold, of = TraceFold(pack, window, ttl_s, sticky), (known, key)
                if recorded:
                    fold.record(tool, args, t, fp)
                hit = fold.evaluate(t)
                out.append((key, seq, hit.name if hit else None, *more))
            yield pd.DataFrame(out, columns=["key", "seq", "rule", *carry], dtype=object)

    more = [F.col(c).cast("string") for c in carry]
    fp = F.col("fp") if "fp" in calls.columns else F.lit(None).cast("string")
    lean = calls.select(F.col("key").isNotNull().alias("known"), F.col("key").cast("string"), F.col("seq").cast("long"), (F.unix_micros("ts") / 1_000_000).alias("t"), "tool", "args", fp.alias("fp"), "recorded", *more)
    return lean.repartition("key").sortWithinPartitions("key", "t", "seq").mapInPandas(run, "key string, seq long, rule string" + "".join(f", {c} string" for c in carry))
