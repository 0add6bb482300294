"""Trace rules over tables of calls, as window functions over blocks of a trace.

A trace is what one key called, in order of time, and a rule looks back over the last `window` recorded calls,
the current one included. `record` numbers the recorded calls of each key, over ranges of the whole table; `blocks`
deals a key's calls to blocks of consecutive numbers, each with a halo of the `window - 1` recorded calls before
it, which is all that its rules can see. So the calls of one busy key are the work of many tasks. All windows
below are by key and block, or by those and something finer, so that a single shuffle serves them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.functions.patterns import BLOCK
from wardline.functions.scan import RESULT, fence, result
from wardline.operators.rules import Budget, Flow, Loop, Rate, Rule, argument, step_is, tool_is
from wardline.sources.ranges import carried, cut, ranged

WINDOW = 256
#: Recorded calls of a key that are one block.
BLOCK_CALLS = 4096
#: Keys of more calls are dealt to blocks, so many of them at most.
BUSY_CALLS, BUSY_KEYS = 65_536, 1000
#: Calls whose names a summary has.
SUMMARY = 5
TRACE = ("key", "block")
#: Sums of arguments are decimal, of numbers between these bounds.
SUM, LARGEST = "decimal(38,9)", 1e24


def by(*cols: str) -> Window:
    return Window.partitionBy(*TRACE, *cols).orderBy("ts", "seq")


def upto_now(*cols: str):
    return by(*cols).rowsBetween(Window.unboundedPreceding, 0)


def record(calls: DataFrame, key: Column, seq: Column, ts: Column, tool: Column, args: Column, recorded: Column | None = None, args_most: int = 0, fp: Column | None = None) -> DataFrame:
    """`calls` with key, seq, ts, tool, args, recorded, and fp if it is given.

    fp is what equal calls share; `text.call_print` makes it of the tool and all arguments by sorted names where a
    rule needs it. args longer than `args_most` characters (0: no bound) are kept with shortened strings."""
    recorded = (tool != "") if recorded is None else recorded
    cols = {"key": key, "seq": seq, "ts": ts.cast("timestamp"), "tool": tool, "args": args, "recorded": F.coalesce(recorded, F.lit(False))}
    calls = calls.withColumns(cols | ({} if fp is None else {"fp": fp}))
    if args_most > 0:
        calls = calls if fp is not None else calls.withColumn("fp", text.call_print("tool", "args"))
        long = F.when(F.char_length("args") > args_most, F.col("args"))
        calls = calls.withColumn("args", F.coalesce(text.shortened_json(long, F.lit(args_most)), "args"))
    return calls


def numbered(calls: DataFrame) -> DataFrame:
    """A recorded table with rn, how many calls of the key have been recorded so far.

    Calls are put in order over ranges of the whole table and counted inside each range; a key that goes on over
    several ranges, of which there are fewer than ranges, begins each with the count of those before."""
    one = F.col("recorded").cast("long")
    rows = ranged(calls.withColumn("recorded", F.coalesce("recorded", F.lit(False))), "key", "ts", "seq")
    before = carried(rows, "key", F.sum(one), F.sum("value"))
    inside = F.sum(one).over(Window.partitionBy("key", "range").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(before), F.col("key").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")), "left")
    return rows.withColumn("rn", inside + F.coalesce("before", F.lit(0))).drop("of", "at", "before", "range")


def busy_keys(calls: DataFrame) -> list:
    """The keys of more than BUSY_CALLS calls; the largest BUSY_KEYS of them, as each of the others has less than that
    part of all calls."""
    counts = calls.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUSY_CALLS)
    return [r.key for r in counts.orderBy(F.desc("n"), "key").limit(BUSY_KEYS).collect()]


def blocks(calls: DataFrame, window: int = WINDOW, size: int = BLOCK_CALLS) -> DataFrame:
    """A recorded table with rn (how many calls of the key have been recorded so far), block and halo: rows of the halo
    are there for the rules to look back at.

    The calls of busy keys are numbered over ranges and dealt to blocks; those of other keys are one block each."""
    size, busy = max(size, window), busy_keys(calls)
    here = lambda df: df.withColumns({"rn": F.sum(F.col("recorded").cast("long")).over(Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)), "block": F.lit(0).cast("long"), "halo": F.lit(False)})
    if not busy:
        return here(calls)
    calls = cut(calls, "calls")
    mine = F.coalesce(F.col("key").isin([k for k in busy if k is not None]), F.lit(None in busy))
    df = numbered(calls.where(mine))
    own = F.greatest(F.lit(0), F.floor((F.col("rn") - 1) / size))
    next_ = F.when(F.col("recorded") & (F.col("rn") > (own + 1) * size - (window - 1)), own + 1)
    df = df.withColumn("block", F.explode(F.array_compact(F.array(own, next_)))).withColumn("halo", F.col("block") != own)
    return here(calls.where(~mine)).unionByName(df)


def judged(calls: DataFrame) -> DataFrame:
    """The calls themselves, without halos and places."""
    return calls.where(~F.col("halo")).drop("halo", "block")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1_000_000


def loop(df: DataFrame, rule: Loop, window: int = WINDOW) -> DataFrame:
    """The call that is `threshold - 1` equal ones back lies in the window."""
    df = df if "fp" in df.columns else df.withColumn("fp", text.call_print("tool", "args"))
    back = F.lag("rn", rule.threshold - 1).over(by("fp", "recorded"))
    df = df.withColumn("__back", F.when(F.col("recorded"), back))
    return df.withColumn(rule.name, F.coalesce(F.max("__back").over(upto_now()) > F.col("rn") - window, F.lit(False))).drop("__back")


def rate(df: DataFrame, rule: Rate, window: int = WINDOW) -> DataFrame:
    """The call of the same tool that is `max_calls` back lies in the window of calls and of time."""
    counted = F.col("recorded") & tool_is(F.col("tool"), rule.tool, wildcard=True)
    same = by("tool", "__counted")
    df = df.withColumn("__counted", counted)
    df = df.withColumns({"__rn": F.when(F.col("__counted"), F.lag("rn", rule.max_calls).over(same)), "__ts": F.when(F.col("__counted"), F.lag(_seconds(F.col("ts")), rule.max_calls).over(same))})
    hit = (F.max("__rn").over(upto_now()) > F.col("rn") - window) & (F.max("__ts").over(upto_now()) >= _seconds(F.col("ts")) - rule.window_s)
    return df.withColumn(rule.name, F.coalesce(hit, F.lit(False))).drop("__counted", "__rn", "__ts")


def _recent(window: int, *fields: Column) -> Column:
    """The recorded calls in the window, oldest first, as structs of rn and the fields."""
    frame = Window.partitionBy(*TRACE).orderBy("rn").rangeBetween(-(window - 1), 0)
    return F.array_sort(F.collect_list(F.when(F.col("recorded"), F.struct("rn", *fields))).over(frame))


def budget(df: DataFrame, rule: Budget, window: int = WINDOW) -> DataFrame:
    """A running sum of the argument over the matching calls in the window passes the total.

    With S the sums from the block's beginning, the running sums of a window are S less what came before its first
    call, so the largest S in it tells. The window is the later of two frames, the last calls and the last
    seconds; calls of the same instant that come later belong to neither. Sums are exact to nine digits behind
    the point; NaN counts as 0."""
    counts = F.col("recorded") & tool_is(F.col("tool"), rule.tool, wildcard=True)
    value = F.when(counts, F.nanvl(argument(F.col("args"), rule.field, "double"), F.lit(0.0)))
    value = F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(-LARGEST)), F.lit(LARGEST)).cast(SUM)
    df = df.withColumns({"__v": fence(value), "__t": F.unix_micros("ts")})
    df = df.withColumn("__s", F.when(F.col("recorded"), F.sum("__v").over(upto_now()).cast(SUM)))
    call = F.when(F.col("recorded"), F.struct("rn", (F.col("__s") - F.col("__v")).cast(SUM).alias("before")))
    calls = Window.partitionBy(*TRACE).orderBy("rn").rangeBetween(-(window - 1), 0)
    past = Window.partitionBy(*TRACE).orderBy("__t").rangeBetween(-round(rule.window_s * 1_000_000), -1)
    now = by("__t").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__c", call)
    df = df.withColumns({f"__{n}{k}": of("__c" if n == "first" else "__s").over(w) for k, w in enumerate((calls, past, now)) for n, of in (("first", F.min), ("top", F.max))})
    df = df.withColumns({"__first": F.coalesce("__first1", "__first2"), "__top": F.greatest("__top1", "__top2")})
    late = F.col("__first.rn") >= F.col("__first0.rn")
    over = F.when(late, F.col("__top") - F.col("__first.before")).when(~late, F.col("__top0") - F.col("__first0.before")) > F.lit(rule.max_total).cast(SUM)
    return df.withColumn(rule.name, F.coalesce(over, F.lit(False))).drop("__v", "__t", "__s", "__c", "__first", "__top", *(f"__{n}{k}" for n in ("first", "top") for k in range(3)))


def flow(df: DataFrame, rule: Flow, window: int = WINDOW) -> DataFrame:
    """Without guards: for each step the latest start of a chain that ends there, carried forward."""
    steps = [s for s in rule.steps if not s.guard]
    if len(steps) < len(rule.steps):
        return guarded_flow(df, rule, window)
    name, spare = rule.name, []
    for k, step in enumerate(steps):
        is_ = F.col("recorded") & step_is(F.col("tool"), F.col("args"), step)
        before = F.max(spare[-1]).over(by().rowsBetween(Window.unboundedPreceding, -1)) if spare else F.col("rn")
        spare.append(f"__d{k}")
        df = df.withColumn(spare[-1], F.when(is_, before))
    return df.withColumn(name, F.coalesce(F.max(spare[-1]).over(upto_now()) > F.col("rn") - window, F.lit(False))).drop(*spare)


def guarded_flow(df: DataFrame, rule: Flow, window: int = WINDOW) -> DataFrame:
    """With guards: a fold over the window's calls. A guard before the next positive step sends the state
    back to the start and consumes the call; guards after the last step never act."""
    groups, guards = [], []
    for step in rule.steps:
        if step.guard:
            guards.append(step)
        else:
            groups.append((tuple(guards), step))
            guards = []
    done = len(groups)
    any_ = lambda steps: F.exists(F.array(*[step_is(F.col("tool"), F.col("args"), s) for s in steps]), lambda x: x) if steps else F.lit(False)
    marks = [F.struct(any_(g).alias("void"), step_is(F.col("tool"), F.col("args"), s).alias("hit")) for g, s in groups]
    df = df.withColumn("__marks", F.array(*marks)).withColumn("__recent", _recent(window, F.col("__marks").alias("m")))
    step = lambda state, x: F.when(state == done, state).when(F.get(x.m, state).void, F.lit(0)).when(F.get(x.m, state).hit, state + 1).otherwise(state)
    return df.withColumn(rule.name, F.aggregate("__recent", F.lit(0), step) == done).drop("__recent", "__marks")


_RULES = {Loop: loop, Rate: rate, Budget: budget, Flow: flow}


def apply_rule(df: DataFrame, rule: Rule, window: int = WINDOW) -> DataFrame:
    """`df` with a boolean column of the rule's name; a table without blocks is dealt to blocks for it."""
    if "block" not in df.columns:
        return judged(apply_rule(blocks(df, window), rule, window))
    return _RULES[type(rule)](df, rule, window)


def apply_pack(df: DataFrame, pack: Sequence[Rule], out: str = "invariant", window: int = WINDOW) -> DataFrame:
    """`df` with the blocking verdict of the first rule in order that holds, else null."""
    if "block" not in df.columns:
        return judged(apply_pack(blocks(df, window), pack, out, window))
    for rule in pack:
        df = apply_rule(df, rule, window)
    verdict = F
    for rule in pack:
        verdict = verdict.when(F.col(rule.name), result(f"invariant:{rule.name}", BLOCK, rule.description or rule.name, 0.0))
    return df.withColumn(out, verdict if pack else F.lit(None).cast(RESULT)).drop(*(r.name for r in pack))


def summary(df: DataFrame, out: str = "summary", last: int = SUMMARY) -> DataFrame:
    """The names of the key's last recorded calls, oldest first."""
    if "block" not in df.columns:
        return judged(summary(blocks(df, last), out, last))
    recent = F.filter("__recent", lambda x: x.rn > F.col("rn") - last)
    df = df.withColumn("__recent", _recent(last, F.col("tool").alias("t")))
    return df.withColumn(out, F.array_join(F.transform(recent, lambda x: x.t), ", ")).drop("__recent")
