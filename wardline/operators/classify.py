"""A pluggable text classifier over token windows, and a gated second stage that judges what it flags.

Both take Python functions that make a model, once for each worker; no model is part of this package. All
verdicts come per chunk, as an array beside the array of texts, so that rows are never exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.parts import by_parts
from wardline.functions.patterns import ALLOW, BLOCK, EGRESS_REDACTIONS, REVIEW
from wardline.functions.redact import masker
from wardline.functions.scan import RESULT, fence, result
from wardline.functions.text import window_starts
from wardline.operators.decide import scanner_failure
from wardline.sources.ranges import cut

NAME, SECOND = "onnx-promptguard", "agent-alignment"
#: One of these must be in the label of a model's last class (fixed values).
BAD_LABELS = ("MALICIOUS", "INJECTION", "JAILBREAK")
#: Characters of a chunk that the second stage is shown, and the score of its denials (fixed values).
SHOWN, CERTAIN = 4000, 0.95
# Wording of audit reasons and of what a judge is asked.
OVER = "prompt injection score {score} >= {block}"
GREY = "prompt injection score {score} in grey zone [{review}, {block})"
UNREADABLE, SETTINGS, FAILED, COMPROMISED = "unparseable_llm_output (match_len={n})", "config_error:{e}", "llm_error:{e}", "AgentAlignment: compromised (observation match_len={n})"
LAST_CALLS, QUESTION = "The agent's most recent tool calls (oldest first):\n{summary}\n\n", "Evaluate this agent action:\n\n{text}"

Scorer = Callable[[list[str]], Sequence[float]]


def check_labels(labels: Sequence[str]) -> None:
    """ValueError unless the last class is the bad one."""
    if not labels or not any(b in labels[-1].upper() for b in BAD_LABELS):
        raise ValueError(f"the last of {list(labels)} is none of {BAD_LABELS}")


def softmax_last(logits: np.ndarray) -> np.ndarray:
    """The last class's share of each row, computed against the row's largest entry."""
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e[..., -1] / e.sum(axis=-1)


def windowed(encode: Callable[[str], Sequence[int]], logits: Callable[[list[Sequence[int]]], np.ndarray], labels: Sequence[str], win: int = 512, stride: int = 64, most: int = 16) -> Scorer:
    """A scorer from a tokenizer and a model over token windows: a text's score is the largest of its windows'.

    ValueError if the model's last label isn't the bad one."""
    check_labels(labels)

    def score(texts: list[str]) -> list[float]:
        windows, of = [], []
        for k, ids in enumerate(map(encode, texts)):
            for start in window_starts(len(ids), win, stride, most):
                windows.append(ids[start : start + max(8, win)])
                of.append(k)
        best = np.zeros(len(texts))
        np.maximum.at(best, of, softmax_last(np.asarray(logits(windows), float)))
        return best.tolist()

    return score


def stub(scores: Callable[[str], float] = lambda text: 0.0) -> Callable[[], Scorer]:
    """A stand-in model by a function of the text; without one it finds nothing."""
    return lambda: lambda texts: [scores(t) for t in texts]


def verdict(score: Column, block: float = 0.9, review: float = 0.5, name: str = NAME) -> Column:
    """Block, review or allow by score; a review threshold of 0 turns reviews off."""
    review = min(review, block)
    said = lambda template: F.replace(F.lit(template.format(score="{}", block=block, review=review)), F.lit("{}"), F.format_string("%.3f", score))
    branch = F.when(score >= block, result(name, BLOCK, said(OVER), score))
    if review > 0:
        branch = branch.when(score >= review, result(name, REVIEW, said(GREY), score))
    return branch.otherwise(result(name, ALLOW, "", 0.0))


def scorer(make: Callable[[], Scorer]):
    """An Arrow UDF from an array of texts to an array of struct<score, error>, null for null.

    The model is given the texts of some rows at a time, see `parts`. What fails so is scored text by text, and a text that fails carries its error. A model that can't
    be imported scores nothing: null, as if there were no such scanner."""

    kind = pa.list_(pa.struct([("score", pa.float64()), ("error", pa.string())]))

    @F.arrow_udf("array<struct<score:double,error:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            model, absent = make(), False
        except ImportError:
            model, absent = None, True

        def one(text: str) -> dict:
            try:
                return {"score": float(model([text])[0]), "error": None}
            except Exception as e:  # noqa: BLE001 - any failure of a model becomes a verdict
                return {"score": None, "error": f"error:{type(e).__name__}:{e}"}

        def scored(rows: list[list[str] | None]) -> list[list[dict] | None]:
            if absent:
                return [None] * len(rows)
            some = [t for r in rows if r is not None for t in r]
            try:
                scores = iter([{"score": float(s), "error": None} for s in model(some)] if some else [])
            except Exception:  # noqa: BLE001
                scores = iter([one(t) for t in some])
            return [None if r is None else [next(scores) for _ in r] for r in rows]

        yield from by_parts(batches, kind, scored)

    return run


def asked_once(df: DataFrame, texts: str, ask: Callable[[Column, Column], Column], out: str, beside: Column | None = None) -> DataFrame:
    """`df` with `out`, what `ask` says of each of an array of texts (with what stands beside them), asking once for equal ones.

    Texts are known by a digest: distinct ones are asked about, the answers are a table by digest, and rows get
    theirs through places of digests alone. The rows are written once, so that each keeps its number. A hot text
    is one row before it is shuffled, and its places are a join that the planner splits. Null for a null array, and
    where an answer is null."""
    beside = F.lit("") if beside is None else F.coalesce(beside, F.lit(""))
    rows = cut(df.withColumns({"__row": F.monotonically_increasing_id(), "__beside": beside}), "asking")
    each = rows.select("__row", "__beside", F.posexplode(texts).alias("place", "text"))
    each = each.withColumn("digest", F.unhex(F.sha2(F.concat(F.sha2("__beside", 256), "text"), 256)))
    distinct = each.groupBy("digest").agg(F.any_value("text").alias("text"), F.any_value("__beside").alias("beside"))
    known = cut(distinct.select("digest", ask(F.array("text"), F.col("beside"))[0].alias("said")), "answers")
    found = each.select("__row", "place", "digest").join(known, "digest").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("place", "said"))).alias("__said"))
    rows = rows.join(found, "__row", "left")
    said = F.transform("__said", lambda x: x.said)
    none = F.when(F.size(texts) == 0, F.array().cast(f"array<{known.schema['said'].dataType.simpleString()}>"))
    return rows.withColumn(out, F.when(F.col("__said").isNull(), none).when(~F.exists(said, lambda x: x.isNull()), said)).drop("__row", "__beside", "__said")


def classify(df: DataFrame, texts: str, run, out: str = "classifier", block: float = 0.9, review: float = 0.5, fail_open: bool = False, name: str = NAME, once: bool = False) -> DataFrame:
    """`df` with the classifier's verdict on each of an array of texts; failures block, or are reviewed where
    failures may pass. Null where the classifier is absent. With `once` equal texts are scored once."""
    df = asked_once(df, texts, lambda x, _: run(x), "__s") if once else df.withColumn("__s", run(F.col(texts)))
    failed = lambda s: scanner_failure(name, s.error, fail_open)
    return df.withColumn(out, fence(F.transform("__s", lambda s: F.when(s.error.isNotNull(), failed(s)).otherwise(verdict(s.score, block, review, name))))).drop("__s")


def prompt(summary: str, text: str) -> str:
    """What a judge is asked: the agent's last calls, if any, and the action."""
    return (LAST_CALLS.format(summary=summary) if summary else "") + QUESTION.format(text=text)


def aligner(make: Callable[[], Callable[[str], tuple[bool, str]]]):
    """An Arrow UDF from flagged texts (array) and a summary of the last calls to an array of verdicts.

    `make` gives a function from a prompt to (compromised, observation). It raises ValueError for an answer it
    can't read, with the answer as argument, RuntimeError for its settings, anything else for other
    failures; all of these become reviews. Texts are masked with the wider set and cut before they leave.
    Reasons never hold what a model wrote, only its length."""

    kind = pa.list_(pa.struct([("scanner", pa.string()), ("outcome", pa.string()), ("reason", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf(f"array<{RESULT}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        mask, said = masker(EGRESS_REDACTIONS), lambda outcome, reason, score=0.0: {"scanner": SECOND, "outcome": outcome, "reason": reason, "score": score}
        judge: list[Callable] = []

        def one(text: str, summary: str) -> dict:
            try:
                if not judge:
                    judge.append(make())
                compromised, observation = judge[0](prompt(summary, mask(text)[0][:SHOWN]))
            except ValueError as e:
                return said(REVIEW, UNREADABLE.format(n=len(str(e.args[0]) if e.args else "")))
            except RuntimeError as e:
                return said(REVIEW, SETTINGS.format(e=e))
            except Exception as e:  # noqa: BLE001 - an exception's text can hold what was sent
                return said(REVIEW, FAILED.format(e=type(e).__name__))
            if compromised:
                return said(BLOCK, COMPROMISED.format(n=len(observation)), CERTAIN)
            return said(ALLOW, "")

        yield from by_parts(batches, kind, lambda texts, summaries: [None if r is None else [one(t, s or "") for t in r] for r, s in zip(texts, summaries, strict=True)])

    return run


def flagged(chunks: Column, verdicts: Column) -> Column:
    """The chunks of which some verdict (an array for each chunk) is a review."""
    of = lambda k: F.exists(F.get(verdicts, k), lambda r: r.outcome == REVIEW)
    return F.filter(chunks, lambda c, k: of(k))


def second_stage(df: DataFrame, chunks: str, verdicts: str, summary: Column, judge, out: str = "second", once: bool = False) -> DataFrame:
    """`df` with a further verdict on each flagged chunk; only rows with one travel to the judge. With `once` equal texts
    behind equal calls are judged once."""
    asked = flagged(F.col(chunks), F.col(verdicts))
    df = df.withColumn("__ask", F.when(F.size(asked) > 0, asked))
    if once:
        df = asked_once(df, "__ask", judge, "__told", summary)
        return df.withColumn(out, fence(F.coalesce("__told", F.array().cast(f"array<{RESULT}>")))).drop("__ask", "__told")
    return df.withColumn(out, fence(F.coalesce(judge(F.col("__ask"), summary), F.array().cast(f"array<{RESULT}>")))).drop("__ask")
