"""Filter interaction audit over a packed bitmap index.

Every filter, label and part of the corpus is a bitset over a block of documents, packed in numpy inside a
task. What a chain of filters keeps depends only on the set of filters that have run, not on their order: for
each such set the block's failing bitsets are and-notted away and the rest is counted by popcount, for all parts
and labels. Counts of blocks are summed by Spark; all orders of the filters are read off those sums.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut

#: What stands between words (fixed value).
SPACE = r"[\x20\x09-\x0D]+"
INDEX = "n long, filters array<binary>, good binary, toxic binary, parts array<struct<part:string,word:int,bits:binary>>"
COUNTS = "part string, subset int, kept long, good long, toxic long"


def content_filters(text: Column) -> dict[str, Column]:
    """Failing conditions that a document's own text decides: A few words, B repeated words, C capitals, D symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> tuple[DataFrame, str]:
    """(part, one boolean a filter, good, toxic of every row), and the filters' letters; E fails copies of a smaller key's text.

    Texts are read once; what is written of them is a row of flags and a 256-bit digest that stands for the text.
    Copies are found by the least key of each digest, counted before the shuffle; only digests that occur
    more than once are joined back, so a group of copies of any size is dealt by the planner's skewed join.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = content_filters(body)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *(c.alias(n) for n, c in own.items()), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = cut(rows, "filter-flags")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    first = cut(first, "first-copies")  # as a table of its own, so that the planner can split the join's hot digests
    rows = rows.join(first, "digest", "left").withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).where("good or toxic")
    rows = rows.select("id", "part", *own, "E").join(known, F.col("id") == F.col("labelled"), "left")
    return rows.select("part", *own, "E", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))), "".join([*own, "E"])


def packed(flags: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, the first row in the lowest bit."""
    out = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    bits = np.packbits(flags, bitorder="little")
    out[: len(bits)] = bits
    return out.view(np.uint64)


def bitmap_index(rows: DataFrame, filters: str) -> DataFrame:
    """One row for each block of rows (an Arrow batch): bitsets of failures by filter, of both labels, and of each part.

    Rows of a block are put in order of their part, so that a part's bitset is kept only from its first `word`
    to its last: an index of many parts is no larger than one of few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n", pa.int64()), ("filters", pa.list_(pa.binary())), ("good", pa.binary()), ("toxic", pa.binary()), ("parts", pa.list_(pa.struct([("part", pa.string()), ("word", pa.int32()), ("bits", pa.binary())])))])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            coded = batch.column("part").dictionary_encode()
            codes = np.asarray(coded.indices)
            order = np.argsort(codes, kind="stable")
            bits = {c: packed(batch.column(c).to_numpy(zero_copy_only=False)[order].astype(bool)) for c in (*filters, "good", "toxic")}
            ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
            parts = []
            for name, begin, end in zip(coded.dictionary.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                word = begin // 64
                member = np.zeros(end - 64 * word, bool)
                member[begin - 64 * word :] = True
                parts.append({"part": name, "word": word, "bits": packed(member).tobytes()})
            row = {"n": n, "filters": [bits[c].tobytes() for c in filters], "good": bits["good"].tobytes(), "toxic": bits["toxic"].tobytes(), "parts": parts}
            yield pa.RecordBatch.from_pylist([row], schema)

    return rows.mapInArrow(run, INDEX)


def subset_counts(index: DataFrame) -> DataFrame:
    """part, subset (bit k: the k-th filter has run), and how many rows, good and toxic ones are left; summed over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.string()), ("subset", pa.int32()), ("kept", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])
        for block in (row for batch in batches for row in batch.to_pylist()):
            words = lambda b: np.frombuffer(b, np.uint64)
            fails, left = [words(b) for b in block["filters"]], [np.full(len(words(block["good"])), ~np.uint64(0))]
            for subset in range(1, 1 << len(fails)):
                last = subset.bit_length() - 1
                left.append(left[subset ^ 1 << last] & ~fails[last])
            alive = np.array(left)
            of = {"kept": alive, "good": alive & words(block["good"]), "toxic": alive & words(block["toxic"])}
            for p in block["parts"]:
                bits = words(p["bits"])
                at = slice(p["word"], p["word"] + len(bits))
                found = {k: np.bitwise_count(v[:, at] & bits).sum(axis=1, dtype=np.int64) for k, v in of.items()}
                yield pa.RecordBatch.from_arrays([pa.array([p["part"]] * len(alive)), pa.array(np.arange(len(alive), dtype=np.int32)), *(pa.array(found[k]) for k in ("kept", "good", "toxic"))], schema=schema)

    return index.mapInArrow(run, COUNTS).groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order of the filters and step of it; see `filter_audit`."""
    every = (1 << len(filters)) - 1
    steps = []
    for order in itertools.permutations(filters):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << filters.index(letter)
            steps.append({"filter_order": "".join(order), "step": k + 1, "f": filters.index(letter), "bit": bit, "before": before, "after": before | bit})
            before |= bit
    # how many orders run exactly the filters of a subset before a filter
    weight = lambda subset: factorial(subset.bit_count()) * factorial(len(filters) - 1 - subset.bit_count())
    removed = lambda subset, bit: f"(c[{subset}].kept - c[{subset | bit}].kept)"
    shapley = ", ".join(" + ".join(f"{weight(s)} * {removed(s, 1 << f)}" for s in range(every + 1) if not s & 1 << f) for f in range(len(filters)))
    rows = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("c"))
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,f:int,bit:int,before:int,after:int>>")
    rows = rows.select("part", "c", F.expr(f"array({shapley})").alias("shapley"), F.explode(plan).alias("s"))
    return rows.selectExpr(
        "part",
        "s.filter_order",
        "s.step",
        "c[s.after].kept AS kept",
        "c[s.before].kept - c[s.after].kept AS removed",
        "(c[0].kept - c[s.bit].kept) - (c[s.before].kept - c[s.after].kept) AS redundant",
        f"c[{every} - s.bit].kept - c[{every}].kept AS unique_fails",
        "c[s.before].good - c[s.after].good AS good_lost",
        "c[s.before].toxic - c[s.after].toxic AS toxic_lost",
        "shapley[s.f] AS shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null part and an empty one are the part ''. Null and empty texts have no words: they fail A, and E if they
    are not the first. A null key has no smaller one and is smaller than none: it never fails E, makes no other row
    fail and has no label. Rows of one key and text are documents of their own, none smaller than the other.
    A document is good or toxic if any of its label rows says so. Texts of any length are read whole; an empty
    table gives no rows; other columns are not read.
    """
    rows, letters = failures(docs, labels, key, text, part)
    return audit(subset_counts(bitmap_index(rows, letters)), letters)


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit(docs, labels)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(c, b)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[: step - 1]), 0) AS INT) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((fails & (before | bit)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((fails & before) = 0 AND (fails & bit) > 0), 0) AS removed,
    coalesce(sum(n) FILTER ((fails & before) > 0 AND (fails & bit) > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER ((fails & before) = 0 AND (fails & bit) > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER ((fails & before) = 0 AND (fails & bit) > 0), 0) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
