"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes ends a chunk wherever its value fits the block size; every
chunk leaves one character, and the characters are the signature. Block sizes are 3 times a power of
two; a text uses the smallest at which it has at most 64 chunks, and a second signature at twice that
size, so that texts of somewhat different length still have a size in common. Likeness is one minus
the edit distance (insertions and deletions) over the signatures' lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import partitions, text_of

#: Bytes under the rolling hash, smallest block size, most chunks, and the alphabet of signatures.
ROLL, LEAST_BLOCK, MOST_CHUNKS = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Signatures are only alike if they share a run of so many characters (fewer for short ones).
COMMON = 7


def rolled(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: plain and weighted sums of the last bytes and a shifted xor of them."""
    padded = np.concatenate([np.zeros(ROLL - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    sums, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for k in range(ROLL):
        x = padded[k : k + n]
        sums += x
        weighted += x * np.uint32(k + 1)
        shifted ^= x << np.uint32(5 * (ROLL - 1 - k))
    return sums + weighted + shifted


def fingerprint(data: bytes, roll: np.ndarray) -> str:
    """block:signature:signature at twice the block, of a text's bytes and their rolling hash."""
    value = roll.astype(np.uint64) + np.uint64(1)
    ends = np.flatnonzero(value % np.uint64(LEAST_BLOCK) == 0)
    value = value[ends] // np.uint64(LEAST_BLOCK)
    powers = value & (~value + np.uint64(1))  # the largest power of two that divides it
    level = 0
    while np.count_nonzero(powers >= np.uint64(1 << level)) >= MOST_CHUNKS:
        level += 1
    out = []
    for k in (level, level + 1):
        cuts = [0, *(ends[powers >= np.uint64(1 << k)] + 1).tolist(), len(data)]
        out.append("".join([ALPHABET[xxhash.xxh32_intdigest(data[a:b]) & 63] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]))
    return f"{LEAST_BLOCK << level}:{out[0]}:{out[1]}"


def _distance(a: str, b: str) -> int:
    """Insertions and deletions between two strings: the longest common subsequence by bit rows."""
    where = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 if their block sizes aren't within a factor of two."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    pairs = [(x1, y1), (x2, y2)] if bx == by else [(x2, y1)] if by == 2 * bx else [(x1, y2)] if bx == 2 * by else []
    best = 0.0
    for a, b in pairs:
        if not a or not b:
            continue
        run = min(COMMON, max(2, min(len(a), len(b)) // 4))
        if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
            continue
        best = max(best, 1 - _distance(a, b) / (len(a) + len(b)))
    return best


def _below(borders: list[int], value: Column) -> Column:
    """How many of the ascending borders are less than the value, by halving."""
    table, n = F.array(*map(F.lit, borders)).cast("array<long>"), len(borders)
    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        less = F.coalesce(F.get(table, middle) < value, F.lit(False))
        low, high = F.when(less, middle + 1).otherwise(span["low"]), F.when(less, span["high"]).otherwise(middle)
        open_ = span["low"] < span["high"]
        return F.struct(F.when(open_, low).otherwise(span["low"]).alias("low"), F.when(open_, high).otherwise(span["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, halve)["low"] if n else F.lit(0)


def _share(rank: Column, parts: Column) -> Column:
    """Which of so many parts a 64-bit hash falls into, in ascending order."""
    top = F.shiftrightunsigned(rank.bitwiseXOR(F.lit(-(2**63))), 33)
    return F.floor(top * parts / 2**31).cast("int")


def with_successor(docs: DataFrame, key: str, text: str, bins: int) -> DataFrame:
    """bin, guest, id, rank, text: documents in bins of ascending key, each bin with its successor's first rows as guests.

    Bin borders are quantiles of the key, so that no task sorts all documents and each text moves once. Null keys
    come first; rows of equal keys stand by a hash of their texts (rank). A key that several quantiles fall on, and
    null keys, have bins of their own, as many as is their share, by rank."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text")).withColumn("rank", F.xxhash64("text"))
    many = rows.agg(F.percentile_approx("id", [k / bins for k in range(1, max(2, bins))], 10_000).alias("q"), F.count("*").alias("n"), F.count("id").alias("known")).first()
    quantiles = sorted(many.q or []) if bins > 1 else []
    borders, busy = sorted(set(quantiles)), 1 + (many.n - many.known) * bins // max(1, many.n)
    # bins in order: those of null keys; then for each border what is below or at it, or below it and then its own bins
    start, own, at = [], [], busy
    for b in borders:
        times = quantiles.count(b)
        start.append(at)
        own.append(times if times > 1 else 0)
        at += 1 + own[-1]
    start, own, total = [*start, at], [*own, 0], at + 1
    if borders or busy > 1:
        below = F.when(F.col("id").isNotNull(), _below(borders, F.col("id")))
        entry = lambda values, k: F.get(F.array(*map(F.lit, values)).cast("array<int>"), k)
        rows = rows.withColumn("k", below).withColumn("times", F.when(F.col("id") == F.get(F.array(*map(F.lit, borders)).cast("array<long>"), F.col("k")), entry(own, F.col("k"))).otherwise(0))
        rows = rows.withColumn("bin", F.when(F.col("id").isNull(), _share(F.col("rank"), F.lit(busy))).otherwise(entry(start, F.col("k")) + F.when(F.col("times") > 0, 1 + _share(F.col("rank"), F.col("times"))).otherwise(0)))
    else:
        rows = rows.withColumns({"bin": F.when(F.col("id").isNull(), 0).otherwise(1), "times": F.lit(0)})
    alone = F.col("id").isNull() | (F.col("times") > 0)  # in a bin of one key, or of null keys: its first row is that of the least rank
    firsts = {r.bin: r for r in rows.groupBy("bin").agg(F.min("id").alias("least"), (F.count("*") > F.count("id")).alias("nulls"), F.min(F.when(alone, F.col("rank"))).alias("rank")).collect()}
    if not firsts:
        return rows.select("bin", F.lit(False).alias("guest"), "id", "rank", "text")
    # by bin: where its first rows are guests (before the first bin comes the last), and their key and rank
    known, before, least, rank = sorted(firsts), [None] * total, [None] * total, [None] * total
    for k, b in enumerate(known):
        before[b], least[b], rank[b] = known[k - 1], None if firsts[b].nulls else firsts[b].least, firsts[b].rank
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("bin"))
    first = F.col("id").eqNullSafe(of(least, "long")) & F.coalesce(F.col("rank") == of(rank, "long"), F.lit(True))
    here = F.struct(F.col("bin").alias("bin"), F.lit(False).alias("guest"))
    homes = F.when(first, F.array(here, F.struct(of(before, "int").alias("bin"), F.lit(True).alias("guest")))).otherwise(F.array(here))
    dealt = rows.select("id", "rank", "text", F.explode(homes).alias("home")).select("home.bin", "home.guest", "id", "rank", "text")
    return dealt.repartitionById(total, F.col("bin")).sortWithinPartitions("bin", "guest", "id", "rank", "text")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The following document is the next by ascending key, after the last the first; rows of equal keys
    are ordered by a 64-bit hash of their texts, then by text, null keys come first, a null text is empty, a lone row follows itself. Repeated
    rows follow one another. An empty table gives an empty table. Other columns are not read. A worker holds two
    texts at a time, at some twenty times their bytes.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, home, out = None, None, []

        def row(key_: int | None, text_: str, data: bytes, roll: np.ndarray, mine: str, following: tuple) -> tuple:
            other = edited(text_, following[1])
            whole, n = other.encode(), len(text_) - len(text_) // 4
            stay = len(text_[:n].encode())
            tail = rolled(np.frombuffer(whole[max(0, stay - ROLL + 1) :], np.uint8))[min(stay, ROLL - 1) :]
            changed = fingerprint(whole, np.concatenate([roll[:stay], tail]))
            return key_, len(text_), hashlib.sha256(whole).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, following[4])

        for batch in batches:
            for bin_, guest, key_, text_ in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if bin_ != home:
                    last, home, done = None, bin_, False
                data = text_.encode()
                roll = rolled(np.frombuffer(data, np.uint8))
                this = (key_, text_, data, roll, fingerprint(data, roll))
                if last and not done:
                    out.append(row(*last, this))
                done = guest  # only the first guest follows a row of this bin
                last = this
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    dealt = with_successor(docs, key, text, partitions(docs.sparkSession))
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
