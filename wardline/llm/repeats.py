"""Repeated pieces of documents: which occurrences aren't the first, and texts without them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut


def place(at: str) -> Column:
    """One number for id, mark and position: occurrences compare as these three do (null ids first).

    A decimal, because its minimum is kept in place by the hash aggregate, unlike that of a struct."""
    dec = lambda c: c.cast("decimal(38,0)")
    id_ = dec(F.coalesce("id", F.lit(-(2**63) + 1)))
    return (id_ * F.lit(10**9).cast("decimal(10,0)") + F.pmod("mark", F.lit(10**9))).cast("decimal(29,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col(at)


def rows_of(docs: DataFrame, key: str, text: str, parts: Callable[[Column], Column]) -> DataFrame:
    """id, mark, parts of every row; rows that repeat key and text are one document."""
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.lit(1), text).alias("mark"), parts(F.coalesce(F.col(text), F.lit(""))).alias("parts"))


def ranged(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """All columns of `docs` and __ranges: the set of s and e that `gone` (id, mark, s, e) has for a row, null if none."""
    ranges = gone.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set(F.struct("s", "e")).alias("__ranges"))
    ranges = cut(ranges, "removed")
    return docs.join(ranges.hint("merge"), F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(F.lit(1), text) == F.col("__mark")), "left").drop("__id", "__mark")


def without(docs: DataFrame, gone: DataFrame, key: str, text: str, parts: Callable[[Column], Column]) -> DataFrame:
    """All columns of `docs`, __n (parts), __gone (removed parts) and __text (the text without them).

    `gone` has id, mark, s, e: ranges of parts, which may overlap."""
    rows = ranged(docs, gone, key, text)
    # ranges in order with those that another covers left out, so that each part is looked up once
    rows = rows.withColumn("__parts", parts(F.coalesce(F.col(text), F.lit("")))).withColumn("__n", F.size("__parts").cast("long"))
    start = F.struct(F.array().cast("array<int>").alias("gone"), F.lit(-1).alias("to"))
    step = lambda a, x: F.struct(F.when(x.e > a.to, F.concat(a.gone, F.sequence(F.greatest(x.s, a.to + 1), x.e))).otherwise(a.gone).alias("gone"), F.greatest(a.to, x.e).alias("to"))
    rows = rows.withColumn("__spots", F.aggregate(F.array_sort("__ranges"), start, step).gone)
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__spots"))
    kept = F.when(F.col("__ranges").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get("__parts", i)), ""))
    return rows.withColumn("__text", kept).withColumn("__gone", F.coalesce(F.size("__spots"), F.lit(0)).cast("long")).drop("__ranges", "__spots", "__parts")
