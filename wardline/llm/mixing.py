"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; within a source the documents
with the smallest keys come first. A source's target is first met with complete epochs; the rest is
the shortest prefix by key that comes nearest to it. So that no task holds a source, documents fall
into bins by key: bins are summed, the sums are prefix-summed, and only the one bin in which a
source's budget ends is sorted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Shielded, cut, forget, partitions

#: Words (fixed value): runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (1, 2, 3), 3
#: About so many documents of a source share a bin; a source has no more bins than MAX_BINS.
BIN_ROWS, MAX_BINS = 4_000, 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A reproducible number in (0, 1) of the given text parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with a row for each source.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes. No target
    passes `most` times its source's size; the excess is shared by weight among the others, until none is
    above. Sources are numbered over ranges, and each sharing is one sum over all of them, so that there may
    be as many as there are web sites; only sums and the number of sources of each range come to the driver.
    """
    order = F.col("source").asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(partitions(sizes.sparkSession), order).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for p, n in counts.items() if p < k) for k in range(max(counts, default=0) + 1)]
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.get(F.array(*map(F.lit, before)), F.col("part"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("double")
    rows = cut(dealt.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap")), "weighed")
    forget(dealt)
    level, last = 0.0, None
    while level is not None and level != last:
        full, last = F.col("cap") <= F.lit(level) * F.col("weight"), level
        left = rows.agg(F.sum("source_size").cast("double").alias("all"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        level = (left["all"] - left["full"]) / left.free if left.free else None
    return rows.select("source", "source_size", F.col("cap").alias("target") if level is None else F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, mark, size, source, source_size, target, epochs, extra, taken for every row of `docs`.

    `quality` (id, quality) has at most one row for each id and gives weights above 0; others weigh 1.
    A document is taken `epochs` times and once more if `extra`. Null text has size 0 and takes 0; a
    null source is a source; rows that tie in key are ordered by id and text hash, so reruns agree and
    repeated rows differ only in which of them is taken. An empty table gives an empty table.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), n_words(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"))
    if quality is not None:
        rows = rows.join(quality.select(F.col("id").alias("__id"), "quality"), F.col("id") == F.col("__id"), "left").drop("__id")
        rows = rows.withColumn("quality", F.coalesce("quality", F.lit(1.0)))
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    rows = cut(rows.withColumn("k", -F.log(uniform(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.col("mark").cast("string")))) / F.col("quality")), "sized")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    bins = F.least(F.lit(MAX_BINS), F.greatest(F.lit(1), F.ceil(F.col("rows") / BIN_ROWS))).cast("int").alias("bins")
    sums = cut(sums.select("source", "source_size", bins), "sources")
    plan = sums.select("source", "bins").withColumnRenamed("source", "s").join(targets(sums.select("source", "source_size")), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = cut(plan.withColumnRenamed("source", "s"), "plan")
    binned = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bin", F.floor((1 - F.exp(-F.col("k"))) * F.col("bins")).cast("int"))

    of_bins = binned.groupBy("source", "bin", "rest").agg(F.sum("size").alias("sum"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    of_bins = of_bins.withColumn("upto", F.sum("sum").over(upto)).withColumn("before", F.col("upto") - F.col("sum"))
    # where the budget ends: the one bin that holds it, whose predecessors are taken whole
    last = of_bins.where("before < rest and upto >= rest").select(F.col("source").alias("s"), F.col("bin").alias("last"), "before")
    last = cut(last, "last-bins")
    placed = binned.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = (F.col("bin") == F.col("last")) & (F.col("size") > 0)
    order = Window.partitionBy("source").orderBy("k", "id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(inside).withColumn("upto", F.col("before") + F.sum("size").over(order))
    # a document is in if the prefix that ends with it is nearer to the budget than the one before it
    edge = edge.withColumn("extra", F.abs(F.col("rest") - F.col("upto")) < F.abs(F.col("rest") - (F.col("upto") - F.col("size"))))
    edge = edge.drop("upto")
    others = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.coalesce((F.col("bin") < F.col("last")) & (F.col("size") > 0), F.lit(False)))
    both = edge.unionByName(others)
    taken = F.col("size") * (F.col("epochs") + F.col("extra").cast("long"))
    return both.select("id", "mark", "size", "source", "source_size", "target", "epochs", "extra", taken.alias("taken"))


def label_quality(labels: DataFrame) -> DataFrame:
    """(id, quality) of labelled documents: the best label of an id counts double, a bad one half."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.when(F.max("quality") > 0, F.lit(2.0)).otherwise(F.lit(0.5)).alias("quality"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with all its columns.

    Rows that repeat id, text and source are numbered by their other columns, so that together they come as
    often as the mix takes them together, the same ones in every run. Rows without words are never taken. Texts of any length
    are counted whole and travel once. Columns of any name pass through.
    """
    own = Shielded(docs)
    docs, key, text, source = own.docs, own[key], own[text], own[source]
    plan = mix(docs, quality, key=key, text=text, source=source).where("size > 0")
    times = plan.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("source").alias("__source")).agg(F.min("epochs").alias("__epochs"), F.count_if("extra").alias("__extra"))
    times = times.where("__epochs > 0 or __extra > 0")
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")) & F.col(source).cast("string").eqNullSafe(F.col("__source"))
    number = F.row_number().over(Window.partitionBy("__id", "__mark", "__source").orderBy(F.to_json(F.struct(*(c for c in docs.columns if c != text)))))
    rows = docs.join(times, same).withColumn("__n", F.col("__epochs") + (number <= F.col("__extra")).cast("long"))
    return rows.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*own.columns())


def op6_mixing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = mix(docs, label_quality(labels))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH q AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             -ln((CAST('0x' || substr(md5('mix|' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(quality, 1.0::DOUBLE) AS k
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, (3 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS turn FROM c),
g AS (SELECT *, max(CASE WHEN cap > turn * weight THEN turn END) OVER () AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT *, greatest(0.0, target - epochs * source_size) AS rest FROM e),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND upto - size < rest AND abs(rest - upto) < abs(rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
