"""Connected components of a link table by repeated contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, forget


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of the links (a long, b long); label is a node of the same component.

    Each round gives the nodes a fresh hash, sends every node to the one of least hash among itself and
    its neighbours, and that one's choice, and renames the links' ends. A fixed share of the nodes vanishes
    a round whatever their ids, about two thirds on a chain, so rounds grow with the logarithm of the nodes.
    The renamings shrink likewise; they are joined up once, from the last to the first. Self links and
    repeated links do no harm; without links the result is empty.
    """
    both = links.select("a", "b").where("a <> b")
    edges, steps, empty = cut(both.union(both.select("b", "a")).distinct(), "edges"), [], False
    while not empty:
        mixed = lambda node, k=len(steps): F.xxhash64(F.lit(k), node)
        parent = edges.groupBy("a").agg(F.min_by("b", mixed(F.col("b"))).alias("b")).select("a", _lower("a", "b", mixed).alias("p"))
        parent = cut(parent, "parents")
        above = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = cut(parent.join(above, "p").select("a", F.col("pp").alias("p")), "step")
        forget(parent)
        steps.append(step)
        to = lambda name, step=step: step.select(F.col("a").alias(name), F.col("p").alias(f"{name}_"))
        new = edges.join(to("a"), "a").join(to("b"), "b").where("a_ <> b_")
        fewer = cut(new.select(F.col("a_").alias("a"), F.col("b_").alias("b")).distinct(), "edges")
        forget(edges)
        edges, empty = fewer, fewer.isEmpty()
    forget(edges)
    labels = steps.pop()
    while steps:
        step, later = steps.pop(), labels.select(F.col("a").alias("p"), F.col("p").alias("last"))
        joined = cut(step.join(later, "p", "left").select("a", F.coalesce("last", "p").alias("p")), "labels")
        forget(step, labels)
        labels = joined
    return labels.select(F.col("a").alias("node"), F.col("p").alias("label"))


def _lower(a: str, b: str, mixed) -> Column:
    """That one of two nodes whose hash is less."""
    return F.when(mixed(F.col(b)) < mixed(F.col(a)), F.col(b)).otherwise(F.col(a))
