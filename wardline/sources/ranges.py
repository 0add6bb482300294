"""Work that follows an order, spread over ranges of a whole table, and tables that cut lineage.

A table is put in order by ranges; what one range must know of those before it is a single row a range, made by
aggregation. So one key that holds a third of all rows is the work of a third of all tasks.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share. Only in local mode, where it may
    be unset, one of our own, which goes when Python ends."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.wardline.scratch", None)
    if not folder:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="wardline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.wardline.scratch", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: lost executors cost no lineage, and rows stay as they were."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `range`, the number of the range that a row is in: all rows of a range come before all of the next by
    the columns of `order`; rows that are equal in them share a range."""
    return cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")


def carried(rows: DataFrame, key: str, value: Column, before: Column) -> DataFrame:
    """of, at, before: what a range (at) of a key (of) takes over from the key's earlier ranges, for those that have some.

    `value` sums up a range, and `before` the `value` of the earlier ranges. A key of more than one range fills all
    between its first and its last, so this has fewer rows than there are ranges, and can be sent everywhere."""
    each = rows.groupBy(F.col(key).alias("of"), F.col("range").alias("at")).agg(value.alias("value"))
    earlier = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("of").orderBy("at")
    return each.withColumns({"before": before.over(earlier), "nth": F.row_number().over(first)}).where("nth > 1").select("of", "at", "before")
