"""Shared helpers: tables in the cluster's shared folder, and row identity."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only in local mode (tests), where it may be unset, one of our own."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.wardline.scratch", None)
    if not folder:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wardline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.conf.set("spark.wardline.scratch", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors cost no lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written and nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._cut_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text: str) -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(text), F.lit(""))


class Shielded:
    """A table under column names that no helper column has, and its own names back on what comes of it."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.docs = docs.toDF(*(f"_{k}" for k in range(len(self.names))))

    def __getitem__(self, name: str) -> str:
        """The name that stands for a column here."""
        return f"_{self.names.index(name)}"

    def columns(self, *but: str) -> list[Column]:
        """All columns, or all but some, under their own names."""
        return [F.col(f"_{k}").alias(n) for k, n in enumerate(self.names) if n not in but]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a small file of fewer partitions than there are cores is dealt to all of them, by key, which needs no sorting."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def trim() -> None:
    """Give freed memory back to the system, where there is a way to."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
