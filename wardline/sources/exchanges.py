"""Tool-call exchanges as a table: the canonical schema, batch and streaming readers, the review sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
SCHEMA = T.StructType(
    [
        *(T.StructField(n, _TEXT) for n in ("exchange_key", "phase", "method")),
        T.StructField("service_names", T.ArrayType(_TEXT)),
        *(T.StructField(n, T.MapType(_TEXT, _TEXT)) for n in ("metadata", "headers")),
        T.StructField("payload", _TEXT),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores, as small files do, dealt to all of them by its first
    column, which needs no sorting; others stay as they are, so large inputs are never shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMA).format(form).load(path)


def read_stream(spark: SparkSession, path: str, form: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).format(form).option("maxFilesPerTrigger", files).load(path)


def decode_headers(pairs: Column) -> Column:
    """A header map of array<struct<key, value binary>>: bad bytes become U+FFFD, the last of equal names counts."""
    text = F.transform(pairs, lambda p: F.struct(p.key.alias("key"), F.make_valid_utf8(p.value.cast("string")).alias("value")))
    last = F.filter(text, lambda p, i: ~F.exists(F.slice(text, i + 2, F.size(text)), lambda x: x.key == p.key))
    return F.map_from_entries(last)


def with_decoded_headers(exchanges: DataFrame, headers: str = "headers") -> DataFrame:
    """Exchanges whose headers came as pairs of a name and bytes, with headers as SCHEMA has them."""
    return exchanges.withColumn(headers, decode_headers(F.col(headers)))


def review_payload(decided: DataFrame) -> DataFrame:
    """What a reviewer is told of exchanges that need one: metadata only, reasons cut at 512 characters."""
    rows = decided.where(F.col("decision.human_review"))
    return rows.select(F.to_json(F.struct(F.lit("human_review").alias("outcome"), F.substring("reason", 1, 512).alias("reason"), "ref", "exchange_id")).alias("body"))


def review_sink(send: Callable[[list[str]], None], batch: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands review payloads to `send` on the executors, some at a time.

    Errors of `send` are dropped: telling reviewers never holds up a stream."""

    def each(rows) -> None:
        bodies = []

        def flush() -> None:
            try:
                send(list(bodies))
            except Exception:  # noqa: BLE001
                pass
            bodies.clear()

        for row in rows:
            bodies.append(row.body)
            if len(bodies) == batch:
                flush()
        if bodies:
            flush()

    return lambda df, _: review_payload(df).foreachPartition(each)
