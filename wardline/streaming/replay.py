"""Tables run through a stream: parts of them arrive one after another, and each is read by a query started anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.ranges import new_folder
from wardline.streaming.traces import BATCH_ROWS, PROVIDER


@contextmanager
def settings(spark: SparkSession, **extra: str) -> Iterator[None]:
    """The session settings that queries with state need while they start; without batches that have no data, which timers would ask for without end, and with Arrow batches of BATCH_ROWS."""
    wanted = dict([PROVIDER]) | {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)} | extra
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def thirds(rows: DataFrame, at: str = "ts") -> list[Column]:
    """Conditions that part a table by time into three spans of one length."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    low, high = rows.agg(F.min(t), F.max(t)).first()
    if low is None:
        return [F.lit(True)]
    cuts = [low + (high - low) * k // 3 for k in (1, 2)]
    return [t < cuts[0], (t >= cuts[0]) & (t < cuts[1]), (t >= cuts[1]) | t.isNull()]


def through_stream(parts: Sequence[DataFrame], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of tables (of one schema) that arrive one after another, in the shared folder.

    Each part is read by a query of its own that goes on from the checkpoint of the one before, as after a restart."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    folder = new_folder(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        out = run(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        with settings(spark, **{"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}):
            query = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
