"""Audit JSON lines as a table, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.audit import CHAINED


def read(spark: SparkSession, path: str) -> DataFrame:
    """The objects among the lines, with file, raw line and all record fields."""
    return parse(spark.read.text(path).withColumn("file", F.input_file_name()))


def parse(lines: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, with their fields; blank and malformed ones are left out (see `malformed`)."""
    rows = lines.where(F.trim("value") != "").withColumn("json", F.try_parse_json("value"))
    rows = rows.where(F.schema_of_variant("json").startswith("OBJECT")).withColumn("r", F.from_json("value", CHAINED))
    return rows.select(*[c for c in lines.columns if c != "value"], F.col("value").alias("raw"), "r.*")


def malformed(lines: DataFrame) -> DataFrame:
    """lines, bad: how many lines aren't blank, and how many of them hold no JSON object."""
    rows = lines.where(F.trim("value") != "").withColumn("json", F.try_parse_json("value"))
    good = F.coalesce(F.schema_of_variant("json").startswith("OBJECT"), F.lit(False))
    return rows.agg(F.count("*").alias("lines"), F.count_if(~good).alias("bad"))


def write(lines: DataFrame, path: str, mode: str = "append") -> None:
    """One text line for each row of `line`, in files by stream and in order."""
    lines.repartition("stream").sortWithinPartitions("stream", "seq").select("line").write.mode(mode).text(path)
