"""Incremental ingestion as Structured Streaming: late rows, repeated deliveries and daily rollups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema that they have now."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "24 hours") -> DataFrame:
    """The first delivery of each key; the state of keys older than the watermark is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there now and return it; output and progress go to the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def daily(stream: DataFrame, at: str, keys: list[str], late: str = "24 hours") -> DataFrame:
    """Rows and cents per day and key; a day comes out once the watermark has passed it."""
    day = F.window(F.col(at), "1 day")
    return stream.withWatermark(at, late).groupBy(day.alias("w"), *keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("cents").alias("cents")).select(F.col("w.start").alias("day"), *keys, "calls", "cents")
